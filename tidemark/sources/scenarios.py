"""Deterministic traffic scenarios as packet rows, for trials and tests: expressions over spark.range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = 1_724_832_000.0
NAMES = ("benign", "syn_flood", "port_scan", "dns_tunnel", "beacon", "exfiltration")


def packets(spark: SparkSession, name: str, scale: int = 1) -> DataFrame:
    """Packets (ts, src_ip, dst_ip, src_port, dst_port, protocol, syn, ack, fin, rst, psh, wire_len, dns_query, dns_type, sni) of a scenario, `scale` times its length."""
    i = F.col("id")
    no, yes = F.lit(False), F.lit(True)
    text = lambda x: F.lit(x)
    none = F.lit(None).cast("string")

    def rows(n: int, step: float, src, dst, sport, dport, proto: str, syn=no, ack=no, size=60, query=none, kind=none, sni=none) -> DataFrame:
        return spark.range(n * scale).select(
            (F.lit(START) + i * step).alias("ts"), src.alias("src_ip"), dst.alias("dst_ip"),
            F.lit(sport).cast("int").alias("src_port") if isinstance(sport, int) else sport.cast("int").alias("src_port"),
            F.lit(dport).cast("int").alias("dst_port") if isinstance(dport, int) else dport.cast("int").alias("dst_port"),
            F.lit(proto).alias("protocol"), syn.alias("syn"), ack.alias("ack"), no.alias("fin"), no.alias("rst"), no.alias("psh"),
            (F.lit(size) if isinstance(size, int) else size).cast("int").alias("wire_len"), query.alias("dns_query"),
            kind.alias("dns_type"), sni.alias("sni")
        )

    if name == "benign":
        web = rows(
            16, 0.05, text("192.168.1.100"), text("142.250.190.46"), 50004, 443, "TCP", (i == 0), (i > 0), F.lit(200) + i * 40,
            sni=F.when(i == 3, "example.com")
        )
        return web.unionByName(rows(2, 0.02, text("192.168.1.100"), text("8.8.8.8"), 54321, 53, "UDP", query=text("example.com"), kind=text("A")))
    if name == "syn_flood":
        return rows(
            500, 0.001, F.concat(F.lit("198.51."), (i / 250).cast("int") + 100, F.lit("."), i % 250 + 1), text("192.168.1.10"),
            i % 60000 + 1024, 80, "TCP", yes
        )
    if name == "port_scan":
        return rows(100, 0.01, text("203.0.113.66"), text("192.168.1.20"), 44444, i % 65000 + 1, "TCP", yes)
    if name == "dns_tunnel":
        return rows(
            4, 0.25, text("192.168.1.50"), text("8.8.8.8"), i + 40000, 53, "UDP",
            query=F.concat(F.substring(F.md5(i.cast("string")), 1, 28), F.lit(".tunnel.example")), kind=text("TXT"), size=120
        )
    if name == "beacon":
        return rows(20, 1.0, text("192.168.1.77"), text("198.51.100.9"), 50505, 443, "TCP", no, yes, 90)
    if name == "exfiltration":
        return rows(47, 0.02, text("192.168.1.88"), text("203.0.113.200"), 51515, 443, "TCP", (i == 0), (i > 0), F.when(i < 3, 60).otherwise(1460))
    raise ValueError(f"no scenario {name}; there are {', '.join(NAMES)}")
