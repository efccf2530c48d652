"""Sensor logs in TSV or NDJSON as normalized events, and back to TSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.rejects import RECORD, read_lines, typed_records

#: what every source is brought to; columns a record lacks are null
EVENT = "ts double, event_type string, source_engine string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, flow_id string, duration double, orig_bytes bigint, resp_bytes bigint, orig_pkts bigint, resp_pkts bigint, conn_state string, history string, service string, query_name string, query_type string, answers array<string>, signature string, severity int, tls_version string, ja3 string, established boolean, http_method string, uri string, user_agent string, status_code int, source_id string, category string, action string, signature_id int, gid int, rev int, subject string, issuer string, ja3s string, request_body_len bigint"


def as_events(df: DataFrame) -> DataFrame:
    """`df` with exactly the columns of EVENT; missing ones are null, flow_id is made where it is missing."""
    known = [c.strip().rsplit(" ", 1) for c in EVENT.split(", ")]
    out = df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in known])
    made = F.concat(
        F.col("src_ip"), F.lit(":"), F.col("src_port"), F.lit(" -> "), F.col("dst_ip"), F.lit(":"), F.col("dst_port"),
        F.lit(" ["), F.col("protocol"), F.lit("]")
    )
    return out.withColumn("flow_id", F.coalesce("flow_id", made))


def read_folder(spark: SparkSession, path: str, names: str = "*.log") -> DataFrame:
    """Lines of all log files below `path`, each once: line_id, file_name, line_no, raw_line. One file is one row of the scan."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", names).text(path)
    lines = files.select(F.col("_metadata.file_path").alias("file_name"), F.posexplode(F.split("value", "\n")).alias("line_no", "raw_line"))
    return lines.select(F.xxhash64("file_name", "line_no").alias("line_id"), "file_name", (F.col("line_no") + 1).alias("line_no"), "raw_line")


def events(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of log lines. The kind of record follows from its fields."""
    read = read_lines(lines)
    r = typed_records(read)
    some = lambda *c: F.coalesce(*c).isNotNull()
    kind = F.when(some("query", "qtype_name"), "dns").when(
        some("cipher", "server_name", "version"), "tls"
    ).when(some("method", "host", "uri"), "http").otherwise("connection")
    dns, http = kind == "dns", kind == "http"
    port = F.when(dns, 53).when(kind == "tls", 443).when(http, 80).otherwise(0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = r.select(
        "ts",
        kind.alias("event_type"),
        F.lit("zeek").alias("source_engine"),
        F.coalesce("orig_h", F.lit("0.0.0.0")).alias("src_ip"),
        F.coalesce("resp_h", F.lit("0.0.0.0")).alias("dst_ip"),
        F.coalesce("orig_p", F.lit(0)).alias("src_port"),
        F.coalesce("resp_p", port).alias("dst_port"),
        F.upper(F.coalesce("proto", F.when(dns, "udp").otherwise("tcp"))).alias("protocol"),
        F.coalesce("duration", F.lit(0.0)).alias("duration"),
        *[zero(c) for c in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")],
        "conn_state",
        "history",
        "service",
        F.coalesce("query", "server_name", "host").alias("query_name"),
        F.col("qtype_name").alias("query_type"),
        "answers",
        F.col("version").alias("tls_version"),
        "ja3",
        "established",
        F.when(http, F.upper(F.coalesce("method", F.lit("GET")))).alias("http_method"),
        F.when(http, F.coalesce("uri", F.lit("/"))).alias("uri"),
        "user_agent",
        F.when(http, F.coalesce("status_code", F.lit(200))).alias("status_code"),
        F.col("uid").alias("source_id"),
        "subject",
        "issuer",
        "ja3s",
        F.when(http, F.coalesce("request_body_len", F.lit(0))).alias("request_body_len"),
    )
    return as_events(out), read.where(F.col("reason").isNotNull()).select("line_id", "file", "at", "line", "reason")


CONN = [
    "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "duration", "orig_bytes", "resp_bytes",
    "conn_state", "missed_bytes", "history", "orig_pkts", "resp_pkts"
]


def header(fields: list[str], path: str) -> list[str]:
    return ["#separator \\x09", "#set_separator\t,", "#empty_field\t(empty)", "#unset_field\t-", f"#path\t{path}", "#fields\t" + "\t".join(fields)]


def to_tsv(records: DataFrame, fields: list[str]) -> DataFrame:
    """Typed records as TSV lines (column value) in the order of `fields`; null is the unset mark."""
    kinds = dict(records.dtypes)

    def text(n: str) -> Column:
        name = RECORD[n][0] if n in RECORD else n
        # a double as text may be in powers of ten, which no log has
        value = F.format_string("%.6f", F.col(name)) if kinds[name] == "double" else F.col(name).cast("string")
        return F.when(F.col(name).isNotNull(), value).otherwise("-")

    return records.select(F.concat_ws("\t", *[text(n) for n in fields]).alias("value"))


DNS = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "query", "qtype_name", "rcode", "answers"]
SSL = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "version", "server_name", "established"]


def records_of(packets: DataFrame) -> dict[str, DataFrame]:
    """Connection, DNS and TLS records (columns as typed_records) of packets: conn, one per flow; dns, one per packet with a
    query; ssl, one per packet with a server name. A flow of one lone SYN has state S0, any other SF."""
    c = F.col
    ends = [c("src_ip").alias("orig_h"), c("src_port").alias("orig_p"), c("dst_ip").alias("resp_h"), c("dst_port").alias("resp_p")]
    ok = packets.where(c("status") == "ok") if "status" in packets.columns else packets
    uid = lambda *x: F.substring(F.md5(F.concat_ws("|", *x)), 1, 16).alias("uid")
    key = ["src_ip", "src_port", "dst_ip", "dst_port", "protocol"]
    flows = ok.groupBy(*key).agg(
        F.min("ts").alias("ts"), F.max("ts").alias("last"), F.sum("wire_len").alias("bytes"), F.count(F.lit(1)).alias("n"),
        F.min_by(F.coalesce("syn", F.lit(False)), "ts").alias("syn")
    )
    service = F.when((c("src_port") == 53) | (c("dst_port") == 53), "dns").when(c("dst_port") == 443, "ssl")
    conn = flows.select(
        "ts", uid(*key), *ends, F.lower("protocol").alias("proto"), service.alias("service"), F.greatest(
            F.lit(1e-4), c("last") - c("ts")
        ).alias("duration"), c("bytes").alias("orig_bytes"), F.lit(0).cast("bigint").alias("resp_bytes"),
        F.when(
            c("syn") & (c("n") == 1), "S0"
        ).otherwise("SF").alias("conn_state"), F.lit(0).cast("bigint").alias("missed_bytes"), F.when(
            c("syn"), "S"
        ).otherwise("ShADdFaf").alias("history"), c("n").alias("orig_pkts"), F.lit(0).cast("bigint").alias("resp_pkts"),
    )
    both = [c(n) if n in ok.columns else F.lit(None).alias(n) for n in ("dns_rcode", "dns_answers")]
    named = ok.select("*", *[x for x, n in zip(both, ("dns_rcode", "dns_answers")) if n not in ok.columns])
    dns = named.where(c("dns_query").isNotNull()).select(
        "ts", uid(*key, "ts"), *ends, F.lit("udp").alias("proto"), c("dns_query").alias("query"),
        F.coalesce("dns_type", F.lit("A")).alias("qtype_name"), F.coalesce(c("dns_rcode").cast("int"), F.lit(0)).alias("rcode"),
        F.nullif(F.array_join(c("dns_answers").cast("array<string>"), ","), F.lit("")).alias("answers")
    )
    ssl = ok.where(c("sni").isNotNull()).select(
        "ts", uid(*key, "ts"), *ends, F.lit("TLSv1.3").alias("version"), c("sni").alias("server_name"),
        F.lit("T").alias("established")
    )
    return {"conn": conn, "dns": dns, "ssl": ssl}
