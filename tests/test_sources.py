import json
import struct

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import packets
from tidemark.operators.models import IsolationForest
from tidemark.sources import bus, eve, folder, pcap, scenarios, zeek

CONN = zeek.header(zeek.CONN, "conn") + [
    "1724832000.5\tC1\t10.0.0.1\t5000\t10.0.0.2\t80\ttcp\thttp\t1.5\t100\t200\tSF\t0\tShADadfF\t4\t5",
    "1724832001.5\tC2\t10.0.0.1\t5001\t10.0.0.2\t80\ttcp\t-\t-\t-\t-\tS0\t0\tS\t1\t0",
    "short\trow",
]


def test_zeek_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "conn.log").write_text("\n".join(CONN) + "\n")
    (tmp_path / "dns.log").write_text('{"ts": 1724832002.0, "id.orig_h": "10.0.0.9", "query": "x.example", "answers": ["192.0.2.1"]}\nnot json\n')
    events, rejected = zeek.events(zeek.read_folder(spark, str(tmp_path)))
    rows = sorted(events.collect(), key=lambda r: r.ts)
    assert [(r.event_type, r.flow_id, r.duration, r.orig_bytes) for r in rows] == [
        ("connection", "10.0.0.1:5000 -> 10.0.0.2:80 [TCP]", 1.5, 100),
        ("connection", "10.0.0.1:5001 -> 10.0.0.2:80 [TCP]", 0.0, 0), ("dns", "10.0.0.9:0 -> 0.0.0.0:53 [UDP]", 0.0, 0)
    ]
    assert rows[2].answers == ["192.0.2.1"]
    assert sorted(r.reason for r in rejected.collect()) == ["column_count", "json_syntax"]


def test_eve(spark, tmp_path):
    lines = [
        {
            "timestamp": "2024-08-28T08:00:00.123456+0000", "event_type": "flow", "src_ip": "10.0.0.1", "src_port": 1,
            "dest_ip": "10.0.0.2", "dest_port": 2, "proto": "tcp",
            "flow": {"pkts_toserver": 3, "bytes_toserver": 30, "age": 4, "state": "closed"}
        },
        {
            "timestamp": "2024-08-28T08:00:01Z", "event_type": "dns", "src_ip": "10.0.0.1",
            "dns": {"rrname": "a.b", "rrtype": "A", "grouped": {"A": ["192.0.2.7"]}}
        },
        {"timestamp": "2024-08-28T08:00:02Z", "event_type": "alert", "alert": {"signature": "s", "severity": 1}},
        {"timestamp": "CORRUPT", "event_type": "flow"},
        {"timestamp": "2024-08-28T08:00:03Z", "event_type": "stats"},
    ]
    (tmp_path / "eve.json").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    raw = eve.read(spark, str(tmp_path / "eve.json")).cache()
    rows = {r.event_type: r for r in eve.events(raw).collect()}
    assert rows["connection"].ts == 1724832000.123456 and rows["connection"].duration == 4 and rows["connection"].resp_bytes == 0
    assert rows["dns"].query_name == "a.b" and rows["dns"].answers == ["192.0.2.7"] and rows["alert"].signature == "s"
    assert sorted(r.reason for r in eve.rejects(raw).collect()) == ["bad_ts", "json_syntax", "unknown_type"]
    back = bus.parse(bus.messages(eve.events(raw)).select("key", F.encode("value", "UTF-8").alias("value")))
    assert back.count() == 3 and back.where("event_type = 'dns'").first().query_name == "a.b"


def tcp(src, dst, sport, dport, flags, payload=b""):
    body = struct.pack(">HHIIBBHHH", sport, dport, 7, 0, 5 << 4, flags, 1024, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, 6, 0, bytes(src), bytes(dst))
    return b"\0" * 12 + b"\x08\x00" + ip + body


def hello(name):
    sni = struct.pack(">HHHBH", 0, len(name) + 5, len(name) + 3, 0, len(name)) + name
    body = b"\x03\x03" + b"\0" * 32 + b"\0" + struct.pack(">H", 2) + b"\x13\x01" + b"\x01\0" + struct.pack(">H", len(sni)) + sni
    shake = b"\x01" + struct.pack(">I", len(body))[1:] + body
    return b"\x16\x03\x01" + struct.pack(">H", len(shake)) + shake


def test_dns_answers_and_their_code():
    head = struct.pack(">HHHHHH", 1, 0x8183, 1, 2, 0, 0)
    question = b"\x01a\x07example\0" + struct.pack(">HH", 1, 1)
    answer = lambda name: name + struct.pack(">HHIH", 1, 1, 60, 4) + bytes([192, 0, 2, 1])
    full = head + question + answer(b"\xc0\x0c") + answer(b"\x01b\xc0\x0e")
    assert pcap._dns(full) == ("a.example", "A", True, 3, ["a.example", "b.example"])
    assert pcap._dns(full[:-6]) == ("a.example", "A", True, 3, ["a.example"])
    assert pcap._dns(head + b"\xc0\x0c" + b"\0" * 4) == (None, None, True, 3, [])  # a pointer at itself
    assert pcap._dns(b"short") == (None, None, None, None, None)


def test_records_of_packets(spark, tmp_path):
    p = scenarios.packets(spark, "benign")
    records = zeek.records_of(p)
    fields = {"conn": zeek.CONN, "dns": zeek.DNS, "ssl": zeek.SSL}
    for kind, df in records.items():
        lines = [r.value for r in zeek.to_tsv(df, fields[kind]).collect()]
        (tmp_path / f"{kind}.log").write_text("\n".join(zeek.header(fields[kind], kind) + lines) + "\n")
    (tmp_path / "eve.json").write_text("\n".join(r.value for r in eve.of_packets(p).collect()))
    found = folder.read(spark, str(tmp_path))
    kinds = {(r.source_engine, r.event_type): r.n for r in found.groupBy("source_engine", "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds == {("zeek", "connection"): 2, ("zeek", "dns"): 2, ("zeek", "tls"): 1, ("suricata", "connection"): 18}
    conn = found.where("source_engine = 'zeek' and event_type = 'connection' and dst_port = 443").first()
    assert (conn.orig_pkts, conn.conn_state, conn.service) == (16, "SF", "ssl")
    ordered = folder.in_order(found).collect()
    assert [r.ts for r in ordered] == sorted(r.ts for r in ordered) and ordered == folder.in_order(found.repartition(7)).collect()
    lone = zeek.records_of(scenarios.packets(spark, "port_scan"))["conn"]
    assert {r.conn_state for r in lone.collect()} == {"S0"} and lone.count() == 100


def test_eve_details(spark, tmp_path):
    lines = [
        {"timestamp": "2024-08-28T08:00:00Z", "flow_id": 7, "event_type": "alert", "alert": {"signature_id": 5}},
        {"timestamp": "2024-08-28T08:00:00Z", "event_type": "tls", "tls": {"subject": "CN=a", "issuerdn": "CN=b", "ja3s": {"hash": "x"}}},
        {"timestamp": "2024-08-28T08:00:00Z", "event_type": "http", "http": {"http_method": "post", "hostname": "h", "length": 9}},
    ]
    (tmp_path / "eve.json").write_text("\n".join(map(json.dumps, lines)))
    rows = {r.event_type: r for r in eve.events(eve.read(spark, str(tmp_path / "eve.json"))).collect()}
    a, t, h = rows["alert"], rows["tls"], rows["http"]
    assert (
        a.source_id, a.signature, a.category, a.severity, a.action, a.gid, a.rev
    ) == ("alert_7_5", "Unknown Signature", "Security Threat", 3, "allowed", 1, 1)
    assert (t.subject, t.issuer, t.ja3s, t.severity) == ("CN=a", "CN=b", "x", None)
    assert (h.http_method, h.uri, h.status_code, h.request_body_len) == ("POST", "/", 200, 9)


def test_packet_predictions(spark):
    v = packets.vectors(scenarios.packets(spark, "dns_tunnel").unionByName(scenarios.packets(spark, "benign")))
    got = {r.src_ip: (r.prediction, r.confidence, r.method) for r in packets.predict(
        v.where("dns_entropy_mean > 0"), F.lit("benign"), F.lit(0.9)
    ).collect()}
    assert got["192.168.1.50"] == ("dns_dga", 1.0, "RULE_BASED") and got["192.168.1.100"] == ("benign", 0.9, "MODEL_BASED")
    sure = packets.predict(v, F.lit("benign"), F.lit(1.0)).select("method").distinct().collect()
    assert [r.method for r in sure] == ["MODEL_BASED"]  # a rule must be surer than the model


def dns_frame():
    query = struct.pack(">HHHHHH", 1, 0x0100, 1, 0, 0, 0) + b"\x06google\x03com\0" + struct.pack(">HH", 16, 1)
    body = struct.pack(">HHHH", 5353, 53, 8 + len(query), 0) + query
    return b"\0" * 12 + b"\x08\x00" + struct.pack(
        ">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, 17, 0, bytes([1, 1, 1, 1]), bytes([8, 8, 8, 8])
    ) + body


def test_pcap(spark, tmp_path):
    frames = [
        tcp([10, 0, 0, 1], [10, 0, 0, 2], 50000, 443, 2),
        tcp([10, 0, 0, 1], [10, 0, 0, 2], 50000, 443, 24, hello(b"example.com")), dns_frame(), b"1234",
        b"\0" * 12 + b"\x08\x00" + b"\x45\0\0", b"\0" * 12 + b"\x08\x06" + b"\0" * 40
    ]
    data = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(
        struct.pack("<IIII", 1724832000, k * 1000, len(f), len(f)) + f for k, f in enumerate(frames)
    )
    (tmp_path / "x.pcap").write_bytes(data)
    pcap.register(spark)
    rows = sorted(spark.read.format("pcap").load(str(tmp_path)).collect(), key=lambda r: r.ts)
    assert [r.status for r in rows] == ["ok", "ok", "ok", "malformed", "truncated_ip", "not_ip"]
    assert rows[0].syn and not rows[0].ack and rows[1].psh and rows[1].sni == "example.com" and rows[0].src_ip == "10.0.0.1"
    assert (rows[2].dns_query, rows[2].dns_type, rows[2].dns_response) == ("google.com", "TXT", False)
    stats = packets.ingest_stats(spark.read.format("pcap").load(str(tmp_path / "x.pcap"))).first()
    assert (stats.n_packets, stats.n_valid, stats.n_malformed) == (6, 3, 3)
    assert spark.read.format("pcap").option("limit", 2).load(str(tmp_path / "x.pcap")).count() == 2


def test_scenarios_are_recognised(spark):
    got = {}
    for name in scenarios.NAMES:
        v = packets.heuristics(packets.vectors(scenarios.packets(spark, name)))
        assert v.where(" or ".join(f"isnan({c})" for c, t in v.dtypes if t == "double")).count() == 0
        got[name] = {r.heuristic for r in v.select("heuristic").distinct().collect()} - {None}
    assert got["port_scan"] == {"PORT_SCAN"} and got["beacon"] == {"C2_BEACONING"} and got["dns_tunnel"] == {"DGA_DNS_TUNNELLING"} and got["exfiltration"] == {"DATA_EXFILTRATION"} and got["benign"] == set()


def test_isolation_forest_ranks_outliers_first():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(600, 4))
    forest = IsolationForest(x, 60, 128)
    scores = forest.score(np.concatenate([x, np.full((5, 4), 9.0)]))
    assert scores[600:].max() < np.quantile(scores[:600], 0.01) and (np.abs(scores) <= 0.5).all()
    assert (forest.score(x) == IsolationForest(x, 60, 128).score(x)).all()


def test_models_have_the_trees_of_the_reference(spark, data, monkeypatch):
    from tidemark.operators import models
    from tidemark.plans.registry import QUERIES

    asked = {}
    forest, fit = models.isolation_forest, models.random_forest
    monkeypatch.setattr(models, "isolation_forest", lambda *a, **k: asked.update(anomaly_scores=k.get("trees")) or forest(*a, **k))
    monkeypatch.setattr(models, "random_forest", lambda *a, **k: asked.update(model_classes=k.get("trees")) or fit(*a, **k))
    for name in ("anomaly_scores", "model_classes"):
        QUERIES[name](spark, data)
    assert asked == {"anomaly_scores": 300, "model_classes": 300}
