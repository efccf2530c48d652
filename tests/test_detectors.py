import pytest
from pyspark.sql import functions as F

from tidemark.operators import detectors
from tidemark.operators.alerts import dedup_savings, deduplicate, page, previous_within, search, statistics
from tidemark.operators.features import ORDER


def vector(spark, **values):
    return spark.createDataFrame([tuple(float(values.get(n, 0.0)) for n in ORDER)], ", ".join(f"{n} double" for n in ORDER))


BOUNDS = [
    ("ddos", 0.95, dict(syn_ratio=0.80, src_ip_entropy=2.5), dict(syn_ratio=0.79, src_ip_entropy=2.5)),
    ("ddos", 0.95, dict(syn_ratio=0.80, dst_in_degree=5), dict(syn_ratio=0.80, src_ip_entropy=2.4, dst_in_degree=4)),
    ("ddos", 0.85, dict(packet_rate=50), dict(packet_rate=49.9)),
    ("ddos", 0.90, dict(udp_rate=50, byte_amplification_ratio=3.1), dict(udp_rate=50, byte_amplification_ratio=3)),
    ("scan", 0.92, dict(unique_dst_ports=10, dst_port_fanout=2), dict(unique_dst_ports=9, dst_port_fanout=2)),
    ("scan", 0.88, dict(unique_dst_hosts=8, dst_host_fanout=2), dict(unique_dst_hosts=8, dst_host_fanout=1.9)),
    ("scan", 0.85, dict(conn_attempts=15, failed_conn_ratio=0.6), dict(conn_attempts=14, failed_conn_ratio=1)),
    ("dns", 0.90, dict(shannon_entropy_mean=3.4, query_len_mean=15), dict(shannon_entropy_mean=3.39, query_len_mean=15)),
    ("dns", 0.93, dict(txt_record_ratio=0.5), dict(txt_record_ratio=0.49)),
    (
        "dns", 0.80, dict(query_frequency=5, query_len_mean=15, shannon_entropy_mean=3),
        dict(query_frequency=4.9, query_len_mean=15, shannon_entropy_mean=3)
    ),
    ("c2", 0.88, dict(repeated_conn_count=5, iat_cv=0.15, iat_mean=0.5), dict(repeated_conn_count=4, iat_cv=0.1, iat_mean=1)),
    ("c2", 0.75, dict(repeated_dst_freq=2, repeated_conn_count=5, iat_cv=0.3, periodicity_score=0.08, iat_mean=0.4999), None),
    (
        "exfil", 0.90, dict(outbound_bytes=25000, out_in_byte_ratio=8, asymmetric_traffic_score=0.75),
        dict(outbound_bytes=24999, out_in_byte_ratio=9, asymmetric_traffic_score=0.9)
    ),
    ("exfil", 0.85, dict(outbound_bytes=25000, outbound_rate=10000), dict(outbound_bytes=25000, outbound_rate=9999)),
    ("encrypted", 0.75, dict(tls_version_num=1.2), dict(tls_version_num=1.2, has_tls_sni=1)),
]


@pytest.mark.parametrize("name, score, hit, miss", BOUNDS)
def test_boundaries(spark, name, score, hit, miss):
    def run(values):
        found = vector(spark, **values).select(F.explode(detectors.detect(F.lit(50000), F.lit(443))).alias("d")).select("d.*").collect()
        return {r.detector: (r.triggered, r.score, r.reason) for r in found}

    if miss is None:  # a value just below its limit
        assert not run(hit)[name][0]
        return
    assert run(hit)[name][:2] == (True, score) and run(hit)[name][2]
    base = {"iat_cv": 1.0} if name != "c2" else {}
    assert run(base | miss)[name] == (False, 0.0, "")


def test_server_answers_are_no_exfiltration(spark):
    v = vector(spark, outbound_bytes=50_000, out_in_byte_ratio=9, asymmetric_traffic_score=0.8)
    hit = lambda port: v.select(F.exists(
        detectors.detect(F.lit(port).cast("int"), F.lit(50000)), lambda d: d["triggered"] & (d["detector"] == "exfil")
    ).alias("x")).first().x
    assert not hit(443) and hit(50123) and hit(None)


CALM = dict(
    syn_ratio=0.0, packet_rate=1.0, ports=1.0, port_fanout=0.0, hosts=1.0, host_fanout=0.0, query_length=None, txt_ratio=0.0,
    out_bytes=0, out_in_ratio=0.0, src_port=50000, dst_port=443, n_times=1, tls=False, sni=False
)
GATE = [
    ({}, ("PASS_NORMAL", "BENIGN", 0.0)),
    (dict(syn_ratio=0.45), ("SUSPICIOUS", None, 0.65)),
    (dict(packet_rate=80.0), ("CRITICAL_RULE", "DDOS", 0.95)),
    (dict(ports=10.0), ("CRITICAL_RULE", "PORT_SCAN", 0.92)),
    (dict(hosts=8.0), ("CRITICAL_RULE", "PORT_SCAN", 0.88)),
    (dict(hosts=3.0), ("SUSPICIOUS", None, 0.60)),
    (dict(query_length=15), ("SUSPICIOUS", None, 0.70)),
    (dict(query_length=14, txt_ratio=0.35), ("CRITICAL_RULE", "DGA_DNS_TUNNELLING", 0.93)),
    (dict(out_bytes=15000, out_in_ratio=20.0), ("CRITICAL_RULE", "DATA_EXFILTRATION", 0.90)),
    (dict(out_bytes=14999, out_in_ratio=20.0), ("PASS_NORMAL", "BENIGN", 0.0)),
    (dict(n_times=4), ("SUSPICIOUS", None, 0.55)),
    (dict(tls=True), ("SUSPICIOUS", None, 0.75)),
    (dict(packet_rate=90.0, query_length=30), ("CRITICAL_RULE", "DGA_DNS_TUNNELLING", 0.95)),
]


def test_gate(spark):
    kinds = {"query_length": "int", "txt_ratio": "double"}
    for change, want in GATE:
        state = {k: F.lit(v).cast(kinds[k]) if k in kinds else F.lit(v) for k, v in (CALM | change).items()}
        assert tuple(spark.range(1).select(*[c.alias(k) for k, c in detectors.gate(state).items()]).first()) == want


def test_fusion_table(spark):
    def run(model, conf, odd, **values):
        v = vector(spark, iat_cv=1.0, **values)
        out = detectors.fuse(detectors.detect(F.lit(50000), F.lit(80)), F.lit(model), F.lit(conf), F.lit(-0.1), F.lit(odd))
        return tuple(v.select(*[c.alias(k) for k, c in out.items()]).first())

    assert run("BENIGN", 0.9, False, packet_rate=60) == ("DDOS", "B", 0.85, "BEHAVIORAL_RULE")
    assert run("BENIGN", 0.9, False, packet_rate=60, outbound_bytes=30000, outbound_rate=10000)[0] == "DATA_EXFILTRATION"  # by priority
    assert run("PORT_SCAN", 0.8, False, packet_rate=60) == ("PORT_SCAN", "B", 0.8, "MODEL_SUPERVISED")
    assert run("DDOS", 0.8, True, packet_rate=60)[:2] == ("DDOS", "B")  # state A can't be reached: the rule takes it
    assert run("BENIGN", 0.8, True) == ("UNKNOWN_ANOMALY", "C", 0.8, "MODEL_ANOMALY")
    assert run("BENIGN", 0.9, True) == ("BENIGN", "D", 0.9, "MODEL_SUPERVISED")  # the anomaly model is bypassed
    assert run("DDOS", 0.6, False)[0] == "BENIGN"
    gated = {"decision": F.lit("SUSPICIOUS"), "threat_class": F.lit(None).cast("string"), "urgency": F.lit(0.6)}
    v = vector(spark, iat_cv=1.0)
    out = detectors.fuse_gated(gated, detectors.detect(F.lit(1), F.lit(1)), F.lit("DDOS"), F.lit(0.78), F.lit(-0.1), F.lit(True))
    assert v.select(out["state"].alias("s")).first().s == "A"  # in the selective table it can


def test_severity_and_evidence(spark):
    def sev(label, conf, **values):
        return vector(spark, **values).select(detectors.severity(F.lit(label), F.lit(conf)).alias("s")).first().s

    assert sev("BENIGN", 1.0) == "INFO" and sev("DDOS", 0.9) == "CRITICAL" and sev("DDOS", 0.8) == "HIGH"
    assert sev("PORT_SCAN", 1.0, unique_dst_ports=25) == "HIGH" and sev("PORT_SCAN", 1.0) == "MEDIUM"
    assert sev("UNKNOWN_ANOMALY", 0.69) == "LOW" and sev("C2_BEACONING", 0.1, periodicity_score=0.2) == "CRITICAL"
    texts, values = detectors.evidence(F.lit("PORT_SCAN"))
    r = vector(spark, unique_dst_ports=20, conn_attempts=30).select(texts.alias("t"), values.alias("v")).first()
    assert len(r.t) == 2 and r.v == {"unique_dst_ports": 20.0, "conn_attempts": 30.0, "failed_conn_ratio": 0.0}


def test_dedup_counts_and_frozen_columns(spark):
    rows = [("f", k * 500_000, 0.5 + k / 100, f"n{k}") for k in range(10)] + [("f", 4_500_000 + 30_000_000, 0.1, "edge"), ("f", 70_000_001, 0.2, "new"), ("g", 0, 0.9, "x")]
    df = spark.createDataFrame(rows, "flow string, us bigint, conf double, note string")
    for block in (1_000_000, 3_600_000_000):
        got = sorted(tuple(r)[1:] for r in deduplicate(df, ["flow"], "us", "conf", ["note"], block_us=block).collect())
        assert got == [("f", 0, 34_500_000, 11, 0.59, "n0"), ("f", 70_000_001, 70_000_001, 1, 0.2, "new"), ("g", 0, 0, 1, 0.9, "x")]
    assert spark.range(1).select(dedup_savings(F.lit(1), F.lit(2)).alias("s")).first().s == 0.5


def test_alert_queries(spark):
    rows = [(1, "A1", "f1", "DDOS", "HIGH", "RULE", 2), (2, "A2", "f2", "BENIGN", "INFO", None, 1), (3, "A3", "f1", "ddos", "high", "RULE", 1)]
    a = spark.createDataFrame(
        rows,
        "k int, alert_id string, flow_id string, threat_class string, severity string, detection_method string, occurrence_count bigint"
    )
    assert [r.k for r in page(a, "k", 2, 0, severity="High").collect()] == [3, 1]
    assert [r.k for r in page(a, "k", 5, 1, exclude_benign=True).collect()] == [1]
    assert search(a, "F1").count() == 2 and search(a, "a2").count() == 1 and search(a, "all").count() == 3
    stats = {(r.facet, r.value): (r.n_alerts, r.n_events) for r in statistics(a).collect()}
    assert stats["total", "all"] == (3, 4) and stats["detection_method", "none"] == (1, 1) and stats["severity", "INFO"] == (1, 1)
    d = spark.createDataFrame([("f", 0), ("f", 30), ("f", 61)], "flow string, us bigint")
    assert [r.previous_us for r in previous_within(d, ["flow"], "us", 30).orderBy("us").collect()] == [None, 0, None]
