from pyspark.sql import functions as F

from tidemark.operators.alerts import newest
from tidemark.sources import zeek
from tidemark.streaming.pipeline import alert_sessions, drain, flow_windows, model_schedule, push_new, track_flows


def stream(spark, folder, rows, schema, files=1):
    df = spark.createDataFrame(rows, schema)
    for k in range(files):
        df.where(F.lit(k) == F.col(df.columns[-1])).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_schedule(spark, tmp_path):
    rows = [
        ("f", 0, 0, 1, False, "LOW"), ("f", 1, 400_000, 1, False, "LOW"), ("f", 2, 500_000, 1, False, "HIGH"),
        ("f", 3, 600_000, 30, False, "LOW"), ("f", 4, 700_000, 1, True, "LOW"), ("f", 5, 1_800_000, 1, False, "LOW"),
        ("g", 6, 0, 1, False, "LOW")
    ]
    s = stream(
        spark, tmp_path, [(*r, 0) for r in rows],
        "flow_id string, seq bigint, us bigint, packets bigint, urgent boolean, risk string, part int"
    )
    got = {r.seq: r.due for r in drain(spark, model_schedule(s), "schedule").collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 4: True, 5: True, 6: True}


def test_windows_and_sessions(spark, tmp_path):
    rows = [("f", t, 10, 1, 0.5 + t / 1000, 0) for t in (0, 10, 40, 71, 130)]
    s = stream(spark, tmp_path, rows, "flow_id string, t int, orig_bytes bigint, resp_bytes bigint, confidence double, part int")
    at = F.timestamp_seconds("t")
    w = {r.start.timestamp(): r.n for r in drain(spark, flow_windows(s, at), "w", "complete").collect()}
    assert w == {0: 3, 60: 1, 120: 1}
    a = sorted((
        r.first_at.timestamp(), r.last_at.timestamp(), r.occurrence_count
    ) for r in drain(spark, alert_sessions(s, at, ["flow_id"]), "s", "complete").collect())
    assert a == [(0, 40, 3), (71, 71, 1), (130, 130, 1)]  # thirty seconds apart is one alert, thirty-one are two


def test_replays_in_any_order_lose_nothing(spark, tmp_path):
    times = (1_000_000, 1_000_040, 500_000, 10, 1_000_020, 500_020)
    rows = [("f", t, 10, 1, 0.5, k) for k, t in enumerate(times)]
    s = stream(spark, tmp_path, rows, "flow_id string, t int, orig_bytes bigint, resp_bytes bigint, confidence double, part int", files=len(rows))
    at = F.timestamp_seconds("t")
    a = sorted((
        r.first_at.timestamp(), r.last_at.timestamp(), r.occurrence_count
    ) for r in drain(spark, alert_sessions(s, at, ["flow_id"]), "s", "complete").collect())
    assert a == [(10, 10, 1), (500_000, 500_020, 2), (1_000_000, 1_000_040, 3)]
    assert sum(r.n for r in drain(spark, flow_windows(s, at), "w", "complete").collect()) == len(rows)


def test_tracked_flows_expire(spark, tmp_path):
    rows = [("f", 1000, 1, 2, 0), ("f", 1005, 1, 2, 0), ("g", 100_000, 1, 1, 1), ("g", 100_001, 1, 1, 2), ("g", 100_002, None, 1, 3)]
    s = stream(spark, tmp_path, rows, "flow_id string, t int, orig_bytes bigint, resp_bytes bigint, part int", files=4)
    out = []
    q = track_flows(
        s, F.timestamp_seconds("t"), idle=60, late="1 second"
    ).writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option(
        "checkpointLocation", str(tmp_path / "c")
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {(r.flow_id, r.event): (r.n, r.orig_bytes) for r in out}
    assert last["f", "updated"] == (2, 2) and last["f", "expired"] == (2, 2) and last["g", "updated"] == (3, 2)


def test_every_alert_of_a_batch_is_pushed(spark, tmp_path):
    s = stream(spark, tmp_path, [(k, 0) for k in range(2503)] + [(k, 1) for k in range(3000, 3007)], "id int, part int", files=2)
    sent = []
    q = push_new(s, sent.append, str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert sorted(r["id"] for part in sent for r in part) == [*range(2503), *range(3000, 3007)]
    assert sorted(map(len, sent)) == [7, 503, 1000, 1000]


def test_tls_and_http_records(spark):
    ssl = zeek.header(["ts", "id.orig_h", "version", "server_name", "established"], "ssl") + ["1724832000\t10.0.0.1\tTLSv13\ta.example\tF"]
    http = zeek.header(["ts", "id.orig_h", "method", "host", "status_code"], "http") + ["1724832001\t10.0.0.1\tpost\tb.example\t-"]
    rows = [(f"{n}{k}", n, k, x) for n, xs in (("s", ssl), ("h", http)) for k, x in enumerate(xs)]
    events, _ = zeek.events(spark.createDataFrame(rows, "line_id string, file_name string, line_no int, raw_line string"))
    tls, web = sorted(events.collect(), key=lambda r: r.ts)
    assert (tls.event_type, tls.dst_port, tls.query_name, tls.established, tls.tls_version) == ("tls", 443, "a.example", False, "TLSv13")
    assert (web.event_type, web.dst_port, web.http_method, web.status_code) == ("http", 80, "POST", 200)


def test_newest(spark):
    assert [r.id for r in newest(spark.range(5), "id", 2).collect()] == [4, 3]
