"""Streams of events: windowed flow totals, session-like alerts, latest flow state, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.session import shared_folder, ship


def flow_windows(events: DataFrame, at: Column, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Tumbling totals per flow; rows later than `late` are beyond the watermark and not counted."""
    rows = events.select("flow_id", at.alias("at"), "orig_bytes", "resp_bytes").withWatermark("at", late)
    return rows.groupBy(F.window("at", width), "flow_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("orig_bytes").alias("orig_bytes"), F.sum("resp_bytes").alias("resp_bytes")
    ).select(F.col("window.start").alias("start"), "flow_id", "n", "orig_bytes", "resp_bytes")


def alert_sessions(detections: DataFrame, at: Column, keys: list[str], gap: str = "30 seconds", late: str | None = None) -> DataFrame:
    """Detections of one key at most `gap` apart as one alert: first and last time, count, best confidence.

    The end of a session window is the last event plus the gap, and equal gaps join, as in batch. late: of a live
    stream, how far behind the newest row others may be; Spark drops rows later than that, in complete mode too, so that
    a replay in any order has none and counts every row (append mode, which needs one, says so).
    """
    rows = detections.select(*keys, at.alias("at"), "confidence")
    rows = rows.withWatermark("at", late) if late else rows
    found = rows.groupBy(F.session_window("at", gap), *keys).agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("occurrence_count"),
        F.max("confidence").alias("max_confidence")
    )
    return found.drop("session_window")


FLOW_STATE = "first_us bigint, last_us bigint, n bigint, orig_bytes bigint, resp_bytes bigint"


def _track(idle_us: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, n, sent, received = state.get
            state.remove()
            yield pd.DataFrame({
                "flow_id": [key[0]], "event": ["expired"], "first_us": [first], "last_us": [last], "n": [n], "orig_bytes": [sent],
                "resp_bytes": [received]
            })
            return
        first, last, n, sent, received = state.get if state.exists else (None, None, 0, 0, 0)
        for b in batches:
            first = int(b.us.min()) if first is None else min(first, int(b.us.min()))
            last = int(b.us.max()) if last is None else max(last, int(b.us.max()))
            n, sent, received = n + len(b), sent + int(b.orig_bytes.sum()), received + int(b.resp_bytes.sum())
        state.update((first, last, n, sent, received))
        state.setTimeoutTimestamp(max(last + idle_us, state.getCurrentWatermarkMs() * 1000 + 1000) // 1000)
        yield pd.DataFrame({
            "flow_id": [key[0]], "event": ["updated"], "first_us": [first], "last_us": [last], "n": [n], "orig_bytes": [sent],
            "resp_bytes": [received]
        })

    return step


def track_flows(events: DataFrame, at: Column, idle: int = 300, late: str = "10 minutes") -> DataFrame:
    """State of each flow after each micro-batch; idle flows (seconds of event time) leave with event `expired`."""
    ship(events.sparkSession)
    rows = events.select(
        "flow_id", at.alias("at"), F.unix_micros(at).alias("us"), F.coalesce("orig_bytes", F.lit(0)).alias("orig_bytes"),
        F.coalesce("resp_bytes", F.lit(0)).alias("resp_bytes")
    ).withWatermark("at", late)
    return rows.groupBy("flow_id").applyInPandasWithState(_track(idle * 1_000_000), f"flow_id string, event string, {FLOW_STATE}", FLOW_STATE, "update", GroupStateTimeout.EventTimeTimeout)


# Seconds between two model evaluations of a flow by its risk, and packets after which one is due anyway.
INTERVALS = {"HIGH": 0.05, "MEDIUM": 0.25, "LOW": 1.0}
PACKETS_DUE = 30


def _due(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at, packets, last = state.get if state.exists else (None, 0, 0)
    for b in batches:
        rows, due = b.sort_values(["us", "seq"]), []
        for us, n, urgent, risk in zip(rows.us, rows.packets, rows.urgent, rows.risk):
            packets += int(n)
            now = bool(urgent) or at is None or packets - last >= PACKETS_DUE or us - at >= INTERVALS.get(risk, 1.0) * 1e6
            if now:
                at, last = int(us), packets
            due.append(now)
        yield rows.assign(due=due)[["flow_id", "seq", "due"]]
    if at is not None:
        state.update((at, packets, last))


def model_schedule(events: DataFrame) -> DataFrame:
    """flow_id, seq, due: whether the models should look at the flow after this event.

    events: a stream of flow_id, seq, us, packets, urgent (the gate is not passed), risk. Due is the first event, an
    urgent one, one with enough packets since the last evaluation, or enough time for the flow's risk.
    """
    ship(events.sparkSession)
    rows = events.select("flow_id", "seq", "us", "packets", "urgent", "risk")
    return rows.groupBy("flow_id").applyInPandasWithState(
        _due, "flow_id string, seq bigint, due boolean", "at bigint, packets bigint, last bigint", "append",
        GroupStateTimeout.NoTimeout
    )


def paced(stream: DataFrame, path: str, checkpoint: str, seconds: float):
    """Replays a stream of files (maxFilesPerTrigger sets how many) at one micro-batch every `seconds`."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def drain(spark: SparkSession, stream: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there and returns its result.

    append: rows whose windows the watermark has closed, exactly once, by file sink and checkpoint. complete: the whole
    aggregate as of the last micro-batch, for replays of finite input (sessions without a watermark, see alert_sessions).
    """
    base = shared_folder(spark, purpose)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{base}/out")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{base}/out"))
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


def push_new(alerts: DataFrame, send: Callable[[list[dict]], None], checkpoint: str, at_most: int = 1000):
    """Hands every alert of each micro-batch to `send`, in lists of `at_most` or fewer.

    The driver holds one partition of the batch at a time. A batch that failed halfway is sent again as a whole.
    """

    def push(df: DataFrame, _: int) -> None:
        rows = df.toLocalIterator()
        while part := [r.asDict() for r in islice(rows, at_most)]:
            send(part)

    return alerts.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint).start()
