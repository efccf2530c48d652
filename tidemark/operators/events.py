"""The normalized network event: one wide table, whatever the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sessions import first_copies

COLUMNS = [
    "row_id", "timestamp", "event_type", "sensor_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "flow_id",
    "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "conn_state", "service", "query_name"
]
#: columns of the protocols above, carried where the deliveries have them
DETAILS = ["history", "query_type", "tls_version", "ja3"]
#: connection states of attempts that failed, and those that count as SYN without answer
# Fixed values.
FAILED = ("S0", "REJ", "RSTO", "RSTOS0")


def deliveries_of(events: DataFrame) -> DataFrame:
    """Events of a source (schema sources.zeek.EVENT) as deliveries, the sensor being the engine.

    Logs name no delivery, so every record is one; its row_id follows from its content, and equal records are numbered.
    """
    content = F.xxhash64(*[F.col(c) for c in events.columns])
    rows = events.select("*", content.alias("__content"))
    rows = rows.select("*", F.row_number().over(Window.partitionBy("__content").orderBy("__content")).alias("__copy"))
    row_id = F.when(F.col("__copy") == 1, F.col("__content")).otherwise(F.xxhash64("__content", "__copy"))
    return rows.select(
        F.col("ts").alias("timestamp"), F.col("source_engine").alias("sensor_id"), F.lit(None).cast("string").alias("event_id"),
        row_id.alias("row_id"), *[c for c in events.columns if c != "ts"]
    )


def normalize(deliveries: DataFrame) -> DataFrame:
    """One row per message: seq, us and the connection columns with the defaults of the data model.

    Repeated deliveries, and rows without a usable time, source or destination, are left out;
    missing counts are 0, event type and sensor are lower case, protocol and state upper case. Events of
    sources/zeek.py and eve.py are taken too. history, query_type, tls_version and ja3 stay where there are any.
    """
    if "row_id" not in deliveries.columns:
        deliveries = deliveries_of(deliveries)
    details = [c for c in DETAILS if c in deliveries.columns]
    rows = first_copies(deliveries, "event_id", "row_id", COLUMNS + details)
    usable = (F.col("timestamp") > 0) & ~F.isnan("timestamp") & (F.col("src_ip") != "0.0.0.0") & (F.col("dst_ip") != "0.0.0.0") & F.col("flow_id").isNotNull()
    zero = lambda c, t="bigint": F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    return rows.where(usable).select(
        F.col("row_id").alias("seq"),
        F.floor(F.col("timestamp") * 1_000_000 + 0.5).alias("us"),
        F.lower("event_type").alias("event_type"),
        F.lower("sensor_id").alias("sensor_id"),
        "src_ip",
        "dst_ip",
        zero("src_port", "int"),
        zero("dst_port", "int"),
        F.upper("protocol").alias("protocol"),
        "flow_id",
        F.coalesce(F.nanvl("duration", F.lit(0.0)), F.lit(0.0)).alias("duration"),
        *[zero(c) for c in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")],
        F.upper("conn_state").alias("conn_state"),
        F.lower("service").alias("service"),
        F.lower("query_name").alias("query_name"),
        *details,
    )
