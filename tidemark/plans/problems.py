"""The queries of the general data problems (2, 4, 5, 6, 7) on the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.heavy_keys import heavy_keys, mode_by_key, percentile_by_key, profile_by_key, value_frequencies
from tidemark.operators.rejects import read_lines, typed_records
from tidemark.operators.sessions import first_copies, sessionize
from tidemark.operators.timestamps import normalize_timestamps
from tidemark.session import read_table, shared_folder
from tidemark.streaming.dedup import surplus_rows

def _micros(column: str = "timestamp") -> Column:
    return F.floor(F.col(column) * 1_000_000 + 0.5)


def _event_time() -> Column:
    """The event's instant, or null where it is missing or zero."""
    return F.when((F.col("timestamp") != 0) & ~F.isnan("timestamp"), _micros())


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return read_lines(read_table(spark, folder, "zeek_lines")).where(F.col("reason").isNotNull()).select("line_id", "reason")


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    return typed_records(read_lines(read_table(spark, folder, "zeek_lines")))


def _bytes(df: DataFrame):
    return F.coalesce("orig_bytes", F.lit(0)) + F.coalesce("resp_bytes", F.lit(0))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [heavy_keys(read_table(spark, folder, t), "dst_ip", "src_ip").select(
        F.lit(t).alias("source_table"), F.col("key").alias("dst_ip")
    ) for t in ("net_events", "flow_keys")]
    return parts[0].unionByName(parts[1])


def p4_destinations(spark: SparkSession, folder: str) -> DataFrame:
    """Per table and destination: events, bytes, distinct sources, first and last time (0: no event has one)."""
    events = read_table(spark, folder, "net_events")
    flows = read_table(spark, folder, "flow_keys")
    parts = [
        profile_by_key(value_frequencies(
            events, "dst_ip", "src_ip", _bytes(events), _event_time()
        )).select(F.lit("net_events").alias("source_table"), "*"),
        profile_by_key(value_frequencies(flows, "dst_ip", "src_ip", at=_micros("first_seen"))).select(F.lit("flow_keys").alias("source_table"), "*"),
    ]
    names = {"key": "dst_ip", "n_rows": "events", "amount": "bytes", "n_values": "distinct_sources", "first_at": "first_us", "last_at": "last_us"}
    both = parts[0].unionByName(parts[1]).withColumnsRenamed(names)
    return both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("first_us", "last_us")})


def p4_modes(spark: SparkSession, folder: str) -> DataFrame:
    """Per destination of net_events the most frequent source and exact percentiles of an event's bytes."""
    events = read_table(spark, folder, "net_events").where(F.col("dst_ip").isNotNull())
    mode = mode_by_key(value_frequencies(events, "dst_ip", "src_ip"))
    sized = events.withColumn("size", _bytes(events))
    p = percentile_by_key(value_frequencies(sized, "dst_ip", "size"), [0.5, 0.95]).groupBy(F.col("key").alias("k")).agg(*[
        F.max(F.when(F.col("percentage") == q, F.col("value"))).alias(n) for q, n in ((0.5, "bytes_p50"), (0.95, "bytes_p95"))
    ])
    return p.join(mode, F.col("k") == F.col("key"), "left").select(
        F.col("k").alias("dst_ip"), F.col("mode").alias("top_source"), F.coalesce("mode_rows", F.lit(0)).alias("top_source_rows"),
        "bytes_p50", "bytes_p95"
    )


def _instants(spark: SparkSession, folder: str, table: str, text: str) -> DataFrame:
    sensors = read_table(spark, folder, "sensors").select(F.col("sensor_id").alias("s"), "tz_name", "date_order")
    rows = read_table(spark, folder, table).select("row_id", "sensor_id", F.col(text).alias("text"), "received_at")
    joined = rows.join(sensors, F.col("sensor_id") == F.col("s"), "left")
    return normalize_timestamps(joined, "text", "received_at", "tz_name", "date_order").select(
        F.lit(table).alias("source_table"), "row_id", "epoch_us"
    )


def p5_instants(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of both tables with its instant, null where the text names none."""
    return _instants(spark, folder, "event_feed", "timestamp").unionByName(_instants(spark, folder, "security_alerts", "timestamp_iso"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_instants(spark, folder).where(F.col("epoch_us").isNotNull())


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        surplus_rows(
            spark, folder, "net_events", "event_id", "row_id", F.coalesce(_event_time(), F.unix_micros("received_at"))
        ).select(F.lit("net_events").alias("source_table"), F.col("row").alias("row_id")),
        surplus_rows(
            spark, folder, "security_alerts", "alert_id", "row_id", F.unix_micros("received_at"), files_per_trigger=24
        ).select(F.lit("security_alerts").alias("source_table"), F.col("row").alias("row_id")),
    ]
    return parts[0].unionByName(parts[1])


def p6_short_horizon(spark: SparkSession, folder: str) -> DataFrame:
    """The same of net_events, delivered in sixteen micro-batches in order of arrival, where identifiers leave the state after
    an hour: copies that come later are settled by the archive."""
    base = shared_folder(spark, "deliveries")
    read_table(spark, folder, "net_events").select("row_id", "event_id", "timestamp", "received_at").repartitionByRange(16, "row_id").write.parquet(f"{base}/net_events.parquet")
    at = F.coalesce(_event_time(), F.unix_micros("received_at"))
    found = surplus_rows(spark, base, "net_events", "event_id", "row_id", at, horizon_us=3_600_000_000, files_per_trigger=1)
    return found.select(F.lit("net_events").alias("source_table"), F.col("row").alias("row_id"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = first_copies(read_table(spark, folder, "net_events"), "event_id", "row_id", ["src_ip", "timestamp", "flow_id"])
    rows = rows.where((F.col("src_ip") != "0.0.0.0") & (F.col("timestamp") != 0) & ~F.isnan("timestamp"))
    return sessionize(rows, "src_ip", _micros(), "flow_id").withColumnRenamed("user", "src_ip")


QUERIES = {f.__name__: f for f in (
    p2_found, p2_records, p4_found, p4_destinations, p4_modes, p5_found, p5_instants, p6_found, p6_short_horizon, p7_found
)}

_FIRST = """first_copy as (select * from (select *, row_number() over (partition by event_id order by row_id) as copy from net_events)
    where event_id is null or copy = 1)"""
_HEAVY = "select '{0}' as source_table, dst_ip from {0} where dst_ip is not null group by dst_ip having count(*) >= 0.02 * (select count(*) from {0})"
_SURPLUS = "select '{0}' as source_table, row_id from (select row_id, row_number() over (partition by {1} order by row_id) as copy from {0} where {1} is not null) where copy > 1"
_US = "cast(floor(\"timestamp\" * 1000000 + 0.5) as bigint)"
SQL = {
    "p4_found": _HEAVY.format("net_events") + " union all " + _HEAVY.format("flow_keys"),
    "p4_destinations": f"""
        select 'net_events' as source_table, dst_ip, count(*) as events, cast(sum(coalesce(orig_bytes, 0) + coalesce(resp_bytes,
        0)) as bigint) as bytes,
          count(distinct src_ip) as distinct_sources, coalesce(min(case when "timestamp" <> 0 then {_US} end), 0) as first_us,
          coalesce(max(case when "timestamp" <> 0 then {_US} end), 0) as last_us
        from net_events group by dst_ip
        union all
        select 'flow_keys', dst_ip, count(*), cast(0 as bigint), count(distinct src_ip),
        coalesce(min(cast(floor(first_seen * 1000000 + 0.5) as bigint)), 0), coalesce(max(cast(floor(first_seen * 1000000 + 0.5) as bigint)), 0)
        from flow_keys group by dst_ip""",
    "p4_modes": """
        with e as (select dst_ip, src_ip, coalesce(orig_bytes, 0) + coalesce(resp_bytes, 0) as size from net_events where dst_ip is not null),
        s as (select dst_ip, src_ip, count(*) as n from e where src_ip is not null group by all),
        m as (select dst_ip, src_ip, n, row_number() over (partition by dst_ip order by n desc, src_ip) as k from s)
        select p.dst_ip, m.src_ip as top_source, coalesce(m.n, 0) as top_source_rows, bytes_p50, bytes_p95
        from (select dst_ip, cast(quantile_disc(size, 0.5) as bigint) as bytes_p50, cast(quantile_disc(size, 0.95) as bigint) as bytes_p95
        from e group by dst_ip) p
        left join m on m.dst_ip = p.dst_ip and m.k = 1""",
    "p6_short_horizon": _SURPLUS.format("net_events", "event_id"),
    "p6_found": _SURPLUS.format("net_events", "event_id") + " union all " + _SURPLUS.format("security_alerts", "alert_id"),
    "p7_found": f"""
        with {_FIRST},
        e as (select src_ip, {_US} as t, flow_id from first_copy where src_ip <> '0.0.0.0' and "timestamp" <> 0),
        g as (select *, case when t - lag(t) over (partition by src_ip order by t) > 1800000000 then 1 else 0 end as flag from e),
        s as (select *, sum(flag) over (partition by src_ip order by t range between unbounded preceding and current row) as session from g)
        select src_ip, min(t) as start_us, max(t) as end_us, count(*) as n_events, count(distinct flow_id) as n_flows from s
        group by src_ip, session""",
}
