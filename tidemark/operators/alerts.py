"""Alerts: deduplication within a gap, statistics, pages, search, as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}


def severity_rank(severity: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SEVERITY_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(severity)), F.lit(-1))


def deduplicate(
    detections: DataFrame, keys: list[str], us: str, confidence: str, frozen: list[str], gap_us: int = 30_000_000,
    block_us: int = 3_600_000_000
) -> DataFrame:
    """One alert per key and run of detections at most `gap_us` apart: first and last time, count, best confidence.

    The `frozen` columns are those of the first detection. Runs are formed inside time blocks and then joined over
    block ends, so a key with very many detections is spread; ids are made of key and first time, hence stable.
    """
    first = F.min(F.struct(us, *frozen))
    inside = Window.partitionBy(*keys, "__b").orderBy(us)
    rows = detections.select("*", F.floor(F.col(us) / block_us).alias("__b")).select(
        "*", (F.col(us) - F.lag(us).over(inside) > gap_us).cast("int").alias("__f")
    )
    rows = rows.select("*", F.coalesce(F.sum("__f").over(inside), F.lit(0)).alias("__run"))
    runs = rows.groupBy(*keys, "__b", "__run").agg(
        F.min(us).alias("a"), F.max(us).alias("z"), F.count(F.lit(1)).alias("n"), F.max(confidence).alias("c"),
        first.alias("first")
    )
    over = Window.partitionBy(*keys).orderBy("a")
    runs = runs.select("*", (F.col("a") - F.lag("z").over(over) > gap_us).cast("int").alias("__g"))
    runs = runs.select("*", F.coalesce(F.sum("__g").over(over), F.lit(0)).alias("__session"))
    out = runs.groupBy(*keys, "__session").agg(
        F.min("a").alias("first_us"), F.max("z").alias("last_us"), F.sum("n").alias("occurrence_count"),
        F.max("c").alias("max_confidence"), F.min("first").alias("first")
    )
    ident = F.concat(
        F.lit("ALT-"), F.date_format(F.timestamp_micros("first_us"), "yyyyMMdd"), F.lit("-"),
        F.upper(F.substring(F.md5(F.concat_ws("|", *keys, F.col("first_us").cast("string"))), 1, 8))
    )
    return out.select(ident.alias("alert_id"), *keys, "first_us", "last_us", "occurrence_count", "max_confidence", *[F.col(f"first.{c}").alias(c) for c in frozen])


def statistics(alerts: DataFrame) -> DataFrame:
    """Counts by severity, by class, by method and in all (grouping sets); facet names the set."""
    facets = F.array(
        *[F.struct(
            F.lit(f).alias("facet"), F.coalesce(F.col(f), F.lit("none")).alias("value")
        ) for f in ("severity", "threat_class", "detection_method")],
        F.struct(F.lit("total").alias("facet"), F.lit("all").alias("value"))
    )
    return alerts.select(F.explode(facets).alias("s"), "occurrence_count").groupBy("s.facet", "s.value").agg(
        F.count(F.lit(1)).alias("n_alerts"), F.sum("occurrence_count").alias("n_events")
    )


def dedup_savings(alerts: Column, events: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), 1 - alerts / F.greatest(events, F.lit(1))), 4)


def page(
    alerts: DataFrame, order: str, limit: int = 50, offset: int = 0, threat_class: str | None = None, severity: str | None = None,
    exclude_benign: bool = False
) -> DataFrame:
    """Newest first; filters ignore case."""
    if exclude_benign:
        alerts = alerts.where(F.upper("threat_class") != "BENIGN")
    if threat_class:
        alerts = alerts.where(F.upper("threat_class") == threat_class.upper())
    if severity:
        alerts = alerts.where(F.upper("severity") == severity.upper())
    return alerts.orderBy(F.desc(order)).offset(offset).limit(limit)


def newest(alerts: DataFrame, order: str, cap: int = 10_000) -> DataFrame:
    """The store's view: the `cap` newest alerts (the table itself keeps all)."""
    return alerts.orderBy(F.desc(order)).limit(cap)


def search(alerts: DataFrame, text: str) -> DataFrame:
    """Alerts whose id or flow contains `text`, whatever the case; ALL finds everything."""
    if text.upper() == "ALL" or not text:
        return alerts
    return alerts.where(F.lower("flow_id").contains(text.lower()) | F.lower("alert_id").contains(text.lower()))


def get(alerts: DataFrame, alert_id: str | None) -> DataFrame:
    """The alert of an id; no row if there is none."""
    return alerts.where(F.col("alert_id") == F.lit(alert_id))


def previous_within(detections: DataFrame, keys: list[str], us: str, reach_us: int, seq: str | None = None) -> DataFrame:
    """As-of lookup: the time of the previous detection of the same key if within reach, else null. seq: order of equal times."""
    before = F.lag(us).over(Window.partitionBy(*keys).orderBy(us, *([seq] if seq else [])))
    return detections.select("*", F.when(F.col(us) - before <= reach_us, before).alias("previous_us"))
