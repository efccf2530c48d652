"""The chain from feature vectors to alerts: detectors, models, fusion, severity, evidence, alerts and a report of the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import alerts, detectors


def decide(vectors: DataFrame, model_class: Column, model_confidence: Column, anomaly: Column, threshold: float = 0.0) -> DataFrame:
    """`vectors` with found (detectors), model and anomaly columns, label, state, confidence, method, severity, evidence,
    primary_reason, snapshot, classifier_probability and triggered_detectors.

    vectors: features, flow_id, src_port, dst_port. A score below `threshold` is anomalous, unless a confident model makes the
    anomaly detector unnecessary: then the score is 0 and not anomalous.
    """
    c = F.col
    v = vectors.withColumns({
        "model_class": model_class, "model_confidence": model_confidence, "found": detectors.detect(c("src_port"), c("dst_port"))
    })
    bypass = detectors.anomaly_bypass(c("found"), c("model_class"), c("model_confidence"))
    v = v.withColumn("anomaly_bypassed", bypass)
    v = v.withColumn("anomaly_score", F.when(c("anomaly_bypassed"), 0.0).otherwise(anomaly))
    v = v.withColumn("anomalous", ~c("anomaly_bypassed") & (c("anomaly_score") < threshold))
    fused = detectors.fuse(c("found"), c("model_class"), c("model_confidence"), c("anomaly_score"), c("anomalous"), threshold)
    v = v.withColumns(fused)
    texts, values = detectors.evidence(c("label"), c("found"), c("anomaly_score"), threshold)
    return v.withColumns(
        {
            "severity": detectors.severity(c("label"), c("confidence")),
            "supporting_evidence": texts,
            "primary_reason": detectors.primary_reason(c("label"), c("confidence")),
            "feature_snapshot": values,
            "classifier_probability": F.when(c("model_class") == c("label"), c("model_confidence")),
            "triggered_detectors": F.transform(F.filter("found", lambda d: d["triggered"]), lambda d: d["detector"]),
        }
    )


#: what an alert keeps of its first detection
FROZEN = [
    "severity", "method", "flow_id", "supporting_evidence", "primary_reason", "classifier_probability", "anomaly_score",
    "anomalous", "triggered_detectors"
]


def to_alerts(decided: DataFrame, gap_us: int = 30_000_000) -> DataFrame:
    """One alert for detections of the same source, destination and class at most `gap_us` apart: first and last time, count,
    best confidence, and what the first detection had."""
    rows = decided.withColumn("us", F.round(F.col("timestamp") * 1_000_000).cast("bigint")).withColumnRenamed("label", "threat_class")
    return alerts.deduplicate(rows, ["src_ip", "dst_ip", "threat_class"], "us", "confidence", FROZEN, gap_us)


def threats(found: DataFrame) -> DataFrame:
    """Alerts of any class but BENIGN."""
    return found.where(F.col("threat_class") != "BENIGN")


def report(events: DataFrame, decided: DataFrame, found: DataFrame) -> DataFrame:
    """One row about a run: events, flows, alerts and threats, events a second of event time, share of detections that were
    joined to an earlier alert, flows that the anomaly detector was not needed for, known and novel threats."""
    c = F.col
    e = events.agg(
        F.count(F.lit(1)).alias("n_events"), F.countDistinct("flow_id").alias("n_flows"),
        F.greatest(F.lit(1e-4), (F.max("us") - F.min("us")) / 1e6).alias("seconds")
    )
    d = decided.agg(
        F.count(F.lit(1)).alias("n_decisions"), F.count_if("anomaly_bypassed").alias("n_bypassed"),
        F.count_if(F.size(F.filter("found", lambda x: x["triggered"])) > 0).alias("n_triggered")
    )
    threat = c("threat_class") != "BENIGN"
    a = found.agg(
        F.count(F.lit(1)).alias("n_alerts"), F.count_if(threat).alias("n_threats"),
        F.count_if(threat & (c("threat_class") != "UNKNOWN_ANOMALY")).alias("n_known"),
        F.count_if(c("threat_class") == "UNKNOWN_ANOMALY").alias("n_novel"),
        F.count_if(threat & c("severity").isin("CRITICAL", "HIGH")).alias("n_severe")
    )
    one = e.crossJoin(d).crossJoin(a)  # three single rows
    rate = lambda n: F.bround(c(n) / c("seconds"), 6)
    return one.select(
        "n_events", "n_flows", "n_decisions", "n_triggered", "n_bypassed", "n_alerts", "n_threats", "n_known", "n_novel",
        "n_severe", rate("n_events").alias("events_per_second"), rate("n_flows").alias("flows_per_second"),
        alerts.dedup_savings(c("n_alerts"), c("n_decisions")).alias("dedup_savings")
    )
