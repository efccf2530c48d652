import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, models, pipeline


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(1)
    data = [(k, "abc"[k % 3], draw.gauss(k % 3 * 4, 1), draw.gauss(0, 1)) for k in range(180)]
    return spark.createDataFrame(data, "id bigint, label string, x double, y double").cache()


def test_boosted_trees_learn(rows):
    found = models.class_of(models.boosted_trees(rows, ["x", "y"], "label", trees=3, depth=2), rows)
    assert found.where("label = model_class").count() >= 160


def test_folds_and_validation(rows):
    sizes = models.folds(rows, "label", "id", 4).groupBy("label", "fold").count().collect()
    assert len(sizes) == 12 and all(r["count"] == 15 for r in sizes)
    got = models.cross_validate(rows, ["x", "y"], "label", "id", lambda t: models.random_forest(t, ["x", "y"], "label", 4), 3).collect()
    assert [r.fold for r in got] == [0, 1, 2] and sum(r.n for r in got) == 180 and min(r.macro_f1 for r in got) > 0.8


def test_size_sweep(rows):
    got = {r.trees: r for r in models.size_sweep(rows, rows, ["x", "y"], "label", (2, 6)).collect()}
    assert got[6].agreement == 1.0 and 0.8 < got[2].accuracy <= 1.0


def test_percentiles_in_ranges(spark):
    draw = random.Random(2)
    data = [(draw.choice("ab"), draw.choice([draw.gauss(0, 10), 3.0])) for _ in range(3000)] + [("one", 7.0), ("none", None), ("none", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double")
    got = {(r.g, r.share): r.value for r in metrics.percentiles(df, "v", [0.0, 0.05, 0.5, 0.99, 1.0], ["g"]).collect()}
    assert {g for g, _ in got} == {"a", "b", "one"}
    for (g, p), value in got.items():
        v = sorted(x for k, x in data if k == g)
        at = (len(v) - 1) * p
        low = int(at)
        assert value == pytest.approx(v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low), abs=1e-9)
    assert metrics.percentiles(df.limit(0), "v", [0.5]).count() == 0


def test_bypassed_flows_have_no_anomaly(spark):
    from tidemark.operators.features import ORDER

    zero = {n: 0.0 for n in ORDER}
    base = [
        ("calm", zero, "BENIGN", 0.9, -0.4), ("unsure", zero, "BENIGN", 0.5, -0.4), ("known", zero, "DDOS", 0.8, -0.4),
        ("quiet", zero, "BENIGN", 0.5, 0.2), ("loud", zero | {"packet_rate": 90.0}, "BENIGN", 0.9, -0.4)
    ]
    df = spark.createDataFrame([(n, "1.1.1.1", "2.2.2.2", 1, 2, 5.0, c, p, s, *[z[k] for k in ORDER]) for n, z, c, p, s in base], "flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, timestamp double, mc string, mp double, ms double, " + ", ".join(f"{n} double" for n in ORDER))
    decided = pipeline.decide(df, F.col("mc"), F.col("mp"), F.col("ms"), -0.1)
    got = {r.flow_id: r for r in decided.collect()}
    assert {k: (r.label, r.anomaly_score, r.anomalous) for k, r in got.items()} == {
        "calm": ("BENIGN", 0.0, False), "unsure": ("UNKNOWN_ANOMALY", -0.4, True), "known": ("DDOS", 0.0, False),
        "quiet": ("BENIGN", 0.2, False), "loud": ("DDOS", -0.4, True)
    }
    assert got["known"].classifier_probability == 0.8 and got["loud"].classifier_probability is None
    assert got["loud"].triggered_detectors == ["ddos"] and any(x.startswith("[DDOS] packet rate 90.0") for x in got["loud"].supporting_evidence)
    assert got["unsure"].feature_snapshot == {"anomaly_score": -0.4} and got["unsure"].confidence == pytest.approx(1.0)
    found = {r.threat_class: r for r in pipeline.to_alerts(decided).collect()}
    assert found["DDOS"].occurrence_count == 2 and found["BENIGN"].occurrence_count == 2
    assert pipeline.threats(pipeline.to_alerts(decided)).count() == 2
    none = pipeline.decide(df.limit(0), F.col("mc"), F.col("mp"), F.col("ms"))
    assert pipeline.to_alerts(none).count() == 0
