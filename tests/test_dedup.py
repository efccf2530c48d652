import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming.dedup import surplus_rows


def write(spark, folder, rows, files):
    df = spark.createDataFrame(rows, "row_id bigint, message string, at bigint, note string")
    df.repartition(files).write.parquet(f"{folder}/t.parquet")


def surplus(rows):
    least = {}
    for r, m, *_ in rows:
        if m is not None:
            least[m] = min(r, least.get(m, r))
    return {r for r, m, *_ in rows if m is not None and r > least[m]}


@pytest.mark.parametrize("horizon", [10**9, 300, 0])
def test_any_order_and_horizon_is_exact(spark, tmp_path, horizon):
    draw = random.Random(horizon)
    ids = [f"m{k}" for k in range(150)] + ["hot"] * 60 + [None] * 10 + ["", "M1"]
    rows = [(k, draw.choice(ids), draw.choice([None, draw.randint(0, 2000)]), draw.choice(["x", None])) for k in range(1200)]
    write(spark, tmp_path, rows, 8)
    got = surplus_rows(spark, str(tmp_path), "t", "message", "row_id", F.col("at"), horizon_us=horizon, buckets=3, files_per_trigger=1)
    found = [r.row for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == surplus(rows)


def test_same_row_twice_and_empty(spark, tmp_path):
    write(spark, tmp_path / "a", [(1, "a", 1, None), (1, "a", 1, None), (2, "b", None, None)], 1)
    assert surplus_rows(spark, str(tmp_path / "a"), "t", "message", "row_id", F.col("at")).count() == 0
    write(spark, tmp_path / "b", [], 1)
    assert surplus_rows(spark, str(tmp_path / "b"), "t", "message", "row_id", F.col("at")).count() == 0
