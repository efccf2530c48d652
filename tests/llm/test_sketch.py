import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import sketch


def table(spark, sets):
    rows = [(g, str(x)) for g, xs in sets.items() for x in xs]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows + rows[: len(rows) // 3], "grp string, id string")


def one_sketch(spark, sets, keys, **how):
    return sketch.merge(sketch.sketches(table(spark, sets), keys, F.col("id"), **how), list(keys))


def test_estimates_within_the_bound(spark):
    sets = {
        "tiny": range(7), "one": ["x"], "some": range(1000, 3100), "few": range(40), "edge": range(8_500),
        "many": range(10_000, 90_000), "more": range(20_000, 60_000)
    }
    df = table(spark, sets).withColumn("sketch", F.lit("clash"))
    parts = sketch.sketches(df, {"grp": F.col("grp")}, F.col("id"), run_rows=5000)
    got = {r.grp: r.estimate for r in sketch.estimate(sketch.merge(parts, ["grp"]), ["grp"]).collect()}
    assert set(got) == set(sets)
    assert round(got["one"]) == 1 and round(got["tiny"]) == 7 and round(got["few"]) == 40
    for g, xs in sets.items():
        assert abs(got[g] - len(set(xs))) <= max(0.5, sketch.relative_error() * len(set(xs)))
    assert sketch.relative_error() <= 0.02


def test_merging_loses_nothing(spark):
    sets = {"a": range(40_000), "b": range(20_000, 70_000), "c": range(50), "d": range(3000, 9000)}
    parts = one_sketch(spark, sets, {"grp": F.col("grp")})
    whole = one_sketch(spark, sets, {"grp": F.lit("all")}).first().sketch
    for how in ({}, {"run_rows": 1000}):  # many small runs: sparse ones grow dense while merging
        again = one_sketch(spark, sets, {"grp": F.col("grp")}, **how)
        assert sketch.merge(again.withColumn("grp", F.lit("all")), ["grp"]).first().sketch == whole
        assert {r.grp: r.sketch for r in again.collect()} == {r.grp: r.sketch for r in parts.collect()}
    assert sketch.merge(parts, []).first().sketch == whole
    size = {r.grp: r.n for r in parts.select("grp", F.length("sketch").alias("n")).collect()}
    assert size["a"] == size["b"] == 2**sketch.PRECISION and size["c"] == 50 * 4 and size["d"] < 6000 * 4 + 1


def test_small_sets_of_every_size_are_counted_within_two_percent(spark):
    sets = {str(n): range(1000 * n, 1000 * n + n) for n in range(1, 400)}
    got = {r.grp: round(r.estimate) for r in sketch.estimate(one_sketch(spark, sets, {"grp": F.col("grp")}), ["grp"]).collect()}
    assert all(abs(got[g] - len(x)) <= max(0.5, 0.02 * len(x)) for g, x in sets.items())


def test_error_over_many_sets():
    draw = np.random.default_rng(1)
    p, off = 10, []
    for n in (500, 5000, 200_000):
        for _ in range(40):
            ranks = np.zeros(2**p, np.int64)
            np.bitwise_or.at(ranks, draw.integers(0, 2**p, n), 1 << (draw.geometric(0.5, n) - 1))
            registers = np.bincount(sketch.to_bytes(ranks[ranks > 0]), minlength=256)[None]
            off.append(sketch.solve(registers.astype(float), np.array([-1.0]), p)[0] / n - 1)
    assert abs(np.mean(off)) < 0.008 and np.std(off) < 1.35 * 0.761 / 2 ** (p / 2)


def test_registers_keep_the_largest_ranks():
    ranks = np.array([1, 2, 3, 0b1000, 0b1011, 1 << 49, (1 << 49) - 1 | 1 << 49], np.int64)
    assert sketch.to_bytes(ranks).tolist() == [0, 4, 6, 12, 13, 196, 199]
    assert sketch.to_bytes(sketch.to_ranks(sketch.to_bytes(ranks))).tolist() == sketch.to_bytes(ranks).tolist()


def test_cube_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", "x", "1"), ("a", None, "2"), (None, "x", "2"), ("b", "y", None)], "k string, l string, id string")
    parts = sketch.sketches(df, {"k": F.col("k"), "l": F.col("l")}, F.col("id"))
    got = {(r.k, r.l, r.level): round(r.estimate) for r in sketch.estimate(sketch.merge_cube(parts, ["k", "l"]), ["k", "l", "level"]).collect()}
    assert got == {
        ("a", "x", 0): 1, ("a", None, 0): 1, (None, "x", 0): 1, ("a", None, 1): 2, (None, None, 1): 1, (None, "x", 2): 2,
        (None, None, 2): 1, (None, None, 3): 2
    }
    none = sketch.sketches(df.limit(0), {"k": F.col("k")}, F.col("id"))
    assert sketch.estimate(sketch.merge(none, ["k"]), ["k"]).count() == 0
    assert sketch.merge_cube(none, ["k"]).count() == 0
