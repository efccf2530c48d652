import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.operators.heavy_keys import heavy_keys, mode_by_key, percentile_by_key, profile_by_key, value_frequencies
from tidemark.operators.sessions import first_copies, sessionize


def test_profiles_against_brute_force(spark):
    draw = random.Random(1)
    rows = [(
        "hot" if draw.random() < 0.4 else draw.choice("abcdef") if draw.random() < 0.95 else None, draw.choice([None, *"uvwxyz"]),
        draw.choice([None, 1, 5, 900]), k
    ) for k in range(3000)]
    df = spark.createDataFrame(rows, "key string, value string, n bigint, at bigint").withColumn("amount", F.lit("clash"))
    f = value_frequencies(df, "key", "value", F.col("n"), F.col("at"))
    got = {r.key: (r.n_rows, r.amount, r.n_values, r.first_at, r.last_at) for r in profile_by_key(f).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert got == {
        k: (len(v), sum(x[2] or 0 for x in v), len({x[1] for x in v} - {None}), min(x[3] for x in v), max(x[3] for x in v)) for k,
        v in by.items()
    }
    mode = {r.key: (r.mode, r.mode_rows) for r in mode_by_key(f).collect()}
    for k, v in by.items():
        c = Counter(x[1] for x in v if x[1] is not None)
        assert mode[k] == min(((a, n) for a, n in c.items() if n == max(c.values())), key=lambda z: z[0])
    assert {r.key for r in heavy_keys(df, "key", "value", 0.1).collect()} == {k for k, v in by.items() if k is not None and len(v) >= 300}


def test_percentiles_are_exact(spark):
    draw = random.Random(2)
    rows = [(draw.choice("ab"), int(draw.gauss(0, 10 ** draw.randint(0, 6)))) for _ in range(4000)] + [("one", 7), ("none", None)]
    p = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {(r.key, r.percentage): r.value for r in percentile_by_key(
        value_frequencies(spark.createDataFrame(rows, "key string, value bigint"), "key", "value"), p
    ).collect()}
    for key in ("a", "b", "one"):
        v = sorted(x for k, x in rows if k == key)
        assert [got[key, q] for q in p] == [v[max(0, -(-int(q * 100) * len(v) // 100) - 1)] for q in p]
    assert not any(k == "none" for k, _ in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "key string, value string")
    assert heavy_keys(none, "key", "value").count() == 0
    assert mode_by_key(value_frequencies(none, "key", "value")).count() == 0


def brute(rows, gap):
    out, by = [], defaultdict(list)
    for u, t, f in rows:
        if u is not None and t is not None:
            by[u].append((t, f))
    for u, v in by.items():
        v.sort(key=lambda x: x[0])
        run = [v[0]]
        for x in v[1:]:
            if x[0] - run[-1][0] > gap:
                out.append((u, run))
                run = []
            run.append(x)
        out.append((u, run))
    return sorted((u, r[0][0], r[-1][0], len(r), len({f for _, f in r} - {None})) for u, r in out)


def test_sessions_against_brute_force(spark):
    draw = random.Random(3)
    rows = []
    for u in ["hot", "b", "c", None]:
        t = 0
        for _ in range(700 if u == "hot" else 60):
            t += draw.choice([0, 1, 10, 60, 100, 101, 5000])
            rows.append((u, t if draw.random() < 0.97 else None, draw.choice([None, "f", "g", "h"])))
    rows += rows[:50]
    df = spark.createDataFrame(rows, "src string, t bigint, f string").withColumn("block", F.lit("x")).withColumn("user", F.lit(0))
    for gap in (0, 1, 100, 5000, 10**9):
        got = sorted(tuple(r) for r in sessionize(df, "src", F.col("t"), "f", gap_us=gap).select(
            "user", "start_us", "end_us", "n_events", "n_flows"
        ).collect())
        assert got == brute(rows, gap)
    assert sessionize(df.limit(0), "src", F.col("t"), "f").count() == 0


def test_first_copies_keeps_null_keys(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, None, "z"), (4, None, "z"), (5, "b", None)], "k int, id string, v string")
    assert sorted(r.v or "" for r in first_copies(df, "id", "k", ["v"]).collect()) == ["", "y", "z", "z"]
