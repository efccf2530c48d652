import hashlib
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import series, text


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def test_text_functions(spark):
    names = ["google.com", "a", "", "x7f3kq9zlw.example", "the.theme", "Ünïcode1.de", "aaaa", "..", None]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string")
    n = F.col("n")
    r = text.letter_ratios(n)
    rows = df.select(
        "k", text.shannon_entropy(n).alias("h"), text.bigram_log_likelihood(n).alias("ll"),
        text.subdomain_depth(n).alias("depth"), text.md5_partition(n, 8).alias("part"), *[c.alias(k) for k, c in r.items()]
    ).orderBy("k").collect()
    for name, row in zip(names[:-1], rows):
        label = name.lower().split(".")[0]
        pairs = [text.BIGRAMS.get(label[i : i + 2], text.FLOOR) for i in range(len(label) - 1)]
        assert math.isclose(row.h, entropy(name), abs_tol=1e-12)
        assert math.isclose(row.ll, sum(map(math.log, pairs)) / len(pairs) if pairs else 0.0, abs_tol=1e-12)
        assert row.depth == name.count(".") and row.part == int(hashlib.md5(name.encode()).hexdigest(), 16) % 8
        letters = [c for c in name.lower() if c.isalpha()]
        assert math.isclose(row.vowel_ratio, sum(c in "aeiou" for c in letters) / max(1, len(letters)))
        assert math.isclose(row.unique_char_ratio, len(set(name.lower())) / max(1, len(name)))
    assert rows[-1].h is None
    assert rows[0].ll > rows[3].ll  # words look more like English than random labels


def test_identity_and_encoding(spark):
    df = spark.createDataFrame(
        [("10.0.0.1", 5, "10.0.0.2", 80, "TCP"), ("10.0.0.2", 80, "10.0.0.1", 5, "TCP")],
        "s string, sp int, d string, dp int, p string"
    )
    five = [F.col(c) for c in ("s", "sp", "d", "dp", "p")]
    rows = df.select(text.flow_id(*five).alias("f"), text.both_ways_id(*five).alias("b")).collect()
    assert rows[0].f == "10.0.0.1:5 -> 10.0.0.2:80 [TCP]" and rows[0].b == rows[1].b
    one = spark.range(1).select(
        text.tls_version_number(F.lit("TLSv13 1.3")).alias("a"), text.tls_version_number(F.lit("TLS 1.2")).alias("b"),
        text.tls_version_number(F.lit("SSLv3")).alias("c"), text.tls_version_number(F.lit(None).cast("string")).alias("d"),
        text.dns_type_name(F.lit(16)).alias("t"), text.dns_type_name(F.lit(99)).alias("u"),
        text.tcp_flag_summary({"SYN": F.lit(True), "ACK": F.lit(True), "FIN": F.lit(False)}).alias("fl"),
        text.tcp_flag_summary({"SYN": F.lit(False)}).alias("none"), text.ratio(F.lit(3), F.lit(0), 1.0).alias("r")
    ).first()
    assert tuple(one) == (1.3, 1.2, 1.0, 0.0, "TXT", "TYPE_99", "SYN+ACK", "NONE", 3.0)


def test_series_against_numpy(spark):
    draw = np.random.default_rng(0)
    xs = [list(map(float, draw.exponential(3, n))) for n in (0, 1, 2, 3, 5, 6, 7, 8, 40, 200)] + [[2.0] * 10]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x array<double>")
    x = F.col("x")
    rows = df.select(
        "k", *[c.alias(n) for n, c in series.moments(x).items()], series.skewness(x).alias("skew"),
        series.spectral_peak(x).alias("peak"), series.autocorrelation_peak(x).alias("auto"),
        series.value_entropy(F.transform(x, lambda v: F.floor(v))).alias("h")
    ).orderBy("k").collect()
    for v, r in zip(xs, rows):
        a = np.array(v)
        if len(a) >= 2:
            assert np.isclose(r.iat_mean, a.mean()) and np.isclose(r.iat_std, a.std()) and r.iat_max == a.max()
        else:
            assert r.iat_mean == r.iat_std == 0
        if len(a) >= 6:
            f = np.abs(np.fft.rfft(a - a.mean()))[1:]
            assert np.isclose(r.peak, f.max() / f.sum() if f.sum() > 1e-9 else 0)
            c = a - a.mean()
            assert np.isclose(r.auto, max((c[:-k] * c[k:]).sum() for k in range(1, min(9, len(a) - 1) + 1)) / (c * c).sum() if c.std() > 1e-6 else 0)
        else:
            assert r.peak == r.auto == 0
        if len(a) >= 3 and a.std() > 1e-6:
            assert np.isclose(r.skew, ((a - a.mean()) ** 3).mean() / a.std() ** 3)
        assert math.isclose(r.h, entropy([math.floor(z) for z in v]), abs_tol=1e-9)


def test_gaps_drop_repeats(spark):
    df = spark.createDataFrame([([1, 1, 1_000_001, 3_000_001],), ([5],), ([],)], "t array<bigint>")
    assert [r.g for r in df.select(series.gaps(F.col("t")).alias("g")).collect()] == [[1.0, 2.0], [], []]


def test_windows_against_brute_force(spark):
    from tidemark.operators.windows import running_total, sliding

    draw = random.Random(1)
    for span, reach in ((900, 50), (3_000_000_000, 40_000_000)):  # the second lies in several blocks
        rows = [(k, draw.choice("hhhhab"), draw.randint(0, span), draw.choice(["x", "y", "z", None]), draw.choice([0, 1, None])) for k in range(500)]
        df = spark.createDataFrame(rows, "seq bigint, host string, us bigint, peer string, flag int")
        c = F.col
        got = {r.seq: r for r in sliding(df, ["host"], "us", reach, {"n": F.lit(1), "f": c("flag")}, {"d": c("peer")}, {"h": c("peer")}).collect()}
        assert len(got) == len(rows)
        for s, h, t, _, _ in rows:
            near = [(p, f) for _, g, u, p, f in rows if g == h and t - reach <= u <= t]
            peers = [p for p, _ in near if p]
            n = len(peers)
            entropy = -sum(peers.count(p) / n * math.log2(peers.count(p) / n) for p in set(peers))
            assert (got[s].n, got[s].f, got[s].d) == (len(near), sum(f or 0 for _, f in near), len(set(peers)))
            assert got[s].h == pytest.approx(entropy, abs=1e-9)
        run = {r.seq: r.sum for r in running_total(df, "us", "seq", F.lit(1), "sum", block_us=span // 9).collect()}
        assert [run[s] for s, *_ in sorted(rows, key=lambda r: (r[2], r[0]))] == list(range(1, 501))
        by = {r.seq: r.sum for r in running_total(df, "us", "seq", F.lit(1), "sum", ["host"], span // 9).collect()}
        assert all(by[s] == sum(g == h and (u, k) <= (t, s) for k, g, u, *_ in rows) for s, h, t, *_ in rows)


def test_a_flooded_host_takes_linear_time(spark):
    """Half a million events of one host within 30 seconds: lists of what lies in reach would hold 10^11 values."""
    from tidemark.operators.windows import sliding

    df = spark.range(500_000).select(
        F.col("id").alias("seq"), (F.col("id") * 60).alias("us"), F.lit("h").alias("host"), (F.col("id") % 50_000).alias("peer")
    )
    began = time.time()
    got = sliding(
        df, ["host"], "us", 30_000_000, {"n": F.lit(1)}, {"d": F.col("peer")}, {"h": F.col("peer")}
    ).agg(F.max("n"), F.max("d"), F.max("h")).first()
    assert (got[0], got[1]) == (500_000, 50_000) and got[2] == pytest.approx(math.log2(50_000), abs=1e-6)
    assert time.time() - began < 120
