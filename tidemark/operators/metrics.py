"""Model and run metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """class, support, precision, recall, f1; both sides are counted in one pass and never joined."""
    pairs = df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(
        F.explode(F.array(
            F.struct(F.col(truth).alias("class"), F.lit(1).alias("t")), F.struct(F.col(guess).alias("class"), F.lit(0).alias("t"))
        )).alias("s"),
        "n", (F.col(truth) == F.col(guess)).alias("hit")
    )
    sums = sides.groupBy("s.class").agg(
        F.sum(F.when(F.col("s.t") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s.t") == 0, F.col("n")).otherwise(0)).alias("guessed"),
        F.sum(F.when((F.col("s.t") == 1) & F.col("hit"), F.col("n")).otherwise(0)).alias("hits")
    )
    p, r = F.col("hits") / F.greatest(F.lit(1), F.col("guessed")), F.col("hits") / F.greatest(F.lit(1), F.col("support"))
    return sums.select("class", "support", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def agreement(a: DataFrame, b: DataFrame, key: str, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Per column: n rows with the key in both, mean and largest absolute difference, share of rows that differ no more than
    `tolerance`. All columns are compared in one pass."""
    both = a.select(key, *[F.col(c).cast("double").alias(f"a_{c}") for c in columns]).join(b.select(F.col(key).alias("__k"), *[F.col(c).cast("double").alias(f"b_{c}") for c in columns]), F.col(key) == F.col("__k"))
    off = {c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in columns}
    one = both.agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{n}_{c}") for c, x in off.items() for n, f in (("mean", F.avg), ("most", F.max))], *[F.avg((x <= tolerance).cast("int")).alias(f"same_{c}") for c, x in off.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"mean_{c}").alias("mean_difference"), F.col(f"most_{c}").alias("largest_difference"), F.col(f"same_{c}").alias("agreement")) for c in columns])).alias("r")
    return one.select("n", rows).select("r.feature", "n", "r.mean_difference", "r.largest_difference", "r.agreement")


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """truth, guess, n: the cells of the confusion matrix that are not 0."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def macro(report: DataFrame) -> DataFrame:
    """One row from class_report: macro averages of precision, recall and f1 over the classes that occur in truth."""
    return report.where("support > 0").agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def rates(df: DataFrame, positive: Column, flagged: Column, score: Column) -> DataFrame:
    """One row: true and false positive rate of a flag, mean scores of both sides and how far they lie apart."""
    rate = lambda x: F.count_if(flagged & x) / F.greatest(F.lit(1), F.count_if(x))
    mean = lambda x: F.avg(F.when(x, score))
    return df.agg(
        rate(positive).alias("true_positive_rate"), rate(~positive).alias("false_positive_rate"),
        mean(positive).alias("positive_mean"), mean(~positive).alias("negative_mean"),
        F.abs(mean(positive) - mean(~positive)).alias("separation")
    )


def class_summary(df: DataFrame, group: str, label: str, score: str, probabilities: list[str]) -> DataFrame:
    """Per group: most frequent label (the smallest of equally frequent), least and mean score, mean of each probability."""
    some = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("k"), F.min(score).alias("least"), F.sum(score).alias("total"), F.count(score).alias("scored"), *[F.sum(p).alias(f"s_{p}") for p in probabilities])
    best = F.min(F.struct((-F.col("k")).alias("k"), F.col(label).alias("label")))["label"]
    return some.groupBy(group).agg(F.sum("k").alias("n"), best.alias("mode"), F.min("least").alias("least_score"), (F.sum("total") / F.sum("scored")).alias("mean_score"), *[(F.sum(f"s_{p}") / F.sum("k")).alias(f"mean_{p}") for p in probabilities])


def classes_worth_training(df: DataFrame, label: str, allowed: list[str] | None = None, least: int = 10) -> DataFrame:
    """The rows of classes with at least `least` rows, and in `allowed` if that is given. Counts are joined, so no class is one task."""
    counts = df.groupBy(F.col(label).alias("__l")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    kept = counts if allowed is None else counts.where(F.col("__l").isin(allowed))
    return df.join(kept.select("__l"), F.col(label) == F.col("__l"), "left_semi")


def audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, rows repeated in full, and per column nulls, NaN and infinite values."""
    numbers = [c for c in columns if dict(df.dtypes)[c] in ("double", "float")]
    hashed = df.select(F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *columns).alias("h2"), *columns)
    groups = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("k"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns], *[F.count_if(F.isnan(c)).alias(f"nan_{c}") for c in numbers], *[F.count_if(F.abs(F.col(c)) == float("inf")).alias(f"inf_{c}") for c in numbers])
    return groups.agg(F.sum("k").alias("n_rows"), F.sum(F.col("k") - 1).alias("repeated_rows"), *[F.sum(f"{k}_{c}").alias(f"{k}_{c}") for k, cs in (("null", columns), ("nan", numbers), ("inf", numbers)) for c in cs])


def _in_ranges(df: DataFrame, value: str, by: list[str], parts: int = 1024) -> DataFrame:
    """Counts n per value with __r, a range of values that follows their order: one of at most `parts` per group.

    The bounds are quantiles of a summary (approx_percentile), so that ranges hold about equally many rows.
    """
    steps = [k / parts for k in range(1, parts)]
    bounds = df.groupBy(*[F.col(b).alias(f"__g_{b}") for b in by]).agg(F.percentile_approx(value, steps, 10 * parts).alias("__bounds"))
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__g_{b}"))
    rows = counts.join(bounds, same)
    return rows.select(*by, value, "n", F.size(F.filter("__bounds", lambda x: x < F.col(value))).alias("__r"))


def percentiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """by..., share, value: exact percentiles with linear interpolation between neighbours, nulls and NaN left out.

    Counts per value are cut into ranges that hold about equally many rows; running sums over the ranges find the one
    that holds each rank, and only inside it values are put in order: no group is one task.
    """
    by = by or []
    rows = _in_ranges(df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))), value, by)
    sums = rows.groupBy(*by, "__r").agg(F.sum("n").alias("__m"))
    w = Window.partitionBy(*by)
    starts = sums.select(*[F.col(b).alias(f"__k_{b}") for b in by], F.col("__r").alias("__q"), F.sum("__m").over(w).alias("__all"), (F.sum("__m").over(w.orderBy("__r")) - F.col("__m")).alias("__s"), "__m")
    # of each share the two ranks between which it lies, from 0 on
    asked = F.array(*[F.struct(
        F.lit(float(p)).alias("share"), F.lit(k).alias("side"), (F.floor((F.col("__all") - 1) * float(p)) + k).alias("rank")
    ) for p in shares for k in (0, 1)])
    starts = starts.withColumn(
        "__asked",
        F.filter(
            asked,
            lambda x: (F.least(
                x["rank"], F.col("__all") - 1
            ) >= F.col("__s")) & (F.least(x["rank"], F.col("__all") - 1) < F.col("__s") + F.col("__m"))
        )
    ).where(F.size("__asked") > 0)
    same = F.col("__r") == F.col("__q")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__k_{b}"))
    upto = F.sum("n").over(Window.partitionBy(*by, "__r").orderBy(value))
    hits = rows.join(starts, same).select(*by, F.col(value).cast("double").alias("__v"), "n", (F.col("__s") + upto).alias("__u"), "__asked", "__all")
    hits = hits.select(
        "*",
        F.explode(F.filter(
            "__asked",
            lambda x: (F.least(x["rank"], F.col("__all") - 1) < F.col("__u")) & (F.least(x["rank"], F.col("__all") - 1) >= F.col("__u") - F.col("n"))
        )).alias("__x")
    )
    low, high = (F.max(F.when(F.col("__x.side") == k, F.col("__v"))) for k in (0, 1))
    part = F.max((F.col("__all") - 1) * F.col("__x.share") - F.floor((F.col("__all") - 1) * F.col("__x.share")))
    return hits.groupBy(*by, F.col("__x.share").alias("share")).agg((low + (high - low) * part).alias("value"))


def auc(df: DataFrame, positive: Column, score: Column) -> DataFrame:
    """One row: auc, with ties counted half, from counts per distinct score in ranges of scores; no task has all of them."""
    rows = df.select(positive.alias("__p"), score.alias("s"))
    ranges = _in_ranges(rows, "s", [])
    by = rows.groupBy(F.col("s").alias("t")).agg(
        F.count_if("__p").alias("p"), F.count_if(~F.col("__p")).alias("q")
    ).join(ranges, F.col("t") == F.col("s"))
    sums = by.groupBy("__r").agg(F.sum("q").alias("__m"))
    starts = sums.select(
        F.col("__r").alias("__k"),
        F.coalesce(F.sum("__m").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s")
    )
    inside = F.coalesce(F.sum("q").over(Window.partitionBy("__r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = by.select("p", "q", "__r", inside.alias("__i")).join(starts, F.col("__r") == F.col("__k")).select(
        "p", "q", (F.col("__i") + F.col("__s")).alias("below")
    )
    return below.agg((F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / (F.sum("p") * F.sum("q"))).alias("auc"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight = n_all / (classes * n)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    return n.select(label, "n", (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight"))


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.2, seed: str = "42", salt: int = 64) -> DataFrame:
    """`df` with in_test: of each label round(share n), at least one, in the order of a hash of `key`.

    The place in that order is found from counts per hash bucket, so no label is one task.
    """
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    rows = df.select("*", h.alias("__h"), F.conv(F.substring(h, 1, 2), 16, 10).cast("int").alias("__b"))
    cells = rows.groupBy(F.col(label).alias("__l"), F.col("__b").alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__l")
    cells = cells.select(
        "__l", "__c", F.sum("__n").over(w).alias("__all"),
        F.coalesce(F.sum("__n").over(w.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")
    )
    place = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key))
    ranked = rows.select("*", place.alias("__k")).join(cells, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__c")))
    n_test = F.when(F.col("__all") >= 5, F.greatest(F.lit(1), F.bround(F.col("__all") * share))).otherwise(1)
    return ranked.select(*df.columns, (F.col("__k") + F.col("__before") <= n_test).alias("in_test"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: list[str]) -> DataFrame:
    bucket = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(value) - low) / (high - low) * bins))).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(*by, bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def standardize(df: DataFrame, columns: list[str], floor: float = 1e-7) -> DataFrame:
    """Columns minus mean over population deviation (at least `floor`); the statistics are one row, read first."""
    s = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    scaled = {c: (F.col(c) - F.lit(s[f"m_{c}"])) / F.lit(max(floor, s[f"s_{c}"] or 0.0)) for c in columns}
    return df.withColumns(scaled)
