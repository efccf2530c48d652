"""Per-key results when a few keys hold most rows.

Rows are first compressed to (key, value, number of rows) and only then grouped by key.
Both steps combine inside the map tasks, so a hot key costs each task one row per
distinct value and then one row; no task ever sees all rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_frequencies(df: DataFrame, key: str, value: str, amount: Column | None = None, at: Column | None = None) -> DataFrame:
    """One row per (key, value): n rows, amount (sum, nulls count 0), first_at, last_at.

    Null keys and null values form groups of their own. An empty table gives no rows.
    """
    amount = F.lit(0).cast("bigint") if amount is None else amount
    at = F.lit(None).cast("bigint") if at is None else at
    slim = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").alias("value"), amount.alias("amount"), at.alias("at"))
    return slim.groupBy("key", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("amount", F.lit(0))).alias("amount"), F.min("at").alias("first_at"),
        F.max("at").alias("last_at")
    )


def profile_by_key(frequencies: DataFrame) -> DataFrame:
    """From value_frequencies: per key the rows, the amount, exact distinct non-null values, first and last time."""
    return frequencies.groupBy("key").agg(
        F.sum("n").alias("n_rows"),
        F.sum("amount").alias("amount"),
        F.count("value").alias("n_values"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    )


def mode_by_key(frequencies: DataFrame) -> DataFrame:
    """Per key the most frequent non-null value (the smallest of equally frequent ones) and its rows.

    Two hashable aggregations instead of max_by over strings, which would sort. Keys
    with only null values are absent.
    """
    some = frequencies.where(F.col("value").isNotNull())
    most = some.groupBy(F.col("key").alias("k")).agg(F.max("n").alias("m"))
    tied = some.join(most, F.col("key").eqNullSafe(F.col("k")) & (F.col("n") == F.col("m")))
    return tied.groupBy("key").agg(F.min("value").alias("mode"), F.max("m").alias("mode_rows"))


def percentile_by_key(frequencies: DataFrame, percentages: list[float]) -> DataFrame:
    """Per key the exact percentiles (lower nearest rank) of numeric `value`, from weighted values.

    A first pass over ranges of the value (by the power of two of its size and its sign)
    finds the range that holds each rank; only that range's distinct values are then kept and put
    in order, so a key with very many values is never sorted as a whole.
    Columns: key, percentage, value. Null values don't count; keys without others are absent.
    """
    from pyspark.sql import Window

    some = frequencies.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    size = F.floor(F.log2(F.abs(F.col("value")) + 1)).cast("int")
    some = some.select("key", "value", "n", F.when(F.col("value") < 0, -size - 1).otherwise(size).alias("range"))
    ranges = some.groupBy("key", "range").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("key")
    ranges = ranges.select("key", "range", "n", F.sum("n").over(w).alias("total"), F.sum("n").over(w.orderBy("range")).alias("upto"))
    wanted = ranges.select("*", F.explode(F.array(*[F.lit(float(p)) for p in percentages])).alias("percentage"))
    rank = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("percentage") * F.col("total")))
    wanted = wanted.select("*", rank.alias("rank")).where((F.col("rank") > F.col("upto") - F.col("n")) & (F.col("rank") <= F.col("upto")))
    wanted = wanted.groupBy(F.col("key").alias("k"), F.col("range").alias("g")).agg(F.collect_list(F.struct(
        "percentage", (F.col("rank") - F.col("upto") + F.col("n")).alias("within")
    )).alias("asked"))
    kept = some.join(wanted, F.col("key").eqNullSafe(F.col("k")) & (F.col("range") == F.col("g")))
    run = Window.partitionBy("key", "range").orderBy("value")
    hit = kept.select("key", "value", "n", F.sum("n").over(run).alias("upto"), "asked")
    hit = hit.select(
        "key", "value",
        F.explode(F.filter("asked", lambda x: (x["within"] > F.col("upto") - F.col("n")) & (x["within"] <= F.col("upto")))).alias("x")
    ).select("key", "value", "x.percentage")
    return hit.groupBy("key", "percentage").agg(F.min("value").alias("value"))


def heavy_keys(df: DataFrame, key: str, value: str, share: float = 0.02) -> DataFrame:
    """The non-null keys that hold at least `share` of all rows (rows with null keys count in the total).

    Columns: key, n_rows, n_values. The total is one number, counted from the same rows.
    """
    total = df.count()
    profile = profile_by_key(value_frequencies(df, key, value))
    return profile.where(F.col("key").isNotNull() & (F.col("n_rows") >= F.lit(share) * F.lit(total))).select("key", "n_rows", "n_values")
