"""Sliding and counted windows that hold when a host is hot.

A window over one host would put all its rows into one task. Rows are therefore cut into
time blocks; the rows within reach of a block's end are repeated in the next block as
context only, so that every frame is complete inside its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _block_us(reach_us: int) -> int:
    return max(600_000_000, 8 * reach_us)


def in_blocks(df: DataFrame, us: str, reach_us: int, block_us: int | None = None) -> DataFrame:
    """`df` with __block and __own: own rows of a block, and those of the block before within reach."""
    block_us = block_us or _block_us(reach_us)
    own = F.floor(F.col(us) / block_us)
    ahead = F.floor((F.col(us) + reach_us) / block_us)
    rows = df.select("*", own.alias("__at"), F.explode(F.sequence(own, ahead)).alias("__block"))
    return rows.select("*", (F.col("__block") == F.col("__at")).alias("__own")).drop("__at")


def _change(x: Column, up: Column) -> Column:
    """By how much x log2 x grows when a count of x (after) was one less (up) or one more before."""
    weigh = lambda n: n * F.log2(F.greatest(n, F.lit(1)))
    return weigh(x) - F.when(up, weigh(x - 1)).otherwise(weigh(x + 1))


def sliding(
    df: DataFrame, keys: list[str], us: str, reach_us: int, sums: dict[str, Column] | None = None,
    distinct: dict[str, Column] | None = None, entropy: dict[str, Column] | None = None, block_us: int | None = None
) -> DataFrame:
    """`df` with values over the last `reach_us` of the row's keys, itself and its ties included.

    sums: whole numbers to add up, null counting 0 (bigint); distinct: values whose different non-null ones are counted
    (bigint); entropy: values whose distribution's entropy in bits is wanted (nulls are no value).

    The work is linear in the rows, however many lie within reach: each row is one change when it comes and one when
    it goes, and running sums of the changes are the values. A value is counted as new only if it didn't occur within
    reach before, and as gone only if it doesn't occur again within reach. `us` may be any whole number that orders the
    rows of a key, such as their place; block_us is then how much of it makes a task.
    """
    sums, distinct, entropy = sums or {}, distinct or {}, entropy or {}
    c = F.col
    block = [*keys, "__block"]
    measured = [F.coalesce(v.cast("bigint"), F.lit(0)).alias(f"__s_{k}") for k, v in sums.items()]
    measured += [v.alias(f"__d_{k}") for k, v in distinct.items()] + [v.alias(f"__e_{k}") for k, v in entropy.items()]
    block_us = block_us or _block_us(reach_us)
    # moved once: every window below is by block and more, so each lies in one partition already
    rows = in_blocks(df.select("*", *measured), us, reach_us, block_us).repartition(*block)
    for k in distinct:
        w = Window.partitionBy(*block, f"__d_{k}").orderBy(us)
        some = c(f"__d_{k}").isNotNull()
        comes = some & ~F.coalesce(c(us) - F.lag(us).over(w) <= reach_us, F.lit(False))
        goes = some & ~F.coalesce(F.lead(us).over(w) - c(us) <= reach_us, F.lit(False))
        rows = rows.withColumns({f"__new_{k}": comes.cast("bigint"), f"__old_{k}": goes.cast("bigint")})
    signs = F.explode(F.array(F.lit(1), F.lit(-1))).alias("__sign")
    changes = rows.select("*", signs).withColumn("__at", F.when(c("__sign") > 0, c(us)).otherwise(c(us) + reach_us + 1))
    # what would come or go after the last row of the block changes nothing
    changes = changes.where((c("__sign") > 0) | (c("__block") == F.floor(c("__at") / block_us)))
    up = c("__sign") > 0
    for k in entropy:
        own = Window.partitionBy(*block, f"__e_{k}").orderBy("__at", "__sign").rowsBetween(Window.unboundedPreceding, 0)
        some = c(f"__e_{k}").isNotNull()
        changes = changes.withColumn(f"__n_{k}", F.when(some, F.sum("__sign").over(own)))
        changes = changes.withColumn(f"__h_{k}", F.when(some, _change(c(f"__n_{k}"), up)).otherwise(0.0))
    upto = Window.partitionBy(*block).orderBy("__at")
    total = lambda v: F.sum(v).over(upto)
    values = {k: total(c(f"__s_{k}") * c("__sign")).alias(k) for k in sums}
    values |= {k: total(F.when(up, c(f"__new_{k}")).otherwise(-c(f"__old_{k}"))).alias(k) for k in distinct}
    for k in entropy:
        n = total(F.when(c(f"__e_{k}").isNotNull(), c("__sign")).otherwise(0))
        values[k] = F.when(n > 0, F.greatest(F.lit(0.0), F.log2(n) - total(f"__h_{k}") / n)).otherwise(0.0).alias(k)
    out = changes.select(*df.columns, "__own", "__sign", *values.values())
    return out.where((c("__sign") > 0) & c("__own")).drop("__own", "__sign")


def last_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last `n` rows of each key. Spark cuts to n per key in the map tasks already."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return df.select("*", F.row_number().over(w).alias("__nth")).where(F.col("__nth") <= n).drop("__nth")


def running_total(
    df: DataFrame, us: str, seq: str, value: Column, name: str, keys: list[str] | None = None, block_us: int = 3_600_000_000
) -> DataFrame:
    """`df` with the running sum of `value` in (us, seq) order, over all rows or those of the same `keys`.

    Sums of time blocks give each block its start; only the block totals pass through one task, whatever the rows.
    """
    keys = keys or []
    rows = df.select("*", F.floor(F.col(us) / block_us).alias("__b"), value.alias("__v"))
    totals = rows.groupBy(*keys, "__b").agg(F.sum("__v").alias("__t"))
    over = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__c"), F.coalesce(F.sum("__t").over(over), F.lit(0)).alias("__s"))
    inside = F.sum("__v").over(Window.partitionBy(*keys, "__b").orderBy(us, seq).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("__b") == F.col("__c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = rows.select("*", inside.alias("__i")).join(starts, same)
    return out.select(*df.columns, (F.col("__i") + F.col("__s")).alias(name))
