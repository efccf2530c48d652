"""Activity split into sessions at inactivity gaps, without one task per user.

Events are first combined, in the map tasks, into blocks of time no wider than the gap: no session can
end inside a block, so its first and last instant say all about it. A gap flag from `lag` over a user's
blocks and its running sum number the sessions. A user with a third of all rows is thus as many rows as
there are blocks in the time covered, whatever the number of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_copies(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Of each non-null key the row with the smallest `order`; rows with a null key all stay.

    Map tasks keep one row per key, so a key that is repeated very often stays small.
    """
    alone = F.when(F.col(f"`{key}`").isNull(), F.col(f"`{order}`"))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate([order, *columns])])
    kept = df.groupBy(F.col(f"`{key}`").alias("__key"), alone.alias("__alone")).agg(F.min(row).alias("__row"))
    return kept.select(*[F.col(f"__row.c{k + 1}").alias(c) for k, c in enumerate(columns)])


def sessionize(df: DataFrame, user: str, at_us: Column, flow: str, gap_us: int = 1_800_000_000) -> DataFrame:
    """Sessions of each user: columns user, start_us, end_us, n_events, n_flows.

    A session begins where more than `gap_us` lie between neighbouring events. Equal
    instants belong together. n_flows counts distinct non-null flows.
    Rows with a null user or instant belong to no session; repeated rows count as often
    as they occur; an empty table gives no rows.
    """
    rows = df.select(F.col(f"`{user}`").alias("user"), at_us.alias("t"), F.col(f"`{flow}`").alias("flow")).where(F.col("user").isNotNull() & F.col("t").isNotNull())
    block = F.floor(F.col("t") / max(1, gap_us)).alias("block")
    by_flow = rows.groupBy("user", block, "flow").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
    blocks = by_flow.groupBy("user", "block").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    over = Window.partitionBy("user").orderBy("block")
    blocks = blocks.select("user", "block", (F.col("first") - F.lag("last").over(over) > gap_us).cast("int").alias("flag"))
    session = F.coalesce(F.sum("flag").over(over.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    numbers = blocks.select(F.col("user").alias("u"), F.col("block").alias("b"), session.alias("session"))
    whole = by_flow.join(numbers, (F.col("user") == F.col("u")) & (F.col("block") == F.col("b")))
    flows = whole.groupBy("user", "session", "flow").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    return flows.groupBy("user", "session").agg(
        F.min("first").alias("start_us"), F.max("last").alias("end_us"), F.sum("n").alias("n_events"),
        F.count("flow").alias("n_flows")
    ).drop("session")
