"""Exactly one copy of each message that was delivered at least once.

The stream keeps the identifiers it has seen in Spark's keyed state store, which is
checkpointed together with the output. The key of the store is a hash bucket; its value
is one packed table of (128-bit identifier hash, smallest order number, event time), so
that a micro-batch is merged with numpy and not key by key in Python. Identifiers leave
the store when the event-time watermark passes them and go to an archive; whatever
arrives later is looked up there, so expiry never costs exactness.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.session import read_table, shared_folder, ship, stream_table

ENTRY = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("row", "<i8"), ("at", "<i8"), ("asked", "<i8")])
SURPLUS, ASKED, EXPIRED = 1, 2, 3
_OUT = "kind int, h1 bigint, h2 bigint, row bigint"
_STATE = "seen binary, newest bigint, expired boolean"
_UNTIMED = np.iinfo(np.int64).min


def _first_in_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks, inside each Arrow batch, the copies behind the first: they are surplus whatever else comes.

    They are spread by order number, so an identifier that is repeated very often fills no bucket.
    """
    for b in batches:
        order = np.lexsort((b.row.to_numpy(), b.h2.to_numpy(), b.h1.to_numpy()))
        b = b.iloc[order].reset_index(drop=True)
        same = (b.h1 == b.h1.shift()) & (b.h2 == b.h2.shift())
        least = b.row.where(~same).ffill().astype("int64")
        b["surplus"] = same & (b.row > least)
        b = b[~same | b.surplus]
        b["bucket"] = np.where(b.surplus, b.row.to_numpy(), b.bucket.to_numpy())
        yield b


def _merge(old: np.ndarray, new: np.ndarray, newest: int, expired: bool, horizon: int) -> tuple[np.ndarray, int, bool, list[tuple[int, np.ndarray]]]:
    """State and outputs after a micro-batch of one bucket."""
    out: list[tuple[int, np.ndarray]] = []
    mark = newest - horizon if newest > _UNTIMED else _UNTIMED
    timed = new["at"][new["at"] > _UNTIMED]
    later = max(newest, int(timed.max())) if len(timed) else newest
    new["at"][new["at"] == _UNTIMED] = later  # without event time they stay as long as the newest
    both = np.concatenate([old, new])
    is_new = np.arange(len(both)) >= len(old)
    order = np.lexsort((both["row"], both["h2"], both["h1"]))
    both, is_new = both[order], is_new[order]
    starts = np.ones(len(both), bool)
    starts[1:] = (both["h1"][1:] != both["h1"][:-1]) | (both["h2"][1:] != both["h2"][:-1])
    at = np.flatnonzero(starts)
    if not len(at):
        return both, later, expired, out
    group = np.cumsum(starts) - 1
    kept = both[at].copy()
    surplus = both["row"] > kept["row"][group]
    out.append((SURPLUS, both[surplus]))
    kept["at"] = np.maximum.reduceat(both["at"], at)
    kept["asked"] = np.maximum.reduceat(both["asked"], at)
    unseen = np.logical_and.reduceat(is_new, at)
    late = unseen & (kept["at"] < mark)
    fresh = unseen & ~late & expired
    moved = is_new[at] & ~unseen & (kept["asked"] == 1)  # a smaller row took over from one that was already asked for
    out.append((ASKED, kept[late | fresh | moved]))
    kept["asked"] |= fresh
    kept = kept[~late]
    mark = later - horizon if later > _UNTIMED else _UNTIMED
    gone = kept["at"] < mark
    out.append((EXPIRED, kept[gone]))
    return kept[~gone], later, bool(expired or gone.any() or late.any()), out


def _stateful(horizon: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, newest, expired = state.get if state.exists else (b"", _UNTIMED, False)
        parts = []
        for b in batches:
            done = b[b.surplus]
            if len(done):
                yield pd.DataFrame({"kind": np.int32(SURPLUS), "h1": done.h1, "h2": done.h2, "row": done.row})
            b = b[~b.surplus]
            part = np.zeros(len(b), ENTRY)
            for c in ("h1", "h2", "row", "at"):
                part[c] = b[c]
            parts.append(part)
        new = np.concatenate(parts) if parts else np.zeros(0, ENTRY)
        if not len(new):
            return
        kept, newest, expired, out = _merge(np.frombuffer(bytes(seen), ENTRY), new, newest, expired, horizon)
        state.update((kept.tobytes(), newest, expired))
        for kind, x in out:
            if len(x):
                yield pd.DataFrame({"kind": np.int32(kind), "h1": x["h1"], "h2": x["h2"], "row": x["row"]})

    return step


def surplus_stream(stream: DataFrame, identifier: str, row: str, at_us: Column, horizon_us: int, buckets: int) -> DataFrame:
    """The stateful part: rows (kind, h1, h2, row) of a stream of deliveries.

    kind 1 is a surplus delivery; 2 asks the archive about an identifier that the state doesn't
    hold though it may have expired; 3 is an archive entry. A null identifier is never a copy.
    """
    ship(stream.sparkSession)
    ident = F.col(f"`{identifier}`")
    slim = stream.where(ident.isNotNull()).select(
        F.xxhash64(ident).alias("h1"),
        F.xxhash64(F.lit("second"), ident).alias("h2"),
        F.col(f"`{row}`").cast("bigint").alias("row"),
        F.coalesce(at_us, F.lit(int(_UNTIMED))).cast("bigint").alias("at"),
    )
    slim = slim.select("*", F.pmod("h1", F.lit(buckets)).alias("bucket"), F.lit(False).alias("surplus"))
    first = slim.mapInPandas(_first_in_batch, slim.schema)
    first = first.withColumn("bucket", F.when(F.col("surplus"), F.pmod("bucket", F.lit(buckets))).otherwise(F.col("bucket")))
    return first.groupBy("bucket").applyInPandasWithState(_stateful(horizon_us), _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def resolve(events: DataFrame) -> DataFrame:
    """Order numbers of surplus rows: those the state found and those the archive settles."""
    sure = events.where(F.col("kind") == SURPLUS).select("row")
    asked = events.where(F.col("kind") != SURPLUS).select("h1", "h2", "row")
    least = asked.groupBy(F.col("h1").alias("a"), F.col("h2").alias("b")).agg(
        F.min("row").alias("least"), F.max("row").alias("most")
    ).where("most > least")
    settled = asked.join(least, (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b"))).where("row > least").select("row")
    return sure.unionByName(settled).distinct()


def surplus_rows(
    spark: SparkSession, folder: str, table: str, identifier: str, row: str, at_us: Column, horizon_us: int = 30 * 86_400_000_000,
    buckets: int | None = None, files_per_trigger: int = 12
) -> DataFrame:
    """Column row: every delivery in `table` whose non-null identifier also occurs at a smaller `row`.

    The table's files are replayed as a stream until they end; state, offsets and output share one
    checkpoint, so a lost executor or a restarted query neither loses nor repeats rows.

    horizon_us: how long (event time) an identifier stays in the state; anything later is settled by
    the archive. buckets: parts of the state, each a packed table of 40 bytes per identifier in the
    horizon; by default as many as keep one below 10 MB if all rows of the table were in it, and 48 at least. Identifiers are compared as written, by a 128-bit hash.
    Null event times are taken as the newest; null identifiers are never surplus; the same
    `row` delivered twice is one delivery; an empty table gives no rows.
    """
    base = shared_folder(spark, f"dedup-{table}")
    if buckets is None:
        buckets = max(48, -(-read_table(spark, folder, table).count() // 250_000))  # a count from the files' footers
    events = surplus_stream(stream_table(spark, folder, table, files_per_trigger), identifier, row, at_us, horizon_us, buckets)
    query = events.writeStream.format("parquet").option("path", f"{base}/events").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return resolve(spark.read.schema(_OUT).parquet(f"{base}/events"))
