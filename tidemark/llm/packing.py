"""Texts of varying length into containers of fixed capacity.

The plan needs only how many items there are of each size: at most `capacity` numbers,
whatever the number of texts. It is made on the driver from this histogram, as classes of
equal containers, and says for each size which ranks go to which containers. Ranking the
items of one size and looking up their containers are distributed again.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut, ship

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published word pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(df: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens of every row; null and empty texts have none. `tokenizer`: file of ranks, present on every executor."""
    ship(df.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(tokenizer, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "n_tokens": [len(encoding.encode_ordinary(t)) if t else 0 for t in b.text]})

    slim = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInPandas(count, f"doc_id {kind}, n_tokens bigint")


class Container:
    """A class of equal containers: how many, and (size, items of that size in each) of their content."""

    __slots__ = ("count", "content")

    def __init__(self, count: int, content: tuple[tuple[int, int], ...]):
        self.count, self.content = count, content


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Container]:
    """Classes of containers that hold `histogram` (size -> number of items, sizes 1 to capacity).

    Items above a third of the capacity come first: the largest is matched with the largest
    partner that still fits, at most two to a container. The smaller ones follow from large to
    small, each into the fullest container that has room (best fit), and open new containers
    only when none has.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    by_gap: dict[int, list[Container]] = {}
    gaps: list[int] = []

    def put(gap: int, c: Container) -> None:
        if gap not in by_gap:
            by_gap[gap] = []
            insort(gaps, gap)
        by_gap[gap].append(c)

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        b = large[k] if k >= 0 else None
        if b is None or (b == a and left[a] == 1):
            put(capacity - a, Container(left[a], ((a, 1),)))
            left[a] = 0
        elif b == a:
            put(capacity - 2 * a, Container(left[a] // 2, ((a, 2),)))
            left[a] %= 2
        else:
            n = min(left[a], left[b])
            put(capacity - a - b, Container(n, ((a, 1), (b, 1))))
            left[a] -= n
            left[b] -= n
        large = [s for s in large if left[s]]
    for size in sorted((s for s in left if left[s]), reverse=True):
        need = left[size]
        while need:
            k = bisect_left(gaps, size)
            if k == len(gaps):
                per = capacity // size
                if need >= per:
                    put(capacity - per * size, Container(need // per, ((size, per),)))
                if need % per:
                    put(capacity - need % per * size, Container(1, ((size, need % per),)))
                break
            gap = gaps[k]
            c = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
                gaps.pop(k)
            per = min(gap // size, need)
            n = min(c.count, need // per)
            if n < c.count:
                put(gap, Container(c.count - n, c.content))
            put(gap - per * size, Container(n, (*c.content, (size, per))))
            need -= n * per
    return [c for g in gaps for c in by_gap[g]]


def pack(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER,
    salt: int = 64
) -> DataFrame:
    """doc_id, part, token_from, token_to, n_tokens, container_id: where each text (or part of it) goes.

    Only texts above the capacity are split: into full containers (with numbers below zero) and one rest, which is packed
    like a text of its size. Texts without tokens (null or empty) need no container: part 0 with a
    null container_id. Repeated rows are packed each; an empty table gives no rows.
    The lookup table of the plan depends on `capacity`, not on the number of texts: it has at most
    a few rows for each pair of size and container class.
    """
    spark = df.sparkSession
    sized = cut(token_counts(df, doc_id, text, tokenizer), "token-counts")
    parts = F.when(F.col("n_tokens") == 0, F.lit(1).cast("bigint")).otherwise(F.ceil(F.col("n_tokens") / capacity))
    items = sized.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    start = F.col("part") * capacity
    items = items.select(
        "doc_id", F.col("part").cast("int").alias("part"), start.alias("token_from"),
        F.least(start + capacity, F.col("n_tokens")).alias("token_to")
    )
    items = items.select(
        "*", (F.col("token_to") - F.col("token_from")).alias("size"),
        F.pmod(F.xxhash64("doc_id", "part"), F.lit(salt)).cast("int").alias("bucket")
    )
    # what fills a container needs no plan and no order, only numbers of its own: those below all others
    full = items.where(F.col("size") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("container_id"))
    items = items.where(F.col("size") < capacity)
    cells = items.where("size > 0").groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["size"]: r["n"] for r in cells.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    rows, taken, first = [], dict.fromkeys(histogram, 0), 0
    for c in plan(histogram, capacity):
        for size, per in c.content:
            rows.append((size, taken[size], taken[size] + per * c.count, first, per))
            taken[size] += per * c.count
        first += c.count
    table = spark.createDataFrame(
        pd.DataFrame(rows, columns=["s", "low", "high", "first", "per"]).astype("int64") if rows else [],
        "s bigint, low bigint, high bigint, first bigint, per bigint"
    )
    over = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(F.col("size").alias("z"), F.col("bucket").alias("q"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "part")) - 1
    ranked = items.where("size > 0").select("*", number.alias("number")).join(
        offsets, (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("q"))
    ).withColumn("rank", F.col("number") + F.col("offset"))
    # the plan has at most a few rows for each size, so its place in memory is bounded by the capacity
    placed = ranked.join(F.broadcast(table), (F.col("size") == F.col("s")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.withColumn("container_id", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("per")))
    empty = items.where("size = 0").withColumn("container_id", F.lit(None).cast("bigint"))
    columns = ["doc_id", "part", "token_from", "token_to", F.col("size").alias("n_tokens"), "container_id"]
    return placed.select(*columns).unionByName(full.select(*columns)).unionByName(empty.select(*columns))
