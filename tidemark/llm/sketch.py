"""Distinct counts over huge identifier sets with mergeable registers.

An identifier's hash picks one of 2**p registers and a rank k with probability 2**-(k+1).
A register keeps the largest rank it saw and, as two indicator bits, whether the next two
lower ranks occurred: 8 bits in all. The indicator bits carry information that a register of
the maximum alone throws away, so maximum likelihood reaches the same error in less space:
its relative standard error is about 0.761 / sqrt(2**p), and 2**p bytes do what takes 28 %
more in 6-bit registers. Two registers merge without loss into the one of all their identifiers.

A sketch is a binary value. Dense, it is the 2**p registers. As long as that takes less room, it
lists the registers in use instead, and for each which of its 64 cells (the next six bits of the hash)
are in use: four bytes a cell. Which cells are in use is one more observation in the same likelihood;
with it small sets are counted all but exactly. Estimation is by maximum likelihood for every size.

Sketches are built of runs of rows inside the map tasks, and only sketches are shuffled: a group
costs at most 2**p bytes for each run of rows it occurs in, however many identifiers it has.
Merging streams through sorted sketches, one group at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.session import ship

PRECISION = 15
INDICATORS = 2
CELLS = 6
EMPTY = 255


def relative_error(p: int = PRECISION, sigmas: float = 4.0) -> float:
    """The stated bound: so many standard errors (4: all but one of 16,000 counts lie within)."""
    return sigmas * 0.761 / math.sqrt(2**p)


def to_bytes(ranks: np.ndarray) -> np.ndarray:
    """Registers of bit sets of ranks (bit k: rank k occurred): the largest rank times 4, and whether the two below occurred."""
    top = np.frexp(ranks.astype(np.float64))[1] - 1
    top -= (ranks >> np.maximum(top, 0)) == 0  # a float may have rounded up
    return (top * 4 + (np.where(top >= 2, ranks >> np.maximum(top - 2, 0), ranks << np.maximum(2 - top, 0)) & 3)).astype(np.uint8)


def to_ranks(registers: np.ndarray) -> np.ndarray:
    """Bit sets of ranks of registers; 0 of empty ones."""
    value = registers.astype(np.int64)
    top, three = value >> 2, 4 + (value & 3)
    return np.where(value == EMPTY, 0, np.where(top >= 2, three << np.maximum(top - 2, 0), three >> np.maximum(2 - top, 0)))


def _binary(parts: list[bytes] | tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """Binary array of byte strings, or of (numbers, how many each value has)."""
    if isinstance(parts, list):
        return pa.array(parts, pa.binary())
    numbers, many = parts
    offsets = np.concatenate([[0], np.cumsum(many * numbers.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(numbers))])


def pack(group: np.ndarray, register: np.ndarray, cell: np.ndarray, ranks: np.ndarray, groups: int, p: int = PRECISION) -> pa.Array:
    """The sketch of each of `groups` groups from rows (group, register, cell, bit set of ranks)."""
    order = np.argsort((group.astype(np.int64) << (p + CELLS)) | (register.astype(np.int64) << CELLS) | cell, kind="stable")
    group, register, cell, ranks = group[order], register[order], cell[order], ranks[order]
    if not len(group):
        return pa.array([b""] * groups, pa.binary())
    other = np.concatenate([[True], (group[1:] != group[:-1]) | (register[1:] != register[:-1])])
    value = to_bytes(np.bitwise_or.reduceat(ranks, np.flatnonzero(other)))[np.cumsum(other) - 1]
    one = other | np.concatenate([[True], cell[1:] != cell[:-1]])
    group, register, cell, value = group[one], register[one], cell[one], value[one]
    entries = (register.astype(np.uint32) << np.uint32(8 + CELLS)) | (cell.astype(np.uint32) << np.uint32(8)) | value
    many = np.bincount(group, minlength=groups)
    if (many * 4 < 2**p).all():
        return _binary((entries, many))
    ends = np.cumsum(many)
    out = []
    for n, end in zip(many.tolist(), ends.tolist()):
        if n * 4 < 2**p:
            out.append(entries[end - n : end].tobytes())
        else:
            dense = np.full(2**p, EMPTY, np.uint8)
            dense[register[end - n : end]] = value[end - n : end]
            out.append(dense.tobytes())
    return _binary(out)


def union(group: np.ndarray, sketches: pa.Array, groups: int, p: int = PRECISION) -> pa.Array:
    """The sketch of each group from the sketches of its rows."""
    offsets = np.frombuffer(sketches.buffers()[1], np.int32)[sketches.offset : sketches.offset + len(sketches) + 1]
    data = np.frombuffer(sketches.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    dense_rows = np.flatnonzero(size == 2**p)
    is_dense = np.zeros(groups, bool)
    is_dense[group[dense_rows]] = True
    inside = np.repeat(size != 2**p, size)
    entries = np.frombuffer(data[offsets[0] : offsets[-1]][inside].tobytes(), np.uint32)
    owner = np.repeat(group, np.where(size == 2**p, 0, size // 4))
    register, cell, ranks = entries >> np.uint32(8 + CELLS), (entries >> np.uint32(8)) & np.uint32(2**CELLS - 1), to_ranks(entries & np.uint32(255))
    if not len(dense_rows):
        return pack(owner, register, cell, ranks, groups, p)
    few = ~is_dense[owner]
    out = pack(owner[few], register[few], cell[few], ranks[few], groups, p).to_pylist()
    held = {}
    for k in dense_rows:
        mine = to_ranks(data[offsets[k] : offsets[k + 1]])
        held[group[k]] = held[group[k]] | mine if group[k] in held else mine
    for g, mine in held.items():
        at = owner == g
        np.bitwise_or.at(mine, register[at], ranks[at])
        dense, used = np.full(2**p, EMPTY, np.uint8), mine != 0
        dense[used] = to_bytes(mine[used])
        out[g] = dense.tobytes()
    return _binary(out)


def _groups(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's group, a row of each group), nulls being a value."""
    n = len(columns[0]) if columns else 0
    code = np.zeros(n, np.int64)
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        d = c.dictionary_encode(null_encoding="encode")
        both = code * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False)
        code = np.unique(both, return_inverse=True)[1]
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    return number, first


def sketches(df: DataFrame, keys: dict[str, Column], identifier: Column, p: int = PRECISION, run_rows: int = 1 << 19) -> DataFrame:
    """Columns of `keys` and sketch (binary): the identifiers of each group. Partial: a group can have several rows.

    Null identifiers are not counted; null keys form groups of their own; repeated rows change
    nothing; an empty table gives no rows. run_rows: rows that are sketched together.
    """
    ship(df.sparkSession)
    slim = df.select(
        *[c.alias(k) for k, c in keys.items()], F.xxhash64(identifier).alias("__h"), identifier.alias("__id")
    ).where(F.col("__id").isNotNull()).drop("__id")
    names = list(keys)

    def sketch_run(run: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(run)
        columns = [table.column(k) for k in names]
        h = table.column("__h").to_numpy().view(np.uint64)
        group, first = _groups(columns) if names else (np.zeros(len(h), np.int64), np.zeros(1, np.int64))
        low = (h & np.uint64((1 << (64 - p)) - 1)).astype(np.int64)
        ranks = np.where(low == 0, 1 << (64 - p), low & -low)  # the lowest set bit is 2**k with probability 2**-(k+1)
        cell = (h >> np.uint64(64 - p - CELLS)) & np.uint64(2**CELLS - 1)
        packed = pack(group, (h >> np.uint64(64 - p)).astype(np.int64), cell.astype(np.int64), ranks, len(first), p)
        return pa.RecordBatch.from_arrays([*(c.take(pa.array(first)).combine_chunks() for c in columns), packed], [*names, "sketch"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                run.append(b)
            if sum(x.num_rows for x in run) >= run_rows:
                yield sketch_run(run)
                run = []
        if run:
            yield sketch_run(run)

    kinds = dict(slim.dtypes)
    return slim.mapInArrow(build, ", ".join([*(f"`{k}` {kinds[k]}" for k in names), "sketch binary"]))


def merge(parts: DataFrame, keys: list[str], p: int = PRECISION) -> DataFrame:
    """One sketch per group of `keys`, columns of `parts`. What is not named is summed over."""
    ship(parts.sparkSession)
    kinds = dict(parts.dtypes)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.RecordBatch | None = None  # the group that may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            if kept is not None:
                b = pa.Table.from_batches([kept, b]).combine_chunks().to_batches()[0]
            columns = [b.column(k) for k in keys]
            group, first = _groups(columns) if keys else (np.zeros(b.num_rows, np.int64), np.zeros(1, np.int64))
            done = pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(first)) for c in columns), union(group, b.column("sketch"), len(first), p)], [*keys, "sketch"]
            )
            last = int(group[-1])
            kept = done.slice(last, 1)
            yield pa.Table.from_batches([
                done.slice(0, last), done.slice(last + 1)
            ]).combine_chunks().to_batches()[0] if len(first) > 1 else done.slice(0, 0)
        if kept is not None:
            yield kept

    slim = parts.select(*keys, "sketch")
    rows = slim.repartition(*keys).sortWithinPartitions(*keys) if keys else slim.coalesce(1)
    return rows.mapInArrow(stream, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "sketch binary"]))


def merge_cube(parts: DataFrame, keys: list[str], p: int = PRECISION) -> DataFrame:
    """One sketch per group of every combination of `keys`; column level: bit j is set where the j-th last key is summed over.

    Each run of sketches is rolled up before it is shuffled, every combination from the next finer one.
    """
    ship(parts.sparkSession)
    kinds = dict(parts.dtypes)
    n = len(keys)

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done: dict[int, tuple[list[pa.Array], pa.Array]] = {}
            for level in range(2**n):
                if level == 0:
                    columns, from_ = [b.column(k) for k in keys], b.column("sketch")
                else:  # the combination with the highest missing key put back has been made before
                    columns, from_ = done[level & ~(1 << (level.bit_length() - 1))]
                    gone = n - level.bit_length()
                    columns = [pa.nulls(len(from_), c.type) if k == gone else c for k, c in enumerate(columns)]
                group, first = _groups(columns)
                at = pa.array(first)
                done[level] = [c.take(at) for c in columns], union(group, from_, len(first), p)
                yield pa.RecordBatch.from_arrays(
                    [*done[level][0], pa.array(np.full(len(first), level, np.int64)), done[level][1]], [*keys, "level", "sketch"]
                )

    rolled = parts.select(*keys, "sketch").mapInArrow(roll, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "level bigint", "sketch binary"]))
    return merge(rolled, [*keys, "level"], p)


def solve(registers: np.ndarray, cells: np.ndarray, p: int) -> np.ndarray:
    """Maximum-likelihood estimates. registers: (sketches, 256) how many registers have each value; cells: how many cells
    are in use, -1 where that is not known.

    With rate x per register, rank k occurs with probability 1 - exp(-x r), r = 2**-(k+1), and a cell is in use with
    probability 1 - exp(-x / 64). The likelihood is exp(-x a) times the product of (1 - exp(-x r_k))**b_k; its only maximum
    solves a = sum b_k r_k / (exp(x r_k) - 1), found by bisection on log x.
    """
    m, top = 2**p, 64 - p
    rate = np.append(2.0 ** -(np.arange(top + 1) + 1), 2.0**-CELLS)
    absent, present = np.zeros(256), np.zeros((256, top + 2))
    for value in range(4 * (top + 1)):
        u, bits = value >> 2, value & 3
        absent[value] = 2.0 ** -(u + 1)  # no rank above u
        present[value, u] = 1
        for d in range(1, INDICATORS + 1):
            if u - d >= 0:
                if bits >> (INDICATORS - d) & 1:
                    present[value, u - d] = 1
                else:
                    absent[value] += rate[u - d]
    used = registers[:, :EMPTY].sum(1)
    a, b = registers @ absent + (m - used), registers @ present
    known = cells >= 0
    a[known] += (m * 2.0**CELLS - cells[known]) * rate[-1]
    b[known, -1] += cells[known]
    low, high = np.full(len(a), -40.0), np.full(len(a), 45.0)
    for _ in range(70):
        mid = (low + high) / 2
        with np.errstate(over="ignore"):
            slope = (b * rate / np.expm1(np.minimum(np.exp(mid)[:, None] * rate, 700))).sum(1) - a
        low, high = np.where(slope > 0, mid, low), np.where(slope > 0, high, mid)
    return np.where(used == 0, 0.0, m * np.exp((low + high) / 2))


def estimate(merged: DataFrame, keys: list[str], p: int = PRECISION) -> DataFrame:
    """Columns `keys` and estimate (double): the distinct identifiers of each sketch."""
    ship(merged.sparkSession)

    @pandas_udf("double")
    def likeliest(column: pd.Series) -> pd.Series:
        registers, cells = np.zeros((len(column), 256)), np.full(len(column), -1.0)
        for k, s in enumerate(column):
            if len(s) == 2**p:
                values = np.frombuffer(s, np.uint8)
                registers[k] = np.bincount(values[values != EMPTY], minlength=256)
            else:
                entries = np.frombuffer(s, np.uint32)
                first = np.concatenate([[True], np.diff(entries >> np.uint32(8 + CELLS)) != 0])[: len(entries)]
                registers[k] = np.bincount(entries[first] & np.uint32(255), minlength=256)
                cells[k] = len(entries)
        return pd.Series(solve(registers, cells, p))

    return merged.select(*keys, likeliest("sketch").alias("estimate"))
