"""Passages of held-out items inside a corpus.

Items and documents are sequences of words; every window of an item (as many words as a
leak must have) is a query. The CGK random walk reads a window symbol by symbol and, by a
random bit of (step, symbol), either stays on the symbol or goes on; two windows at a small
edit distance soon walk in step again, so that edits turn into few differing outputs. Random
samples of these outputs are the keys of a locality-sensitive hash: as many repetitions of them
as reach the target recall, measured on edited windows; equal windows always collide. Every
collision is then verified by the exact edit distance. Whole passages are found the same way,
as those verified with distance 0.

The items are the stated query set; they are broadcast in blocks of bounded size. Documents
never move: each is read once for each block where it lies, whole, and only hits leave the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, without regard to case."""
    return _WORD.findall(text.lower()) if text else []


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing function (xor, shift, multiply)."""
    x = (x ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Embedding:
    """CGK embedding of windows: several random walks, each with several bit samples of its output."""

    SAMPLES_OF_A_WALK = 4

    def __init__(self, window: int, repetitions: int, samples: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.window, self.steps, self.repetitions = window, 3 * window, repetitions
        self.walks = []
        for first in range(0, repetitions, self.SAMPLES_OF_A_WALK):
            seeds = [int(x) for x in draw.integers(1, 2**62, self.steps)]
            # a window has been read to its end after about two steps a symbol
            picks = [np.sort(draw.choice(2 * window, samples, replace=False)) for _ in range(min(self.SAMPLES_OF_A_WALK, repetitions - first))]
            self.walks.append((seeds, picks))

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """(repetitions, windows) keys of a matrix of word numbers (0: a word of no item)."""
        n = len(windows)
        padded = np.concatenate([windows.astype(np.uint64) + np.uint64(1), np.zeros((n, 1), np.uint64)], axis=1).ravel()
        base = np.arange(n) * (self.window + 1)
        keys = np.zeros((self.repetitions, n), np.uint64)
        r = 0
        for seeds, picks in self.walks:
            pointer = np.zeros(n, np.int64)
            for j in range(max(p[-1] for p in picks) + 1):
                symbol = padded[base + pointer]
                for k, pick in enumerate(picks):
                    if j in pick:
                        keys[r + k] = _mix(keys[r + k] + symbol, seeds[0] + k)
                pointer = np.minimum(pointer + (_mix(symbol, seeds[j]) & np.uint64(1)).astype(np.int64), self.window)
            r += len(picks)
        return keys


def near_prefixes(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Least edit distance of each row of `a` to any prefix of that row of `b` (`most` symbols longer; 0 equals nothing).

    Exact up to `most`; anything greater comes out as more than `most`. Only the cells within `most` of the diagonal
    count, for all rows at once.
    """
    n, w = a.shape
    far = np.int8(most + 1)
    band = [np.full(n, max(d, 0) if d >= 0 else far, np.int8) for d in range(-most, most + 1)]  # by column minus row
    columns, rows = np.ascontiguousarray(b.T), np.ascontiguousarray(a.T)
    for i in range(w):
        for k, d in enumerate(range(-most, most + 1)):
            j = i + d  # row i + 1, column j + 1
            if j < 0:
                value = np.full(n, i + 1 if j == -1 else far, np.int8)
            else:
                value = band[k] + ((rows[i] != columns[j]) | (rows[i] == 0))
                if k:
                    np.minimum(value, band[k - 1] + 1, out=value)
            if k + 1 < len(band):
                np.minimum(value, band[k + 1] + 1, out=value)
            band[k] = np.minimum(value, far).astype(np.int8)
    return np.min(band, axis=0)


class Index:
    """The windows of a block of items, their words and their keys."""

    MOST = 4096

    def __init__(self, items: list[tuple[int, str]], window: int, max_edits: int, target: float):
        self.window, self.max_edits = window, max_edits
        self.vocabulary: dict[str, int] = {}
        rows, owner, pairs = [], [], []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            pairs += zip(ids, ids[1:])
            for k in range(len(ids) - window + 1):
                rows.append(ids[k : k + window])
                owner.append(item)
        # equal windows of several items are one window with several owners
        self.windows, number = np.unique(np.array(rows, np.int32).reshape(-1, window), axis=0, return_inverse=True)
        order = np.argsort(number.ravel(), kind="stable")
        self.owner, self.owners_from = np.array(owner, np.int64)[order], np.searchsorted(number.ravel()[order], np.arange(len(self.windows) + 1))
        self.pairs = np.unique(self._pair(*np.array(pairs, np.int64).reshape(-1, 2).T))
        samples = max(3, window // (1 + 2 * max_edits))
        self.embedding, self.recall = self._embedding(samples, target)
        keys = self.embedding.keys(self.windows)
        self.order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left * (len(self.vocabulary) + 1) + right

    def _edited(self, trials: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item windows, passages with `max_edits` changed, added or lost words anywhere among foreign words, kinds."""
        draw = np.random.default_rng(11)
        w, e = self.window, self.max_edits
        a = self.windows[draw.integers(0, len(self.windows), trials)]
        b = np.zeros((trials, w + 3 * e), np.int64)
        kinds = np.arange(trials) % 3
        for k in range(trials):
            x = list(a[k])
            for _ in range(e):
                at = int(draw.integers(0, len(x)))
                if kinds[k] == 0:
                    x[at] = 0
                elif kinds[k] == 1:
                    x.insert(at, 0)
                else:
                    del x[at]
            b[k, e : e + len(x)] = x
        return a, b, kinds

    def _embedding(self, samples: int, target: float, trials: int = 3000) -> tuple[Embedding, float]:
        """The embedding with as many repetitions as reach the target recall, and that recall.

        Measured as search() finds them, collision and verification, on `trials` edited windows of the items,
        changed, added and lost words each, since windows differ in how easily they meet.
        """
        if not len(self.windows):
            return Embedding(self.window, 1, samples), 1.0
        w, e = self.window, self.max_edits
        a, b, kinds = self._edited(trials)
        most = 16
        while most <= self.MOST:
            probe = Embedding(w, most, samples)
            mine, met = probe.keys(a), np.zeros((most, trials), bool)
            for start in range(2 * e + 1):
                near = b[:, start : start + w + e]
                good = near_prefixes(a, near, e) <= e
                met |= (mine == probe.keys(near[:, :w])) & good
            met = np.logical_or.accumulate(met, axis=0)
            recall = np.min([met[:, kinds == k].mean(axis=1) for k in range(3)], axis=0)
            if recall[-1] >= target:
                enough = int(np.flatnonzero(recall >= target)[0])
                return Embedding(w, enough + 1, samples), float(recall[enough])
            most *= 4
        raise ValueError(f"{self.MOST} repetitions find less than {target:.4f} of the windows with {e} edits")

    def _possible(self, ids: np.ndarray, document: np.ndarray) -> np.ndarray:
        """Where a passage can start, by counts that no match can miss.

        Each edit makes at most one word foreign to all items, and at most two pairs of neighbouring words.
        """
        w, e, n = self.window, self.max_edits, len(ids)
        foreign = np.concatenate([[0], np.cumsum(ids == 0)])
        known = np.zeros(n - 1, bool)
        both = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
        asked = self._pair(ids[both], ids[both + 1])
        place = np.minimum(np.searchsorted(self.pairs, asked), len(self.pairs) - 1)
        known[both] = self.pairs[place] == asked
        strange = np.concatenate([[0], np.cumsum(~known)])
        # passages that end before the window does have used edits for that
        shortest = w - e
        starts = np.arange(n - w + 1)
        fits = (foreign[w:] - foreign[:-w] <= e) & (document[: n - w + 1] >= 0)
        return np.flatnonzero(fits & (strange[starts + max(shortest - 1, 0)] - strange[starts] <= 2 * e))

    def search(self, ids: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, edits) of verified windows. ids: word numbers of several documents, `window` zeros after each.

        document: of each word; -1 for the zeros, where no passage starts. A collision is verified against the passages
        of all lengths within `max_edits` of the window's that start with it.
        """
        w = self.window
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [tuple(np.zeros(0, np.int64) for _ in range(3))]
        if len(ids) < w or not len(self.windows):
            return out[0]
        at = self._possible(ids, document)
        views = np.lib.stride_tricks.sliding_window_view(np.concatenate([ids, np.zeros(self.max_edits, ids.dtype)]), w + self.max_edits)
        for low in range(0, len(at), 1 << 14):
            part = at[low : low + (1 << 14)]
            mine = views[part]
            keys = self.embedding.keys(mine[:, :w])
            met = np.zeros(0, np.int64)
            for r in range(len(keys)):
                left, right = np.searchsorted(self.keys[r], keys[r], "left"), np.searchsorted(self.keys[r], keys[r], "right")
                many = right - left
                which = np.repeat(np.arange(len(part)), many)
                item = self.order[r][np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(left, many)]
                met = np.union1d(met, which * len(self.windows) + item)
            for first in range(0, len(met), 1 << 18):
                which, item = np.divmod(met[first : first + (1 << 18)], len(self.windows))
                edits = near_prefixes(self.windows[item], mine[which], self.max_edits)
                good = edits <= self.max_edits
                which, item, edits = which[good], item[good], edits[good]
                many = self.owners_from[item + 1] - self.owners_from[item]
                nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.owners_from[item], many)
                out.append((document[part[np.repeat(which, many)]], self.owner[nth], np.repeat(edits, many).astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def find_leaks(
    documents: DataFrame, items: DataFrame, window: int = 13, max_edits: int = 0, target: float = 0.95, doc_id: str = "doc_id",
    doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = 200_000
) -> DataFrame:
    """doc_id, item_id, edits: documents with a passage within `max_edits` word edits of a window of `window` words of the item.

    One row per document and item with the fewest edits found. The search is always made for at least one edit.
    Windows that occur unchanged are all found; the chance of finding one with edits is at least `target` for changed,
    added and lost words each (ValueError if that can't be reached). Null or empty texts and items
    of fewer words than `window` have no windows; repeated rows give one row; empty tables give none.
    block_words: about how many words of items are broadcast at a time (about a kilobyte each); more items are searched
    block by block. An item is never divided.
    """
    spark = documents.sparkSession
    ship(spark)
    slim = documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{doc_text}`").alias("text"))
    asked = items.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"), F.col(f"`{item_text}`").alias("text")).where("item_id is not null and text is not null")
    n_words = asked.agg(F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")))).first()[0] or 0
    blocks = max(1, -(-n_words // block_words))
    reach = max(1, max_edits)
    found = None
    for k in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        index = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in mine.collect()], window, reach, target))

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            find = index.value
            gap = np.zeros(window, np.int64)
            for b in batches:
                ids, document = [], []
                for n, text in enumerate(b.text):
                    mine = np.fromiter((find.vocabulary.get(w, 0) for w in words(text)), np.int64)
                    ids += [mine, gap]
                    document += [np.full(len(mine), n), np.full(window, -1)]
                if not ids:
                    continue
                d, i, e = find.search(np.concatenate(ids), np.concatenate(document))
                hits = pd.DataFrame({"doc_id": b.doc_id.to_numpy()[d], "item_id": i, "edits": e})
                yield hits.groupby(["doc_id", "item_id"], as_index=False, dropna=False).edits.min()

        part = slim.mapInPandas(search, "doc_id bigint, item_id bigint, edits bigint")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits")).where(F.col("edits") <= max_edits)
