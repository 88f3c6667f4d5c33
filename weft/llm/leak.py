"""Problem 6: evaluation texts leaking into training text, by winnowing.

Every text is turned into hashes of k = 8 consecutive words; of every window of w = 5 such
hashes the smallest (the rightmost of equals) is kept as a fingerprint.  A span of
k + w - 1 = 12 words that two texts share has a whole window in both, so both keep the same
fingerprint in it: no shared span of 12 words is missed.  Fingerprints of documents and items
are joined and every hit is extended word by word to the longest shared run around it; runs of
``least`` words or more are leaks.

Held-out sets are small next to a corpus.  Their texts are taken in blocks of a bounded size, and each
block goes to the executors as sorted arrays: the corpus is read once per block and never shuffled, so a
fingerprint that a third of all documents have is no hot key.  The usual set is one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.words import Hasher, flat, shingles, words

K, WINDOW = 8, 5
#: Characters of a block of items (about as many words and fingerprints of 8 bytes as a sixth of it) that executors hold at once.
BOUND = 8_000_000


def winnow(h: np.ndarray, off: np.ndarray, k: int = K, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of a batch: ``(hash, text number, word position within the flat batch)``, in order."""
    g, own = shingles(h, off, k)
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # position of a shingle in the flat word array: its rank among its text's shingles + the text's offset
    begin = np.searchsorted(own, np.arange(len(off) - 1))
    at = off[own] + np.arange(len(own)) - begin[own]
    stack = np.stack([g[w - 1 - i : w - 1 - i + n] for i in range(w)])  # rightmost first: argmin takes it among equals
    pick = np.arange(n) + (w - 1) - np.argmin(stack, axis=0)
    pick = np.unique(pick[own[:n] == own[w - 1 :]])
    return g[pick], own[pick], at[pick]


def _lists(b: pa.RecordBatch) -> list[list[bytes]]:
    return [words(t) if t else [] for t in b.column("text").to_pylist()]


class _Items:
    """Item texts as arrays: words, offsets and sorted fingerprints."""

    def __init__(self, ids: np.ndarray, lists: list[list[bytes]]):
        self.ids = ids
        self.h, self.off = flat(lists, Hasher())
        f, own, at = winnow(self.h, self.off)
        order = np.argsort(f, kind="stable")
        self.f, self.own, self.at = f[order], own[order], at[order]


def _run(d: np.ndarray, p: int, lo: int, hi: int, e: np.ndarray, q: int, elo: int, ehi: int) -> tuple[int, int]:
    """The longest run of equal words around d[p] = e[q]: its begin in d and its length."""
    back = 0
    while p - back > lo and q - back > elo and d[p - back - 1] == e[q - back - 1]:
        back += 1
    n = 0
    while p + n < hi and q + n < ehi and d[p + n] == e[q + n]:
        n += 1
    return p - back, back + n


def _hits(h: np.ndarray, off: np.ndarray, items: _Items, least: int) -> Iterator[tuple[int, int, int, int]]:
    """``(text, item, begin, length)`` of the shared runs of a batch."""
    f, own, at = winnow(h, off)
    if not len(f) or not len(items.f):
        return
    left = np.searchsorted(items.f, f, "left")
    right = np.searchsorted(items.f, f, "right")
    ends: dict[tuple[int, int, int], int] = {}  # of the last run on a diagonal: hits inside it are the same run
    whole: set[tuple[int, int]] = set()  # items found from begin to end: no run can be longer
    for i in np.flatnonzero(right > left):
        t, p = int(own[i]), int(at[i])
        for j in range(left[i], right[i]):
            m, q = int(items.own[j]), int(items.at[j])
            if (t, m) in whole or p < ends.get((t, m, p - q), 0):
                continue
            lo, hi = int(items.off[m]), int(items.off[m + 1])
            begin, n = _run(h, p, int(off[t]), int(off[t + 1]), items.h, q, lo, hi)
            ends[t, m, p - q] = begin + n
            if n == hi - lo:
                whole.add((t, m))
            if n >= least:
                yield t, m, begin - int(off[t]), n


def leaks(docs: DataFrame, items: DataFrame, least: int = K + WINDOW - 1, bound: int = BOUND) -> DataFrame:
    """``(doc_id, item_id, begin, length)``: the longest shared run per document row and item, in words.

    ``docs(doc_id, text)``, ``items(item_id, text)``.  Null ids, null and empty texts and texts of fewer
    than ``least`` words leak nothing.  Of equally long runs the first counts.  ``least`` must not be
    below k + w - 1, from where on every run is found.  Items are taken in blocks of about ``bound`` characters (a
    longer one is a block of its own); the result doesn't depend on it.
    """
    if least < K + WINDOW - 1:
        raise ValueError(f"runs below {K + WINDOW - 1} words are not guaranteed to be found")
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-chars // bound))
    parts = [_hits_of(docs, items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i), least) for i in range(blocks)]
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("length", (-F.col("begin")).alias("b"))).alias("m")).select("doc_id", "item_id", (-F.col("m.b")).alias("begin"), F.col("m.length").alias("length"))


_OUT = "doc_id long, item_id long, begin int, length int"


def _out(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32())], ["doc_id", "item_id", "begin", "length"])


def _hits_of(docs: DataFrame, items: DataFrame, least: int) -> DataFrame:
    rows = items.collect()  # one block
    sent = docs.sparkSession.sparkContext.broadcast(_Items(np.array([r.item_id for r in rows], np.int64), [words(r.text) for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, it = Hasher(), sent.value
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            h, off = flat(_lists(b), hasher)
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for t, m, begin, n in _hits(h, off, it, least):
                if n > best.get((t, m), (0, 0))[1]:
                    best[t, m] = begin, n
            if best:
                yield _out([(ids[t], int(it.ids[m]), begin, n) for (t, m), (begin, n) in best.items()])

    return docs.mapInArrow(run, _OUT)
