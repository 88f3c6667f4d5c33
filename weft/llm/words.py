"""Words, word hashes and hashed counts shared by the operators of this package.

A word is a maximal run of letters or digits of any script in the lower-cased text.
Work is done on whole Arrow batches: one flat word list per batch, one 64-bit hash per
word, then numpy over the hashes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_ASCII = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def words(text: str) -> list[bytes]:
    """The words of ``text`` in UTF-8; [] for an empty or blank text."""
    if text.isascii():
        return text.encode().lower().translate(_ASCII).split()
    return [w.encode() for w in _WORD.findall(text.lower())]


class Hasher(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    BOUND = 500_000

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def flat(lists: list[list[bytes]], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch in order, and the offsets at which each text begins (n + 1)."""
    off = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=off[1:])
    get = hasher.__getitem__
    out = np.empty(off[-1], np.uint64)
    at = 0
    for x in lists:
        n = len(x)
        out[at : at + n] = list(map(get, x)) if n else 0
        at += n
    return out, off


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word sequences that lie in one text, and the text each belongs to, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = h[:n].copy()
    for i in range(1, k):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : n + i]
    own = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keep = own[:n] == own[k - 1 :]
    return mix(g[keep]), own[:n][keep]


def hashed_counts(df: DataFrame, bins: int, bin_ids: Callable[[pa.RecordBatch], np.ndarray], top: int = 255) -> np.ndarray:
    """Counts over all rows of ``df`` in ``bins`` hashed bins, each count cut off at ``top`` (<= 255).

    ``bin_ids`` gives the bin of every occurrence in a batch.  Each task holds one array of
    ``bins`` and sends it in pieces, so what is shuffled is tasks x bins bytes at most and
    what reaches the driver is exactly ``bins`` bytes, whatever the size of the data.
    """
    piece = min(bins, 1 << 16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(bins, np.uint8), False
        for b in batches:
            ids = bin_ids(b)
            if len(ids):
                seen = True
                u, c = np.unique(ids, return_counts=True)
                total[u] = np.minimum(total[u] + c, top)
        if seen:
            parts = total.reshape(-1, piece)
            for i, p in enumerate(parts):
                yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int32()), "n": pa.array([p.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(n, np.uint8)
                sums[i] = np.minimum(sums[i] + v, top) if i in sums else v.astype(np.uint16)
        for i, v in sums.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int32()), "n": pa.array([v.astype(np.uint8).tobytes()], pa.binary())})

    parts = df.mapInArrow(count, "piece int, n binary")
    pieces = bins // piece
    summed = parts.repartition(min(pieces, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.col("piece")).mapInArrow(add, "piece int, n binary")
    out = np.zeros(bins, np.uint8)
    for r in summed.collect():  # exactly ``bins`` bytes
        out[r.piece * piece : (r.piece + 1) * piece] = np.frombuffer(bytes(r.n), np.uint8)
    return out
