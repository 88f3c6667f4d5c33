"""Sections as weighted vectors of terms (A9): in how many sections a term occurs, and the keys in which similar sections meet.

A vector never leaves the task that makes it.  What leaves is one count per term and task, and per section a signature of its
vector and a few keys, so that the rows shuffled don't follow the number of terms.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.text import CJK, STOPWORDS

#: Most terms whose number of sections every task knows; of the others it knows an upper bound.
KNOWN = 200_000
#: Sums of weights in a batch are off by less than this.
SLACK = 1e-6

_WORD = bytes(c if c < 128 and (chr(c).isalnum() or c == 95) else 32 for c in range(256))
_RUN = re.compile(f"[{CJK}]+")
_STOP = frozenset(w.encode() for w in STOPWORDS)


def tokens(body: bytes) -> list[bytes]:
    """The terms of ``functions.text.rule_terms``, with stopwords, single letters and outer underscores, which :class:`Terms` drops."""
    out = body.lower().translate(_WORD).split()
    if not body.isascii():
        for r in _RUN.findall(body.decode("utf-8", "replace")):
            out += [r[i : i + 2].encode() for i in range(max(1, len(r) - 1))]
    return out


class Terms(dict):
    """Token -> number of its term: known terms come first, others as they are met (``new``); -1 is no term."""

    def __init__(self, known: dict[bytes, int]):
        super().__init__(known)
        self.known, self.new = len(known), []

    def __missing__(self, token: bytes) -> int:
        term = token.strip(b"_")
        if len(term) < 2 or term in _STOP:
            n = -1
        elif term != token:
            n = self[term]
        else:
            n = self.known + len(self.new)
            self.new.append(term)
        self[token] = n
        return n


def _hashes(terms: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes a term."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, terms)), "<u8").reshape(-1, 2).T.astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _counted(bodies: list[bytes], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Row, term and count of each term of each text, in this order; the new terms, numbered by their hashes, and these."""
    terms = Terms(known)
    lists = [list(map(terms.__getitem__, tokens(b))) for b in bodies]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    term = np.fromiter(chain.from_iterable(lists), np.int64, len(row))
    h = _hashes(terms.new)
    order = np.lexsort(h)
    place = np.arange(terms.known + len(order))
    place[terms.known + order] = terms.known + np.arange(len(order))
    row, term = row[term >= 0], place[term[term >= 0]]
    span = max(1, len(place))
    at, count = np.unique(row * span + term, return_counts=True)
    return at // span, at % span, count, [terms.new[i] for i in order], h[:, order]


def frequencies(texts: DataFrame) -> DataFrame:
    """``(term, df)``: in how many rows of ``texts(id, body binary)`` a term occurs; counted in each batch before rows of terms are made."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, term, _, new, _ = _counted(b.column("body").to_pylist(), {})
            n = np.bincount(term, minlength=len(new))
            yield pa.RecordBatch.from_pydict({"term": pa.array(new, pa.binary()).cast(pa.string()), "df": pa.array(n, pa.int64())})

    return texts.mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def known_terms(df: DataFrame) -> tuple[list[bytes], np.ndarray, int]:
    """All terms of ``df(term, df)`` in so many sections or more, frequent ones first, with their df; and the most that another term can be in."""
    top = df.where("df > 1").orderBy(F.desc("df"), "term").limit(KNOWN + 1).toArrow()
    n = top.column("df").to_numpy()
    rest = int(n[KNOWN]) if len(n) > KNOWN else 1
    kept = int((n > rest).sum())
    return [t.encode() for t in top.column("term").to_pylist()[:kept]], n[:kept], rest


def keyed(texts: DataFrame, known: tuple[list[bytes], np.ndarray, int], n: int, t: float, depth: int) -> DataFrame:
    """``(id, s1, s2, keys, parts)`` of each of ``texts(id, body binary)`` that has a key: texts with a cosine of ``t`` or more share one.

    Terms go from rare to frequent.  Of the first ``depth`` terms that two texts share, let j be the last: all others that they share
    come after it, so a cosine of t needs (squares of the first ones) + (squares after j) >= t² of all squares of either vector; of both parts
    the product must be t² or more.  So a text has a key for each set of ``depth`` terms of which this holds, and for smaller sets that are
    enough without any term after them; a set of one term only if depth is 1, which is the prefix filter.  Two texts that share a single term
    are not of interest.  Where a term's df is only known to lie in an interval, the part is taken as large as it can be.  s1, s2 is a
    signature of the vector.
    """
    terms, freq, rest = known
    sent = texts.sparkSession.sparkContext.broadcast((terms, freq))
    lo, hi, least = np.log(1 + n / rest), np.log(1 + n), t * t - SLACK

    def one(b: pa.RecordBatch, ranks: dict[bytes, int], idf: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch | None:
        row, term, count, new, more = _counted(b.column("body").to_pylist(), ranks)
        if not len(row):
            return None
        h = np.concatenate([hashes, more], axis=1)[:, term]
        bound = lambda x: (np.concatenate([idf, np.full(len(new), x)])[term] * count) ** 2
        begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        sizes = np.diff(np.r_[begins, len(row)])
        first = np.repeat(begins, sizes)
        small, large = bound(lo), bound(hi)
        total = np.repeat(np.add.reduceat(small, begins), sizes)
        small, large = small / total, large / total  # of the vector's squares; the latter may be too large
        so_far = lambda x: (c := np.cumsum(x)) - (c - x)[first]
        below, above = so_far(small), so_far(large)
        part = lambda inside, outside: inside / (inside + np.maximum(outside, 0))
        r = part(above, 1 - below)
        i = np.flatnonzero(r >= least)
        key, r, found = _mix(h[0][i]), r[i], []
        in_large, in_small = large[i], small[i]
        for length in range(1, depth):
            if length > 1:  # no further one is shared
                last = part(in_large, 1 - in_small)
                found.append((row[i[last >= least]], key[last >= least], last[last >= least]))
            k, d, longer = np.arange(len(i)), 1, []
            while len(k):
                k = k[i[k] - d >= first[i[k]]]
                j = i[k] - d
                r = part(in_large[k] + above[j], 1 - in_small[k] - below[j])
                k, j, r = k[r >= least], j[r >= least], r[r >= least]
                longer.append((j, _mix(key[k] + _mix(h[0][j])), r, in_large[k] + large[j], in_small[k] + small[j]))
                d += 1
            i, key, r, in_large, in_small = map(np.concatenate, zip(*longer, strict=True)) if longer else (x[:0] for x in (i, key, r, in_large, in_small))
        found.append((row[i], key, r))
        at, keys, parts = map(np.concatenate, zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        who, each = np.unique(at, return_counts=True)
        offsets = pa.array(np.r_[0, np.cumsum(each)], pa.int32())
        signed = [np.add.reduceat(_mix(x + _mix(count.astype(np.uint64))), begins)[np.searchsorted(row[begins], who)].view(np.int64) for x in h]
        lists = (pa.array(keys[order].view(np.int64)), pa.array((parts[order] + SLACK).astype(np.float32)))
        return pa.RecordBatch.from_pydict({"id": b.column("id").take(pa.array(who)), "s1": pa.array(signed[0]), "s2": pa.array(signed[1])} | {k: pa.ListArray.from_arrays(offsets, x) for k, x in zip(("keys", "parts"), lists, strict=True)})

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = sent.value
        ranks, idf, hashes = {w: i for i, w in enumerate(known)}, np.log(1 + n / df), _hashes(known)
        for b in batches:
            if (out := one(b, ranks, idf, hashes)) is not None:
                yield out

    return texts.mapInArrow(make, f"id {texts.schema['id'].dataType.simpleString()}, s1 long, s2 long, keys array<long>, parts array<float>")
