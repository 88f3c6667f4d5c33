"""Problem 7: mixing sources to target weights, by blocks, multinomial draws and index permutations.

1. **Pack.**  A source's documents, in a pseudorandom but fixed order, form one stream of tokens;
   the stream is cut into blocks of ``BLOCK`` tokens.  A document's place in the stream is a running
   total over range-sorted chunks, so a source with a third of all rows is no single task.
2. **Draw.**  Each output shard of ``SLOTS`` slots draws how many slots each source gets from a
   multinomial with the planned shares, seeded by (seed, shard): the target weights, where what a source
   can't give within its cap goes to the others.  What the draws put beyond a source's slots goes,
   in a last shard, to those that got less: no slot is lost and the shares are the planned ones.
3. **Map.**  A source's j-th slot takes block ``perm_e(j mod n)`` of its n blocks, with epoch
   e = j div n and perm_e a keyed bijection on 0..n-1.  So each block is used in every epoch once,
   never more than ``max_repeats`` times, and no list of blocks is ever shuffled or collected.
4. **Join.**  Slots are counted by (source, block) and joined with the blocks each document covers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.tokens import FOLDER as TOKENIZERS
from weft.functions.tokens import encoding
from weft.operators.prefix import chunked, running_total
from weft.runtime import cut

#: Tokens of a block and slots of an output shard; large corpora take larger blocks.
BLOCK, SLOTS = 64, 4096
#: Without a total: how much of the mix, at most, may be off its target because sources are at their caps.
MOST_OFF = 0.05


def token_counts(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """``(doc_id, source, tokens)`` of ``docs(doc_id, source, text)``; null and empty texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(run, "doc_id long, source string, tokens long")


def permuted(i: np.ndarray, n: np.ndarray | int, key: np.ndarray) -> np.ndarray:
    """A keyed bijection on 0..n-1 at the points ``i``: a four-round Feistel network with cycle walking."""
    i, key = i.astype(np.uint64), key.astype(np.uint64)
    n = np.broadcast_to(np.asarray(n, np.uint64), i.shape)
    half = np.maximum((np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))) / 2 + 0.5).astype(np.uint64), 1)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = i.copy(), np.ones(i.shape, bool)
    while todo.any():
        x, h, m, k = out[todo], half[todo], low[todo], key[todo]
        a, b = x >> h, x & m
        for r in range(4):
            f = (b + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ (k + np.uint64(r)) * np.uint64(0xC2B2AE3D27D4EB4F)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & m)
        out[todo] = (a << h) | b
        todo = out >= n
    return out.astype(np.int64)


def plan(sources: pd.DataFrame, total: int | None = None, most_off: float = MOST_OFF) -> pd.DataFrame:
    """Adds ``cap``, ``weight`` and ``goal`` (in tokens) and ``planned_share`` to ``sources(source, target_share, max_repeats, tokens_available)``.

    ``weight`` is the target share over the sources that have tokens and may be used.  A source gives its weight of
    ``total``, or all that its cap allows; what it can't give goes to the others by their weights.  Without ``total``
    the mix is the largest in which the parts that sources at their caps can't give sum to ``most_off`` of it.
    """
    s = sources.copy()
    s["cap"] = (s.tokens_available * s.max_repeats.clip(lower=0)).astype(np.float64)
    live = (s.cap > 0) & (s.target_share > 0)
    s["weight"] = np.where(live, s.target_share, 0.0)
    s["weight"] = s.weight / s.weight.sum() if live.any() else 0.0
    cap, w = np.where(live, s.cap, 0.0), s.weight.to_numpy(np.float64)
    left = float(min(total, cap.sum())) if total is not None else 0.0
    if total is None and live.any():
        low, high = 0.0, cap.sum()
        for _ in range(100):  # what is missing rises with the size of the mix
            mid = (low + high) / 2
            low, high = (mid, high) if np.maximum(w - cap / mid, 0).sum() <= most_off else (low, mid)
        left = low
    got = np.zeros(len(s))
    for _ in range(len(s) + 1):
        able = (w > 0) & (cap - got > 1e-6)
        if left < 1e-6 or not able.any():
            break
        take = np.minimum(np.where(able, w / w[able].sum() * left, 0.0), cap - got)
        got += take
        left -= take.sum()
    s["goal"], s["planned_share"] = got, got / max(got.sum(), 1e-9)
    return s


def rounded(x: np.ndarray) -> np.ndarray:
    """Non-negative numbers rounded to whole ones of the same (rounded) sum, the largest remainders up."""
    out = np.floor(x + 1e-9).astype(np.int64)
    up = np.argsort(-(x - out), kind="stable")[: max(0, int(round(x.sum())) - int(out.sum()))]
    out[up] += 1
    return out


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, block: int = BLOCK, slots: int = SLOTS, folder: str = TOKENIZERS, most_off: float = MOST_OFF) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs(doc_id, source, text)`` to ``targets(source, target_share, max_repeats)``.

    Returns ``chosen(doc_id, source, tokens, repeats, tokens_used)`` and ``shares(source, target_share, weight,
    max_repeats, docs, tokens_available, planned_share, tokens_used, actual_share)``.  ``repeats`` is the largest number
    of times any token of the document occurs in the mix, at most max_repeats.  Sources are compared
    trimmed and in lower case; documents of other sources, null sources and texts without tokens are
    not chosen.  Rows repeated under one doc_id count as one document (the longest text).  A target
    without documents has share 0, and its weight goes to the others.  Targets are one row per
    source, of a fixed number: they are the only rows that reach the driver.
    """
    spark = docs.sparkSession
    key = F.lower(F.trim(F.regexp_replace(F.col("source"), r"(?U)^\s+|\s+$", "")))
    goal = targets.where("source IS NOT NULL").groupBy(key.alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).toPandas().sort_values("source", ignore_index=True)
    wanted = docs.where("doc_id IS NOT NULL").select("doc_id", key.alias("source"), "text").where(F.col("source").isin(goal.source.tolist()))
    counts = token_counts(wanted, folder).groupBy("doc_id", "source").agg(F.max("tokens").alias("tokens")).where("tokens > 0")
    placed = chunked(counts.withColumn("_at", F.xxhash64("doc_id", F.lit(seed))), ["source"], ["_at", "doc_id"], "mix-docs")
    placed = cut(running_total(placed, ["source"], ["_at", "doc_id"], F.col("tokens"), "start").drop("_at"), "mix-placed")
    have = placed.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens_available")).toPandas()
    s = goal.merge(have, on="source", how="left").fillna({"docs": 0, "tokens_available": 0})
    s = plan(s, total_tokens, most_off)
    available = s.tokens_available.to_numpy(np.int64)
    n_blocks = -(-available // block)  # the last block of a source may be shorter
    cap = n_blocks * s.max_repeats.clip(lower=0).to_numpy(np.int64)
    draws = s.goal.to_numpy(np.float64) * n_blocks / np.maximum(available, 1)
    due = np.minimum(rounded(draws), cap)
    n_slots = int(due.sum())
    rate = draws / draws.sum() if n_slots else draws
    n_shards = -(-n_slots // slots)
    names = s.source.tolist()

    def shard_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(int(i), c, int(x)) for i in b.column(0).to_pylist() for c, x in enumerate(np.random.default_rng([seed, i]).multinomial(min(slots, n_slots - i * slots), rate))]
            c = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64())], ["shard", "src", "n"])

    schema = "shard long, src int, n long"
    drawn = spark.range(n_shards).mapInArrow(shard_counts, schema) if n_slots else spark.createDataFrame([], schema)
    drawn = cut(drawn, "mix-drawn")
    sums = {r.src: r.n for r in drawn.groupBy("src").agg(F.sum("n").alias("n")).collect()}  # one row per target
    extra = spark.createDataFrame([(n_shards, i, int(x) - sums.get(i, 0)) for i, x in enumerate(due) if x > sums.get(i, 0)], schema)
    table = chunked(drawn.unionByName(extra), ["src"], ["shard"], "mix-shards")
    starts = running_total(table, ["src"], ["shard"], F.col("n"), "first").where("n > 0")

    def slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, n, first = (b.column(c).to_numpy(zero_copy_only=False) for c in ("src", "n", "first"))
            n = np.maximum(np.minimum(n, due[src] - first), 0)  # what the draw put beyond a source's slots is in the last shard, for others
            each = np.repeat(src, n)
            j = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            size = n_blocks[each]
            epoch = j // np.maximum(size, 1)
            idx = permuted(j % np.maximum(size, 1), np.maximum(size, 1), each.astype(np.uint64) * np.uint64(1_000_003) + epoch.astype(np.uint64) * np.uint64(7919) + np.uint64(seed))
            yield pa.RecordBatch.from_arrays([pa.array(each, pa.int32()), pa.array(idx, pa.int64())], ["src", "block"])

    used = starts.select("src", "n", "first").mapInArrow(slots_of, "src int, block long").groupBy("src", "block").agg(F.count("*").alias("times"))
    number = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]) if names else F.create_map(F.lit(""), F.lit(-1))
    last = (F.col("start") + F.col("tokens") - 1)
    covers = placed.withColumn("src", number[F.col("source")].cast("int")).select("*", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(last / block))).alias("block"))
    overlap = F.least(last, (F.col("block") + 1) * block - 1) - F.greatest("start", F.col("block") * block) + 1
    chosen = cut(covers.join(used, ["src", "block"]).groupBy("doc_id", "source", "tokens").agg(F.max("times").alias("repeats"), F.sum(overlap * F.col("times")).alias("tokens_used")), "mix-chosen")
    report = spark.createDataFrame(s[["source", "target_share", "weight", "max_repeats", "docs", "tokens_available", "planned_share"]].astype({"docs": "int64", "tokens_available": "int64", "max_repeats": "int64"}), "source string, target_share double, weight double, max_repeats long, docs long, tokens_available long, planned_share double")
    got = chosen.groupBy("source").agg(F.sum("tokens_used").alias("tokens_used"))
    whole = chosen.agg(F.sum("tokens_used").alias("_all"))
    shares = report.join(got, "source", "left").join(whole, how="left").select(*report.columns, F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), F.coalesce(F.col("tokens_used") / F.col("_all"), F.lit(0.0)).alias("actual_share"))
    return chosen, shares
