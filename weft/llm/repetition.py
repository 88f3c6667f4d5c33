"""Problem 8: repetition inside a single document, and lines repeated across documents.

Two measures over the same hashed units:

* *Within a document* (:func:`repeated_shares`): the units of a text - sequences of five words,
  lines, sentences, paragraphs - are hashed and counted; the share of repetition is
  1 - distinct / all.
* *Across documents* (:func:`line_frequency`): normalised lines are hashed, the distinct
  documents per host are counted, lines above a limit are removed and depleted documents rejected.

Line frequency alone can't find a document that repeats phrases inside its lines, nor measure
the share that problem 8 asks for; it is the second stage, the first gives the shares.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.words import Hasher, flat, shingles, words

_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*")


def _units(text: str) -> tuple[list[str], list[str], list[str]]:
    """Lines, sentences and paragraphs without blank ones, white space folded and case ignored."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").lower()
    fold = lambda xs: [y for x in xs if (y := " ".join(x.split()))]
    return fold(text.split("\n")), fold(_SENTENCE.split(text.replace("\n", " "))), fold(re.split(r"\n\s*\n", text))


def _share(units: list[str]) -> float:
    return 1 - len(set(units)) / len(units) if units else 0.0


def repeated_shares(docs: DataFrame, k: int = 5, blocks: bool = True) -> DataFrame:
    """``(doc_id, sequences, distinct, share)`` and, with ``blocks``, ``line_share, sentence_share, paragraph_share``.

    One row per row of ``docs(doc_id, text)``.  ``share`` is 1 - distinct / all over the k-word
    sequences; it is 0 where there are none (null, empty and short texts).
    """
    schema = "doc_id long, sequences long, distinct long, share double" + (", line_share double, sentence_share double, paragraph_share double" if blocks else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            h, off = flat([words(t) for t in texts], hasher)
            g, own = shingles(h, off, k)
            order = np.lexsort((g, own))
            g, own = g[order], own[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
            n = np.bincount(own, minlength=len(texts))
            u = np.bincount(own[new], minlength=len(texts))
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(u, pa.int64()), pa.array(1 - u / np.maximum(n, 1) * (n > 0) - (n == 0))]
            if blocks:
                cols += [pa.array(c, pa.float64()) for c in zip(*((_share(x) for x in _units(t)) for t in texts))] or [pa.array([], pa.float64())] * 3
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def normal_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, host, no, line, h)``: the non-blank lines of each document, white space folded, with a 64-bit hash of their lower case."""
    lines = docs.where("text IS NOT NULL").select("doc_id", "host", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("no", "line"))
    folded = F.trim(F.regexp_replace("line", r"(?U)\s+", " "))
    return lines.withColumn("line", folded).where("line <> ''").withColumn("h", F.xxhash64(F.lower("line")))


def line_frequency(docs: DataFrame, most_docs: int = 20, most_share: float = 0.01, least_left: float = 0.5) -> DataFrame:
    """``(doc_id, lines, removed, left_share, rejected)``: per document with a line, how much of it is boilerplate of its host.

    ``docs(doc_id, host, text)``.  A line is boilerplate if it occurs in more than ``most_docs`` documents of the
    host and in more than ``most_share`` of them; a document that keeps less than ``least_left`` of its characters
    is rejected.  Lines are counted by (host, hash) with distinct documents first, so a host with a third of
    all documents is spread over its lines, and a line on all of them is combined before the shuffle.
    """
    lines = normal_lines(docs)
    per_host = docs.where("text IS NOT NULL").groupBy("host").agg(F.count_distinct("doc_id").alias("host_docs"))
    counts = lines.select("host", "h", "doc_id").distinct().groupBy("host", "h").agg(F.count("*").alias("n"))
    common = counts.where(F.col("n") > most_docs).withColumnRenamed("host", "_host").join(per_host, F.col("_host").eqNullSafe(F.col("host"))).where(F.col("n") > most_share * F.col("host_docs")).select("_host", F.col("h").alias("_h"))
    marked = lines.join(common, F.col("host").eqNullSafe(F.col("_host")) & (F.col("h") == F.col("_h")), "left")
    n, bad = F.length("line"), F.col("_h").isNotNull()
    out = marked.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(bad).alias("removed"), (F.sum(F.when(bad, 0).otherwise(n)) / F.sum(n)).alias("left_share"))
    return out.withColumn("rejected", F.col("left_share") < least_left)


def line_hash(line: str) -> int:
    """For tests: Spark's ``xxhash64`` of a string (seed 42) as a signed number."""
    h = xxhash.xxh64_intdigest(line.encode(), 42)
    return h - (1 << 64) if h >> 63 else h
