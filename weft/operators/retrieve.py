"""Ranked retrieval over texts and symbols."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.runtime import cut

#: The parameters of the two BM25 variants, the blend, and the cap on hits per keyword.
DOC_K1, RECALL_K1, B = 1.5, 1.2, 0.75
LIKE_CAP, LIKE_CAP_WHOLE, FALLBACK_SCORE = 50, 10, 0.3


def keywords(task: str) -> list[str]:
    """Runs of letters, digits and underscores of at least three bytes; all of them, in order."""
    return [w for w in re.split(r"[^\w]+", task) if len(w.encode()) >= 3]


def term_weights(symbols: DataFrame) -> DataFrame:
    """``(path, term, cnt, tf, weight)`` of ``symbols(path, name)``: weight = tf · ln(N / df), N = files with a symbol.

    A term of every file weighs 0; nothing is smoothed.
    """
    terms = symbols.select("path", F.explode(T.identifier_terms(F.col("name"))).alias("term"))
    cnt = terms.groupBy("path", "term").agg(F.count("*").alias("cnt"))
    total = cnt.groupBy("path").agg(F.sum("cnt").alias("total"))
    df = cnt.groupBy("term").agg(F.count("*").alias("df"))
    n = symbols.select("path").distinct().count()
    tf = F.col("cnt") / F.col("total")
    return cnt.join(total, "path").join(df, "term").select("path", "term", "cnt", tf.alias("tf"), (tf * F.log(F.lit(float(max(n, 1))) / F.col("df"))).alias("weight"))


def tfidf_search(symbols: DataFrame, query: str, n: int = 20) -> DataFrame:
    """``(path, score)`` by cosine, best first, paths break ties.

    The query is its raw term counts, of length 1; a document's component is cnt · weight.  Where nothing
    scores, files with a symbol that contains a query term get 0.3.
    """
    w = term_weights(symbols)
    q: dict[str, int] = {}
    for t in tokens(query):
        q[t] = q.get(t, 0) + 1
    norm = sum(c * c for c in q.values()) ** 0.5
    part = F.col("cnt") * F.col("weight")
    weight = F.lit(0.0)
    for t, c in q.items():
        weight = F.when(F.col("term") == t, F.lit(c / norm)).otherwise(weight)
    sim = w.groupBy("path").agg(F.sum(weight * part).alias("dot"), F.sqrt(F.sum(part * part)).alias("len"))
    scored = sim.where("dot > 0 AND len > 0").select("path", (F.col("dot") / F.col("len")).alias("score"))
    top = cut(scored.orderBy(F.desc(F.round("score", 9)), "path").limit(n), "tfidf")
    if not q or not top.isEmpty():
        return top
    low = F.lower("name")
    some = F.lit(False)
    for t in q:
        some = some | low.contains(t)
    return symbols.where(some).select("path").distinct().select("path", F.lit(FALLBACK_SCORE).alias("score")).orderBy("path").limit(n)


def tokens(query: str) -> list[str]:
    """X1 for a query given as a Python string."""
    humps = "".join(" " + c if c.isupper() and i and not query[i - 1].isupper() else c for i, c in enumerate(query))
    return [t for t in re.split(r"[^\w]+|_", humps.lower()) if t]


def _bm25(docs: DataFrame, terms: Column, query: list[str], k1: float, idf_of, least_terms: int) -> DataFrame:
    """``docs`` without ``text``, with ``score``.

    Term frequencies are counted inside each row, so no term table is shuffled; the counts (as many numbers per row as
    query terms) are kept in a table, from which statistics and scores are taken.
    """
    uniq = list(dict.fromkeys(query))
    rows = docs.withColumn("_t", terms).withColumn("_dl", F.size("_t"))
    count = lambda t: F.size(F.filter("_t", lambda x: x == t))
    tf = {t: count(t) for t in uniq}
    kept = [c for c in docs.columns if c != "text"]
    counted = rows.select(*kept, "_dl", *[tf[t].alias(f"_f{i}") for i, t in enumerate(uniq)])
    base = cut(counted.where(F.col("_dl") >= least_terms), "counted")
    s = base.agg(F.count("*").alias("n"), F.avg("_dl").alias("avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"d{i}") for i in range(len(uniq))]).first()
    n, avg = s["n"], s["avg"] or 1.0
    score = F.lit(0.0)
    for t in query:
        i = uniq.index(t)
        f = F.col(f"_f{i}").cast("double")
        score = score + F.lit(idf_of(n, s[f"d{i}"])) * f * (k1 + 1) / (f + k1 * (1 - B + B * F.col("_dl") / F.lit(float(avg))))
    return base.withColumn("score", score).drop("_dl", *[f"_f{i}" for i in range(len(uniq))])


def bm25_documents(docs: DataFrame, query: list[str], top_k: int | None = None) -> DataFrame:
    """``(path, score)`` of ``docs(path, text)``; documents without a term are no documents, repeated query terms count again.

    Query terms are lower-cased but not split, so one with ``_`` never matches.  Score 0 is dropped.
    """
    from math import log

    q = [t.lower() for t in query]
    out = _bm25(docs.select("path", "text").where("text IS NOT NULL"), T.document_terms(F.col("text")), q, DOC_K1, lambda n, d: log((n - d + 0.5) / (d + 0.5) + 1), 1)
    out = out.where("score > 0").select("path", "score")
    return out.orderBy(F.desc(F.round("score", 9)), "path").limit(top_k) if top_k else out


def bm25_recall(docs: DataFrame, query: str) -> DataFrame:
    """A10: ``docs`` (with a column ``text``) and ``score``; distinct query terms, N counts empty documents too."""
    from math import log

    low = query.lower()
    q = re.findall(r"[a-z0-9_]{2,}", low)
    for run in re.findall(r"[぀-ゟ゠-ヿ一-鿿]+", low):
        q += list(run) + [run[i : i + 2] for i in range(len(run) - 1)]
    return _bm25(docs.withColumn("text", F.coalesce("text", F.lit(""))), T.recall_terms(F.col("text")), list(dict.fromkeys(q)), RECALL_K1, lambda n, d: log(1 + (n - d + 0.5) / (d + 0.5)), 0)


def like_hits(symbols: DataFrame, query: str, limit: int) -> DataFrame:
    """the first ``limit`` symbols (by id) whose name contains ``query``; ``%`` and ``_`` are wildcards."""
    return symbols.where(T.like_anywhere(F.col("name"), query)).orderBy("id").limit(limit)


def context(symbols: DataFrame, query: str, limit: int = 10, kind: str | None = None) -> DataFrame:
    """Hits with score 1.0; with a kind, ``2 · limit`` hits are taken *before* the filter."""
    hits = like_hits(symbols, query, 2 * limit if kind else limit)
    if kind:
        hits = hits.where(F.col("kind") == kind).orderBy("id").limit(limit)
    return hits.withColumn("score", F.lit(1.0))


def keyword_hits(symbols: DataFrame, task: str) -> DataFrame:
    """``symbols`` with ``(ord, keyword)``: up to 50 per keyword, the first by id.  A task without keywords is one keyword (10 rows).

    One scan finds the hits of all keywords, and each task keeps its own first rows before the shuffle, so a keyword that every
    symbol holds moves no more than the others.
    """
    kws = keywords(task)
    plan = [(k, LIKE_CAP) for k in kws] if kws else [(task, LIKE_CAP_WHOLE)]
    found = F.array_compact(F.array(*[F.when(T.like_anywhere(F.col("name"), k), F.struct(F.lit(i).alias("ord"), F.lit(k.lower()).alias("keyword"))) for i, (k, _) in enumerate(plan)]))
    each = symbols.select("*", F.inline(found))
    first = F.row_number().over(W.partitionBy("ord").orderBy("id"))
    return each.withColumn("_k", first).where(F.col("_k") <= plan[0][1]).drop("_k")


def like_scores(hits: DataFrame, sizes: DataFrame, n_keywords: int) -> DataFrame:
    """``(path, like)``: Σ 1 / hits over the file's matched keywords, over (1 + ln(symbols)) · keywords, at most 1.

    ``hits`` is of :func:`keyword_hits` (bounded), ``sizes`` has (path, symbols).
    """
    weight = hits.groupBy("keyword").agg((F.lit(1.0) / F.greatest(F.count("*") / F.count_distinct("ord"), F.lit(1))).alias("w"))
    matched = hits.select("path", "keyword").distinct().join(weight, "keyword").groupBy("path").agg(F.sum("w").alias("s"))
    per = (1 + F.log(F.greatest(F.coalesce("symbols", F.lit(0)), F.lit(1)).cast("double"))) * max(n_keywords, 1)
    return matched.join(sizes, "path", "left").select("path", F.least(F.col("s") / per, F.lit(1.0)).alias("like"))


def blended(like: Column, tfidf: Column, bm25: Column, textual: Column) -> Column:
    """.4 like + .3 tfidf + .3 saturated BM25 for textual files, else (.4 like + .3 tfidf) / .7."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return F.when(textual, 0.4 * z(like) + 0.3 * z(tfidf) + 0.3 * T.saturated(z(bm25))).otherwise((0.4 * z(like) + 0.3 * z(tfidf)) / 0.7)
