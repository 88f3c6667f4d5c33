"""Rule sections ``sections(id, file, owner, heading, text)``: relevance to a task, and near-contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import vectors
from weft.runtime import cut, drop

#: What makes a pair of sections a candidate for a conflict.
MIN_CHARS, MIN_SIMILARITY, MIN_SHARED, SAME = 40, 0.3, 2, 0.999


#: Sections of a key that one task joins with all of its sections.
BLOCK = 2048
#: Thresholds that are tried, and the sections from which on: fewer hardly have enough pairs above it.
THRESHOLDS = (0.995, 50_000), (0.98, 5_000), (0.95, 50_000), (0.9, 1_000), (0.85, 50_000), (0.75, 1_000), (0.5, 0), (MIN_SIMILARITY, 0)
#: Terms of a key from a threshold on: the more, the fewer sections meet by chance, and the more keys a section has.
DEPTHS = (0.98, 4), (0.75, 2)
#: Places of a table, broadcast, that keeps most texts of no pair out of the shuffle.
PLACES = 1 << 18


def with_hash(sections: DataFrame) -> DataFrame:
    """Adds ``hash``: SHA-256 of heading, line end, text (nulls count as empty)."""
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    return sections.withColumn("hash", F.sha2(F.concat(e("heading"), F.lit("\n"), e("text")), 256))


def _body() -> Column:
    return F.concat(F.coalesce("heading", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))


def relevant(sections: DataFrame, task_terms: list[str], agent: str) -> DataFrame:
    """``(id, score)``: Σ idf of the distinct task terms a section holds; only > 0.

    Of sections with one hash the first (least id) counts, and it is taken *before* the agent's own are left out.
    The statistics cover the whole input; only the rows of task terms are shuffled for them.
    """
    terms = sorted(set(task_terms))
    body = F.concat(F.coalesce("heading", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    has = with_hash(sections).withColumn("_t", T.rule_terms(body))
    s = has.agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("_t", t)).alias(f"d{i}") for i, t in enumerate(terms)]).first()
    from math import log

    score = F.lit(0.0)
    for i, t in enumerate(terms):
        if s[f"d{i}"]:
            score = score + F.when(F.array_contains("_t", t), F.lit(log(1 + s["n"] / s[f"d{i}"]))).otherwise(0.0)
    first = has.groupBy("hash").agg(F.min_by(F.struct("id", "owner", score.alias("score")), "id").alias("m")).select("m.*")
    return first.where((F.col("score") > 0) & ~F.coalesce(F.col("owner") == agent, F.lit(False))).select("id", "score")


def within_budget(ranked: DataFrame, budget: int, order: list[Column] | None = None) -> DataFrame:
    """Greedy packing of ``ranked(id, score, tokens)`` by score, then id (or by ``order``, ascending): what is too large is skipped, smaller ones may still fit.

    Of items of one size only the best budget // size can ever be taken, so no more are kept per size (first within
    salted parts of a size, so a common size is no hot group): an exact bound of budget · (1 + ln budget) rows, which
    are then folded as one array.  Items of 0 tokens or fewer are free.
    """
    order = order or [(-F.col("score")).alias("s"), F.col("id")]
    few = ranked.where(f"tokens > 0 AND tokens <= {int(budget)}").withColumns({"_part": F.pmod(F.xxhash64("id"), F.lit(64)), "_at": F.struct(*order)})
    for by in (["tokens", "_part"], ["tokens"]):
        k = F.row_number().over(W.partitionBy(*by).orderBy("_at"))
        few = few.withColumn("_k", k).where(F.col("_k") * F.col("tokens") <= budget).drop("_k")
    items = few.agg(F.array_sort(F.collect_list(F.struct("_at", F.col("id").alias("id"), F.col("tokens").alias("tokens")))).alias("a"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))
    fits = lambda acc, x: acc["used"] + x["tokens"] <= budget
    step = lambda acc, x: F.struct(F.when(fits(acc, x), acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"), F.when(fits(acc, x), F.concat(acc["ids"], F.array(x["id"].cast("long")))).otherwise(acc["ids"]).alias("ids"))
    taken = items.select(F.explode(F.aggregate("a", start, step)["ids"]).alias("id"))
    return ranked.join(taken, "id", "left_semi").unionByName(ranked.where("tokens <= 0"))


def _meeting(texts: DataFrame, known: tuple, n: int, t: float) -> tuple[DataFrame, DataFrame]:
    """``members(id, vector)`` and pairs ``(vector_a, vector_b)`` of vectors that can have a cosine of t or more; a vector is named by its least id.

    Sections of one vector are compared with others once, and with each other never: they are SAME.
    """
    keyed = cut(vectors.keyed(texts, known, n, t, next((d for x, d in DEPTHS if t >= x), 1)), "keyed")
    members = keyed.join(keyed.groupBy("s1", "s2").agg(F.min("id").alias("vector")), ["s1", "s2"]).select("id", "vector", F.when(F.col("id") == F.col("vector"), F.arrays_zip("keys", "parts")).alias("at"))
    members = cut(members, "members")
    drop(keyed)
    p = members.select("vector", F.explode("at").alias("at")).select("vector", "at.*")
    hot = p.groupBy("keys").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    p = p.join(F.broadcast(hot), "keys", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    a = p.select("keys", F.pmod(F.xxhash64("vector"), F.col("blocks")).cast("int").alias("block"), F.col("vector").alias("vector_a"), F.col("parts").alias("part_a"))
    b = p.select("keys", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("vector").alias("vector_b"), F.col("parts").alias("part_b"))
    near = (F.col("vector_a") < F.col("vector_b")) & (F.col("part_a").cast("double") * F.col("part_b") >= t * t - 4 * vectors.SLACK)
    return members, cut(a.join(b, ["keys", "block"]).where(near).select("vector_a", "vector_b").distinct(), "meeting")


def _similar(bodies: DataFrame, pairs: DataFrame, df: DataFrame, n: int, t: float) -> DataFrame:
    """``(vector_a, vector_b, similarity)`` of those ``pairs`` whose t <= cosine < SAME, with shared terms enough; only their texts are shuffled."""
    ids = pairs.select(F.explode(F.array("vector_a", "vector_b")).alias("id")).distinct()
    place = lambda: F.pmod(F.xxhash64("id"), F.lit(PLACES)).alias("place")
    texts = bodies.withColumn("place", place()).join(F.broadcast(ids.select(place()).distinct()), "place", "left_semi").drop("place").join(ids, "id", "left_semi")
    cnt = texts.select("id", F.explode(T.rule_terms(F.col("body"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("cnt"))
    v = cut(cnt.join(df, "term").select("id", "term", (F.col("cnt") * F.log(1 + F.lit(float(n)) / F.col("df"))).alias("w")), "weights")
    norm = v.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    x = v.select(F.col("id").alias("vector_a"), "term", F.col("w").alias("wa"))
    y = v.select(F.col("id").alias("vector_b"), "term", F.col("w").alias("wb"))
    dots = pairs.join(x, "vector_a").join(y, ["vector_b", "term"]).groupBy("vector_a", "vector_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"), F.count("*").alias("shared"))
    dots = dots.where(F.col("shared") >= MIN_SHARED)
    for s in "ab":
        dots = dots.join(norm.select(F.col("id").alias(f"vector_{s}"), F.col("norm").alias(f"norm_{s}")), f"vector_{s}")
    cosine = F.col("dot") / (F.col("norm_a") * F.col("norm_b"))
    found = cut(dots.select("vector_a", "vector_b", cosine.alias("similarity")).where((F.col("similarity") >= t) & (F.col("similarity") < SAME)), "similar")
    drop(v)
    return found


def conflicts(sections: DataFrame, max_pairs: int = 20) -> DataFrame:
    """The ``max_pairs`` most similar pairs of sections of different owners and texts, ``(id_a, id_b, similarity)``.

    TF-IDF cosine in [0.3, 0.999) with at least two shared terms, texts of 40 characters or more, (file, heading) of a
    strictly below b's; null headings count as empty.  A top-k is exact as soon as a threshold t yields k pairs at or
    above it, so t goes down from 0.995 (few sections: from less); each pass is a join of keys (``operators/vectors.py``).  It is counted in pairs of vectors: of those
    that have a pair of sections, only the k best and their equals are multiplied out.
    """
    if not 1 <= max_pairs <= 100:
        raise ValueError("max_pairs must be between 1 and 100")
    sections = sections.withColumn("heading", F.coalesce("heading", F.lit("")))
    n = sections.count()
    df = cut(vectors.frequencies(sections.select("id", _body().cast("binary").alias("body"))), "frequencies")
    known = vectors.known_terms(df)
    whole = sections.where(F.length(T.trim(F.coalesce("text", F.lit("")))) >= MIN_CHARS)
    at = F.struct("file", "heading")
    for t in (x for x, least in THRESHOLDS if n >= least):
        members, pairs = _meeting(whole.select("id", _body().cast("binary").alias("body")), known, n, t)
        found = _similar(whole.select("id", _body().alias("body")), pairs, df, n, t)
        drop(pairs)
        of = members.select("id", "vector").join(found.select(F.explode(F.array("vector_a", "vector_b")).alias("vector")).distinct(), "vector")
        of = cut(of.join(whole.select("id", "owner", "file", "heading"), "id").where("file IS NOT NULL"), "sections")
        drop(members)
        ends = of.groupBy("vector", "owner").agg(F.min(at).alias("low"), F.max(at).alias("high"))
        for s in "ab":
            found = found.join(ends.select(F.col("vector").alias(f"vector_{s}"), F.col("owner").alias(f"owner_{s}"), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}")), f"vector_{s}")
        others = ~F.col("owner_a").eqNullSafe(F.col("owner_b"))
        found = cut(found.where(others & ((F.col("low_a") < F.col("high_b")) | (F.col("low_b") < F.col("high_a")))).select("vector_a", "vector_b", "similarity").distinct(), "pairs")
        best = found.select(F.round("similarity", 9).alias("s")).orderBy(F.desc("s")).limit(max_pairs).collect()
        if len(best) == max_pairs:
            found = found.where(F.round("similarity", 9) >= best[-1].s)
            break
    # what is not among the first max_pairs of its vector and owner is preceded by as many pairs with the same section b
    k = F.row_number().over(W.partitionBy("vector", "owner").orderBy("file", "heading", "id"))
    either = found.unionByName(found.select(F.col("vector_a").alias("vector_b"), F.col("vector_b").alias("vector_a"), "similarity"))
    a = of.withColumn("k", k).where(F.col("k") <= max_pairs).drop("k")
    a, b = (x.select(*[F.col(c).alias(f"{c}_{s}") for c in x.columns]) for x, s in ((a, "a"), (of, "b")))
    ahead = (F.col("file_a") < F.col("file_b")) | ((F.col("file_a") == F.col("file_b")) & (F.col("heading_a") < F.col("heading_b")))
    named = either.join(a, "vector_a").join(b, "vector_b").where(ahead & others)
    return named.orderBy(F.desc(F.round("similarity", 9)), "file_a", "heading_a", "file_b", "heading_b", "id_a", "id_b").limit(max_pairs).select("id_a", "id_b", "similarity")
