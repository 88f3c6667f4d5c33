"""Queries of ranked retrieval and rules, over all documents and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import budget, retrieve, rules
from weft.plans.base import nodes, query
from weft.plans.q_text import _CJK, _RUNS, _STOP
from weft.runtime import read_table


def _symbols(spark, d):
    """Every document is a file whose only symbol is its text."""
    return read_table(spark, d, "documents").where("text IS NOT NULL").select(F.format_string("doc/%06d", "doc_id").alias("path"), F.col("text").alias("name"), F.col("doc_id").alias("id"))


_TERMS = "list_filter(" + _RUNS.format("lower(regexp_replace(text, '([^\\p{Lu}])(\\p{Lu})', '\\1 \\2', 'g'))") + ", lambda x: x <> '')"
_WEIGHTS = f"""WITH t AS (SELECT printf('doc/%06d', doc_id) AS path, unnest({_TERMS}) AS term FROM documents WHERE text IS NOT NULL),
n AS (SELECT count(*)::DOUBLE AS n FROM documents WHERE text IS NOT NULL), c AS (SELECT path, term, count(*) AS cnt FROM t GROUP BY 1, 2), l AS (SELECT path, sum(cnt) AS total FROM c GROUP BY 1), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
w AS (SELECT c.path, c.term, cnt, cnt / total AS tf, cnt / total * ln(n / df) AS weight FROM c JOIN l USING (path) JOIN f USING (term), n)"""


@query(_WEIGHTS + " SELECT path, count(*) AS terms, round(sum(weight), 6) AS weight, round(max(tf), 6) AS top_tf FROM w GROUP BY 1")
def a07_term_weights(spark: SparkSession, d: str) -> DataFrame:
    w = retrieve.term_weights(_symbols(spark, d))
    return w.groupBy("path").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("weight"), F.round(F.max("tf"), 6).alias("top_tf"))


_Q = "cache snapshot cache lockfile"


@query(_WEIGHTS + ", q AS (SELECT 'cache' AS term, 2 / sqrt(6.0) AS qw UNION ALL SELECT 'snapshot', 1 / sqrt(6.0) UNION ALL SELECT 'lockfile', 1 / sqrt(6.0)), s AS (SELECT path, sum(coalesce(qw, 0) * cnt * weight) AS dot, sqrt(sum(cnt * weight * cnt * weight)) AS len FROM w LEFT JOIN q USING (term) GROUP BY 1) SELECT path, round(dot / len, 6) AS score FROM s WHERE dot > 0 AND len > 0 ORDER BY dot / len DESC, path LIMIT 20")
def r01_tfidf_search(spark: SparkSession, d: str) -> DataFrame:
    """A7, R1, T1."""
    return retrieve.tfidf_search(_symbols(spark, d), _Q).withColumn("score", F.round("score", 6))


@query("SELECT path, 0.3::DOUBLE AS score FROM (SELECT DISTINCT printf('doc/%06d', doc_id) AS path FROM documents WHERE contains(lower(text), 'napsho')) x ORDER BY path LIMIT 20")
def r02_substring_fallback(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.tfidf_search(_symbols(spark, d), "napsho")


_DOC = "list_transform(list_filter(" + _RUNS.format("text") + ", lambda x: strlen(x) >= 2), lambda x: lower(x))"


@query(f"""WITH d AS (SELECT printf('doc/%06d', doc_id) AS path, {_DOC} AS t FROM documents WHERE text IS NOT NULL), b AS (SELECT path, t, len(t) AS dl FROM d WHERE len(t) > 0), s AS (SELECT count(*) AS n, avg(dl) AS a FROM b),
q AS (SELECT unnest(['cache', 'snapshot', 'cache', 'lockfile']) AS q), f AS (SELECT path, dl, q, len(list_filter(t, lambda x: x = q)) AS f FROM b, (SELECT DISTINCT q FROM q) z), df AS (SELECT q, count(*) FILTER (WHERE f > 0) AS df FROM f GROUP BY 1),
r AS (SELECT path, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM q JOIN f USING (q) JOIN df USING (q), s GROUP BY 1)
SELECT path, round(score, 6) AS score FROM r WHERE score > 0 ORDER BY r.score DESC, path LIMIT 20""")
def a08_bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    """A8, T2, X31; the repeated query term counts twice."""
    out = retrieve.bm25_documents(_symbols(spark, d).select("path", F.col("name").alias("text")), _Q.split(), 20)
    return out.withColumn("score", F.round("score", 6))


_RECALL = f"(regexp_extract_all(lower(t), '[a-z0-9_]{{2,}}') || flatten([[x[i:i] FOR i IN range(1, length(x) + 1)] FOR x IN regexp_extract_all(lower(t), '[{_CJK}]+')]) || flatten([[x[i:i+1] FOR i IN range(1, length(x))] FOR x IN regexp_extract_all(lower(t), '[{_CJK}]+')]))"


@query(f"""WITH d AS (SELECT turn_no, min(coalesce(request, '')) AS t FROM turns GROUP BY 1), b AS (SELECT turn_no, {_RECALL} AS t, len({_RECALL}) AS dl FROM d), s AS (SELECT count(*) AS n, avg(dl) AS a FROM b),
q AS (SELECT unnest(['lockfile', 'cache', '節', '点', '節点']) AS q), f AS (SELECT turn_no, dl, q, len(list_filter(t, lambda x: x = q)) AS f FROM b, q), df AS (SELECT q, count(*) FILTER (WHERE f > 0) AS df FROM f GROUP BY 1),
r AS (SELECT turn_no, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a))) AS score FROM q JOIN f USING (q) JOIN df USING (q), s GROUP BY 1)
SELECT turn_no, round(score, 6) AS score FROM r WHERE score > 0""")
def a10_bm25_recall(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "turns").groupBy("turn_no").agg(F.min(F.coalesce("request", F.lit(""))).alias("text"))
    return retrieve.bm25_recall(t, "lockfile cache Cache 節点").where("score > 0").select("turn_no", F.round("score", 6).alias("score"))


@query("""WITH n AS (SELECT p_partkey AS id, p_brand AS path, lower(p_name) AS name FROM part), k AS (SELECT * FROM (VALUES ('blue', 0), ('rod', 1), ('large_gear', 2)) v(kw, ord)),
h AS (SELECT * FROM (SELECT kw, path, row_number() OVER (PARTITION BY kw ORDER BY id) AS r FROM k JOIN n ON name LIKE '%' || kw || '%') x WHERE r <= 50), w AS (SELECT kw, 1.0 / greatest(count(*), 1) AS w FROM h GROUP BY 1), z AS (SELECT path, count(*) AS symbols FROM n GROUP BY 1)
SELECT m.path, round(least(m.s / ((1 + ln(greatest(symbols, 1))) * 3), 1.0), 6) AS "like" FROM (SELECT path, sum(w) AS s FROM (SELECT DISTINCT path, kw FROM h) y JOIN w USING (kw) GROUP BY 1) m JOIN z USING (path)""")
def a13_r03_like_scores(spark: SparkSession, d: str) -> DataFrame:
    """A13, R3, F1, U3, W6; the capped hits per keyword are the specificity."""
    n = nodes(spark, d).withColumn("path", F.col("file_id"))
    sizes = n.groupBy("path").agg(F.count("*").alias("symbols"))
    task = "blue rod large_gear to"
    hits = retrieve.keyword_hits(n, task)
    return retrieve.like_scores(hits, sizes, len(retrieve.keywords(task))).withColumn("like", F.round("like", 6))


@query("SELECT event_id, round(CASE WHEN event_type IN ('click', 'view') THEN 0.4 * (value / 100) + 0.3 * (value / 200) + 0.3 * (value / (value + 2)) ELSE (0.4 * (value / 100) + 0.3 * (value / 200)) / 0.7 END, 9) AS score FROM events")
def r04_blended(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    t = read_table(spark, d, "events")
    return t.select("event_id", F.round(retrieve.blended(v / 100, v / 200, v, F.col("event_type").isin("click", "view")), 9).alias("score"))


# ---------------------------------------------------------------- rules


def _sections(spark, d):
    return read_table(spark, d, "sections").select(F.col("section_id").alias("id"), "file", "owner", "heading", "text")


_BODY = "coalesce(heading, '') || chr(10) || coalesce(text, '')"
_RT = f"(list_filter([trim(lower(x), '_') FOR x IN regexp_extract_all({_BODY}, '[A-Za-z0-9_]+')], lambda x: length(x) >= 2 AND x NOT IN ({_STOP})) || flatten([CASE WHEN length(x) = 1 THEN [x] ELSE [x[i:i+1] FOR i IN range(1, length(x))] END FOR x IN regexp_extract_all({_BODY}, '[{_CJK}]+')]))"
_TASK = ["cache", "lockfile", "節点"]


@query(f"""WITH s AS (SELECT section_id AS id, owner, sha256({_BODY}) AS hash, list_distinct({_RT}) AS t FROM sections), n AS (SELECT count(*) AS n FROM s), q AS (SELECT unnest({_TASK}) AS q),
d AS (SELECT q, count(*) AS df FROM q JOIN s ON list_contains(t, q) GROUP BY 1), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY id) AS k FROM s) x WHERE k = 1 AND owner IS DISTINCT FROM 'codex')
SELECT id, round(sum(ln(1 + n / df)), 6) AS score FROM f JOIN d ON list_contains(t, q), n GROUP BY 1""")
def a18_relevance(spark: SparkSession, d: str) -> DataFrame:
    return rules.relevant(_sections(spark, d), _TASK, "codex").select("id", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE s AS (SELECT section_id AS id, owner, sha256({_BODY}) AS hash, list_distinct({_RT}) AS t, length({_BODY}) // 4 AS tokens FROM sections), n AS (SELECT count(*) AS n FROM s), q AS (SELECT unnest({_TASK}) AS q),
d AS (SELECT q, count(*) AS df FROM q JOIN s ON list_contains(t, q) GROUP BY 1), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY id) AS k FROM s) x WHERE k = 1 AND owner IS DISTINCT FROM 'codex'),
r AS (SELECT id, tokens, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS k FROM (SELECT id, any_value(tokens) AS tokens, sum(ln(1 + n / df)) AS score FROM f JOIN d ON list_contains(t, q), n GROUP BY 1) z),
p(k, used, id, taken) AS (SELECT 0::BIGINT, 0::BIGINT, -1::BIGINT, false UNION ALL SELECT r.k, CASE WHEN p.used + r.tokens <= 1000 THEN p.used + r.tokens ELSE p.used END, r.id, p.used + r.tokens <= 1000 FROM p JOIN r ON r.k = p.k + 1)
SELECT id FROM p WHERE taken""")
def r09_w11_relevant_in_budget(spark: SparkSession, d: str) -> DataFrame:
    """Best sections first; what doesn't fit is skipped, smaller ones may follow."""
    s = _sections(spark, d)
    size = s.select("id", F.floor(F.length(F.concat(F.coalesce("heading", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))) / 4).alias("tokens"))
    ranked = rules.relevant(s, _TASK, "codex").withColumn("score", F.round("score", 9)).join(size, "id")
    return rules.within_budget(ranked, budget.RULE_BUDGET).select("id")


@query(f"""WITH s AS (SELECT section_id AS id, file, owner, coalesce(heading, '') AS heading, coalesce(text, '') AS text, sha256({_BODY}) AS hash, {_RT} AS t FROM sections), n AS (SELECT count(*)::DOUBLE AS n FROM s),
c AS (SELECT id, term, count(*) AS cnt FROM (SELECT id, unnest(t) AS term FROM s) x GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1), v AS (SELECT id, term, cnt * ln(1 + n / df) AS w FROM c JOIN f USING (term), n), l AS (SELECT id, sqrt(sum(w * w)) AS norm FROM v GROUP BY 1),
m AS (SELECT * FROM s WHERE length(trim(text, E' \\n\\r\\t')) >= 40), g AS (SELECT a.id AS id_a, b.id AS id_b, sum(a.w * b.w) AS dot, count(*) AS shared FROM v a JOIN v b ON a.term = b.term AND a.id <> b.id GROUP BY 1, 2),
r AS (SELECT id_a, id_b, dot / (x.norm * y.norm) AS similarity, p.file AS fa, p.heading AS ha, q.file AS fb, q.heading AS hb FROM g JOIN l x ON x.id = id_a JOIN l y ON y.id = id_b JOIN m p ON p.id = id_a JOIN m q ON q.id = id_b
  WHERE shared >= 2 AND p.owner IS DISTINCT FROM q.owner AND p.hash <> q.hash AND (p.file, p.heading) < (q.file, q.heading) AND dot / (x.norm * y.norm) >= 0.3 AND dot / (x.norm * y.norm) < 0.999)
SELECT id_a, id_b, round(similarity, 6) AS similarity FROM r ORDER BY round(r.similarity, 9) DESC, fa, ha, fb, hb, id_a, id_b LIMIT 100""")
def a09_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """A top-k over all sections."""
    return rules.conflicts(_sections(spark, d), 100).withColumn("similarity", F.round("similarity", 6))


@query("SELECT CASE WHEN a <= 400000 THEN 0 WHEN b <= 400000 THEN 1 ELSE 2 END AS level, NOT a <= 400000 AS adjusted, c > 400000 AS exceeded FROM (SELECT sum(t) AS a, sum(floor(t * 0.70::DOUBLE)) AS b, sum(floor(t * 0.25::DOUBLE)) AS c FROM (SELECT strlen(text) // 4 AS t FROM documents WHERE text IS NOT NULL) x) y")
def b01_choose_level(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "documents").where("text IS NOT NULL").select(F.floor(F.octet_length("text") / 4).alias("base"))
    return budget.choose_level(t, 400_000)


@query("SELECT sent, greatest(500000 - sent, 0) AS saved FROM (SELECT coalesce(sum(tokens), 0)::BIGINT AS sent FROM calls WHERE stale) x")
def b04_totals(spark: SparkSession, d: str) -> DataFrame:
    return budget.totals(read_table(spark, d, "calls").where("stale"), F.lit(500_000))


