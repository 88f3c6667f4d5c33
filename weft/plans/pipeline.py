"""The flagship: a ranked context pack for a task within a token budget, as one DAG of bounded candidate sets."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from weft.functions import text as T
from weft.operators import budget as B
from weft.operators import graph, overview, retrieve, rules
from weft.plans.base import docs, query
from weft.runtime import cut, read_table
from weft.sources import extract

#: Languages whose texts BM25 scores; results taken from TF-IDF and BM25.
TEXTUAL = ("markdown", "docx", "pptx", "xlsx", "pdf", "jsonl")
TOP = 20


def symbols_of(files: DataFrame) -> DataFrame:
    """Symbols of ``files(file_id, path, language, text)`` by language: ``(file_id, id, name, kind, line)``.

    The id is the place, (file_id, line), so orders by id are orders of place.
    """
    lang = lambda *x: files.where(F.col("language").isin(*x))
    cols = ["file_id", "name", "kind", "line"]
    found = extract.markdown_headings(lang("markdown")).select(*cols)
    for part in (extract.json_keys(lang("json")), extract.jsonl_keys(lang("jsonl")), extract.tag_names(lang("html", "xml")), extract.code_symbols(files)):
        found = found.unionByName(part.select(*cols))
    return found.select("file_id", F.struct("file_id", "line").alias("id"), "name", "kind", "line")


def diff_boost(candidates: DataFrame, changed: DataFrame, indexed: DataFrame) -> DataFrame:
    """``(path, bucket, score, seq)``: candidates in the diff first, then other indexed changed files by path, then the rest.

    ``changed(path)`` files that aren't ``indexed(path)`` are dropped; a ``seq`` that is no number is null for files that are
    no candidates.  Order by (bucket, score descending, seq, path).
    """
    c = changed.select("path").distinct().withColumn("_c", F.lit(True))
    known = c.join(indexed.select("path").distinct(), "path", "left_semi")
    own = candidates.join(c, "path", "left").select("path", F.when(F.col("_c"), 0).otherwise(2).alias("bucket"), "score", "seq")
    kind = candidates.schema["seq"].dataType
    none = F.lit(0 if isinstance(kind, NumericType) else None).cast(kind)
    more = known.join(candidates.select("path"), "path", "left_anti").select("path", F.lit(1).alias("bucket"), F.lit(0.0).alias("score"), none.alias("seq"))
    return own.unionByName(more)


def place(stage: int, at: Column, file: Column | None = None, line: Column | None = None) -> Column:
    """Where a candidate was first seen: the stage, the place in it, the file and line."""
    return F.struct(F.lit(stage).alias("stage"), at.cast("double").alias("at"), (F.lit(None) if file is None else file).cast("long").alias("file"), (F.lit(None) if line is None else line).cast("int").alias("line"))


def candidates_for(files: DataFrame, symbols: DataFrame, task: str) -> DataFrame:
    """``(path, seq, score)``: at most 50 rows per keyword and 40 more, blended and deduplicated.

    A file is known by ``path`` here, which is unique in ``files(path, language, text)`` and ``symbols(path, id, name)``.
    """
    words = retrieve.keywords(task)
    hits = cut(retrieve.keyword_hits(symbols, task), "hits")
    sizes = symbols.join(hits.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.count("*").alias("symbols"))
    like = retrieve.like_scores(hits, sizes, len(words))
    tfidf = retrieve.tfidf_search(symbols, task, TOP)
    textual = files.where(F.col("language").isin(*TEXTUAL))
    bm25 = retrieve.bm25_documents(textual, words, TOP) if words else None
    seen = hits.select("path", place(0, F.col("ord"), F.col("id.file_id"), F.col("id.line")).alias("seq"), F.lit(None).cast("double").alias("tfidf"), F.lit(None).cast("double").alias("bm25"))
    seen = seen.unionByName(tfidf.select("path", place(1, -F.round("score", 9)).alias("seq"), F.col("score").alias("tfidf"), F.lit(None).cast("double").alias("bm25")))
    if bm25 is not None:
        seen = seen.unionByName(bm25.select("path", place(2, -F.round("score", 9)).alias("seq"), F.lit(None).cast("double").alias("tfidf"), F.col("score").alias("bm25")))
    each = seen.groupBy("path").agg(F.min("seq").alias("seq"), F.max("tfidf").alias("tfidf"), F.max("bm25").alias("bm25"))
    j = each.join(like, "path", "left").join(files.select("path", "language"), "path")
    eligible = F.col("language").isin(*TEXTUAL) & F.lit(bm25 is not None)
    return j.select("path", "seq", retrieve.blended(F.col("like"), F.col("tfidf"), F.col("bm25"), eligible).alias("score"))


class Packed(NamedTuple):
    """What a pipeline run works out: ``files`` (see :func:`run_pipeline`) with ``content``, the symbols and files it looked at, and how it was packed."""

    files: DataFrame
    indexed: DataFrame
    symbols: DataFrame
    level: int
    adjusted: bool
    by_rules: bool


EMPTY = "rank int, path string, score double, level int, tokens long, file_id long, content string"


def pack(files: DataFrame, task: str, max_tokens: int = B.DEFAULT_BUDGET, changed: DataFrame | None = None, level_rules: DataFrame | None = None, level: int | None = None) -> Packed:
    """R5 up to B4: candidates, their order, the level, and the files that fit (see :func:`run_pipeline`)."""
    if max_tokens < 1:
        raise ValueError("max_tokens must be positive")
    if level is not None and level not in B.FACTOR:
        raise ValueError("the level must be 0, 1 or 2")
    spark = files.sparkSession
    files = files.where("file_id IS NOT NULL AND path IS NOT NULL AND text IS NOT NULL").select("file_id", "path", "language", "text")
    # equal texts under one path are one file; only hashes are shuffled, and the copies, usually few, are left out by a join
    hashed = files.select("file_id", "path", "language", F.md5("text").alias("h"))
    copies = hashed.groupBy("path", "language", "h").agg(F.min("file_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    extra = cut(hashed.join(copies, ["path", "language", "h"]).where("file_id <> first").select("file_id").distinct(), "copies")
    # the operators know a file by one string: its id in order of numbers
    files = files.join(extra, "file_id", "left_anti").select("file_id", F.lpad(F.col("file_id").cast("string"), 20, "0").alias("path"), F.col("path").alias("real"), "language", "text")
    symbols = cut(symbols_of(files), "symbols").withColumn("path", F.lpad(F.col("file_id").cast("string"), 20, "0"))
    if not task.strip():
        return Packed(spark.createDataFrame([], EMPTY), files, symbols, 0, False, False)
    found = cut(candidates_for(files, symbols, task), "candidates")
    if changed is not None:
        changed = files.join(changed.select(F.col("path").alias("real")).distinct(), "real", "left_semi").select("path")
    boosted = diff_boost(found, changed, files) if changed is not None else found.withColumn("bucket", F.lit(2))
    count = symbols.join(boosted.select("path"), "path", "left_semi").groupBy("path").agg(F.count("*").alias("symbols"))
    base = B.base_tokens(F.octet_length("text"), F.coalesce("symbols", F.lit(0)))
    sized = cut(files.join(boosted, "path").join(count, "path", "left").select("file_id", "path", "real", "language", "text", "bucket", "score", "seq", base.alias("base")), "sized")
    chosen = B.choose_level(sized, max_tokens).first()
    lv = chosen.level if level is None else level
    order = [F.col("bucket"), (-F.round("score", 9)).alias("s"), F.col("seq"), F.col("path")]
    packed = rules.within_budget(sized.select(F.col("file_id").alias("id"), "bucket", "score", "seq", "path", B.estimate(F.col("base"), lv).alias("tokens")), max_tokens, order)
    full = sized.join(packed.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    # what fits a budget is no more than its tokens, and files without any
    full = full.withColumn("rank", F.row_number().over(W.orderBy(*order))).drop("path").withColumnRenamed("real", "path")
    own = F.lit(None).cast("int")
    if level_rules is not None:
        full, own = full.join(B.rule_level(full.select("path").distinct(), level_rules).withColumnRenamed("level", "_own"), "path"), F.col("_own")
    full = full.withColumn("level", F.coalesce(own, F.lit(int(lv)))).withColumn("content", T.compress(F.col("text"), F.col("language"), F.col("level")))
    out = full.select("rank", "path", "score", "level", F.ceil(F.length("content") / 4).alias("tokens"), "file_id", "content")
    return Packed(out, files, symbols, int(lv), bool(level is None and chosen.adjusted), level_rules is not None)


def run_pipeline(files: DataFrame, task: str, max_tokens: int = B.DEFAULT_BUDGET, changed: DataFrame | None = None, level_rules: DataFrame | None = None, level: int | None = None, include_content: bool = False) -> DataFrame:
    """``(rank, path, score, level, tokens, file_id)`` of the files that fit the budget, best first.

    A path may hold several files of different texts: each counts for itself (``file_id`` is unique), and equal texts under one
    path are one file, the one of the least id.  Files without a text have no symbols and never come out.  ``level`` overrides the chosen compression, ``level_rules``
    overrides it by path; ``include_content`` adds the compressed text as ``content``.  A blank task gives no rows.
    """
    out = pack(files, task, max_tokens, changed, level_rules, level).files
    return (out if include_content else out.drop("content")).orderBy("rank")


class Answer(NamedTuple):
    """E1 in full: the packed ``files``, the files one edge away, the rule sections, one row of figures, and the record of the call."""

    files: DataFrame
    related: DataFrame
    rules: DataFrame
    summary: DataFrame
    record: DataFrame


def answer(files: DataFrame, task: str, edges: DataFrame | None = None, nodes: DataFrame | None = None, sections: DataFrame | None = None, agent: str = "unknown", session_id: str | None = None, now_ms: int = 0, **options) -> Answer:
    """Everything one call of the pipeline answers and writes down.

    ``files`` is (rank, path, score, level, tokens, file_id, content).  ``related(file, total)`` are the ten files with most edges to the chosen
    ones, of ``edges(from_id, to_id)`` between ``nodes(id, file_id)``.  ``rules(id, file, heading, hash)`` are the sections of other agents that matter
    for the task, within the rule budget.  ``summary`` has the tokens sent and saved (what a counter adds up), savings, cost, level and flags,
    and the numbers of chosen files by extension.  ``record`` is the call as the history keeps it.
    """
    budget = options.get("max_tokens", B.DEFAULT_BUDGET)
    p = pack(files, task, **options)
    spark, chosen = files.sparkSession, cut(p.files, "chosen")
    text = "file string, total long"
    related = graph.related_files(edges, nodes, chosen.select(F.col("file_id").alias("file")), 10) if edges is not None and nodes is not None else spark.createDataFrame([], text)
    if sections is not None:
        size = sections.select("id", F.floor(F.length(F.concat(F.coalesce("heading", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))) / 4).alias("tokens"))
        terms = [r.t for r in spark.range(1).select(F.explode(T.rule_terms(F.lit(task))).alias("t")).collect()]
        ranked = rules.relevant(sections, terms, agent).withColumn("score", F.round("score", 9)).join(size, "id")
        best = rules.within_budget(ranked, B.RULE_BUDGET).select("id")
        used = cut(rules.with_hash(sections.join(best, "id", "left_semi")).select("id", "file", "heading", "hash"), "rules")
    else:
        used = spark.createDataFrame([], "id long, file string, heading string, hash string")
    whole = p.indexed.agg(F.floor(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) / 4).cast("long").alias("workspace"), F.count_if(F.col("language").isin(*TEXTUAL)).alias("indexed_docs"))
    sums = chosen.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("sent"), F.count("*").alias("n_files"))
    s = sums.join(whole).withColumn("saved", F.greatest(F.col("workspace") - F.col("sent"), F.lit(0)))
    types = {r.ext: r.n for r in overview.file_types(chosen).collect()}  # as many as there are extensions among the chosen files
    kinds = F.create_map(*[x for k, v in sorted(types.items()) for x in (F.lit(k), F.lit(v))]) if types else F.create_map().cast("map<string,bigint>")
    summary = s.select(
        F.lit(task).alias("task"), "n_files", "sent", "saved", "workspace", B.savings(F.col("workspace"), F.col("sent")).alias("savings"), B.cost(F.col("sent"), "sonnet").alias("cost"),
        F.lit(p.level).alias("level"), F.lit(p.adjusted).alias("adjusted"), (F.lit(p.by_rules) & (F.col("sent") > budget)).alias("exceeded_by_rules"), "indexed_docs", kinds.alias("file_types"),
    )
    names = p.symbols.join(chosen.select("file_id"), "file_id", "left_semi").agg(F.array_sort(F.collect_set("name")).alias("symbols"))
    record = sums.join(names).join(chosen.agg(F.array_sort(F.collect_set("path")).alias("files"))).join(used.agg(F.collect_list(F.struct("file", "heading", "hash")).alias("rules")))
    record = record.select(F.lit(task).alias("query"), "symbols", "files", F.col("sent").alias("tokens"), F.lit(agent).alias("agent"), F.lit(session_id).cast("string").alias("session_id"), F.lit(now_ms).cast("long").alias("timestamp"), "rules")
    return Answer(chosen, related, used, summary, record)


TASK = "Open conflicts: how does the cache digest rank a lockfile snapshot under load?"
_DECL = r"^\s*(?:export\s+|pub(?:\([a-z]+\))?\s+|default\s+|abstract\s+|async\s+)*(?:fn|struct|enum|impl|trait|class|interface|type|function|def|func)\b"
_KEPT = r"^\s*(?:#|[-*+>] |\p{N})|^\s*(?:---|\*\*\*|___)\s*$"
_SHUT = r"regexp_replace(regexp_replace({}, '(?m)^[ \t\r]*\n(?:[ \t\r]*\n)*', chr(10), 'g'), '\s+\z', '')"
_QUERY = ", ".join(f"'{w.lower()}'" for w in retrieve.keywords(TASK))
_TERMS = ", ".join(f"'{w}'" for w in retrieve.tokens(TASK))
#: The pipeline step by step: files, symbols, the three searches, the blend, the level, the packing, the texts at that level.
CHOSEN_SQL = rf"""WITH RECURSIVE f AS (SELECT min(doc_id) AS id, path, code, text FROM (SELECT *, doc_type = 'code' AS code FROM documents) x WHERE text IS NOT NULL AND path IS NOT NULL GROUP BY path, code, text),
l AS (SELECT id, code, unnest(t) AS x, generate_subscripts(t, 1) AS line FROM (SELECT id, code, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n\z', ''), chr(10)) AS t FROM f) y),
sym AS (SELECT id, line, trim(regexp_replace(x, '^\s*#{{1,6}}', ''), E' \t\r') AS name FROM l WHERE NOT code AND regexp_matches(x, '^\s*#{{1,6}}[^#].*$') AND trim(regexp_replace(x, '^\s*#{{1,6}}', ''), E' \t\r') <> ''
  UNION ALL SELECT id, line, regexp_extract(x, '^\s*(?:pub(?:\([a-z]+\))? )?(?:async )?(?:fn|struct|enum|trait|impl(?:<[^>]*>)?)\s+(?:[\w:<>]+ for )?(\w+)', 1) FROM l
    WHERE code AND regexp_matches(x, '^\s*(?:pub(?:\([a-z]+\))? )?(?:async )?fn\s+(\w+)|^\s*(?:pub )?(?:struct|enum|trait)\s+\w+|^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+ for )?\w+')),
per AS (SELECT id, count(*) AS symbols FROM sym GROUP BY 1),
kw AS (SELECT unnest([{_QUERY}]) AS kw, generate_subscripts([{_QUERY}], 1) - 1 AS ord),
hit AS (SELECT * FROM (SELECT kw, ord, id, line, row_number() OVER (PARTITION BY ord ORDER BY id, line) AS k FROM kw JOIN sym ON lower(name) LIKE '%' || kw || '%') x WHERE k <= 50),
lk AS (SELECT id, least(sum(w) / ((1 + ln(greatest(any_value(symbols), 1))) * (SELECT count(*) FROM kw)), 1.0) AS lk FROM (SELECT DISTINCT id, kw FROM hit) h JOIN (SELECT kw, 1.0 / count(*) AS w FROM hit GROUP BY 1) w USING (kw) JOIN per USING (id) GROUP BY 1),
term AS (SELECT id, term, count(*) AS cnt FROM (SELECT id, unnest(list_filter(string_split_regex(lower(regexp_replace(name, '([^\p{{Lu}}])(\p{{Lu}})', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')) AS term FROM sym) x GROUP BY 1, 2),
part AS (SELECT id, term, cnt * (cnt / sum(cnt) OVER (PARTITION BY id)) * ln((SELECT count(*) FROM per)::DOUBLE / count(*) OVER (PARTITION BY term)) AS p FROM term),
tf AS (SELECT id, score, -round(score, 9) AS spot FROM (SELECT id, sum(CASE WHEN term IN ({_TERMS}) THEN p ELSE 0 END) / sqrt(len([{_TERMS}])) / sqrt(sum(p * p)) AS score FROM part GROUP BY 1 HAVING sum(p * p) > 0) x WHERE score > 0 ORDER BY round(score, 9) DESC, id LIMIT 20),
doc AS (SELECT id, list_transform(list_filter(string_split_regex(text, '[^\p{{L}}\p{{N}}]+'), lambda t: strlen(t) >= 2), lambda t: lower(t)) AS t FROM f WHERE NOT code),
cnt AS (SELECT id, len(t) AS dl, kw, len(list_filter(t, lambda x: x = kw)) AS c FROM doc, kw WHERE len(t) > 0),
st AS (SELECT count(DISTINCT id) AS n, sum(dl) / count(*) AS a FROM cnt), df AS (SELECT kw, count(*) FILTER (WHERE c > 0) AS d FROM cnt GROUP BY 1),
bm AS (SELECT id, score, -round(score, 9) AS spot FROM (SELECT id, sum(ln((n - d + 0.5) / (d + 0.5) + 1) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM cnt JOIN df USING (kw), st GROUP BY 1) x WHERE score > 0 ORDER BY round(score, 9) DESC, id LIMIT 20),
seen AS (SELECT id, min((stage, spot, file, line)) AS seq FROM (SELECT id, 0 AS stage, ord::DOUBLE AS spot, id AS file, line FROM hit UNION ALL SELECT id, 1, spot, 0, 0 FROM tf UNION ALL SELECT id, 2, spot, 0, 0 FROM bm) x GROUP BY 1),
cand AS (SELECT id, seq, code, path, text, CASE WHEN code THEN (0.4 * coalesce(lk, 0) + 0.3 * coalesce(tf.score, 0)) / 0.7 ELSE 0.4 * coalesce(lk, 0) + 0.3 * coalesce(tf.score, 0) + 0.3 * coalesce(bm.score, 0) / (coalesce(bm.score, 0) + 2) END AS score,
  CASE WHEN strlen(text) // 4 > 0 THEN strlen(text) // 4 ELSE coalesce(symbols, 0) * 50 END AS base FROM seen JOIN f USING (id) LEFT JOIN lk USING (id) LEFT JOIN tf USING (id) LEFT JOIN bm USING (id) LEFT JOIN per USING (id)),
lv AS (SELECT CASE WHEN sum(base) <= 8000 THEN 0 WHEN sum(floor(base * 0.70::DOUBLE)) <= 8000 THEN 1 ELSE 2 END AS lv FROM cand),
rk AS (SELECT *, (CASE lv WHEN 0 THEN base WHEN 1 THEN floor(base * 0.70::DOUBLE) ELSE floor(base * 0.25::DOUBLE) END)::BIGINT AS est, row_number() OVER (ORDER BY round(score, 9) DESC, seq, id) AS rank FROM cand, lv),
pk(rank, used, taken) AS (SELECT 0::BIGINT, 0::BIGINT, false UNION ALL SELECT rk.rank, CASE WHEN used + est <= 8000 THEN used + est ELSE used END, used + est <= 8000 FROM pk JOIN rk ON rk.rank = pk.rank + 1),
mk AS (SELECT id, line, x, starts_with(trim(x), '```') AS mark, sum(starts_with(trim(x), '```')::INT) OVER (PARTITION BY id ORDER BY line) AS n FROM l WHERE NOT code),
md AS (SELECT id, {_SHUT.format("coalesce(string_agg(CASE WHEN mark OR n % 2 = 1 OR regexp_matches(x, '" + _KEPT + "') THEN x END, chr(10) ORDER BY line), '')")} AS t FROM mk GROUP BY 1),
sk AS (SELECT id, coalesce(string_agg(CASE WHEN regexp_matches(x, '{_DECL}') THEN regexp_replace(x, '\s*[{{:]?\s*$', '') || ' {{ ... }}' END, chr(10) ORDER BY line), '') AS t FROM l WHERE code GROUP BY 1),
cr AS (SELECT id, {_SHUT.format("replace(text, chr(13) || chr(10), chr(10))")} AS plain, {_SHUT.format("regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(?s:/\\*.*?\\*/)|(?m://[^\\n]*$)', '', 'g')")} AS bare FROM f),
chosen AS (SELECT (row_number() OVER (ORDER BY rk.rank))::INT AS rank, path, round(score, 6) AS score, lv AS level, ceil(length(CASE lv WHEN 0 THEN text WHEN 1 THEN CASE WHEN code THEN bare ELSE plain END ELSE CASE WHEN code THEN sk.t ELSE md.t END END) / 4)::BIGINT AS tokens, id AS file_id
  FROM pk JOIN rk ON rk.rank = pk.rank AND taken LEFT JOIN md USING (id) LEFT JOIN sk USING (id) JOIN cr USING (id))
"""


@query(CHOSEN_SQL + "SELECT * FROM chosen")
def flagship_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """R5, T3, E1 over all documents, those of different texts under one path included."""
    return run_pipeline(docs(spark, d), TASK).withColumn("score", F.round("score", 6))


@query(CHOSEN_SQL + """, t AS (SELECT sum(tokens)::BIGINT AS sent, count(*) AS n_files, any_value(level) AS level FROM chosen), w AS (SELECT (sum(strlen(text)) // 4)::BIGINT AS workspace, count(*) FILTER (WHERE NOT code) AS indexed_docs FROM f)
SELECT n_files, sent, greatest(workspace - sent, 0) AS saved, workspace, round_even(((workspace - sent)::DOUBLE * 100 / workspace)::FLOAT::DOUBLE, 0)::BIGINT || '%' AS savings, printf('$%d.%02d', round(sent * 3 / 10000)::BIGINT // 100, round(sent * 3 / 10000)::BIGINT % 100) AS cost,
  level, level > 0 AS adjusted, false AS exceeded_by_rules, indexed_docs, (SELECT string_agg(ext || '=' || n, ' ' ORDER BY ext) FROM (SELECT CASE WHEN e = '' THEN 'unknown' ELSE e END AS ext, count(*) AS n FROM (SELECT regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1) AS e FROM chosen) x GROUP BY 1) y) AS file_types FROM t, w""")
def e01_summary(spark: SparkSession, d: str) -> DataFrame:
    """The figures of one call of the pipeline over all documents."""
    s = answer(docs(spark, d), TASK).summary
    kinds = F.array_join(F.array_sort(F.transform(F.map_entries("file_types"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), " ")
    return s.drop("task").withColumn("file_types", kinds)


@query("""WITH d AS (SELECT doc_id, path FROM (SELECT doc_id, path, row_number() OVER (PARTITION BY path ORDER BY doc_id) AS k FROM documents) x WHERE k = 1), c AS (SELECT path, (doc_id % 101)::DOUBLE AS score, doc_id AS seq FROM d WHERE doc_id % 3 = 0), g AS (SELECT path FROM d WHERE doc_id % 17 = 0), i AS (SELECT path FROM d WHERE doc_id % 2 = 0)
SELECT path, CASE WHEN path IN (SELECT path FROM g) THEN 0 ELSE 2 END AS bucket, score, seq FROM c UNION ALL SELECT path, 1, 0.0, 0 FROM g WHERE path IN (SELECT path FROM i) AND path NOT IN (SELECT path FROM c)""")
def j16_diff_boost(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "documents").groupBy("path").agg(F.min("doc_id").alias("doc_id"))
    c = t.where("doc_id % 3 = 0").select("path", (F.col("doc_id") % 101).cast("double").alias("score"), F.col("doc_id").alias("seq"))
    return diff_boost(c, t.where("doc_id % 17 = 0"), t.where("doc_id % 2 = 0"))
