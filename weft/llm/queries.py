"""Queries of this package on the test tables, and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import conversations, leak, mixing, near, personal, repetition, truncation
from weft.runtime import read_table

# ---------------------------------------------------------------- problem 1


def _sections(spark: SparkSession, d: str) -> DataFrame:
    heading = F.coalesce("heading", F.lit(""))
    return read_table(spark, d, "sections").select(F.col("section_id").alias("id"), F.concat(heading, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of sections that share at least half of their three-word sequences."""
    members, links = near.near_duplicates(_sections(spark, d), k=3, least=0.5, least_words=12)
    return near.expanded(members, links).select(F.col("a").alias("a_id"), F.col("b").alias("b_id")).distinct()


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every section that has words enough: its class of copies, its group, and the links of its class."""
    members, links = near.near_duplicates(_sections(spark, d), k=3, least=0.5, least_words=12)
    links, members = near.cut(links, "links"), near.cut(members, "members")
    groups = near.components(members.select(F.col("cls_id").alias("id")).distinct(), links)
    n = links.select(F.col("a").alias("cls_id")).unionByName(links.select(F.col("b").alias("cls_id"))).groupBy("cls_id").agg(F.count("*").alias("n_links"))
    out = members.join(groups.withColumnRenamed("id", "cls_id"), "cls_id").join(n, "cls_id", "left")
    return out.select(F.col("id").alias("section_id"), F.col("cls_id").alias("class_id"), "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


# ---------------------------------------------------------------- problem 2


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The messages of the intact recorded sessions, in order."""
    return conversations.session_conversations(read_table(spark, d, "calls"), read_table(spark, d, "sessions"))


def p2_unassigned(spark: SparkSession, d: str) -> DataFrame:
    """Intact conversations among rows without a session id: channels are agents, split at calibrated pauses."""
    calls = read_table(spark, d, "calls")
    named = conversations.channel_of(F.col("session_id"))
    known = conversations.chunked(conversations.records(calls, named), ["channel"], ["ts", "id"], "known")
    gap = conversations.calibrated_gap(known)
    lost = calls.where(named.isNull() | (named == ""))
    found = conversations.conversations(conversations.records(lost, F.coalesce("agent", F.lit("unknown"))), gap)
    return found.select(F.col("channel").alias("agent"), "part", "msg_no", "role", F.col("id").alias("call_id"))


# ---------------------------------------------------------------- problem 3


def _turn_values(spark: SparkSession, d: str) -> DataFrame:
    both = F.inline(F.array(F.struct(F.lit("request").alias("field"), F.col("request").alias("text")), F.struct(F.lit("outcome").alias("field"), F.col("outcome").alias("text"))))
    return read_table(spark, d, "turns").select(F.col("turn_no").alias("id"), "source", both)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Values of turns whose end was lost."""
    found = truncation.cut_values(_turn_values(spark, d)).where("cut")
    return found.select(F.col("id").alias("turn_no"), "field").distinct()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per source and field: values, cut values and their share."""
    once = truncation.cut_values(_turn_values(spark, d)).groupBy("source", "field", "id").agg(F.max("cut").alias("cut"))
    return once.groupBy("source", "field").agg(F.count("*").alias("n_values"), F.count_if("cut").alias("n_cut"), F.avg(F.col("cut").cast("int")).alias("share_cut"))


# ---------------------------------------------------------------- problem 4


def _free_texts(spark: SparkSession, d: str) -> DataFrame:
    """All request, outcome and query texts."""
    turns = _turn_values(spark, d).select(F.lit("turns").alias("tbl"), "id", "field", "text")
    calls = read_table(spark, d, "calls").select(F.lit("calls").alias("tbl"), F.col("call_id").alias("id"), F.lit("query").alias("field"), F.col("query").alias("text"))
    return turns.unionByName(calls)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every mention of personal data with its kind and place."""
    return personal.found(_free_texts(spark, d), read_table(spark, d, "name_list")).select("tbl", "rec_id", "field", "kind", "start_pos")


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with typed placeholders in place of the mentions."""
    return personal.redact(_free_texts(spark, d), read_table(spark, d, "name_list")).withColumnRenamed("id", "rec_id").distinct()


# ---------------------------------------------------------------- problem 6


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items of which they hold twelve consecutive words."""
    return _leaks(spark, d).select("doc_id", "item_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation item: how many documents leak it, and the longest leaked run in words."""
    got = _leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("length").alias("longest"))
    items = read_table(spark, d, "eval_items").select("item_id", "suite")
    return items.join(got, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("longest", F.lit(0)).alias("longest"))


# ---------------------------------------------------------------- problem 7


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixture(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix with their repeat counts and the tokens they contribute."""
    return _mixture(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per target source: target and reached share of the mix."""
    return _mixture(spark, d)[1]


# ---------------------------------------------------------------- problem 8


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of whose five-word sequences at least 30 % repeat an earlier one."""
    shares = repetition.repeated_shares(read_table(spark, d, "documents"), blocks=False)
    return shares.where("sequences > 0 AND (sequences - distinct) * 10 >= 3 * sequences").select("doc_id").distinct()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the share of its word sequences, lines, sentences and paragraphs that are repetition."""
    return repetition.repeated_shares(read_table(spark, d, "documents"))


def p8_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the lines that are boilerplate of its source, what is left, and whether it is rejected."""
    host = F.lower(F.regexp_replace("source", r"(?U)^\s+|\s+$", ""))
    return repetition.line_frequency(read_table(spark, d, "documents").select("doc_id", host.alias("host"), "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_groups, p2_found, p2_unassigned, p3_found, p3_rates, p4_found, p4_redacted, p6_found, p6_report, p7_mix, p7_shares, p8_found, p8_shares, p8_lines)
}

_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


def _grams(text: str, k: int, n: str = "w") -> str:
    return f"[array_to_string({n}[i:i+{k - 1}], ' ') FOR i IN range(1, len({n}) - {k - 2})]"


_SPACE = "'[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]'"


def _units(texts: str) -> str:
    folded = f"trim(regexp_replace(u, {_SPACE} || '+', ' ', 'g'))"
    return f"list_filter([{folded} FOR u IN {texts}], lambda u: u <> '')"


def _repeats(units: str) -> str:
    return f"CASE WHEN len({units}) = 0 THEN 0.0 ELSE 1 - len(list_distinct({units}))::DOUBLE / len({units}) END"


SQL: dict[str, str] = {
    "p1_found": f"""
WITH t AS (SELECT section_id AS id, {_WORDS.format("coalesce(heading, '') || chr(10) || coalesce(text, '')")} AS w FROM sections),
g AS (SELECT id, list_distinct({_grams("", 3)}) AS g FROM t WHERE len(w) >= 12),
n AS (SELECT id, len(g) AS n FROM g), e AS (SELECT id, unnest(g) AS s FROM g),
c AS (SELECT a.id AS a_id, b.id AS b_id, count(*) AS c FROM e a JOIN e b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)
SELECT a_id, b_id FROM c JOIN n x ON x.id = a_id JOIN n y ON y.id = b_id WHERE c * 2 >= x.n + y.n - c""",
    "p2_found": """
WITH c AS (
  SELECT lower(regexp_replace(session_id, '^\\s+|\\s+$', '', 'g')) AS s, call_id, query, outcome,
    CASE WHEN "timestamp" < 100000000000 THEN "timestamp" * 1000 ELSE "timestamp" END AS ts
  FROM calls WHERE coalesce(kind, 'turn') <> 'delegation'),
r AS (
  SELECT s, ts, min(call_id) AS call_id, coalesce(regexp_matches(query, '\\S'), false) AS ask, coalesce(regexp_matches(outcome, '\\S'), false) AS reply
  FROM c WHERE s IN (SELECT id FROM sessions) GROUP BY s, ts, query, outcome),
m AS (
  SELECT s, ts, call_id, 1 AS k, 'user' AS role FROM r WHERE ask UNION ALL SELECT s, ts, call_id, 2, 'assistant' FROM r WHERE reply),
o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ts, call_id, k) AS msg_no, count(*) OVER (PARTITION BY s) AS n FROM m),
bad AS (
  SELECT s FROM r WHERE NOT ask AND NOT reply
  UNION SELECT s FROM o WHERE (msg_no % 2 = 1) <> (role = 'user') OR n % 2 = 1)
SELECT s AS session_id, msg_no, role, call_id FROM o WHERE s NOT IN (SELECT s FROM bad)""",
    "p6_found": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM eval_items),
a AS (SELECT DISTINCT doc_id, unnest({_grams("", 12)}) AS s FROM d), b AS (SELECT DISTINCT item_id, unnest({_grams("", 12)}) AS s FROM i)
SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (s)""",
    "p8_found": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), g AS (SELECT doc_id, {_grams("", 5)} AS g FROM d WHERE len(w) >= 5)
SELECT doc_id FROM g WHERE (len(g) - len(list_distinct(g))) * 10 >= 3 * len(g)""",
    "p1_groups": f"""
WITH RECURSIVE t AS (SELECT section_id AS id, {_WORDS.format("coalesce(heading, '') || chr(10) || coalesce(text, '')")} AS w FROM sections),
c AS (SELECT id, min(id) OVER (PARTITION BY w) AS cls, w FROM t WHERE len(w) >= 12),
g AS (SELECT id, list_distinct({_grams("", 3)}) AS g FROM c WHERE id = cls), n AS (SELECT id, len(g) AS n FROM g), e AS (SELECT id, unnest(g) AS s FROM g),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM e a JOIN e b ON a.s = b.s AND a.id <> b.id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c * 2 >= x.n + y.n - c),
r(id, grp) AS (SELECT id, id FROM n UNION SELECT l.b, r.grp FROM r JOIN l ON l.a = r.id), m AS (SELECT id, min(grp) AS grp FROM r GROUP BY 1), k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT c.id AS section_id, c.cls AS class_id, m.grp AS group_id, coalesce(k.n, 0) AS n_links FROM c JOIN m ON m.id = c.cls LEFT JOIN k ON k.a = c.cls""",
    "p8_lines": """
WITH d AS (SELECT doc_id, lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS host, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, host, trim(regexp_replace(unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))), '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]+', ' ', 'g')) AS line FROM d),
k AS (SELECT doc_id, host, line, lower(line) AS h FROM l WHERE line <> ''), s AS (SELECT host, count(DISTINCT doc_id) AS n FROM d GROUP BY 1),
f AS (SELECT k.host, h, count(DISTINCT doc_id) AS c FROM k GROUP BY 1, 2), b AS (SELECT f.host, h FROM f JOIN s ON f.host IS NOT DISTINCT FROM s.host WHERE c > 20 AND c > 0.01 * n)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE b.h IS NOT NULL) AS removed, sum(CASE WHEN b.h IS NULL THEN length(line) ELSE 0 END) / sum(length(line)) AS left_share,
  sum(CASE WHEN b.h IS NULL THEN length(line) ELSE 0 END) / sum(length(line)) < 0.5 AS rejected
FROM k LEFT JOIN b ON b.h = k.h AND b.host IS NOT DISTINCT FROM k.host GROUP BY 1""",
    "p6_report": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM eval_items),
a AS (SELECT doc_id, unnest({_grams("", 12)}) AS s, generate_subscripts({_grams("", 12)}, 1) AS p FROM d WHERE len(w) >= 12),
b AS (SELECT item_id, unnest({_grams("", 12)}) AS s, generate_subscripts({_grams("", 12)}, 1) AS q FROM i WHERE len(w) >= 12),
m AS (SELECT doc_id, item_id, p, p - q AS diagonal FROM a JOIN b USING (s)),
r AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p) AS island FROM m),
l AS (SELECT doc_id, item_id, count(*) + 11 AS n FROM r GROUP BY doc_id, item_id, diagonal, island),
g AS (SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(n) AS longest FROM l GROUP BY 1)
SELECT item_id, suite, coalesce(n_docs, 0) AS n_docs, coalesce(longest, 0) AS longest FROM eval_items LEFT JOIN g USING (item_id)""",
    "p8_shares": f"""
WITH t AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w, lower(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS x FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN {_grams("", 5)} ELSE [] END AS g,
  {_units("string_split(x, chr(10))")} AS a, {_units("string_split(regexp_replace(replace(x, chr(10), ' '), '([.!?。！？])' || " + _SPACE + " || '*', '\\1' || chr(1), 'g'), chr(1))")} AS b, {_units("string_split(regexp_replace(x, '\\n' || " + _SPACE + " || '*\\n', chr(1), 'g'), chr(1))")} AS c FROM t)
SELECT doc_id, len(g) AS sequences, len(list_distinct(g)) AS distinct, {_repeats("g")} AS share, {_repeats("a")} AS line_share, {_repeats("b")} AS sentence_share, {_repeats("c")} AS paragraph_share FROM g""",
    "p2_unassigned": """
WITH c AS (
  SELECT lower(regexp_replace(session_id, '^\\s+|\\s+$', '', 'g')) AS s, coalesce(agent, 'unknown') AS agent, call_id, query, outcome,
    CASE WHEN "timestamp" < 100000000000 THEN "timestamp" * 1000 ELSE "timestamp" END AS ts
  FROM calls WHERE coalesce(kind, 'turn') <> 'delegation'),
k AS (SELECT s, ts, min(call_id) AS id FROM c WHERE s IS NOT NULL GROUP BY s, ts, query, outcome),
gap AS (SELECT quantile_disc(p, 0.99) AS g FROM (SELECT ts - lag(ts) OVER (PARTITION BY s ORDER BY ts, id) AS p FROM k) x),
r AS (
  SELECT agent, ts, min(call_id) AS id, coalesce(regexp_matches(query, '\\S'), false) AS ask, coalesce(regexp_matches(outcome, '\\S'), false) AS reply
  FROM c WHERE s IS NULL OR s = '' GROUP BY agent, ts, query, outcome),
b AS (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY agent ORDER BY ts, id) > (SELECT g FROM gap))::INT, 0) AS brk FROM r),
p AS (SELECT *, sum(brk) OVER (PARTITION BY agent ORDER BY ts, id)::BIGINT AS part FROM b),
m AS (SELECT agent, part, ts, id, 1 AS k, 'user' AS role FROM p WHERE ask UNION ALL SELECT agent, part, ts, id, 2, 'assistant' FROM p WHERE reply),
o AS (SELECT *, row_number() OVER (PARTITION BY agent, part ORDER BY ts, id, k) AS msg_no, count(*) OVER (PARTITION BY agent, part) AS n FROM m),
bad AS (SELECT agent, part FROM p WHERE NOT ask AND NOT reply UNION SELECT agent, part FROM o WHERE (msg_no % 2 = 1) <> (role = 'user') OR n % 2 = 1)
SELECT agent, part, msg_no, role, id AS call_id FROM o WHERE (agent, part) NOT IN (SELECT (agent, part) FROM bad)""",
}
