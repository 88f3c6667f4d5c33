"""Queries of the text and path functions, over all documents, files, sections or calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import paths, text as T
from weft.functions.tokens import count_tokens
from weft.operators import budget
from weft.plans.base import docs, files, query
from weft.runtime import read_table
from weft.sources import extract

_RUNS = "string_split_regex({}, '[^\\p{{L}}\\p{{N}}]+')"
_CJK = r"\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{4e00}-\x{9fff}"


def _all(spark, d, f, name="terms"):
    t = read_table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", F.array_join(f(F.col("text")), " ").alias(name))


@query("SELECT doc_id, array_to_string(list_filter(" + _RUNS.format("lower(regexp_replace(text, '([^\\p{Lu}])(\\p{Lu})', '\\1 \\2', 'g'))") + ", lambda x: x <> ''), ' ') AS terms FROM documents WHERE text IS NOT NULL")
def x01_identifier_terms(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d, T.identifier_terms)


@query("SELECT doc_id, array_to_string(list_transform(list_filter(" + _RUNS.format("text") + ", lambda x: strlen(x) >= 2), lambda x: lower(x)), ' ') AS terms FROM documents WHERE text IS NOT NULL")
def x02_document_terms(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d, T.document_terms)


@query(f"""
WITH r AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}') AS a, regexp_extract_all(lower(text), '[{_CJK}]+') AS c FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(a || flatten([[x[i:i] FOR i IN range(1, length(x) + 1)] FOR x IN c]) || flatten([[x[i:i+1] FOR i IN range(1, length(x))] FOR x IN c]), ' ') AS terms FROM r""")
def x03_recall_terms(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d, T.recall_terms)


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"""
WITH r AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+') AS a, regexp_extract_all(text, '[{_CJK}]+') AS c FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_filter([trim(lower(x), '_') FOR x IN a], lambda x: length(x) >= 2 AND x NOT IN ({_STOP})) || flatten([CASE WHEN length(x) = 1 THEN [x] ELSE [x[i:i+1] FOR i IN range(1, length(x))] END FOR x IN c]), ' ') AS terms FROM r""")
def x04_rule_terms(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d, T.rule_terms)


# keys are planted in every text, so that there is something to redact; RE2 has no look-around, hence whole assignments here
_PLANT = "text || chr(10) || 'api_key = \"abcdef0123456789abcdef\" and ghp_' || repeat('a1', 20)"


@query(f"""SELECT doc_id, regexp_replace(regexp_replace({_PLANT}, '{T.KEY_SHAPES}', '[REDACTED]', 'g'), '(\\b(?i:{T.SECRET_NAMES})\\b[ \\t]*[:=][ \\t]*["'']?)[A-Za-z_./+\\-]*[0-9][A-Za-z0-9_./+\\-]{{15,}}', '\\1[REDACTED]', 'g') AS text FROM documents WHERE text IS NOT NULL""")
def x05_redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "documents").where("text IS NOT NULL")
    planted = F.concat("text", F.lit('\napi_key = "abcdef0123456789abcdef" and ghp_' + "a1" * 20))
    return t.select("doc_id", T.redact_secrets(planted).alias("text"))


@query("SELECT turn_no, source, request[1:600] AS request, outcome[1:400] AS outcome FROM turns")
def x06_truncate_chars(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "turns")
    return t.select("turn_no", "source", T.truncate_chars(F.col("request"), 600).alias("request"), T.truncate_chars(F.col("outcome"), 400).alias("outcome"))


@query("SELECT turn_no, source, CASE WHEN recorded_at < TIMESTAMP '2024-04-01' AND length(request) > 120 THEN request[1:119] || '…' ELSE request END AS request FROM turns")
def x07_fold(spark: SparkSession, d: str) -> DataFrame:
    old = F.col("recorded_at") < F.lit("2024-04-01").cast("timestamp_ntz")
    return read_table(spark, d, "turns").select("turn_no", "source", T.fold(F.col("request"), old).alias("request"))


@query("SELECT section_id, regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{9f}]', '', 'g') AS text FROM sections")
def x08_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "sections").select("section_id", T.sanitize(F.col("text")).alias("text"))


_BR = r"[ \t\r]*(?:(?:-[ \t\r]*){3,}|(?:\*[ \t\r]*){3,}|(?:_[ \t\r]*){3,})?"


@query(rf"""SELECT section_id, CASE WHEN regexp_full_match(t, '(?:{_BR}\n)*{_BR}') THEN '' ELSE regexp_replace(regexp_replace(t, '\A(?:{_BR}\n)+', ''), '(?:\n{_BR})+\z', '') END AS text
FROM (SELECT section_id, regexp_replace(replace('---' || chr(10) || text || chr(10) || '* * *', chr(13) || chr(10), chr(10)), '\n\z', '') AS t FROM sections) x WHERE t IS NOT NULL""")
def x09_trim_breaks(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "sections").where("text IS NOT NULL")
    return t.select("section_id", T.trim_breaks(F.concat(F.lit("---\n"), "text", F.lit("\n* * *"))).alias("text"))


#: Front matter for a third of the documents, fences of both kinds for another, so that the texts hold what the functions are for.
_FRONT, _FENCED = "---\nowner: team\n# no heading\n---\n", "\n```\n# no heading\n~~~\n\n\nkept code\n```\n# Tail\nbody\n ~~~ \n## inside\n```\nstill inside\n~~~\n---\n"


def _planted(spark, d) -> DataFrame:
    """``(doc_id, text)`` of all documents with a text, with front matter and fences put into two thirds of them."""
    third = F.pmod("doc_id", F.lit(3))
    text = F.when(third == 0, F.concat(F.lit(_FRONT), "text")).when(third == 1, F.concat("text", F.lit(_FENCED))).otherwise(F.col("text"))
    return read_table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.alias("text"))


def _e(s: str) -> str:
    return "E'" + s.replace("\n", "\\n") + "'"


_PLANTED = f"""p AS (SELECT doc_id, CASE (doc_id % 3 + 3) % 3 WHEN 0 THEN {_e(_FRONT)} || text WHEN 1 THEN text || {_e(_FENCED)} ELSE text END AS text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS no
  FROM (SELECT doc_id, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n\\z', '') AS t FROM p) y)"""


@query(rf"""
WITH RECURSIVE {_PLANTED},
m AS (SELECT doc_id, min(no) FILTER (WHERE no > 1 AND x = '---') AS stop FROM l WHERE doc_id IN (SELECT doc_id FROM l WHERE no = 1 AND x = '---') GROUP BY 1),
b AS (SELECT doc_id, x, no - coalesce(stop, 0) AS no, regexp_extract(x, '^ {{0,3}}(```|~~~)', 1) AS mark FROM l LEFT JOIN m USING (doc_id) WHERE no > coalesce(stop, 0)),
f(doc_id, no, fence, head) AS (
  SELECT doc_id, no, mark, mark = '' AND regexp_matches(x, '^#{{1,3}} ') FROM b WHERE no = 1
  UNION ALL SELECT b.doc_id, b.no, CASE WHEN f.fence = '' THEN b.mark WHEN f.fence = b.mark THEN '' ELSE f.fence END, f.fence = '' AND b.mark = '' AND regexp_matches(b.x, '^#{{1,3}} ') FROM f JOIN b ON b.doc_id = f.doc_id AND b.no = f.no + 1),
s AS (SELECT b.doc_id, b.no, x, head, sum(head::INT) OVER (PARTITION BY b.doc_id ORDER BY b.no) AS sec FROM b JOIN f ON f.doc_id = b.doc_id AND f.no = b.no),
g AS (SELECT doc_id, sec, coalesce(max(CASE WHEN head THEN trim(regexp_replace(regexp_extract(x, '^#{{1,3}} (.*)$', 1), '[# ]+$', '')) END), '') AS heading, coalesce(string_agg(CASE WHEN NOT head THEN x END, chr(10) ORDER BY no), '') AS body FROM s GROUP BY 1, 2),
c AS (SELECT doc_id, heading, trim(body, E' \t\r\n') AS t FROM g),
t AS (SELECT doc_id, heading, CASE WHEN regexp_full_match(t, '(?:{_BR}\n)*{_BR}') THEN '' ELSE regexp_replace(regexp_replace(t, '\A(?:{_BR}\n)+', ''), '(?:\n{_BR})+\z', '') END AS text FROM c)
SELECT doc_id, heading, text, sha256(heading || chr(10) || text) AS hash FROM t WHERE text <> ''""")
def x10_rule_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of all documents, with front matter and fences in two thirds of them."""
    return _planted(spark, d).select("doc_id", F.inline(T.rule_sections(F.col("text"))))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(?m)^[ \t\r]*\n(?:[ \t\r]*\n)*', chr(10), 'g'), '\s+\z', '') AS text FROM documents WHERE text IS NOT NULL""")
def x11_collapse_blank(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", T.collapse_blank(F.col("text")).alias("text"))


_COLLAPSED = r"regexp_replace(regexp_replace({}, '(?m)^[ \t\r]*\n(?:[ \t\r]*\n)*', chr(10), 'g'), '\s+\z', '')"


@query(rf"""
WITH {_PLANTED}, f AS (SELECT *, starts_with(trim(x), '```') AS mark, sum(starts_with(trim(x), '```')::INT) OVER (PARTITION BY doc_id ORDER BY no) AS n FROM l),
k AS (SELECT doc_id, string_agg(CASE WHEN mark OR n % 2 = 1 OR regexp_matches(x, '^\s*(?:#|[-*+>] |\p{{N}})|^\s*(?:---|\*\*\*|___)\s*$') THEN x END, chr(10) ORDER BY no) AS t FROM f GROUP BY 1)
SELECT doc_id, {_COLLAPSED.format("coalesce(t, '')")} AS text FROM k""")
def x12_markdown_compress(spark: SparkSession, d: str) -> DataFrame:
    """All documents, with front matter and fences in two thirds of them."""
    return _planted(spark, d).select("doc_id", T.markdown_compress(F.col("text")).alias("text"))


_KEPT_LINES = r"coalesce(string_agg(CASE WHEN mark OR n % 2 = 1 OR regexp_matches(x, '^\s*(?:#|[-*+>] |\p{N})|^\s*(?:---|\*\*\*|___)\s*$') THEN x END, chr(10) ORDER BY no), '')"
#: RE2 has no look-behind; a comment that follows a colon stays one in Spark, and no document has one.
_NO_COMMENTS = r"regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(?s:/\*.*?\*/)|(?m://[^\n]*$)', '', 'g')"
_DECL = r"^\s*(?:export\s+|pub(?:\([a-z]+\))?\s+|default\s+|abstract\s+|async\s+)*(?:fn|struct|enum|impl|trait|class|interface|type|function|def|func)\b"


@query(rf"""
WITH t AS (SELECT doc_id AS file_id, text, doc_type = 'code' AS code, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n\z', ''), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
q AS (SELECT file_id, unnest(l) AS x, generate_subscripts(l, 1) AS no, code FROM t WHERE NOT code), f AS (SELECT *, starts_with(trim(x), '```') AS mark, sum(starts_with(trim(x), '```')::INT) OVER (PARTITION BY file_id ORDER BY no) AS n FROM q),
k AS (SELECT file_id, {_COLLAPSED.format(_KEPT_LINES)} AS t FROM f GROUP BY 1),
b AS (SELECT t.file_id, strlen(text) AS bytes_0, CASE WHEN NOT code THEN strlen({_COLLAPSED.format("replace(text, chr(13) || chr(10), chr(10))")}) ELSE strlen({_COLLAPSED.format(_NO_COMMENTS)}) END AS bytes_1,
  CASE WHEN NOT code THEN strlen(k.t) ELSE strlen(array_to_string([regexp_replace(x, '\s*[{{:]?\s*$', '') || ' {{ ... }}' FOR x IN l IF regexp_matches(x, '{_DECL}')], chr(10))) END AS bytes_2 FROM t LEFT JOIN k ON k.file_id = t.file_id)
SELECT *, CASE WHEN bytes_0 > 0 THEN round_even(greatest((1 - bytes_2 / bytes_0) * 100, 0.0), 0)::INT ELSE 0 END || '%' AS rate FROM b""")
def x15_compress(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of every document at the three levels, and the rate of level 2."""
    t = docs(spark, d).where("text IS NOT NULL")
    one = budget.compressed_files(t, 1).select("file_id", F.col("original").alias("bytes_0"), F.col("compressed").alias("bytes_1"))
    two = budget.compressed_files(t, 2).select("file_id", F.col("compressed").alias("bytes_2"), "rate")
    return one.join(two, "file_id")


@query("SELECT id, path, b AS base, floor(b * 0.70::DOUBLE)::BIGINT AS level_1, floor(b * 0.25::DOUBLE)::BIGINT AS level_2 FROM (SELECT id, path, CASE WHEN coalesce(char_count, 0) // 4 > 0 THEN char_count // 4 ELSE 150 END AS b FROM files) x")
def x17_x18_estimates(spark: SparkSession, d: str) -> DataFrame:
    base = budget.base_tokens(F.col("char_count"), F.lit(3))
    return read_table(spark, d, "files").select("id", "path", base.alias("base"), budget.estimate(base, 1).alias("level_1"), budget.estimate(base, 2).alias("level_2"))


@query()
def x19_count_tokens(spark: SparkSession, d: str) -> DataFrame:
    """X19 with a public vocabulary."""
    return read_table(spark, d, "documents").select("doc_id", count_tokens(F.col("text")).alias("tokens"))


@query("SELECT call_id, CASE WHEN tokens > 0 THEN round_even(((tokens - tokens // 3)::DOUBLE * 100 / tokens)::FLOAT::DOUBLE, 0)::BIGINT || '%' ELSE '0%' END AS savings, printf('$%d.%02d', round(tokens * 15 / 10000)::BIGINT // 100, round(tokens * 15 / 10000)::BIGINT % 100) AS cost FROM calls")
def x20_x21_savings_cost(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "calls")
    return t.select("call_id", budget.savings(F.col("tokens"), F.floor(F.col("tokens") / 3)).alias("savings"), budget.cost(F.col("tokens"), "opus").alias("cost"))


@query("SELECT call_id, strftime(epoch_ms(CASE WHEN \"timestamp\" < 100000000000 THEN \"timestamp\" * 1000 ELSE \"timestamp\" END), '%Y-%m-%d %H:%M') AS at FROM calls")
def x22_epoch_minutes(spark: SparkSession, d: str) -> DataFrame:
    ms = F.when(F.col("timestamp") < 100_000_000_000, F.col("timestamp") * 1000).otherwise(F.col("timestamp"))
    return read_table(spark, d, "calls").select("call_id", T.epoch_minutes(ms).alias("at"))


@query("SELECT id, CASE WHEN starts_with(replace(path, chr(92), '/'), 'core/') THEN replace(path, chr(92), '/')[6:] ELSE replace(path, chr(92), '/') END AS path FROM files")
def x29_relativize(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "files").select("id", T.relativize(F.col("path"), "core").alias("path"))


@query("SELECT event_id, round(pow(0.5, greatest(epoch(TIMESTAMP '2024-06-01' - ts) / 86400.0, 0.0) / 90.0), 9) AS decay, round(value / (value + 2), 9) AS saturated FROM events")
def x30_x31_decay(spark: SparkSession, d: str) -> DataFrame:
    age = (F.lit(1717200000.0) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) / 86400.0
    return read_table(spark, d, "events").select("event_id", F.round(T.recency(age), 9).alias("decay"), F.round(T.saturated(F.col("value")), 9).alias("saturated"))


# ---------------------------------------------------------------- paths


_LANG = " ".join(f"WHEN '{e}' THEN '{lang}'" for lang, exts in paths.LANGUAGES.items() for e in exts.split())


@query(f"SELECT id, path, CASE regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1) {_LANG} ELSE 'unknown' END AS language FROM files")
def s04_language(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "files").select("id", "path", paths.language_of(F.col("path")).alias("language"))


@query("SELECT id, path, len(list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda s: s LIKE '.%' OR s IN ('node_modules', 'venv', '__pycache__', 'coverage', 'vendor', 'out'))) > 0 AS skipped FROM files")
def s02_skipped(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "files").select("id", "path", paths.skipped(F.col("path")).alias("skipped"))


@query("SELECT doc_id, sha256(text) AS hash, strlen(text) AS char_count FROM documents WHERE text IS NOT NULL")
def s05_content_hash(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").alias("char_count"))


_DOTS = ("", "/../x", "//y/./z/", "/../../../../../../../..")


@query(f"""
WITH p AS (SELECT id, string_split('home/u/x/../' || replace(path, chr(92), '/') || CASE (id % 4 + 4) % 4 {" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_DOTS))} END, '/') AS s FROM files WHERE path IS NOT NULL),
f AS (SELECT id, list_reduce([['']] || [[x] FOR x IN s], lambda a, x: CASE WHEN x[1] IN ('', '.') OR a[1] = 'out' THEN a WHEN x[1] = '..' AND len(a) = 1 THEN ['out'] WHEN x[1] = '..' THEN a[1:len(a) - 1] ELSE a || x END) AS a FROM p)
SELECT id, CASE WHEN a[1] = 'out' THEN NULL WHEN len(a) = 1 THEN '/' ELSE array_to_string(a, '/') END AS path FROM f""")
def s21_absolute(spark: SparkSession, d: str) -> DataFrame:
    """Paths of all files; three quarters get dots, doubled slashes or more steps up than there are folders."""
    tail = F.element_at(F.array(*map(F.lit, _DOTS)), (F.pmod("id", F.lit(4)) + 1).cast("int"))
    return read_table(spark, d, "files").where("path IS NOT NULL").select("id", paths.absolute(F.concat(F.lit("/home/u/x/../"), "path", tail)).alias("path"))


@query("SELECT id, CASE WHEN p = 'core' OR starts_with(p, 'core/') THEN 'core' WHEN starts_with(p, 'notes/') THEN 'notes' END AS root FROM (SELECT id, replace(path, chr(92), '/') AS p FROM files) x")
def s20_root(spark: SparkSession, d: str) -> DataFrame:
    from weft.sources.corpus import rooted

    return read_table(spark, d, "files").select("id", rooted(paths.slashes(F.col("path")), ["core", "core/folder", "notes"]).alias("root"))


@query("SELECT id, regexp_matches(p, '^(?:\\.|AppData(?:/|$)|Library(?:/|$))') AND NOT starts_with(p, 'AppData/Local/Temp') AS private FROM (SELECT id, CASE id % 4 WHEN 0 THEN '.cache/' WHEN 1 THEN 'AppData/Local/Temp/' WHEN 2 THEN 'Library/' ELSE 'src/' END || replace(path, chr(92), '/') AS p FROM files) x")
def s22_private_place(spark: SparkSession, d: str) -> DataFrame:
    sub = F.element_at(F.array(F.lit(".cache/"), F.lit("AppData/Local/Temp/"), F.lit("Library/"), F.lit("src/")), (F.col("id") % 4 + 1).cast("int"))
    p = F.concat(F.lit("/home/u/"), sub, paths.slashes(F.col("path")))
    return read_table(spark, d, "files").select("id", paths.private_place(p, "/home/u").alias("private"))


@query("SELECT section_id, CASE WHEN f = 'CLAUDE.md' THEN 'claude-code' WHEN f = 'AGENTS.md' THEN 'codex' WHEN f = 'GEMINI.md' THEN 'gemini-cli' WHEN f = '.github/copilot-instructions.md' THEN 'github-copilot' WHEN f = 'CONVENTIONS.md' THEN 'aider' WHEN f = '.clinerules' THEN 'cline' WHEN f = '.windsurfrules' THEN 'windsurf' WHEN f = '.claude/CLAUDE.md' THEN 'claude-code' WHEN f LIKE '.clinerules/%.md' THEN 'cline' WHEN f LIKE '.cursor/rules/%.md' OR f LIKE '.cursor/rules/%.mdc' THEN 'cursor' END AS owner FROM (SELECT section_id, regexp_replace(file, '^packages/[^/]*/', '') AS f FROM sections) x")
def f10_owner(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "sections").select("section_id", paths.owner_of(F.regexp_replace("file", "^packages/[^/]*/", "")).alias("owner"))


@query("SELECT call_id, regexp_replace(coalesce(agent, 'no one!') || '@home', '[^A-Za-z0-9_-]', '_', 'g') AS agent FROM calls")
def f13_agent_id(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "calls").select("call_id", T.agent_id(F.concat(F.coalesce("agent", F.lit("no one!")), F.lit("@home"))).alias("agent"))


@query("SELECT id, path FROM files WHERE starts_with(lower(path), 'core/f')")
def f07_prefix_match(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "files").where(T.prefix_match(F.col("path"), "Core/F")).select("id", "path")


_RULES = "(VALUES ('*', 0), ('*.go', 1), ('parser*', 2), ('*.md', 2), ('core/folder/parser_4j.go', 0), ('whitespace_3f.md', 1)) r(pattern, level)"


@query(f"""
WITH f AS (SELECT DISTINCT path, regexp_extract(path, '[^/]*$') AS n FROM files), r AS (SELECT * FROM {_RULES}),
m AS (SELECT path, level, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN pattern = path THEN 0 WHEN pattern = n THEN 1 ELSE 2 END, length(replace(pattern, '*', '')) DESC, pattern) AS k
  FROM f JOIN r ON pattern = path OR pattern = n OR pattern = '*' OR (pattern LIKE '*%' AND ends_with(n, pattern[2:])) OR (pattern LIKE '%*' AND pattern NOT LIKE '*%' AND starts_with(n, pattern[1:length(pattern) - 1])))
SELECT path, level FROM m WHERE k = 1""")
def f08_f09_rule_levels(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("*", 0), ("*.go", 1), ("parser*", 2), ("*.md", 2), ("core/folder/parser_4j.go", 0), ("whitespace_3f.md", 1)], "pattern string, level int")
    return budget.rule_level(read_table(spark, d, "files").select("path").distinct(), rules)


@query("SELECT call_id, CASE WHEN len(files) > 5 THEN array_to_string(files[1:5], ', ') || ', … (+' || (len(files) - 5) || ' more)' ELSE array_to_string(files, ', ') END AS files FROM calls WHERE files IS NOT NULL")
def t08_capped_list(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "calls").where("files IS NOT NULL").select("call_id", T.capped_list(F.col("files")).alias("files"))


# ---------------------------------------------------------------- extraction


@query("SELECT event_id AS file_id, unnest(json_keys(props)) AS name, 1 AS line FROM events WHERE props IS NOT NULL")
def s06_json_keys(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "events").select(F.col("event_id").alias("file_id"), F.col("props").alias("text"))
    return extract.json_keys(t).select("file_id", "name", "line")


@query("SELECT event_id AS file_id, unnest(json_keys(props)) AS name FROM events WHERE props IS NOT NULL")
def s07_jsonl_keys(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "events").select(F.col("event_id").alias("file_id"), F.concat(F.lit("\n  \n"), "props", F.lit('\n{"other": 1}')).alias("text"))
    return extract.jsonl_keys(t).select("file_id", "name")


_LINES = r"""l AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS line
  FROM (SELECT doc_id, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n\z', '') AS t FROM documents WHERE text IS NOT NULL) y)"""


@query(rf"""WITH {_LINES}, w AS (SELECT doc_id AS file_id, trim(regexp_replace(x, '^\s*#{{1,6}}', ''), E' \t\r') AS name, line, x, length(regexp_extract(x, '^\s*(#{{1,6}})', 1)) + 1 AS col, first(CASE WHEN regexp_matches(x, '\S') THEN trim(x, E' \t\r') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM l)
SELECT file_id, name, line, col, CASE WHEN nxt LIKE '#%' THEN NULL WHEN length(nxt) > 100 THEN nxt[1:100] || '…' ELSE nxt END AS signature FROM w WHERE regexp_matches(x, '^\s*#{{1,6}}[^#].*$') AND name <> ''""")
def s09_markdown_headings(spark: SparkSession, d: str) -> DataFrame:
    """S9, W8."""
    return extract.markdown_headings(docs(spark, d)).select("file_id", "name", "line", "col", "signature")


@query(rf"""WITH {_LINES}, t AS (SELECT doc_id AS file_id, line, unnest(regexp_extract_all(regexp_replace(x, '`([A-Za-z]\w*)`', '<\1>', 'g'), '<([A-Za-z][\w.:-]*)', 1)) AS name FROM l)
SELECT file_id, name, min(line) AS line FROM t GROUP BY 1, 2""")
def s08_s15_tag_names(spark: SparkSession, d: str) -> DataFrame:
    """S8, S15; names in code marks stand for tags."""
    marked = docs(spark, d).withColumn("text", F.regexp_replace("text", r"`([A-Za-z]\w*)`", "<$1>"))
    return extract.tag_names(marked).select("file_id", "name", "line")


@query(r"""
WITH c AS (SELECT column_name, column_type, row_number() OVER () AS n FROM (DESCRIBE calls)), t AS (SELECT *, regexp_replace(column_type, '(\[\])+$', '') AS one FROM c),
k AS (SELECT column_name, n, column_type LIKE '%[]' AS many, CASE one WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
  ELSE replace(replace(replace(replace(replace(one, 'STRUCT(', 'struct<'), ')', '>'), '"', ''), ' VARCHAR', ':string'), ', ', ',') END AS one FROM t)
SELECT 'Parquet Schema' AS name, 'module' AS kind, 1 AS line, (SELECT count(*) FROM calls) || ' rows, ' || (SELECT count(*) FROM c) || ' columns' AS signature
UNION ALL SELECT column_name, 'property', n + 1, CASE WHEN many THEN 'array<' || one || '>' ELSE one END FROM k""")
def s10_parquet_schema(spark: SparkSession, d: str) -> DataFrame:
    return extract.parquet_schema(spark, f"{d}/calls.parquet")


_CODE_LINES = _LINES.replace("WHERE text IS NOT NULL", "WHERE text IS NOT NULL AND doc_type = 'code'")


@query(rf"""WITH {_CODE_LINES}, s AS (SELECT doc_id AS file_id, line, x, CASE WHEN regexp_matches(x, '^\s*(?:pub(?:\([a-z]+\))? )?(?:async )?fn\s+(\w+)') THEN 'function' WHEN regexp_matches(x, '^\s*(?:pub )?struct\s+\w+') THEN 'struct' WHEN regexp_matches(x, '^\s*(?:pub )?enum\s+\w+') THEN 'enum' WHEN regexp_matches(x, '^\s*(?:pub )?trait\s+\w+') THEN 'interface' WHEN regexp_matches(x, '^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+ for )?\w+') THEN 'class' END AS kind FROM l)
SELECT file_id, regexp_extract(x, '^\s*(?:pub(?:\([a-z]+\))? )?(?:async )?(?:fn|struct|enum|trait|impl(?:<[^>]*>)?)\s+(?:[\w:<>]+ for )?(\w+)', 1) AS name, kind, line, regexp_matches(x, '^\s*(?:pub\b|export\b)') AS is_exported FROM s WHERE kind IS NOT NULL""")
def s16_code_symbols(spark: SparkSession, d: str) -> DataFrame:
    """S16, X34 over the documents of code."""
    return extract.code_symbols(docs(spark, d)).select("file_id", "name", "kind", "line", "is_exported")


_NC = ", ".join(f"'{w}'" for w in extract.NO_CALL + extract.NO_CALL_BY["rust"])


@query(rf"""WITH {_CODE_LINES}, a AS (
  SELECT doc_id AS file_id, line, string_split(regexp_extract(x, '^\s*use\s+([\w:]+)', 1), '::')[-1] AS name, 'import' AS kind FROM l WHERE regexp_matches(x, '^\s*use\s+[\w:]+')
  UNION ALL SELECT doc_id, line, unnest(regexp_extract_all(x, '[\w_]+::([\w_]+)\s*\(', 1)), 'function_call' FROM l
  UNION ALL SELECT doc_id, line, n, 'function_call' FROM (SELECT doc_id, line, x, unnest(regexp_extract_all(x, '([A-Za-z_]\w*)\s*\(', 1)) AS n FROM l) z
    WHERE n NOT IN ({_NC}) AND n <> regexp_extract(x, '^\s*(?:pub(?:\(crate\))? |async |pub async )?fn\s+([\w$]+)', 1))
SELECT file_id, line, name, kind, count(*) AS n FROM a WHERE name <> '' GROUP BY 1, 2, 3, 4""")
def x24_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """X23, X24, X33 over the documents of code; the other languages are tested on fixtures."""
    return extract.dependencies(docs(spark, d)).groupBy("file_id", "line", "name", "kind").agg(F.count("*").alias("n"))


#: Lines that every language's extractor has to read, at the end of every document.
_SNIPPET = {
    "typescript": "import { Left, Right as R } from 'm'\nimport * as All from \"n\"\nconst fs = require('fs')\nexport async function own(a) { other(new Box(a.open(1))) }\nif (x) own(y)",
    "python": "from a.b import (one, two as t)\nimport os, run(3)\nasync def own(a): other(a)\nclass Own(Base): print(own(1))\nwith f(x): g(y)",
    "go": "func (s *Server) Own(a int) { other(a) }\nfunc own() { go run(1); defer done() }\nfor i := range list(2) { s.call(i) }",
}


def _in_language(spark, d, language: str) -> DataFrame:
    text = F.concat("text", F.lit("\n" + _SNIPPET[language]))
    return extract.dependencies(docs(spark, d).select("file_id", F.lit(language).alias("language"), text.alias("text"))).groupBy("file_id", "line", "name", "kind").agg(F.count("*").alias("n"))


def _in_language_sql(language: str, parts: str, quiet: str = "false") -> str:
    snippet = _SNIPPET[language].replace("'", "''").replace("\n", "\\n")
    banned = ", ".join(f"'{w}'" for w in extract.NO_CALL + extract.NO_CALL_BY[language])
    defines = extract.DEFINES[language]
    return rf"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS line
  FROM (SELECT doc_id, regexp_replace(replace(text || chr(10) || E'{snippet}', chr(13) || chr(10), chr(10)), '\n\z', '') AS t FROM documents WHERE text IS NOT NULL) y),
a AS ({parts} UNION ALL SELECT doc_id, line, n, 'function_call' FROM (SELECT doc_id, line, x, unnest(regexp_extract_all(x, '([A-Za-z_]\w*)\s*\(', 1)) AS n FROM l WHERE NOT {quiet}) z WHERE n NOT IN ({banned}) AND n <> regexp_extract(x, '{defines}', 1))
SELECT doc_id AS file_id, line, name, kind, count(*) AS n FROM a WHERE name <> '' GROUP BY 1, 2, 3, 4"""


_TS = r"""SELECT doc_id, line, trim(unnest(string_split(regexp_extract(x, 'import\s+\{\s*([^}]+?)\s*\}\s+from\s+[''"][^''"]+[''"]', 1), ','))) AS name, 'import' AS kind FROM l
  UNION ALL SELECT doc_id, line, regexp_extract(x, 'import\s+\*\s+as\s+(\w+)\s+from\s+[''"][^''"]+[''"]', 1), 'import' FROM l
  UNION ALL SELECT doc_id, line, regexp_extract(x, '(?:const|var|let)\s+(\w+)\s*=\s*require\([''"].*?[''"]\)', 1), 'import' FROM l
  UNION ALL SELECT doc_id, line, unnest(regexp_extract_all(x, '[\w_]+\.([\w_]+)\s*\(', 1)), 'function_call' FROM l
  UNION ALL SELECT doc_id, line, unnest(regexp_extract_all(x, 'new\s+([A-Za-z_]\w*)\s*\(', 1)), 'type_reference' FROM l"""
_FROM = r"regexp_extract(x, '^\s*from\s+[\w.]+\s+import\s+(.+)$', 1)"
_PY = rf"""SELECT doc_id, line, name, kind FROM (SELECT doc_id, line, regexp_replace(trim(string_split(unnest(string_split({_FROM}, ',')), ' as ')[1]), '^[()\s]+|[()\s]+$', '', 'g') AS name, 'import' AS kind FROM l) z WHERE name <> '*'"""


@query(_in_language_sql("typescript", _TS))
def x25_typescript(spark: SparkSession, d: str) -> DataFrame:
    """Every document read as TypeScript, with a snippet at its end."""
    return _in_language(spark, d, "typescript")


@query(_in_language_sql("python", _PY, rf"({_FROM} <> '' OR starts_with(ltrim(x), 'import '))"))
def x26_python(spark: SparkSession, d: str) -> DataFrame:
    """Every document read as Python, with a snippet at its end."""
    return _in_language(spark, d, "python")


@query(_in_language_sql("go", "SELECT doc_id, line, '' AS name, '' AS kind FROM l WHERE false"))
def x27_go(spark: SparkSession, d: str) -> DataFrame:
    """Every document read as Go, with a snippet at its end."""
    return _in_language(spark, d, "go")


#: An ignore file at the root, one further down, and a supplementary one.
_IGNORED = [(".gitignore", "# comment\n*.json\nnotes/\n!keep.json\n/core/**/[ab]*.go\n"), ("core/.gitignore", "!*.json\ntools\n")]
_EXTRA = "*.txt\nbench/*.md\n"


@query(r"""WITH p AS (SELECT DISTINCT regexp_replace(replace(path, chr(92), '/'), '^\./', '') AS path FROM files WHERE path IS NOT NULL)
SELECT path FROM p WHERE NOT regexp_matches(path, '(?:^|/)notes/') AND NOT regexp_matches(path, '^core/(?:[^/]+/)*[ab][^/]*\.go$') AND NOT regexp_matches(path, '^core/(?:.*/)?tools(?:/|$)') AND NOT regexp_matches(path, '^bench/[^/]*\.md$')
  AND NOT ends_with(path, '.txt') AND (NOT ends_with(path, '.json') OR starts_with(path, 'core/') OR regexp_matches(path, '(?:^|/)keep\.json$'))""")
def s01_unignored(spark: SparkSession, d: str) -> DataFrame:
    """The paths of all files that nested ignore files leave."""
    from weft.operators.capture import norm_path
    from weft.sources import corpus

    t = read_table(spark, d, "files").select(norm_path(F.col("path")).alias("path")).distinct()
    return corpus.unignored(t, corpus.Ignore(_IGNORED, _EXTRA))


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'CLAUDE.md' WHEN 1 THEN 'AGENTS.md' WHEN 2 THEN '.cursor/rules/' || doc_id || '.mdc' WHEN 3 THEN 'docs/' || doc_id || '.md' WHEN 4 THEN '.clinerules/../' || doc_id || '.md' ELSE '.clinerules/' || doc_id || '.md' END AS path, repeat(text, CASE WHEN doc_id % 7 = 0 THEN 200 ELSE 1 END) AS text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex' WHEN 2 THEN 'cursor' ELSE 'cline' END AS owner, strlen(text) AS bytes FROM t WHERE doc_id % 6 NOT IN (3, 4) AND strlen(text) <= 65536 AND doc_id % 11 <> 0""")
def s24_instruction_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as tracked files, some elsewhere, some outside, some too large, some not UTF-8."""
    from weft.sources import corpus

    t = read_table(spark, d, "documents").where("text IS NOT NULL")
    i = F.col("doc_id")
    path = F.when(i % 6 == 0, "CLAUDE.md").when(i % 6 == 1, "AGENTS.md").when(i % 6 == 2, F.concat(F.lit(".cursor/rules/"), i.cast("string"), F.lit(".mdc"))).when(i % 6 == 3, F.concat(F.lit("docs/"), i.cast("string"), F.lit(".md")))
    path = path.when(i % 6 == 4, F.concat(F.lit(".clinerules/../"), i.cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit(".clinerules/"), i.cast("string"), F.lit(".md")))
    body = F.expr("repeat(text, CASE WHEN doc_id % 7 = 0 THEN 200 ELSE 1 END)")
    broken = F.when(i % 11 == 0, F.lit(bytearray(b"\xff\xfe"))).otherwise(F.lit(bytearray()))
    files_ = t.select("doc_id", path.alias("at"), F.concat(F.encode(body, "UTF-8"), broken).alias("content"))
    return corpus.instruction_files(files_.withColumnRenamed("at", "path"), ["doc_id"]).select("doc_id", "owner", F.octet_length("text").alias("bytes"))
