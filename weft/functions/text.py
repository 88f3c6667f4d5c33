"""Text functions as Column expressions: everything stays in the JVM and inside generated code.

"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that carry no meaning in rule texts.
STOPWORDS = "a an and are as at be by for from in into is it of on or the to with this that these those".split()

# Shapes of keys, and names whose assigned value is secret.
KEY_SHAPES = r"sk-[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{35}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|xox[abposr]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16}"
SECRET_NAMES = "api_key|api-key|apikey|secret|token|password|passwd|access_key|access-key"
REDACTED = "[REDACTED]"

CJK = r"\u3040-\u309f\u30a0-\u30ff\u4e00-\u9fff"


def lines(c: Column) -> Column:
    r"""The lines of a text; ``\r\n`` ends a line like ``\n``, a final line end opens no empty line."""
    unix = F.regexp_replace(c, r"\r\n", "\n")
    return F.split(F.regexp_replace(unix, r"\n\z", ""), "\n")


def without_blank(a: Column) -> Column:
    """An array without empty strings."""
    return F.filter(a, lambda x: x != "")


def identifier_terms(c: Column) -> Column:
    """Split at non-alphanumerics and before an upper-case letter after one that isn't; lower case."""
    humps = F.regexp_replace(c, r"([^\p{Lu}])(\p{Lu})", "$1 $2")
    return without_blank(F.split(F.lower(humps), r"[^\p{L}\p{N}]+"))


def document_terms(c: Column) -> Column:
    """Runs of letters or digits of at least two *bytes* (measured before lower-casing), lower-cased."""
    long_enough = F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda x: F.octet_length(x) >= 2)
    return F.transform(long_enough, F.lower)


def recall_terms(c: Column) -> Column:
    """Runs of two or more of ``[a-z0-9_]`` in lower case, and single characters and pairs of CJK runs; repeats stay."""
    low = F.lower(c)
    ascii_runs = F.regexp_extract_all(low, F.lit("([a-z0-9_]{2,})"), F.lit(1))
    runs = F.regexp_extract_all(low, F.lit(f"([{CJK}]+)"), F.lit(1))
    pieces = lambda n: F.flatten(F.transform(runs, lambda r: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substring(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))))
    return F.concat(ascii_runs, pieces(1), pieces(2))


def rule_terms(c: Column) -> Column:
    """ASCII word runs without outer underscores, at least two long and no stopword; pairs of CJK runs (a lone one as it is)."""
    ascii_runs = F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z0-9_]+)"), F.lit(1)), lambda w: F.regexp_replace(F.lower(w), "^_+|_+$", ""))
    kept = F.filter(ascii_runs, lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS))
    runs = F.regexp_extract_all(c, F.lit(f"([{CJK}]+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))
    return F.concat(kept, pairs)


def redact_secrets(c: Column) -> Column:
    """Keys of known shapes, then assigned values of 16 or more characters with a digit that are no call; idempotent."""
    keys = F.regexp_replace(c, KEY_SHAPES, REDACTED)
    assigned = rf"((?i:\b(?:{SECRET_NAMES})\b)[ \t]*[:=][ \t]*[\"']?)(?=[A-Za-z_./+\-]*[0-9])[A-Za-z0-9_./+\-]{{16,}}+(?!\()"
    return F.regexp_replace(keys, assigned, "$1" + REDACTED.replace("[", r"\[").replace("]", r"\]"))


def truncate_chars(c: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(c, 1, n)


def fold(c: Column, old: Column, n: int = 120) -> Column:
    """Texts of old records longer than n characters are cut to n - 1 and an ellipsis; idempotent."""
    return F.when(old & (F.length(c) > n), F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def sanitize(c: Column) -> Column:
    r"""Drop control characters except ``\n`` and ``\t``."""
    return F.regexp_replace(c, r"[\p{Cc}&&[^\n\t]]", "")


_BREAK = r"^\s*(?:-\s*){3,}$|^\s*(?:\*\s*){3,}$|^\s*(?:_\s*){3,}$|^\s*$"


def trim_breaks(c: Column) -> Column:
    """Drop blank and thematic-break lines at both ends of a body."""
    ls = lines(c)
    keep = F.transform(ls, lambda x: ~x.rlike(_BREAK))
    first = F.array_position(keep, F.lit(True))
    last = F.size(ls) - F.array_position(F.reverse(keep), F.lit(True)) + 1
    return F.when(c.isNull(), c).when(first == 0, "").otherwise(F.array_join(F.slice(ls, F.greatest(first, F.lit(1)).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")), "\n"))


def trim(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def collapse_blank(c: Column) -> Column:
    """X11: a run of blank lines becomes one empty line; the text loses its trailing white space."""
    unix = F.regexp_replace(c, r"\r\n", "\n")
    return F.regexp_replace(F.regexp_replace(unix, r"(?m)^[ \t\r]*\n(?:[ \t\r]*\n)*", "\n"), r"(?U)\s+\z", "")


_KEPT = r"^\s*(?:#|[-*+>] |\p{N})|^\s*(?:---|\*\*\*|___)\s*$"


def markdown_compress(c: Column) -> Column:
    """Keep headings, bullets, quotations, rules, lines that start with a number, and fenced code; then X11."""
    step = lambda acc, x: F.struct(
        F.when(F.trim(x).startswith("```"), ~acc["code"]).otherwise(acc["code"]).alias("code"),
        F.when(F.trim(x).startswith("```") | acc["code"] | x.rlike(_KEPT), F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"),
    )
    start = F.struct(F.lit(False).alias("code"), F.array().cast("array<string>").alias("kept"))
    return collapse_blank(F.array_join(F.aggregate(lines(c), start, step)["kept"], "\n"))


#: Comments by language; a line-oriented stand-in for a syntax tree, strings with comment signs included.
_SLASH = r"(?s)/\*.*?\*/|(?m:(?<!:)//[^\n]*$)"
_HASH = r"(?m)^\s*#[^\n]*$|(?<=\s)#[^\n]*$"
COMMENTS = {"rust": _SLASH, "typescript": _SLASH, "javascript": _SLASH, "go": _SLASH, "python": _HASH}


def compact(c: Column, language: Column) -> Column:
    """Comments off (by pattern, for the languages that have a grammar), then X11."""
    out = F.when(language == "python", F.regexp_replace(c, _HASH, "")).when(language.isin("rust", "typescript", "javascript", "go"), F.regexp_replace(c, _SLASH, "")).otherwise(c)
    return collapse_blank(out)


_DECLARES = r"^\s*(?:export\s+|pub(?:\([a-z]+\))?\s+|default\s+|abstract\s+|async\s+)*(?:fn|struct|enum|impl|trait|class|interface|type|function|def|func)\b"


def skeleton(c: Column, language: Column) -> Column:
    """Only the lines that declare something, with the body elided; other languages give the first line."""
    ls = lines(c)
    declared = F.transform(F.filter(ls, lambda x: x.rlike(_DECLARES)), lambda x: F.concat(F.regexp_replace(x, r"\s*[{:]?\s*$", ""), F.when(language == "python", " ...").otherwise(" { ... }")))
    return F.when(language.isin(*COMMENTS), F.array_join(declared, "\n")).otherwise(F.get(ls, F.lit(0)))


def compress(c: Column, language: Column, level: Column) -> Column:
    """Level 0 as it is, 1 compact, 2 skeleton (Markdown by X12); any other level as 0."""
    return F.when(level == 1, compact(c, language)).when((level == 2) & (language == "markdown"), markdown_compress(c)).when(level == 2, skeleton(c, language)).otherwise(c)


def epoch_minutes(ms: Column) -> Column:
    """``YYYY-MM-DD HH:MM`` in UTC of epoch milliseconds (the session's zone is UTC)."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm")


def relativize(c: Column, root: str) -> Column:
    """The path below ``root``; other paths stay."""
    p = F.replace(c, F.lit("\\"), F.lit("/"))
    pre = root.rstrip("/") + "/"
    return F.when(p.startswith(pre), F.substring(p, len(pre) + 1, 1_000_000)).otherwise(p)


def recency(age_days: Column, half_life: float = 90.0) -> Column:
    """Halves every ``half_life`` days; negative ages count as 0."""
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life)


def saturated(score: Column) -> Column:
    """S / (s + 2)."""
    return score / (score + 2)


def agent_id(c: Column) -> Column:
    """everything but ASCII letters, digits, ``_`` and ``-`` becomes ``_``."""
    return F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")


def prefix_match(c: Column, prefix: str) -> Column:
    """case-insensitive prefix."""
    return F.lower(c).startswith(prefix.lower())


def glob_match(path: Column, pattern: Column) -> Column:
    """F8: ``*`` matches all, ``*x`` a suffix, ``x*`` a prefix, anything else itself."""
    return (
        F.when(pattern == "*", True)
        .when(pattern.startswith("*"), F.endswith(path, F.substr(pattern, F.lit(2))))
        .when(pattern.endswith("*"), F.startswith(path, F.substr(pattern, F.lit(1), F.length(pattern) - 1)))
        .otherwise(path == pattern)
    )


def like_anywhere(c: Column, query: str) -> Column:
    """case-insensitive substring in which ``%`` and ``_`` of the query are wildcards."""
    return F.lower(c).like("%" + query.lower().replace("\\", "\\\\") + "%")


def capped_list(a: Column, n: int = 5) -> Column:
    """The first n entries, and how many more there are."""
    head = F.array_join(F.slice(a, 1, n), ", ")
    return F.when(F.size(a) > n, F.concat(head, F.lit(", … (+"), (F.size(a) - n).cast("string"), F.lit(" more)"))).otherwise(head)


# ----------------------------------------------------------------- transcripts


def content_text(c: Column) -> Column:
    """The text of a message's content, given as JSON: a string, or an array of blocks.

    Text blocks that are nothing but one reminder are dropped, the rest joined by line ends and trimmed;
    nothing left gives null.
    """
    blocks = F.from_json(c, "array<struct<type:string,text:string>>")
    texts = F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull() & ~trim(b["text"]).rlike(r"(?s)\A<system-reminder>(?:(?!</system-reminder>).)*</system-reminder>\z"))
    joined = F.when(F.size(texts) > 0, F.array_join(F.transform(texts, lambda b: b["text"]), "\n"))
    plain = F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")
    text = F.when(F.ltrim(c).startswith("["), joined).when(F.ltrim(c).startswith('"'), plain)
    return F.when(trim(text) != "", trim(text))


# ----------------------------------------------------------------- Markdown sections


def rule_sections(text: Column) -> Column:
    """``array<struct<heading, text, hash>>`` of an instruction file.

    Front matter is dropped; headings are lines of one to three ``#`` and a space outside fenced code;
    bodies are sanitised, trimmed and freed of thematic breaks, empty ones dropped.  One left fold over
    the lines carries the fence and the open section.
    """
    ls = lines(text)
    second = F.array_position(F.slice(ls, 2, 1_000_000), F.lit("---"))
    body = F.when((F.get(ls, F.lit(0)) == "---") & (second > 0), F.slice(ls, (second + 2).cast("int"), 1_000_000)).otherwise(ls)
    marker = lambda x: F.regexp_extract(x, r"^ {0,3}(```|~~~)", 1)
    heading = lambda x: F.regexp_extract(x, r"^#{1,3} (.*)$", 1)
    empty = F.array().cast("array<struct<heading:string,lines:array<string>>>")
    start = F.struct(F.lit("").alias("fence"), F.lit("").alias("heading"), F.array().cast("array<string>").alias("lines"), empty.alias("done"))
    close = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["heading"].alias("heading"), acc["lines"].alias("lines"))))

    def step(acc: Column, x: Column) -> Column:
        m, opened = marker(x), acc["fence"] != ""
        head = ~opened & (m == "") & x.rlike("^#{1,3} ")
        return F.struct(
            F.when(opened, F.when(m == acc["fence"], "").otherwise(acc["fence"])).otherwise(m).alias("fence"),
            F.when(head, sanitize(F.trim(F.regexp_replace(heading(x), "[# ]+$", "")))).otherwise(acc["heading"]).alias("heading"),
            F.when(head, F.array().cast("array<string>")).otherwise(F.concat(acc["lines"], F.array(x))).alias("lines"),
            F.when(head, close(acc)).otherwise(acc["done"]).alias("done"),
        )

    parts = F.aggregate(body, start, step, close)
    shaped = F.transform(parts, lambda p: F.struct(p["heading"].alias("heading"), trim_breaks(trim(sanitize(F.array_join(p["lines"], "\n")))).alias("text")))
    kept = F.filter(shaped, lambda p: p["text"] != "")
    return F.transform(kept, lambda p: F.struct(p["heading"].alias("heading"), p["text"].alias("text"), F.sha2(F.concat(p["heading"], F.lit("\n"), p["text"]), 256).alias("hash")))
