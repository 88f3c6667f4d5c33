"""Symbols and references out of source texts ``files(file_id, language, text)``, line by line and inside the JVM.

A syntax tree needs a parser that isn't here: code symbols and comments are found by patterns on lines, an approximation that
is exact on the usual layouts.  Every extractor gives ``(file_id, name, kind, line, col, signature)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import text as T

NAME = r"[A-Za-z_][\w]*"

# Words before "(" that are no calls, in every language and by language.
NO_CALL = "if for while switch return catch".split()
NO_CALL_BY = {
    "rust": "match fn let loop impl mut pub".split(),
    "typescript": "function await typeof super do else new".split(),
    "python": "elif with assert del raise except lambda yield print".split(),
    "go": "func go defer select range".split(),
}
# How a line that defines a function begins.
DEFINES = {
    "rust": r"^\s*(?:pub(?:\(crate\))? |async |pub async )?fn\s+([\w$]+)",
    "typescript": r"^\s*(?:export )?(?:async )?function\s+([\w$]+)",
    "python": r"^\s*(?:async def|def|class)\s+([\w$]+)",
    "go": r"^\s*func\s+(?:\([^)]*\)\s*)?([\w$]+)",
}


def numbered(files: DataFrame) -> DataFrame:
    """``(file_id, language, line, text)``: one row per line, from 1."""
    return files.where("text IS NOT NULL").select("file_id", "language", F.posexplode(T.lines(F.col("text"))).alias("p", "text")).select("file_id", "language", (F.col("p") + 1).alias("line"), "text")


def preview(c: Column, n: int = 100, more: str = "…") -> Column:
    """The first n characters, with a sign if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(more))).otherwise(c)


def markdown_headings(files: DataFrame) -> DataFrame:
    """Lines of one to six ``#`` and a non-empty rest; col = level + 1, signature = the next non-blank line, null if a heading.

    The lines after each are searched inside the file's array of lines: no window, no shuffle.
    """
    ls = F.transform(T.lines(F.col("text")), lambda x, i: F.struct((i + 1).alias("line"), x.alias("x")))
    heads = F.filter(ls, lambda s: s["x"].rlike(r"^\s*#{1,6}[^#].*$") & (T.trim(F.regexp_replace(s["x"], r"^\s*#{1,6}", "")) != ""))
    rows = files.where("text IS NOT NULL").select("file_id", ls.alias("ls"), F.explode(heads).alias("h"))
    after = F.get(F.filter(F.slice(F.col("ls"), F.col("h.line") + 1, F.size("ls")), lambda s: T.trim(s["x"]) != ""), F.lit(0))["x"]
    level = F.length(F.regexp_extract(F.col("h.x"), r"^\s*(#{1,6})", 1))
    sig = F.when(~F.trim(after).startswith("#"), preview(T.trim(after)))
    return rows.select("file_id", T.trim(F.regexp_replace(F.col("h.x"), r"^\s*#{1,6}", "")).alias("name"), F.lit("module").alias("kind"), F.col("h.line").cast("int").alias("line"), (level + 1).alias("col"), sig.alias("signature"))


def json_keys(files: DataFrame) -> DataFrame:
    """The top-level keys of an object; line = the first that holds the key in quotes, else 1.  Anything else gives none."""
    rows = files.where("text IS NOT NULL").select("file_id", "text", F.explode(F.json_object_keys("text")).alias("name"))
    where = F.array_position(F.transform(T.lines(F.col("text")), lambda x: x.contains(F.concat(F.lit('"'), F.col("name"), F.lit('"')))), F.lit(True))
    return rows.select("file_id", "name", F.lit("property").alias("kind"), F.greatest(where, F.lit(1)).cast("int").alias("line"), F.lit(1).alias("col"), F.lit(None).cast("string").alias("signature"))


def jsonl_keys(files: DataFrame) -> DataFrame:
    """The keys of the first non-blank line."""
    first = F.get(F.filter(T.lines(F.col("text")), lambda x: T.trim(x) != ""), F.lit(0))
    return json_keys(files.withColumn("text", first)).withColumn("line", F.lit(1))


def tag_names(files: DataFrame) -> DataFrame:
    """Distinct element names with the line of their first opening tag; end tags, comments and declarations are no elements."""
    tags = F.flatten(F.transform(T.lines(F.col("text")), lambda x, i: F.transform(F.regexp_extract_all(x, F.lit(r"<([A-Za-z][\w.:-]*)"), F.lit(1)), lambda t: F.struct((i + 1).cast("int").alias("line"), t.alias("name")))))
    found = files.where("text IS NOT NULL").select("file_id", F.explode(tags).alias("t")).select("file_id", "t.*")
    return found.groupBy("file_id", "name").agg(F.min("line").alias("line")).select("file_id", "name", F.lit("module").alias("kind"), "line", F.lit(1).alias("col"), F.lit(None).cast("string").alias("signature"))


def parquet_schema(spark, path: str) -> DataFrame:
    """One module symbol with row and column counts, one property per field; only footers are read."""
    df = spark.read.parquet(path)
    rows = [("Parquet Schema", "module", 1, f"{df.count()} rows, {len(df.columns)} columns")] + [(f.name, "property", i + 2, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "name string, kind string, line int, signature string")


_CODE = {
    "rust": [("function", r"^\s*(?:pub(?:\([a-z]+\))? )?(?:async )?fn\s+(\w+)"), ("struct", r"^\s*(?:pub )?struct\s+(\w+)"), ("enum", r"^\s*(?:pub )?enum\s+(\w+)"), ("interface", r"^\s*(?:pub )?trait\s+(\w+)"), ("class", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+ for )?(\w+)")],
    "typescript": [("function", r"^\s*(?:export )?(?:default )?(?:async )?function\s+(\w+)"), ("class", r"^\s*(?:export )?(?:abstract )?class\s+(\w+)"), ("interface", r"^\s*(?:export )?interface\s+(\w+)"), ("type", r"^\s*(?:export )?type\s+(\w+)\s*=")],
    "python": [("function", r"^\s*(?:async )?def\s+(\w+)"), ("class", r"^\s*class\s+(\w+)")],
    "go": [("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("type", r"^\s*type\s+(\w+)")],
}


def code_symbols(files: DataFrame) -> DataFrame:
    """Declarations by line; col is 1 + the indent, exported where Rust says ``pub`` or TypeScript ``export``; other languages give none."""
    rows = numbered(files.withColumn("language", F.when(F.col("language") == "javascript", "typescript").otherwise(F.col("language"))).where(F.col("language").isin(*_CODE)))
    name, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for lang, patterns in reversed(_CODE.items()):
        for k, p in reversed(patterns):
            hit = (F.col("language") == lang) & F.col("text").rlike(p)
            name, kind = F.when(hit, F.regexp_extract("text", p, 1)).otherwise(name), F.when(hit, k).otherwise(kind)
    out = rows.select("file_id", name.alias("name"), kind.alias("kind"), F.col("line").cast("int").alias("line"), (F.length(F.regexp_extract("text", r"^(\s*)", 1)) + 1).alias("col"), F.trim("text").alias("signature"), F.col("text").rlike(r"^\s*(?:pub\b|export\b)").alias("is_exported"))
    return out.where("name IS NOT NULL")


def dependencies(files: DataFrame) -> DataFrame:
    """Unresolved references ``(file_id, line, name, kind)`` of Rust, TypeScript/JavaScript, Python and Go.

    ``use``, named and star imports, ``require`` and ``from … import`` give imports; ``new X(`` a type reference and a call; ``a::b(``
    and ``a.b(`` a call of b, ``name(`` one of name - so a qualified call comes twice, as edges are a set later.  The name a line
    defines and control words are no calls; Python lines that import are nothing else.
    """
    lang = F.when(F.col("language") == "javascript", "typescript").otherwise(F.col("language"))
    rows = numbered(files.withColumn("language", lang).where(lang.isin(*DEFINES)))
    x, is_ = F.col("text"), lambda v: F.col("language") == v
    none = F.array().cast("array<string>")
    every = lambda p: F.regexp_extract_all(x, F.lit(p), F.lit(1))
    names = lambda c: F.filter(F.transform(F.split(c, ","), lambda s: F.regexp_replace(F.trim(F.substring_index(s, " as ", 1)), r"^[()\s]+|[()\s]+$", "")), lambda s: (s != "") & (s != "*"))
    use = F.regexp_extract(x, r"^\s*use\s+([\w:]+)", 1)
    named = F.regexp_extract(x, r"import\s+\{\s*([^}]+?)\s*\}\s+from\s+['\"][^'\"]+['\"]", 1)
    star = F.regexp_extract(x, r"import\s+\*\s+as\s+(\w+)\s+from\s+['\"][^'\"]+['\"]", 1)
    need = F.regexp_extract(x, r"(?:const|var|let)\s+(\w+)\s*=\s*require\(['\"].*?['\"]\)", 1)
    pulled = F.regexp_extract(x, r"^\s*from\s+[\w.]+\s+import\s+(.+)$", 1)
    imports = F.when(is_("rust"), F.when(use != "", F.array(F.substring_index(use, "::", -1))).otherwise(none)).when(is_("typescript"), F.filter(F.concat(F.transform(F.split(named, ","), lambda s: F.trim(s)), F.array(star, need)), lambda s: s != "")).when(is_("python") & (pulled != ""), names(pulled)).otherwise(none)
    defined = F.lit("")
    banned = F.lit(False)
    for k, p in DEFINES.items():
        defined = F.when(is_(k), F.regexp_extract(x, p, 1)).otherwise(defined)
    calls = F.filter(every(rf"({NAME})\s*\("), lambda n: (n != F.col("_def")) & ~n.isin(NO_CALL) & ~F.array_contains(F.col("_ban"), n))
    for k, words in NO_CALL_BY.items():
        banned = F.when(is_(k), F.array(*[F.lit(w) for w in words])).otherwise(banned) if k != "rust" else F.when(is_(k), F.array(*[F.lit(w) for w in words])).otherwise(none)
    qualified = F.when(is_("rust"), every(r"[\w_]+::([\w_]+)\s*\(")).when(is_("typescript"), every(r"[\w_]+\.([\w_]+)\s*\(")).otherwise(none)
    built = F.when(is_("typescript"), every(rf"new\s+({NAME})\s*\(")).otherwise(none)
    silent = is_("python") & ((pulled != "") | F.ltrim(x).startswith("import "))
    tagged = lambda c, kind: F.transform(c, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind")))
    r = rows.withColumns({"_def": defined, "_ban": banned})
    found = F.concat(tagged(imports, "import"), F.when(silent, F.array().cast("array<struct<name:string,kind:string>>")).otherwise(F.concat(tagged(qualified, "function_call"), tagged(built, "type_reference"), tagged(calls, "function_call"))))
    return r.select("file_id", F.col("line").cast("int").alias("line"), F.inline(found)).where("name <> ''")


OFFICE = "name string, kind string, line int, signature string"


def office_symbols(files: DataFrame) -> DataFrame:
    """Symbols of ``binaryFile`` rows (path, content) of Word, slide and sheet files; broken files give none.

    Documents give one symbol with a preview of 200 characters, presentations one per slide (slide names sort as strings), workbooks one
    per sheet.  Archives need a library, so this one runs in Arrow batches with the standard library.
    """
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    import pandas as pd

    def texts(xml: bytes, tag: str) -> str:
        return " ".join(e.text for e in ElementTree.fromstring(xml).iter() if e.tag.endswith("}" + tag) and e.text)

    def short(s: str) -> str:
        return s[:200] + "..." if len(s) > 200 else s

    def read(path: str, content: bytes) -> list[tuple]:
        try:
            z = zipfile.ZipFile(io.BytesIO(content))
            if path.endswith(".docx"):
                return [(path, path.rsplit("/", 1)[-1], "module", 1, short(texts(z.read("word/document.xml"), "t")))]
            if path.endswith(".pptx"):
                slides = sorted(n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n))
                return [(path, f"Slide {i + 1}", "module", i + 1, short(texts(z.read(n), "t"))) for i, n in enumerate(slides)]
            if path.endswith(".xlsx"):
                book = ElementTree.fromstring(z.read("xl/workbook.xml"))
                return [(path, e.get("name"), "module", i + 1, None) for i, e in enumerate(x for x in book.iter() if x.tag.endswith("}sheet"))]
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            pass
        return []

    def run(frames):
        for f in frames:
            rows = [r for p, c in zip(f.path, f.content) if c is not None for r in read(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "line", "signature"])

    return files.select("path", "content").mapInPandas(run, "path string, " + OFFICE)


def pdf_symbols(files: DataFrame) -> DataFrame:
    """One symbol per page of ``binaryFile`` rows (path, content), the first with a preview of the text shown by Tj, ', " and TJ.

    Only plain and deflated content streams with literal strings are read; anything else gives pages without a preview, broken files nothing.
    """
    import re
    import zlib

    import pandas as pd

    stream = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
    shown = re.compile(rb"\[((?:\\.|[^\]\\])*)\]\s*TJ|\(((?:\\.|[^()\\])*)\)\s*(?:Tj|'|\")", re.S)
    literal = re.compile(rb"\(((?:\\.|[^()\\])*)\)", re.S)

    def text_of(content: bytes) -> str:
        out = []
        for s in stream.findall(content):
            try:
                s = zlib.decompress(s)
            except zlib.error:
                pass
            for array, one in shown.findall(s):
                parts = literal.findall(array) if array else [one]
                out.append(b"".join(re.sub(rb"\\(.)", rb"\1", p, flags=re.S) for p in parts).decode("latin-1"))
        return " ".join(out)

    def run(frames):
        for f in frames:
            rows = []
            for p, c in zip(f.path, f.content):
                c = bytes(c) if c is not None else b""
                if c.startswith(b"%PDF"):
                    t = text_of(c)
                    pages = len(re.findall(rb"/Type\s*/Page(?![s\w])", c))
                    rows += [(p, f"Page {i + 1}", "module", i + 1, (t[:200] + "..." if len(t) > 200 else t) if i == 0 else None) for i in range(pages)]
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "line", "signature"])

    return files.select("path", "content").mapInPandas(run, "path string, " + OFFICE)
