"""Path functions as Column expressions: languages, owners, skipping, normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension (case counts), directories that hold no sources.
LANGUAGES = {
    "rust": "rs", "typescript": "ts tsx", "javascript": "js jsx", "python": "py", "go": "go", "java": "java", "c": "c h",
    "cpp": "cpp cc cxx hpp", "csharp": "cs", "ruby": "rb", "php": "php", "bash": "sh bash", "sql": "sql", "html": "html htm",
    "css": "css scss less", "json": "json", "jsonl": "jsonl", "yaml": "yaml yml", "xml": "xml", "markdown": "md",
    "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "pdf": "pdf", "parquet": "parquet",
}
SKIPPED = ("node_modules", "venv", "__pycache__", "coverage", "vendor", "out")
MAX_FILE_BYTES = 5 * 1024 * 1024

# Instruction files and the agent each belongs to.
OWNERS = {
    "CLAUDE.md": "claude-code", ".claude/CLAUDE.md": "claude-code", "AGENTS.md": "codex", "GEMINI.md": "gemini-cli",
    ".github/copilot-instructions.md": "github-copilot", "CONVENTIONS.md": "aider", ".clinerules": "cline", ".windsurfrules": "windsurf",
}


def slashes(c: Column) -> Column:
    r"""``\`` as ``/``."""
    return F.replace(c, F.lit("\\"), F.lit("/"))


def file_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The extension of the file name without its dot; "" if there is none (a leading dot opens no extension)."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def language_of(path: Column) -> Column:
    """The language by extension, ``unknown`` otherwise; null for a null path."""
    pairs = [F.lit(x) for lang, exts in LANGUAGES.items() for e in exts.split() for x in (e, lang)]
    return F.when(path.isNotNull(), F.coalesce(F.try_element_at(F.create_map(*pairs), extension(path)), F.lit("unknown")))


def skipped(path: Column, history: str | None = None) -> Column:
    """Whether a relative path lies in a hidden or source-free directory; ``history`` is a prefix that never does."""
    parts = F.split(slashes(path), "/")
    hidden = F.exists(parts, lambda s: s.startswith(".") | s.isin(*SKIPPED))
    return F.when(slashes(path).startswith(history), False).otherwise(hidden) if history else hidden


def owner_of(path: Column) -> Column:
    """the agent that reads an instruction file; null for other files, absolute paths and paths with ``..``."""
    p = slashes(path)
    outside = p.startswith("/") | (F.substring(p, 2, 1) == ":") | F.array_contains(F.split(p, "/"), "..")
    out = F.when(outside, None)
    for name, owner in OWNERS.items():
        out = out.when(p == name, owner)
    return out.when(p.startswith(".clinerules/") & p.endswith(".md"), "cline").when(p.startswith(".cursor/rules/") & (p.endswith(".md") | p.endswith(".mdc")), "cursor")


def folded(segments: Column) -> Column:
    """``.`` and empty segments dropped, ``..`` taking one back; null where it would climb above the root."""
    start = F.struct(F.array().cast("array<string>").alias("a"), F.lit(True).alias("ok"))
    step = lambda acc, s: F.struct(
        F.when((s == "") | (s == "."), acc["a"]).when(s == "..", F.slice(acc["a"], 1, F.greatest(F.size(acc["a"]) - 1, F.lit(0)))).otherwise(F.concat(acc["a"], F.array(s))).alias("a"),
        (acc["ok"] & ~((s == "..") & (F.size(acc["a"]) == 0))).alias("ok"),
    )
    done = F.aggregate(segments, start, step)
    return F.when(done["ok"], done["a"])


def absolute(path: Column) -> Column:
    r"""An absolute path in one spelling; null if it isn't absolute or climbs out.

    Verbatim prefixes (``\\?\``) are removed, drive letters upper-cased, shares keep ``//``.
    """
    s = slashes(path)
    plain = F.when(s.rlike(r"^//\?/[A-Za-z]:/"), F.substring(s, 5, 1_000_000)).when(s.rlike(r"^//\?/(?i:unc)/[^/]"), F.concat(F.lit("//"), F.substring(s, 9, 1_000_000))).when(s.startswith("//?/"), None).otherwise(s)
    drive, share = plain.rlike("^[A-Za-z]:/"), plain.rlike("^//[^/]") | (plain == "//")
    prefix = F.when(drive, F.concat(F.upper(F.substring(plain, 1, 1)), F.lit(":/"))).when(share, "//").when(plain.startswith("/"), "/")
    rest = F.when(drive, F.substring(plain, 4, 1_000_000)).when(share, F.substring(plain, 3, 1_000_000)).otherwise(F.substring(plain, 2, 1_000_000))
    parts = folded(F.split(rest, "/"))
    return F.when(prefix.isNotNull() & parts.isNotNull() & ~((prefix == "//") & (F.size(parts) == 0)), F.concat(prefix, F.array_join(parts, "/")))


def private_place(path: Column, home: str) -> Column:
    """Whether a path lies in a protected folder of ``home`` (hidden, AppData or Library, but not the temporary one)."""
    inside = path.startswith(home.rstrip("/") + "/")
    seg = F.split(F.substring(path, len(home.rstrip("/")) + 2, 1_000_000), "/")
    drive = len(home) > 1 and home[1] == ":"
    same = (lambda c, w: F.lower(c) == w.lower()) if drive else (lambda c, w: c == w)
    at = lambda i: F.get(seg, F.lit(i))
    protected = at(0).startswith(".") | same(at(0), "AppData") | same(at(0), "Library")
    temp = same(at(0), "AppData") & F.coalesce(same(at(1), "Local"), F.lit(False)) & F.coalesce(same(at(2), "Temp"), F.lit(False))
    return inside & protected & ~temp
