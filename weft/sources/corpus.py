"""Scanning source trees, hashing, and the difference between two scans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import paths


def scan(spark: SparkSession, root: str, history: str | None = None, exclude: list[str] | None = None, max_bytes: int = paths.MAX_FILE_BYTES) -> DataFrame:
    """``(path, content, length, hash, language, modified)`` of the files below ``root``; paths are relative.

    Hidden and source-free directories, excluded glob patterns and files above ``max_bytes`` are left out; ``history`` names a
    hidden prefix that is kept (S3).  ``content`` is only read where a later step asks for it: without it and ``hash`` the scan lists files.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace(F.col("path"), r"^file:(?://)?", "")
    rel = F.substring(rel, len(base.removeprefix("file://")) + 2, 1_000_000)
    out = raw.where(F.col("length") <= max_bytes).select(rel.alias("path"), "content", "length", F.sha2("content", 256).alias("hash"), F.col("modificationTime").alias("modified"))
    out = out.where(~paths.skipped(F.col("path"), history))
    for pattern in exclude or []:
        from weft.functions.text import glob_match

        out = out.where(~glob_match(paths.file_name(F.col("path")), F.lit(pattern)))
    return out.withColumn("language", paths.language_of(F.col("path")))


#: Names of ignore files, weakest first.
IGNORE_FILES = (".gitignore", ".ignore")


class Ignore:
    """Ignore files as rules: of the patterns that match, the last one of the deepest and strongest file decides.

    ``files`` are (path of the ignore file, its text); ``extra`` is the text of a supplementary file, which counts as one of the
    root and is the weakest.  A pattern with a slash is bound to the file's folder, one that ends in a slash matches folders only, ``!`` takes
    a path back - but nothing below an ignored folder.
    """

    def __init__(self, files: list[tuple[str, str]], extra: str = ""):
        self.rules: list[tuple[str, re.Pattern[str], bool, bool]] = []
        rank = {n: i for i, n in enumerate(IGNORE_FILES)}
        split = [(p.rpartition("/")[0], p.rpartition("/")[2], t) for p, t in files]
        for base, _, text in [("", "", extra)] + sorted(split, key=lambda f: (f[0].count("/") + bool(f[0]), rank.get(f[1], -1), f[0])):
            for line in text.splitlines():
                rule = self._rule(line)
                if rule:
                    self.rules.append((base + "/" if base else "", *rule))
        self._memo: dict[str, bool] = {}

    @staticmethod
    def _rule(line: str) -> tuple[re.Pattern[str], bool, bool] | None:
        text = re.sub(r"(?<!\\)\s+$", "", line)
        if not text or text.startswith("#"):
            return None
        negated = text.startswith("!")
        text = text[negated:]
        folder = text.endswith("/")
        text = text.rstrip("/")
        bound = "/" in text
        text = text.lstrip("/")
        out, i = "", 0
        while i < len(text):
            c = text[i]
            if text.startswith("**/", i) and (i == 0 or text[i - 1] == "/"):
                out, i = out + "(?:[^/]+/)*", i + 3
                continue
            if text[i:] == "**" and (i == 0 or text[i - 1] == "/"):
                out, i = out + ".+", i + 2
                continue
            if c == "*":
                out += "[^/]*"
            elif c == "?":
                out += "[^/]"
            elif c == "[" and (end := text.find("]", i + 2)) > 0:
                inner = text[i + 1 : end]
                out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "") + "]"
                i = end
            elif c == "\\" and i + 1 < len(text):
                i += 1
                out += re.escape(text[i])
            else:
                out += re.escape(c)
            i += 1
        return re.compile(out if bound else f"(?:.*/)?{out}"), negated, folder

    def _matches(self, path: str, is_folder: bool) -> bool:
        for base, pattern, negated, folder in reversed(self.rules):
            if path.startswith(base) and (is_folder or not folder) and pattern.fullmatch(path, len(base)):
                return not negated
        return False

    def folder(self, path: str) -> bool:
        """Whether a folder or one above it is ignored."""
        if path not in self._memo:
            if len(self._memo) > 100_000:
                self._memo.clear()
            above = path.rpartition("/")[0]
            self._memo[path] = bool(above) and self.folder(above) or self._matches(path, True)
        return self._memo[path]

    def file(self, path: str) -> bool:
        """Whether a file is ignored, by itself or with a folder above it."""
        above = path.rpartition("/")[0]
        return bool(above) and self.folder(above) or self._matches(path, False)


def unignored(files: DataFrame, rules: Ignore) -> DataFrame:
    """The rows of ``files(path, ...)`` that no ignore rule leaves out; the rules are a configuration and go along with the function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([p for p in b.column(0).to_pylist() if not rules.file(p)], pa.string())], ["path"])

    kept = files.where("path IS NOT NULL").select("path").distinct().mapInArrow(run, "path string")
    return files.join(kept, "path", "left_semi")


def ignore_rules(listing: DataFrame, extra: str = "", most: int = 10_000) -> Ignore:
    """The ignore files of a scan's ``listing(path, content)``, wherever they lie; more than ``most`` are an error."""
    own = listing.where(paths.file_name(F.col("path")).isin(*IGNORE_FILES)).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    rows = own.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} ignore files")
    return Ignore([(r.path, r.text or "") for r in rows], extra)


def scan_difference(now: DataFrame, before: DataFrame) -> DataFrame:
    """``(path, state)``: what a scan ``now(path, hash)`` finds ``added``, ``changed`` or ``deleted`` since ``before(path, hash)``."""
    a, b = now.select("path", F.col("hash").alias("h_now"), F.lit(1).alias("_a")), before.select("path", F.col("hash").alias("h_before"), F.lit(1).alias("_b"))
    j = a.join(b, "path", "full_outer")
    state = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "deleted").when(~F.col("h_now").eqNullSafe(F.col("h_before")), "changed")
    return j.select("path", state.alias("state")).where("state IS NOT NULL").distinct()


#: Fixed value: bytes of an instruction file at most.
INSTRUCTION_BYTES = 64 * 1024


def instruction_files(tracked: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``(path, owner, text)``, and the columns to ``keep``, of the tracked files ``(path, content)`` that are instructions of an agent.

    The relative path must map to an owner (F10) and stay inside the workspace; files of more than 64 KiB or that aren't valid UTF-8 are skipped.
    """
    owner = paths.owner_of(F.col("path"))
    text = F.col("content").cast("string")
    inside = ~F.col("path").startswith("/") & ~F.array_contains(F.split("path", "/"), "..")
    small = tracked.where(inside & (F.octet_length("content") <= INSTRUCTION_BYTES))
    return small.select(*(keep or []), "path", owner.alias("owner"), text.alias("text")).where(F.col("owner").isNotNull() & F.is_valid_utf8("text"))


def changed_paths(listing: str, ref: str = "HEAD~1") -> list[str]:
    """The paths of a NUL-separated listing of a version-control diff against ``ref``; the engine itself runs no process.

    A ref that begins with ``-`` or holds a control character is refused, as whoever makes the listing passes it to a command.
    """
    if not ref or ref.startswith("-") or any(ord(c) < 32 or ord(c) == 127 for c in ref):
        raise ValueError("not a ref")
    return [p for p in listing.split("\0") if p]


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of ``now(path, hash)`` that are new or have another hash; an anti-join on both."""
    return now.join(before.select("path", "hash").distinct(), ["path", "hash"], "left_anti")


def deleted(now: DataFrame, before: DataFrame) -> DataFrame:
    """Paths of ``before`` that ``now`` hasn't."""
    return before.select("path").distinct().join(now.select("path"), "path", "left_anti")


def upsert(files: DataFrame, new: DataFrame) -> DataFrame:
    """``files`` with the rows of ``new`` in place of those of the same path; the id is a hash of the path and so never changes."""
    fresh = new.withColumn("id", F.xxhash64("path"))
    return files.join(fresh.select("path"), "path", "left_anti").select(*files.columns).unionByName(fresh.select(*files.columns))


def rooted(path: Column, roots: list[str]) -> Column:
    """The root a path lies in, of roots that don't contain each other; null outside all.

    Roots are a configuration.  Those equal to or inside another one are dropped, drives compare without case.
    """
    kept: list[str] = []
    fold = lambda r: r.lower() if r[1:2] == ":" else r
    for r in sorted({x.rstrip("/") for x in roots}, key=lambda r: (len(r), r)):
        if not any(fold(r) == fold(k) or fold(r).startswith(fold(k) + "/") for k in kept):
            kept.append(r)
    out = F.lit(None).cast("string")
    for r in kept:
        p, q = (F.lower(path), r.lower()) if r[1:2] == ":" else (path, r)
        out = F.when((p == q) | p.startswith(q + "/"), r).otherwise(out)
    return out


def folder_needs_pass(events: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, needed)`` of ``events(path, exists, has_source)``: a folder with a source, or with indexed files below it.

    "Below" is a prefix test on paths; instead of comparing every pair, each file is listed under all its parent folders.
    """
    seg = F.split("path", "/")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(seg) - 1, F.lit(1))), lambda i: F.array_join(F.slice(seg, 1, i), "/"))
    below = files.where(F.col("path").contains("/")).select(F.explode(parents).alias("path")).distinct().withColumn("_below", F.lit(True))
    return events.join(below, "path", "left").select("path", (F.col("has_source") & F.col("exists") | F.coalesce("_below", F.lit(False))).alias("needed"))
