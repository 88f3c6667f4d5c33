"""Roll-ups over files, symbols, edges and tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import paths


def stats(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts."""
    one = lambda df, n: df.agg(F.count("*").alias(n))
    rows = [one(df, "n").select(F.lit(n).alias("what"), "n") for df, n in ((files, "files"), (nodes, "nodes"), (edges, "edges"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def symbols_per_file(nodes: DataFrame) -> DataFrame:
    """A2."""
    return nodes.groupBy("file_id").agg(F.count("*").alias("symbols"))


def languages(files: DataFrame) -> DataFrame:
    """A3: files per language, most first, names break ties."""
    return files.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")


def workspace_tokens(files: DataFrame) -> DataFrame:
    """A4: one row: a quarter of all bytes."""
    return files.agg(F.floor(F.coalesce(F.sum("char_count"), F.lit(0)) / 4).alias("tokens"))


def token_usage(calls: DataFrame) -> DataFrame:
    """A5, K7, E5: one row of ``calls(sent, saved)``: sums, count, average sent, efficiency in whole percent; zero-safe."""
    s = calls.agg(F.coalesce(F.sum("sent"), F.lit(0)).cast("long").alias("sent"), F.coalesce(F.sum("saved"), F.lit(0)).cast("long").alias("saved"), F.count("*").alias("queries"))
    all_ = F.col("sent") + F.col("saved")
    return s.select("sent", "saved", "queries", F.when(F.col("queries") > 0, F.expr("sent div queries")).otherwise(0).cast("long").alias("average"), F.concat(F.when(all_ > 0, F.expr("(saved * 100) div (sent + saved)")).otherwise(0).cast("string"), F.lit("%")).alias("efficiency"))


def file_types(files: DataFrame) -> DataFrame:
    """Files per extension, ``unknown`` without one."""
    ext = paths.extension(F.col("path"))
    return files.groupBy(F.when(ext == "", "unknown").otherwise(ext).alias("ext")).agg(F.count("*").alias("n"))


def top_directories(files: DataFrame, n: int = 5) -> DataFrame:
    """The first path segments with most files."""
    return files.groupBy(F.substring_index("path", "/", 1).alias("dir")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dir").limit(n)


def top_files(files: DataFrame, nodes: DataFrame, n: int = 10) -> DataFrame:
    """The files with most symbols, paths break ties."""
    return files.join(symbols_per_file(nodes).withColumnRenamed("file_id", "id"), "id").select("path", "symbols").orderBy(F.desc("symbols"), "path").limit(n)


def project(files: DataFrame, nodes: DataFrame, edges: DataFrame, n: int = 10) -> dict[str, DataFrame]:
    """The parts of an overview of ``files(id, path, language)``, ``nodes(file_id, name, kind, is_exported)`` and ``edges``.

    ``stats(what, n)``, ``languages(language, n)``, ``top_files(path, symbols)``, ``files(path, language, symbols)`` with files without symbols,
    and ``exported(path, name, kind)``.
    """
    per = symbols_per_file(nodes).withColumnRenamed("file_id", "id")
    listed = files.join(per, "id", "left").select("path", "language", F.coalesce("symbols", F.lit(0)).alias("symbols"))
    out = nodes.where("is_exported").join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", "name", "kind")
    return {"stats": stats(files, nodes, edges), "languages": languages(files), "top_files": top_files(files, nodes, n), "files": listed, "exported": out.orderBy("path", "name", "kind")}


def diff_context(changed: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Changed paths with language and symbol count; unindexed ones are ``unknown`` with 0."""
    per = symbols_per_file(nodes).withColumnRenamed("file_id", "id")
    f = files.select("path", "language", "id", F.lit(True).alias("_known")).join(per, "id", "left")
    j = changed.select("path").distinct().join(f, "path", "left")
    return j.select("path", F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("_known", F.lit(False)).alias("indexed"))


def file_summary(files: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """Symbols by kind of one file."""
    return files.where(F.col("path") == path).select(F.col("id").alias("file_id")).join(nodes, "file_id").groupBy("kind").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def latest_activity(*stores: DataFrame) -> DataFrame:
    """The greatest ``timestamp`` over all stores, null without any; each store is reduced before the union."""
    out = None
    for s in stores:
        one = s.agg(F.max("timestamp").alias("latest"))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.max("latest").alias("latest"))


def symbol(nodes: DataFrame, files: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """All symbols of a name, in one file if ``path`` is indexed; an unknown path falls back to all files."""
    hits = nodes.where(F.col("name") == name)
    if path is None:
        return hits
    own = files.where(F.col("path") == path).select(F.col("id").alias("file_id"))
    return hits if own.isEmpty() else hits.join(own, "file_id", "left_semi")
