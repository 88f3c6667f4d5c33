"""Tables and files that can't be read are moved aside, never overwritten and never silently skipped."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.runtime import cut, new_path
from weft.sources.corpus import rooted, upsert
from weft.sources.store import append_history, read_memory

MARKER = ".recovered"


def _files(spark: SparkSession, path: str):
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark._jsc.hadoopConfiguration()), of


def quarantine(spark: SparkSession, path: str, stamp_ms: int) -> str:
    """Move a file or table aside as ``<path>.corrupt-<stamp>``; an older one of the same time is an error."""
    fs, of = _files(spark, path)
    to = f"{path.rstrip('/')}.corrupt-{stamp_ms}"
    if fs.exists(of(to)) or not fs.rename(of(path), of(to)):
        raise RuntimeError(f"{to} can't be made")
    return to


def open_table(spark: SparkSession, path: str, schema: str, stamp_ms: int, readable: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """The table at ``path``, empty if there is none; one that can't be read goes to quarantine and leaves a marker.

    ``readable`` reads what has to be readable and raises if it isn't; by default all rows are counted with the given schema.
    """
    fs, of = _files(spark, path)
    if not fs.exists(of(path)):
        return spark.createDataFrame([], schema)
    try:
        df = spark.read.schema(schema).parquet(path)
        (readable or (lambda t: t.select([F.max(F.col(c).isNull()) for c in t.columns]).collect()))(df)
        return df
    except (PySparkException, Py4JJavaError):
        quarantine(spark, path, stamp_ms)
        out = fs.create(of(path.rstrip("/") + MARKER), True)
        out.write(bytearray(str(stamp_ms).encode()))
        out.close()
        return spark.createDataFrame([], schema)


def recovered_at(spark: SparkSession, path: str) -> int | None:
    """When the table at ``path`` was last rebuilt after a corruption, until a full pass clears the marker."""
    fs, of = _files(spark, path)
    marker = path.rstrip("/") + MARKER
    return int(spark.read.text(marker).first()[0]) if fs.exists(of(marker)) else None


def full_pass_done(spark: SparkSession, path: str) -> None:
    """A full pass rebuilt the table, so nothing is missing any more."""
    fs, of = _files(spark, path)
    fs.delete(of(path.rstrip("/") + MARKER), False)


def memory_for_writing(spark: SparkSession, path: str, stamp_ms: int) -> tuple[DataFrame, list[str]]:
    """The calls of the session-memory files at ``path``, and the files that were no memory and went to quarantine.

    Failures to read, as opposed to parse, are raised.  Files are few and small: one per agent.
    """
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    shape = F.from_json("value", "sessions array<struct<id:string>>, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    checked = texts.select("file", (shape.isNull() | shape["_bad"].isNotNull() | shape["sessions"].isNull()).alias("bad")).collect()
    bad = sorted(r.file for r in checked if r.bad)
    for f in bad:
        quarantine(spark, f, stamp_ms)
    if len(bad) == len(checked):
        path = _no_memory(spark)
    return cut(read_memory(spark, path)[0], "memory"), bad


def _no_memory(spark: SparkSession) -> str:
    """A folder with one empty memory."""
    path = new_path(spark, "no-memory")
    spark.createDataFrame([('{"sessions": []}',)], "value string").coalesce(1).write.text(path)
    return path


def located(path: Column, roots: list[str], separator: str = "/") -> Column:
    """The stored path of an absolute one: what is below its root; null outside all roots."""
    root = rooted(path, roots)
    return F.when(root.isNotNull(), F.substr(path, F.length(root) + F.length(F.lit(separator)) + 1))


def index_file(files: DataFrame, new: DataFrame, roots: list[str]) -> DataFrame:
    """``files`` with ``new(path, ...)``, absolute paths, in place of what is stored under them; one outside every root is an error."""
    at = located(F.col("path"), roots)
    outside = new.where(at.isNull()).select("path").take(1)
    if outside:
        raise ValueError(f"{outside[0].path} lies outside all roots")
    return upsert(files, new.withColumn("path", at))


def remove_file(files: DataFrame, gone: DataFrame, roots: list[str]) -> DataFrame:
    """``files`` without ``gone(path)``, absolute paths; those outside every root are no-ops."""
    return files.join(gone.select(located(F.col("path"), roots).alias("path")).where("path IS NOT NULL").distinct(), "path", "left_anti").select(*files.columns)


def record_tool_call(spark: SparkSession, path: str, sent: int, saved: int) -> None:
    """K7: append one call's tokens; :func:`weft.operators.overview.token_usage` adds them up."""
    if sent < 0 or saved < 0:
        raise ValueError("tokens are counted from 0")
    append_history(spark.createDataFrame([(sent, saved)], "sent long, saved long"), path)
