"""The registry of queries, and the stand-in relations over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import paths
from weft.runtime import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under its name, with the SQL that must agree."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    """Source files: ``(file_id, path, language, text)`` of the documents."""
    t = read_table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("file_id"), "path", F.when(F.col("doc_type") == "code", "rust").otherwise("markdown").alias("language"), "text", "doc_type")


#: Symbols stand for parts: a brand is a file, names repeat, cheap parts are exported.
NODES_SQL = "SELECT p_partkey AS id, p_brand AS file_id, p_name AS name, p_type AS kind, p_size AS line, p_partkey % 7 + 1 AS col, p_retailprice < 1000 AS is_exported FROM part"
#: Edges stand for consecutive parts of an order.
EDGES_SQL = (
    "SELECT DISTINCT from_id, to_id, kind FROM (SELECT l_partkey AS from_id, l_returnflag AS kind, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS to_id FROM lineitem) x WHERE to_id IS NOT NULL"
)
GRAPH = f"WITH nodes AS ({NODES_SQL}), edges AS ({EDGES_SQL}) "
#: The last version of each normalised path of the files table.
FILES_SQL = (
    "SELECT id, path, language, hash, char_count FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY last_indexed DESC, id DESC, char_count DESC) AS k FROM files) x WHERE k = 1"
)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").alias("line"), (F.col("p_partkey") % 7 + 1).alias("col"), (F.col("p_retailprice") < 1000).alias("is_exported"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    t = read_table(spark, d, "lineitem").select(F.col("l_partkey").alias("from_id"), F.lead("l_partkey").over(w).alias("to_id"), F.col("l_returnflag").alias("kind"))
    return t.where("to_id IS NOT NULL").distinct()


def files(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "files")
    return t.groupBy("path").agg(F.max(F.struct("last_indexed", "id", "char_count", "language", "hash")).alias("m")).select("m.id", "path", "m.language", "m.hash", "m.char_count")


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Session calls, each call id once (the copies of a row are equal)."""
    return read_table(spark, d, "calls").dropDuplicates(["call_id"])


CALLS_SQL = "calls1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id) AS k_ FROM calls) x WHERE k_ = 1)"

__all__ = ["query", "docs", "nodes", "edges", "files", "calls", "paths"]
