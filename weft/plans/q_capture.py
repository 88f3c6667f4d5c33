"""Problem 5: the files that the next index run must handle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.operators import capture
from weft.plans.base import query
from weft.runtime import new_path, read_table

_PATH = "regexp_replace(replace(path, chr(92), '/'), '^\\./', '')"


_SQL = f"""
WITH f AS (
  SELECT id, {_PATH} AS p, lower(hash) AS h, row_number() OVER (PARTITION BY {_PATH} ORDER BY last_indexed DESC, id DESC) AS k FROM files WHERE hash IS NOT NULL),
i AS (
  SELECT {_PATH} AS p, lower(hash) AS h, row_number() OVER (PARTITION BY {_PATH} ORDER BY run_id DESC, done_at DESC, lower(hash) DESC) AS k
  FROM run_items WHERE run_id IN (SELECT run_id FROM index_runs WHERE status = 'ok' AND finished_at IS NOT NULL))
SELECT DISTINCT f.id, CASE WHEN i.h IS NULL THEN 'added' ELSE 'changed' END AS state
FROM f LEFT JOIN i ON f.p = i.p AND i.k = 1
WHERE f.k = 1 AND i.h IS DISTINCT FROM f.h"""


@query(_SQL)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The files that the next index run must handle, each once, and whether they are new or changed."""
    return capture.pending_files(*(read_table(spark, d, t) for t in ("files", "index_runs", "run_items")))


@query(_SQL)
def p5_replayed(spark: SparkSession, d: str) -> DataFrame:
    """The same files where the second batch died after its write, before its commit, and was replayed."""
    files, runs, items = (read_table(spark, d, t) for t in ("files", "index_runs", "run_items"))
    folder = new_path(spark, "replayed")
    log, log_of = capture.change_log(files), capture.ChangeCapture(spark, folder)
    log_of.run(log, parts=3)
    log_of.run(log, fail_before_commit=True, parts=2)
    return capture.pending_files(files, runs, items, folder)
