"""Problem 5: processing only new or changed records, by log-based change capture.

The table of versions is read as a log: a record's *key* is its normalised path, its
*partition* a hash of the key, its *offset* the version id.  A batch works like this:

1. **Plan.**  For each partition the range ``(committed, highest]`` of offsets is written to
   ``plan-<n>`` in the log's folder *before* anything is read (write-ahead).
2. **Process.**  The rows of the planned ranges are read and reduced to one per key.
3. **Commit.**  The result goes to the sink under the batch's number, then ``done-<n>`` is written.

A plan without ``done`` is replayed with the very same ranges after a failure, so nothing is
skipped; the sink overwrites the folder of its batch and keeps the latest version per key over all
batches, so nothing is repeated and a version that arrives late replaces no newer one.  Plans hold one line per partition (a fixed number), never data.

What earlier runs *attest* (their items, if the run succeeded) is the other side: only keys
without an attested hash, or with another one, come out.  All committed batches count: a key of an
earlier batch comes out until a successful run attests it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.runtime import new_path

PARTITIONS = 16


def norm_path(c: Column) -> Column:
    r"""``\`` becomes ``/`` and one leading ``./`` is dropped; case is kept."""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^\./", "")


def change_log(files: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """``(part, offset, path, hash, at)`` of the readable versions; null hashes, ids and paths are no records."""
    path = norm_path(F.col("path"))
    return (
        files.where("hash IS NOT NULL AND path IS NOT NULL AND id IS NOT NULL")
        .select(F.pmod(F.xxhash64(path), F.lit(partitions)).cast("int").alias("part"), F.col("id").alias("offset"), path.alias("path"), F.lower("hash").alias("hash"), F.col("last_indexed").alias("at"))
    )


def attested(runs: DataFrame, items: DataFrame) -> DataFrame:
    """``(path, seen)``: the hash of each path in the latest run that ended well.

    A run ended well if its status is ``ok`` and it has a finish time.  If one run holds several
    hashes of a path, the one handled last counts (then the greatest hash); a null hash attests nothing.
    """
    good = runs.where("status = 'ok' AND finished_at IS NOT NULL").select("run_id").distinct()
    good_items = items.where("path IS NOT NULL").join(F.broadcast(good) if _small(good) else good, "run_id", "left_semi")
    at = F.struct("run_id", "done_at", F.lower("hash").alias("h"))
    return good_items.groupBy(norm_path(F.col("path")).alias("path")).agg(F.max(at).alias("m")).select("path", F.col("m.h").alias("seen"))


def _small(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether ``df`` (of a few fixed-size columns) has at most ``rows`` rows, counted."""
    return df.limit(rows + 1).count() <= rows


def current(log: DataFrame) -> DataFrame:
    """One row per path: the version with the greatest time, then the greatest offset.

    ``max`` of a struct combines before the shuffle, so a path with any number of versions is no hot key.
    """
    return log.groupBy("path").agg(F.max(F.struct("at", "offset", "hash")).alias("m")).select("path", F.col("m.offset").alias("id"), F.col("m.hash").alias("hash"), F.col("m.at").alias("at"))


def pending(now: DataFrame, seen: DataFrame) -> DataFrame:
    """``(id, state)`` of the current versions that no successful run attests: ``added`` or ``changed``."""
    j = now.join(seen, "path", "left").where(F.col("seen").isNull() | (F.col("seen") != F.col("hash")))
    return j.select("id", F.when(F.col("seen").isNull(), "added").otherwise("changed").alias("state"))


class ChangeCapture:
    """Batches over a change log with write-ahead plans, replay and an idempotent sink in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- small files of the log -------------------------------------------------
    def _names(self) -> set[str]:
        p = self._fs_path(self.folder)
        return {s.getPath().getName() for s in self._fs.listStatus(p)} if self._fs.exists(p) else set()

    def _put(self, name: str, value: dict) -> None:
        tmp, to = self._fs_path(f"{self.folder}/.{name}"), self._fs_path(f"{self.folder}/{name}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        if not self._fs.rename(tmp, to):
            raise RuntimeError(f"{name} exists already: another writer holds the log")

    def _get(self, name: str) -> dict:
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.folder}/{name}").collect()))

    # -- protocol ---------------------------------------------------------------
    def committed(self) -> dict[str, int]:
        """The highest offset handled for sure, by partition."""
        done = [n for n in self._names() if n.startswith("done-")]
        return self._get(f"plan-{max(int(n[5:]) for n in done)}")["to"] if done else {}

    def is_open(self) -> bool:
        """Whether a plan was written ahead and not committed."""
        names = self._names()
        return any(n.startswith("plan-") and f"done-{n[5:]}" not in names for n in names)

    def plan(self, log: DataFrame, parts: int = 1) -> tuple[int, dict] | None:
        """The open plan if there is one, else a new one written ahead; None if nothing is new.

        A new plan takes the first of ``parts`` equal ranges of each partition's new offsets.
        """
        names = self._names()
        plans = sorted(int(n[5:]) for n in names if n.startswith("plan-"))
        if plans and f"done-{plans[-1]}" not in names:
            return plans[-1], self._get(f"plan-{plans[-1]}")
        start = self.committed()
        ends = {str(r.part): (r.low, r.top) for r in log.groupBy("part").agg(F.min("offset").alias("low"), F.max("offset").alias("top")).collect()}  # PARTITIONS rows
        to = dict(start)
        for p, (low, top) in ends.items():
            base = start.get(p, low - 1)
            to[p] = max(base, base - (base - top) // parts)
        if to == start:
            return None
        n = plans[-1] + 1 if plans else 0
        self._put(f"plan-{n}", {"from": start, "to": to})
        return n, {"from": start, "to": to}

    def rows(self, log: DataFrame, plan: dict) -> DataFrame:
        """The log's rows in the planned offset ranges."""
        within = F.lit(False)
        for p, top in sorted(plan["to"].items()):
            low = plan["from"].get(p)
            one = (F.col("part") == int(p)) & (F.col("offset") <= top)
            within = within | (one if low is None else one & (F.col("offset") > low))
        return log.where(within)

    def run(self, log: DataFrame, fail_before_commit: bool = False, parts: int = 1) -> DataFrame | None:
        """One batch: plan, process, write to the sink, commit.  Returns the rows that the sink got, None if nothing is new.

        ``parts`` is that of :meth:`plan`; ``fail_before_commit`` stops after the sink's write, as a lost driver would (for tests).
        """
        planned = self.plan(log, parts)
        if planned is None:
            return None
        n, plan = planned
        out = f"{self.folder}/sink/batch={n}"
        current(self.rows(log, plan)).write.mode("overwrite").parquet(out)
        if fail_before_commit:
            return None
        self._put(f"done-{n}", {"batch": n})
        return self.spark.read.parquet(out)

    def sink(self) -> DataFrame:
        """All committed rows ``(path, id, hash, at)``, one per key: the one with the greatest time, then offset."""
        done = sorted(int(n[5:]) for n in self._names() if n.startswith("done-"))
        if not done:
            return self.spark.createDataFrame([], "path string, id long, hash string, at timestamp")
        rows = self.spark.read.option("basePath", f"{self.folder}/sink").parquet(*[f"{self.folder}/sink/batch={n}" for n in done])
        if len(done) == 1:
            return rows.select("path", "id", "hash", "at")
        return rows.groupBy("path").agg(F.max(F.struct("at", "id", "hash")).alias("m")).select("path", "m.id", "m.hash", "m.at")


def pending_files(files: DataFrame, runs: DataFrame, items: DataFrame, folder: str | None = None, batches: int = 2) -> DataFrame:
    """``(id, state)`` of the files the next run must handle, each once, after all new versions are captured.

    A batch that a failure left open is replayed first; then what is new since the last commit is captured in
    ``batches`` batches, so that one of them is lost by a failure at most.  A fresh log starts at the first offset; with
    a kept ``folder`` only new versions are read.  The state of all committed batches is held against what runs
    attest.  Empty tables give no rows.
    """
    spark = files.sparkSession
    log = change_log(files)
    capture = ChangeCapture(spark, folder or new_path(spark, "capture"))
    if capture.is_open():
        capture.run(log)
    for parts in range(batches, 0, -1):
        capture.run(log, parts=parts)
    return pending(capture.sink(), attested(runs, items))
