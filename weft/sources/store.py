"""Session stores and append-only history: reading with bad lines counted, appending, repairing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators.history import DAY_MS, first_of_line
from weft.runtime import cut

CALL = (
    "query string, request string, outcome string, symbols array<string>, files array<string>, tokens long, stale boolean, timestamp long, agent string, "
    "rules array<struct<file:string,heading:string,hash:string>>, session_id string, turn_id string, parent_turn_id string, kind string, commit string, test_exit int"
)


def _shaped(df: DataFrame) -> DataFrame:
    """Defaults of a record: the request stands in for a missing query, the agent is ``unknown``."""
    return df.withColumns({"query": F.coalesce("query", "request"), "agent": F.coalesce("agent", F.lit("unknown")), "tokens": F.coalesce("tokens", F.lit(0)), "stale": F.coalesce("stale", F.lit(False))}).drop("request")


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records of JSON lines, and the lines that aren't records as ``(line)``; blank lines are neither."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", CALL + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    good = parsed.where("r._bad IS NULL AND r IS NOT NULL AND ltrim(value) LIKE '{%'")
    bad = parsed.where("r._bad IS NOT NULL OR r IS NULL OR ltrim(value) NOT LIKE '{%'")
    return _shaped(good.select("r.*").drop("_bad")), bad.select(F.col("value").alias("line"))


def read_memory(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The calls of all ``{"sessions": [{id, timestamp, calls}]}`` files, and how many files could not be read."""
    schema = f"sessions array<struct<id:string,timestamp:long,calls:array<struct<{', '.join(f'`{n}`:{t}' for n, t in (x.split(' ', 1) for x in CALL.split(', ') ))}>>>>, _bad string"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    raw = cut(raw, "memory")
    bad = raw.where("_bad IS NOT NULL").count()
    calls = raw.select(F.inline("sessions")).select(F.col("id").alias("_session"), F.inline("calls"))
    return _shaped(calls.withColumn("session_id", F.coalesce("session_id", "_session")).drop("_session")), bad


def append_history(calls: DataFrame, path: str) -> None:
    """Append records as JSON lines; every write adds files, so appends never collide."""
    calls.write.mode("append").json(path)


KINDS = ("turn", "delegation")


def session_log(spark: SparkSession, path: str, request: str, outcome: str | None = None, files: list[str] | None = None, *, agent: str = "unknown", session_id: str | None = None, kind: str | None = None, now_ms: int = 0) -> None:
    """Append one record; a blank request or another kind than a turn or delegation is refused."""
    if not request.strip():
        raise ValueError("a record needs a request")
    if kind is not None and kind not in KINDS:
        raise ValueError("the kind is turn or delegation")
    row = (request, outcome, files or [], agent, session_id, kind, now_ms)
    append_history(spark.createDataFrame([row], "query string, outcome string, files array<string>, agent string, session_id string, kind string, timestamp long"), path)


def by_session(calls: DataFrame) -> DataFrame:
    """K8: ``(id, timestamp, calls)``: the records of each session as the memory files keep them, in order of time.

    Bounded by the longest session: a store of this form can't hold one that no task could.
    """
    return calls.groupBy(F.col("session_id").alias("id")).agg(F.min("timestamp").alias("timestamp"), F.array_sort(F.collect_list(F.struct("timestamp", *[c for c in calls.columns if c not in ("timestamp", "session_id")]))).alias("calls"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, pos)``: the lines of a text table that aren't blank, numbered by file and place."""
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n")).alias("pos"))
    return raw.where(F.trim("line") != "")


def _rewrite(spark: SparkSession, path: str, lines: DataFrame, stamp_ms: int) -> str:
    """The lines, worked out in full, in place of the table, which is kept as a backup; returns the backup's path."""
    new = cut(lines.select("line", "pos"), "rewritten")
    kept = backup(spark, path, stamp_ms)
    new.orderBy("pos").select(F.col("line").alias("value")).write.text(path)
    return kept


def repair_history(spark: SparkSession, path: str, stamp_ms: int) -> dict[str, int]:
    """Bad lines go to ``<path>.quarantine``, the good ones stay as they are; returns both counts.

    The table is backed up first.  Without a bad line nothing is touched.
    """
    rows = _lines(spark, path)
    record = F.from_json("line", CALL + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    checked = cut(rows.withColumn("r", record).withColumn("good", F.col("r").isNotNull() & F.col("r._bad").isNull() & F.ltrim("line").startswith("{")).select("line", "pos", "good"), "checked")
    n = checked.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).first()
    if n.bad:
        _rewrite(spark, path, checked.where("good"), stamp_ms)
        checked.where("NOT good").select(F.col("line").alias("value")).write.mode("append").text(path.rstrip("/") + ".quarantine")
    return {"good": n.good, "bad": n.bad}


def compact_history(spark: SparkSession, path: str, stamp_ms: int, now_ms: int = 0, fold_days: int | None = None) -> dict[str, int]:
    """Each line once, at its first place; with ``fold_days`` long texts of older records are folded.

    All is worked out before anything is touched, so a policy that fails leaves the table as it was; then it is backed up and
    rewritten.  A folded record keeps the fields of :data:`CALL`; lines that are no records stay.
    """
    if fold_days is not None and fold_days < 1:
        raise ValueError("days must be at least 1")
    rows = _lines(spark, path)
    once = first_of_line(rows, "line", "pos")
    if fold_days is not None:
        r = F.from_json("line", CALL)
        old = r["timestamp"] < now_ms - int(fold_days * DAY_MS)
        long = F.coalesce(old & ((F.length(r["query"]) > 120) | (F.length(r["outcome"]) > 120)), F.lit(False))
        shorter = r.withField("query", T.fold(r["query"], old)).withField("outcome", T.fold(r["outcome"], old))
        once = once.withColumn("line", F.when(long, F.to_json(shorter)).otherwise(F.col("line")))
    once = cut(once, "once")
    before, after = rows.count(), once.count()
    _rewrite(spark, path, once, stamp_ms)
    return {"before": before, "after": after}


def merge_spill(history: DataFrame, spill: DataFrame) -> DataFrame:
    """K9: history with records that were written aside, each line once."""
    return history.unionByName(spill, allowMissingColumns=True).distinct()


def new_snapshots(rules: DataFrame, stored: DataFrame) -> DataFrame:
    """Rule snapshots that aren't stored yet, one per hash."""
    return rules.dropDuplicates(["hash"]).join(stored.select("hash"), "hash", "left_anti")


def doctor(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(good, bad)`` of a history file."""
    good, bad = read_history(spark, path)
    return good.agg(F.count("*").alias("good")).join(bad.agg(F.count("*").alias("bad")))


def backup(spark: SparkSession, path: str, stamp_ms: int) -> str | None:
    """Move a table aside under the time in ms, so that a rewrite never overwrites an older copy; None if there is none."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(of(path)):
        return None
    to = f"{path.rstrip('/')}.bak-{stamp_ms}"
    if fs.exists(of(to)) or not fs.rename(of(path), of(to)):
        raise RuntimeError(f"{to} can't be made")
    return to
