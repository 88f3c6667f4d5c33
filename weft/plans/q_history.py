"""Queries over session history and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import history
from weft.plans.base import CALLS_SQL, calls, query
from weft.runtime import cut, new_path, read_table
from weft.streaming import events as stream

_C = f"WITH {CALLS_SQL}, t AS (SELECT * FROM calls1 WHERE kind = 'turn'), d AS (SELECT * FROM calls1 WHERE kind = 'delegation')"


@query(_C + """ SELECT d.call_id AS delegation, min(t.call_id) AS turn FROM d LEFT JOIN t ON t.turn_id = d.parent_turn_id WHERE d.parent_turn_id IS NOT NULL GROUP BY 1
UNION ALL SELECT d.call_id, min_by(t.call_id, (t."timestamp", t.call_id)) FROM d LEFT JOIN t ON t.session_id = d.session_id AND t."timestamp" >= d."timestamp" WHERE d.parent_turn_id IS NULL GROUP BY 1""")
def j14_parent_turns(spark: SparkSession, d: str) -> DataFrame:
    """Forward as-of."""
    return history.parent_turns(calls(spark, d))


@query(_C + """ SELECT t.call_id AS turn, d.call_id AS delegation FROM d JOIN t ON t.turn_id = d.parent_turn_id
UNION ALL SELECT t.call_id, x.call_id FROM (SELECT d.call_id, d.session_id, min(t."timestamp") AS at FROM d JOIN t ON t.session_id = d.session_id AND t."timestamp" >= d."timestamp" WHERE d.parent_turn_id IS NULL GROUP BY 1, 2) x JOIN t ON t.session_id = x.session_id AND t."timestamp" = x.at""")
def j13_w03_delegations(spark: SparkSession, d: str) -> DataFrame:
    """Interval join."""
    return history.delegations(calls(spark, d))


_NOW = 1725000000000


@query("SELECT turn_no, min(recorded_at) AS recorded_at FROM turns GROUP BY 1")
def w05_first_of_line(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "turns").select("turn_no", "recorded_at")
    return history.first_of_line(t, "turn_no", "recorded_at")


@query(f"""WITH {CALLS_SQL}, h AS (SELECT call_id, "timestamp", coalesce(contains(lower(query), 'lockfile digest'), false) OR coalesce(contains(lower(outcome), 'lockfile digest'), false) AS hit, regexp_extract_all(lower(concat_ws(chr(10), query, outcome, CASE WHEN len(files) > 0 THEN array_to_string(files, chr(10)) END)), '[a-z0-9_]{{2,}}') AS a,
  regexp_extract_all(lower(concat_ws(chr(10), query, outcome)), '[\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]+') AS c FROM calls1),
b AS (SELECT *, len(a) + coalesce(list_sum([2 * length(x) - 1 FOR x IN c]), 0) AS dl, len(list_filter(a, lambda x: x = 'lockfile')) AS f1, len(list_filter(a, lambda x: x = 'digest')) AS f2 FROM h),
s AS (SELECT count(*) AS n, avg(dl) AS av, count(*) FILTER (WHERE f1 > 0) AS d1, count(*) FILTER (WHERE f2 > 0) AS d2 FROM b),
r AS (SELECT call_id, CASE WHEN hit THEN 0 ELSE 1 END AS grp, CASE WHEN hit THEN 0.0 ELSE (ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / av)) + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * dl / av))) * pow(0.5, greatest({_NOW} - "timestamp", 0) / 86400000.0 / 90.0) END AS score FROM b, s)
SELECT call_id, grp, round(score, 6) AS score FROM r WHERE grp = 0 OR score > 0""")
def r06_recall_ranking(spark: SparkSession, d: str) -> DataFrame:
    """R6, R7, A10, T5."""
    return history.recall(calls(spark, d), "Lockfile digest", _NOW, None).withColumn("score", F.round("score", 6))


@query(f'WITH {CALLS_SQL} SELECT call_id, 0 AS grp, 0.0::DOUBLE AS score FROM calls1 ORDER BY "timestamp" DESC, call_id LIMIT 20')
def t06_recall_newest(spark: SparkSession, d: str) -> DataFrame:
    """T6, E10 without a query."""
    return history.recall(calls(spark, d), " ", _NOW)


_LISTED = "CASE WHEN len({0}) > 5 THEN array_to_string({0}[1:5], ', ') || ', … (+' || (len({0}) - 5) || ' more)' WHEN len({0}) > 0 THEN array_to_string({0}, ', ') END"


@query(_C + f""", explicit AS (SELECT t.call_id AS turn, d.call_id AS del FROM d JOIN t ON t.turn_id = d.parent_turn_id),
open AS (SELECT t.call_id AS turn, x.call_id AS del FROM (SELECT d.call_id, d.session_id, min(t."timestamp") AS due FROM d JOIN t ON t.session_id = d.session_id AND t."timestamp" >= d."timestamp" WHERE d.parent_turn_id IS NULL GROUP BY 1, 2) x JOIN t ON t.session_id = x.session_id AND t."timestamp" = x.due),
ran AS (SELECT turn AS call_id, list(coalesce(agent, 'unknown') || CASE WHEN test_exit IS NOT NULL THEN ' (test_exit ' || test_exit || ')' ELSE '' END ORDER BY "timestamp", call_id) AS told FROM (SELECT * FROM explicit UNION ALL SELECT * FROM open) u JOIN calls1 c ON c.call_id = u.del GROUP BY 1),
by1 AS (SELECT del AS call_id, min(turn) AS turn FROM (SELECT * FROM explicit UNION ALL SELECT * FROM open) u GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY "timestamp" DESC, call_id) AS rank FROM calls1)
SELECT rank::INT AS rank, r.call_id, strftime(epoch_ms(r."timestamp"), '%Y-%m-%d %H:%M') AS "at", coalesce(agent, 'unknown') AS agent, query, nullif(outcome, '') AS outcome, tokens, coalesce(stale, false) AS stale, {_LISTED.format("symbols")} AS symbols, {_LISTED.format("files")} AS files,
  {_LISTED.format("[coalesce(x.file, '') || '#' || coalesce(x.heading, '') || ' (' || coalesce(x.hash, '')[1:8] || ')' FOR x IN rules]")} AS rules,
  CASE WHEN kind = 'turn' THEN commit_sha[1:8] END AS commit, CASE WHEN kind = 'turn' THEN {_LISTED.format("told")} END AS delegations, CASE WHEN kind = 'delegation' THEN (SELECT query[1:60] FROM calls1 p WHERE p.call_id = by1.turn) END AS delegated_by
FROM r LEFT JOIN ran ON ran.call_id = r.call_id LEFT JOIN by1 ON by1.call_id = r.call_id WHERE rank <= 300""")
def r08_session_recall(spark: SparkSession, d: str) -> DataFrame:
    """The newest 300 records as a reader sees them."""
    return history.session_recall(calls(spark, d), "", _NOW, 300)


@query(f"WITH {CALLS_SQL} SELECT call_id, stale OR coalesce(list_contains(files, (SELECT min(files[1]) FROM calls)), false) AS stale FROM calls1")
def e12_mark_stale(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d)
    path = c.agg(F.min(F.get("files", F.lit(0))).alias("p")).first().p
    return history.mark_stale(c, path).select("call_id", "stale")


@query(f"""WITH {CALLS_SQL} SELECT call_id, CASE WHEN "timestamp" < {_NOW} - 7776000000 AND length(query) > 120 THEN query[1:119] || '…' ELSE query END AS query, CASE WHEN "timestamp" < {_NOW} - 7776000000 AND length(outcome) > 120 THEN outcome[1:119] || '…' ELSE outcome END AS outcome FROM calls1""")
def k15_compact_folded(spark: SparkSession, d: str) -> DataFrame:
    """X7, K15, W5, E20."""
    return history.folded(calls(spark, d), _NOW, 90).select("call_id", "query", "outcome")


@query("SELECT turn_no, source, nullif(trim(trim(request, E' \\n\\r\\t') || chr(10) || coalesce(outcome, ''), E' \\n\\r\\t'), '') AS text FROM turns")
def x32_content_text(spark: SparkSession, d: str) -> DataFrame:
    """X32 over all turns as transcript messages: two text blocks around a reminder and a tool call."""
    t = read_table(spark, d, "turns")
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    content = F.to_json(F.array(block("text", T.trim(F.col("request"))), block("text", F.lit("<system-reminder>x</system-reminder>")), block("tool_use", F.lit("no")), block("text", F.coalesce("outcome", F.lit("")))))
    return t.select("turn_no", "source", T.content_text(content).alias("text"))


@query(f"WITH {CALLS_SQL} SELECT call_id FROM calls1 WHERE call_id % 3 <> 0 UNION SELECT call_id FROM calls1 WHERE call_id % 2 = 0")
def k09_merge_spill(spark: SparkSession, d: str) -> DataFrame:
    """History and what was written aside, overlapping in part."""
    from weft.sources.store import merge_spill

    c = calls(spark, d).select("call_id", "session_id", "query")
    return merge_spill(c.where("call_id % 3 <> 0"), c.where("call_id % 2 = 0")).select("call_id")


def _messages(spark, d):
    c = calls(spark, d)
    said = F.inline(F.array(F.struct(F.lit("user").alias("role"), F.col("query").alias("text"), (F.col("call_id") * 2).alias("pos")), F.struct(F.lit("assistant").alias("role"), F.col("outcome").alias("text"), (F.col("call_id") * 2 + 1).alias("pos"))))
    return c.select(F.col("session_id").alias("conv"), said)


@query(f"""WITH {CALLS_SQL}, m AS (SELECT session_id AS conv, 'user' AS role, query AS text, call_id AS pos FROM calls1 UNION ALL SELECT session_id, 'assistant', outcome, call_id FROM calls1), s AS (SELECT * FROM m WHERE regexp_matches(text, '\\S')),
g AS (SELECT conv, max_by(trim(text, E' \\n\\r\\t'), pos) FILTER (WHERE role = 'user') AS request, max_by(trim(text, E' \\n\\r\\t'), pos) FILTER (WHERE role = 'assistant') AS outcome FROM s GROUP BY 1) SELECT conv, request[1:600] AS request, outcome[1:400] AS outcome FROM g WHERE request IS NOT NULL""")
def w09_x28_last_turn(spark: SparkSession, d: str) -> DataFrame:
    """Per session the last request and outcome."""
    return history.last_turn(_messages(spark, d))


@query(f"""WITH {CALLS_SQL}, l AS (SELECT session_id AS conv, max(call_id) AS last FROM calls1 WHERE regexp_matches(query, '\\S') GROUP BY 1), e AS (SELECT session_id AS conv, call_id, unnest(files) AS file FROM calls1)
SELECT DISTINCT e.conv, file FROM e LEFT JOIN l USING (conv) WHERE last IS NULL OR call_id >= last""")
def w10_files_after_request(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d)
    asked = c.where(F.col("query").rlike(r"\S")).select(F.col("session_id").alias("conv"), (F.col("call_id") * 2).alias("pos"), F.lit("user").alias("role"), F.lit(None).cast("string").alias("file"))
    touched = c.select(F.col("session_id").alias("conv"), (F.col("call_id") * 2 + 1).alias("pos"), F.lit("tool").alias("role"), F.explode("files").alias("file"))
    return history.files_after_request(asked.unionByName(touched))


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) x WHERE p IS NULL OR p <> event_type")
def w07_consecutive_once(spark: SparkSession, d: str) -> DataFrame:
    return history.consecutive_once(read_table(spark, d, "events"), ["event_type"], ["ts", "event_id"], "user_id").select("event_id")


# ---------------------------------------------------------------- streams


def _file_events(spark, d):
    t = read_table(spark, d, "events")
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "create").otherwise("change")
    return t.select(F.col("ts").cast("timestamp").alias("event_time"), F.col("user_id").cast("string").alias("path"), op.alias("op"))


def _as_stream(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` as a stream over files in the shared folder."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def _drained(df: DataFrame, label: str) -> DataFrame:
    """Everything a stream gives when it is read to its end, through a file sink."""
    spark = df.sparkSession
    out, state = new_path(spark, label), new_path(spark, label + "-state")
    q = df.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


_HOUR_MS = 3_600_000


@query("""WITH e AS (SELECT user_id::VARCHAR AS path, ts, CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'create' ELSE 'change' END AS op FROM events),
x AS (SELECT *, op = 'delete' OR coalesce(lead(ts) OVER (PARTITION BY path ORDER BY ts, op) - ts >= INTERVAL 1 HOUR, true) AS ends FROM e),
g AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY path ORDER BY ts, op ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS burst FROM x)
SELECT path, strftime(max(ts) + CASE WHEN bool_or(op = 'delete') THEN INTERVAL 0 HOUR ELSE INTERVAL 1 HOUR END, '%Y-%m-%d %H:%M:%S') AS settled_at, max_by(op, ts) AS op, count(*) AS n FROM g GROUP BY path, burst""")
def z01_z02_settled(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of a path, with a quiet time of an hour for these slow events; deletes come out at once and cancel what waits."""
    return stream.settled(_file_events(spark, d), _HOUR_MS).select("path", F.date_format("settled_at", "yyyy-MM-dd HH:mm:ss").alias("settled_at"), "op", "n")


@query()
def z01_streamed(spark: SparkSession, d: str) -> DataFrame:
    """Z1, Z2 through Structured Streaming; open bursts stay in the state until the watermark passes them."""
    got = _drained(stream.settled(_as_stream(_file_events(spark, d), "file-events"), _HOUR_MS), "settled")
    return got.select("path", "settled_at", "op", "n")


def _folder_events(spark, d):
    t = read_table(spark, d, "events")
    return t.select((F.col("user_id") % 20).cast("string").alias("workspace"), F.col("ts").cast("timestamp").alias("event_time"), F.col("user_id").cast("string").alias("path"))


def _folders(spark, d, every_ms: int, sync_ms: int) -> DataFrame:
    got = stream.folder_batches(_folder_events(spark, d), every_ms, sync_ms)
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return got.select("workspace", fmt("batch_at"), "path", fmt("first_seen"))


def _folders(spark, d, every_ms: int, sync_ms: int) -> DataFrame:
    got = stream.folder_batches(_folder_events(spark, d), every_ms, sync_ms)
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return got.select("workspace", fmt("batch_at"), "path", fmt("first_seen"))


def _folder_query(every: str, sync: str) -> str:
    """Batches one by one: the timer starts with the first candidate left, or when the sync before ends."""
    return f"""WITH RECURSIVE e AS (SELECT (user_id % 20)::VARCHAR AS w, ts, user_id::VARCHAR AS path FROM events),
r(w, due) AS (SELECT w, min(ts) + INTERVAL {every} FROM e GROUP BY w
  UNION ALL SELECT w, greatest(first, due + INTERVAL {sync}) + INTERVAL {every} FROM (SELECT r.w, any_value(r.due) AS due, min(e.ts) AS first FROM r JOIN e ON e.w = r.w AND e.ts >= r.due GROUP BY r.w) x),
b AS (SELECT w, due, lag(due, 1, TIMESTAMP '1970-01-01') OVER (PARTITION BY w ORDER BY due) AS since FROM r)
SELECT e.w AS workspace, strftime(due, '%Y-%m-%d %H:%M:%S') AS batch_at, path, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen FROM e ASOF JOIN b ON e.w = b.w AND e.ts >= b.since GROUP BY e.w, due, path"""


@query(_folder_query("6 HOUR", "0 HOUR"))
def z04_folder_batches(spark: SparkSession, d: str) -> DataFrame:
    """Z4 with a timer of six hours for these slow events; workspaces are users modulo 20."""
    return _folders(spark, d, 6 * _HOUR_MS, 0)


@query(_folder_query("1 HOUR", "5 HOUR"))
def z04_while_syncing(spark: SparkSession, d: str) -> DataFrame:
    """Z4 where a sync takes five hours: candidates are held and start the timer when it ends."""
    return _folders(spark, d, _HOUR_MS, 5 * _HOUR_MS)


@query("SELECT user_id::VARCHAR AS path, arg_max(op, ts) AS op, count(*) AS n FROM (SELECT user_id, ts, CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'create' ELSE 'change' END AS op FROM events) x GROUP BY 1")
def z03_serial_queue(spark: SparkSession, d: str) -> DataFrame:
    """Micro-batches over the stream; a waiting path is handed on once per batch."""
    out = new_path(spark, "queue")
    seen = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)
    src = _as_stream(_file_events(spark, d), "queue-events")
    q = src.writeStream.foreachBatch(stream.serial_queue(seen)).option("checkpointLocation", new_path(spark, "queue-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    handled = spark.read.parquet(out).select("path", "op")
    return handled.join(_file_events(spark, d).groupBy("path").agg(F.count("*").alias("n")), "path").select("path", "op", "n")


_POLLS = "p AS (SELECT user_id::VARCHAR AS repo, ts, CASE WHEN event_type <> 'error' THEN event_type END AS ref FROM events)"


@query(f"WITH {_POLLS}, l AS (SELECT repo, ts, ref, lag(ref) OVER (PARTITION BY repo ORDER BY ts) AS before FROM p WHERE ref IS NOT NULL) SELECT repo, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time, before, ref FROM l WHERE before <> ref")
def z05_branch_changes(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "events").select(F.col("user_id").cast("string").alias("repo"), F.col("ts").cast("timestamp").alias("event_time"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("ref"))
    return stream.branch_changes(t).select("repo", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "before", "ref")


@query(f"WITH {_POLLS}, l AS (SELECT repo, ts, ref, lag(ref) OVER (PARTITION BY repo ORDER BY ts) AS before FROM p WHERE ref IS NOT NULL) SELECT repo, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time, before, ref FROM l WHERE before <> ref")
def z05_streamed(spark: SparkSession, d: str) -> DataFrame:
    """Z5 with keyed state."""
    t = read_table(spark, d, "events").select(F.col("user_id").cast("string").alias("repo"), F.col("ts").cast("timestamp").alias("event_time"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("ref"))
    got = _drained(stream.branch_changes(_as_stream(t, "polls")), "branches")
    return cut(got).select("repo", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "before", "ref")


@query("WITH r AS (SELECT UNNEST(rules, recursive := true) FROM calls) SELECT hash, count(*) > 0 AS fresh FROM r WHERE hash NOT IN (SELECT hash FROM sections WHERE hash IS NOT NULL) GROUP BY 1")
def k10_new_snapshots(spark: SparkSession, d: str) -> DataFrame:
    from weft.sources.store import new_snapshots

    refs = read_table(spark, d, "calls").select(F.inline("rules"))
    return new_snapshots(refs, read_table(spark, d, "sections")).select("hash", F.lit(True).alias("fresh"))


@query("SELECT count(*) FILTER (WHERE call_id % 10 <> 0) AS good, count(*) FILTER (WHERE call_id % 10 = 0) AS bad FROM calls")
def a17_k12_doctor(spark: SparkSession, d: str) -> DataFrame:
    """History written as JSON lines, a tenth of them cut short, read back and counted."""
    from weft.sources.store import doctor

    t = read_table(spark, d, "calls").withColumnRenamed("commit_sha", "commit").drop("recorded_at")
    line = F.to_json(F.struct(*[c for c in t.columns if c != "call_id"]))
    path = new_path(spark, "history")
    t.select(F.when(F.col("call_id") % 10 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    return doctor(spark, path)


def _history_text(spark: SparkSession, d: str, label: str) -> str:
    """The calls as lines of JSON, every row of the table, with each tenth one cut short; returns the folder."""
    t = read_table(spark, d, "calls").withColumnRenamed("commit_sha", "commit").drop("recorded_at")
    line = F.to_json(F.struct(*[c for c in t.columns if c != "call_id"]))
    path = new_path(spark, label)
    t.select(F.when(F.col("call_id") % 10 == 0, F.concat(F.substring(line, 1, 9), F.col("call_id").cast("string"))).otherwise(line).alias("value")).write.text(path)
    return path


@query("SELECT count(*) FILTER (WHERE call_id % 10 <> 0) AS good, count(*) FILTER (WHERE call_id % 10 = 0) AS bad, count(*) FILTER (WHERE call_id % 10 <> 0) AS good_after, 0::BIGINT AS bad_after, count(*) FILTER (WHERE call_id % 10 = 0) AS quarantined FROM calls")
def k12_repair(spark: SparkSession, d: str) -> DataFrame:
    """Bad lines go to quarantine and the rest stays; a second run finds nothing to do."""
    from weft.sources import store

    path = _history_text(spark, d, "repair")
    first, second = store.repair_history(spark, path, 1), store.repair_history(spark, path, 2)
    aside = spark.read.text(path + ".quarantine").count()
    return spark.createDataFrame([(first["good"], first["bad"], second["good"], second["bad"], aside)], "good long, bad long, good_after long, bad_after long, quarantined long")


@query(f"""WITH u AS (SELECT DISTINCT c.* EXCLUDE (call_id, recorded_at) FROM calls c WHERE call_id % 10 <> 0)
SELECT u."timestamp" AS ts, CASE WHEN u."timestamp" < {_NOW} - 7776000000 AND length(query) > 120 THEN query[1:119] || '…' ELSE query END AS query, CASE WHEN u."timestamp" < {_NOW} - 7776000000 AND length(outcome) > 120 THEN outcome[1:119] || '…' ELSE outcome END AS outcome FROM u""")
def k15_compacted_file(spark: SparkSession, d: str) -> DataFrame:
    """A history file with each line once and old texts folded, read back."""
    from weft.sources import store

    path = _history_text(spark, d, "compact")
    store.compact_history(spark, path, 1, _NOW, 90)
    return store.read_history(spark, path)[0].select(F.col("timestamp").alias("ts"), "query", "outcome")
