"""Session history ``calls(call_id, session_id, timestamp, query, outcome, ...)``: linkage, recall, upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators.asof import asof
from weft.operators.prefix import chunked, neighbour
from weft.operators.retrieve import bm25_recall

DAY_MS = 86_400_000.0


def first_of_line(df: DataFrame, line: str, pos: str) -> DataFrame:
    """Of equal lines the first by position; an aggregate, so a line repeated without end is no hot group."""
    rest = [c for c in df.columns if c != line]
    return df.groupBy(line).agg(F.min_by(F.struct(*rest), pos).alias("_m")).select(line, "_m.*")


def parent_turns(calls: DataFrame) -> DataFrame:
    """``(delegation, turn)`` by call id: the parent of each delegation, null if it has none.

    A delegation with a parent turn id belongs to the first turn of that id, else to the earliest turn of its session at
    or after it (the least call id among equals); without a session to none.
    """
    turns, d = calls.where("kind = 'turn'"), calls.where("kind = 'delegation'")
    named = turns.where("turn_id IS NOT NULL").groupBy(F.col("turn_id").alias("parent_turn_id")).agg(F.min("call_id").alias("turn"))
    explicit = d.where("parent_turn_id IS NOT NULL").select("parent_turn_id", F.col("call_id").alias("delegation")).join(named, "parent_turn_id", "left").select("delegation", "turn")
    implicit = asof(d.where("parent_turn_id IS NULL"), turns, "session_id", "timestamp", "call_id", F.col("call_id"), forward=True, tie=F.col("call_id"))
    return explicit.unionByName(implicit.select(F.col("call_id").alias("delegation"), F.col("match").alias("turn")))


def delegations(calls: DataFrame) -> DataFrame:
    """``(turn, delegation)`` by call id: every delegation of every turn.

    By turn id where the delegation names its parent; else all turns of the session at the earliest turn time not before it,
    which is the window (previous turn time, turn time].
    """
    turns, d = calls.where("kind = 'turn'"), calls.where("kind = 'delegation'")
    explicit = d.where("parent_turn_id IS NOT NULL").select(F.col("call_id").alias("delegation"), F.col("parent_turn_id").alias("turn_id")).join(turns.select("turn_id", F.col("call_id").alias("turn")), "turn_id").select("turn", "delegation")
    at = asof(d.where("parent_turn_id IS NULL"), turns, "session_id", "timestamp", "call_id", F.col("timestamp"), forward=True).where("match IS NOT NULL")
    open_d = at.select(F.col("call_id").alias("delegation"), F.col("match").alias("timestamp")).join(d.select(F.col("call_id").alias("delegation"), "session_id"), "delegation")
    return explicit.unionByName(open_d.join(turns.select("session_id", "timestamp", F.col("call_id").alias("turn")), ["session_id", "timestamp"]).select("turn", "delegation"))


def recall(calls: DataFrame, query: str, now_ms: int, limit: int | None = 20) -> DataFrame:
    """``(call_id, grp, score)``, best first.

    Group 0 are substring hits in query or outcome, newest first; group 1 the others by BM25 times a decay that halves every
    90 days.  A blank query lists all, newest first.  Ties: least call id.
    """
    q = query.strip().lower()
    newest = [F.desc("timestamp"), F.col("call_id")]
    if not q:
        out = calls.select("call_id", "timestamp", F.lit(0).alias("grp"), F.lit(0.0).alias("score")).orderBy(*newest)
        return (out.limit(limit) if limit else out).select("call_id", "grp", "score")
    text = F.concat_ws("\n", "query", "outcome", F.when(F.size("files") > 0, F.array_join("files", "\n")))
    hit = F.coalesce(F.lower("query").contains(q), F.lit(False)) | F.coalesce(F.lower("outcome").contains(q), F.lit(False))
    scored = bm25_recall(calls.select("call_id", "timestamp", hit.alias("hit"), text.alias("text")), q)
    hit = F.col("hit")
    age = F.greatest(F.lit(now_ms) - F.col("timestamp"), F.lit(0)) / DAY_MS
    s = scored.select("call_id", "timestamp", F.when(hit, 0).otherwise(1).alias("grp"), F.when(hit, 0.0).otherwise(F.col("score") * T.recency(age)).alias("score")).where("grp = 0 OR score > 0")
    order = ["grp", F.desc(F.when(F.col("grp") == 0, F.col("timestamp"))), F.desc(F.round("score", 12)), "call_id"]
    out = s.orderBy(*order)
    return (out.limit(limit) if limit else out).select("call_id", "grp", "score")


def session_recall(calls: DataFrame, query: str, now_ms: int, limit: int = 20, shown: int = 5) -> DataFrame:
    """The recalled records in order, with what a reader needs beside them.

    ``(rank, call_id, at, agent, query, outcome, tokens, stale, symbols, files, rules, commit, delegations, delegated_by)``: lists are cut
    to ``shown`` entries (T8), rules are ``file#heading (hash)``, a turn has its commit and the agents of its delegations with
    their test results (J13), a delegation the query of the turn that ran it (J14).  Links are worked out over all of
    ``calls``; the joins that carry texts see the recalled rows only.
    """
    got = recall(calls, query, now_ms, limit)
    order = W.orderBy("grp", F.desc(F.when(F.col("grp") == 0, F.col("timestamp"))), F.desc(F.round("score", 12)), "call_id")
    rows = calls.join(got, "call_id").withColumn("rank", F.row_number().over(order))  # at most ``limit`` rows
    agent = F.coalesce("agent", F.lit("unknown"))
    known = rows.select("call_id")
    told = F.concat(agent, F.when(F.col("test_exit").isNotNull(), F.concat(F.lit(" (test_exit "), F.col("test_exit").cast("string"), F.lit(")"))).otherwise(""))
    ran = delegations(calls).join(known.withColumnRenamed("call_id", "turn"), "turn", "left_semi").join(calls.select(F.col("call_id").alias("delegation"), "timestamp", told.alias("told")), "delegation")
    ran = ran.groupBy("turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "delegation", "told"))), lambda x: x["told"]).alias("told"))
    by = parent_turns(calls).join(known.withColumnRenamed("call_id", "delegation"), "delegation", "left_semi").join(calls.select(F.col("call_id").alias("turn"), F.substring("query", 1, 60).alias("by")), "turn")
    j = rows.join(ran.withColumnRenamed("turn", "call_id"), "call_id", "left").join(by.select(F.col("delegation").alias("call_id"), "by"), "call_id", "left")
    some = lambda c: F.when(F.size(c) > 0, T.capped_list(c, shown))
    refs = F.transform("rules", lambda r: F.concat(F.coalesce(r["file"], F.lit("")), F.lit("#"), F.coalesce(r["heading"], F.lit("")), F.lit(" ("), F.substring(F.coalesce(r["hash"], F.lit("")), 1, 8), F.lit(")")))
    return j.select(
        "rank", "call_id", T.epoch_minutes(F.col("timestamp")).alias("at"), agent.alias("agent"), "query", F.when(F.col("outcome") != "", F.col("outcome")).alias("outcome"), "tokens", F.coalesce("stale", F.lit(False)).alias("stale"),
        some(F.col("symbols")).alias("symbols"), some(F.col("files")).alias("files"), some(refs).alias("rules"),
        F.when(F.col("kind") == "turn", F.substring("commit_sha", 1, 8)).alias("commit"), F.when(F.col("kind") == "turn", some(F.col("told"))).alias("delegations"), F.when(F.col("kind") == "delegation", F.col("by")).alias("delegated_by"),
    )


def mark_stale(calls: DataFrame, path: str) -> DataFrame:
    """Records that mention a path become stale."""
    return calls.withColumn("stale", F.col("stale") | F.coalesce(F.array_contains("files", path), F.lit(False)))


def folded(calls: DataFrame, now_ms: int, days: int) -> DataFrame:
    """Query and outcome of records older than ``days`` cut to 120 characters; running it again changes nothing."""
    if days < 1:
        raise ValueError("days must be at least 1")
    old = F.col("timestamp") < now_ms - int(days * DAY_MS)
    return calls.withColumns({c: T.fold(F.col(c), old) for c in ("query", "outcome")})


def last_turn(messages: DataFrame, request_chars: int = 600, outcome_chars: int = 400) -> DataFrame:
    """Per conversation of ``messages(conv, pos, role, text)`` the last request and outcome, redacted and cut.

    Conversations without a request do not come out; blank texts don't count.
    """
    said = messages.where(F.col("text").rlike(r"(?U)\S"))
    last = lambda r: F.max_by(F.when(F.col("role") == r, T.trim(F.col("text"))), F.when(F.col("role") == r, F.col("pos")))
    g = said.groupBy("conv").agg(last("user").alias("request"), last("assistant").alias("outcome")).where("request IS NOT NULL")
    return g.select("conv", T.truncate_chars(T.redact_secrets(F.col("request")), request_chars).alias("request"), T.truncate_chars(T.redact_secrets(F.col("outcome")), outcome_chars).alias("outcome"))


def files_after_request(events: DataFrame) -> DataFrame:
    """``(conv, file)`` of ``events(conv, pos, role, file)``: distinct files touched after the conversation's last request."""
    last = events.where("role = 'user'").groupBy("conv").agg(F.max("pos").alias("_from"))
    return events.where("file IS NOT NULL").join(last, "conv", "left").where(F.col("_from").isNull() | (F.col("pos") > F.col("_from"))).select("conv", "file").distinct()


def consecutive_once(df: DataFrame, key: list[str], order: list[str], within: str) -> DataFrame:
    """Rows whose key differs from the row before (adjacent repeats only); nulls are equal.

    ``order`` should make rows unique within ``within``.  Rows are range-sorted into chunks: one value of ``within`` may hold a third of them.
    """
    columns = df.columns
    table = chunked(df.withColumn("_key", F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"{c}_") for c in key], *[F.col(c).isNull().alias(f"{c}_n") for c in key])), [within], order, "adjacent")
    return neighbour(table, [within], order, ["_key"], back=True).where("_prev__key IS NULL OR _prev__key <> _key").select(*columns)
