"""Problem 2: rebuilding conversations from message rows, by sessionizing channels.

Rows are sorted by time within their channel (a session id, or the participant where there is
none), split at inactivity gaps longer than a calibrated limit, given roles, and kept only if
every question is answered.  Where a channel *is* a recorded session, the session is one conversation:
it is intact if all of its parts are, and otherwise looked at once more as a whole.

A channel may hold a third of all rows, so no step puts a channel into one task: rows are
range-sorted by (channel, time, id) into chunks, and positions are running totals over chunks.
With ``before`` messages ahead of it, a record is in place if its first role is the one due:
user at even positions, assistant at odd ones.  A conversation is intact if every record has a
message and is in place, and the number of messages is even and not 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.operators.prefix import CHUNK, chunked, null_safe, running_total
from weft.runtime import cut

SECONDS_BELOW = 100_000_000_000


def not_blank(c: Column) -> Column:
    """Whether a text holds more than white space (of any script)."""
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def channel_of(c: Column) -> Column:
    """A session id without surrounding blanks, in lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def records(calls: DataFrame, channel: Column) -> DataFrame:
    """``(channel, ts, id, ask, reply)``: one row per record, known by its smallest call id.

    Rows agreeing in channel, time, query and outcome (null only with null) are one record.  The
    texts are compared by 64-bit hashes within their channel and time.  Delegations are left out;
    a null kind counts as a turn.  Rows without channel or time are no records.
    """
    ts = F.when(F.col("timestamp") < SECONDS_BELOW, F.col("timestamp") * 1000).otherwise(F.col("timestamp"))
    rows = calls.where("coalesce(kind, 'turn') <> 'delegation'").select(
        channel.alias("channel"), ts.alias("ts"), F.col("call_id").alias("id"),
        F.col("query").isNull().alias("qn"), F.xxhash64("query").alias("qh"), F.col("outcome").isNull().alias("on"), F.xxhash64("outcome").alias("oh"),
        not_blank(F.col("query")).alias("ask"), not_blank(F.col("outcome")).alias("reply"),
    )
    rows = rows.where("channel IS NOT NULL AND ts IS NOT NULL AND id IS NOT NULL")
    return rows.groupBy("channel", "ts", "qn", "qh", "on", "oh", "ask", "reply").agg(F.min("id").alias("id")).select("channel", "ts", "id", "ask", "reply")


def with_previous(table: DataFrame) -> DataFrame:
    """Adds ``prev``: the time of the channel's record before this one, across chunks."""
    w = W.partitionBy("channel", CHUNK).orderBy("ts", "id")
    ends = table.groupBy("channel", CHUNK).agg(F.max("ts").alias("_end"))
    ends = ends.select("channel", CHUNK, F.lag("_end").over(W.partitionBy("channel").orderBy(CHUNK)).alias("_before"))
    return null_safe(table.withColumn("_lag", F.lag("ts").over(w)), ends, ["channel", CHUNK]).withColumn("prev", F.coalesce("_lag", "_before")).drop("_lag", "_before")


def calibrated_gap(recorded: DataFrame, share: float = 0.99) -> int:
    """The inactivity limit in ms: ``share`` of the pauses inside recorded sessions are no longer.

    ``recorded`` is a table of :func:`chunked` records whose channels are known sessions; without
    any pause the limit is 30 minutes.
    """
    got = with_previous(recorded).where("prev IS NOT NULL").agg(F.percentile_approx(F.col("ts") - F.col("prev"), share, 10_000).alias("g")).first()
    return int(got.g) if got.g is not None else 30 * 60 * 1000


def conversations(rec: DataFrame, gap_ms: int | None = None, channels: DataFrame | None = None, by_channel: bool = False) -> DataFrame:
    """``(channel, part, msg_no, role, id)`` of the intact conversations of ``records``.

    ``part`` counts a channel's conversations from 0; without ``gap_ms`` a channel is one conversation.
    With ``channels`` (a distinct column ``channel``) only those come out.  ``msg_no`` counts from 1 in the
    conversation, or ``by_channel`` over all messages of the channel (and the chunk comes out too).
    ``rec`` may be a table of :func:`chunked` already.  Ties in time are ordered by id.
    """
    table = rec if CHUNK in rec.columns else chunked(rec, ["channel"], ["ts", "id"], "records")
    if gap_ms is None:
        table = table.withColumn("part", F.lit(0).cast("long"))
    else:
        broken = cut(with_previous(table).withColumn("brk", F.coalesce((F.col("ts") - F.col("prev") > gap_ms).cast("long"), F.lit(0))).drop("prev"), "pauses")
        table = cut(running_total(broken, ["channel"], ["ts", "id"], F.col("brk"), "_part").withColumn("part", F.col("_part") + F.col("brk")).drop("_part", "brk"), "parts")
    n = F.col("ask").cast("long") + F.col("reply").cast("long")
    placed = running_total(table, ["channel", "part"], ["ts", "id"], n, "before")
    placed = running_total(placed, ["channel"], ["ts", "id"], n, "ahead") if by_channel else placed.withColumn("ahead", F.col("before"))
    placed = cut(placed, "placed")
    in_place = (n > 0) & (F.col("ask") == (F.col("before") % 2 == 0))
    by_chunk = placed.groupBy("channel", "part", CHUNK).agg(F.min(in_place).alias("ok"), F.sum(n).alias("n"))
    whole = by_chunk.groupBy("channel", "part").agg(F.min("ok").alias("ok"), F.sum("n").alias("n")).where("n > 0 AND ok AND n % 2 = 0")
    if channels is not None:
        whole = whole.join(channels, "channel", "left_semi")
    # the list of intact conversations goes back by (channel, part, chunk): a hot channel is spread over its chunks
    keep = by_chunk.select("channel", "part", CHUNK).join(whole.select("channel", "part"), ["channel", "part"], "left_semi")
    kept = placed.join(keep, ["channel", "part", CHUNK], "left_semi")
    user = F.when(F.col("ask"), F.struct(F.lit("user").alias("role"), (F.col("ahead") + 1).alias("msg_no")))
    answer = F.when(F.col("reply"), F.struct(F.lit("assistant").alias("role"), (F.col("ahead") + 1 + F.col("ask").cast("long")).alias("msg_no")))
    return kept.select("channel", "part", CHUNK, "id", F.inline(F.array_compact(F.array(user, answer)))).select("channel", "part", "msg_no", "role", "id", *([CHUNK] if by_channel else []))


def session_conversations(calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """The intact conversations of recorded sessions: ``(session_id, msg_no, role, call_id)``.

    Sessions are split at the pauses that are unusual inside sessions; one whose parts are all intact is intact as a whole.  A
    recorded session is one conversation however long its pauses are, so a session with a part that is not intact is
    looked at once more as a whole: a pause may lie between a question and its reply.  A session without rows, with
    an empty record, with roles out of turn or without a last reply does not come out.  Empty tables give no rows.
    """
    ids = sessions.where("id IS NOT NULL").select(F.col("id").alias("channel")).distinct()
    rec = chunked(records(calls, channel_of(F.col("session_id"))), ["channel"], ["ts", "id"], "records")
    parts = cut(conversations(rec, calibrated_gap(rec), ids, by_channel=True), "intact")
    # records without a message aside, a session is covered by its intact parts if these hold all of its messages
    n = F.col("ask").cast("long") + F.col("reply").cast("long")
    every = rec.groupBy("channel").agg(F.sum(n).alias("n"), F.min(n).alias("least")).where("least > 0")
    whole = cut(parts.groupBy("channel").agg(F.count("*").alias("n")).join(every, ["channel", "n"]).select("channel"), "whole")
    # lists of sessions go to the rows by (session, chunk): a hot session is spread over its chunks
    held = parts.select("channel", CHUNK).distinct().join(whole, "channel", "left_semi")
    found = parts.join(held, ["channel", CHUNK], "left_semi").drop(CHUNK).unionByName(conversations(rec, None, ids.join(whole, "channel", "left_anti")))
    return found.select(F.col("channel").alias("session_id"), F.col("msg_no").cast("long").alias("msg_no"), "role", F.col("id").alias("call_id"))
