"""File, folder and branch events as streams.

Every operator works on batch and streaming DataFrames alike, so its batch result is the test of its stream.  A state that still
waits for a timer when a stream ends comes out when the watermark passes it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.operators.prefix import chunked, neighbour, running_total
from weft.runtime import cut

EVENT = "event_time timestamp, path string, op string"


def settled(events: DataFrame, quiet_ms: int = 500, watermark: str = "5 seconds") -> DataFrame:
    """``(path, settled_at, op, n)``: what is done to a path, and after how many of its events.

    A create or change (re)starts the path's timer; when it was quiet for ``quiet_ms`` the last operation comes out, once.  A
    delete cancels the timer and comes out at once.  Batch input is range-sorted into chunks, so a path with a third of
    all events is no hot group; of events of one path at one time the order is that of ``op``.
    """
    if events.isStreaming:
        return _settled_stream(events, quiet_ms, watermark)
    table = chunked(events.where("path IS NOT NULL AND event_time IS NOT NULL").select("path", "event_time", "op"), ["path"], ["event_time", "op"], "file-events")
    gone = F.col("op") == "delete"
    alone = F.col("_next_event_time").isNull() | (F.unix_micros("_next_event_time") - F.unix_micros("event_time") >= quiet_ms * 1000)
    seen = neighbour(table, ["path"], ["event_time", "op"], ["event_time"]).withColumn("ends", (gone | alone).cast("long"))
    place = cut(seen.drop("_next_event_time"), "settling")
    bursts = running_total(place, ["path"], ["event_time", "op"], F.col("ends"), "burst").groupBy("path", "burst")
    out = bursts.agg(F.max(F.struct("event_time", "op")).alias("m"), F.max("ends").alias("ends"), F.count("*").alias("n")).where("ends = 1")
    at = F.when(F.col("m.op") == "delete", F.col("m.event_time")).otherwise(F.timestamp_micros(F.unix_micros("m.event_time") + quiet_ms * 1000))
    return out.select("path", at.alias("settled_at"), F.col("m.op").alias("op"), "n")


def _settled_stream(events: DataFrame, quiet_ms: int, watermark: str) -> DataFrame:
    columns = ["path", "settled_at", "op", "n"]
    quiet = pd.Timedelta(milliseconds=quiet_ms)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, op, n = state.get if state.exists else (0, "", 0)
        at, out = pd.Timestamp(last, unit="us"), []
        if state.hasTimedOut:
            out.append((key[0], at + quiet, op, n))
            n = 0
        else:
            rows = pd.concat(list(frames)).sort_values(["event_time", "op"])
            for t, o in zip(rows.event_time, rows.op):
                if n and t - at >= quiet:
                    out.append((key[0], at + quiet, op, n))
                    n = 0
                at, op, n = t, o, n + 1
                if o == "delete":
                    out.append((key[0], t, o, n))
                    n = 0
        if n:
            state.update((at.value // 1000, op, n))
            state.setTimeoutTimestamp(max(at.value // 1_000_000 + quiet_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=columns)

    src = events.where("path IS NOT NULL").withWatermark("event_time", watermark)
    return src.groupBy("path").applyInPandasWithState(step, "path string, settled_at timestamp, op string, n long", "last long, op string, n long", "append", GroupStateTimeout.EventTimeTimeout)


def folder_batches(events: DataFrame, every_ms: int = 1000, sync_ms: int = 0, watermark: str = "5 seconds") -> DataFrame:
    """``(workspace, batch_at, path, first_seen)`` of ``events(workspace, event_time, path)``: the distinct folders of each sync.

    The first candidate starts the timer, later ones don't move it; what comes while a sync of ``sync_ms`` is running is held
    and starts the timer when it ends.  Batch input is cut at pauses after which no timer and no sync can be left over; the parts are
    independent and are read in order with the state of one timer, so no group is collected.
    """
    cols, schema = ["workspace", "batch_at", "path", "first_seen"], "workspace string, batch_at timestamp, path string, first_seen timestamp"
    if events.isStreaming:
        return _folder_stream(events, every_ms, sync_ms, watermark, cols, schema)
    table = chunked(events.where("path IS NOT NULL AND event_time IS NOT NULL").select("workspace", "event_time", "path"), ["workspace"], ["event_time", "path"], "folder-events")
    pause = F.unix_micros("event_time") - F.unix_micros("_prev_event_time") >= (every_ms + 2 * sync_ms) * 1000
    seen = neighbour(table, ["workspace"], ["event_time", "path"], ["event_time"], back=True).withColumn("starts", F.coalesce(pause.cast("long"), F.lit(1)))
    parts = running_total(cut(seen.drop("_prev_event_time"), "pauses"), ["workspace"], ["event_time", "path"], F.col("starts"), "_before")
    parts = parts.select("workspace", (F.col("_before") + F.col("starts")).alias("part"), F.unix_micros("event_time").alias("t"), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, timer = None, _Timer(every_ms * 1000, sync_ms * 1000)
        for b in batches:
            out = []
            for w, part, t, p in zip(*(c.to_pylist() for c in b.columns)):
                if (w, part) != group:
                    out += [(group[0], *r) for r in timer.end()] if group else []
                    group, timer = (w, part), _Timer(every_ms * 1000, sync_ms * 1000)
                out += [(w, *r) for r in timer.add(t, p)]
            yield _micros(out)
        yield _micros([(group[0], *r) for r in timer.end()] if group else [])

    sorted_parts = parts.repartition("workspace", "part").sortWithinPartitions("workspace", "part", "t", "path")
    return sorted_parts.mapInArrow(run, "workspace string, batch_at long, path string, first_seen long").select("workspace", F.timestamp_micros("batch_at").alias("batch_at"), "path", F.timestamp_micros("first_seen").alias("first_seen"))


def _micros(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.int64())], ["workspace", "batch_at", "path", "first_seen"])


class _Timer:
    """The folder timer: candidates in order of time (microseconds) give batches ``(batch_at, path, first_seen)``."""

    def __init__(self, every: int, sync: int, fires: int | None = None, busy: int | None = None, held: dict[str, int] | None = None):
        self.every, self.sync, self.fires, self.busy, self.held = every, sync, fires, busy, held or {}

    def until(self, t: int) -> list[tuple[int, str, int]]:
        """What is handed on at or before the time ``t``."""
        if self.fires is None or self.fires > t:
            return []
        out = [(self.fires, p, s) for p, s in self.held.items()]
        self.busy, self.fires, self.held = self.fires + self.sync, None, {}
        return out

    def add(self, t: int, path: str) -> list[tuple[int, str, int]]:
        """A candidate; returns the batch that was due before it."""
        out = self.until(t)
        self.held.setdefault(path, t)
        if self.fires is None:
            self.fires = max(t, self.busy or t) + self.every
        return out

    def end(self) -> list[tuple[int, str, int]]:
        return self.until(self.fires) if self.fires is not None else []


def _folder_stream(events: DataFrame, every_ms: int, sync_ms: int, watermark: str, cols: list[str], schema: str) -> DataFrame:
    stamp = lambda us: pd.Timestamp(us, unit="us")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fires, busy, paths, seen = state.get if state.exists else (None, None, [], [])
        timer = _Timer(every_ms * 1000, sync_ms * 1000, fires, busy, dict(zip(paths, seen)))
        if state.hasTimedOut:
            out = timer.end()
        else:
            rows = pd.concat(list(frames)).sort_values(["event_time", "path"])
            out = [r for t, p in zip(rows.event_time, rows.path) for r in timer.add(t.value // 1000, p)]
        if timer.fires is not None:
            state.setTimeoutTimestamp(max(timer.fires // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        state.update((timer.fires, timer.busy, list(timer.held), list(timer.held.values())))
        if out:
            yield pd.DataFrame([(key[0], stamp(at), p, stamp(s)) for at, p, s in out], columns=cols)

    src = events.where("path IS NOT NULL").withWatermark("event_time", watermark)
    return src.groupBy("workspace").applyInPandasWithState(step, schema, "fires long, busy long, paths array<string>, seen array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def branch_changes(polls: DataFrame) -> DataFrame:
    """``(repo, event_time, before, ref)`` whenever a readable ref differs from the one before; the first is the baseline.

    Batch input is range-sorted into chunks (:mod:`weft.operators.prefix`), so a repository polled without end is no hot group.
    """
    if polls.isStreaming:
        return _branch_stream(polls)
    from pyspark.sql import Window as W

    from weft.operators.prefix import CHUNK, chunked, null_safe

    read = polls.where("ref IS NOT NULL").select("repo", "event_time", "ref")
    table = chunked(read, ["repo"], ["event_time"], "polls")
    last = table.groupBy("repo", CHUNK).agg(F.max_by("ref", "event_time").alias("_end"))
    carried = last.select("repo", CHUNK, F.lag("_end").over(W.partitionBy("repo").orderBy(CHUNK)).alias("_carry"))
    here = table.withColumn("_prev", F.lag("ref").over(W.partitionBy("repo", CHUNK).orderBy("event_time")))
    j = null_safe(here, carried, ["repo", CHUNK])
    return j.select("repo", "event_time", F.coalesce("_prev", "_carry").alias("before"), "ref").where("before IS NOT NULL AND before <> ref")


def _branch_stream(polls: DataFrame) -> DataFrame:
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("event_time")
        out = []
        for t, ref in zip(rows.event_time, rows.ref):
            if ref is not None:
                if last is not None and ref != last:
                    out.append((key[0], t, last, ref))
                last = ref
        if last is not None:
            state.update((last,))
        if out:
            yield pd.DataFrame(out, columns=["repo", "event_time", "before", "ref"])

    schema = "repo string, event_time timestamp, before string, ref string"
    return polls.where("ref IS NOT NULL").groupBy("repo").applyInPandasWithState(step, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def serial_queue(handle: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands each waiting path on once per batch, in order of arrival; one batch at a time."""

    def run(batch: DataFrame, number: int) -> None:
        handle(batch.groupBy("path").agg(F.min("event_time").alias("event_time"), F.max_by("op", "event_time").alias("op")).orderBy("event_time", "path"), number)

    return run
