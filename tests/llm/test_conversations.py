"""Problem 2 against a plain version."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from weft.llm import conversations as C

SCHEMA = "call_id long, session_id string, timestamp long, query string, outcome string, kind string, agent string, recorded_at timestamp, channel string, part int"


def plain(calls, sessions):
    blank = lambda s: s is None or not s.strip()
    out = []
    for sid in set(sessions):
        rec = {}
        for c in calls:
            if c[1] is not None and c[1].strip().lower() == sid and (c[5] or "turn") != "delegation":
                ts = c[2] * 1000 if c[2] < 100_000_000_000 else c[2]
                key = (ts, c[3], c[4])
                rec[key] = min(c[0], rec.get(key, c[0]))
        msgs, ok = [], True
        for (ts, q, o), i in sorted(rec.items(), key=lambda x: (x[0][0], x[1])):
            mine = [("user", i)] * (not blank(q)) + [("assistant", i)] * (not blank(o))
            ok &= bool(mine)
            msgs += mine
        ok &= bool(msgs) and all(r == ("user", "assistant")[n % 2] for n, (r, _) in enumerate(msgs)) and len(msgs) % 2 == 0
        if ok:
            out += [(sid, n + 1, r, i) for n, (r, i) in enumerate(msgs)]
    return sorted(out)


def make(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        sid = rng.choice(["hot"] * 3 + [f"s{k}" for k in range(60)] + [None])
        sid = sid and rng.choice([sid, f" {sid}\t", sid.upper()])
        ts = rng.choice([1_700_000_000_000 + rng.randrange(10_000) * 1000, 1_700_000_000 + rng.randrange(10_000)])
        q, o = rng.choice([("q", "a"), ("q", "a"), ("q", "a"), ("q", None), (None, "a"), ("", " ")])
        rows.append((i, sid, ts, q and f"{q}{rng.randrange(5)}", o, rng.choice(["turn", None, "delegation"]), "me", datetime(2024, 1, 1), "x", 1))
    return rows + rng.sample(rows, n // 10)


def test_equals_plain_version(spark, rows):
    for seed in (1, 2):
        calls = make(260, seed)
        sessions = [f"s{k}" for k in range(55)] + ["s1", "unseen", "hot"]
        got = C.session_conversations(spark.createDataFrame(calls, SCHEMA), spark.createDataFrame([(s,) for s in sessions], "id string"))
        want = plain(calls, sessions)
        assert len(want) > 20
        assert rows(got) == want


def test_a_hot_session_spans_chunks(spark, rows):
    calls = [(i, "hot", 1_700_000_000_000 + i, "ask", "answer", None, None, None, None, None) for i in range(2000)]
    got = C.session_conversations(spark.createDataFrame(calls, SCHEMA), spark.createDataFrame([("hot",)], "id string"))
    assert rows(got) == sorted(("hot", 2 * i + k + 1, r, i) for i in range(2000) for k, r in ((0, "user"), (1, "assistant")))


def test_gaps_split_a_channel(spark, rows):
    minute = 60_000
    t = [0, 1, 2, 90, 91, 300]
    calls = [(i, None, 1_700_000_000_000 + m * minute, "q", "a" if i != 5 else None, None, "me", None, None, None) for i, m in enumerate(t)]
    rec = C.records(spark.createDataFrame(calls, SCHEMA), F.col("agent"))
    got = C.conversations(rec, gap_ms=30 * minute)
    assert rows(got, "channel", "part", "msg_no", "id") == [("me", 0, n, i) for n, i in enumerate((0, 0, 1, 1, 2, 2), 1)] + [("me", 1, n, i) for n, i in enumerate((3, 3, 4, 4), 1)]


def test_calibrated_gap(spark):
    calls = [(i, f"s{i // 50}", 1_700_000_000_000 + (i // 50) * 10**9 + (i % 50) * 1000, "q", "a", None, None, None, None, None) for i in range(500)]
    known = C.chunked(C.records(spark.createDataFrame(calls, SCHEMA), C.channel_of(F.col("session_id"))), ["channel"], ["ts", "id"])
    assert C.calibrated_gap(known) == 1000
    assert C.calibrated_gap(known.limit(0)) == 30 * 60 * 1000


def test_awkward_rows(spark, rows):
    calls = [(1, "a", None, "q", "r", None, None, None, None, None), (None, "a", 5, "q", "r", None, None, None, None, None), (3, None, 5, "q", "r", None, None, None, None, None), (4, "b", 5, "q" * 500_000, "　", None, None, None, None, None), (5, "b", 6, None, "r", None, None, None, None, None)]
    df = spark.createDataFrame(calls, SCHEMA)
    ids = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    assert rows(C.session_conversations(df, ids)) == [("b", 1, "user", 4), ("b", 2, "assistant", 5)]
    assert rows(C.session_conversations(df.limit(0), ids)) == []
    assert rows(C.session_conversations(df, ids.limit(0))) == []


def test_long_pauses_inside_a_session(spark, rows):
    """A pause between exchanges splits and comes together again; one between a question and its reply is found by the second look."""
    t0, day = 1_700_000_000_000, 86_400_000
    calls = [(i, "usual", t0 + i * 1000, "ask", "answer", None, None, None, None, None) for i in range(300)]
    calls += [(1000, "between", t0, "ask", "answer", None, None, None, None, None), (1001, "between", t0 + day, "more", "yes", None, None, None, None, None)]
    calls += [(2000, "within", t0, "ask", None, None, None, None, None, None), (2001, "within", t0 + day, None, "answer", None, None, None, None, None)]
    calls += [(3000, "broken", t0, "ask", "answer", None, None, None, None, None), (3001, "broken", t0 + day, "ask", None, None, None, None, None, None)]
    df, ids = spark.createDataFrame(calls, SCHEMA), [("usual",), ("between",), ("within",), ("broken",)]
    rec = C.chunked(C.records(df, C.channel_of(F.col("session_id"))), ["channel"], ["ts", "id"], "known")
    assert C.calibrated_gap(rec) < day
    got = rows(C.session_conversations(df, spark.createDataFrame(ids, "id string")))
    assert got == plain(calls, [i for i, in ids])
    assert [r[:2] for r in got if r[0] != "usual"] == [("between", 1), ("between", 2), ("between", 3), ("between", 4), ("within", 1), ("within", 2)]
