"""Problem 5: change capture, replay after failures, and the rule against a plain version."""

import random
from datetime import datetime, timedelta

import pytest

from weft.operators import capture
from weft.runtime import new_path

T0 = datetime(2024, 1, 1)
FILES = "id long, path string, hash string, last_indexed timestamp, offset int, part int"
RUNS = "run_id long, status string, finished_at timestamp"
ITEMS = "run_id long, path string, hash string, done_at timestamp"


def plain(files, runs, items):
    norm = lambda p: p.replace("\\", "/").removeprefix("./")
    good = {r for r, s, f in runs if s == "ok" and f is not None}
    seen, now = {}, {}
    for r, p, h, t in items:
        if r in good and p is not None:
            seen[norm(p)] = max(seen.get(norm(p), (-1, T0, "")), (r, t, (h or "").lower()))
    for i, p, h, t in files:
        if h is not None and p is not None:
            now[norm(p)] = max(now.get(norm(p), (T0 - timedelta(9), -1, "")), (t, i, h.lower()))
    return sorted((i, "added" if p not in seen else "changed") for p, (t, i, h) in now.items() if p not in seen or seen[p][2] != h)


def make(seed, n=300):
    rng = random.Random(seed)
    path = lambda: rng.choice(["", "", "./"]) + f"d{rng.randrange(9)}" + rng.choice("/\\") + f"f{rng.randrange(12)}"
    digest = lambda: rng.choice("abcdef") + rng.choice(["", "A"])
    files = [(i, path(), rng.choice([digest(), digest(), None]), T0 + timedelta(minutes=rng.randrange(50))) for i in range(n)]
    runs = [(r, rng.choice(["ok", "ok", "failed", "killed"]), rng.choice([T0, T0, None])) for r in range(8)]
    items = [(rng.randrange(9), path(), digest().upper(), T0 + timedelta(seconds=rng.randrange(999))) for _ in range(n)]
    return files + files[:20], runs, items + items[:20]


def frames(spark, files, runs, items):
    return spark.createDataFrame([(*f, 1, 2) for f in files], FILES), spark.createDataFrame(runs, RUNS), spark.createDataFrame(items, ITEMS)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_plain_version(spark, rows, seed):
    data = make(seed)
    want = plain(*data)
    assert len(want) > 10
    assert rows(capture.pending_files(*frames(spark, *data))) == want


def test_batches_survive_failures(spark, rows):
    files = [(i, f"p{i % 7}", f"h{i}", T0 + timedelta(minutes=i)) for i in range(40)]
    cc = capture.ChangeCapture(spark, new_path(spark, "cc"))
    log = lambda n: capture.change_log(frames(spark, files[:n], [], [])[0])
    first = cc.run(log(20))
    assert rows(first, "id") == [(i,) for i in range(13, 20)]
    # a batch that dies after its write is replayed with the same ranges, though more rows have come
    assert cc.run(log(25), fail_before_commit=True) is None
    again = cc.run(log(40))
    assert rows(again, "id") == [(i,) for i in range(20, 25)]
    rest = cc.run(log(40))
    assert rows(rest, "id") == [(i,) for i in range(33, 40)]
    assert cc.run(log(40)) is None
    assert rows(cc.sink(), "path", "id") == sorted((f"p{i % 7}", i) for i in range(33, 40))
    with pytest.raises(Exception):
        cc._put("plan-0", {})


def test_awkward_rows(spark, rows):
    f, r, i = frames(spark, [(1, None, "h", T0), (2, "a", None, T0), (None, "b", "h", T0), (4, "c", "H", T0), (5, "c", "h", T0), (6, "x" * 100_000, "h", T0)], [(1, "ok", T0), (None, None, None)], [(1, None, "h", T0), (1, "c", None, T0)])
    # a run that attests a path without a hash attests nothing
    assert rows(capture.pending_files(f, r, i)) == [(5, "added"), (6, "added")]
    assert rows(capture.pending_files(f.limit(0), r, i)) == []
    assert rows(capture.pending_files(f, r.limit(0), i.limit(0))) == [(5, "added"), (6, "added")]


def test_kept_folder_with_late_rows_and_a_failed_run(spark, rows):
    at = lambda m: T0 + timedelta(minutes=m)
    first = [(1, "a", "a1", at(10)), (2, "b", "b1", at(20)), (3, "c", "c1", at(30)), (4, "d", "d1", at(40))]
    late = [(5, "./b", "b0", at(5)), (6, "c", "c2", at(50)), (7, "e", "e1", at(60))]
    runs = [(1, "ok", T0), (2, "failed", T0)]
    items = [(1, "b", "B1", T0), (1, "d", "d1", T0)]
    lost = [(2, p, f"{p}1", T0) for p in "ac"]  # handled by the run that failed
    folder = new_path(spark, "kept")
    assert rows(capture.pending_files(*frames(spark, first, runs[:1], items), folder)) == plain(first, runs[:1], items) == [(1, "added"), (3, "added")]
    # the current row of b is still the first one, and a comes out again
    again = frames(spark, first + late, runs, items + lost)
    assert rows(capture.pending_files(*again, folder)) == plain(first + late, runs, items + lost) == [(1, "added"), (6, "added"), (7, "added")]
    cc = capture.ChangeCapture(spark, folder)
    assert rows(cc.sink(), "path", "id") == [("a", 1), ("b", 2), ("c", 6), ("d", 4), ("e", 7)]
    # nothing new, then a batch that dies, with more rows before its replay
    assert rows(capture.pending_files(*again, folder)) == [(1, "added"), (6, "added"), (7, "added")]
    more = first + late + [(8, "f", "f1", at(70))]
    cc.run(capture.change_log(frames(spark, more, [], [])[0]), fail_before_commit=True)
    more += [(9, "g", "g1", at(80))]
    assert rows(capture.pending_files(*frames(spark, more, runs, items + lost), folder)) == plain(more, runs, items + lost)


@pytest.mark.parametrize("seed", [4, 5])
def test_any_batches_equal_one(spark, rows, seed):
    files, runs, items = make(seed)
    files.sort(key=lambda f: f[0])
    folder = new_path(spark, "kept")
    for n in (90, 91, 200, len(files)):
        assert rows(capture.pending_files(*frames(spark, files[:n], runs, items), folder)) == plain(files[:n], runs, items)
