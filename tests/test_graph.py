"""Graph, resolution and as-of operators on literal relations."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import asof, graph, overview, prefix, resolve
from weft.sources import corpus

NODE = "id long, file_id string, name string, kind string, line int, col int, is_exported boolean"


def nodes(spark, *rows):
    return spark.createDataFrame([(i, f, n, "function", ln, 1, x) for i, f, n, ln, x in rows], NODE)


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "function_call") for a, b in pairs], "from_id long, to_id long, kind string")


@pytest.fixture
def four(spark):
    n = nodes(spark, (1, "a.rs", "alpha", 1, True), (2, "b.rs", "beta", 1, True), (3, "c.rs", "gamma", 1, True), (4, "d.rs", "delta", 1, True))
    return n, edges(spark, (1, 3), (3, 1), (1, 2))


def test_related_files(spark, four, rows):
    n, e = four
    pivots = spark.createDataFrame([("a.rs",), ("b.rs",)], "file string")
    assert rows(graph.related_files(e, n, pivots)) == [("c.rs", 2)]
    assert rows(graph.related_files(e, n, pivots.limit(0), 5)) == []


def test_neighbours_and_dependents(spark, four, rows):
    n, e = four
    assert rows(graph.neighbours(e, n, incoming=False), "id", "other_name") == [(1, "beta"), (1, "gamma"), (3, "alpha")]
    assert rows(graph.neighbours(e, n, incoming=True), "id", "other_name") == [(1, "gamma"), (2, "alpha"), (3, "alpha")]
    assert rows(graph.file_dependents(e, n)) == [("a.rs", "c.rs"), ("b.rs", "a.rs"), ("c.rs", "a.rs")]


def test_impact(spark, rows):
    e = edges(spark, (2, 1), (3, 2), (1, 3), (4, 3), (4, 2), (9, 8))
    start = spark.createDataFrame([(1,)], "id long")
    assert rows(graph.impact(e, start)) == [(2, 1), (3, 2), (4, 2)]
    assert rows(graph.impact(e, start, 1)) == [(2, 1)]
    assert rows(graph.impact(e, start.limit(0))) == []
    long = edges(spark, *[(i + 1, i) for i in range(1, 25)])
    assert rows(graph.impact(long, start)) == [(i + 1, i) for i in range(1, 25)]


def test_replace_and_delete(spark, rows):
    n = nodes(spark, (1, "a", "a_old", 1, True), (2, "b", "b", 1, True))
    e = edges(spark, (2, 1), (1, 2))
    kept, left = graph.replace_symbols(n, e, spark.createDataFrame([("a",)], "file_id string"), n.limit(0))
    assert rows(kept, "id") == [(2,)] and rows(left) == []
    files = spark.createDataFrame([("a", "a"), ("b", "b")], "id string, path string")
    f, n2, e2 = graph.delete_files(files, n, e, spark.createDataFrame([("b",)], "id string"))
    assert rows(f, "id") == [("a",)] and rows(n2, "id") == [(1,)] and rows(e2) == []


def test_symbol_spans(spark, rows):
    n = nodes(spark, (1, "a", "x", 1, True), (2, "a", "y", 10, True), (3, "b", "z", 5, True))
    assert rows(graph.symbol_spans(n, F.lit(99)), "id", "end_line") == [(1, 9), (2, 99), (3, 99)]


def deps(spark, *rows_):
    return spark.createDataFrame([(i, *r, "function_call") for i, r in enumerate(rows_)], "dep_id long, file_id string, line int, name string, kind string")


def test_resolution(spark, rows):
    n = nodes(spark, (1, "a", "main", 1, False), (2, "a", "help", 10, False), (3, "b", "far", 1, True), (4, "b", "dup", 5, True), (5, "c", "dup", 5, True), (6, "c", "private", 9, False), (7, "a", "main", 20, False))
    d = deps(
        spark,
        ("a", 3, "help"),  # same file
        ("a", 4, "far"),  # other file, exported once
        ("a", 5, "dup"),  # ambiguous
        ("a", 12, "help"),  # only itself: nothing elsewhere
        ("a", 2, "main"),  # not the caller, but the second of the name
        ("a", 3, "private"),  # not exported, but unique
        ("b", 1, "nothing"),
        ("c", 2, "far"),  # before the first symbol
    )
    assert rows(resolve.resolve_edges(d, n), "from_id", "to_id") == [(1, 2), (1, 3), (1, 6), (1, 7)]
    assert rows(resolve.resolve_edges(d.limit(0), n)) == []


def test_enclosing_ties(spark, rows):
    n = spark.createDataFrame([(1, "a", "x", "f", 5, 9, True), (2, "a", "y", "f", 5, 2, True), (3, "a", "z", "f", 7, 1, True)], NODE)
    assert rows(resolve.enclosing(deps(spark, ("a", 5, "q"), ("a", 6, "q"), ("a", 7, "q"), ("a", 4, "q")), n)) == [(0, 2), (1, 2), (2, 3)]


@pytest.mark.parametrize("forward", [False, True])
def test_asof_equals_plain_version(spark, forward):
    rng = random.Random(7)
    key = lambda: rng.choice(["hot", "hot", "hot", "k1", "k2", None])
    left = [(i, key(), rng.randrange(300)) for i in range(400)]
    right = [(i, key(), rng.randrange(300)) for i in range(300)]
    got = {r.id: r.match for r in asof.asof(spark.createDataFrame(left, "id long, k string, at long"), spark.createDataFrame(right, "id long, k string, at long"), "k", "at", "id", F.col("id"), forward, F.col("id")).collect()}
    for i, k, t in left:
        ok = [(r_t, r_i) for r_i, r_k, r_t in right if k is not None and r_k == k and (r_t >= t if forward else r_t <= t)]
        best = (min(ok) if forward else min(ok, key=lambda x: (-x[0], x[1])))[1] if ok else None
        assert got[i] == best


def test_running_total(spark):
    rng = random.Random(2)
    data = [(rng.choice(["hot", "hot", "x", None]), i, rng.choice([None, 1, 2, 5])) for i in range(500)]
    table = prefix.chunked(spark.createDataFrame(data, "k string, o long, v int"), ["k"], ["o"])
    assert table.where("k = 'hot'").select("_chunk").distinct().count() > 1
    got = {r.o: r.t for r in prefix.running_total(table, ["k"], ["o"], F.col("v"), "t").collect()}
    sums = {}
    for k, o, v in data:
        assert got[o] == sums.get(k, 0)
        sums[k] = sums.get(k, 0) + (v or 0)


def test_scan_differences(spark, rows):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    assert rows(corpus.changed(now, before)) == [("b", "2"), ("d", "1")] and rows(corpus.changed(before, before)) == []
    assert rows(corpus.deleted(now, before)) == [("c",)]


def test_roots_and_folders(spark, rows):
    df = spark.createDataFrame([("/w/a",), ("/w",), ("/wx",), ("C:/Dev/x",), ("/w/sub/z",)], "path string")
    assert rows(df.select("path", corpus.rooted(F.col("path"), ["/w", "/w/sub", "c:/dev"]))) == [("/w", "/w"), ("/w/a", "/w"), ("/w/sub/z", "/w"), ("/wx", None), ("C:/Dev/x", "c:/dev")]
    files = spark.createDataFrame([("a/b/c.rs",), ("d.rs",)], "path string")
    ev = spark.createDataFrame([("a", False, False), ("a/b", False, False), ("x", True, True), ("x2", True, False), ("d.rs", False, True)], "path string, exists boolean, has_source boolean")
    assert rows(corpus.folder_needs_pass(ev, files)) == [("a", True), ("a/b", True), ("d.rs", False), ("x", True), ("x2", False)]


def test_overview_on_nothing(spark, rows):
    calls = spark.createDataFrame([], "sent long, saved long")
    assert rows(overview.token_usage(calls)) == [(0, 0, 0, 0, "0%")]
    files = spark.createDataFrame([], "id long, path string, language string, char_count long")
    assert rows(overview.workspace_tokens(files)) == [(0,)]
