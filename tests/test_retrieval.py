"""Retrieval, rules, budgets and the pipeline on literal cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weft.operators import budget, retrieve, rules
from weft.plans import pipeline


def symbols(spark, *pairs):
    return spark.createDataFrame([(i, p, n, "function", 1) for i, (p, n) in enumerate(pairs)], "id long, path string, name string, kind string, line int")


def test_keywords():
    assert retrieve.keywords("fix the DB_pool, in é?") == ["fix", "the", "DB_pool"]
    assert retrieve.tokens("getAuthToken x_y HTTPServer") == ["get", "auth", "token", "x", "y", "httpserver"]


def test_tfidf_prefers_the_focused_file(spark):
    many = [("long.md", f"heading number {i} on pools and things") for i in range(28)]
    s = symbols(spark, *many, ("connection_pool.rs", "ConnectionPool"), ("connection_pool.rs", "leak_handles"), ("path_utils.rs", "truncate_unicode"))
    assert retrieve.tfidf_search(s, "sqlite connection pool leaks handles under load").first().path == "connection_pool.rs"
    assert retrieve.tfidf_search(s, "truncates unicode filenames").first().path == "path_utils.rs"


def test_substring_fallback(spark, rows):
    s = symbols(spark, ("a.rs", "authenticate"), ("a.rs", "authorizeUser"), ("b.rs", "apiRoute"))
    assert rows(retrieve.tfidf_search(s, "auth")) == [("a.rs", 0.3)]
    assert rows(retrieve.tfidf_search(s, "zzz")) == [] and rows(retrieve.tfidf_search(s, "!")) == []
    assert rows(retrieve.tfidf_search(s.limit(0), "auth")) == []


def test_bm25_variants(spark):
    d = spark.createDataFrame([("a", "cache cache miss"), ("b", "cache"), ("c", None), ("d", ""), ("e", "x_y other words")], "path string, text string")
    got = {r.path: r.score for r in retrieve.bm25_documents(d, ["Cache", "cache"]).collect()}
    idf = math.log((3 - 2 + 0.5) / (2 + 0.5) + 1)
    avg = (3 + 1 + 3) / 3  # single letters are no terms: "x_y other words" has two
    avg = (3 + 1 + 2) / 3
    assert got["a"] == pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg))) and set(got) == {"a", "b"}
    assert retrieve.bm25_documents(d, ["x_y"]).isEmpty()
    r = {x.path: x.score for x in retrieve.bm25_recall(d, "cache cache 節").collect()}
    idf = math.log(1 + (5 - 2 + 0.5) / (2 + 0.5))
    avg = (3 + 1 + 0 + 0 + 3) / 5
    assert r["b"] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 / avg))) and r["c"] == 0


def test_context_filters_after_the_limit(spark, rows):
    s = spark.createDataFrame([(i, "p", f"abc{i}", "x" if i < 6 else "y", 1) for i in range(10)], "id long, path string, name string, kind string, line int")
    assert rows(retrieve.context(s, "ABC", 3, "y"), "id") == []
    assert rows(retrieve.context(s, "a_c", 2), "id") == [(0,), (1,)]


def test_like_scores_weigh_specific_words(spark):
    s = symbols(spark, ("x", "add_a"), ("y", "add_b"), ("y", "jwt"), ("z", "add_c"))
    hits = retrieve.keyword_hits(s, "add jwt")
    sizes = s.groupBy("path").agg(F.count("*").alias("symbols"))
    got = {r.path: r.like for r in retrieve.like_scores(hits, sizes, 2).collect()}
    assert got["x"] == pytest.approx(1 / 3 / 2) and got["y"] == pytest.approx((1 / 3 + 1) / ((1 + math.log(2)) * 2))


# ---------------------------------------------------------------- rules

SECTION = "id long, file string, owner string, heading string, text string"


def test_relevance_and_budget(spark, rows):
    s = spark.createDataFrame([(1, "f", "me", "Cache", "always clear the cache"), (2, "f", "you", "Cache", "always clear the cache"), (3, "g", "you", None, "cache lockfile"), (4, "h", "you", "Other", None)], SECTION)
    got = {r.id: r.score for r in rules.relevant(s, ["cache", "lockfile"], "me").collect()}
    assert set(got) == {3} and got[3] == pytest.approx(math.log(1 + 4 / 3) + math.log(1 + 4))
    assert rows(rules.relevant(s.limit(0), ["cache"], "me")) == []


@pytest.mark.parametrize("seed", range(4))
def test_packing_equals_plain_version(spark, rows, seed):
    rng = random.Random(seed)
    items = [(i, float(rng.randrange(20)), rng.choice([0, 1, 3, 3, 3, 7, 50, 200])) for i in range(300)]
    used, want = 0, []
    for i, s, t in sorted(items, key=lambda x: (-x[1], x[0])):
        if used + t <= 100:
            used += t
            want.append(i)
    got = rules.within_budget(spark.createDataFrame(items, "id long, score double, tokens long"), 100)
    assert rows(got, "id") == sorted((i,) for i in want)


def test_conflicts_equal_brute_force(spark):
    rng = random.Random(1)
    words = [f"term{i}" for i in range(60)]
    data = []
    for i in range(60):
        base = data[rng.randrange(len(data))][4].split() if data and rng.random() < 0.5 else [rng.choice(words) for _ in range(14)]
        base = [w if rng.random() < 0.85 else rng.choice(words) for w in base]
        data.append((i, f"f{i:02d}", rng.choice(["x", "y", None]), rng.choice(["H", None]), " ".join(base)))
    got = [(r.id_a, r.id_b, round(r.similarity, 6)) for r in rules.conflicts(spark.createDataFrame(data, SECTION), 30).collect()]
    cnt = {i: {} for i, *_ in data}
    for i, _, _, h, t in data:
        for w in ((h or "") + " " + t).lower().split():
            if len(w) > 1:
                cnt[i][w] = cnt[i].get(w, 0) + 1
    df = {w: sum(w in c for c in cnt.values()) for c in cnt.values() for w in c}
    v = {i: {w: n * math.log(1 + len(data) / df[w]) for w, n in c.items()} for i, c in cnt.items()}
    norm = {i: math.sqrt(sum(x * x for x in c.values())) for i, c in v.items()}
    want = []
    for a in data:
        for b in data:
            shared = v[a[0]].keys() & v[b[0]].keys()
            sim = sum(v[a[0]][w] * v[b[0]][w] for w in shared) / (norm[a[0]] * norm[b[0]])
            if (a[1], a[3] or "") < (b[1], b[3] or "") and a[2] != b[2] and (a[3], a[4]) != (b[3], b[4]) and len(shared) >= 2 and 0.3 <= sim < 0.999:
                want.append((-round(sim, 9), a[1], b[1], a[0], b[0], round(sim, 6)))
    assert got == [(a, b, s) for *_, a, b, s in sorted(want)[:30]]
    with pytest.raises(ValueError):
        rules.conflicts(spark.createDataFrame([], SECTION), 0)


# ---------------------------------------------------------------- budget and pipeline


def test_estimates_and_levels(spark, rows):
    df = spark.createDataFrame([(180, 1), (3, 2), (None, 4), (0, 0)], "c long, s long")
    b = budget.base_tokens(F.col("c"), F.col("s"))
    assert rows(df.select(b.alias("b"), budget.estimate(b, 1).alias("x"), budget.estimate(b, 2).alias("y"))) == [(0, 0, 0), (45, 31, 11), (100, 70, 25), (200, 140, 50)]
    items = spark.createDataFrame([(100,), (200,)], "base long")
    assert [tuple(budget.choose_level(items, n).first()) for n in (300, 210, 75, 74)] == [(0, False, False), (1, True, False), (2, True, False), (2, True, True)]
    one = spark.range(1)
    assert one.select(budget.savings(F.lit(1000), F.lit(350)), budget.savings(F.lit(0), F.lit(0)), budget.savings(F.lit(200), F.lit(195)), budget.cost(F.lit(1_000_000), "claude-haiku"), budget.cost(F.lit(1000), "opus")).first()[:] == ("65%", "0%", "2%", "$0.80", "$0.02")


def test_rule_levels(spark, rows):
    files = spark.createDataFrame([("src/test_a.rs",), ("src/b.rs",), ("c.md",), ("d.py",)], "path string")
    r = spark.createDataFrame([("*.rs", 1), ("test_*", 2), ("src/b.rs", 0), ("c.md", 2), ("*.md", 1)], "pattern string, level int")
    assert rows(budget.rule_level(files, r)) == [("c.md", 2), ("d.py", None), ("src/b.rs", 0), ("src/test_a.rs", 2)]
    assert rows(budget.rule_level(files, r.limit(0))) == [(p, None) for p in ("c.md", "d.py", "src/b.rs", "src/test_a.rs")]


def test_pipeline(spark):
    md = "\n".join(f"# Heading {i} under load on pools\ntext" for i in range(28))
    files = [(1, "long.md", "markdown", md), (2, "connection_pool.rs", "rust", "pub struct ConnectionPool;\npub fn leak_handles() {\n    check();\n}\n"), (3, "other.rs", "rust", "fn nothing() {}"), (4, "empty.md", "markdown", None)]
    df = spark.createDataFrame(files, "file_id long, path string, language string, text string")
    got = pipeline.run_pipeline(df, "sqlite connection pool leaks handles under load").collect()
    assert got[0].path == "connection_pool.rs" and [r.rank for r in got] == sorted(r.rank for r in got)
    changed = spark.createDataFrame([("other.rs",), ("gone.rs",)], "path string")
    assert [r.path for r in pipeline.run_pipeline(df, "sqlite connection pool leaks handles", changed=changed).collect()][:1] == ["other.rs"]
    small = pipeline.run_pipeline(df, "connection pool leaks handles under load", max_tokens=20).collect()
    assert sum(r.tokens for r in small) <= 20
    assert pipeline.run_pipeline(df, "  ").isEmpty() and pipeline.run_pipeline(df.limit(0), "pool").isEmpty()


def test_pipeline_keeps_different_texts_under_one_path(spark):
    text = lambda i: f"# Connection pool {i}\n\nThe connection pool leaks handles under load, case {i}.\n"
    data = [(i, f"docs/p{i // 2}.md", "markdown", text(i)) for i in range(8)] + [(20, "docs/p0.md", "markdown", text(0)), (30, "docs/other.md", "markdown", "# Colours\n\nNothing of the kind.\n")]
    schema = "file_id long, path string, language string, text string"
    task = "connection pool leaks handles under load"
    df = spark.createDataFrame(data, schema)
    got = pipeline.run_pipeline(df, task).collect()
    assert sorted(r.file_id for r in got if r.path != "docs/other.md") == list(range(8))
    assert all(r.path == f"docs/p{r.file_id // 2}.md" for r in got if r.file_id < 8)
    assert pipeline.run_pipeline(spark.createDataFrame(data[::-1], schema).repartition(5), task).collect() == got
    changed = spark.createDataFrame([("docs/p3.md",), ("gone.md",)], "path string")
    rules = spark.createDataFrame([("docs/p3.md", 2)], "pattern string, level int")
    first = pipeline.run_pipeline(df, task, changed=changed, level_rules=rules).collect()
    assert sorted(r.file_id for r in first[:2]) == [6, 7] and {r.level for r in first[:2]} == {2} and len(first) == len(got)


def test_answer(spark, rows):
    text = lambda i: f"# Connection pool {i}\n\nThe connection pool leaks handles under load, case {i}.\n"
    df = spark.createDataFrame([(i, f"docs/p{i}.md", "markdown", text(i)) for i in range(4)] + [(9, "far.rs", "rust", "fn alone() {}")], "file_id long, path string, language string, text string")
    nodes = spark.createDataFrame([(i, i) for i in range(4)] + [(90, 9), (91, 9), (92, 10)], "id long, file_id long")
    edges = spark.createDataFrame([(0, 90), (91, 1), (92, 90), (2, 3)], "from_id long, to_id long")
    sections = spark.createDataFrame([(1, "CLAUDE.md", "claude-code", "Pools", "Close every connection."), (2, "AGENTS.md", "codex", "Pools", "Never close a connection."), (3, "AGENTS.md", None, None, "Colours.")], "id long, file string, owner string, heading string, text string")
    a = pipeline.answer(df, "connection pool leaks handles under load", edges, nodes, sections, agent="codex", session_id="s", now_ms=5)
    assert rows(a.files, "file_id") == [(0,), (1,), (2,), (3,)] and a.files.where("content LIKE '# Connection pool%'").count() == 4
    assert rows(a.related, "file", "total") == [(9, 2)]
    assert rows(a.rules, "id", "file", "heading") == [(1, "CLAUDE.md", "Pools")]
    s = a.summary.first()
    assert (s.n_files, s.level, s.adjusted, s.exceeded_by_rules, s.indexed_docs, s.file_types) == (4, 0, False, False, 4, {"md": 4})
    assert s.sent == sum(r.tokens for r in a.files.collect()) and s.saved == max(s.workspace - s.sent, 0)
    r = a.record.first()
    assert (r.query, r.agent, r.session_id, r.timestamp, r.tokens) == ("connection pool leaks handles under load", "codex", "s", 5, s.sent)
    assert r.files == [f"docs/p{i}.md" for i in range(4)] and r.symbols == [f"Connection pool {i}" for i in range(4)] and [x.file for x in r.rules] == ["CLAUDE.md"]
    empty = pipeline.answer(df.limit(0), "pool", edges, nodes, sections, agent="codex")
    assert empty.summary.first().sent == 0 and rows(empty.related) == [] and empty.record.first().files == []
    over = spark.createDataFrame([("*", 0)], "pattern string, level int")
    big = pipeline.answer(df, "connection pool leaks handles under load", max_tokens=30, level_rules=over).summary.first()
    assert big.exceeded_by_rules == (big.sent > 30)
    with pytest.raises(ValueError):
        pipeline.run_pipeline(df, "pool", level=3)
