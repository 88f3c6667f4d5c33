"""History, stores, extraction and streams on literal cases."""

import io
import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weft.operators import history
from weft.runtime import new_path, shared_dir
from weft.sources import corpus, extract, store
from weft.streaming import events

CALL = "call_id long, session_id string, timestamp long, kind string, turn_id string, parent_turn_id string, query string, outcome string, files array<string>, stale boolean"


def calls(spark, *rows):
    return spark.createDataFrame([(*r, None, None, None, False) if len(r) == 6 else r for r in rows], CALL)


def test_delegations(spark, rows):
    c = calls(spark, (1, "s", 100, "turn", "t1", None), (2, "s", 200, "turn", "t2", None), (3, "s", 150, "delegation", None, None), (4, "s", 250, "delegation", None, None), (5, "x", 10, "delegation", None, "t1"), (6, None, 90, "delegation", None, None), (7, "s", 200, "turn", "t3", None), (8, "s", 100, "delegation", None, None), (9, "s", 120, None, None, None))
    assert rows(history.parent_turns(c)) == [(3, 2), (4, None), (5, 1), (6, None), (8, 1)]
    assert rows(history.delegations(c)) == [(1, 5), (1, 8), (2, 3), (7, 3)]
    assert rows(history.parent_turns(c.limit(0))) == [] and rows(history.delegations(c.limit(0))) == []


def test_recall(spark):
    now = 1_700_000_000_000
    day = 86_400_000
    rec = lambda i, age, q, o=None: (i, "s", now - age * day, "turn", None, None, q, o, ["a/b.rs"], False)
    c = calls(spark, rec(1, 0, "fix the token cache"), rec(2, 1, "cache token order"), rec(3, 400, "x", "the token cache again"), rec(4, 5, None, None), rec(5, 1, "cache token order"), rec(6, 90, "cache token order"))
    got = [(r.call_id, r.grp) for r in history.recall(c, " Token Cache ", now).collect()]
    assert got == [(1, 0), (3, 0), (2, 1), (5, 1), (6, 1)]
    assert [r.call_id for r in history.recall(c, "  ", now, 3).collect()] == [1, 2, 5]


def test_upkeep(spark, rows):
    now = 100 * 86_400_000
    c = calls(spark, (1, "s", 0, "turn", None, None, "q" * 130, "o", ["x"], False), (2, "s", now, "turn", None, None, "q" * 130, None, None, False))
    once = history.folded(c, now, 30)
    assert rows(once.select(F.length("query"))) == [(120,), (130,)]
    assert rows(history.folded(once, now, 30), "query") == rows(once, "query")
    with pytest.raises(ValueError):
        history.folded(c, now, 0)
    assert rows(history.mark_stale(c, "x"), "call_id", "stale") == [(1, True), (2, False)]
    lines = spark.createDataFrame([("a", 2, "second"), ("a", 1, "first"), ("b", 3, "x"), (None, 4, "y")], "line string, pos long, v string")
    assert rows(history.first_of_line(lines, "line", "pos"), "line", "v") == [(None, "y"), ("a", "first"), ("b", "x")]


def test_transcripts(spark, rows):
    m = spark.createDataFrame([(1, 1, "user", "first"), (1, 2, "assistant", " done "), (1, 3, "user", "token = abcdef0123456789abcd"), (1, 4, "assistant", "  "), (2, 1, "assistant", "alone")], "conv long, pos long, role string, text string")
    assert rows(history.last_turn(m)) == [(1, "token = [REDACTED]", "done")]
    e = spark.createDataFrame([(1, 1, "user", None), (1, 2, "tool", "old"), (1, 3, "user", None), (1, 4, "tool", "new"), (1, 5, "tool", "new"), (2, 1, "tool", "only")], "conv long, pos long, role string, file string")
    assert rows(history.files_after_request(e)) == [(1, "new"), (2, "only")]


def test_stores(spark, rows):
    path = new_path(spark, "store")
    text = [json.dumps({"request": "q1", "timestamp": 5, "files": ["a"]}), "", "{broken", '"a string"', json.dumps({"query": "q2", "agent": "me", "tokens": 7})]
    spark.createDataFrame([(t,) for t in text], "value string").coalesce(1).write.text(path)
    good, bad = store.read_history(spark, path)
    assert rows(good, "query", "agent", "tokens", "stale") == [("q1", "unknown", 0, False), ("q2", "me", 7, False)]
    assert rows(bad) == [('"a string"',), ("{broken",)]
    assert rows(store.doctor(spark, path)) == [(2, 2)]
    store.append_history(good, path + "-out")
    store.append_history(good, path + "-out")
    assert store.read_history(spark, path + "-out")[0].count() == 4
    mem = new_path(spark, "memory")
    spark.createDataFrame([('{"sessions":[{"id":"s1","timestamp":1,"calls":[{"request":"r"},{"query":"x","session_id":"own"}]}]}',)], "value string").coalesce(1).write.text(mem)
    spark.createDataFrame([('{"sessions":[',)], "value string").coalesce(1).write.mode("append").text(mem)
    got, unreadable = store.read_memory(spark, mem)
    assert rows(got, "session_id", "query") == [("own", "x"), ("s1", "r")] and unreadable == 1


def test_scan(spark, rows, tmp_path):
    for p, t in (("src/a.rs", "fn a() {}"), (".git/x", "no"), ("node_modules/m.js", "no"), (".engine/history/2024-01.jsonl", "{}"), ("b.md", "# B"), ("c.log", "no")):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    got = corpus.scan(spark, str(tmp_path), ".engine/history/", ["*.log"], 100)
    assert rows(got, "path", "language") == [("b.md", "markdown"), ("src/a.rs", "rust")] or rows(got, "path", "language") == [(".engine/history/2024-01.jsonl", "jsonl"), ("b.md", "markdown"), ("src/a.rs", "rust")]
    import hashlib

    assert got.where("path = 'b.md'").first().hash == hashlib.sha256(b"# B").hexdigest()


def files(spark, *rows):
    return spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(rows)], "file_id long, language string, text string")


def test_documents(spark, rows):
    f = files(spark, ("markdown", "# One\n\nfirst body\n##Two\n### Three\r\nx\n#\n####### seven"), ("markdown", None))
    assert rows(extract.markdown_headings(f), "name", "line", "col", "signature") == [("One", 1, 2, "first body"), ("Three", 5, 4, "x"), ("Two", 4, 3, None)]
    j = files(spark, ("json", '{\n "a": 1,\n "b": {"c": 2}\n}'), ("json", "[1]"), ("json", "{oops"), ("jsonl", '\n{"x": 1}\n{"y": 2}'))
    assert rows(extract.json_keys(j.where("language = 'json'")), "file_id", "name", "line") == [(0, "a", 2), (0, "b", 3)]
    assert rows(extract.jsonl_keys(j.where("language = 'jsonl'")), "name") == [("x",)]
    x = files(spark, ("xml", "<?xml?><a><b/>\n<b></b><ns:c d='e'></a>"), ("html", "<!DOCTYPE html><P class=x>text</P> 3 < 4"))
    assert rows(extract.tag_names(x), "file_id", "name", "line") == [(0, "a", 1), (0, "b", 1), (0, "ns:c", 2), (1, "P", 1)]


def test_code(spark, rows):
    f = files(
        spark,
        ("rust", "use crate::graph::Store;\npub struct A;\nimpl A {\n    fn b() { c(); }\n}\npub fn c() { Store::open(1); if (x) {} }"),
        ("typescript", "import { X, Y } from './m';\nimport * as z from 'z';\nconst q = require('q');\nexport class K {}\nexport async function run() { new X(); z.go(); }"),
        ("python", "from m.n import a as b, (c)\nimport os\nclass P:\n    def f(self): return g(1)\nprint(h())"),
        ("go", "func (r *Repo) Save() { flush() }\nfunc main() { defer close(x) }\ntype T struct {}"),
        ("markdown", "call(me)"),
    )
    assert rows(extract.code_symbols(f), "file_id", "name", "kind", "is_exported") == [(0, "A", "class", False), (0, "A", "struct", True), (0, "b", "function", False), (0, "c", "function", True), (1, "K", "class", True), (1, "run", "function", True), (2, "P", "class", False), (2, "f", "function", False), (3, "Save", "method", False), (3, "T", "type", False), (3, "main", "function", False)]
    got = rows(extract.dependencies(f), "file_id", "name", "kind")
    call = "function_call"
    assert got == sorted(
        [(0, "Store", "import"), (0, "c", call), (0, "open", call), (0, "open", call), (1, "X", "import"), (1, "Y", "import"), (1, "z", "import"), (1, "q", "import"), (1, "require", call), (1, "X", "type_reference"), (1, "X", call), (1, "go", call), (1, "go", call), (2, "a", "import"), (2, "c", "import"), (2, "g", call), (2, "h", call), (3, "flush", call), (3, "close", call)]
    )


def test_office(spark, rows):
    def archive(**parts):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n, t in parts.items():
                z.writestr(n.replace("__", "/"), t)
        return b.getvalue()

    w = '<w:document xmlns:w="w"><w:t>Hello</w:t><w:t>world</w:t></w:document>'
    s = '<p xmlns:a="a"><a:t>{}</a:t></p>'
    book = '<workbook xmlns="m"><sheets><sheet name="Data"/><sheet name="Notes"/></sheets></workbook>'
    data = [("d.docx", archive(**{"word__document.xml": w})), ("p.pptx", archive(**{f"ppt__slides__slide{i}.xml": s.format(f"no {i}") for i in (1, 2, 10)})), ("x.xlsx", archive(**{"xl__workbook.xml": book})), ("bad.docx", b"junk"), ("null.docx", None)]
    got = extract.office_symbols(spark.createDataFrame(data, "path string, content binary"))
    assert rows(got, "path", "name", "signature") == [("d.docx", "d.docx", "Hello world"), ("p.pptx", "Slide 1", "no 1"), ("p.pptx", "Slide 2", "no 10"), ("p.pptx", "Slide 3", "no 2"), ("x.xlsx", "Data", None), ("x.xlsx", "Notes", None)]


def folders(spark, rows, t0):
    # the first candidate starts the timer and later ones don't move it; what comes during a sync waits for its end
    ev = [("w", ms, p) for ms, p in ((0, "a"), (900, "b"), (950, "a"), (1000, "c"), (1999, "d"), (2500, "e"), (9000, "f"))] + [("v", 0, "a"), ("v", 5000, "a"), (None, 7, "x"), ("w", 5, None)]
    df = spark.createDataFrame([(w, t0 + timedelta(milliseconds=ms), p) for w, ms, p in ev], "workspace string, event_time timestamp, path string")
    at = lambda t: round((t - t0).total_seconds() * 1000)
    shaped = lambda got: [(w, at(b), p, at(s)) for w, b, p, s in rows(got, "workspace", "batch_at", "path", "first_seen")]
    plain = shaped(events.folder_batches(df))
    assert plain == [(None, 1007, "x", 7), ("v", 1000, "a", 0), ("v", 6000, "a", 5000), ("w", 1000, "a", 0), ("w", 1000, "b", 900), ("w", 2000, "c", 1000), ("w", 2000, "d", 1999), ("w", 3500, "e", 2500), ("w", 10000, "f", 9000)]
    slow = shaped(events.folder_batches(df, sync_ms=700))
    assert [r for r in slow if r[0] == "w"] == [("w", 1000, "a", 0), ("w", 1000, "b", 900), ("w", 2700, "c", 1000), ("w", 2700, "d", 1999), ("w", 2700, "e", 2500), ("w", 10000, "f", 9000)]
    assert rows(events.folder_batches(df.limit(0))) == []
    src, out, state = new_path(spark, "fo"), new_path(spark, "fo-out"), new_path(spark, "fo-state")
    df.unionByName(spark.createDataFrame([("zz", t0 + timedelta(hours=1), "late")], df.schema)).coalesce(1).write.parquet(src)
    q = events.folder_batches(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    q.awaitTermination()
    assert shaped(spark.read.parquet(out)) == plain


def test_streams_equal_batches(spark, rows):
    t0 = datetime(2024, 1, 1)
    ev = [("a", 0, "create"), ("a", 300, "change"), ("a", 2000, "change"), ("b", 100, "change"), ("b", 200, "delete"), ("z", 900_000, "change")]
    df = spark.createDataFrame([(t0 + timedelta(milliseconds=ms), p, op) for p, ms, op in ev], events.EVENT)
    batch = rows(events.settled(df), "path", "op", "n")
    assert batch == [("a", "change", 1), ("a", "change", 2), ("b", "delete", 2), ("z", "change", 1)]
    # a delete acts at once, cancels what waits, and what comes after it starts anew
    more = [("c", 0, "change"), ("c", 100, "delete"), ("c", 200, "create"), ("c", 699, "change"), ("c", 1199, "change"), ("d", 0, "delete"), ("d", 10, "delete")]
    got = events.settled(spark.createDataFrame([(t0 + timedelta(milliseconds=ms), p, op) for p, ms, op in more], events.EVENT))
    at = lambda t: round((t - t0).total_seconds() * 1000)
    assert [(p, at(t), o, n) for p, t, o, n in rows(got, "path", "settled_at", "op", "n")] == [("c", 100, "delete", 2), ("c", 1199, "change", 2), ("c", 1699, "change", 1), ("d", 0, "delete", 1), ("d", 10, "delete", 1)]
    assert rows(events.settled(df.limit(0))) == []
    src = new_path(spark, "ev")
    df.write.parquet(src)
    out, state = new_path(spark, "ev-out"), new_path(spark, "ev-state")
    q = events.settled(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    q.awaitTermination()
    assert rows(spark.read.parquet(out), "path", "op", "n") == batch[:3]  # the last burst is still open
    folders(spark, rows, t0)
    polls = spark.createDataFrame([("r", t0 + timedelta(seconds=i), x) for i, x in enumerate(["m", "m", None, "f", "f", "m"])], "repo string, event_time timestamp, ref string")
    assert rows(events.branch_changes(polls), "before", "ref") == [("f", "m"), ("m", "f")]


def test_backup_and_listings(spark, rows):
    path = new_path(spark, "kept")
    assert store.backup(spark, path, 5) is None
    spark.range(3).write.parquet(path)
    to = store.backup(spark, path, 5)
    assert spark.read.parquet(to).count() == 3
    spark.range(1).write.parquet(path)
    with pytest.raises(RuntimeError):
        store.backup(spark, path, 5)
    assert corpus.changed_paths("a/b\0c d\0") == ["a/b", "c d"]
    for bad in ("-x", "a\nb", ""):
        with pytest.raises(ValueError):
            corpus.changed_paths("", bad)


def test_token_counts(spark, rows):
    from weft.functions.tokens import count_tokens, encoding

    df = spark.createDataFrame([("Hello world",), (None,), ("",), ("日本 <|endoftext|>",)], "s string")
    assert rows(df.select("s", count_tokens(F.col("s")).alias("n"))) == sorted(((s, len(encoding().encode_ordinary(s)) if s else 0) for s in ("Hello world", None, "", "日本 <|endoftext|>")), key=lambda r: (r[0] is not None, r[0]))


def test_shared_folder(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == named if named else shared_dir(spark).startswith("file:///")


def test_repair_and_compaction(spark, rows):
    line = lambda i, q="q": json.dumps({"query": q, "timestamp": i, "own": i})
    path = new_path(spark, "kept")
    data = [line(1), "{broken", line(2), "", line(1), "[1]", line(3, "x" * 300)]
    spark.createDataFrame([(x,) for x in data], "value string").coalesce(1).write.text(path)
    assert store.repair_history(spark, path, 10) == {"good": 4, "bad": 2}
    assert [r.value for r in spark.read.text(path).collect()] == [line(1), line(2), line(1), line(3, "x" * 300)]
    assert sorted(r.value for r in spark.read.text(path + ".quarantine").collect()) == ["[1]", "{broken"]
    assert spark.read.text(path + ".bak-10").count() == 7
    assert store.repair_history(spark, path, 11) == {"good": 4, "bad": 0}  # nothing to do: no backup
    with pytest.raises(ValueError):
        store.compact_history(spark, path, 12, 0, 0)
    assert spark.read.text(path).count() == 4
    assert store.compact_history(spark, path, 13) == {"before": 4, "after": 3}
    assert [r.value for r in spark.read.text(path).collect()] == [line(1), line(2), line(3, "x" * 300)]
    store.compact_history(spark, path, 14, now_ms=10**12, fold_days=1)
    got = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert [r["timestamp"] for r in got] == [1, 2, 3] and len(got[2]["query"]) == 120 and got[0]["own"] == 1
    assert spark.read.text(path + ".bak-14").count() == 3


def test_session_log_and_memory(spark, rows):
    path = new_path(spark, "log")
    store.session_log(spark, path, "fix it", "done", ["a.rs"], agent="codex", session_id="s1", kind="turn", now_ms=3)
    store.session_log(spark, path, "next", now_ms=4)
    for bad in ({"request": " "}, {"request": "x", "kind": "other"}):
        with pytest.raises(ValueError):
            store.session_log(spark, path, **bad)
    good, wrong = store.read_history(spark, path)
    assert rows(good, "query", "agent", "session_id", "kind") == [("fix it", "codex", "s1", "turn"), ("next", "unknown", None, None)] and wrong.isEmpty()
    memory = {r.id: r for r in store.by_session(good.select("session_id", "timestamp", "query")).collect()}
    assert memory["s1"].timestamp == 3 and [c.query for c in memory["s1"].calls] == ["fix it"]


def test_session_recall_shows_links(spark):
    cols = "call_id long, session_id string, timestamp long, query string, outcome string, symbols array<string>, files array<string>, tokens long, stale boolean, agent string, rules array<struct<file:string,heading:string,hash:string>>, turn_id string, parent_turn_id string, kind string, commit_sha string, test_exit int"
    data = [
        (1, "s", 10, "part one", "ok", [], None, 5, None, "helper", None, None, None, "delegation", None, 1),
        (2, "s", 20, "the whole " + "y" * 80, "", ["a", "b", "c", "d", "e", "f"], ["x.rs"], 7, True, None, [("R.md", "H", "0123456789")], "t1", None, "turn", "abcdef123456", None),
        (3, None, 30, "named", None, None, None, 0, False, "other", None, None, "t1", "delegation", "ffff", None),
    ]
    got = {r.call_id: r for r in history.session_recall(spark.createDataFrame(data, cols), "", 100, 20).collect()}
    assert [got[i].rank for i in (3, 2, 1)] == [1, 2, 3]
    assert got[1].delegated_by == got[3].delegated_by == ("the whole " + "y" * 80)[:60]
    assert got[2].delegations == "helper (test_exit 1), other" and got[2].commit == "abcdef12" and got[2].symbols == "a, b, c, d, e, … (+1 more)" and got[2].rules == "R.md#H (01234567)"
    assert got[2].stale and got[2].outcome is None and got[3].commit is None and got[1].symbols is None
    assert [r.call_id for r in history.session_recall(spark.createDataFrame(data, cols), "named", 100, 20).collect()] == [3]
    assert history.session_recall(spark.createDataFrame([], cols), "named", 100).isEmpty()


def test_ignore_files(spark, rows):
    rules = corpus.Ignore([(".gitignore", "*.log\n!keep.log\n/build\nsrc/**/gen/\ntmp/\n\\#odd\nq?[!a]x\n# no rule\n  \n"), ("a/.gitignore", "!*.log\nlocal\n"), ("a/.ignore", "b.log\n")], extra="*.bak\nkeep.log\n")
    out = ["x.log", "build/y.rs", "src/gen/z.rs", "src/a/b/gen/z.rs", "tmp/keep.log", "d/tmp/e.rs", "#odd", "q1bx", "a/local", "a/d/local/f.rs", "a/b.log", "o.bak", "a/o.bak"]
    kept = ["keep.log", "sub/build/y.rs", "gen/z.rs", "tmp", "odd", "q1ax", "a/x.log", "local", "d/local.rs", "src/gen.rs"]
    assert [p for p in out if not rules.file(p)] == [] and [p for p in kept if rules.file(p)] == []
    df = spark.createDataFrame([(p, 1) for p in out + kept] + [(None, 2)], "path string, n int")
    assert rows(corpus.unignored(df, rules), "path") == sorted((p,) for p in kept)
    listing = spark.createDataFrame([("s/.gitignore", b"*.o\n"), ("s/other", b"x"), (".ignore", b"\xff*.p\n")], "path string, content binary")
    read = corpus.ignore_rules(listing)
    assert read.file("s/a.o") and not read.file("a.o")
    with pytest.raises(ValueError):
        corpus.ignore_rules(listing, most=1)
    now, before = (spark.createDataFrame(x, "path string, hash string") for x in ([("a", "1"), ("b", "2"), ("d", None)], [("a", "1"), ("b", "3"), ("c", "4"), ("d", None)]))
    assert rows(corpus.scan_difference(now, before)) == [("b", "changed"), ("c", "deleted")]


def test_instruction_files(spark, rows):
    data = [("CLAUDE.md", b"ok"), ("AGENTS.md", b"\xff"), ("GEMINI.md", b"x" * 65537), (".cursor/rules/a.mdc", "日本".encode()), ("../CLAUDE.md", b"out"), ("README.md", b"no"), (".clinerules/../b.md", b"out"), ("CONVENTIONS.md", None)]
    got = corpus.instruction_files(spark.createDataFrame(data, "path string, content binary"))
    assert rows(got) == [(".cursor/rules/a.mdc", "cursor", "日本"), ("CLAUDE.md", "claude-code", "ok")]
