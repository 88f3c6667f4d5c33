"""Text and path functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from weft.functions import paths as P
from weft.functions import text as T


@pytest.fixture
def ev(spark):
    """Evaluate an expression of one string."""

    def run(f, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").select("i", f(F.col("s")).alias("r"))
        got = [r.r for r in df.orderBy("i").collect()]
        return got[0] if len(values) == 1 else got

    return run


def test_tokenizers(ev):
    assert ev(T.identifier_terms, "getAuthToken", "get_auth_token", "HTTP_SERVER", "fix JWT validation bug", "HTTPServer", "", None) == [["get", "auth", "token"], ["get", "auth", "token"], ["http", "server"], ["fix", "jwt", "validation", "bug"], ["httpserver"], [], None]
    assert ev(T.document_terms, "A bc é_Xy", "") == [["bc", "é", "xy"], []]
    assert ev(T.recall_terms, "Ab a_1 節点X 記", "") == [["ab", "a_1", "節", "点", "記", "節点"], []]
    assert ev(T.rule_terms, "The _cache_ of x 節点録 記", "") == [["cache", "節点", "点録", "記"], []]


def test_redaction(ev):
    key = "sk-" + "a1" * 12
    assert ev(T.redact_secrets, f"use {key} now") == "use [REDACTED] now"
    assert ev(T.redact_secrets, 'token = "abcdef0123456789abcd"') == 'token = "[REDACTED]"'
    assert ev(T.redact_secrets, "password: short1") == "password: short1"
    assert ev(T.redact_secrets, "secret = compute_secret_value_1234(") == "secret = compute_secret_value_1234("
    assert ev(T.redact_secrets, "token = all_letters_no_digit_here") == "token = all_letters_no_digit_here"
    once = ev(T.redact_secrets, f"api_key={key} token: AKIA{'A1' * 8}")
    assert ev(T.redact_secrets, once) == once and key not in once


def test_fold_and_lists(ev, spark):
    long = "x" * 130
    fold = lambda c: T.fold(c, F.lit(True))
    assert ev(fold, long, "short") == ["x" * 119 + "…", "short"]
    assert ev(fold, ev(fold, long)) == "x" * 119 + "…"
    lists = spark.createDataFrame([(list("abcdefg"),), (["a"],), ([],)], "a array<string>")
    assert [r[0] for r in lists.select(T.capped_list(F.col("a"))).collect()] == ["a, b, c, d, e, … (+2 more)", "a", ""]


def test_blank_lines_and_breaks(ev):
    assert ev(T.collapse_blank, "a\n\n \n\nb  \n\n", "\n\nx", "", None) == ["a\n\nb", "\nx", "", None]
    assert ev(T.trim_breaks, "---\n\nbody\n* * *\nmore\n\n___\n", "---\n***", "x", None) == ["body\n* * *\nmore", "", "x", None]
    assert ev(T.sanitize, "a\x00b\n\tc\x7f") == "ab\n\tc"


def test_markdown_compress(ev):
    text = "# Head\n\nplain text\n- item\n> quote\n1. first\n---\n```\ncode line\n\nmore\n```\nend"
    assert ev(T.markdown_compress, text) == "# Head\n- item\n> quote\n1. first\n---\n```\ncode line\n\nmore\n```"


def test_rule_sections(ev):
    text = "---\ntitle: x\n---\nintro\n# One ##\nbody\n```\n# not a heading\n```\n---\n#### deep\n## Empty\n\n---\n# Two\r\nlast\n~~~\n# inside"
    got = ev(T.rule_sections, text)
    assert [(s.heading, s.text) for s in got] == [("", "intro"), ("One", "body\n```\n# not a heading\n```\n---\n#### deep"), ("Two", "last\n~~~\n# inside")]
    import hashlib

    assert got[0].hash == hashlib.sha256(b"\nintro").hexdigest()
    assert ev(T.rule_sections, "", None) == [[], None]


def test_levels(ev):
    rust = "// note\npub fn a(x: u8) -> u8 {\n    x /* in */\n}\n\n\n\nstruct B;\n"
    at = lambda lv, lang: lambda c: T.compress(c, F.lit(lang), F.lit(lv))
    assert ev(at(0, "rust"), rust) == rust and ev(at(7, "rust"), rust) == rust
    assert "note" not in ev(at(1, "rust"), rust) and "\n\n\n" not in ev(at(1, "rust"), rust)
    assert ev(at(2, "rust"), rust).splitlines() == ["pub fn a(x: u8) -> u8 { ... }", "struct B; { ... }"]
    assert ev(at(2, "unknown"), "first\nsecond") == "first"


def test_content_text(ev):
    assert ev(T.content_text, '"  hi "', '""', '[{"type":"text","text":"a"},{"type":"tool_use","name":"x"},{"type":"text","text":"b"}]', '[{"type":"text","text":"<system-reminder>x</system-reminder>"}]', '[{"type":"text","text":"<system-reminder>a</system-reminder> body <system-reminder>b</system-reminder>"}]', "{}") == ["hi", None, "a\nb", None, "<system-reminder>a</system-reminder> body <system-reminder>b</system-reminder>", None]


def test_small_functions(ev):
    assert ev(T.agent_id, "a b/ç-1") == "a_b__-1"
    assert ev(lambda c: T.relativize(c, "/w"), "/w/a\\b", "/x/y") == ["a/b", "/x/y"]
    assert ev(lambda c: T.prefix_match(c, "AU"), "author", "x") == [True, False]
    for pattern, want in (("*", [True, True]), ("*.rs", [True, False]), ("test_*", [True, False]), ("a.py", [False, True])):
        assert ev(lambda c, p=pattern: T.glob_match(c, F.lit(p)), "test_a.rs", "a.py") == want


def test_paths(ev):
    assert ev(P.language_of, "a/b.rs", "b.TS", "Makefile", ".gitignore", "x.tar.gz", "d.htm", None) == ["rust", "unknown", "unknown", "unknown", "unknown", "html", None]
    assert ev(P.skipped, "src/a.rs", ".git/x", "a\\node_modules\\b", "out/x", "outer/x") == [False, True, True, True, False]
    assert ev(lambda c: P.skipped(c, ".engine/history/"), ".engine/history/a.jsonl", ".engine/x") == [False, True]
    assert ev(P.owner_of, "CLAUDE.md", ".cursor/rules/a/b.mdc", ".clinerules/x.md", "docs/CLAUDE.md", "/CLAUDE.md", "../AGENTS.md", "C:/AGENTS.md") == ["claude-code", "cursor", "cline", None, None, None, None]
    assert ev(P.absolute, "/a//b/./c/../d/", "e:\\dev\\x", "\\\\?\\E:\\dev", "\\\\?\\UNC\\srv\\share\\d", "\\\\srv\\share", "/a/../..", "rel/x", "", "/", "\\\\?\\Volume\\x") == ["/a/b/d", "E:/dev/x", "E:/dev", "//srv/share/d", "//srv/share", None, None, None, "/", None]
    assert ev(lambda c: P.private_place(c, "/home/u"), "/home/u/.ssh/id", "/home/u/AppData/Local/Temp/x", "/home/u/Library/x", "/home/u/src/.x", "/home/u2/.ssh") == [True, False, True, False, False]
    assert ev(lambda c: P.private_place(c, "C:/Users/u"), "C:/Users/u/appdata/x", "C:/Users/u/appdata/local/temp/x") == [True, False]


def test_queries_leave_out_no_row(spark, rows, tmp_path):
    from weft.plans.registry import QUERIES

    fence = "# One\nalpha\n```\n# no heading\n```\n# Two\nbeta"
    # ids at which the queries put nothing into a text or path
    docs = [(2, fence), (5, "---\nkey: v\n---\n# Three\ngamma"), (8, "# Four\n~~~\n# none\n~~~\ndelta"), (11, "# Five\nepsilon"), (14, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    files = [(4, "a/../b.rs"), (8, "a//c.rs"), (12, "a/./d.rs"), (16, "e.rs"), (20, None)]
    spark.createDataFrame(files, "id long, path string").write.parquet(f"{tmp_path}/files.parquet")
    run = lambda q: QUERIES[q](spark, str(tmp_path))
    assert rows(run("x10_rule_sections"), "doc_id", "heading") == [(2, "One"), (2, "Two"), (5, "Three"), (8, "Four"), (11, "Five")]
    assert rows(run("x12_markdown_compress"), "doc_id") == [(2,), (5,), (8,), (11,)]
    assert rows(run("s21_absolute")) == [(4, "/home/u/b.rs"), (8, "/home/u/a/c.rs"), (12, "/home/u/a/d.rs"), (16, "/home/u/e.rs")]
