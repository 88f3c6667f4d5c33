"""Building the index, and keeping it up to date."""

import zlib

from weft.plans import index
from weft.sources import extract

FILES = "file_id long, path string, language string, text string"
CALLER = (1, "a.rs", "rust", "pub fn caller() {\n    target();\n}")


def edges_by_name(ix, rows):
    names = {r.id: r["name"] for r in ix.nodes.collect()}
    return sorted((names[a], names[b]) for a, b in rows(ix.edges.select("from_id", "to_id")))


def test_update_repairs_callers(spark, rows):
    frame = lambda *fs: spark.createDataFrame([CALLER, *fs], FILES)
    first = index.build(frame((2, "b.rs", "rust", "pub fn target() {\n}"), (3, "c.md", "markdown", "# Notes\ntext")))
    assert edges_by_name(first, rows) == [("caller", "target")]
    edited = index.update(first, frame((2, "b.rs", "rust", "// moved down\n\npub fn target() {\n    caller();\n}"), (3, "c.md", "markdown", "# Notes\ntext")))
    assert edges_by_name(edited, rows) == [("caller", "target"), ("target", "caller")]
    moved = index.update(first, frame((4, "d.rs", "rust", "pub fn target() {\n}"), (3, "c.md", "markdown", "# Notes\ntext")))
    assert edges_by_name(moved, rows) == [("caller", "target")]
    gone = index.update(first, frame((3, "c.md", "markdown", "# Notes\ntext")))
    assert edges_by_name(gone, rows) == [] and rows(gone.nodes, "name") == [("Notes",), ("caller",)]
    same = index.update(first, frame((2, "b.rs", "rust", "pub fn target() {\n}"), (3, "c.md", "markdown", "# Notes\ntext")))
    assert rows(same.nodes, "id") == rows(first.nodes, "id") and rows(same.edges) == rows(first.edges)


def test_empty_corpus(spark, rows):
    ix = index.build(spark.createDataFrame([], FILES))
    assert rows(ix.nodes) == [] and rows(ix.edges) == []


def test_pdf(spark, rows):
    body = zlib.compress(b"BT (Hello) Tj [(wor) 3 (ld)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj << /Type /Pages >>\n2 0 obj << /Type /Page >>\n3 0 obj << /Type /Page >>\nstream\n" + body + b"\nendstream"
    got = extract.pdf_symbols(spark.createDataFrame([("a.pdf", pdf), ("b.pdf", b"no"), ("c.pdf", None)], "path string, content binary"))
    assert rows(got, "path", "name", "signature") == [("a.pdf", "Page 1", "Hello world"), ("a.pdf", "Page 2", None)]
