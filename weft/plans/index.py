"""Building and updating the index: files, nodes and edges out of source texts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import graph, resolve
from weft.plans.base import docs, query
from weft.plans.q_text import _CODE_LINES, _LINES, _NC
from weft.runtime import cut
from weft.sources import corpus, extract


class Index(NamedTuple):
    """``files(file_id, path, hash, language)``, ``nodes(id, file_id, name, kind, line, col, is_exported)``, ``edges(from_id, to_id, kind)``."""

    files: DataFrame
    nodes: DataFrame
    edges: DataFrame


def nodes_of(files: DataFrame) -> DataFrame:
    """The symbols of ``files(file_id, language, text)``; headings count as exported.  Ids rise with (file, line)."""
    cols = ["file_id", "name", "kind", "line", "col", "is_exported"]
    heads = extract.markdown_headings(files.where("language = 'markdown'")).withColumn("is_exported", F.lit(True)).select(*cols)
    found = heads.unionByName(extract.code_symbols(files).select(*cols))
    return found.select((F.col("file_id") * 1_000_000 + F.col("line")).alias("id"), *cols)


def references_of(files: DataFrame) -> DataFrame:
    """The unresolved references of ``files``, numbered."""
    return cut(extract.dependencies(files).distinct().withColumn("dep_id", F.monotonically_increasing_id()), "references")


def build(files: DataFrame) -> Index:
    """The whole index of ``files(file_id, path, language, text)``; two phases, so that calls resolve across all files."""
    nodes = cut(nodes_of(files), "nodes")
    hashed = files.select("file_id", "path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "language")
    return Index(hashed, nodes, resolve.resolve_edges(references_of(files), nodes))


def clear(old: Index) -> Index:
    """K6: an index of the same shape without a row."""
    return Index(*(t.limit(0) for t in old))


def update(old: Index, files: DataFrame) -> Index:
    """The index after a scan gave ``files``; ids of paths must not change.

    Changed and new files are parsed again, deleted ones go, and unchanged callers of either are resolved again, so an edge into a file
    that was edited stays as long as its target does.
    """
    now = files.select("file_id", "path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "language")
    changed = corpus.changed(now.select("path", "hash", "file_id"), old.files).select("file_id")
    gone = corpus.deleted(now, old.files).join(old.files.select("path", "file_id"), "path").select("file_id")
    touched = cut(changed.unionByName(gone).distinct(), "touched")
    repair = graph.callers_to_repair(old.edges, old.nodes, touched.select(F.col("file_id").alias("file")), now.select(F.col("file_id").alias("file")))
    again = cut(touched.unionByName(repair.select(F.col("file").alias("file_id"))).distinct(), "again")
    kept = old.nodes.join(touched, "file_id", "left_anti")
    nodes = cut(kept.unionByName(nodes_of(files.join(changed, "file_id", "left_semi")).select(*kept.columns)), "nodes")
    from_again = old.nodes.join(again, "file_id", "left_semi").select(F.col("id").alias("from_id"))
    into_touched = old.nodes.join(touched, "file_id", "left_semi").select(F.col("id").alias("to_id"))
    stay = old.edges.join(from_again, "from_id", "left_anti").join(into_touched, "to_id", "left_anti").select("from_id", "to_id", "kind")
    new = resolve.resolve_edges(references_of(files.join(again, "file_id", "left_semi")), nodes)
    return Index(now, nodes, stay.unionByName(new).distinct())


@query(rf"""WITH {_LINES}, c AS ({_CODE_LINES.replace("l AS (", "SELECT * FROM (", 1)} z),
w AS (SELECT doc_id AS file_id, trim(regexp_replace(x, '^\s*#{{1,6}}', ''), E' \t\r') AS name, line, x, length(regexp_extract(x, '^\s*(#{{1,6}})', 1)) + 1 AS col FROM l WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_type <> 'code')),
nodes AS (SELECT file_id * 1000000 + line AS id, file_id, name, line, col, true AS is_exported FROM w WHERE regexp_matches(x, '^\s*#{{1,6}}[^#].*$') AND name <> ''
  UNION ALL SELECT doc_id * 1000000 + line, doc_id, regexp_extract(x, '^\s*(?:pub(?:\([a-z]+\))? )?(?:async )?(?:fn|struct|enum|trait|impl(?:<[^>]*>)?)\s+(?:[\w:<>]+ for )?(\w+)', 1), line, length(regexp_extract(x, '^(\s*)', 1)) + 1, regexp_matches(x, '^\s*(?:pub\b|export\b)') FROM c
    WHERE regexp_matches(x, '^\s*(?:pub(?:\([a-z]+\))? )?(?:async )?fn\s+(\w+)|^\s*(?:pub )?(?:struct|enum|trait)\s+\w+|^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+ for )?\w+')),
a AS (SELECT doc_id AS file_id, line, string_split(regexp_extract(x, '^\s*use\s+([\w:]+)', 1), '::')[-1] AS name, 'import' AS kind FROM c WHERE regexp_matches(x, '^\s*use\s+[\w:]+')
  UNION ALL SELECT doc_id, line, unnest(regexp_extract_all(x, '[\w_]+::([\w_]+)\s*\(', 1)), 'function_call' FROM c
  UNION ALL SELECT doc_id, line, n, 'function_call' FROM (SELECT doc_id, line, x, unnest(regexp_extract_all(x, '([A-Za-z_]\w*)\s*\(', 1)) AS n FROM c) z
    WHERE n NOT IN ({_NC}) AND n <> regexp_extract(x, '^\s*(?:pub(?:\(crate\))? |async |pub async )?fn\s+([\w$]+)', 1)),
deps AS (SELECT row_number() OVER () AS dep_id, * FROM (SELECT DISTINCT * FROM a) q),
called AS (SELECT d.*, f.id AS caller FROM deps d ASOF JOIN nodes f ON d.file_id = f.file_id AND d.line >= f.line),
near AS (SELECT c.dep_id, min_by(n.id, (n.line, n.col, n.id)) AS target FROM called c JOIN nodes n ON n.file_id = c.file_id AND n.name = c.name AND n.id <> c.caller GROUP BY 1),
far AS (SELECT c.dep_id, CASE WHEN count(*) FILTER (WHERE n.is_exported) = 1 THEN min(n.id) FILTER (WHERE n.is_exported) WHEN count(*) FILTER (WHERE n.is_exported) = 0 AND count(*) = 1 THEN min(n.id) END AS target FROM called c JOIN nodes n ON n.name = c.name AND n.file_id <> c.file_id GROUP BY 1)
SELECT 'node' AS what, id AS a, NULL::BIGINT AS b FROM nodes UNION ALL
SELECT DISTINCT 'edge', c.caller, coalesce(x.target, y.target) FROM called c LEFT JOIN near x USING (dep_id) LEFT JOIN far y USING (dep_id) WHERE coalesce(x.target, y.target) <> c.caller""")
def e07_build_index(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of all documents."""
    built = build(docs(spark, d).select("file_id", "path", "language", "text"))
    edges = built.edges.select(F.lit("edge").alias("what"), F.col("from_id").alias("a"), F.col("to_id").alias("b")).distinct()
    return built.nodes.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(edges)
