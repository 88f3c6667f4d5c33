"""Queries on the graph: neighbours, coupling, impact, resolution, replacement, roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import graph, overview, resolve, retrieve
from weft.plans.base import FILES_SQL, GRAPH, NODES_SQL, edges, files, nodes, query
from weft.runtime import cut, read_table
from weft.sources import corpus


@query("SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_size AS line FROM part WHERE lower(p_name) LIKE '%r_d%' ORDER BY id LIMIT 50")
def f01_symbol_search(spark: SparkSession, d: str) -> DataFrame:
    """F1, F17; the underscore is a wildcard."""
    return retrieve.like_hits(nodes(spark, d), "R_d", 50).select("id", "name", "kind", "line")


@query("SELECT * FROM (SELECT p_partkey AS id, p_name AS name, p_type AS kind, 1.0::DOUBLE AS score FROM part WHERE lower(p_name) LIKE '%blue%' ORDER BY id LIMIT 20) x WHERE kind = (SELECT min(p_type) FROM part) ORDER BY id LIMIT 10")
def f02_r10_context(spark: SparkSession, d: str) -> DataFrame:
    """The kind filter comes after the limit."""
    n = nodes(spark, d)
    kind = n.agg(F.min("kind").alias("k")).first().k
    return retrieve.context(n, "blue", 10, kind).select("id", "name", "kind", "score")


@query(GRAPH + "SELECT id, file_id, name FROM nodes WHERE name = 'blue rod' AND is_exported")
def f03_f04_exact_exported(spark: SparkSession, d: str) -> DataFrame:
    """F3, F4, E14."""
    return nodes(spark, d).where("name = 'blue rod' AND is_exported").select("id", "file_id", "name")


@query(GRAPH + "SELECT id, file_id, line FROM nodes WHERE name = 'blue rod' AND file_id = 'Brand#11' UNION ALL SELECT -id, file_id, line FROM nodes WHERE name = 'blue rod'")
def e14_symbol(spark: SparkSession, d: str) -> DataFrame:
    """In one file, and in all for an unknown one (negative ids)."""
    n = nodes(spark, d)
    f = n.select(F.col("file_id").alias("id"), F.col("file_id").alias("path")).distinct()
    one, every = overview.symbol(n, f, "blue rod", "Brand#11"), overview.symbol(n, f, "blue rod", "no such file")
    return one.select("id", "file_id", "line").unionByName(every.select((-F.col("id")).alias("id"), "file_id", "line"))


@query("SELECT 'core/folder/' AS prefix, bool_or(starts_with(path, 'core/folder/')) AS found FROM files")
def f05_prefix_exists(spark: SparkSession, d: str) -> DataFrame:
    hit = not read_table(spark, d, "files").where(F.col("path").startswith("core/folder/")).limit(1).isEmpty()
    return spark.createDataFrame([("core/folder/", hit)], "prefix string, found boolean")


@query(f"SELECT id, path, char_count FROM ({FILES_SQL}) f WHERE id = 7 OR path = (SELECT path FROM files WHERE id = 11 LIMIT 1)")
def f06_f14_lookups(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "files")
    path = t.where("id = 11").select("path").limit(1)
    f = files(spark, d)
    return f.where("id = 7").unionByName(f.join(path, "path", "left_semi")).select("id", "path", "char_count").distinct()


@query(GRAPH + "SELECT e.from_id AS id, e.to_id AS other_id, n.name AS other_name, e.kind FROM edges e JOIN nodes n ON n.id = e.to_id")
def j02_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """J1, J2, E15 outgoing."""
    return graph.neighbours(edges(spark, d), nodes(spark, d), incoming=False)


@query(GRAPH + "SELECT e.to_id AS id, e.from_id AS other_id, n.name AS other_name, e.kind FROM edges e JOIN nodes n ON n.id = e.from_id")
def j03_dependents(spark: SparkSession, d: str) -> DataFrame:
    """J3, E15 incoming."""
    return graph.neighbours(edges(spark, d), nodes(spark, d), incoming=True)


@query(GRAPH + "SELECT e.to_id AS id, e.from_id AS other_id, n.name AS other_name, e.kind FROM edges e JOIN nodes n ON n.id = e.from_id WHERE e.to_id IN (SELECT id FROM nodes WHERE name = 'blue rod')")
def e15_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """E15."""
    return graph.dependencies(edges(spark, d), nodes(spark, d), "blue rod", "in")


@query(GRAPH + "SELECT DISTINCT b.file_id AS callee, a.file_id AS caller FROM edges e JOIN nodes a ON a.id = e.from_id JOIN nodes b ON b.id = e.to_id WHERE a.file_id <> b.file_id")
def j04_file_dependents(spark: SparkSession, d: str) -> DataFrame:
    """J4, U2."""
    return graph.file_dependents(edges(spark, d), nodes(spark, d))


_FE = ", fe AS (SELECT a.file_id AS f, b.file_id AS t, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.from_id JOIN nodes b ON b.id = e.to_id WHERE a.file_id <> b.file_id GROUP BY 1, 2)"


@query(GRAPH.rstrip() + _FE + " SELECT file, sum(n)::BIGINT AS total FROM (SELECT f AS piv, t AS file, n FROM fe UNION ALL SELECT t, f, n FROM fe) u WHERE piv IN ('Brand#11', 'Brand#23') AND file NOT IN ('Brand#11', 'Brand#23') GROUP BY 1 ORDER BY total DESC, file LIMIT 10")
def j05_related_files(spark: SparkSession, d: str) -> DataFrame:
    """J5, G3, U1."""
    pivots = spark.createDataFrame([("Brand#11",), ("Brand#23",)], "file string")
    return graph.related_files(edges(spark, d), nodes(spark, d), pivots, 10)


_HALVES = "now_ AS (SELECT DISTINCT path, coalesce(hash, '') AS hash FROM files WHERE id % 5 <> 0), before_ AS (SELECT DISTINCT path, coalesce(hash, '') AS hash FROM files WHERE id % 7 <> 0)"


def _scans(spark, d):
    t = read_table(spark, d, "files").select("id", "path", F.coalesce("hash", F.lit("")).alias("hash"))
    return t.where("id % 5 <> 0").drop("id").distinct(), t.where("id % 7 <> 0").drop("id").distinct()


@query(f"WITH {_HALVES} SELECT path, hash, 'changed' AS state FROM (SELECT * FROM now_ EXCEPT SELECT * FROM before_) x UNION ALL SELECT DISTINCT path, NULL, 'deleted' FROM before_ WHERE path NOT IN (SELECT path FROM now_)")
def j06_j07_scan_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two scans, made from the versions of all files."""
    now, before = _scans(spark, d)
    gone = corpus.deleted(now, before).select("path", F.lit(None).cast("string").alias("hash"), F.lit("deleted").alias("state"))
    return corpus.changed(now, before).withColumn("state", F.lit("changed")).unionByName(gone)


@query(GRAPH.rstrip() + _FE + ", touched AS (SELECT 'Brand#11' AS file UNION ALL SELECT 'Brand#23'), present AS (SELECT DISTINCT file_id AS file FROM nodes WHERE file_id <> 'Brand#12') SELECT DISTINCT f AS file FROM fe WHERE t IN (SELECT file FROM touched) AND f NOT IN (SELECT file FROM touched) AND f IN (SELECT file FROM present)")
def j08_g05_callers_to_repair(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    touched = spark.createDataFrame([("Brand#11",), ("Brand#23",)], "file string")
    return graph.callers_to_repair(edges(spark, d), n, touched, n.where("file_id <> 'Brand#12'").select(F.col("file_id").alias("file")))


#: References stand for order lines: the part's brand is the file, the quantity the line, another part's name the name.
_DEPS_SQL = "deps AS (SELECT row_number() OVER () AS dep_id, * FROM (SELECT a.p_brand AS file_id, l.l_quantity::INT AS line, b.p_name AS name, l.l_returnflag AS kind FROM lineitem l JOIN part a ON a.p_partkey = l.l_partkey JOIN part b ON b.p_partkey = l.l_suppkey) x)"


def _deps(spark, d):
    n = read_table(spark, d, "part")
    t = read_table(spark, d, "lineitem").join(n.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("file_id")), "l_partkey")
    t = t.join(n.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("name")), "l_suppkey")
    t = t.select("file_id", F.col("l_quantity").cast("int").alias("line"), "name", F.col("l_returnflag").alias("kind"))
    return cut(t.withColumn("dep_id", F.monotonically_increasing_id()), "deps")


_ENCL = f"""WITH nodes AS ({NODES_SQL}), {_DEPS_SQL}, firsts AS (SELECT file_id, line, min_by(id, (col, id)) AS id FROM nodes GROUP BY 1, 2),
called AS (SELECT d.*, f.id AS caller FROM deps d ASOF JOIN firsts f ON d.file_id = f.file_id AND d.line >= f.line)"""


@query(_ENCL + " SELECT file_id, line, caller, count(*) AS n FROM called GROUP BY 1, 2, 3")
def j09_enclosing_symbol(spark: SparkSession, d: str) -> DataFrame:
    """Backward as-of."""
    deps = _deps(spark, d)
    got = deps.join(resolve.enclosing(deps, nodes(spark, d)), "dep_id")
    return got.groupBy("file_id", "line", "caller").agg(F.count("*").alias("n"))


_NEAR = ", near AS (SELECT c.dep_id, min_by(n.id, (n.line, n.col, n.id)) AS target FROM called c JOIN nodes n ON n.file_id = c.file_id AND n.name = c.name AND n.id <> c.caller GROUP BY 1)"
_FAR = ", far AS (SELECT c.dep_id, CASE WHEN count(*) FILTER (WHERE n.is_exported) = 1 THEN min(n.id) FILTER (WHERE n.is_exported) WHEN count(*) FILTER (WHERE n.is_exported) = 0 AND count(*) = 1 THEN min(n.id) END AS target FROM called c JOIN nodes n ON n.name = c.name AND n.file_id <> c.file_id GROUP BY 1)"


@query(_ENCL + _NEAR + " SELECT target, count(*) AS n FROM near GROUP BY 1")
def j10_local_target(spark: SparkSession, d: str) -> DataFrame:
    deps, n = _deps(spark, d), nodes(spark, d)
    got = resolve.local_targets(deps.join(resolve.enclosing(deps, n), "dep_id"), n)
    return got.groupBy("target").agg(F.count("*").alias("n"))


def _rarer(sql: str) -> str:
    """Names that few parts share, so that some are unique elsewhere."""
    return sql.replace("p_name AS name, p_type", "p_name || ' ' || p_partkey % 997 AS name, p_type").replace("b.p_name AS name", "b.p_name || ' ' || b.p_partkey % 997 AS name")


@query(_rarer(_ENCL + _FAR) + " SELECT target, count(*) AS n FROM far WHERE target IS NOT NULL GROUP BY 1")
def j11_j19_unique_target(spark: SparkSession, d: str) -> DataFrame:
    rare = lambda key: F.concat_ws(" ", "p_name", (F.col(key) % 997).cast("string"))
    n = nodes(spark, d).withColumn("name", F.concat_ws(" ", "name", (F.col("id") % 997).cast("string")))
    p = read_table(spark, d, "part")
    t = read_table(spark, d, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("file_id")), "l_partkey")
    t = t.join(p.select(F.col("p_partkey").alias("l_suppkey"), rare("p_partkey").alias("name")), "l_suppkey").select("file_id", F.col("l_quantity").cast("int").alias("line"), "name")
    deps = cut(t.withColumn("dep_id", F.monotonically_increasing_id()), "deps")
    return resolve.unique_elsewhere(deps, n).join(resolve.enclosing(deps, n), "dep_id", "left_semi").groupBy("target").agg(F.count("*").alias("n"))


@query(_ENCL + _NEAR + _FAR + " SELECT DISTINCT c.caller AS from_id, coalesce(a.target, b.target) AS to_id, c.kind FROM called c LEFT JOIN near a USING (dep_id) LEFT JOIN far b USING (dep_id) WHERE coalesce(a.target, b.target) <> c.caller")
def j12_resolve_edges(spark: SparkSession, d: str) -> DataFrame:
    """J12, K3, Z6."""
    return resolve.resolve_edges(_deps(spark, d), nodes(spark, d))


@query(GRAPH.replace("WITH ", "WITH RECURSIVE ").rstrip() + ", r(id, depth) AS (SELECT 17::BIGINT, 0 UNION SELECT e.from_id, depth + 1 FROM r JOIN edges e ON e.to_id = r.id WHERE depth < 3) SELECT id, min(depth) AS depth FROM r WHERE id <> 17 GROUP BY 1")
def g01_impact_depth_3(spark: SparkSession, d: str) -> DataFrame:
    """G1, E3, G4."""
    return graph.impact(edges(spark, d), spark.createDataFrame([(17,)], "id long"), 3)


@query(GRAPH.replace("WITH ", "WITH RECURSIVE ").rstrip() + ", r(id) AS (SELECT 17::BIGINT UNION SELECT e.from_id FROM r JOIN edges e ON e.to_id = r.id), c AS (SELECT count(*) AS n FROM r WHERE id <> 17) SELECT n.file_id AS file, count(*) AS symbols, CASE WHEN c.n = 0 THEN 'none' WHEN c.n <= 5 THEN 'low' WHEN c.n <= 20 THEN 'medium' ELSE 'high' END AS severity FROM r JOIN nodes n ON n.id = r.id, c WHERE r.id <> 17 GROUP BY 1, c.n")
def g02_a14_impact_unlimited(spark: SparkSession, d: str) -> DataFrame:
    """By file, with the severity of the whole."""
    hit = cut(graph.impact(edges(spark, d), spark.createDataFrame([(17,)], "id long")), "impact")
    n = hit.count()
    return hit.join(nodes(spark, d), "id").groupBy(F.col("file_id").alias("file")).agg(F.count("*").alias("symbols")).withColumn("severity", graph.severity(F.lit(n)))


@query(GRAPH + "SELECT id, file_id, line, coalesce(lead(line) OVER (PARTITION BY file_id ORDER BY line, col, id) - 1, 60) AS end_line FROM nodes")
def w01_symbol_spans(spark: SparkSession, d: str) -> DataFrame:
    return graph.symbol_spans(nodes(spark, d), F.lit(60)).select("id", "file_id", "line", "end_line")


@query(GRAPH + "SELECT file_id, min_by(name, id) AS first_symbol FROM nodes GROUP BY 1")
def w04_first_symbol(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).groupBy("file_id").agg(F.min_by("name", "id").alias("first_symbol"))


@query(GRAPH.rstrip() + ", gone AS (SELECT id FROM nodes WHERE file_id = 'Brand#11') SELECT 'node' AS what, id AS a, NULL::BIGINT AS b FROM nodes WHERE file_id <> 'Brand#11' UNION ALL SELECT 'edge', from_id, to_id FROM edges WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'node', -1, NULL")
def k02_k05_replace_symbols(spark: SparkSession, d: str) -> DataFrame:
    """K2, K4, K5, K14."""
    n = nodes(spark, d)
    new = n.limit(1).select(F.lit(-1).cast("long").alias("id"), F.lit("Brand#11").alias("file_id"), *[c for c in n.columns if c not in ("id", "file_id")])
    ns, es = graph.replace_symbols(n, edges(spark, d), spark.createDataFrame([("Brand#11",)], "file_id string"), new)
    return ns.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(es.select(F.lit("edge").alias("what"), F.col("from_id").alias("a"), F.col("to_id").alias("b")))


@query(f"WITH old AS ({FILES_SQL}), new AS (SELECT DISTINCT path FROM files WHERE id % 9 = 0) SELECT path, coalesce(hash, '') AS hash FROM old WHERE path NOT IN (SELECT path FROM new) UNION ALL SELECT path, 'new' FROM new")
def k01_upsert(spark: SparkSession, d: str) -> DataFrame:
    """K1, E8."""
    old = files(spark, d).withColumn("hash", F.coalesce("hash", F.lit("")))
    new = read_table(spark, d, "files").where("id % 9 = 0").select("path").distinct().select("path", F.lit("x").alias("language"), F.lit("new").alias("hash"), F.lit(0).cast("long").alias("char_count"))
    return corpus.upsert(old, new).select("path", "hash")


@query("WITH f AS (SELECT DISTINCT replace(path, chr(92), '/') AS path FROM files) SELECT e.path, coalesce(bool_or(starts_with(f.path, e.path || '/')), false) AS needed FROM (SELECT DISTINCT string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS path FROM f) e LEFT JOIN f ON starts_with(f.path, e.path || '/') GROUP BY 1")
def f16_folder_needs_pass(spark: SparkSession, d: str) -> DataFrame:
    """F16, E9."""
    f = read_table(spark, d, "files").select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path")).distinct()
    ev = f.select(F.concat_ws("/", F.get(F.split("path", "/"), F.lit(0)), F.get(F.split("path", "/"), F.lit(1))).alias("path")).distinct().select("path", F.lit(False).alias("exists"), F.lit(False).alias("has_source"))
    return corpus.folder_needs_pass(ev, f)


# ---------------------------------------------------------------- roll-ups


@query(GRAPH + f"SELECT 'files' AS what, count(*) AS n FROM ({FILES_SQL}) f UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges")
def a01_stats(spark: SparkSession, d: str) -> DataFrame:
    """A1, E6."""
    return overview.stats(files(spark, d), nodes(spark, d), edges(spark, d))


@query(GRAPH + "SELECT file_id, count(*) AS symbols FROM nodes GROUP BY 1")
def a02_symbols_per_file(spark: SparkSession, d: str) -> DataFrame:
    return overview.symbols_per_file(nodes(spark, d))


@query(f"SELECT language, count(*) AS n FROM ({FILES_SQL}) f GROUP BY 1")
def a03_languages(spark: SparkSession, d: str) -> DataFrame:
    """A3, E4."""
    return overview.languages(files(spark, d))


@query(f"SELECT floor(coalesce(sum(char_count), 0) / 4)::BIGINT AS tokens FROM ({FILES_SQL}) f")
def a04_workspace_tokens(spark: SparkSession, d: str) -> DataFrame:
    return overview.workspace_tokens(files(spark, d))


@query("SELECT sum(tokens)::BIGINT AS sent, sum(tokens * 3)::BIGINT AS saved, count(*) AS queries, (sum(tokens) // count(*))::BIGINT AS average, ((sum(tokens * 3) * 100) // (sum(tokens) + sum(tokens * 3)))::BIGINT || '%' AS efficiency FROM calls")
def a05_k07_token_usage(spark: SparkSession, d: str) -> DataFrame:
    """A5, K7, E5."""
    return overview.token_usage(read_table(spark, d, "calls").select(F.col("tokens").alias("sent"), (F.col("tokens") * 3).alias("saved")))


@query(f"SELECT coalesce(nullif(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1), ''), 'unknown') AS ext, count(*) AS n FROM ({FILES_SQL}) f GROUP BY 1")
def a06_file_types(spark: SparkSession, d: str) -> DataFrame:
    return overview.file_types(files(spark, d))


@query(f"SELECT string_split(path, '/')[1] AS dir, count(*) AS n FROM ({FILES_SQL}) f GROUP BY 1 ORDER BY n DESC, dir LIMIT 5")
def a15_top_directories(spark: SparkSession, d: str) -> DataFrame:
    return overview.top_directories(files(spark, d))


@query(GRAPH + """, f AS (SELECT DISTINCT file_id AS path, 'parts' AS language FROM nodes UNION ALL SELECT 'empty', 'none'), c AS (SELECT file_id AS path, count(*) AS n FROM nodes GROUP BY 1)
SELECT 'stats' AS part, 'files' AS a, '' AS b, (SELECT count(*) FROM f) AS n UNION ALL SELECT 'stats', 'nodes', '', (SELECT count(*) FROM nodes) UNION ALL SELECT 'stats', 'edges', '', (SELECT count(*) FROM edges)
UNION ALL SELECT 'languages', language, '', count(*) FROM f GROUP BY language UNION ALL (SELECT 'top_files', path, '', n FROM c ORDER BY n DESC, path LIMIT 10)
UNION ALL SELECT 'files', path, language, coalesce(n, 0) FROM f LEFT JOIN c USING (path) UNION ALL SELECT 'exported', file_id, name || ' ' || kind, count(*) FROM nodes WHERE is_exported GROUP BY 2, 3""")
def e17_overview(spark: SparkSession, d: str) -> DataFrame:
    """All parts of the overview in one table."""
    n = nodes(spark, d)
    f = n.select(F.col("file_id").alias("id"), F.col("file_id").alias("path"), F.lit("parts").alias("language")).distinct().unionByName(spark.createDataFrame([("empty", "empty", "none")], "id string, path string, language string"))
    parts = overview.project(f, n, edges(spark, d))
    none = F.lit("")
    rows = [
        parts["stats"].select(F.lit("stats").alias("part"), F.col("what").alias("a"), none.alias("b"), "n"), parts["languages"].select(F.lit("languages"), "language", none, "n"), parts["top_files"].select(F.lit("top_files"), "path", none, "symbols"),
        parts["files"].select(F.lit("files"), "path", "language", "symbols"), parts["exported"].groupBy("path", F.concat_ws(" ", "name", "kind").alias("b")).agg(F.count("*").alias("n")).select(F.lit("exported"), "path", "b", "n"),
    ]
    return reduce(DataFrame.union, rows)


@query(GRAPH + "SELECT file_id AS path, count(*) AS symbols FROM nodes GROUP BY 1 ORDER BY symbols DESC, path LIMIT 10")
def t04_e17_top_files(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return overview.top_files(n.select(F.col("file_id").alias("id"), F.col("file_id").alias("path")).distinct(), n)


@query(f"WITH f AS ({FILES_SQL}), c AS (SELECT DISTINCT path FROM run_items WHERE run_id % 17 = 0), s AS (SELECT p_size AS id, count(*) AS symbols FROM part GROUP BY 1) SELECT c.path, coalesce(f.language, 'unknown') AS language, coalesce(s.symbols, 0) AS symbols, f.path IS NOT NULL AS indexed FROM c LEFT JOIN f ON f.path = c.path LEFT JOIN s ON s.id = f.id")
def j15_e18_diff_context(spark: SparkSession, d: str) -> DataFrame:
    sizes = read_table(spark, d, "part").select(F.col("p_size").cast("long").alias("file_id"))
    return overview.diff_context(read_table(spark, d, "run_items").where("run_id % 17 = 0").select("path"), files(spark, d), sizes)


@query(GRAPH + "SELECT kind, count(*) AS n, array_to_string(list_sort(list_distinct(list(name))), ',') AS names FROM nodes WHERE file_id = 'Brand#23' GROUP BY 1")
def e16_t10_file_summary(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return overview.file_summary(n.select(F.col("file_id").alias("id"), F.col("file_id").alias("path")).distinct(), n, "Brand#23")


@query("SELECT greatest((SELECT max(\"timestamp\") FROM sessions), (SELECT max(\"timestamp\") FROM calls)) AS latest")
def a11_latest_activity(spark: SparkSession, d: str) -> DataFrame:
    return overview.latest_activity(read_table(spark, d, "sessions"), read_table(spark, d, "calls"))


@query("SELECT call_id, array_to_string(list_sort(list_distinct(symbols)), ',') AS symbols FROM calls WHERE symbols IS NOT NULL")
def a12_distinct_symbols(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "calls").where("symbols IS NOT NULL").select("call_id", F.array_join(F.array_sort(F.array_distinct("symbols")), ",").alias("symbols"))


@query(f"SELECT count(*) AS files, sum(char_count)::BIGINT AS bytes FROM ({FILES_SQL}) f")
def a16_index_summary(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).agg(F.count("*").alias("files"), F.sum("char_count").alias("bytes"))


@query(f"SELECT id, path, language FROM ({FILES_SQL}) f ORDER BY path")
def t09_file_list(spark: SparkSession, d: str) -> DataFrame:
    """T9, E4."""
    return files(spark, d).select("id", "path", "language").orderBy("path")


