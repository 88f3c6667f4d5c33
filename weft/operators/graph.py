"""Operators on the property graph ``files(id, path, ...)``, ``nodes(id, file_id, name, ...)``, ``edges(from_id, to_id, kind)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.runtime import cut


def distinct_edges(edges: DataFrame) -> DataFrame:
    """K3: edges are a set over (from_id, to_id, kind)."""
    return edges.dropDuplicates(["from_id", "to_id", "kind"])


def located(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes with the path of their file; the plan picks the join by the sizes it measures."""
    return nodes.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")


def neighbours(edges: DataFrame, nodes: DataFrame, incoming: bool) -> DataFrame:
    """Per node the nodes it depends on, or that depend on it, with the edge kind: ``(id, other_id, other_name, kind)``."""
    near, far = ("to_id", "from_id") if incoming else ("from_id", "to_id")
    other = nodes.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"))
    return edges.select(F.col(near).alias("id"), F.col(far).alias("other_id"), "kind").join(other, "other_id").select("id", "other_id", "other_name", "kind")


def dependencies(edges: DataFrame, nodes: DataFrame, name: str, direction: str) -> DataFrame:
    """The neighbours of all symbols of a name; ``direction`` is ``in`` or ``out``."""
    if not name:
        raise ValueError("a name is required")
    if direction not in ("in", "out"):
        raise ValueError("direction must be in or out")
    ids = nodes.where(F.col("name") == name).select("id")
    return neighbours(edges, nodes, direction == "in").join(ids, "id", "left_semi")


def file_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between different files, counted by pair: ``(from_file, to_file, n)``.

    Pre-aggregated after the joins, so what later operators shuffle is pairs of files, not edges.
    """
    owner = nodes.select("id", "file_id")
    a = owner.select(F.col("id").alias("from_id"), F.col("file_id").alias("from_file"))
    b = owner.select(F.col("id").alias("to_id"), F.col("file_id").alias("to_file"))
    pairs = edges.select("from_id", "to_id").join(a, "from_id").join(b, "to_id").where("from_file <> to_file")
    return pairs.groupBy("from_file", "to_file").agg(F.count("*").alias("n"))


def file_dependents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (callee file, caller file) pairs, a file never with itself."""
    return file_edges(edges, nodes).select(F.col("to_file").alias("callee"), F.col("from_file").alias("caller"))


def related_files(edges: DataFrame, nodes: DataFrame, pivots: DataFrame, limit: int | None = None) -> DataFrame:
    """Files coupled to the pivot files by edges of either direction, ``(file, total)``.

    ``pivots`` has a column ``file``.  Kinds count separately; pivots are left out; order is total
    descending, file ascending.  No pivots give no rows.
    """
    between = file_edges(edges, nodes)
    both = between.select(F.col("from_file").alias("pivot"), F.col("to_file").alias("file"), "n").unionByName(between.select(F.col("to_file").alias("pivot"), F.col("from_file").alias("file"), "n"))
    p = pivots.select("file").distinct()
    hit = both.join(p.withColumnRenamed("file", "pivot"), "pivot", "left_semi").join(p, "file", "left_anti")
    out = hit.groupBy("file").agg(F.sum("n").alias("total"))
    return out.orderBy(F.desc("total"), "file").limit(limit) if limit else out


def callers_to_repair(edges: DataFrame, nodes: DataFrame, touched: DataFrame, present: DataFrame) -> DataFrame:
    """Unchanged, still present files that call into changed or deleted ones; columns ``file``."""
    t = touched.select("file").distinct()
    callers = file_dependents(edges, nodes).join(t.withColumnRenamed("file", "callee"), "callee", "left_semi").select(F.col("caller").alias("file")).distinct()
    return callers.join(t, "file", "left_anti").join(present.select("file").distinct(), "file", "left_semi")


def impact(edges: DataFrame, start: DataFrame, max_depth: int = 0) -> DataFrame:
    """``(id, depth)`` of all nodes that reach a start node over edges of any kind, at their least depth.

    ``start`` has a column ``id``; start nodes are not in the result, even on a cycle.  ``max_depth`` 0
    is unlimited.  Breadth-first by frontiers: every round joins the frontier with the reversed edges,
    drops what was seen, and is written to the shared folder, so a lost executor costs one round.
    """
    reverse = cut(edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("next")).distinct(), "reverse")
    frontier = start.select("id").distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    depth = 0
    while max_depth == 0 or depth < max_depth:
        depth += 1
        step = reverse.join(frontier, "id", "left_semi").select(F.col("next").alias("id")).distinct()
        frontier = cut(step.join(seen.select("id"), "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
        if depth % 8 == 0:
            seen = cut(seen, "seen")  # keeps the plan short on long paths
    return seen.where("depth > 0")


def severity(n: Column) -> Column:
    """None, low up to 5, medium up to 20, else high."""
    return F.when(n == 0, "none").when(n <= 5, "low").when(n <= 20, "medium").otherwise("high")


def symbol_spans(nodes: DataFrame, last_line: Column) -> DataFrame:
    """Adds ``end_line``: the line before the file's next symbol by (line, col), else ``last_line``."""
    from pyspark.sql import Window as W

    w = W.partitionBy("file_id").orderBy("line", "col", "id")
    return nodes.withColumn("end_line", F.coalesce(F.lead("line").over(w) - 1, last_line))


def replace_symbols(nodes: DataFrame, edges: DataFrame, changed: DataFrame, new_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after the symbols of the ``changed(file_id)`` files were replaced.

    Edges at either end of a replaced symbol go, its nodes go, the new nodes come.
    """
    files = changed.select("file_id").distinct()
    gone = nodes.join(files, "file_id", "left_semi").select("id")
    kept = edges.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return nodes.join(files, "file_id", "left_anti").unionByName(new_nodes), kept


def delete_files(files: DataFrame, nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K5: files, nodes and edges without the ``gone(id)`` files."""
    n, e = replace_symbols(nodes, edges, gone.select(F.col("id").alias("file_id")), nodes.limit(0))
    return files.join(gone.select("id").distinct(), "id", "left_anti"), n, e
