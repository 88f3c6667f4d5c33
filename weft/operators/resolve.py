"""Name resolution: unresolved references ``deps(dep_id, file_id, line, name, kind)`` into edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.asof import asof


def enclosing(deps: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(dep_id, caller)``: the symbol with the greatest line not below the reference's; ties: least column, then id.

    References before the first symbol are dropped.
    """
    first = nodes.groupBy("file_id", "line").agg(F.min_by("id", F.struct("col", "id")).alias("id"))
    got = asof(deps, first, "file_id", "line", "dep_id", F.col("id"))
    return got.where("match IS NOT NULL").select("dep_id", F.col("match").alias("caller"))


def local_targets(deps: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(dep_id, target)``: the first symbol of the name in the same file by (line, col), not the caller itself.

    ``deps`` has ``caller``.  At most two symbols per (file, name) can matter - the first and, where that is
    the caller, the second - so two are kept per group and nothing is multiplied.
    """
    first = nodes.groupBy("file_id", "name").agg(F.min(F.struct("line", "col", "id")).alias("a"))
    rest = nodes.join(first, ["file_id", "name"]).where(F.struct("line", "col", "id") > F.col("a")).groupBy("file_id", "name").agg(F.min(F.struct("line", "col", "id")).alias("b"))
    known = first.join(rest, ["file_id", "name"], "left")
    j = deps.join(known, ["file_id", "name"])
    target = F.when(F.col("a.id") != F.col("caller"), F.col("a.id")).otherwise(F.col("b.id"))
    return j.select("dep_id", target.alias("target")).where("target IS NOT NULL")


def unique_elsewhere(deps: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(dep_id, target)``: the only exported symbol of the name in other files, or the only one at all if none is exported.

    Counts by name, less those by (file, name), are those of all other files: no list of homonyms is built.
    """
    exported = F.col("is_exported")
    wide = F.col("id").cast("decimal(20,0)")  # ids may be 64-bit hashes
    ids = {"n": F.count("*"), "x": F.count_if(exported), "s": F.sum(wide), "sx": F.sum(F.when(exported, wide))}
    every = nodes.groupBy("name").agg(*[c.alias(k) for k, c in ids.items()])
    own = nodes.groupBy("file_id", "name").agg(*[c.alias(f"own_{k}") for k, c in ids.items()])
    j = deps.join(every, "name").join(own, ["file_id", "name"], "left")
    rest = lambda c: F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"own_{c}"), F.lit(0))
    # where one symbol is left, the difference of the sums of ids is its id
    return j.select("dep_id", F.when(rest("x") == 1, rest("sx")).when((rest("x") == 0) & (rest("n") == 1), rest("s")).cast("long").alias("target")).where("target IS NOT NULL")


def resolve_edges(deps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges ``(from_id, to_id, kind)``; the same file goes first, self-edges and ambiguous names are dropped."""
    called = deps.join(enclosing(deps, nodes), "dep_id")
    local = local_targets(called, nodes).withColumnRenamed("target", "near")
    far = unique_elsewhere(called, nodes).withColumnRenamed("target", "far")
    both = called.join(local, "dep_id", "left").join(far, "dep_id", "left")
    edges = both.select(F.col("caller").alias("from_id"), F.coalesce("near", "far").alias("to_id"), "kind").where("to_id IS NOT NULL AND from_id <> to_id")
    return edges.distinct()
