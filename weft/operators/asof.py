"""As-of joins without one task per key.

Left and right rows are laid in one order per key and range-sorted into chunks (see
:mod:`weft.operators.prefix`); a row takes the last right row before it in its chunk or, if
there is none, the last one of an earlier chunk.  One shuffle by range, one by (key, chunk),
and never a product of left and right rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.operators.prefix import CHUNK, chunked, null_safe


def carry_last(table: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds ``out`` to a table of :func:`prefix.chunked`: the last non-null ``value`` at or before each row of its key."""
    here = W.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    ends = table.where(value.isNotNull()).groupBy(*keys, CHUNK).agg(F.max_by(value, F.struct(*order)).alias("_end"))
    all_chunks = table.select(*keys, CHUNK).distinct()
    ends = null_safe(all_chunks, ends, [*keys, CHUNK])
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*keys, CHUNK, F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    within = table.withColumn("_last", F.last(value, ignorenulls=True).over(here))
    return null_safe(within, ends, [*keys, CHUNK]).withColumn(out, F.coalesce("_last", "_carried")).drop("_last", "_carried")


def asof(left: DataFrame, right: DataFrame, key: str, at: str, left_id: str, right_value: Column, forward: bool = False, tie: Column | None = None) -> DataFrame:
    """``(left_id, match)``: per left row the right row of the same key nearest in ``at``.

    Backward takes the greatest ``at`` not above the left row's, forward the least not below.  ``right_value``
    is what comes out (a column or struct of the right side); among right rows of equal ``at`` the one with the
    least ``tie`` wins.  Left rows without a match, and rows with a null key, give null.
    """
    sign = -1 if forward else 1
    tie = F.lit(0) if tie is None else tie
    r = right.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), (F.col(at) * sign).alias("_at"), F.lit(0).alias("_side"), (-tie).cast("long").alias("_tie"), F.lit(None).cast(left.schema[left_id].dataType).alias("_id"), right_value.alias("_value"))
    kind = r.schema["_value"].dataType
    x = left.select(F.col(key).alias("_k"), (F.col(at) * sign).alias("_at"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"), F.col(left_id).alias("_id"), F.lit(None).cast(kind).alias("_value"))
    table = chunked(r.unionByName(x.where("_k IS NOT NULL")), ["_k"], ["_at", "_side", "_tie"], "asof")
    got = carry_last(table, ["_k"], ["_at", "_side", "_tie"], F.col("_value"), "match").where("_side = 1")
    return got.select(F.col("_id").alias(left_id), "match").unionByName(x.where("_k IS NULL").select(F.col("_id").alias(left_id), F.col("_value").alias("match")))
