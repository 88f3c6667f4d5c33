"""Running totals over groups of any size, without one task per group.

``row_number``/``sum`` over ``partitionBy(key)`` sends a whole key to one task.  Here
the rows are range-partitioned by ``(key, order)`` instead, so a key with a third of
all rows spreads over a third of the partitions.  The sorted rows are written with the
number of their partition (a *chunk*); a second, tiny aggregate per ``(key, chunk)``
gives every chunk the total of the chunks before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.runtime import cut

CHUNK = "_chunk"


def chunked(df: DataFrame, keys: list[str], order: list[str], label: str = "chunked") -> DataFrame:
    """``df`` sorted by ``(*keys, *order)`` in a table with a column ``_chunk`` that rises with the order.

    ``order`` should make the rows of a key unique; ties may fall in either order, but the table
    fixes where they fall.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *keys, *order)
    return cut(ranged.withColumn(CHUNK, F.spark_partition_id()), label)


def offsets(table: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Per ``(*keys, _chunk)``: for each named value its sum over all earlier chunks of the key, as ``_o_<name>``.

    The window runs over one row per key and chunk, so at most as many as there are partitions.
    """
    seg = table.groupBy(*keys, CHUNK).agg(*[F.sum(v).alias(f"_s_{n}") for n, v in values.items()])
    w = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    return seg.select(*keys, CHUNK, *[F.coalesce(F.sum(f"_s_{n}").over(w), F.lit(0)).alias(f"_o_{n}") for n in values])


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` where null equals null; the right side's keys are dropped."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        on = c if on is None else on & c
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def running_total(table: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds ``out`` to a table of :func:`chunked`: the sum of ``value`` over the key's earlier rows.

    Null keys form one group; null values count as 0.
    """
    v = F.coalesce(value, F.lit(0))
    w = W.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    within = table.withColumn("_in", F.coalesce(F.sum(v).over(w), F.lit(0)))
    joined = null_safe(within, offsets(table, keys, {"v": v}), [*keys, CHUNK])
    return joined.withColumn(out, F.col("_in") + F.coalesce(F.col("_o_v"), F.lit(0))).drop("_o_v", "_in")


def neighbour(table: DataFrame, keys: list[str], order: list[str], values: list[str], back: bool = False) -> DataFrame:
    """Adds ``_next_<value>`` (or ``_prev_<value>``) to a table of :func:`chunked`: the values of the key's row after (before) this one, null at the end."""
    w = W.partitionBy(*keys, CHUNK).orderBy(*order)
    v, o = F.struct(*values), F.struct(*order)
    edge = table.groupBy(*keys, CHUNK).agg((F.max_by(v, o) if back else F.min_by(v, o)).alias("_edge"))
    step, near = (F.lag, F.lag("_edge")) if back else (F.lead, F.lead("_edge"))
    edge = edge.select(*keys, CHUNK, near.over(W.partitionBy(*keys).orderBy(CHUNK)).alias("_far"))
    j = null_safe(table.withColumn("_near", step(v).over(w)), edge, [*keys, CHUNK]).withColumn("_at", F.coalesce("_near", "_far"))
    name = "_prev_" if back else "_next_"
    return j.select(*table.columns, *[F.col(f"_at.{c}").alias(name + c) for c in values])
