"""Joins and ranks that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hot keys that are broadcast; a fixed bound, whatever the data.
HOT_KEYS = 1000


def join_to_groups(
    rows: DataFrame, groups: DataFrame, on: Sequence[str], weight: str, hot: int = HOT_KEYS
) -> DataFrame:
    """Inner join of many ``rows`` to one row per key in ``groups``, safe for hot keys.

    ``weight`` is the column of ``groups`` that counts the rows of a key. The ``hot`` heaviest keys are broadcast
    (a table of at most ``hot`` rows); every other key then holds at most 1/``hot`` of all rows, so a shuffled join
    of the rest has no large key. Keys without a group and rows with a null key are dropped, as in any inner join.
    """
    on = list(on)
    top = groups.orderBy(F.desc(weight), *on).limit(hot).select(*on, F.lit(True).alias("_hot"))
    marked = groups.join(F.broadcast(top), on, "left")
    heavy = marked.where(F.col("_hot")).drop("_hot")
    light = marked.where(F.col("_hot").isNull()).drop("_hot")
    by_broadcast = rows.join(F.broadcast(heavy), on, "inner")
    rest = rows.join(F.broadcast(top.select(*on)), on, "left_anti")
    by_shuffle = rest.join(light, on, "inner")
    return by_broadcast.unionByName(by_shuffle)


def balanced_rank(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, slices: int = 64
) -> DataFrame:
    """Adds ``name``: 0-based rank of each row within ``by``, without one task per group.

    Rows of a group are spread over ``slices`` hash slices of the ``order`` columns; ranks run slice by slice, so they
    are dense, unique and the same on every run, but follow ``order`` only inside a slice. The table of slice counts
    has ``slices`` rows a group. Ranking and joining share one partitioning. Rows with a null in ``by`` are dropped.
    """
    by, order = list(by), list(order)
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    counts = sliced.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_slice", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(*by, "_slice").orderBy(*order)
    ranked = sliced.withColumn("_rn", F.row_number().over(inner) - 1)
    joined = ranked.join(offsets, [*by, "_slice"], "inner")
    return joined.select(*df.columns, (F.col("_offset") + F.col("_rn")).cast("long").alias(name))
