"""Exact seeded samples, splits and dense ranks without a global sort in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a priority that the histogram counts.
DIGITS = 4
#: Ids that share one bucket of a dense rank.
WIDTH = 65_536


def priority(seed: str | int, *keys: Column) -> Column:
    """A digest that orders rows the same on every run, engine and layout."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def lowest(df: DataFrame, n: int, order: str, *ties: str) -> DataFrame:
    """Exactly the ``n`` rows of lowest ``order`` (a hex digest), ties by ``ties``.

    The histogram of leading digits (at most 16**4 rows) tells which bins lie wholly below the cut; only the one bin at
    the cut is sorted.
    """
    if n <= 0:
        return df.where(F.lit(False))
    bin_ = F.substring(order, 1, DIGITS)
    counts = df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect()
    below = 0
    for r in counts:
        if below + r["n"] >= n:
            w = Window.orderBy(order, *ties)
            at = df.where(bin_ == r["bin"]).withColumn("_rk", F.row_number().over(w))
            at = at.where(F.col("_rk") <= n - below).drop("_rk")
            return df.where(bin_ < r["bin"]).unionByName(at)
        below += r["n"]
    return df


def exact_sample(df: DataFrame, n: int, seed: str | int, *keys: str) -> DataFrame:
    """``n`` rows without replacement; all rows if there are not more."""
    ranked = df.withColumn("_p", priority(seed, *[F.col(k) for k in keys]))
    return lowest(ranked, n, "_p", *keys).drop("_p")


def held_out_size(rows: int, fraction: float) -> int:
    """Rows to hold out: half-even rounding, at least one, at most all but one."""
    return min(max(round(rows * fraction), 1), rows - 1)


def split(df: DataFrame, fraction: float, seed: str | int, *keys: str, optional: bool = False) -> DataFrame:
    """Adds ``split``: exactly ``held_out_size`` rows are 'heldout', the others 'train'.

    An ``optional`` split of no share, or of less than two rows, holds nothing out; it is an error otherwise.
    """
    if optional and (fraction == 0 or df.limit(2).count() < 2):
        return df.withColumn("split", F.lit("train"))
    if not 0 < fraction < 1:
        raise ValueError("the held-out fraction lies between 0 and 1")
    total = df.count()
    if total < 2:
        raise ValueError("a split needs two rows")
    ranked = df.withColumn("_p", priority(seed, *[F.col(k) for k in keys]))
    held = lowest(ranked, held_out_size(total, fraction), "_p", *keys)
    marks = held.select(*keys, F.lit("heldout").alias("split"))
    return df.join(marks, list(keys), "left").withColumn("split", F.coalesce("split", F.lit("train")))


def dense_rank_by_id(df: DataFrame, id_col: str, name: str = "ord", width: int = WIDTH) -> DataFrame:
    """Adds the 0-based position of each row in the order of a unique integer id.

    Ranks run inside buckets of ``width`` ids; the running sum over buckets sees one row a bucket.
    """
    b = df.withColumn("_b", F.floor(F.col(id_col) / width))
    sizes = b.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(id_col)) - 1
    joined = b.withColumn("_rn", inside).join(offsets, "_b")
    return joined.select(*df.columns, (F.col("_off") + F.col("_rn")).cast("long").alias(name))


def replicate(df: DataFrame, times: int, name: str = "copy") -> DataFrame:
    """Each row ``times`` times, numbered from 1."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(times))))


def seeded_batches(df: DataFrame, batches: int, size: int, seed: int, step: int, *keys: str) -> DataFrame:
    """``size`` rows for each batch b, drawn with the seed ``seed + step * b``; adds ``batch``."""
    out = None
    for b in range(batches):
        one = exact_sample(df, size, seed + step * b, *keys).withColumn("batch", F.lit(b))
        out = one if out is None else out.unionByName(one)
    return out


def batch_count(target: int, per_batch: int) -> int:
    return max(1, math.ceil(target / per_batch))


def prefer_first(df: DataFrame, wanted: Column) -> DataFrame:
    """Rows that satisfy ``wanted``; all rows if none does."""
    any_ = df.agg(F.max(F.coalesce(wanted, F.lit(False)).cast("int")).alias("_any"))
    return df.crossJoin(F.broadcast(any_)).where(wanted | (F.coalesce("_any", F.lit(0)) == 0)).drop("_any")


__all__: Sequence[str] = [
    "batch_count", "dense_rank_by_id", "exact_sample", "held_out_size", "lowest", "prefer_first", "priority", "replicate",
    "seeded_batches", "split",
]
