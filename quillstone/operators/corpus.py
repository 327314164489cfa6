"""Curation of example corpora: keyed union, deduplication, leak guards, restart joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """First row of every key by ``order``: a map-side combined argmin, no window over a hot key."""
    return _extreme(df, key, order, F.min_by)


def last_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    return _extreme(df, key, order, F.max_by)


def _extreme(df: DataFrame, key: str, order: Sequence[str], pick) -> DataFrame:  # noqa: ANN001
    row = pick(F.struct(*df.columns), F.struct(*order))
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(row.alias("_row")).select("_row.*")


def without_keys(df: DataFrame, banned: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not banned. Rows without key stay."""
    return df.join(banned.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def merge_unique(base: DataFrame, extra: DataFrame, key: str, *order: str) -> DataFrame:
    """All of ``base`` as it is, and the first row of each new non-empty key of ``extra``."""
    new = first_per_key(extra.where(F.col(key) != ""), key, *order)
    return base.unionByName(without_keys(new, base, key).select(*base.columns))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys in both."""
    return a.select(key).intersect(b.select(key))


def assert_disjoint(a: DataFrame, b: DataFrame, key: str, shown: int = 5) -> None:
    """Raises with the number of shared keys and the smallest of them."""
    shared = overlap(a, b, key)
    n = shared.count()
    if n:
        first = [r[0] for r in shared.orderBy(key).limit(shown).collect()]
        raise ValueError(f"{n} keys are in both sides, such as {first}")


def new_keys(after: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Distinct keys that were not there before."""
    return after.select(key).subtract(before.select(key))


def answers_in_order(operations: DataFrame, answers: DataFrame, key: str, output: str) -> DataFrame:
    """Every operation with its answer, '' while pending; duplicated operations share one answer."""
    return operations.join(answers.select(key, output), key, "left").withColumn(output, F.coalesce(output, F.lit("")))


def pending(operations: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return operations.join(done.select(key).distinct(), key, "left_anti")


def finished(operations: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return operations.join(done.select(key).distinct(), key, "left_semi")


def order_mismatches(a: DataFrame, b: DataFrame, ord_col: str, key: str) -> DataFrame:
    """One row with the number of positions at which two ordered lists differ."""
    x, y = a.select(ord_col, F.col(key).alias("_a")), b.select(ord_col, F.col(key).alias("_b"))
    return x.join(y, ord_col, "full").agg(F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("mismatches"))


def validation_stages(df: DataFrame, claimed: str, computed: str, keep: str, confident: str, proposed: str) -> DataFrame:
    """One pass over candidates: ``stage``, ``final_solution`` and ``kept``.

    A computed value that meets the claim, or fills a missing one, is kept without a verdict; a claim that differs is
    dropped; without a computed value the verdict decides: keep, high confidence and a solution.
    """
    from quillstone.functions.text import solutions_match

    has, claim = F.col(computed).isNotNull(), F.length(F.coalesce(F.trim(F.col(claimed)), F.lit(""))) > 0
    stage = (
        F.when(has & ~claim, "filled")
        .when(has & solutions_match(F.col(claimed), F.col(computed)), "agreed")
        .when(has, "mismatch")
        .otherwise("verdict")
    )
    final = F.when(has, F.col(computed)).otherwise(F.coalesce(F.col(proposed), F.col(claimed)))
    voted = F.col(keep) & F.col(confident) & (F.length(F.coalesce(F.trim(final), F.lit(""))) > 0)
    kept = F.when(F.col("stage").isin("filled", "agreed"), True).when(F.col("stage") == "mismatch", False).otherwise(voted)
    return df.withColumn("stage", stage).withColumn("final_solution", final).withColumn("kept", F.coalesce(kept, F.lit(False)))
