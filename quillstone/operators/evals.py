"""Evaluation metrics, intervals and adaptive stopping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def z_critical(p_value: float) -> float:
    """Two-sided critical value of the normal distribution."""
    if not 0 < p_value < 1:
        raise ValueError("the p value lies between 0 and 1")
    return NormalDist().inv_cdf(1 - p_value / 2)


def metrics(scored: DataFrame, by: Sequence[str], operation: str = "operation", correct: str = "correct") -> DataFrame:
    """Counts and accuracy per group; incomplete rows count as wrong, rows without operation do not count."""
    flag = F.lower(F.trim(F.col(correct)))
    rows = scored.where(F.length(F.trim(F.col(operation))) > 0)
    agg = rows.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce(flag, F.lit("")) != "incomplete").alias("completed"),
        F.count_if(flag == "true").alias("correct"),
        F.count_if(F.coalesce(flag, F.lit("")) == "incomplete").alias("incomplete"),
    )
    return agg.withColumn("accuracy", share(F.col("correct"), F.col("total")))


def share(correct: Column, total: Column) -> Column:
    """Correct over total, 0 for an empty total."""
    return F.when(total > 0, correct / total).otherwise(F.lit(0.0))


def proportion_half(correct: Column, n: Column, z: float) -> Column:
    """Half width of a Wald interval; 1 without observations."""
    p = F.greatest(F.lit(0), F.least(correct, n)) / F.nullif(n, F.lit(0))
    return F.when(n > 0, F.lit(z) * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)))).otherwise(F.lit(1.0))


def with_proportion_ci(df: DataFrame, z: float, correct: str = "correct", n: str = "total") -> DataFrame:
    """Adds half_width, low, high, the last two inside [0, 1]."""
    c, t = F.col(correct), F.col(n)
    p = F.when(t > 0, F.greatest(F.lit(0), F.least(c, t)) / F.nullif(t, F.lit(0))).otherwise(F.lit(0.0))
    df = df.withColumn("half_width", proportion_half(c, t, z))
    low = F.when(t > 0, F.greatest(F.lit(0.0), p - F.col("half_width"))).otherwise(F.lit(0.0))
    high = F.when(t > 0, F.least(F.lit(1.0), p + F.col("half_width"))).otherwise(F.lit(1.0))
    return df.withColumns({"low": low, "high": high})


def diff_half(ca: Column, na: Column, cb: Column, nb: Column, z: float) -> Column:
    """Half width of the difference of two shares, unpooled; 1 if either side is empty."""
    var = lambda c, n: (c / F.nullif(n, F.lit(0))) * (1 - c / F.nullif(n, F.lit(0))) / F.nullif(n, F.lit(0))
    return F.when((na > 0) & (nb > 0), F.lit(z) * F.sqrt(var(ca, na) + var(cb, nb))).otherwise(F.lit(1.0))


def with_diff_ci(df: DataFrame, a: str, b: str, z: float, target: float) -> DataFrame:
    """Adds diff, half_width, low, high and meets_target for the counts ``correct_a, n_a`` and ``correct_b, n_b``."""
    ca, na, cb, nb = (F.col(f"{x}_{s}") for s in (a, b) for x in ("correct", "n"))
    ok = (na > 0) & (nb > 0)
    df = df.withColumn("diff", F.when(ok, ca / F.nullif(na, F.lit(0)) - cb / F.nullif(nb, F.lit(0))).otherwise(F.lit(0.0)))
    df = df.withColumn("half_width", diff_half(ca, na, cb, nb, z))
    return df.withColumns(
        {
            "low": F.when(ok, F.col("diff") - F.col("half_width")).otherwise(F.lit(-1.0)),
            "high": F.when(ok, F.col("diff") + F.col("half_width")).otherwise(F.lit(1.0)),
            "meets_target": ok & (F.col("half_width") <= target + 1e-15),
        }
    )


def required_n(p: Column, half: Column, z: float) -> Column:
    """Observations needed for a half width; 10**9 for none or a negative one."""
    return F.when(half > 0, F.ceil(F.lit(z * z) * p * (1 - p) / F.nullif(half * half, F.lit(0.0)))).otherwise(F.lit(10**9)).cast("long")


def noise_band(pairs: Sequence[tuple[Column, Column]], z: float) -> Column:
    """z times the root of the summed variances of (correct, total) pairs; 0 if any of them is missing."""
    if z <= 0:
        return F.lit(0.0)
    var = F.lit(0.0)
    for c, n in pairs:
        p = c / F.nullif(n, F.lit(0))
        var = var + F.when(n > 0, p * (1 - p) / n)
    return F.coalesce(F.lit(z) * F.sqrt(var), F.lit(0.0))


@dataclass(frozen=True)
class StopRule:
    """When an adaptive evaluation ends."""

    batch: int = 40
    least: int = 40
    most: int = 200
    target: float = 0.02
    p_value: float = 0.05


def sequential_stop(ranked: DataFrame, by: Sequence[str], rule: StopRule, a: str = "correct_a", b: str = "correct_b") -> DataFrame:
    """First batch boundary of each group at which the paired difference is known well enough.

    ``ranked`` has ``ord`` (0-based within the group) and 0/1 columns for both sides. Rows beyond ``most`` are not read into
    the window; it sees one row a batch. ``target_met`` is false where the pool or the cap ended the evaluation.
    """
    z = z_critical(rule.p_value)
    pool = ranked.groupBy(*by).agg(F.count("*").alias("n_pool"))
    step = ranked.where(F.col("ord") < rule.most).groupBy(*by, F.floor(F.col("ord") / rule.batch).alias("_b")).agg(
        F.sum(a).alias("_a"), F.sum(b).alias("_c"), F.count("*").alias("_n")
    )
    w = Window.partitionBy(*by).orderBy("_b")
    run = step.select(
        *by, F.sum("_n").over(w).alias("n_used"), F.sum("_a").over(w).alias("correct_a"), F.sum("_c").over(w).alias("correct_b")
    ).join(pool, list(by))
    n, most = F.col("n_used"), F.least(F.col("n_pool"), F.lit(rule.most))
    least = F.least(F.lit(max(rule.least, rule.batch)), most)
    half = diff_half(F.col("correct_a"), n, F.col("correct_b"), n, z)
    run = run.withColumns({"half_width": half, "target_met": half <= rule.target + 1e-15})
    stops = run.where((n >= least) & (F.col("target_met") | (n >= most)))
    row = F.struct("n_used", "correct_a", "correct_b", "half_width", "target_met", "n_pool")
    first = stops.groupBy(*by).agg(F.min_by(row, n).alias("_r")).select(*by, "_r.*")
    return first.withColumn("exhausted", ~F.col("target_met"))


def with_marginal(history: DataFrame, post: str, n: str, correct: str, ordinal: str, min_delta: float, z: float, by: Sequence[str] = ()) -> DataFrame:
    """Adds gain, band and marginal: a gain over the step before below both the least gain and the noise.

    One row a step; the first step of a group is never marginal.
    """
    w = Window.partitionBy(*by).orderBy(ordinal)
    before_c, before_n = F.lag(correct).over(w), F.lag(n).over(w)
    df = history.withColumns({"gain": F.col(post) - F.lag(post).over(w), "_bc": before_c, "_bn": before_n})
    band = noise_band([(F.col(correct), F.col(n)), (F.col("_bc"), F.col("_bn"))], z)
    df = df.withColumn("band", F.when(F.col("gain").isNull(), 0.0).otherwise(band))
    marginal = F.coalesce(F.col("gain") < F.greatest(F.lit(min_delta), F.col("band")), F.lit(False))
    return df.withColumn("marginal", marginal).drop("_bc", "_bn")


def trailing_streak(flags: DataFrame, flag: str, ordinal: str, by: Sequence[str] = ()) -> DataFrame:
    """Length of the run of true flags at the end of each group: rows after the last false one."""
    last = F.max(F.when(~F.col(flag), F.col(ordinal)))
    keys = list(by)
    if not keys:
        top = flags.agg(last.alias("_last"))
        return flags.crossJoin(F.broadcast(top)).agg(F.count_if(F.col("_last").isNull() | (F.col(ordinal) > F.col("_last"))).alias("streak"))
    top = flags.groupBy(*keys).agg(last.alias("_last"))
    return flags.join(top, keys).groupBy(*keys).agg(
        F.count_if(F.col("_last").isNull() | (F.col(ordinal) > F.col("_last"))).alias("streak")
    )


def comparisons(sides: DataFrame, by: Sequence[str], z: float, target: float) -> DataFrame:
    """One row a comparison: high minus instant, and instant minus previous where there is a previous evaluation.

    ``sides`` has correct_x and n_x for x in high, instant, previous; null or zero counts leave a comparison out.
    """
    out = None
    for name, a, b in (("high_minus_instant", "high", "instant"), ("instant_minus_previous", "instant", "previous")):
        rows = sides.where((F.coalesce(F.col(f"n_{a}"), F.lit(0)) > 0) & (F.coalesce(F.col(f"n_{b}"), F.lit(0)) > 0))
        one = with_diff_ci(rows, a, b, z, target).select(*by, F.lit(name).alias("name"), "diff", "half_width", "low", "high", "meets_target")
        out = one if out is None else out.unionByName(one)
    return out


def all_required_met(sides: DataFrame, compared: DataFrame, by: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Whether every required comparison that is present meets its target; true where none is."""
    ok = compared.where(F.col("name").isin(*required)).groupBy(*by).agg(F.bool_and("meets_target").alias("_met"))
    return sides.select(*by).distinct().join(ok, list(by), "left").select(*by, F.coalesce("_met", F.lit(True)).alias("met"))
