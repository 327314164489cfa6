"""Run-log analytics: history records, checkpoints, events, live overlays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: marks of imported and interim records
IMPORTED_KINDS = ("imported", "imported_checkpoint", "parent_import", "parent_checkpoint")
IMPORTED_SOURCES = ("parent_train_promoted", "imported_checkpoint")
INTERIM_ROLES = ("post_interim", "interim", "ci_refine_pending")


def path(record: Column, *names: str) -> Column:
    """First non-null JSON path of a record, as text."""
    return F.coalesce(*[F.get_json_object(record, f"$.{n}") for n in names])


def number(record: Column, *names: str) -> Column:
    from quillstone.functions.text import double

    return F.coalesce(*[double(F.get_json_object(record, f"$.{n}")) for n in names])


def accuracy(record: Column, at: str) -> Column:
    """An accuracy given as number, as {instant: {accuracy}}, as {accuracy} or as {instant_accuracy}."""
    return number(record, at, f"{at}.instant.accuracy", f"{at}.accuracy", f"{at}.instant_accuracy")


def readable(df: DataFrame, record: str) -> DataFrame:
    """Rows whose record is a whole JSON object; torn, blank and other lines are skipped."""
    v = F.try_parse_json(F.col(record))
    return df.where(F.schema_of_variant(v).startswith("OBJECT"))


def is_imported(kind: Column, source: Column, iteration: Column) -> Column:
    return F.coalesce(kind.isin(*IMPORTED_KINDS), F.lit(False)) | F.coalesce(source.isin(*IMPORTED_SOURCES), F.lit(False)) | F.coalesce(iteration == -1, F.lit(False))


def is_interim(pending: Column, role: Column, note: Column) -> Column:
    n = F.lower(F.coalesce(note, F.lit("")))
    return (
        F.coalesce(pending, F.lit(False))
        | F.coalesce(role.isin(*INTERIM_ROLES), F.lit(False))
        | (n.contains("interim") & n.contains("ci refine"))
    )


NUMERIC = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"


def member(v: Column, *paths: str) -> Column:
    """The first member of a variant at ``paths`` that says something: no null, zero, false, empty text, object or array."""

    def telling(p: str) -> Column:
        x = F.try_variant_get(v, f"$.{p}", "variant")
        k = F.schema_of_variant(x)
        none = (k == "VOID") | ((k == "BOOLEAN") & ~F.try_variant_get(x, "$", "boolean")) | (k.rlike(NUMERIC) & (F.try_variant_get(x, "$", "double") == 0))
        none = none | F.to_json(x).isin('""', "{}", "[]")
        return F.when(~F.coalesce(none, F.lit(True)), x)

    return F.coalesce(*[telling(p) for p in paths])


def eval_accuracy(x: Column) -> Column:
    """Accuracy of an evaluation given as number, {instant: {accuracy}}, {accuracy} or {instant_accuracy}."""
    k, get = F.schema_of_variant(x), lambda p: F.try_variant_get(x, f"$.{p}", "double")
    inner = F.coalesce(F.schema_of_variant(F.try_variant_get(x, "$.instant", "variant")).startswith("OBJECT"), F.lit(False))
    of_object = F.when(inner, get("instant.accuracy")).otherwise(F.coalesce(get("accuracy"), get("instant_accuracy")))
    return F.when(k.rlike(NUMERIC), F.try_variant_get(x, "$", "double")).when(k.startswith("OBJECT"), of_object)


def eval_counts(x: Column) -> Column:
    """struct(c, n): correct and total of an evaluation, null if they are not recorded as numbers or the total is not positive."""
    inner = F.coalesce(F.schema_of_variant(F.try_variant_get(x, "$.instant", "variant")).startswith("OBJECT"), F.lit(False))
    x = F.when(inner, F.try_variant_get(x, "$.instant", "variant")).otherwise(x)
    count = lambda p: F.when(
        F.schema_of_variant(F.try_variant_get(x, f"$.{p}", "variant")).rlike(NUMERIC), F.floor(F.try_variant_get(x, f"$.{p}", "double"))
    )
    c, n = count("correct"), count("total")
    return F.when(c.isNotNull() & (n > 0), F.struct(c.alias("c"), n.alias("n")))


#: Members that hold the evaluations of a record, held-out pair first.
PAIRS = (
    (("pre_heldout", "heldout.pre"), ("post_heldout", "heldout.post")),
    (("pre_train", "pre", "pre_eval", "train_seed.pre"), ("post_train", "post", "post_eval", "train_seed.post")),
)


def with_marginal(df: DataFrame, record: str, by: Sequence[str], order: Sequence[str], min_delta: float, z: float) -> DataFrame:
    """Adds gain, band and marginal to records (JSON texts of objects) in their order.

    The gain of a record is that of its first complete pair of evaluations, held-out before training; without one it is
    its post evaluation over that of the record before. It is marginal if it stays below the least gain and the noise.
    """
    from quillstone.operators.evals import noise_band

    side = lambda x: F.struct(eval_accuracy(x).alias("acc"), eval_counts(x).alias("k"))
    v = F.try_parse_json(F.col(record))
    df = df.withColumns({f"_{s}{i}": side(member(v, *paths)) for i, pair in enumerate(PAIRS) for s, paths in zip("ab", pair, strict=True)})
    df = df.withColumn("_own", side(F.coalesce(member(v, "post", "post_eval"), v)))
    whole = [F.col(f"_a{i}.acc").isNotNull() & F.col(f"_b{i}.acc").isNotNull() for i in range(len(PAIRS))]
    pick = lambda s: F.coalesce(*[F.when(ok, F.col(f"_{s}{i}")) for i, ok in enumerate(whole)])
    df = df.withColumns({"_pre": pick("a"), "_post": pick("b")})
    w = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumn("_before", F.lag(F.coalesce("_post", "_own")).over(w))
    a = F.when(F.col("_pre").isNotNull(), F.col("_pre")).otherwise(F.col("_before"))
    b = F.coalesce("_post", "_own")
    df = df.withColumns({"_a": a, "_b": b}).withColumn("gain", F.col("_b.acc") - F.col("_a.acc"))
    band = noise_band([(F.col("_a.k.c"), F.col("_a.k.n")), (F.col("_b.k.c"), F.col("_b.k.n"))], z)
    df = df.withColumn("band", F.when(F.col("gain").isNotNull(), band).otherwise(F.lit(0.0)))
    df = df.withColumn("marginal", F.coalesce(F.col("gain") < F.greatest(F.lit(min_delta), F.col("band")), F.lit(False)))
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def generation(explicit: Column, imported: Column, iteration: Column, any_imported: Column) -> Column:
    """The explicit generation, else 1 for imported records, else iteration plus 2 or 1; 1 where nothing can be read."""
    after = iteration + F.when(any_imported, 2).otherwise(1)
    return F.coalesce(explicit, F.when(imported, F.lit(1)).otherwise(after), F.lit(1)).cast("long")


def checkpoint_roles(df: DataFrame, group: Sequence[str], batch: str, name: str) -> DataFrame:
    """Adds ``role``: the last checkpoint of a group by (batch, name) is finalized, the others intermediate."""
    order = F.struct(F.coalesce(F.col(batch), F.lit(-1)).alias("b"), F.col(name).alias("n"))
    last = df.where(F.col(group[0]).isNotNull()).groupBy(*group).agg(F.max(order).alias("_last"))
    joined = df.join(last, list(group))
    return joined.withColumn("role", F.when(order == F.col("_last"), "finalized").otherwise("intermediate")).drop("_last")


def last_values(events: DataFrame, by: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The current row of each group: for every field its last non-null value."""
    at = F.struct(*order)
    return events.groupBy(*by).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields])


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The last ``n`` rows: a bounded top-n, no global sort."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def upsert(base: DataFrame, new: DataFrame, key: str, ord_col: str) -> DataFrame:
    """Replace the rows of ``base`` that ``new`` has too, in place; append the others behind, in the order of ``new``.

    A key occurs at most once in the result: later rows of the same key in ``new`` win.
    """
    new = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), F.col(ord_col)).alias("_r")).select("_r.*")
    first = base.groupBy(key).agg(F.min(ord_col).alias("_at"))
    kept = base.join(first, key).where(F.col(ord_col) == F.col("_at")).drop("_at")
    top = base.agg(F.coalesce(F.max(ord_col), F.lit(-1)).alias("_top"))
    n = new.join(first, key, "left").crossJoin(F.broadcast(top))
    place = F.coalesce(F.col("_at"), F.col("_top") + 1 + F.col(ord_col))
    merged = n.withColumn(ord_col, place).select(*base.columns)
    return kept.join(new.select(key), key, "left_anti").select(*base.columns).unionByName(merged)


def overlay(points: DataFrame, live: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Live values over recorded points, field by field; live points without a record are appended."""
    p, v = points.alias("p"), live.alias("v")
    joined = p.join(v, F.col(f"p.{key}") == F.col(f"v.{key}"), "full")
    return joined.select(
        F.coalesce(F.col(f"v.{key}"), F.col(f"p.{key}")).alias(key),
        *[F.coalesce(F.col(f"v.{f}"), F.col(f"p.{f}")).alias(f) for f in fields],
    )


def refine(history: DataFrame, refined: DataFrame, key: str, n: str, fields: Sequence[str]) -> DataFrame:
    """Late refinements replace a record only if they rest on at least as many observations."""
    h, r = history.alias("h"), refined.alias("r")
    use = F.col(f"r.{n}") >= F.coalesce(F.col(f"h.{n}"), F.lit(0))
    pick = lambda c: F.when(use, F.col(f"r.{c}")).otherwise(F.col(f"h.{c}")).alias(c)
    return h.join(r, F.col(f"h.{key}") == F.col(f"r.{key}"), "left").select(
        F.col(f"h.{key}").alias(key), pick(n), *[pick(f) for f in fields], F.coalesce(use, F.lit(False)).alias("refined")
    )


def headline(live: Column, recorded: Column, keep_zero: bool = False) -> Column:
    """The live value, falling back to the recorded one; a live zero counts as missing unless ``keep_zero``."""
    return F.coalesce(live if keep_zero else F.nullif(live, F.lit(0.0)), recorded)


def reusable(df: DataFrame, by: Sequence[str], ordinal: str, model: str, sample: str) -> DataFrame:
    """Adds ``reuse``: the step before had the same model and sample, neither of them blank."""
    w = Window.partitionBy(*by).orderBy(ordinal)
    same = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")) == F.lag(F.nullif(F.col(c), F.lit(""))).over(w), F.lit(False))
    return df.withColumn("reuse", same(model) & same(sample))


def upsert_where(base: DataFrame, new: DataFrame, matches: Column, ord_col: str) -> DataFrame:
    """Replace all rows of ``base`` that match by the one row of ``new``, in the place of the first of them, else append it."""
    place = base.agg(
        F.coalesce(F.min(F.when(matches, F.col(ord_col))), F.max(ord_col) + 1, F.lit(0)).alias("_at")
    )
    row = new.drop(ord_col).crossJoin(F.broadcast(place)).withColumnRenamed("_at", ord_col).select(*base.columns)
    return base.where(~F.coalesce(matches, F.lit(False))).unionByName(row)


def finished_record(evals: DataFrame, by: Sequence[str]) -> DataFrame:
    """The history record of an iteration from its evaluations: pre, post and delta per split and the overfit gap.

    ``evals`` has split (train_seed, heldout), stage (pre, post) and accuracy.
    """
    at = lambda split, stage: F.max(F.when((F.col("split") == split) & (F.col("stage") == stage), F.col("accuracy")))
    wide = evals.groupBy(*by).agg(*[at(s, g).alias(f"{s}_{g}") for s in ("train_seed", "heldout") for g in ("pre", "post")])
    block = lambda s: F.struct(F.col(f"{s}_pre").alias("pre"), F.col(f"{s}_post").alias("post"), (F.col(f"{s}_post") - F.col(f"{s}_pre")).alias("delta"))
    gap = F.struct((F.col("train_seed_post") - F.col("heldout_post")).alias("overfit_gap"))
    return wide.select(*by, block("train_seed").alias("train_seed"), block("heldout").alias("heldout"), gap.alias("delta"))
