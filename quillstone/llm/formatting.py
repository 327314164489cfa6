"""Problem 1: duplicates hidden by formatting differences.

Everything is built from JVM string functions, so a row never leaves the executor's JVM: a text is canonicalised
(characters, case, white space, marks, brackets around the whole, digit grouping), the canonical fields of a record are
put in a fixed order, and the record is hashed to 128 bits. Groups form by a map-side combined aggregation over the
hash alone; an independent 64-bit check value shows whether two different texts met in one hash, and such groups are
formed again by the text itself.

Defined cases: a null or blank field counts as missing and agrees only with a missing one. Rows whose key field is
missing (or only marks) are no records and appear in no result. Repeated ids keep one row each in the counts. An empty
table gives empty results. Other columns of the table are never read and may have any name. Very long texts are
processed whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.spelling import with_spelling
from quillstone.operators.skew import join_to_groups
from quillstone.session import cut

MISSING = "\u0000"


def with_record_key(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Adds ``key``: the canonical text of a record, whatever the order of its fields; no row if the first is missing."""
    names = [f"f{i}" for i in range(len(fields))]
    df = with_spelling(df, dict(zip(names, fields, strict=True)))
    parts = [F.when(F.col(c) == "", F.lit(MISSING)).otherwise(F.col(c)) for c in names]
    return df.where("f0 <> ''").withColumn("key", F.array_join(F.array_sort(F.array(*parts)), "\u0001"))


def md5_128(text: Column) -> tuple[Column, Column]:
    """128 bits of ``text`` as two longs: fixed-width keys keep the aggregation in hash mode."""
    digest = F.md5(text)
    half = lambda a: F.conv(F.substring(digest, a, 16), 16, -10).cast("long")
    return half(1), half(17)


def formatting_groups(
    df: DataFrame,
    id_col: str,
    fields: Sequence[str],
    hasher: Callable[[Column], tuple[Column, Column]] = md5_128,
) -> tuple[DataFrame, DataFrame]:
    """Rows with their group key, and one row per group: ``kept_id`` (smallest id) and ``n_rows``.

    The key is (h1, h2, sub): two halves of the hash, and a text that is empty but for hashes in which different texts
    met. ``hasher`` is a parameter so that tests can provoke such meetings.
    """
    src = {f"c{i}": c for i, c in enumerate(fields)}
    rows = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), *[F.col(c).alias(name) for name, c in src.items()]
    )
    rows = with_record_key(rows, list(src)).select("id", "key")
    h1, h2 = hasher(F.col("key"))
    chk = F.xxhash64(F.col("key"), F.length("key"))
    hashed = cut(rows.select("id", h1.alias("h1"), h2.alias("h2"), chk.alias("chk")), "formatting")
    sums = hashed.groupBy("h1", "h2").agg(
        F.min("id").alias("kept_id"),
        F.count("*").alias("n_rows"),
        F.min("chk").alias("lo"),
        F.max("chk").alias("hi"),
    )
    groups = sums.where("lo = hi").select("h1", "h2", F.lit("").alias("sub"), "kept_id", "n_rows")
    keyed = hashed.select("id", "h1", "h2", F.lit("").alias("sub"))
    mixed = sums.where("lo <> hi").select("h1", "h2")
    if mixed.limit(1).count():
        texts = rows.select("id", F.col("key").alias("sub"), h1.alias("h1"), h2.alias("h2"))
        texts = texts.join(mixed, ["h1", "h2"], "left_semi")
        again = texts.groupBy("h1", "h2", "sub").agg(F.min("id").alias("kept_id"), F.count("*").alias("n_rows"))
        groups = groups.unionByName(again)
        keyed = keyed.join(mixed, ["h1", "h2"], "left_anti").unionByName(texts)
    return keyed, groups


def formatting_copies(df: DataFrame, id_col: str, fields: Sequence[str], **kw) -> DataFrame:
    """One row (kept_id, copy_id) for each row that repeats a row of smaller id."""
    rows, groups = formatting_groups(df, id_col, fields, **kw)
    pairs = join_to_groups(rows, groups.where("n_rows > 1"), ["h1", "h2", "sub"], "n_rows")
    return pairs.where("id > kept_id").select("kept_id", F.col("id").alias("copy_id"))


def formatting_counts(df: DataFrame, id_col: str, fields: Sequence[str], **kw) -> DataFrame:
    """One row (kept_id, n_rows) per record, with the number of rows it stood for."""
    return formatting_groups(df, id_col, fields, **kw)[1].select("kept_id", "n_rows")
