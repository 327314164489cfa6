"""Queries of the training-data problems, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import formatting, incremental, ledger, mojibake, packing, pairs, tokens

#: pack_capacity is a fixed small table; more capacities than this are an error.
MAX_CAPACITIES = 1000


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return formatting.formatting_copies(_table(spark, sf, "math_example"), "example_id", ["operation", "solution"])


def p1_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Each record with the number of rows it stood for."""
    return formatting.formatting_counts(_table(spark, sf, "math_example"), "example_id", ["operation", "solution"])


def p3_sample(spark: SparkSession, sf: str) -> DataFrame:
    tables = {"heldout": _table(spark, sf, "eval_heldout_sample"), "train": _table(spark, sf, "eval_train_sample")}
    return ledger.stable_sample(tables, "operation", "snapshot")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.repeats_of_history(
        _table(spark, sf, "train_data"), _table(spark, sf, "validated"), "example_id", "operation", "batch_no"
    )


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.defects(_table(spark, sf, "arithmetic_run_instant"), "answer_id", "operation", "output")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_column(_table(spark, sf, "documents"), "doc_id", "text")


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    sizes = tokens.encode_column(_table(spark, sf, "documents"), "doc_id", "text", sizes=True)
    rows = _table(spark, sf, "pack_capacity").select("capacity").distinct().limit(MAX_CAPACITIES + 1).collect()
    if len(rows) > MAX_CAPACITIES:
        raise ValueError(f"more than {MAX_CAPACITIES} capacities")
    return packing.pack_all(sizes, "doc_id", "n_tokens", [r["capacity"] for r in rows])


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    out = mojibake.restored(_table(spark, sf, "documents"), "doc_id", "text", "source")
    return out.where("found").select("doc_id")


def p9_restored(spark: SparkSession, sf: str) -> DataFrame:
    """The found documents with their restored text."""
    out = mojibake.restored(_table(spark, sf, "documents"), "doc_id", "text", "source")
    return out.where("found").select("doc_id", F.col("text").alias("restored"))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p3_sample, p5_found, p6_found, p7_ids, p8_packed, p9_found, p9_restored)}


def _ledger_sql(snapshots: int = 8, share: float = 0.25, least: int = 10, seed: str = "ledger-1") -> str:
    """The ledger of ``p3_sample`` snapshot by snapshot; each step sees the one before."""
    blank = r"[\s\p{Z}\x{200B}\x{2060}\x{FEFF}]+"
    member = f"nullif(regexp_replace(operation, '^{blank}|{blank}$', '', 'g'), '')"
    steps = [
        f"""rows as (select 'heldout' as track, {member} as key, snapshot from eval_heldout_sample union all
select 'train', {member}, snapshot from eval_train_sample),
members as (select track, key, min(snapshot) as s, md5(concat('{seed}', chr(1), track, chr(1), key)) as priority from rows where key is not null group by 1, 2)"""
    ]
    for s in range(snapshots):
        had = f"l{s - 1}" if s else "(select '' as track, '' as key, '' as priority, 0 as snapshot where false)"
        steps.append(
            f"""l{s} as materialized (select * from {had} union all select track, key, priority, {s} from (
select m.*, row_number() over (partition by m.track order by priority, key) as rn,
  least(q.n, greatest({least}, ceil(round({share} * q.n, 6)))) - coalesce(h.n, 0) as room
from members m join (select track, count(*) as n from members where s <= {s} group by 1) q on q.track = m.track
left join (select track, count(*) as n from {had} group by 1) h on h.track = m.track
where m.s <= {s} and not exists (select 1 from {had} x where x.track = m.track and x.key = m.key)) where rn <= room)"""
        )
    return "with " + ",\n".join(steps) + f"\nselect track, key as operation, priority, cast(snapshot as int) as snapshot from l{snapshots - 1}"


SQL: dict[str, str] = {"p3_sample": _ledger_sql()}
