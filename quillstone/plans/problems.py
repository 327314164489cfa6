"""Queries of the general data problems: nested records (2) and drifting schemas (4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import drift, nested, tables

ROOTS = ["heldout", "train_seed", "delta", "train"]
#: Members of a history record that are not flat fields.
STRUCTURED = ["iteration", "generation", "new_examples", "train_pool_size", "train", "train_seed", "heldout", "delta"]
_CI = [f"{root}.{part}.sequential_ci" for root in ("heldout", "train_seed") for part in ("pre", "post")]
#: The root table and the child tables of history; ``p2_tables`` has the rows of any other.
TABLES = [
    "",
    *("delta.by_effort", "delta.by_effort[].spans", "train.checkpoints", "train.checkpoints[].rewards", "train.notes"),
    *(f"{ci}.{t}" for ci in _CI for t in ("batches", "batches[].ids", "comparisons", "comparisons[].spans")),
]
FLAT = ["pre", "post_heldout", "post_train"]


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/history.parquet")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.object_elements(_history(spark, sf), "history_id", "record", ROOTS)


def p2_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the root table ('') and of all child tables with their surrogate keys and members."""
    rows = tables.all_rows(_history(spark, sf), "history_id", "record", ROOTS)
    return rows.select(F.col("record_id").alias("history_id"), "table", "node_id", "parent_id", "path", "ordinal", "kind", "body")


def _table_query(table: str) -> Callable[[SparkSession, str], DataFrame]:
    """One table of history with typed columns."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = tables.typed_table(_history(spark, sf), "history_id", "record", ROOTS, table)
        return rows.withColumnRenamed("record_id", "history_id")

    query.__name__ = "p2_" + (table.replace("[]", "").replace(".", "_") or "root")
    return query


def p2_schema(spark: SparkSession, sf: str) -> DataFrame:
    """The merged schema: every path with its kinds."""
    return nested.merged_schema(_history(spark, sf), "record", ROOTS)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.schema_changes(_history(spark, sf), "run_id", "file_seq", "record", STRUCTURED)


def p4_table(spark: SparkSession, sf: str) -> DataFrame:
    """All readable lines in one consistent table."""
    ids = ["history_id", "run_id", "file_seq", "line_no"]
    return drift.united(_history(spark, sf), ids, "run_id", "file_seq", "record", FLAT, STRUCTURED)


QUERIES = {
    f.__name__: f for f in (p2_found, p2_tables, p2_schema, *map(_table_query, TABLES), p4_found, p4_table)
}
SQL: dict[str, str] = {}
