"""Readers of the run directory. Schemas are given, never inferred; bad rows fail or are skipped as each contract says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillstone.functions.text import strip
from quillstone.session import file_system

_CSV = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"', "encoding": "UTF-8", "enforceSchema": "false"}


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text by header name; a byte order mark and blanks around names are dropped."""
    raw = spark.read.options(**_CSV).csv(path)
    return raw.select(*[F.col(f"`{c}`").alias(c.replace("﻿", "").strip()) for c in raw.columns])


def _required(c: Column, message: str) -> Column:
    ok = F.length(strip(F.coalesce(c, F.lit("")))) > 0
    return F.when(ok, strip(c)).otherwise(F.raise_error(F.lit(message)).cast("string"))


def _columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")


def math_csv(spark: SparkSession, path: str) -> DataFrame:
    """(operation, solution): solution may be missing, an empty operation is an error."""
    df = _csv(spark, path)
    _columns(df, "operation")
    sol = strip(F.coalesce(F.col("solution"), F.lit(""))) if "solution" in df.columns else F.lit("")
    return df.select(_required(F.col("operation"), "empty operation").alias("operation"), sol.alias("solution"))


def training_csv(spark: SparkSession, path: str) -> DataFrame:
    """(operation, solution), both required; at least one row."""
    df = _csv(spark, path)
    _columns(df, "operation", "solution")
    out = df.select(
        _required(F.col("operation"), "empty operation").alias("operation"),
        _required(F.col("solution"), "empty solution").alias("solution"),
    )
    if out.isEmpty():
        raise ValueError("no rows")
    return out


def operations_csv(spark: SparkSession, path: str) -> DataFrame:
    return math_csv(spark, path).select("operation")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): the text lines of one or more files with their 1-based position.

    Files are split as usual: lines are counted per split, and the running sum over the splits of a file sees one row a
    split. Only the numbers of lines need a second, narrow pass over the file.
    """
    each = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), "value"
    )
    splits = each.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    at = F.col("_off") + F.col("_id") - F.col("_first") + 1
    return each.join(splits, ["file", "_start"]).select("file", at.alias("line_no"), "value")


def json_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Parsed objects (file, line_no, record): blank, torn and other lines are skipped; ``limit`` counts raw lines from the end."""
    df = lines(spark, path)
    if limit is not None:
        last = df.groupBy("file").agg(F.max("line_no").alias("_top"))
        df = df.join(last, "file").where(F.col("line_no") > F.col("_top") - limit).drop("_top")
    v = F.try_parse_json("value")
    return df.where(F.schema_of_variant(v).startswith("OBJECT")).select("file", "line_no", F.col("value").alias("record"))


def appended_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """As ``json_lines``, but only the last line of a file may be torn; any other bad line is an error."""
    df = lines(spark, path).where(F.length(F.trim("value")) > 0)
    last = df.groupBy("file").agg(F.max("line_no").alias("_top"))
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    df = df.join(last, "file").withColumn("_ok", ok).where(F.col("_ok") | (F.col("line_no") < F.col("_top")))
    record = F.when(F.col("_ok"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("bad record in line "), F.col("line_no").cast("string"))).cast("string"))
    return df.select("file", "line_no", record.alias("record"))


def lenient_json(spark: SparkSession, path: str) -> DataFrame:
    """One row with the parsed document, null if it is missing or corrupt; never fails."""
    schema = StructType([StructField("value", StringType())])
    try:
        rows = spark.read.text(path, wholetext=True)
        rows.schema  # noqa: B018
    except Exception:  # noqa: BLE001  a missing path is one of the defined cases
        rows = spark.createDataFrame([(None,)], schema)
    return rows.select(F.try_parse_json("value").alias("value"))


def strict_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed rows; a malformed document is an error, unknown members are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def physical_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row ``n``: text lines but the header, at least 0; quoted line breaks count as lines. Null for a missing file."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([(None,)], "n long")
    return spark.read.text(path).agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("n"))


def run_directories(spark: SparkSession, root: str, marker: str = "status.json") -> DataFrame:
    """(run, modified, bytes) of every run directory that holds ``marker``, newest first; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", marker).option("recursiveFileLookup", "true").load(root)
    run = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return files.select(run.alias("run"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).orderBy(F.desc("modified"), "run")


def iteration_files(spark: SparkSession, run_dir: str, names: dict[str, str]) -> DataFrame:
    """One row an ``iter_*`` directory with a flag for each named file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(run_dir).select("path", "length")
    it = F.regexp_extract("path", r"iter_([0-9]+)/", 1)
    rows = files.where(it != "").withColumn("iteration", it.cast("int"))
    flags = [F.max(F.col("path").endswith(f"/{f}")).alias(f"has_{n}") for n, f in names.items()]
    return rows.groupBy("iteration").agg(*flags)
