"""Run-log operators over streams of immutable JSON files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "ts timestamp, kind string, iteration int, phase string, message string, payload string"


def event_stream(spark: SparkSession, directory: str, schema: str = EVENT, files_per_batch: int = 100) -> DataFrame:
    """Events from a directory to which whole files are added; a growing file would not be read again."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(directory)


def current_status(events: DataFrame, by: Sequence[str], fields: Sequence[str], ts: str = "ts") -> DataFrame:
    """Last non-null value of every field per group: the state is one row a group."""
    at = lambda f: F.when(F.col(f).isNotNull(), F.struct(F.col(ts)))
    return events.groupBy(*by).agg(F.max(ts).alias("updated_at"), *[F.max_by(f, at(f)).alias(f) for f in fields])


def windowed_counts(events: DataFrame, by: Sequence[str], length: str, late: str, ts: str = "ts") -> DataFrame:
    """Counts per event-time window; events later than ``late`` are left out and state is dropped behind the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length), *by).agg(F.count("*").alias("n"))


def index_checkpoints(stream: DataFrame, keys: Sequence[str], late: str | None = None, ts: str = "ts") -> DataFrame:
    """Every checkpoint once, however often it is reported; with ``late`` the state of old keys is dropped."""
    if late is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def progress_by_tag(events: DataFrame, tag: str, value: str, done: str, ts: str = "ts") -> DataFrame:
    """Running value of every tag, and its last completed value."""
    at = F.struct(F.col(ts))
    running = F.when(F.col(done), F.lit(None)).otherwise(F.col(value))
    return events.groupBy(tag).agg(
        F.max_by(running, at).alias("in_progress"), F.max_by(F.when(F.col(done), F.col(value)), F.when(F.col(done), at)).alias("completed")
    )


def upsert_stream(
    stream: DataFrame, target: str, key: str, newest: Callable[[DataFrame], DataFrame], checkpoint: str, **trigger: str | bool
) -> StreamingQuery:
    """Late corrections merged into a table by key, batch by batch.

    Each batch writes a new version beside the old one and then moves the pointer, so that a lost batch is repeated
    without harm. ``newest`` picks one row a key from old and new rows.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        from quillstone.sources.writers import save_json

        local = target.removeprefix("file://")
        pointer = f"{local}/current.json"
        try:
            import json

            with open(pointer, encoding="utf-8") as f:
                now = json.load(f)
        except FileNotFoundError:
            now = {"version": None, "batch": -1}
        if batch_id <= now["batch"]:
            return
        rows = batch
        if now["version"] is not None:
            rows = spark.read.schema(batch.schema).parquet(now["version"]).unionByName(batch)
        version = f"{target}/v{batch_id:09d}"
        newest(rows).write.mode("overwrite").parquet(version)
        save_json(pointer, {"version": version, "batch": batch_id})

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
