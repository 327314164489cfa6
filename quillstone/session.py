"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session as the tests and the benchmark use it."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillstone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return ship(b.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests, a local master) a local folder is made and set.
    """
    sc = spark.sparkContext
    path = sc.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if not path:
        set_dir = sc._jsc.sc().getCheckpointDir()
        path = set_dir.get() if set_dir.isDefined() else None
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"quillstone-{os.getpid()}")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    fs, p = file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path as its object."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of the shared folder; None if there is none."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file as a whole: it is written beside and moved, so that a reader never sees a part."""
    fs, p = file_system(spark, path)
    beside = file_system(spark, f"{path}.{uuid.uuid4().hex[:8]}")[1]
    fs.mkdirs(p.getParent())
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(beside, p):
        fs.delete(p, False)
        fs.rename(beside, p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder in order; none if there is no such folder."""
    fs, p = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def cut(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        folder = Path(tempfile.mkdtemp(prefix="quillstone-"))
        archive = folder / "quillstone.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)
    return spark


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path; a path that is gone already is no error."""
    fs, p = file_system(spark, path)
    fs.delete(p, True)
