"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each Spark context, wherever their Python looks for modules."""
    context = spark.sparkContext
    if getattr(context, "_framelake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "framelake_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    context._framelake_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only where none is set, on one
    machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "/tmp/framelake-checkpoints"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: With this Spark deletes a query's shuffle files at its end; else they stay until the driver collects its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str, tidy: bool = False) -> DataFrame:
    """`df` written once as Parquet to the shared folder and read back: its lineage ends there. `discard` deletes it.
    tidy: its shuffle files go once it is written."""
    conf, path = df.sparkSession.conf, f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    before = conf.get(_TIDY)
    try:
        conf.set(_TIDY, str(tidy).lower() if tidy else before)
        df.write.parquet(path)
    finally:
        conf.set(_TIDY, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that `written` made and nothing reads any more."""
    for df in tables:
        if df is not None and getattr(df, "scratch_path", None):
            remove(df.sparkSession, df.scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, in whatever store; nothing if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The names of files and folders whose whole path fits a pattern with *, in whatever store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return [s.getPath().getName() for s in found or []]
