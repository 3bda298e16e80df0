"""Helpers shared by the training-data operators: tables, scratch space, Arrow batches."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession, rows: int = 256) -> None:
    """Gives the executors this package. Python workers see at most `rows` rows at once, so that long texts cannot
    pile up in one batch."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only where none is set,
    as in tests on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "/tmp/framelake-checkpoints"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: With these Spark deletes a query's shuffle files at its end (else they stay until the driver collects its garbage) and
#: keeps no long plan strings in the driver, which makes and holds one for each query and anew for each of its stages.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "8192"}


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` written once as Parquet to the shared scratch folder and read back: lineage ends here and a lost
    executor costs a re-read, not a recomputation. Its shuffle files go once it is written. `discard` deletes it; else
    the cluster clears the folder."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that `written` made and nothing reads any more."""
    for df in tables:
        if df is not None and getattr(df, "scratch_path", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(id_column: str, modulus: int) -> Column:
    """crc32 of the id written as decimal text, modulo `modulus`; null ids give null."""
    return F.crc32(F.col(id_column).cast("string")) % F.lit(modulus)


def crc_mod_py(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def fold(key: Column, folds: int) -> Column:
    """A fold from 0 to folds - 1 that depends on the id alone."""
    return F.pmod(F.xxhash64(key), F.lit(folds))
