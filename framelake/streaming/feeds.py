"""Streams: the ledger as it grows, and the latest state of each key.

Event-time windows with a watermark are an addition of this library. Parquet timestamps without a zone are read as UTC.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.session import shared_folder


def open_stream(spark: SparkSession, path: str, time: str, files_per_trigger: int = 8) -> DataFrame:
    """New Parquet files of a folder (or the one file given), with `time` as a timestamp."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    single = name.endswith(".parquet") and not any(True for _ in _parts(spark, path))
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def _parts(spark: SparkSession, path: str):
    """Files below a path, if it is a folder; through Spark's file systems, so any store will do."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(where).isDirectory():
        yield from fs.listStatus(where)


def daily(rows: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """Rows of each UTC day; a day is final once the watermark has passed it."""
    w = F.window(time, "1 day")
    return rows.withWatermark(time, late).groupBy(w).agg(F.count("*").alias("events"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("value_cents")).select(F.to_date("window.start").alias("day"), "events", "value_cents")


def latest(rows: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """The latest values of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), F.col(order)).alias("last"), F.count("*").alias("events")).select(key, *[F.col(f"last.{v}").alias(v) for v in values], "events")


def drained(rows: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and returns its result, which is written to the shared scratch folder, as
    is the stream's state. A batch in complete mode is the whole result and replaces the one before."""
    spark = rows.sparkSession
    where = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    out = f"{where}/rows"
    spark.createDataFrame([], rows.schema).write.parquet(out if mode == "complete" else f"{out}/batch=-1")
    sink = (lambda batch, _: batch.write.mode("overwrite").parquet(out)) if mode == "complete" else append_to(out)
    query = push(rows, sink, f"{where}/state", mode=mode)
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(rows.schema).parquet(out).select(*rows.columns)


def push(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "append"):
    """Gives each batch to `sink`. The checkpoint makes the stream go on where it stopped; a sink must bear the same
    batch twice."""
    writer = rows.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own, so a repeated batch replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
