"""Sweeps over watched folders that go on where they were stopped.

A sweep looks at its directories chunk by chunk. What a chunk finds is written first, then the list of its directories;
that list's _SUCCESS is the moment at which the chunk is done, and what a stopped chunk left is written over. The next run
leaves out the directories that are done, by an anti-join, so directories that came in the meantime are looked at and
none is looked at twice. A sweep that hasn't moved for a day is given up, as trees drift, and a new one begins.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.session import discard, names, written

#: Directories of a chunk, and hours after which a stopped sweep is given up.
CHUNK = 200
HOURS = 24
_DONE = "root string, directory string, at timestamp"


def _held(spark: SparkSession, folder: str) -> list[str]:
    """Names of parts of a folder that were written to their end."""
    return [n for n in names(spark, folder) if "_SUCCESS" in names(spark, f"{folder}/{n}")]


def done(spark: SparkSession, folder: str, sweep: int) -> DataFrame:
    """(root, directory, at): the directories that a sweep has looked at."""
    where = f"{folder}/sweep={sweep}/done"
    parts = _held(spark, where)
    return spark.read.schema(_DONE).parquet(*[f"{where}/{p}" for p in parts]) if parts else spark.createDataFrame([], _DONE)


def current(spark: SparkSession, folder: str, now: datetime.datetime, hours: int = HOURS) -> int:
    """The number of the sweep to go on with, or of a new one."""
    numbers = sorted(int(n.removeprefix("sweep=")) for n in names(spark, folder) if n.startswith("sweep="))
    if not numbers:
        return 1
    last = numbers[-1]
    moved = done(spark, folder, last).agg(F.unix_micros(F.max("at"))).first()[0]
    stale = moved is None or now.timestamp() - moved / 1e6 > hours * 3600
    return last + 1 if stale or "finished" in _held(spark, f"{folder}/sweep={last}") else last


def run(directories: DataFrame, folder: str, look: Callable[[DataFrame], DataFrame], now: datetime.datetime, chunk: int = CHUNK, hours: int = HOURS, most: int | None = None) -> tuple[int, bool]:
    """Goes on with the sweep over directories (root, directory), or begins one: `look` gets some of them and returns
    what is there. Stops after `most` chunks. Returns the number of the sweep and whether it is finished."""
    spark = directories.sparkSession
    sweep = current(spark, folder, now, hours)
    where = f"{folder}/sweep={sweep}"
    before = len(_held(spark, f"{where}/done"))
    left = directories.select("root", "directory").distinct().join(done(spark, folder, sweep), ["root", "directory"], "left_anti")
    left = written(left.withColumn("hash", F.xxhash64("root", "directory")), "sweep")
    chunks = -(-left.count() // chunk)
    for i in range(chunks if most is None else min(chunks, most)):
        some = left.where(F.pmod("hash", F.lit(chunks)) == i).select("root", "directory")
        look(some).write.mode("overwrite").parquet(f"{where}/found/chunk={before + i}")
        at = F.timestamp_micros(F.lit(int(now.timestamp() * 1e6)))
        some.withColumn("at", at).write.mode("overwrite").parquet(f"{where}/done/chunk={before + i}")
    discard(left)
    finished = most is None or chunks <= most
    if finished:
        spark.createDataFrame([(now,)], "at timestamp").coalesce(1).write.mode("overwrite").parquet(f"{where}/finished")
    return sweep, finished


def found(spark: SparkSession, folder: str, sweep: int, schema) -> DataFrame:
    """What the finished chunks of a sweep found."""
    parts = _held(spark, f"{folder}/sweep={sweep}/done")
    return spark.read.schema(schema).parquet(*[f"{folder}/sweep={sweep}/found/{p}" for p in parts]) if parts else spark.createDataFrame([], schema)
