"""A library kept as snapshots in hash buckets, so that a change rewrites the buckets that it touches and no others.

A table is a folder: data/<part>/bucket=<n> holds the rows whose key falls in bucket n, versions/v=<number> lists which
part of each bucket is alive. A change reads the buckets of its keys, writes them anew as one part, then writes the next
version; that list's _SUCCESS is the moment at which the change holds. What stops before leaves a part that no version
names, and doing the change again gives the same rows. Readers keep the version that they began with. There is one
writer at a time, as there is one master.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framelake.session import names, remove

BUCKETS = 64
_LISTED = "bucket int, part string, about string"


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions that hold, in order."""
    return sorted(int(n[2:]) for n in names(spark, f"{folder}/versions") if n.startswith("v=") and "_SUCCESS" in names(spark, f"{folder}/versions/{n}"))


def _listed(spark: SparkSession, folder: str, version: int) -> tuple[dict[int, str], StructType, int]:
    """The live part of each bucket that has rows, the schema, and the number of buckets."""
    rows = spark.read.schema(_LISTED).json(f"{folder}/versions/v={version}").collect()  # a row for each bucket
    about = next(r for r in rows if r["bucket"] < 0)
    return {r["bucket"]: r["part"] for r in rows if r["bucket"] >= 0}, StructType.fromJson(json.loads(about["about"])), int(about["part"])


def _list(spark: SparkSession, folder: str, version: int, live: dict[int, str], schema: StructType, buckets: int) -> None:
    rows = [(-1, str(buckets), schema.json()), *[(b, p, None) for b, p in sorted(live.items())]]
    spark.createDataFrame(rows, _LISTED).coalesce(1).write.mode("overwrite").json(f"{folder}/versions/v={version}")


def _part(df: DataFrame, folder: str, key: str, buckets: int, most: int) -> tuple[str, list[int]]:
    """Writes rows as a new part, and which buckets it has."""
    name = uuid.uuid4().hex
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    df.withColumn("bucket", bucket).repartition(max(1, most), "bucket").write.partitionBy("bucket").parquet(f"{folder}/data/{name}")
    return name, [int(n.removeprefix("bucket=")) for n in names(df.sparkSession, f"{folder}/data/{name}") if n.startswith("bucket=")]


def create(df: DataFrame, folder: str, key: str, buckets: int = BUCKETS) -> None:
    """A table with the rows of `df` as its first version."""
    spark = df.sparkSession
    part, has = _part(df, folder, key, buckets, buckets)
    _list(spark, folder, 1, dict.fromkeys(has, part), df.schema, buckets)


def _rows(spark: SparkSession, folder: str, live: dict[int, str], schema: StructType) -> DataFrame:
    if not live:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/data/{p}/bucket={b}" for b, p in sorted(live.items())])


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The rows of a version, else of the last one."""
    live, schema, _ = _listed(spark, folder, version or versions(spark, folder)[-1])
    return _rows(spark, folder, live, schema)


def change(spark: SparkSession, folder: str, key: str, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """The next version, in which `merge(rows, changes)` stands for the rows of all buckets that hold a key of `changes`.
    It must keep rows whose key isn't among the changes as they are. Returns how many buckets were written anew."""
    before = versions(spark, folder)[-1]
    live, schema, buckets = _listed(spark, folder, before)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    touched = {r["bucket"] for r in changes.where(F.col(key).isNotNull()).select(bucket.alias("bucket")).distinct().collect()}  # at most all buckets
    rows = merge(_rows(spark, folder, {b: p for b, p in live.items() if b in touched}, schema), changes.where(F.col(key).isNotNull()))
    rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema])
    part, has = _part(rows, folder, key, buckets, len(touched))
    kept = {b: p for b, p in live.items() if b not in touched}
    _list(spark, folder, before + 1, kept | dict.fromkeys(has, part), schema, buckets)
    return len(touched)


def clean(spark: SparkSession, folder: str, keep: int = 1) -> None:
    """Deletes versions but for the last `keep`, and parts that none of those names."""
    stay = versions(spark, folder)[-keep:]
    named = {p for v in stay for p in _listed(spark, folder, v)[0].values()}
    for name in names(spark, f"{folder}/versions"):
        if name.startswith("v=") and int(name[2:]) < stay[0]:
            remove(spark, f"{folder}/versions/{name}")
    for name in names(spark, f"{folder}/data"):
        if name not in named:
            remove(spark, f"{folder}/data/{name}")
