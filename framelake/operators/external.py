"""Languages from lists that another program gives out from time to time, as they were when a file was looked at.

A list holds for so many hours after it was staged. A file takes the youngest list staged at or before its time, if that
one still holds; within it the longest root above the file decides. Times are put in buckets as long as a list holds, so
a file meets the lists of its own bucket and of the one before in an equality join, and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.language import two_letter

HOURS = 24


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def as_of(files: DataFrame, lists: DataFrame, hours: float = HOURS) -> DataFrame:
    """(file_path, at, staged_at) of files (file_path, at): the list that holds for each; null where none does. Lists are
    rows with a staged_at; files without a time have no list. Rows that repeat a path and a time are one."""
    held = int(hours * 3_600_000_000)
    bucket = lambda c: F.floor(_micros(F.col(c)) / held)
    times = lists.where("staged_at is not null").select("staged_at").distinct()
    meets = times.select("staged_at", F.explode(F.array(bucket("staged_at"), bucket("staged_at") + 1)).alias("bucket"))
    rows = files.select("file_path", "at").distinct()
    both = rows.where("at is not null").withColumn("bucket", bucket("at")).join(meets, "bucket")
    age = _micros(F.col("at")) - _micros(F.col("staged_at"))
    best = both.where((age >= 0) & (age <= held)).groupBy("file_path", "at").agg(F.max("staged_at").alias("staged_at"))
    return rows.join(best.withColumnsRenamed({"file_path": "p", "at": "a"}), F.col("file_path").eqNullSafe(F.col("p")) & F.col("at").eqNullSafe(F.col("a")), "left").select("file_path", "at", "staged_at")


def language_at(files: DataFrame, lists: DataFrame, hours: float = HOURS) -> DataFrame:
    """(file_path, at, staged_at, language) by lists (staged_at, root, lang). Roots match whatever their case; entries
    without a language say nothing."""
    found = as_of(files, lists, hours)
    root = F.lower(F.regexp_replace(F.regexp_replace("root", r"\\", "/"), "/+$", ""))
    named = lists.where("lang <> ''").select(F.col("staged_at").alias("s"), root.alias("folder"), "lang").groupBy("s", "folder").agg(F.min("lang").alias("lang"))
    parts = F.split(F.lower("file_path"), "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = found.where("staged_at is not null").select("file_path", "at", F.col("staged_at").alias("s"), F.explode(above).alias("folder"))
    best = each.join(named, ["s", "folder"]).groupBy("file_path", "at").agg(F.max_by("lang", F.length("folder")).alias("lang"))
    out = found.join(best.withColumnsRenamed({"file_path": "p", "at": "a"}), F.col("file_path").eqNullSafe(F.col("p")) & F.col("at").eqNullSafe(F.col("a")), "left")
    return out.select("file_path", "at", "staged_at", two_letter(F.col("lang")).alias("language"))
