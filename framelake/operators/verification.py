"""A pass of the rolling verification, which stops where storage seems to be gone.

Files are looked at in the order of the rotation. One that isn't there is marked as missing, unless something worse is
known of it; the fifth in a row that isn't there ends the pass, and neither it nor what comes after is marked. Where that
is depends on the order of all files, yet no task sees them all: files are dealt to ranges of the rotation, each range
tells how many are missing at its start and at its end and where its own first five in a row are, and these few rows,
one for each range, say where the pass ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.session import written

#: Missing files in a row that end a pass.
MISSING = 5


def ends_at(ranges: list[tuple[int, int, int, int, int | None]], most: int = MISSING) -> tuple[int, int] | None:
    """The range and the place in it of the file that ends the pass, from (range, files, missing at its start, missing at
    its end, place of the first `most`-th missing file in a row) in order; None if none does."""
    before = 0
    for number, files, start, end, inner in ranges:
        if before + start >= most:
            return number, most - before
        if inner is not None:
            return number, inner
        before = before + files if start == files else end
    return None


def verified(candidates: DataFrame, ranges: int | None = None, most: int = MISSING) -> DataFrame:
    """(id, last_verify_result) of the files that a pass marks. Candidates are (id, last_verified_at, last_verify_result,
    here: whether the file is there, found: what its verification says, null where it isn't there); ids differ."""
    spark = candidates.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("last_verified_at"), F.asc("id")]
    dealt = candidates.select("id", "last_verified_at", "last_verify_result", F.coalesce("here", F.lit(False)).alias("here"), "found").repartitionByRange(ranges, *order)
    in_range = Window.partitionBy("range").orderBy(*order)
    rows = dealt.withColumn("range", F.spark_partition_id()).withColumn("at", F.row_number().over(in_range))
    # how many are missing in a row up to each file
    last = F.coalesce(F.max(F.when(F.col("here"), F.col("at"))).over(in_range.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    rows = written(rows.withColumn("gone", F.col("at") - last).select("id", "last_verify_result", "here", "found", "range", "at", "gone"), "verification")
    told = rows.groupBy("range").agg(
        F.count("*").alias("files"),
        F.coalesce(F.min(F.when(F.col("here"), F.col("at"))) - 1, F.count("*")).alias("start"),
        F.max_by("gone", "at").alias("end"),
        F.min(F.when(F.col("gone") >= most, F.col("at"))).alias("inner"),
    )
    end = ends_at([tuple(r) for r in told.orderBy("range").collect()], most)  # one row for each range
    if end:
        rows = rows.where((F.col("range") < end[0]) | ((F.col("range") == end[0]) & (F.col("at") < end[1])))
    known = F.when(F.col("last_verify_result") != "ok", F.col("last_verify_result"))
    return rows.select("id", F.when(F.col("here"), F.col("found")).otherwise(F.coalesce(known, F.lit("missing"))).alias("last_verify_result"))


