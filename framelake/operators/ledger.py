"""Reports over the ledger of finished jobs (columns as in sources.adapters.ENCODE_HISTORY)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.session import matching

#: Order of rows that tie: unique in the ledger, so that limits are deterministic.
TIE = ("job_key", "line_no", "part_key", "node_key", "original_size_bytes", "completed_at")
#: What a ledger can be laid out by.
UNITS = ("day", "month")


def of_kind(ledger: DataFrame, kind: str | None) -> DataFrame:
    """Rows of a kind; a blank or unknown kind filters nothing."""
    name = (kind or "").strip().capitalize()
    return ledger.where(F.col("kind") == name) if name in ("Video", "Music") else ledger


def trailing(ledger: DataFrame, days: int, now: str) -> DataFrame:
    """Rows from the first of the last `days` UTC days on; there is no upper bound. 1 to 365 days. Of a ledger laid out
    by day or month (`by_period`) only those are read."""
    days = min(365, max(1, days))
    first = F.date_sub(F.to_date(F.lit(now)), days - 1)
    rows = ledger
    for unit in UNITS:
        if unit in ledger.columns:
            rows = rows.where(F.col(unit) >= F.trunc(first, unit) if unit == "month" else F.col(unit) >= first)
    return rows.where(F.col("completed_at") >= first)


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)


def append_row(rows: DataFrame) -> DataFrame:
    """What is appended: savings never negative, a device and an outcome always named."""
    named = lambda c, other: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", other).otherwise(F.col(c)).alias(c)
    changed = {"bytes_saved": F.greatest(F.col("bytes_saved"), F.lit(0)).alias("bytes_saved"), "device_id": named("device_id", "unknown"), "outcome": named("outcome", "Completed")}
    return rows.select(*[changed.get(c, F.col(c)) for c in rows.columns])


def add_by_period(rows: DataFrame, folder: str, unit: str = "day") -> int:
    """Adds finished jobs to the ledger in a folder, which is laid out by UTC day, or by month where jobs are few, and
    returns how many of these that wrote.

    Late jobs go to their own day, as a batch beside those that are there; of jobs that are there already, by TIE,
    `by_period` reads those of the newest batch, so adding the same ones again changes nothing. Jobs are written once,
    and days without new jobs aren't touched."""
    spark = rows.sparkSession
    day = F.to_date("completed_at")
    number = 1 + max((int(n.removeprefix("batch=")) for n in matching(spark, f"{folder}/{unit}=*/batch=*")), default=-1)
    new = rows.withColumns({unit: F.trunc(day, "month") if unit == "month" else day, "batch": F.lit(number)})
    new.repartition(unit).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(unit, "batch").parquet(folder)
    return len(matching(spark, f"{folder}/{unit}=*/batch={number}"))


def by_period(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger in a folder, with the column day or month that it is laid out by. Batches of a day are told apart by
    the jobs' keys, so a filter on the day or the time is one on what is read."""
    rows = spark.read.parquet(folder)
    key = Window.partitionBy(*[u for u in UNITS if u in rows.columns], *TIE)
    return rows.withColumn("newest", F.max("batch").over(key)).where("batch = newest").drop("batch", "newest")


def job_row(jobs: DataFrame, kilo: int = 1000, always_keep: bool = False) -> DataFrame:
    """Ledger measures of a finished job: no savings if nothing was written, or not less than the source unless outputs
    are always kept; whole kbps. Remote jobs of old rows were counted with a kilo of 1024."""
    none = (F.col("encoded_size_bytes") == 0) | (F.lit(not always_keep) & (F.col("encoded_size_bytes") >= F.col("original_size_bytes")))
    kbps = lambda size: F.coalesce(F.when(F.col("duration_seconds") > 0, (F.col(size) * 8 / kilo / F.col("duration_seconds")).cast("long")), F.lit(0).cast("long"))
    return jobs.select(
        *TIE,
        none.alias("no_savings"),
        F.when(none, 0).otherwise(F.greatest(F.lit(0), F.col("original_size_bytes") - F.col("encoded_size_bytes"))).cast("long").alias("saved"),
        kbps("original_size_bytes").alias("original_kbps"),
        F.when(none, 0).otherwise(kbps("encoded_size_bytes")).cast("long").alias("encoded_kbps"),
    )


def summary(ledger: DataFrame) -> DataFrame:
    """Lifetime totals; zeros for an empty ledger."""
    return ledger.agg(
        F.count("*").alias("jobs"),
        F.count_if(F.col("kind") == "Video").alias("video_jobs"),
        F.count_if(F.col("kind") == "Music").alias("music_jobs"),
        F.count_if(F.col("is_4k")).alias("four_k_jobs"),
        F.count_if(F.col("outcome") == "NoSavings").alias("no_savings_jobs"),
        *[_total(c) for c in ("original_size_bytes", "encoded_size_bytes", "bytes_saved", "encode_seconds")],
    )


def savings_over_time(ledger: DataFrame, days: int, now: str) -> DataFrame:
    """One row for each of the last `days` UTC days, with zeros where no job finished. Later days have no row."""
    by_day = trailing(ledger, days, now).groupBy(F.to_date("completed_at").alias("day")).agg(F.count("*").alias("jobs"), *[F.sum(c).alias(c) for c in ("bytes_saved", "original_size_bytes", "encode_seconds")])
    last = F.to_date(F.lit(now))
    calendar = ledger.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, min(365, max(1, days)) - 1), last)).alias("day"))
    filled = F.broadcast(calendar).join(by_day, "day", "left")  # a calendar of 365 rows at most
    return filled.select("day", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("jobs", "bytes_saved", "original_size_bytes", "encode_seconds")])


def device_utilization(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("device_id").agg(F.count("*").alias("jobs"), *[F.sum(c).alias(c) for c in ("encode_seconds", "duration_seconds", "bytes_saved", "original_size_bytes")]).orderBy(F.desc("encode_seconds"), "device_id")


def codec_mix(ledger: DataFrame) -> DataFrame:
    """Jobs of each codec. The empty codec is called unknown after grouping, so it stays apart from a real `unknown`."""
    grouped = ledger.groupBy("encoded_codec").agg(F.count("*").alias("jobs"), F.sum("bytes_saved").alias("bytes_saved"))
    return grouped.select(F.when(F.col("encoded_codec") == "", "unknown").otherwise(F.col("encoded_codec")).alias("codec"), "jobs", "bytes_saved").orderBy(F.desc("jobs"), "codec")


def node_throughput(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("node_hostname").agg(F.min("node_id").alias("node_id"), F.count("*").alias("jobs"), *[F.sum(c).alias(c) for c in ("bytes_saved", "encode_seconds")], F.count_if("was_remote").alias("remote_jobs")).orderBy(F.desc("jobs"), "node_hostname")


def recent(ledger: DataFrame, limit: int = 25) -> DataFrame:
    return ledger.orderBy(F.desc("completed_at"), *TIE).limit(min(200, max(1, limit)))


def top_savings(ledger: DataFrame, now: str, limit: int = 10, days: int = 365) -> DataFrame:
    rows = trailing(ledger, days, now).where("outcome = 'Completed'")
    return rows.orderBy(F.desc("bytes_saved"), *TIE).limit(min(100, max(1, limit)))


def labelled(ledger: DataFrame) -> DataFrame:
    """The columns of jobs that ran under a named profile."""
    return ledger.where("profile_name is not null").select("profile_name", "profile_id", "original_size_bytes", "encoded_size_bytes", "bytes_saved", "duration_seconds", "completed_at", *[c for c in TIE if c in ("job_key", "line_no", "part_key", "node_key")])


def measured_profiles(ledger: DataFrame) -> DataFrame:
    """Results of each profile name: kept jobs only count for sizes and kbps; the id is that of the latest job."""
    kept = F.col("encoded_size_bytes") > 0
    size, seconds = F.sum(F.when(kept, F.col("encoded_size_bytes"))), F.sum(F.when(kept, F.col("duration_seconds")))
    rows = labelled(ledger).groupBy("profile_name").agg(
        F.max_by("profile_id", F.struct("completed_at", "job_key", "line_no", "part_key", "node_key", "original_size_bytes")).alias("profile_id"),
        F.count("*").alias("jobs"),
        F.count_if(kept).alias("kept"),
        F.count_if(~kept).alias("discarded"),
        F.coalesce(F.sum(F.when(kept, F.col("original_size_bytes"))), F.lit(0)).alias("original_size_bytes"),
        F.coalesce(size, F.lit(0)).alias("encoded_size_bytes"),
        F.coalesce(F.sum(F.when(kept, F.col("bytes_saved"))), F.lit(0)).alias("bytes_saved"),
        F.coalesce(F.when(seconds > 0, (size * 8 / 1000 / seconds).cast("long")), F.lit(0)).alias("kbps"),
    )
    return rows.orderBy(F.desc("jobs"), F.lower("profile_name"))


def workload_shares(ledger: DataFrame) -> DataFrame:
    """Each device's share of all encode seconds and of the largest, in whole percent. The totals come from a few
    grouped rows, joined back, so no task sees the ledger whole."""
    by = ledger.groupBy("device_id").agg(F.sum("encode_seconds").alias("encode_seconds"))
    totals = by.agg(F.greatest(F.sum("encode_seconds"), F.lit(1)).alias("total"), F.greatest(F.max("encode_seconds"), F.lit(1)).alias("most"))
    percent = lambda of: F.floor(F.col("encode_seconds") * 100 / F.col(of)).cast("long")
    return by.crossJoin(F.broadcast(totals)).select("device_id", "encode_seconds", percent("total").alias("share"), percent("most").alias("of_most"))  # one row of totals


def savings_ratio(ledger: DataFrame) -> DataFrame:
    """Saved percent of all bytes (0 at least) and the multiple of real time, to hundredths."""
    s = ledger.agg(F.sum("bytes_saved").alias("saved"), F.sum("original_size_bytes").alias("original"), F.sum("duration_seconds").alias("played"), F.sum("encode_seconds").alias("spent"))
    ratio = lambda a, b, scale: F.coalesce(F.when(F.col(b) > 0, F.floor(F.col(a) * scale / F.col(b) + 0.5).cast("long")), F.lit(0).cast("long"))
    return s.select(F.greatest(F.lit(0).cast("long"), ratio("saved", "original", 100)).alias("saved_percent"), ratio("played", "spent", 100).alias("realtime_hundredths"))


def outcome_pies(ledger: DataFrame, drop_zero: bool = False) -> DataFrame:
    """Segments (pie, name, value): outcomes, kinds, and 4K against other video; zero segments stay or go."""
    c = ledger.agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "NoSavings").alias("none"), F.count_if(F.col("kind") == "Video").alias("video"), F.count_if(F.col("kind") == "Music").alias("music"), F.count_if(F.col("is_4k") & (F.col("kind") == "Video")).alias("wide"))
    zero = F.lit(0).cast("long")
    segment = lambda pie, name, value: F.struct(F.lit(pie).alias("pie"), F.lit(name).alias("name"), value.alias("value"))
    rows = c.select(F.explode(F.array(segment("status", "success", F.greatest(zero, F.col("total") - F.col("none"))), segment("status", "noSavings", F.col("none")), segment("status", "error", zero), segment("kind", "video", F.col("video")), segment("kind", "music", F.col("music")), segment("resolution", "4K", F.col("wide")), segment("resolution", "other", F.greatest(zero, F.col("video") - F.col("wide"))))).alias("s")).select("s.*")
    return rows.where("value > 0") if drop_zero else rows


def codec_pies(ledger: DataFrame) -> DataFrame:
    """Segments (pie, name, value): codecs of video and of music that were made, `unknown` for an empty name."""
    pie = F.when(F.col("kind") == "Video", "video").otherwise("audio").alias("pie")
    name = F.when(F.coalesce("encoded_codec", F.lit("")) == "", "unknown").otherwise(F.col("encoded_codec"))
    return ledger.groupBy(pie, name.alias("name")).agg(F.count("*").alias("value"))


def size_difference(ledger: DataFrame) -> DataFrame:
    """Thousandths of the 10^9 bytes that all jobs saved."""
    return ledger.agg(F.floor(F.coalesce(F.sum("bytes_saved"), F.lit(0)) / 1_000_000).cast("long").alias("size_diff_thousandths"))
