"""Composition and health of the library (columns as in sources.adapters.MEDIA_FILES)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.media import insight_bucket
from framelake.functions.paths import like_escaped


def scanned(files: DataFrame) -> DataFrame:
    """Files that were ever probed: reports on the library are about these."""
    return files.where("last_scanned_at is not null")


def codecs(files: DataFrame) -> DataFrame:
    return scanned(files).where("codec <> ''").groupBy("codec").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes")).orderBy(F.desc("files"), "codec")


def resolutions(files: DataFrame) -> DataFrame:
    """Video files by width bucket; empty buckets and unknown widths have no row."""
    return scanned(files).where("kind = 'Video' and width > 0").groupBy(insight_bucket(F.col("width")).alias("bucket")).agg(F.count("*").alias("files"))


def statuses(files: DataFrame) -> DataFrame:
    return scanned(files).groupBy("status").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "status")


def totals(files: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return scanned(files).agg(F.count("*").alias("files"), F.count_if("is_hdr").alias("hdr"), F.count_if(F.col("kind") == "Video").alias("video"), F.count_if(F.col("kind") == "Music").alias("music"), total("file_size"), total("duration"))


def status_counts(files: DataFrame) -> DataFrame:
    """Files of each status and kind, with all files of the status beside them."""
    return files.groupBy("status", "kind").agg(F.count("*").alias("files"))


def health() -> dict[str, Column]:
    """Conditions of the health categories. An empty list of audio streams is a finding, an unknown one isn't."""
    found = {
        "no_audio": (F.col("kind") == "Video") & (F.col("audio_streams") == "[]"),
        "no_video": (F.col("kind") == "Video") & (F.col("codec") != "") & ((F.col("width") <= 0) | (F.col("height") <= 0)),
        "no_duration": (F.col("codec") != "") & (F.col("duration") <= 0),
        "failed": F.col("status") == "Failed",
        "verify_failed": F.col("last_verify_result").isNotNull() & ~F.col("last_verify_result").isin("ok", "missing"),
    }
    found = {k: F.coalesce(v, F.lit(False)) for k, v in found.items()}
    any_ = F.lit(False)
    for v in found.values():
        any_ = any_ | v
    return found | {"any": any_}


def health_summary(files: DataFrame) -> DataFrame:
    """Files of each category in one pass; categories overlap."""
    return scanned(files).agg(*[F.count_if(v).alias(k) for k, v in health().items()])


def health_page(files: DataFrame, category: str = "any", skip: int = 0, take: int = 50, search: str | None = None) -> DataFrame:
    """Findings, failed files first, then by path. Deep pages read as far as they reach."""
    rows = scanned(files).where(health()[category])
    if search:
        rows = rows.where(like_escaped(F.col("file_path"), search))
    return rows.orderBy(F.desc(F.col("status") == "Failed"), "file_path").offset(skip).limit(take).select("id", "file_path", "status", "failure_count")


def health_paths(files: DataFrame, category: str = "any", limit: int = 5000) -> DataFrame:
    return scanned(files).where(health()[category]).orderBy(F.desc(F.col("status") == "Failed"), "file_path").limit(limit).select("file_path")


def issues(files: DataFrame) -> DataFrame:
    """The names of each file's findings, in the order of the categories, for files that have any. Here a missing file
    counts as failed verification."""
    named = health()
    named["verify_failed"] = F.coalesce(F.col("last_verify_result").isNotNull() & (F.col("last_verify_result") != "ok"), F.lit(False))
    names = F.array_compact(F.array(*[F.when(v, F.lit(k.replace("_", "-"))) for k, v in named.items() if k != "any"]))
    return scanned(files).select("id", F.array_join(names, ",").alias("issues")).where("issues <> ''")


def verify_rotation(files: DataFrame, quota: int) -> DataFrame:
    """Files to verify next: scanned, neither queued nor running, never verified ones first."""
    rows = files.where("last_scanned_at is not null and status not in ('Queued', 'Processing')")
    return rows.orderBy(F.asc_nulls_first("last_verified_at"), "id").limit(quota).select("id", "file_path", "last_verified_at")


def hourly_quota(per_day: int) -> int:
    return max(1, per_day // 24)


def verify_stats(files: DataFrame) -> DataFrame:
    return scanned(files).agg(F.count("last_verified_at").alias("verified"), F.count_if(health()["verify_failed"]).alias("failed"), F.count("*").alias("total"))


def failed_files(files: DataFrame, limit: int = 100) -> DataFrame:
    return files.where("status = 'Failed'").orderBy(F.desc("failure_count"), "id").limit(limit).select("id", "file_path", "failure_count")


def directory_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("directory").agg(F.count("*").alias("files"), F.count_if(F.col("kind") == "Video").alias("video"), F.count_if(F.col("kind") == "Music").alias("music"))


def directory_page(files: DataFrame, directory: str, skip: int, take: int) -> DataFrame:
    """Files below a directory in order of their lower-case paths, 1 to 5000 at a time."""
    rows = files.where(F.col("file_path").startswith(directory.rstrip("/") + "/"))
    return rows.orderBy(F.lower("file_path"), "id").offset(skip).limit(min(5000, max(1, take))).select("id", "file_path", "kind")


def sample(files: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n files (or all), the same for the same seed: those of least hash."""
    return files.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), "id").limit(n)


def slim(files: DataFrame) -> DataFrame:
    """The columns that policies look at."""
    return files.select("id", "file_path", "file_name", "codec", "width", "height", "bitrate", "file_size", "duration", "pixel_format", "is_hdr", "is_4k", "status", "kind")


def by_path(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("file_path") == path).limit(1)


def by_remote_id(files: DataFrame, work_item_id: str) -> DataFrame:
    """The file of a work item on a node, or nothing."""
    return files.where(F.col("remote_work_item_id") == work_item_id).limit(1)


def by_id(files: DataFrame, id_: int) -> DataFrame:
    return files.where(F.col("id") == id_).limit(1)


def by_title(files: DataFrame, directory: str, base_name: str) -> DataFrame:
    return files.where((F.col("directory") == directory) & (F.col("base_name") == base_name))


def api_id(files: DataFrame) -> DataFrame:
    """Ids as other programs see them, and read back from there; foreign ids read as null."""
    out = F.concat(F.lit("mf-"), F.col("id").cast("string"))
    return files.select("id", out.alias("api_id"), F.regexp_extract(out, r"^mf-(\d+)$", 1).try_cast("long").alias("parsed"))
