"""The library's queries over the tables at hand, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import codec as C
from framelake.functions import language as L
from framelake.functions import media as M
from framelake.functions import ocr
from framelake.functions import paths as P
from framelake.functions import schedule as S
from framelake.functions import text as X
from framelake.functions import titles as T
from framelake.operators import decision as D
from framelake.operators import ledger, library, placement, queue, scan
from framelake.operators import streams as A
from framelake.plans import policy as PO
from framelake.sources import files as FS
from framelake.sources.adapters import NOW, oracle, table, view
from framelake.streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return add


def _from(operator, *views: str, **options) -> Query:
    """A query that applies an operator to views."""
    return lambda spark, d: operator(*[view(spark, d, v) for v in views], **options)


_DAY = f"CAST('{NOW}' AS TIMESTAMP)"
_TIE = "job_key, line_no, part_key, node_key, original_size_bytes, completed_at"

# ledger

query(
    "ledger_summary",
    """SELECT count(*) AS jobs, count(*) FILTER (kind = 'Video') AS video_jobs, count(*) FILTER (kind = 'Music') AS music_jobs, count(*) FILTER (is_4k) AS four_k_jobs,
count(*) FILTER (outcome = 'NoSavings') AS no_savings_jobs, CAST(coalesce(sum(original_size_bytes), 0) AS BIGINT) AS original_size_bytes, CAST(coalesce(sum(encoded_size_bytes), 0) AS BIGINT) AS encoded_size_bytes,
CAST(coalesce(sum(bytes_saved), 0) AS BIGINT) AS bytes_saved, CAST(coalesce(sum(encode_seconds), 0) AS BIGINT) AS encode_seconds FROM encode_history""",
)(_from(ledger.summary, "encode_history"))

query(
    "savings_over_time",
    f"""SELECT CAST(g.d AS DATE) AS day, CAST(count(h.job_key) AS BIGINT) AS jobs, CAST(coalesce(sum(bytes_saved), 0) AS BIGINT) AS bytes_saved, CAST(coalesce(sum(original_size_bytes), 0) AS BIGINT) AS original_size_bytes, CAST(coalesce(sum(encode_seconds), 0) AS BIGINT) AS encode_seconds
FROM (SELECT unnest(generate_series(CAST({_DAY} AS DATE) - INTERVAL '29' DAY, CAST(CAST({_DAY} AS DATE) AS TIMESTAMP), INTERVAL '1' DAY)) AS d) g LEFT JOIN encode_history h ON CAST(h.completed_at AS DATE) = CAST(g.d AS DATE) GROUP BY 1""",
)(_from(ledger.savings_over_time, "encode_history", days=30, now=NOW))

query("savings_over_time_video", f"""SELECT CAST(g.d AS DATE) AS day, CAST(count(h.job_key) AS BIGINT) AS jobs, CAST(coalesce(sum(bytes_saved), 0) AS BIGINT) AS bytes_saved, CAST(coalesce(sum(original_size_bytes), 0) AS BIGINT) AS original_size_bytes, CAST(coalesce(sum(encode_seconds), 0) AS BIGINT) AS encode_seconds
FROM (SELECT unnest(generate_series(CAST('1998-01-02' AS TIMESTAMP), CAST('1998-04-01' AS TIMESTAMP), INTERVAL '1' DAY)) AS d) g LEFT JOIN (SELECT * FROM encode_history WHERE kind = 'Video') h ON CAST(h.completed_at AS DATE) = CAST(g.d AS DATE) GROUP BY 1""")(
    lambda s, d: ledger.savings_over_time(ledger.of_kind(view(s, d, "encode_history"), "video"), 90, "1998-04-01 08:00:00")
)

query("device_utilization", "SELECT device_id, count(*) AS jobs, CAST(sum(encode_seconds) AS BIGINT) AS encode_seconds, CAST(sum(duration_seconds) AS BIGINT) AS duration_seconds, CAST(sum(bytes_saved) AS BIGINT) AS bytes_saved, CAST(sum(original_size_bytes) AS BIGINT) AS original_size_bytes FROM encode_history GROUP BY 1")(_from(ledger.device_utilization, "encode_history"))
query("codec_mix", "SELECT CASE WHEN encoded_codec = '' THEN 'unknown' ELSE encoded_codec END AS codec, count(*) AS jobs, CAST(sum(bytes_saved) AS BIGINT) AS bytes_saved FROM encode_history GROUP BY encoded_codec")(_from(ledger.codec_mix, "encode_history"))
query("node_throughput", "SELECT node_hostname, min(node_id) AS node_id, count(*) AS jobs, CAST(sum(bytes_saved) AS BIGINT) AS bytes_saved, CAST(sum(encode_seconds) AS BIGINT) AS encode_seconds, count(*) FILTER (was_remote) AS remote_jobs FROM encode_history GROUP BY 1")(_from(ledger.node_throughput, "encode_history"))
query("recent_encodes", f"SELECT job_key, line_no, part_key, node_key, bytes_saved, completed_at FROM encode_history ORDER BY completed_at DESC, {_TIE} LIMIT 25")(
    lambda s, d: ledger.recent(view(s, d, "encode_history")).select("job_key", "line_no", "part_key", "node_key", "bytes_saved", "completed_at")
)
query("top_savings", f"SELECT job_key, line_no, part_key, node_key, bytes_saved, completed_at FROM encode_history WHERE outcome = 'Completed' AND completed_at >= CAST({_DAY} AS DATE) - INTERVAL '364' DAY ORDER BY bytes_saved DESC, {_TIE} LIMIT 10")(
    lambda s, d: ledger.top_savings(view(s, d, "encode_history"), NOW).select("job_key", "line_no", "part_key", "node_key", "bytes_saved", "completed_at")
)
query(
    "measured_profiles",
    """SELECT profile_name, arg_max(profile_id, (completed_at, job_key, line_no, part_key, node_key, original_size_bytes)) AS profile_id, count(*) AS jobs, count(*) FILTER (encoded_size_bytes > 0) AS kept, count(*) FILTER (encoded_size_bytes <= 0) AS discarded,
CAST(coalesce(sum(original_size_bytes) FILTER (encoded_size_bytes > 0), 0) AS BIGINT) AS original_size_bytes, CAST(coalesce(sum(encoded_size_bytes) FILTER (encoded_size_bytes > 0), 0) AS BIGINT) AS encoded_size_bytes, CAST(coalesce(sum(bytes_saved) FILTER (encoded_size_bytes > 0), 0) AS BIGINT) AS bytes_saved,
CAST(floor(sum(encoded_size_bytes) FILTER (encoded_size_bytes > 0) * 8 / 1000 / sum(duration_seconds) FILTER (encoded_size_bytes > 0)) AS BIGINT) AS kbps FROM encode_history WHERE profile_name IS NOT NULL GROUP BY 1""",
)(_from(ledger.measured_profiles, "encode_history"))
query("workload_shares", "SELECT device_id, CAST(s AS BIGINT) AS encode_seconds, CAST(floor(s * 100 / greatest(sum(s) OVER (), 1)) AS BIGINT) AS share, CAST(floor(s * 100 / greatest(max(s) OVER (), 1)) AS BIGINT) AS of_most FROM (SELECT device_id, sum(encode_seconds) AS s FROM encode_history GROUP BY 1)")(_from(ledger.workload_shares, "encode_history"))
query("savings_ratio", "SELECT greatest(0, CAST(floor(sum(bytes_saved) * 100 / sum(original_size_bytes) + 0.5) AS BIGINT)) AS saved_percent, CAST(floor(sum(duration_seconds) * 100 / sum(encode_seconds) + 0.5) AS BIGINT) AS realtime_hundredths FROM encode_history")(_from(ledger.savings_ratio, "encode_history"))
query("job_rows", """SELECT job_key, line_no, part_key, node_key, original_size_bytes, completed_at, n AS no_savings, CASE WHEN n THEN 0 ELSE original_size_bytes - encoded_size_bytes END AS saved, CASE WHEN duration_seconds > 0 THEN CAST(floor(original_size_bytes * 8 / 1000 / duration_seconds) AS BIGINT) ELSE 0 END AS original_kbps,
CASE WHEN n OR duration_seconds <= 0 THEN 0 ELSE CAST(floor(encoded_size_bytes * 8 / 1000 / duration_seconds) AS BIGINT) END AS encoded_kbps FROM (SELECT *, encoded_size_bytes = 0 OR encoded_size_bytes >= original_size_bytes AS n FROM encode_history)""")(_from(ledger.job_row, "encode_history"))
_PIES = """SELECT * FROM (SELECT 'status' AS pie, 'success' AS name, CAST(greatest(0, count(*) - count(*) FILTER (outcome = 'NoSavings')) AS BIGINT) AS value FROM encode_history UNION ALL SELECT 'status', 'noSavings', count(*) FILTER (outcome = 'NoSavings') FROM encode_history UNION ALL SELECT 'status', 'error', 0
UNION ALL SELECT 'kind', 'video', count(*) FILTER (kind = 'Video') FROM encode_history UNION ALL SELECT 'kind', 'music', count(*) FILTER (kind = 'Music') FROM encode_history UNION ALL SELECT 'resolution', '4K', count(*) FILTER (is_4k AND kind = 'Video') FROM encode_history UNION ALL SELECT 'resolution', 'other', count(*) FILTER (NOT is_4k AND kind = 'Video') FROM encode_history)"""
query("status_pies", _PIES)(_from(ledger.outcome_pies, "encode_history"))
query("compatible_pies", _PIES + " WHERE value > 0")(_from(ledger.outcome_pies, "encode_history", drop_zero=True))
query("ledger_append", "SELECT job_key, line_no, part_key, node_key, greatest(bytes_saved, 0) AS bytes_saved, CASE WHEN trim(device_id) = '' THEN 'unknown' ELSE device_id END AS device_id, outcome FROM encode_history")(
    lambda s, d: ledger.append_row(view(s, d, "encode_history").select("job_key", "line_no", "part_key", "node_key", "bytes_saved", "device_id", "outcome"))
)

# library

query("library_codecs", "SELECT codec, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM media_files WHERE codec <> '' AND last_scanned_at IS NOT NULL GROUP BY 1")(_from(library.codecs, "media_files"))
query("library_resolutions", "SELECT CASE WHEN width > 1920 THEN '4K' WHEN width > 1280 THEN '1080p' WHEN width > 960 THEN '720p' ELSE 'SD' END AS bucket, count(*) AS files FROM media_files WHERE kind = 'Video' AND width > 0 AND last_scanned_at IS NOT NULL GROUP BY 1")(_from(library.resolutions, "media_files"))
query("library_statuses", "SELECT status, count(*) AS files FROM media_files WHERE last_scanned_at IS NOT NULL GROUP BY 1")(_from(library.statuses, "media_files"))
query("library_status_kinds", "SELECT status, kind, count(*) AS files FROM media_files GROUP BY 1, 2")(_from(library.status_counts, "media_files"))
query("library_totals", "SELECT count(*) AS files, count(*) FILTER (is_hdr) AS hdr, count(*) FILTER (kind = 'Video') AS video, count(*) FILTER (kind = 'Music') AS music, CAST(sum(file_size) AS BIGINT) AS file_size, CAST(sum(duration) AS BIGINT) AS duration FROM media_files WHERE last_scanned_at IS NOT NULL")(_from(library.totals, "media_files"))
_HEALTH = """SELECT id, file_path, status, failure_count, kind = 'Video' AND coalesce(audio_streams = '[]', FALSE) AS no_audio, kind = 'Video' AND codec <> '' AND (width <= 0 OR height <= 0) AS no_video, codec <> '' AND duration <= 0 AS no_duration, status = 'Failed' AS failed,
last_verify_result IS NOT NULL AND last_verify_result NOT IN ('ok', 'missing') AS verify_failed, last_verify_result IS NOT NULL AND last_verify_result <> 'ok' AS not_ok FROM media_files WHERE last_scanned_at IS NOT NULL"""
_ANY = "(no_audio OR no_video OR no_duration OR failed OR verify_failed)"
query("health_summary", f'SELECT count(*) FILTER (no_audio) AS no_audio, count(*) FILTER (no_video) AS no_video, count(*) FILTER (no_duration) AS no_duration, count(*) FILTER (failed) AS failed, count(*) FILTER (verify_failed) AS verify_failed, count(*) FILTER ({_ANY}) AS "any" FROM ({_HEALTH})')(_from(library.health_summary, "media_files"))
query("health_page", f"SELECT id, file_path, status, failure_count FROM ({_HEALTH}) WHERE {_ANY} ORDER BY status = 'Failed' DESC, file_path LIMIT 50 OFFSET 25")(_from(library.health_page, "media_files", skip=25))
query("health_search", f"SELECT id, file_path, status, failure_count FROM ({_HEALTH}) WHERE failed AND file_path ILIKE '%N_TION\\_7/%' ESCAPE '\\' AND contains(lower(file_path), 'nation_7/') ORDER BY file_path LIMIT 50")(_from(library.health_page, "media_files", category="failed", search="NATION_7/"))
query("health_paths", f"SELECT file_path FROM ({_HEALTH}) WHERE verify_failed ORDER BY status = 'Failed' DESC, file_path LIMIT 5000")(_from(library.health_paths, "media_files", category="verify_failed"))
query("health_issues", f"""SELECT id, concat_ws(',', CASE WHEN no_audio THEN 'no-audio' END, CASE WHEN no_video THEN 'no-video' END, CASE WHEN no_duration THEN 'no-duration' END, CASE WHEN failed THEN 'failed' END, CASE WHEN not_ok THEN 'verify-failed' END) AS issues FROM ({_HEALTH})
WHERE no_audio OR no_video OR no_duration OR failed OR not_ok""")(_from(library.issues, "media_files"))
query("verify_rotation", "SELECT id, file_path, last_verified_at FROM media_files WHERE last_scanned_at IS NOT NULL AND status NOT IN ('Queued', 'Processing') ORDER BY last_verified_at ASC NULLS FIRST, id LIMIT 41")(_from(library.verify_rotation, "media_files", quota=library.hourly_quota(1000)))
query("verify_stats", f"SELECT (SELECT count(last_verified_at) FROM media_files WHERE last_scanned_at IS NOT NULL) AS verified, (SELECT count(*) FROM ({_HEALTH}) WHERE verify_failed) AS failed, (SELECT count(*) FROM media_files WHERE last_scanned_at IS NOT NULL) AS total")(_from(library.verify_stats, "media_files"))
query("failed_files", "SELECT id, file_path, failure_count FROM media_files WHERE status = 'Failed' ORDER BY failure_count DESC, id LIMIT 100")(_from(library.failed_files, "media_files"))
query("directory_totals", "SELECT directory, count(*) AS files, count(*) FILTER (kind = 'Video') AS video, count(*) FILTER (kind = 'Music') AS music FROM media_files GROUP BY 1")(_from(library.directory_totals, "media_files"))
query("directory_page", "SELECT id, file_path, kind FROM media_files WHERE starts_with(file_path, '/media/asia/') ORDER BY lower(file_path), id LIMIT 100 OFFSET 20")(_from(library.directory_page, "media_files", directory="/media/asia", skip=20, take=100))
query("api_ids", "SELECT id, concat('mf-', CAST(id AS VARCHAR)) AS api_id, id AS parsed FROM media_files")(_from(library.api_id, "media_files"))
query("random_sample", "SELECT * FROM media_files ORDER BY md5(concat(CAST(id AS VARCHAR), ':0')), id LIMIT 100")(_from(library.sample, "media_files", n=100))

# queue

_QUEUED = "media_files WHERE status = 'Queued' AND assigned_node_id IS NULL"
query("queue_page", f"SELECT id, file_path, priority, bitrate, created_at FROM {_QUEUED} ORDER BY priority DESC, bitrate DESC, id LIMIT 30 OFFSET 10")(_from(queue.page, "media_files", skip=10, take=30))
query("queue_newest", f"SELECT id, file_path, priority, bitrate, created_at FROM {_QUEUED} ORDER BY priority DESC, created_at DESC, id LIMIT 30")(_from(queue.page, "media_files", skip=0, take=30, newest=True))
query("queue_total", f"SELECT count(*) AS total FROM {_QUEUED} AND kind = 'Video'")(_from(queue.total, "media_files", kind="Video"))
query("queue_window", f"""SELECT id, file_path, kind, priority, bitrate FROM (SELECT *, CASE WHEN mw > mh THEN 'Music' WHEN vw > vh THEN 'Video' END AS short, CASE WHEN mw > mh THEN mw WHEN vw > vh THEN vw ELSE 0 END AS want FROM (SELECT *, count(*) FILTER (kind = 'Music' AND rn <= 50) OVER () AS mh, least(8, count(*) FILTER (kind = 'Music') OVER ()) AS mw,
count(*) FILTER (kind = 'Video' AND rn <= 50) OVER () AS vh, least(8, count(*) FILTER (kind = 'Video') OVER ()) AS vw FROM (SELECT *, row_number() OVER (ORDER BY priority DESC, bitrate DESC, id) AS rn, row_number() OVER (PARTITION BY kind ORDER BY priority DESC, bitrate DESC, id) AS kn FROM {_QUEUED})))
WHERE (rn <= 50 AND (short IS NULL OR kind = short OR rn <= 50 - want)) OR (kind = short AND kn <= 8)""")(_from(queue.window, "media_files"))
query("queue_rotation", f"SELECT id, file_path FROM {_QUEUED} ORDER BY priority DESC, bitrate DESC, id LIMIT 50 OFFSET 50")(_from(queue.rotated, "media_files", turn=1))
query("queue_excluding_active", f"SELECT id, file_path, priority, bitrate FROM {_QUEUED} AND lower(file_path) NOT IN (SELECT lower(file_path) FROM media_files WHERE id % 3 = 0) ORDER BY priority DESC, bitrate DESC, id LIMIT 40 OFFSET 5")(
    lambda s, d: (lambda m: queue.excluding(m, m.where("id % 3 = 0").select(F.upper("file_path").alias("path")), 5, 40))(view(s, d, "media_files"))
)
query("queue_counts", "SELECT count(*) FILTER (status = 'Queued' AND assigned_node_id IS NULL) AS pending, count(*) FILTER (status = 'Processing') AS running, count(*) FILTER (status IN ('Completed', 'Failed', 'Skipped')) AS finished FROM media_files")(_from(queue.item_counts, "media_files"))
_SEGMENTS = "SELECT id, file_path, status, {} AS rank, {} AS segment FROM media_files WHERE {}"


_WHOLE = f"""SELECT * FROM ({_SEGMENTS.format('-bitrate', 0, "status = 'Processing'")} UNION ALL {_SEGMENTS.format('-bitrate', 1, "status = 'Queued' AND assigned_node_id IS NULL")} UNION ALL
{_SEGMENTS.format("CASE status WHEN 'Completed' THEN 0 WHEN 'Failed' THEN 2 ELSE 4 END", 2, "status IN ('Failed', 'Completed')")}) ORDER BY segment, rank, id LIMIT 60 OFFSET 15"""


@query("queue_segments_all", _WHOLE)
@query("queue_segments", _WHOLE)
def _segments(spark, d):
    m = view(spark, d, "media_files")
    columns = ("id", "file_path", "status")
    active = m.where("status = 'Processing'").select(*columns, (-F.col("bitrate")).alias("rank"))
    pending = queue.queued(m).select(*columns, (-F.col("bitrate")).alias("rank"))
    done = m.where("status in ('Failed', 'Completed')").select(*columns, queue.terminal_rank().cast("long").alias("rank"))
    return queue.segments(active, pending, done, 15, 60).withColumn("segment", F.col("segment").cast("int"))


query("bump_priority", "SELECT id, CASE WHEN id = (SELECT min(id) FROM media_files WHERE status = 'Queued') THEN (SELECT coalesce(max(priority), 0) + 1 FROM media_files WHERE status = 'Queued') ELSE priority END AS priority FROM media_files")(
    lambda s, d: (lambda m: queue.bump(m, m.where("status = 'Queued'").agg(F.min("id").alias("id"))).select("id", "priority"))(view(s, d, "media_files"))
)
query("evicted_items", "SELECT id, finished_at FROM (SELECT id, coalesce(last_scanned_at, created_at) AS finished_at, row_number() OVER (ORDER BY coalesce(last_scanned_at, created_at) DESC, id DESC) AS rn FROM media_files WHERE status IN ('Completed', 'Failed')) WHERE rn > 100")(_from(queue.evicted, "media_files", keep=100))

# policy

POLICY = PO.Policy(
    rules=(
        PO.Rule("r1", "Keep AV1", (PO.Condition("codec", "is", ("AV01",)),), "skip"),
        PO.Rule("r2", "4K HEVC", (PO.Condition("codec", "in", ("x265", "hevc")), PO.Condition("is_4k", "is", ("true",))), "transcode_with_profile", "p1"),
        PO.Rule("r3", "Tall or deep", (PO.Condition("resolution_class", "in", ("1440p", "2160p+")), PO.Condition("bit_depth", "greater_than", ("10",))), "transcode_with_profile", "p2", match="any"),
        PO.Rule("r4", "Off", (PO.Condition("width", "is_known"),), "skip", enabled=False),
        PO.Rule("r5", "Small", (PO.Condition("bitrate_kbps", "between", ("2000", "500")), PO.Condition("codec", "is_not", ("h264",))), "mux_only"),
        PO.Rule("r6", "Nameless", (PO.Condition("codec", "is_unknown"),), "transcode_with_profile", "gone"),
    ),
    profiles=(PO.Profile("p1", "AV1 small", "av1", "bitrate", 3500), PO.Profile("p2", "HEVC quality", "h265")),
)
_PLAN = """SELECT *, CASE rule_id WHEN 'r1' THEN 'action:skip' WHEN 'r2' THEN 'profile:p1' WHEN 'r3' THEN 'profile:p2' WHEN 'r5' THEN 'action:mux_only' WHEN 'r6' THEN 'blocked:profile missing' ELSE 'action:use_simple' END AS bucket FROM (
SELECT m.*, CASE WHEN codec = 'av1' THEN 'r1' WHEN codec = 'hevc' AND is_4k THEN 'r2'
 WHEN (width > 0 AND height > 0 AND least(width, height) >= 1440) OR pixel_format = 'gray12be' THEN 'r3'
 WHEN bitrate BETWEEN 500 AND 2000 AND codec NOT IN ('', 'h264') THEN 'r5' WHEN codec = '' THEN 'r6' END AS rule_id FROM media_files m)"""
_NAMES = "CASE rule_id WHEN 'r1' THEN 'Keep AV1' WHEN 'r2' THEN '4K HEVC' WHEN 'r3' THEN 'Tall or deep' WHEN 'r5' THEN 'Small' WHEN 'r6' THEN 'Nameless' END"


def _planned(spark: SparkSession, d: str) -> DataFrame:
    return PO.assign(view(spark, d, "media_files"), POLICY)


query("policy_assign", f"SELECT id, rule_id, bucket FROM ({_PLAN})")(lambda s, d: _planned(s, d).select("id", F.col("plan.rule_id").alias("rule_id"), PO.bucket_key().alias("bucket")))
query("rule_match", "SELECT id, codec = 'av1' AS r1, codec = 'hevc' AND is_4k AS r2, (width > 0 AND height > 0 AND least(width, height) >= 1440) OR coalesce(pixel_format = 'gray12be', FALSE) AS r3, width > 0 AS r4, bitrate BETWEEN 500 AND 2000 AND codec NOT IN ('', 'h264') AS r5, codec = '' AS r6 FROM media_files")(
    lambda s, d: (lambda m: m.select("id", *[PO.compile_rule(r, PO.facts(m)).alias(r.id) for r in POLICY.rules]))(view(s, d, "media_files"))
)
query("policy_impact", f"""SELECT bucket, count(*) AS files, CAST(sum(file_size) FILTER (file_size > 0) AS BIGINT) AS bytes, CAST(sum(CASE WHEN bucket = 'profile:p1' AND duration > 0 THEN CAST(3500 * 125 * duration AS BIGINT) END) AS BIGINT) AS projected_bytes,
count(*) FILTER (status IN ('Completed', 'Skipped')) AS already_processed, coalesce(string_agg(DISTINCT {_NAMES}, ','), '') AS rules, CASE bucket WHEN 'profile:p1' THEN 'AV1 small' WHEN 'profile:p2' THEN 'HEVC quality' WHEN 'blocked:profile missing' THEN 'profile missing' ELSE substr(bucket, 8) END AS label FROM ({_PLAN}) GROUP BY bucket""")(
    lambda s, d: PO.impact(_planned(s, d))
)
query("rule_counts", f"SELECT coalesce(rule_id, 'unmatched') AS rule, count(*) AS files FROM ({_PLAN}) GROUP BY 1")(lambda s, d: PO.rule_counts(_planned(s, d)))
query("impact_samples", f"SELECT bucket, id, file_name, rn AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY bucket ORDER BY id) AS INT) AS rn FROM ({_PLAN})) WHERE rn <= 8")(lambda s, d: PO.samples(_planned(s, d)))
query("find_files", f"SELECT id, file_name, CASE WHEN bucket LIKE 'action:%' THEN substr(bucket, 8) ELSE 'transcode_with_profile' END AS action FROM ({_PLAN}) WHERE contains(lower(file_name), '12') ORDER BY id LIMIT 5")(lambda s, d: PO.find_files(_planned(s, d), "12"))
_LONGEST = "SELECT m.id, m.file_path, f.root AS folder_root, f.policy, f.target_kbps FROM media_files m LEFT JOIN folders f ON starts_with(lower(m.file_path), f.root || '/') QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY length(f.root) DESC NULLS LAST) = 1"
query("folder_override", _LONGEST)(lambda s, d: P.longest_prefix(view(s, d, "media_files").select("id", "file_path"), view(s, d, "folders")))
query("policy_by_folder", f"SELECT bucket, count(*) AS files FROM (SELECT CASE WHEN o.policy = 'Off' THEN 'action:use_simple' ELSE p.bucket END AS bucket FROM ({_PLAN}) p JOIN ({_LONGEST}) o ON p.id = o.id) GROUP BY 1")(
    lambda s, d: PO.assign(P.longest_prefix(view(s, d, "media_files"), view(s, d, "folders")), POLICY, "policy").groupBy(PO.bucket_key().alias("bucket")).agg(F.count("*").alias("files"))
)
query("layered_target", f"SELECT id, coalesce(CASE WHEN id % 4 = 0 THEN 900 END, target_kbps, 3500) AS target_kbps FROM ({_LONGEST})")(
    lambda s, d: P.longest_prefix(view(s, d, "media_files").select("id", "file_path"), view(s, d, "folders")).select("id", F.coalesce(F.when(F.col("id") % 4 == 0, 900), "target_kbps", F.lit(3500)).alias("target_kbps"))
)
query("prefix_rewrite", "SELECT id, CASE WHEN starts_with(file_path, '/media/asia/') THEN concat('/mnt/a/', substr(file_path, 13)) WHEN starts_with(file_path, '/media/') THEN concat('/data/', substr(file_path, 8)) ELSE file_path END AS path FROM media_files")(
    lambda s, d: view(s, d, "media_files").select("id", P.rewrite_prefix(F.col("file_path"), [("/media/", "/data/"), ("/media/asia/", "/mnt/a/")]).alias("path"))
)
query("aligned_tail", "SELECT id, CASE WHEN contains(file_path, '/media/asia/') THEN substr(file_path, 13) WHEN contains(file_path, '/asia/') THEN split_part(file_path, '/asia/', 2) END AS tail FROM media_files")(
    lambda s, d: view(s, d, "media_files").select("id", P.aligned_tail(F.col("file_path"), "/srv/media/Asia").alias("tail"))
)

# decisions

OPTIONS = D.Options()
_SKIP = """SELECT id, CASE WHEN kind = 'Music' THEN FALSE WHEN NOT (codec = 'av1' OR is_hevc) OR bitrate <= 0 THEN FALSE WHEN bitrate <= (CASE WHEN is_4k THEN 14000 ELSE 3500 END) * 1.2 THEN TRUE
ELSE is_hevc AND bitrate < 4200 AND NOT (CASE id % 9 WHEN 3 THEN TRUE ELSE FALSE END) END AS skip FROM media_files"""
query("skip_predicate", _SKIP)(lambda s, d: view(s, d, "media_files").select("id", D.would_skip(OPTIONS).alias("skip")))
_EXCLUDED = "(regexp_matches(lower(file_name), '^1.*9\\.mkv$') OR file_size / 1073741824.0 >= 0.04 OR (width > 0 AND height > 0 AND greatest(height, CAST(floor(width * 3 / 4.0) AS INT)) BETWEEN 600 AND 899))"
_RULES = dict(patterns=["1*9.mkv"], most_gib=0.04, resolutions=["720P"])
query("exclusions", f"SELECT id, file_name, {_EXCLUDED} AS excluded FROM media_files")(lambda s, d: (lambda m: m.select("id", "file_name", scan.excluded(m, **_RULES).alias("excluded")))(view(s, d, "media_files")))
_DRY = f"""SELECT id, CASE WHEN {_EXCLUDED} THEN 'Excluded' WHEN status = 'Completed' THEN 'AlreadyCompleted' WHEN status = 'Failed' THEN 'AlreadyFailed' WHEN b AND bitrate > 0 AND bitrate <= c THEN 'Skip'
WHEN is_hevc AND bitrate > 0 AND bitrate < 4200 AND id % 9 <> 3 THEN 'Skip' WHEN bitrate > 0 AND bitrate < r + 700 AND NOT is_hevc THEN 'Shrink' WHEN is_hevc AND bitrate > 0 AND bitrate < 4200 THEN 'Copy' ELSE 'Queue' END AS decision, bitrate, file_size, r, b AND bitrate > c AND bitrate <= c * 1.3 AND duration > 5 AS borderline
FROM (SELECT *, codec = 'av1' OR is_hevc AS b, CASE WHEN width > 1920 THEN 16800 ELSE 4200 END AS c, CASE WHEN width > 1920 THEN 14000 ELSE 3500 END AS r FROM media_files WHERE kind = 'Video')"""


def _dry(spark, d):
    m = view(spark, d, "media_files").where("kind = 'Video'")
    return m.select("id", "file_size", D.dry_run_video(OPTIONS, scan.excluded(m, **_RULES)).alias("d"))


query("dry_run_video", f"SELECT id, decision, CASE decision WHEN 'Shrink' THEN CAST(floor(bitrate * CAST(0.7 AS DOUBLE)) AS BIGINT) WHEN 'Queue' THEN CASE WHEN bitrate > 0 THEN least(r, bitrate) ELSE r END ELSE 0 END AS target, borderline FROM ({_DRY})")(lambda s, d: _dry(s, d).select("id", "d.decision", "d.target", "d.borderline"))
query("decision_summary", f"SELECT decision, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes, count(*) FILTER (borderline) AS borderline FROM ({_DRY}) GROUP BY 1")(
    lambda s, d: _dry(s, d).groupBy("d.decision").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"), F.count_if("d.borderline").alias("borderline")).orderBy(F.desc("files"), "decision")
)
query("dry_run_policy", f"""SELECT id, CASE WHEN status = 'Completed' THEN 'AlreadyCompleted' WHEN status = 'Failed' THEN 'AlreadyFailed' WHEN bucket LIKE 'blocked:%' THEN 'Queue' WHEN bucket = 'action:skip' THEN 'Skip' WHEN bucket LIKE 'profile:%' THEN 'Queue'
WHEN b AND bitrate > 0 AND bitrate <= c THEN 'Skip' WHEN is_hevc AND bitrate > 0 AND bitrate < 4200 AND id % 9 <> 3 THEN 'Skip' WHEN bitrate > 0 AND bitrate < r + 700 AND NOT is_hevc THEN 'Shrink' WHEN is_hevc AND bitrate > 0 AND bitrate < 4200 THEN 'Copy' ELSE 'Queue' END AS decision
FROM (SELECT *, codec = 'av1' OR is_hevc AS b, CASE WHEN width > 1920 THEN 16800 ELSE 4200 END AS c, CASE WHEN width > 1920 THEN 14000 ELSE 3500 END AS r FROM ({_PLAN}) WHERE kind = 'Video')""")(
    lambda s, d: _planned(s, d).where("kind = 'Video'").select("id", D.dry_run_video(OPTIONS, F.lit(False), F.create_map(*[F.lit(x) for x in ("skip", "Skip", "mux_only", "MuxOnly", "transcode_with_profile", "TranscodeWithProfile", "use_simple", "UseSimple")])[F.col("plan.action")], F.col("plan.blocked").isNotNull(), F.col("plan.target_kbps"))["decision"].alias("decision"))
)
MUSIC = D.MusicOptions(kbps=4000, tolerance_percent=25)
query("dry_run_music", "SELECT id, CASE WHEN codec = 'aac' AND bitrate BETWEEN 3000 AND 5000 THEN 'Skip' ELSE 'Queue' END AS decision, CASE WHEN codec = 'aac' AND bitrate BETWEEN 3000 AND 5000 THEN 0 ELSE 4000 END AS target FROM media_files WHERE kind = 'Music'")(
    lambda s, d: view(s, d, "media_files").where("kind = 'Music'").select("id", D.dry_run_music(MUSIC).alias("m")).select("id", "m.*")
)
query("bitrate_plan", """SELECT id, CASE WHEN s THEN CAST(floor(bitrate * CAST(0.7 AS DOUBLE)) AS BIGINT) ELSE t END AS target, CASE WHEN s THEN CAST(floor(bitrate * CAST(0.6 AS DOUBLE)) AS BIGINT) ELSE greatest(t - 200, 0) END AS least, CASE WHEN s THEN CAST(floor(bitrate * CAST(0.8 AS DOUBLE)) AS BIGINT) ELSE t + 500 END AS most, is_hevc AND bitrate > 0 AND bitrate < 4200 AS copy FROM (
SELECT *, bitrate > 0 AND bitrate < CASE WHEN width > 1920 THEN 14000 ELSE 3500 END + 700 AND NOT is_hevc AS s, CASE WHEN width > 1920 THEN 14000 WHEN bitrate > 0 THEN least(3500, bitrate) ELSE 3500 END AS t FROM media_files)""")(
    lambda s, d: view(s, d, "media_files").select("id", M.bitrate_plan(F.col("bitrate"), F.col("is_hevc"), F.col("width"), target=3500, multiplier=4).alias("p")).select("id", "p.*")
)
query("keep_output", """SELECT job_key, line_no, part_key, node_key, original_size_bytes, completed_at, reason <> 'no savings' AS keep, reason FROM (SELECT *, CASE WHEN part_key % 10 = 0 THEN 'profile retention policy' WHEN encoded_size_bytes < original_size_bytes THEN 'savings' WHEN is_4k THEN 'remux' ELSE 'no savings' END AS reason FROM encode_history)""")(
    lambda s, d: view(s, d, "encode_history").select(*ledger.TIE, D.keep_output(F.col("original_size_bytes"), F.col("encoded_size_bytes"), F.col("part_key") % 10 == 0, False, F.col("is_4k")).alias("k")).select(*ledger.TIE, "k.*")
)
WANTED = A.StreamOptions(audio_languages=("en", "ja"), subtitle_languages=("en",), exclude_sdh=True)
# tracks as lists of structs; a tag's language, else the first one that the title names
_TRACKS = """(SELECT *, CASE WHEN json_valid(audio_streams) THEN from_json(audio_streams, '[{"l":"VARCHAR","c":"VARCHAR","ch":"INTEGER","t":"VARCHAR"}]') ELSE [] END AS a,
CASE WHEN json_valid(subtitle_streams) THEN from_json(subtitle_streams, '[{"l":"VARCHAR","c":"VARCHAR","t":"VARCHAR","s":"BOOLEAN"}]') ELSE [] END AS b FROM media_files)"""
_ISO = "MAP {'eng': 'en', 'english': 'en', 'en': 'en', 'fre': 'fr', 'fra': 'fr', 'french': 'fr', 'ger': 'de', 'deu': 'de', 'german': 'de', 'deutsch': 'de', 'jpn': 'ja', 'japanese': 'ja', 'ja': 'ja'}"
_NAMED = f"coalesce({_ISO}[lower(trim(x.l))], [{_ISO}[lower(w)] for w in string_split_regex(coalesce(x.t, ''), '[ ()\\[\\]\\-,/.:]+') if {_ISO}[lower(w)] IS NOT NULL][1], lower(trim(x.l)))"
_AUDIO_WORK = f"""SELECT id, len(a) > 0 AND (len(kept) < len(a) OR coalesce(list_position(tags, 'ja') < list_position(tags, 'en'), FALSE) OR len([x for x in kept if contains(lower(x.t), 'comm')]) > 0) AS work
FROM (SELECT *, [coalesce({_ISO}[lower(trim(x.l))], lower(trim(x.l))) for x in kept] AS tags FROM (SELECT *, [x for x in a if {_NAMED} IN ('en', 'ja')] AS kept FROM {_TRACKS}))"""
query("audio_work", _AUDIO_WORK)(lambda s, d: view(s, d, "media_files").select("id", A.has_audio_work(A.audio(F.col("audio_streams")), WANTED).alias("work")))
query("subtitle_work", f"SELECT id, len(b) > 0 AND (len([x for x in b if {_NAMED} = 'en']) < len(b) OR len([x for x in b if x.s]) > 0) AS work FROM {_TRACKS}")(lambda s, d: view(s, d, "media_files").select("id", A.has_subtitle_work(A.subtitles(F.col("subtitle_streams")), WANTED).alias("work")))
query("audio_duplicates", f"SELECT id, len(a) > 0 AND (len([x for x in a if contains(lower(x.t), 'comm')]) > 0 OR len(list_distinct([lower(coalesce(x.l, 'und')) for x in a])) < len(a)) AS work FROM {_TRACKS}")(lambda s, d: view(s, d, "media_files").select("id", A.has_audio_work(A.audio(F.col("audio_streams")), A.StreamOptions(preserve_original_audio=False)).alias("work")))
query("best_audio", f"SELECT id, [x.c for x in a if x.ch >= 6 AND x.ch = list_max([y.ch for y in a])][1] AS codec FROM {_TRACKS}")(lambda s, d: view(s, d, "media_files").select("id", A.best_source(A.audio(F.col("audio_streams")), 6)["c"].alias("codec")))
query("container_change", "SELECT id, NOT ends_with(file_path, '.mkv') AS change FROM media_files")(lambda s, d: view(s, d, "media_files").select("id", D.needs_container_change(OPTIONS).alias("change")))
query("no_op_encodes", "SELECT id FROM media_files WHERE is_hevc AND bitrate > 0 AND bitrate < 4200 AND id % 9 <> 3")(lambda s, d: view(s, d, "media_files").where(D.is_no_op(OPTIONS)).select("id"))
query("decision_labels", "SELECT DISTINCT status, status AS label FROM media_files")(
    lambda s, d: view(s, d, "media_files").select("status", D.decision_label(F.col("status")).alias("label")).distinct()
)

# scans and changes

query("scan_new_files", "SELECT path FROM scan WHERE path NOT IN (SELECT file_path FROM media_files)")(lambda s, d: scan.new_files(view(s, d, "scan"), view(s, d, "media_files")).select("path"))
query("scan_changed", "SELECT path, m.file_size AS old_size, s.size, m.duration AS old_duration, s.duration FROM scan s JOIN media_files m ON s.path = m.file_path WHERE abs(1 - s.size / m.file_size) > 0.1 OR abs(m.duration - s.duration) > 30")(_from(scan.changed_files, "scan", "media_files"))
query("scan_renamed", "SELECT path, m.file_path AS old_path, m.id FROM scan s JOIN media_files m ON lower(s.directory) = lower(m.directory) AND lower(s.base_name) = lower(m.base_name) WHERE path NOT IN (SELECT file_path FROM media_files)")(_from(scan.renamed_files, "scan", "media_files"))
query("scan_known", "SELECT s.path FROM scan s WHERE path IN (SELECT file_path FROM media_files) OR EXISTS (SELECT 1 FROM media_files m WHERE m.status <> 'Unseen' AND m.directory = s.directory AND m.base_name = s.base_name)")(_from(scan.known_paths, "scan", "media_files"))
query("prune_missing", "SELECT id, file_path FROM media_files WHERE file_path NOT IN (SELECT path FROM scan)")(lambda s, d: scan.missing_files(view(s, d, "media_files"), view(s, d, "scan")).select("id", "file_path"))
query("settled_files", "SELECT path FROM scan WHERE modified_at <= CAST('1997-01-01' AS TIMESTAMP) - INTERVAL '30' MINUTE")(lambda s, d: view(s, d, "scan").where(scan.settled(F.col("modified_at"), F.lit("1997-01-01").cast("timestamp_ntz"))).select("path"))


def _probes(m: DataFrame, which: str = "id % 3 = 0") -> DataFrame:
    """Newly probed rows: some known files with changes, and new paths."""
    return m.where(which).select(
        F.when(F.col("id") % 2 == 0, F.col("file_path")).otherwise(F.concat("file_path", F.lit(".new"))).alias("file_path"), (F.col("file_size") + 1).alias("file_size"), "bitrate", F.lit("av1").alias("codec"), "width", "height", "duration", F.lit("Queued").alias("status"),
        F.when(F.col("id") % 4 == 0, 9).otherwise(0).alias("priority"), (F.col("id") % 12 == 0).alias("force_mux"), F.when(F.col("id") % 5 == 0, F.lit("[]")).alias("audio_streams"), F.lit(None).cast("string").alias("subtitle_streams"), F.when(F.col("id") % 7 == 0, F.lit("fr")).alias("original_language"), F.lit(0).alias("failure_count"),
    )


_UPSERT = """SELECT coalesce(n.file_path, o.file_path) AS file_path, CASE WHEN n.file_path IS NOT NULL THEN n.file_size ELSE o.file_size END AS file_size, CASE WHEN n.file_path IS NOT NULL THEN 'av1' ELSE o.codec END AS codec, CASE WHEN n.file_path IS NOT NULL THEN 'Queued' ELSE o.status END AS status,
CASE WHEN n.priority <> 0 THEN n.priority ELSE coalesce(o.priority, 0) END AS priority, coalesce(o.force_mux, FALSE) OR coalesce(n.force_mux, FALSE) AS force_mux, coalesce(n.audio_streams, o.audio_streams) AS audio_streams, coalesce(n.original_language, o.original_language) AS original_language, coalesce(o.failure_count, 0) AS failure_count
FROM media_files o FULL JOIN (SELECT CASE WHEN id % 2 = 0 THEN file_path ELSE concat(file_path, '.new') END AS file_path, file_size + 1 AS file_size, CASE WHEN id % 4 = 0 THEN 9 ELSE 0 END AS priority, id % 12 = 0 AS force_mux, CASE WHEN id % 5 = 0 THEN '[]' END AS audio_streams, CASE WHEN id % 7 = 0 THEN 'fr' END AS original_language FROM media_files WHERE id % 3 = 0) n ON o.file_path = n.file_path"""
query("upsert_merge", _UPSERT)(
    lambda s, d: (lambda m: scan.merge(m, _probes(m)).select("file_path", "file_size", "codec", "status", "priority", "force_mux", "audio_streams", "original_language", "failure_count"))(view(s, d, "media_files"))
)
query("requeue_orphans", "SELECT id, CASE WHEN status = 'Processing' AND assigned_node_id IS NULL THEN 'Queued' ELSE status END AS status FROM media_files")(lambda s, d: scan.requeue_orphans(view(s, d, "media_files")).select("id", "status"))
query("reset_verification", "SELECT id, CASE WHEN last_verify_result IS NOT NULL AND last_verify_result NOT IN ('ok', 'missing') THEN NULL ELSE last_verify_result END AS last_verify_result FROM media_files")(
    lambda s, d: scan.reset_verification(view(s, d, "media_files"), library.health()["verify_failed"]).select("id", "last_verify_result")
)
query("clear_assignment", "SELECT id, CASE WHEN assigned_node_id = 'node-2' AND status = 'Processing' THEN 'Queued' ELSE status END AS status, CASE WHEN assigned_node_id = 'node-2' THEN NULL ELSE assigned_node_id END AS assigned_node_id FROM media_files")(
    lambda s, d: scan.clear_assignment(view(s, d, "media_files"), "node-2").select("id", "status", "assigned_node_id")
)
query("delete_failed", "SELECT id FROM media_files WHERE status <> 'Failed'")(lambda s, d: scan.delete_where(view(s, d, "media_files"), F.col("status") == "Failed").select("id"))
query("latest_transitions", "SELECT user_id AS work_item_id, arg_max(event_type, event_id) AS phase, arg_max(event_type, event_id) = 'purchase' AS completed FROM events GROUP BY 1")(
    lambda s, d: scan.latest_transition(table(s, d, "events").select(F.col("user_id").alias("work_item_id"), F.col("event_id").alias("id"), F.col("event_type").alias("phase"), (F.col("event_type") == "purchase").alias("completed")))
)
query("intake", f"""SELECT m.id, CASE WHEN m.id % 4 = 0 AND status IN ('Failed', 'Completed', 'Queued') THEN 'Unchanged' WHEN {_EXCLUDED} THEN 'Excluded' WHEN m.id % 3 <> 0 AND status IN ('Completed', 'Queued') THEN 'Known' WHEN m.id % 3 <> 0 AND status = 'Failed' AND (kind <> 'Music' OR failure_count >= 3) THEN 'Failed' WHEN skip THEN 'Skip' ELSE 'Queue' END AS decision FROM media_files m JOIN ({_SKIP}) k ON m.id = k.id""")(
    lambda s, d: (lambda m: m.select("id", D.intake(OPTIONS, scan.excluded(m, **_RULES), F.col("id") % 4 == 0, F.col("id") % 3 == 0).alias("decision")))(view(s, d, "media_files"))
)

# scalars

query("codec_normalize", "SELECT DISTINCT codec, CASE WHEN codec IN ('hevc') THEN 'h265' WHEN codec IN ('h264') THEN 'h264' ELSE codec END AS normal, CASE WHEN codec = 'hevc' THEN 'h265' WHEN codec = '' THEN 'unknown' ELSE codec END AS label FROM media_files WHERE NOT (codec = '' AND is_hevc)")(
    lambda s, d: view(s, d, "media_files").where("not (codec = '' and is_hevc)").select("codec", C.normalize(F.upper(F.concat(F.lit(" "), "codec"))).alias("normal"), C.source_label(F.col("codec"), F.col("is_hevc")).alias("label")).distinct()
)
_BITS = "regexp_extract(lower(trim(pixel_format)), '{}', 1)"
query(
    "bit_depth",
    f"""SELECT id, CASE WHEN coalesce(trim(pixel_format), '') = '' THEN NULL WHEN {_BITS.format('p[024]?(9|1[0246])(?:le|be)?$')} <> '' THEN CAST({_BITS.format('p[024]?(9|1[0246])(?:le|be)?$')} AS INT) WHEN lower(pixel_format) IN ('v210', 'v410') THEN 10
WHEN {_BITS.format('^(?:gray|rgb|bgr|gbr|y).*?(9|1[0246])(?:le|be)?$')} <> '' THEN CAST({_BITS.format('^(?:gray|rgb|bgr|gbr|y).*?(9|1[0246])(?:le|be)?$')} AS INT) ELSE 8 END AS depth FROM media_files""",
)(lambda s, d: view(s, d, "media_files").select("id", M.bit_depth(F.col("pixel_format")).alias("depth")))
query("resolution_labels", """SELECT id, CASE WHEN e IS NULL THEN NULL WHEN e < 720 THEN 'sd' WHEN e < 1080 THEN '720p' WHEN e < 1440 THEN '1080p' WHEN e < 2160 THEN '1440p' ELSE '2160p+' END AS class, CASE WHEN h >= 2000 THEN '2160p' WHEN h >= 1300 THEN '1440p' WHEN h >= 900 THEN '1080p' WHEN h >= 600 THEN '720p' WHEN h >= 380 THEN '480p' END AS exclusion,
CASE WHEN is_4k OR e >= 2160 THEN '4K' WHEN e >= 1440 THEN '1440p' WHEN e >= 1080 THEN '1080p' WHEN e >= 720 THEN '720p' WHEN e > 0 THEN 'SD' ELSE 'Unknown' END AS display, CASE WHEN width > 1920 THEN '4K' WHEN width > 1280 THEN '1080p' WHEN width > 960 THEN '720p' WHEN width > 0 THEN 'SD' END AS insight
FROM (SELECT *, CASE WHEN width > 0 AND height > 0 THEN least(width, height) END AS e, CASE WHEN width > 0 AND height > 0 THEN greatest(height, CAST(floor(width * 3 / 4.0) AS INT)) END AS h FROM media_files)""")(
    lambda s, d: (lambda w, h: view(s, d, "media_files").select("id", M.resolution_class(w, h).alias("class"), M.exclusion_label(w, h).alias("exclusion"), M.display_resolution(F.col("is_4k"), w, h).alias("display"), M.insight_bucket(w).alias("insight")))(F.col("width"), F.col("height"))
)
query("path_parts", "SELECT id, directory, file_name, base_name, CASE WHEN id % 5 = 0 THEN 'flac' ELSE 'mkv' END AS extension, kind, lower(concat(directory, '|', base_name)) AS key FROM media_files")(
    lambda s, d: (lambda p: view(s, d, "media_files").select("id", P.directory(p).alias("directory"), P.file_name(p).alias("file_name"), P.base_name(p).alias("base_name"), P.extension(p).alias("extension"), P.kind(p).alias("kind"), P.folder_key(P.directory(p), P.base_name(p)).alias("key")))(F.col("file_path"))
)
_TITLE = "concat('/lib/', c_name, CASE c_custkey % 6 WHEN 0 THEN '.S01E02.1080p.mkv' WHEN 1 THEN ' (1999).mkv' WHEN 2 THEN ' - 07 [720p].mkv' WHEN 3 THEN '.2x05.avi' WHEN 4 THEN ' 2001 A Space (1968).mkv' ELSE '.mkv' END)"
_MARK = "'[Ss][0-9]+[Ee][0-9]+|[ ._-][0-9]+x[0-9]+[ ._-]| - [0-9]+ '"
_NAME = f"regexp_extract({_TITLE}, '([^/]*)[.][^.]*$', 1)"
query("media_classify", f"SELECT c_custkey, CASE WHEN regexp_matches({_TITLE}, {_MARK}) OR regexp_matches({_TITLE}, '[ ._-][0-9]+x[0-9]+[.]') THEN 'Tv' ELSE 'Movie' END AS media FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", T.classify(F.expr(_TITLE)).alias("media")))
query("series_title", f"SELECT c_custkey, trim(replace(regexp_replace({_NAME}, '[ ._-]*(?:[Ss][0-9]+[Ee][0-9]+|[0-9]+x[0-9]+| - [0-9]+).*$', ''), '.', ' ')) AS title FROM customer WHERE regexp_matches({_TITLE}, {_MARK})")(lambda s, d: table(s, d, "customer").where(T.classify(F.expr(_TITLE)) == "Tv").select("c_custkey", T.series_title(F.expr(_TITLE)).alias("title")))
query("movie_year", f"SELECT c_custkey, trim(regexp_replace({_NAME}, '[(](?:19|20)[0-9][0-9][)]$', '')) AS title, TRY_CAST(regexp_extract({_NAME}, '.*[ (]((?:19|20)[0-9][0-9])[ )]?$', 1) AS INT) AS year FROM customer WHERE NOT regexp_matches({_TITLE}, {_MARK})")(
    lambda s, d: table(s, d, "customer").where(T.classify(F.expr(_TITLE)) == "Movie").select("c_custkey", T.movie_title(F.expr(_TITLE)).alias("m")).select("c_custkey", "m.*")
)
_TAG = "CASE c_custkey % 6 WHEN 0 THEN 'ENG' WHEN 1 THEN ' ger' WHEN 2 THEN 'French' WHEN 3 THEN 'und' WHEN 4 THEN NULL ELSE 'jpn' END"
query("language_normalize", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' WHEN 5 THEN 'ja' END AS two, CASE c_custkey % 6 WHEN 0 THEN 'eng' WHEN 1 THEN 'ger' WHEN 2 THEN 'fre' WHEN 5 THEN 'jpn' END AS b, CASE c_custkey % 6 WHEN 0 THEN 'eng' WHEN 1 THEN 'deu' WHEN 2 THEN 'fra' WHEN 5 THEN 'jpn' END AS t, CASE c_custkey % 6 WHEN 0 THEN 'English' WHEN 1 THEN 'German' WHEN 2 THEN 'French' WHEN 5 THEN 'Japanese' END AS name FROM customer")(
    lambda s, d: (lambda x: table(s, d, "customer").select("c_custkey", L.two_letter(x).alias("two"), L.three_letter_b(x).alias("b"), L.three_letter_t(x).alias("t"), L.english_name(x).alias("name")))(F.expr(_TAG))
)
query("language_match", "SELECT c_custkey, c_custkey % 6 IN (0, 3, 5) AS wanted FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", L.matches(F.expr(_TAG), F.expr("CASE WHEN c_custkey % 6 = 3 THEN 'English (Forced)' END"), ["en", "ja"]).alias("wanted")))
query("track_titles", "SELECT c_custkey, c_custkey % 4 = 0 AS sdh, c_custkey % 4 = 1 AS commentary FROM customer")(
    lambda s, d: (lambda x: table(s, d, "customer").select("c_custkey", L.is_sdh(x).alias("sdh"), L.is_commentary(x).alias("commentary")))(F.expr("CASE c_custkey % 4 WHEN 0 THEN 'English [CC]' WHEN 1 THEN 'Director Commentary' WHEN 2 THEN 'Chichewa' END"))
)
query("duration_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE CAST(o_orderkey % 90000 AS DOUBLE) END AS seconds, CASE WHEN o_orderkey % 3 = 0 THEN '00:00:00' ELSE concat(lpad(CAST(CAST(floor((o_orderkey % 90000) / 3600) AS BIGINT) AS VARCHAR), 2, '0'), ':', lpad(CAST(CAST(floor((o_orderkey % 90000) / 60) AS BIGINT) % 60 AS VARCHAR), 2, '0'), ':', lpad(CAST((o_orderkey % 90000) % 60 AS VARCHAR), 2, '0')) END AS clock FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", S.seconds(F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(S.clock(F.col("o_orderkey") % 90000))).alias("seconds")).withColumn("clock", S.clock(F.col("seconds")))
)
# sizes of parts over their numbers stand for rates; some of these have nothing below the line
_RATE = "concat(CAST(p_size * 1000 AS STRING), '/', CAST(p_partkey % 7 * 143 AS STRING))"
query("frame_rate", "SELECT p_partkey, rate, CAST(CASE WHEN rate IS NULL THEN 48 ELSE greatest(24, round_even(rate * 2, 0)) END AS INT) AS gop FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN p_size * 1000 / CAST(p_partkey % 7 * 143 AS DOUBLE) END AS rate FROM part)")(
    lambda s, d: table(s, d, "part").select("p_partkey", M.frame_rate(F.expr(_RATE)).alias("rate")).withColumn("gop", M.gop(F.col("rate")))
)
query("schedule_open", "SELECT event_id, CASE WHEN dayofweek(ts) IN (1, 2, 3, 4, 5) AND hour(ts) >= 22 THEN TRUE WHEN dayofweek(ts) IN (2, 3, 4, 5, 6) AND hour(ts) * 60 + minute(ts) < 390 THEN TRUE WHEN dayofweek(ts) = 0 THEN TRUE ELSE FALSE END AS open FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", S.within(F.from_json(F.lit('[{"days":["Monday","Tuesday","Wednesday","Thursday","Friday"],"start":"22:00","end":"06:30"},{"days":["Sunday"],"start":"00:00","end":"00:00"},{"days":["Saturday"],"start":"25:00","end":"26:00"}]'), "array<struct<days:array<string>,start:string,end:string>>"), F.col("ts")).alias("open"))
)
query("backoff", "SELECT id, failure_count, CASE failure_count WHEN 1 THEN 5 WHEN 2 THEN 10 WHEN 3 THEN 20 WHEN 4 THEN 40 ELSE 60 END AS minutes FROM media_files WHERE failure_count > 0")(lambda s, d: view(s, d, "media_files").where("failure_count > 0").select("id", "failure_count", M.backoff_minutes(F.col("failure_count")).alias("minutes")))
query("kbps_from_size", "SELECT id, CASE WHEN duration > 0 THEN CAST(floor(file_size * 8 / duration / 1000) AS BIGINT) ELSE 0 END AS kbps FROM media_files")(lambda s, d: view(s, d, "media_files").select("id", M.kbps_from_size(F.col("file_size"), F.col("duration")).alias("kbps")))
query("plausible_outputs", "SELECT id, duration % 100 = 0 OR abs(duration - duration % 100 * 50) < greatest(30, duration * 0.01) AS plausible FROM media_files")(lambda s, d: view(s, d, "media_files").select("id", S.plausible_output(F.col("duration").cast("double"), (F.col("duration") % 100 * 50).cast("double")).alias("plausible")))

# placement

_ITEMS = "SELECT id AS item_id, file_size AS size, is_4k, CASE id % 3 WHEN 0 THEN 'h265' WHEN 1 THEN 'av1' ELSE 'h264' END AS codec, CASE id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'none' WHEN 2 THEN 'nvidia' ELSE 'intel' END AS hardware, CASE WHEN id % 10 = 0 THEN 'hevc_qsv' ELSE '' END AS encoder FROM media_files WHERE status = 'Queued' AND kind = 'Video'"
_SCORES = f"""SELECT item_id, node_id, device_id, status, is_paused, heartbeat_rank, cap, used, CAST(CASE WHEN device_id = 'music' THEN -100 WHEN only_4k AND NOT is_4k THEN -100 WHEN exclude_4k AND is_4k THEN -100 WHEN encoder <> '' AND NOT list_contains(string_split(encoders, ','), encoder) THEN -100 WHEN available_disk_bytes < size * 2.5 THEN -100
WHEN NOT list_contains(string_split(codecs, ','), codec) THEN -50 WHEN encoder = '' AND hardware = 'none' AND device_id <> 'cpu' THEN -50 WHEN encoder = '' AND hardware NOT IN ('none', 'auto') AND device_id = 'cpu' AND chosen THEN -50 WHEN encoder = '' AND hardware = 'auto' AND device_id = 'cpu' AND usable THEN -50 WHEN encoder = '' AND hardware NOT IN ('none', 'auto') AND device_id <> 'cpu' AND device_id <> hardware THEN -50
ELSE CASE WHEN encoder <> '' THEN 21 WHEN hardware = 'none' THEN 7 WHEN hardware = 'auto' THEN CASE WHEN device_id = 'cpu' THEN 6 ELSE 9 END WHEN device_id = hardware THEN 13 ELSE 1 END + greatest(0, cap - used) END AS INT) AS score
FROM (SELECT i.*, dn.*, coalesce(u.used, 0) AS used, EXISTS (SELECT 1 FROM devices h WHERE h.node_id = dn.node_id AND h.device_id <> 'cpu' AND list_contains(string_split(h.codecs, ','), i.codec)) AS usable, EXISTS (SELECT 1 FROM devices h WHERE h.node_id = dn.node_id AND h.device_id <> 'cpu' AND h.device_id = i.hardware AND list_contains(string_split(h.codecs, ','), i.codec)) AS chosen
FROM ({_ITEMS}) i CROSS JOIN (SELECT d.node_id, d.device_id, d.codecs, d.encoders, CASE WHEN d.device_id = 'cpu' THEN 1 ELSE d.capacity END AS cap, n.status, n.is_paused, n.heartbeat_rank, n.only_4k, n.exclude_4k, n.available_disk_bytes FROM devices d JOIN nodes n ON d.node_id = n.node_id) dn LEFT JOIN (SELECT node_id, device_id, CAST(count(*) AS INT) AS used FROM slots GROUP BY 1, 2) u ON u.node_id = dn.node_id AND u.device_id = dn.device_id)"""


def _items(spark, d):
    """Queued videos as items to place."""
    return view(spark, d, "media_files").where("status = 'Queued' and kind = 'Video'").selectExpr(
        "id as item_id",
        "file_size as size",
        "is_4k",
        "case id % 3 when 0 then 'h265' when 1 then 'av1' else 'h264' end as codec",
        "case id % 4 when 0 then 'auto' when 1 then 'none' when 2 then 'nvidia' else 'intel' end as hardware",
        "case when id % 10 = 0 then 'hevc_qsv' else '' end as encoder",
    )


def _placed(operator):
    return lambda s, d: operator(_items(s, d), *[view(s, d, v) for v in ("nodes", "devices", "slots")])


_BEST = f"SELECT item_id, node_id, device_id, score FROM ({_SCORES}) WHERE status IN ('Online', 'Busy', 'Uploading', 'Downloading') AND NOT is_paused AND used < cap AND score > 0\nQUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, heartbeat_rank, node_id, device_id) = 1"
for _name in ("slot_scores", "slot_scores_all"):
    query(_name, f"SELECT item_id, node_id, device_id, score FROM ({_SCORES})")(lambda s, d: _placed(placement.all_scores)(s, d))
for _name in ("best_slot", "best_slot_all"):
    query(_name, _BEST)(_placed(placement.best_slots_by_class))
query("slot_usage", "SELECT node_id, device_id, count(*) AS used FROM slots GROUP BY 1, 2")(_from(placement.used_slots, "slots"))
query("slot_phases", "SELECT phase, count(*) AS slots, max(progress) AS furthest FROM slots GROUP BY 1")(_from(placement.slots_by_phase, "slots"))
query(
    "watchdog",
    """SELECT id, assigned_node_id, id % 13 AS idle_minutes, CASE WHEN id % 13 < 5 THEN 'ok' WHEN assigned_node_id IS NOT NULL AND assigned_node_id NOT IN (SELECT node_id FROM nodes) THEN 'ghost-node'
WHEN assigned_node_id IS NULL AND concat('job-', CAST(id AS VARCHAR)) NOT IN (SELECT job_id FROM slots) AND file_size % 3 <> 0 THEN 'local-orphan' WHEN assigned_node_id IS NOT NULL AND file_size % 3 = 0 AND id % 13 >= 10 THEN 'stalled-remote' ELSE 'ok' END AS class FROM media_files WHERE status = 'Processing'""",
)(
    lambda s, d: (
        lambda m: placement.watchdog(m.select("id", "assigned_node_id", (F.col("id") % 13).alias("idle_minutes")), view(s, d, "nodes"), view(s, d, "slots").select(F.regexp_replace("job_id", "^job-", "").cast("long").alias("id")), m.where("file_size % 3 = 0").select("id"))
    )(view(s, d, "media_files").where("status = 'Processing'"))
)
query("reconcile", "SELECT coalesce(r.job_id, a.job_id) AS job_id, CASE WHEN r.job_id IS NULL THEN 'idle-grace' WHEN a.job_id IS NULL THEN 'unknown' WHEN progress = 100 THEN 'completed' WHEN phase = 'Uploading' THEN 'receiving' ELSE 'progress' END AS class FROM (SELECT * FROM slots WHERE progress % 3 <> 0) r FULL JOIN (SELECT job_id FROM slots WHERE progress % 4 <> 0) a ON r.job_id = a.job_id")(
    lambda s, d: (lambda x: placement.reconcile(x.where("progress % 3 <> 0").select("job_id", F.when(F.col("progress") == 100, "done").when(F.col("phase") == "Uploading", "receiving").otherwise("running").alias("state")), x.where("progress % 4 <> 0").select("job_id")))(view(s, d, "slots"))
)
query("capability_signature", "SELECT node_id, string_agg(one, ';' ORDER BY one) AS signature FROM (SELECT node_id, concat(device_id, '=', array_to_string(list_sort(string_split(codecs, ',')), '+')) AS one FROM devices) GROUP BY 1")(_from(placement.signatures, "devices"))


@query("encoder_catalog", "SELECT DISTINCT e AS encoder, CASE WHEN e IN ('libx264', 'LIBX265') THEN 'local' ELSE 'worker' END AS source FROM (SELECT unnest(string_split(encoders, ',')) AS e FROM devices) WHERE e NOT IN ('libx264', 'libx265') UNION ALL SELECT 'libx264', 'local' UNION ALL SELECT 'LIBX265', 'local' UNION ALL SELECT 'libvpx', 'registry'")
def _catalog(spark, d):
    workers = view(spark, d, "devices").select("codecs", F.explode(F.split("encoders", ",")).alias("encoder")).select(F.lit("any").alias("codec"), "encoder")
    own = spark.createDataFrame([("h264", "libx264"), ("h265", "LIBX265")], "codec string, encoder string")
    registry = spark.createDataFrame([("vp9", "libvpx"), ("h264", "libx264")], "codec string, encoder string")
    return placement.encoder_catalog(own, workers, registry).select("encoder", "source")


# streams and text

query("stream_daily", "SELECT CAST(ts AS DATE) AS day, count(*) AS events, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_cents FROM events GROUP BY 1")(
    lambda s, d: feeds.drained(feeds.daily(feeds.open_stream(s, f"{d}/events.parquet", "ts"), "ts"), "framelake_daily")
)
query("stream_latest", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, count(*) AS events FROM events GROUP BY 1")(
    lambda s, d: feeds.drained(feeds.latest(feeds.open_stream(s, f"{d}/events.parquet", "ts"), "user_id", "event_id", "event_type", "value"), "framelake_latest")
)
_ALONE = "'(^|\\s|-)[|\\[\\]]($|\\s|[,.?!''])', '\\1I\\2', 'g'"  # twice, as neighbours share the blank between them
query(
    "ocr_substitutions",
    f"SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(concat('= | think ', text), {_ALONE}), {_ALONE}), '(^|\\n|\\r)=', '\\1-', 'g') AS text FROM conversations",
)(lambda s, d: table(s, d, "conversations").select("conv_id", "turn", ocr.substituted(F.concat(F.lit("= | think "), "text")).alias("text")))
query("srt_cues", """SELECT conv_id, string_agg(concat(CAST(n AS VARCHAR), chr(10), '00:', lpad(CAST(turn * 2 // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(turn * 2 % 60 AS VARCHAR), 2, '0'), ',000 --> 00:', lpad(CAST((turn * 2 + 1) // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST((turn * 2 + 1) % 60 AS VARCHAR), 2, '0'), ',500', chr(10), text, chr(10)), chr(10) ORDER BY n) AS srt
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT DISTINCT conv_id, turn, trim(text) AS text FROM conversations WHERE trim(text) <> '')) GROUP BY 1""")(
    lambda s, d: FS.srt(table(s, d, "conversations").select("conv_id", (F.col("turn") * 2000).alias("start_ms"), (F.col("turn") * 2000 + 1500).alias("end_ms"), F.trim("text").alias("text"), "turn").distinct(), "conv_id")
)
query("metrics_text", """SELECT name, concat('# HELP ', name, ' Files by status', chr(10), '# TYPE ', name, ' gauge', chr(10), string_agg(sample, chr(10) ORDER BY sample)) AS text FROM (SELECT 'library_files' AS name, concat('library_files{status="', status, '"} ', CAST(count(*) AS VARCHAR)) AS sample FROM media_files WHERE last_scanned_at IS NOT NULL GROUP BY status) GROUP BY name""")(
    lambda s, d: FS.metrics_text(library.statuses(view(s, d, "media_files")).select(F.lit("library_files").alias("name"), F.lit("gauge").alias("kind"), F.lit("Files by status").alias("help"), F.lit("status").alias("label"), F.col("status").alias("label_value"), F.col("files").alias("value")))
)
query("crop_modes", "SELECT file_id, arg_min(crop, (-n, crop)) AS crop FROM (SELECT user_id AS file_id, event_type AS crop, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")(lambda s, d: FS.crop_mode(table(s, d, "events").select(F.col("user_id").alias("file_id"), F.col("event_type").alias("crop"))))
query(
    "json_envelope",
    f"""SELECT concat('{{{{"page":0,"pageSize":10,"total":', (SELECT count(*) FROM {_QUEUED}), ',"records":[', string_agg(concat('{{{{"id":', id, ',"priority":', priority, '}}}}'), ',' ORDER BY priority DESC, bitrate DESC, id), ']}}}}') AS json
FROM (SELECT * FROM {_QUEUED} ORDER BY priority DESC, bitrate DESC, id LIMIT 10)""".replace("{{", "{").replace("}}", "}"),
)(lambda s, d: (lambda m: FS.envelope(queue.page(m, 0, 10).select("id", "priority"), queue.total(m), 0, 10))(view(s, d, "media_files")))

# more of the repertoire

query("remote_files", "SELECT id, assigned_node_id FROM media_files WHERE assigned_node_id IS NOT NULL")(lambda s, d: queue.remote(view(s, d, "media_files")).select("id", "assigned_node_id"))
query("insert_unseen", "SELECT DISTINCT path AS file_path, directory, CASE WHEN ends_with(path, '.mp4') THEN base_name ELSE split_part(base_name, '/', -1) END AS base_name, 'Completed' AS status FROM scan WHERE path NOT IN (SELECT file_path FROM media_files)")(_from(scan.insert_unseen, "media_files", "scan"))
query("open_transitions", "SELECT event_id FROM events WHERE event_type <> 'purchase'")(lambda s, d: scan.open_transitions(table(s, d, "events").select("event_id", (F.col("event_type") == "purchase").alias("completed"))).select("event_id"))
query("old_transitions", "SELECT event_id AS id FROM events WHERE event_type = 'purchase' AND ts < CAST('2024-01-20' AS TIMESTAMP) - INTERVAL '24' HOUR ORDER BY ts, event_id LIMIT 50")(
    lambda s, d: scan.old_transitions(table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), (F.col("event_type") == "purchase").alias("completed")), F.lit("2024-01-20").cast("timestamp_ntz"), limit=50).select("id")
)
query("external_language", "SELECT file_path, CASE WHEN starts_with(file_path, '/media/asia/') THEN 'ja' WHEN starts_with(file_path, '/media/europe/') THEN 'de' WHEN contains(file_path, '/nation_7/') THEN 'fr' END AS language FROM media_files")(
    lambda s, d: scan.external_language(view(s, d, "media_files"), s.createDataFrame([("/media/asia/", "Japanese"), ("/media", ""), ("/Media/Europe", "ger"), ("/elsewhere/NATION_7", "fra")], "path string, lang string"))
)
query("music_intake", "SELECT id, CASE WHEN codec = 'aac' AND bitrate BETWEEN 3000 AND 5000 THEN 'Skip' WHEN id % 3 <> 0 AND status IN ('Completed', 'Queued') THEN 'Known' WHEN id % 3 <> 0 AND status = 'Failed' AND failure_count >= 3 THEN 'Failed' ELSE 'Queue' END AS decision FROM media_files WHERE kind = 'Music'")(
    lambda s, d: view(s, d, "media_files").where("kind = 'Music'").select("id", D.intake_music(MUSIC, F.col("id") % 3 == 0).alias("decision"))
)
query("mux_dry_run", f"""SELECT id, CASE WHEN status = 'Completed' THEN 'AlreadyCompleted' WHEN status = 'Failed' THEN 'AlreadyFailed' WHEN len(a) > 0 AND len([x for x in a if contains(lower(x.t), 'comm')]) > 0 THEN 'Mux' ELSE 'Skip' END AS decision FROM {_TRACKS} WHERE kind = 'Video'""")(
    lambda s, d: view(s, d, "media_files").where("kind = 'Video'").select("id", D.dry_run_video(D.Options(mode="MuxOnly", mux_streams="Audio"), F.lit(False))["decision"].alias("decision"))
)
query("analysis_tab", f"SELECT m.id, m.file_path, y.decision FROM ({_DRY}) y JOIN media_files m ON m.id = y.id WHERE decision IN ('Queue', 'Shrink') AND contains(lower(m.file_path), 'asia')")(
    lambda s, d: (lambda m: D.filter_analysis(m.select("id", "file_path", D.dry_run_video(OPTIONS, scan.excluded(m, **_RULES))["decision"].alias("decision")), ["Queue", "Shrink"], "ASIA"))(view(s, d, "media_files").where("kind = 'Video'"))
)
query("master_node", "SELECT min(node_id) AS node_id FROM nodes WHERE role = 'master'")(_from(placement.master, "nodes"))
query("slot_labels", "SELECT job_id, CASE phase WHEN 'Encoding' THEN 'Encoding' WHEN 'Downloading' THEN 'Downloading' ELSE 'Uploading' END AS label, CASE phase WHEN 'Encoding' THEN 'Encoding' WHEN 'Downloading' THEN 'Downloading' ELSE 'Uploading' END AS back FROM slots")(
    lambda s, d: view(s, d, "slots").select("job_id", placement.phase_label(F.col("phase")).alias("label")).withColumn("back", placement.phase_of(F.col("label")))
)
query("node_statuses", "SELECT n.node_id, CASE WHEN is_paused THEN 'Paused' WHEN count(s.job_id) > 0 THEN 'Busy' ELSE 'Online' END AS status FROM nodes n LEFT JOIN slots s ON s.node_id = n.node_id GROUP BY n.node_id, is_paused")(
    lambda s, d: view(s, d, "nodes").join(view(s, d, "slots").groupBy("node_id").agg(F.count("*").alias("used")), "node_id", "left").select("node_id", placement.node_status(F.col("is_paused"), F.coalesce("used", F.lit(0))).alias("status"))
)
query("slim_projection", "SELECT id, file_path, file_name, codec, width, height, bitrate, file_size, duration, pixel_format, is_hdr, is_4k, status, kind FROM media_files")(_from(library.slim, "media_files"))
query("labelled_ledger", "SELECT profile_name, profile_id, original_size_bytes, encoded_size_bytes, bytes_saved, duration_seconds, completed_at, job_key, line_no, part_key, node_key FROM encode_history WHERE profile_name IS NOT NULL")(_from(ledger.labelled, "encode_history"))
# names in the manner of events: each word of what a part is, with a capital and without blanks
_CAMEL = "replace(initcap(p_type), ' ', '')"
query(
    "notification_texts",
    """SELECT p_partkey, trim(regexp_replace(camel, '([A-Z])', ' \\1', 'g')) AS title, CASE p_partkey % 3 WHEN 0 THEN 'ntfy' WHEN 1 THEN 'apprise' ELSE 'webhook' END AS channel, CASE WHEN length(p_name) <= 20 THEN p_name ELSE concat(p_name[1:17], '...') END AS short
FROM (SELECT *, array_to_string([concat(upper(w[1]), lower(w[2:])) for w in string_split(p_type, ' ')], '') AS camel FROM part)""",
)(
    lambda s, d: table(s, d, "part").select(
        "p_partkey",
        X.spaced(F.expr(_CAMEL)).alias("title"),
        X.channel(F.expr("CASE p_partkey % 3 WHEN 0 THEN 'https://ntfy.sh/x' WHEN 1 THEN 'apprise://x' ELSE 'https://example.com/h' END")).alias("channel"),
        X.shortened(F.col("p_name"), 20).alias("short"),
    )
)
query("companions", "SELECT m.file_path, concat(m.directory, '/', m.base_name, ' [encoded].mkv') AS output FROM media_files m WHERE id % 3 = 0")(
    lambda s, d: (lambda m: scan.companions(m.select("directory", "base_name", "file_path").unionByName(m.where("id % 3 = 0").select("directory", F.concat("base_name", F.lit(" [encoded]")).alias("base_name"), F.concat("directory", F.lit("/"), "base_name", F.lit(" [encoded].mkv")).alias("file_path"))), " [encoded]"))(view(s, d, "media_files"))
)

from framelake import more_queries  # noqa: E402, F401  its queries are added to these
from framelake import ocr_queries  # noqa: E402, F401
from framelake import dispatch_queries  # noqa: E402, F401
from framelake import stream_queries  # noqa: E402, F401
from framelake import policy_queries  # noqa: E402, F401
from framelake import flow_queries  # noqa: E402, F401
