"""Queries of changes: states after settings changed, failures, assignments, verification, deletions, lookups, and the
texts of dashboard and log. Each has DuckDB SQL that follows the rule, not the function."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions import media as M
from framelake.more_queries import _AT, _DIGITS, _WIDE, _now, _wide
from framelake.operators import decision as D
from framelake.operators import library, placement, queue, scan, snapshots
from framelake.queries import _SKIP, _UPSERT, OPTIONS, _probes, query, view
from framelake.session import shared_folder
from framelake.sources import files as FS
from framelake.sources.adapters import table

# settings changed

# half of the finished files stand for ones that were never seen or saved nothing
_MIXED = "CASE WHEN status = 'Completed' AND id % 4 = 1 THEN 'Unseen' WHEN status = 'Completed' AND id % 4 = 3 THEN 'NoSavings' ELSE status END"
_KNOWN = "(audio_streams IS NOT NULL OR subtitle_streams IS NOT NULL)"
_REEVALUATED = """SELECT m.id, CASE WHEN s = 'Skipped' AND NOT ({known} AND skip) THEN 'Unseen' WHEN s = 'Unseen' AND {known} AND skip THEN 'Skipped'
WHEN s = 'Queued' AND assigned_node_id IS NULL AND {known} AND skip THEN 'Skipped' WHEN {retry} AND s = 'NoSavings' THEN 'Unseen' ELSE s END AS status
FROM (SELECT *, {mixed} AS s FROM media_files) m JOIN ({skip}) k ON m.id = k.id"""


def _mixed(spark, d) -> DataFrame:
    return view(spark, d, "media_files").withColumn("status", F.expr(_MIXED))


for _name, _retry in (("reevaluate", False), ("reevaluate_all", True)):
    query(_name, _REEVALUATED.format(known=_KNOWN, mixed=_MIXED, skip=_SKIP, retry=str(_retry).upper()))(
        lambda s, d, retry=_retry: scan.reevaluate(_mixed(s, d), D.would_skip(OPTIONS), retry).select("id", "status")
    )
# every finished file stands for one that saved nothing
_FINISHED = "CASE WHEN status = 'Completed' THEN 'NoSavings' ELSE status END"
query("reopen_no_savings", f"SELECT id, CASE WHEN s = 'NoSavings' THEN 'Unseen' ELSE s END AS status FROM (SELECT id, {_FINISHED} AS s FROM media_files)")(
    lambda s, d: scan.reopen_no_savings(view(s, d, "media_files").withColumn("status", F.expr(_FINISHED))).select("id", "status")
)
query(
    "reset_queued",
    """SELECT id, CASE WHEN w THEN 'Unseen' ELSE status END AS status, CASE WHEN w THEN 0 ELSE priority END AS priority, force_mux AND NOT w AS force_mux
FROM (SELECT *, status = 'Queued' AND assigned_node_id IS NULL AS w FROM media_files)""",
)(lambda s, d: scan.reset_queued(view(s, d, "media_files")).select("id", "status", "priority", "force_mux"))
# every path of even size is listed; every third of them once more in capitals, which is no file's spelling and comes later
query("batch_status", "SELECT id, CASE WHEN file_path IN (SELECT path FROM scan WHERE size % 2 = 0) THEN 'Queued' ELSE status END AS status FROM media_files")(
    lambda s, d: (
        lambda x: scan.set_status(view(s, d, "media_files"), x.select("path", F.lit(1).alias("place")).unionByName(x.where("size % 3 = 0").select(F.upper("path").alias("path"), F.lit(2).alias("place"))), "Queued").select("id", "status")
    )(view(s, d, "scan").where("size % 2 = 0"))
)

# upserts that rewrite only what they touch

_FEW = 61

@query("upsert_buckets", _UPSERT.replace("id % 3 = 0)", f"id % {_FEW} = 0)"))
def _upsert_buckets(spark, d):
    """The library as a table in buckets, the probes of a few files merged into it, and read again."""
    folder = f"{shared_folder(spark)}/library-{uuid.uuid4().hex}"
    m = view(spark, d, "media_files")
    snapshots.create(scan.merge(m, _probes(m).where(F.lit(False))), folder, "file_path")
    snapshots.change(spark, folder, "file_path", _probes(m.withColumn("few", F.col("id") % _FEW == 0), "few"), scan.merge)
    return snapshots.read(spark, folder).select("file_path", "file_size", "codec", "status", "priority", "force_mux", "audio_streams", "original_language", "failure_count")


# failures, assignments, verification

query(
    "record_failure",
    f"""SELECT m.id, CASE WHEN f.id IS NULL THEN status ELSE 'Failed' END AS status, failure_count + coalesce(n, 0) AS failure_count, CASE WHEN f.id IS NULL THEN failure_reason ELSE repeat(last, 2048) END AS failure_reason
FROM (SELECT {_WIDE} FROM media_files) m LEFT JOIN (SELECT user_id AS id, CAST(count(*) AS INT) AS n, arg_max(substr(event_type, 1, 1), event_id) AS last FROM events WHERE event_type <> 'purchase' GROUP BY 1) f ON m.id = f.id""",
)(
    lambda s, d: (
        lambda m: scan.record_failures(
            m,
            table(s, d, "events").where("event_type <> 'purchase'").join(m.select(F.col("id").alias("user_id"), F.col("file_path").alias("path")), "user_id").select("path", F.repeat(F.substring("event_type", 1, 1), F.lit(3000)).alias("reason"), F.col("event_id").alias("at")),
        )
    )(_wide(s, d)).select("id", "status", "failure_count", "failure_reason")
)
# every fourth file goes to the supplier of its number, if there is one
_GIVEN = "SELECT m.id, s_suppkey, s_name, s_nationkey FROM media_files m JOIN supplier ON m.id // 4 % 100 = s_suppkey WHERE m.id % 4 = 0"
_PLACED = {"assigned_node_name": "string", "assigned_node_ip": "string", "assigned_node_port": "int"}
_JOB = ["id", "status", "assigned_node_id", *_PLACED, "remote_work_item_id", "remote_job_phase", "dispatched_device_id"]


def _placed(spark, d) -> DataFrame:
    """The library with the columns of assignments."""
    return _wide(spark, d).withColumns({c: F.lit(None).cast(t) for c, t in _PLACED.items()})


query(
    "assign_jobs",
    f"""SELECT m.id, CASE WHEN h THEN 'Processing' ELSE status END AS status, CASE WHEN h THEN concat('node-', s_suppkey) ELSE assigned_node_id END AS assigned_node_id, s_name AS assigned_node_name, CASE WHEN h THEN concat('10.0.0.', s_nationkey) END AS assigned_node_ip,
CAST(CASE WHEN h THEN 5000 + s_nationkey END AS INT) AS assigned_node_port, CASE WHEN h THEN concat('job-', m.id) ELSE remote_work_item_id END AS remote_work_item_id, CASE WHEN h THEN 'Uploading' ELSE remote_job_phase END AS remote_job_phase,
CASE WHEN h AND m.id % 8 = 0 THEN 'intel' ELSE dispatched_device_id END AS dispatched_device_id FROM (SELECT {_WIDE} FROM media_files) m LEFT JOIN (SELECT *, TRUE AS h FROM ({_GIVEN})) g ON g.id = m.id""",
)(
    lambda s, d: (
        lambda m: scan.assign(
            m,
            m.where("id % 4 = 0").join(F.broadcast(table(s, d, "supplier").where("s_suppkey < 100")), F.expr("id div 4 % 100 = s_suppkey")).selectExpr(
                "file_path as path", "concat('job-', id) as job_id", "concat('node-', s_suppkey) as node_id", "s_name as node_name", "concat('10.0.0.', s_nationkey) as node_ip", "cast(5000 + s_nationkey as int) as node_port", "'Uploading' as phase", "if(id % 8 = 0, 'intel', '') as device_id"
            ),
        )
    )(_placed(s, d)).select(*_JOB)
)
query(
    "remote_changes",
    f"""SELECT id, status, CASE WHEN id % 2 = 0 THEN 'Downloading' ELSE remote_job_phase END AS remote_job_phase, CASE WHEN id % 10 <> 0 THEN remote_work_item_id END AS remote_work_item_id, CAST(remote_failure_count + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS remote_failure_count
FROM (SELECT {_WIDE} FROM media_files)""",
)(
    lambda s, d: (
        lambda m: scan.set_remote(m, m.where("id % 2 = 0 or id % 5 = 0").selectExpr("file_path as path", "if(id % 2 = 0, 'Downloading', null) as phase", "id % 10 = 0 as forget", "if(id % 5 = 0, 1, 0) as failures"))
    )(_wide(s, d)).select("id", "status", "remote_job_phase", "remote_work_item_id", "remote_failure_count")
)
query(
    "verify_results",
    f"""SELECT m.id, CASE WHEN s.path IS NULL THEN last_verified_at ELSE {_AT} END AS last_verified_at, CASE WHEN s.path IS NULL THEN last_verify_result WHEN s.size = m.file_size THEN 'ok' ELSE concat('size ', s.size) END AS last_verify_result
FROM media_files m LEFT JOIN scan s ON s.path = m.file_path""",
)(
    lambda s, d: (
        lambda m: scan.set_verified(m, view(s, d, "scan").join(m.select(F.col("file_path").alias("path"), "file_size"), "path").select("path", F.when(F.col("size") == F.col("file_size"), "ok").otherwise(F.concat(F.lit("size "), "size")).alias("result")), _now())
    )(view(s, d, "media_files")).select("id", "last_verified_at", "last_verify_result")
)

# deletions

query("delete_paths", "SELECT id FROM media_files WHERE file_path NOT IN (SELECT path FROM scan WHERE size % 2 = 0)")(lambda s, d: scan.delete_paths(view(s, d, "media_files"), view(s, d, "scan").where("size % 2 = 0").select("path")).select("id"))
query(
    "delete_old_transitions",
    """SELECT event_id AS id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-20' - INTERVAL '24' HOUR ORDER BY ts, event_id LIMIT 1000)""",
)(
    lambda s, d: scan.without_old_transitions(table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), (F.col("event_type") == "purchase").alias("completed")), F.lit("2024-01-20").cast("timestamp_ntz")).select("id")
)

# lookups

query("lookup_path", "SELECT id, file_path FROM media_files WHERE file_path = (SELECT min(file_path) FROM media_files)")(
    lambda s, d: (lambda m: library.by_path(m, m.agg(F.min("file_path")).scalar()).select("id", "file_path"))(view(s, d, "media_files"))
)
query("lookup_title", "SELECT id, file_path FROM media_files WHERE (directory, base_name) = (SELECT (directory, base_name) FROM media_files ORDER BY directory, base_name LIMIT 1)")(
    lambda s, d: (lambda m: library.by_title(m, m.agg(F.min("directory")).scalar(), m.agg(F.min(F.struct("directory", "base_name"))["base_name"]).scalar()).select("id", "file_path"))(view(s, d, "media_files"))
)
query("lookup_remote_id", f"SELECT id, remote_work_item_id FROM (SELECT {_WIDE} FROM media_files) WHERE remote_work_item_id = (SELECT concat('w-', max(id)) FROM media_files WHERE id % 6 = 0)")(
    lambda s, d: (lambda m: library.by_remote_id(m, m.where("id % 6 = 0").agg(F.concat(F.lit("w-"), F.max("id"))).scalar()).select("id", "remote_work_item_id"))(_wide(s, d))
)

# the queue as the API gives it: what waits, then what is done, in the API's own order

query(
    "api_queue_page",
    f"""SELECT id, status FROM (SELECT id, status, 1 AS segment, -bitrate AS rank FROM media_files WHERE status = 'Queued' AND assigned_node_id IS NULL
UNION ALL SELECT id, s, 2, CASE s WHEN 'Completed' THEN 0 WHEN 'Failed' THEN 1 ELSE 3 END FROM (SELECT id, {_MIXED} AS s FROM media_files) WHERE s IN ('Completed', 'Failed', 'NoSavings')) ORDER BY segment, rank, id LIMIT 500 OFFSET 40""",
)(
    lambda s, d: (
        lambda m: queue.segments(
            m.where(F.lit(False)).select("id", "status", F.lit(0).cast("long").alias("rank")),
            queue.queued(m).select("id", "status", (-F.col("bitrate")).alias("rank")),
            m.where("status in ('Completed', 'Failed', 'NoSavings')").select("id", "status", queue.terminal_rank(dashboard=False).cast("long").alias("rank")),
            40,
            500,
        ).select("id", "status")
    )(_mixed(s, d))
)
query("silent_nodes", "SELECT node_id FROM (SELECT concat('node-', user_id) AS node_id, max(ts) AS last_heartbeat FROM events GROUP BY 1) WHERE last_heartbeat < (SELECT max(ts) FROM events) - INTERVAL '5' MINUTE")(
    lambda s, d: (
        lambda e: placement.silent(e.groupBy(F.concat(F.lit("node-"), "user_id").alias("node_id")).agg(F.max("ts").alias("last_heartbeat")), e.agg(F.max("ts")).scalar()).select("node_id")
    )(table(s, d, "events"))
)

# texts of the dashboard and the log

_UNITS = "CASE " + " ".join(f"WHEN b >= {1024**i} THEN {_DIGITS.format(f'(b / {1024**i}.0)')} || ' {u}'" for i, u in reversed(list(enumerate(M.DASHBOARD_UNITS)))) + " ELSE '0 B' END"
_LOGGED = "CASE " + " ".join(f"WHEN b >= {1024**i} THEN regexp_replace(printf('%.2f', round(b / {1024**i}.0, 2)), '\\.?0+$', '') || ' {u}'" for i, u in reversed(list(enumerate(M.LOG_UNITS)))) + " ELSE '0 Bytes' END"
_SIZED = "file_size * CAST(pow(40, id % 6) AS BIGINT) // CASE WHEN id % 6 = 0 THEN 1000 * (1 + id % 5) ELSE 1 END"
query(
    "display_texts",
    f"""SELECT id, {_UNITS} AS shown, {_LOGGED} AS logged, CASE WHEN t <= 0 THEN '0m' WHEN t < 3600 THEN (t // 60) || 'm' WHEN t < 360000 THEN (t // 3600) || 'h ' || (t // 60 % 60) || 'm' ELSE (t // 3600) || 'h' END AS took,
CASE WHEN a < 60 THEN a || 's ago' WHEN a < 3600 THEN (a // 60) || 'm ago' WHEN a < 86400 THEN (a // 3600) || 'h ago' WHEN a < 604800 THEN (a // 86400) || 'd ago' ELSE strftime(CAST('{{now}}' AS TIMESTAMP) - to_seconds(a), '%-m/%-d/%Y') END AS since,
CASE WHEN duration = 0 OR t <= 0 THEN '—' WHEN duration / t < 10 THEN printf('%.1f', floor(duration / t * 10 + 0.5) / 10) || '×' ELSE CAST(floor(duration / t + 0.5) AS BIGINT) || '×' END AS speed,
CASE WHEN file_size <= 0 THEN '—' ELSE CAST(greatest(0, floor((file_size - bitrate * 1000) / file_size * 100 + 0.5)) AS BIGINT) || '%' END AS saved
FROM (SELECT *, CASE WHEN id % 35 = 0 THEN 0 ELSE {_SIZED} END AS b, CAST(id % 11 * id % 500000 AS BIGINT) AS t, CAST(id * id % 1000000 AS BIGINT) AS a FROM media_files)""".replace("{now}", "2001-10-15 12:00:00"),
)(
    lambda s, d: view(s, d, "media_files")
    .withColumn("b", F.expr("if(id % 35 = 0, 0, file_size * cast(pow(40, id % 6) as bigint) div if(id % 6 = 0, 1000 * (1 + id % 5), 1))"))
    .withColumn("t", F.expr("cast(id % 11 * id % 500000 as bigint)"))
    .withColumn("time", _now() - F.make_dt_interval(secs=F.expr("cast(id * id % 1000000 as decimal(18, 6))")))
    .select(
        "id",
        M.display_bytes(F.col("b")).alias("shown"),
        M.log_bytes(F.col("b")).alias("logged"),
        M.hours_minutes(F.col("t")).alias("took"),
        M.ago(F.col("time"), _now()).alias("since"),
        M.realtime(F.col("duration"), F.col("t")).alias("speed"),
        M.saved_share(F.col("file_size"), F.col("bitrate") * 1000).alias("saved"),
    )
)

# texts of files

_STAMP = "printf('%02d:%02d:%02d,{1}', {0} // 3600, {0} // 60 % 60, {0} % 60)"
query(
    "srt_parsed",
    f"""SELECT conv_id, turn, {_STAMP.format('turn * 2', '000')} AS "start", {_STAMP.format('(turn * 2 + 1)', '500')} AS "end", text
FROM (SELECT DISTINCT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations) WHERE text <> ''""",
)(
    lambda s, d: FS.srt(
        table(s, d, "conversations").select("conv_id", (F.col("turn") * 2000).alias("start_ms"), (F.col("turn") * 2000 + 1500).alias("end_ms"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")).where("text <> ''").distinct(), "conv_id"
    )
    .select("conv_id", F.explode(FS.parse_srt(F.col("srt"))).alias("cue"))
    .select("conv_id", F.expr("(cast(split(cue.start, '[:,]')[0] as bigint) * 3600 + cast(split(cue.start, '[:,]')[1] as bigint) * 60 + cast(split(cue.start, '[:,]')[2] as bigint)) div 2").alias("turn"), "cue.start", "cue.end", "cue.text")
)
