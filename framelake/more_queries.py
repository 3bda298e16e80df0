"""More queries of the library: probes, logs, changes of state, slots, audio plans. Each has DuckDB SQL that computes the
same rows from the tables' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions import codec as C
from framelake.functions import language as L
from framelake.functions import media as M
from framelake.operators import decision as D
from framelake.operators import ledger, library, placement, queue, scan
from framelake.operators import streams as A
from framelake.queries import NOW, WANTED, _from, query, view
from framelake.sources import files as FS
from framelake.sources.adapters import table

# probes

_PROBE = """concat('{"streams":[{"index":0,"codec_type":"video","codec_name":"', codec, '","duration":"', CAST(duration AS STRING), '.5","color_transfer":',
CASE WHEN is_hdr THEN '"SMPTE2084"' ELSE 'null' END, ',"color_primaries":', CASE WHEN id % 5 = 0 THEN '"BT2020"' ELSE 'null' END,
'},{"index":1,"codec_type":"audio","codec_name":"aac","channels":2,"bit_rate":"', CAST(id % 3 * 64000 AS STRING),
'","tags":{"language":"eng","title":"Main"}},{"index":2,"codec_type":"subtitle","codec_name":"subrip","tags":{"language":"fre","title":"', CASE WHEN id % 4 = 0 THEN 'VF SDH' ELSE 'VF' END,
'"}}],"format":{"duration":"', CAST(duration + id % 2 AS STRING), '","bit_rate":"', CAST(bitrate * 1000 AS STRING), '"}}')"""


def _probed(spark, d) -> DataFrame:
    m = view(spark, d, "media_files").selectExpr("*", f"case when id % 11 = 0 then 'broken{{' else {_PROBE} end as text")
    return m.withColumn("p", FS.probe(F.col("text")))


query(
    "probe_facts",
    """SELECT id, CASE WHEN id % 11 = 0 THEN 0 ELSE greatest(duration + id % 2, duration + 0.5) END AS seconds,
CASE WHEN id % 11 = 0 THEN 0 WHEN id % 3 > 0 THEN id % 3 * 64 ELSE bitrate END AS kbps,
CASE WHEN id % 11 <> 0 THEN is_hdr OR id % 5 = 0 END AS any_hdr, CASE WHEN id % 11 = 0 THEN FALSE ELSE is_hdr END AS first_hdr FROM media_files""",
)(
    lambda s, d: _probed(s, d).select(
        "id",
        FS.best_duration(F.col("p")).alias("seconds"),
        FS.source_kbps(F.col("p")).alias("kbps"),
        M.hdr_any(F.col("p.streams")).alias("any_hdr"),
        M.hdr_first(F.col("p.streams")).alias("first_hdr"),
    )
)


@query(
    "stream_summaries",
    f"""SELECT id, array_to_string([concat_ws(':', x.tags.language, x.codec_name, CAST(x.channels AS VARCHAR), x.tags.title) for x in s if x.codec_type = 'audio'], ',') AS audio,
array_to_string([concat_ws(':', x.tags.language, x.codec_name, CASE WHEN regexp_matches(x.tags.title, '(?i)\\bsdh\\b') THEN 'true' ELSE 'false' END) for x in s if x.codec_type = 'subtitle'], ',') AS subtitles
FROM (SELECT id, CASE WHEN json_valid(text) THEN from_json(json_extract(text, '$.streams'), '[{{"codec_type":"VARCHAR","codec_name":"VARCHAR","channels":"INTEGER","tags":{{"language":"VARCHAR","title":"VARCHAR"}}}}]') END AS s
FROM (SELECT id, CASE WHEN id % 11 = 0 THEN 'broken{{' ELSE {_PROBE} END AS text FROM media_files))""",
)
def _summaries(spark, d):
    audio, subtitles = A.summaries(F.col("p.streams"))
    rows = _probed(spark, d).select("id", audio.alias("a"), subtitles.alias("b"))  # nothing is known of broken ones
    texts = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[n].cast("string") for n in names])), ",")
    return rows.select("id", texts("a", "l", "c", "ch", "t").alias("audio"), texts("b", "l", "c", "s").alias("subtitles"))


# logs, settings, scalars

_DAMAGE = "CASE WHEN event_id % 3 = 0 THEN 'Application provided invalid, NON monotonically increasing dts to muxer in stream 0' ELSE event_type END"
query("benign_lines", f"SELECT event_id, event_id % 3 = 0 AS benign FROM events")(
    lambda s, d: table(s, d, "events").selectExpr("event_id", f"{_DAMAGE} as line").select("event_id", FS.benign(F.col("line")).alias("benign"))
)
query("expired_logs", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-21 00:00:00' AND event_id % 10 <> 0")(
    lambda s, d: FS.expired_logs(
        table(s, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("modified_at"), F.concat(F.when(F.col("event_id") % 10 == 0, "current-").otherwise("job-"), "event_id").alias("name")),
        F.lit("2024-01-31").cast("timestamp_ntz"),
        10,
    ).select("event_id")
)
query(
    "black_seconds",
    "SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 4 * 0.5 + CASE WHEN event_id % 2 = 0 THEN 0.25 ELSE 0 END END AS DOUBLE) AS seconds FROM events",
)(
    lambda s, d: table(s, d, "events").selectExpr(
        "event_id",
        """case when event_id % 4 = 0 then 'no blackness' else concat('[black] black_start:1 black_duration:', cast(event_id % 4 * 0.5 as string), case when event_id % 2 = 0 then '\\n black_duration: 0.25 black_duration:.' else '' end) end as log""",
    ).select("event_id", FS.black_seconds(F.col("log")).alias("seconds"))
)
query("watched_folders", "SELECT root, root AS first, concat(root, '/x') AS second FROM folders")(
    lambda s, d: view(s, d, "folders").withColumn("w", FS.watched_folders(F.concat(F.lit('["'), "root", F.lit('",{"path":"'), "root", F.lit('/x","policy":"Off"}]')))).select("root", F.col("w")[0].alias("first"), F.col("w")[1].alias("second"))
)
query("original_languages", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) END AS language FROM nation")(
    lambda s, d: table(s, d, "nation").selectExpr(
        "n_nationkey",
        """case n_nationkey % 3 when 0 then concat('{"originalLanguage":{"id":1,"name":"', n_name, '"}}') when 1 then concat('{"originalLanguage":"', lower(n_name), '"}') else '{}' end as entry""",
    ).select("n_nationkey", FS.original_language(F.col("entry")).alias("language"))
)
# three digits at least, halves up: quotients by powers of two are exact
_DIGITS = "CASE WHEN {0} < 10 THEN printf('%.2f', round({0}, 2)) WHEN {0} < 100 THEN printf('%.1f', round({0}, 1)) ELSE CAST(CAST(round({0}) AS BIGINT) AS VARCHAR) END"
query(
    "media_scalars",
    f"""SELECT id, CASE id % 5 WHEN 0 THEN 2160 WHEN 1 THEN 1440 WHEN 2 THEN 720 WHEN 3 THEN 480 ELSE 1080 END AS height, CAST(id * 3003 // 90 AS BIGINT) AS ms,
CASE WHEN id % 7 = 0 THEN -100 ELSE greatest(1, 100 - id % 12 * 10) END AS music_score, CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN greatest(0, CAST(id % 6 AS INT) - 2) ELSE 4 END AS cap,
CASE WHEN file_size >= 1073741824 THEN {_DIGITS.format('file_size / 1073741824.0')} || ' GB' WHEN file_size >= 1048576 THEN {_DIGITS.format('file_size / 1048576.0')} || ' MB' WHEN file_size >= 1024 THEN {_DIGITS.format('file_size / 1024.0')} || ' KB' ELSE {_DIGITS.format('file_size / 1.0')} || ' B' END AS shown FROM media_files""",
)(
    lambda s, d: view(s, d, "media_files").select(
        "id",
        M.downscale_height(F.element_at(F.array(*[F.lit(x) for x in ("4K", "1440p", "720p", "480p", "8K")]), (F.col("id") % 5 + 1).cast("int"))).alias("height"),
        FS.pts_ms(F.col("id") * 3003).alias("ms"),
        placement.music_score((F.col("id") % 12).cast("int"), F.col("id") % 7 != 0).alias("music_score"),
        placement.capacity(F.element_at(F.array(F.lit("cpu"), F.lit("nvidia"), F.lit("intel")), (F.col("id") % 3 + 1).cast("int")), F.lit(4), F.when(F.col("id") % 3 == 1, (F.col("id") % 6).cast("int") - 2)).alias("cap"),
        M.display_bytes(F.col("file_size")).alias("shown"),
    )
)
query("targets_met", """SELECT id, codec = 'av1' AS av1, codec = 'av1' OR is_hevc AS h265, codec IN ('av1', 'h264') OR is_hevc AS h264 FROM media_files""")(
    lambda s, d: view(s, d, "media_files").select("id", *[C.meets_target(F.col("codec"), F.col("is_hevc"), e).alias(n) for n, e in (("av1", "libsvtav1"), ("h265", "hevc_x265"), ("h264", "libx264"))])
)
query("codec_fallback", "SELECT DISTINCT codec, id % 16 = 3 AS hevc, CASE WHEN codec = 'hevc' THEN 'h265' WHEN codec <> '' THEN codec WHEN id % 16 = 3 THEN 'h265' ELSE 'unknown' END AS label FROM media_files")(
    lambda s, d: view(s, d, "media_files").select("codec", (F.col("id") % 16 == 3).alias("hevc"), C.source_label(F.col("codec"), F.col("id") % 16 == 3).alias("label")).distinct()
)
_STATES = ("Pending", "Processing", "Uploading", "Downloading", "NoSavings", "Completed", "Failed")
query(
    "state_labels",
    """SELECT DISTINCT i AS state, CASE i WHEN 0 THEN 'Queued' WHEN 1 THEN 'Processing' WHEN 2 THEN 'Processing' WHEN 3 THEN 'Processing' WHEN 4 THEN 'No Savings' WHEN 5 THEN 'Completed' ELSE 'Failed' END AS label
FROM (SELECT id % 7 AS i FROM media_files)""",
)(
    lambda s, d: view(s, d, "media_files").select((F.col("id") % 7).alias("state")).distinct().select("state", D.decision_label(F.element_at(F.array(*[F.lit(x) for x in _STATES]), (F.col("state") + 1).cast("int"))).alias("label"))
)
query(
    "language_order",
    """SELECT id, a <> b AND a IN (1, 2) AND b IN (1, 2) AND a = 2 AS reorder FROM (SELECT id, id % 4 AS a, id // 4 % 4 AS b FROM media_files)""",
)(
    lambda s, d: view(s, d, "media_files").withColumn("names", F.array(*[F.lit(x) for x in ("fre", "ENG", "jpn", "ger")])).select(
        "id",
        L.would_reorder(F.array(*[F.element_at("names", (x % 4 + 1).cast("int")) for x in (F.col("id"), F.floor(F.col("id") / 4))]), ["en", "ja"]).alias("reorder"),
    )
)
query(
    "job_rows_1024",
    """SELECT job_key, line_no, part_key, node_key, original_size_bytes, completed_at, n AS no_savings, CASE WHEN n THEN 0 ELSE greatest(0, original_size_bytes - encoded_size_bytes) END AS saved,
CASE WHEN duration_seconds > 0 THEN CAST(floor(original_size_bytes * 8 / 1024 / duration_seconds) AS BIGINT) ELSE 0 END AS original_kbps,
CASE WHEN n OR duration_seconds <= 0 THEN 0 ELSE CAST(floor(encoded_size_bytes * 8 / 1024 / duration_seconds) AS BIGINT) END AS encoded_kbps
FROM (SELECT *, encoded_size_bytes = 0 AS n FROM encode_history)""",
)(_from(ledger.job_row, "encode_history", kilo=1024, always_keep=True))

query(
    "best_qualities",
    """SELECT id, coalesce(min(q) FILTER (k <= floor(2000 * 1.25)), arg_min(q, (abs(k - 2000), q))) AS quality FROM (
SELECT id, q, CAST(bitrate + (30 - q) * (id % 7) * 60 AS BIGINT) AS k FROM media_files, (VALUES (18), (24), (30), (36)) v(q)) GROUP BY id""",
)(
    lambda s, d: view(s, d, "media_files").select(
        "id",
        M.best_tested(F.transform(F.array(*[F.lit(q) for q in (18, 24, 30, 36)]), lambda q: F.struct(q.alias("quality"), (F.col("bitrate") + (30 - q) * (F.col("id") % 7) * 60).cast("long").alias("kbps"))), F.lit(2000), 0.25).alias("quality"),
    )
)
query("active_order", "SELECT id, CASE id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS rank FROM media_files ORDER BY rank, bitrate DESC, id LIMIT 700")(
    lambda s, d: view(s, d, "media_files").withColumn("status", F.element_at(F.array(*[F.lit(x) for x in ("Processing", "Uploading", "Downloading", "Queued", "Failed")]), (F.col("id") % 5 + 1).cast("int")))
    .withColumn("rank", queue.active_rank()).orderBy("rank", F.desc("bitrate"), "id").limit(700).select("id", "rank")
)

# workers

query(
    "worker_problems",
    """SELECT id, CASE WHEN id % 7 = 0 THEN 'protocol not supported' WHEN id % 7 = 1 THEN 'blocked: bitrate missing' WHEN id % 4 = 0 THEN 'skip must not be dispatched' WHEN id % 4 = 1 THEN 'mux plan needs mux options' WHEN id % 4 = 2 THEN NULL
WHEN id % 5 = 0 THEN 'profile missing' WHEN id % 5 = 1 THEN 'profile mismatch' WHEN id % 3 = 0 THEN 'encoder mismatch' END AS problem FROM media_files""",
)(
    lambda s, d: view(s, d, "media_files").selectExpr(
        "id",
        """named_struct('protocol', case when id % 7 = 0 then 2 else 1 end, 'blocked', case when id % 7 = 1 then 'bitrate missing' end,
        'action', case id % 4 when 0 then 'skip' when 1 then 'mux_only' when 2 then 'use_simple' else 'transcode_with_profile' end, 'profile_id', case when id % 5 = 1 then 'p9' else 'p1' end,
        'resolved_id', case when id % 5 <> 0 then 'p1' end, 'encoder', 'LIBX265', 'profile_encoder', case when id % 3 = 0 then 'libsvtav1' else 'libx265' end) as plan""",
    ).select("id", D.worker_problem(F.col("plan"), D.Options(encoder="libx265")).alias("problem"))
)

# lookups and pages

query("lookup_id", "SELECT id, file_path FROM media_files WHERE id = 7")(lambda s, d: library.by_id(view(s, d, "media_files"), 7).select("id", "file_path"))
query("keyset_page", "SELECT id, file_path FROM media_files WHERE id > 300 AND status IN ('Queued', 'Skipped') ORDER BY id LIMIT 40")(
    lambda s, d: queue.page_after(view(s, d, "media_files"), 300, 40, ("Queued", "Skipped")).select("id", "file_path")
)
query("capped_result", "SELECT id, (SELECT count(*) FROM media_files WHERE status = 'Failed') AS total FROM media_files WHERE status = 'Failed' QUALIFY count(*) OVER () <= 30 OR row_number() OVER (ORDER BY id) <= 20")(
    lambda s, d: queue.capped(view(s, d, "media_files").where("status = 'Failed'").select("id"), [F.col("id")], most=30, keep=20)
)
query("status_unions", "SELECT id, 'work' AS part FROM media_files WHERE status IN ('Queued', 'Processing') UNION ALL SELECT id, 'open' FROM media_files WHERE status IN ('Skipped', 'Unseen', 'Queued')")(
    lambda s, d: (lambda m: m.where("status in ('Queued', 'Processing')").select("id", F.lit("work").alias("part")).unionByName(m.where("status in ('Skipped', 'Unseen', 'Queued')").select("id", F.lit("open").alias("part"))))(view(s, d, "media_files"))
)
query("first_local", f"SELECT id FROM media_files WHERE status = 'Queued' AND kind = 'Video' AND id % 5 <> 3 AND id % 4 <> 2 ORDER BY bitrate DESC, id LIMIT 1")(
    lambda s, d: (lambda m: placement.first_local(m.where("status = 'Queued'").select("id", "kind", F.lit("Pending").alias("status"), (-F.col("bitrate")).alias("place")), m.where("id % 5 = 3").select("id"), F.col("id") % 4 == 2))(view(s, d, "media_files")).select("id")
)

# changes of state

_WIDE = """*, case when id % 3 = 0 then 'bad frame' end as failure_reason, case when id % 2 = 0 then created_at end as completed_at, case when id % 5 = 0 then created_at end as last_encoded_at,
case when id % 6 = 0 then concat('w-', cast(id as string)) end as remote_work_item_id, case when id % 6 = 0 then 'Encoding' end as remote_job_phase, case when id % 6 = 0 then 'nvidia' end as dispatched_device_id, cast(id % 4 as int) as remote_failure_count"""
_AT = f"CAST('{NOW}' AS TIMESTAMP)"


def _wide(spark, d) -> DataFrame:
    return view(spark, d, "media_files").selectExpr(*[x for x in _split(_WIDE)])


def _split(text: str) -> list[str]:
    """Columns of a select list, parted by the commas outside parentheses."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


query(
    "set_state",
    f"""SELECT id, CASE WHEN id % 4 = 0 THEN 'Completed' WHEN id % 4 = 1 THEN 'Failed' ELSE status END AS status, CASE WHEN id % 4 = 1 AND id % 8 <> 1 THEN 'probe' ELSE failure_reason END AS failure_reason,
CASE WHEN id % 4 = 0 THEN {_AT} ELSE completed_at END AS completed_at, CASE WHEN id % 4 IN (0, 1) AND id % 8 IN (0, 1) THEN {_AT} ELSE last_encoded_at END AS last_encoded_at,
force_mux AND NOT (id % 4 IN (0, 1) AND id % 8 IN (0, 1)) AS force_mux FROM (SELECT {_WIDE} FROM media_files)""",
)(
    lambda s, d: (
        lambda m: scan.set_state(
            m,
            m.where("id % 4 < 2").selectExpr("file_path as path", "case when id % 4 = 0 then 'Completed' else 'Failed' end as new_status", "case when id % 4 = 1 then 'probe' end as reason", "id % 8 in (0, 1) as encoded"),
            _now(),
        )
    )(_wide(s, d)).select("id", "status", "failure_reason", "completed_at", "last_encoded_at", "force_mux")
)
query("guarded_flip", "SELECT id, CASE WHEN id % 2 = 0 AND status IN ('Queued', 'Skipped') THEN 'Unseen' ELSE status END AS status FROM media_files")(
    lambda s, d: scan.flip(view(s, d, "media_files"), F.col("id") % 2 == 0, ("Queued", "Skipped"), "Unseen").select("id", "status")
)
_RESET = ["id", "status", "priority", "failure_count", "failure_reason", "completed_at", "assigned_node_id", "remote_work_item_id", "remote_job_phase", "dispatched_device_id", "remote_failure_count"]
query(
    "reset_all",
    """SELECT id, 'Unseen' AS status, priority, 0 AS failure_count, CAST(NULL AS VARCHAR) AS failure_reason, CAST(NULL AS TIMESTAMP) AS completed_at, CAST(NULL AS VARCHAR) AS assigned_node_id,
CAST(NULL AS VARCHAR) AS remote_work_item_id, CAST(NULL AS VARCHAR) AS remote_job_phase, CAST(NULL AS VARCHAR) AS dispatched_device_id, 0 AS remote_failure_count FROM media_files""",
)(lambda s, d: scan.reset_all(_wide(s, d)).select(*_RESET))
query(
    "reset_file",
    f"SELECT id, CASE WHEN id % 9 = 0 THEN 'Unseen' ELSE status END AS status, CASE WHEN id % 9 = 0 THEN 0 ELSE failure_count END AS failure_count, CASE WHEN id % 9 <> 0 THEN failure_reason END AS failure_reason, force_mux AND id % 9 <> 0 AS force_mux FROM (SELECT {_WIDE} FROM media_files)",
)(lambda s, d: scan.reset_file(_wide(s, d), F.col("id") % 9 == 0).select("id", "status", "failure_count", "failure_reason", "force_mux"))
_JOB = ["id", "status", "assigned_node_id", "remote_work_item_id", "remote_job_phase", "dispatched_device_id"]
query(
    "unassign_jobs",
    f"""SELECT id, CASE WHEN h THEN n ELSE status END AS status, CASE WHEN NOT h THEN assigned_node_id END AS assigned_node_id, CASE WHEN NOT h OR n = 'Queued' THEN remote_work_item_id END AS remote_work_item_id,
CASE WHEN NOT h THEN remote_job_phase END AS remote_job_phase, CASE WHEN NOT h THEN dispatched_device_id END AS dispatched_device_id, CASE WHEN h AND n IN ('Completed', 'NoSavings') THEN {_AT} ELSE last_encoded_at END AS last_encoded_at
FROM (SELECT {_WIDE}, id % 3 = 0 AS h, CASE id % 4 WHEN 0 THEN 'Queued' WHEN 1 THEN 'Completed' WHEN 2 THEN 'Failed' ELSE 'NoSavings' END AS n FROM media_files)""",
)(
    lambda s, d: (
        lambda m: scan.unassign(
            m, m.where("id % 3 = 0").selectExpr("file_path as path", "case id % 4 when 0 then 'Queued' when 1 then 'Completed' when 2 then 'Failed' else 'NoSavings' end as new_status"), _now()
        )
    )(_wide(s, d)).select(*_JOB, "last_encoded_at")
)

# slots as snapshots

_WISHES = "SELECT concat('wish-', CAST(id AS STRING)) AS job_id, concat('node-', CAST(id % 11 AS STRING)) AS node_id, CASE id % 4 WHEN 0 THEN 'cpu' WHEN 1 THEN 'nvidia' WHEN 2 THEN 'intel' ELSE '' END AS device_id, bitrate AS asked FROM media_files WHERE status = 'Queued'"
_CAPS = "SELECT concat('node-', CAST(s_suppkey AS STRING)) AS node_id, 'cpu' AS device_id, 3 AS cap FROM supplier UNION ALL SELECT concat('node-', CAST(s_suppkey AS STRING)), 'nvidia', 40 FROM supplier UNION ALL SELECT concat('node-', CAST(s_suppkey AS STRING)), 'intel', 0 FROM supplier"


def _sql(spark, d, text: str) -> DataFrame:
    for name in ("media_files", "supplier"):
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(text, **{n: view(spark, d, n) for n in ("media_files", "supplier") if f"{{{n}}}" in text})


query(
    "reserve_slots",
    f"""SELECT job_id, node_id, device_id, phase FROM slots UNION ALL SELECT job_id, node_id, device_id, 'Reserved' FROM (
SELECT w.*, c.cap - coalesce(u.used, 0) AS room, row_number() OVER (PARTITION BY w.node_id, w.device_id ORDER BY asked, w.job_id) AS turn FROM ({_WISHES}) w JOIN ({_CAPS}) c ON w.node_id = c.node_id AND w.device_id = c.device_id
LEFT JOIN (SELECT node_id, device_id, count(*) AS used FROM slots GROUP BY 1, 2) u ON u.node_id = w.node_id AND u.device_id = w.device_id) WHERE turn <= room""",
)(lambda s, d: placement.reserve(view(s, d, "slots"), _sql(s, d, _WISHES), _sql(s, d, _CAPS)).select("job_id", "node_id", "device_id", "phase"))
query("release_slots", "SELECT job_id, node_id FROM slots WHERE progress <= 50")(lambda s, d: (lambda t: placement.release(t, t.where("progress > 50")).select("job_id", "node_id"))(view(s, d, "slots")))
query(
    "rekey_slots",
    """SELECT CASE WHEN device_id = 'cpu' AND n NOT IN (SELECT job_id FROM slots) THEN n ELSE job_id END AS job_id, node_id FROM (SELECT *, CASE WHEN progress % 2 = 0 THEN concat(job_id, '-again') ELSE (SELECT min(job_id) FROM slots) END AS n FROM slots)""",
)(
    lambda s, d: (lambda t: placement.rekey(t, t.where("device_id = 'cpu'").join(F.broadcast(t.agg(F.min("job_id").alias("taken")))).select("job_id", F.when(F.col("progress") % 2 == 0, F.concat("job_id", F.lit("-again"))).otherwise(F.col("taken")).alias("new_id"))).select("job_id", "node_id"))(view(s, d, "slots"))
)

# pies

query("codec_pies", "SELECT CASE WHEN kind = 'Video' THEN 'video' ELSE 'audio' END AS pie, CASE WHEN encoded_codec = '' THEN 'unknown' ELSE encoded_codec END AS name, count(*) AS value FROM encode_history GROUP BY 1, 2")(_from(ledger.codec_pies, "encode_history"))
query("size_difference", "SELECT CAST(floor(sum(bytes_saved) / 1000000) AS BIGINT) AS size_diff_thousandths FROM encode_history")(_from(ledger.size_difference, "encode_history"))

# streams of a file

_AUDIO = """SELECT id, CAST(i - 1 AS INT) AS i, a[i].l AS l, a[i].c AS c, a[i].ch AS ch, a[i].t AS t FROM (SELECT id, a, unnest(generate_series(1, len(a))) AS i
FROM (SELECT id, CASE WHEN json_valid(audio_streams) THEN from_json(audio_streams, '[{"l":"VARCHAR","c":"VARCHAR","ch":"INTEGER","t":"VARCHAR"}]') END AS a FROM media_files))"""
query("language_counts", f"SELECT id, lower(coalesce(l, 'und')) AS language, CAST(count(*) AS INT) AS tracks FROM ({_AUDIO}) GROUP BY 1, 2")(
    lambda s, d: view(s, d, "media_files").select("id", F.explode(A.language_counts(A.audio(F.col("audio_streams")))).alias("n")).select("id", "n.*")
)
#: Buckets by tag without commentaries (all tracks in one bucket if only those are there), the outputs held against each
#: bucket's tracks, and what is left; for outputs (aac, stereo, 192) and (opus, 5.1, 256).
_PLANNED = f"""WITH audio AS ({_AUDIO}), real AS (SELECT *, coalesce(contains(lower(t), 'comm'), FALSE) AS comm FROM audio), alone AS (SELECT id FROM real GROUP BY id HAVING bool_and(comm)),
sources AS (SELECT r.*, CASE WHEN a.id IS NULL THEN lower(coalesce(l, 'und')) ELSE 'und' END AS bucket, a.id IS NOT NULL AS kept FROM real r LEFT JOIN alone a ON a.id = r.id WHERE NOT comm OR a.id IS NOT NULL),
places AS (SELECT id, bucket, bool_or(kept) AS kept, min(i) AS place FROM sources GROUP BY 1, 2), outputs(o, codec, n, kbps) AS (VALUES (1, 'aac', 2, 192), (2, 'opus', 6, 256)),
same AS (SELECT s.id, s.bucket, o.o, arg_max(s.i, (s.ch, -s.i)) AS i FROM sources s JOIN outputs o ON lower(s.c) = o.codec AND s.ch = o.n GROUP BY ALL),
fit AS (SELECT s.id, s.bucket, o.o, any_value(o.codec) AS codec, any_value(o.n) AS n, any_value(o.kbps) AS kbps,
  arg_max(s.i, (s.ch, CASE WHEN s.c IN ('dts', 'dtshd') THEN 3 WHEN s.c IN ('ac3', 'eac3') THEN 2 WHEN s.c IN ('aac', 'opus', 'mp3', 'vorbis') THEN 1 ELSE 0 END, -s.i)) AS i
  FROM sources s JOIN outputs o ON s.ch >= o.n WHERE NOT EXISTS (SELECT 1 FROM same x WHERE x.id = s.id AND x.bucket = s.bucket AND x.o = o.o) GROUP BY ALL),
copies AS (SELECT DISTINCT s.id, s.bucket, s.i FROM sources s JOIN places p ON p.id = s.id AND p.bucket = s.bucket WHERE {{keep}} OR p.kept OR EXISTS (SELECT 1 FROM same x WHERE x.id = s.id AND x.bucket = s.bucket AND x.i = s.i)
  UNION SELECT id, bucket, arg_max(i, (ch, -i)) FROM sources s WHERE NOT EXISTS (SELECT 1 FROM same x WHERE x.id = s.id AND x.bucket = s.bucket) AND NOT EXISTS (SELECT 1 FROM fit x WHERE x.id = s.id AND x.bucket = s.bucket) AND NOT {{keep}} GROUP BY 1, 2),
steps AS (SELECT c.id, c.bucket, 0 AS part, c.i AS at, 'copy' AS action, c.i AS source, s.c AS codec, s.ch AS channels, 0 AS kbps FROM copies c JOIN sources s ON s.id = c.id AND s.i = c.i
  UNION ALL SELECT id, bucket, 1, o, 'encode', i, codec, n, kbps FROM fit)
SELECT s.id, CAST(row_number() OVER (PARTITION BY s.id ORDER BY p.place, s.part, s.at) - 1 AS INT) AS output, s.bucket, s.action, s.source, s.codec, s.channels, s.kbps FROM steps s JOIN places p ON p.id = s.id AND p.bucket = s.bucket"""
_OUTPUTS = (A.AudioOutput("aac", "stereo"), A.AudioOutput("opus", "5.1", 256))


def _plan(keep: bool):
    options = A.StreamOptions(audio_outputs=_OUTPUTS, preserve_original_audio=keep)
    return lambda s, d: view(s, d, "media_files").select("id", F.explode(A.audio_plan(A.audio(F.col("audio_streams")), options)).alias("p")).select("id", "p.*")


def _inner_with(sql: str) -> str:
    return f"SELECT * FROM ({sql})"


query("audio_plan", _inner_with(_PLANNED.replace("{keep}", "TRUE")))(_plan(True))
query("audio_plan_outputs", _inner_with(_PLANNED.replace("{keep}", "FALSE")))(_plan(False))
query(
    "sidecars",
    """SELECT id, coalesce(string_agg(CAST(i - 1 AS VARCHAR), ',' ORDER BY i), '') AS indexes FROM (SELECT id, b, unnest(CASE WHEN len(b) > 0 THEN generate_series(1, len(b)) ELSE [NULL] END) AS i FROM (
SELECT id, CASE WHEN json_valid(subtitle_streams) THEN from_json(subtitle_streams, '[{"l":"VARCHAR","c":"VARCHAR","t":"VARCHAR","s":"BOOLEAN"}]') ELSE [] END AS b FROM (SELECT id, coalesce(subtitle_streams, '[]') AS subtitle_streams FROM media_files)))
WHERE i IS NULL OR (b[i].c NOT IN ('hdmv_pgs_subtitle') AND (b[i].l = 'eng' OR (b[i].l = 'und' AND b[i].t LIKE 'English%')) AND NOT b[i].s) GROUP BY id
UNION ALL SELECT id, '' FROM media_files WHERE id % 10 IN (2, 3)""",
)(lambda s, d: view(s, d, "media_files").select("id", F.array_join(A.sidecars(A.subtitles(F.col("subtitle_streams")), WANTED).cast("array<string>"), ",").alias("indexes")))


def _kept(spark, d) -> DataFrame:
    m = view(spark, d, "media_files").withColumn("a", A.audio(F.col("audio_streams")))
    count = None
    for original in ("ja", "en", None):  # the languages that the library has
        wanted = list(A.with_original(("en",), original))
        n = F.size(F.filter("a", lambda x: L.matches(x["l"], x["t"], wanted)))  # noqa: B023
        count = n if count is None else F.when(F.col("original_language").eqNullSafe(F.lit(original)), n).otherwise(count)
    return m.select("id", count.alias("kept"))


query(
    "kept_tracks",
    f"""SELECT m.id, CAST(count(a.id) FILTER (lower(a.l) = 'eng' OR (a.l IS NULL AND a.t = 'English') OR (a.l = 'jpn' AND m.original_language = 'ja')) AS INT) AS kept
FROM media_files m LEFT JOIN ({_AUDIO}) a ON a.id = m.id GROUP BY 1""",
)(_kept)

from framelake import change_queries  # noqa: E402, F401  and these
