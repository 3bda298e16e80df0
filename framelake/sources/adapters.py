"""The media-library model over the tables at hand: one text for Spark and for DuckDB.

`encode_history` is the ledger of finished jobs, `media_files` the library; smaller views stand for nodes, devices,
slots, watched folders and scans. Sizes and durations are integers, so that sums don't depend on their order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The fixed clock of all reports: a day inside the ledger, so that some rows lie in its future.
NOW = "2001-10-15 12:00:00"

ENCODE_HISTORY = """
SELECT l_orderkey AS job_key, l_linenumber AS line_no, l_partkey AS part_key, l_suppkey AS node_key,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS original_size_bytes,
  CASE WHEN l_returnflag = 'R' THEN CAST(0 AS BIGINT)
       ELSE CAST(floor(round(l_extendedprice * 100) * (100 - round(l_discount * 100)) / 100) AS BIGINT) END AS encoded_size_bytes,
  CASE WHEN l_returnflag = 'R' THEN CAST(0 AS BIGINT)
       ELSE CAST(round(l_extendedprice * 100) AS BIGINT) - CAST(floor(round(l_extendedprice * 100) * (100 - round(l_discount * 100)) / 100) AS BIGINT) END AS bytes_saved,
  CAST(l_quantity AS BIGINT) AS duration_seconds,
  CAST(l_quantity * (1 + round(l_tax * 100)) AS BIGINT) AS encode_seconds,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS device_id,
  CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 9 = 1 THEN 'unknown' ELSE p_type END AS encoded_codec,
  s_name AS node_hostname, CAST(l_suppkey AS STRING) AS node_id,
  CASE WHEN l_linestatus = 'F' THEN 'Video' ELSE 'Music' END AS kind,
  l_quantity > 40 AS is_4k,
  CASE WHEN l_returnflag = 'R' THEN 'NoSavings' ELSE 'Completed' END AS outcome,
  l_shipdate AS completed_at,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE concat('profile-', CAST(l_suppkey % 4 AS STRING)) END AS profile_name,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE concat('p', CAST(l_suppkey % 12 AS STRING)) END AS profile_id,
  l_suppkey % 3 = 0 AS was_remote
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
"""

MEDIA_FILES = """
SELECT f.*, concat(directory, '/', file_name) AS file_path
FROM (
SELECT o_orderkey AS id,
  lower(concat('/media/', r_name, '/', n_name, '/', c_mktsegment)) AS directory,
  concat(CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 5 = 0 THEN '.flac' ELSE '.mkv' END) AS file_name,
  CAST(o_orderkey AS STRING) AS base_name,
  CAST(round(o_totalprice * 100) AS BIGINT) AS file_size,
  CAST(floor(o_totalprice / 50) AS BIGINT) AS bitrate,
  CASE WHEN o_orderkey % 5 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'flac' WHEN 1 THEN 'mp3' ELSE 'aac' END
       ELSE CASE o_orderkey % 8 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' WHEN 2 THEN 'av1' WHEN 3 THEN '' WHEN 4 THEN 'mpeg2video' WHEN 6 THEN 'hevc' ELSE 'h264' END END AS codec,
  CAST(CASE o_orderkey % 7 WHEN 0 THEN 3840 WHEN 1 THEN 1920 WHEN 2 THEN 1280 WHEN 3 THEN 720 WHEN 4 THEN 0 WHEN 5 THEN 2560 ELSE 1920 END AS INT) AS width,
  CAST(CASE o_orderkey % 7 WHEN 0 THEN 2160 WHEN 1 THEN 1080 WHEN 2 THEN 720 WHEN 3 THEN 480 WHEN 4 THEN 0 WHEN 5 THEN 1440 ELSE 800 END AS INT) AS height,
  CASE o_orderkey % 6 WHEN 0 THEN 'yuv420p' WHEN 1 THEN 'yuv420p10le' WHEN 2 THEN 'p010le' WHEN 3 THEN NULL WHEN 4 THEN 'v210' ELSE 'gray12be' END AS pixel_format,
  CAST(o_orderkey % 9000 AS BIGINT) AS duration,
  o_orderkey % 5 <> 0 AND o_orderkey % 8 IN (1, 6) AS is_hevc,
  o_orderkey % 6 IN (1, 2) AS is_hdr,
  o_orderkey % 7 IN (0, 5) AS is_4k,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Music' ELSE 'Video' END AS kind,
  CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'P' THEN 'Failed' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'Skipped' WHEN 1 THEN 'Processing' ELSE 'Queued' END END AS status,
  CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
  CASE WHEN o_orderkey % 10 < 3 THEN NULL ELSE o_orderdate + INTERVAL '30' DAY END AS last_verified_at,
  CASE o_orderkey % 10 WHEN 3 THEN 'corrupt' WHEN 4 THEN 'missing' WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'ok' END AS last_verify_result,
  o_orderkey % 13 = 0 AS force_mux,
  CAST(CASE WHEN o_orderstatus = 'P' THEN 1 + o_orderkey % 5 ELSE 0 END AS INT) AS failure_count,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END AS last_scanned_at,
  o_orderdate AS created_at,
  o_orderkey * 10000000 AS file_mtime,
  CASE o_orderkey % 9 WHEN 0 THEN '[]' WHEN 1 THEN NULL WHEN 2 THEN '[{{"l":"eng","c":"ac3","ch":6,"t":"Main"}},{{"l":"fre","c":"aac","ch":2,"t":"VF"}}]'
    WHEN 3 THEN '[{{"l":"jpn","c":"opus","ch":2,"t":null}},{{"l":"eng","c":"aac","ch":2,"t":"Director Commentary"}}]'
    WHEN 4 THEN '[{{"l":null,"c":"aac","ch":2,"t":"English"}}]' WHEN 5 THEN '[{{"l":"eng","c":"aac","ch":2,"t":null}},{{"l":"ENG","c":"ac3","ch":6,"t":null}}]'
    WHEN 6 THEN '[{{"l":"ger","c":"dts","ch":8,"t":"Deutsch"}}]' WHEN 7 THEN 'broken' ELSE '[{{"l":"eng","c":"aac","ch":2,"t":null}}]' END AS audio_streams,
  CASE o_orderkey % 10 WHEN 0 THEN '[]' WHEN 1 THEN NULL WHEN 2 THEN '[{{"l":"eng","c":"subrip","t":"SDH","s":true}}]'
    WHEN 3 THEN '[{{"l":"fre","c":"hdmv_pgs_subtitle","t":null,"s":false}}]' WHEN 4 THEN '[{{"l":"und","c":"ass","t":"English (Forced)","s":false}}]'
    ELSE '[{{"l":"eng","c":"subrip","t":null,"s":false}}]' END AS subtitle_streams,
  CASE o_orderkey % 4 WHEN 0 THEN 'ja' WHEN 1 THEN 'en' ELSE NULL END AS original_language,
  CASE WHEN o_orderkey % 6 = 0 THEN concat('node-', CAST(o_orderkey % 5 AS STRING)) ELSE NULL END AS assigned_node_id
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
) f
"""

NODES = """
SELECT concat('node-', CAST(s_suppkey AS STRING)) AS node_id, s_name AS hostname,
  CASE WHEN s_suppkey % 7 = 0 THEN 'master' ELSE 'worker' END AS role,
  CASE s_suppkey % 6 WHEN 0 THEN 'Offline' WHEN 1 THEN 'Online' WHEN 2 THEN 'Busy' WHEN 3 THEN 'Uploading' WHEN 4 THEN 'Downloading' ELSE 'Unreachable' END AS status,
  s_suppkey % 8 = 0 AS is_paused,
  CAST(CASE WHEN s_acctbal < 0 THEN 0 ELSE round(s_acctbal * 10000) END AS BIGINT) AS available_disk_bytes,
  s_suppkey % 9 = 0 AS only_4k, s_suppkey % 10 = 0 AS exclude_4k,
  CAST(s_suppkey AS BIGINT) AS heartbeat_rank
FROM {supplier}
"""

DEVICES = """
SELECT concat('node-', CAST(s_suppkey AS STRING)) AS node_id, d.device_id, d.codecs, d.encoders, CAST(d.capacity AS INT) AS capacity
FROM {supplier} JOIN (
  SELECT 0 AS pick, 'cpu' AS device_id, 'h264,h265,av1' AS codecs, 'libx264,libx265,libsvtav1' AS encoders, 1 AS capacity
  UNION ALL SELECT 1, 'nvidia', 'h264,h265', 'h264_nvenc,hevc_nvenc', 3
  UNION ALL SELECT 2, 'intel', 'h264,h265,av1', 'h264_qsv,hevc_qsv,av1_qsv', 2
  UNION ALL SELECT 3, 'music', 'aac,flac', 'aac,flac', 4) d ON s_suppkey % 4 = d.pick OR d.pick = 0
"""

SLOTS = """
SELECT concat('job-', CAST(o_orderkey AS STRING)) AS job_id, concat('node-', CAST(1 + o_orderkey % 10 AS STRING)) AS node_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'cpu' WHEN 1 THEN 'nvidia' WHEN 2 THEN 'intel' ELSE 'music' END AS device_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'Reserved' WHEN 1 THEN 'Uploading' WHEN 2 THEN 'Encoding' WHEN 3 THEN 'Downloading' ELSE 'Encoding' END AS phase,
  CAST(o_orderkey % 101 AS INT) AS progress
FROM {orders} WHERE o_orderkey % 50 = 7
"""

#: Watched folders: prefixes of library paths, of which the longest that fits a file holds.
FOLDERS = """
SELECT DISTINCT lower(concat('/media/', r_name)) AS root, CASE WHEN r_regionkey = 1 THEN 'Off' ELSE 'Inherit' END AS policy, CAST(2000 + 500 * r_regionkey AS INT) AS target_kbps FROM {region}
UNION ALL
SELECT lower(concat('/media/', r_name, '/', n_name)) AS root, 'Inherit' AS policy, CAST(1000 + 10 * n_nationkey AS INT) AS target_kbps FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0
"""

#: What a new scan lists: most known files, some changed, some renamed, some new.
SCAN = """
SELECT CASE WHEN o_orderkey % 19 = 0 THEN concat(m.directory, '/new-', m.file_name) WHEN o_orderkey % 23 = 0 THEN concat(m.directory, '/', m.base_name, '.mp4') ELSE m.file_path END AS path,
  m.directory AS directory, CASE WHEN o_orderkey % 19 = 0 THEN concat('new-', m.base_name) ELSE m.base_name END AS base_name,
  CASE WHEN o_orderkey % 7 = 0 THEN m.file_size * 2 WHEN o_orderkey % 7 = 1 THEN CAST(floor(m.file_size * 1.05) AS BIGINT) ELSE m.file_size END AS size,
  CASE WHEN o_orderkey % 29 = 0 THEN m.duration + 45 ELSE m.duration END AS duration, m.created_at + INTERVAL '1' DAY AS modified_at
FROM {media_files} m JOIN {orders} ON m.id = o_orderkey WHERE o_orderkey % 31 <> 0
"""

_VIEWS = {
    "encode_history": ENCODE_HISTORY,
    "media_files": MEDIA_FILES,
    "nodes": NODES,
    "devices": DEVICES,
    "slots": SLOTS,
    "folders": FOLDERS,
    "scan": SCAN,
}
_NAME = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the model, or a table."""
    if name not in _VIEWS:
        return table(spark, sf_dir, name)
    text = _VIEWS[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in set(_NAME.findall(text))})


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that it names in front."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in _VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in order:
                need(_VIEWS[name])
                if name not in order:
                    order.append(name)

    need(sql)
    if not order:
        return sql
    views = ", ".join(f"{n} AS ({_VIEWS[n].format(**{k: k for k in _NAME.findall(_VIEWS[n])})})" for n in order)
    return f"WITH {views}\n{sql}"
