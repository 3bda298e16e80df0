"""Policy and layered settings for each file and each kind of node, and DuckDB SQL that goes through the layers one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import paths as P
from framelake.plans import policy as PO
from framelake.plans import resolve as R
from framelake.queries import _LONGEST, POLICY, query, view

_POLICY = R.checked(
    POLICY,
    rules=tuple(r for r in POLICY.rules if r.id != "r6"),
    profiles=(PO.Profile("p1", "AV1 small", "AV01", "bitrate", 3500), PO.Profile("p2", "HEVC exact", "hevc", encoder="hevc_nvenc", downscale="CapAtTarget")),
)
_N = "length(folder_root)"
_FOLDER = {
    "target_kbps": "folder_kbps",
    "codec": f"CASE WHEN {_N} % 3 = 0 THEN 'AV1' END",
    "encoder": f"CASE {_N} % 5 WHEN 0 THEN 'HEVC_NVENC' WHEN 1 THEN 'libx265' END",
    "format": f"CASE WHEN {_N} % 7 = 0 THEN 'webm' END",
    "audio_codec": f"CASE WHEN {_N} % 2 = 0 THEN ' AC3 ' END",
}
_CHOICE = {
    "policy": f"CASE WHEN folder_policy = 'Off' THEN 'Simple' WHEN {_N} % 4 = 1 THEN 'Profile' WHEN folder_root IS NOT NULL THEN 'Inherit' END",
    "profile_id": f"CASE WHEN {_N} % 8 = 1 THEN 'p2' ELSE 'p9' END",
}
_NODE = {
    "hardware": "CASE r_regionkey WHEN 1 THEN 'nvidia' WHEN 2 THEN 'intel' END",
    "codec": "CASE WHEN r_regionkey = 3 THEN 'h264' END",
    "encoder": "CASE WHEN r_regionkey = 4 THEN 'hevc_nvenc' END",
    "target_kbps": "CASE WHEN r_regionkey = 2 THEN 900 END",
    "two_channels": "CASE WHEN r_regionkey = 1 THEN TRUE END",
    "keep_audio": "CASE WHEN r_regionkey = 4 THEN TRUE END",
}
_SAID = {x: x.replace("'", "''") for x in (R.MISSING, R.WRONG_CODEC, R.CONFLICT)}
_SHOWN = ("format", "codec", "encoder", "hardware", "target_kbps", "mode", "keep_audio", "downscale")

_SQL = f"""SELECT id, node, action, rule_id, profile_id, format, codec3 AS codec, CASE WHEN kind = 'p2' THEN 'hevc_nvenc' WHEN kind = 'p1' AND format = 'webm' THEN 'libsvtav1' ELSE encoder2 END AS encoder, CASE WHEN kind = 'p2' THEN 'nvidia' ELSE hardware2 END AS hardware, kbps2 AS target_kbps,
CASE WHEN kind = 'mux' THEN 'MuxOnly' ELSE 'Transcode' END AS mode, keep2 AS keep_audio, CASE WHEN kind = 'p2' THEN 'CapAtTarget' ELSE 'Never' END AS downscale, outputs2 AS outputs,
CASE WHEN kind = 'missing' THEN '{_SAID[R.MISSING]}' WHEN kind = 'p2' AND (CASE lower(codec3) WHEN 'hevc' THEN 'h265' ELSE lower(codec3) END) <> 'h265' THEN '{_SAID[R.WRONG_CODEC]}' WHEN kind = 'p2' AND (lower(f_encoder) <> 'hevc_nvenc' OR lower(n_encoder) <> 'hevc_nvenc') THEN '{_SAID[R.CONFLICT]}' END AS blocked
FROM (SELECT *, CASE WHEN kind IN ('p1', 'p2') AND format = 'webm' THEN 'av1' ELSE codec2 END AS codec3 FROM (
SELECT *, coalesce(n_codec, codec1) AS codec2, coalesce(n_encoder, CASE WHEN n_codec = 'h264' THEN 'libx264' END, encoder1) AS encoder2, coalesce(n_hardware, hardware1) AS hardware2, coalesce(n_kbps, kbps1) AS kbps2,
  CASE WHEN node = 1 THEN audio IS NULL WHEN node = 4 THEN TRUE ELSE audio IS NULL END AS keep2, CASE WHEN audio IS NULL THEN '' WHEN node = 1 THEN 'ac3 Stereo 0' ELSE 'ac3 Source 0' END AS outputs2
FROM (SELECT *, coalesce(f_codec, CASE kind WHEN 'p1' THEN 'av1' ELSE 'h265' END) AS codec1, coalesce(f_encoder, CASE WHEN f_codec IS NOT NULL THEN 'libsvtav1' END, CASE kind WHEN 'p1' THEN 'libsvtav1' WHEN 'p2' THEN 'hevc_nvenc' ELSE 'libx265' END) AS encoder1,
  CASE kind WHEN 'p2' THEN 'nvidia' ELSE 'auto' END AS hardware1, coalesce(f_kbps, 3500) AS kbps1, coalesce(f_format, 'mkv') AS format
FROM (SELECT *, CASE kind WHEN 'skip' THEN 'skip' WHEN 'mux' THEN 'mux_only' WHEN 'simple' THEN 'use_simple' ELSE 'transcode_with_profile' END AS action, CASE WHEN kind IN ('p1', 'p2') THEN kind END AS profile_id, CASE WHEN choice IN ('Simple', 'Profile') THEN NULL ELSE rule END AS rule_id
FROM (SELECT *, CASE WHEN choice = 'Simple' THEN 'simple' WHEN choice = 'Profile' THEN CASE WHEN chosen = 'p2' THEN 'p2' ELSE 'missing' END ELSE CASE rule WHEN 'r1' THEN 'skip' WHEN 'r2' THEN 'p1' WHEN 'r3' THEN 'p2' WHEN 'r5' THEN 'mux' ELSE 'simple' END END AS kind
FROM (SELECT l.id, r_regionkey AS node, {_CHOICE['policy']} AS choice, {_CHOICE['profile_id']} AS chosen, {', '.join(f"{v} AS f_{k}" for k, v in _FOLDER.items() if k not in ('target_kbps', 'audio_codec'))}, folder_kbps AS f_kbps, {_FOLDER['audio_codec']} AS audio,
  {_NODE['hardware']} AS n_hardware, {_NODE['codec']} AS n_codec, {_NODE['encoder']} AS n_encoder, {_NODE['target_kbps']} AS n_kbps,
  CASE WHEN codec = 'av1' THEN 'r1' WHEN codec = 'hevc' AND is_4k THEN 'r2' WHEN (width > 0 AND height > 0 AND least(width, height) >= 1440) OR pixel_format = 'gray12be' THEN 'r3' WHEN bitrate BETWEEN 500 AND 2000 AND codec NOT IN ('', 'h264') THEN 'r5' END AS rule
FROM (SELECT id, folder_root, policy AS folder_policy, target_kbps AS folder_kbps FROM ({_LONGEST})) l JOIN media_files m ON m.id = l.id CROSS JOIN region))))))"""


@query("resolved_options", _SQL)
def _resolved(spark, d):
    """Every file under the longest folder above it, for a kind of node of each region's settings."""
    m = view(spark, d, "media_files")
    folders = P.longest_prefix(m, view(spark, d, "folders")).withColumnsRenamed({"policy": "folder_policy", "target_kbps": "folder_kbps"})
    files = folders.withColumn("folder", F.struct(*[F.expr(v).alias(k) for k, v in {**_CHOICE, **_FOLDER}.items()]))
    nodes = view(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("node_class"), F.struct(*[F.expr(v).alias(k) for k, v in _NODE.items()]).alias("node"))
    both = R.resolve(files, _POLICY, folder="folder", node="node", nodes=nodes.limit(64))  # a row for each kind of node
    outputs = F.array_join(F.transform("options.audio_outputs", lambda x: F.concat_ws(" ", x["codec"], x["layout"], x["kbps"])), ",")
    return both.select("id", F.col("node_class").alias("node"), *[F.col(f"plan.{k}").alias(k) for k in ("action", "rule_id", "profile_id", "blocked")], *[F.col(f"options.{k}").alias(k) for k in _SHOWN], outputs.alias("outputs"))
