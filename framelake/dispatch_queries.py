"""The queue dispatched in its order, and DuckDB SQL that places one item after the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import dispatch
from framelake.queries import _items, query, view

_SQL = """SELECT * FROM (WITH RECURSIVE place AS (
  SELECT row_number() OVER (ORDER BY heartbeat_rank, n.node_id, d.device_id) AS p, d.node_id, d.device_id, d.codecs, d.encoders, n.only_4k, n.exclude_4k, n.available_disk_bytes AS disk,
    CASE WHEN d.device_id = 'cpu' THEN 1 ELSE d.capacity END - coalesce(u.used, 0) AS free
  FROM devices d JOIN nodes n ON n.node_id = d.node_id LEFT JOIN (SELECT node_id, device_id, CAST(count(*) AS INT) AS used FROM slots GROUP BY 1, 2) u ON u.node_id = d.node_id AND u.device_id = d.device_id
  WHERE n.role = 'worker' AND n.status IN ('Online', 'Busy', 'Uploading', 'Downloading') AND NOT n.is_paused AND d.device_id <> 'music'
),
item AS (
  SELECT id, file_size AS size, is_4k, CASE id % 3 WHEN 0 THEN 'h265' WHEN 1 THEN 'av1' ELSE 'h264' END AS codec, CASE id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'none' WHEN 2 THEN 'nvidia' ELSE 'intel' END AS hw,
    CASE WHEN id % 10 = 0 THEN 'hevc_qsv' ELSE '' END AS enc, row_number() OVER (ORDER BY priority DESC, bitrate DESC, id) AS n
  FROM media_files WHERE status = 'Queued' AND kind = 'Video' AND assigned_node_id IS NULL
),
able AS (SELECT node_id, device_id, unnest(string_split(codecs, ',')) AS codec FROM devices WHERE device_id <> 'cpu'),
worth AS (
  SELECT i.id, i.n, list(CASE WHEN p.only_4k AND NOT i.is_4k OR p.exclude_4k AND i.is_4k THEN NULL WHEN i.enc <> '' AND NOT list_contains(string_split(p.encoders, ','), i.enc) THEN NULL WHEN p.disk < i.size * 2.5 THEN NULL
    WHEN NOT list_contains(string_split(p.codecs, ','), i.codec) THEN NULL WHEN i.enc <> '' THEN 21
    WHEN i.hw = 'none' THEN CASE WHEN p.device_id = 'cpu' THEN 7 END
    WHEN i.hw = 'auto' THEN CASE WHEN p.device_id <> 'cpu' THEN 9 WHEN EXISTS (SELECT 1 FROM able a WHERE a.node_id = p.node_id AND a.codec = i.codec) THEN NULL ELSE 6 END
    WHEN p.device_id = 'cpu' THEN CASE WHEN EXISTS (SELECT 1 FROM able a WHERE a.node_id = p.node_id AND a.device_id = i.hw AND a.codec = i.codec) THEN NULL ELSE 1 END
    WHEN p.device_id = i.hw THEN 13 END ORDER BY p.p) AS base
  FROM item i CROSS JOIN place p GROUP BY 1, 2
),
start AS (SELECT list(free ORDER BY p) AS free FROM place),
step AS (
  SELECT CAST(0 AS BIGINT) AS n, free, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS p, CAST(NULL AS BIGINT) AS score FROM start
  UNION ALL
  SELECT n, list_transform(free, lambda x, i: x - CASE WHEN i = p THEN 1 ELSE 0 END), id, p, score
  FROM (SELECT n, free, id, CASE WHEN list_max(scores) IS NOT NULL THEN list_position(scores, list_max(scores)) END AS p, list_max(scores) AS score
    FROM (SELECT w.n, s.free, w.id, list_transform(w.base, lambda b, i: CASE WHEN s.free[i] > 0 THEN b + s.free[i] END) AS scores FROM step s JOIN worth w ON w.n = s.n + 1))
)
SELECT id AS item_id, node_id, device_id, CAST(score AS INT) AS score FROM step s JOIN place USING (p))"""


@query("dispatch_queue", _SQL)
def _dispatch(spark, d):
    waits = view(spark, d, "media_files").where("assigned_node_id is null").selectExpr("id as item_id", "-priority as p", "-bitrate as b")
    items = _items(spark, d).join(waits, "item_id").withColumn("i", F.col("item_id"))
    return dispatch.dispatch(items, ["p", "b", "i"], *[view(spark, d, v) for v in ("nodes", "devices", "slots")])[0]
