"""Verification passes, paths under other roots, events between snapshots. Each has DuckDB SQL of its own way."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators import alignment, events, external, ledger, sweep, verification
from framelake.queries import NOW, ORACLES, query, view
from framelake.session import names, shared_folder
from framelake.sources import files as FS
from framelake.sources.adapters import table

# rolling verification: files verified on some days lie on storage that is gone

_GONE = "last_verified_at BETWEEN CAST('1996-03-01' AS TIMESTAMP) AND CAST('1996-03-20' AS TIMESTAMP)"
_CANDIDATES = "last_scanned_at IS NOT NULL AND status NOT IN ('Queued', 'Processing')"


def _roll(name: str, gone: str) -> None:
    @query(
        name,
        f"""WITH c AS (SELECT id, last_verify_result AS prior, file_path IN (SELECT path FROM scan) AND NOT coalesce({gone}, FALSE) AS here, file_size % 11 AS state, row_number() OVER (ORDER BY last_verified_at NULLS FIRST, id) AS n FROM media_files WHERE {_CANDIDATES}),
r AS (SELECT *, n - coalesce(max(CASE WHEN here THEN n END) OVER (ORDER BY n), 0) AS run FROM c)
SELECT id, CASE WHEN here THEN CASE WHEN state = 0 THEN 'damaged' ELSE 'ok' END WHEN prior IS NOT NULL AND prior <> 'ok' THEN prior ELSE 'missing' END AS last_verify_result
FROM r WHERE n < coalesce((SELECT min(n) FROM r WHERE NOT here AND run >= 5), 9223372036854775807)""".replace("WITH c AS", "SELECT * FROM (WITH c AS", 1)
        + ")",
    )
    def roll(spark, d):
        m = view(spark, d, "media_files").where(_CANDIDATES)
        there = view(spark, d, "scan").select(F.col("path").alias("file_path"), F.lit(True).alias("listed")).distinct()
        rows = m.join(there, "file_path", "left").withColumn("here", F.coalesce("listed", F.lit(False)) & ~F.coalesce(F.expr(gone), F.lit(False)))
        return verification.verified(rows.withColumn("found", F.when(F.col("here"), F.when(F.col("file_size") % 11 == 0, "damaged").otherwise("ok"))))


_roll("verification_pass", _GONE)
_roll("verification_whole", "FALSE")

# the library as another program sees it: a root for each supplier

_ROOTS = """SELECT CAST(s_suppkey AS INT) AS place, CASE s_suppkey % 5 WHEN 0 THEN concat('/srv/', r_name, '/', n_name, '/') WHEN 1 THEN concat('\\\\\\\\nas\\\\', n_name) WHEN 2 THEN concat('/pool', CAST(s_suppkey AS STRING), '/MEDIA') WHEN 3 THEN concat('D:\\\\x\\\\', r_name, '\\\\', n_name, '\\\\machinery') ELSE '/none' END AS root
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""
_ROOTS_SQL = _ROOTS.replace("{", "").replace("}", "").replace("\\\\", "\\")


@query(
    "aligned_roots",
    f"""WITH roots AS ({_ROOTS_SQL}),
tails AS (SELECT place, root, k, '/' || array_to_string(p[len(p) - k + 1:], '/') || '/' AS tail FROM (SELECT place, root, [lower(x) for x in string_split_regex(root, '[\\\\/]+') if x <> ''] AS p FROM roots), unnest(range(1, len(p) + 1)) u(k)),
hit AS (SELECT m.file_path, t.root, t.k, strpos(lower(m.file_path) || '/', t.tail) AS pos, length(t.tail) AS size FROM media_files m JOIN tails t ON contains(lower(m.file_path) || '/', t.tail) QUALIFY row_number() OVER (PARTITION BY m.file_path ORDER BY t.k DESC, t.place) = 1)
SELECT file_path AS path, root, rtrim(root, '/\\') || CASE WHEN contains(root, '\\') AND NOT contains(root, '/') THEN '\\' || replace(substr(file_path, pos + size), '/', '\\') ELSE '/' || substr(file_path, pos + size) END AS mapped, CAST(k AS INT) AS length FROM hit""".replace("WITH roots AS", "SELECT * FROM (WITH roots AS", 1)
    + ")",
)
def _aligned(spark, d):
    roots = spark.sql(_ROOTS, **{n: table(spark, d, n) for n in ("supplier", "nation", "region")})
    return alignment.aligned(view(spark, d, "media_files"), roots)


# events between the library as it was and as a scan left it

_COLUMNS = "id, file_path, file_size, status, priority, last_verify_result"
_AFTER = f"SELECT id, file_path, CASE WHEN id % 7 = 0 THEN file_size + 1 ELSE file_size END AS file_size, status, CASE WHEN id % 14 = 1 THEN priority + 1 ELSE priority END AS priority, CASE WHEN id % 21 = 2 THEN NULL ELSE last_verify_result END AS last_verify_result FROM {{m}} WHERE id % 9 <> 0 UNION ALL SELECT -id, concat(file_path, '.new'), file_size, 'Unseen', 0, NULL FROM {{m}} WHERE id % 13 = 0"


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    m = view(spark, d, "media_files")
    return m.select(*_COLUMNS.split(", ")), spark.sql(_AFTER, m=m)


_NEW = _AFTER.format(m="media_files")


@query(
    "item_events",
    f"""SELECT 'item' AS topic, coalesce(n.id, o.id) AS key, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS kind, coalesce(n.file_size, o.file_size) AS file_size, CASE WHEN n.id IS NULL THEN o.last_verify_result ELSE n.last_verify_result END AS last_verify_result
FROM media_files o FULL JOIN ({_NEW}) n ON o.id = n.id
WHERE (o.id, o.file_path, o.file_size, o.status, o.priority) IS DISTINCT FROM (n.id, n.file_path, n.file_size, n.status, n.priority) OR o.last_verify_result IS DISTINCT FROM n.last_verify_result""",
)
def _events(spark, d):
    return events.between(*_snapshots(spark, d), "id", "item").select("topic", "key", "kind", "row.file_size", "row.last_verify_result")


@query("events_replayed", f"SELECT * FROM ({_NEW})")
def _replayed(spark, d):
    old, new = _snapshots(spark, d)
    found = events.between(old, new, "id", "item")
    return events.replayed(old, found.unionByName(found.where("key % 5 = 0")), "id")  # some of them sent twice


query(
    "event_counts",
    f"""SELECT topic, kind, count(*) AS events FROM (SELECT 'item' AS topic, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM media_files o FULL JOIN ({_NEW}) n ON o.id = n.id WHERE (o.id, o.file_path, o.file_size, o.priority) IS DISTINCT FROM (n.id, n.file_path, n.file_size, n.priority) OR o.status IS DISTINCT FROM n.status OR o.last_verify_result IS DISTINCT FROM n.last_verify_result
UNION ALL SELECT 'worker', CASE WHEN node_rank % 2 = 0 THEN 'changed' ELSE 'removed' END FROM (SELECT heartbeat_rank AS node_rank FROM nodes) WHERE node_rank % 2 = 0 OR node_rank % 5 = 0) GROUP BY 1, 2""",
)(
    lambda s, d: (
        lambda n: events.counts(events.between(*_snapshots(s, d), "id", "item").select("topic", F.col("key").cast("string").alias("key"), "kind").unionByName(events.between(n, n.where("heartbeat_rank % 2 = 0 or heartbeat_rank % 5 <> 0").withColumn("is_paused", F.when(F.col("heartbeat_rank") % 2 == 0, ~F.col("is_paused")).otherwise(F.col("is_paused"))), "node_id", "worker").select("topic", "key", "kind")))
    )(view(s, d, "nodes"))
)


# a sweep that is stopped after two chunks and goes on, and the end of a log

_ROOT = "concat('/media/', split_part(directory, '/', 3))"


@query("sweep_resumed", f"SELECT DISTINCT {_ROOT} AS root, directory, path, size FROM scan")
def _sweep(spark, d):
    folder = f"{shared_folder(spark)}/sweeps-{uuid.uuid4().hex}"
    listing = view(spark, d, "scan").select("directory", "path", "size").distinct()
    directories = view(spark, d, "media_files").selectExpr(f"{_ROOT} as root", "directory").distinct()
    look = lambda some: some.join(listing, "directory").select("root", "directory", "path", "size")
    now = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    sweep.run(directories, folder, look, now, chunk=40, most=2)
    number, _ = sweep.run(directories, folder, look, now + datetime.timedelta(hours=3), chunk=40)
    return sweep.found(spark, folder, number, look(directories).schema)


@query(
    "log_end",
    "SELECT n - 1 AS line, value FROM (SELECT row_number() OVER (ORDER BY event_id) AS n, concat(event_id, ' ', event_type) AS value FROM (SELECT * FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) ORDER BY event_id DESC LIMIT 50))",
)
def _log_end(spark, d):
    """Events as a log of each day; the last lines of the newest one."""
    folder = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    lines = table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), F.concat_ws(" ", "event_id", "event_type").alias("value"))
    lines.repartition("day").sortWithinPartitions("day", "event_id").select("day", "value").write.partitionBy("day").text(folder)
    day = max(n for n in names(spark, folder) if n.startswith("day="))
    name = next(n for n in names(spark, f"{folder}/{day}") if n.startswith("part-"))
    return FS.log_tail(spark, f"{folder}/{day}/{name}", 50)


# lists staged on the first of most months, each of which holds for forty days

_LISTS = """SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS staged_at, lower(concat('/media/', r_name)) AS root,
  CASE (r_regionkey + CAST(extract(MONTH FROM o_orderdate) AS INT)) % 4 WHEN 0 THEN 'jpn' WHEN 1 THEN 'German' WHEN 2 THEN '' ELSE 'en' END AS lang
FROM {orders} CROSS JOIN {region} WHERE extract(MONTH FROM o_orderdate) NOT IN (4, 5, 9)
UNION ALL SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP), lower(concat('/media/', r_name, '/', n_name, '/')), 'fre'
FROM {orders} CROSS JOIN {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE n_nationkey % 4 = 0 AND extract(MONTH FROM o_orderdate) IN (1, 2, 7)"""
_LISTS_SQL = _LISTS.replace("{", "").replace("}", "")


@query(
    "staged_languages",
    f"""SELECT * FROM (WITH lists AS ({_LISTS_SQL}), held AS (SELECT m.file_path, m.created_at AS at_, t.staged_at FROM media_files m ASOF LEFT JOIN (SELECT DISTINCT staged_at FROM lists) t ON m.created_at >= t.staged_at),
fresh AS (SELECT file_path, at_, CASE WHEN at_ - staged_at <= INTERVAL '40' DAY THEN staged_at END AS staged_at FROM held)
SELECT f.file_path, f.at_ AS "at", f.staged_at, CASE l.lang WHEN 'jpn' THEN 'ja' WHEN 'German' THEN 'de' WHEN 'en' THEN 'en' WHEN 'fre' THEN 'fr' END AS language
FROM fresh f LEFT JOIN lists l ON l.staged_at = f.staged_at AND l.lang <> '' AND starts_with(f.file_path, rtrim(l.root, '/') || '/') QUALIFY row_number() OVER (PARTITION BY f.file_path ORDER BY length(rtrim(l.root, '/')) DESC NULLS LAST) = 1)""",
)
def _staged(spark, d):
    lists = spark.sql(_LISTS, **{n: table(spark, d, n) for n in ("orders", "nation", "region")})
    files = view(spark, d, "media_files").select("file_path", F.col("created_at").cast("timestamp").alias("at"))
    found = external.language_at(files, lists.withColumn("staged_at", F.col("staged_at").cast("timestamp")), hours=40 * 24)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("at", "staged_at")})


# the ledger laid out by month: every fifth job is late, and some are added twice


@query("savings_by_month")
def _by_month(spark, d):
    folder = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    jobs = view(spark, d, "encode_history")
    ledger.add_by_period(jobs.where("part_key % 5 <> 0"), folder, "month")
    ledger.add_by_period(jobs.where("part_key % 5 = 0 or part_key % 35 = 1"), folder, "month")
    return ledger.savings_over_time(ledger.by_period(spark, folder), days=30, now=NOW)


ORACLES["savings_by_month"] = ORACLES["savings_over_time"]
