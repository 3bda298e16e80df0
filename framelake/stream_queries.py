"""Streams with state of their own: transitions of a write-ahead log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.queries import query
from framelake.session import shared_folder, ship
from framelake.sources.adapters import table
from framelake.streaming import transitions as T

#: Each event begins a transition of its user; two of three are completed up to 49 hours later.
_LOG_SQL = """log AS (
  SELECT user_id AS work_item_id, event_id AS transition_id, event_type AS phase, FALSE AS completed, ts AS "at" FROM events
  UNION ALL SELECT user_id, event_id, event_type, TRUE, ts + to_hours(CAST(event_id % 50 AS INT)) FROM events WHERE event_id % 3 > 0
)"""


def _log(spark, d) -> DataFrame:
    e = table(spark, d, "events").selectExpr("user_id as work_item_id", "event_id as transition_id", "event_type as phase", "cast(ts as timestamp) as ts")
    done = e.where("transition_id % 3 > 0").withColumn("ts", F.expr("ts + make_dt_interval(0, int(transition_id % 50))"))
    return T.entries(e, F.col("ts"), False).unionByName(T.entries(done, F.col("ts"), True))


@query(
    "transitions_stream",
    f"""WITH {_LOG_SQL} SELECT work_item_id, transition_id, phase, "at", "at" + INTERVAL '24' HOUR <= (SELECT max("at") FROM log) - INTERVAL '1' HOUR AS overdue
FROM log l WHERE NOT completed AND NOT EXISTS (SELECT 1 FROM log c WHERE c.completed AND c.work_item_id = l.work_item_id AND c.transition_id = l.transition_id)""",
)
def _transitions(spark, d):
    """The log as a feed, the earlier half of its time first: followed, stopped in between, and followed on. Files come
    in the order of their writing, so the later half is written after the stream has seen the earlier one."""
    ship(spark)
    folder = f"{shared_folder(spark)}/transitions-{uuid.uuid4().hex}"
    rows = _log(spark, d)
    half = rows.agg(F.timestamp_micros(F.expr("(unix_micros(min(at)) + unix_micros(max(at))) div 2")).alias("half"))
    late = F.coalesce(F.col("at") > F.col("half"), F.lit(False))
    for part, batches in ((~late, 1), (late, None)):
        rows.crossJoin(F.broadcast(half)).where(part).drop("half").write.mode("append").parquet(f"{folder}/log")  # one row
        T.follow(spark.readStream.schema(T.LOG).parquet(f"{folder}/log"), folder, batches=batches)
    return T.open_transitions(spark, folder).withColumn("at", F.col("at").cast("timestamp_ntz"))


query(
    "transitions_open",
    f"""WITH {_LOG_SQL} SELECT work_item_id, transition_id, phase, "at", "at" + INTERVAL '24' HOUR <= (SELECT max("at") FROM log) - INTERVAL '1' HOUR AS overdue
FROM log l WHERE NOT completed AND NOT EXISTS (SELECT 1 FROM log c WHERE c.completed AND c.work_item_id = l.work_item_id AND c.transition_id = l.transition_id)""",
)(lambda s, d: T.open_in(_log(s, d)).withColumn("at", F.col("at").cast("timestamp_ntz")))
