"""What changed between two snapshots, as events, and snapshots from events.

Rows are held against each other in one join on the key, so both snapshots are shuffled once. An event says what it is about
(topic), what happened (added, changed, removed) and the new row; a removed one has the old row. Events of a batch may be
written twice, as each key has one of them at most, and replaying them over the old snapshot gives the new one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDED, CHANGED, REMOVED = "added", "changed", "removed"


def between(old: DataFrame, new: DataFrame, key: str, topic: str) -> DataFrame:
    """Events (topic, key, kind, row) that lead from one snapshot to another with the same columns. Keys are there and
    differ; rows without one are passed over."""
    new = new.select(*old.columns)
    a, b = (rows.where(F.col(key).isNotNull()).select(F.col(key).alias("the key"), F.struct(*rows.columns).alias(side)) for rows, side in ((old, "old"), (new, "new")))
    both = a.join(b, "the key", "full")
    kind = F.when(F.col("old").isNull(), ADDED).when(F.col("new").isNull(), REMOVED).when(~F.col("old").eqNullSafe(F.col("new")), CHANGED)
    rows = both.withColumn("kind", kind).where("kind is not null")
    return rows.select(F.lit(topic).alias("topic"), F.col("the key").alias("key"), "kind", F.coalesce("new", "old").alias("row"))


def replayed(old: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """The snapshot after events over the old one; events may be there more than once."""
    once = events.dropDuplicates(["key"]).select(F.col("key").alias(key), "kind", "row")
    kept = old.join(once.select(key), key, "left_anti").select(*old.columns)
    return kept.unionByName(once.where(F.col("kind") != REMOVED).select("row.*").select(*old.columns))


def counts(events: DataFrame) -> DataFrame:
    """How many events of each kind each topic has."""
    return events.groupBy("topic", "kind").agg(F.count("*").alias("events"))


def told(events: DataFrame, name: Callable[[Column], Column] | None = None) -> DataFrame:
    """Events as messages (topic, key, text) for subscribers: what happened and the row as JSON."""
    text = F.to_json(F.struct("kind", F.col("row")))
    return events.select("topic", (name(F.col("key")) if name else F.col("key").cast("string")).alias("key"), text.alias("text"))
