"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import discard, written

_MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them. Every edge has u > v here."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each end of an edge of (u, v) reaches; ids without an edge have no row.

    Loops and repeated edges do no harm. A node with very many edges is one row of the small side of a join whose
    large side Spark splits. Every round is written to the shared folder, so a lost executor costs one round, and
    replaces the one before.
    """
    now = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct()
    now = written(now, "edges")
    state = None
    for _ in range(_MOST_ROUNDS):
        before, now = now, written(_small_star(_large_star(now)), "stars")
        discard(before)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(new) == state:
            break
        state = tuple(new)
    else:
        raise RuntimeError("the components did not settle")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    found = written(stars.union(now.select(F.col("v"), F.col("v")).distinct()), "components")
    discard(now)
    return found
