"""The queue: order, pages, windows, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def queued(files: DataFrame, kind: str | None = None) -> DataFrame:
    """Files that wait for this machine: queued and not given to a node."""
    rows = files.where("status = 'Queued' and assigned_node_id is null")
    return rows.where(F.col("kind") == kind) if kind else rows


def order(newest: bool = False) -> list[Column]:
    return [F.desc("priority"), F.desc("created_at" if newest else "bitrate"), F.col("id")]


def page(files: DataFrame, skip: int, take: int, newest: bool = False, kind: str | None = None) -> DataFrame:
    """A page of the queue; nothing for take <= 0."""
    return queued(files, kind).orderBy(*order(newest)).offset(max(0, skip)).limit(max(0, take)).select("id", "file_path", "priority", "bitrate", "created_at")


def total(files: DataFrame, kind: str | None = None) -> DataFrame:
    return queued(files, kind).agg(F.count("*").alias("total"))


def excluding(files: DataFrame, active: DataFrame, skip: int, take: int) -> DataFrame:
    """A page of the queue without the files of `active` (column path), whatever their case."""
    gone = active.where("path is not null").select(F.lower(F.trim("path")).alias("gone")).distinct()
    rows = queued(files).join(gone, F.lower("file_path") == F.col("gone"), "left_anti")
    return rows.orderBy(*order()).offset(skip).limit(take).select("id", "file_path", "priority", "bitrate")


def window(files: DataFrame, size: int = 50, floor: int = 8) -> DataFrame:
    """The working window: the top of the queue, whose tail gives way to the top `floor` of a kind that would have
    fewer: music first, else video. Both tops are limits, so no task ranks the queue."""
    rows = queued(files).select("id", "file_path", "kind", "priority", "bitrate")
    top = lambda df, n: df.orderBy(F.desc("priority"), F.desc("bitrate"), "id").limit(n)
    head = top(rows, size).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("priority"), F.desc("bitrate"), "id")))
    floors = None
    for place, kind in enumerate(("Music", "Video")):
        some = top(rows.where(F.col("kind") == kind), floor).withColumn("place", F.lit(place))
        floors = some if floors is None else floors.unionByName(some)
    have = head.groupBy("kind").agg(F.count("*").alias("have"))
    asked = floors.groupBy("kind", "place").agg(F.count("*").alias("want")).join(have, "kind", "left").where("want > coalesce(have, 0)")
    short = asked.orderBy("place").limit(1).select(F.col("kind").alias("short"), "want")
    kept = head.join(F.broadcast(short), F.lit(True), "left").where("short is null or (rank <= {n} - want and kind <> short) or kind = short".replace("{n}", str(size)))
    extra = floors.join(F.broadcast(short), F.col("kind") == F.col("short")).select("id", "file_path", "kind", "priority", "bitrate")
    rows = kept.select("id", "file_path", "kind", "priority", "bitrate").unionByName(extra).dropDuplicates(["id"])
    return rows


def rotated(files: DataFrame, turn: int, size: int = 50) -> DataFrame:
    """The `turn`-th window of the queue."""
    return queued(files).orderBy(*order()).offset(turn * size).limit(size).select("id", "file_path")


def bump(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """Gives a queued file, the one row of `chosen` (column id), one more than the highest priority of the queue."""
    most = files.where("status = 'Queued'").agg((F.coalesce(F.max("priority"), F.lit(0)) + 1).alias("most"))
    one = most.crossJoin(chosen.select(F.col("id").alias("chosen")))  # one row each
    hit = F.coalesce((F.col("id") == F.col("chosen")) & (F.col("status") == "Queued"), F.lit(False))
    return files.crossJoin(F.broadcast(one)).withColumn("priority", F.when(hit, F.col("most")).otherwise(F.col("priority"))).drop("most", "chosen")


def segments(active: DataFrame, pending: DataFrame, terminal: DataFrame, skip: int, take: int) -> DataFrame:
    """One page over active, then pending, then finished items (columns id, rank and any others alike), each in order
    of its rank."""
    rows = active.withColumn("segment", F.lit(0)).unionByName(pending.withColumn("segment", F.lit(1))).unionByName(terminal.withColumn("segment", F.lit(2)))
    return rows.orderBy("segment", "rank", "id").offset(skip).limit(take)


def terminal_rank(dashboard: bool = True) -> Column:
    """Order of finished states: on the dashboard savings-free ones have a rank of their own."""
    status = F.col("status")
    if dashboard:
        return F.when(status == "Completed", 0).when(status == "NoSavings", 1).when(status == "Failed", 2).when(status.isin("Cancelled", "Stopped"), 3).otherwise(4)
    return F.when(status == "Completed", 0).when(status == "Failed", 1).when(status == "Cancelled", 2).otherwise(3)


def active_rank() -> Column:
    status = F.col("status")
    return F.when(status == "Processing", 0).when(status == "Uploading", 1).when(status == "Downloading", 2).otherwise(3)


def remote(files: DataFrame) -> DataFrame:
    """Files that a node works on."""
    return files.where("assigned_node_id is not null")


def item_counts(files: DataFrame) -> DataFrame:
    return files.agg(F.count_if((F.col("status") == "Queued") & F.col("assigned_node_id").isNull()).alias("pending"), F.count_if(F.col("status") == "Processing").alias("running"), F.count_if(F.col("status").isin("Completed", "Failed", "Skipped")).alias("finished"))


def evicted(files: DataFrame, keep: int) -> DataFrame:
    """Finished items beyond the newest `keep`. Only the bound of the kept ones is looked up."""
    done = files.where("status in ('Completed', 'Failed')").select("id", F.coalesce("last_scanned_at", "created_at").alias("finished_at"))
    last = done.orderBy(F.desc("finished_at"), F.desc("id")).limit(keep).agg(F.min_by(F.struct("finished_at", "id"), F.struct("finished_at", "id")).alias("bound"), F.count("*").alias("n"))
    return done.crossJoin(F.broadcast(last)).where((F.col("n") == keep) & (F.struct("finished_at", "id") < F.col("bound"))).select("id", "finished_at")  # one row


def page_after(files: DataFrame, last: int, take: int, statuses: tuple[str, ...] = ("Queued",)) -> DataFrame:
    """The next rows by id after `last`: pages that don't move when rows before them go. Spark needs them only for
    callers that fetch page by page."""
    return files.where(F.col("id") > last).where(F.col("status").isin(*statuses)).orderBy("id").limit(take)


def capped(rows: DataFrame, order: list[Column], most: int = 20_000, keep: int = 1_000) -> DataFrame:
    """All rows, or the first `keep` where there are more than `most`, each with the number of all rows (total)."""
    head = rows.orderBy(*order).limit(most + 1)
    n = rows.agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))  # of a limited page
    return head.withColumn("place", place).crossJoin(F.broadcast(n)).where((F.col("total") <= most) | (F.col("place") <= keep)).drop("place")
