"""A write-ahead log of transitions as state of a stream.

A transition is begun before a change and completed after it; one that stays open was interrupted. The log is a feed of
entries (work_item_id, transition_id, phase, completed, at): one when it begins, one with `completed` when it is done.
The stream's state holds the open transitions of some work items at each key, and a timer for the one that is due first;
an entry that completes one which hasn't begun yet is kept until it does, so entries may come in any order. What changes goes to a folder for each batch,
written again if the batch is, so what a stream that was stopped or killed leaves behind is what it would have been.

State is spread over the work items and lies with the stream's checkpoint in the shared folder. An open transition ends
with its completion; a completion without a beginning is forgotten once its timer runs out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelake.streaming.feeds import append_to, push

#: Hours after which an open transition needs recovery.
HOURS = 24
#: What the stream reads.
LOG = "work_item_id long, transition_id long, phase string, completed boolean, at timestamp"
#: What the stream gives out: a transition begins, is completed, or is overdue.
CHANGE = "work_item_id long, transition_id long, phase string, state string, at timestamp"


#: Work items are dealt to so many keys of the state by a hash: calling a function costs far more than a row does.
KEYS = 512
#: What waits at a key, transition by transition: since when, and whether it is begun, overdue, or early (a completion
#: without its beginning).
STATE = "item array<bigint>, number array<bigint>, phase array<string>, since array<bigint>, kind array<string>"


def _transitions(hours: int):
    """The function of one key: its state comes and goes whole with the rows of a batch, so a row costs no call of the
    state store. Times are microseconds; the key's timer is that of the transition that is due first."""
    limit = int(hours * 3_600_000)

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = {(item, n): (phase, since, kind) for item, n, phase, since, kind in zip(*state.get, strict=True)} if state.exists else {}
        found: list[tuple] = []
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(["micros", "completed", "transition_id"])
            for item, n, phase, completed, at in zip(*(rows[c].tolist() for c in ("work_item_id", "transition_id", "phase", "completed", "micros")), strict=True):
                number = (item, n)
                old = waiting.get(number)
                if completed:
                    if old and old[2] != "early":
                        del waiting[number]
                        found.append((item, n, old[0], "completed", at))
                    else:
                        waiting[number] = (None, at, "early")
                elif old and old[2] == "early":
                    del waiting[number]
                    found.append((item, n, phase, "completed", old[1]))
                elif not old:
                    waiting[number] = (phase, at, "begun")
                    found.append((item, n, phase, "begun", at))
        now, due = state.getCurrentWatermarkMs(), None
        for number, (phase, since, kind) in [x for x in waiting.items() if x[1][2] != "overdue"]:
            ms = since // 1000 + limit
            if ms > now:
                due = ms if due is None else min(due, ms)
            elif kind == "early":
                del waiting[number]
            else:
                waiting[number] = (phase, since, "overdue")
                found.append((*number, phase, "overdue", since))
        if waiting:
            state.update(tuple(map(list, zip(*((*k, *v) for k, v in waiting.items()), strict=True))))
            if due is not None:
                state.setTimeoutTimestamp(due - 1)  # it runs out once the watermark is past it, so at `due`
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=["work_item_id", "transition_id", "phase", "state", "micros"])

    return run


def entries(transitions: DataFrame, at: Column, completed: bool) -> DataFrame:
    """Entries of the log for transitions (work_item_id, transition_id, phase) that begin, or are completed, at a time."""
    return transitions.select("work_item_id", "transition_id", "phase", F.lit(completed).alias("completed"), at.cast("timestamp").alias("at"))


def open_in(log: DataFrame, hours: int = HOURS, late: str = "1 hour") -> DataFrame:
    """(work_item_id, transition_id, phase, at, overdue): what `open_transitions` says after the whole log, from the log."""
    rows = log.where("work_item_id is not null and transition_id is not null and at is not null").withColumn("at", F.col("at").cast("timestamp"))
    newest = rows.agg((F.max("at") - F.expr(f"interval {late}")).alias("seen"))
    done = rows.where("completed").select("work_item_id", "transition_id").distinct()
    left = rows.where("not coalesce(completed, false)").groupBy("work_item_id", "transition_id").agg(F.min_by("phase", "at").alias("phase"), F.min("at").alias("at")).join(done, ["work_item_id", "transition_id"], "left_anti")
    overdue = F.col("at") + F.expr(f"interval {hours} hours") <= F.col("seen")
    return left.crossJoin(F.broadcast(newest)).select("work_item_id", "transition_id", "phase", "at", overdue.alias("overdue"))  # one row


def changes(log: DataFrame, hours: int = HOURS, late: str = "1 hour") -> DataFrame:
    """Changes (CHANGE) of a stream of log entries. Rows without an item, a number or a time say nothing and are left out,
    and so are rows that come more than `late` behind the newest one before their batch."""
    rows = log.where("work_item_id is not null and transition_id is not null and at is not null")
    rows = rows.select(F.col("work_item_id").cast("long").alias("work_item_id"), F.col("transition_id").cast("long").alias("transition_id"), "phase", F.coalesce("completed", F.lit(False)).alias("completed"), F.col("at").cast("timestamp").alias("at"))
    rows = rows.withColumns({"micros": F.unix_micros("at"), "key": F.pmod(F.xxhash64("work_item_id"), F.lit(KEYS))}).withWatermark("at", late)
    found = rows.groupBy("key").applyInPandasWithState(_transitions(hours), CHANGE.replace("at timestamp", "micros long"), STATE, "Update", GroupStateTimeout.EventTimeTimeout)
    return found.select("work_item_id", "transition_id", "phase", "state", F.timestamp_micros("micros").alias("at"))


def prepare(spark: SparkSession) -> None:
    """State with timers lies in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def follow(log: DataFrame, folder: str, hours: int = HOURS, late: str = "1 hour", batches: int | None = None):
    """Runs the stream over what the log holds now, from where it stopped before in `folder`, and returns when it has
    seen it; with `batches` it is stopped after so many, as if it had been killed."""
    spark = log.sparkSession
    prepare(spark)
    write = append_to(f"{folder}/changes")

    def sink(batch: DataFrame, number: int) -> None:
        if batches is not None and number >= batches:
            raise InterruptedError(f"stopped before batch {number}")
        write(batch, number)

    query = push(changes(log, hours, late), sink, f"{folder}/state", mode="update")
    try:
        query.awaitTermination()
    except Exception as e:
        if "stopped before batch" not in str(e):
            raise
    finally:
        query.stop()


def states(spark: SparkSession, folder: str) -> DataFrame:
    """(work_item_id, transition_id, phase, state, at): the last word on each transition that was seen to begin."""
    rows = spark.read.schema(CHANGE + ", batch long").parquet(f"{folder}/changes")
    order = F.struct(F.array_position(F.array(*[F.lit(x) for x in ("begun", "overdue", "completed")]), F.col("state")))
    last = rows.groupBy("work_item_id", "transition_id").agg(F.max_by(F.struct("phase", "state", "at"), order).alias("last"))
    return last.select("work_item_id", "transition_id", "last.phase", "last.state", "last.at")


def open_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """Transitions that are open after all batches so far, and which of them are overdue."""
    return states(spark, folder).where("state <> 'completed'").select("work_item_id", "transition_id", "phase", "at", (F.col("state") == "overdue").alias("overdue"))
