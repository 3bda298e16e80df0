"""Dispatch of a queue to the slots of a cluster, as if its items were placed one by one in the queue's order.

A device with free slots is as many slots, of which each is worth one less than the one before, as load is to spread.
One by one, each item would take the best slot that is left. The same comes out of deferred acceptance, in rounds that
look at all items at once: each item asks for the best slot that no earlier item holds, each device hands its slots to
those that ask in the queue's order, as long as they don't like a slot elsewhere better, and an item that loses its slot
to an earlier one asks again. Slots only ever go to earlier items, so it ends, and as all slots rank items alike there
is just one result.

Later items take nothing from earlier ones, so the queue is gone through in blocks of a few items for each free slot, in
order; between blocks the slots that are taken and the items that fit on no free one are left out, so the first item of
each block gets a slot. What a round looks at depends on the cluster, not on the queue. Items that are alike but for
their size are a class, with one list of slots. A block's items lie beside the list of their class once for all rounds; a
round brings who holds which slot to them, two numbers a slot. What an earlier item of a class asks for, a later one of
the class doesn't ask for in that round, so a class needn't lose its slots one by one. The earliest item asks for the same
slot in all rounds, and once the first few do, so does the next one: it ends, with the same result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.placement import DISPATCHABLE, video_scores
from framelake.session import discard, written

#: Items of a block for each free slot.
BLOCK = 2
#: Slots that are looked at together.
_WINDOW = 512
_FREE = np.iinfo(np.int64).max
_ALIKE = ["is_4k", "codec", "hardware", "encoder"]


def dispatchable(nodes: DataFrame) -> DataFrame:
    """Nodes that take work: workers in a working state, not paused; inside their schedule, warmed up and out of their
    cooldown where columns in_schedule, warmed_up and cooling say so."""
    rows = nodes.where((F.col("role") == "worker") & F.col("status").isin(*DISPATCHABLE) & ~F.col("is_paused"))
    for name, wanted in (("in_schedule", True), ("warmed_up", True), ("cooling", False)):
        if name in nodes.columns:
            rows = rows.where(F.coalesce(F.col(name), F.lit(wanted)) == wanted)
    return rows


def slot_lists(items: DataFrame, nodes: DataFrame, devices: DataFrame, slots: DataFrame) -> DataFrame:
    """(class, at, node_id, device_id, turn, disk, score): for each class of items its free slots, best first. Ties go to
    the older heartbeat, then by name; `turn` numbers the slots of a device."""
    classes = items.select(*_ALIKE).distinct().withColumn("size", F.lit(0).cast("long")).withColumn("item_id", F.xxhash64(*_ALIKE))
    takers = dispatchable(nodes)
    scored = video_scores(classes, takers, devices, slots).where("score > 0 and used < cap").join(takers.select("node_id", F.col("available_disk_bytes").alias("disk")), "node_id")
    each = scored.select("*", F.explode(F.sequence(F.lit(0), F.col("cap") - F.col("used") - 1)).alias("turn")).withColumn("score", F.col("score") - F.col("turn"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "heartbeat_rank", "node_id", "device_id", "turn")
    return each.select(F.col("item_id").alias("class"), F.row_number().over(order).alias("at"), "node_id", "device_id", "turn", "disk", "score")


def _asks(device, room, by, needs, place) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the items of a class in order: where in their list the best slot is that no earlier item holds or asks for, and
    the best one of another device, -1 where there is none; and whether the item holds the first. Changes `by`."""
    best, other, holds = np.full(len(place), -1), np.full(len(place), -1), np.zeros(len(place), dtype=bool)
    for k in range(len(place)):
        if k % 64 == 0:
            left = np.flatnonzero(by >= place[k])  # what an earlier item has is gone for all later ones
        for lo in range(0, len(left), _WINDOW):
            some = left[lo : lo + _WINDOW]
            some = some[(room[some] >= needs[k]) & (by[some] >= place[k])]
            if len(some) and best[k] < 0:
                best[k] = some[0]
            if best[k] >= 0:
                some = some[device[some] != device[best[k]]]
                if len(some):
                    other[k] = some[0]
                    break
        if best[k] >= 0:
            holds[k] = by[best[k]] == place[k]
            by[best[k]] = place[k]
    return best, other, holds


def _asked(rows: DataFrame, details: DataFrame, held: DataFrame) -> DataFrame:
    """(node_id, device_id, place, holds, other, own, first): what each item asks for. other is how far down its list the
    best slot elsewhere is that no earlier item has, own how far down the slots of this device are, of which `first`
    is the first that was free before."""
    names = ["class", "place", "at", "holds", "other"]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                place, size, at, slot, device, disk, taken, holder = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("place", "size", "at", "slot", "device", "disk", "taken", "holder"))
                by = np.full(len(slot), _FREE)
                if len(taken):
                    order = np.argsort(taken)
                    where = np.minimum(np.searchsorted(taken, slot, sorter=order), len(taken) - 1)
                    same = taken[order][where] == slot
                    by[same] = holder[order][where][same]
                best, other, holds = _asks(device, disk.astype(float), by, size * 2.5, place)
                some = best >= 0
                best, other, holds, place = best[some], other[some], holds[some], place[some]
                further = pa.array(at[other].astype(np.int32), pa.int32(), mask=other < 0)
                columns = [pa.array(np.full(len(place), b.column("class")[i].as_py()), pa.int64()), pa.array(place, pa.int64()), pa.array(at[best].astype(np.int32)), pa.array(holds), further]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    now = held.agg(F.collect_list(F.struct(F.xxhash64("node_id", "device_id", "turn").alias("slot"), "place")).alias("h")).select(F.col("h.slot").alias("taken"), F.col("h.place").alias("holder"))
    asked = rows.crossJoin(F.broadcast(now)).mapInArrow(run, "class bigint, place bigint, at int, holds boolean, other int")
    return asked.join(details, ["class", "at"]).select("node_id", "device_id", "place", "holds", "other", "own", "first")


def _handed_out(asked: DataFrame) -> DataFrame:
    """(node_id, device_id, turn, place): the slots of each device after a round."""
    # holders first, and as many others as there are slots; who isn't looked at asks again
    first = Window.partitionBy("node_id", "device_id").orderBy(F.desc_nulls_last("holds"), "place")
    some = asked.withColumn("n", F.row_number().over(first)).where(F.col("n") <= 2 * F.size("own"))
    each = some.groupBy("node_id", "device_id").agg(F.array_sort(F.collect_list(F.struct("place", "other", "own"))).alias("who"), F.min("first").alias("first"))
    taken = F.expr(
        """aggregate(who, cast(array() as array<bigint>), (got, x) ->
        if(size(got) < size(x.own) and (x.other is null or get(x.own, size(got)) < x.other), concat(got, array(x.place)), got))"""
    )
    return each.select("node_id", "device_id", "first", F.posexplode(taken).alias("n", "place")).select("node_id", "device_id", (F.col("first") + F.col("n")).alias("turn"), "place")


def _settled(block: DataFrame, lists: DataFrame) -> tuple[DataFrame, int]:
    """(node_id, device_id, turn, item_id): who holds which slot once nothing moves any more, and the rounds that it
    took."""
    # a block is no larger than the cluster, so one task may number it
    ranked = written(block.select("item_id", "size", "class", F.row_number().over(Window.orderBy("place")).cast("long").alias("place")), "ranked")
    some = ranked.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("place", "size"))).alias("i")).select("class", F.col("i.place").alias("place"), F.col("i.size").alias("size"))
    facts = F.struct("at", F.xxhash64("node_id", "device_id", "turn").alias("slot"), F.xxhash64("node_id", "device_id").alias("device"), "disk")
    each = lists.groupBy("class").agg(F.array_sort(F.collect_list(facts)).alias("s")).select("class", *[F.col(f"s.{c}").alias(c) for c in ("at", "slot", "device", "disk")])
    rows = written(some.join(each, "class").repartition(32), "lists-of-items")
    own = lists.groupBy("class", "node_id", "device_id").agg(F.array_sort(F.collect_list("at")).alias("own"), F.min("turn").alias("first"))
    details = written(lists.select("class", "at", "node_id", "device_id").join(own, ["class", "node_id", "device_id"]), "slot-details")
    none = lists.select("node_id", "device_id", "turn").where(F.lit(False))
    held, state, rounds = written(none.join(ranked.select("place"), F.lit(False), "left"), "held"), None, 0
    while True:
        rounds += 1
        before, held = held, written(_handed_out(_asked(rows, details, held)), "held")
        discard(before)
        now = tuple(held.agg(F.count("*"), F.sum(F.xxhash64("node_id", "device_id", "turn", "place").cast("decimal(20,0)"))).first())
        if now == state:
            found = written(held.join(ranked.select("place", "item_id"), "place").drop("place"), "held")
            discard(held, ranked, rows, details)
            return found, rounds
        state = now


def dispatch(items: DataFrame, order: list[str], nodes: DataFrame, devices: DataFrame, slots: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, node_id, device_id, score) of the items that get a slot, and the number of rounds that it took.

    Items (item_id, size, is_4k, codec, hardware, encoder) are placed in ascending order of the columns `order`, which no
    two items may share; descending ones come negated. Items that fit nowhere, or for which no slot is left, have no row.
    """
    lists = written(slot_lists(items, nodes, devices, slots), "slot-lists")
    queue = items.select("item_id", "size", F.xxhash64(*_ALIKE).alias("class"), F.struct(*order).alias("place"))
    kind = "item_id {}, node_id string, device_id string, score int".format(items.schema["item_id"].dataType.simpleString())
    parts, rounds, last = [items.sparkSession.createDataFrame([], kind)], 0, None
    while True:
        free = lists.select("node_id", "device_id", "turn").distinct().count()
        most = lists.groupBy("class").agg(F.max("disk").alias("most"))
        left = queue if last is None else queue.where(F.col("place") > last)
        fits = left.join(most, "class").where(F.col("most") >= F.col("size") * 2.5).drop("most")
        block = written(fits.orderBy("place").limit(BLOCK * free), "queue-block")
        end = block.agg(F.count("*").alias("n"), F.max("place").alias("place")).first()
        if end["n"]:
            held, more = _settled(block, lists)
            rounds += more
            scored = held.join(block.select("item_id", "class"), "item_id").join(lists.select("class", "node_id", "device_id", "turn", "score"), ["class", "node_id", "device_id", "turn"])
            parts.append(written(scored.select("item_id", "node_id", "device_id", "score"), "placed"))
            before, lists = lists, written(lists.join(held.select("node_id", "device_id", "turn"), ["node_id", "device_id", "turn"], "left_anti"), "slot-lists")
            discard(before, held)
        discard(block)
        if not end["n"] or end["n"] < BLOCK * free:
            discard(lists)
            return functools.reduce(DataFrame.unionByName, parts), rounds
        last = F.struct(*[F.lit(end["place"][c]).cast(queue.schema["place"].dataType[c].dataType).alias(c) for c in order])
