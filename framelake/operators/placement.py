"""Placing work on nodes: capacity, scores, the best slot, and what a watchdog sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Devices that are sent to all executors; more of them are dealt out.
FEW_PLACES = 100_000
#: Classes of items whose scores each place carries along, at most; places of a task that makes pairs and its rows, about.
FEW_CLASSES = 1_000
PLACES = 4_000
PAIRS = 2_000_000
MANY_TASKS = 2_000
ALIKE = ["is_4k", "codec", "hardware", "encoder"]
DISPATCHABLE = ("Online", "Busy", "Uploading", "Downloading")


def first_local(items: DataFrame, deferred: DataFrame, skip: Column) -> DataFrame:
    """The first pending video, in the queue's order (column place), that isn't deferred (column id) or left to nodes."""
    fit = items.where("kind = 'Video' and status = 'Pending'").where(~F.coalesce(skip, F.lit(False)))
    return fit.join(deferred.select("id").distinct(), "id", "left_anti").orderBy("place", "id").limit(1)


def reserve(slots: DataFrame, wishes: DataFrame, capacities: DataFrame) -> DataFrame:
    """The slots after a round of wishes (job_id, node_id, device_id, asked): each place (node_id, device_id, cap) takes
    the wishes asked first, as far as it has room. Jobs that have a slot, and wishes without a place, get none. A job
    that asks several times asks once, first."""
    named = wishes.where("job_id <> '' and node_id <> '' and device_id <> ''").join(slots.select("job_id"), "job_id", "left_anti")
    once = named.groupBy("job_id").agg(F.min_by(F.struct("node_id", "device_id", "asked"), F.struct("asked", "node_id", "device_id")).alias("w")).select("job_id", "w.*")
    room = capacities.join(used_slots(slots), ["node_id", "device_id"], "left").select("node_id", "device_id", (F.col("cap") - F.coalesce("used", F.lit(0))).alias("room"))
    order = Window.partitionBy("node_id", "device_id").orderBy("asked", "job_id")
    won = once.join(room.where("room > 0"), ["node_id", "device_id"]).withColumn("turn", F.row_number().over(order)).where("turn <= room")
    return slots.select("job_id", "node_id", "device_id", "phase", "progress").unionByName(won.select("job_id", "node_id", "device_id", F.lit("Reserved").alias("phase"), F.lit(0).alias("progress")))


def release(slots: DataFrame, done: DataFrame) -> DataFrame:
    """The slots without those of jobs (job_id) that ended."""
    return slots.join(done.select("job_id").distinct(), "job_id", "left_anti")


def rekey(slots: DataFrame, moves: DataFrame) -> DataFrame:
    """The slots with jobs renamed (job_id, new_id); a name that is taken stays with its holder."""
    taken = slots.select(F.col("job_id").alias("new_id"))
    free = moves.join(taken, "new_id", "left_anti").groupBy("new_id").agg(F.min("job_id").alias("job_id"))
    free = free.groupBy("job_id").agg(F.min("new_id").alias("new_id"))
    return slots.join(free, "job_id", "left").withColumn("job_id", F.coalesce("new_id", "job_id")).drop("new_id")


def used_slots(slots: DataFrame) -> DataFrame:
    return slots.groupBy("node_id", "device_id").agg(F.count("*").alias("used"))


def slots_by_phase(slots: DataFrame) -> DataFrame:
    return slots.groupBy("phase").agg(F.count("*").alias("slots"), F.max("progress").alias("furthest"))


def capacity(device: Column, default: Column, configured: Column | None = None) -> Column:
    """Slots of a device: one for the CPU, else what is configured, else its own, never negative."""
    own = F.coalesce(configured, default) if configured is not None else default
    return F.when(device == "cpu", 1).otherwise(F.greatest(F.lit(0), own))


def _codecs(c: Column) -> Column:
    return F.split(F.lower(c), ",")


def _places(nodes: DataFrame, devices: DataFrame, slots: DataFrame) -> DataFrame:
    """The devices with their nodes, slots, and what the node's hardware can do."""
    used = used_slots(slots).select("node_id", "device_id", F.col("used").cast("int").alias("used"))
    places = devices.join(nodes, "node_id").join(used, ["node_id", "device_id"], "left").fillna({"used": 0})
    able = devices.where("device_id <> 'cpu'").groupBy("node_id").agg(F.collect_set(F.struct("device_id", "codecs")).alias("hardware_codecs"))
    return places.join(able, "node_id", "left").withColumn("cap", capacity(F.col("device_id"), F.col("capacity")))


def _score(is_4k: Column, codec: Column, hardware: Column, encoder: Column, too_large: Column) -> Column:
    """The score of an item on the place of the row."""
    codec = F.when(F.lower(codec).isin("h265", "hevc"), "h265").when(F.lower(codec).isin("h264", "avc"), "h264").otherwise(F.lower(codec))
    hw, cpu, exact = F.coalesce(F.lower(hardware), F.lit("auto")), F.col("device_id") == "cpu", F.coalesce(F.trim(encoder), F.lit("")) != ""
    usable = F.coalesce(F.exists("hardware_codecs", lambda d: F.array_contains(_codecs(d["codecs"]), codec)), F.lit(False))
    chosen = F.coalesce(F.exists("hardware_codecs", lambda d: (d["device_id"] == hw) & F.array_contains(_codecs(d["codecs"]), codec)), F.lit(False))
    base = F.when(exact, 21).when(hw == "none", 7).when(hw == "auto", F.when(cpu, 6).otherwise(9)).when(F.col("device_id") == hw, 13).otherwise(1)
    return (
        F.when(F.col("device_id") == "music", -100)
        .when(F.col("only_4k") & ~is_4k, -100)
        .when(F.col("exclude_4k") & is_4k, -100)
        .when(exact & ~F.array_contains(F.split(F.lower("encoders"), ","), F.lower(encoder)), -100)
        .when(too_large, -100)
        .when(~F.array_contains(_codecs(F.col("codecs")), codec), -50)
        .when(~exact & (hw == "none") & ~cpu, -50)
        .when(~exact & ~hw.isin("none", "auto") & cpu & chosen, -50)
        .when(~exact & (hw == "auto") & cpu & usable, -50)
        .when(~exact & ~hw.isin("none", "auto") & ~cpu & (F.col("device_id") != hw), -50)
        .otherwise(base + F.greatest(F.lit(0), F.col("cap") - F.col("used")))
    ).cast("int")


def video_scores(items: DataFrame, nodes: DataFrame, devices: DataFrame, slots: DataFrame) -> DataFrame:
    """A score for each item (item_id, size, is_4k, codec, hardware, encoder) on each device of each node: -100 and -50
    where it can't or mustn't run, else 1 and more for a better fit and for free slots. Every item is held against every
    device, which is for few items, as classes are: `all_scores` gives the scores of many, and `best_slots_by_class`
    places items without making those rows."""
    places = _places(nodes, devices, slots)
    few = places.limit(FEW_PLACES + 1).count() <= FEW_PLACES  # a cluster's devices, which are small rows
    both = items.crossJoin(F.broadcast(places) if few else places)
    score = _score(*[F.col(c) for c in ALIKE], F.col("available_disk_bytes") < F.col("size") * 2.5)
    return both.select("item_id", "node_id", "device_id", "status", "is_paused", "heartbeat_rank", "cap", "used", score.alias("score"))


def all_scores(items: DataFrame, nodes: DataFrame, devices: DataFrame, slots: DataFrame) -> DataFrame:
    """(item_id, node_id, device_id, score) as in `video_scores`. Items that are alike but for their size are a class,
    which is scored once for each place; a pair takes the score of its class unless the disk is too small. Parts of the
    items meet parts of the places, so a task holds few places, however many there are, and however few files they come in."""
    places = _places(nodes, devices, slots)
    m = places.count()
    # a page of classes, which is all of them where they are few
    found = items.groupBy(*ALIKE).agg(F.count("*").alias("items")).limit(FEW_CLASSES + 1).collect()
    few = len(found) <= FEW_CLASSES
    n = sum(r["items"] for r in found) if few else items.count()
    beside, tasks = dealt(n, m)
    items = items.repartition(tasks)
    if not few:
        return video_scores(items, nodes, devices, slots).select("item_id", "node_id", "device_id", "score")
    classes = items.sparkSession.createDataFrame([tuple(r[c] for c in ALIKE) for r in found], items.select(*ALIKE).schema).select(F.struct(*ALIKE).alias("c"))
    # one row; a disk that is too small is seen to below
    classes = F.broadcast(classes.agg(F.array_sort(F.collect_list("c")).alias("classes")))
    scores = F.transform("classes", lambda c: _score(*[c[k] for k in ALIKE], F.lit(None).cast("boolean")))
    scored = places.crossJoin(classes).select("node_id", "device_id", "available_disk_bytes", scores.alias("scores")).repartition(beside)
    numbered = items.crossJoin(classes).select("item_id", (F.col("size") * 2.5).alias("needs"), F.array_position("classes", F.struct(*ALIKE)).cast("int").alias("class"))
    both = numbered.crossJoin(scored.hint("shuffle_replicate_nl"))
    score = F.when(F.col("available_disk_bytes") < F.col("needs"), -100).otherwise(F.get("scores", F.col("class") - 1))
    return both.select("item_id", "node_id", "device_id", score.alias("score"))


def dealt(n: int, m: int) -> tuple[int, int]:
    """Into how many parts m places and n items are dealt, of which each two meet in a task: a task holds few places, and
    makes about PAIRS pairs as long as there are no more than MANY_TASKS, then up to ten times as many."""
    beside = max(1, -(-m // PLACES))
    tasks = max(min(-(-n * m // PAIRS), MANY_TASKS), -(-n * m // (10 * PAIRS)))
    return beside, max(1, -(-tasks // beside))


def music_score(used: Column, supports: Column) -> Column:
    return F.when(~supports, -100).otherwise(F.greatest(F.lit(1), 100 - used * 10))


def best_slots(scores: DataFrame) -> DataFrame:
    """The best free slot of each item on a node that takes work; on ties the older heartbeat, then the names. Items
    without one have no row."""
    fit = scores.where(F.col("status").isin(*DISPATCHABLE) & ~F.col("is_paused") & (F.col("used") < F.col("cap")) & (F.col("score") > 0))
    best = F.min_by(F.struct("node_id", "device_id", "score"), F.struct(-F.col("score"), "heartbeat_rank", "node_id", "device_id"))
    return fit.groupBy("item_id").agg(best.alias("b")).select("item_id", "b.node_id", "b.device_id", "b.score")


def best_slots_by_class(items: DataFrame, nodes: DataFrame, devices: DataFrame, slots: DataFrame) -> DataFrame:
    """The rows of `best_slots`, without a row for each item and device. Items that are alike but for their size are a
    class; of a class's places, best first, only those count that have more disk than all better ones, and an item
    takes the first that has room for it. Classes are few, and a class's list is short."""
    alike = ["is_4k", "codec", "hardware", "encoder"]
    classes = items.select(*alike).distinct().withColumn("size", F.lit(0).cast("long")).withColumn("item_id", F.xxhash64(*alike))
    scored = video_scores(classes, nodes, devices, slots).join(nodes.select("node_id", "available_disk_bytes"), "node_id")
    fit = scored.where(F.col("status").isin(*DISPATCHABLE) & ~F.col("is_paused") & (F.col("used") < F.col("cap")) & (F.col("score") > 0))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "heartbeat_rank", "node_id", "device_id")
    before = F.max("available_disk_bytes").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fit = fit.withColumn("place", F.row_number().over(order)).withColumn("before", before).where("before is null or available_disk_bytes > before")
    lists = fit.groupBy(F.col("item_id").alias("class")).agg(F.array_sort(F.collect_list(F.struct("place", "available_disk_bytes", "node_id", "device_id", "score"))).alias("places"))
    chosen = F.get(F.filter("places", lambda p: p["available_disk_bytes"] >= F.col("size") * 2.5), 0)
    placed = items.withColumn("class", F.xxhash64(*alike)).join(lists, "class").withColumn("b", chosen).where("b is not null")
    return placed.select("item_id", "b.node_id", "b.device_id", "b.score")


def watchdog(items: DataFrame, nodes: DataFrame, active: DataFrame, remote: DataFrame) -> DataFrame:
    """Classes of running items (id, assigned_node_id, idle_minutes) that haven't moved for five minutes: on a node that
    is gone, or without a node and neither among this machine's jobs (active: id) nor among those on nodes (remote: id).
    An item on a node whose job is known is stalled after ten minutes. All others are in order."""
    n = nodes.select(F.col("node_id").alias("known_node")).distinct()
    here, there = (x.select(F.col("id").alias(k)).distinct() for x, k in ((active, "active_id"), (remote, "remote_id")))
    rows = items.join(n, items["assigned_node_id"] == n["known_node"], "left").join(here, items["id"] == here["active_id"], "left").join(there, items["id"] == there["remote_id"], "left")
    on_node, idle = F.col("assigned_node_id").isNotNull(), F.col("idle_minutes")
    what = (
        F.when(F.coalesce(idle, F.lit(0)) < 5, "ok")
        .when(on_node & F.col("known_node").isNull(), "ghost-node")
        .when(~on_node & F.col("active_id").isNull() & F.col("remote_id").isNull(), "local-orphan")
        .when(on_node & F.col("remote_id").isNotNull() & (idle >= 10), "stalled-remote")
        .otherwise("ok")
    )
    return rows.select("id", "assigned_node_id", "idle_minutes", what.alias("class"))


def reconcile(reported: DataFrame, assigned: DataFrame) -> DataFrame:
    """A node's reported jobs (job_id, state) against those it was given (job_id): in progress, completed, idle and in
    grace, or unknown to us."""
    both = reported.withColumn("r", F.lit(True)).join(assigned.withColumn("a", F.lit(True)), "job_id", "full")
    what = F.when(F.col("r").isNull(), "idle-grace").when(F.col("a").isNull(), "unknown").when(F.col("state") == "done", "completed").when(F.col("state") == "receiving", "receiving").otherwise("progress")
    return both.select("job_id", what.alias("class"))


def node_status(paused: Column, used: Column) -> Column:
    return F.when(paused, "Paused").when(used > 0, "Busy").otherwise("Online")


def signatures(devices: DataFrame) -> DataFrame:
    """A node's capabilities as one canonical string: equal nodes have equal ones."""
    one = F.concat_ws("=", "device_id", F.array_join(F.array_sort(_codecs(F.col("codecs"))), "+"))
    return devices.groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_list(one)), ";").alias("signature"))


def encoder_catalog(local: DataFrame, workers: DataFrame, registry: DataFrame) -> DataFrame:
    """Encoders (codec, encoder, source) of the local machine, then of workers, then of the registry, each name once
    whatever its case."""
    ranked = local.withColumn("rank", F.lit(0)).unionByName(workers.withColumn("rank", F.lit(1))).unionByName(registry.withColumn("rank", F.lit(2)))
    return ranked.groupBy(F.lower("encoder").alias("key")).agg(F.min_by(F.struct("codec", "encoder", "rank"), "rank").alias("b")).select("b.codec", "b.encoder", F.element_at(F.array(F.lit("local"), F.lit("worker"), F.lit("registry")), F.col("b.rank") + 1).alias("source")).orderBy("codec", "encoder")


def phase_label(phase: Column) -> Column:
    """Phases as they travel between nodes: a slot counts as uploading until bytes flow, as downloading at its end."""
    return F.when(phase == "Encoding", "Encoding").when(phase.isin("Downloading", "Completing"), "Downloading").otherwise("Uploading")


def phase_of(label: Column) -> Column:
    """Phases as they are read back; unknown ones are taken as encoding."""
    return F.when(label.isin("Receiving", "Uploading"), "Uploading").when(label == "Downloading", "Downloading").otherwise("Encoding")


def master(nodes: DataFrame) -> DataFrame:
    """The node that leads: the least name among those that may, letter by letter."""
    return nodes.where("role = 'master'").agg(F.min("node_id").alias("node_id"))


def silent(nodes: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Nodes (node_id, last_heartbeat) to remove."""
    return nodes.where(F.col("last_heartbeat") < now - F.make_interval(mins=F.lit(minutes)))
