"""Dispatch of the queue against one item after the other."""

import random

import pytest
from pyspark.sql import functions as F

from framelake.operators import dispatch, placement


def tables(spark, seed, n_items, n_nodes):
    rng = random.Random(seed)
    items = [(i, rng.choice((10, 100, 1000)), rng.random() < 0.3, rng.choice(("h265", "av1", "h264")), rng.choice(("auto", "auto", "none", "nvidia", "intel")), "hevc_qsv" if rng.random() < 0.1 else "", i * 7919 % n_items) for i in range(n_items)]
    nodes, devices, slots = [], [], []
    for k in range(n_nodes):
        name = f"n{k}"
        nodes.append((name, name, rng.choice(("worker", "worker", "worker", "master")), rng.choice(("Online", "Busy", "Offline")), rng.random() < 0.1, rng.choice((50, 500, 5000)), rng.random() < 0.1, rng.random() < 0.1, rng.randrange(3)))
        devices.append((name, "cpu", "h264,h265,av1", "libx264,libx265", 1))
        for d, codecs, encoders in (("nvidia", "h264,h265", "h264_nvenc"), ("intel", "h264,h265,av1", "hevc_qsv"), ("music", "aac", "aac")):
            if rng.random() < 0.6:
                devices.append((name, d, codecs, encoders, rng.randint(0, 5)))
                if rng.random() < 0.4:
                    slots.append((f"job{len(slots)}", name, d, "Encoding", 1))
    return (
        spark.createDataFrame(items, "item_id long, size long, is_4k boolean, codec string, hardware string, encoder string, turn long"),
        spark.createDataFrame(nodes, "node_id string, hostname string, role string, status string, is_paused boolean, available_disk_bytes long, only_4k boolean, exclude_4k boolean, heartbeat_rank long"),
        spark.createDataFrame(devices, "node_id string, device_id string, codecs string, encoders string, capacity int"),
        spark.createDataFrame(slots, "job_id string, node_id string, device_id string, phase string, progress int"),
    )


def one_by_one(items, nodes, devices, slots):
    takers = dispatch.dispatchable(nodes)
    rows = placement.video_scores(items, takers, devices, slots).where("score > 0 and used < cap").collect()
    by_item = {}
    for r in rows:
        by_item.setdefault(r["item_id"], []).append(r)
    used, placed = {}, set()
    for item in sorted(items.collect(), key=lambda r: r["turn"]):
        best = None
        for r in by_item.get(item["item_id"], []):
            taken = used.get((r["node_id"], r["device_id"]), 0)
            if r["used"] + taken < r["cap"]:
                key = (-(r["score"] - taken), r["heartbeat_rank"], r["node_id"], r["device_id"])
                best = min(best, key) if best else key
        if best:
            used[best[2:]] = used.get(best[2:], 0) + 1
            placed.add((item["item_id"], *best[2:], -best[0]))
    return placed


@pytest.mark.parametrize(("seed", "n_items", "n_nodes"), [(1, 60, 8), (2, 400, 12), (3, 5, 9)])
def test_dispatch(spark, seed, n_items, n_nodes):
    given = tables(spark, seed, n_items, n_nodes)
    found, rounds = dispatch.dispatch(given[0], ["turn"], *given[1:])
    assert {tuple(r) for r in found.collect()} == one_by_one(*given) and rounds <= 25


def test_many_blocks(spark, monkeypatch):
    """Blocks of one item a free slot, and slots of one device that are taken in several of them."""
    monkeypatch.setattr(dispatch, "BLOCK", 1)
    for seed in (6, 7):
        given = tables(spark, seed, 250, 6)
        assert {tuple(r) for r in dispatch.dispatch(given[0], ["turn"], *given[1:])[0].collect()} == one_by_one(*given)


def test_few_rounds(spark):
    """Items of one class that all like the same slots best get theirs together."""
    items, nodes, devices, slots = tables(spark, 8, 120, 40)
    items = items.withColumns({"size": F.lit(10).cast("long"), "is_4k": F.lit(False), "codec": F.lit("h265"), "hardware": F.lit("auto"), "encoder": F.lit("")})
    found, rounds = dispatch.dispatch(items, ["turn"], nodes, devices, slots)
    assert {tuple(r) for r in found.collect()} == one_by_one(items, nodes, devices, slots) and rounds <= 4


def test_nothing_to_place(spark):
    items, nodes, devices, slots = tables(spark, 4, 5, 3)
    assert dispatch.dispatch(items.where(F.lit(False)), ["turn"], nodes, devices, slots)[0].count() == 0
    assert dispatch.dispatch(items, ["turn"], nodes.where(F.lit(False)), devices, slots)[0].count() == 0


def test_dispatchable(spark):
    nodes = tables(spark, 5, 1, 20)[1].withColumn("cooling", F.col("node_id") == "n1").withColumn("in_schedule", F.when(F.col("node_id") == "n2", False))
    names = {r["node_id"] for r in dispatch.dispatchable(nodes).collect()}
    assert names == {r["node_id"] for r in nodes.collect() if r["role"] == "worker" and r["status"] in ("Online", "Busy") and not r["is_paused"] and r["node_id"] not in ("n1", "n2")}


def test_all_scores(spark, monkeypatch):
    """Scores by class are those of each item by itself, in as many tasks as the pairs ask for."""
    monkeypatch.setattr(placement, "PAIRS", 100)
    items, *cluster = tables(spark, 5, 90, 7)
    items = items.drop("turn").unionByName(spark.createDataFrame([(900, None, True, None, None, None), (901, 5, None, "HEVC", "NVIDIA", " ")], items.drop("turn").schema)).coalesce(1)
    cluster[1] = cluster[1].unionByName(cluster[1].limit(1))  # a device that is listed twice
    plain = sorted(tuple(r[c] for c in ("item_id", "node_id", "device_id", "score")) for r in placement.video_scores(items, *cluster).collect())
    got = placement.all_scores(items, *cluster)
    assert sorted(map(tuple, got.collect())) == plain and got.rdd.getNumPartitions() > 8
    monkeypatch.setattr(placement, "FEW_CLASSES", 3)
    assert sorted(map(tuple, placement.all_scores(items, *cluster).collect())) == plain
