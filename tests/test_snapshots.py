"""A library in buckets: changes rewrite what they touch, hold all at once, and can be done again."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from framelake.operators import scan, snapshots

COLUMNS = "file_path string, file_size long, bitrate long, codec string, width int, height int, duration long, status string, priority int, force_mux boolean, audio_streams string, subtitle_streams string, original_language string, failure_count int"


def files(spark, n, size=1, start=0):
    return spark.createDataFrame([(f"/m/{i}.mkv", size, 1, "h264", 1, 1, 1, "Queued", i % 3, False, None, None, None, 0) for i in range(start, n)], COLUMNS)


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("part-*.parquet"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_changes(spark, tmp_path):
    d = str(tmp_path / "t")
    old = files(spark, 4000)
    snapshots.create(old, d, "file_path", buckets=32)
    whole = size(d)
    assert rows(snapshots.read(spark, d)) == rows(old)
    one, many = files(spark, 1, size=5), files(spark, 400, size=7)
    assert snapshots.change(spark, d, "file_path", one, scan.merge) == 1
    first = size(d) - whole
    assert first < whole / 16
    assert snapshots.change(spark, d, "file_path", files(spark, 4003, size=9, start=4000), scan.merge) <= 3
    assert size(d) - whole - first < 4 * whole / 16
    want = scan.merge(scan.merge(scan.merge(old, one), files(spark, 4003, size=9, start=4000)), many)
    snapshots.change(spark, d, "file_path", many, scan.merge)
    assert rows(snapshots.read(spark, d)) == rows(want) and rows(snapshots.read(spark, d, 1)) == rows(old)
    assert snapshots.versions(spark, d) == [1, 2, 3, 4]
    snapshots.clean(spark, d)
    assert rows(snapshots.read(spark, d)) == rows(want) and snapshots.versions(spark, d) == [4] and size(d) < 1.5 * whole


def test_stopped_before_the_version(spark, tmp_path, monkeypatch):
    d = str(tmp_path / "t")
    old, new = files(spark, 50), files(spark, 20, size=3)
    snapshots.create(old, d, "file_path", buckets=4)
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_list", lambda *a: (_ for _ in ()).throw(InterruptedError))
        with pytest.raises(InterruptedError):
            snapshots.change(spark, d, "file_path", new, scan.merge)
    assert rows(snapshots.read(spark, d)) == rows(old)
    snapshots.change(spark, d, "file_path", new, scan.merge)
    once = rows(snapshots.read(spark, d))
    snapshots.change(spark, d, "file_path", new, scan.merge)
    assert once == rows(scan.merge(old, new)) == rows(snapshots.read(spark, d))


def test_deletes_and_empty_tables(spark, tmp_path):
    d = str(tmp_path / "t")
    snapshots.create(files(spark, 0), d, "file_path")
    assert snapshots.read(spark, d).count() == 0
    snapshots.change(spark, d, "file_path", files(spark, 9).unionByName(files(spark, 1).withColumn("file_path", F.lit(None).cast("string"))), scan.merge)
    assert snapshots.read(spark, d).count() == 9
    gone = files(spark, 9).select("file_path")
    snapshots.change(spark, d, "file_path", gone, lambda old, new: scan.delete_paths(old, new.withColumnRenamed("file_path", "path")))
    assert snapshots.read(spark, d).count() == 0 and snapshots.read(spark, d, 2).count() == 9
    assert snapshots.change(spark, d, "file_path", files(spark, 0), scan.merge) == 0
