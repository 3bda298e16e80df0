"""Verification passes, paths under other roots and events, each against a plain loop."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from framelake.operators import alignment, events, external, sweep, verification
from framelake.sources import files


def plain_pass(rows, most=5):
    """(id, result) of the files that a pass marks, one after the other."""
    out, gone = [], 0
    for i, at, prior, here, found in sorted(rows, key=lambda r: (r[1] is not None, r[1] or datetime.datetime.min, r[0])):
        if not here:
            gone += 1
            if gone >= most:
                break
            out.append((i, prior if prior is not None and prior != "ok" else "missing"))
        else:
            gone = 0
            out.append((i, found))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_verification(spark, seed):
    rng = random.Random(seed)
    n = 120
    here = [rng.random() < 0.75 for _ in range(n)]
    start = {0: 17, 1: 0, 2: n - 5, 3: None}[seed]
    if start is not None:
        here[start : start + 5] = [False] * 5
    if seed == 3:  # never five in a row
        here = [h or (i % 5 == 4) for i, h in enumerate(here)]
    times = sorted(rng.sample(range(10_000), n))
    rows = [(i * 31 % 997, None if t < 300 else datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=t), rng.choice((None, "ok", "corrupt", "missing")), h, rng.choice(("ok", "bad")) if h else None) for i, (t, h) in enumerate(zip(times, here, strict=True))]
    df = spark.createDataFrame(rows, "id long, last_verified_at timestamp_ntz, last_verify_result string, here boolean, found string").repartition(3)
    for ranges in (1, 4, 60):  # runs lie over the borders of ranges
        assert sorted(map(tuple, verification.verified(df, ranges).collect())) == plain_pass(rows)
    assert verification.verified(df.limit(0)).count() == 0


def test_where_a_pass_ends():
    assert verification.ends_at([]) is None
    assert verification.ends_at([(0, 3, 0, 3, None), (1, 1, 1, 1, None), (2, 4, 1, 0, None)]) == (2, 1)
    assert verification.ends_at([(0, 9, 0, 4, None), (1, 9, 0, 4, 7)]) == (1, 7)
    assert verification.ends_at([(0, 9, 9, 9, 5)]) == (0, 5)


def plain_mapped(path, roots):
    parts = [s for s in re.split(r"[\\/]+", path) if s]
    low = [s.lower() for s in parts]
    best, most = None, 0
    for root in roots:
        tail = [s.lower() for s in re.split(r"[\\/]+", root or "") if s]
        for k in range(min(len(tail), len(parts)), most, -1):
            at = next((i for i in range(len(parts) - k + 1) if low[i : i + k] == tail[-k:]), None)
            if at is not None:
                rest = parts[at + k :]
                sign = "\\" if "\\" in root and "/" not in root else "/"
                best, most = (root, root if not rest else root.rstrip("/\\") + sign + sign.join(rest), k), k
                break
    return best


def test_alignment(spark):
    rng = random.Random(1)
    names = ["Movies", "movies", "TV", "a", "b", "x.mkv", "media"]
    roots = ["/".join(["", *rng.choices(names, k=rng.randint(1, 4))]) for _ in range(25)] + ["\\\\nas\\Movies\\", "D:\\tv", "/", "", "//data//Movies//", None]
    paths = ["/".join(["", *rng.choices(names, k=rng.randint(1, 6))]) for _ in range(150)] + ["", "/", "C:\\media\\TV\\x.mkv", None]
    got = {r["path"]: (r["root"], r["mapped"], r["length"]) for r in alignment.aligned(spark.createDataFrame([(p,) for p in paths * 2], "file_path string"), spark.createDataFrame(list(enumerate(roots)), "place int, root string")).collect()}
    want = {p: m for p in paths if p is not None and (m := plain_mapped(p, roots))}
    assert got == want and len(want) > 50
    assert alignment.aligned(spark.createDataFrame([("/a",)], "file_path string"), spark.createDataFrame([], "place int, root string")).count() == 0


def test_events(spark):
    kind = "id long, a string, b double"
    old = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (3, "z", None), (4, "same", 4.0), (None, "lost", 0.0)], kind)
    new = spark.createDataFrame([(4.0, 4, "same"), (None, 3, "z"), (5.0, 2, None), (6.0, 6, "new")], "b double, id long, a string")
    found = events.between(old, new, "id", "item")
    assert {(r["key"], r["kind"]) for r in found.collect()} == {(1, "removed"), (2, "changed"), (6, "added")}
    again = events.replayed(old.where("id is not null"), found.unionByName(found), "id")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, new.select("id", "a", "b").collect()))
    assert {tuple(r) for r in events.counts(found).collect()} == {("item", k, 1) for k in ("removed", "changed", "added")}
    texts = {r["key"]: r["text"] for r in events.told(found).collect()}
    assert texts["6"] == '{"kind":"added","row":{"id":6,"a":"new","b":6.0}}' and set(texts) == {"1", "2", "6"}
    assert events.between(old, old, "id", "item").count() == 0


def test_sweep(spark, tmp_path):
    dirs = spark.createDataFrame([(f"/r{i % 3}", f"/r{i % 3}/d{i}") for i in range(30)], "root string, directory string")
    now = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    hours = lambda n: now + datetime.timedelta(hours=n)
    seen = []

    def look(some):
        seen.extend(r["directory"] for r in some.collect())
        return some.withColumn("path", F.concat("directory", F.lit("/f")))

    d, kind = str(tmp_path / "s"), "root string, directory string, path string"
    assert sweep.run(dirs, d, look, now, chunk=5, most=2) == (1, False)
    with pytest.raises(OSError, match="gone"):
        sweep.run(dirs, d, lambda some: (_ for _ in ()).throw(OSError("gone")), hours(1), chunk=5)
    more = dirs.unionByName(spark.createDataFrame([("/r0", "/r0/new")], "root string, directory string"))
    assert sweep.run(more, d, look, hours(20), chunk=5) == (1, True)
    assert sorted(seen) == sorted(r["directory"] for r in more.collect())
    assert sweep.found(spark, d, 1, kind).count() == 31
    assert sweep.run(dirs, d, look, hours(21), chunk=5, most=1) == (2, False)  # the one before is finished
    assert sweep.run(dirs, d, look, hours(60), chunk=50) == (3, True)  # the one before is too old
    assert sweep.found(spark, d, 3, kind).count() == 30 and sweep.done(spark, d, 2).count() < 30


def test_log_tail(spark, tmp_path):
    path = tmp_path / "a.log"
    for text, lines, want in (("", 3, []), ("a", 3, ["a"]), ("a\nb\r\nc", 2, ["b", "c"]), ("a\nb\n", 1, ["b"]), ("\n\nx\n", 3, ["", "", "x"]), ("a\n" * 9, 0, [])):
        path.write_text(text, newline="")
        assert [r["value"] for r in files.log_tail(spark, str(path), lines, block=2).collect()] == want
    path.write_text("".join(f"line {i} é\n" for i in range(50_000)), encoding="utf-8")
    assert [r["value"] for r in files.log_tail(spark, str(path), 2000).collect()] == [f"line {i} é" for i in range(48_000, 50_000)]
    logs = spark.createDataFrame([("app-1.log", 1), ("app-2.log", 3), ("app-3.txt", 9), ("other.log", 8)], "name string, modified_at int")
    assert files.newest_log(logs, "app-").first()["name"] == "app-2.log"


def test_staged_lists(spark):
    day = lambda n, h=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n, hours=h)
    lists = spark.createDataFrame([(day(0), "/m/", "eng"), (day(0), "/m/a", "ger"), (day(3), "/M", "fra"), (day(3), "/m/b", ""), (None, "/m", "jpn")], "staged_at timestamp_ntz, root string, lang string")
    asked = [("/m/a/x", day(0), "de"), ("/m/ab/x", day(0, 24), "en"), ("/m/a/x", day(1, 1), None), ("/m/b/x", day(3, 5), "fr"), ("/n/x", day(3), None), ("/m/x", day(-1), None), ("/m/x", None, None), (None, day(3), None)]
    files = spark.createDataFrame([a[:2] for a in asked] * 2, "file_path string, at timestamp_ntz")
    got = external.language_at(files, lists).collect()
    assert sorted(((r["file_path"], r["at"], r["language"]) for r in got), key=str) == sorted(asked, key=str)


def test_whole_status_changes(spark):
    """Every finished file is reopened, and every listed path counts, whatever else the list says of it."""
    from framelake.queries import QUERIES, view

    d = "/root/testdata/sf0.001"
    files = view(spark, d, "media_files").select("id", "file_path", "status").collect()
    got = dict(map(tuple, QUERIES["reopen_no_savings"](spark, d).collect()))
    assert got == {r["id"]: "Unseen" if r["status"] == "Completed" else r["status"] for r in files}
    listed = {r["path"] for r in view(spark, d, "scan").where("size % 2 = 0").collect()}
    got = dict(map(tuple, QUERIES["batch_status"](spark, d).collect()))
    assert got == {r["id"]: "Queued" if r["file_path"] in listed else r["status"] for r in files}
