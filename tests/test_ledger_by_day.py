"""A ledger laid out by day: late jobs, jobs added twice, and what a trailing window reads."""

import datetime

from framelake.operators import ledger

COLUMNS = "job_key long, line_no int, part_key long, node_key long, original_size_bytes long, completed_at timestamp_ntz, bytes_saved long, encode_seconds long"


def jobs(spark, keys, day, saved=1):
    at = datetime.datetime(2024, 1, day, 13)
    return spark.createDataFrame([(k, 1, 1, 1, 10, at, saved, 2) for k in keys], COLUMNS)


def test_by_day(spark, tmp_path):
    d = str(tmp_path / "ledger")
    assert ledger.add_by_period(jobs(spark, range(5), 1).unionByName(jobs(spark, range(5, 8), 2)), d) == 2
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "ledger" / "day=2024-01-02").iterdir()}
    assert ledger.add_by_period(jobs(spark, [20], 3).unionByName(jobs(spark, [4, 9], 1, saved=7)), d) == 2
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "ledger" / "day=2024-01-02").iterdir()}
    rows = {(r["job_key"], r["day"].day, r["bytes_saved"]) for r in ledger.by_period(spark, d).collect()}
    assert rows == {*((k, 1, 1) for k in range(4)), (4, 1, 7), (9, 1, 7), *((k, 2, 1) for k in range(5, 8)), (20, 3, 1)}
    assert ledger.add_by_period(jobs(spark, [20], 3), d) == 1 and ledger.by_period(spark, d).count() == 10
    assert ledger.add_by_period(jobs(spark, [], 3), d) == 0
    window = ledger.trailing(ledger.by_period(spark, d), 2, "2024-01-03 10:00:00")
    assert {r["job_key"] for r in window.collect()} == {5, 6, 7, 20}
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "(day" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_by_month(spark, tmp_path):
    d = str(tmp_path / "ledger")
    assert ledger.add_by_period(jobs(spark, range(5), 1).unionByName(jobs(spark, range(5, 8), 30)), d, "month") == 1
    assert {r["job_key"] for r in ledger.trailing(ledger.by_period(spark, d), 3, "2024-01-31 10:00:00").collect()} == {5, 6, 7}


def test_jobs_are_written_once(spark, tmp_path):
    """A later batch adds its own rows to a day; those that are there are neither read nor written again."""
    d = tmp_path / "ledger"
    ledger.add_by_period(jobs(spark, range(50), 1), str(d))
    before = {p: p.stat().st_mtime_ns for p in d.rglob("*.parquet")}
    assert ledger.add_by_period(jobs(spark, [3, 60], 1, saved=9), str(d)) == 1
    assert before == {p: p.stat().st_mtime_ns for p in before if p.exists()}
    assert sum(spark.read.parquet(str(p)).count() for p in d.rglob("*.parquet")) == 52
    rows = sorted((r["job_key"], r["bytes_saved"]) for r in ledger.by_period(spark, str(d)).collect())
    assert rows == [*((k, 9 if k == 3 else 1) for k in range(50)), (60, 9)]
