"""Transitions of a write-ahead log followed as a stream, against the whole log at once."""

import datetime
import random

import pandas as pd
import pytest

from framelake.session import ship
from framelake.streaming import transitions

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def log_of(seed, n):
    """Entries over some days; some completions come in before their beginnings, some entries twice."""
    rng, rows = random.Random(seed), []
    for number in range(n):
        at = START + datetime.timedelta(minutes=rng.randrange(8000))
        item = rng.randrange(6)
        rows.append((item, number, rng.choice("abc"), False, at))
        if rng.random() < 0.6:
            rows.append((item, number, "done", True, at + datetime.timedelta(minutes=rng.choice((0, 3, 600, 900)))))
        if rng.random() < 0.1:
            rows.append(rows[-1])
    rows += [(None, 1, "a", False, START), (1, None, "a", False, START), (1, 9999, "a", None, START)]
    return sorted(rows, key=lambda r: r[4] + datetime.timedelta(minutes=rng.randrange(40)))


@pytest.mark.parametrize("stops", [[], [1], [1, 2, 3]])
def test_follow(spark, tmp_path, stops):
    ship(spark)
    rows = log_of(len(stops), 150)
    whole = spark.createDataFrame(rows, transitions.LOG)
    for k in range(5):
        part = rows[k * len(rows) // 5 : (k + 1) * len(rows) // 5]
        spark.createDataFrame(part, transitions.LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(transitions.LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    for n in stops:
        transitions.follow(stream, str(tmp_path), batches=n)
    transitions.follow(stream, str(tmp_path))
    got = sorted(map(tuple, transitions.open_transitions(spark, str(tmp_path)).collect()))
    want = sorted(map(tuple, transitions.open_in(whole).collect()))
    assert set(got) ^ set(want) == set() and len(got) == len(want) and any(r[-1] for r in want) and not all(r[-1] for r in want)
    seen = {r["state"] for r in transitions.states(spark, str(tmp_path)).collect()}
    assert seen == {"begun", "overdue", "completed"}


def test_nothing(spark):
    assert transitions.open_in(spark.createDataFrame([], transitions.LOG)).count() == 0


class Counted:
    """A key's state that counts how often it is read and written."""

    exists, hasTimedOut, calls, value, due = False, False, 0, None, None

    @property
    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.exists, self.value = self.calls + 1, True, value

    def setTimeoutTimestamp(self, ms):
        self.calls, self.due = self.calls + 1, ms

    def getCurrentWatermarkMs(self):
        return 0


def test_state_is_asked_once_a_batch():
    """Thousands of entries of several items: the state store is called twice for each batch, not for each entry."""
    state, run = Counted(), transitions._transitions(24)
    for batch in range(2):
        rows = [(item, n, "a", False, batch * 10**6 + n) for item in range(3) for n in range(batch * 1000, batch * 1000 + 1000)]
        rows += [(item, n, "a", True, 5 * 10**6) for item, n, *_ in rows if n % 2 and item]
        frame = pd.DataFrame(rows, columns=["work_item_id", "transition_id", "phase", "completed", "micros"])
        assert sum(len(x) for x in run((7,), iter([frame]), state)) == len(rows)
    assert state.calls == 5 and len(state.value[0]) == 4000 and state.due == 24 * 3_600_000 - 1
