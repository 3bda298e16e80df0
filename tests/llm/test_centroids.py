"""Exponion search against distances to all centroids."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import centroids

D = 64


def plain(rows):
    """(vec_id, cluster, distance, cluster inertia, inertia, digest) with Python integers alone."""
    x = [(i, [math.floor(64 * float(c)) for c in e]) for i, e in rows if e is not None and len(e) == D and all(c is not None and math.isfinite(c) for c in e)]
    if not x:
        return []
    start = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in start[:16]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for n in range(4):
        at = [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in x]
        if n < 3:
            for j in range(len(c)):
                own = [v for (_, v), k in zip(x, at, strict=True) if k == j]
                if own:
                    c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    d = [far(v, c[j]) for (_, v), j in zip(x, at, strict=True)]
    inertia = {j: sum(e for e, k in zip(d, at, strict=True) if k == j) for j in set(at)}
    return [(i, j, e, inertia[j], sum(d), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), j, e in zip(x, at, d, strict=True)]


def rows_of(spark, folder, rows):
    df = spark.createDataFrame([(i, e, 1, "clash", 0.5) for i, e in rows], "vec_id long, embedding array<float>, label int, cluster string, distance double")
    return sorted(map(tuple, centroids.op11_centroids(spark, folder(embeddings=df)).collect()), key=str)


def vectors(kind, n):
    rng = np.random.default_rng(n)
    if kind == "clusters":
        return rng.normal(size=(12, D))[rng.integers(0, 12, n)] + rng.normal(size=(n, D)) * 0.1
    if kind == "ties":
        return rng.integers(0, 2, (n, D)) * (np.arange(D) < 3) / 64.0
    return rng.normal(size=(n, D)) * 5


@pytest.mark.parametrize(("kind", "n"), [("clusters", 300), ("ties", 200), ("spread", 150), ("spread", 9), ("spread", 1)])
def test_query(spark, folder, kind, n):
    rows = [(i * 7, v.astype(np.float32).tolist()) for i, v in enumerate(vectors(kind, n))]
    assert rows_of(spark, folder, rows) == sorted(plain(rows), key=str)


def test_odd_rows(spark, folder):
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors("clusters", 60))]
    one = rows[0][1]
    rows += [(0, one), (0, one), (1, rows[5][1]), (None, one), (None, rows[7][1]), (100, None), (101, []), (102, one[:-1]), (103, [*one, 0.0])]
    rows += [(104, [None, *one[1:]]), (105, [float("nan"), *one[1:]]), (106, [float("inf"), *one[1:]]), (107, [0.0] * D), (108, [-0.0001] * D)]
    assert rows_of(spark, folder, rows) == sorted(plain(rows), key=str)
    assert rows_of(spark, folder, []) == []
    with pytest.raises(ValueError, match="64 bits"):
        rows_of(spark, folder, [(1, [1e30] * D)])


def test_rounds_look_at_few_centroids():
    """After the first round most vectors are settled by their bounds, and results stay those of all distances."""
    rng = np.random.default_rng(5)
    x = np.floor(64 * (rng.normal(size=(16, D)) * 3)[rng.integers(0, 16, 4000)] + 8 * rng.normal(size=(4000, D))).astype(np.int64)
    c, before, state, seen = x[:16].copy(), None, None, []

    class Counted(centroids.Exponion):
        def _search(self, x, look, *rest):
            seen.append(len(look))
            super()._search(x, look, *rest)

    for _ in range(5):
        search = Counted(c, before)
        state = search.first(x) if state is None else search.assign(x, *state)
        far = np.stack([centroids.squared_distances(x, v) for v in c])
        assert (state[0] == far.argmin(axis=0)).all()
        near = np.sort(np.sqrt(far), axis=0)
        assert (state[1] >= near[0] * (1 - 1e-9)).all() and (state[2] <= near[1] * (1 + 1e-9)).all()
        before, c = c, np.array([x[state[0] == j].sum(axis=0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else c[j] for j in range(16)])
    assert seen[-1] < len(x) / 4


def test_operator(spark):
    points = spark.createDataFrame([(i, [i % 3 * 100, i]) for i in range(30)], "vec_id long, x array<long>")
    found, c = centroids.clustered(points, k=3, rounds=2)
    assert found.count() == 30 and c.shape == (3, 2) and found.where(F.col("distance") < 0).count() == 0
