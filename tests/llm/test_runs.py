"""Periodic runs against all periods of all stretches."""

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.llm import runs


def plain_runs(w):
    """For each period the maximal stretches; the smallest period of each stretch, if it is long enough."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q - start), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=90), max_size=6))
def test_small_alphabets(texts):
    assert runs.runs_of(texts) == [plain_runs(t) for t in texts]


def test_long_and_planted():
    rng = random.Random(0)
    texts = []
    for k in range(60):
        base = [rng.randrange(rng.choice((3, 50, 5000))) for _ in range(rng.choice((0, 1, 5, 100, 700, 3000)))]
        for _ in range(rng.randrange(5)):
            p = rng.choice((1, 2, 3, 7, 20, 64, 150))
            piece = [rng.randrange(4 if k % 2 else 900) for _ in range(p)]
            at = rng.randrange(len(base) + 1)
            base[at:at] = (piece * 12)[: rng.randint(3 * p, 12 * p)]
        texts.append(base)
    texts += [[0] * 5, [0] * 6, [0] * 5000, [0, 1] * 700, [0, 1, 0, 2] * 333 + [0] * 40 + [0, 1] * 9]
    assert runs.runs_of(texts) == [plain_runs(t) for t in texts]
    assert runs.runs_of([]) == [] and runs.runs_of([[]]) == [[]]


def test_z_values():
    import numpy as np

    rng = random.Random(1)
    for _ in range(200):
        w = [rng.randrange(2) for _ in range(rng.randint(2, 40))]
        most = rng.randint(1, len(w) - 1)
        want = {}
        for i in range(1, most + 1):
            k = 0
            while i + k < len(w) and w[k] == w[i + k]:
                k += 1
            if k:
                want[i] = k
        assert runs.z_values([9, *w, 8], np.array([9, *w, 8]), 1, 1 + len(w), most) == want


def plain_row(doc_id, text):
    words = [x for x in "".join("\n" if c in " \t\n\x0b\x0c\r" else c for c in text or "").split("\n") if x]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, n_, q in found for i in range(s + q, s + n_)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query(spark, make_docs, folder, odd):
    rng = random.Random(2)
    texts = [*odd, "go " * 6, "a b " * 4 + "a", "x y " * 5, "x\x1cy " * 9, "\t\x0b\x0c\r a a a a a a\n"]
    texts += [" ".join(rng.choices("the river runs below an old stone bridge".split(), k=rng.randint(0, 300))) for _ in range(150)]
    docs = make_docs([*enumerate(texts), (3, "b " * 40), (3, "b " * 40), (None, "c " * 40), (None, None)])
    rows = runs.op12_runs(spark, folder(documents=docs)).collect()
    want = [plain_row(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert sum(r["n_runs"] for r in rows) > 10 and len({r["period"] for r in rows}) > 3
    assert runs.op12_runs(spark, folder(documents=docs.where(F.lit(False)))).count() == 0


def test_operator_keeps_columns(spark, make_docs):
    docs = make_docs([(1, "so so so so so so much"), (2, None), (None, "x")]).withColumn("runs", F.lit("clash"))
    rows = {r["doc_id"]: r for r in runs.periodic_runs(docs).collect()}
    assert rows[1]["collapsed"] == "so much" and [tuple(x) for x in rows[1]["runs"]] == [(0, 6, 1)]
    assert rows[2]["collapsed"] == "" and rows[2]["runs"] == [] and rows[2]["lang"] == "en" and rows[None]["collapsed"] == "x"


def test_small_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = runs.op12_runs(spark, d).collect()
    want = [plain_row(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
