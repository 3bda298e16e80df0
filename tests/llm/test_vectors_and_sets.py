"""Cover trees, the Jaccard join, components and fingerprints against brute force."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from framelake.llm import covertree, fingerprints, jaccard
from framelake.llm.components import components


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 340)] + [(400, x) for x in range(401, 460)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame([*pairs, *pairs[:5], (None, 3)], "u long, v long")).collect()}
    expected = union_find(500, pairs)
    ends = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: expected[x] for x in ends}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("noise", [0.05, 0.15, 0.3, 0.6])
def test_dual_traversal(noise):
    rng = np.random.default_rng(int(noise * 100))
    base = rng.normal(size=(30, 16))
    x = covertree._unit(np.concatenate([base[rng.integers(0, 30, 400)] + noise * rng.normal(size=(400, 16)), rng.normal(size=(150, 16))]))
    x[5] = x[6]
    copies, ids, part = rng.integers(1, 4, len(x)), np.arange(len(x)), rng.integers(0, 3, len(x))
    trees = [covertree.CoverTree(x[part == k], ids[part == k], copies[part == k]) for k in range(3)]
    links, edges = np.zeros(len(x), dtype=int), []
    for i, j in itertools.combinations_with_replacement(range(3), 2):
        for u, v, n in zip(*covertree.dual_traversal(trees[i], trees[j], i == j, 0.9).result(), strict=True):
            if u == v:
                links[u] += n
            else:
                edges.append((int(u), int(v)))
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    assert (links == hit @ copies).all()
    assert union_find(len(x), edges) == union_find(len(x), zip(*map(np.ndarray.tolist, np.nonzero(hit)), strict=True))


def test_nodes_are_covered():
    x = covertree._unit(np.random.default_rng(0).normal(size=(300, 8)))
    tree = covertree.CoverTree.load(covertree.CoverTree(x, np.arange(300), np.ones(300, dtype=int)).dump())
    for node in range(len(tree.lo)):
        inside = tree.x[tree.lo[node] : tree.hi[node]]
        assert covertree._chord(inside @ tree.x[tree.centre[node]]).max() <= tree.radius[node] + 1e-7
        assert tree.lo[node] <= tree.centre[node] < tree.hi[node]
    assert sorted(tree.ids.tolist()) == list(range(300))


@pytest.mark.parametrize("block", [16, 5000])
def test_vector_query(spark, block):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(12, 8))
    vectors = [v.tolist() for v in np.concatenate([base[rng.integers(0, 12, 80)] + 0.2 * rng.normal(size=(80, 8)), rng.normal(size=(20, 8))])]
    vectors += [vectors[0]] * 30 + [[2 * x for x in vectors[1]], None, [0.0] * 8, [1.0, None] + [0.0] * 6, [math.nan] + [1.0] * 7, [math.inf] + [1.0] * 7, [], [1.0, 2.0], [1.0, 2.0]]
    rows = [(i, v, i % 3, 1) for i, v in enumerate(vectors)] + [(None, vectors[0], 0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, links int")
    got = {r["vec_id"]: r for r in covertree.near_duplicates(df, block=block).collect()}
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = {i: np.array(np.float32(v), dtype=np.float64) / np.linalg.norm(np.float32(v).astype(np.float64)) for i, v in enumerate(vectors) if ok(v)}
    pairs = [(i, j) for i, j in itertools.combinations(unit, 2) if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    component = union_find(len(vectors), pairs)
    for i in range(len(vectors)):
        n = sum(i in p for p in pairs)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n, component[i], component[i] == i)
    assert tuple(got[None])[1:] == (0, None, False)
    assert covertree.near_duplicates(df.where(F.lit(False))).count() == 0
    assert covertree.near_duplicates(df.where("vec_id is null or embedding is null")).count() == 2


@pytest.mark.parametrize("block", [8, 5000])
def test_vectors_at_the_threshold_and_with_repeated_ids(spark, block):
    """Cosines of 0.9 +- 1e-9, rows that share an id but not the vector, and a large group of copies."""
    at = lambda cosine: [cosine, math.sqrt(1 - cosine * cosine), 0.0, 0.0]
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, at(0.9 + 1e-9)), (3, at(0.9 - 1e-9)), (4, [0.0, 0.0, 1.0, 0.0]), (4, [0.0, 0.0, 0.0, 1.0])]
    rows += [(5, [0.0, 0.0, 1.0, 0.001]), (6, [0.0, 0.0, 0.001, 1.0]), (7, [0.0, 0.0, 0.002, 1.0]), (7, [0.0, 0.0, 0.002, 1.0])]
    rows += [(100 + i, [-1.0, -1.0, -1.0, -1.0]) for i in range(40)]
    got = covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=block)
    unit = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if unit[i] @ unit[j] >= 0.9]
    root = union_find(len(rows), pairs)
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in root}
    expected = sorted((rows[i][0], sum(i in p for p in pairs), least[root[i]], least[root[i]] == rows[i][0]) for i in range(len(rows)))
    assert sorted(map(tuple, got.collect())) == expected
    assert (0, 1) in pairs and (0, 2) not in pairs


def word_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return set(zip(words, words[1:], words[2:], strict=False)) if len(words) >= 3 else {tuple(words)} if words else set()


def linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 90 * len(a | b)


def set_texts():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    out = ["", None, " \t\n", "one", "One", "one two", "ONE\x0btwo", "one two three", "É a b", "é a b"]
    passage = " ".join(rng.choice(words, 60))
    for size in (3, 8, 11, 12, 13, 15, 17, 18, 20, 22, 25, 30, 40, 60, 100, 300):
        base = rng.choice(words, size)
        for changes in (0, 0, 1, 1, 2, 3, 6):
            new = base.copy()
            for _ in range(changes):
                new[[0, len(new) - 1][int(rng.integers(0, 2))] if rng.random() < 0.6 else int(rng.integers(0, len(new)))] = f"n{rng.integers(0, 10**6)}"
            out.append(" ".join(new))
        out += [" ".join(base[:-1]), " ".join([*base, "tail"]), " ".join(base) + " " + passage]
    return out + [passage] * 5


def test_jaccard_query(spark, make_docs, folder, monkeypatch):
    texts = set_texts()
    rows = jaccard.op6_jaccard(spark, folder(documents=make_docs([*texts, (None, "one two three")]))).collect()
    sets = [word_set(t) for t in texts]
    component = union_find(len(texts), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if linked(sets[i], sets[j])])
    got = {r["doc_id"]: r for r in rows}
    for i, s in enumerate(sets):
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(s), component[i]), texts[i]
    assert got[None]["component_id"] is None and got[None]["kept"] and got[None]["n_shingles"] == 1
    assert jaccard.op6_jaccard(spark, folder(documents=make_docs([(1, "x")]).where(F.lit(False)))).count() == 0


@pytest.mark.parametrize("boundary", [0, 12, 25, 40])
def test_any_boundary_finds_all_links(boundary):
    """A shared key is necessary for each linked pair, whichever sizes enumerate subsets."""
    rng = np.random.default_rng(boundary)

    def keys(s):
        s = sorted(s)
        out = set()
        if len(s) <= boundary:
            for c in jaccard._subset_sizes(len(s), boundary, 90):
                out |= {("sub", c, x) for x in itertools.combinations(s, c)} if math.comb(len(s), c) < 5000 else set()
        if len(s) > boundary or len(s) >= jaccard.least_partner(boundary + 1):
            out |= {("list", x) for x in s[: jaccard.prefix_length(len(s))]}
        return out

    for _ in range(150):
        a = set(rng.choice(1000, int(rng.integers(1, 34)), replace=False).tolist())
        b = set(a)
        for _ in range(int(rng.integers(0, 3))):
            if rng.random() < 0.5 and len(b) > 1:
                b.remove(next(iter(b)))
            else:
                b.add(int(rng.integers(1000, 2000)))
        if linked(a, b) and a != b:
            assert keys(a) & keys(b), (len(a), len(b))


def test_hot_lists_are_dealt_out(spark, make_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 3)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*base[:50], f"x{i}", *base[51:]]) for i in range(40)] + [" ".join(f"z{i}{j}" for j in range(30)) for i in range(5)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_sets(make_docs(texts)).collect()}
    assert got == {i: 0 if i < 40 else i for i in range(45)}


def test_copies_that_do_not_link_are_not_compared(spark, make_docs, monkeypatch):
    """Copies of a text that differ by more than links allow, all in the same lists: no pair of them is made."""
    base = [f"w{i}" for i in range(2000)]
    texts = [" ".join(base[:-150] + [f"own{k}x{i}" for i in range(150)]) for k in range(20)]
    texts += [" ".join(base[:-40] + [f"near{k}x{i}" for i in range(40)]) for k in range(3)]
    made, whole = [], jaccard._open_pairs
    monkeypatch.setattr(jaccard, "_open_pairs", lambda *a: made.append(whole(*a).cache()) or made[0])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_sets(make_docs(texts)).collect()}
    sets = [word_set(t) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if linked(sets[i], sets[j])]
    assert [got[i] for i in range(len(texts))] == union_find(len(texts), links)
    assert got[20] == got[21] == got[22] == 20 and made[0].count() <= 3


def test_near_copies_meet_before_all_pairs_are_made(spark, make_docs, monkeypatch):
    """One group in which most documents link only with some that stand far from them: it is one component before pairs
    of all its documents are looked at."""
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(180):  # the first 60 link with all, the others not with each other
        at = 3 + 37 * k % 143
        texts.append(" ".join(base[:at] + [f"own{k}"] + ([f"more{k}"] if k >= 60 else []) + base[at + (2 if k >= 60 else 1) :]))
    made, whole = [], jaccard._open_pairs
    monkeypatch.setattr(jaccard, "_open_pairs", lambda *a: made.append(whole(*a).cache()) or made[0])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_sets(make_docs(texts)).collect()}
    sets = [word_set(t) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if linked(sets[i], sets[j])]
    assert [got[i] for i in range(len(texts))] == union_find(len(texts), links)
    assert made[0].count() <= 180


def winnow_plain(text, hashed, k=8, w=8):
    """Chosen (hash, position) by the definition."""
    grams = [text[i : i + k] for i in range(len(text) - k + 1)] or ([text] if text else [])
    values = [(hashed(g), -i) for i, g in enumerate(grams)]
    chosen = {min(values[i : i + w]) for i in range(max(1, len(values) - w + 1))} if values else set()
    return sorted(((h, -i) for h, i in chosen), key=lambda x: x[1])


def gram_hash(gram):
    return xxhash.xxh64_intdigest(gram.encode(), 42) & (1 << 35) - 1


def likeness_plain(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def digest_plain(chosen):
    return hashlib.sha256(",".join(f"{h << 28 | (1 << 28) - 1 - p:X}" for h, p in chosen).encode()).hexdigest()


def test_fingerprint_query(spark, make_docs, folder, odd, monkeypatch):
    """All columns against the definition, with texts of each length around the window's, emoji, and small chunks."""
    monkeypatch.setattr(fingerprints, "CHUNK", 50)
    rng = random.Random(6)
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    texts = [*odd, "the quick brown fox jumps over the lazy dog " * 20, "another text altogether, with other words " * 9]
    texts += [some(n, "ab😀é ") for n in range(0, 70)] + [some(n, "xyz 𝒳\n") for n in (99, 100, 101, 300, 1000, 3)] + ["", "aaaa" * 100]
    d = folder(documents=make_docs([(10 * i, t) for i, t in enumerate(texts)]))
    rows = {r["doc_id"] // 10: r for r in fingerprints.op8_fingerprints(spark, d).collect()}
    plain = [t or "" for t in texts]
    prints = [winnow_plain(t, gram_hash) for t in plain]
    assert len(rows) == len(plain)
    for i, t in enumerate(plain):
        nxt = plain[(i - 1) % len(plain)]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        other = winnow_plain(edited, gram_hash)
        r = rows[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == digest_plain(prints[i]) and r["edited_fingerprint"] == digest_plain(other), repr(t)
        assert r["near_edited"] == pytest.approx(likeness_plain(prints[i], other))
        assert r["near_next"] == pytest.approx(likeness_plain(prints[i], prints[(i - 1) % len(plain)]))
        assert r["n_grams"] == len(prints[i])
    assert rows[5]["fingerprint"] == rows[6]["fingerprint"] != rows[7]["fingerprint"]


def test_fingerprint_of_a_million_characters(spark, make_docs, folder):
    rng = random.Random(1)
    long = "".join(rng.choice(["ab", "c d", "😀", "é", "xyz "]) for _ in range(500_000))
    rows = {r["doc_id"]: r for r in fingerprints.op8_fingerprints(spark, folder(documents=make_docs([(1, long), (2, long + "tail"), (2, "again"), (None, "x")]))).collect() if r["n_chars"] > 9}
    assert len(long) > 1_000_000
    for i, text in ((1, long), (2, long + "tail")):
        assert rows[i]["fingerprint"] == digest_plain(winnow_plain(text, gram_hash))


def test_slices(spark):
    for n in (0, 1, 2, 5, 17, 100):
        cuts = [3 * i for i in range(n)]
        df = spark.range(-2, 320).withColumn("slice", fingerprints._slice_of(F.col("id"), cuts))
        assert all(r["slice"] == sum(c <= r["id"] for c in cuts) for r in df.collect())


def test_winnowing_positions(spark):
    """The chosen grams are the rightmost minima of all windows, with their positions in code points."""
    texts = ["", "short", "exactly8", "abcabcabcabcabcabcabcabc", "the quick brown fox jumps over the lazy dog", "日本語のテキストもあります。日本語😀のテキストも😀あります。😀😀😀"]
    rows = fingerprints.fingerprints(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for r in rows:
        assert [(x["hash"], x["position"]) for x in r["fingerprint"]] == winnow_plain(r["text"], gram_hash)


def test_shared_passages_meet(spark):
    passage = "a passage of more than fifteen characters"
    df = spark.createDataFrame([("unrelated head 123 " + passage + " tail one",), ("zz " + passage + " and another end",)], "text string")
    a, b = [set(r["h"]) for r in df.select(fingerprints.hashes(fingerprints.winnow(F.col("text"))).alias("h")).collect()]
    assert a & b


def test_one_and_no_document(spark, make_docs, folder):
    one = fingerprints.op8_fingerprints(spark, folder(documents=make_docs([(4, "only this text here")]))).collect()
    assert one[0]["near_next"] == 1.0
    assert fingerprints.op8_fingerprints(spark, folder(documents=make_docs([(1, "x")]).where(F.lit(False)))).count() == 0
