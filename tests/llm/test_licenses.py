"""License notices against edit distances of all stretches of words."""

import random
import re

from pyspark.sql import functions as F

from framelake.llm import licenses

PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_base(text):
    w = plain_words(text)
    at = [(i, label) for i in range(len(w)) for p, label in PHRASES if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def plain_labels(text):
    """Labels of notices of which some stretch of whole words is within the notice's edits."""
    w, found = plain_words(text), set()
    for notice in licenses.notices():
        n = len(notice.words)
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                size = len(" ".join(w[i:j]))
                if size > n + notice.edits:
                    break
                if size >= n - notice.edits and distance(notice.words, " ".join(w[i:j])) <= notice.edits:
                    found.add(notice.label)
    return ",".join(sorted(found))


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        i = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[i] = rng.choice("abcxyz ")
        elif kind == 1:
            text[i:i] = rng.choice("abcxyz ")
        else:
            del text[i]
    return "".join(text)


def texts_of(rng, n):
    words = "the under license mit apache version 2 cc by nc public general software any use übung 日本".split()
    known = [w for w, _ in (*licenses.BASE, *licenses.MORE)]
    out = []
    for _ in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 12)))]
        for _ in range(rng.randrange(3)):
            parts += [edited(rng, rng.choice(known), rng.choice((0, 0, 1, 2, 3, 5))), " ".join(rng.choices(words, k=rng.randint(0, 6)))]
        out.append(rng.choice((" ", ", ", "\n", "-", "")).join(parts).title() if rng.random() < 0.3 else " ".join(parts))
    return out


def test_query(spark, make_docs, folder, odd):
    rng = random.Random(0)
    texts = [*odd, "under the MIT license", "(Under\nthe mit-license!) CC BY-NC 4.0 cc_by_nc cc by ncx", "cc by nc " * 300, "Apache License, Version 2.0", "under the mit licence", "ünder the mit license", *texts_of(rng, 200)]
    docs = make_docs([*enumerate(texts), (3, "cc by nc"), (3, "cc by nc"), (None, "under the mit license"), (None, None)])
    rows = [tuple(r) for r in licenses.op13_licenses(spark, folder(documents=docs)).collect()]
    want = [(r["doc_id"], *plain_base(r["text"]), plain_labels(r["text"])) for r in docs.collect()]
    assert sorted((r[:7] for r in rows), key=str) == sorted(want, key=str)
    assert all(0 <= r[7] <= 1 and (r[7] > 0) == bool(r[6]) and (r[7] == 1 or not r[5]) for r in rows)
    assert sum(r[5] != r[6] for r in rows) > 20
    assert licenses.op13_licenses(spark, folder(documents=docs.where(F.lit(False)))).count() == 0


def test_spans(spark, make_docs):
    texts = ["Ein Text, Released Under the MIT Licence. Then: CC-BY-NC", "", None, "under the mit license under the mit license"]
    rows = {r["doc_id"]: r for r in licenses.license_spans(make_docs(texts).withColumn("licenses", F.lit("clash"))).collect()}
    first = rows[0]["licenses"]
    assert [(x["label"], texts[0][x["start"] : x["end"]], x["edits"], x["first_word"], x["last_word"]) for x in first] == [("mit", "Under the MIT Licence", 1, 3, 6), ("cc-by-nc", "CC-BY-NC", 0, 8, 10)]
    assert rows[1]["licenses"] == rows[2]["licenses"] == [] and rows[3]["lang"] == "en"
    assert [(x["start"], x["end"]) for x in rows[3]["licenses"]] == [(0, 21), (22, 43)]


def test_any_occurrence_holds_a_piece():
    rng = random.Random(1)
    for notice in licenses.notices():
        assert "".join(p for _, p in licenses.pieces(notice)) == notice.words and len(licenses.pieces(notice)) == notice.edits + 1
        for _ in range(50):
            text = edited(rng, notice.words, notice.edits)
            assert any(p in text for _, p in licenses.pieces(notice))


def test_small_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r)[:6] for r in licenses.op13_licenses(spark, d).collect()]
    want = [(r["doc_id"], *plain_base(r["text"])) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
