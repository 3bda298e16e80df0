"""Personal data, toxicity, language, quality: contracts, held-out accuracy, odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.llm import language, pii, quality, toxicity
from tests.llm.plain_kneser_ney import KneserNey

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_by_definition(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")), "card": lambda: 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]  # noqa: B023
            if ok():
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+ 0145(){}é\n_%", max_size=50))
def test_base_spans(text):
    assert pii.base_spans(text) == base_by_definition(text)


@pytest.mark.parametrize("text", ["a@b.c@d.e", "a@b@c.d", "1.2.3.4.5 256.1.1.1 0001.2.3.4", "+1 (23) 456-789012 +1+12345678901", "4111 1111 1111 1111-9 4111-1111-1111-1111", "1.2.3.4@5.6", "9" * 3000, "@" * 50 + "x.y"])
def test_base_spans_of_odd_texts(text):
    assert pii.base_spans(text) == base_by_definition(text)


def private_texts():
    rng = random.Random(2)
    words = "the of and region house about there under which these".split()
    out = []
    for i in range(160):
        item = [f"user{i}.x@mail{i}.example.com", f"10.{i % 256}.7.{i % 99}", "4111 1111 1111 1111", f"+1 (555) 010-{1000 + i}"][i % 4]
        out.append(" ".join(rng.choices(words, k=9)) + f" {item} " + " ".join(rng.choices(words, k=6)) + f" version {i % 9}.{i % 7}")
    return out


@pytest.fixture(scope="module")
def crf():
    return pii.train(pii._examples(private_texts()))


def test_added_spans(crf):
    base, found = pii.spans("please call (555) 010-4477 today, or write to a.b@c.example.com", crf)
    assert [k for _, _, k in base] == ["email"] and set(base) <= set(found)
    assert any(k == "phone" and "555" in "please call (555) 010-4477 today"[a:b] for a, b, k in found if b < 40)
    for text in ("version 4.0 of chapter 12", "no digits at all", "password=b7db7aa4a5fcc78305"):
        assert pii.spans(text, crf)[1] == []


@pytest.fixture(scope="module")
def learned(spark):
    """A model of every other document of the small tables, and the documents left out."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 4 < 2").select("doc_id", "text")
    model = pii.learn(docs.where("doc_id % 2 = 0"))
    return model, [r["text"] for r in docs.where("doc_id % 2 = 1").where(F.col("text").rlike(pii._LIKELY)).collect()], docs


def test_recall_and_precision_on_texts_left_out(learned):
    """Data rewritten in other texts than the learned ones: nine in ten are found, and what is found is right."""
    model, texts, _ = learned
    parts = [m.group() for t in texts for m in re.finditer(r"[^\n]{0,120}(?:" + pii._LIKELY + r")[^\n]{0,120}", t)]
    examples = pii._examples(parts, seed=99)
    wanted = found = right = 0
    for text, tokens, gold in examples:
        base = pii.base_spans(text)
        apart = {(tokens[i][0], tokens[j - 1][1], k) for i, j, k in gold}
        apart = {g for g in apart if not any(x < g[1] and g[0] < y for x, y, _ in base)}
        added = set(pii.spans(text, model)[1]) - set(base)
        wanted, found, right = wanted + len(apart), found + len(added), right + len(added & apart)
    print(f"{wanted} rewritten, {found} found, {right} right; margin {model.margin}, {model.report}")
    assert wanted > 100 and right >= 0.9 * wanted and right >= 0.9 * found


def test_known_rewritings(learned):
    model = learned[0]
    for text, kind, part in (
        ("please call (555) 010-4477 today", "phone", "(555) 010-4477"),
        ("the address is 10. 0. 0. 1 there", "ip", "10. 0. 0. 1"),
        ("write to john.doe @ example . com now", "email", "john.doe @ example . com"),
    ):
        at = text.index(part)
        assert (at, at + len(part), kind) in pii.spans(text, model)[1], text


def test_decoding_is_the_best_segmentation(crf):
    """The dynamic programme against all segmentations of a short region."""
    text = "tel 555 0100 at 10.1.2.3"
    tokens = [m.span() for m in pii._TOKEN.finditer(text)]
    scored = {(i, j, k): s for i, j, features in pii._segments(text, tokens) for k, s in zip(pii.KINDS, crf.scores(features), strict=True)}

    def best(at):
        if at == len(tokens):
            return 0.0
        return max([best(at + 1), *[s + best(j) for (i, j, _), s in scored.items() if i == at]])

    assert sum(s for *_, s in crf.decode(text, tokens)) == pytest.approx(best(0))


def test_gradient():
    """Log-likelihood against the sum over all segmentations, and its gradient against finite differences."""
    texts = ["at 10.1.2.3 x", "call 555 0100", "a@b.c"]
    examples = [(t, [m.span() for m in pii._TOKEN.finditer(t)], g) for t, g in zip(texts, ({(1, 8, "ip")}, {(1, 3, "phone")}, set()), strict=True)]
    ids = {f: i for i, f in enumerate(sorted({f for t, tokens, _ in examples for *_, fs in pii._segments(t, tokens) for f in fs}))}
    batch = pii._Batch(examples, ids)
    w = np.random.default_rng(0).normal(size=(len(ids), 4)) * 0.3
    value, grad = batch.gradient(w)

    def total(text, tokens, at):
        if at == len(tokens):
            return 1.0
        ways = total(text, tokens, at + 1)
        for i, j, features in pii._segments(text, tokens):
            if i == at:
                ways += np.exp(w[[ids[f] for f in features]].sum(axis=0)).sum() * total(text, tokens, j)
        return ways

    expected = 0.0
    for text, tokens, gold in examples:
        for i, j, features in pii._segments(text, tokens):
            expected += sum(w[[ids[f] for f in features], k].sum() for k, kind in enumerate(pii.KINDS) if (i, j, kind) in gold)
        expected -= np.log(total(text, tokens, 0))
    assert value == pytest.approx(expected)
    for at in [(0, 0), (3, 1), (len(ids) - 1, 3), *zip(*np.unravel_index(np.argsort(-np.abs(grad), axis=None)[:4], grad.shape), strict=True)]:
        more = w.copy()
        more[at] += 1e-6
        assert (batch.gradient(more)[0] - value) / 1e-6 == pytest.approx(grad[at], abs=1e-3)


def test_long_runs_and_long_tokens(crf):
    """A sign far inside a run without blanks, and runs of a million characters."""
    text = "x" * 500 + "-call-" + "y" * 90 + " 10. 0. 0. 1"
    assert pii._regions("ab" * 300 + "7" + "cd" * 300)[0][0][0] == 0
    assert pii.spans(text, crf)[0] == []
    for odd in ("é" * 1_000_000 + "1", "1," * 100_000, "@" * 100_000, "7" * 1_000_000):
        assert isinstance(pii.spans(odd, crf)[1], list)


def test_pii_query(spark, make_docs, folder, odd):
    texts = [*odd, *private_texts(), "x" * 20_000 + " 10.0.0.1 " + "é" * 9000 + " q@r.st"]
    rows = pii.op2_pii(spark, folder(documents=make_docs([*texts, (None, "a@b.cd")]))).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = "a@b.cd" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        base = base_by_definition(text)
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x == k for _, _, x in base) for k in pii.KINDS]
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))


def test_masking(spark, make_docs):
    df = make_docs(["mail a@b.cd now", None, "nothing"])
    assert [r["text"] for r in pii.with_spans(df, pii.SemiMarkov(), mask=True).orderBy("doc_id").collect()] == ["mail [EMAIL] now", None, "nothing"]
    assert pii.learn(df.where(F.lit(False))) == pii.SemiMarkov()


def toxic_tables(make_docs, n=500):
    rng = random.Random(8)
    words = [a + b for a in "ra le mo tin du ser".split() for b in "nok vel pas dim tor hes".split()]
    bad = ["vilgrum", "slurbek", "grotzan"]
    texts, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        body = rng.choices(words, k=rng.randint(5, 80))
        for _ in range(3 if toxic else 0):
            body.insert(rng.randrange(len(body)), rng.choice(bad) + rng.choice(["", "a", "en", "os"]))
        texts.append(" ".join(body))
        labels.append((i, 1 if i % 3 else 0, int(toxic)))
    return make_docs(texts), labels


def test_toxicity(spark, make_docs, folder, odd):
    docs, labels = toxic_tables(make_docs)
    extra = make_docs([(1000 + i, t) for i, t in enumerate(odd)] + [(None, "vilgrum slurbek")])
    d = folder(documents=docs.unionByName(extra), labels=spark.createDataFrame([*labels, (7, None, None), (99999, 1, 1)], "doc_id long, quality int, toxic int"))
    rows = toxicity.op3_toxicity(spark, d).collect()
    assert len(rows) == 500 + len(odd) + 1
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    judged = [(truth[r["doc_id"]], r["predicted"]) for r in held if r["doc_id"] in truth]
    assert np.mean([a == b for a, b in judged]) >= 0.97
    assert next(r["predicted"] for r in rows if r["doc_id"] is None) == 1


def test_held_out_labels_change_nothing(spark, make_docs, folder):
    docs, labels = toxic_tables(make_docs, 240)
    schema = "doc_id long, quality int, toxic int"
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a, b = (toxicity.op3_toxicity(spark, folder(documents=docs, labels=spark.createDataFrame(x, schema))).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


def test_toxicity_without_labels(spark, make_docs, folder):
    docs = make_docs(["a b c", None])
    d = folder(documents=docs, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {(r["score"], r["predicted"]) for r in toxicity.op3_toxicity(spark, d).collect()} == {(0.0, 0)}


def grams_of(words):
    """Rows (gram, ordinary, toxic) of (word, ordinary, toxic)."""
    rows = {}
    for word, *counts in words:
        marked, padded = f"^{word}$"[: toxicity.BEGINNING], f"^^^{word}$"
        for gram in ["<" + marked[:i] for i in range(2, len(marked) + 1)] + ["=" + padded[i : i + 4] for i in range(len(word) + 1)]:
            row = rows.setdefault(gram, [0, 0])
            rows[gram] = [a + b for a, b in zip(row, counts, strict=True)]
    return [(g, *v) for g, v in rows.items()]


def test_kneser_ney_is_a_distribution():
    """Over the letters, the end and one more for all unseen letters, the chances of each context sum to 1."""
    model = KneserNey(grams_of([("ab", 4, 1), ("a", 1, 1), ("bac", 3, 0), ("abc", 0, 2), ("cab", 1, 6)]))
    for toxic in (0, 1):
        for context in ("^", "^a", "^ab", "^abc", "^b", "^ca"):
            assert sum(model.probability(context + c, toxic) for c in "abc$?") == pytest.approx(1.0, abs=1e-12)
    assert model.word("zz") == pytest.approx(model.ratio("^z")) and model.word("bac") < 0


def test_scores_by_definition(spark, make_docs):
    """Features of documents against the plain model of the same counts."""
    docs, labels = toxic_tables(make_docs, 120)
    docs = docs.unionByName(make_docs([(900, "vilgrumation-x MO 12 grotz"), (901, ""), (902, None), (903, "lenok " * 40 + "slurbeken")]))
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = ["difference", "second", "five", "density", "length"]
    rows = toxicity._with_features(docs.select("doc_id", "text"), "text", model.shared, None).collect()
    learnable = sorted((zlib.crc32(str(i).encode()), i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 != 1)
    order = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(1)).alias("h")).collect()}
    counts = {}
    for c in (0, 1):
        some = sorted([i for _, i, t in learnable if t == c], key=lambda i: (order[i], i))
        for i in some[max(1, len(some) // toxicity.CALIBRATION_SHARE) :]:
            for w in re.findall(r"[^\W\d_]+", next(r["text"] for r in rows if r["doc_id"] == i).lower()):
                counts.setdefault(w, [0, 0])[c] += 1
    plain = KneserNey(grams_of([(w, *n) for w, n in counts.items()]))
    assert len(rows) == 124
    for r in rows:
        assert [r[n] for n in names] == pytest.approx(plain.features(r["text"] or ""), abs=2e-5), r["text"]


def test_rare_beginnings_count(spark, make_docs, monkeypatch):
    docs, labels = toxic_tables(make_docs, 200)
    more = [(1000, "mo-vilgrumx RALENOK zzz tim,slurb grot"), (1001, "slurbek"), (1002, "ra ra ra grotzanos 12"), (1003, ""), (1004, None), (None, "vilgrum")]
    docs = docs.unionByName(make_docs(more))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []
    for size in (toxicity.WINDOWS, 25):
        monkeypatch.setattr(toxicity, "WINDOWS", size)
        model = toxicity.fit(docs, labels)
        assert (model.nodes is None) == (size > 25)
        seen.append({(r["doc_id"], r["text"]): r["score"] for r in model.score(docs).collect()})
    assert seen[0].keys() == seen[1].keys() and len(seen[0]) == 206
    assert all(abs(seen[1][k] - v) < 1e-6 for k, v in seen[0].items())


def test_tables_have_the_ratios(spark):
    words = ["vilgrum", "vilgar", "ranok", "ravel", "mo", "a", "slurbek", "ravelling", "b" * 40]
    counts = spark.createDataFrame([(w, c, n) for i, w in enumerate(words) for c in (0, 1) if (n := (i * 5 + c * 7) % 4 * 3)], "token string, toxic int, count long")
    grams = toxicity._grams(counts)
    plain = KneserNey([tuple(r) for r in grams.collect()])
    new = ["vil", "vilx", "raz", "zz", "ravellers", "slurb", "é", "b" * 50, "b" * 23]
    nodes = toxicity._nodes(grams)
    *head, whole = toxicity._head(nodes, 1000)
    assert whole and not toxicity._head(nodes, 10)[3] and len(toxicity._head(nodes, 10)[0]) <= 10
    scored = toxicity._Scorer(head).values([toxicity._marked(w) for w in words + new])
    joined = toxicity._values(spark.createDataFrame([(toxicity._marked(w),) for w in words + new], "word string").distinct(), nodes)
    joined = {r["word"]: r["value"] for r in joined.collect()}
    for w, v in zip(words + new, scored, strict=True):
        assert v == pytest.approx(plain.word(w), abs=1e-5) and joined[toxicity._marked(w)] == pytest.approx(plain.word(w), abs=1e-5)


def test_toxicity_held_out_on_the_tables(spark):
    """AUC and catches over the held-out labels of the small tables."""
    d = "/root/testdata/sf0.01"
    rows = toxicity.op3_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("toxic is not null").collect()
    good, bad = [r["score"] for r in rows if not r["toxic"]], [r["score"] for r in rows if r["toxic"]]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc >= 0.93 and np.mean([b >= toxicity.THRESHOLD for b in bad]) >= 0.75 and np.mean([g >= toxicity.THRESHOLD for g in good]) <= 0.05


def sentences(lang, n, seed):
    rng = random.Random(seed)
    parts = {"xx": "ther ing and the of tion ed".split(), "yy": "keit ung der die sch ein zu".split(), "zz": "ción mente que de la os".split()}[lang]
    return [" ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.randint(8, 60))) for _ in range(n)]


def test_language(spark, make_docs, folder, odd):
    df = None
    for k, lang in enumerate(("xx", "yy", "zz")):
        part = make_docs([(1000 * k + i, t) for i, t in enumerate(sentences(lang, 60 * (3 - k), k))], lang)
        df = part if df is None else df.unionByName(part)
    extra = make_docs([(9000 + i, t) for i, t in enumerate(odd)] + [(None, sentences("yy", 1, 77)[0]), (9999, "12 34 -- !!")], None)
    rows = language.op9_language(spark, folder(documents=df.unionByName(extra))).collect()
    truth = {r["doc_id"]: r["lang"] for r in df.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.98
    by = {r["doc_id"]: r for r in rows}
    assert by[None]["lang_pred"] == "yy" and by[9999]["lang_pred"] == "und"
    for i, t in enumerate(odd):
        assert (by[9000 + i]["lang_pred"] == "und") == (not t or not any(c.isalpha() for c in t))
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language.op9_language(spark, folder(documents=df.where(F.lit(False)))).count() == 0


def test_language_against_plain_compression(spark, make_docs, folder, odd):
    """Each text with each dictionary in a plain loop; more languages than would have whole dictionaries."""
    import zstandard

    rng = random.Random(12)
    alphabets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 6)) for _ in range(9)]
    texts = [(10 * i + k, " ".join("".join(rng.choices(a, k=rng.randint(2, 7))) for _ in range(rng.randint(5, 60))), f"l{k}") for k, a in enumerate(alphabets) for i in range(12)]
    docs = spark.createDataFrame([*texts, *[(1000 + i, t, None) for i, t in enumerate(odd)], (None, texts[0][1] * 300, None)], "doc_id long, text string, lang string")
    known = language.dictionaries(docs.where("doc_id is not null"), together=9 * 400)
    assert len(known) == 9 and all(0 < len(d) <= 400 for d in known.values())
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.with_language(docs, known).collect()}
    for doc_id, text in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        if not text or not any(c.isalpha() for c in text):
            assert got[doc_id] == ("und", 0.0)
            continue
        data, sizes = language.letters(text).encode(), []
        for d in known.values():
            encoder = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(encoder.compress(data[i : i + language.BLOCK])) for i in range(0, len(data), language.BLOCK)))
        first, second = sorted(sizes)[:2]
        margin = (second - first) / first
        assert got[doc_id] == (list(known)[sizes.index(first)], pytest.approx(margin / (margin + language.HALF)))


def test_quality(spark, make_docs, folder, odd):
    rng = random.Random(3)
    good = [" ".join(rng.choices("the river runs below an old stone bridge near town".split(), k=40)) + "." for _ in range(150)]
    bad = ["!! ".join(rng.choices(["BUY", "NOW", "WIN"], k=30)) for _ in range(75)] + [("same " * 40) for _ in range(75)]
    docs = make_docs([*good, *bad, *odd, (0, "another text"), (None, "x"), (None, None)])
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300) if i % 4], "doc_id long, quality int, toxic int")
    d = folder(documents=docs, labels=labels)
    rows = quality.op10_quality(spark, d).collect()
    assert len(rows) == 303 + len(odd) and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["predicted"] == int(r["doc_id"] < 150) for r in rows if r["doc_id"] is not None and 0 < r["doc_id"] < 300 and r["doc_id"] % 4 == 0]) >= 0.95
    assert sorted(rows, key=str) == sorted(quality.op10_quality(spark, d).collect(), key=str)
    featured = quality.features(docs)
    none = quality.fit(featured, labels.where(F.lit(False))).score(featured)
    assert {r["score"] for r in none.collect()} == {0.0}
    assert quality.op10_quality(spark, folder(documents=docs.where(F.lit(False)), labels=labels)).count() == 0


def test_a_documents_own_label_is_not_in_its_score(spark, make_docs):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("one two three four five six seven".split(), k=30)) + " !!" * (i % 3) for i in range(200)]
    featured = quality.features(make_docs(texts))
    labels = [(i, int(i % 3 < 2)) for i in range(200)]
    half = {r["doc_id"]: r["half"] for r in featured.collect()}
    scores = []
    for flip in (False, True):
        df = spark.createDataFrame([(i, 1 - q if flip and half[i] == 0 else q) for i, q in labels], "doc_id long, quality int")
        scores.append({r["doc_id"]: r["score"] for r in quality.fit(featured, df).score(featured).collect()})
    assert all(scores[0][i] == scores[1][i] for i in range(200) if half[i] == 0)


def test_quality_on_the_tables(spark):
    """Areas under the curve over all labelled documents, none of which trained the model that scores it."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    featured = quality.written(quality.features(docs), "test-features")
    model = quality.fit(featured, labels)
    rows = model.score(featured).join(labels, "doc_id").where("quality is not null").toPandas()
    areas = {c: quality.area(rows[c].to_numpy(), rows["quality"].to_numpy()) for c in ("text_score", "page_score", "score")}
    print(areas, model.report)
    assert areas["text_score"] >= 0.95 and areas["score"] >= 0.95
    assert model.report["text at last"] >= model.report["text at first"] - 0.02


def test_views_teach_each_other(spark):
    """A view that starts from few labels learns from what the other is sure of."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000)
    x = [np.clip(np.column_stack([y * 0.4 + 0.3 + rng.normal(size=3000) * s, rng.random(3000)]), 0, 1) for s in (0.1, 0.2)]
    rows = [(i, int(i % 2), *[bytes((255 * v[i]).astype(np.uint8)) for v in x]) for i in range(3000)]
    featured = spark.createDataFrame(rows, "doc_id long, half int, text_view binary, page_view binary")
    few = spark.createDataFrame([(i, int(y[i])) for i in range(60)], "doc_id long, quality int")
    scored = quality.fit(featured, few).score(featured).toPandas().sort_values("doc_id")
    assert quality.area(scored["score"].to_numpy(), y) > 0.97 and quality.area(scored["page_score"].to_numpy(), y) > 0.8
    assert quality.area(np.array([0.1, 0.5, 0.5, 0.9]), np.array([0, 0, 1, 1])) == 0.875
