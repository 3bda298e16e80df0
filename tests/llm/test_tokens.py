"""BPE, token counts and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framelake.llm import bpe, bytes_bpe, packing, token_counts

WORD = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
BYTE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_word_bpe_is_the_librarys(text):
    (ids, decoded), = bpe.word_bpe(bpe.tokenizer_path(bpe.WORD_BPE)).encode([text])
    expected = WORD.encode(text, add_special_tokens=False).ids
    assert ids == " ".join(map(str, expected)) and decoded == WORD.decode(expected, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 1.\n\t'ésS\x1c\x85　"), max_size=40))
def test_byte_bpe_is_the_librarys(text):
    expected = BYTE.encode(text, add_special_tokens=False).ids
    assert bytes_bpe.load().encoded(text) == expected


@pytest.mark.parametrize("pattern", ["{}", "X {}a1{}b"])
def test_word_bpe_over_unicode(pattern):
    """Every character of the basic plane and some beyond, alone and inside words: ids and decoded text."""
    chars = [chr(c) for c in [*range(0x10000), *range(0x10000, 0x110000, 997)] if not 0xD800 <= c < 0xE000]
    if pattern != "{}":
        chars = [c for c in chars if ord(c) < 0x600 or ord(c) % 7 == 0]
    texts = [pattern.replace("{}", c) for c in chars]
    model = bpe.word_bpe(bpe.tokenizer_path(bpe.WORD_BPE))
    for lo in range(0, len(texts), 5000):
        some = texts[lo : lo + 5000]
        for text, (ids, decoded), w in zip(some, model.encode(some), WORD.encode_batch(some, add_special_tokens=False), strict=True):
            assert ids == " ".join(map(str, w.ids)), ascii(text)
            assert decoded == WORD.decode(w.ids, skip_special_tokens=False), ascii(text)


def test_bpe_query(spark, make_docs, folder, odd):
    d = folder(documents=make_docs([*odd, *[(None, "no id"), (None, "no id")]]))
    rows = bpe.op4_bpe(spark, d).collect()
    assert len(rows) == len(odd) + 2
    for r in rows:
        text = "no id" if r["doc_id"] is None else odd[r["doc_id"]] or ""
        ids = WORD.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(WORD.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_then_decode(spark, make_docs, odd):
    rows = bpe.decode(bpe.encode(make_docs(odd))).collect()
    for r in rows:
        assert r["ids"] == WORD.encode(odd[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["decoded"] == WORD.decode(r["ids"], skip_special_tokens=False)


def _long_texts():
    rng = random.Random(5)
    words = ["alpha", "be", "gamma's", "  ", "\n\n", "don't", "日本", "<|endoftext|>", "12345", "...", "\t"]
    out = [" ".join(rng.choice(words) for _ in range(900)), "x" * 4000, " " * 3000 + "a", "ab" * 700 + " " + "!" * 2000, "a\n" * 1500]
    return [*out, "", "short", None]


@pytest.mark.parametrize(("size", "overlap"), [(400, 60), (64, 40), (1000, 999)])
def test_splicing(spark, size, overlap):
    """Small chunks with small overlaps: many splices, and many failures that widen."""
    texts = [t for t in _long_texts() if t]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, text string")
    token_counts.prepare(spark)
    got = {int(r["key"]): r["n_tokens"] for r in token_counts.huge_counts(df, size=size, overlap=overlap).collect()}
    assert got == {i: len(BYTE.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_count_query(spark, make_docs, folder, odd):
    texts = [*odd, *_long_texts(), "word " * 12_000, "word " * 12_000]
    rows = token_counts.op5_token_counts(spark, folder(documents=make_docs([*texts, (None, "x " * 20_000)]))).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = "x " * 20_000 if r["doc_id"] is None else texts[r["doc_id"]] or ""
        assert r["n_bytes"] == len(text.encode())
        n = len(BYTE.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 1024)


@given(st.lists(st.integers(1, 1023), max_size=60))
@settings(max_examples=100, deadline=None)
def test_windows_hold(sizes):
    found = packing.windows_of(np.array(sizes, dtype=np.int64))
    load = np.bincount([w for *_, w in found], weights=[n for _, _, n, _ in found]) if found else np.zeros(1)
    assert load.max() <= 1024 and load.sum() == sum(sizes) and len(load) == max(1, -(-sum(sizes) // 1024))
    at = {}
    for i, start, n, _ in found:
        assert start == at.get(i, 0) and n > 0
        at[i] = start + n
    assert [at.get(i, 0) for i in range(len(sizes))] == sizes


def test_differencing_balances():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 129, 2000)
    at = packing.differencing(sizes, 120)
    sums = np.bincount(at, weights=sizes, minlength=120)
    assert sums.max() - sums.min() <= 4


def test_pack_query(spark, make_docs, folder, odd):
    texts = [*odd, *[f"w{i} " * (i * 7 % 900) for i in range(120)]]
    d = folder(documents=make_docs([*texts, (3, "again"), (None, "none"), (None, "none")]))
    rows = packing.op7_packing(spark, d).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for pieces in by.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    docs = [(i, t or "") for i, t in enumerate(texts)] + [(3, "again"), (None, "none"), (None, "none")]
    ids_of: dict = {}  # of each id, the documents that have it, each as its ids
    for i, t in docs:
        ids_of.setdefault(i, []).append(np.array([*BYTE.encode(t, add_special_tokens=False).ids, 0], dtype="<u4"))
    for i, some in ids_of.items():
        own = [r for r in rows if r["doc_id"] == i]
        if len(some) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(some[0])
                at += r["length"]
                assert r["ids_crc32"] == zlib.crc32(some[0][r["start"] : at].tobytes())
            assert at == len(some[0])
        assert sum(r["length"] for r in own) == sum(map(len, some))
    used = sum(r["length"] for r in rows)
    tasks = len({r["sequence_id"] >> 32 for r in rows})
    assert len(by) * 1024 - used <= 0.01 * used + 1024 * tasks
    assert len(rows) - sum(len(x) // 1024 for some in ids_of.values() for x in some) <= 1.3 * len(docs)


def test_few_documents_are_cut_and_little_is_padded():
    rng = random.Random(5)
    for seed in range(5):
        sizes = np.array([rng.randint(1, 1023) if seed % 2 else int(rng.lognormvariate(5.5, 1)) % 1023 + 1 for _ in range(600)], dtype=np.int64)
        found = packing.windows_of(sizes)
        load = np.bincount([w for *_, w in found], weights=[n for _, _, n, _ in found])
        assert load.max() <= 1024 and len(load) * 1024 - sizes.sum() <= 1024 + 0.005 * sizes.sum()
        assert len(found) <= 1.3 * len(sizes)
        for i, n in enumerate(sizes):
            own = [(s, k) for j, s, k, _ in found if j == i]
            assert [s for s, _ in own] == [sum(k for _, k in own[:x]) for x in range(len(own))] and sum(k for _, k in own) == n


def test_empty_tables(spark, make_docs, folder):
    d = folder(documents=make_docs([(1, "x")]).where(F.lit(False)))
    assert bpe.op4_bpe(spark, d).count() == token_counts.op5_token_counts(spark, d).count() == packing.op7_packing(spark, d).count() == 0
