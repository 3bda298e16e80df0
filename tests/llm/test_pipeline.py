"""The pipeline: every stage on its own input, and all of them."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from framelake.llm.common import written
from tests.llm.test_models import toxic_tables
from tests.llm.test_vectors_and_sets import linked, union_find, word_set


def tables(spark, make_docs, folder):
    docs, labels = toxic_tables(make_docs, 300)
    texts = [f"the quiet river number {i} runs below the old stone bridge and the town sleeps {i * 7} hours" for i in range(20)]
    more = make_docs([(1000 + i, t) for i, t in enumerate([*texts, texts[0], texts[0] + " x", "mail me at a@b.cd please and thank you very much indeed", "", None, "12345"])] + [(None, "no id at all but some words here"), (None, "no id at all but some words here")])
    return folder(documents=docs.unionByName(more), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_stages(spark, make_docs, folder):
    d = tables(spark, make_docs, folder)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, d), name)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    before, after = seen["toxicity"]
    kept = {r["doc_id"] for r in after.collect()}
    toxic = {i for i in range(300) if i % 5 == 0}
    assert len(kept & toxic) <= 6 and len(set(range(300)) - toxic - kept) <= 3
    before, after = seen["language"]
    texts = [r["text"] for r in after.collect()]
    assert all(t and re.search(r"[^\W\d_]", t) for t in texts) and len(texts) >= 0.9 * before.count()
    before, after = seen["near_duplicates"]
    rows = sorted(before.where("doc_id is not null").collect(), key=lambda r: r["doc_id"])
    sets = [word_set(r["text"]) for r in rows]
    root = union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if linked(sets[i], sets[j])])
    assert {r["doc_id"] for r in after.where("doc_id is not null").collect()} == {rows[i]["doc_id"] for i in range(len(rows)) if root[i] == i}
    assert after.where("doc_id is null").count() == before.where("doc_id is null").count()
    before, after = seen["personal_data"]
    assert after.count() == before.count()
    masked = [r for r in after.collect() if "[EMAIL]" in r["text"]]
    assert len(masked) == 1 and masked[0]["n_chars"] == len(masked[0]["text"])
    before, after = seen["packing"]
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


def test_run(spark, make_docs, folder):
    d = tables(spark, make_docs, folder)
    rows = corpus_pipeline.run(spark, d).collect()
    assert rows
    empty = spark.read.parquet(f"{d}/documents.parquet").where(F.lit(False))
    assert corpus_pipeline.run(spark, folder(documents=empty, labels=spark.read.parquet(f"{d}/labels.parquet"))).count() == 0


def test_near_copies_by_five_words(spark, make_docs):
    words = [f"word{i}" for i in range(100)]
    changed = lambda at: " ".join("other" + w if i in at else w for i, w in enumerate(words))
    # with two words changed, 86 of 106 shingles of five words are common, and 92 of 104 of three; with three, 81 of 111
    docs = make_docs([(1, changed(())), (2, changed((30, 60))), (3, changed((20, 45, 70)))])
    assert {r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()} == {1, 3}


def test_labels_of_one_class_drop_nothing(spark, make_docs, folder):
    docs = make_docs([f"text number {i} of some words" for i in range(30)] + [None])
    for toxic in (0, 1):
        d = folder(documents=docs, labels=spark.createDataFrame([(i, 0, toxic) for i in range(30)], "doc_id long, quality int, toxic int"))
        assert corpus_pipeline.drop_toxic(spark, docs, d).count() == 31
