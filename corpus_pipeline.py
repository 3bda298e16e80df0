"""The corpus pipeline: toxicity, language, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import jaccard, language, packing, pii, toxicity
from framelake.llm.common import discard, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose toxicity is below the threshold, null and empty texts and rows with a null or repeated
    id like all others. Without labels of both classes there is nothing to compare, and all documents stay."""
    docs = _documents(docs)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _documents(model.score(docs).where("predicted = 0")) if model.compares else docs


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is clear. Texts without a letter and texts for which two languages are about
    as good go. Without any language to learn from, nothing can be judged and all documents stay."""
    docs = _documents(docs)
    known = language.learned(docs)
    if not known:
        return docs
    found = language.with_language(docs, known)
    return _documents(found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= language.REJECT)))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near duplicates, by sets of five words and a similarity of 0.8;
    rows with a null id, which can't be told apart, all stay, and so do rows that repeat a kept id."""
    docs = _documents(docs)
    gone = jaccard.similar_sets(docs, words=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets, and counts the characters anew where a text changed. Rows stay
    one for one, whatever their ids; null and empty texts stay as they are."""
    docs = _documents(docs)
    masked = pii.with_spans(docs.withColumn("before", F.xxhash64("text")), pii.learn(docs), mask=True)
    counted = F.when(F.xxhash64("text") == F.col("before"), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return masked.withColumn("n_chars", counted).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens. Null and empty texts are their closing token alone; equal rows, and
    rows that share an id or have none, are packed each by itself."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: SQL can't express the models, the tokenizer or the differencing; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared scratch folder before the next one; a stage's table goes
    once the next one is written. An empty table passes all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
