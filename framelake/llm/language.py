"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from texts of that language, in lower case and with a
space for all that isn't a letter. A text, treated alike, is encoded block by block with each dictionary and belongs
to the language whose dictionary makes it smallest, on ties to the one learned from more texts. The margin by which the
second language loses is the score; callers reject texts whose margin is narrow.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import crc_mod, prepare, table

#: The bounded sample: bytes of a language's dictionary, characters that one text gives to it, and bytes of all
#: dictionaries together. All languages are learned; where there are so many that this is less, each gets its share.
DICTIONARY = 65_536
SHARE = 2_048
ALL_DICTIONARIES = 256 * DICTIONARY
#: Bytes of a block: long texts are judged by all their blocks, each against the dictionary alone.
BLOCK = 4_096
LEVEL = 6
#: The score is margin / (margin + HALF): 0.5 where the second language takes HALF more bytes than the first.
HALF = 0.02
#: Below this score a text's language is taken as unknown by the pipeline.
REJECT = 0.1
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    return _OTHER.sub(" ", text).lower()


def dictionaries(docs: DataFrame, most: int = DICTIONARY, together: int = ALL_DICTIONARIES) -> dict[str, bytes]:
    """Dictionaries of all languages from rows of (doc_id, text, lang), the most frequent language first. Texts are taken
    in order of a hash of their ids until a dictionary is full, each with its middle part."""
    rows = docs.where("lang is not null and length(text) > 0")
    order = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]  # a row for each language
    if not order:
        return {}
    size = min(most, max(1, together // len(order)))
    need = -(-size // 256)  # texts per language; more than enough if texts are 256 bytes long
    ranked = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    part = F.substring("text", F.greatest(F.lit(1), F.floor((F.char_length("text") - SHARE) / 2).cast("int")), F.lit(SHARE))
    some = rows.select("lang", "doc_id", part.alias("text")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= need)
    found: dict[str, list[bytes]] = {}
    for r in some.orderBy("lang", "rank").toLocalIterator():  # at most `need` parts of SHARE characters for each language
        parts = found.setdefault(r["lang"], [])
        if sum(map(len, parts)) < size:
            parts.append(letters(r["text"]).encode("utf-8", "surrogatepass"))
    return {lang: b" ".join(found[lang])[:size] for lang in order if lang in found}


class _Judge:
    def __init__(self, known: dict[str, bytes]):
        import zstandard

        self.languages = list(known)
        self._encoders = []
        for lang in self.languages:
            d = zstandard.ZstdCompressionDict(known[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self._encoders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        data = letters(text).encode("utf-8", "surrogatepass")
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return np.array([sum(len(e.compress(b)) for b in blocks) for e in self._encoders], dtype=np.int64)

    def judge(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        sizes = self.sizes(text)
        order = np.argsort(sizes, kind="stable")  # ties: the most frequent language
        if len(order) == 1:
            return self.languages[order[0]], 1.0
        margin = (sizes[order[1]] - sizes[order[0]]) / sizes[order[0]]
        return self.languages[order[0]], float(margin / (margin + HALF))


def with_language(docs: DataFrame, known: dict[str, bytes]) -> DataFrame:
    """`docs` with columns lang_pred and score. Null texts and texts without a letter are `und` with score 0, and so
    are all texts if no language was learned. The score is near 0 where two languages are about as good."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(known)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names] + ["lang_pred string", "score double"])

    def run(batches):
        judge = _Judge(shared.value)
        for b in batches:
            found = [judge.judge(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def learned(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries from the documents that aren't held out."""
    return dictionaries(docs.where(crc_mod("doc_id", 5) != 0).select("doc_id", "text", "lang"))


def op9_language(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from text and lang of documents that aren't held out. Rows with a
    null id are judged like others and count as not held out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    found = with_language(docs.select("doc_id", "text"), learned(docs))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
