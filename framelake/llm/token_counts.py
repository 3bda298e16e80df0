"""Token counts by overlap resynchronisation.

Texts up to `huge` characters are encoded at once. A longer one is cut in chunks that overlap, which Spark deals out;
each chunk is encoded with offsets. Two neighbours are spliced at the first pre-token boundary that both have in
their overlap. From a common boundary on both see the same characters and the splitting pattern never looks back, so
they go on alike: the boundary is proven, by induction from the text's start. Boundaries near a chunk's right end,
where the pattern could have looked further ahead, don't count. Where neighbours share no boundary, the text is cut
again with wider overlaps, at last as one chunk.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import bytes_bpe
from framelake.llm.common import discard, prepare, table, written

HUGE = 32_768
CHUNK = 16_384
OVERLAP = 512
#: Characters before a chunk's right end in which no boundary counts: longer than any special string.
MARGIN = 32
LIMIT = 1024


def _counted(df: DataFrame, tokenizer: str) -> DataFrame:
    def run(batches):
        model = bytes_bpe.load(tokenizer)
        for b in batches:
            n = [len(model.encoded(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return df.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def _chunks(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """(key, k, last, start, chunk): chunk k starts at k * size and reaches `overlap` into the next one."""

    def run(batches):
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                n = max(1, -(-len(text) // size))
                for k in range(n):
                    piece = text[k * size : (k + 1) * size + overlap] if k < n - 1 else text[k * size :]
                    yield pa.RecordBatch.from_pydict({"key": [key], "k": pa.array([k], pa.int32()), "last": [k == n - 1], "start": pa.array([k * size], pa.int64()), "chunk": [piece]})

    return texts.mapInArrow(run, "key string, k int, last boolean, start bigint, chunk string")


def _encoded(chunks: DataFrame, size: int, overlap: int, tokenizer: str) -> DataFrame:
    """Per chunk: tokens in all, and the boundaries (position, tokens before) at its left and right overlap."""
    pairs = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))

    def run(batches):
        model = bytes_bpe.load(tokenizer)
        for b in batches:
            total, left, right = [], [], []
            for k, last, start, chunk in zip(*(b.column(c).to_pylist() for c in ("k", "last", "start", "chunk")), strict=True):
                at, n, all_tokens = model.boundaries(chunk)
                total.append(all_tokens)
                left.append([{"at": start + x, "n": c} for x, c in zip(at, n, strict=True) if x < overlap] if k else [])
                ends = [*at[1:], len(chunk)]
                right.append([] if last else [{"at": start + x, "n": c} for x, c, e in zip(at, n, ends, strict=True) if x >= size and e <= len(chunk) - MARGIN])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("k"), b.column("last"), pa.array(total, pa.int64()), pa.array(left, pairs), pa.array(right, pairs)], names=["key", "k", "last", "total", "left", "right"])

    kind = "array<struct<at:bigint,n:bigint>>"
    return chunks.mapInArrow(run, f"key string, k int, last boolean, total bigint, left {kind}, right {kind}")


def _spliced(encoded: DataFrame) -> DataFrame:
    """(key, n_tokens): null where some neighbours share no boundary."""
    right = encoded.select("key", "k", "last", "total", "right")
    left = encoded.select("key", (F.col("k") - 1).alias("k"), "left").where("k >= 0")
    both = right.join(left, ["key", "k"], "left")
    common = F.array_min(F.array_intersect(F.col("right.at"), F.col("left.at")))
    both = both.withColumn("common", common)
    # a chunk adds its tokens before the splice; its neighbour takes off those it has before it
    tokens = F.when(F.col("last"), F.col("total")).otherwise(F.get(F.filter("right", lambda x: x["at"] == F.col("common")), 0)["n"] - F.get(F.filter("left", lambda x: x["at"] == F.col("common")), 0)["n"])
    both = both.withColumn("tokens", tokens)
    return both.groupBy("key").agg(F.when(F.count("*") == F.count("tokens"), F.sum("tokens")).alias("n_tokens"))


def huge_counts(texts: DataFrame, tokenizer: str = bytes_bpe.BYTE_BPE, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens) of long texts given as (key, text), each key once."""
    texts = texts.select("key", "text")
    found = None
    longest = None
    # a number of its own, else few small partitions become one although their chunks are much work
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        chunks = _chunks(texts, size, overlap).repartition(tasks, F.col("key"), F.col("k"))
        encoded = written(_encoded(chunks, size, overlap, tokenizer), "encoded-chunks")  # both sides of the splices read it
        now = written(_spliced(encoded), "splices")
        discard(encoded)
        done = now.where("n_tokens is not null")
        found = done if found is None else found.unionByName(done)
        failed = now.where("n_tokens is null").select("key")
        if failed.isEmpty():
            return found
        texts = texts.join(failed, "key", "left_semi")
        if longest is None:
            longest = texts.select(F.max(F.char_length("text"))).first()[0]
        size, overlap = size * 8, overlap * 8
        if overlap >= longest:
            size = longest + 1


def token_counts(docs: DataFrame, tokenizer: str = bytes_bpe.BYTE_BPE, huge: int = HUGE) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row of (doc_id, text). Null texts are empty and have no token. Long texts
    that occur many times are encoded once."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = _counted(docs.where(F.char_length("text") <= huge), tokenizer)
    long = docs.where(F.char_length("text") > huge).withColumn("key", F.sha2("text", 256))
    counts = huge_counts(long.select("key", "text").dropDuplicates(["key"]), tokenizer)
    return short.unionByName(long.select("doc_id", "n_bytes", "key").join(counts, "key").select("doc_id", "n_bytes", "n_tokens"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every whole text. Null texts are empty; rows stay one for one, whatever their ids."""
    counts = token_counts(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
