"""Document fingerprints by winnowing, with DataFrame functions only.

A text's rolling k-grams of code points are hashed, each window of `window` consecutive hashes gives its minimum
(the rightmost one on ties), and the chosen (hash, position) pairs form the fingerprint. Any passage of at least
``k + window - 1`` code points that two texts share has a hash that both choose.

A gram is packed in one long: 35 bits of its hash above 28 bits of its reversed position, so the smallest packed
value of a window is the smallest hash at its rightmost position. Window minima come from doubling: ``log2(window)``
element-wise minima of an array with itself shifted. A long text is taken CHUNK windows at a time, so only one chunk's
grams are in memory beside the text and what was chosen.

An edited text goes on like the text it comes from for a while, so what that beginning chooses is computed once.

Null texts count as empty. A text shorter than k has its whole text as its only gram; an empty text has no gram and
an empty fingerprint; a text with fewer than `window` grams has one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 8
WINDOW = 8
_POSITION_BITS = 28
_POSITIONS = (1 << _POSITION_BITS) - 1
_HASHES = (1 << 35) - 1


#: Windows of a long text that are looked at together.
CHUNK = 16_384


def _grams(text: Column, k: int) -> Column:
    # each match goes on by one code point, so that none begins inside a surrogate pair
    grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))
    return F.when(F.char_length(text) >= k, grams).when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))


def _packed(text: Column, k: int, offset: Column) -> Column:
    """Packed grams of a text whose first code point has position `offset`."""
    return F.transform(
        _grams(text, k),
        lambda gram, i: F.shiftleft(F.xxhash64(gram).bitwiseAND(F.lit(_HASHES)), _POSITION_BITS).bitwiseOR(
            F.lit(_POSITIONS) - (i + offset).bitwiseAND(F.lit(_POSITIONS))
        ),
    )


def _bound(value: Column, then) -> Column:
    """`then(value)` with `value` evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _minima(packed: Column, window: int) -> Column:
    """The minimum of each run of `window` elements; one minimum of all if there are fewer."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")

    def shifted(step):
        return lambda a: F.zip_with(a, F.slice(a, step + 1, F.greatest(F.size(a) - step, F.lit(0))), lambda x, y: F.least(x, y))

    whole = packed
    step = 1
    while step < window:
        whole = _bound(whole, shifted(step))
        step *= 2
    return _bound(whole, lambda a: F.slice(a, 1, F.greatest(F.size(a) - (window - 1), F.least(F.size(a), F.lit(1)))))


def _chosen(text: Column, k: int, window: int, offset: Column) -> Column:
    """Distinct minima of the windows of a text of at most CHUNK windows."""
    return F.array_distinct(_minima(_packed(text, k, offset), window))


def _chunked(text: Column, k: int, window: int, offset: Column) -> Column:
    """Distinct minima of all windows of a text, chunk by chunk."""
    windows = F.char_length(text) - (k + window - 2)
    starts = F.sequence(F.lit(0), F.greatest(windows - 1, F.lit(0)), F.lit(CHUNK))
    piece = lambda i: F.substring(text, i + 1, F.lit(CHUNK + k + window - 2))
    long = F.flatten(F.transform(starts, lambda i: _chosen(piece(i), k, window, i + offset)))
    return F.when(windows <= CHUNK, _chosen(text, k, window, offset)).otherwise(F.array_distinct(long))


def winnow(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The fingerprint of a text: distinct packed grams in order of position."""
    return _chunked(F.coalesce(text, F.lit("")), k, window, F.lit(0))


def hashes(fingerprint: Column) -> Column:
    """The distinct hashes of a fingerprint, without positions."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, _POSITION_BITS)))


def positions(fingerprint: Column) -> Column:
    """(hash, position) pairs of a fingerprint; positions count code points from 0."""
    return F.transform(
        fingerprint,
        lambda x: F.struct(
            F.shiftright(x, _POSITION_BITS).alias("hash"), (F.lit(_POSITIONS) - x.bitwiseAND(F.lit(_POSITIONS))).alias("position")
        ),
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 where both are empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def fingerprints(df: DataFrame, text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """`df` with column fingerprint: array of (hash, position)."""
    return df.withColumn("fingerprint", positions(winnow(F.col(text), k, window)))


def _slice_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many of the sorted `cuts` are not above the id, found in two steps of about the root of their number."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    below = lambda numbers: F.size(F.filter(numbers, lambda x: x <= doc_id))
    longs = lambda x: F.array(*[F.lit(v).cast("long") for v in x])
    group = F.greatest(below(longs([g[0] for g in groups])) - 1, F.lit(0))
    return group * width + below(F.get(F.array(*[longs(g) for g in groups]), group))


def with_next_text(docs: DataFrame, slices: int):
    """Rows with next_text, and the window that orders them in their slices. next_text: the text of the next row in
    descending doc_id, and the first row's after the last.

    The ids are cut in `slices` ranges by approximate quantiles. Each slice is sorted by itself, with the first row of
    the next slice that has rows appended, so one shuffle does it and no task sees more than a slice. Equal ids follow
    in order of their texts; null ids come last.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = base.where("doc_id is not null").approxQuantile("doc_id", [i / slices for i in range(1, slices)], 0.5 / slices) if slices > 1 else []
    part = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_slice_of(F.col("doc_id"), sorted({int(x) for x in cuts})))
    base = base.withColumn("slice", part)
    heads = {r["slice"]: r["head"] for r in base.groupBy("slice").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    # at most `slices` + 1 rows: the head of each slice goes to the slice before it, the very first to the last one
    moves = [(heads[s], s, order[i - 1]) for i, s in enumerate(order)]
    moves = F.broadcast(spark.createDataFrame(moves, "head long, of int, to int"))
    first = base.join(moves, F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("slice") == F.col("of")))
    first = first.groupBy("to").agg(F.min("text").alias("text"))
    rows = base.withColumn("extra", F.lit(0)).unionByName(first.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("to").alias("slice"), F.lit(1).alias("extra")))
    in_slice = Window.partitionBy("slice").orderBy("extra", F.desc_nulls_last("doc_id"), "text")
    return rows.withColumn("next_text", F.lead("text").over(in_slice)), in_slice


def edited_pairs(docs: DataFrame, k: int = K, window: int = WINDOW, slices: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text and likenesses; see the contract of op8."""
    spark = docs.sparkSession
    n = slices or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, in_slice = with_next_text(docs, n)
    text, chars, reach = F.col("text"), F.col("n_chars").cast("int"), k + window - 2
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("cut", F.floor(chars / 3).cast("int"))
    rows = rows.withColumn("added", F.substring(F.col("next_text"), F.lit(1), F.col("cut"))).drop("next_text")
    rows = rows.withColumn("edited", F.concat(F.substring(text, F.lit(1), chars - F.col("cut")), F.col("added")))
    # where both texts hold whole windows before the edit, those windows are looked at once
    shares = chars >= 2 * (reach + 1)
    kept, at = chars - F.col("cut"), chars - F.col("cut") - reach
    none = F.array().cast("array<bigint>")
    rest = F.substring(text, at + 1, chars)
    new = F.concat(F.substring(text, at + 1, F.lit(reach)), F.col("added"))
    rows = rows.withColumn("head", F.when(shares, _chunked(F.substring(text, F.lit(1), kept), k, window, F.lit(0))).otherwise(none))
    after = lambda piece, whole: F.when(~shares, _chunked(whole, k, window, F.lit(0))).when(
        F.char_length(piece) > reach, F.array_union("head", _chunked(piece, k, window, at))
    ).otherwise(F.col("head"))
    rows = rows.withColumn("own", after(rest, text)).withColumn("other", after(new, F.col("edited")))
    rows = rows.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    rows = rows.select("doc_id", "slice", "extra", "text", "n_chars", "edited_sha256", "own", "other")
    rows = rows.withColumn("own_hashes", hashes(F.col("own"))).withColumn("edited_hashes", hashes(F.col("other")))
    return rows.withColumn("next_hashes", F.lead("own_hashes").over(in_slice)).where("extra = 0")


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Winnowing fingerprints of every document and of its edited text.

    fingerprint and edited_fingerprint are SHA-256 digests of the packed (hash, position) lists, so equal texts have
    equal ones; n_grams counts the chosen grams. Null ids are kept, null texts are empty, an empty table gives no row.
    Rows that repeat an id stay, in order of their texts.
    """
    rows = edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(F.concat_ws(",", F.transform(F.col(c), lambda x: F.hex(x))), 256)
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        digest("own").alias("fingerprint"),
        digest("other").alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"),
        F.size("own").cast("long").alias("n_grams"),
    )
