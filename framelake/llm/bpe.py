"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of a word's tree hold (rank, position) of each adjacent pair of symbols, and each inner node the least of
its children, so the root is the leftmost pair of lowest rank. A merge writes three leaves - the merged pair, the
vanished one and the one before - and repairs their paths to the root, in logarithmic time, until the root says that
no pair can be merged. The trees of many words of like length are laid out in one array and advance together.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framelake.llm.common import prepare

WORD_BPE = "word_bpe_49k.json"
_NONE = np.int64(2**62)
#: Words and texts that a worker remembers; it forgets all of them beyond that, which costs time and no result.
REMEMBERED = 250_000


def tokenizer_path(name_or_path: str) -> str:
    """A path is taken as it is; a bare file name is one of the installed public tokenizers."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(extra)) for b in range(256)]


class WordBpe:
    """Encoder of a word-end BPE file: NFC, lower case, white space dropped, special strings kept whole."""

    # Latin letters and digits; texts with others go through the library's own normaliser and splitter
    _LATIN = re.compile(r"[\x00-ɏ]*")
    _WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-z0-9ª²³µ¹º¼-¾ß-öø-ɏ]+")
    _SPACES = re.compile(r"[\t-\r \x85\xa0  -     　]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.vocabulary: dict[str, int] = spec["model"]["vocab"]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocabulary.items(), *self.special.items()]}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._library = Tokenizer.from_file(path)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        pairs = np.array([(self.vocabulary[a] << 32) | self.vocabulary[b] for a, b in merges], dtype=np.int64)
        self._merged = np.array([self.vocabulary[a + b] for a, b in merges], dtype=np.int64)
        _, first = np.unique(pairs, return_index=True)  # sorted pairs, each with its lowest rank
        self._pairs, self._ranks = pairs[first], first.astype(np.int64)
        chars = byte_alphabet()
        self._byte = np.array([self.vocabulary[c] for c in chars], dtype=np.int64)
        self._last = np.array([self.vocabulary[c + self.suffix] for c in chars], dtype=np.int64)
        self._of_char = {c: b for b, c in enumerate(chars)}
        self._word_ids: dict[bytes, tuple[int, ...]] = {}
        self._chunk_ids: dict[str, str] = {}
        self._chunk_tokens: dict[str, str] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where((self._pairs[at] == key) & (a >= 0) & (b >= 0), self._ranks[at], _NONE >> 32)

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of words given as bytes, in the order given."""
        out: list[tuple[int, ...]] = [()] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_width.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, members in by_width.items():
            step = max(1, 400_000 // width)
            for lo in range(0, len(members), step):
                some = members[lo : lo + step]
                for i, ids in zip(some, self._advance([words[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def _advance(self, words: list[bytes], width: int) -> list[tuple[int, ...]]:
        n = len(words)
        length = np.fromiter(map(len, words), dtype=np.int64, count=n)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        row = np.repeat(np.arange(n), length)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        symbol = np.full((n, width + 1), -1, dtype=np.int64)
        symbol[row, col] = self._byte[flat]
        ends = np.array([w[-1] for w in words])
        symbol[np.arange(n), length - 1] = self._last[ends]
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        after[np.arange(n), length - 1] = width  # the last column of symbol holds no symbol
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
        place = np.arange(width)
        tree[:, width:] = (self._rank(symbol[:, :width], symbol[:, 1:]) << 32) | place
        half = width
        while half > 1:
            tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
            half //= 2
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while live.size:
            root = tree[live, 1]
            i = root & 0xFFFFFFFF
            j = after[live, i]
            k = after[live, j]
            p = before[live, i]
            new = self._merged[root >> 32]
            symbol[live, i] = new
            symbol[live, j] = -1
            after[live, i] = k
            before[live, k] = i
            tree[live, width + j] = _NONE
            tree[live, width + i] = (self._rank(new, np.where(k < width, symbol[live, k], -1)) << 32) | i
            has = p >= 0
            q, at = p[has], live[has]
            tree[at, width + q] = (self._rank(symbol[at, q], new[has]) << 32) | q
            x, y, z = (width + i) >> 1, (width + j) >> 1, (width + q) >> 1
            while x[0] >= 1:
                for who, node in ((live, x), (live, y), (at, z)):
                    tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
                x, y, z = x >> 1, y >> 1, z >> 1
            live = live[tree[live, 1] < _NONE]
        kept = symbol[:, :width] >= 0
        ids = symbol[:, :width][kept].tolist()
        stops = np.cumsum(kept.sum(axis=1)).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *stops], stops, strict=False)]

    def words(self, chunk: str) -> list[bytes]:
        """The words of a chunk without white space, as bytes."""
        if self._LATIN.fullmatch(chunk):
            plain = (chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)).lower()
            if self._LATIN.fullmatch(plain):  # some capitals have their small letter elsewhere
                return [w.encode() for w in self._WORDS.findall(plain)]
        found = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(chunk))
        return [bytes(self._of_char[c] for c in w) for w, _ in found]

    def chunks(self, text: str) -> list[str]:
        """Special strings, and what white space parts of the rest: no word reaches over a chunk's end."""
        parts = self._split.split(text) if self._split else [text]
        if len(parts) == 1 and not re.search("[\x1c-\x1f]", text):
            return text.split()  # but for these four, Python's white space is the library's
        return [c for i, p in enumerate(parts) for c in ([p] if i % 2 else self._SPACES.split(p)) if c]

    def learn(self, chunks: set[str]) -> None:
        """Encodes the chunks that aren't remembered."""
        if len(self._chunk_ids) > REMEMBERED:
            self._chunk_ids.clear()
            self._chunk_tokens.clear()
        if len(self._word_ids) > REMEMBERED:
            self._word_ids.clear()
        todo = [c for c in chunks if c not in self._chunk_ids]
        parts = {c: self.words(c) for c in todo if c not in self.special}
        new = list({w for ws in parts.values() for w in ws if w not in self._word_ids})
        self._word_ids.update(zip(new, self.merge(new), strict=True))
        for c in todo:
            ids = [self.special[c]] if c in self.special else [i for w in parts[c] for i in self._word_ids[w]]
            self._chunk_ids[c] = " ".join(map(str, ids))
            self._chunk_tokens[c] = " ".join([self.tokens[i] for i in ids])

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text its decimal ids and its decoded text, both joined by spaces."""
        split = [self.chunks(t) for t in texts]
        self.learn({c for s in split for c in s})
        for s in split:
            yield " ".join(map(self._chunk_ids.__getitem__, s)), " ".join(map(self._chunk_tokens.__getitem__, s))

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by spaces; unknown ids are passed over."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode(df: DataFrame, text: str = "text", tokenizer: str = WORD_BPE) -> DataFrame:
    """`df` with columns ids (array of int) and decoded (string)."""
    prepare(df.sparkSession)
    schema = T.StructType([f for f in df.schema if f.name not in ("ids", "decoded")] + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    names = [f.name for f in schema][:-2]

    def run(batches):
        model = word_bpe(tokenizer_path(tokenizer))
        for b in batches:
            pairs = list(model.encode([t or "" for t in b.column(text).to_pylist()]))
            ids = [[int(i) for i in x.split()] for x, _ in pairs]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(ids, pa.list_(pa.int32())), pa.array([d for _, d in pairs], pa.string())], names=[*names, "ids", "decoded"])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", tokenizer: str = WORD_BPE) -> DataFrame:
    """`df` with column decoded, from an array of ids."""
    prepare(df.sparkSession)
    schema = T.StructType([f for f in df.schema if f.name != "decoded"] + [T.StructField("decoded", T.StringType())])
    names = [f.name for f in schema][:-1]

    def run(batches):
        model = word_bpe(tokenizer_path(tokenizer))
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array([model.decode(x or []) for x in b.column(ids).to_pylist()], pa.string())], names=[*names, "decoded"])

    return df.mapInArrow(run, schema)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests.

    Null texts are empty: no ids, and both digests are those of the empty string. Rows stay one for one, whatever
    their ids.
    """
    import hashlib

    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("cast(doc_id as bigint) doc_id", "text")

    def run(batches):
        model = word_bpe(tokenizer_path(WORD_BPE))
        for b in batches:
            n, ids, decoded = [], [], []
            for x, d in model.encode([t or "" for t in b.column("text").to_pylist()]):
                n.append(x.count(" ") + 1 if x else 0)
                ids.append(hashlib.sha256(x.encode()).hexdigest())
                decoded.append(hashlib.sha256(d.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
