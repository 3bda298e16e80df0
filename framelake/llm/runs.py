"""Periodic runs of words by Main and Lorentz's divide and conquer.

Words are interned to numbers, and the texts of a batch lie one after the other with a number of its own between any
two, so that no run goes over an end. A run of period q that is at least four periods long crosses the midpoint of the
smallest block that holds it, and at least two of its periods lie on one side of the midpoint. So the word at q of that
side, read away from the midpoint, has a Z-value of q or more: the Z-functions of both sides of each midpoint give all
candidates. A candidate is extended to both sides; what goes on beyond its block belongs to a block above. Of equal
stretches the smallest period stays.

Blocks of up to 64 words are looked at together, a level at a time, as tables of numbers; larger ones one by one, with
Z-values only at the places that hold the side's first word (all others are 0).
"""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import prepare, table

#: A run has at least so many words and so many periods.
LEAST, PERIODS = 6, 4
#: Words on each side of the midpoints that are looked at together.
_TOGETHER = 32
#: Bytes of text that are looked at together.
_BYTES = 4_000_000


class _Ids(dict):
    """Numbers of words in order of appearance."""

    def __missing__(self, word):
        self[word] = found = len(self)
        return found


def words_of(text: bytes | None) -> list[bytes]:
    """The stretches of a UTF-8 text without blanks and controls from tab to carriage return, which is how bytes split."""
    return text.split() if text else []


def z_values(ids: list[int], line: np.ndarray, at: int, end: int, most: int) -> dict[int, int]:
    """The Z-function of ids[at:end] at 1 to `most`, without its zeros. `line` is `ids` as an array."""
    first = np.flatnonzero(line[at + 1 : min(at + most + 1, end)] == line[at]) + 1
    if not first.size:
        return {}
    z = dict.fromkeys(first.tolist(), 1)
    second = first[line[np.minimum(at + first + 1, len(line) - 1)] == line[at + 1]] if end - at > 1 else first[:0]
    left = right = 0
    for i in second.tolist():
        k = min(right - i, z.get(i - left, 0)) if i < right else 0
        while at + i + k < end and ids[at + k] == ids[at + i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _agree(line: np.ndarray, a: int, b: int, most: int, step: int) -> int:
    """How many words agree from a and from b on, forwards (step 1) or backwards (-1), at most `most`."""
    size, done = 8, 0
    while done < most:
        n = min(size, most - done)
        if step > 0:
            same = line[a + done : a + done + n] == line[b + done : b + done + n]
        else:
            same = line[a - done - n + 1 : a - done + 1][::-1] == line[b - done - n + 1 : b - done + 1][::-1]
        if not same.all():
            return done + int(same.argmin())
        done += n
        size *= 8
    return done


def _crossing(line: np.ndarray, lo: int, mid: int, hi: int, forward: list[int], backward: list[int], found: dict) -> None:
    """Adds the runs of the block from lo to hi that cross mid, by candidate periods of both sides, to {(start, end):
    period}. The words before lo and at hi exist."""
    for periods, step in ((forward, 1), (backward, -1)):
        ends: list[tuple[int, int]] = []  # of this side: where a period's repetition stops
        for q in periods:
            if step > 0:
                stop = mid + q + _agree(line, mid + q, mid, hi - mid - q, 1)
                beyond = stop == hi and line[hi] == line[hi - q]
            else:
                stop = mid - q - _agree(line, mid - 1 - q, mid - 1, mid - q - lo, -1)
                beyond = stop == lo and line[lo - 1] == line[lo - 1 + q]
            if any(q % p == 0 and stop == s for p, s in ends):
                continue  # the same stretch in several periods at once
            ends.append((q, stop))
            if beyond:
                continue
            if step > 0:
                start, end = mid - _agree(line, mid - 1, mid - 1 + q, mid - lo, -1), stop
                beyond = start == lo and line[lo - 1] == line[lo - 1 + q]
            else:
                start, end = stop, mid + _agree(line, mid, mid - q, hi - mid, 1)
                beyond = end == hi and line[hi] == line[hi - q]
            if not beyond and end - start >= max(LEAST, PERIODS * q):
                found[start, end] = min(q, found.get((start, end), q))


def runs_of(texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of word numbers (from 0 on), by start, then period."""
    bounds = [1]
    ids = [-1]  # numbers that no word has stand between texts and at both ends
    for k, text in enumerate(texts):
        ids += text
        ids.append(-2 - k)
        bounds.append(len(ids))
    n = len(ids)
    ids += range(-2 - len(texts) - (-n % (2 * _TOGETHER)), -2 - len(texts))
    line = np.array(ids, dtype=np.int64)
    found: dict[tuple[int, int], int] = {}
    half = PERIODS
    while half <= _TOGETHER:
        sides = line.reshape(-1, 2 * half)
        for side, step in ((sides[:, half:], 1), (sides[:, :half][:, ::-1], -1)):
            for q in range(1, half * 2 // PERIODS + 1):
                alive = side[:, 0] == side[:, q]
                for t in range(1, q):
                    if not alive.any():
                        break
                    alive &= side[:, t] == side[:, t + q]
                for block in np.flatnonzero(alive).tolist():
                    mid = (2 * block + 1) * half
                    lo, hi = max(mid - half, 1), min(mid + half, len(line) - 1)
                    _crossing(line, lo, mid, hi, [q] if step > 0 else [], [q] if step < 0 else [], found)
        half *= 2
    starts = np.array(bounds)
    mirrored, mirror = None, None
    while half < n:
        mids = np.arange(half, n, 2 * half)
        text = np.searchsorted(starts, mids, side="right") - 1
        los = np.maximum(mids - half, starts[text])
        his = np.minimum(mids + half, starts[np.minimum(text + 1, len(starts) - 1)] - 1)
        some = (los < mids) & (mids < his) & (his - los >= LEAST)
        for lo, mid, hi in zip(los[some].tolist(), mids[some].tolist(), his[some].tolist(), strict=True):
            if mirrored is None:
                mirrored, mirror = ids[::-1], np.ascontiguousarray(line[::-1])
            most, size = (hi - lo) // PERIODS, len(line)
            forward = z_values(ids, line, mid, hi, min(most, hi - mid - 1))
            backward = z_values(mirrored, mirror, size - mid, size - lo, min(most, mid - lo - 1))
            ahead, behind = sorted(q for q, z in forward.items() if z >= q), sorted(q for q, z in backward.items() if z >= q)
            if ahead or behind:
                _crossing(line, lo, mid, hi, ahead, behind, found)
        half *= 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if found:
        keys = sorted(found)
        for (start, end), k in zip(keys, (np.searchsorted(starts, [s for s, _ in keys], side="right") - 1).tolist(), strict=True):
            out[k].append((start - bounds[k], end - start, found[start, end]))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run repeats: of each run the first period stays, unless another run drops it."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    keep = np.cumsum(edges[:-1]) == 0
    return list(itertools.compress(words, keep.tolist()))


def repeated(doc_id: int | None, words: list) -> list:
    """The words with the repetition that the query's contract plants in a tenth of the documents, by their ids."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * (-(-(n - a) // p)))[: n - a]


def _batches(texts: list[bytes | None]):
    """Stretches of places in `texts` of at most about _BYTES bytes together."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or b"") > _BYTES:
            yield first, i
            first, size = i, 0
        size += len(t or b"")
    if first < len(texts):
        yield first, len(texts)


def _looked_at(batches, change=None):
    """(row, words, runs) of the rows of Arrow batches with a binary column text; change(row, words) alters words."""
    for b in batches:
        texts = b.column("text").to_pylist()
        for first, end in _batches(texts):
            words = [words_of(t) for t in texts[first:end]]
            if change:
                words = [change(b, first + i, w) for i, w in enumerate(words)]
            ids = _Ids()
            yield b.slice(first, end - first), words, runs_of([list(map(ids.__getitem__, w)) for w in words])


_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with columns runs (start, length, period in words, by start, then period) and collapsed, the text without
    what runs repeat, its kept words joined by blanks.

    Null texts are empty: no runs, and an empty text. Rows stay one for one, whatever their other columns hold.
    """
    prepare(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("runs", "collapsed")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names]

    def run(batches):
        for b in batches:
            alone = pa.RecordBatch.from_arrays([b.column(text).cast(pa.binary()), *[b.column(n) for n in names]], names=["text", *[f"{i}" for i in range(len(names))]])
            for part, words, runs in _looked_at([alone]):
                found = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
                kept = [b" ".join(kept_words(w, r)).decode("utf-8", "replace") for w, r in zip(words, runs, strict=True)]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(found, kind), pa.array(kept, pa.string())], names=[*names, "runs", "collapsed"])

    return docs.select(*names).mapInArrow(run, ", ".join([*fields, f"runs {_RUNS}", "collapsed string"]))


def op12_runs(spark, sf_dir: str) -> DataFrame:
    """Periodic runs of every whole text, some of them planted by the contract, as numbers and digests.

    Null texts have no words: no run, and the digests of the empty string. Rows with a null id are left as they are and
    looked at like others; rows that repeat an id stay. An empty table gives no row.
    """
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def plant(doc_ids, row, words):
        return repeated(doc_ids.column("doc_id")[row].as_py(), words)

    def run(batches):
        for part, words, runs in _looked_at(batches, plant):
            longest = [min(r, key=lambda x: (-x[1], x[0], x[2])) if r else (None, None, None) for r in runs]
            exponents = [1000 * n // q if q else None for _, n, q in longest]
            listed = [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()).hexdigest() for r in runs]
            kept = [hashlib.sha256(b" ".join(kept_words(w, r))).hexdigest() for w, r in zip(words, runs, strict=True)]
            numbers = [list(map(len, runs)), *map(list, zip(*longest, strict=True)), exponents]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x, pa.int64()) for x in numbers], pa.array(listed, pa.string()), pa.array(kept, pa.string())], names=names)

    schema = ", ".join([f"{n} bigint" for n in names[:6]] + [f"{n} string" for n in names[6:]])
    return docs.mapInArrow(run, schema)
