"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids are whole sequences first, then a rest that is shorter. The rests of about GROUP_WINDOWS windows, as they
come in a task, are a group. In it every rest starts as a partial partition with one filled window, and the two
partitions of largest imbalance are merged again and again, the fullest windows of one with the emptiest of the other,
which leaves near-equal windows. There are as many windows as the tokens need at least; while the fullest one is over
the capacity, one more is tried, until SLACK of the places would be padding. What is over the capacity then is cut off
the longest rests of its windows and fills the places that others have left, so most documents stay in one piece.

Groups are made where the texts are, so nothing is shuffled, and only the last group of a task can be small.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import bytes_bpe
from framelake.llm.common import prepare, table

CAPACITY = 1024
#: Windows of a group, about.
GROUP_WINDOWS = 256
#: The share of places that may be padding before rests are cut.
SLACK = 0.004
END = 0


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item, by multiway differencing."""
    n = len(sizes)
    label = np.empty((2 * n - 1, windows), dtype=np.int32) if n else np.empty((0, windows), dtype=np.int32)
    if windows == 1 or n <= 1:
        return np.zeros(n, dtype=np.int64)
    sums: dict[int, np.ndarray] = {}
    heap = []
    for i, s in enumerate(sizes.tolist()):
        one = np.zeros(windows, dtype=np.int64)
        one[0] = s
        sums[i] = one  # descending
        heap.append((-s, i))
    heapq.heapify(heap)
    merges = []
    new = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        sums[new] = total
        merges.append((a, b, new, order))
        heapq.heappush(heap, (int(total[-1] - total[0]), new))
        new += 1
    label[new - 1] = np.arange(windows)
    for a, b, made, order in reversed(merges):
        back = np.empty(windows, dtype=np.int32)
        back[order] = label[made]
        label[a] = back
        label[b] = back[::-1]
    return label[:n, 0].astype(np.int64)


def windows_of(sizes: np.ndarray, capacity: int = CAPACITY, slack: float = SLACK) -> list[tuple[int, int, int, int]]:
    """(item, start, length, window) of the pieces of all items, in order of items and starts; no window is over the
    capacity, and few items are cut."""
    if not len(sizes):
        return []
    least = max(1, -(-int(sizes.sum()) // capacity))
    for m in range(least, max(least, int(least * (1 + slack))) + 1):
        at = differencing(sizes, m)
        load = np.bincount(at, weights=sizes, minlength=m).astype(np.int64)
        if load.max() <= capacity:
            break
    pieces = [[i, 0, int(n), int(w)] for i, (n, w) in enumerate(zip(sizes, at, strict=True))]
    over = np.flatnonzero(load > capacity)
    if len(over):
        of_window: dict[int, list[list[int]]] = {int(w): [] for w in over}
        for p in pieces:
            if p[3] in of_window:
                of_window[p[3]].append(p)
        room = [(int(load[w]) - capacity, int(w)) for w in np.flatnonzero(load < capacity)]
        heapq.heapify(room)  # the emptiest first
        for w, own in of_window.items():
            extra = int(load[w]) - capacity
            own.sort(key=lambda p: -p[2])
            while extra:
                longest = own.pop(0)
                cut = min(extra, longest[2])
                extra -= cut
                longest[2] -= cut
                start = longest[1] + longest[2]
                while cut:
                    free, to = heapq.heappop(room)
                    n = min(cut, -free)
                    pieces.append([longest[0], start, n, to])
                    start, cut = start + n, cut - n
                    if n < -free:
                        heapq.heappush(room, (free + n, to))
    return sorted((i, s, n, w) for i, s, n, w in pieces if n)


def packed(docs: DataFrame, tokenizer: str = bytes_bpe.BYTE_BPE, capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens) with sequence_id and offset. A sequence never has more than
    `capacity` tokens and its pieces lie without gaps from 0. Null texts are empty: only the closing id. Equal rows, and
    rows that share an id or have none, are packed each by itself. A sequence's number tells its task and its place there."""
    prepare(docs.sparkSession)
    end = np.array([END], dtype="<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        model = bytes_bpe.load(tokenizer)
        following = TaskContext.get().partitionId() << 32
        rests: list[tuple[int | None, int, bytes, int]] = []  # document, start, ids, tokens of the document
        waiting = 0

        def group() -> list[tuple]:
            nonlocal following
            rows, filled = [], {}
            sizes = np.array([len(ids) // 4 for _, _, ids, _ in rests], dtype=np.int64)
            for i, start, length, window in windows_of(sizes, capacity):
                doc_id, first, ids, tokens = rests[i]
                at = filled.get(window, 0)
                filled[window] = at + length
                rows.append((doc_id, first + start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), tokens, following + window, at))
            following += max(filled, default=-1) + 1
            rests.clear()
            return rows

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = model.ids(text or "") + end
                n = len(ids) // 4
                whole = n - n % capacity
                for start in range(0, whole, capacity):
                    rows.append((doc_id, start, capacity, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + capacity)]), n, following, 0))
                    following += 1
                if whole < n:
                    rests.append((doc_id, whole, bytes(ids[4 * whole :]), n))
                    waiting += n - whole
                if waiting >= group_windows * capacity:
                    rows += group()
                    waiting = 0
            if rows:
                yield batch(rows)
        if rests:
            yield batch(group())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 1024 with little padding; see `packed`."""
    return packed(table(spark, sf_dir, "documents"))
