"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has a model of the letters of words: the highest order is discounted counts of how the
class's own words go on after what was read of a word, and what is taken off goes to lower orders that both classes
share, with continuation counts as Kneser and Ney have them. So a rare or unseen expression is smoothed by the same
backoff in both classes, and only what a class has really seen makes a difference. After a beginning that the toxic
class has seen fewer than SEEN times both classes go on by the shared orders alone, so that a word that a toxic text
happens to hold doesn't count as an insult.

Counts, backoff and ratios are tables, without a bound: a row for each word beginning that was seen. Its most frequent
rows go to all executors and decide most words where the text is. A word that goes on where rows are left out is open:
such words, rare in the labelled texts, get their values by joins, which are brought back to the documents they are in.

An expression (a word) has the difference of its log-likelihoods under the classes. A document's features are that
difference over the whole text, normalised by its length; the same of its toxic expressions alone; and its most toxic
expressions, as a few insults in a long text are not many for each word. A logistic curve turns them into a
probability. It is fitted on labelled documents from which no counts were taken.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import crc_mod, discard, prepare, table, written

#: Letters of a word, start mark included, that the classes have counts for; letters of a shared window.
BEGINNING = 24
SHARED = 4
DISCOUNT = 0.75
#: A word whose log-likelihood ratio is above this counts as evidence.
EVIDENCE = 1.0
#: Beginnings that go to all executors, the most frequent ones (others are joined).
WINDOWS = 1 << 20
#: Sightings by the toxic class from which the classes go on after a beginning by counts of their own.
SEEN = 4
#: The curve is fitted on this share of the labels of each class, at most so many rows.
CALIBRATION_SHARE = 5
CALIBRATION_ROWS = 10_000
THRESHOLD = 0.7
FEATURES = ("difference", "second", "five", "density", "length")
#: Labels up to this number are sent to all executors; more of them are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
REMEMBERED = 150_000
_WORD = re.compile(r"[^\W\d_]+")
_START, _END = "^", "$"
_MARKS = ".,;:!?\"'()"
_U = np.uint64


def _word_counts(labelled: DataFrame) -> DataFrame:
    """(token, toxic, count) of rows (text, toxic), summed by task."""

    def run(batches):
        counts = (Counter(), Counter())

        def rows():
            for toxic in (0, 1):
                if counts[toxic]:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts[toxic])), pa.array([toxic] * len(counts[toxic]), pa.int32()), pa.array(list(counts[toxic].values()), pa.int64())], names=["token", "toxic", "count"])
                    counts[toxic].clear()

        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                counts[toxic].update((text or "").lower().split())
            if len(counts[0]) + len(counts[1]) > 100_000:
                yield from rows()
        yield from rows()

    parts = labelled.select("text", "toxic").mapInArrow(run, "token string, toxic int, count bigint")
    return parts.groupBy("token", "toxic").agg(F.sum("count").alias("count"))


def _grams(counts: DataFrame) -> DataFrame:
    """(gram, ordinary, toxic): counts of word beginnings (tagged "<") and of shared windows (tagged "=") over all
    labelled texts."""
    words = counts.select(F.explode(F.regexp_extract_all("token", F.lit(r"(\p{L}+)"))).alias("word"), "toxic", "count")
    marked = F.concat(F.lit(_START), "word", F.lit(_END))
    padded = F.concat(F.lit(_START * (SHARED - 1)), "word", F.lit(_END))
    beginnings = F.transform(F.sequence(F.lit(2), F.least(F.lit(BEGINNING), F.char_length("word") + 2)), lambda i: F.concat(F.lit("<"), F.substring(marked, F.lit(1), i)))
    windows = F.transform(F.sequence(F.lit(1), F.char_length("word") + 1), lambda i: F.concat(F.lit("="), F.substring(padded, i, F.lit(SHARED))))
    grams = words.select(F.explode(F.concat(beginnings, windows)).alias("gram"), "toxic", "count")
    of = lambda c: F.sum(F.when(F.col("toxic") == c, F.col("count")).otherwise(0))
    return grams.groupBy("gram").agg(of(0).alias("ordinary"), of(1).alias("toxic"))


def _but_last(c: str):
    return F.expr(f"substring({c}, 1, char_length({c}) - 1)")


def _backoff(grams: DataFrame) -> DataFrame:
    """(last, shared): the shared probability of the last letter of each window of SHARED - 1 letters after the others."""
    seen = grams.where("gram like '=%'").select(F.expr("substring(gram, 2)").alias("g"))
    orders = []
    for _ in range(SHARED - 1):
        counts = seen.groupBy(F.expr("substring(g, 2)").alias("g")).agg(F.count("*").alias("n"))
        orders.append(counts.join(counts.groupBy(_but_last("g").alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("types")), _but_last("g") == F.col("context")))
        seen = counts.select("g")
    letters = seen.agg((F.greatest(F.count("*"), F.lit(1)) + 1).alias("letters"))
    lower = orders[-1].crossJoin(letters).withColumn("below", 1.0 / F.col("letters"))
    for k in reversed(range(SHARED - 1)):
        value = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total") + DISCOUNT * F.col("types") / F.col("total") * F.col("below")
        found = lower.select("g", value.alias("shared"))
        if k:
            lower = orders[k - 1].join(found.select(F.col("g").alias("rest"), F.col("shared").alias("below")), F.expr("substring(g, 2)") == F.col("rest"))
    return found.withColumnRenamed("g", "last")


def _nodes(grams: DataFrame) -> DataFrame:
    """(beginning, ratio, beyond, least, count) of the start mark and of each word beginning that was seen after one
    that the toxic class has seen often enough: the log-likelihood ratio of its last letter, the ratio of any letter after it that
    was not seen there, and the least count of those that were."""
    seen = grams.where("gram like '<%'").select(F.expr("substring(gram, 2)").alias("beginning"), "ordinary", "toxic").withColumn("context", _but_last("beginning"))
    sums = [F.sum(c).alias(f"{c}_total") for c in ("ordinary", "toxic")] + [F.sum((F.col(c) > 0).cast("int")).alias(f"{c}_types") for c in ("ordinary", "toxic")]
    contexts = seen.groupBy("context").agg(*sums, F.min(F.col("ordinary") + F.col("toxic")).alias("least")).where(F.col("toxic_total") >= SEEN)
    taken = lambda c: F.when(F.col(f"{c}_total") > 0, DISCOUNT * F.col(f"{c}_types") / F.col(f"{c}_total")).otherwise(1.0)
    own = lambda c: F.when(F.col(f"{c}_total") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"{c}_total")).otherwise(0.0)
    chance = lambda c: own(c) + taken(c) * F.col("shared")
    last = F.expr(f"right(concat('{_START * (SHARED - 2)}', beginning), {SHARED - 1})")
    ratios = seen.join(contexts, "context").withColumn("last", last).join(_backoff(grams), "last")
    ratios = ratios.select("beginning", (F.log(chance("toxic")) - F.log(chance("ordinary"))).alias("ratio"), (F.col("ordinary") + F.col("toxic")).alias("count"))
    after = contexts.select(F.col("context").alias("beginning"), (F.log(taken("toxic")) - F.log(taken("ordinary"))).alias("beyond"), "least", (F.col("ordinary_total") + F.col("toxic_total")).alias("sum"))
    both = ratios.join(after, "beginning", "full")  # the start mark is a context only
    number = lambda c: F.coalesce(c, F.lit(0.0)).cast("float").alias(c)
    return both.select("beginning", number("ratio"), number("beyond"), "least", F.coalesce("count", "sum").alias("count"))


def _steps(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of words as a matrix of code points, their lengths, and a hash of nothing for each."""
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = np.zeros((len(words), int(length.max(initial=0))), dtype=np.uint64)
    row = np.repeat(np.arange(len(words)), length)
    letters[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return letters, length, np.full(len(words), _U(0x9E3779B97F4A7C15))


def _onward(h: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Hashes of beginnings with one letter more."""
    h = (h ^ letters) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


def _hashes(words: list[str]) -> np.ndarray:
    letters, length, h = _steps(words)
    for i in range(letters.shape[1]):
        on = length > i
        h[on] = _onward(h[on], letters[on, i])
    return h


def _head(nodes: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Sorted hashes of the most frequent beginnings, at most `size`, their ratio and beyond, and whether these are all
    beginnings. beyond is not a number where rows that go on are left out."""
    by_count = nodes.groupBy("count").agg(F.count("*").alias("n"))
    total = nodes.count()
    least = 0
    if total > size:  # the counts are few numbers, but for the largest ones, which don't decide
        left = total
        for r in by_count.orderBy("count").limit(100_000).collect():
            left, least = left - r["n"], r["count"] + 1
            if left <= size:
                break

    def packed(batches):  # one row of arrays for each task, as a million rows would cost the driver far more than their bytes
        parts = []
        for b in batches:
            ratio, beyond = (b.column(c).to_numpy(zero_copy_only=False).astype(np.float32) for c in ("ratio", "beyond"))
            parts.append((_hashes(b.column("beginning").to_pylist()), ratio, beyond))
        if parts:
            columns = [pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "ratio", "beyond"])

    beyond = F.when(F.col("least") < least, F.lit(float("nan"))).otherwise(F.col("beyond")).cast("float").alias("beyond")
    rows = nodes.where(F.col("count") >= least).select("beginning", "ratio", beyond).mapInArrow(packed, "h binary, ratio binary, beyond binary").collect()
    h, ratio, beyond = (np.frombuffer(b"".join([bytes(r[c]) for r in rows]), dtype=t) for c, t in (("h", np.uint64), ("ratio", np.float32), ("beyond", np.float32)))
    order = np.argsort(h)
    return h[order], ratio[order], beyond[order], least == 0


def _marked(word: str) -> str:
    """The part of a lower-case word that counts."""
    return (_START + word + _END)[:BEGINNING]


class _Scorer:
    def __init__(self, head: tuple[np.ndarray, np.ndarray, np.ndarray]):
        hashes, self.ratio, self.beyond = head
        # hashes are spread evenly, so where one would stand is a step or two from where its first bits begin
        self.hashes = np.append(hashes, _U(2**64 - 1))
        bits = max(1, len(hashes).bit_length() + 1)
        self.shift = _U(64 - bits)
        self.first = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.known: dict[str, float | tuple[float | None, tuple[str, ...]]] = {}

    def _places(self, h: np.ndarray) -> np.ndarray:
        """Where hashes stand among those of the head, or would."""
        at = self.first[h >> self.shift]
        less = np.flatnonzero(self.hashes[at] < h)
        while less.size:
            at[less] += 1
            less = less[self.hashes[at[less]] < h[less]]
        return at

    def values(self, marked: Sequence[str]) -> list[float | None]:
        """The log-likelihood ratios of words, all read letter by letter together; null where the head leaves one open."""
        letters, length, h = _steps(marked)
        value, beyond = np.zeros(len(marked)), np.zeros(len(marked))
        on = np.arange(len(marked))
        for i in range(letters.shape[1]):
            on = on[length[on] > i]
            h[on] = _onward(h[on], letters[on, i])
            at = self._places(h[on])
            found = (self.hashes[at] == h[on]) & (at < len(self.ratio))
            value[on[~found]] += beyond[on[~found]]
            on, at = on[found], at[found]
            value[on] += self.ratio[at]
            beyond[on] = self.beyond[at]
        return [None if v != v else v for v in value.tolist()]

    def learn(self, tokens: set[str]) -> None:
        """The highest log-likelihood ratio of the words of each token, 0 without a letter; or the highest of those
        that the head decides, and the open words."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = [t for t in tokens if t not in known]
        # most tokens are one word between marks, which needs no search
        low = [t.lower().strip(_MARKS) for t in new]
        alone = [t for t, w in zip(new, low, strict=True) if w.isalpha()]
        if alone:
            marked = [f"{_START}{w}{_END}"[:BEGINNING] for w in low if w.isalpha()]
            values = self.values(marked)
            known.update(zip(alone, values, strict=True))
            if None in values:
                known.update({t: (None, (w,)) for t, w, v in zip(alone, marked, values, strict=True) if v is None})
        mixed = {t: tuple({_marked(x) for x in _WORD.findall(w)}) for t, w in zip(new, low, strict=True) if not w.isalpha()}
        words = list({w for ws in mixed.values() for w in ws})
        values = dict(zip(words, self.values(words), strict=True)) if words else {}
        for t, ws in mixed.items():
            best = max([v for w in ws if (v := values[w]) is not None], default=None)
            left = tuple(w for w in ws if values[w] is None)
            known[t] = (best, left) if left else best or 0.0

    def batch(self, texts: list[str | None]) -> list[list[str]]:
        """The tokens of texts, which it learns together."""
        split = [(t or "").split() for t in texts]
        self.learn({t for s in split for t in s})
        return split

    def evidence(self, tokens: list[str]) -> tuple[int, list[float], float, float, list[tuple]]:
        """The tokens, the five highest decided expressions, the sums of all and of toxic evidence that is decided, and
        (count, value, words) of the open tokens."""
        known, different = self.known, {*tokens}
        if not known.keys() >= different:
            self.learn(different)
        left = [t for t in different if type(known[t]) is tuple]
        values = list(map(known.__getitem__, tokens))
        if left:
            times = Counter(t for t in tokens if type(known[t]) is tuple)
            left = [(times[t], *known[t]) for t in left]
            values = [v for v in values if type(v) is not tuple]
        return len(tokens), heapq.nlargest(5, values), math.fsum(values), math.fsum([x for x in values if x > EVIDENCE]), left

    def features(self, tokens: list[str]) -> tuple[float, ...]:
        """The difference a word, the second highest expression, the mean of the five highest, the toxic evidence a
        word, and log length."""
        n, top, total, evidence, _ = self.evidence(tokens)
        top = [*top, 0.0, 0.0, 0.0, 0.0, 0.0]
        return total / max(1, n), top[1], sum(top[:5]) / 5, evidence / max(1, n), math.log1p(n)


_models: dict[str, _Scorer] = {}


def _scorer(shared) -> _Scorer:
    """One scorer for each broadcast model in a worker, so that what it remembers lasts over tasks."""
    if shared.value[0] not in _models:
        _models.clear()
        _models[shared.value[0]] = _Scorer(shared.value[1])
    return _models[shared.value[0]]


def fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 0.03, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression (the constant last), by Newton's method. Both classes weigh the same."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * np.append(w[:-1], 0.0)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([penalty] * (len(w) - 1) + [1e-6])
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _with_features(rows: DataFrame, text: str, shared, nodes: DataFrame | None) -> DataFrame:
    """`rows` with their features; `nodes` is there if the head leaves words open."""
    keep = rows.columns
    fields = lambda names: ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in names)

    def run(batches):
        scorer = _scorer(shared)
        for b in batches:
            found = [scorer.features(t) for t in scorer.batch(b.column(text).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([f[i] for f in found], pa.float64()) for i in range(len(FEATURES))]], names=[*keep, *FEATURES])

    if nodes is None:
        return rows.mapInArrow(run, ", ".join([fields(keep), *[f"{f} double" for f in FEATURES]]))

    open_ = pa.list_(pa.struct([("times", pa.int64()), ("best", pa.float64()), ("words", pa.list_(pa.string()))]))

    def decide(batches):
        scorer = _scorer(shared)
        for b in batches:
            found = [scorer.evidence(t) for t in scorer.batch(b.column(1).to_pylist())]
            n, top, total, evidence, left = zip(*found, strict=True) if found else ((), (), (), (), ())
            left = [[{"times": t, "best": v, "words": w} for t, v, w in some] for some in left]
            columns = [pa.array(n, pa.int64()), pa.array(top, pa.list_(pa.float64())), pa.array(total, pa.float64()), pa.array(evidence, pa.float64()), pa.array(left, open_)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["the row", "n", "top", "total", "evidence", "left"])

    rows = written(rows.withColumn("the row", F.monotonically_increasing_id()), "toxicity-rows")
    decided = rows.select("the row", text).mapInArrow(decide, "`the row` long, n long, top array<double>, total double, evidence double, left array<struct<times: long, best: double, words: array<string>>>")
    decided = written(decided, "toxicity-decided")
    tokens = decided.select("the row", F.posexplode("left").alias("at", "t")).select("the row", "at", "t.times", "t.best", F.explode("t.words").alias("word"))
    values = _values(tokens.select("word").distinct(), nodes)
    tokens = tokens.join(values, "word").groupBy("the row", "at").agg(F.first("times").alias("times"), F.greatest(F.max("best"), F.max("value")).alias("value"))
    of_five = F.sort_array(F.flatten(F.collect_list(F.array_repeat("value", F.least("times", F.lit(5)).cast("int")))), asc=False)
    total = F.sum(F.col("value") * F.col("times")).alias("more_total")
    joined = tokens.groupBy("the row").agg(F.slice(of_five, 1, 5).alias("more"), total, F.sum(F.when(F.col("value") > EVIDENCE, F.col("value") * F.col("times")).otherwise(0.0)).alias("more_evidence"))
    both = decided.drop("left").join(joined, "the row", "left")
    top = F.slice(F.sort_array(F.concat("top", F.coalesce("more", F.array().cast("array<double>"))), asc=False), 1, 5)
    both = both.withColumn("five highest", top)
    second = F.coalesce(F.get("five highest", F.lit(1)), F.lit(0.0))
    five = F.aggregate("five highest", F.lit(0.0), lambda a, x: a + x) / 5
    difference = (F.col("total") + F.coalesce("more_total", F.lit(0.0))) / F.greatest("n", F.lit(1))
    density = (F.col("evidence") + F.coalesce("more_evidence", F.lit(0.0))) / F.greatest("n", F.lit(1))
    found = both.select("the row", *[c.alias(f) for f, c in zip(FEATURES, (difference, second, five, density, F.log1p("n")), strict=True)])
    return rows.join(found, "the row").select(*keep, *FEATURES)


def _values(words: DataFrame, nodes: DataFrame) -> DataFrame:
    """(word, value) of rows (word), marked and cut to what counts."""
    lengths = F.sequence(F.lit(1), F.char_length("word"))
    steps = words.select("word", F.explode(F.transform(lengths, lambda i: F.expr("word").substr(F.lit(1), i))).alias("beginning")).join(nodes.select("beginning", "ratio", "beyond"), "beginning")
    far = F.char_length("beginning")
    found = steps.groupBy("word").agg(F.sum("ratio").alias("ratio"), F.max(far).alias("far"), F.max_by("beyond", far).alias("beyond"))
    return found.select("word", (F.col("ratio") + F.when(F.col("far") < F.char_length("word"), F.col("beyond")).otherwise(0.0)).alias("value"))


class ToxicityModel:
    """A fitted model: `score` adds columns score and predicted."""

    def __init__(self, shared, nodes: DataFrame | None, weights: np.ndarray | None, default: float):
        self.shared, self.nodes, self.weights, self.default = shared, nodes, weights, default

    @property
    def compares(self) -> bool:
        """Whether there were labels of both classes; else all documents have one score, which says nothing of them."""
        return self.weights is not None

    def score(self, docs: DataFrame) -> DataFrame:
        """`docs` (with a column text) with score and predicted. Null texts are empty; texts without a word have the
        score of a document in which nothing speaks for either class. Other columns stay."""
        prepare(docs.sparkSession)
        names = [c for c in docs.columns if c not in ("score", "predicted")]
        if self.weights is None:
            return docs.select(*names).withColumn("score", F.lit(self.default)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
        inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
        found = _with_features(inner, f"c{names.index('text')}", self.shared, self.nodes)
        *weights, constant = (float(x) for x in self.weights)
        score = 1.0 / (1.0 + F.exp(-sum((w * F.col(f) for w, f in zip(weights, FEATURES, strict=True)), F.lit(constant))))
        found = found.withColumn("the score", score)
        return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("the score").alias("score"), (F.col("the score") >= THRESHOLD).cast("int").alias("predicted"))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learns from rows of (doc_id, text) that have a label (doc_id, toxic) and aren't held out. One label in
    CALIBRATION_SHARE of each class, at most CALIBRATION_ROWS, goes to the curve; counts cover all others. Ids with
    several labels are toxic if one says so. Without two labels of both classes there is nothing to compare, and every
    document gets the share of toxic labels."""
    spark = docs.sparkSession
    prepare(spark)
    labels = labels.where("doc_id is not null and toxic in (0, 1)").where(F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(False)))
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    labels = written(labels, "toxicity-labels")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    many = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = many.get(1, 0) / max(1, sum(many.values()))
    order = (F.xxhash64("doc_id", F.lit(1)), "doc_id")
    taken = {c: min(CALIBRATION_ROWS, max(1, many.get(c, 0) // CALIBRATION_SHARE)) for c in (0, 1)}
    chosen = labels.where("toxic = 0").orderBy(*order).limit(taken[0]).union(labels.where("toxic = 1").orderBy(*order).limit(taken[1]))
    chosen = written(chosen, "toxicity-chosen")  # bounded, so it can go to every executor
    counted = labels.join(F.broadcast(chosen), "doc_id", "left_anti")
    counted = rows.join(F.broadcast(counted) if sum(many.values()) <= BROADCAST_LABELS else counted, "doc_id")
    grams = written(_grams(_word_counts(counted)), "toxicity-grams")
    discard(labels)
    nodes = written(_nodes(grams), "toxicity-nodes")
    discard(grams)
    *head, whole = _head(nodes, WINDOWS)
    seen = None
    if len(head[0]):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, tuple(head)))
        left = None if whole else nodes
        sample = rows.join(F.broadcast(chosen), "doc_id")
        rows = _with_features(sample.select("toxic", "text"), "text", shared, left).select("toxic", *FEATURES).collect()
        seen = np.array(rows, dtype=np.float64).reshape(-1, 1 + len(FEATURES))
    discard(chosen)
    if seen is None or len(set(seen[:, 0].tolist())) < 2:
        return ToxicityModel(None, None, None, share)
    return ToxicityModel(shared, left, fit_curve(seen[:, 1:], seen[:, 0], penalty=1.0), 0.0)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text, learned from labels that aren't held out. Rows with a null id are scored like
    others and count as not held out. Rows that repeat an id are scored one by one, whatever their texts; a label
    counts for all of them. Null texts are empty; an empty table gives no row."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = fit(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
