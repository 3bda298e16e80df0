"""Document quality by co-training.

Two logistic classifiers look at a document from two sides: its text (hashed words, hashed shapes of three characters,
shares of letters and repeats) and its page metadata (source, language, declared length). Both start from labelled
documents. In each round each of them goes over all documents without a label and labels those that it is surest of,
and these join the training rows of the other. At last each view is calibrated on labelled documents that no round has
trained on, and the calibrated views are combined.

There are two such pairs of classifiers, each learned from one half of the documents, by their ids; a document is scored
by the pair of the other half, so no score comes from the document's own label.

Texts are read once: their features, a few hundred bytes a document, are a table that rounds and scores read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import discard, fold, prepare, table, written
from framelake.llm.toxicity import BROADCAST_LABELS, fit_curve

#: Labelled documents that are trained on, at most.
LABELLED = 20_000
ROUNDS = 3
#: Documents that a view labels in a round, for each class; only if it is at least this sure.
GIVEN = 500
SURE = 0.95
#: One labelled document in so many calibrates.
FOLDS = 5
HALVES = 2
WORDS, SHAPES, SOURCES, TONGUES, LENGTHS = 128, 128, 32, 8, 16

# classes of bytes: small and capital letters, digits, blanks, line ends, beyond ASCII; other marks are their own
_CLASS = np.arange(256, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[9], _CLASS[128:] = 97, 65, 48, 32, 128
_SHAPE = (np.arange(129**3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(57)).astype(np.int64) % SHAPES


def _byte(share: float) -> int:
    """A share from 0 to 1 in a byte, small ones spread out."""
    return int(255 * min(1.0, max(0.0, share)) ** 0.5)


def text_features(text: str) -> bytes:
    """What the text itself shows; all zero for an empty one."""
    words = text.lower().split()
    if not words:
        return bytes(WORDS + SHAPES + 8)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    classes = _CLASS[data]
    counts = Counter(words)
    n, m = len(data), len(words)
    hashed = np.zeros(WORDS)
    for w, c in counts.items():
        hashed[zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS] += c
    shapes = np.bincount(_SHAPE[(classes[:-2] * 129 + classes[1:-1]) * 129 + classes[2:]], minlength=SHAPES) if n > 2 else np.zeros(SHAPES)
    of = np.bincount(classes, minlength=129)
    surface = [np.log1p(m) / 16, of[65] / n, of[48] / n, of[128] / n, n / m / 64, len(counts) / m, counts.most_common(1)[0][1] / m, 1 - (of[65] + of[97] + of[128]) / n]
    spread = lambda x, total: (255 * np.minimum(1.0, x / max(1, total)) ** 0.5).astype(np.uint8).tobytes()
    return spread(hashed, m) + spread(shapes, n) + bytes(map(_byte, surface))


def metadata_features(lang: str | None, source: str | None, declared: int | None) -> bytes:
    """What the page says of itself: origin, language, declared length."""
    out = bytearray(SOURCES + TONGUES + LENGTHS + 3)
    if source is not None:
        out[zlib.crc32(source.encode()) % SOURCES] = 255
    if lang is not None:
        out[SOURCES + zlib.crc32(lang.encode()) % TONGUES] = 255
    if declared is not None:
        out[SOURCES + TONGUES + min(LENGTHS - 1, max(0, declared).bit_length())] = 255
    for i, missing in enumerate((source is None, lang is None, declared is None)):
        out[SOURCES + TONGUES + LENGTHS + i] = 255 * missing
    return bytes(out)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, half, text_view, page_view of rows (doc_id, text, lang, source, n_chars). Null texts are empty, null
    metadata counts as such."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    rows = rows.withColumn("half", fold(F.col("doc_id"), HALVES).cast("int"))

    def run(batches):
        for b in batches:
            texts = [text_features(t or "") for t in b.column("text").to_pylist()]
            pages = [metadata_features(*x) for x in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("half"), pa.array(texts, pa.binary()), pa.array(pages, pa.binary())], names=["doc_id", "half", "text_view", "page_view"])

    return rows.mapInArrow(run, "doc_id bigint, half int, text_view binary, page_view binary")


VIEWS = ("text_view", "page_view")


def _matrix(column) -> np.ndarray:
    values = list(column)
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(len(values), -1).astype(np.float64) / 255 if values else np.zeros((0, 1))


class View:
    """A logistic classifier on standardised features, with a calibration of its own."""

    def __init__(self) -> None:
        self.mean = self.scale = self.weights = None
        self.curve = np.array([1.0, 0.0])

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-2
        self.weights = fit_curve((x - self.mean) / self.scale, y, penalty=10.0)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.curve = _plain_curve(self.logit(x), y)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.curve[0] * self.logit(x) + self.curve[1]


def _plain_curve(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and constant of a logistic curve over one feature, classes weighed as they come."""
    x, w = np.column_stack([z, np.ones(len(z))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.1 * (w - [1.0, 0.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def area(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the curve: the chance that a good document scores above a bad one."""
    good, bad = np.sort(score[y == 1]), score[y == 0]
    if not len(good) or not len(bad):
        return float("nan")
    return float((len(good) - (np.searchsorted(good, bad) + np.searchsorted(good, bad, "right")) / 2).mean() / len(good))


class _Pair:
    """The two views learned from one half, and the training rows that each was given."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray):
        self.models, self.views, self.y = (View(), View()), views, y
        self.given: list[list[tuple[int, bytes, int]]] = [[], []]  # document, features, label: what the other view gave

    def fit(self) -> None:
        for i, model in enumerate(self.models):
            more = self.given[i]
            x = np.concatenate([self.views[i], _matrix([f for _, f, _ in more])]) if more else self.views[i]
            model.fit(x, np.concatenate([self.y, np.array([label for *_, label in more], dtype=self.y.dtype)]))


def _surest(unlabelled: DataFrame, pairs: list[_Pair]) -> list:
    """Rows (pair, view, label, doc_id, features of the other view): over all rows, the GIVEN that each view is surest
    of for each class and that it hasn't given before."""
    models = [p.models for p in pairs]
    before = [[{d for d, _, _ in p.given[1 - i]} for i in (0, 1)] for p in pairs]
    shared = unlabelled.sparkSession.sparkContext.broadcast((models, before))

    def run(batches):
        models, before = shared.value
        for pdf in batches:
            for pair, two in enumerate(models):
                for view, model in enumerate(two):
                    p = model.chance(_matrix(pdf[VIEWS[view]]))
                    for label, sure in ((1, p), (0, 1 - p)):
                        some = pdf[(sure >= SURE) & ~pdf["doc_id"].isin(before[pair][view])]
                        some = some.assign(pair=pair, view=view, label=label, sure=sure[some.index])
                        some = some.nlargest(GIVEN, "sure", keep="all").sort_values(["sure", "doc_id"], ascending=[False, True]).head(GIVEN)
                        yield some.assign(features=some[VIEWS[1 - view]])[["pair", "view", "label", "sure", "doc_id", "features"]]

    rows = unlabelled.mapInPandas(run, "pair int, view int, label int, sure double, doc_id bigint, features binary")
    order = Window.partitionBy("pair", "view", "label").orderBy(F.desc("sure"), "doc_id", "features")
    found = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= GIVEN).orderBy("pair", "view", "label", "rank").collect()
    shared.destroy()
    return found


class QualityModel:
    """Pairs of views by the half of documents that they score; `report` has areas under the curve on the rows that
    calibrate, after the first and the last round."""

    def __init__(self, pairs: list | None, default: float, report: dict[str, float] | None = None):
        self.pairs, self.default, self.report = pairs, default, report or {}

    def score(self, featured: DataFrame) -> DataFrame:
        """doc_id, text_score, page_score, score of rows of `features`: probabilities that a document is good. Without
        labels of both classes in both halves every score is the share of good labels."""
        if self.pairs is None:
            share = F.lit(self.default)
            return featured.select("doc_id", share.alias("text_score"), share.alias("page_score"), share.alias("score"))
        shared = featured.sparkSession.sparkContext.broadcast(self.pairs)

        def run(batches):
            p = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
            for pdf in batches:
                for half, ((text, page), w) in enumerate(shared.value):
                    some = pdf[pdf["half"].fillna(0) == half]
                    if len(some):
                        x, z = text.calibrated(_matrix(some["text_view"])), page.calibrated(_matrix(some["page_view"]))
                        yield some[["doc_id"]].assign(text_score=p(x), page_score=p(z), score=p(w[0] * x + w[1] * z + w[2]))

        return featured.mapInPandas(run, "doc_id bigint, text_score double, page_score double, score double")


def fit(featured: DataFrame, labels: DataFrame) -> QualityModel:
    """Co-trains on rows of `features` with labels (doc_id, quality). An id with several labels is good if one says so;
    rows that repeat an id have its label each. Ties among the surest rows go to the smaller id."""
    prepare(featured.sparkSession)
    labels = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    known = labels.orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(LABELLED)  # bounded, so it can go to every executor
    labelled = featured.join(F.broadcast(known), "doc_id").withColumn("fold", fold(F.xxhash64("doc_id"), FOLDS).cast("int")).orderBy("doc_id", "text_view", "page_view").toPandas()
    y, half, calibrates = labelled["quality"].to_numpy(), labelled["half"].to_numpy(), labelled["fold"].to_numpy() == 0
    views = [_matrix(labelled[v]) for v in VIEWS]
    if any(len(set(y[(half == h) & c].tolist())) < 2 for h in range(HALVES) for c in (calibrates, ~calibrates)):
        return QualityModel(None, float(y.mean()) if len(y) else 0.0)
    rows = [(half != h) & ~calibrates for h in range(HALVES)]  # a pair learns from the other half
    pairs = [_Pair([v[r] for v in views], y[r]) for r in rows]
    few = labels.count() <= BROADCAST_LABELS
    unlabelled = featured.where("doc_id is not null").join(F.broadcast(labels) if few else labels, "doc_id", "left_anti")
    tests = [(half != h) & calibrates for h in range(HALVES)]
    report: dict[str, float] = {}

    def measure(when: str) -> None:
        for i, name in enumerate(("text", "page")):
            report[f"{name} {when}"] = float(np.mean([area(p.models[i].logit(views[i][t]), y[t]) for p, t in zip(pairs, tests, strict=True)]))

    for round_ in range(ROUNDS + 1):
        for p in pairs:
            p.fit()
        if round_ == 0:
            measure("at first")
        if round_ == ROUNDS:
            break
        found = _surest(unlabelled, pairs)
        if not found:
            break
        for r in found:
            pairs[r["pair"]].given[1 - r["view"]].append((r["doc_id"], bytes(r["features"]), r["label"]))
    measure("at last")
    out = []
    for p, t in zip(pairs, tests, strict=True):
        for model, x in zip(p.models, views, strict=True):
            model.calibrate(x[t], y[t])
        both = np.column_stack([m.calibrated(x[t]) for m, x in zip(p.models, views, strict=True)])
        out.append((p.models, fit_curve(both, y[t], penalty=0.1)))
    return QualityModel(out, 0.0, report)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; predicted is 1 where the score is at least 0.5. A labelled document's score comes
    from models that haven't seen its label. Rows stay one for one, whatever their ids; an empty table gives no row."""
    featured = written(features(table(spark, sf_dir, "documents")), "quality-features")
    scored = fit(featured, table(spark, sf_dir, "labels")).score(featured)
    out = written(scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), "quality-scores")
    discard(featured)
    return out
