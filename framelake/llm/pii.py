"""Personal data by a semi-Markov conditional random field.

Base spans (email, ip, card, phone) are found by their patterns. Around whatever holds a digit or an at sign the text
is cut in regions of tokens; in a region every run of up to MOST tokens and LONGEST characters that holds such a sign
is a candidate segment of each kind or of none, but for runs of several words without an at sign. Features look at the whole segment (its groups of digits, marks between
them, checks) and at the words before it, and dynamic programming over the ends of segments chooses boundaries and
kinds jointly. A region reaches AROUND blanks past the signs, within a line, and takes in later signs that are near, so
an entity can't reach out of its region but by more blanks than that.

The weights maximise the likelihood of segmentations of a bounded sample of regions of the corpus, whose base spans
are the entities, and of rewritings of them in ways that people write such data and that the base patterns miss. A part
of the sample is kept out: on it the margin is chosen that an added span needs. Decoded entities that touch no base
span are added to the base spans.
"""

from __future__ import annotations

import functools
import itertools
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import prepare, table

KINDS = ("email", "ip", "card", "phone")
#: Tokens and characters of an entity at most, blanks around a sign that a region takes in, tokens of a region at most
#: that training takes.
MOST = 13
LONGEST = 254
AROUND = 6
TRAINED = 60
#: Bounds of the sample that the weights are learned from: documents of each sort, and regions.
SAMPLE = 1_500
REGIONS = 400
#: Rewritings of each region that has an entity; one region in KEPT_OUT chooses the margin.
REWRITTEN = 3
KEPT_OUT = 5
EPOCHS = 8
#: Share of the added spans that must be right on the regions kept out.
PRECISION = 0.95
MARGINS = tuple(i / 4 for i in range(25))

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SEED = re.compile(r"[0-9@]|[\[(]at[\])]", re.IGNORECASE)
_SEEDED = r"(?i)[0-9@]|[\[(]at[\])]"
#: What every base span holds, for choosing the sample.
_LIKELY = r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|\+[0-9][ ().0-9-]{8}|[0-9](?:[ -]?[0-9]){13}"
_DIGIT = re.compile(r"[0-9]")

_DIGITS, _LETTERS = re.compile(r"[0-9]+"), re.compile(r"[^\W\d_]+")
_AT = re.compile(r"@|[\[(]at[\])]", re.IGNORECASE)
_MAILBOX = re.compile(r"[\w.%+-]+(?:\s?[._]\s?[\w%+-]+)*\s?(?:@|[\[(]at[\])])\s?[\w-]+(?:\s?(?:\.|[\[(]dot[\])])\s?[\w-]+)+", re.IGNORECASE)

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, kind by kind, leftmost and without overlap in a kind; matches that fail their check are
    dropped and not tried again. Sorted by start, then by kind as listed."""
    found: list[Span] = []
    end = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((start, m.end(), "email"))
                end = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# tokens: runs of digits, runs of letters, single marks; blanks belong to the token after them
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")


def _regions(text: str) -> list[list[tuple[int, int]]]:
    """Token spans of each region: around every seed the marks and words that an entity could take in."""
    regions: list[list[tuple[int, int]]] = []
    done = 0
    for seed in _SEED.finditer(text):
        if seed.start() < done:
            continue
        lo, hi = _reach(text, seed.start(), -1), _reach(text, seed.start(), 1)
        lo = max(lo, done)
        while True:  # take in later seeds that are near
            nxt = _SEED.search(text, hi, min(len(text), hi + 24))
            if not nxt:
                break
            hi = _reach(text, nxt.start(), 1)
        done = hi
        tokens = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
        if tokens:
            regions.append(tokens)
    return regions


def _reach(text: str, at: int, step: int) -> int:
    """The position AROUND blanks away, in the same line, and at most 80 characters beyond the sign's own run."""
    blanks, i, end = 0, at, None
    while 0 <= i < len(text) and (end is None or i != end):
        if text[i].isspace():
            if text[i] == "\n":
                break
            blanks += 1
            if end is None:
                end = i + 80 * step
            if blanks > AROUND:
                break
        i += step
    i = max(-1, min(len(text), i))
    return i + 1 if step < 0 else i


@functools.lru_cache(maxsize=50_000)
def _shape(segment: str) -> tuple[str, ...]:
    """Features of a whole segment."""
    groups = _DIGITS.findall(segment)
    digits = "".join(groups)
    n = len(digits)
    marks = _DIGITS.sub("9", _LETTERS.sub("a", segment))
    dense = "".join(marks.split())
    kind = lambda c: c if not c.isalnum() else "d" if c.isdigit() else "a"
    out = [
        f"digits={min(n, 20)}" if n else "no digits",
        "groups=" + "-".join(str(min(len(g), 6)) for g in groups[:6]),
        f"length={int(math.log2(len(segment) + 1))}",
        f"first={kind(segment[0])}",
        f"last={kind(segment[-1])}",
        "letters" if "a" in marks else "no letters",
        "set=" + "".join(sorted(set(marks)))[:12],
    ]
    if len(marks) <= 24:
        out.append("marks=" + marks)
        out.append("dense=" + dense)
    if _AT.search(segment):
        out.append("at")
        if _MAILBOX.fullmatch(segment):
            out.append("mailbox")
    if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and dense in ("9.9.9.9", "9[.]9[.]9[.]9", "9(.)9(.)9(.)9"):
        out.append("octets")
    if 14 <= n <= 19 and not {*dense} - {*"9.-/"}:
        out.append("luhn" if luhn(digits) else "not luhn")
    if 9 <= n <= 15 and not {*dense} - {*"9+().-/"}:
        out.append("dialled")
        out.append("punctuated" if len(groups) > 1 else "solid")
    return tuple(out)


_Tokens = list[tuple[int, int]]


def _segments(text: str, tokens: _Tokens) -> Iterator[tuple[int, int, tuple[str, ...]]]:
    """Candidate segments (first token, end token, features), by their ends."""
    words = [text[a:b].lower() for a, b in tokens]
    seeded = [bool(_SEED.match(text, a)) for a, _ in tokens]
    near = [0, *itertools.accumulate(seeded)]
    ats = [0, *itertools.accumulate(bool(_AT.match(text, a)) for a, _ in tokens)]
    letters = [0, *itertools.accumulate(w.isalpha() for w in words)]
    for j in range(1, len(tokens) + 1):
        end = tokens[j - 1][1]
        after = "end"
        if j < len(tokens):
            after = "blank" if end < tokens[j][0] else words[j][0] if not words[j][0].isalnum() else "word"
        for i in range(max(0, j - MOST), j):
            start = tokens[i][0]
            if near[j] == near[i] or end - start > LONGEST or (ats[j] == ats[i] and letters[j] - letters[i] > 1):
                continue
            segment = text[start:end]
            before = "blank" if i == 0 or tokens[i - 1][1] < start else words[i - 1][-1] if not words[i - 1][-1].isalnum() else "word"
            cues = [f"{d} before={words[i - d][:16]}" for d in (1, 2, 3) if i >= d and words[i - d].isalpha()]
            yield i, j, (*_shape(segment), "before=" + before, "after=" + after, "any", *cues)


@dataclass
class SemiMarkov:
    """Weights of features, one for each kind, the margin of added spans, and how they did on the regions kept out."""

    weights: dict[str, tuple[float, ...]] = field(default_factory=dict)
    margin: float = 0.0
    report: dict[str, float] = field(default_factory=dict)

    def scores(self, features: tuple[str, ...]) -> list[float]:
        known = [w for f in features if (w := self.weights.get(f)) is not None]
        return [sum(x) for x in zip(*known, strict=True)] if known else [0.0] * len(KINDS)

    def decode(self, text: str, tokens: _Tokens) -> list[tuple[int, int, str, float]]:
        """Best segmentation: entities (first token, end token, kind, score). A segment of no kind has score 0."""
        best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
        done = 0
        for i, j, features in _segments(text, tokens):
            while done < j:
                done += 1
                best[done] = best[done - 1]
            for kind, s in zip(KINDS, self.scores(features), strict=True):
                if s > 0 and best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, kind, s)
        out, j = [], done
        while j > 0:
            if back[j]:
                i, kind, s = back[j]
                out.append((i, j, kind, s))
                j = i
            else:
                j -= 1
        return out[::-1]


class _Batch:
    """Regions with their segments as arrays, whose forward and backward sums advance together."""

    def __init__(self, examples, ids: dict[str, int]):
        region, start, end, gold, flat, sizes = [], [], [], [], [], []
        for r, (text, tokens, entities) in enumerate(examples):
            for i, j, features in _segments(text, tokens):
                known = [ids[f] for f in features if f in ids]
                region.append(r)
                start.append(i)
                end.append(j)
                gold.append([float((i, j, k) in entities) for k in KINDS])
                flat.extend(known)
                sizes.append(len(known))
        self.n, self.last = len(examples), max([len(t) for _, t, _ in examples], default=0)
        self.region, self.start, self.end = (np.array(x, dtype=np.int64) for x in (region, start, end))
        self.gold = np.array(gold).reshape(len(region), len(KINDS))
        self.flat = np.array(flat, dtype=np.int64)
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        self.by_end = [np.flatnonzero(self.end == j) for j in range(self.last + 1)]
        self.by_start = [np.flatnonzero(self.start == i) for i in range(self.last + 1)]

    def _sums(self, which: list[np.ndarray], steps: range, back: int, ends: np.ndarray, score: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, self.last + 1))
        for j in steps:
            some = which[j]
            r = self.region[some]
            parts = out[r, ends[some]][:, None] + score[some]
            top = out[:, j + back].copy()
            np.maximum.at(top, r, parts.max(axis=1, initial=-np.inf))
            total = np.exp(out[:, j + back] - top)
            np.add.at(total, r, np.exp(parts - top[r][:, None]).sum(axis=1))
            out[:, j] = top + np.log(total)
        return out

    def gradient(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Log-likelihood of the gold entities and its gradient by (feature, kind)."""
        score = np.stack([np.bincount(self.of, weights=w[self.flat, k], minlength=len(self.region)) for k in range(len(KINDS))], axis=1)
        forward = self._sums(self.by_end, range(1, self.last + 1), -1, self.start, score)
        backward = self._sums(self.by_start, range(self.last - 1, -1, -1), 1, self.end, score)
        total = forward[:, self.last]
        r = self.region
        p = np.exp((forward[r, self.start] + backward[r, self.end] - total[r])[:, None] + score)
        left = self.gold - p
        grad = np.stack([np.bincount(self.flat, weights=left[self.of, k], minlength=len(w)) for k in range(len(KINDS))], axis=1)
        return float((self.gold * score).sum() - total.sum()), grad


def train(examples, epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-3, batch: int = 64) -> SemiMarkov:
    """Gradient ascent with step sizes adapted to each weight, and the margin by the examples kept out. An example is
    (text, tokens, entities), entities being (first token, end token, kind)."""
    order = list(range(len(examples)))
    random.Random(7).shuffle(order)
    kept_out = [examples[k] for k in order if k % KEPT_OUT == 0]
    used = [examples[k] for k in order if k % KEPT_OUT]
    ids: dict[str, int] = {}
    for text, tokens, _ in used:
        for _, _, features in _segments(text, tokens):
            for f in features:
                ids.setdefault(f, len(ids))
    batches = [_Batch(used[lo : lo + batch], ids) for lo in range(0, len(used), batch)]
    w = np.zeros((len(ids), len(KINDS)))
    squares = np.zeros_like(w)
    for _ in range(epochs):
        for b in batches:
            grad = b.gradient(w)[1] - decay * w
            squares += grad * grad
            w += rate * grad / (np.sqrt(squares) + 1e-3)
    model = SemiMarkov({f: tuple(w[i].round(5).tolist()) for f, i in ids.items() if np.abs(w[i]).max() > 1e-3})
    model.margin, model.report = _margin(model, kept_out)
    return model


def _margin(model: SemiMarkov, examples) -> tuple[float, dict[str, float]]:
    """The least margin with which PRECISION of the entities that no base pattern finds are right, and how many of
    those there are it finds."""
    found, wanted = [], 0
    for text, tokens, entities in examples:
        base = base_spans(text)
        apart = lambda i, j: not any(x < tokens[j - 1][1] and tokens[i][0] < y for x, y, _ in base)  # noqa: B023, E731
        wanted += sum(apart(i, j) for i, j, _ in entities)
        found += [(s, (i, j, k) in entities) for i, j, k, s in model.decode(text, tokens) if apart(i, j)]
    for margin in MARGINS:
        kept = [right for s, right in found if s >= margin]
        precision = sum(kept) / max(1, len(kept))
        if precision >= PRECISION or margin == MARGINS[-1]:
            return margin, {"recall": sum(kept) / max(1, wanted), "precision": precision, "entities": float(wanted)}
    raise AssertionError


def _rewritten(value: str, kind: str, rng: random.Random) -> str:
    """A datum of the same kind with other digits, as people also write it and base patterns mostly don't see it."""
    digits = re.sub(r"\D", "", value)
    if kind == "phone":
        local = "".join(rng.choices("23456789", k=1) + rng.choices("0123456789", k=9))
        a, b, c = local[:3], local[3:6], local[6:]
        country = digits[:-10] or "1"
        return rng.choice([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{country} {a} {b} {c}", f"{country}-{a}-{b}-{c}", f"({a}){b}-{c}"])
    if kind == "card":
        digits = "".join(rng.choices("3456", k=1) + rng.choices("0123456789", k=14))
        digits += next(d for d in "0123456789" if luhn(digits + d))
        return rng.choice([".", " - ", "/", "  "]).join(digits[i : i + 4] for i in range(0, 16, 4))
    if kind == "email":
        at = rng.choice([" @ ", "@ ", " @", " [at] ", "(at)", " (at) "])
        name, _, domain = value.rpartition("@")
        dot = rng.choice([".", " . ", " [dot] "]) if at not in ("@ ", " @") else " . "
        return name + at + domain.replace(".", dot)
    octets = [str(rng.randrange(256)) for _ in range(4)]
    return rng.choice([". ", " .", " . ", "[.]", "(.)"]).join(octets)


def _examples(texts: list[str], seed: int = 11) -> list[tuple[str, _Tokens, set]]:
    """Training regions with gold entities: as they are, and rewritten."""
    rng = random.Random(seed)
    out = []
    plain = 0
    for text in texts:
        spans = base_spans(text)
        for tokens in _regions(text):
            if len(tokens) > TRAINED:
                continue
            lo, hi = tokens[0][0], tokens[-1][1]
            inside = [s for s in spans if s[0] >= lo and s[1] <= hi]
            if any(a[1] > b[0] for a, b in zip(inside, inside[1:], strict=False)):
                continue
            if not inside:
                plain += 1
                if plain > REGIONS // 2:
                    continue
            for change in range(1 + REWRITTEN if inside else 1):
                parts, gold, at = [], [], lo
                for start, end, kind in inside:
                    parts.append(text[at:start])
                    begin = sum(map(len, parts))
                    parts.append(_rewritten(text[start:end], kind, rng) if change else text[start:end])
                    gold.append((begin, begin + len(parts[-1]), kind))
                    at = end
                piece = "".join([*parts, text[at:hi]])
                cut = [m.span() for m in _TOKEN.finditer(piece)]
                firsts, ends = {a: i for i, (a, _) in enumerate(cut)}, {b: i + 1 for i, (_, b) in enumerate(cut)}
                if all(a in firsts and b in ends and ends[b] - firsts[a] <= MOST for a, b, _ in gold):
                    out.append((piece, cut, {(firsts[a], ends[b], k) for a, b, k in gold}))
            if len(out) >= REGIONS * 2:
                return out
    return out


def learn(docs: DataFrame) -> SemiMarkov:
    """A model from the regions of at most SAMPLE documents that hold what base spans hold and SAMPLE others that hold
    a digit or an at sign, taken by a hash of the id. Only the characters around the signs leave the executors. With
    nothing to learn from there are no weights, and no spans beyond the base ones."""
    # the hash stands for the text, which would else go along to the one task that takes the sample
    marked = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").rlike(_LIKELY).alias("likely"), F.col("text").rlike(_SEEDED).alias("seeded"))
    order = (F.xxhash64("doc_id", F.lit(3)), "doc_id", "h")
    chosen = marked.where("likely").orderBy(*order).limit(SAMPLE).union(marked.where("seeded and not likely").orderBy(*order).limit(SAMPLE))
    around = lambda what: F.slice(F.regexp_extract_all("text", F.lit(rf"([^\n]{{0,120}}(?:{what})[^\n]{{0,120}})")), 1, 4)
    rows = docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "h"])
    rows = rows.select("doc_id", "h", F.when(F.col("likely"), around(_LIKELY)).otherwise(around("[0-9@]")).alias("parts")).distinct().collect()
    texts = [p for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["h"])) for p in r["parts"]]
    examples = _examples(texts)
    return train(examples) if any(gold for _, _, gold in examples) else SemiMarkov()


def spans(text: str, model: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    if not _SEED.search(text):
        return [], []
    base = base_spans(text)
    added = []
    if model.weights:
        taken = sorted((a, b) for a, b, _ in base)
        for tokens in _regions(text):
            lo, hi = tokens[0][0], tokens[-1][1]
            near = None
            for i, j, kind, s in model.decode(text, tokens):
                if s < model.margin:
                    continue
                if near is None:
                    near = [(x, y) for x, y in taken if x < hi and y > lo]
                a, b = tokens[i][0], tokens[j - 1][1]
                if not any(x < b and a < y for x, y in near):
                    added.append((a, b, kind))
    return base, sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(found: list[Span]) -> str:
    return ",".join([f"{k}:{a}:{b}" for a, b, k in found])


def with_spans(docs: DataFrame, model: SemiMarkov, mask: bool = False) -> DataFrame:
    """`docs` with columns base and spans ("kind:start:end,..." in code points), or with all spans in column text
    replaced by "[KIND]". Null texts have no span and stay null; other columns stay."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    new = [] if mask else ["base", "spans"]
    names = [c for c in docs.columns if c not in new]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches):
        model = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [spans(t or "", model) for t in texts]
            if mask:
                texts = [_masked(t, s) if s else t for t, (_, s) in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in names], names=names)
            else:
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array([_joined(x) for x, _ in found]), pa.array([_joined(x) for _, x in found])], names=[*names, *new])

    return docs.select(*names).mapInArrow(run, ", ".join([f"`{n}` {kinds[n]}" for n in names] + [f"{n} string" for n in new]))


def _masked(text: str, found: list[Span]) -> str:
    """Overlapping spans are replaced together, under the first one's kind."""
    out, at, until = [], 0, 0
    for a, b, kind in found:
        if a >= until:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = until = max(until, b)
    return "".join([*out, text[at:]])


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every whole text. base_sha256 digests the base spans; spans holds all of them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = with_spans(docs, learn(docs)).drop("text")
    base = F.split("base", ",")
    count = lambda kind: F.size(F.filter(base, lambda x: x.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")
