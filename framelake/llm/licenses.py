"""Short license notices in texts, also where they are misspelt: exact seeds, then bounded-error matching.

A text becomes its words, A-Z lower-cased, joined by blanks; a notice is a few such words with a label and a number of
edits that it may differ by. A notice is split in as many pieces as it may have edits, and one more, so an occurrence
holds one piece at least as it is (the pigeonhole principle). All pieces of all notices are looked for in one pass of an
Aho-Corasick automaton; a piece tells where its notice would begin and end. Windows that meet are joined, and there the
regex library matches the notice with at most its edits, from word to word, and reports where.

Places without an edit are all places; others of one notice don't overlap and are taken from the left.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import prepare, table

#: Characters of a notice for each edit that it may have.
PER_EDIT = 10
#: The notices of the query's contract, which count only as they are for base places.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: More of them, by the wording of well-known licenses.
MORE = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license", "apache-2"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license version 2", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("free and unencumbered software released into the public domain", "unlicense"),
    ("do what the fuck you want to public license", "wtfpl"),
)
#: What is no letter or digit of ASCII, and not beyond ASCII, parts words.
_TO_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Notice(NamedTuple):
    words: str
    label: str
    edits: int
    base: bool


class Place(NamedTuple):
    label: str
    notice: str
    start: int  # in the joined words
    end: int
    edits: int


def notices(base=BASE, more=MORE, per_edit: int = PER_EDIT) -> list[Notice]:
    return [Notice(w, label, len(w) // per_edit if len(w) >= 2 * per_edit else 0, own) for own, some in ((True, base), (False, more)) for w, label in some]


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """A notice in edits + 1 pieces of about one length, each with its place."""
    n, k = len(notice.words), notice.edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, notice.words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def joined_words(text: bytes | None) -> tuple[str, int]:
    """The words of a UTF-8 text joined by blanks, and their number."""
    words = text.translate(_TO_WORDS).split() if text else []
    return b" ".join(words).decode("utf-8", "replace"), len(words)


class Scanner:
    """Finds notices in texts; compiled once for each worker."""

    def __init__(self, known: list[Notice]):
        import ahocorasick
        import regex

        self.known = known
        self._patterns = [regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(x.words, literal_spaces=True)}){{e<={x.edits}}}(?![^ ])") for x in known]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(known):
            for offset, piece in pieces(notice):
                seeds.setdefault(piece, []).append((i, offset))
        self._seeds = ahocorasick.Automaton()
        for piece, of in seeds.items():
            self._seeds.add_word(piece, (len(piece), of))
        self._seeds.make_automaton()

    def windows(self, line: str) -> dict[int, list[list[int]]]:
        """For each notice the stretches of whole words in which it may stand, joined where they meet, in order."""
        found: dict[int, list[list[int]]] = {}
        for last, (size, of) in self._seeds.iter(line):
            for i, offset in of:
                notice = self.known[i]
                start = max(0, last + 1 - size - offset - notice.edits)
                end = line.find(" ", last + 1 - size - offset + len(notice.words) + notice.edits)
                found.setdefault(i, []).append([line.rfind(" ", 0, start) + 1, end if end >= 0 else len(line)])
        for i, spans in found.items():
            spans.sort()
            merged = spans[:1]
            for s in spans[1:]:
                if s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(s)
            found[i] = merged
        return found

    def _exact(self, line: str, notice: Notice, start: int, end: int) -> Iterator[int]:
        """All places of a window at which a notice stands as it is, from word to word."""
        at = line.find(notice.words, start, end)
        while at >= 0:
            stop = at + len(notice.words)
            if (at == 0 or line[at - 1] == " ") and (stop == len(line) or line[stop] == " "):
                yield at
            at = line.find(notice.words, at + 1, end)

    def places(self, line: str) -> list[Place]:
        """All places of notices in joined words, in order."""
        found = []
        for i, windows in self.windows(line).items():
            notice, pattern = self.known[i], self._patterns[i]
            for start, end in windows:
                exact = list(self._exact(line, notice, start, end))
                found += [Place(notice.label, notice.words, at, at + len(notice.words), 0) for at in exact]
                if not notice.edits:
                    continue
                # the words between exact places
                for lo, hi in zip([start, *[at + len(notice.words) + 1 for at in exact]], [*[at - 1 for at in exact], end], strict=True):
                    if hi - lo >= len(notice.words) - notice.edits:
                        found += [Place(notice.label, notice.words, *m.span(), sum(m.fuzzy_counts)) for m in pattern.finditer(line, lo, hi)]
        return sorted(found, key=lambda p: (p.start, p.end, p.label, p.notice))


@functools.lru_cache(maxsize=4)
def scanner(known: tuple[Notice, ...]) -> Scanner:
    return Scanner(list(known))


def likeness(places: list[Place]) -> float:
    """1 for a notice as it is, less for each share of its characters that is edited; 0 without any."""
    return max((1 - p.edits / len(p.notice) for p in places), default=0.0)


_SPANS = "array<struct<label:string,notice:string,start:bigint,end:bigint,first_word:bigint,last_word:bigint,edits:int>>"


def license_spans(docs: DataFrame, text: str = "text", known: list[Notice] | None = None) -> DataFrame:
    """`docs` with column licenses: where notices stand in each whole text, by code points (end exclusive) and by words,
    with the edits between the notice and what stands there.

    Null texts are empty and have none. Rows stay one for one, whatever their other columns hold.
    """
    prepare(docs.sparkSession)
    known = tuple(notices() if known is None else known)
    names = [c for c in docs.columns if c != "licenses"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names]
    kind = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), *[(n, pa.int64()) for n in ("start", "end", "first_word", "last_word")], ("edits", pa.int32())]))

    def run(batches):
        find = scanner(known)
        for b in batches:
            out = []
            for t in b.column(text).to_pylist():
                line, _ = joined_words((t or "").encode("utf-8", "surrogatepass"))
                places = find.places(line)
                words = [m.span() for m in _WORD.finditer(t.translate(_LOWER))] if places else []
                blanks = [i for i, c in enumerate(line) if c == " "] if places else []
                rows = []
                for p in places:
                    first, last = bisect_right(blanks, p.start), bisect_right(blanks, p.end - 1)
                    rows.append({"label": p.label, "notice": p.notice, "start": words[first][0], "end": words[last][1], "first_word": first, "last_word": last, "edits": p.edits})
                out.append(rows)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(out, kind)], names=[*names, "licenses"])

    return docs.select(*names).mapInArrow(run, ", ".join([*fields, f"licenses {_SPANS}"]))


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def op13_licenses(spark, sf_dir: str) -> DataFrame:
    """License notices of every whole text: base places of the contract's phrases, and labels that the method adds where
    a notice stands with edits or one of more notices stands.

    Null texts have no words, no labels and score 0. Rows with a null id and rows that repeat an id stay. An empty table
    gives no row. The score is 1 for a notice as it is and falls with the share of edited characters.
    """
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    known = tuple(notices())
    base = {n.words for n in known if n.base}
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [*[pa.int64()] * 4, *[pa.string()] * 2, pa.float64()]

    def run(batches):
        find = scanner(known)
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                line, n = joined_words(t)
                places = find.places(line)
                own = [p for p in places if p.notice in base and not p.edits]
                first, last = (line.count(" ", 0, own[0].start), line.count(" ", 0, own[-1].start)) if own else (None, None)
                labels = [",".join(sorted({p.label for p in x})) for x in (own, places)]
                rows.append((n, len(own), first, last, *labels, likeness(places)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, types, strict=True)]], names=names)

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
