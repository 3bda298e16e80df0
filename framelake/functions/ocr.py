"""Corrections of subtitle text that was read from pictures.

A word is looked up among a list of known words by rank. Known words at one edit come from an index of deletions: each
word, and each known word, stands under itself and under itself without each one of its letters, and an equality join
of the two finds all pairs at one edit, and which edit it is. A word keeps the few candidates that evidence can decide
between. What it becomes depends on the words beside it as well: known pairs that speak for a candidate are joined to its
place from either side, and the candidates of a place are weighed in its row. Only lines in which something changes are
put together anew. Of the lists of words only the most common ones, whose number is checked, go to all executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.session import discard, written

# The letters that a digit is mistaken for, likeliest first; letters of edits, in order; how alike pairs of
# letters look (in either order; r and n, o and q are 2, which the source sets last); what evidence counts.
DIGITS = {"0": "o", "1": "li", "5": "s", "8": "sb", "6": "g"}
ALPHABET = "abcdefghijklmnopqrstuvwxyz'"
ALIKE = {
    3: "ao ad bd ce co eo il nm pq uv vw",
    2: "ae bh bp cg fr ft gq hn ij lt nr qo rt yj yg uw",
}
SHAPE, LONGER, PAIR, COMMON_PAIR, COMMON = 100, 200, 1000, 300, 500
LEAST_GAIN = 500
RAREST = 100_000
MOST_VARIANTS = 256
#: Words of a rank below COMMON that are sent to all executors; more of them are joined as any table is.
FEW_COMMON = 10_000

_LINE = "number of the line"

_WORD = r"([\p{L}\p{Nd}']+)"
_BLANK = r"\t\n\f\r "
#: Letters whose capital is one letter only by itself: where it isn't, others would be written for it (SS for the sharp s).
_CAPITALS = {"\u00df": "\u1e9e"} | {c: c.title() for c in map(chr, range(0x1F80, 0x2000)) if len(c.upper()) > 1 and len(c.title()) == 1}


def _lower(text: Column) -> Column:
    """Small letters, one for each letter and whatever stands beside it."""
    return F.lower(F.translate(text, "\u0130\u03a3", "i\u03c3"))


def _upper(word: Column) -> Column:
    """Capitals, one for each letter."""

    def one(c):
        c = F.translate(c, "".join(_CAPITALS), "".join(_CAPITALS.values()))
        return F.when(F.char_length(F.upper(c)) == 1, F.upper(c)).otherwise(c)

    return F.array_join(F.transform(F.split(word, ""), one), "")


def substituted(text: Column) -> Column:
    """Bars and brackets that stand alone between blanks, dashes and marks for a capital I, and equals signs that open
    a line for a dash."""
    out = F.regexp_replace(text, rf"(?<=^|[{_BLANK}]|-)[|\[\]](?=\z|[{_BLANK}]|[,.?!'])", "I")
    return F.regexp_replace(out, r"(?<=^|\n|\r)=", "-")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(1))


def _between(text: Column) -> Column:
    """What stands before, between and after the words: one more than there are words."""
    return F.split(text, _WORD)


def word_ranks(lines: DataFrame, column: str, least: int = 1) -> DataFrame:
    """(word, rank) of the words without digits that the lines hold `least` times or more, in small letters: how many
    words are more frequent. Ranks come from how often each frequency occurs, so no task sorts all words."""
    counts = lines.select(F.explode(_words(_lower(F.col(column)))).alias("word")).where(~F.col("word").rlike(r"\p{Nd}")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    often = counts.groupBy("n").agg(F.count("*").alias("words"))  # a row for each frequency that occurs: few
    above = F.sum("words").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    return counts.join(often.select("n", F.coalesce(above, F.lit(0)).cast("int").alias("rank")), "n").select("word", "rank")


def word_pairs(lines: DataFrame, column: str, least: int = 2) -> DataFrame:
    """(a, b): words that follow each other in the lines `least` times or more, in small letters."""
    w = F.col("w")
    pairs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, i: F.struct(a.alias("a"), F.get(w, i + 1).alias("b")))
    return lines.select(_words(_lower(F.col(column))).alias("w")).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("a", "b")


def _without(word: Column, at: Column) -> Column:
    """The word without the letter at a place; the word itself at -1."""
    shorter = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
    return F.when(at < 0, word).otherwise(shorter)


def _deletions(words: DataFrame, word: str) -> DataFrame:
    """The words under hashes of themselves (at -1) and of themselves without the letter at each place."""
    places = F.sequence(F.lit(-1), F.char_length(word) - 1)
    return words.where(F.char_length(word) > 0).withColumn("at", F.explode(places)).withColumn("key", F.xxhash64(_without(F.col(word), F.col("at"))))


def neighbours(words: DataFrame, ranks: DataFrame) -> DataFrame:
    """(word, candidate, rank, place, shape): known words at one edit of `words` (word), in which a letter that comes in
    is one of ALPHABET, once for each edit. place orders a word's edits: by position, then deletion, transposition, letter,
    substitution before insertion. shape is how alike the letters look that were taken for each other; 1 for letters that
    changed places."""
    a = _deletions(words.select("word"), "word")
    b = _deletions(ranks.select(F.col("word").alias("candidate"), "rank"), "candidate").withColumnRenamed("at", "to")
    at, to = F.col("at"), F.col("to")
    both = a.join(b, "key").where((F.col("word") != F.col("candidate")) & (_without(F.col("word"), at) == _without(F.col("candidate"), to)))
    old, new = F.substring("word", at + 1, F.lit(1)), F.substring("candidate", to + 1, F.lit(1))
    letter = F.instr(F.lit(ALPHABET), new) - 1  # also found by strings that aren't a letter
    known = (letter >= 0) & (F.char_length(new) == 1)
    gone = (at >= 0) & (to < 0)
    added = (at < 0) & (to >= 0) & known
    other = (at >= 0) & (at == to) & known
    turned = (at >= 0) & (to == at + 1) & (old == new)
    order = lambda at, kind, which, last: ((at.cast("long") * 3 + kind) * len(ALPHABET) + which) * 2 + last
    place = F.when(gone, order(at, 0, 0, 0)).when(turned, order(at, 1, 0, 0)).when(other, order(at, 2, letter, 0)).when(added, order(to, 2, letter, 1))
    looks = F.create_map(*[F.lit(x) for shape, pairs in ALIKE.items() for p in pairs.split() for q in (p, p[::-1]) for x in (q, shape)])
    shape = F.when(other, F.coalesce(F.try_element_at(looks, F.concat(old, new)), F.lit(0))).when(turned, F.lit(1)).otherwise(F.lit(0))
    return both.select("word", "candidate", "rank", place.alias("place"), shape.alias("shape")).where("place is not null")


def candidates(words: DataFrame, ranks: DataFrame) -> DataFrame:
    """(word, own_rank, candidates) of words (word) that may become one of their neighbours, each neighbour under its first
    edit. Ones that the words beside can't help past another neighbour, or past the word itself, are left out: what
    evidence counts is bounded, and the bound is the most that it can be. A word without a rank counts as RAREST."""
    near = neighbours(words, ranks).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("candidate", "place", "shape", "rank"))).alias("n"))
    near = near.join(ranks.select("word", F.col("rank").alias("own_rank")), "word", "left")

    def valued(n):
        grows = F.signum(F.char_length(n["candidate"]) - F.char_length("word")).cast("int")
        worth = -F.least(n["rank"], F.lit(RAREST)) + SHAPE * n["shape"] + LONGER * grows
        most = worth + 2 * PAIR + F.when(n["rank"] < COMMON, 2 * COMMON_PAIR).otherwise(0)
        return F.struct(n["candidate"].alias("candidate"), n["rank"].alias("rank"), n["place"].alias("place"), grows.alias("grows"), worth.cast("int").alias("worth"), most.cast("int").alias("most"))

    first = F.filter("n", lambda n, i: (i == 0) | (n["candidate"] != F.get("n", i - 1)["candidate"]))
    near = near.select("word", "own_rank", F.transform(first, valued).alias("n"))
    near = near.withColumn("n", F.filter("n", lambda n: n["most"] + F.least("own_rank", F.lit(RAREST)) >= LEAST_GAIN))
    near = near.withColumn("least", F.array_max(F.transform("n", lambda n: n["worth"])))
    return near.select("word", "own_rank", F.filter("n", lambda n: n["most"] >= F.col("least")).alias("candidates")).where(F.size("candidates") > 0)


def readings(words: DataFrame, ranks: DataFrame) -> DataFrame:
    """(word, best) of words with digits: the first known word that they are with their digits read as letters, unless
    there are more than 256 ways to read them."""
    w = F.col("word")
    ways = F.pow(F.lit(2.0), F.char_length(F.regexp_replace(w, "[^18]", "")))
    options = F.create_map(*[x for d, letters in DIGITS.items() for x in (F.lit(d), F.array(*[F.lit(c) for c in letters]))])
    step = lambda found, c: F.flatten(F.transform(found, lambda head: F.transform(F.coalesce(F.try_element_at(options, c), F.array(c)), lambda tail: F.concat(head, tail))))
    letters = F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: F.substring(w, i, F.lit(1)))
    variants = F.aggregate(letters, F.array(F.lit("")), step)
    read = words.where(w.rlike(r"\p{Nd}")).where(ways <= MOST_VARIANTS).select("word", F.posexplode(variants).alias("place", "candidate"))
    return read.join(ranks.select(F.col("word").alias("candidate")), "candidate").groupBy("word").agg(F.min_by("candidate", "place").alias("best"))


def _best(own_rank: Column, candidates: Column, beside: tuple[tuple[str, str], ...]) -> Column:
    """What a word becomes; null if it stays. beside: the rank of the word on either side, and which candidates (or the word
    itself) make a known pair with it."""
    paired = lambda word, c: F.coalesce(F.array_contains(c, word), F.lit(False))

    def evidence(word, rank):
        return sum((PAIR * paired(word, F.col(c)).cast("int") + COMMON_PAIR * F.coalesce((F.col(r) + rank < COMMON).cast("int"), F.lit(0)) for r, c in beside), F.lit(0))

    def scored(n):
        voted = paired(n["candidate"], F.col(beside[0][1])) | paired(n["candidate"], F.col(beside[1][1]))
        return F.struct((n["worth"] + evidence(n["candidate"], n["rank"])).alias("score"), (-n["place"]).alias("place"), n["candidate"].alias("candidate"), ((n["grows"] == 0) | voted).alias("fit"))

    held = -F.least(own_rank, F.lit(RAREST)) + evidence(F.col("word"), own_rank)
    best = F.array_max(F.transform(candidates, scored))
    return F.element_at(F.transform(F.array(best), lambda b: F.when((b["score"] - held >= LEAST_GAIN) & b["fit"], b["candidate"])), 1)


def decisions(words: DataFrame, known: DataFrame, ranks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of words in their places (word, before, after; "" where there is no neighbour; and what else tells the places
    apart) those that become another one (best). known: (word, own_rank, candidates, reading). A word becomes its best
    neighbour on much better evidence, which an unknown one has against it only from the rarest, and one of another length
    only if a known pair speaks for it.
    A place travels to the pairs on either side of its word and then to the word's candidates, as one row each time."""
    # an unknown word whose one neighbour has its length becomes that, whatever stands beside it
    settled = F.col("own_rank").isNull() & (F.size("candidates") == 1) & F.exists("candidates", lambda n: (n["grows"] == 0) & (n["worth"] + RAREST - 2 * PAIR >= LEAST_GAIN))
    open_ = known.where(F.col("candidates").isNotNull() & ~settled)
    either = open_.select("word", F.explode(F.concat(F.transform("candidates", lambda n: n["candidate"]), F.array("word"))).alias("c"))
    common = ranks.where(F.col("rank") < COMMON).select(F.col("word").alias("w"), F.col("rank").alias("r"))
    few = common.limit(FEW_COMMON + 1).count() <= FEW_COMMON  # as ranks go, about as many as COMMON
    for side, mine, theirs in (("before", "b", "a"), ("after", "a", "b")):
        speak = either.join(pairs.select(F.col(mine).alias("c"), F.col(theirs).alias(side)), "c").groupBy("word", side).agg(F.collect_set("c").alias(f"pairs_{side}"))
        ranked = common.select(F.col("w").alias(side), F.col("r").alias(f"rank_{side}"))
        words = words.join(speak, ["word", side], "left").join(F.broadcast(ranked) if few else ranked, side, "left").drop(side)
    best = _best(F.col("own_rank"), F.col("candidates"), (("rank_before", "pairs_before"), ("rank_after", "pairs_after")))
    found = words.join(known, "word").withColumn("best", F.coalesce("reading", best)).where("best is not null")
    return found.drop("own_rank", "candidates", "reading", "rank_before", "rank_after", "pairs_before", "pairs_after")


def _looked_at(text: Column) -> Column:
    """array<struct<at, word, before, after>>: the words that may be corrected, in small letters. Short ones, ones in capitals and
    capitalised ones inside a sentence may not."""

    def one(words, low, between):
        beside = lambda i: F.coalesce(F.get(low, i), F.lit(""))
        rows = F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("shown"), F.get(low, i).alias("word"), F.when(i > 0, beside(i - 1)).otherwise("").alias("before"), beside(i + 1).alias("after"), ((i == 0) | F.get(between, i).rlike(r"[.!?\n\r:]")).alias("opens")))
        found = F.filter(rows, lambda r: (F.char_length(r["shown"]) >= 3) & (r["opens"] | ~r["shown"].rlike(r"^\p{Lu}")) & ~r["shown"].rlike(r"^\p{Lu}+$"))
        return F.transform(found, lambda r: F.struct(*[r[k].alias(k) for k in ("at", "word", "before", "after")]))

    # each of these once a line, as all words look at them
    parts = F.array(F.struct(_words(text).alias("w"), F.transform(_words(text), _lower).alias("low"), _between(text).alias("b")))
    return F.element_at(F.transform(parts, lambda x: one(x["w"], x["low"], x["b"])), 1)


def _cased(word: Column, shown: Column) -> Column:
    """`word` in the case of what was shown."""
    first = F.concat(_upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.char_length(word)))
    return F.when(shown.rlike(r"^\p{Lu}+$"), _upper(word)).when(shown.rlike(r"^\p{Lu}"), first).otherwise(word)


def corrected(lines: DataFrame, column: str, ranks: DataFrame, pairs: DataFrame) -> DataFrame:
    """`lines` with column corrected: substitutions, then words by `decisions`. Null lines stay null, and lines stay one
    for one. Words that are known have at most as many letters as the list's longest, so longer ones cost no more. Lines are
    numbered and written once, so a word that is looked at carries the number of its line and not the line; each table
    below is written as well, so that its shuffle files go before those of the next are made."""
    rows = written(lines.withColumns({"corrected": substituted(F.col(column)), _LINE: F.monotonically_increasing_id()}), "ocr-lines", tidy=True)
    ranks, pairs = written(ranks, "ocr-ranks", tidy=True), written(pairs, "ocr-pairs", tidy=True)
    longest = ranks.agg(F.max(F.char_length("word")).alias("longest"))
    seen = rows.where("corrected is not null").select(_LINE, F.explode(_looked_at(F.col("corrected"))).alias("t")).select(_LINE, "t.*")
    seen = seen.join(F.broadcast(longest), F.char_length("word") <= F.col("longest") + 1).drop("longest")  # one row
    words = seen.select("word").distinct()
    near = candidates(words.where(~F.col("word").rlike(r"\p{Nd}")), ranks)
    read = readings(words, ranks).select("word", F.col("best").alias("reading"))
    known = written(near.unionByName(read, allowMissingColumns=True), "ocr-known", tidy=True)
    changed = decisions(seen, known, ranks, pairs).groupBy(_LINE).agg(F.map_from_entries(F.collect_list(F.struct("at", "best"))).alias("new"))
    changed = written(changed, "ocr-changed", tidy=True)
    discard(ranks, pairs, known)
    both = rows.join(changed, _LINE, "left")
    words = F.transform(_words(F.col("corrected")), lambda w, i: (lambda n: F.when(n.isNull(), w).otherwise(_cased(n, w)))(F.try_element_at("new", i)))
    whole = F.transform(F.array(words), lambda w: F.array_join(F.transform(_between(F.col("corrected")), lambda g, i: F.concat(g, F.coalesce(F.get(w, i), F.lit("")))), ""))
    return both.withColumn("corrected", F.when(F.col("new").isNull(), F.col("corrected")).otherwise(F.element_at(whole, 1))).drop(_LINE, "new")
