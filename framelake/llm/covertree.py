"""Pairs of vectors within a cosine threshold, by dual traversal of cover trees.

Unit vectors lie at chord distance sqrt(2 - 2 cos). Spark deals them to blocks: the anchors of a bounded sample are
the upper level of the tree, each vector goes to its nearest anchor, and large cells are split by a hash. Each block
gets a cover tree of its own: level i holds centres of which each covers its descendants within 2^(1-i), and centres
stay centres on every deeper level. Every node knows its true covering radius.

Pairs of cells, then pairs of nodes, are pruned where their centres are further apart than both radii and the
threshold together, and taken whole where they are that near; the others are opened. What is left at the leaves is
decided by the dot product in double precision, so the pairs are exact. Blocks meet in tiles of several blocks against
several, so a tree travels once for each tile and not for each other block.

Links are counted, not listed: a task returns the links of each vector and a forest that spans its linked vectors.
"""

from __future__ import annotations

import functools
import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import discard, prepare, table, written
from framelake.llm.components import components

#: Vectors of a block, about.
BLOCK = 6144
#: Blocks of a tile's side at most.
TOGETHER = 8
#: Vectors of the sample from which the anchors come, and the most anchors.
SAMPLE = 8192
ANCHORS = 1024
_EPS = 1e-7
_DEPTH = 12


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def _cover(x: np.ndarray, members: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Greedy cover of `members` (the first one is a centre): the centres, and for each member its centre's index."""
    limit = 1.0 - radius * radius / 2.0
    owner = np.full(len(members), -1, dtype=np.int64)
    centres: list[int] = []
    rest = np.arange(len(members))
    while rest.size:
        some = rest[:256]
        near = x[members[some]] @ x[members[some]].T >= limit
        covered = np.zeros(len(some), dtype=bool)
        new = []
        for i in range(len(some)):
            if not covered[i]:
                new.append(i)
                covered |= near[i]
        chosen = members[some[new]]
        dots = x[members[rest]] @ x[chosen].T
        best = dots.argmax(axis=1)
        hit = dots[np.arange(len(rest)), best] >= limit
        hit[new] = True  # a centre covers itself whatever the rounding
        best[new] = np.arange(len(new))
        owner[rest[hit]] = best[hit] + len(centres)
        centres.extend(chosen.tolist())
        rest = rest[~hit]
    return np.array(centres), owner


class CoverTree:
    """Nodes in breadth-first order; a node's vectors are a range of `x`, its children a range of nodes."""

    def __init__(self, raw: np.ndarray, ids: np.ndarray, copies: np.ndarray):
        x = _unit(raw)
        order = np.arange(len(x))
        nodes = [(0, 0, len(x), 0)]  # centre (an index of the input), range in order, level
        kids: list[tuple[int, int]] = []
        at = 0
        while at < len(nodes):
            centre, lo, hi, level = nodes[at]
            at += 1
            first = len(nodes)
            if hi - lo > 1 and level < _DEPTH:
                members = order[lo:hi]
                members = np.concatenate([[centre], members[members != centre]])
                centres, owner = _cover(x, members, 2.0 ** (1 - (level + 1)))
                by = np.argsort(owner, kind="stable")
                order[lo:hi] = members[by]
                stops = lo + np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(centres)))])
                nodes.extend((int(c), int(a), int(b), level + 1) for c, a, b in zip(centres, stops, stops[1:], strict=False))
            kids.append((first, len(nodes)))
        place = np.empty(len(x), dtype=np.int64)
        place[order] = np.arange(len(x))
        table_ = np.array(nodes, dtype=np.int64).reshape(-1, 4)
        self.raw, self.x, self.ids, self.copies = raw[order], x[order], ids[order], copies[order]
        self.centre, self.lo, self.hi = place[table_[:, 0]], table_[:, 1], table_[:, 2]
        self.kids = np.array(kids, dtype=np.int64).reshape(-1, 2)
        self.radius = np.zeros(len(nodes))
        for i in np.flatnonzero(self.hi - self.lo > 1):
            self.radius[i] = _chord(self.x[self.lo[i] : self.hi[i]] @ self.x[self.centre[i]]).max()

    _PARTS = ("raw", "ids", "copies", "centre", "lo", "hi", "kids", "radius")

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self._PARTS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> CoverTree:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as parts:
            for k in cls._PARTS:
                setattr(self, k, parts[k])
        self.x = _unit(self.raw)
        return self

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """The children of the nodes; a leaf stays itself."""
        lo, hi = self.kids[nodes, 0], self.kids[nodes, 1]
        return np.concatenate([nodes[lo == hi], _spread(lo, hi)])

    def leaf(self, node: int) -> bool:
        return bool(self.kids[node, 0] == self.kids[node, 1])


class _Links:
    """Links found so far between the vectors of two trees (or of one with itself)."""

    def __init__(self, a: CoverTree, b: CoverTree, same: bool):
        self.a, self.b, self.same = a, b, same
        self.shift = 0 if same else len(a.x)  # where b's vectors begin among all
        self.ids = a.ids if same else np.concatenate([a.ids, b.ids])
        self.n = np.zeros(len(self.ids) + 1, dtype=np.int64)  # differences of links along the vectors
        self.chain = np.zeros(len(self.ids) + 1, dtype=np.int64)  # differences: vectors linked with the next one
        self.weight = [np.concatenate([[0], np.cumsum(t.copies)]) for t in (a, b)]
        self.parent = list(range(len(self.ids)))

    def _root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def _roots(self, at: np.ndarray) -> np.ndarray:
        return np.fromiter((self._root(i) for i in at.tolist()), dtype=np.int64, count=len(at))

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        for i, j in zip(u.tolist(), v.tolist(), strict=True):
            i, j = self._root(i), self._root(j)
            if i != j:
                self.parent[max(i, j)] = min(i, j)

    def matrix(self, hit: np.ndarray, alo, ahi, blo, bhi) -> None:
        """Range i of a is linked with range j of b, each vector with each, where hit[i, j]."""
        rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        if not rows.size:
            return
        hit = hit[np.ix_(rows, cols)]
        alo, ahi, blo, bhi = alo[rows], ahi[rows], blo[cols], bhi[cols]
        wa, wb = self.weight[0][ahi] - self.weight[0][alo], self.weight[1][bhi] - self.weight[1][blo]
        for lo, hi, w in ((alo, ahi, hit @ wb), (blo + self.shift, bhi + self.shift, wa @ hit)):
            np.add.at(self.n, lo, w)
            np.add.at(self.n, hi, -w)
            np.add.at(self.chain, lo, 1)
            np.add.at(self.chain, hi - 1, -1)
        blo = blo + self.shift
        while True:  # one edge for each row that is still apart from one of its columns
            apart = hit & (self._roots(alo)[:, None] != self._roots(blo)[None, :])
            left = np.flatnonzero(apart.any(axis=1))
            if not left.size:
                return
            self.join(alo[left], blo[apart[left].argmax(axis=1)])

    def within(self, lo: int, hi: int) -> None:
        """All vectors of one range of a tree against itself are linked with each other."""
        w = self.weight[0][hi] - self.weight[0][lo]
        self.n[lo] += w
        self.n[hi] -= w
        own = self.a.copies[lo:hi]
        self.n[lo:hi] -= own
        self.n[lo + 1 : hi + 1] += own
        self.chain[lo] += 1
        self.chain[hi - 1] -= 1

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(u, v, links): rows with v = u hold links, the others edges of a spanning forest."""
        links = np.cumsum(self.n)[:-1]
        run = np.flatnonzero(np.cumsum(self.chain)[:-1] > 0)
        self.join(run, run + 1)
        root = self._roots(np.arange(len(self.ids)))
        moved, linked = np.flatnonzero(root != np.arange(len(root))), np.flatnonzero(links)
        ids = self.ids
        return np.concatenate([ids[linked], ids[moved]]), np.concatenate([ids[linked], ids[root[moved]]]), np.concatenate([links[linked], np.zeros(len(moved), dtype=np.int64)])


def _spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    n = hi - lo
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def dual_traversal(a: CoverTree, b: CoverTree, same: bool, threshold: float) -> _Links:
    """Links between the vectors of a and b; with `same`, b is a, and a vector isn't linked with itself.

    A step holds nodes of a against nodes of b, whose pairs are taken, pruned or opened together: a node of a is
    opened against all the nodes of b that are still near it."""
    tau = float(_chord(np.array(threshold)))
    links = _Links(a, b, same)
    root = np.zeros(1, dtype=np.int64)
    stack = [(root, root, same)]

    def singles(rows: np.ndarray, cols: np.ndarray, mirrored: bool) -> None:
        hit = a.x[a.centre[rows]] @ b.x[b.centre[cols]].T >= threshold
        if mirrored:
            hit &= rows[:, None] < cols[None, :]
        if hit.any():
            links.matrix(hit, a.lo[rows], a.hi[rows], b.lo[cols], b.hi[cols])

    def leaves(s: int, ts: np.ndarray, own: bool) -> None:
        right = _spread(b.lo[ts], b.hi[ts])
        for lo in range(int(a.lo[s]), int(a.hi[s]), 512):
            some = np.arange(lo, min(lo + 512, int(a.hi[s])))
            hit = a.x[some] @ b.x[right].T >= threshold
            if own:
                hit &= some[:, None] < right[None, :]
            if hit.any():
                links.matrix(hit, some, some + 1, right, right + 1)

    def others(rows: np.ndarray, cols: np.ndarray, mirrored: bool, by_column: bool) -> None:
        reach = a.radius[rows][:, None] + b.radius[cols][None, :]
        away = _chord(a.x[a.centre[rows]] @ b.x[b.centre[cols]].T)
        near = away <= reach + (tau + _EPS)
        if mirrored:
            near &= rows[:, None] < cols[None, :]
        hit = near & (away + reach <= tau - _EPS)
        if hit.any():
            links.matrix(hit, a.lo[rows], a.hi[rows], b.lo[cols], b.hi[cols])
        near &= ~hit
        if by_column:  # the rows are single vectors
            for q in np.flatnonzero(near.any(axis=0)):
                t, some = cols[q], rows[near[:, q]]
                if b.leaf(t):
                    inside = np.arange(b.lo[t], b.hi[t])
                    links.matrix(a.x[a.lo[some]] @ b.x[inside].T >= threshold, a.lo[some], a.hi[some], inside, inside + 1)
                else:
                    stack.append((some, b.below(np.array([t])), False))
            return
        for p in np.flatnonzero(near.any(axis=1)):
            s, some = int(rows[p]), cols[near[p]]
            if a.leaf(s):
                ends = b.kids[some, 0] == b.kids[some, 1]
                if ends.any():
                    leaves(s, some[ends], False)
                some = some[~ends]
            if some.size:
                stack.append((a.below(np.array([s])), b.below(some), False))

    while stack:
        left, right, mirrored = stack.pop()
        one_left, one_right = a.hi[left] - a.lo[left] == 1, b.hi[right] - b.lo[right] == 1
        for lo in range(0, len(left), 512):
            some, one = left[lo : lo + 512], one_left[lo : lo + 512]
            for rows, cols, how in ((some[one], right[one_right], 0), (some[one], right[~one_right], 1), (some[~one], right, 2)):
                if rows.size and cols.size:
                    singles(rows, cols, mirrored) if how == 0 else others(rows, cols, mirrored, how == 1)
        if mirrored:  # each node against itself
            for s in left[~one_left].tolist():
                if 2 * a.radius[s] <= tau - _EPS:
                    links.within(int(a.lo[s]), int(a.hi[s]))
                elif a.leaf(s):
                    leaves(s, np.array([s]), True)
                else:
                    below = a.below(np.array([s]))
                    stack.append((below, below, True))
    return links


def _anchors(sample: np.ndarray, n: int) -> np.ndarray:
    """The first n points of a farthest-first traversal: at any radius its prefix is a cover of the sample."""
    best = np.full(len(sample), -2.0)
    chosen = [0]
    for _ in range(n - 1):
        best = np.maximum(best, sample @ sample[chosen[-1]])
        chosen.append(int(best.argmin()))
    return sample[chosen]


def _array(column: pd.Series, kind: str) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float32 if kind == "array<float>" else np.float64)


def _blocks(vectors: DataFrame, count: int, threshold: float, block: int):
    """Trees (number, cell, tree) of blocks, tiles (a, b, group) of groups of `together` blocks that may hold links, and
    for each two cells whether they may. Tables that are used up by then are gone."""
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.simpleString()
    sample = vectors.orderBy(F.xxhash64("uid")).limit(SAMPLE).select("embedding").toPandas()
    points = _anchors(_unit(_array(sample["embedding"], kind)), min(ANCHORS, len(sample), max(1, -(-count // block))))
    anchors = spark.sparkContext.broadcast(points)

    def assign(batches):
        for pdf in batches:
            dots = _unit(_array(pdf["embedding"], kind)) @ anchors.value.T
            best = dots.argmax(axis=1)
            yield pdf.assign(cell=best.astype("int32"), away=_chord(dots[np.arange(len(pdf)), best]))

    placed = written(vectors.mapInPandas(assign, f"uid bigint, copies bigint, embedding {kind}, cell int, away double"), "vectors")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).orderBy("cell").toPandas()  # a row for each anchor at most
    number, radius = cells["cell"].to_numpy(), cells["radius"].to_numpy()
    parts = -(-cells["n"].to_numpy() // block)
    first = np.cumsum(parts) - parts
    near = _chord(points[number] @ points[number].T) <= radius[:, None] + radius[None, :] + float(_chord(np.array(threshold))) + _EPS

    of = spark.createDataFrame(list(zip(range(len(cells)), *(x.tolist() for x in (number, parts, first)), strict=True)), "at int, cell int, parts long, first long")
    numbered = placed.join(F.broadcast(of), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("uid"), F.col("parts")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        tree = CoverTree(_array(pdf["embedding"], kind), pdf["uid"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64))
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "at": [pdf["at"].iloc[0]], "tree": [tree.dump()]})

    trees = written(numbered.select("block", "at", "uid", "copies", "embedding").groupBy("block").applyInPandas(build, "block bigint, at int, tree binary"), "trees")
    discard(placed)
    # so many blocks together that there are a few tiles for each core, and that their trees fit in a task
    together = int(min(TOGETHER, max(1, parts.sum() // math.sqrt(4 * spark.sparkContext.defaultParallelism))))
    i, j = np.nonzero(np.triu(near))
    pairs = spark.createDataFrame(pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32")}))
    ends = of.select("at", F.floor(F.col("first") / together).alias("lo"), F.floor((F.col("first") + F.col("parts") - 1) / together).alias("hi"))
    ends = F.broadcast(ends)
    groups = lambda side, name: F.explode(F.sequence(f"{side}_lo", f"{side}_hi")).alias(name)
    tiles = pairs.join(ends.toDF("i", "i_lo", "i_hi"), "i").join(ends.toDF("j", "j_lo", "j_hi"), "j")
    tiles = tiles.select("j_lo", "j_hi", groups("i", "p")).select("p", groups("j", "q")).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    tiles = tiles.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("group"))
    return trees.withColumn("group", F.floor(F.col("block") / together)), tiles, near


def links(vectors: DataFrame, threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(u, v, links) over distinct vectors (uid, copies, embedding) of one dimension, written: rows with u = v count the
    rows that u is linked with, others are edges that span what is linked."""
    count = vectors.count()
    spark = vectors.sparkSession
    if not count:
        return spark.createDataFrame([], "u bigint, v bigint, links bigint")
    trees, tiles, near = _blocks(vectors, count, threshold, block)
    near = spark.sparkContext.broadcast(near)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["a"].iloc[0], pdf["b"].iloc[0]
        found = [(n, g, at, CoverTree.load(t)) for n, g, at, t in zip(pdf["block"], pdf["group"], pdf["at"], pdf["tree"], strict=True)]
        parts = []
        for m, g, c, s in found:
            for n, h, d, t in found:
                if g == a and h == b and (a < b or m <= n) and near.value[c, d]:
                    parts.append(pd.DataFrame(dict(zip(("u", "v", "links"), dual_traversal(s, t, m == n, threshold).result(), strict=True))))
        out = pd.concat(parts) if parts else pd.DataFrame({"u": [], "v": [], "links": []}).astype("int64")
        return out.groupby(["u", "v"], as_index=False).sum()

    joined = tiles.join(trees.select("block", "at", "tree", "group"), "group")
    found = written(joined.groupBy("a", "b").applyInPandas(meet, "u bigint, v bigint, links bigint"), "links")
    discard(trees)
    return found


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """One row per row of (vec_id, embedding): vec_id, n_links, component_id, kept.

    Equal vectors are one point with a number of copies, so a group of copies costs one row. Vectors that are null,
    zero or hold null or non-finite components, and rows without an id, link with nothing; rows with a null id have a
    null component and aren't kept. Vectors of different dimensions never link. Repeated rows link with each other;
    rows that share an id but not the vector are vectors of their own. An empty table gives no row.
    """
    spark = vectors.sparkSession
    prepare(spark)
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    usable = F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    keyed = rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("h1", F.when(F.col("usable"), F.xxhash64("embedding"))).withColumn("h2", F.when(F.col("usable"), F.hash("embedding", F.lit(1))))
    distinct = keyed.where("usable").groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"))
    distinct = written(distinct.withColumn("uid", F.monotonically_increasing_id()), "distinct")  # written, so the numbers stay
    found = []
    for row in distinct.select(F.size("embedding").alias("d")).distinct().collect():  # dimensions of a table: a handful
        found.append(links(distinct.where(F.size("embedding") == row["d"]).select("uid", "copies", "embedding"), threshold, block))
    members = keyed.select("vec_id", "h1", "h2")
    if not found:
        return members.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    all_links = functools.reduce(DataFrame.unionByName, found)
    counts = all_links.where("u = v").groupBy(F.col("u").alias("uid")).agg(F.sum("links").alias("links"))
    parts = components(all_links.where("u <> v").select("u", "v"))
    points = distinct.select("h1", "h2", "uid", "first", "copies").join(counts, "uid", "left").join(parts.withColumnRenamed("id", "uid"), "uid", "left")
    points = points.select("h1", "h2", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "uid").alias("part"))
    points = written(points, "points")
    least = written(points.groupBy("part").agg(F.min("first").alias("component")), "least-of-parts")
    # written, so that both sides of the joins come from shuffles and Spark splits the rows of a large group
    named = written(points.join(least, "part").select("h1", "h2", "n", "component"), "named-points")
    discard(distinct, parts, points, least, *found)
    return members.join(named, ["h1", "h2"], "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        (F.col("vec_id").isNotNull() & (F.coalesce("component", "vec_id") == F.col("vec_id"))).alias("kept"),
    )


#: The rows of op1_near_vectors for tables whose ids are there and differ.
ORACLE_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (
  SELECT * FROM v WHERE len(e) > 0 AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in e if x <> 0]) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
),
reached AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT r.vec_id, coalesce(any_value(n), 0) AS n_links, min(other) AS component_id, min(other) = r.vec_id AS kept
FROM reached r LEFT JOIN counted c ON c.vec_id = r.vec_id GROUP BY r.vec_id"""


def op1_near_vectors(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of the whole table at cosine 0.9; see `near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
