"""Centroid clustering by Exponion search, exact in integers.

Each vector keeps an upper bound of the distance to its centroid and a lower bound of the distance to any other one.
When the centroids have moved, the bounds are widened by the moves; only where they overlap is the distance to the own
centroid computed anew, and only where that doesn't settle it are other centroids looked at: those in the ball of
radius ``2 * distance + s`` around the own centroid, where s is the own centroid's distance to its nearest neighbour.
The centroids of a ball are a prefix of the own centroid's list of the others, sorted by distance. The nearest and the
second nearest centroid lie in the ball, whose edge is inside, so ties are seen and go to the smaller number.

Distances are squared and exact; bounds are roots, rounded outwards, and only a strict difference settles anything.

What is broadcast is `k` centroids. A round reads and writes the table of vectors and their bounds once, and adds up
each cluster where it is read: a few rows leave each task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import discard, prepare, table, written

DIMENSION = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
#: Components beyond this have no squared distances that 64 bits hold for vectors of DIMENSION components.
LARGEST = 1 << 27
#: Rows that Python sees at once.
ROWS = 4_096
#: Roots are off by less than this share.
_OFF = 1e-12


def _above(squared: np.ndarray) -> np.ndarray:
    """Roots, not below the true ones."""
    return np.sqrt(squared.astype(np.float64)) * (1 + _OFF)


def _below(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - _OFF)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Exponion:
    """Centroids, their sorted lists of each other, and how far they moved since the round before."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids = centroids
        k = len(centroids)
        between = np.stack([squared_distances(centroids, c) for c in centroids]) if k else np.zeros((0, 0), np.int64)
        others = [np.array([j for j in np.argsort(between[a], kind="stable") if j != a], dtype=np.int64) for a in range(k)]
        self.others = np.stack(others) if k else np.zeros((0, 0), np.int64)
        self.reach = _below(np.take_along_axis(between, self.others, axis=1)) if k else np.zeros((0, 0))
        self.half_gap = self.reach[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        self.gap = _above(np.take_along_axis(between, self.others[:, :1], axis=1))[:, 0] if k > 1 else np.zeros(k)
        self.moved = _above(squared_distances(centroids, before)) if before is not None else None
        if self.moved is not None and k > 1:  # the furthest move of any other centroid
            order = np.argsort(-self.moved, kind="stable")
            self.others_moved = np.full(k, self.moved[order[0]])
            self.others_moved[order[0]] = self.moved[order[1]]
        elif self.moved is not None:
            self.others_moved = np.zeros(k)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Clusters and bounds of vectors from those of the round before."""
        cluster = cluster.copy()
        upper, lower = (upper + self.moved[cluster]) * (1 + _OFF), (lower - self.others_moved[cluster]) * (1 - np.sign(lower) * _OFF)
        settled = upper < np.maximum(lower, self.half_gap[cluster])
        look = np.flatnonzero(~settled)
        own = squared_distances(x[look], self.centroids[cluster[look]])
        upper[look] = _above(own)
        still = ~(upper[look] < np.maximum(lower[look], self.half_gap[cluster[look]]))
        look, own = look[still], own[still]
        self._search(x, look, own, cluster, upper, lower)
        return cluster, upper, lower

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Clusters and bounds of vectors that have none yet: the search starts at the first centroid."""
        n = len(x)
        cluster, upper, lower = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        self._search(x, np.arange(n), squared_distances(x, self.centroids[cluster]), cluster, upper, lower)
        return cluster, upper, lower

    def _search(self, x, look, own, cluster, upper, lower) -> None:
        """Looks at the balls of the vectors at the places `look`, whose squared distance to their centroid is `own`."""
        owner = cluster[look]
        for a in np.unique(owner):
            rows = np.flatnonzero(owner == a)
            at, near = look[rows], own[rows]
            ball = 2 * _above(near) + self.gap[a]
            inside = np.searchsorted(self.reach[a], ball * (1 + _OFF), side="right")
            best, best_of = near.copy(), np.full(len(at), a)
            second = np.full(len(at), np.iinfo(np.int64).max)
            for rank in range(int(inside.max(initial=0))):
                j, some = self.others[a, rank], np.flatnonzero(inside > rank)
                d = squared_distances(x[at[some]], self.centroids[j])
                wins = (d < best[some]) | ((d == best[some]) & (j < best_of[some]))
                second[some] = np.where(wins, best[some], np.minimum(second[some], d))
                best[some], best_of[some] = np.where(wins, d, best[some]), np.where(wins, j, best_of[some])
            cluster[at], upper[at] = best_of, _above(best)
            # with a single centroid there is no second one
            lower[at] = np.where(second == np.iinfo(np.int64).max, np.inf, _below(second))


def usable(vector: Column, dimension: int = DIMENSION) -> Column:
    """Whether a vector has the dimension and only finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dimension) & fine, F.lit(False))


def in_steps(vector: Column, scale: int = SCALE) -> Column:
    """Components as integers: floor(scale * x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def starts(points: DataFrame, k: int) -> np.ndarray:
    """The k points (vec_id, x) whose ids have the least hashes; points without an id come last, equal ids by their
    components."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = points.select(key.alias("key"), "x").orderBy(F.asc_nulls_last("key"), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64, copy=False)


def _round(points: DataFrame, exponion: Exponion) -> DataFrame:
    """Points with cluster and bounds by one round; points that have no cluster yet get theirs."""
    shared = points.sparkSession.sparkContext.broadcast(exponion)  # k centroids
    old = "cluster" in points.columns
    schema = "vec_id bigint, x array<bigint>, cluster int, upper double, lower double"

    def run(batches):
        search = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"))
            if old:
                bounds = [b.column(n).to_numpy(zero_copy_only=False) for n in ("cluster", "upper", "lower")]
                found = search.assign(x, bounds[0].astype(np.int64), *bounds[1:])
            else:
                found = search.first(x)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(found[0], pa.int32()), pa.array(found[1]), pa.array(found[2])], names=["vec_id", "x", "cluster", "upper", "lower"])

    return points.mapInArrow(run, schema)


def _means(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored means of the clusters; empty ones keep their centroid. One row a cluster comes to the driver."""
    d = centroids.shape[1]
    sums = points.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)]).collect()
    new = centroids.copy()
    for r in sums:
        new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(d)]
    return new


def clustered(points: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance), written, of points (vec_id, x: integers, all of one dimension), and the final centroids.

    The first centroids are the points whose ids have the least hashes; fewer than k points make fewer centroids. Equal
    rows are points each. A component beyond LARGEST is an error, as 64 bits don't hold its squared distances.
    """
    prepare(points.sparkSession, ROWS)
    points = written(points.select("vec_id", "x"), "points")
    odd = points.where(F.exists("x", lambda v: F.abs(v) > LARGEST)).select("vec_id").first()
    if odd:
        raise ValueError(f"vector {odd[0]} has a component whose squared distances don't fit in 64 bits")
    centroids = starts(points, k)
    before = None
    if not len(centroids):
        return points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for n in range(rounds + 1):
        last, points = points, written(_round(points, Exponion(centroids, before)), "assigned")
        discard(last)
        if n < rounds:
            before, centroids = centroids, _means(points, centroids)
    final = F.array(*[F.array(*[F.lit(int(v)) for v in c]) for c in centroids])
    far = F.aggregate(F.zip_with("x", F.get(final, F.col("cluster")), lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, v: s + v)
    found = written(points.select("vec_id", "cluster", far.cast("long").alias("distance")), "clusters")
    discard(points)
    return found, centroids


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    """Clusters of all usable vectors of embeddings after three rounds and a last assignment.

    Vectors that are null, have another dimension or hold null or non-finite components have no row. Vectors without an
    id are clustered like others and come last among possible first centroids; rows that repeat an id are vectors each.
    Fewer than 16 vectors make fewer clusters, none no row. See `clustered` for components beyond its limit.
    """
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"))
    found, centroids = clustered(vectors.where(usable(F.col("e"))).select("vec_id", in_steps(F.col("e")).alias("x")))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = [(j, sums.get(j, 0), sum(sums.values()), name) for j, name in enumerate(names)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rows of op11_centroids in DuckDB, one round after the other."""
    steps = [
        """kept AS (
  SELECT vec_id, [CAST(floor(CAST(c AS DOUBLE) * 64) AS BIGINT) for c in embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len([c for c in embedding if c IS NULL OR NOT isfinite(CAST(c AS DOUBLE))]) = 0
)""",
        """c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS j, x AS c
  FROM (SELECT sha256(concat('1:', CAST(vec_id AS VARCHAR))) AS h, x FROM kept ORDER BY h LIMIT 16)
)""",
    ]
    near = """SELECT vec_id, x, arg_min(j, (d, j)) AS j, min(d) AS d
  FROM (SELECT vec_id, x, j, CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(x, c)]) AS BIGINT) AS d FROM kept CROSS JOIN c{r}) GROUP BY vec_id, x"""
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (\n  {near.format(r=r)}\n)")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (
  SELECT j, list(m ORDER BY i) AS c FROM (
    SELECT j, i, (s - ((s % n) + n) % n) // n AS m
    FROM (SELECT j, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT j, unnest(x) AS v, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY j, i)
  ) GROUP BY j
),
c{r + 1} AS MATERIALIZED (SELECT c{r}.j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.j = c{r}.j)""")
    last = f"""SELECT vec_id, CAST(a.j AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.j = a.j"""
    return "WITH " + ",\n".join(steps) + "\n" + last


#: The rows of op11_centroids for tables whose ids are there and differ.
ORACLE_SQL = _oracle()
