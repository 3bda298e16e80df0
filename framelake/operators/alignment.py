"""Library paths under the roots of another program, found by the folders that both share.

The other program sees the same files under roots of its own. A root fits a path where the root's last folders stand in
the path one after the other; the root of which the most do is taken, the first one listed on ties, and what follows
them in the path goes below it. Each root stands under each of its tails, each path under each run of its segments that
is no longer than the longest root, and an equality join brings them together. Of roots with the same tail only the
first counts, so a folder that many roots end in makes no more rows than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segments(path: Column) -> Column:
    """The parts of a path between slashes of either kind, none empty."""
    return F.filter(F.split(path, r"[\\/]+"), lambda s: s != "")


def tails(roots: DataFrame) -> DataFrame:
    """(key, length, root) of roots (place, root): the first root of each tail, whatever its case."""
    parts = F.transform(segments(F.col("root")), lambda s: F.lower(s))
    each = roots.where("root is not null").withColumn("parts", parts).where(F.size("parts") > 0)
    each = each.select("place", "root", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("length"))
    key = F.array_join(F.slice("parts", -F.col("length"), F.col("length")), "/")
    return each.groupBy(key.alias("key"), "length").agg(F.min_by("root", F.struct("place", "root")).alias("root"), F.min(F.struct("place", "root"))["place"].alias("place"))


def aligned(files: DataFrame, roots: DataFrame, path: str = "file_path") -> DataFrame:
    """(path, root, mapped, length): each distinct path that some root fits, and the path as the other program sees it.
    Roots are (place, root) in the order in which they are listed."""
    known = tails(roots)
    longest = roots.agg(F.coalesce(F.max(F.size(segments(F.col("root")))), F.lit(0)).alias("longest"))
    rows = files.select(F.col(path).alias("path")).where("path is not null").distinct().crossJoin(F.broadcast(longest))  # one row
    rows = rows.withColumn("parts", segments(F.col("path"))).where((F.size("parts") > 0) & (F.col("longest") > 0))
    low = F.transform("parts", lambda s: F.lower(s))
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.least("longest", F.size("parts"))),
            lambda k: F.transform(F.sequence(F.lit(1), F.size("parts") - k + 1), lambda i: F.struct(F.array_join(F.slice("low", i, k), "/").alias("key"), k.alias("length"), i.alias("at"))),
        )
    )
    each = rows.withColumn("low", low).select("path", F.explode(runs).alias("run")).select("path", "run.*")
    best = each.join(known, ["key", "length"]).groupBy("path").agg(F.min_by(F.struct("root", "length", "at"), F.struct(-F.col("length"), "place", "root", "at")).alias("b"))
    rest = F.slice(segments(F.col("path")), F.col("b.at") + F.col("b.length"), F.size(segments(F.col("path"))))
    sign = F.when(F.col("b.root").contains("\\") & ~F.col("b.root").contains("/"), "\\").otherwise("/")
    below = F.concat(F.regexp_replace("b.root", r"[\\/]+$", ""), sign, F.when(sign == "/", F.array_join(rest, "/")).otherwise(F.array_join(rest, "\\")))
    return best.select("path", "b.root", F.when(F.size(rest) == 0, F.col("b.root")).otherwise(below).alias("mapped"), "b.length")
