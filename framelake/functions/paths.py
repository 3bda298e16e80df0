"""Paths, file names and watched folders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions that count as video and music.
VIDEO = ("mkv", "mp4", "ts", "wmv", "avi", "m4v", "mpeg", "mov", "3gp", "webm", "flv")
MUSIC = ("mp3", "m4a", "flac", "aac", "ogg", "opus", "wav", "wma", "alac", "ape", "aiff", "dsf", "dff", "mka", "mp2")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[\\/][^\\/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def base_name(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    """The last extension, in lower case and without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def kind(path: Column, marker: str = "[encoded]") -> Column:
    """Video, Music, or null for other files and for those whose name has the mark of our own outputs."""
    ext = extension(path)
    own = F.lower(file_name(path)).contains(marker.lower())
    return F.when(own, None).when(ext.isin(*VIDEO), "Video").when(ext.isin(*MUSIC), "Music")


def folder_key(directory_: Column, base: Column) -> Column:
    """Key of a title in a folder, whatever its case."""
    return F.lower(F.concat_ws("|", directory_, base))


def glob(name: Column, pattern: str) -> Column:
    """Whether a name fits a pattern with * and ?, as a whole and whatever its case."""
    return name.rlike("(?i)^" + re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".") + "$")


def like_escaped(text: Column, needle: str) -> Column:
    """Whether a text holds the needle, whatever its case; marks of LIKE in the needle stand for themselves."""
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return text.ilike(f"%{escaped}%")


def rewrite_prefix(path: Column, rewrites: list[tuple[str, str]]) -> Column:
    """The path with the longest prefix that fits replaced. The list comes from settings and is short."""
    out = path
    for old, new in sorted(rewrites, key=lambda r: len(r[0])):
        out = F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(out)
    return out


#: Folders up to this number, of so many depths, are sent to all executors.
FEW_FOLDERS = 100_000
FEW_DEPTHS = 12


def longest_prefix(files: DataFrame, folders: DataFrame, path: str = "file_path", root: str = "root") -> DataFrame:
    """`files` with the columns of the folder that is the longest ancestor of the path, whatever its case; null where
    none is. Few folders are looked up depth by depth without moving the files; with many, every path is exploded to
    its ancestors and joined on equality, so neither side is scanned for each row of the other."""
    columns = [c for c in folders.columns if c != root]
    key = F.lower(F.regexp_replace(root, r"[\\/]+$", ""))
    found = folders.withColumn("folder_root", key).dropDuplicates(["folder_root"]).select("folder_root", *columns)
    found = found.withColumn("depth", F.size(F.split("folder_root", "/")))
    depths = {r["depth"]: r["count"] for r in found.groupBy("depth").count().limit(FEW_DEPTHS + 1).collect()}
    parts = F.split(F.lower(F.col(path)), "/")
    if len(depths) <= FEW_DEPTHS and sum(depths.values()) <= FEW_FOLDERS:
        out, hits = files, []
        for depth in sorted(depths, reverse=True):
            name = f"the folder {depth}"
            side = found.where(F.col("depth") == depth).select(F.col("folder_root").alias(f"the root {depth}"), F.struct("folder_root", *columns).alias(name))
            ancestor = F.when(F.size(parts) > depth, F.array_join(F.slice(parts, 1, depth), "/"))
            out = out.join(F.broadcast(side), ancestor == F.col(f"the root {depth}"), "left")
            hits.append(F.col(name))
        best = F.coalesce(*hits) if hits else F.lit(None).cast(found.select(F.struct("folder_root", *columns).alias("s")).schema["s"].dataType)
        out = out.withColumn("the best", best)
        return out.select(*[F.col(c) for c in files.columns], *[F.col("the best")[c].alias(c) for c in ("folder_root", *columns)])
    return _longest_of_many(files, found.drop("depth"), columns, path)


def _longest_of_many(files: DataFrame, found: DataFrame, columns: list[str], path: str) -> DataFrame:
    parts = F.split(F.lower(F.col(path)), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    hits = files.select(F.col(path).alias("the_path"), F.explode(ancestors).alias("folder_root")).distinct().join(found, "folder_root")
    best = hits.groupBy("the_path").agg(F.max_by(F.struct("folder_root", *columns), F.length("folder_root")).alias("best"))
    out = files.join(best, files[path] == best["the_path"], "left")
    return out.select(*[files[c] for c in files.columns], F.col("best.folder_root").alias("folder_root"), *[F.col(f"best.{c}").alias(c) for c in columns])


def aligned_tail(path: Column, root: str) -> Column:
    """The path below the longest tail of the root's segments that the path holds as whole segments; null if none."""
    segments = [s.lower() for s in re.split(r"[\\/]+", root) if s]
    parts = F.filter(F.split(path, r"[\\/]+"), lambda s: s != "")
    lowered = F.transform(parts, F.lower)
    out = F.lit(None).cast("string")
    for k in range(1, len(segments) + 1):  # longer tails override shorter ones
        tail = F.array(*[F.lit(s) for s in segments[-k:]])
        at = F.get(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - k + 1)), lambda i: F.slice(lowered, i, k) == tail), 0)  # noqa: B023
        rest = F.array_join(F.slice(parts, at + k, F.greatest(F.lit(0), F.size(parts) - at - k + 1)), "/")
        out = F.when(at.isNotNull(), rest).otherwise(out)
    return out
