"""Resolution, depth, bitrate and other numbers of media files."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(x: Column) -> Column:
    """A number if it is positive, else null."""
    return F.when(x > 0, x)


def resolution_class(width: Column, height: Column) -> Column:
    """sd, 720p, 1080p, 1440p or 2160p+ by the short edge; null unless both edges are known."""
    edge = F.when((width > 0) & (height > 0), F.least(width, height))
    return F.when(edge.isNull(), None).when(edge < 720, "sd").when(edge < 1080, "720p").when(edge < 1440, "1080p").when(edge < 2160, "1440p").otherwise("2160p+")


def exclusion_label(width: Column, height: Column) -> Column:
    """The standard label nearest to the larger of the height and three quarters of the width, in whole pixels."""
    h = F.when((width > 0) & (height > 0), F.greatest(height, F.floor(width * 3 / 4).cast("int")))
    return F.when(h >= 2000, "2160p").when(h >= 1300, "1440p").when(h >= 900, "1080p").when(h >= 600, "720p").when(h >= 380, "480p")


def display_resolution(is_4k: Column, width: Column, height: Column) -> Column:
    """What the dashboard shows: 4K first, then by the short edge."""
    edge = F.when((width > 0) & (height > 0), F.least(width, height)).otherwise(F.greatest(width, height))
    return F.when(is_4k, "4K").when(edge >= 2160, "4K").when(edge >= 1440, "1440p").when(edge >= 1080, "1080p").when(edge >= 720, "720p").when(edge > 0, "SD").otherwise("Unknown")


def insight_bucket(width: Column) -> Column:
    """Library insight buckets by width; null for an unknown one."""
    return F.when(width > 1920, "4K").when(width > 1280, "1080p").when(width > 960, "720p").when(width > 0, "SD")


# How names of pixel formats end in their depths.
_PLANAR = r"(?i)p[024]?(9|10|12|14|16)(?:le|be)?$"
_PACKED = r"(?i)(?:gray|rgb|bgr|gbr|y)[a-z0-9_]*?(9|10|12|14|16)(?:le|be)?$"


def bit_depth(pixel_format: Column) -> Column:
    """Bits of a component, from the name of the pixel format; 8 if the name doesn't say, null without a name."""
    name = F.trim(pixel_format)
    planar, packed = F.regexp_extract(name, _PLANAR, 1), F.regexp_extract(name, _PACKED, 1)
    depth = F.when(planar != "", planar.try_cast("int")).when(F.lower(name).isin("v210", "v410"), 10).when(packed != "", packed.try_cast("int")).otherwise(8)
    return F.when(F.coalesce(name, F.lit("")) == "", None).otherwise(depth)


def hdr_any(streams: Column) -> Column:
    """HDR by transfer or primaries of any video stream."""
    return F.exists(streams, lambda s: (s["codec_type"] == "video") & (F.coalesce(F.lower(s["color_transfer"]).isin("smpte2084", "arib-std-b67"), F.lit(False)) | F.coalesce(F.lower(s["color_primaries"]) == "bt2020", F.lit(False))))


def hdr_first(streams: Column) -> Column:
    """HDR by the transfer of the first video stream alone."""
    first = F.get(F.filter(streams, lambda s: s["codec_type"] == "video"), 0)
    return F.coalesce(F.lower(first["color_transfer"]).isin("smpte2084", "arib-std-b67"), F.lit(False))


def kbps_from_size(size: Column, seconds: Column, kilo: int = 1000) -> Column:
    """Whole kbps of a file; 0 for an unknown length."""
    return F.coalesce(F.when(seconds > 0, (size * 8 / seconds / kilo).cast("long")), F.lit(0))


def frame_rate(text: Column) -> Column:
    """"30000/1001" or "25" as a number; null if it isn't a positive one."""
    parts = F.split(text, "/")
    a, b = F.get(parts, 0).try_cast("double"), F.coalesce(F.get(parts, 1), F.lit("1")).try_cast("double")
    value = F.try_divide(a, b)
    return F.when((F.size(parts) <= 2) & (value > 0), value)


def gop(rate: Column) -> Column:
    """Key frame distance: two seconds, rounded half to even, 24 at least; 48 if the rate is unknown."""
    return F.when(rate.isNull(), 48).otherwise(F.greatest(F.lit(24), F.bround(rate * 2).cast("int")))


# Heights of downscale targets.
HEIGHTS = {"4K": 2160, "2160p": 2160, "1440p": 1440, "1080p": 1080, "720p": 720, "480p": 480, "240p": 240}


def downscale_height(target: Column) -> Column:
    """Height of a downscale target; 1080 if it isn't known."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in HEIGHTS.items() for x in pair]), target), F.lit(1080))


def backoff_minutes(failures: Column) -> Column:
    """Minutes to wait after the n-th failure: 5, 10, 20, ... 60 at most."""
    return F.least(F.lit(60), (F.pow(F.lit(2.0), failures - 1) * 5).cast("int"))


def bitrate_plan(bitrate: Column, is_hevc: Column, width: Column, *, target: int, strict: bool = False, multiplier: int = 2, below_4k: bool = False, crop: bool = False) -> Column:
    """Struct (target, least, most, copy) of an encode, in kbps."""
    four_k = target * min(8, max(2, multiplier))
    wide = (width > 1920) & F.lit(not below_4k)
    budget = F.when(wide, F.lit(four_k)).otherwise(F.lit(target))
    shrink = (bitrate > 0) & (bitrate < budget + 700) & ~is_hevc
    capped = F.when(wide, budget.cast("long")).otherwise(F.when(bitrate > 0, F.least(F.lit(target).cast("long"), bitrate)).otherwise(F.lit(target).cast("long")))

    def pick(scale: float, shift: int) -> Column:
        if strict:
            return F.lit(target).cast("long")
        return F.when(shrink, (bitrate * F.lit(scale)).cast("long")).otherwise(F.greatest(capped + shift, F.lit(0)))

    copy = (bitrate > 0) & (bitrate < target + 700) & is_hevc & F.lit(not crop)
    return F.struct(pick(0.7, 0).alias("target"), pick(0.6, -200).alias("least"), pick(0.8, 500).alias("most"), copy.alias("copy"))


def calibration_step(points: list[tuple[float, float]], goal: float, low: float, high: float) -> float:
    """The next quality value to try, given (quality, kbps) points: the middle of a bracket around the goal, else
    along the slope of the logarithm, within the bounds."""
    above = [q for q, kbps in points if kbps > goal]
    below = [q for q, kbps in points if kbps <= goal]
    if above and below:
        return (max(above) + min(below)) / 2
    if len(points) >= 2:
        (q1, k1), (q2, k2) = sorted(points)[:2] if above else sorted(points)[-2:]
        slope = (math.log(k2) - math.log(k1)) / (q2 - q1)
        if slope:
            return min(high, max(low, q1 + (math.log(goal) - math.log(k1)) / slope))
    q = points[-1][0] if points else (low + high) / 2
    return min(high, q + 4) if above else max(low, q - 4) if below else q


def best_quality(tested: dict[int, int], target: int, tolerance: float) -> int:
    """The tested quality value to use: the best one (the least value) within the tolerance, else the nearest."""
    under = [q for q, kbps in tested.items() if kbps <= int(target * (1 + tolerance))]
    return min(under) if under else min(tested, key=lambda q: (abs(tested[q] - target), q))


def best_tested(tests: Column, target: Column, tolerance: float) -> Column:
    """`best_quality` of array<struct<quality, kbps>>; null without a test."""
    under = F.transform(F.filter(tests, lambda x: x["kbps"] <= F.floor(target * (1 + tolerance))), lambda x: x["quality"])
    nearest = F.array_min(F.transform(tests, lambda x: F.struct(F.abs(x["kbps"] - target).alias("off"), x["quality"].alias("quality"))))
    return F.when(F.size(under) > 0, F.array_min(under)).otherwise(nearest["quality"])


# The units of sizes on the dashboard, and in the log.
DASHBOARD_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
LOG_UNITS = ("Bytes", "KB", "MB", "GB", "TB")


def _rounded(size: Column, step: int, places: int) -> Column:
    """size / step with so many decimal places, halves up, in integers."""
    scale = 10**places
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
    n = div(size, step) * scale + div(size % step * (2 * scale) + step, 2 * step)
    if not places:
        return n.cast("string")
    return F.concat(div(n, scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), places, "0"))


def _in_units(size: Column, units: tuple[str, ...], shown) -> Column:
    """`shown(step)` in the largest unit that the size reaches."""
    out = F.concat(shown(1), F.lit(f" {units[0]}"))
    for i, unit in enumerate(units[1:], 1):
        out = F.when(size >= 1024**i, F.concat(shown(1024**i), F.lit(f" {unit}"))).otherwise(out)
    return out


def display_bytes(size: Column) -> Column:
    """A size on the dashboard: two decimals below 10, one below 100, else none; nothing is 0 B."""
    size = size.cast("long")
    shown = lambda step: F.when(size < 10 * step, _rounded(size, step, 2)).when(size < 100 * step, _rounded(size, step, 1)).otherwise(_rounded(size, step, 0))
    return F.when(F.coalesce(size, F.lit(0)) <= 0, "0 B").otherwise(_in_units(size, DASHBOARD_UNITS, shown))


def log_bytes(size: Column) -> Column:
    """A size in the log: at most two decimals, no zeros at the end."""
    size = size.cast("long")
    shown = lambda step: F.regexp_replace(_rounded(size, step, 2), r"\.?0+$", "")
    return F.when(F.coalesce(size, F.lit(0)) <= 0, "0 Bytes").otherwise(_in_units(size, LOG_UNITS, shown))


def hours_minutes(seconds: Column) -> Column:
    """A duration in whole minutes; from 100 hours on in hours."""
    minutes = F.floor(seconds / 60).cast("long")
    hours, rest = F.floor(minutes / 60).cast("long"), minutes % 60
    text = F.when(hours == 0, F.concat(rest.cast("string"), F.lit("m"))).when(hours < 100, F.concat(hours.cast("string"), F.lit("h "), rest.cast("string"), F.lit("m")))
    return F.when(F.coalesce(seconds, F.lit(0)) <= 0, "0m").otherwise(text.otherwise(F.concat(hours.cast("string"), F.lit("h"))))


def ago(time: Column, now: Column) -> Column:
    """How long ago a time is; beyond a week the date, as month/day/year."""
    seconds = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(time.cast("timestamp"))) / 1_000_000).cast("long")
    out = F.date_format(time, "M/d/yyyy")
    for below, step, unit in ((86400 * 7, 86400, "d"), (86400, 3600, "h"), (3600, 60, "m"), (60, 1, "s")):
        out = F.when(seconds < below, F.concat(F.floor(seconds / step).cast("string"), F.lit(f"{unit} ago"))).otherwise(out)
    return out


def realtime(content: Column, encode: Column) -> Column:
    """Seconds of content for each second of encoding: one decimal below 10, else none; a dash where there is nothing."""
    times = content / encode
    one = F.format_string("%.1f", F.floor(times * 10 + 0.5) / 10)
    shown = F.concat(F.when(times < 10, one).otherwise(F.floor(times + 0.5).cast("string")), F.lit("×"))
    return F.when((F.coalesce(content, F.lit(0)) == 0) | (F.coalesce(encode, F.lit(0)) <= 0), "—").otherwise(shown)


def saved_share(original: Column, encoded: Column) -> Column:
    """The percentage saved, never below 0; a dash without an original size."""
    share = F.greatest(F.lit(0), F.floor((original - F.coalesce(encoded, F.lit(0))) / original * 100 + 0.5).cast("long"))
    return F.when(F.coalesce(original, F.lit(0)) <= 0, "—").otherwise(F.concat(share.cast("string"), F.lit("%")))
