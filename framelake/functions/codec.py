"""Codec names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Aliases of codec names.
ALIASES = {
    "h265": ("hevc", "h.265", "h265", "x265"),
    "h264": ("avc", "avc1", "h.264", "h264", "x264"),
    "av1": ("av01", "av1"),
}
# Lossy music codecs, and the lossless encoder.
LOSSY_MUSIC = ("mp3", "aac", "ac3", "eac3", "opus", "vorbis", "wma", "wmav2")
LOSSLESS_MUSIC = ("flac",)


def normalize(codec: Column) -> Column:
    """h264, h265 or av1 for their aliases, else the trimmed lower-case name; null is empty."""
    name = F.lower(F.trim(F.coalesce(codec, F.lit(""))))
    out = name
    for canonical, aliases in ALIASES.items():
        out = F.when(name.isin(*aliases), F.lit(canonical)).otherwise(out)
    return out


def normalize_text(codec: str | None) -> str:
    name = (codec or "").strip().lower()
    return next((c for c, aliases in ALIASES.items() if name in aliases), name)


def source_label(codec: Column, is_hevc: Column) -> Column:
    """The codec of a file for display: an empty one is h265 if the file is known as HEVC, else unknown."""
    name = normalize(codec)
    return F.when(name != "", name).when(is_hevc, F.lit("h265")).otherwise(F.lit("unknown"))


def rank(codec: Column, is_hevc: Column) -> Column:
    """Efficiency: av1 3, hevc 2, h264 1, others 0."""
    name = F.lower(F.coalesce(codec, F.lit("")))
    return F.when(name == "av1", 3).when(is_hevc, 2).when(name.isin("h264", "avc"), 1).otherwise(0)


def meets_target(codec: Column, is_hevc: Column, encoder: str) -> Column:
    """Whether the source is at least as efficient as what the encoder makes."""
    e = encoder.lower()
    return rank(codec, is_hevc) >= (3 if "av1" in e or "svt" in e else 2 if "265" in e else 1)


# The software encoder of a codec (of all others the one of h265), and what names of encoders say of the
# device that they run on.
SOFTWARE = {"av1": "libsvtav1", "h264": "libx264"}
DEVICES = {"nvenc": "nvidia", "qsv": "intel", "amf": "amd", "videotoolbox": "apple"}


def software_encoder(codec: Column) -> Column:
    """The software encoder of a codec as it is spelt, whatever its case."""
    name = F.lower(codec)
    return F.when(name == "av1", SOFTWARE["av1"]).when(name == "h264", SOFTWARE["h264"]).otherwise("libx265")


def encoder_codec(encoder: Column) -> Column:
    """The codec that an encoder's name tells, or null."""
    name = F.lower(F.trim(encoder))
    return F.when(name.contains("av1") | name.contains("rav1e"), "av1").when(name.contains("265") | name.contains("hevc"), "h265").when(name.contains("264") | name.contains("avc"), "h264")


def encoder_device(encoder: str) -> str:
    """The device that an encoder's name tells; the CPU for all others."""
    name = encoder.lower()
    for part, device in DEVICES.items():
        if part in name:
            return device
    return ("amd" if "amd" in name else "intel") if "vaapi" in name else "cpu"
