"""Texts of notifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spaced(name: Column) -> Column:
    """"EncodeCompleted" as "Encode Completed"."""
    return F.regexp_replace(name, r"(?<=[a-z])([A-Z])", " $1")


def shortened(text: Column, most: int = 4096) -> Column:
    """The text, or its beginning and an ellipsis if it is too long."""
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def channel(url: Column) -> Column:
    """Which kind of service a notification URL is for."""
    low = F.lower(url)
    return F.when(low.rlike("^apprises?://"), "apprise").when(url.contains("/ntfy.") | url.contains("ntfy.sh"), "ntfy").otherwise("webhook")


def number(value: Column) -> Column:
    """A number with six decimals at most and no trailing zeros."""
    text = F.call_function("format_number", value, F.lit("0.######"))
    return F.regexp_replace(text, r"\\.$", "")
