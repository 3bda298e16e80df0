"""Clock times, durations and schedule windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def minutes(clock: Column) -> Column:
    """Minutes since midnight of "HH:mm"; null if it isn't a time of day."""
    parts = F.split(clock, ":")
    h, m = F.get(parts, 0).try_cast("int"), F.get(parts, 1).try_cast("int")
    return F.when((F.size(parts) == 2) & h.between(0, 23) & m.between(0, 59), h * 60 + m)


def within(windows: Column, now: Column) -> Column:
    """Whether a moment lies in any window of array<struct<days, start, end>>. No windows: always. No days, or a
    malformed time: never. Equal ends: the whole day. An end before its start reaches into the next day."""
    names = F.array(*[F.lit(d) for d in DAYS])
    today = F.element_at(names, F.dayofweek(now))
    yesterday = F.element_at(names, F.pmod(F.dayofweek(now) - 2, F.lit(7)) + 1)
    at = F.hour(now) * 60 + F.minute(now)

    def holds(w: Column) -> Column:
        start, end = minutes(w["start"]), minutes(w["end"])
        on = F.array_contains(w["days"], today)
        hit = F.when(start == end, on).when(start < end, on & (at >= start) & (at < end)).otherwise((on & (at >= start)) | (F.array_contains(w["days"], yesterday) & (at < end)))
        return F.coalesce(start.isNotNull() & end.isNotNull() & (F.size(w["days"]) > 0) & hit, F.lit(False))

    return F.when(windows.isNull() | (F.size(windows) == 0), True).otherwise(F.exists(windows, holds))


def seconds(text: Column) -> Column:
    """Seconds of "h:m:s.f", or of a plain number; 0 if it is neither."""
    parts = F.split(text, ":")
    h, m, s = (F.get(parts, i).try_cast("double") for i in range(3))
    return F.coalesce(F.when(F.size(parts) == 3, h * 3600 + m * 60 + s).when(F.size(parts) == 1, text.try_cast("double")), F.lit(0.0))


def clock(seconds_: Column) -> Column:
    """HH:MM:SS of whole seconds."""
    s = F.floor(seconds_).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(s / 3600)
    return F.concat_ws(":", F.when(hours > 99, hours.cast("string")).otherwise(two(hours)), two(F.floor(s / 60) % 60), two(s % 60))


def plausible_output(source: Column, output: Column) -> Column:
    """Whether an output's length fits its source: unknown, or less than 30 s or 1 % apart."""
    return (output <= 0) | (F.abs(source - output) < F.greatest(F.lit(30.0), source * 0.01))
