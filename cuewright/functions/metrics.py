"""Measures of a cue: columns start_ms, end_ms, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuewright.functions.timecode import col


def duration() -> Column:
    return F.col("end_ms") - F.col("start_ms")


def timing_valid() -> Column:
    return duration() >= 0


def characters(text="text") -> Column:
    """Code points without line ends."""
    return F.length(F.replace(col(text), F.lit("\n"), F.lit(""))).cast("bigint")


def lines(text="text") -> Column:
    """The lines of a text; an empty text has none."""
    return F.when(col(text) == "", F.array().cast("array<string>")).otherwise(F.split(col(text), "\n"))


def line_count(text="text") -> Column:
    return F.size(lines(text)).cast("bigint")


def longest_line(text="text") -> Column:
    return F.coalesce(F.array_max(F.transform(lines(text), F.length)), F.lit(0)).cast("bigint")


def reading_speed() -> Column:
    """Characters a second; 0 where the duration isn't positive."""
    return F.when(duration() <= 0, F.lit(0.0)).otherwise(characters() / (duration() / F.lit(1000.0)))


def required_ms(least_ms, speed) -> Column:
    """The least duration that a cue's characters need."""
    wanted = F.when(speed <= 0, F.lit(0).cast("bigint")).otherwise(F.ceil(characters() / speed * F.lit(1000.0)).cast("bigint"))
    return F.greatest(least_ms, wanted)


def one_decimal(x: Column) -> Column:
    """One decimal, half to even on the binary value, no thousands separators."""
    return F.call_function("format_number", x, F.lit("0.0"))


def fold(x) -> Column:
    """A-Z as a-z and nothing else."""
    return F.translate(col(x), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def format_name(x) -> Column:
    """The canonical name of a format alias, or null."""
    x = fold(F.trim(col(x)))
    return F.when(x.isin("srt", "subrip"), "srt").when(x.isin("ass", "ssa", "ssa1"), "ass").when(x.isin("vtt", "webvtt"), "vtt")


def event_kind(tag) -> Column:
    """comment for `Comment` in any case, else dialogue."""
    return F.when(fold(F.trim(col(tag))) == "comment", "comment").otherwise("dialogue")


def event_tag(kind) -> Column:
    return F.when(col(kind) == "comment", "Comment").otherwise("Dialogue")


def field(fields, name: str) -> Column:
    """The value of the first field of that name (A-Z fold), or ''."""
    hit = F.filter(col(fields), lambda f: fold(f["name"]) == name.lower())
    return F.coalesce(F.get(hit, F.lit(0))["value"], F.lit(""))


def with_field(fields, name: str, value: str) -> Column:
    """fields with the first of that name set, or the field appended."""
    has = F.exists(col(fields), lambda f: fold(f["name"]) == name.lower())
    at = F.array_position(F.transform(col(fields), lambda f: fold(f["name"])), name.lower())
    new = F.struct(F.lit(name).alias("name"), F.lit(value).alias("value"))
    put = F.transform(col(fields), lambda f, i: F.when(i + 1 == at, F.struct(f["name"].alias("name"), F.lit(value).alias("value"))).otherwise(f))
    return F.when(has, put).otherwise(F.concat(col(fields), F.array(new)))
