"""Formats of raw texts by their first lines; never by a file's name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuewright.functions.metrics import fold
from cuewright.functions.timecode import strip
from cuewright.sources.lines import ARROW, physical_lines


def detect_format(text: str = "text") -> Column:
    """srt, ass or vtt by the first decisive one of the first 20 lines; null where none is."""

    def judge(line: Column) -> Column:
        s = strip(F.regexp_replace(line, "^﻿+", ""))
        low = fold(s)
        value = F.when(s.rlike(r"^\+?[0-9]+$"), s.try_cast("decimal(38,0)"))
        ass = s.startswith("[") & (low.contains("script info") | low.contains("v4 styles") | low.contains("events"))
        return F.when(s.startswith("WEBVTT"), "vtt").when(ass, "ass").when(s.contains(ARROW), "srt").when((value <= 4294967295) & F.col(text).contains(ARROW), "srt")

    return F.try_element_at(F.filter(F.transform(F.slice(physical_lines(text), 1, 20), judge), lambda x: x.isNotNull()), F.lit(1))


def forced_format(forced, text: str = "text") -> Column:
    """The forced format, if the text's own is recognised at all; else null."""
    own = detect_format(text)
    return F.when(own.isNotNull(), F.coalesce(forced if isinstance(forced, Column) else F.col(forced), own))
