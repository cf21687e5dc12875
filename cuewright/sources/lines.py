"""Lines of raw texts, as the parsers see them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARROW = "-->"


def clean(x) -> Column:
    """Without white space (Unicode) at the right end."""
    return F.regexp_replace(F.col(x) if isinstance(x, str) else x, r"(?U)\s+$", "")


def physical_lines(text="text") -> Column:
    """The lines of a text; a final line end adds none."""
    parts = F.split(F.col(text), "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, "\r$", ""))


def time_line(line: str = "l") -> tuple[Column, Column, Column]:
    """(start_ms, end_ms, error) of a line with an arrow. The error names what is wrong; times that can't be read are 0."""
    from cuewright.functions.timecode import parse_timestamp

    parts = F.split(F.col(line), ARROW, -1)
    first = lambda x: F.regexp_extract(x, r"(?U)^\s*(\S+)", 1)
    left, right = first(parts[0]), first(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    zero, start, end = F.lit(0).cast("bigint"), parse_timestamp(left), parse_timestamp(right)
    both = (left != "") & (right != "")
    error = (
        F.when(~both, "zaman cizgisinin iki tarafi da dolu olmali")
        .when(start.isNull(), F.concat(F.lit("baslangic zamani okunamadi: "), left))
        .when(end.isNull(), F.concat(F.lit("bitis zamani okunamadi: "), right))
    )
    good = both & start.isNotNull()
    return F.when(good, start).otherwise(zero), F.when(good & end.isNotNull(), end).otherwise(zero), error
