"""ASS/SSA: events, styles, headers and syntax errors of raw texts, without failing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions.metrics import fold
from cuewright.sources.parse import parsed_as


def parse(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cues, styles, headers, syntax errors) of raw (doc_id, text)."""
    out = parsed_as(raw, "ass")
    return out.cues, out.styles, out.headers, out.syntax_errors


def script_type(fields) -> Column:
    """The header ScriptType, or the text for its absence (a fixed value)."""
    hit = F.filter(F.col(fields) if isinstance(fields, str) else fields, lambda f: fold(f["name"]) == "scripttype")
    return F.coalesce(F.get(hit, F.lit(0))["value"], F.lit("v4+ (belirtilmemis)"))
