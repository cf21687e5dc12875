"""WebVTT: cues, headers and syntax errors of raw texts, without failing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cuewright.sources.parse import parsed_as


def parse(raw: DataFrame, chunk: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cues, headers, syntax errors) of raw (doc_id, text); headers: doc_id, pos, name, value."""
    out = parsed_as(raw, "vtt", chunk)
    return out.cues, out.headers, out.syntax_errors
