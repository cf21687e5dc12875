"""SRT: cues and syntax errors of raw texts, without failing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cuewright.sources.parse import parsed_as


def parse(raw: DataFrame, chunk: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cues, syntax errors) of raw (doc_id, text)."""
    out = parsed_as(raw, "srt", chunk)
    return out.cues, out.syntax_errors
