"""Documents as text: cues are collected by document, in the order of seq. Line ends between the parts are eol, or those of
each document where cues and documents have a boolean column crlf and eol is None; texts stay as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions.metrics import event_tag, fold
from cuewright.functions.timecode import format_ass_time, format_srt_time, format_vtt_time


def joined(cues: DataFrame, line: Column) -> DataFrame:
    """doc_id, body: the lines of all cues."""
    rows = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return cues.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "").alias("body"))


def line_end(eol: str | None) -> Column:
    return F.when(F.col("crlf"), "\r\n").otherwise("\n") if eol is None else F.lit(eol)


def render_srt(cues: DataFrame, eol: str | None = "\n") -> DataFrame:
    """doc_id, text: number, times, text and a blank line for each cue."""
    e = line_end(eol)
    line = F.concat(F.col("cue_no").cast("string"), e, format_srt_time("start_ms"), F.lit(" --> "), format_srt_time("end_ms"), e, F.col("text"), e, e)
    return joined(cues, line).select("doc_id", F.col("body").alias("text"))


def header_lines(headers: Column, eol: Column) -> Column:
    return F.array_join(F.transform(headers, lambda h: F.concat(h["name"], F.lit(": "), h["value"], eol)), "")


def render_vtt(cues: DataFrame, headers: DataFrame | None = None, eol: str | None = "\n") -> DataFrame:
    """doc_id, text; headers: doc_id, headers (array of name and value), of documents with cues; a null eol needs them."""
    e = line_end(eol)
    line = F.concat(format_vtt_time("start_ms"), F.lit(" --> "), format_vtt_time("end_ms"), e, F.col("text"), e, e)
    out, head = joined(cues, line), F.lit("")
    if headers is not None:
        out, head = out.join(headers.select("doc_id", "headers", *(["crlf"] if eol is None else [])), "doc_id", "left"), F.coalesce(header_lines(F.col("headers"), e), F.lit(""))
    return out.select("doc_id", F.concat(F.lit("WEBVTT"), e, head, e, F.col("body")).alias("text"))


def event_value(name: Column) -> Column:
    """The value of a cue for a column of an Events section; unknown columns are empty."""
    kinds = {"layer": F.col("layer").cast("string"), "start": format_ass_time("start_ms"), "end": format_ass_time("end_ms"), "style": F.coalesce("style", F.lit("")), "name": F.coalesce("speaker", F.lit("")), "marginl": F.col("margin_l").cast("string"), "marginr": F.col("margin_r").cast("string"), "marginv": F.col("margin_v").cast("string"), "effect": F.col("effect"), "text": F.col("text")}
    out, key = F.lit(""), fold(name)
    for k, v in kinds.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def render_ass(cues: DataFrame, documents: DataFrame, eol: str | None = "\n") -> DataFrame:
    """doc_id, text; documents: doc_id, headers, style_format, event_format, styles (array of arrays of fields)."""
    e = line_end(eol)
    rows = cues.join(documents.select("doc_id", "event_format"), "doc_id")
    line = F.concat(event_tag("event_kind"), F.lit(": "), F.array_join(F.transform("event_format", event_value), ","), e)
    looks = F.transform("styles", lambda fields: F.concat(F.lit("Style: "), F.array_join(F.transform("style_format", lambda k: style_value(fields, k)), ","), e))
    out = documents.join(joined(rows, line), "doc_id", "left")
    text = F.concat(
        F.lit("[Script Info]"), e, header_lines(F.col("headers"), e), e, F.lit("[V4+ Styles]"), e, F.lit("Format: "), F.array_join("style_format", ", "), e, F.array_join(looks, ""), e,
        F.lit("[Events]"), e, F.lit("Format: "), F.array_join("event_format", ", "), e, F.coalesce("body", F.lit("")),
    )
    return out.select("doc_id", text.alias("text"))


def style_value(fields: Column, name: Column) -> Column:
    hit = F.filter(fields, lambda f: fold(f["name"]) == fold(name))
    return F.coalesce(F.get(hit, F.lit(0))["value"], F.lit(""))
