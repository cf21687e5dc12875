"""Conversion between formats, and what it loses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.operators import render
from cuewright.operators.defaults import EVENT_FORMAT, STYLE, STYLE_FORMAT
from cuewright.sources.parse import Parsed

LONG = "bigint"


def loss(feature: str, value: Column | str, reason: str) -> Column:
    return F.struct(F.lit(feature).alias("feature"), (F.lit(value) if isinstance(value, str) else value).alias("value"), F.lit(reason).alias("reason"))


def loss_report(documents: DataFrame, cues: DataFrame, styles: DataFrame, *targets: str) -> DataFrame:
    """doc_id, target, loss_pos, feature, value, reason for each feature that a target doesn't carry, for all targets in one
    pass. documents: doc_id, headers (array). Texts are fixed values."""
    own = cues.groupBy("doc_id").agg(
        F.min_by("style", F.when(F.col("style").isNotNull(), F.col("seq"))).alias("style"),
        F.count("style").alias("styled"),
        F.max((F.col("effect") != "") | (F.col("margin_v") != 0)).alias("margins"),
        F.max(F.col("event_kind") == "comment").alias("comments"),
        F.max(F.col("layer") != 0).alias("layers"),
    )
    tables = styles.groupBy("doc_id").agg(F.count("*").alias("n_styles"))
    rows = documents.select("doc_id", F.size("headers").alias("n_headers")).join(own, "doc_id", "left").join(tables, "doc_id", "left")
    n_styles, styled = F.coalesce("n_styles", F.lit(0).cast(LONG)), F.coalesce("styled", F.lit(0).cast(LONG)) > 0
    headers = lambda reason: F.when(F.col("n_headers") > 0, loss("baslik bloklari", F.format_string("%d alan", "n_headers"), reason))
    looks = lambda reason: F.when(n_styles > 0, loss("ASS stiller", F.format_string("%d stil", n_styles), reason))
    first = lambda reason: F.when(styled, loss("replik stili", F.col("style"), reason))
    edges = lambda reason: F.when(F.col("margins"), loss("kenar bosluklari ve efekt", "MarginL/MarginR/MarginV/Effect", reason))
    hidden = lambda reason: F.when(F.col("comments"), loss("Comment satirlari", "gizli replikler", reason))
    lost = {
        "srt": [looks("SRT stil tasimaz; metin ve zamanlama korunur"), first("SRT stil tasimaz"), edges("SRT bu alanlari icermez"), headers("SRT baslik bolumu tanimlamaz"), hidden("SRT yorum satiri icermez; tumu normal replige donustu")],
        "vtt": [looks("WebVTT `STYLE` blogu kullanilir, ASS `Style:` tablosu degil"), first("WebVTT replik ici stil tasimaz; CSS sinifi kullanilir"), edges("WebVTT cue ayarlari kenar boslugu icermez"), hidden("WebVTT `NOTE` blogu kullanilir; icerik replik olarak tasindi")],
        "ass": [
            headers("ASS `Script Info` blogu varsayilan degerlerle yeniden uretildi"),
            F.when(n_styles == 0, loss("stil tablosu", "yok", "kaynak bicim stil tasimiyor; `Default` stili uretildi")),
            F.when(~styled, loss("replik stili", "yok", "kaynak belgede replik stili yok; tumu `Default` stiline baglandi")).when(n_styles == 0, loss("replik stili", "stil adlari", "kaynak belgede stil tablosu yok; `Default` stili uretildi")),
            F.when(F.col("layers"), loss("replik katmani", "Layer", "SRT ve WebVTT katman bilgisi tasimaz")),
        ],
    }
    every = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.array_compact(F.array(*lost[t])).alias("losses")) for t in targets)))
    rows = rows.select("doc_id", every.alias("t")).select("doc_id", "t.target", F.posexplode("t.losses").alias("loss_pos", "l"))
    return rows.select("doc_id", "target", F.col("loss_pos").cast("int").alias("loss_pos"), "l.*")


def convert_report(losses: DataFrame, cues: DataFrame, target: str) -> DataFrame:
    """doc_id, target, n_cues, losses (feature, value, reason, in order) of documents with cues or losses; losses as
    loss_report() gives them for that target."""
    lost = losses.where(F.col("target") == target).select("doc_id", F.lit(0).cast(LONG).alias("n"), F.struct("loss_pos", "feature", "value", "reason").alias("l"))
    rows = lost.unionByName(cues.select("doc_id", F.lit(1).cast(LONG).alias("n"), F.lit(None).cast(lost.schema["l"].dataType).alias("l")))
    own = F.transform(F.array_sort(F.collect_list("l")), lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"), x["reason"].alias("reason")))
    return rows.groupBy("doc_id").agg(F.sum("n").alias("n_cues"), own.alias("losses")).select("doc_id", F.lit(target).alias("target"), "n_cues", "losses")


def script_info(source: str | Column, title: str = "untitled") -> Column:
    """The header fields of a new ASS document; title is the caller's."""
    source = F.lit(source) if isinstance(source, str) else source
    vtt = source == "vtt"
    fields = [("Title", F.lit(title)), ("ScriptType", F.lit("v4+")), ("WrapStyle", F.lit("0")), ("PlayResX", F.when(vtt, "1920").otherwise("384")), ("PlayResY", F.when(vtt, "1080").otherwise("288")), ("ScaledBorderAndShadow", F.lit("yes"))]
    return F.array(*(F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in fields))


def convert_cues(cues: DataFrame, target: str) -> DataFrame:
    """Cues are copied; in ASS a cue without a style gets `Default`."""
    return cues.withColumn("style", F.coalesce("style", F.lit("Default"))) if target == "ass" else cues


def convert_documents(documents: DataFrame, target: str, title: str = "untitled") -> DataFrame:
    """doc_id, format, headers, style_format, event_format, styles of converted documents (doc_id, format)."""
    empty = F.array().cast("array<struct<name:string,value:string>>")
    names = lambda x: F.array(*map(F.lit, x)) if target == "ass" else F.array().cast("array<string>")
    style = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(v).alias("value")) for k, v in STYLE)) if target == "ass" else empty
    headers = script_info(F.col("format"), title) if target == "ass" else empty
    return documents.select("doc_id", F.lit(target).alias("format"), headers.alias("headers"), names(STYLE_FORMAT).alias("style_format"), names(EVENT_FORMAT).alias("event_format"), style.alias("style_fields"))


def convert_files(files: Parsed, target: str, title: str = "untitled") -> tuple[DataFrame, DataFrame]:
    """Files of mixed formats as documents of the target format, and what that loses: (doc_id, source, text) with each file's
    own line ends, and the loss report. Files of no known format are left out."""
    documents = files.documents.where("format is not null")
    ends = documents.select("doc_id", "crlf")
    cues = convert_cues(files.cues, target).join(ends, "doc_id")
    new = convert_documents(documents, target, title).join(ends, "doc_id").withColumn("styles", F.array("style_fields") if target == "ass" else F.array().cast("array<array<struct<name:string,value:string>>>"))
    texts = {"srt": lambda: render.render_srt(cues, None), "vtt": lambda: render.render_vtt(cues, new, None), "ass": lambda: render.render_ass(cues, new, None)}[target]()
    e = F.when(F.col("crlf"), "\r\n").otherwise("\n")
    empty = {"srt": F.lit(""), "vtt": F.concat(F.lit("WEBVTT"), e, e), "ass": F.lit("")}[target]
    out = documents.select("doc_id", F.col("format").alias("source"), "crlf").join(texts, "doc_id", "left")
    return out.select("doc_id", "source", F.coalesce("text", empty).alias("text")), loss_report(documents, files.cues, files.styles, target)
