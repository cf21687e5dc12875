"""Timed-text tables derived from the given ones, by integer arithmetic only. The SQL runs alike in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CUES = """
SELECT conv_id AS doc_id, turn AS seq, CAST(turn + 1 AS BIGINT) AS cue_no, start_ms,
       CASE WHEN start_ms + dur_ms < 0 THEN 0 ELSE start_ms + dur_ms END AS end_ms,
       text, style, speaker, 0 AS margin_l, 0 AS margin_r, margin_v, effect, layer, event_kind
FROM (SELECT conv_id, turn, text,
        CASE WHEN turn * 2600 + h % 700 - (CASE WHEN h % 10 = 3 THEN 4000 ELSE 0 END) < 0 THEN 0
             ELSE turn * 2600 + h % 700 - (CASE WHEN h % 10 = 3 THEN 4000 ELSE 0 END) END AS start_ms,
        CASE WHEN h % 13 = 0 THEN 0 WHEN h % 17 = 0 THEN -500
             ELSE 400 + (length(text) * 35 + h * 7) % 4200 END AS dur_ms,
        CASE h % 4 WHEN 0 THEN 'Default' WHEN 1 THEN 'ALTBASLIK' WHEN 2 THEN 'YokBoyleStil' END AS style,
        role AS speaker,
        CASE WHEN h % 29 = 0 THEN 40 ELSE 0 END AS margin_v,
        CASE WHEN h % 31 = 0 THEN 'Karaoke' ELSE '' END AS effect,
        CASE WHEN h % 37 = 0 THEN 1 ELSE 0 END AS layer,
        CASE WHEN h % 19 = 0 THEN 'comment' ELSE 'dialogue' END AS event_kind
      FROM (SELECT conv_id, turn, role, text, (conv_id * 7919 + turn * 104729) % 1000 AS h FROM {conversations}))
"""
CUES_DOCS = """
SELECT doc_id, seq, seq + 1 AS cue_no, start_ms,
       CASE WHEN start_ms + dur_ms < 0 THEN 0 ELSE start_ms + dur_ms END AS end_ms, text
FROM (SELECT doc_id, seq, text, seq * 3000 + h % 900 AS start_ms,
        CASE WHEN h % 41 = 0 THEN 0 WHEN h % 43 = 0 THEN -500
             ELSE 300 + (length(text) * 40 + h * 11) % 5000 END AS dur_ms
      FROM (SELECT doc_id, seq, text, (doc_id * 7919 + seq * 104729) % 1000 AS h FROM {lines}))
"""
LINES = "SELECT doc_id, CAST(i - 1 AS BIGINT) AS seq, string_split(text, chr(10))[i] AS text FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)"
LONG = "bigint"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CUES, conversations=read(spark, sf_dir, "conversations")).withColumns({c: F.col(c).cast(LONG) for c in ("start_ms", "end_ms")})


def cues_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text")).withColumn("seq", F.col("seq").cast(LONG))
    return spark.sql(CUES_DOCS, lines=lines)


def doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()


def styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two styles for documents whose id isn't a multiple of three."""
    two = F.array(*(F.struct(F.lit(i).alias("style_pos"), F.lit(n).alias("name")) for i, n in enumerate(("Default", "AltBaslik"))))
    rows = doc_ids(spark, sf_dir).where("doc_id % 3 <> 0").select("doc_id", F.explode(two).alias("s")).select("doc_id", "s.*")
    pair = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    return rows.withColumn("fields", F.array(pair("Name", F.col("name")), pair("Fontname", F.lit("Arial")), pair("Fontsize", F.lit("48"))))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, format, headers, style_format, event_format, styles of the derived documents."""
    from cuewright.operators.defaults import EVENT_FORMAT

    kinds = F.when(F.col("doc_id") % 3 == 0, "srt").when(F.col("doc_id") % 3 == 1, "ass").otherwise("vtt")
    pair = lambda k, v: F.struct(F.lit(k).alias("name"), F.lit(v).alias("value"))
    headers = F.when(F.col("doc_id") % 2 == 0, F.array(pair("Title", "t"), pair("ScriptType", "v4.00+"))).otherwise(F.array().cast("array<struct<name:string,value:string>>"))
    look = styles(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("style_pos", "fields"))), lambda x: x["fields"]).alias("styles"))
    out = doc_ids(spark, sf_dir).join(look, "doc_id", "left")
    return out.select("doc_id", kinds.alias("format"), headers.alias("headers"), F.array(*map(F.lit, ("Name", "Fontname", "Fontsize"))).alias("style_format"), F.array(*map(F.lit, EVENT_FORMAT)).alias("event_format"), F.coalesce("styles", F.array().cast("array<array<struct<name:string,value:string>>>")).alias("styles"))


def one_line(cues: DataFrame) -> DataFrame:
    """cues whose texts have no line end, as ASS events need."""
    return cues.withColumn("text", F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds for every other document, some of them missing."""
    return doc_ids(spark, sf_dir).where("doc_id % 2 = 0").select("doc_id", F.lit(30.0).alias("okuma_hizi"), F.lit(500).cast(LONG).alias("asgari_dinlenme_ms"), F.lit(12.0).alias("asgari_hiz"), F.when(F.col("doc_id") % 4 == 0, 60).alias("en_fazla_karakter"), F.lit(2000).cast(LONG).alias("kabul_edilebilir_bosluk_ms"))


def raw_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuewright.operators.render import render_srt

    return render_srt(cues(spark, sf_dir))


def raw_vtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuewright.operators.render import render_vtt

    return render_vtt(cues(spark, sf_dir), documents(spark, sf_dir))


def raw_ass(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuewright.operators.render import render_ass

    return render_ass(one_line(cues(spark, sf_dir)), documents(spark, sf_dir))


#: What Latin-1 can't hold, and some more, becomes an e before a text is encoded in single bytes.
NOT_LATIN = "[^\\x00-\\x7fà-ÿ]"


def damaged() -> Column:
    """The text with a stray last line, for some documents, and for others a number that announces no cue."""
    return F.concat(F.col("text"), F.when(F.col("doc_id") % 11 == 4, "stray\n").when(F.col("doc_id") % 11 == 6, "99\n").otherwise(""))


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content: the conversations as SRT, ASS or VTT files by doc_id. Some have CR LF line ends (every second), some are
    damaged, some are UTF-16 (7k + 3), some have a mark (7k + 5), some are single-byte (7k + 1), and some single-byte with one
    more line in UTF-8 (7k + 2)."""
    own = None
    for f, k in ((raw_srt, 0), (raw_ass, 1), (raw_vtt, 2)):
        part = f(spark, sf_dir).where(F.col("doc_id") % 3 == k)
        own = part if own is None else own.unionByName(part)
    ends = lambda x: F.when(F.col("doc_id") % 2 == 0, F.replace(x, F.lit("\n"), F.lit("\r\n"))).otherwise(x)
    text, kind = ends(damaged()), F.col("doc_id") % 7
    utf8, wide = F.encode(text, "UTF-8"), F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))
    latin = F.encode(F.regexp_replace(text, NOT_LATIN, "e"), "ISO-8859-1")
    content = F.when(kind == 1, latin).when(kind == 2, F.concat(latin, F.encode(ends(F.lit("é\n")), "UTF-8"))).when(kind == 3, wide).when(kind == 5, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).otherwise(utf8)
    return own.select("doc_id", content.alias("content"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content: texts in UTF-8, UTF-8 with a mark, single-byte and mixed encodings, by doc_id."""
    text = F.encode("text", "UTF-8")
    latin = F.encode(F.regexp_replace("text", NOT_LATIN, "e"), "ISO-8859-1")
    kind = F.col("doc_id") % 4
    content = F.when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), text)).when(kind == 2, latin).when(kind == 3, F.concat(F.encode(F.lit("é\n"), "UTF-8"), latin)).otherwise(text)
    return read(spark, sf_dir, "documents").select("doc_id", content.alias("content"))


def wide_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content: texts in UTF-16, little-endian for even ids, with a lone first surrogate before the text (3k + 1), or a
    lone second one after it (3k + 2), and one more byte (5k)."""
    lone = F.when(F.col("doc_id") % 3 == 1, "D83D").when(F.col("doc_id") % 3 == 2, "DE00")
    little = F.col("doc_id") % 2 == 0
    lone = F.coalesce(F.unhex(F.when(little, F.concat(F.substring(lone, 3, 2), F.substring(lone, 1, 2))).otherwise(lone)), F.unhex(F.lit("")))
    text = F.when(little, F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "UTF-16BE"))
    body = F.when(F.col("doc_id") % 3 == 1, F.concat(lone, text)).otherwise(F.concat(text, lone))
    odd = F.unhex(F.when(F.col("doc_id") % 5 == 0, "41").otherwise(""))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.unhex(F.when(little, "FFFE").otherwise("FEFF")), body, odd).alias("content"))
