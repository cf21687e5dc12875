"""The registered queries of the timed-text operators: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.functions import metrics as m
from cuewright.functions import timecode as t
from cuewright.operators import convert as c
from cuewright.operators import render, report, retime, rules
from cuewright.operators.compare import differences
from cuewright.plans import derived as d
from cuewright.sources import ass, io, srt, vtt
from cuewright.sources.decode import bad_sequences, bom, decoded, healthy, line_kinds
from cuewright.sources.detect import detect_format, forced_format
from cuewright.sources.ledger import Collection
from cuewright.sources.parse import Parsed, parse_files, recognised

LONG = "bigint"
PAL, NTSC = (25, 1), (24000, 1001)
CORE = ["doc_id", "seq", "cue_no", "start_ms", "end_ms", "text"]
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def findings(spark, sf_dir, **more) -> DataFrame:
    return rules.check(d.cues(spark, sf_dir), **more)


def report_of(spark, sf_dir) -> DataFrame:
    """Whole reports of files of mixed formats and encodings, some damaged, with profiles for every other one."""
    return report.check_report(parse_files(recognised(d.mixed_files(spark, sf_dir))).rows, profiles=d.profiles(spark, sf_dir))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset the warehouse, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (found or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def parsed_files(spark: SparkSession, sf_dir: str) -> Parsed:
    """Files of mixed formats and encodings, written, decoded and parsed once."""
    return parse_files(recognised(d.mixed_files(spark, sf_dir))).saved(f"{shared_folder(spark)}/parsed-{uuid.uuid4().hex}")


# Sources and sinks


@query
def read_files(spark, sf_dir):
    """Files are written under their own names, read back as bytes by a ledger, decoded, detected and parsed."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    io.write_text_files(d.raw_srt(spark, sf_dir), path, "srt")
    own = Collection(spark, f"{path}-own")
    own.ingest(path, "*.srt")
    cues = own.parsed().cues.groupBy("doc_id").agg(F.count("*").alias("n_cues"))
    return own.files().join(cues, "doc_id", "left").select(name_of("srt"), "format", "encoding.encoding", F.length("text").cast(LONG).alias("n_chars"), "n_cues")


def name_of(form: str):
    """The number that a file is named by."""
    return F.regexp_extract("path", rf"([0-9]+)\.{form}$", 1).cast(LONG).alias("doc_id")


@query
def read_parsed(spark, sf_dir):
    """Files of all formats, some damaged, written one each and read by a ledger; a second run finds nothing new."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    rows = [f(spark, sf_dir).where(F.col("doc_id") % 3 == k).select("doc_id", d.damaged().alias("text"), F.lit(x).alias("format")) for f, k, x in ((d.raw_srt, 0, "srt"), (d.raw_ass, 1, "ass"), (d.raw_vtt, 2, "vtt"))]
    io.write_text_files(reduce(DataFrame.unionByName, rows), path)
    own = Collection(spark, f"{path}-own")
    own.ingest(path, "*.{srt,ass,vtt}")
    again = own.ingest(path, "*.{srt,ass,vtt}")
    rows = own.parsed().rows.groupBy("doc_id").agg(F.first("document", ignorenulls=True).alias("d"), F.count("cue").alias("n_cues"), F.count("style").alias("n_styles"), F.count("error").alias("n_syntax"))
    return rows.select("d.path", "d.format", "n_cues", "n_styles", "n_syntax").select(name_of("[a-z]+"), "format", "n_cues", "n_styles", "n_syntax", F.lit(again is None).alias("read_once"))


def mixed_raw(spark, sf_dir) -> DataFrame:
    """doc_id, text: SRT, VTT, ASS renderings and plain texts, by doc_id."""
    own = [(d.raw_srt, 0), (d.raw_ass, 1), (d.raw_vtt, 2)]
    out = d.read(spark, sf_dir, "documents").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "text")
    for f, k in own:
        out = out.unionByName(f(spark, sf_dir).where(F.col("doc_id") % 3 == k))
    return out


@query
def detect_format_(spark, sf_dir):
    return mixed_raw(spark, sf_dir).select("doc_id", detect_format().alias("format"))


@query
def force_format(spark, sf_dir):
    forced = F.when(F.col("doc_id") % 5 == 0, "vtt")
    return mixed_raw(spark, sf_dir).select("doc_id", forced_format(forced).alias("format"))


@query
def forced_files(spark, sf_dir):
    """Some SRT files read as WebVTT and some WebVTT files as SRT; plain texts stay rejected whatever is forced."""
    own, plain = F.col("doc_id") % 3, F.col("doc_id") >= 1_000_000_000
    forced = F.when(plain | ((own == 0) & (F.col("doc_id") % 5 == 0)), "vtt").when((own == 2) & (F.col("doc_id") % 5 == 1), "srt")
    files = mixed_raw(spark, sf_dir).withColumn("format", forced_format(forced))
    return parse_files(files).rows.groupBy("doc_id").agg(F.first("document.format", ignorenulls=True).alias("format"), F.count("cue").alias("n_cues"), F.coalesce(F.sum("cue.cue_no"), F.lit(0)).cast(LONG).alias("sum_no"), F.count("error").alias("n_syntax"))


@query
def parse_srt(spark, sf_dir):
    return srt.parse(d.raw_srt(spark, sf_dir))[0].select(*CORE)


@query
def parse_vtt(spark, sf_dir):
    return vtt.parse(d.raw_vtt(spark, sf_dir))[0].select(*CORE)


@query
def parse_ass_events(spark, sf_dir):
    return ass.parse(d.raw_ass(spark, sf_dir))[0]


@query
def parse_ass_styles(spark, sf_dir):
    rows = ass.parse(d.raw_ass(spark, sf_dir))[1]
    return rows.select("doc_id", "style_pos", "name", F.size("fields").cast(LONG).alias("n_fields"), m.field("fields", "fontsize").alias("fontsize"))


@query
def parse_headers(spark, sf_dir):
    own = vtt.parse(d.raw_vtt(spark, sf_dir))[1].withColumn("source", F.lit("vtt"))
    return own.unionByName(ass.parse(d.raw_ass(spark, sf_dir))[2].withColumn("source", F.lit("ass")))


@query
def syntax_errors(spark, sf_dir):
    """Plain texts read as each of the formats."""
    raw = d.read(spark, sf_dir, "documents").select("doc_id", "text")
    return srt.parse(raw)[1].unionByName(vtt.parse(raw)[2]).unionByName(ass.parse(raw)[3])


@query
def render_srt(spark, sf_dir):
    return d.raw_srt(spark, sf_dir)


@query
def render_vtt(spark, sf_dir):
    return d.raw_vtt(spark, sf_dir)


@query
def render_ass(spark, sf_dir):
    return d.raw_ass(spark, sf_dir)


@query
def write_documents(spark, sf_dir):
    path = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    io.write_documents(d.raw_vtt(spark, sf_dir), path)
    return spark.read.parquet(path).select("doc_id", F.length("text").cast(LONG).alias("n_chars"))


@query
def write_reports(spark, sf_dir):
    """Reports of checking, shifting, normalising and converting in one table, read back by path."""
    path, cues = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}", d.cues(spark, sf_dir)
    losses = c.loss_report(d.documents(spark, sf_dir), cues, d.styles(spark, sf_dir), "vtt")
    io.write_reports(path, check=report_of(spark, sf_dir), shift=retime.shift_report(cues, -1400), normalize=retime.normalize_report(retime.normalize(cues, PAL)), convert=c.convert_report(losses, cues, "vtt"))
    at = lambda p, kind="bigint": F.try_variant_get("report", p, kind)
    return io.read_reports(spark, path).select("doc_id", "kind", at("$.n_findings").alias("n_findings"), at("$.rule_counts[5].n").alias("n_encoding"), at("$.encoding.encoding", "string").alias("encoding"), at("$.affected").alias("affected"), at("$.renumbered").alias("renumbered"), at("$.losses[0].feature", "string").alias("first_loss"))


@query
def read_profile(spark, sf_dir):
    """Each profile as JSON text without its missing fields, read back with defaults."""
    own = d.profiles(spark, sf_dir)
    text = F.to_json(F.struct(*(x for x in own.columns if x != "doc_id")))
    return own.select("doc_id", io.parse_profile(text).alias("p")).select("doc_id", "p.*")


# Encodings


@query
def bom_sniff(spark, sf_dir):
    mark, length, note = bom("content")
    return d.files(spark, sf_dir).select("doc_id", mark.alias("encoding"), length.cast(LONG).alias("mark_bytes"), note.alias("note"))


@query
def decode_text(spark, sf_dir):
    return decoded(d.files(spark, sf_dir)).select("doc_id", F.length("text").cast(LONG).alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query
def decode_wide_text(spark, sf_dir):
    """Texts in UTF-16 of both orders, some with a lone surrogate or an odd last byte."""
    files = d.wide_files(spark, sf_dir)
    return decoded(files).select("doc_id", "encoding.encoding", "encoding.bad_seq", "encoding.fffd", F.length("text").cast(LONG).alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query
def bad_sequences_(spark, sf_dir):
    return d.files(spark, sf_dir).select("doc_id", bad_sequences(F.col("content")).alias("bad_seq"))


@query
def mixed_encoding(spark, sf_dir):
    good, other = line_kinds(F.col("content"))
    return d.files(spark, sf_dir).select("doc_id", good.alias("utf8_lines"), other.alias("single_byte_lines"), ((good > 0) & (other > 0)).alias("mixed"))


@query
def encoding_report(spark, sf_dir):
    rows = decoded(d.files(spark, sf_dir)).select("doc_id", "encoding.*", healthy().alias("healthy"))
    return rows.withColumn("notes", F.size("notes").cast(LONG))


# Scalars


@query
def parse_timestamp(spark, sf_dir):
    times = {"srt_ms": t.format_srt_time, "ass_ms": t.format_ass_time, "vtt_ms": t.format_vtt_time}
    return d.cues(spark, sf_dir).select("doc_id", "seq", *(t.parse_timestamp(f("start_ms")).alias(k) for k, f in times.items()))


@query
def format_srt_time(spark, sf_dir):
    return d.cues_docs(spark, sf_dir).select("doc_id", "seq", t.format_srt_time("start_ms").alias("shown"))


@query
def format_ass_time(spark, sf_dir):
    return d.cues_docs(spark, sf_dir).select("doc_id", "seq", t.format_ass_time("start_ms").alias("shown"))


@query
def format_vtt_time(spark, sf_dir):
    return d.cues_docs(spark, sf_dir).select("doc_id", "seq", t.format_vtt_time("start_ms").alias("shown"))


@query
def duration_text(spark, sf_dir):
    return d.cues_docs(spark, sf_dir).groupBy("doc_id").agg(t.duration_text(F.max("end_ms")).alias("duration"))


@query
def cue_metrics(spark, sf_dir):
    return d.cues(spark, sf_dir).select("doc_id", "seq", m.duration().alias("duration_ms"), m.characters().alias("n_chars"), m.line_count().alias("n_lines"), m.longest_line().alias("longest_line"), m.timing_valid().alias("valid"))


@query
def reading_speed(spark, sf_dir):
    return d.cues(spark, sf_dir).select("doc_id", "seq", m.reading_speed().alias("speed"))


@query
def required_duration(spark, sf_dir):
    return d.cues(spark, sf_dir).select("doc_id", "seq", m.required_ms(F.lit(1000).cast(LONG), F.lit(6.0)).alias("required_ms"))


@query
def fps_fraction(spark, sf_dir):
    """Rates from the documents' ids: tenths, and NTSC rates."""
    rate = F.when(F.col("doc_id") % 4 == 0, F.lit(23.976)).when(F.col("doc_id") % 4 == 1, F.lit(29.97)).otherwise((F.col("doc_id") % 1200) / F.lit(10.0))
    num, den = t.fps_columns(rate)
    return d.doc_ids(spark, sf_dir).select("doc_id", num.alias("num"), den.alias("den"))


@query
def frame_number(spark, sf_dir):
    return d.cues(spark, sf_dir).select("doc_id", "seq", t.frame_number("start_ms", *NTSC).alias("frame"))


@query
def frame_to_ms(spark, sf_dir):
    return d.cues(spark, sf_dir).select("doc_id", "seq", t.frame_to_ms("cue_no", *NTSC).alias("ms"))


@query
def snap_to_frame(spark, sf_dir):
    return d.cues(spark, sf_dir).select("doc_id", "seq", t.snap_to_frame("start_ms", *NTSC).alias("ntsc_ms"), t.snap_to_frame("end_ms", *PAL).alias("pal_ms"))


@query
def format_name(spark, sf_dir):
    alias = F.element_at(F.array(*map(F.lit, ("SubRip", " ssa", "WebVTT", "srt", "txt", "ASS"))), (F.col("turn") % 6 + 1).cast("int"))
    return d.read(spark, sf_dir, "conversations").select("conv_id", "turn", m.format_name(alias).alias("format"))


@query
def event_kind(spark, sf_dir):
    tag = F.when(F.col("event_kind") == "comment", F.when(F.col("seq") % 2 == 0, "COMMENT ").otherwise("Comment")).otherwise("Picture")
    own = m.event_kind(tag)
    return d.cues(spark, sf_dir).select("doc_id", "seq", own.alias("kind"), m.event_tag(own).alias("tag"))


@query
def style_field(spark, sf_dir):
    changed = m.with_field("fields", "FONTSIZE", "20")
    return d.styles(spark, sf_dir).select("doc_id", "name", m.field("fields", "fontname").alias("font"), m.field("fields", "none").alias("none"), F.get(F.filter(changed, lambda f: m.fold(f["name"]) == "fontsize"), F.lit(0))["value"].alias("size"), F.size(m.with_field("fields", "Bold", "1")).cast(LONG).alias("n_fields"))


@query
def script_type(spark, sf_dir):
    return d.documents(spark, sf_dir).select("doc_id", ass.script_type("headers").alias("script_type"))


# Rules


def rule(k: int, name: str, where: str = "true"):
    def run(spark, sf_dir):
        return findings(spark, sf_dir).where(F.col("rule") == rules.RULES[k]).where(where).select("doc_id", "severity", "cue_no", "related_cue_no", "line", "measured", "threshold", "message")

    QUERIES[name] = run


for _k, _name, _where in ((0, "rule_reading_speed", "true"), (1, "rule_min_duration", "true"), (2, "rule_line_length", "line > 0"), (2, "rule_line_count", "line = 0"), (3, "rule_overlap", "true"), (4, "rule_negative_or_zero", "threshold <> 'baslangic artan sirada'"), (4, "rule_order", "threshold = 'baslangic artan sirada'")):
    rule(_k, _name, _where)


@query
def rule_encoding(spark, sf_dir):
    rows = decoded(d.files(spark, sf_dir)).select("doc_id", F.explode(rules.encoding_findings()).alias("f")).select("doc_id", "f.*")
    return rows.select("doc_id", "severity", "measured", "threshold", "message")


# Joins


@query
def undefined_styles(spark, sf_dir):
    rows = report.undefined_styles(d.cues(spark, sf_dir), d.styles(spark, sf_dir))
    return rows.select("doc_id", F.array_join("styles", ",").alias("styles"))


@query
def check_with_profile(spark, sf_dir):
    rows = findings(spark, sf_dir, profiles=d.profiles(spark, sf_dir))
    return rows.groupBy("doc_id", "rule").agg(F.count("*").alias("n"), F.min("threshold").alias("threshold"))


@query
def shift_by_table(spark, sf_dir):
    control = d.doc_ids(spark, sf_dir).where("doc_id % 3 = 0").select("doc_id", (F.col("doc_id") * 37 % 5000 - 2500).alias("shift_ms"))
    return retime.shift_by_table(d.cues(spark, sf_dir), control).select("doc_id", "seq", "start_ms", "end_ms")


# Aggregations


@query
def doc_stats(spark, sf_dir):
    return report.doc_stats(d.documents(spark, sf_dir), d.cues(spark, sf_dir))


@query
def rule_summary(spark, sf_dir):
    return report.rule_summary(d.doc_ids(spark, sf_dir), findings(spark, sf_dir))


@query
def check_report(spark, sf_dir):
    joined = lambda name, of, by=";": F.array_join(F.transform(name, of), by).alias(name)
    found = joined("findings", lambda f: F.concat_ws("|", F.coalesce(f["cue_no"], F.lit(0)), f["line"], f["rule"], f["severity"], f["measured"], f["threshold"], f["message"]))
    limits = F.concat_ws("|", *(f"thresholds.{k}" for k in rules.KINDS)).alias("thresholds")
    wrong = joined("syntax_errors", lambda e: F.concat_ws("|", e["format"], e["line"], e["message"]))
    coding = [f"encoding.{c}" for c in ("encoding", "has_bom", "bad_seq", "fffd", "mixed", "single_byte_lines")]
    return report_of(spark, sf_dir).select("doc_id", "format", "crlf", "n_cues", "n_lines", "last_end_ms", *coding, limits, joined("rule_counts", lambda r: r["n"].cast("string"), "|"), "n_findings", "n_critical", found, F.array_join("styles", ",").alias("styles"), "n_syntax", wrong)


@query
def report_summary(spark, sf_dir):
    return report.report_summary(report_of(spark, sf_dir))


@query
def quality_gate(spark, sf_dir):
    return report.quality_gate(report_of(spark, sf_dir))


@query
def longest_cue(spark, sf_dir):
    return report.longest_cue(d.cues(spark, sf_dir)).select("doc_id", "cue_no", "n_chars")


# Retiming


@query
def shift_amount(spark, sf_dir):
    """Seconds to whole milliseconds, as a control table gives them."""
    seconds = (F.col("doc_id") % 4001 - 2000) / F.lit(16.0)
    return d.doc_ids(spark, sf_dir).select("doc_id", retime.round_away(seconds * F.lit(1000.0)).alias("shift_ms"))


@query
def shift_ms(spark, sf_dir):
    return retime.shift_ms(d.cues(spark, sf_dir), -1400).select("doc_id", "seq", "start_ms", "end_ms")


@query
def shift_report(spark, sf_dir):
    return retime.shift_report(d.cues(spark, sf_dir), -1400)


@query
def shift_percent(spark, sf_dir):
    return retime.shift_percent(d.cues(spark, sf_dir), -10.0).select("doc_id", "seq", "start_ms", "end_ms")


@query
def shift_percent_report(spark, sf_dir):
    """A share for each document, null for some."""
    share = F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 41 - 20) / F.lit(4.0))
    return retime.shift_percent_report(d.cues(spark, sf_dir), share)


@query
def normalize_snap(spark, sf_dir):
    return retime.snapped(d.cues(spark, sf_dir), NTSC).select("doc_id", "seq", "start_ms", "end_ms", "snapped")


@query
def normalize_sort(spark, sf_dir):
    return retime.by_start(d.cues(spark, sf_dir)).select("doc_id", "seq", "cue_no", "moved")


@query
def normalize_renumber(spark, sf_dir):
    odd = d.cues(spark, sf_dir).withColumn("cue_no", F.col("cue_no") + F.col("doc_id") % 2)
    return retime.renumbered(odd).select("doc_id", "seq", "cue_no", "numbered")


@query
def normalize_min_frame(spark, sf_dir):
    return retime.at_least_a_frame(d.cues(spark, sf_dir), PAL).select("doc_id", "seq", "start_ms", "end_ms")


@query
def normalize(spark, sf_dir):
    return retime.normalize_report(retime.normalize(d.cues(spark, sf_dir), PAL))


@query
def overlap_pairs(spark, sf_dir):
    return retime.overlap_pairs(d.cues_docs(spark, sf_dir))


# Conversion


@query
def loss_report(spark, sf_dir):
    return c.loss_report(d.documents(spark, sf_dir), d.cues(spark, sf_dir), d.styles(spark, sf_dir), "srt", "vtt", "ass")


@query
def convert(spark, sf_dir):
    cues = c.convert_cues(d.cues(spark, sf_dir), "ass").groupBy("doc_id").agg(F.count("*").alias("n_cues"), F.count_if(F.col("style") == "Default").alias("n_default"))
    own = c.convert_documents(d.documents(spark, sf_dir), "ass")
    return own.join(cues, "doc_id").select("doc_id", "format", F.size("style_format").cast(LONG).alias("n_style_fields"), F.size("event_format").cast(LONG).alias("n_event_fields"), "n_cues", "n_default")


@query
def convert_files(spark, sf_dir):
    """Files of mixed formats and encodings, some damaged, as SRT with their own line ends, and what that loses."""
    texts, losses = c.convert_files(parsed_files(spark, sf_dir), "srt")
    lost = F.transform(F.array_sort(F.collect_list(F.struct("loss_pos", "feature", "value"))), lambda x: F.concat_ws("=", x["feature"], x["value"]))
    losses = losses.groupBy("doc_id").agg(F.array_join(lost, ";").alias("losses"))
    return texts.join(losses, "doc_id", "left").select("doc_id", "source", F.length("text").cast(LONG).alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), F.coalesce("losses", F.lit("")).alias("losses"))


@query
def check_files(spark, sf_dir):
    """All six rules and the syntax errors of files of mixed formats and encodings, some damaged."""
    p = parsed_files(spark, sf_dir)
    found = rules.check(p.cues, documents=p.documents).groupBy("doc_id").agg(F.count("*").alias("n_findings"), F.count_if(F.col("severity") == rules.CRITICAL).alias("n_critical"), F.count_if(F.col("rule") == rules.RULES[5]).alias("n_encoding"))
    wrong = p.syntax_errors.groupBy("doc_id").agg(F.count("*").alias("n_syntax"))
    out = p.documents.join(found, "doc_id", "left").join(wrong, "doc_id", "left")
    n = {x: F.coalesce(x, F.lit(0).cast(LONG)) for x in ("n_findings", "n_critical", "n_encoding", "n_syntax")}
    return out.select("doc_id", "format", "crlf", "encoding.encoding", *(v.alias(k) for k, v in n.items()), ((n["n_critical"] == 0) & (n["n_syntax"] == 0)).alias("passed"))


@query
def default_script_info(spark, sf_dir):
    info = F.explode(c.script_info(F.col("format"))).alias("h")
    return d.documents(spark, sf_dir).select("doc_id", info).select("doc_id", "h.*")


@query
def roundtrip(spark, sf_dir):
    """SRT, ASS, VTT and SRT again: texts stay, times within 10 ms."""
    docs = d.documents(spark, sf_dir)
    first = srt.parse(render.render_srt(d.one_line(d.cues(spark, sf_dir))))[0]
    second = ass.parse(render.render_ass(c.convert_cues(first, "ass"), docs))[0]
    third = vtt.parse(render.render_vtt(second))[0]
    return srt.parse(render.render_srt(third))[0].select(*CORE)


@query
def roundtrip_differences(spark, sf_dir):
    """What SRT, ASS, VTT and SRT again change: times that ASS rounds to 10 ms, nothing else."""
    before = d.one_line(d.cues(spark, sf_dir)).select(*CORE)
    found = differences(before, roundtrip(spark, sf_dir), "doc_id", "seq")
    has = lambda c: F.count_if(F.array_contains("fields", c)).alias(f"n_{c}")
    return found.groupBy("doc_id").agg(F.count_if(F.col("kind") != "changed").alias("n_lost"), has("cue_no"), has("start_ms"), has("end_ms"), has("text"))


# Sorts and set operations


@query
def sorted_cues(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("start_ms", "seq")
    return d.cues(spark, sf_dir).select("doc_id", F.row_number().over(w).cast(LONG).alias("place"), "seq", "start_ms")


@query
def check(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("doc_id", "rule", "severity").agg(F.count("*").alias("n"))


@query
def check_documents(spark, sf_dir):
    """The rules over the lines of all documents."""
    return rules.check(d.cues_docs(spark, sf_dir)).groupBy("doc_id", "rule", "severity").agg(F.count("*").alias("n"))


@query
def normalize_documents(spark, sf_dir):
    return retime.normalize_report(retime.normalize(d.cues_docs(spark, sf_dir), PAL))


#: So few rows to a chunk that the tables' documents have several.
CHUNK = 16


@query
def check_documents_in_chunks(spark, sf_dir):
    """check_documents with chunks of documents and their halo rows."""
    return rules.check(d.cues_docs(spark, sf_dir), chunk=CHUNK).groupBy("doc_id", "rule", "severity").agg(F.count("*").alias("n"))


@query
def overlap_pairs_in_chunks(spark, sf_dir):
    return retime.overlap_pairs(d.cues_docs(spark, sf_dir), CHUNK)


@query
def normalize_documents_by_ranges(spark, sf_dir):
    """normalize_documents with places from ranges."""
    return retime.normalize_report(retime.normalize(d.cues_docs(spark, sf_dir), PAL, ranges=True))


@query
def syntax_errors_in_chunks(spark, sf_dir):
    """Plain texts read as SRT and WebVTT, a chunk of lines at a time."""
    raw = d.read(spark, sf_dir, "documents").select("doc_id", "text")
    return srt.parse(raw, CHUNK)[1].unionByName(vtt.parse(raw, CHUNK)[2])


@query
def ordered_findings(spark, sf_dir):
    return rules.ordered(findings(spark, sf_dir)).select("doc_id", "rank", "rule", "cue_no", "line")


for _name in ("detect_format_", "bad_sequences_"):
    QUERIES[_name.rstrip("_")] = QUERIES.pop(_name)
