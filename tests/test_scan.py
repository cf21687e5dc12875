"""The one-pass scan: plans, segmented documents against whole ones, forced formats."""

import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.operators import render, report, retime, rules
from cuewright.plans import derived as d
from cuewright.sources import parse, scan, srt, vtt

LINES = {
    "srt": ["", "", "1", "2", "0", "+3", "77", "4294967296", "00:00:01,000 --> 00:00:02,000", "00:00:03,000 --> x", " --> ", "hello", "hello  ", "12 a", "\t"],
    "vtt": ["", "", "WEBVTT", "Kind: captions", "key value", "NOTE x", "STYLE", "::cue { color: red }", "REGION", "00:01.000 --> 00:02.000", "a: b", "--> ", "name", "text", "NOTE --> y"],
}


def damaged(form, n, seed):
    rng, own = np.random.default_rng(seed), LINES[form]
    texts = ["\n".join(rng.choice(own, rng.integers(0, 60))) + "\n" * int(rng.integers(0, 2)) for _ in range(n)]
    if form == "vtt":
        texts = [("WEBVTT\n" + "".join(f"k{i}: v\n" for i in range(k % 20)) + t) if k % 3 else t for k, t in enumerate(texts)]
    return [*texts, "", "\n" * 30, "x\n" * 30, "1\n" * 31 + LINES[form][9], "5\n00:00:01,000 --> 00:00:02,000\n" + "text\n" * 40]


@pytest.mark.parametrize("form", ["srt", "vtt"])
@pytest.mark.parametrize("chunk", [1, 2, 7])
def test_segmented_equals_whole(spark, form, chunk):
    """Chunks of a few lines, each in a task of its own, give what whole documents give."""
    texts = damaged(form, 60, 3)
    raw = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = lambda df: sorted(map(repr, df.collect()))
    for whole, parts in zip(*((srt if form == "srt" else vtt).parse(raw, c) for c in (None, chunk)), strict=True):
        want = rows(whole)
        assert want and rows(parts) == want


def test_no_window_sees_a_whole_document(spark):
    """In chunks every window is over (document, chunk), or a document's chunks in the fold."""
    raw = spark.createDataFrame([(0, "1\n" * 100)], "doc_id bigint, text string")
    plan = srt.parse(raw, 7)[0]._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"windowspecdefinition\(([^()]*?), ln", plan)
    assert keys and all("chunk" in k for k in keys)


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    return len(re.findall(r"FileScan|Scan ExistingRDD|LocalTableScan", plan)), len(re.findall(r"\bExchange hash", plan))


def test_one_scan_and_one_exchange(spark, sf, tmp_path):
    """All tables of all formats come from one scan and one exchange, and are written by one job."""
    parse.recognised(d.mixed_files(spark, sf)).write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    own = parse.parse_files(files)
    assert scans(own.rows) == (1, 1)
    saved = own.saved(f"{tmp_path}/parsed")
    for kind in ("documents", "cues", "styles", "headers", "syntax_errors"):
        want = sorted(map(repr, getattr(own, kind).collect()))
        assert want and sorted(map(repr, getattr(saved, kind).collect())) == want
        assert scans(getattr(saved, kind)) == (1, 0)


def test_bucketed_rows_need_no_exchange(spark, sf, tmp_path):
    """Checking, normalising, rendering and reporting a bucketed table take no exchange and give what they give without one."""
    parse.recognised(d.mixed_files(spark, sf)).write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    plain, own = parse.parse_files(files), parse.parse_files(files, buckets=3)
    assert scans(own.rows)[0] == 1 and own.rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange ") == 1
    table = f"parsed_{uuid.uuid4().hex}"
    try:
        saved = own.saved_as(table)
        jobs = {
            "check": lambda p: rules.check(p.cues),
            "normalize": lambda p: retime.normalize_report(retime.normalize(p.cues, (25, 1))),
            "render": lambda p: render.render_srt(p.cues),
            "report": lambda p: report.check_report(p.rows),
            "join": lambda p: p.cues.join(p.documents.select("doc_id", "format"), "doc_id"),
        }
        for name, job in jobs.items():
            plan = job(saved)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan or (name == "join" and "BroadcastExchange" in plan), (name, plan)
            assert sorted(map(repr, job(saved).select(job(plain).columns).collect())) == sorted(map(repr, job(plain).collect()))
        with pytest.raises(Exception, match="(?i)exists"):
            own.saved_as(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    with pytest.raises(ValueError, match="buckets"):
        plain.saved_as("x")


def test_columns_of_files_stay(spark):
    """Columns that files have besides stay with their documents, whatever their names."""
    rows = [(1, "1\n00:00:01,000 --> 00:00:02,000\nx\n", "srt", 5, "p"), (2, None, None, 6, "q")]
    files = spark.createDataFrame(rows, "doc_id bigint, text string, format string, ln int, raw string").withColumn("a b", F.lit(1))
    out = parse.parse_files(files)
    assert [tuple(r) for r in out.documents.orderBy("doc_id").collect()] == [(1, "srt", 5, "p", 1, []), (2, None, 6, "q", 1, [])]
    assert out.cues.count() == 1 and out.syntax_errors.count() == 0


def test_forced_format(spark):
    """A forced format is what a file is parsed in; a file that isn't recognised at all stays rejected."""
    text = "WEBVTT\n\n00:01.000 --> 00:02.000\nx\n"
    rows = [(1, text, None), (2, text, "srt"), (3, "plain", "srt"), (4, text, "vtt")]
    files = spark.createDataFrame(rows, "doc_id bigint, text string, want string").select("doc_id", F.encode("text", "UTF-8").alias("content"), "want")
    out = parse.parse_files(parse.recognised(files, forced="want"))
    assert {r.doc_id: r.format for r in out.documents.collect()} == {1: "vtt", 2: "srt", 3: None, 4: "vtt"}
    assert {r.doc_id: r.line for r in out.syntax_errors.collect()} == {2: 1}
    assert sorted(r.doc_id for r in out.cues.collect()) == [1, 2, 4]


def test_formats_are_known():
    assert set(scan.FORMATS) == {"srt", "vtt", "ass"}
