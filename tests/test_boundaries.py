"""Boundary rows of rules, times and frames, damaged inputs and encodings."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from cuewright.functions import timecode as t
from cuewright.operators import retime, rules
from cuewright.sources import ass, srt, vtt
from cuewright.sources.decode import decoded
from cuewright.sources.detect import detect_format


def one(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def cues(spark, *rows):
    return spark.createDataFrame([(1, i, n, a, b, s) for i, (n, a, b, s) in enumerate(rows)], "doc_id bigint, seq bigint, cue_no bigint, start_ms bigint, end_ms bigint, text string")


def names(df):
    return sorted(r.rule for r in df.collect())


@pytest.mark.parametrize(
    "chars,ms,rule,hit",
    [(34, 2000, 0, False), (36, 2000, 0, True), (30, 4999, 1, True), (30, 5000, 1, False), (30, 5001, 1, False), (42, 9000, 2, False), (43, 9000, 2, True)],
)
def test_thresholds(spark, chars, ms, rule, hit):
    assert (rules.RULES[rule] in names(rules.check(cues(spark, (1, 0, ms, "x" * chars))))) is hit


def test_overlap_and_order(spark):
    line = "x" * 30
    touching = cues(spark, (1, 0, 6000, line), (2, 6000, 12000, line))
    assert names(rules.check(touching)) == []
    over = cues(spark, (1, 0, 6001, line), (2, 6000, 12000, line))
    assert names(rules.check(over)) == ["cakisan_araliklar"]
    assert names(rules.check(over, rules.Thresholds(kabul_edilebilir_bosluk_ms=100))) == []
    negative = cues(spark, (1, 5000, 4000, "a"), (2, 3000, 9000, "b"))
    assert names(rules.check(negative)) == ["sira_bozuklugu", "sira_bozuklugu"]
    assert rules.check(cues(spark)).count() == 0


def test_empty_text_and_three_lines(spark):
    found = rules.check(cues(spark, (1, 0, 9000, ""), (2, 9000, 20000, "a\nb\nc"))).collect()
    assert [(f.cue_no, f.line, f.measured) for f in found] == [(2, 0, "3 satir")]


def test_times(spark):
    x = ["00:00:01,000", "0:00:01.23", "01:02.500", "100:00:00.5", "00:00:01", " 1 : 02 : 03 ", "", None, "1", "1:2:3:4", "00:60:00", "00:00:60", "-1:00:00", "00:00:01,5x", "00:00:01,1239"]
    want = [1000, 1230, 62500, 360000500, 1000, 3723000, None, None, None, None, 3600000, None, None, None, 1123]
    assert one(spark, t.parse_timestamp("x"), x) == want
    assert one(spark, t.format_ass_time("x"), [995, 994, -5, 3599996], "bigint") == ["0:00:01.00", "0:00:00.99", "0:00:00.00", "1:00:00.00"]
    assert one(spark, t.format_vtt_time("x"), [1000, 3600000], "bigint") == ["00:01.000", "01:00:00.000"]
    assert one(spark, t.format_srt_time("x"), [-1, 360000001], "bigint") == ["00:00:00,000", "100:00:00,001"]


def test_frames(spark):
    assert [t.fps_fraction(x) for x in (23.976, 25, 29.97, 23.5, 60, 1, 2)] == [(24000, 1001), (25, 1), (30000, 1001), (47, 2), (60, 1), (1000, 1001), (2000, 1001)]
    with pytest.raises(ValueError):
        t.fps_fraction(0.5)
    assert one(spark, t.snap_to_frame("x", 30, 1), [1042, 3280], "bigint") == [1033, 3267]
    assert one(spark, t.snap_to_frame("x", 24000, 1001), [1042, 25042], "bigint") == [1043, 25025]
    assert t.frame_ms(25, 1) == 40
    assert t.shift_amount(seconds=1.4) == ("ms", 1400) and t.shift_amount(percent=-10) == ("percent", -10.0)
    with pytest.raises(ValueError):
        t.shift_amount(ms=1, seconds=1)


def test_shift_and_sort(spark):
    c = cues(spark, (1, 100, 300, "a"), (2, 50, 60, "b"), (3, 50, 60, "c"))
    assert [tuple(r) for r in retime.shift_report(c, -200).collect()] == [(1, -200, -200, 3, 3)]
    rows = retime.by_start(c).orderBy("seq").collect()
    assert [(r.text, r.moved) for r in rows] == [("b", True), ("c", True), ("a", True)]
    assert retime.shift_percent(cues(spark, (1, 0, 0, "a")), 50.0).first().end_ms == 0


SRT = [
    ("1\n00:00:01,000 --> 00:00:02,000\na\n\n2\n00:00:03,000 --> 00:00:04,000 X1:5\nb\nc\n", [(1, 1000, 2000, "a"), (2, 3000, 4000, "b\nc")], []),
    ("5\n6\n00:00:01,000 --> 00:00:02,000\na", [(1, 1000, 2000, "a")], [(2, "yok")]),
    ("7\n00:00:01,000 --> 00:00:02,000\na\n\n00:00:03,000 --> x\n", [(7, 1000, 2000, "a"), (8, 3000, 0, "")], [(5, "bitis"), (6, "bos")]),
    ("0\n00:00:01,000 --> 00:00:02,000\na", [(1, 1000, 2000, "a")], [(2, "0 olamaz")]),
    ("9", [], [(1, "zaman cizgisi yok")]),
    ("", [], []),
    ("1\r\n00:00:01,000 --> 00:00:02,000\r\na\r\n", [(1, 1000, 2000, "a")], []),
    ("junk\n00:00:01,000 --> 00:00:02,000\na", [(2, 1000, 2000, "a")], [(1, "yok")]),
]


@pytest.mark.parametrize("text,want,wrong", SRT)
def test_damaged_srt(spark, text, want, wrong):
    found, errors = srt.parse(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
    assert [(r.cue_no, r.start_ms, r.end_ms, r.text) for r in found.orderBy("seq").collect()] == want
    got = sorted((r.line, r.message) for r in errors.collect())
    assert len(got) == len(wrong) and all(a == line and part in m for (a, m), (line, part) in zip(got, wrong, strict=True))


def test_damaged_vtt(spark):
    text = "WEBVTT\nKind: captions\n\nNOTE x\ny\n\nSTYLE\n::cue { color: red }\n\nstray\nname\n00:01.000 --> 00:02.000 align:start\na\n\n00:03.000 --> 00:04.000\n\nlast\n"
    found, headers, errors = vtt.parse(spark.createDataFrame([(1, text), (2, ""), (3, "00:01.000 --> 00:02.000\nb")], "doc_id bigint, text string"))
    assert [(r.doc_id, r.cue_no, r.start_ms, r.text) for r in found.orderBy("doc_id", "seq").collect()] == [(1, 1, 1000, "a"), (1, 2, 3000, ""), (3, 1, 1000, "b")]
    assert [(r.name, r.value) for r in headers.orderBy("pos").collect()] == [("Kind", "captions"), ("STYLE ", ":cue { color: red }")]
    assert sorted((r.doc_id, r.line) for r in errors.collect()) == [(1, 10), (1, 16), (1, 17), (2, 0), (3, 1)]


def test_damaged_ass(spark):
    text = "stray\n[Script Info]\nTitle: x\nbroken\n; remark\n[V4 Styles]\nFormat: Name, Fontname\nStyle: A, Arial\nStyle: B\n[Events]\nFormat: Start, End, Style, Text\nDialogue: 0:00:01.00,0:00:02.00,A,Hello, world \ncomment: bad,0:00:02.00,,x\nDialogue: 0:00:01.00\nnothing\n"
    found, styles, headers, errors = ass.parse(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
    got = [(r.cue_no, r.start_ms, r.text, r.style, r.event_kind) for r in found.orderBy("seq").collect()]
    assert got == [(1, 1000, "Hello, world", "A", "dialogue"), (2, 0, "x", None, "comment"), (3, 1000, "", None, "dialogue")]
    assert [(r.name, [f.value for f in r.fields]) for r in styles.orderBy("style_pos").collect()] == [("A", ["A", "Arial"]), ("B", ["B", ""])]
    assert [(r.name, r.value) for r in headers.collect()] == [("Title", "x")]
    assert sorted(r.line for r in errors.collect()) == [1, 4, 9, 13, 14, 14]


def test_detection(spark):
    x = ["WEBVTT\n", "﻿WEBVTT", "[Script Info]\n", "[V4+ Styles]\n", "[V4 Styles]", "[Events]", "1\nx\na --> b", "a --> b", "hello", "", "\n" * 25 + "WEBVTT"]
    assert one(spark, detect_format("x"), x) == ["vtt", "vtt", "ass", None, "ass", "ass", "srt", "srt", None, None, None]


def test_encodings(spark):
    cases = {
        b"abc": ("utf-8", False, 0, 0, False, "abc"),
        b"\xef\xbb\xbfabc": ("utf-8-bom", True, 0, 0, False, "abc"),
        "aé".encode("utf-16"): ("utf-16-le", True, 0, 0, False, "aé"),
        b"\xfe\xff" + "aş".encode("utf-16-be"): ("utf-16-be", True, 0, 0, False, "aş"),
        b"\xff\xfea\x00\x00\xd8b": ("utf-16-le", True, 2, 1, False, "a�"),
        b"\xfeey": ("windows-1254", False, 1, 0, False, "şey"),
        "ş\n".encode() + b"\xfe\n": ("karisik", False, 1, 0, True, "ÅŸ\nş\n"),
        b"\x81\xe2\x82": ("windows-1254", False, 2, 1, False, "�â‚"),
        b"": ("utf-8", False, 0, 0, False, ""),
    }
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(cases)], "i int, content binary")
    got = [(r.encoding.encoding, r.encoding.has_bom, r.encoding.bad_seq, r.encoding.fffd, r.encoding.mixed, r.text) for r in decoded(df).orderBy("i").collect()]
    assert got == list(cases.values())


def test_wide_units(spark):
    """Every order of surrogates, and bytes that look like halves of them, as Python's decoder reads them."""
    rng, own = random.Random(1), [0x41, 0xD83D, 0xDE00, 0xD800, 0xDFFF, 0xFFFD, 0x0A, 0x85, 0x2028, 0xD8, 0xDC, 0xD7FF, 0xE000, 0xFEFF, 0xFFFE, 0, 0xD8DC]
    cases = []
    for k in range(400):
        order = ("little", "big")[k % 2]
        body = b"".join(rng.choice(own).to_bytes(2, order) for _ in range(rng.randint(0, 14)))
        text = body.decode(f"utf-16-{order[0]}e", "replace")
        bad = text.count("�") - sum(body[i : i + 2] == (0xFFFD).to_bytes(2, order) for i in range(0, len(body), 2))
        cases.append(((0xFEFF).to_bytes(2, order) + body + b"\xd8" * (k % 3 == 0), text, bad + (k % 3 == 0)))
    df = spark.createDataFrame([(i, bytearray(c[0])) for i, c in enumerate(cases)], "i int, content binary")
    got = [(r.text, r.encoding.bad_seq, r.encoding.fffd) for r in decoded(df).orderBy("i").collect()]
    assert got == [(text, bad, text.count("�")) for _, text, bad in cases]


def test_wide_texts_in_seconds(spark):
    """A text of eight million bytes, a lone surrogate in its middle, is matched once, not unit by unit for each column."""
    half = "aß\n中" * 500_000
    content = b"\xff\xfe" + half.encode("utf-16-le") + b"\x3d\xd8" + half.encode("utf-16-le")
    df = spark.createDataFrame([(1, bytearray(content))], "id int, content binary")
    rows = decoded(df).select(F.length("text"), F.sha2("text", 256), "encoding.bad_seq", "encoding.fffd")
    began = time.perf_counter()
    assert tuple(rows.first()) == (4_000_001, hashlib.sha256((half + "�" + half).encode()).hexdigest(), 1, 1)
    assert time.perf_counter() - began < 8


def test_profile_files(spark, tmp_path):
    from cuewright.sources.io import read_profile

    (tmp_path / "p.json").write_text('{"okuma_hizi": 30.0, "en_fazla_satir": 3}')
    r = read_profile(spark, str(tmp_path)).first()
    assert (r.okuma_hizi, r.asgari_dinlenme_ms, r.en_fazla_karakter, r.en_fazla_satir) == (30.0, 1000, 42, 3)
    (tmp_path / "q.json").write_text("{")
    with pytest.raises(Exception):
        read_profile(spark, str(tmp_path)).collect()


def test_drop_folder_stream(spark, tmp_path):
    from cuewright.streaming.files import stream_files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\na\n")
    seen = []
    q = stream_files(spark, str(tmp_path / "in"), lambda df, n: seen.extend(r.format for r in df.select("format").collect()), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert seen == ["srt"]


def test_neighbour_column_names(spark):
    c = cues(spark, (1, 0, 9000, "x")).withColumn("extra", F.lit(1))
    assert rules.check(c).count() == 0
