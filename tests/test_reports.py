"""Whole reports: golden totals of a damaged sample, all fields, plans, and reports of all kinds in one table."""

import re

import pytest
from pyspark.sql import functions as F

from cuewright.operators import convert, report, retime, rules
from cuewright.sources import io, parse, srt

#: A damaged sample by times and lengths of texts; fixed values.
TIMES = [(1000, 3000, 38), (3280, 5520, 35), (2900, 4200, 61), (6000, 6000, 25), (10000, 8000, 30), (12000, 14000, (24, 18))]


def sample():
    time = lambda ms: f"00:00:{ms // 1000:02},{ms % 1000:03}"
    text = lambda n: "\n".join("x" * k for k in (n if isinstance(n, tuple) else (n,)))
    return "\n".join(f"{i}\n{time(a)} --> {time(b)}\n{text(n)}\n" for i, (a, b, n) in enumerate(TIMES, 1))


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    """The sample in UTF-8, with a mark, and with a stray line; an ASS file; a file of no format and an empty one."""
    ass = "[Script Info]\nTitle: t\n\n[V4+ Styles]\nFormat: Name, Fontsize\nStyle: Default,20\nStyle: Alt,30\n\n[Events]\nFormat: Layer, Start, End, Style, Text\n" + "".join(f"{kind}: 0,0:00:0{k}.00,0:00:0{k}.90,{style},hello\n" for k, (kind, style) in enumerate([("Dialogue", "Default"), ("Dialogue", "ALT"), ("Dialogue", "Lost"), ("Comment", "Default")], 1))
    rows = [(0, sample().encode()), (1, b"\xef\xbb\xbf" + sample().encode()), (2, sample().encode() + b"\nstray\n"), (3, ass.encode()), (4, b"nothing"), (5, b"")]
    files = parse.recognised(spark.createDataFrame(rows, "doc_id bigint, content binary"))
    return parse.parse_files(files).saved(str(tmp_path_factory.mktemp("parsed") / "p"))


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_golden_totals(parsed):
    rows = by_id(report.check_report(parsed.rows))
    r = rows[0]
    assert (r.format, r.n_cues, r.n_lines, r.last_end_ms, r.n_findings, r.n_critical, r.n_syntax) == ("srt", 6, 7, 14000, 13, 4, 0)
    assert [x.n for x in r.rule_counts] == [3, 5, 1, 1, 3, 0] and [x.rule for x in r.rule_counts] == rules.RULES
    assert [(f.cue_no, f.rule, f.severity, f.measured, f.threshold) for f in r.findings] == [
        (1, "okuma_hizi", "uyari", "19.0 karakter/sn", "17.0 karakter/sn"),
        (1, "asgari_dinlenme", "uyari", "2000 ms (38 karakter)", "6334 ms"),
        (2, "asgari_dinlenme", "uyari", "2240 ms (35 karakter)", "5834 ms"),
        (2, "cakisan_araliklar", "kritik", "2620 ms cakisma", "> 0 ms"),
        (3, "okuma_hizi", "uyari", "46.9 karakter/sn", "17.0 karakter/sn"),
        (3, "asgari_dinlenme", "uyari", "1300 ms (61 karakter)", "10167 ms"),
        (3, "sira_bozuklugu", "kritik", "00:00:02,900 < 00:00:03,280", "baslangic artan sirada"),
        (3, "satir_uzunlugu", "uyari", "61 karakter", "42 karakter"),
        (4, "asgari_dinlenme", "uyari", "0 ms (25 karakter)", "4167 ms"),
        (4, "sira_bozuklugu", "kritik", "0 ms", "> 0 ms"),
        (5, "sira_bozuklugu", "kritik", "-2000 ms", "0 ms"),
        (6, "okuma_hizi", "uyari", "21.0 karakter/sn", "17.0 karakter/sn"),
        (6, "asgari_dinlenme", "uyari", "2000 ms (42 karakter)", "7000 ms"),
    ]
    assert (rows[1].n_findings, rows[1].encoding.encoding, rows[1].findings[0].rule) == (14, "utf-8-bom", "kodlama_bozuklugu")
    assert [(e.format, e.line) for e in rows[2].syntax_errors] == [("srt", 26)] and rows[2].n_findings == 13
    assert (rows[3].format, rows[3].n_cues, rows[3].styles, rows[3].n_syntax) == ("ass", 4, ["Lost"], 0)
    for k in (4, 5):
        assert (rows[k].format, rows[k].n_cues, rows[k].n_lines, rows[k].n_findings, rows[k].styles, rows[k].syntax_errors) == (None, 0, 0, 0, [], [])


def test_golden_profile(spark, parsed):
    """Another profile for one document; the others keep the defaults, and all show theirs."""
    own = spark.createDataFrame([(0, 15.0, 1200, 5.0, 38)], "doc_id bigint, okuma_hizi double, asgari_dinlenme_ms bigint, asgari_hiz double, en_fazla_karakter int")
    rows = by_id(report.check_report(parsed.rows, profiles=own))
    assert (rows[0].n_findings, rows[0].n_critical, rows[0].thresholds.okuma_hizi, rows[0].thresholds.en_fazla_satir) == (14, 4, 15.0, 2)
    assert (rows[1].n_findings, rows[1].thresholds.okuma_hizi) == (14, 17.0)


def test_golden_short_report_and_gate(parsed):
    rows = report.check_report(parsed.rows)
    short = by_id(report.report_summary(rows))[0]
    assert tuple(short) == (0, "srt", 6, 7, "00:00:14.000", "utf-8", 13, 4)
    assert {k: r.passed for k, r in by_id(report.quality_gate(rows)).items()} == {0: False, 1: False, 2: False, 3: True, 4: True, 5: True}
    assert all(r.passed for r in report.quality_gate(rows, tolerant=True).collect())


def test_golden_retiming(spark):
    cues = srt.parse(spark.createDataFrame([(0, sample())], "doc_id bigint, text string"))[0]
    left = lambda c: retime.overlap_pairs(c).count()
    shifted = retime.by_start(retime.shift_ms(cues, 1400)).drop("moved")
    assert tuple(retime.shift_report(cues, 1400).first()) == (0, 1400, 1400, 0, 6) and left(shifted) == 2
    assert tuple(retime.shift_percent_report(cues, -10.0).first()) == (0, -1400, -1400, 1, 6) and left(retime.shift_percent(cues, -10.0)) == 1
    written = shifted.withColumn("seq", F.col("seq"))
    assert tuple(retime.normalize_report(retime.normalize(written, (25, 1))).first()) == (0, 1, 0, 2, 15400)
    assert tuple(retime.normalize_report(retime.normalize(written, (24000, 1001), sort=False, renumber=False)).first()) == (0, 6, 0, 0, 15390)


def test_golden_losses(parsed):
    documents = parsed.documents.where("doc_id = 3")
    losses = convert.loss_report(documents, parsed.cues, parsed.styles, "vtt")
    out = convert.convert_report(losses, parsed.cues.where("doc_id = 3"), "vtt").first()
    assert (out.target, out.n_cues, [(x.feature, x.value) for x in out.losses]) == ("vtt", 4, [("ASS stiller", "2 stil"), ("replik stili", "Default"), ("Comment satirlari", "gizli replikler")])


def test_one_exchange(spark, parsed):
    """From a parse's rows a report takes one scan and one exchange."""
    plan = report.check_report(parsed.rows)._jdf.queryExecution().executedPlan().toString()
    assert (len(re.findall("FileScan", plan)), len(re.findall(r"\bExchange", plan))) == (1, 1)


def test_tagged_tables(parsed):
    """Tables from elsewhere give the same report as a parse's rows."""
    rows = report.tagged(parsed.documents, parsed.cues, parsed.styles, parsed.syntax_errors)
    want = report.check_report(parsed.rows)
    assert sorted(map(repr, report.check_report(rows).select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_reports_of_all_kinds(spark, parsed, tmp_path):
    """Reports of unlike shapes share a table; one kind is read without the others' files."""
    checks, shifts = report.check_report(parsed.rows), retime.shift_report(parsed.cues, -1400)
    io.write_reports(f"{tmp_path}/r", check=checks, shift=shifts)
    rows = io.read_reports(spark, f"{tmp_path}/r")
    assert {r.kind: r.n for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"check": 6, "shift": 4}
    own = io.read_reports(spark, f"{tmp_path}/r", "shift")
    assert re.search(r"PartitionFilters: \[[^\]]*kind[^\]]*shift", own._jdf.queryExecution().executedPlan().toString())
    assert {(r.doc_id, r.a) for r in own.select("doc_id", F.variant_get("report", "$.affected", "bigint").alias("a")).collect()} == {(r.doc_id, r.affected) for r in shifts.collect()}
    shape = own.agg(F.schema_of_variant_agg("report").alias("s")).first().s
    assert all(f"{c}: BIGINT" in shape for c in ("affected", "applied_ms", "clipped", "requested_ms"))
    first = io.read_reports(spark, f"{tmp_path}/r", "check").where("doc_id = 0").select(F.variant_get("report", "$.findings[12].measured", "string").alias("m"), F.to_json("report").alias("j")).first()
    assert first.m == "2000 ms (42 karakter)" and '"n_critical":4' in first.j
    with pytest.raises(Exception, match="(?i)exists"):
        io.write_reports(f"{tmp_path}/r", shift=shifts)


def test_reduced_rates(spark):
    from cuewright.functions.timecode import fps_columns

    given = {25.0: (25, 1), 23.976: (24000, 1001), 29.97: (30000, 1001), 23.5: (47, 2), 60.0: (60, 1), 12.34: (617, 50), 999.999: (1000, 1), 1.0: (1000, 1001), 0.5: None, 1000.5: None}
    rows = spark.createDataFrame([(k,) for k in given], "rate double")
    num, den = fps_columns("rate")
    assert {r.rate: (r.n, r.d) if r.n is not None else None for r in rows.select("rate", num.alias("n"), den.alias("d")).collect()} == given
