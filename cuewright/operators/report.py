"""Reports by document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright import __version__
from cuewright.functions import metrics as m
from cuewright.functions.timecode import duration_text
from cuewright.operators.rules import CRITICAL, FINDING, KINDS, RULES, Thresholds, cue_findings, encoding_findings, limits

LONG = "bigint"


def doc_stats(documents: DataFrame, cues: DataFrame) -> DataFrame:
    """For each document cues, lines and the last end (0 without cues)."""
    own = cues.groupBy("doc_id").agg(F.count("*").alias("n_cues"), F.sum(m.line_count()).alias("n_lines"), F.max("end_ms").alias("last_end_ms"))
    zero = F.lit(0).cast(LONG)
    return documents.select("doc_id").join(own, "doc_id", "left").select("doc_id", *(F.coalesce(c, zero).alias(c) for c in ("n_cues", "n_lines", "last_end_ms")))


def rule_summary(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """The number of findings of each of the six rules, for each document and in the rules' order."""
    six = F.posexplode(F.array(*map(F.lit, RULES)))
    grid = documents.select("doc_id", six.alias("place", "rule"))
    return grid.join(findings.groupBy("doc_id", "rule").agg(F.count("*").alias("n")), ["doc_id", "rule"], "left").select("doc_id", F.col("place").cast(LONG).alias("place"), "rule", F.coalesce("n", F.lit(0).cast(LONG)).alias("n_findings"))


def undefined_styles(cues: DataFrame, styles: DataFrame) -> DataFrame:
    """Style names that cues use and their document doesn't define, A-Z fold, sorted."""
    used = cues.where("style is not null").select("doc_id", "style").distinct().withColumn("key", m.fold("style"))
    known = styles.select("doc_id", m.fold("name").alias("key"))
    return used.join(known, ["doc_id", "key"], "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_set("style")).alias("styles"))


def tagged(documents: DataFrame, cues: DataFrame, styles: DataFrame, syntax_errors: DataFrame) -> DataFrame:
    """Four tables by doc_id as rows of one (doc_id, kind, document, cue, style, error), like those that a parse gives."""
    tables = {"document": documents, "cue": cues, "style": styles, "error": syntax_errors}
    kinds = {k: F.struct(*(F.col(f"`{c}`") for c in t.columns if c != "doc_id")) for k, t in tables.items()}
    types = {k: t.select(kinds[k].alias("x")).schema["x"].dataType for k, t in tables.items()}
    rows = [t.select("doc_id", F.lit(k).alias("kind"), *((kinds[k] if c == k else F.lit(None).cast(types[c])).alias(c) for c in tables)) for k, t in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def check_report(rows: DataFrame, thresholds: Thresholds | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """The whole report of each document, from tagged rows (those of a parse, or of tagged()): version, format, the document's
    other columns, n_cues, n_lines, last_end_ms, thresholds, rule_counts (of the six rules, in order), n_findings, n_critical,
    findings in order, styles (used and undefined, sorted), n_syntax, syntax_errors by line.

    One exchange by doc_id, which windows and the aggregation share; another for profiles (doc_id and thresholds), where there
    are any. A cue's neighbours, and whether its style is defined, are windows; everything else is one aggregation."""
    col, zero, names = F.col, F.lit(0).cast(LONG), [c for c in rows.schema["document"].dataType.names if c not in ("format", "encoding", "headers")]
    is_ = lambda k: col("kind") == k
    own, key = F.struct("cue.cue_no", "cue.start_ms", "cue.end_ms"), F.when(is_("cue"), m.fold("cue.style")).when(is_("style"), m.fold("style.name"))
    # Both windows are by doc_id alone, so that they share its exchange: cues follow each other, and a style's peers have its key.
    w, peers = Window.partitionBy("doc_id").orderBy("kind", "cue.seq"), Window.partitionBy("doc_id").orderBy("style_key").rangeBetween(Window.currentRow, Window.currentRow)
    rows = rows.where(col("kind").isin("document", "cue", "style", "error")).withColumn("style_key", key)
    own = F.when(is_("cue"), own)
    rows = rows.withColumns({"before": F.lag(own).over(w), "after": F.lead(own).over(w), "known": F.max(is_("style")).over(peers)})
    profile = None
    if profiles is not None:
        filled = [(F.col(k) if k in profiles.columns else F.lit(None)).cast(kind).alias(k) for k, kind in KINDS.items()]
        rows, profile = rows.join(profiles.select("doc_id", F.struct(*filled).alias("profile")), "doc_id", "left"), "profile"
    limit = limits(thresholds, profile)
    encoding = [col("document.encoding").alias("encoding")] if "encoding" in rows.schema["document"].dataType.names else []
    flat = rows.select("doc_id", "kind", "document", "error", "known", "cue.*", *encoding, F.struct(*(v.alias(k) for k, v in limit.items())).alias("thresholds"), "before", "after")
    limit = {k: col(f"thresholds.{k}") for k in limit}
    found = F.when(is_("cue"), cue_findings(limit))
    found = F.coalesce(found.when(is_("document"), encoding_findings()) if encoding else found, F.array().cast(f"array<{FINDING}>"))
    rank = F.array(*map(F.lit, RULES))
    keyed = F.transform(found, lambda f: F.struct(F.coalesce(f["cue_no"], zero).alias("c"), f["line"].alias("l"), F.array_position(rank, f["rule"]).alias("r"), f["message"].alias("m"), f.alias("f")))
    flat = flat.select("doc_id", "kind", "document", "thresholds", "end_ms", F.when(is_("cue"), m.line_count()).alias("lines"), F.when(is_("cue") & ~col("known"), col("style")).alias("lacks"), F.when(is_("error"), F.struct("error.line", "error.message", "error.format")).alias("error"), F.when(F.size(keyed) > 0, keyed).alias("found"))
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    out = flat.groupBy("doc_id").agg(first("document"), first("thresholds"), F.count_if(is_("cue")).alias("n_cues"), F.coalesce(F.sum("lines"), zero).alias("n_lines"), F.coalesce(F.max("end_ms"), zero).alias("last_end_ms"), F.transform(F.array_sort(F.flatten(F.collect_list("found"))), lambda x: x["f"]).alias("findings"), F.array_sort(F.collect_set("lacks")).alias("styles"), F.array_sort(F.collect_list("error")).alias("wrong"))
    among = lambda field, value: F.size(F.filter("findings", lambda f: f[field] == value)).cast(LONG)
    counts = F.array(*(F.struct(F.lit(r).alias("rule"), among("rule", r).alias("n")) for r in RULES))
    wrong = F.transform("wrong", lambda e: F.struct(e["format"].alias("format"), e["line"].alias("line"), e["message"].alias("message")))
    return out.where("document is not null").select(
        "doc_id", F.lit(__version__).alias("version"), "document.format", *(f"document.`{c}`" for c in names), "n_cues", "n_lines", "last_end_ms", *(["document.encoding"] if encoding else []), "thresholds", counts.alias("rule_counts"),
        F.size("findings").cast(LONG).alias("n_findings"), among("severity", CRITICAL).alias("n_critical"), "findings", "styles", F.size("wrong").cast(LONG).alias("n_syntax"), wrong.alias("syntax_errors"),
    )


def report_summary(report: DataFrame) -> DataFrame:
    """The short form of a report: format, cues, lines, duration, encoding, findings and critical ones."""
    encoding = ["encoding.encoding"] if "encoding" in report.columns else []
    return report.select("doc_id", "format", "n_cues", "n_lines", duration_text("last_end_ms").alias("duration"), *encoding, "n_findings", "n_critical")


def quality_gate(report: DataFrame, tolerant: bool = False) -> DataFrame:
    """passed: no critical finding and no syntax error; a tolerant gate passes all."""
    good = F.lit(True) if tolerant else (F.col("n_critical") == 0) & (F.col("n_syntax") == 0)
    return report.select("doc_id", good.alias("passed"))


def longest_cue(cues: DataFrame) -> DataFrame:
    """The cue with the most characters of each document, the last of equals."""
    chars = m.characters()
    best = F.max_by(F.struct("cue_no", chars.alias("n_chars"), "text"), F.struct(chars, "seq"))
    return cues.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.*")
