"""Repeated runs of lines, by prefix doubling over line identities; DataFrame functions only.

A text's lines with a word are a sequence of identities (64-bit hashes). The suffix array of all sequences is built by
distributed prefix doubling: at level k every place is named by its next 2**k lines, and two names of level k, 2**k
lines apart, make a name of level k + 1. A place whose name is unique is done, since its neighbours in the array share
no longer prefix, so only repeated places go on. Suffixes that share a prefix form an interval of the array; an interval
is known by the names that cover its prefix (two of one level, which may overlap), and needs no sorted order.

A repeated run counts if it has at least MIN_WORDS words. Every such run is the union of its shortest windows of
that many words, forward from each line and backward from its last lines, so intervals of these windows reveal exactly
the maximal repeated runs. Each interval keeps its first window, by doc_id (null first), then input row, then line; the
lines of later ones are deleted. A run that overlaps its own copy keeps its first lines.

Lines without words are never deleted. A text that loses all its lines with words goes; texts that had none stay. Null
texts stay null. Equal rows are copies of each other: the first stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm.common import forget, own_name, table, written

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def shortest(words: str, backward: bool, least: int) -> Column:
    """For each line the number of lines, from it on or up to it, that first reach `least` words; 0 if none do. Each
    line has a word, so `least` lines are enough to look at."""

    def reach(_: Column, i: Column) -> Column:
        at = F.greatest(i - least + 2, F.lit(1)) if backward else i + 1
        part = F.slice(F.col(words), at, F.least(F.lit(least), i + 1) if backward else F.lit(least))
        part = F.reverse(part) if backward else part
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"))
        step = lambda acc, w: F.when(acc["sum"] >= least, acc).otherwise(F.struct((acc["n"] + 1).alias("n"), (acc["sum"] + w).alias("sum")))
        return F.aggregate(part, zero, step, lambda acc: F.when(acc["sum"] >= least, acc["n"]).otherwise(0))

    return F.transform(F.col(words), reach)


def line_table(rows: DataFrame, row: str, least: int) -> DataFrame:
    """row, doc_id, at (place among the lines with words), p (place among all lines), line (identity), forward, backward
    (lines of the shortest windows) for each line with words."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("p"), F.regexp_count(x, F.lit(WORD)).alias("words"), F.xxhash64(x).alias("line")))
    arrays = rows.select(F.col(row).alias("row"), F.col("doc_id"), F.filter(numbered, lambda x: x["words"] > 0).alias("x"))
    arrays = arrays.select("row", "doc_id", F.col("x.p").alias("p"), F.col("x.line").alias("line"), F.col("x.words").alias("words"))
    arrays = arrays.select("row", "doc_id", "p", "line", shortest("words", False, least).alias("forward"), shortest("words", True, least).alias("backward"))
    out = arrays.select("row", "doc_id", F.posexplode(F.arrays_zip("p", "line", "forward", "backward")).alias("at", "x"))
    return out.select("row", "doc_id", "at", "x.p", "x.line", "x.forward", "x.backward")


def named(lines: DataFrame, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """level, row, at, name of every place whose 2**level lines are repeated somewhere, for all levels that windows of
    `least` lines need, and the tables that it reads."""
    repeated = lambda x: x.join(x.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "name", "left_semi")
    now = written(repeated(lines.select("row", "at", F.col("line").alias("name"))), "names")
    out, level, held = now.withColumn("level", F.lit(0)), 0, [now]
    while 2 << level <= least:
        after = now.select("row", (F.col("at") - (1 << level)).alias("at"), F.col("name").alias("then"))
        pairs = now.join(after, ["row", "at"]).select("row", "at", F.xxhash64("name", "then", F.lit(level)).alias("name"))
        now = written(repeated(pairs), "names")
        level += 1
        held.append(now)
        out = out.unionByName(now.withColumn("level", F.lit(level)))
    return out, held


def doomed(rows: DataFrame, row: str, least: int = MIN_WORDS) -> DataFrame:
    """row, p of each line (counted among all lines) that lies in a later copy of a repeated run."""
    lines = written(line_table(rows, row, least), "lines")
    names, held = named(lines, least)
    forward = lines.where("forward > 0").select("row", "doc_id", "at", F.col("forward").alias("size"))
    backward = lines.where("backward > 0").select("row", "doc_id", (F.col("at") - F.col("backward") + 1).alias("at"), F.col("backward").alias("size"))
    windows = forward.unionByName(backward).distinct()
    level = F.floor(F.log2("size") + 1e-9).cast("int")
    windows = windows.withColumn("level", level)
    first = names.select("level", "row", "at", F.col("name").alias("first"))
    last = names.select("level", "row", F.col("at").alias("last_at"), F.col("name").alias("last"))
    covered = windows.join(first, ["level", "row", "at"]).withColumn("last_at", F.col("at") + F.col("size") - F.call_function("shiftleft", F.lit(1), F.col("level"))).join(last, ["level", "row", "last_at"])
    covered = written(covered.select("row", "doc_id", "at", "size", F.xxhash64("size", "first", "last").alias("interval")), "windows")
    forget(*held)
    place = F.struct("doc_id", "row", "at")
    starts = covered.groupBy("interval").agg(F.min(place).alias("start"), F.count("*").alias("n")).where("n > 1").select("interval", "start")
    later = covered.join(starts, "interval").where(place > F.col("start"))
    later = later.select("row", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("at")).distinct()
    out = written(later.join(lines.select("row", "at", "p"), ["row", "at"]).select("row", "p"), "doomed")
    forget(lines, covered)
    return out


def marked(dead: DataFrame, row: str, name: str) -> DataFrame:
    """row, name (the doomed lines as bits, 64 to a number: a look-up takes the same time in any text) and their number."""
    words = dead.groupBy("row", F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p") % 64)).alias("bits"), F.count("*").alias("n"))
    own = words.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"), F.max("w").alias("top"), F.sum("n").cast("int").alias(f"{name}_n"))
    return own.select(F.col("row").alias(row), F.transform(F.sequence(F.lit(0), "top"), lambda w: F.coalesce(F.element_at("m", w), F.lit(0).cast("bigint"))).alias(name), f"{name}_n")


def without_copies(docs: DataFrame, least: int = MIN_WORDS) -> tuple[DataFrame, str, str]:
    """docs with the text changed, and the names of two columns more: lines with words, and how many were deleted."""
    row, lost, n, gone = (own_name(docs, c) for c in ("line_row", "line_lost", "n_lines", "n_deleted"))
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    both = rows.join(marked(doomed(rows, row, least), row, lost), row, "left")
    lines = F.split("text", "\n")
    bits = lambda i: F.coalesce(F.get(F.col(lost), F.shiftright(i, 6)), F.lit(0).cast("bigint"))
    kept = F.filter(lines, lambda x, i: F.getbit(bits(i), i % 64) == 0)
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    words = F.size(F.filter(lines, lambda x: x.rlike(WORD)))
    out = both.withColumn(n, F.coalesce(F.when(F.col("text").isNotNull(), words), F.lit(0))).withColumn(gone, F.coalesce(f"{lost}_n", F.lit(0))).withColumn("text", text)
    return out.select(*docs.columns, n, gone), n, gone


def keep_first_runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """docs without later copies of repeated runs; n_chars, if there, follows the text; texts left without words go."""
    out, n, gone = without_copies(docs, least)
    out = out.where((F.col(gone) == 0) | (F.col(gone) < F.col(n)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op4_line_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_deleted (of the lines with words), text_sha256 of what stays, for each document."""
    out, n, gone = without_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col(n).cast("long").alias("n_lines"), F.col(gone).cast("long").alias("n_deleted"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS p
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS spot,
         sum(w) OVER (PARTITION BY doc_id ORDER BY p) AS upto
  FROM (SELECT *, length(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM lines) WHERE w > 0
), forward AS (
  SELECT a.doc_id, a.spot, min(b.spot) AS until FROM worded a JOIN worded b
  ON a.doc_id = b.doc_id AND b.spot BETWEEN a.spot AND a.spot + 49 AND b.upto - a.upto + a.w >= 50 GROUP BY ALL
), backward AS (
  SELECT a.doc_id, max(b.spot) AS spot, a.spot AS until FROM worded a JOIN worded b
  ON a.doc_id = b.doc_id AND b.spot BETWEEN a.spot - 49 AND a.spot AND a.upto - b.upto + b.w >= 50 GROUP BY a.doc_id, a.spot
), windows AS (
  SELECT doc_id, spot, until, string_agg(line, chr(10) ORDER BY n) AS content FROM (
    SELECT v.*, x.line, x.spot AS n FROM (SELECT * FROM forward UNION SELECT * FROM backward) v
    JOIN worded x ON x.doc_id = v.doc_id AND x.spot BETWEEN v.spot AND v.until) GROUP BY ALL
), later AS (
  SELECT doc_id, spot, until FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, spot) AS nth FROM windows) WHERE nth > 1
), dead AS (
  SELECT DISTINCT w.doc_id, w.p FROM worded w JOIN later v ON w.doc_id = v.doc_id AND w.spot BETWEEN v.spot AND v.until
)
SELECT l.doc_id, count(*) FILTER (w.p IS NOT NULL) AS n_lines, count(d.p) AS n_deleted,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.p) FILTER (d.p IS NULL), '')) AS text_sha256
FROM lines l LEFT JOIN worded w ON l.doc_id = w.doc_id AND l.p = w.p LEFT JOIN dead d ON l.doc_id = d.doc_id AND l.p = d.p
GROUP BY l.doc_id
"""
