"""Shifts, frame snapping, sorting and renumbering of cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions import metrics as m
from cuewright.functions.timecode import frame_ms, snap_to_frame
from cuewright.operators.places import places, with_neighbours

LONG = "bigint"
FULL = ["cue_no", "start_ms", "end_ms", "text", "style", "speaker", "margin_l", "margin_r", "margin_v", "effect", "layer", "event_kind"]


def full(cues: DataFrame):
    """All fields of a cue as a struct, in a fixed order."""
    return F.struct(*(c for c in FULL if c in cues.columns))


def shift_ms(cues: DataFrame, delta) -> DataFrame:
    """Starts and ends moved by delta (a number or a column), not below 0."""
    d, zero = F.lit(delta).cast(LONG) if isinstance(delta, int) else delta, F.lit(0).cast(LONG)
    return cues.withColumns({c: F.greatest(F.col(c) + d, zero) for c in ("start_ms", "end_ms")})


def shift_report(cues: DataFrame, delta) -> DataFrame:
    """For each document: requested_ms, applied_ms, clipped (cues that would go below 0), affected (cues that changed)."""
    d = F.lit(delta).cast(LONG) if isinstance(delta, int) else delta
    start, end, zero = F.col("start_ms") + d, F.col("end_ms") + d, F.lit(0).cast(LONG)
    changed = (F.greatest(start, zero) != F.col("start_ms")) | (F.greatest(end, zero) != F.col("end_ms"))
    return cues.groupBy("doc_id").agg(F.max(d).alias("requested_ms"), F.max(d).alias("applied_ms"), F.count_if((start < 0) | (end < 0)).alias("clipped"), F.count_if(changed).alias("affected"))


def round_away(x):
    """Half away from zero."""
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast(LONG)


def percent_delta(cues: DataFrame, percent) -> DataFrame:
    """cues with delta_ms: that share (a number, or a column with one value for each document) of the document's last end; 0
    where that isn't positive or the share isn't a finite number."""
    total = F.max("end_ms").over(Window.partitionBy("doc_id"))
    share = percent.cast("double") if isinstance(percent, Column) else F.lit(float(percent))
    finite = share.isNotNull() & ~F.isnan(share) & (F.abs(share) != float("inf"))
    return cues.withColumn("delta_ms", F.when((total > 0) & finite, round_away(total * share / F.lit(100.0))).otherwise(F.lit(0).cast(LONG)))


def shift_percent(cues: DataFrame, percent) -> DataFrame:
    return shift_ms(percent_delta(cues, percent), F.col("delta_ms")).drop("delta_ms")


def shift_percent_report(cues: DataFrame, percent) -> DataFrame:
    """shift_report of a percentage shift."""
    return shift_report(percent_delta(cues, percent), F.col("delta_ms"))


def shift_by_table(cues: DataFrame, control: DataFrame) -> DataFrame:
    """Each document moved by its own amount in control (doc_id, shift_ms); documents without one stay. Spark broadcasts
    control if it is small."""
    rows = cues.join(control.select("doc_id", F.col("shift_ms").cast(LONG).alias("_shift")), "doc_id", "left")
    return shift_ms(rows, F.coalesce("_shift", F.lit(0).cast(LONG))).drop("_shift")


def snapped(cues: DataFrame, fps: tuple[int, int]) -> DataFrame:
    """Starts and ends on the nearest frames, and whether one of them moved (column snapped)."""
    start, end = (snap_to_frame(c, *fps) for c in ("start_ms", "end_ms"))
    return cues.withColumns({"snapped": (start != F.col("start_ms")) | (end != F.col("end_ms")), "start_ms": start, "end_ms": end})


def by_start(cues: DataFrame) -> DataFrame:
    """Stably sorted by start: seq is the new place, moved tells whether another cue stood there before."""
    w = Window.partitionBy("doc_id").orderBy("start_ms", "seq")
    file = Window.partitionBy("doc_id").orderBy("seq")
    rows = cues.withColumns({"_new": F.row_number().over(w), "_old": F.row_number().over(file), "_own": full(cues)})
    # Each cue stands twice, at its new and at its old place, so that a look at the next row finds the cue that stood at the
    # new place: linear in a document's cues, and no further exchange.
    rest = F.struct(*(c for c in cues.columns if c not in ("doc_id", "seq")))
    new = F.struct(F.col("_new").alias("place"), F.lit(0).alias("kind"), F.col("_own").alias("own"), rest.alias("rest"))
    old = F.struct(F.col("_old").alias("place"), F.lit(1).alias("kind"), F.col("_own").alias("own"), F.lit(None).alias("rest"))
    both = rows.select("doc_id", F.explode(F.array(new, old)).alias("_x")).select("doc_id", "_x.*")
    there = F.lead("own").over(Window.partitionBy("doc_id").orderBy("place", "kind"))
    found = both.withColumn("moved", ~there.eqNullSafe(F.col("own"))).where("kind = 0").withColumn("seq", (F.col("place") - 1).cast(LONG))
    return found.select("doc_id", "seq", "rest.*", "moved").select(*cues.columns, "moved")


def by_start_in_ranges(cues: DataFrame, partitions: int | None = None) -> DataFrame:
    """by_start() for documents of any length: places by ranges, in the new and the old order, joined by place."""
    new = places(cues, "start_ms", "seq", partitions=partitions)
    old = places(cues, "seq", partitions=partitions).select("doc_id", "place", full(cues).alias("_there"))
    rows = new.withColumn("_own", full(cues)).join(old, ["doc_id", "place"])
    return rows.withColumns({"moved": ~F.col("_own").eqNullSafe(F.col("_there")), "seq": F.col("place")}).select(*cues.columns, "moved")


def renumbered(cues: DataFrame, ranges: bool = False, partitions: int | None = None) -> DataFrame:
    """cue_no from 1 in the order of seq, and whether it changed (column numbered). ranges: for documents of any length."""
    if ranges:
        rows = places(cues, "seq", partitions=partitions).withColumn("_n", F.col("place") + 1).drop("place")
    else:
        rows = cues.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")).cast(LONG))
    return rows.withColumns({"numbered": F.col("_n") != F.col("cue_no"), "cue_no": F.col("_n")}).drop("_n")


def at_least_a_frame(cues: DataFrame, fps: tuple[int, int]) -> DataFrame:
    return cues.withColumn("end_ms", F.when(F.col("end_ms") <= F.col("start_ms"), F.col("start_ms") + frame_ms(*fps)).otherwise(F.col("end_ms")))


def normalize(cues: DataFrame, fps: tuple[int, int] | None = None, sort: bool = True, renumber: bool = True, ranges: bool = False) -> DataFrame:
    """Snap, sort, renumber and lengthen to a frame, in that order, with the flags of each step. All windows are by doc_id:
    one exchange. ranges: for documents of any length, places come from ranges instead."""
    out = snapped(cues, fps) if fps else cues.withColumn("snapped", F.lit(False))
    out = (by_start_in_ranges(out) if ranges else by_start(out)) if sort else out.withColumn("moved", F.lit(False))
    out = renumbered(out, ranges) if renumber else out.withColumn("numbered", F.lit(False))
    return at_least_a_frame(out, fps) if fps else out


def normalize_report(normalized: DataFrame) -> DataFrame:
    return normalized.groupBy("doc_id").agg(F.count_if("snapped").alias("snapped"), F.count_if("moved").alias("sorted"), F.count_if("numbered").alias("renumbered"), F.greatest(F.max("end_ms"), F.lit(0).cast(LONG)).alias("total_ms"))


def overlap_pairs(cues: DataFrame, chunk: int | None = None) -> DataFrame:
    """Neighbours in file order, both with valid times, the first of which ends after the second starts. chunk: for documents
    of any length, as in with_neighbours()."""
    rows = with_neighbours(cues, F.struct("cue_no", "start_ms", "end_ms"), chunk).withColumnRenamed("after", "b")
    over = F.col("end_ms") - F.col("b.start_ms")
    return rows.where(m.timing_valid() & (F.col("b.end_ms") >= F.col("b.start_ms")) & (over > 0)).select("doc_id", F.col("cue_no").alias("cue_a"), F.col("b.cue_no").alias("cue_b"), over.alias("overlap_ms"))
