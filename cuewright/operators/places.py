"""Order within documents of any length: neighbours and places without a window over a whole document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: monotonically_increasing_id() holds the partition above this many bits.
PARTITION_BITS = 33


def with_neighbours(rows: DataFrame, own: Column, chunk: int | None = None) -> DataFrame:
    """rows (doc_id, seq) with before and after, own of the row before and after in the order of seq; null at the ends.

    Where chunk is given, a window holds the rows of `chunk` successive values of seq, and each chunk's first and last row
    are carried to the chunks beside it: a document of n rows brings n / chunk rows together, not n."""
    if chunk is None:
        w = Window.partitionBy("doc_id").orderBy("seq")
        return rows.withColumn("before", F.lag(own).over(w)).withColumn("after", F.lead(own).over(w))
    rows = rows.withColumn("_chunk", F.floor(F.col("seq") / chunk)).withColumn("_own", own)
    ends = rows.groupBy("doc_id", "_chunk").agg(F.min_by("_own", "seq").alias("first"), F.max_by("_own", "seq").alias("last"))
    beside = Window.partitionBy("doc_id").orderBy("_chunk")
    halo = ends.select("doc_id", "_chunk", F.lag("last").over(beside).alias("_before"), F.lead("first").over(beside).alias("_after"))
    w = Window.partitionBy("doc_id", "_chunk").orderBy("seq")
    rows = rows.join(halo, ["doc_id", "_chunk"])
    rows = rows.withColumns({"before": F.coalesce(F.lag("_own").over(w), "_before"), "after": F.coalesce(F.lead("_own").over(w), "_after")})
    return rows.drop("_chunk", "_own", "_before", "_after")


def places(rows: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    """rows with place, their number (from 0) in their document in the given order, which must tell any two rows apart.

    Rows are dealt by ranges of (doc_id, order), so that a long document lies in several partitions, and kept by checkpoint(),
    since the ranges come from a sample. A place is the row's number in its document's part of a partition plus the sizes
    of the parts before, which are one row each. spark.checkpoint.dir must be set."""
    by = ["doc_id", *order]
    dealt = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    dealt = dealt.sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()).checkpoint().withColumn("_part", F.shiftright("_id", PARTITION_BITS))
    sizes = dealt.groupBy("doc_id", "_part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("doc_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("doc_id", "_part", F.coalesce(earlier, F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("doc_id", "_part").orderBy("_id")) - 1
    return dealt.join(offsets, ["doc_id", "_part"]).withColumn("place", (own + F.col("_offset")).cast("bigint")).drop("_id", "_part", "_offset")
