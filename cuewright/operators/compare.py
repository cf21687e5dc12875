"""Two tables of one shape compared by key, in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """The keys that differ: keys, kind (left, right: only one table has it; repeated: a table has it more than once; changed) and
    fields, the names of those that differ. Rows of left count +1, of right -1, in one union and one aggregation by key; values
    are compared themselves, nulls as equal. Tables may order their columns differently."""
    fields = [c for c in left.columns if c not in keys]
    side = lambda df, sign: df.select(*keys, F.struct(*fields).alias("row"), F.lit(sign).alias("sign"))
    own = lambda sign: F.first(F.when(F.col("sign") == sign, F.col("row")), ignorenulls=True)
    rows = side(left, 1).unionByName(side(right, -1)).groupBy(*keys).agg(F.sum("sign").alias("sum"), F.count("*").alias("n"), own(1).alias("l"), own(-1).alias("r"))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")), F.lit(c)) for c in fields)))
    kind = F.when(F.col("n") > 2, "repeated").when(F.col("sum") == 2, "repeated").when(F.col("sum") == -2, "repeated").when(F.col("sum") == 1, "left").when(F.col("sum") == -1, "right").when(F.size("fields") > 0, "changed")
    both = (F.col("n") == 2) & (F.col("sum") == 0)
    rows = rows.withColumn("fields", F.when(both, changed).otherwise(F.array().cast("array<string>"))).withColumn("kind", kind)
    return rows.where("kind is not null").select(*keys, "kind", "fields")
