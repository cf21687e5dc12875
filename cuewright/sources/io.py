"""Files in, files out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.operators.rules import KINDS, Thresholds
from cuewright.sources.parse import Parsed, parse_files, recognised
from cuewright.sources.sink import write_files


def raw_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """doc_id (the path's hash), path, content of every file below path that isn't empty (Spark's reader skips empty files)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """doc_id, path, text, encoding, crlf, format of every file below path; files of no known format have a null format and
    none is an error."""
    return recognised(raw_files(spark, path, glob))


def read_parsed(spark: SparkSession, path: str, glob: str = "*", chunk: int | None = None) -> Parsed:
    """The files below path, each parsed by its format; documents have the path."""
    return parse_files(read_files(spark, path, glob), chunk)


def write_documents(rendered: DataFrame, path: str, buckets: int = 16) -> None:
    """Rendered documents (doc_id, text) as Parquet, by a hash of doc_id; an existing path is an error."""
    rendered.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).write.mode("errorifexists").partitionBy("bucket").parquet(path)


def write_text_files(rendered: DataFrame, path: str, form: str | None = None, names: DataFrame | None = None) -> None:
    """One UTF-8 file without a mark for each rendered document (doc_id, text): by its name in names (doc_id, name, without an
    extension), or else its doc_id, with the format's extension (form, or the column format)."""
    rows = rendered if names is None else rendered.join(names.select("doc_id", "name"), "doc_id", "left")
    own = F.coalesce("name", F.col("doc_id").cast("string")) if names is not None else F.col("doc_id").cast("string")
    write_files(rows.select(F.concat(own, F.lit("."), F.lit(form) if form else F.col("format")).alias("name"), "text"), path)


def write_reports(path: str, **reports: DataFrame) -> None:
    """Reports of several kinds and shapes (each with doc_id) in one table, doc_id, kind and report, a VARIANT, with a folder for
    each kind. An existing path is an error."""
    rows = [df.select("doc_id", F.lit(kind).alias("kind"), F.to_variant_object(F.struct(*(c for c in df.columns if c != "doc_id"))).alias("report")) for kind, df in reports.items()]
    reduce(DataFrame.unionByName, rows).write.mode("errorifexists").partitionBy("kind").parquet(path)


def read_reports(spark: SparkSession, path: str, *kinds: str) -> DataFrame:
    """doc_id, kind, report of what write_reports() wrote; only the files of those kinds are read, where some are named."""
    rows = spark.read.schema("doc_id bigint, kind string, report variant").parquet(path)
    return rows.where(F.col("kind").isin(*kinds)) if kinds else rows


def report_json(reports: DataFrame) -> DataFrame:
    """doc_id, report: each row as a JSON object."""
    return reports.select("doc_id", F.to_json(F.struct(*reports.columns)).alias("report"))


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """Threshold profiles from JSON files: missing fields are the defaults, malformed files an error."""
    schema = ", ".join(f"{k} {v}" for k, v in KINDS.items())
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)
    return rows.select(*(F.coalesce(k, F.lit(v).cast(KINDS[k])).alias(k) for k, v in vars(Thresholds()).items()))


def parse_profile(text):
    """A profile from JSON text in a column, as a struct with defaults."""
    own = F.from_json(text, ", ".join(f"{k} {v}" for k, v in KINDS.items()), {"mode": "FAILFAST"})
    return F.struct(*(F.coalesce(own[k], F.lit(v).cast(KINDS[k])).alias(k) for k, v in vars(Thresholds()).items()))
