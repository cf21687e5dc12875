"""Decoded files of mixed formats to tables of cues, styles, headers and syntax errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.sources.decode import decoded
from cuewright.sources.detect import detect_format, forced_format
from cuewright.sources.scan import FORMATS, tagged


@dataclass
class Parsed:
    """rows: doc_id, kind and, by kind, one of document, header, cue, style, error. All tables are views of these rows."""

    rows: DataFrame
    buckets: int | None = None

    def view(self, kind: str) -> DataFrame:
        return self.rows.where(F.col("kind") == kind).select("doc_id", f"{kind}.*")

    @property
    def documents(self) -> DataFrame:
        """doc_id, format (null if none is recognised), what else the files had, headers (array)."""
        return self.view("document")

    @property
    def cues(self) -> DataFrame:
        return self.view("cue")

    @property
    def styles(self) -> DataFrame:
        return self.view("style")

    @property
    def headers(self) -> DataFrame:
        return self.view("header")

    @property
    def syntax_errors(self) -> DataFrame:
        return self.view("error")

    def saved(self, path: str) -> Parsed:
        """The rows written below path as Parquet, a folder for each kind, in one job, and read again, so that what uses
        them doesn't parse anew."""
        self.rows.write.mode("errorifexists").partitionBy("kind").parquet(path)
        return Parsed(self.rows.sparkSession.read.schema(self.rows.schema).parquet(path))


    def saved_as(self, table: str) -> Parsed:
        """The rows as a catalog table, partitioned by kind, bucketed and sorted by doc_id: checking, normalising and rendering it
        need no exchange any more, nor do joins of its views. The parse must have been told the buckets; each of its tasks
        then writes one file for each kind. An existing table is an error."""
        if self.buckets is None:
            raise ValueError("parse_files(..., buckets=) says how many buckets there are")
        self.rows.write.partitionBy("kind").bucketBy(self.buckets, "doc_id").sortBy("doc_id").saveAsTable(table)
        return Parsed(self.rows.sparkSession.table(table), self.buckets)


def recognised(files: DataFrame, content: str = "content", forced: str | None = None) -> DataFrame:
    """files (doc_id, content) with text, encoding, crlf and format added; content is dropped. forced: a column of formats to
    read files in; one whose own format isn't recognised stays without. Where a name is no format, that is an error of the
    caller's, and the file has none."""
    rows = decoded(files, content).drop(content).withColumn("crlf", F.contains("text", F.lit("\r\n")))
    if forced is None:
        return rows.withColumn("format", detect_format())
    return rows.withColumn("format", forced_format(forced)).withColumn("format", F.when(F.col("format").isin(*FORMATS), F.col("format"))).drop(forced)


def parse_files(files: DataFrame, chunk: int | None = None, buckets: int | None = None) -> Parsed:
    """files: doc_id, text, format and more, as recognised() gives them, each parsed by its format, in one scan. Files without
    a format have a document, but no cues and no errors: documents.where("format is null") are the rejects."""
    return Parsed(tagged(files, FORMATS, chunk, buckets), buckets)


def parsed_as(raw: DataFrame, form: str, chunk: int | None = None) -> Parsed:
    """raw (doc_id, text), all in one format."""
    return Parsed(tagged(raw.select("doc_id", "text", F.lit(form).alias("format")), (form,), chunk))
