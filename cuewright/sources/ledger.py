"""A collection of files, read once each: a ledger of what has been read, decoded texts in few Parquet files, and what they
were parsed into.

ingest() compares a folder's listing with the ledger (path, length, time of change) by an anti-join and takes new and changed
files only, a batch at a time: their texts are decoded once and written together, parsed from there, and then entered into
the ledger. That entry is the commit: a batch that failed before it leaves the ledger as it was, is taken again by the next
run and overwrites its own folder. A path's last batch counts, so a changed file's older rows vanish from all tables.

One ingest at a time: two at once would take the same number. Files that are deleted later stay in the collection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.sources.decode import REPORT
from cuewright.sources.parse import Parsed, parse_files, recognised

#: Up to so many new files are read by a list of their paths (Spark lists more paths than that by a task each); more by the
#: time of change of the oldest, and a join.
LISTED = 32
ENTRY = "path string, doc_id bigint, length bigint, modified timestamp"
FILE = f"doc_id bigint, path string, text string, encoding {REPORT}, crlf boolean, format string"


class Collection:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def committed(self) -> int:
        """The number of batches in the ledger."""
        context, n = self.spark.sparkContext, 0
        hadoop = context._jvm.org.apache.hadoop.fs.Path
        store = hadoop(self.root).getFileSystem(context._jsc.hadoopConfiguration())
        while store.exists(hadoop(f"{self.root}/ledger/batch={n}/_SUCCESS")):
            n += 1
        return n

    def read(self, name: str, schema: str) -> DataFrame:
        """A table's rows of committed batches, with batch."""
        n = self.committed()
        if not n:
            return self.spark.createDataFrame([], f"{schema}, batch int")
        return self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.root}/{name}").where(F.col("batch") < n)

    def ledger(self) -> DataFrame:
        """path, doc_id, length, modified, batch: of each path its last entry."""
        rows = self.read("ledger", ENTRY)
        last = F.max_by(F.struct("doc_id", "length", "modified", "batch"), "batch")
        return rows.groupBy("path").agg(last.alias("e")).select("path", "e.*")

    def below(self, path: str, glob: str = "*") -> DataFrame:
        """The files below path, listed once: path, modificationTime, length and content, which is read only where it is asked
        for."""
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)

    @staticmethod
    def listing(files: DataFrame) -> DataFrame:
        """path, doc_id, length, modified of files. No content is read."""
        return files.select("path", F.xxhash64("path").alias("doc_id"), "length", F.col("modificationTime").alias("modified"))

    def contents(self, files: DataFrame, new: DataFrame) -> DataFrame:
        """doc_id, path, content of the new ones of files. Those older than the oldest of them aren't opened."""
        some = [r.path for r in new.select("path").limit(LISTED + 1).collect()]
        if len(some) <= LISTED:
            files = self.spark.read.format("binaryFile").load(some)
        else:
            files = files.where(F.col("modificationTime") >= F.lit(new.agg(F.min("modified")).first()[0]))
        return files.join(new.select("path", "doc_id"), "path").select("doc_id", "path", "content")

    def ingest(self, path: str, glob: str = "*", chunk: int | None = None) -> int | None:
        """Take what is new or changed below path as the next batch, and return its number; None if there is nothing. chunk: as in
        parse_files()."""
        number = self.committed()
        batch = f"batch={number}"
        files = self.below(path, glob)
        seen, listing = self.ledger(), self.listing(files)
        pending = f"{self.root}/pending/{batch}"
        listing.join(seen, ["path", "length", "modified"], "left_anti").select("path", "doc_id", "length", "modified").write.mode("overwrite").parquet(pending)
        new = self.spark.read.schema(ENTRY).parquet(pending)
        if new.isEmpty():
            return None
        twins = seen.select("path", "doc_id").unionByName(new.select("path", "doc_id")).distinct().groupBy("doc_id").count().where("count > 1").head()
        if twins:
            raise ValueError(f"two paths share the id {twins.doc_id}")
        recognised(self.contents(files, new)).write.mode("overwrite").parquet(f"{self.root}/files/{batch}")
        texts = self.spark.read.schema(FILE).parquet(f"{self.root}/files/{batch}")
        parse_files(texts, chunk).rows.write.mode("overwrite").partitionBy("kind").parquet(f"{self.root}/rows/{batch}")
        new.hint("rebalance").write.mode("overwrite").parquet(f"{self.root}/ledger/{batch}")
        return number

    def current(self, rows: DataFrame) -> DataFrame:
        """Of rows with doc_id and batch those of each document's last batch."""
        return rows.join(self.ledger().select("doc_id", "batch"), ["doc_id", "batch"], "left_semi")

    def files(self) -> DataFrame:
        """doc_id, path, text, encoding, crlf, format of all files as they are now."""
        return self.current(self.read("files", FILE)).drop("batch")

    def parsed(self) -> Parsed:
        """All documents as they are now."""
        n = self.committed()
        if not n:
            return parse_files(self.spark.createDataFrame([], FILE))
        # The files tell their shape; building a parse for it would cost the driver more.
        rows = self.spark.read.parquet(f"{self.root}/rows").where(F.col("batch") < n)
        return Parsed(self.current(rows).drop("batch"))

    def rejects(self) -> DataFrame:
        """doc_id, path, encoding of files of no known format."""
        return self.parsed().documents.where("format is null").select("doc_id", "path", "encoding")
