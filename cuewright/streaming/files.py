"""Drop folders as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.sources.parse import recognised


def stream_files(spark: SparkSession, path: str, each, checkpoint: str, glob: str = "*"):
    """Run each(DataFrame like read_files', batch id) on new files of a drop folder; every document stands alone, so the
    batch functions apply. Returns the started query."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path)

    def batch(df: DataFrame, number: int) -> None:
        each(recognised(df.select(F.xxhash64("path").alias("doc_id"), "path", "content")), number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
