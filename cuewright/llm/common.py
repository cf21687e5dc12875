"""What the operators share: tables, the shared folder, one large object for each worker."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Where the public vocabularies lie; every operator takes another folder as a parameter.
TOKENIZERS = "/opt/tokenizers"
#: Bytes of texts that near dedup and mixing work on at once; all texts are read, in parts of this size.
PART_BYTES = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset (tests;
    on a cluster that is an error)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="cuewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again. Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def own_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_held: dict = {}


def per_worker(key, make):
    """One object for each Python worker, e.g. a loaded tokenizer with its memo: workers live on from stage to stage, so
    another key's object goes first. Its many small entries hold no cycles, so the cycle collector runs less often."""
    if key not in _held:
        gc.set_threshold(50_000, 20, 100)
        _held.clear()
        gc.collect()
        _held[key] = make()
    return _held[key]


def lighten() -> None:
    """Drop what an earlier stage's tasks have left in this Python worker."""
    if _held:
        _held.clear()
        release()


def release() -> None:
    """Give freed memory back to the system: allocators keep it, and workers live on, idle or not, beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU's C library only
    if trim:
        trim(0)


def tidy(run):
    """The function of batches run, that gives its memory back when a task ends."""

    @wraps(run)
    def out(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return out


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (Steele et al., SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
