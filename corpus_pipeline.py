"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

A stage works on all that its predecessor kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuewright.llm.common import TOKENIZERS, table, written
from cuewright.llm.fertility import keep_good
from cuewright.llm.line_runs import keep_first_runs
from cuewright.llm.near_text import keep_one
from cuewright.llm.soft_mixing import take_mixed
from cuewright.llm.trie_bpe import encode_decode


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut out; a document left without words goes."""
    return keep_first_runs(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more) stays."""
    return keep_one(docs, 80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken at rates that bring the domains' tokens to their targets."""
    return take_mixed(docs, table(spark, sf_dir, "labels"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, tokens, their number and digests, and the decoded text's digest."""
    return encode_decode(docs, f"{TOKENIZERS}/byte_bpe_50k.json", with_tokens=True).drop("decoded")


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("mixing", mixing), ("BPE encoding", encoding)]

#: The fertility bands, b-bit signatures, fitted rates and merges aren't expressible in SQL; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
