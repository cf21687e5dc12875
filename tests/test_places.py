"""Documents of any length: the same findings, pairs and places without a window over a whole document."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.operators import places, retime, rules
from cuewright.operators.compare import differences


@pytest.fixture(scope="module")
def cues(spark):
    """Damaged cues of one long document, some short ones and one of a single cue; starts tie, and seq has gaps."""
    rng, rows = np.random.default_rng(9), []
    for doc, n in ((1, 301), (2, 1), (3, 2), (4, 40), (5, 7)):
        seq = np.sort(rng.choice(3 * n, n, replace=False))
        for k, s in enumerate(seq):
            start = int(rng.integers(0, 40)) * 500
            rows.append((doc, int(s), k + 1 + int(rng.integers(0, 2)), start, start + int(rng.integers(-500, 3000)), "x" * int(rng.integers(0, 60))))
    return spark.createDataFrame(rows, "doc_id bigint, seq bigint, cue_no bigint, start_ms bigint, end_ms bigint, text string").repartition(5)


def same(left, right):
    return sorted(map(repr, left.select(right.columns).collect())) == sorted(map(repr, right.collect()))


@pytest.mark.parametrize("chunk", [1, 2, 100])
def test_halo_rows(cues, chunk):
    assert same(rules.check(cues, chunk=chunk), rules.check(cues)) and same(retime.overlap_pairs(cues, chunk), retime.overlap_pairs(cues))


def test_halo_windows(cues):
    """Cues are in windows of (document, chunk) only; windows by document hold a row for each chunk."""
    plan = rules.check(cues, chunk=2)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"windowspecdefinition\((.*?), seq", plan) and all("_chunk" in k for k in re.findall(r"windowspecdefinition\(([^()]*?), seq", plan))


def test_places(cues):
    """Three partitions cut through one document; places go on."""
    one = cues.where("doc_id = 1")
    got = places.places(one, "start_ms", "seq", partitions=3)
    want = {r.seq: k for k, r in enumerate(sorted(one.collect(), key=lambda r: (r.start_ms, r.seq)))}
    rows = got.withColumn("part", F.spark_partition_id()).collect()
    assert {r.seq: r.place for r in rows} == want
    dealt = one.repartitionByRange(3, "doc_id", "start_ms", "seq").groupBy(F.spark_partition_id()).count().count()
    assert dealt == 3


@pytest.mark.parametrize("partitions", [3, 8])
def test_sorting_by_ranges(cues, partitions):
    assert same(retime.by_start_in_ranges(cues, partitions), retime.by_start(cues))
    assert same(retime.renumbered(cues, True, partitions), retime.renumbered(cues))


def test_normalize_by_ranges(cues):
    assert same(retime.normalize(cues, (25, 1), ranges=True), retime.normalize(cues, (25, 1)))


def test_differences(spark):
    """One side only, repeated, changed fields, nulls as equal, columns in another order."""
    schema = "k bigint, a string, b bigint"
    left = spark.createDataFrame([(1, "x", 1), (2, "x", None), (3, None, 1), (4, "l", 1), (6, "t", 1), (6, "t", 1), (7, "p", 3)], schema)
    right = spark.createDataFrame([(1, "x", 1), (2, "x", None), (3, "y", 2), (5, "r", 1), (6, "t", 1), (7, "p", 4)], schema).select("b", "k", "a")
    got = {r.k: (r.kind, r.fields) for r in differences(left, right, "k").collect()}
    assert got == {3: ("changed", ["a", "b"]), 4: ("left", []), 5: ("right", []), 6: ("repeated", []), 7: ("changed", ["b"])}
    assert differences(left.limit(0), right.limit(0), "k").count() == 0
    plan = differences(left, right, "k")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange", plan)) == 1
