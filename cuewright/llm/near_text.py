"""Near-duplicate texts by b-bit MinHash.

A text's set is its distinct 5-word shingles (words as in words.py, A-Z lower-cased; fewer than five words are one
shingle; no words: empty and linked with nothing). Texts with equal sets are one class. Each class has HASHES minima;
BANDS bands of ROWS minima give bucket keys, and only the low BITS bits of each minimum are kept, packed as planes of
bits. Classes that share a bucket are candidates; bit counts of the planes estimate their similarity, corrected for
chance collisions of BITS bits, and candidates far below the threshold go. The rest is confirmed on full sets.

Groups of any size: a text of whose shingles too many occur in no other candidate can't link and is shed. Only what joins
components matters, so a bucket's pairs aren't all listed. Some rounds compare each bucket's classes with one pivot, unless
they are known to be connected. Then what is left must meet: in buckets of up to SMALL classes, those outside the largest
component meet the classes of the others; in larger ones classes are told apart by how they differ from the pivot, and only
those meet that share a rare difference (see differing()). No link between components is lost either way.

Chance of missing a link of similarity s: (1 - s**ROWS)**BANDS; 2e-8 at 0.85, 6e-6 at 0.8.
Null doc_id: such a document's links count, but it gives no component its name; alone it is kept, with a null
component. Rows with equal doc_id are each judged by their own text.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.llm.common import PART_BYTES, forget, lighten, own_name, table, tidy, written
from cuewright.llm.components import components
from cuewright.llm.words import shingle_sets, slices

BANDS, ROWS, BITS, PIVOT_ROUNDS, SMALL = 24, 4, 2, 2, 48
#: Sets that are taken apart at once.
PART = 256
HASHES = BANDS * ROWS
PLANES = BITS * (-(-HASHES // 64))
MULTIPLY, ADD = (np.random.default_rng(7).integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) for _ in range(2))
MULTIPLY |= np.uint32(1)
BAND_MULTIPLY = np.random.default_rng(11).integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, HASHES) 32-bit minima; sets aren't empty."""
    x = np.concatenate(sets)
    x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), HASHES), np.uint32)
    for j in range(HASHES):
        y = x * MULTIPLY[j] + ADD[j]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[:, j] = np.minimum.reduceat(y, at)
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """(sets, PLANES) 64-bit planes of the low BITS bits."""
    out = []
    for bit in range(BITS):
        bits = np.zeros((len(low), PLANES // BITS * 64), np.uint8)
        bits[:, :HASHES] = low >> np.uint32(bit) & np.uint32(1)
        out.append(np.packbits(bits, axis=1, bitorder="little").view("<i8"))
    return np.concatenate(out, axis=1)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, key (of the set; null if empty), buckets, planes for each row."""
    kinds = "doc_id long, text_hash long, n_shingles long, key binary, buckets array<long>, planes array<long>"

    @tidy
    def run(batches):
        lighten()
        for batch in batches:
            doc_id, text_hash, text = batch.columns
            for at, data, offsets in slices(text, PART_BYTES):
                sets = shingle_sets(data, offsets)
                full = [s for s in sets if len(s)]
                keys = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                buckets, planes = [None] * len(sets), [None] * len(sets)
                if full:
                    low = minima(full)
                    bands = (low.reshape(-1, BANDS, ROWS).astype(np.uint64) * BAND_MULTIPLY).sum(2) ^ np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    for i, b, p in zip([i for i, s in enumerate(sets) if len(s)], bands.view(np.int64), packed(low), strict=True):
                        buckets[i], planes[i] = b, p
                n = len(sets)
                yield pa.RecordBatch.from_arrays([doc_id.slice(at, n), text_hash.slice(at, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64())), pa.array(planes, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_shingles", "key", "buckets", "planes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text"))
    return rows.mapInArrow(run, kinds)


def estimate(a: str, b: str) -> Column:
    """Similarity estimated from two packed signatures: the share of equal low parts, less those equal by chance."""
    words, differ = PLANES // BITS, F.lit(0)
    for w in range(words):
        x = F.lit(0).cast("long")
        for bit in range(BITS):
            x = x.bitwiseOR(F.col(a)[bit * words + w].bitwiseXOR(F.col(b)[bit * words + w]))
        differ = differ + F.bit_count(x)
    chance = 1 / (1 << BITS)
    return (1 - differ / HASHES - chance) / (1 - chance)


def slack(threshold: float, sigmas: float = 6.0) -> float:
    """How far below the threshold an estimate may fall."""
    chance = 1 / (1 << BITS)
    p = threshold + (1 - threshold) * chance
    return threshold - sigmas * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles (sorted 64-bit hashes as bytes) of nodes (node, doc_id, text_hash), from the whole texts."""

    @tidy
    def run(batches):
        lighten()
        for batch in batches:
            for at, data, offsets in slices(batch.columns[1], PART_BYTES):
                yield pa.RecordBatch.from_arrays([batch.columns[0].slice(at, len(offsets) - 1), pa.array([s.tobytes() for s in shingle_sets(data, offsets)], pa.binary())], names=["node", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").alias("text"))
    found = rows.join(nodes.select("node", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return found.select("node", "text").dropDuplicates(["node"]).mapInArrow(run, "node long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    @tidy
    def run(batches):
        lighten()
        for batch in (b.slice(at, PART) for b in batches for at in range(0, len(b), PART)):
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = 0
                if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                    small, large = (x, y) if len(x) <= len(y) else (y, x)
                    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[place] == small).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def linkable(sets: DataFrame, percent: int) -> DataFrame:
    """node, size, free of the sets that may link at all. free is the number of shingles that some other of these sets
    has too: the others can't be shared, so a set with too few of them has no partner. Exact."""

    @tidy
    def run(batches):
        lighten()
        for batch in (b.slice(at, PART) for b in batches for at in range(0, len(b), PART)):
            own = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), [len(x) for x in own])), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))], names=["node", "x"])

    one = sets.mapInArrow(run, "node long, x long").groupBy("x").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    alone = one.groupBy("node").agg(F.count("*").alias("alone"))
    out = sets.select("node", (F.length("shingles") / 8).cast("int").alias("size")).join(alone, "node", "left")
    out = out.select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).cast("int").alias("free"))
    return out.where(100 * F.col("free") >= percent * F.col("size"))


def shared_only(rows: DataFrame) -> DataFrame:
    """rows (bucket, node) of buckets with two nodes or more."""
    shared = rows.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket")
    return rows.join(shared, "bucket", "left_semi")


def hopeful(rows: DataFrame, percent: int) -> DataFrame:
    """rows (bucket, node, size, free) without those that can't link with any set of their bucket: the partner has at
    least the bucket's smallest size, and shares at most what is free. Sheds the members of groups of texts that are alike
    but not enough, in one pass over the bucket."""
    least = rows.groupBy("bucket").agg(F.min("size").alias("least"))
    bound = F.col("size") + F.greatest("least", "free") - F.col("free")
    return rows.join(least, "bucket").where(100 * F.col("free") >= percent * bound).drop("least")


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether two sets' sizes and free shingles allow the similarity."""
    both = F.least(f"{a}free", f"{b}free")
    return 100 * both >= percent * (F.col(f"{a}size") + F.col(f"{b}size") - both)


def pivot_order() -> Column:
    """Least for a bucket's pivot: the class with the largest share of shingles that others have too."""
    return F.struct(-F.col("free") / F.col("size"), "node")


def rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    return rows.withColumn("root", F.col("node")) if roots is None else rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).distinct()


def with_pivots(at: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components, of which one is the bucket's k-th pivot, that may link."""
    pivot = F.min_by(F.struct("node", "root", "size", "free"), F.xxhash64("node", F.lit(k)) if k else pivot_order()).alias("pivot")
    still = at.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), pivot).where("low < high")
    pairs = at.join(still.select("bucket", F.col("pivot.node").alias("x"), F.col("pivot.root").alias("x_root"), F.col("pivot.size").alias("x_size"), F.col("pivot.free").alias("x_free")), "bucket")
    return ordered(pairs.where((F.col("root") != F.col("x_root")) & may_link("", "x_", percent)))


def outside_largest(at: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may link, of buckets of few classes: one is outside the largest component."""
    largest = at.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    outside = at.join(largest, "bucket").where("root <> main").select("bucket", F.col("node").alias("x"), F.col("root").alias("x_root"), F.col("size").alias("x_size"), F.col("free").alias("x_free"))
    return ordered(outside.join(at, "bucket").where((F.col("root") != F.col("x_root")) & may_link("", "x_", percent)))


def differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """p, node, root, size, p_size, d (number of shingles that just one of node and pivot p has), element (each of them)."""

    @tidy
    def run(batches):
        lighten()
        for batch in (b.slice(at, PART) for b in batches for at in range(0, len(b), PART)):
            parts = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                parts.append(np.setxor1d(np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64), assume_unique=True))
            d = np.array([len(x) for x in parts], np.int64)
            own = [pa.array(np.repeat(batch.column(c).to_numpy(), d)) for c in ("p", "node", "root", "size", "p_size")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.repeat(d, d)), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))], names=["p", "node", "root", "size", "p_size", "d", "element"])

    own = members.join(sets.select("node", F.col("shingles").alias("x")), "node").join(sets.select(F.col("node").alias("p"), F.col("shingles").alias("y")), "p")
    rows = own.select("p", "node", F.col("root").cast("long"), F.col("size").cast("long"), (F.length("y") / 8).cast("long").alias("p_size"), "x", "y")
    return rows.mapInArrow(run, "p long, node long, root long, size long, p_size long, d long, element long")


def differing(at: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components of large buckets that may link.

    D(a) is the symmetric difference of a's set and the pivot's p. a and b link if |D(a) ^ D(b)| <= c (|a| + |b|) with
    c = (1 - t) / (1 + t), so they share at least o = (|D(a)| + |D(b)| - c (|a| + |b|)) / 2 differences. Classes that link
    with p are in its component, so of a pair still to be found one, y, doesn't: |D(y)| > c (|y| + |p|). Then o > 0, more
    than about half of the other's differences, and at least |D(y)| - |y| (1 - t) / t. Sorted by rarity, two sets that share
    o elements share one of their first |D| - o + 1: only those are joined, and a difference that nobody shares takes a place
    there for nothing. Texts with edits of their own so meet few others, however large the group is."""
    pivots = at.groupBy("bucket").agg(F.min_by("node", pivot_order()).alias("p"))
    members = at.join(pivots, "bucket").select("p", "node", "root", "size", "free").distinct()
    rows = written(differences(members, sets), "differences")
    often = rows.groupBy("p", "element").agg(F.count("*").alias("n")).where("n > 1")
    own = Window.partitionBy("p", "node")
    shared = rows.join(often, ["p", "element"]).withColumn("f", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("n", "element")) + F.col("d") - F.col("f"))
    least = {
        "short": F.ceil((F.col("d") * (100 + percent) + (100 - percent) * F.least(F.lit(0), F.col("p_size") - F.col("size"))) / (2 * (100 + percent)) - 1e-9),
        "long": F.ceil(F.col("d") - F.col("size") * (100 - percent) / percent - 1e-9),
    }
    fits = {k: F.col("place") <= F.col("d") - F.greatest(F.lit(1), o) + 1 for k, o in least.items()}
    apart = F.col("d") * (100 + percent) > (100 - percent) * (F.col("size") + F.col("p_size"))
    shared = written(shared.select("p", "element", "node", "root", "size", "d", "f", fits["short"].alias("short"), (fits["long"] & apart).alias("long")).where("short or long"), "shared")
    y = shared.where("long").select("p", "element", F.col("node").alias("x"), F.col("root").alias("x_root"), F.col("size").alias("x_size"), F.col("d").alias("x_d"), F.col("f").alias("x_f"))
    enough = 2 * F.least("f", "x_f") * (100 + percent) >= (F.col("d") + F.col("x_d")) * (100 + percent) - (100 - percent) * (F.col("size") + F.col("x_size"))
    sizes = 100 * F.least("size", "x_size") >= percent * F.greatest("size", "x_size")
    return ordered(shared.where("short").join(y, ["p", "element"]).where((F.col("root") != F.col("x_root")) & enough & sizes))


def left_over(rows: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may link two components of any bucket."""
    at = rooted(rows, roots)
    kinds = at.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket", "n")
    at = written(at.join(kinds, "bucket"), "left")
    few, many = at.where(F.col("n") <= SMALL), at.where(F.col("n") > SMALL)
    found = outside_largest(few.drop("n"), percent)
    return found if many.isEmpty() else found.unionByName(differing(many, sets, percent)).distinct()


def near_components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    signed = written(signatures(docs), "signatures")
    one = F.min_by(F.struct("doc_id", "text_hash", "buckets", "planes"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    classes = signed.where("key is not null").groupBy("key").agg(one.alias("one")).select("key", "one.*")
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = written(shared_only(classes.select("node", F.explode("buckets").alias("bucket"))), "buckets")
    sets = written(full_sets(docs, classes.join(rows.select("node").distinct(), "node", "left_semi")), "sets")
    all_rows, rows = rows, written(shared_only(hopeful(rows.join(linkable(sets, percent), "node"), percent)), "buckets")
    forget(all_rows)
    planes, roots = classes.select("node", "planes"), None
    for k in range(PIVOT_ROUNDS + 1):
        pairs = with_pivots(rooted(rows, roots), k, percent) if k < PIVOT_ROUNDS else left_over(rows, roots, sets, percent)
        pairs = pairs.join(planes.select(F.col("node").alias("a"), F.col("planes").alias("x")), "a").join(planes.select(F.col("node").alias("b"), F.col("planes").alias("y")), "b")
        new = confirmed(pairs.where(estimate("x", "y") >= slack(percent / 100)).select("a", "b"), sets, percent)
        new = new if roots is None else new.unionByName(roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))
        roots = components(new)
    roots = written(roots, "roots")
    forget(rows, sets)
    named = classes.select("key", "node", F.col("doc_id").alias("own")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("own").alias("component_id"))
    named = named.join(names, "root").select(F.col("key").alias("_key"), "component_id", F.col("node").alias("_node"))
    out = signed.select("doc_id", "text_hash", "n_shingles", "key").join(named, F.col("key") == F.col("_key"), "left")
    out = out.withColumn("component_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the rows that are near copies of a kept one: a component keeps the text of its smallest doc_id."""
    text_hash, own_id, own_hash = (own_name(docs, c) for c in ("near_hash", "near_kept_id", "near_kept_hash"))
    one = written(near_components(docs, percent).where("kept").select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)), "kept")
    repeated = not one.groupBy(own_id, own_hash).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    rows = docs.withColumn(text_hash, F.xxhash64("text"))
    same = (F.col(text_hash) == F.col(own_hash)) & F.col("doc_id").cast("long").eqNullSafe(F.col(own_id))
    found = rows.join(one, same, "left_semi")
    # Only rows that repeat both id and text need another exchange: one of them stays.
    return (found.dropDuplicates(["doc_id", text_hash]) if repeated else found).select(*docs.columns)


def op7_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), 85).select("doc_id", "n_shingles", "component_id", "kept")
