"""Near-duplicate embeddings by collision-counting projections.

Vectors with equal labels and numbers of components are compared by cosine. Each is projected on COUNTED orthonormal lines
(as many as components, if those are fewer). On each line the projections are sorted, and a window around each vector (the
query) gives its collisions, counted for each pair. Near vectors collide on most lines, others on few, and pairs that reach
a count are verified in double precision. The count is a bound, not a likelihood: the squares of a pair's distances on
orthonormal lines add up to no more than the square of its distance, so a pair at the threshold can leave few windows of a
given width only (see calibrated()), and no pair is missed. All pairs of a label are counted: its work grows with the square
of its different vectors.

Equal vectors of a label are one node with a weight. A label of more than BLOCK nodes is dealt out as pairs of blocks, so a
task never holds a large group and each pair is met once. Each block gives, for each vector, its number of links and one
vector that stands for its component in the block: rows as many as vectors, not pairs.

Null or zero vectors, vectors with null or non-finite components, and null labels link with nothing. A null vec_id
gives no component its name.
"""

from __future__ import annotations

from functools import lru_cache
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm.common import table, written
from cuewright.llm.components import components

COUNTED, BLOCK, STRIP = 48, 2048, 256


@lru_cache(4)
def lines(dim: int) -> np.ndarray:
    """Orthonormal lines of a random direction (dim, COUNTED or dim)."""
    return np.linalg.qr(np.random.default_rng([5, dim]).standard_normal((dim, min(dim, COUNTED))))[0]


def calibrated(cosine: float, counted: int = COUNTED) -> tuple[float, int]:
    """Half-width of the window, and the least count of collisions of pairs at the cosine. They are outside the windows of k
    lines only if k squares of the half-width are less than the square of their distance: a quarter of the lines at most."""
    out = counted // 4
    return sqrt((2 - 2 * cosine) / (out + 1)) * (1 + 1e-9) + 1e-9, counted - out


def recall(cosine: float) -> float:
    """Share of pairs at the cosine that are found: all, as calibrated() gives bounds."""
    return 1.0


def collisions(x: np.ndarray, y: np.ndarray, half: float) -> np.ndarray:
    """For each query in x and each row in y the number of lines on which y lies in the query's window. Each line is
    sorted; the window is a run of the sorted order."""
    # Unsigned, so one comparison tells whether a rank lies in a run.
    kind = np.uint16 if len(y) < 1 << 16 else np.uint32
    count, place, rank = np.zeros((len(x), len(y)), np.uint8), np.arange(len(y), dtype=kind), np.empty(len(y), kind)
    for j in range(x.shape[1]):
        order = np.argsort(y[:, j])
        line = y[order, j]
        low, high = np.searchsorted(line, x[:, j] - half).astype(kind), np.searchsorted(line, x[:, j] + half, "right").astype(kind)
        rank[order] = place
        count += rank - low[:, None] < (high - low)[:, None]
    return count


def unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as unit vectors."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # By powers of two, so that squares of very large and very small components stay in range.
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nodes_of(vectors: DataFrame) -> DataFrame:
    """node, label, embedding (double), dim, vec_id, weight for each different (label, vector) that can link."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = v.where(F.col("label").isNotNull() & F.coalesce(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    one = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
    return written(one.select(F.monotonically_increasing_id().alias("node"), "label", F.size("embedding").alias("dim"), "vec_id", "weight", "embedding"), "nodes")


def joined(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """up names for each place the smallest place of its component; the same with links between i and j."""
    while True:
        a, b = up[i], up[j]
        apart = a != b
        if not apart.any():
            return up
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        up = up.copy()
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]


def group_links(side: np.ndarray | None, x: np.ndarray, spots: np.ndarray, weight: np.ndarray, node: np.ndarray, cosine: float):
    """(links, root) of the nodes of one group: all pairs, or where side tells two blocks apart those across. root is a
    node of the same component of these links."""
    half, enough = calibrated(cosine, spots.shape[1])
    left = np.arange(len(node)) if side is None else np.flatnonzero(side == 0)
    right = left if side is None else np.flatnonzero(side == 1)
    links, up = np.zeros(len(node)), np.arange(len(node))
    for at in range(0, len(left), STRIP):
        mine = left[at : at + STRIP]
        other = right[at:] if side is None else right
        i, j = np.nonzero((collisions(spots[mine], spots[other], half) >= enough) & (x[mine] @ x[other].T >= cosine))
        if side is None:
            i, j = i[i < j], j[i < j]
        i, j = mine[i], other[j]
        links += np.bincount(i, weight[j], len(node)) + np.bincount(j, weight[i], len(node))
        up = joined(up, i, j)
    return links.astype(np.int64), node[up]


def small_links(group: np.ndarray, x: np.ndarray, spots: np.ndarray, weight: np.ndarray, node: np.ndarray, cosine: float):
    """The same for many small groups at once: the pairs of rows at each distance in the sorted rows."""
    half, enough = calibrated(cosine, spots.shape[1])
    links, up = np.zeros(len(node), np.int64), np.arange(len(node))
    for d in range(1, len(node)):
        i = np.flatnonzero(group[d:] == group[:-d])
        if not len(i):
            break
        j = i + d
        near = (np.abs(spots[i] - spots[j]) <= half).sum(1) >= enough
        i, j = i[near], j[near]
        hit = (x[i] * x[j]).sum(1) >= cosine
        i, j = i[hit], j[hit]
        for mine, other in ((i, j), (j, i)):
            np.add.at(links, mine, weight[other])
        up = joined(up, i, j)
    return links, node[up]


def block_links(rows: DataFrame, cosine: float, small: int = 24) -> DataFrame:
    """For each group of rows (group, dim, two, side, node, weight, embedding): node, links (weight of the nodes that it
    links with), root (a node of its component in the group)."""

    def solve(data: pa.Table):
        data = data.combine_chunks()
        dims = data.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = data.filter(pa.array(dims == dim)).combine_chunks()
            own = {c: part.column(c).to_numpy() for c in ("group", "two", "side", "node", "weight")}
            x = unit(part.column("embedding").chunk(0))
            spots = x @ lines(int(dim))
            starts = np.flatnonzero(np.concatenate([[True], own["group"][1:] != own["group"][:-1]]))
            size = np.diff(np.append(starts, len(x)))
            links, root = np.zeros(len(x), np.int64), own["node"].copy()
            little = np.repeat((size <= small) & ~own["two"][starts], size)
            links[little], root[little] = small_links(own["group"][little], x[little], spots[little], own["weight"][little], own["node"][little], cosine)
            for a, n in zip(starts, size, strict=True):
                if not little[a]:
                    r = slice(a, a + n)
                    links[r], root[r] = group_links(own["side"][r] if own["two"][a] else None, x[r], spots[r], own["weight"][r], own["node"][r], cosine)
            got = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(own["node"][got]), pa.array(links[got]), pa.array(root[got])], names=["node", "links", "root"])

    def run(batches):
        held = None
        for batch in batches:
            data = pa.Table.from_batches([batch])
            data = data if held is None else pa.concat_tables([held, data])
            group = data.column("group").to_numpy()
            last = int(np.flatnonzero(group != group[-1])[-1]) + 1 if (group != group[-1]).any() else 0
            if last:
                yield from solve(data.slice(0, last))
            held = data.slice(last)
        if held is not None and len(held):
            yield from solve(held)

    return rows.mapInArrow(run, "node long, links long, root long")


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    nodes = nodes_of(vectors)
    kind = ["label", "dim"]
    sizes = nodes.groupBy(kind).agg(F.count("*").alias("size")).where("size > 1")
    # A label's nodes go to blocks by a hash; each pair of blocks is a group of its own.
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = nodes.join(sizes, kind).select("node", "weight", "embedding", *kind, parts.alias("n"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("own"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    full = dealt.select("node", "weight", "embedding", "dim", (F.col("p") != F.col("q")).alias("two"), "side", F.xxhash64(*kind, "p", "q").alias("group"))
    full = full.repartition("group").sortWithinPartitions("group")
    found = written(block_links(full, cosine), "links")
    degrees = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    whole = nodes.join(degrees, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = whole.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    whole = whole.join(names, "root").select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    out = rows.join(whole, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")), "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def op10_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.93)
