"""Hard negatives by cover trees over norm-augmented candidates.

Candidates x become (x, sqrt(M^2 - |x|^2)), where M is the largest norm of all; an anchor q becomes (q, 0). Then
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so a ball around a centre bounds the inner products of all points in it, from above and
from below. Pivots (a bounded sample) cut the candidates into cells, a cell into shards of about SHARD rows by a hash, and
each shard gets a cover tree: nodes are nets of their parent's points, each with the radius that covers its own.

A search takes windows of scores. An anchor first visits the most promising shard; its fifth score there raises the
window's lower end, and only cells whose bounds still meet a window are visited then. In a shard, nodes are bounded level
by level, those outside all windows are skipped, and leaves are taken best bound first and verified exactly. Positives are a
search with an open window among rows of the anchor's label; each positive's score gives a window for the negatives.

Anchors are dealt in blocks of BLOCK, shards and blocks meet pairwise: each pair moves a shard (about 2 MB) and a block (up
to 4 MB), never a row for each anchor and candidate. Copies of a vector with one label count by their smallest ids only, as
no more of them can be returned; these are ranked before the shuffle, so a large group of copies never meets in one task.

Rows with a null vec_id, label or vector, or with null or non-finite components, take no part; vectors of unequal length
don't meet. Rows that repeat wholly count once; a row with the anchor's own vec_id is never its positive or negative.
Components beyond 64 bits saturate; scores must fit in 64 bits. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.llm.common import forget, table, written

SHARD, BLOCK, CELLS, FAN, LEAF, FIRST = 16_384, 8_192, 512, 16, 64, 5
BOTTOM, TOP = -(2**63), 2**63 - 1


def rows_of(column) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, exactly: in doubles where these hold all sums."""
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), np.int64)
    most = float(np.abs(x.astype(np.float64)).max()) * float(np.abs(y.astype(np.float64)).max()) * x.shape[1]
    if most < 2**52:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


def augmented(x: np.ndarray, top: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))])


def bounds(ip: np.ndarray, own: np.ndarray, radius: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of an anchor (squared norm own) with what lies within radius of a centre, given the
    centre's. Widened by what rounding can do."""
    d, slack = np.sqrt(np.maximum(own + top - 2 * ip, 0)), 1 + 1e-6 * (own + top)
    return (own + top - (d + radius) ** 2) / 2 - slack, (own + top - np.maximum(d - radius, 0) ** 2) / 2 + slack


def cover_tree(x: np.ndarray, top: float) -> dict[str, np.ndarray]:
    """A cover tree of the rows of x: order (of rows, so that a node's are a run), and for each node, level by level, centre
    (a row in that order), radius, start, end, child (its first child, 0 for a leaf) and children (their number)."""
    p, order = augmented(x, top), np.arange(len(x))
    far = lambda rows, c: np.sqrt(((p[rows] - p[c]) ** 2).sum(1))
    nodes = [[0, far(order, 0).max(initial=0.0), 0, len(x), 0, 0]]
    at = 0
    while at < len(nodes):
        centre, radius, start, end = nodes[at][:4]
        if end - start > LEAF and radius > 0:
            rows, net = order[start:end], [centre]
            near, owner = far(rows, centre), np.zeros(end - start, np.int64)
            # A net of half the radius, or of FAN centres where that takes more.
            while len(net) < FAN and near.max() > radius / 2:
                net.append(int(rows[near.argmax()]))
                d = far(rows, net[-1])
                owner[d < near], near = len(net) - 1, np.minimum(d, near)
            by = np.argsort(owner, kind="stable")
            order[start:end], near, size = rows[by], near[by], np.bincount(owner, minlength=len(net))
            nodes[at][4:] = [len(nodes), len(net)]
            ends = start + np.cumsum(size)
            nodes += [[c, near[e - n - start : e - start].max(), int(e - n), int(e), 0, 0] for c, n, e in zip(net, size, ends, strict=True)]
        at += 1
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    centre, radius, start, end, child, children = (np.array(c) for c in zip(*nodes, strict=True))
    return {"order": order, "centre": place[centre], "radius": radius, "start": start, "end": end, "child": child, "children": children}


def search(tree: dict, points: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, anchor: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, top: float):
    """The FIRST best of each anchor and window in one tree: (row of the anchor, window, score, vec_id). low and high have
    a column for each window; low is raised on the way."""
    own, low = (q.astype(np.float64) ** 2).sum(1), low.copy()
    meets = lambda a, least, most: ((most[:, None] >= low[a]) & (least[:, None] <= high[a])).any(1)
    a, n, leaves = np.arange(len(q)), np.zeros(len(q), np.int64), []
    centres = points[tree["centre"]]
    while len(a):
        # One level: all anchors with the nodes that are left to them.
        nodes, at = np.unique(n, return_inverse=True)
        ip = products(q, centres[nodes])[a, at].astype(np.float64)
        least, most = bounds(ip, own[a], tree["radius"][n], top)
        live = meets(a, least, most)
        a, n, least, most = a[live], n[live], least[live], most[live]
        leaf = tree["children"][n] == 0
        leaves.append((a[leaf], n[leaf], least[leaf], most[leaf]))
        many = tree["children"][n[~leaf]]
        first = np.repeat(tree["child"][n[~leaf]], many)
        n = first + np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
        a = np.repeat(a[~leaf], many)
    a, n, least, most = (np.concatenate(c) for c in zip(*leaves, strict=True))
    by = np.lexsort((-most, a))
    a, n, least, most = a[by], n[by], least[by], most[by]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    best = [np.zeros(0, np.int64) for _ in range(4)]
    done, take = 0, 1
    while (place >= done).any():
        now = np.flatnonzero((place >= done) & (place < done + take) & meets(a, least, most))
        found = [best]
        for leaf in np.unique(n[now]):
            who, r = a[now[n[now] == leaf]], slice(tree["start"][leaf], tree["end"][leaf])
            score = products(q[who], points[r])
            ok = ((labels[r][None] == label[who][:, None]) == same) & (ids[r][None] != anchor[who][:, None])
            for w in range(low.shape[1]):
                i, j = np.nonzero(ok & (score >= low[who, w][:, None]) & (score <= high[who, w][:, None]))
                found.append([who[i], np.full(len(i), w), score[i, j], ids[r][j]])
        best = [np.concatenate(c) for c in zip(*found, strict=True)]
        by = np.lexsort((best[3], -best[2], best[1], best[0]))
        best = [c[by] for c in best]
        key = best[0] * low.shape[1] + best[1]
        rank = np.arange(len(key)) - np.searchsorted(key, key)
        full = rank == FIRST - 1
        low[best[0][full], best[1][full]] = np.maximum(low[best[0][full], best[1][full]], best[2][full])
        best = [c[rank < FIRST] for c in best]
        done, take = done + take, 2 * take
    return best


TREE = "dim int, cell int, salt int, size long, kind string, points binary, ids binary, labels binary, nodes binary, radius binary"
FOUND = "qid long, slot int, score long, vec_id long"


def shards(rows: DataFrame, top: float) -> DataFrame:
    """A row for each shard (dim, cell, salt) of rows: its tree, points in the narrowest integers that hold them."""

    def build(key, data):
        dim, cell, salt = (k.as_py() for k in key)
        order = np.lexsort((data["label"].to_numpy(), data["vec_id"].to_numpy()))
        x, ids, labels = rows_of(data["parts"])[order] if dim else np.zeros((len(order), 0), np.int64), data["vec_id"].to_numpy()[order], data["label"].to_numpy()[order]
        tree = cover_tree(x, top)
        x, ids, labels = x[tree["order"]], ids[tree["order"]], labels[tree["order"]]
        kind = next((k for k in ("int8", "int16", "int32") if not x.size or np.abs(x.astype(np.float64)).max() < np.iinfo(k).max), "int64")
        nodes = np.stack([tree[c] for c in ("centre", "start", "end", "child", "children")]).astype(np.int64)
        out = {"dim": dim, "cell": cell, "salt": salt, "size": len(x), "kind": kind, "points": x.astype(kind).tobytes(), "ids": ids.astype(np.int64).tobytes(), "labels": labels.astype(np.int64).tobytes(), "nodes": nodes.tobytes(), "radius": tree["radius"].astype(np.float64).tobytes()}
        return pa.Table.from_pylist([out], pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("salt", pa.int32()), ("size", pa.int64()), ("kind", pa.string()), *((c, pa.binary()) for c in ("points", "ids", "labels", "nodes", "radius"))]))

    return rows.groupBy("dim", "cell", "salt").applyInArrow(build, TREE)


def visits(trees: DataFrame, routed: DataFrame, blocks: int, same: bool, top: float) -> DataFrame:
    """What the anchors find in the shards that they are routed to (dim, cell, salt)."""

    def run(key, left, right):
        out = [np.zeros(0, np.int64) for _ in range(4)]
        if left.num_rows and right.num_rows:
            t = left.to_pylist()[0]
            points = np.frombuffer(t["points"], t["kind"]).reshape(t["size"], -1)
            nodes = np.frombuffer(t["nodes"], np.int64).reshape(5, -1)
            tree = dict(zip(("centre", "start", "end", "child", "children"), nodes, strict=True), radius=np.frombuffer(t["radius"], np.float64))
            ids, labels = np.frombuffer(t["ids"], np.int64), np.frombuffer(t["labels"], np.int64)
            parts, low, high = (rows_of(right[c]) if t["dim"] or c != "parts" else np.zeros((right.num_rows, 0), np.int64) for c in ("parts", "low", "high"))
            qid, anchor, label = (right[c].to_numpy() for c in ("qid", "anchor_id", "label"))
            found = []
            for s in range(0, right.num_rows, 256):
                r = slice(s, s + 256)
                i, slot, score, own = search(tree, points, ids, labels, parts[r], anchor[r], label[r], low[r], high[r], same, top)
                found.append([qid[r][i], slot, score, own])
            out = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.table({"qid": out[0], "slot": out[1].astype(np.int32), "score": out[2], "vec_id": out[3]})

    key = ["dim", "cell", "salt", "block"]
    left = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = routed.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(run, FOUND)


class Index:
    """Trees over all candidate rows (vec_id, label, parts). Pivots are a sample of CELLS rows at most; cells that hold more
    than SHARD rows, copies of one region, are dealt out by a hash."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        size, self.top = rows.agg(F.count("*"), F.max(F.aggregate("parts", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
        self.top = top = self.top or 0.0
        sample = rows.select("dim", "parts").orderBy(F.xxhash64("vec_id"), "label").limit(min(CELLS, 1 + size // SHARD)).collect()
        self.pivots = pivots = {d: np.array([r.parts for r in sample if r.dim == d], np.int64).reshape(-1, d) for d in {r.dim for r in sample}}

        def assign(batches):
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                cell, far = np.zeros(len(dims), np.int32), np.full(len(dims), np.inf)
                for d in np.unique(dims):
                    if d in pivots and d:
                        at = np.flatnonzero(dims == d)
                        x, p = augmented(rows_of(batch.column("parts").take(pa.array(at))), top), augmented(pivots[d], top)
                        square = ((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T).clip(0)
                        cell[at] = square.argmin(1)
                        far[at] = np.sqrt(((x - p[cell[at]]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=["vec_id", "label", "dim", "parts", "cell", "far"])

        dealt = written(rows.select("vec_id", "label", "dim", "parts").mapInArrow(assign, "vec_id long, label long, dim int, parts array<long>, cell int, far double"), "cells")
        # A row a cell: as many as pivots, and one more for each length of vectors that the sample has none of.
        cells = dealt.groupBy("dim", "cell").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / SHARD).cast("int").alias("salts")).orderBy("dim", "cell").collect()
        self.cells = {d: ([r.cell for r in cells if r.dim == d], np.array([r.radius for r in cells if r.dim == d]), np.array([r.salts for r in cells if r.dim == d])) for d in {r.dim for r in cells}}
        salts = spark.createDataFrame([(r.dim, r.cell, r.salts) for r in cells], "dim int, cell int, salts int")
        salted = dealt.join(F.broadcast(salts), ["dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), "salts").cast("int"))
        self.trees = written(shards(salted.drop("salts", "far"), top), "trees")
        forget(dealt)

    def routed(self, queries: DataFrame, seed: bool) -> DataFrame:
        """queries with the shards to visit: the most promising one, or all others (seed_cell and seed_salt are visited)
        whose cell meets a window."""
        pivots, cells, top = self.pivots, self.cells, self.top

        def run(batches):
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                who, cell, salt = [], [], []
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    part = batch.take(pa.array(at))
                    names, radius, salts = cells.get(d, ([], np.zeros(0), np.zeros(0, int)))
                    low, high = rows_of(part.column("low")), rows_of(part.column("high"))
                    least, most = np.full((len(at), len(names)), -np.inf), np.full((len(at), len(names)), np.inf)
                    if d in pivots and d:
                        q = rows_of(part.column("parts"))
                        own = (q.astype(np.float64) ** 2).sum(1)[:, None]
                        least, most = bounds(products(q, pivots[d])[:, names].astype(np.float64), own, radius[None], top)
                    live = np.zeros(least.shape, bool)
                    for w in range(low.shape[1]):
                        live |= (most >= low[:, w][:, None]) & (least <= high[:, w][:, None])
                    if seed:
                        worth = np.where(live, np.minimum(most, high.max(1).astype(np.float64)[:, None]), -np.inf)
                        i = np.flatnonzero(live.any(1))
                        j, k = worth[i].argmax(1) if len(i) else i, np.zeros(len(i), int)
                    else:
                        i, j = np.nonzero(live)
                        n = salts[j] if len(j) else np.zeros(0, int)
                        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        i, j = np.repeat(i, n), np.repeat(j, n)
                        other = (np.array(names)[j] != part.column("seed_cell").to_numpy()[i]) | (k != part.column("seed_salt").to_numpy()[i])
                        i, j, k = i[other], j[other], k[other]
                    who.append(at[i])
                    cell.append(np.array(names, np.int32)[j])
                    salt.append(k)
                if who:
                    # In slices, as one anchor can go to many shards.
                    who, cell, salt = (np.concatenate(x) for x in (who, cell, salt))
                    for s in range(0, len(who), 4096):
                        r = slice(s, s + 4096)
                        kept = batch.take(pa.array(who[r])).select(["qid", "anchor_id", "label", "dim", "parts", "low", "high"])
                        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell[r].astype(np.int32)), pa.array(salt[r].astype(np.int32))], names=[*kept.schema.names, "cell", "salt"])

        return queries.mapInArrow(run, "qid long, anchor_id long, label long, dim int, parts array<long>, low array<long>, high array<long>, cell int, salt int")

    def best(self, queries: DataFrame, same: bool) -> DataFrame:
        """qid, slot, rank, score, vec_id: the FIRST best candidates of each window of queries (qid, anchor_id, label, dim,
        parts, low, high) among rows of the anchor's label, or of others."""
        blocks = max(1, -(-queries.count() // BLOCK))
        start = written(self.routed(queries, True), "seeds")
        first = written(visits(self.trees, start, blocks, same, self.top), "found")
        fifth = first.groupBy("qid", "slot").agg(F.when(F.count("*") >= FIRST, F.min("score")).alias("fifth")).where("fifth is not null")
        fifth = fifth.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "fifth"))).alias("fifths"))
        raised = F.transform("low", lambda x, i: F.greatest(x, F.try_element_at("fifths", i)))
        rest = start.withColumnsRenamed({"cell": "seed_cell", "salt": "seed_salt"}).join(fifth, "qid", "left").withColumn("low", raised).drop("fifths")
        more = visits(self.trees, self.routed(rest, False), blocks, same, self.top)
        rank = F.row_number().over(Window.partitionBy("qid", "slot").orderBy(F.desc("score"), "vec_id"))
        return first.unionByName(more).withColumn("rank", rank).where(F.col("rank") <= FIRST)


def candidates(vectors: DataFrame) -> DataFrame:
    """vec_id, label (moved on by one, modulo 10, where 7 divides vec_id), dim and parts (floor(256 x)) of the rows that take
    part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("x", finite), F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return v.select("vec_id", label.alias("label"), F.size("x").alias("dim"), F.transform("x", lambda x: F.floor(x * 256)).alias("parts")).groupBy("vec_id", "label", "parts").agg(F.first("dim").alias("dim"))


def hard_negatives(vectors: DataFrame, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of vectors (vec_id, embedding,
    label) whose vec_id is divisible by `every`."""
    rows = written(candidates(vectors), "candidates")
    # More than FIRST + 1 copies with one label can't be returned: one of them may be the anchor itself.
    copy = F.row_number().over(Window.partitionBy("label", "parts").orderBy("vec_id"))
    index = Index(written(rows.withColumn("copy", copy).where(F.col("copy") <= FIRST + 1).drop("copy"), "distinct"))
    anchors = written(rows.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("qid"), F.col("vec_id").alias("anchor_id"), "label", "dim", "parts"), "anchors")
    open_window = anchors.withColumn("low", F.array(F.lit(BOTTOM).cast("long"))).withColumn("high", F.array(F.lit(TOP).cast("long")))
    positives = written(index.best(open_window, True).select("qid", (F.col("rank") - 1).alias("slot"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")), "positives")
    # 80 p <= 100 n <= 100 p: no window where p is negative; else n from 4 p / 5 rounded up to p.
    p = F.col("positive_score")
    least = F.when(p >= 0, p - F.expr("positive_score div 5")).otherwise(F.lit(TOP))
    windows = positives.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("slot", least.alias("low"), p.alias("high")))).alias("w"))
    # Slots without a positive get a window that nothing meets, so that all anchors have as many.
    filled = lambda name, empty: F.transform(F.sequence(F.lit(0), F.lit(FIRST - 1)), lambda i: F.coalesce(F.get("w", i)[name], F.lit(empty).cast("long")))
    asked = written(anchors.join(windows, "qid").withColumn("low", filled("low", TOP)).withColumn("high", filled("high", BOTTOM)).drop("w"), "asked")
    found = index.best(asked, False).select("qid", "slot", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.join(positives, ["qid", "slot"]).join(anchors.select("qid", "anchor_id"), "qid")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"), 100)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""
