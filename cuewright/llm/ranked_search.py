"""Ranked lexical search for many items at once, by shared term sets.

Items are dealt in blocks of about ENTRIES (item, term) entries. In a block, shared_sets() mines the term sets that items
share: terms of the same items are one atom, and the pair of neighbouring sets (in the order of how many items hold them)
that most items share is made a set of its own, again and again, until no two items share a pair. So the sets form a
directed acyclic graph: each is the union of two smaller ones, an item the union of a few.

The documents are read once for a block: postings() keeps the length of each and how often it holds the block's terms (found
by hash, then compared by bytes). These give the corpus's statistics. Then each batch of documents gets an accumulator for
each set: atoms from the postings, every other set once from its two parts, level by level, and items from their sets.
Scores are 64-bit integers, so they don't depend on how a sum is cut. A task keeps the best documents of each item only;
these are ranked within salted groups first, then by item.

Driver and workers hold a block's terms and sets, never documents. Copies of a document tie and are ranked by doc_id.
Items of one item_id are one item; a null one is an item like others. Null or empty texts hold no terms: such an item has no
rows, and such a document is in none. Documents with a null doc_id count in all statistics, but aren't ranked, since nothing
names them. Rows with a repeated doc_id are ranked each. Very long texts count whole. Empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import uuid
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.llm.common import per_worker, table, written
from cuewright.llm.words import LOWER, PUNCT, gathered, slices, span_hashes, word_spans

ENTRIES, KEEP, SALTS, CELLS = 200_000, 50, 64, 4_000_000
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The contract's terms (a fixed value).
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def shared_sets(item: np.ndarray, term: np.ndarray) -> dict[str, list]:
    """The sets of a block, from its different (item, term) entries, both numbered from 0: atom (of each term), left and right
    (the parts of each further set, numbered on after the atoms), bounds (of the levels in left), sets (of all items, one
    item after the other) and starts (of each item's)."""
    by = np.lexsort((item, term))
    who, edges = item[by].astype(np.int64), np.flatnonzero(np.diff(term[by], prepend=-1))
    atoms: dict[bytes, int] = {}
    atom = np.array([atoms.setdefault(x.tobytes(), len(atoms)) for x in np.split(who, edges[1:])], np.int64) if len(who) else np.zeros(0, np.int64)
    held = np.array([len(k) // 8 for k in atoms], np.int64)
    entry = np.unique(np.stack([item.astype(np.int64), atom[term]], 1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
    entry = entry[np.lexsort((entry[:, 1], -held[entry[:, 1]], entry[:, 0]))] if len(entry) else entry
    own, seq, n = entry[:, 0], entry[:, 1], len(held)
    left, right, bounds = [], [], [0]
    while len(seq) > 1:
        pairs = np.flatnonzero(own[1:] == own[:-1])
        if not len(pairs):
            break
        kinds, kind, count = np.unique(np.stack([seq[pairs], seq[pairs + 1]], 1), axis=0, return_inverse=True, return_counts=True)
        kind, place = kind.ravel(), np.empty(len(kinds), np.int64)
        place[np.argsort(-count, kind="stable")] = np.arange(len(kinds))
        # Of overlapping pairs the one that most items share is taken.
        worth = np.full(len(seq) + 1, len(kinds))
        worth[pairs] = np.where(count[kind] > 1, place[kind], len(kinds))
        here = worth[pairs]
        taken = (here < len(kinds)) & (here < worth[pairs - 1]) & (here < worth[pairs + 1])
        again = np.bincount(kind[taken], minlength=len(kinds)) > 1
        taken &= again[kind]
        if not taken.any():
            break
        new = np.cumsum(again) - 1 + n
        left.append(kinds[again, 0])
        right.append(kinds[again, 1])
        seq[pairs[taken]] = new[kind[taken]]
        keep = np.ones(len(seq), bool)
        keep[pairs[taken] + 1] = False
        own, seq, n = own[keep], seq[keep], n + int(again.sum())
        bounds.append(n - len(held))
    starts = np.searchsorted(own, np.arange(item.max() + 1 if len(item) else 0))
    join = lambda x: np.concatenate(x).tolist() if x else []
    return {"atom": atom.tolist(), "atoms": len(held), "left": join(left), "right": join(right), "bounds": bounds, "sets": seq.tolist(), "starts": starts.tolist()}


def blocks_of(items: DataFrame) -> DataFrame:
    """A row for each block: items (ids), terms, and what shared_sets() makes of them."""
    terms = F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, SMALL), F.lit(TERM), F.lit(0)))
    rows = items.select("item_id", F.explode(terms).alias("term")).groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    rows = written(rows, "items")
    entries = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-entries // ENTRIES)))))
    kind = rows.schema["item_id"].dataType.simpleString()
    schema = f"items array<{kind}>, terms array<string>, atom array<int>, atoms int, left array<int>, right array<int>, bounds array<int>, sets array<int>, starts array<int>"

    def mine(data):
        order = np.argsort([str(x) for x in data["item_id"].to_pylist()], kind="stable")
        data = data.take(pa.array(order)).combine_chunks()
        each = data["terms"].combine_chunks()
        flat = each.flatten().dictionary_encode()
        item = np.repeat(np.arange(len(each)), np.diff(each.offsets.to_numpy()))
        found = shared_sets(item, flat.indices.to_numpy())
        ids, terms = data["item_id"].to_pylist(), flat.dictionary.to_pylist()
        number = pa.list_(pa.int32())
        return pa.Table.from_pylist([{"items": ids, "terms": terms, **found}], pa.schema([("items", pa.list_(data.schema.field("item_id").type)), ("terms", pa.list_(pa.string())), ("atom", number), ("atoms", pa.int32()), *((c, number) for c in ("left", "right", "bounds", "sets", "starts"))]))

    return rows.groupBy("block").applyInArrow(mine, schema)


class Terms:
    """A block's terms, looked up by the hash of their bytes and compared by the bytes."""

    def __init__(self, terms: list[str]):
        (_, data, offsets), *more = slices(pa.array(terms, pa.large_string()), 2**62)
        assert not more
        starts, ends = offsets[:-1], offsets[1:]
        h = span_hashes(data, starts, ends)
        self.order = np.argsort(h, kind="stable")
        self.hash, self.data, self.starts, self.sizes = h[self.order], data, starts[self.order], (ends - starts)[self.order]

    def find(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word's term, -1 for others. Of terms with one hash each word is compared with all."""
        h, size = span_hashes(low, starts, ends), ends - starts
        out, at = np.full(len(h), -1, np.int64), np.searchsorted(self.hash, h)
        left = np.flatnonzero(at < len(self.hash))
        left = left[self.hash[at[left]] == h[left]]
        while len(left):
            k = at[left]
            fits = np.flatnonzero(size[left] == self.sizes[k])
            n = size[left[fits]]
            equal = gathered(low, starts[left[fits]], n) == gathered(self.data, self.starts[k[fits]], n)
            good = fits[np.logical_and.reduceat(equal, np.cumsum(n) - n)] if len(fits) else fits
            out[left[good]] = self.order[k[good]]
            rest = np.setdiff1d(np.arange(len(left)), good)
            at[left[rest]] += 1
            left = left[rest]
            left = left[at[left] < len(self.hash)]
            left = left[self.hash[at[left]] == h[left]]
        return out


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (its terms with repeats), terms (numbers of the given ones that it holds) and counts, for each document
    with a term."""
    sent, key, many = docs.sparkSession.sparkContext.broadcast(terms), uuid.uuid4().hex, max(len(terms), 1)

    def run(batches):
        known = per_worker(key, lambda: Terms(sent.value))
        for batch in batches:
            for first, data, offsets in slices(batch.column("text")):
                starts, ends, bounds = word_spans(data, offsets, PUNCT)
                n = np.diff(bounds)
                found = known.find(LOWER[data], starts, ends)
                hit = np.flatnonzero(found >= 0)
                row = np.searchsorted(bounds, hit, "right") - 1
                pairs, counts = np.unique(row * many + found[hit], return_counts=True)
                row, own = np.divmod(pairs, many)
                at = pa.array(np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32))
                out = pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(n)), pa.array(n), *(pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (own, counts))], names=["doc_id", "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def accumulated(block: dict[str, np.ndarray], doc: np.ndarray, term: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
    """Scores (items, documents) from what each term that a document holds adds: each shared set is summed once."""
    sums = np.zeros((block["atoms"] + len(block["left"]), n_docs), np.int64)
    np.add.at(sums, (block["atom"][term], doc), value)
    for a, b in zip(block["bounds"], block["bounds"][1:], strict=False):
        sums[block["atoms"] + a : block["atoms"] + b] = sums[block["left"][a:b]] + sums[block["right"][a:b]]
    return np.add.reduceat(sums[block["sets"]], block["starts"], axis=0)


def best_of(item: np.ndarray, doc: np.ndarray, score: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by = np.lexsort((doc, -score, item))
    item, doc, score = item[by], doc[by], score[by]
    good = np.arange(len(item)) - np.searchsorted(item, item) < keep
    return item[good], doc[good], score[good]


def ranked(docs: DataFrame, items: DataFrame, keep: int = KEEP) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item."""
    spark, parts = docs.sparkSession, []
    for block in blocks_of(items).toLocalIterator():
        names, terms = pa.array(block.items), list(block.terms)
        held = written(postings(docs, terms), "postings")
        n_docs, n_terms = held.agg(F.count("*"), F.sum("n")).first()
        df = dict(held.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(terms))], np.int64)
        sent = spark.sparkContext.broadcast({c: np.array(block[c], np.int64) if isinstance(block[c], list) else block[c] for c in ("atom", "atoms", "left", "right", "bounds", "sets", "starts")})

        def run(batches, sent=sent, names=names, weight=weight, n_docs=n_docs, n_terms=n_terms):
            own = sent.value
            step = max(1, CELLS // (own["atoms"] + len(own["left"]) + len(own["sets"])))
            kept, new, size = tuple(np.zeros(0, np.int64) for _ in range(3)), [], 0
            least = np.ones(len(names), np.int64)

            def merged():
                x = best_of(*(np.concatenate(c) for c in zip(kept, *new, strict=True)), keep)
                full = np.flatnonzero(np.arange(len(x[0])) - np.searchsorted(x[0], x[0]) == keep - 1)
                least[x[0][full]] = x[2][full]
                return x

            for whole in batches:
                for s in range(0, whole.num_rows, step):
                    batch = whole.slice(s, step)
                    n, per = batch.column("n").to_numpy(), batch.column("terms").value_lengths().to_numpy()
                    term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "counts"))
                    doc = np.repeat(np.arange(len(n)), per)
                    m = 50 + 50 * n * n_docs // n_terms
                    score = accumulated(own, doc, term, weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc])), len(n))
                    i, j = np.nonzero(score >= least[:, None])
                    new.append((i, batch.column("doc_id").to_numpy()[j], score[i, j]))
                    size += len(i)
                    if size > 4 * keep * len(names):
                        kept, new, size = merged(), [], 0
            i, doc, score = merged()
            for s in range(0, len(i), 10_000):
                r = slice(s, s + 10_000)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(i[r])), pa.array(doc[r]), pa.array(score[r])], names=["item_id", "doc_id", "score"])

        kind = items.schema["item_id"].dataType.simpleString()
        parts.append(held.where("doc_id is not null").mapInArrow(run, f"item_id {kind}, doc_id long, score long"))
    if not parts:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    by = [F.desc("score"), F.asc("doc_id")]
    out = out.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*by))).where(F.col("rank") <= keep)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*by))).where(F.col("rank") <= keep)
    return out.select("item_id", "rank", "doc_id", "score")


def op11_shared_term_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), KEEP)


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{SMALL}'), '{TERM}') AS ts FROM documents),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{SMALL}'), '{TERM}')) AS term FROM benchmark),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term, n_docs),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(ts) * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {KEEP}
"""
