"""Toxicity by class-conditional Kneser-Ney models of words' spelling.

Two interpolated Kneser-Ney models, toxic and ordinary, give each symbol of a word (a byte, or the word's end) a probability
after the ORDER - 1 symbols before it in the word (with marks where the word starts). Their counts come from all labelled
texts but those held out, each text counting a word once. In a class c,

    p_c(s | h) = (max(count_c(h s) - DISCOUNT, 0) + DISCOUNT * kinds_c(h) * p(s | h')) / count_c(h),   or p(s | h') if c has no h,

where h' is h without its first symbol, and the back-off p is shared by both classes: it's interpolated in the same way over
continuation counts (how many symbols stand before s and its context), down to one symbol and an even share. So a class that
knows too little of an expression is smoothed by what both hold, and spellings that no word of the training rows has are
judged by their parts. For any context the probabilities of all symbols sum to one.

A word's ratio is the sum of log p_toxic / p_ordinary over its symbols, held within CLIP. Where neither class has the symbol
after its context, the shared part cancels and the ratio is that of the back-off weights; so a model is a table of ratios by
gram and by context. Spark sums counts over all rows and makes that table with joins and groupings; it grows with the input.
To score, a table of up to BROADCAST_GRAMS rows (24 MB) is broadcast; a larger one is joined: texts are dealt into chunks of
about CHUNK bytes by a hash (many in a partition), a chunk's different grams are joined with the table, and what is found meets the chunk's texts.
Both ways give the same scores.

A text's score compares length-normalised log-likelihoods: of the whole text, of its most toxic windows of a few words, as an
expression may be a few words in a long text, and of the words beyond doubt. A logistic function of these, fitted on about
CALIBRATE labelled rows (by a hash of the text) that weren't counted, gives the score. Texts without words (null too) have
measures 0. Repeated rows get equal scores; a repeated doc_id is judged by each row's text; other columns don't matter.

Words are runs of letters and digits (A-Z lower-cased). Labels are learned only from rows whose crc32(doc_id) mod 4 is 0, 1
(counts) or 3 (calibration, and counts of the final model); 2 is held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.llm.common import forget, table, written
from cuewright.llm.words import LOWER, PUNCT, Lexicon, gathered, slices, span_hashes, word_spans

ORDER, BITS, END, START, SYMBOLS = 6, 9, 257, 258, 257
CHUNK, DISCOUNT, CLIP, SURE = 8 << 20, 0.75, 7.0, 2.0
WINDOWS = (1, 3, 8)
MEASURES = len(WINDOWS) + 2
CALIBRATE = 40_000
COUNTS = ("toxic", "ordinary", "toxic_part", "ordinary_part")
#: Labelled rows (id and label) are broadcast up to this number, about 50 MB; beyond it the join shuffles.
BROADCAST_LABELS = 1_000_000
#: Ratios are broadcast up to this number; beyond it they are joined.
BROADCAST_GRAMS = 2_000_000


def fold(doc_id: Column | str) -> Column:
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % 4


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic (0 or 1), fold of docs with a label; several labels of a row count as the highest."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = own.select(F.col("doc_id").alias("_id"), "toxic", fold("doc_id").alias("fold")).where("fold <> 2")
    own = F.broadcast(own) if own.count() <= BROADCAST_LABELS else own
    return docs.select("doc_id", "text").join(own, F.col("doc_id") == F.col("_id")).select("text", "toxic", "fold")


def grams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Keys of the grams of each word, its length and one of them: each symbol with the order - 1 before it, BITS bits each,
    the last symbol lowest."""
    n = ends - starts + 1
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start, last = np.repeat(starts, n), np.repeat(n - 1, n)
    key = np.where(at == last, END, low[np.minimum(start + at, len(low) - 1)].astype(np.int64) + 1)
    for j in range(1, order):
        key |= np.where(at >= j, low[np.maximum(start + at - j, 0)].astype(np.int64) + 1, START) << BITS * j
    return key


def counted(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """key (of a gram) and COUNTS: texts' words that have it, in all rows and in those of folds 0 and 1."""

    def run(batches):
        held, size = [], 0

        def flush():
            for k in range(4):
                keys, n = (np.concatenate([x[i] for kind, *x in held if kind == k] or [np.zeros(0, np.int64)]) for i in (0, 1))
                own, back = np.unique(keys, return_inverse=True)
                n = np.bincount(back, n, len(own)).astype(np.int64)
                kinds = k & 1 > 0, k & 1 == 0, k == 1, k == 0
                yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(n if x else np.zeros_like(n)) for x in kinds)], names=["key", *COUNTS])

        for batch in batches:
            label = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64) + 2 * (batch.column("fold").to_numpy(zero_copy_only=False) == 3)
            for first, data, offsets in slices(batch.column("text")):
                low = LOWER[data]
                starts, ends, bounds = word_spans(low, offsets, PUNCT)
                h, row = span_hashes(low, starts, ends), np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
                order_of = np.lexsort((h, row))
                new = np.ones(len(h), bool)
                new[1:] = (h[order_of][1:] != h[order_of][:-1]) | (row[order_of][1:] != row[order_of][:-1])
                once = order_of[new]
                kind = label[first + row[once]]
                for k in range(4):
                    own = once[kind == k]
                    _, at, n = np.unique(h[own], return_index=True, return_counts=True)
                    at = own[at]
                    keys, back = np.unique(grams(low, starts[at], ends[at], order), return_inverse=True)
                    held.append((k, keys, np.bincount(back, np.repeat(n, ends[at] - starts[at] + 1), len(keys)).astype(np.int64)))
                    size += len(keys)
                if size > 3_000_000:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    kinds = "key long, " + ", ".join(f"{c} long" for c in COUNTS)
    return rows.select("text", "toxic", "fold").mapInArrow(run, kinds).groupBy("key").agg(*(F.sum(c).alias(c) for c in COUNTS))


def context(key: str = "key") -> Column:
    return F.shiftright(key, BITS)


def suffix(length: int) -> Column:
    return F.col("key").bitwiseAND(F.lit((1 << BITS * length) - 1))


def shared(keys: DataFrame, order: int = ORDER) -> DataFrame:
    """length, key (of that many symbols, fewer than order), n (how many symbols stand before it), total and kinds of n after
    its context. keys: the different grams of both classes. All lengths are counted at once, so that the plan stays small."""
    longer = keys.select(F.inline(F.array(*(F.struct(F.lit(k).alias("length"), suffix(k + 1).alias("longer")) for k in range(1, order))))).distinct()
    own = longer.select("length", F.col("longer").bitwiseAND(F.expr(f"shiftleft(1L, {BITS} * length) - 1")).alias("key"))
    own = own.withColumn("h", context()).repartition("length", "h").groupBy("length", "h", "key").agg(F.count("*").alias("n"))
    after = Window.partitionBy("length", "h")
    return own.select("length", "key", "n", F.sum("n").over(after).alias("total"), F.count("*").over(after).alias("kinds"))


def backed_off(keys: DataFrame, order: int = ORDER) -> DataFrame:
    """gram and p, the back-off probability of its last symbol after the order - 2 before it, of each of keys: its shorter
    grams are looked up at once, whatever their lengths, and interpolated from one symbol up."""
    wanted = keys.select(F.col("key").alias("gram"), F.inline(F.array(*(F.struct(F.lit(k).alias("length"), suffix(k).alias("key")) for k in range(1, order)))))
    found = wanted.join(shared(keys, order), ["length", "key"]).select("gram", "length", "n", "total", "kinds").repartition("gram")
    found = found.groupBy("gram").agg(*(F.max(F.when(F.col("length") == k, F.col(c))).alias(f"{c}_{k}") for k in range(1, order) for c in ("n", "total", "kinds")))
    p = F.lit(1.0 / SYMBOLS)
    for k in range(1, order):
        p = (F.greatest(F.col(f"n_{k}") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"kinds_{k}") * p) / F.col(f"total_{k}")
    return found.select("gram", p.alias("p"))


def probabilities(counts: DataFrame, part: bool, order: int = ORDER) -> DataFrame:
    """key, p_toxic, p_ordinary of each gram, and for the context of each (order - 1 symbols) its back-off weights there."""
    names = {c: c + "_part" * part for c in ("toxic", "ordinary")}
    own = counts.select("key", *(F.col(c).alias(k) for k, c in names.items())).where("toxic + ordinary > 0")
    sums = [x for k in names for x in (F.sum(k).alias(f"{k}_total"), F.count_if(F.col(k) > 0).alias(f"{k}_kinds"))]
    contexts = own.groupBy(context().alias("h")).agg(*sums)
    rows = own.join(contexts, context() == F.col("h")).join(backed_off(own.select("key"), order), F.col("key") == F.col("gram"))
    back = lambda k: F.when(F.col(f"{k}_total") > 0, DISCOUNT * F.col(f"{k}_kinds") / F.col(f"{k}_total")).otherwise(1.0)
    seen = lambda k: F.when(F.col(f"{k}_total") > 0, F.greatest(F.col(k) - DISCOUNT, F.lit(0.0)) / F.col(f"{k}_total")).otherwise(0.0)
    found = rows.select("key", *((seen(k) + back(k) * F.col("p")).alias(f"p_{k}") for k in names))
    return found.unionByName(contexts.select(F.col("h").alias("key"), *(back(k).alias(f"p_{k}") for k in names)))


class Trained:
    """ratios: key, ratio of each gram, and of each context for grams that aren't there; weights of the measures."""

    def __init__(self, counts: DataFrame, part: bool, order: int = ORDER):
        rows = probabilities(counts, part, order).select("key", F.log(F.col("p_toxic") / F.col("p_ordinary")).alias("ratio"))
        self.ratios, self.weights, self.order = written(rows, "ratios"), np.zeros(MEASURES + 1), order
        self.size = self.ratios.count()


class Scorer:
    """Ratios of words from a table of ratios (keys, ratios)."""

    def __init__(self, key: np.ndarray, ratio: np.ndarray, order: int = ORDER):
        at = np.argsort(key, kind="stable")
        self.key, self.ratio, self.order = key[at], ratio[at], order
        self.words = Lexicon(np.float32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratio of each key (0 if it isn't there), and whether it is."""
        if not len(self.key):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        there = self.key[at] == keys
        return np.where(there, self.ratio[at], 0.0), there

    def compute(self, words: list[bytes]) -> list[bytes]:
        n = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(n)
        keys, back = np.unique(grams(np.frombuffer(b"".join(words), np.uint8), ends - n, ends, self.order), return_inverse=True)
        ratio, there = self.find(keys)
        ratio[~there] = self.find(keys[~there] >> BITS)[0]
        sums = np.add.reduceat(ratio[back], np.cumsum(n + 1) - n - 1)
        return [x.tobytes() for x in np.clip(sums, -CLIP, CLIP).astype(np.float32)]

    def measures(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each row: mean ratio of its words, the highest mean over a window of 1, 3, 8 words (shorter texts: of the
        whole), and what exceeds SURE, summed and divided by the root of the number of words."""
        low = LOWER[data]
        starts, ends, bounds = word_spans(low, offsets, PUNCT)
        n = np.diff(bounds)
        out, full = np.zeros((len(n), MEASURES)), np.flatnonzero(n)
        if not len(full):
            return out
        own = self.words.runs(span_hashes(low, starts, ends), low, starts, ends, self.compute)
        r = gathered(self.words.pool, *own).astype(float)
        sums, at = np.concatenate([[0.0], np.cumsum(r)]), bounds[:-1][full]
        out[full, 0] = (sums[bounds[1:][full]] - sums[at]) / n[full]
        for j, size in enumerate(WINDOWS):
            # The mean over the window that starts at each word; those that would leave the row stand back.
            last = np.minimum(np.arange(len(r)) + size, np.repeat(bounds[1:], n))
            first = np.maximum(last - size, np.repeat(bounds[:-1], n))
            out[full, j + 1] = np.maximum.reduceat((sums[last] - sums[first]) / (last - first), at)
        out[full, -1] = np.add.reduceat(np.maximum(r - SURE, 0), at) / np.sqrt(n[full])
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps on standardised measures; the intercept isn't shrunk."""
    if not len(y) or y.min() == y.max():
        return np.concatenate([[np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))], np.zeros(x.shape[1])])
    mid, wide = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mid) / wide])
    w, shrink = np.zeros(a.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + shrink, a.T @ (y - p) - shrink @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([[w[0] - (w[1:] * mid / wide).sum()], w[1:] / wide])


def asked(placed: DataFrame, order: int) -> DataFrame:
    """chunk and key of the grams of each chunk, each about once, and of their contexts."""

    def run(batches):
        held, size = {}, 0

        def flush():
            for chunk, keys in held.items():
                keys = np.unique(np.concatenate(keys))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk, np.int32)), pa.array(keys)], names=["chunk", "key"])

        for batch in batches:
            chunk = batch.column("chunk").to_numpy(zero_copy_only=False)
            for at, data, offsets in slices(batch.column("text")):
                low = LOWER[data]
                starts, ends, bounds = word_spans(low, offsets, PUNCT)
                row, h = np.repeat(chunk[at : at + len(offsets) - 1], np.diff(bounds)), span_hashes(low, starts, ends)
                for c in np.unique(row):
                    mine = np.flatnonzero(row == c)
                    mine = mine[np.unique(h[mine], return_index=True)[1]]
                    keys = np.unique(grams(low, starts[mine], ends[mine], order))
                    held.setdefault(int(c), []).append(np.concatenate([keys, np.unique(keys >> BITS)]))
                    size += len(held[int(c)][-1])
                if size > 3_000_000:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return placed.select("chunk", "text").mapInArrow(run, "chunk int, key long")


def measured(rows: DataFrame, trained: Trained, most: int = BROADCAST_GRAMS) -> DataFrame:
    """rows (one column beside text) with their measures as an array column."""
    other, order = next(c for c in rows.columns if c != "text"), trained.order
    kind = f"{other} {dict(rows.dtypes)[other]}, measures array<double>"
    listed = lambda x: pa.array(list(x), pa.list_(pa.float64()))
    if trained.size <= most:
        own = trained.ratios.toArrow()
        sent = rows.sparkSession.sparkContext.broadcast((own.column("key").to_numpy(), own.column("ratio").to_numpy()))

        def score(batches):
            scorer = Scorer(*sent.value, order)
            for batch in batches:
                for at, data, offsets in slices(batch.column("text")):
                    yield pa.RecordBatch.from_arrays([batch.column(other).slice(at, len(offsets) - 1), listed(scorer.measures(data, offsets))], names=[other, "measures"])

        return rows.select(other, "text").mapInArrow(score, kind)
    n = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CHUNK + 1
    placed = rows.select(other, "text", F.pmod(F.xxhash64(other, "text"), F.lit(n)).cast("int").alias("chunk")).repartition("chunk")
    found = asked(placed, order).join(trained.ratios, "key")

    def run(texts: pa.Table, ratios: pa.Table) -> pa.Table:
        key, at = np.unique(ratios.column("key").to_numpy(), return_index=True)
        scorer = Scorer(key, ratios.column("ratio").to_numpy()[at], order)
        parts = [scorer.measures(data, offsets) for _, data, offsets in slices(texts.column("text"))]
        return pa.table({other: texts.column(other), "measures": listed(np.concatenate(parts) if parts else [])})

    return placed.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(run, kind)


def train(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> Trained:
    """Counts of folds 0 and 1 are calibrated on fold 3; the model has that calibration and the counts of all three."""
    rows = labelled(docs, labels)
    counts = written(counted(rows, order), "counts")
    apart = rows.where("fold = 3")
    share = min(1.0, CALIBRATE / max(1, apart.count()))
    chosen = apart.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else apart
    part = Trained(counts, True, order)
    sample = measured(chosen.select("toxic", "text"), part).toArrow()
    model = Trained(counts, False, order)
    forget(counts, part.ratios)
    x = np.array(sample.column("measures").to_pylist()).reshape(-1, MEASURES)
    model.weights = fit_logistic(x, sample.column("toxic").to_numpy().astype(float))
    return model


def scored(docs: DataFrame, model: Trained, threshold: float = 0.3, most: int = BROADCAST_GRAMS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    found = measured(docs.select("doc_id", "text"), model, most)
    z = sum((float(w) * F.element_at("measures", i + 1) for i, w in enumerate(model.weights[1:])), F.lit(float(model.weights[0])))
    found = found.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z)))))
    return found.select("doc_id", F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
