"""Mixing to target weights by soft membership.

A classifier learned from the labels table gives each document the probability of each domain: good, poor (quality 0)
and toxic text. Documents get rates, how often each is to be taken, so that the expected tokens of each domain, the sum
of rate * tokens * probability, meet the targets. Rates start at one and stay as near to that as the targets let them:
they minimise the tokens' squares of (rate - 1), and what is missing of the targets at a high price (1 / PRICE), so
    rate = max(0, 1 - p . multipliers)
with a multiplier for each domain: projected gradient with lazy projection. The gradient of the squared misses moves every
rate by its memberships times the misses; the moves add up in the multipliers, and rates are their projection on what isn't
negative. Each step is scaled by the curvature G = sum of tokens * p p' over the documents whose rate isn't zero, and halved
if it doesn't lower the (convex) dual. A step sums as many numbers as there are pairs of domains over all documents; the
rates follow from the multipliers, so no state is kept or sent.

The fitted rates are the final ones, so what they reach is what the fit has measured; targets that no rates reach (all
documents alike, or too few rounds) are reported by a warning. A rate r
takes a document floor(r) times, and once more with probability r - floor(r), by a hash of its id and text. Rows without
words have no tokens; they stay once. Repeated rows share probability, rate and number of copies. A domain without any
mass is left out of the targets.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm.common import PART_BYTES, lighten, own_name, table, tidy, written
from cuewright.llm.words import LOWER, PUNCT, SPACE, STEP, slices, span_hashes, word_hashes, word_spans

DOMAINS = ("good", "poor", "toxic")
#: Target tokens of each domain as shares of those it has.
TARGETS = {"good": 1.0, "poor": 0.4, "toxic": 0.1}
SLOTS, SHAPES, SAMPLE, EPOCHS, ROUNDS, PRICE, STEMS = 1 << 16, 7, 6000, 60, 40, 1e-6, (4, 5)


def shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, SHAPES) shares that tell junk from prose, and the number of words by white space."""
    h, bounds = word_hashes(data, offsets, SPACE)
    n, size = np.diff(bounds), np.maximum(np.diff(offsets), 1)
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, row))
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    again = np.bincount(row[order][same], minlength=len(n))
    many = np.isin(data, np.frombuffer(b"#*$%&|<>!", np.uint8))
    upper, digit, line = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57), data == 10
    out = [sums(many) / size, sums(upper) / size, sums(digit) / size, again / np.maximum(n, 1), sums(line) / size * 10, n / size * 5, np.log1p(n) / 10]
    return np.column_stack(out), n


def word_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the beginnings (STEMS bytes) of each lower-cased word, so that rare endings don't hide a known stem, and the
    first slot of each row."""
    low = LOWER[data]
    starts, ends, bounds = word_spans(low, offsets, PUNCT)
    h = [span_hashes(low, starts, np.minimum(ends, starts + k)) * STEP for k in STEMS]
    return (np.stack(h, 1).ravel() >> np.uint64(48)).astype(np.int64), bounds * len(STEMS)


class Classifier:
    """Multinomial logistic regression on hashed stems (each occurrence weighs 1 / sqrt(stems)) and shapes."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, rate: float = 2.0, ridge: float = 2e-6):
        k, count = len(DOMAINS), [len(w) for w, _ in rows]
        self.words, self.dense, self.base = np.zeros((SLOTS, k), np.float32), np.zeros((SHAPES, k)), np.zeros(k)
        if not rows:
            return
        # Each row's different slots with their weights, and the same in the order of slots: sums over either are runs.
        pairs = [np.unique(w, return_counts=True) for w, _ in rows]
        size = np.array([len(w) for w, _ in pairs])
        at, row = np.concatenate([w for w, _ in pairs]), np.repeat(np.arange(len(rows)), size)
        value = (np.concatenate([n for _, n in pairs]) / np.sqrt(np.maximum(np.repeat(count, size), 1))).astype(np.float32)
        full, firsts = np.flatnonzero(size), (np.cumsum(size) - size)[size > 0]
        order = np.argsort(at, kind="stable")
        by_slot, slot_value = row[order], value[order][:, None]
        slots, slot_firsts = np.unique(at[order], return_index=True)
        x, hot = np.array([s for _, s in rows]), np.eye(k)[label]
        self.mid, self.wide = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mid) / self.wide
        seen = [np.zeros_like(self.words), np.zeros_like(self.dense), np.zeros_like(self.base)]
        for _ in range(EPOCHS):
            z = self.base + x @ self.dense
            if len(at):
                z[full] += np.add.reduceat(self.words[at] * value[:, None], firsts, axis=0)
            off = (softmax(z) - hot) / len(rows)
            own = ridge * self.words
            if len(at):
                own[slots] += np.add.reduceat(off.astype(np.float32)[by_slot] * slot_value, slot_firsts, axis=0)
            steps = [own, x.T @ off + ridge * self.dense, off.sum(0)]
            for w, g, s in zip((self.words, self.dense, self.base), steps, seen, strict=True):
                s += g * g
                w -= (rate * g / (np.sqrt(s) + 1e-8)).astype(w.dtype)

    def posterior(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, domains) probabilities, and words."""
        x, n = shapes(data, offsets)
        at, bounds = word_slots(data, offsets)
        z = self.base + (((x - self.mid) / self.wide) @ self.dense if hasattr(self, "mid") else 0) + np.zeros((len(n), 1))
        for j in range(len(DOMAINS)):
            total = np.concatenate([[0], np.cumsum(self.words[at, j], dtype=np.float64)])
            z[:, j] += np.diff(total[bounds]) / np.sqrt(np.maximum(np.diff(bounds), 1))
        return softmax(z), n


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def learn(docs: DataFrame, labels: DataFrame) -> Classifier:
    """From about SAMPLE labelled rows, chosen by a hash of doc_id."""
    own = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    own = own.select(F.col("doc_id").alias("_id"), F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0).alias("domain"))
    share = min(1.0, SAMPLE / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else own

    @tidy
    def run(batches):
        lighten()
        for batch in batches:
            label = batch.column("domain").to_numpy(zero_copy_only=False)
            for at, data, offsets in slices(batch.column("text"), PART_BYTES):
                x, _ = shapes(data, offsets)
                w, bounds = word_slots(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(label[at : at + len(x)]), pa.array(list(x), pa.list_(pa.float64())), pa.array([w[a:b].astype(np.int32) for a, b in zip(bounds, bounds[1:], strict=False)], pa.list_(pa.int32()))], names=["domain", "shapes", "words"])

    # At most about SAMPLE ids and labels: a fixed bound, so they are broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("_id")).select("domain", "text")
    found = rows.mapInArrow(run, "domain int, shapes array<double>, words array<int>").toArrow().to_pandas()
    found = found.iloc[np.lexsort([found["words"].map(lambda w: crc32(w.tobytes())), found["domain"]])] if len(found) else found
    return Classifier(list(zip(found["words"], found["shapes"], strict=True)), found["domain"].to_numpy(dtype=np.int64))


KINDS = "n_tokens long, p_good double, p_poor double, p_toxic double"


def memberships(text: Column, model) -> Column:
    """KINDS of whole texts (null: no words) as a struct; model: a broadcast Classifier."""

    @F.pandas_udf(KINDS)
    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lighten()
        own = model.value
        for texts in batches:
            parts = [own.posterior(data, offsets) for _, data, offsets in slices(pa.array(texts, pa.string(), from_pandas=True), PART_BYTES)]
            p, n = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros((0, 3)), np.zeros(0))
            yield pd.DataFrame({"n_tokens": n.astype("int64"), **{f"p_{d}": np.round(p[:, j], 9) for j, d in enumerate(DOMAINS)}})

    return run(text)


def rate_of(multipliers: np.ndarray, p: list[Column]) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((float(x) * c for x, c in zip(multipliers[1:], p[1:], strict=True)), float(multipliers[0]) * p[0]))


def fit_rates(members: DataFrame, s: str, targets: dict[str, float], rounds: int = ROUNDS, close: float = 1e-4) -> np.ndarray:
    """Multipliers that bring the expected tokens of each domain to the targets (shares of what it has); a warning if they
    don't, by more than close of all tokens."""
    n, p, k = F.col(f"{s}.n_tokens"), [F.col(f"{s}.p_{d}") for d in DOMAINS], len(DOMAINS)

    def sums(x):
        """Tokens reached, the curvature, and the tokens' squares of the rates."""
        r = rate_of(x, p)
        live = F.when(r > 0, n).otherwise(0)
        row = np.array([v or 0.0 for v in members.agg(*(F.sum(r * n * c) for c in p), *(F.sum(live * a * b) for a in p for b in p), F.sum(r * r * n)).first()], float)
        return row[:k], row[k:-1].reshape(k, k), row[-1]

    best, (now, g, square) = np.zeros(k), sums(np.zeros(k))
    has, total = now, now.sum()
    if not total:
        return best
    goal = has * np.array([targets[d] for d in DOMAINS])
    dual = lambda x, square: square / 2 + x @ goal + PRICE * total * (x @ x) / 2
    lowest, step = dual(best, square), None
    for _ in range(rounds):
        if step is None:
            slope = now - goal - PRICE * total * best
            if np.abs(slope).max() <= 1e-7 * total:
                break
            step = np.linalg.solve(g + PRICE * total * np.eye(k), slope)
        tried = sums(best + step)
        if (new := dual(best + step, tried[2])) > lowest + 1e-12 * total:
            step = step / 2
            continue
        best, (now, g, square), lowest, step = best + step, tried, new, None
    if np.abs(now - goal).max() > close * total:
        shares = {d: (round(float(x / h), 4), targets[d]) for d, x, h in zip(DOMAINS, now, has, strict=True) if h}
        warnings.warn(f"mixing misses its targets; (reached, target) of each domain: {shares}", stacklevel=2)
    return best


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> tuple[DataFrame, str, str, str]:
    """docs and the names of three columns more: memberships (struct), rate, copies."""
    s, rate, copies = (own_name(docs, c) for c in ("mix_membership", "mix_rate", "mix_copies"))
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    members = written(docs.withColumn(s, memberships(F.col("text"), model)), "members")
    multipliers = fit_rates(members.where(F.col(f"{s}.n_tokens") > 0).select(s), s, TARGETS | (targets or {}))
    r = F.round(rate_of(multipliers, [F.col(f"{s}.p_{d}") for d in DOMAINS]), 6)
    r = F.when(F.col(f"{s}.n_tokens") == 0, F.lit(1.0)).otherwise(r)
    chance = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    out = members.withColumn(rate, r).withColumn(copies, F.floor(F.col(rate) + chance).cast("long"))
    return out, s, rate, copies


def take_mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs, each as often as its rate says."""
    out, _, _, copies = mixed(docs, labels, targets)
    n = own_name(out, "mix_n")
    many = out.where(F.col(copies) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return many.select(*docs.columns)


def op6_soft_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, s, rate, copies = mixed(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", f"{s}.*", F.col(rate).alias("rate"), F.col(copies).alias("copies"))
