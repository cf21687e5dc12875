"""Quality rules: plain text counts, and how well a public vocabulary fits a text.

The vocabulary (a sentencepiece model with byte fallback) measures for each text the characters per token, the share of
byte-fallback tokens and the entropy of its tokens (bits). Each language has a band for these: its median over all
documents of enough words, plus and minus some median absolute deviations, but never narrower than a share of the
median. A text outside its language's band is rejected. Texts without words fail the base rule; a null or unknown
language has a band of its own. A language's quartiles are drawn towards those of all by n / (n + `least`) for n measured
documents, so a band goes from that of all to its own without a step. Repeated rows count as often as they stand there and
are judged alike; columns of other names stay as they are.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm.common import TOKENIZERS, own_name, per_worker, table, tidy, written
from cuewright.llm.words import SPACE, Lexicon, gathered, slices, span_hashes, windows, word_spans

SPACES, SYMBOL = b" \t\n\x0b\x0c\r", np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double"
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
#: Deviations allowed below and above the median, and the least half-width of a band: a share of the median, or so much.
LOW, HIGH, LEAST_SHARE, LEAST = 4.5, 10.0, 0.125, {"chars_per_token": 0.0, "byte_share": 0.15, "token_entropy": 0.8}


class PieceCoder:
    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.own.get_piece_size()
        self.is_byte = np.array([self.own.is_byte(i) for i in range(self.size)])
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.known = Lexicon(self.dtype)

    def compute(self, words: list[bytes]) -> list[bytes]:
        return [array(self.dtype.char, x).tobytes() for x in self.own.encode([w.decode() for w in words], num_threads=1)]

    def stats(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """A column for each of STATS."""
        starts, ends, bounds = word_spans(data, offsets)
        n, rows = np.diff(bounds), len(offsets) - 1
        sums = lambda x, at: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
        h, row = span_hashes(data, starts, ends), np.repeat(np.arange(rows), n)
        chars = sums(~SPACE[data] & (data & 0xC0 != 0x80), offsets)
        lines = [[x for x in t.split(b"\n") if x.strip(SPACES)] for t in (data[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False))]
        at, size = self.known.runs(h, data, starts, ends, self.compute)
        ids, tokens = gathered(self.known.pool, at, size).astype(np.int64), sums(size, bounds)
        key, count = np.unique(np.repeat(np.arange(rows), tokens) * self.size + ids, return_counts=True)
        owner = key // self.size
        share = count / tokens[owner]
        of = np.maximum(tokens, 1)
        return [
            n, chars, sums(SYMBOL[data], offsets), np.array([len(x) - len(set(x)) for x in lines], np.int64), sums(repeated(h, bounds, row), bounds), tokens,
            chars / of, np.bincount(np.repeat(np.arange(rows), tokens), self.is_byte[ids], rows) / of, np.bincount(owner, -share * np.log2(share), rows),
        ]


def repeated(h: np.ndarray, bounds: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of three words found twice or more in its row."""
    x, at = windows(h, bounds, 3)
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((x, own))
    same = np.zeros(len(x) + 1, bool)
    same[1:-1] = (x[order][1:] == x[order][:-1]) & (own[order][1:] == own[order][:-1])
    often = order[same[1:] | same[:-1]]
    hit = np.zeros(len(h), bool)
    first = bounds[:-1][own[often]] + often - at[:-1][own[often]]
    for k in range(3):
        hit[first + k] = True
    return hit


def stats(text: Column, vocabulary: str) -> Column:
    """STATS of whole texts as a struct (null: no words)."""
    names = [x.split()[0] for x in STATS.split(", ")]

    @F.arrow_udf(STATS)
    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = per_worker(("pieces", vocabulary), lambda: PieceCoder(vocabulary))
        for column in batches:
            parts = [coder.stats(data, offsets) for _, data, offsets in slices(column)]
            kinds = [pa.int64() if x.endswith("long") else pa.float64() for x in STATS.split(", ")]
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * len(names)
            yield pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    return run(text)


def base_failed(s: str) -> Column:
    return (F.col(f"{s}.n_words") < 50) | (100 * F.col(f"{s}.n_repeat_words") > 50 * F.col(f"{s}.n_words"))


def bands(measured: DataFrame, s: str, lang: str, least: int = 20) -> DataFrame:
    """A row for each value of lang, and one more (every = true) for all: the low and high end of each measure, from
    the rows of measured that pass the base rule. Quartiles are exact, of measures rounded to thousandths, so that they
    don't depend on the order of rows; what crosses the shuffle is counts of different values, bounded by the rounding."""
    good = measured.where(~base_failed(s)).select(F.col(lang).alias("lang"), *(F.col(f"{s}.{m}").alias(m) for m in MEASURES))
    kinds = good.withColumn("every", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("lang", F.when(~F.col("every"), F.col("lang")))
    mid = kinds.groupBy("every", "lang").agg(F.count("*").alias("n"), *(F.percentile(F.round(m, 3), F.lit([0.25, 0.5, 0.75])).alias(m) for m in MEASURES))
    every = mid.where("every").select(*(F.col(m).alias(f"all_{m}") for m in MEASURES))
    mid, own, ends = mid.crossJoin(F.broadcast(every)), F.when(F.col("every"), F.lit(1.0)).otherwise(F.col("n") / (F.col("n") + least)), []
    for m in MEASURES:
        q = [own * F.col(m)[i] + (1 - own) * F.col(f"all_{m}")[i] for i in range(3)]
        # Half the distance between the quartiles is the median absolute deviation of a symmetric spread.
        wide = lambda times: F.greatest(times * (q[2] - q[0]) / 2, LEAST_SHARE * q[1], F.lit(LEAST[m]))  # noqa: B023, E731
        ends += [(q[1] - wide(LOW)).alias(f"{m}_low"), (q[1] + wide(HIGH)).alias(f"{m}_high")]
    return mid.select("every", "lang", *ends)


def judged(measured: DataFrame, s: str, lang: str, verdict: str) -> DataFrame:
    """measured with a boolean column verdict: inside the band of its language and past the base rule."""
    limits = bands(measured, s, lang)
    ends, own_lang, own_band = [c for c in limits.columns if c not in ("every", "lang")], own_name(measured, "band_lang"), own_name(measured, "band")
    # The band of all documents is one row of numbers; those of languages are joined, and Spark checks their size.
    every = limits.where("every").first()
    own = limits.where(~F.col("every")).select(F.col("lang").alias(own_lang), F.struct(*ends).alias(own_band))
    out = measured.join(own, F.col(lang).eqNullSafe(F.col(own_lang)), "left")
    band = {c: F.coalesce(F.col(f"{own_band}.{c}"), F.lit(every[c] if every else None).cast("double")) for c in ends}
    inside = F.lit(True)
    for m in MEASURES:
        inside &= F.col(f"{s}.{m}").between(band[f"{m}_low"], band[f"{m}_high"])
    return out.withColumn(verdict, ~base_failed(s) & F.coalesce(inside, F.lit(True))).drop(own_lang, own_band)


def keep_good(docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """The rows of docs that pass the base rule and their language's band, all columns as they were."""
    s, verdict = own_name(docs, "quality_stats"), own_name(docs, "quality_verdict")
    lang = "lang" if "lang" in docs.columns else own_name(docs, "quality_lang")
    rows = docs if lang in docs.columns else docs.withColumn(lang, F.lit(None).cast("string"))
    measured = written(rows.withColumn(s, stats(F.col("text"), vocabulary)), "quality")
    return judged(measured, s, lang, verdict).where(verdict).select(*docs.columns)


def op2_tokeniser_fertility(spark: SparkSession, sf_dir: str, vocabulary: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = written(docs.select("doc_id", "lang", stats(F.col("text"), vocabulary).alias("s")), "fertility")
    rows = judged(measured, "s", "lang", "kept")
    return rows.select("doc_id", "lang", "s.*", base_failed("s").alias("base_failed"), "kept")
