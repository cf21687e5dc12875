"""Language identification by language-bitmask n-gram filters.

Texts become lower-case letters with single spaces between words; their n-grams (SIZES characters, within and across words)
are counted for each language over all documents that may teach. A language has an n-gram if it makes up at least LEAST
of the language's n-grams and SHARE of the rate in the language that uses it most. LEAST bounds the number of n-grams
(1 / LEAST for each language and size), and with them the filter, however large the corpus is.

The filter is a Bloom filter, bit-sliced: a slot holds one bit for each language, so HASHES look-ups and an AND give
all languages that contain an n-gram at once. A text's n-grams are looked up, and the set bits are counted for each language.
Of n n-grams a language would get n * f by chance alone, where f is the share of random n-grams that its slice answers with
yes, so (hits - n * f) / (1 - f) remain. The language with most wins, of equal ones that with more documents, then by
name. The score is the winner's share of what remains for all.

Texts that are null or have no letter are `und` with score 0, as are all texts where nothing could be learned. A text of
which no n-gram is known gets the language with most documents, with score 0. Null languages teach nothing; neither do
rows with a null doc_id. Repeated rows count as often as they occur; very long texts count whole, slice by slice. Any
number of languages is taken, 64 to a word of the slot.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm.common import own_name, per_worker, splitmix, table, written
from cuewright.llm.words import slices

SIZES, LEAST, SHARE, HASHES, SLOTS, SEGMENT = (2, 3, 4), 2e-6, 0.25, 3, 2**23, 2**16
UNKNOWN = "und"


def alphabet() -> np.ndarray:
    """For each code point its lower-case letter (or mark), a space for all others."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if x.isalpha() or unicodedata.category(x)[0] == "M":
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' letters with single spaces between words and one at each end, and the first place of each text."""
    first = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(first)])[offsets]
    x = known[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    # A space stands before and after each text.
    n = np.diff(at)
    place = at + 2 * np.arange(len(at))
    spaced = np.full(place[-1], 32, np.uint32)
    spaced[np.arange(len(x)) + 2 * np.repeat(np.arange(len(n)), n) + 1] = x
    keep = np.ones(len(spaced), bool)
    keep[1:] = (spaced[1:] != 32) | (spaced[:-1] != 32)
    keep[place[:-1]] = True
    return spaced[keep], np.concatenate([[0], np.cumsum(keep)])[place]


def grams(x: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of `size` characters that hold a letter and lie in one text, and the text of each."""
    n = max(len(x) - size + 1, 0)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h * np.uint64(0x1F123BB5159A55E5)) ^ x[k : k + n]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if n:
        good = row[:n] == row[size - 1 :]
        return splitmix(h[good]), row[:n][good]
    return h, row[:0]


def pieces(x: np.ndarray, bounds: np.ndarray, size: int, step: int = 1_000_000):
    """grams() a million places at a time, however long a text is."""
    for s in range(0, max(len(x) - size + 1, 0), step):
        part = slice(s, s + step + size - 1)
        low, high = np.searchsorted(bounds, [s, min(s + step + size - 1, len(x))], "right")
        own = np.concatenate([[s], bounds[low:high], [min(s + step + size - 1, len(x))]]) - s
        h, row = grams(x[part], own, size)
        yield h, row + low - 1


def counted(docs: DataFrame, codes: dict[str, int]) -> DataFrame:
    """code, size, gram, n of the teaching documents (text, lang)."""

    def run(batches):
        known = per_worker("alphabet", alphabet)
        for batch in batches:
            code = np.array([codes[x] for x in batch.column("lang").to_pylist()], np.int64)
            for first, data, offsets in slices(batch.column("text")):
                x, bounds = letters(data, offsets, known)
                own = code[first : first + len(offsets) - 1]
                for size in SIZES:
                    for h, row in pieces(x, bounds, size):
                        for c in np.unique(own[row]):
                            gram, n = np.unique(h[own[row] == c], return_counts=True)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), c, np.int32)), pa.array(np.full(len(gram), size, np.int32)), pa.array(gram.view(np.int64)), pa.array(n)], names=["code", "size", "gram", "n"])

    found = docs.mapInArrow(run, "code int, size int, gram long, n long")
    return found.groupBy("code", "size", "gram").agg(F.sum("n").alias("n"))


def places(gram, k: int, slots: int):
    """The slot of the k-th hash of each n-gram: two halves of its hash, the second taken k times."""
    if isinstance(gram, np.ndarray):
        low, step = gram & np.uint64(0xFFFFFFFF), gram >> np.uint64(32) | np.uint64(1)
        return ((low + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64)
    low, step = gram.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(gram, 32).bitwiseOR(F.lit(1).cast("long"))
    return (low + k * step).bitwiseAND(F.lit(slots - 1).cast("long"))


class Filter:
    """The bit-sliced Bloom filter: slots of as many bytes as the languages need, and each language's chance of a false
    yes."""

    def __init__(self, languages: list[str], data: np.ndarray):
        self.languages, self.data = languages, data
        bits = np.zeros(8 * data.shape[1])
        for b in range(data.shape[1]):
            bits[8 * b : 8 * b + 8] = np.bincount(data[:, b], minlength=256) @ BYTE_BITS
        self.false = (bits[: len(languages)] / len(data)) ** HASHES

    def holders(self, gram: np.ndarray) -> np.ndarray:
        """For each n-gram the bits of the languages that hold it, as bytes."""
        out = self.data[places(gram, 0, len(self.data))]
        for k in range(1, HASHES):
            out &= self.data[places(gram, k, len(self.data))]
        return out

    def hits(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of each text, and of these the ones that each language holds."""
        rows, width = len(bounds) - 1, self.data.shape[1]
        n, out = np.zeros(rows, np.int64), np.zeros((rows, 8 * width), np.int64)
        for size in SIZES:
            for h, row in pieces(x, bounds, size):
                n += np.bincount(row, minlength=rows)
                held = self.holders(h)
                for b in range(width):
                    # Texts by byte, then the bits of the bytes: a popcount for each language.
                    out[:, 8 * b : 8 * b + 8] += np.bincount(row * 256 + held[:, b], minlength=256 * rows).reshape(rows, 256) @ BYTE_BITS
        return n, out[:, : len(self.languages)]

    def decide(self, n: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language (its number) and score of each text. A slice that says yes to all tells nothing."""
        room = np.maximum(1 - self.false, 1e-9)
        rest = np.round(np.maximum((hits - n[:, None] * self.false) / room, 0), 6)
        best, total = rest.argmax(1), rest.sum(1)
        return best, np.where(total > 0, rest[np.arange(len(rest)), best] / np.maximum(total, 1e-300), 0.0)


BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def learned(docs: DataFrame) -> Filter:
    """The filter of documents (text, lang, both not null). The languages, by falling number of documents, and one row for
    each of them and size come to the driver, and the filter itself, whose size depends on the number of languages only."""
    docs = docs.select("text", F.col("lang").cast("string").alias("lang"))
    many = docs.groupBy("lang").count().collect()
    names = [r.lang for r in sorted(many, key=lambda r: (-r["count"], r.lang))]
    width = max(1, -(-len(names) // 8))
    slots = SLOTS >> max(0, (width - 1).bit_length() - 3)
    table_of_bits = np.zeros((slots, width), np.uint8)
    counts = written(counted(docs, {x: i for i, x in enumerate(names)}), "grams")
    totals = counts.groupBy("code", "size").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), ["code", "size"]).withColumn("rate", F.col("n") / F.col("total")).where(F.col("rate") >= LEAST)
    held = rates.groupBy("size", "gram").agg(F.collect_list(F.struct("code", "rate")).alias("rates"), F.max("rate").alias("most"))
    held = held.select("gram", F.explode(F.filter("rates", lambda r: r["rate"] >= SHARE * F.col("most"))["code"]).alias("code"))
    bits = held.select("code", F.explode(F.array(*(places(F.col("gram"), k, slots) for k in range(HASHES)))).alias("slot"))
    byte = F.expr("shiftleft(1, code % 8)")
    bytes_ = bits.groupBy("slot", F.floor(F.col("code") / 8).cast("int").alias("byte")).agg(F.bit_or(byte).alias("bits"))

    def pack(key, data):
        out = np.zeros(SEGMENT, np.uint8)
        out[data["slot"].to_numpy() % SEGMENT] = data["bits"].to_numpy()
        return pa.table({"segment": [key[0].as_py()], "byte": pa.array([key[1].as_py()], pa.int32()), "data": [out.tobytes()]})

    segments = bytes_.withColumn("segment", F.floor(F.col("slot") / SEGMENT)).groupBy("segment", "byte").applyInArrow(pack, "segment long, byte int, data binary")
    for r in segments.toLocalIterator():
        part = slice(r.segment * SEGMENT, min((r.segment + 1) * SEGMENT, slots))
        table_of_bits[part, r.byte] = np.frombuffer(r.data, np.uint8)[: part.stop - part.start]
    return Filter(names, table_of_bits)


def identified(docs: DataFrame, filter_: Filter) -> DataFrame:
    """docs (text and other columns) with lang_pred and score in place of text and of columns of those names."""
    sent, letter = docs.sparkSession.sparkContext.broadcast(filter_), own_name(docs, "has_letter")

    def run(batches):
        known = per_worker("alphabet", alphabet)
        own = sent.value
        names = pa.array([*own.languages, UNKNOWN])
        for batch in batches:
            told = batch.column(letter).to_numpy(zero_copy_only=False)
            for first, data, offsets in slices(batch.column("text")):
                n = len(offsets) - 1
                best, score = np.full(n, len(own.languages)), np.zeros(n)
                if own.languages:
                    good = told[first : first + n]
                    best[good], score[good] = (x[good] for x in own.decide(*own.hits(*letters(data, offsets, known))))
                yield pa.RecordBatch.from_arrays([*(c.slice(first, n) for c in batch.columns[:-2]), names.take(pa.array(best)), pa.array(score)], names=[*(f.name for f in kept), "lang_pred", "score"])

    docs = docs.drop("lang_pred", "score")
    kept = [f for f in docs.schema.fields if f.name != "text"]
    rows = docs.select(*(F.col(f"`{f.name}`") for f in kept), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(letter))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double"])
    return rows.mapInArrow(run, schema)


def op12_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    filter_ = learned(docs.where((fold != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    out = identified(docs.select("doc_id", "text"), filter_)
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
