"""Token-ID output as length-delimited binary records, with an offset index for shuffled reads.

A shard `shard-NNNNN.bin` is a run of records, each
    length of the payload (u64) | masked checksum of those 8 bytes (u32) | payload | masked checksum of it (u32)
all little-endian. The payload is the serialised sequence: its ids as u16, or u32 where the vocabulary has more than
65,536 ids. The checksum is CRC-32 turned right by 15 bits plus a constant, so that checksums of data that hold
checksums aren't degenerate. `shard-NNNNN.idx` has 25 bytes a record: doc_id (i64), 1 if there is one (u8), place of
the record in the shard (u64), number of ids (u64).

Shards and records ascend by doc_id (null first; equal ids by the text's hash, then by text). A task writes to a name of its own and renames it
at the end, so a task that runs again or twice leaves one whole file. Empty input writes no shard. A null text is empty;
repeated rows have a record each; columns other than doc_id and text don't matter.
"""

from __future__ import annotations

import os
import posixpath
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm.common import TOKENIZERS, own_name, per_worker, shared_folder, table
from cuewright.llm.trie_bpe import byte_letters
from cuewright.llm.words import LOWER, Lexicon, gathered, slices, span_hashes, word_spans

MASK = 0xA282EAD8
ENTRY = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("at", "<u8"), ("n", "<u8")])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def unframe(read, at: int) -> bytes:
    """The payload of the record at `at`; read(offset, size) gives bytes. Raises ValueError on damage."""
    head = read(at, 12)
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError(f"damaged length at {at}")
    size = struct.unpack("<Q", head[:8])[0]
    body = read(at + 12, size + 4)
    if len(body) < size + 4 or struct.unpack("<I", body[size:])[0] != masked(body[:size]):
        raise ValueError(f"damaged record at {at}")
    return body[:size]


def filesystem(uri: str):
    """The store of a URI and the path in it (local, HDFS, S3, GCS)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class WordCoder:
    """Encodes with a `tokenizers` vocabulary that lower-cases and whose white space only separates: each different run of
    other characters is encoded once by the library and remembered by its hash; a text's ids are gathered from these. A run
    of letters with one full stop or comma after it is two pre-tokens, so its letters are encoded apart. Where neither added
    tokens nor combining marks can be meant, A-Z are lower-cased before the look-up, as the vocabulary would."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        top = self.own.get_vocab_size(with_added_tokens=True)
        self.dtype, self.code = (np.dtype("<u2"), "H") if top <= 1 << 16 else (np.dtype("<u4"), "I")
        self.known = Lexicon(self.dtype)
        self.shown = {b: c for c, b in byte_letters().items()}
        self.ends = dict(zip((b".", b","), self.library([b".", b","]), strict=True))

    def library(self, words: list[bytes]) -> list[bytes]:
        found = self.own.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [array(self.code, x.ids).tobytes() for x in found]

    def letters(self, words: list[str]) -> list[bytes]:
        """Words of Latin letters alone are one pre-token each, in composed form: the library's merges run on its bytes."""
        tokenize, code, shown = self.own.model.tokenize, self.code, self.shown
        return [array(code, [t.id for t in tokenize(w.lower() if w.isascii() else w.lower().encode().decode("latin-1").translate(shown))]).tobytes() for w in words]

    def compute(self, words: list[bytes]) -> list[bytes]:
        cores = [w[:-1] if w[-1:] in self.ends and w[-2:-1].isalpha() else w for w in words]
        new = list(set(cores))
        shown = {c: w for c in new if self.latin(w := c.decode())}
        rest = [c for c in new if c not in shown]
        known = dict(zip(rest, self.library(rest), strict=True)) | dict(zip(shown, self.letters(list(shown.values())), strict=True))
        return [known[c] if c is w else known[c] + self.ends[w[-1:]] for c, w in zip(cores, words, strict=True)]

    @staticmethod
    def latin(w: str) -> bool:
        """All letters, up to U+024F; without U+0130, whose lower case has a mark."""
        return w.isalpha() and (w.isascii() or max(w) < "\u0250" and "\u0130" not in w)

    def lowered(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """data with A-Z lower-cased, but for rows that may hold added tokens or combining marks."""
        low = LOWER[data]
        odd = (data == 0xCC) | (data == 0xCD)
        odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        for i in np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1):
            low[offsets[i] : offsets[i + 1]] = data[offsets[i] : offsets[i + 1]]
        return low

    def encode(self, column: pa.Array):
        """For each text (null: empty) the bytes of its ids."""
        for _, data, offsets in slices(column):
            low = self.lowered(data, offsets)
            starts, ends, bounds = word_spans(low, offsets)
            at, n = self.known.runs(span_hashes(low, starts, ends), low, starts, ends, self.compute)
            raw = gathered(self.known.pool, at, n).tobytes()
            spots = (np.concatenate([[0], np.cumsum(n)])[bounds] * self.dtype.itemsize).tolist()
            for a, b in zip(spots, spots[1:], strict=False):
                yield raw[a:b]


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2) -> list[dict]:
    """Encode docs' whole texts (null: empty), append end_id, write shards in ascending doc_id order into folder.
    Returns the manifest, a row for each shard: name, docs, ids, the ids of all shards before it."""
    tie = own_name(docs.select("doc_id", "text"), "tie")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias(tie))
    rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")

    def write(batches):
        store, path = filesystem(folder)
        shard = TaskContext.get().partitionId()
        name, own = f"shard-{shard:05d}", f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        coder = per_worker(("records", vocabulary), lambda: WordCoder(vocabulary))
        end = np.array([end_id], coder.dtype).tobytes()
        store.create_dir(path)
        part, index, at, ids = posixpath.join(path, f"{own}.part"), [], 0, 0
        with store.open_output_stream(part) as out:
            for batch in batches:
                for doc_id, got in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text")), strict=True):
                    record = frame(got + end)
                    index.append((doc_id or 0, doc_id is not None, at, (len(got) + len(end)) // coder.dtype.itemsize))
                    out.write(record)
                    at += len(record)
                    ids += index[-1][3]
        if not index:
            store.delete_file(part)
            return
        with store.open_output_stream(f"{part}.idx") as out:
            out.write(np.array(index, ENTRY).tobytes())
        store.move(f"{part}.idx", posixpath.join(path, f"{name}.idx"))
        store.move(part, posixpath.join(path, f"{name}.bin"))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "docs": [len(index)], "ids": [ids], "item": pa.array([coder.dtype.itemsize], pa.int32())})

    kinds = "shard int, name string, docs long, ids long, item int"
    manifest = [r.asDict() for r in rows.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, kinds).collect()]
    before = 0
    for m in sorted(manifest, key=lambda m: m["shard"]):
        m["before"], before = before, before + m["ids"]
    return sorted(manifest, key=lambda m: m["shard"])


def read_records(spark: SparkSession, folder: str, manifest: list[dict], shuffle_seed: int | None = None) -> DataFrame:
    """Read shards back through their offset index: doc_id, start (ids of all documents before it), n_tokens, ids (u32
    little-endian bytes). With shuffle_seed each shard's records come in a shuffled order."""
    kinds = "doc_id long, start long, n_tokens long, ids binary"
    if not manifest:
        return spark.createDataFrame([], kinds)
    shards = spark.createDataFrame([(m["name"], m["before"], m["item"]) for m in manifest], "name string, before long, item int")

    def read(batches):
        store, path = filesystem(folder)
        for batch in batches:
            for name, before, item in zip(*(batch.column(c).to_pylist() for c in ("name", "before", "item")), strict=True):
                with store.open_input_file(posixpath.join(path, f"{name}.idx")) as f:
                    index = np.frombuffer(f.read(), ENTRY)
                start = before + np.concatenate([[0], np.cumsum(index["n"][:-1].astype("int64"))])
                order = np.arange(len(index)) if shuffle_seed is None else np.random.default_rng([shuffle_seed, before]).permutation(len(index))
                with store.open_input_file(posixpath.join(path, f"{name}.bin")) as f:
                    for part in np.array_split(order, max(1, len(order) // 1000)):
                        ids = [np.frombuffer(unframe(lambda at, n: (f.seek(at), f.read(n))[1], int(index["at"][i])), f"<u{item}").astype("<u4").tobytes() for i in part]
                        doc_id = pa.array(index["doc_id"][part], mask=index["has_id"][part] == 0)
                        yield pa.RecordBatch.from_arrays([doc_id, pa.array(start[part], pa.int64()), pa.array(index["n"][part].astype("int64")), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return shards.repartitionByRange(len(manifest), "name").mapInArrow(read, kinds)


def op5_length_delimited_records(spark: SparkSession, sf_dir: str, vocabulary: str = f"{TOKENIZERS}/word_bpe_49k.json") -> DataFrame:
    """Encode, write and read back all documents; one digest row for each."""
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    manifest = write_records(table(spark, sf_dir, "documents"), folder, vocabulary)
    rows = read_records(spark, folder, manifest)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
