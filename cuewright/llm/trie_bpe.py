"""Byte-level BPE encoding by traversal of a trie of distinct words, and decoding.

For byte-level BPE the encoding of a prefix is the encoding of a shorter prefix plus one last token, so the last token
of every prefix tells the whole encoding. Distinct words are inserted into a trie (here: sorted, each entering the trie
at the place where it leaves its predecessor); depth-first, every node gets its last token from the states above it, so
a prefix that many words share is encoded once. A token may follow a state only if no merge would have crossed the
seam; that test is kept by pair of tokens.

Whole texts are cut where white space begins after other characters; no pre-token crosses such a place, so each such
unit is split and encoded once and remembered. Texts with control or other white space than space, tab and line ends are
split whole, by the library's own pre-tokenizer. Strings of added tokens become their ids.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from cuewright.llm.common import TOKENIZERS, per_worker, table, tidy
from cuewright.llm.words import Lexicon, gathered, slices, span_hashes

UNIT = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿]")
UNIT_SPACE = np.isin(np.arange(256), [0x20, 0x0A, 0x09, 0x0D])
#: Bytes that odd white space has or begins with.
MAY_BE_ODD = np.isin(np.arange(256), [0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF])
#: Latin units are split by the pre-tokenizer's public pattern, others by the library.
LATIN = re.compile("[\\x00-\\u024f]*")
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of byte-level BPE."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieCoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        raw = lambda s: bytes(letters[c] for c in s)
        added = {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if i not in added}
        self.bytes = {i: s for s, i in self.ids.items()} | {i: s.encode() for i, s in added.items()}
        self.added = {s: i for i, s in added.items()}
        if max(self.bytes) >= 1 << 20:
            raise ValueError("vocabularies of more than 1,048,576 ids aren't handled")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        vocab = spec["model"]["vocab"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            self.merges.setdefault(pair, (rank, made))
            self.halves.setdefault(made, (*pair, rank))
        self.longest = max(map(len, self.ids))
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.letters = letters
        self.fits: dict[int, bool] = {}
        self.dtype = np.dtype("<u2" if max(self.bytes) < 1 << 16 else "<u4")
        self.known = Lexicon(self.dtype)
        self.shown, self.raw = (self.listed(lambda i, f=f: f(i) if i in self.bytes else b"") for f in (lambda i: b"%d," % i, self.bytes.__getitem__))

    def merge(self, parts: list[int]) -> list[int]:
        """Plain BPE of a few tokens: the lowest rank merges first, the leftmost of equals."""
        while len(parts) > 1:
            rank, k = min((self.merges.get(p, (1 << 60,))[0], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts = [*parts[:k], self.merges[parts[k], parts[k + 1]][1], *parts[k + 2 :]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand after token a: encoding their joint bytes gives just these two. Undoes the later
        of both tokens' last merges step by step; a seam merge that comes before is a conflict."""
        found = self.fits.get(a << 20 | b)
        if found is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            found = self.fits[a << 20 | b] = self._follows(a, b)
        return found

    def _follows(self, a: int, b: int) -> bool:
        limit = 1 << 60
        while True:
            seam = self.merges.get((a, b))
            if seam and seam[0] < limit:
                return False
            ra, rb = self.halves.get(a, (0, 0, -1))[2], self.halves.get(b, (0, 0, -1))[2]
            if max(ra, rb) < 0:
                return True
            # Undo the later merge; at equal ranks the left one was made first, so the right one is undone first.
            if ra > rb:
                limit, a = ra, self.halves[a][1]
            else:
                limit, b = rb, self.halves[b][0]
                # a seam merge of the same rank would stand to the left, and so come first
                limit += 1

    def encode_words(self, words: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Depth first through the trie of words; states[d] is the last token of the prefix of d bytes, with its
        length. Just one token is possible at a node, so the order of trial is free."""
        out, path, states = {}, b"", [(-1, 0)]
        known, longest, fits, follows = self.ids.get, self.longest, self.fits, self.follows
        for word in sorted(words):
            common, most = 0, min(len(word), len(path))
            if word[:most] == path[:most]:
                common = most
            else:
                while word[common] == path[common]:
                    common += 1
            del states[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                found = None
                for start in range(max(0, end - longest), end):
                    token = known(word[start:end])
                    if token is not None and (before := states[start]) is not None:
                        ok = True if not start else fits.get(before[0] << 20 | token)
                        if ok or ok is None and follows(before[0], token):
                            found = token, end - start
                            break
                states.append(found)
            path, at, found = word, len(word), []
            while at and states[at] is not None:
                token, n = states[at]
                found.append(token)
                at -= n
            out[word] = tuple(found[::-1])
        return out

    def split(self, unit: str) -> list[bytes]:
        """The pre-tokens of a unit as bytes."""
        if LATIN.fullmatch(unit) and not ODD_SPACE.search(unit):
            return [s.encode() for s in PATTERN.findall(unit)]
        return [bytes(map(self.letters.__getitem__, s)) for s, _ in self.pre.pre_tokenize_str(unit)]

    def listed(self, of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What stands for each id, as one pool of bytes, with the place and length of each."""
        parts = [of(i) for i in range(max(self.bytes) + 1)]
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(n) - n, n

    def learn(self, units: list[bytes]) -> list[bytes]:
        """The packed ids of units."""
        pieces = [self.split(u.decode()) for u in units]
        words = self.encode_words(list(set(chain.from_iterable(pieces))))
        code = self.dtype.char
        packed = {w: array(code, ids).tobytes() for w, ids in words.items()}
        return [packed[p[0]] if len(p) == 1 else b"".join(map(packed.__getitem__, p)) for p in pieces]

    def whole(self, text: bytes) -> bytes:
        """The packed ids of a text with odd white space or added tokens."""
        parts = [p for p in self.cut.split(text.decode()) if p] if self.cut else [text.decode()]
        units = lambda p: [p.encode()] if ODD_SPACE.search(p) else [u.encode() for u in UNIT.findall(p)]
        return b"".join(array(self.dtype.char, [self.added[p]]).tobytes() if p in self.added else b"".join(self.learn(units(p))) for p in parts)

    def odd(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Rows with odd white space or added tokens."""
        rows = set()
        for i in np.unique(np.searchsorted(offsets, np.flatnonzero(MAY_BE_ODD[data]), "right") - 1).tolist():
            if ODD_SPACE.search(data[offsets[i] : offsets[i + 1]].tobytes().decode()):
                rows.add(i)
        raw = data.tobytes()
        for s in map(str.encode, self.added):
            at = raw.find(s)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, "right")) - 1
                rows.add(i)
                at = raw.find(s, max(at + 1, int(offsets[i + 1]) - len(s) + 1))
        return sorted(rows)

    def spread(self, ids: np.ndarray, bounds: np.ndarray, pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[bytes]:
        """What stands for the ids of each row."""
        out = gathered(pool, at[ids], n[ids]).tobytes()
        spots = np.concatenate([[0], np.cumsum(n[ids])])[bounds].tolist()
        return [out[a:b] for a, b in zip(spots, spots[1:], strict=False)]

    def encode(self, texts):
        """For each text (null: empty) its ids (packed), its ids as decimals joined by commas, and the bytes they decode to."""
        for _, data, offsets in slices(pa.array(texts, pa.string()) if isinstance(texts, list) else texts):
            space = UNIT_SPACE[data]
            cut = np.zeros(len(data) + 1, bool)
            cut[1:-1] = space[1:] & ~space[:-1]
            cut[offsets] = True
            cut[-1] = False
            starts = np.flatnonzero(cut[:-1])
            ends = np.append(starts[1:], len(data))
            bounds = np.searchsorted(starts, offsets)
            odd = self.odd(data, offsets)
            plain = np.ones(len(starts), bool)
            for i in odd:
                plain[bounds[i] : bounds[i + 1]] = False
            h, n = span_hashes(data, starts[plain], ends[plain]), np.zeros(len(starts), np.int64)
            at, n[plain] = self.known.runs(h, data, starts[plain], ends[plain], self.learn)
            ids = gathered(self.known.pool, at, n[plain])
            sizes = np.diff(np.concatenate([[0], np.cumsum(n)])[bounds])
            if odd:
                parts, spots = [], np.concatenate([[0], np.cumsum(sizes)])
                for i in range(len(sizes)):
                    parts.append(np.frombuffer(self.whole(data[offsets[i] : offsets[i + 1]].tobytes()), self.dtype) if i in odd else ids[spots[i] : spots[i + 1]])
                ids, sizes = np.concatenate(parts), np.array([len(x) for x in parts])
            rows = np.concatenate([[0], np.cumsum(sizes)])
            own = (ids[a:b].tobytes() for a, b in zip(rows, rows[1:], strict=False))
            for x, shown, raw in zip(own, self.spread(ids, rows, *self.shown), self.spread(ids, rows, *self.raw), strict=True):
                yield x, shown[:-1], raw


KINDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, vocabulary: str, with_tokens: bool = False) -> DataFrame:
    """For each row of docs doc_id, n_tokens, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text
    (ill-formed UTF-8 becomes U+FFFD) and, if asked for, tokens and decoded. A null text is empty; other columns don't
    matter. Rows are independent: no shuffle; repeated rows give the same, an empty text no tokens."""

    @tidy
    def run(batches):
        coder = per_worker(("trie", vocabulary), lambda: TrieCoder(vocabulary))
        for batch in batches:
            doc_id, text = batch.columns
            at, out, size = 0, [], 0

            def made(at, out):
                cols = list(zip(*out, strict=True))
                parts = [pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])]
                if with_tokens:
                    flat = np.frombuffer(b"".join(cols[3]), coder.dtype).astype(np.int32)
                    parts += [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cols[0])]).astype(np.int32)), pa.array(flat)), pa.array(cols[4])]
                return pa.RecordBatch.from_arrays([doc_id.slice(at, len(out)), *parts], names=["doc_id", *names])

            for ids, shown, raw in coder.encode(text):
                decoded = raw.decode("utf-8", "replace")
                row = len(ids) // coder.dtype.itemsize, sha256(shown).hexdigest(), sha256(decoded.encode()).hexdigest()
                out.append((*row, ids, decoded) if with_tokens else row)
                size += len(raw)
                if size > 4_000_000:
                    yield made(at, out)
                    at, out, size = at + len(out), [], 0
            if out:
                yield made(at, out)

    kinds = KINDS + ", tokens array<int>, decoded string" * with_tokens
    names = [x.split()[0] for x in kinds.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {kinds}")


def op9_trie_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), vocabulary)
