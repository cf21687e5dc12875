import hashlib
import random
import zlib

import numpy as np
import pytest

from cuewright.llm.common import TOKENIZERS, shared_folder
from cuewright.llm.records import frame, masked, read_records, unframe, write_records
from cuewright.llm.trie_bpe import TrieCoder, encode_decode

WORD, BYTE = f"{TOKENIZERS}/word_bpe_49k.json", f"{TOKENIZERS}/byte_bpe_50k.json"


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def fuzz(n=400, seed=4):
    pick = random.Random(seed)
    parts = ["the", "The", " ", "  ", "\n", "\r\n", "\t", ".", ",", "'s", "É", "É", "H̱", "İ", "<|endoftext|>", "<|ENDOFTEXT|>", "日", "9", " ", "\x1c", "aaaa", "ß", '"', "\U0001f44d", "loving"]
    return ["".join(pick.choice(parts) for _ in range(pick.randint(0, 30))) for _ in range(n)]


def test_trie_equals_library():
    own, texts = library(BYTE), [*fuzz(), "a" * 3000, ""]
    got = list(TrieCoder(BYTE).encode(texts))
    for text, (ids, shown, raw) in zip(texts, got, strict=True):
        want = own.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u2").tolist() == want
        assert shown == ",".join(map(str, want)).encode()
        assert raw.decode() == own.decode(want, skip_special_tokens=False)


def test_encode_decode(clash, odd):
    rows = encode_decode(clash, BYTE, with_tokens=True).collect()
    assert len(rows) == len(odd)
    own = library(BYTE)
    want = sorted((hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), len(ids), hashlib.sha256((t or "").encode()).hexdigest()) for t in odd for ids in [own.encode(t or "", add_special_tokens=False).ids])
    assert sorted((r.ids_sha256, r.n_tokens, r.decoded_sha256) for r in rows) == want
    assert all(len(r.tokens) == r.n_tokens for r in rows)
    assert encode_decode(clash.limit(0), BYTE).count() == 0


def test_frames():
    data = frame(b"abc") + frame(b"")
    read = lambda at, n: data[at : at + n]
    assert unframe(read, 0) == b"abc" and unframe(read, 19) == b""
    for i in range(len(data)):
        bad = data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :]
        with pytest.raises(ValueError):
            [unframe(lambda at, n: bad[at : at + n], at) for at in (0, 19)]
    assert masked(b"a") != zlib.crc32(b"a")


@pytest.mark.parametrize("seed", [None, 3])
def test_records(spark, make, odd, seed):
    texts = [*odd, *fuzz(60)]
    ids = [None, *range(len(texts) - 2, -1, -1)]
    folder = f"{shared_folder(spark)}/records-test-{seed}"
    manifest = write_records(make(texts, ids).repartition(3), folder, WORD)
    rows = sorted(read_records(spark, folder, manifest, seed).collect(), key=lambda r: r.start)
    own, at = library(WORD), 0
    order = sorted(zip(ids, texts, strict=True), key=lambda x: -1 if x[0] is None else x[0])
    for r, (i, text) in zip(rows, order, strict=True):
        want = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(want)) and np.frombuffer(r.ids, "<u4").tolist() == want
        at += len(want)


def test_records_of_odd_rows(spark, clash, odd):
    """Repeated and null ids, repeated texts and columns of the names used here: every row has its record."""
    folder = f"{shared_folder(spark)}/records-odd"
    rows = sorted(read_records(spark, folder, write_records(clash.unionByName(clash.where("doc_id is null")), folder, WORD)).collect(), key=lambda r: r.start)
    own = library(WORD)
    want = sorted((-1 if i is None else i, [*own.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in zip([*range(len(odd) - 2), 4, None, None], [*odd, odd[-1]], strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == want
    assert [r.doc_id is None for r in rows] == [True, True] + [False] * (len(rows) - 2)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()


def test_no_records(spark, make):
    folder = f"{shared_folder(spark)}/records-none"
    assert read_records(spark, folder, write_records(make([]), folder, WORD)).count() == 0
