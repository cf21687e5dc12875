import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.llm import components, near_text, near_vectors, words
from tests.llm.conftest import prose


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_components(spark):
    rng = np.random.default_rng(1)
    for n, m in ((40, 25), (300, 280), (200, 900)):
        links = [tuple(map(int, x)) for x in rng.integers(0, n, (m, 2))] + [(i, i + 1) for i in range(n, n + 30)] + [(5, 5)]
        got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
        nodes = {x for a, b in links if a != b for x in (a, b)}
        assert got == {k: v for k, v in roots(range(n + 40), links).items() if k in nodes}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_words_hash():
    import pyarrow as pa

    texts = ["The cat  sat", "the CAT\nsat", None, "", "x" * 500 + " y", "é É", "catsat the"]
    for _, data, offsets in words.slices(pa.array(texts)):
        h, at = words.word_hashes(data, offsets)
        own = [h[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
        assert [len(x) for x in own] == [3, 3, 0, 0, 2, 2, 2] and own[0] == own[1] and own[5][0] != own[5][1]
        assert [len(s) for s in words.shingle_sets(data, offsets)] == [1, 1, 0, 0, 1, 1, 1]


def corpus():
    rng, out = np.random.default_rng(5), []
    for g in range(6):
        base = prose(120, 50 + g).split()
        for k in range(25):
            w = list(base)
            for i in rng.integers(0, len(w), k // 4):
                w[i] = prose(1, 1000 * g + 7 * k + int(i))
            out.append(" ".join(w))
    return out + [prose(3, 1), prose(3, 1).upper(), prose(3, 2), "", None, " ", out[3], out[3].upper(), prose(4, 9)]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_text(make, percent):
    texts = corpus()
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = roots(range(len(texts)), links)
    rows = near_text.near_components(make(texts), percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (len(s), want[i], want[i] == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize("percent", [85, 80])
@pytest.mark.parametrize("small", [3, 48])
def test_large_group(make, monkeypatch, percent, small):
    """Many texts with edits of one base: most are linked to few or none, and edits repeat."""
    monkeypatch.setattr(near_text, "SMALL", small)
    rng, base, texts = np.random.default_rng(8), prose(110, 5).split(), []
    for _ in range(260):
        w = list(base)
        for _ in range(rng.integers(0, 7)):
            i = int(rng.integers(0, 30)) * 3
            w[i : i + 1] = [[], [w[i], w[i]], ["new"], [prose(1, int(rng.integers(0, 9999)))]][rng.integers(0, 4)]
        texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    want = roots(range(len(texts)), [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])])
    assert 20 < len(set(want.values())) < 230
    rows = near_text.near_components(make(texts), percent).collect()
    assert {r.doc_id: r.component_id for r in rows} == want


def test_estimate():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    a, b = x[:700], x[100:800]
    low = near_text.minima([a, b])
    pa_, pb = near_text.packed(low)
    words_ = near_text.PLANES // near_text.BITS
    differ = sum(int(np.bitwise_count((np.bitwise_or.reduce([pa_[k * words_ + w] ^ pb[k * words_ + w] for k in range(near_text.BITS)])).view(np.uint64))) for w in range(words_))
    assert (1 - differ / near_text.HASHES - 0.25) / 0.75 == pytest.approx(600 / 800, abs=0.2)
    assert near_text.slack(0.85) < 0.7


def test_keep_one(make, clash, odd):
    texts = corpus()
    kept = near_text.keep_one(make(texts), 80)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in near_text.near_components(make(texts), 80).where("kept").collect()}
    out = near_text.keep_one(clash)
    assert out.columns == clash.columns
    assert sorted(len(r.text or "") for r in out.collect()) == sorted(len(t or "") for t in [odd[0], *odd[1:5], *odd[6:10]])
    assert near_text.keep_one(clash.limit(0)).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def test_near_vectors(spark):
    rng, rows = np.random.default_rng(4), []
    for i in range(900):
        v = rng.standard_normal(24)
        if i % 3 and rows:
            v = np.array(rows[i // 30 * 3][1]) * rng.choice([1.0, 2.0]) + rng.normal(0, 0.05, 24)
        rows.append((i, [float(x) for x in np.float32(v)], int(i % 2)))
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1002, [0.0] * 24, 0), (1003, None, 0), (1004, [float("nan")] * 24, 0), (1005, rows[0][1], None), (1006, [1.0, 2.0], 0), (1007, [2.0, 4.0], 0), (1008, [None, 1.0], 0), (1009, [float("inf"), 1.0], 0), (1010, [], 0)]
    links = []
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for k, (i, v, lab) in enumerate(good):
        for j, w, other in good[:k]:
            if lab == other and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links.append((i, j))
    want = roots([r[0] for r in rows], links)
    degree = {r[0]: 0 for r in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    got = {r.vec_id: r for r in near_vectors.near_vectors(vectors(spark, rows).withColumn("node", F.lit(1))).collect()}
    assert set(got) == set(want)
    found = sum(r.n_links for r in got.values()) / sum(degree.values())
    assert found >= 0.98 and all(got[i].n_links <= degree[i] for i in degree)
    assert np.mean([got[i].component_id == want[i] and got[i].kept == (want[i] == i) for i in want]) >= 0.98


def test_planted_vectors(spark):
    """Pairs planted at cosines just over the threshold, long vectors, null and repeated ids."""
    rng, rows = np.random.default_rng(12), []
    for i in range(300):
        a, b = rng.standard_normal(300), rng.standard_normal(300)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        c = rng.uniform(0.931, 0.95)
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (c * a + (1 - c * c) ** 0.5 * b / np.linalg.norm(b)).tolist(), 1)]
    got = near_vectors.near_vectors(vectors(spark, rows)).collect()
    assert sum(r.n_links for r in got) >= 0.97 * 600 and all(r.n_links <= 1 for r in got)
    assert all(r.component_id == r.vec_id // 2 * 2 for r in got if r.n_links)
    odd = near_vectors.near_vectors(vectors(spark, [(None, [1.0, 2.0], 1), (7, [1.0, 2.0], 1), (7, [1.0, 2.0], 1), (None, [3.0, -1.0], 1), (9, [2.0, 4.0], 2)])).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in odd) == [(-1, 0, -1, True), (-1, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (9, 0, 9, True)]


def test_vector_blocks(spark, monkeypatch):
    """A group larger than a block is dealt out in pairs of blocks with the same result."""
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    rng = np.random.default_rng(6)
    base = rng.standard_normal(16)
    rows = [(i, [float(x) for x in base + rng.normal(0, 0.01, 16)], 1) for i in range(100)]
    got = near_vectors.near_vectors(vectors(spark, rows)).collect()
    assert all(r.n_links == 99 and r.component_id == 0 for r in got)
    assert near_vectors.near_vectors(vectors(spark, rows).limit(0)).count() == 0
    half, least = near_vectors.calibrated(0.93)
    assert 0 < least < near_vectors.COUNTED and near_vectors.recall(0.93) > 0.98


@pytest.mark.parametrize("block", [16, 2048])
def test_no_link_lost(spark, monkeypatch, block):
    """Chains whose smallest vectors meet only by larger ones, and pairs just over and under the threshold: all links, and
    components as by brute force."""
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    rng, rows = np.random.default_rng(21), []
    for i in range(400 if block > 16 else 40):
        a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        for turn in rng.permutation(4):  # each links with the next one only
            rows.append((len(rows), (np.cos(0.37 * turn) * a + np.sin(0.37 * turn) * b).tolist(), i % 3))
        if i % 2:
            c = rng.choice([0.9302, 0.9298])
            rows.append((len(rows), (c * a - (1 - c * c) ** 0.5 * b).tolist(), i % 3))
    rows += [(len(rows), [1e-200, 3e-200], 1), (len(rows) + 1, [1e-200, 3.1e-200], 1), (len(rows) + 2, [2e200, 1e200], 2), (len(rows) + 3, [2e200, 1.1e200], 2)]
    links = []
    for lab in range(3):
        own = [r for r in rows[:-4] if r[2] == lab]
        x = np.array([r[1] for r in own])
        i, j = np.nonzero(np.triu(x @ x.T / np.outer(*[np.linalg.norm(x, axis=1)] * 2) >= 0.93, 1))
        links += [(own[a][0], own[b][0]) for a, b in zip(i, j, strict=True)]
    n = len(rows)
    links += [(n - 4, n - 3), (n - 2, n - 1)]
    degree = np.bincount(np.ravel(links), minlength=n)
    want = roots(range(n), links)
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (degree[i], want[i], want[i] == i) for i in range(n)}


def test_count_is_a_bound():
    """No pair at the threshold, however its difference is spread over the lines, falls short of the count."""
    rng, half, least = np.random.default_rng(3), *near_vectors.calibrated(0.93)
    for k in range(1, near_vectors.COUNTED + 1):
        d = np.zeros((1, near_vectors.COUNTED))
        d[0, rng.permutation(near_vectors.COUNTED)[:k]] = (0.14 / k) ** 0.5
        assert near_vectors.collisions(np.zeros_like(d), d, half)[0, 0] >= least


def test_tasks_give_memory_back(spark):
    """A worker that has finished a task doesn't keep what the task's objects took."""
    from pathlib import Path

    from cuewright.llm.common import tidy

    def mb():
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10

    held = []

    def run(batches):
        held.extend(bytes(700) for _ in range(200_000))
        pin = bytes(700)  # the last one keeps the heap's end where it is
        del held[:-1]
        yield pin

    before = mb()
    assert len(list(tidy(run)([]))) == 1 and mb() - before < 40


def test_sets_are_taken_apart_in_parts(spark, make, monkeypatch):
    """Parts of batches give what whole batches give."""
    texts, want = corpus(), None
    for part in (10_000, 7):
        monkeypatch.setattr(near_text, "PART", part)
        got = sorted((r.doc_id, r.component_id) for r in near_text.near_components(make(texts)).collect())
        want = want or got
        assert got == want
