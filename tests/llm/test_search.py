"""Ranked search, language identification and hard negatives against brute force."""

import os
import re
import zlib
from collections import Counter
from math import floor, log

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cuewright.llm import hard_negatives, language_id, ranked_search
from cuewright.llm.words import slices
from tests.llm.conftest import SCHEMA, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def against_sql(spark, sf, name):
    df, con = __spark_entry__.queries()[name](spark, sf), duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert df.columns == names
    want = sorted(found.fetchall())
    assert want and sorted(map(tuple, df.collect())) == want


@pytest.mark.parametrize("name", ["op11_shared_term_sets", "op13_cover_tree"])
def test_registered_against_sql(spark, sf, name):
    against_sql(spark, sf.replace("sf0.001", "sf0.01"), name)


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranking(docs, items, keep):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    live = [c for _, c in counts if c]
    n_docs, n_terms = len(live), sum(c.total() for c in live)
    df = Counter(t for c in live for t in c)
    sets = {}
    for i, t in items:
        sets.setdefault(i, set()).update(terms(t))
    out = []
    for item, want in sets.items():
        scored = []
        for i, c in counts:
            m = c and 100 - 50 + 50 * c.total() * n_docs // n_terms
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in want if c[t])
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:keep], 1)]
    return sorted(out, key=repr)


def test_shared_sets():
    """Each item is the union of its sets, and what is shared is summed once."""
    rng = np.random.default_rng(3)
    for n_items, n_terms, held in ((1, 5, 5), (30, 40, 12), (200, 60, 20), (50, 2000, 30)):
        sets = [np.sort(rng.choice(n_terms, rng.integers(1, held + 1), replace=False, p=(w := 1 / np.arange(1, n_terms + 1)) / w.sum())) for _ in range(n_items)]
        item, flat = np.repeat(np.arange(n_items), [len(s) for s in sets]), np.concatenate(sets)
        names, term = np.unique(flat, return_inverse=True)
        got = ranked_search.shared_sets(item, term)
        parts = [set() for _ in range(got["atoms"])]
        for t, a in enumerate(got["atom"]):
            parts[a].add(int(names[t]))
        for a, b in zip(got["left"], got["right"], strict=True):
            assert not parts[a] & parts[b]
            parts.append(parts[a] | parts[b])
        ends = [*got["starts"][1:], len(got["sets"])]
        for s, a, b in zip(sets, got["starts"], ends, strict=True):
            own = [parts[k] for k in got["sets"][a:b]]
            assert set().union(*own) == set(s.tolist()) and sum(map(len, own)) == len(s)
        assert len(got["sets"]) + len(got["left"]) <= len(flat)
    assert ranked_search.shared_sets(np.zeros(0, int), np.zeros(0, int))["sets"] == []


@pytest.mark.parametrize("entries", [200_000, 20])
def test_ranked_oddities(spark, clash, odd, monkeypatch, entries):
    """Null, empty, long, repeated and equal texts, repeated and null ids, items without terms, one block and many."""
    monkeypatch.setattr(ranked_search, "ENTRIES", entries)
    rows = [(1, prose(30, 1)), (2, "Éa 漢字 X!"), (3, None), (4, ""), (5, "..."), (1, "Y" + "y" * 299_999), (None, "a b"), (6, prose(8, 2)), (7, prose(12, 2))]
    items = spark.createDataFrame(rows, "item_id bigint, text string").withColumn("score", F.lit(1)).withColumn("salt", F.lit(1))
    docs = [(r.doc_id, r.text) for r in clash.collect()]
    for keep in (2, 50):
        got = ranked_search.ranked(clash, items, keep)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == ranking(docs, rows, keep)
    assert ranked_search.ranked(clash.limit(0), items).count() == 0 == ranked_search.ranked(clash, items.limit(0)).count()


def test_terms_with_equal_hashes(monkeypatch):
    monkeypatch.setattr(ranked_search, "span_hashes", lambda low, starts, ends: ((ends - starts) % 2).astype(np.uint64))
    (_, data, offsets), = slices(pa.array(["ab", "cd", "abc", "xyz", "", "efgh", "q"]))
    found = ranked_search.Terms(["cd", "xyz", "ab", "zz", "q"]).find(data, offsets[:-1], offsets[1:])
    assert found.tolist() == [2, 0, -1, 1, -1, -1, 4]


# Language identification


def own_grams(text):
    known = [chr(c) for c in language_id.per_worker("alphabet", language_id.alphabet)[[ord(c) for c in text]]] if text else []
    x = " " + " ".join("".join(known).split()) + " "
    x = " " if x == "  " else x
    return {s: [x[i : i + s] for i in range(len(x) - s + 1)] for s in language_id.SIZES}


TEXTS = [("en", "the cat and the dog went over there"), ("en", "then they thought that this was the thing"), ("de", "der Hund und die Katze gehen über die Straße"), ("de", "ich weiß nicht, was die Leute dort machen"), ("fr", "le chat et le chien ne sont pas là où tu crois"), ("fr", "où est-ce que les enfants sont allés"), ("ja", "猫と犬が道を渡る"), ("ja", "これはペンです。")]


def test_language_by_sets(spark):
    """Without false positives the answer is that of plain sets: hits of each language's n-grams, most first."""
    rng = np.random.default_rng(2)
    teach = [(lang, text) for lang, text in TEXTS for _ in range(1 + (lang == "de"))]
    filter_ = language_id.learned(spark.createDataFrame(teach, "lang string, text string"))
    assert filter_.languages == ["de", "en", "fr", "ja"] and filter_.false.max() < 1e-9
    counts = {}
    for lang, text in teach:
        for size, found in own_grams(text).items():
            for g in found:
                counts.setdefault((size, g), Counter())[lang] += 1
    totals = Counter()
    for (size, _), c in counts.items():
        for lang, n in c.items():
            totals[size, lang] += n
    holders = {}
    for (size, g), c in counts.items():
        rates = {lang: n / totals[size, lang] for lang, n in c.items()}
        holders[size, g] = {lang for lang, r in rates.items() if r >= language_id.LEAST and r >= language_id.SHARE * max(rates.values())}
    words = " ".join(t for _, t in TEXTS).split()
    texts = [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(60)] + [t for _, t in TEXTS] + [None, "", "123 !?", "ß", "zzqq", "THE DOG", "è", "x" * 1000]
    rows = language_id.identified(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"), filter_).collect()
    for r in rows:
        text = texts[r.doc_id]
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        hits = Counter(lang for size, found in own_grams(text).items() for g in found for lang in holders.get((size, g), ()))
        best = max(filter_.languages, key=lambda x: hits[x])
        assert r.lang_pred == best and r.score == pytest.approx(hits[best] / max(hits.total(), 1))


def test_false_positives_are_taken_off(spark, monkeypatch):
    """A filter that is nearly full still finds the language, since its false answers are counted on."""
    monkeypatch.setattr(language_id, "SLOTS", 1 << 16)
    monkeypatch.setattr(language_id, "LEAST", 0.0)
    alike = lambda seed, alphabet: " ".join("".join(np.random.default_rng(seed).choice(list(alphabet), 6)) for _ in range(1))
    teach = [("many", " ".join(alike(i, "abcdefghijklmnopqrst") for i in range(9000))), ("few", " ".join(alike(i, "uvwxyz") for i in range(200)))]
    filter_ = language_id.learned(spark.createDataFrame(teach, "lang string, text string"))
    assert filter_.false[filter_.languages.index("many")] > 0.2
    docs = spark.createDataFrame([(0, " ".join(alike(i, "uvwxyz") for i in range(9000, 9040))), (1, " ".join(alike(i, "abcdefghijklmnopqrst") for i in range(40)))], "doc_id bigint, text string")
    assert [r.lang_pred for r in language_id.identified(docs, filter_).orderBy("doc_id").collect()] == ["few", "many"]


def test_many_languages(spark):
    """More languages than a byte, or a 64-bit word, has bits."""
    names = [f"l{i:03}" for i in range(70)]
    text = lambda i: prose(40, 500 + i) + f" {chr(0x4E00 + i) * 3}" * 40
    filter_ = language_id.learned(spark.createDataFrame([(n, text(i)) for i, n in enumerate(names)], "lang string, text string"))
    docs = spark.createDataFrame([(i, f"{chr(0x4E00 + i) * 3} " * 9) for i in range(70)], "doc_id bigint, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.identified(docs, filter_).collect()} == dict(enumerate(names))


def test_long_text_in_pieces():
    x = np.random.default_rng(1).integers(97, 103, 5000).astype(np.uint32)
    bounds = np.array([0, 0, 7, 7, 1500, 1501, 4990, 5000])
    for size in (2, 3, 4):
        h, row = language_id.grams(x, bounds, size)
        for step in (3, 64, 1000):
            got = list(language_id.pieces(x, bounds, size, step))
            assert np.concatenate([g[0] for g in got]).tolist() == h.tolist() and np.concatenate([g[1] for g in got]).tolist() == row.tolist()


def test_language_oddities(spark, clash, make):
    none = language_id.learned(make([]))
    assert {(r.lang_pred, r.score) for r in language_id.identified(clash.select("doc_id", "text"), none).collect()} == {("und", 0.0)}
    own = language_id.learned(clash.where("text is not null"))
    out = language_id.identified(clash, own)
    assert out.columns == [c for c in clash.columns if c not in ("text", "score")] + ["lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == clash.count() and {r.lang_pred for r in rows} == {"en", "und"} and {r.kept for r in rows} == {1}
    assert language_id.identified(make([]).select("doc_id", "text"), own).count() == 0


def test_language_query(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    rows = __spark_entry__.queries()["op12_language_bitmask"](spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.99 * len(held)


# Hard negatives


def mined(rows):
    good = sorted({(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(floor(256 * x) for x in v)) for i, label, v in rows if None not in (i, label, v) and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for a, al, av in (r for r in good if r[0] % 100 == 0):
        scored = sorted(((-sum(x * y for x, y in zip(av, v, strict=True)), i, label) for i, label, v in good if i != a and len(v) == len(av)), key=lambda r: r[:2])
        for ps, p, _ in [r for r in scored if r[2] == al][:5]:
            negatives = [(i, -s) for s, i, label in scored if label != al and 80 * -ps <= 100 * -s <= 100 * -ps][:5]
            out += [(a, p, k, i, -ps, s) for k, (i, s) in enumerate(negatives, 1)]
    return sorted(out)


VECTORS = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize("shard", [16_384, 40])
def test_hard_negatives(spark, monkeypatch, shard):
    """Copies and near copies in one group, negative products, vectors of all norms, odd rows; one shard and many cells."""
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((5, 6))
    vectors = np.float32(centres[rng.integers(0, 5, 700)] * rng.uniform(0.1, 2, (700, 1)) + 0.2 * rng.standard_normal((700, 6)))
    vectors[150:400] = vectors[150]
    rows = [(i, int(rng.integers(0, 10)), v.tolist()) for i, v in enumerate(vectors)]
    rows += [(700, 3, None), (None, 3, vectors[0].tolist()), (800, None, vectors[0].tolist()), (900, 3, [None] * 6), (901, 3, [float("nan")] * 6), (902, 4, [float("inf")] + [1.0] * 5), (1000, 3, [0.0] * 6), (1100, 2, []), (1101, 2, []), (1102, 5, []), (1200, 4, [1.0, 2.0]), (1201, 4, [1.0, 1.5]), (1202, 1, [1.0, 1.4]), (1300, 7, vectors[150].tolist()), (1300, 7, vectors[150].tolist())]
    table = spark.createDataFrame([(i, v, label) for i, label, v in rows], VECTORS).withColumns({c: F.lit(1) for c in ("qid", "parts", "dim", "cell")})
    got = hard_negatives.hard_negatives(table)
    assert sorted(map(tuple, got.collect())) == mined(rows)
    if shard > 40:
        assert hard_negatives.hard_negatives(table.limit(0)).count() == 0


def test_cover_tree_bounds():
    """Each node's radius covers its points, children part their parent's points, and the bounds hold."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.integers(-200, 200, (900, 8)), np.repeat(rng.integers(-200, 200, (1, 8)), 200, 0)])
    top = float((x.astype(float) ** 2).sum(1).max())
    t = hard_negatives.cover_tree(x, top)
    x = x[t["order"]]
    p, q = hard_negatives.augmented(x, top), rng.integers(-200, 200, (20, 8))
    assert sorted(t["order"]) == list(range(len(x)))
    for k in range(len(t["start"])):
        r = slice(t["start"][k], t["end"][k])
        assert np.linalg.norm(p[r] - p[t["centre"][k]], axis=1).max() <= t["radius"][k] + 1e-6
        ip = hard_negatives.products(q, x[r])
        least, most = hard_negatives.bounds(q @ x[t["centre"][k]].astype(float), (q.astype(float) ** 2).sum(1), np.float64(t["radius"][k]), top)
        assert (ip >= least[:, None]).all() and (ip <= most[:, None]).all()
        if n := t["children"][k]:
            c = range(t["child"][k], t["child"][k] + n)
            assert [t["start"][i] for i in c] == [r.start, *(t["end"][i] for i in c)][:-1] and t["end"][c[-1]] == r.stop
        else:
            assert r.stop - r.start <= hard_negatives.LEAF or t["radius"][k] == 0


def test_products_beyond_doubles():
    x = np.array([[2**40 + 1, 3]])
    assert hard_negatives.products(x, np.array([[2**20 + 1, 1]])).tolist() == [[(2**40 + 1) * (2**20 + 1) + 3]]
