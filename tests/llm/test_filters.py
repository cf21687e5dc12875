import re
import textwrap
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.llm import fertility, kneser_ney, licences, line_runs, private_spans, soft_mixing
from cuewright.llm.common import TOKENIZERS
from tests.llm.conftest import prose

PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"


def naive_stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if tri[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(n - 1 for n in Counter(lines).values()), len(hit)


def test_stats(clash, odd, make):
    texts = [*odd, "a b c a b c a b", "x\nx\n \nx", "#*$%&|<> \x0b\x1c \x85", prose(30, 3) + " " + prose(30, 3)]
    rows = make(texts).select("doc_id", fertility.stats(F.col("text"), PIECES).alias("s")).orderBy("doc_id").select("s.*").collect()
    assert [tuple(r)[:5] for r in rows] == [naive_stats(t) for t in texts]
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for t, r in zip(texts, rows, strict=True):
        ids = [i for w in re.findall(r"[^\x20\x09-\x0D]+", t or "") for i in own.encode(w)]
        assert r.n_tokens == len(ids)
        if ids:
            assert r.byte_share == pytest.approx(np.mean([own.is_byte(i) for i in ids]))
            p = np.array(list(Counter(ids).values())) / len(ids)
            assert r.token_entropy == pytest.approx(-(p * np.log2(p)).sum())


def test_keep_good(make, clash):
    good = [prose(80, k) for k in range(40)]
    junk = ["q9 x7 " * 3 + " ".join(f"\U0001f44d{k}漢{j}ఝ" for j in range(70)) for k in range(3)]
    docs = make([*good, *junk, "few words", "a b c " * 60])
    kept = {r.doc_id for r in fertility.keep_good(docs).collect()}
    assert kept == set(range(40))
    out = fertility.keep_good(clash)
    assert out.columns == clash.columns
    assert fertility.keep_good(clash.limit(0)).count() == 0
    assert fertility.keep_good(docs.drop("lang")).count() == 40


def test_bands_have_no_step(spark):
    """A language's band moves from that of all to its own bit by bit."""
    got = []
    for n in (1, 19, 20, 2000):
        rows = [("a", (60, 0, 4.0, 0.0, 7.0))] * 4000 + [("b", (60, 0, 2.0, 0.8, 5.0))] * n
        measured = spark.createDataFrame(rows, "lang string, s struct<n_words:long,n_repeat_words:long,chars_per_token:double,byte_share:double,token_entropy:double>")
        r = fertility.bands(measured, "s", "lang").where("lang = 'b'").first()
        got.append((r.byte_share_low + r.byte_share_high) / 2)
    assert got == pytest.approx([0.8 / 21, 0.8 * 19 / 39, 0.4, 0.8 * 2000 / 2020])


def test_licences(make):
    texts = [t for own in licences.TEMPLATES.values() for t in own] + licences.OTHERS + [None, "", "foo\n\nLicensed under the Apache License, Version 2.0. bar"]
    names = [c for c, own in licences.TEMPLATES.items() for _ in own] + ["unknown"] * len(licences.OTHERS) + [None, None, "apache-2.0"]
    rows = licences.scanned(make(texts), "scan").orderBy("doc_id").collect()
    for r, want in zip(rows, names, strict=True):
        assert [x.family for x in r.scan or []] in ([want], []) if want == "unknown" else [x.family for x in r.scan or []] == ([want] if want else [])
    assert rows[-1].scan[0].paragraph == 1 and rows[-3].scan is None


def test_wrapped_licences(make):
    """Notices wrapped at any width are found as one; notices of neighbouring lines stay apart."""
    gpl, bsd = licences.TEMPLATES["gpl"][1], licences.TEMPLATES["bsd"][0]
    texts = [textwrap.fill(t, w) for t in (gpl, bsd) for w in (72, 40, 16)]
    texts += [f"{prose(9, 1)}\n{textwrap.fill(gpl, 60)}\n{prose(300, 2)}\n\n{prose(5, 3)}", "Released under the MIT License.\nLicensed under CC BY 4.0.", "All\nrights\nreserved. Copyright."]
    rows = licences.scanned(make(texts), "scan").orderBy("doc_id").collect()
    assert [[x.family for x in r.scan] for r in rows] == [["gpl"]] * 3 + [["bsd"]] * 3 + [["gpl"], ["mit", "cc-by"], ["reserved"]]


def test_licence_scores_by_hand(make):
    weights, bias, _ = licences.trained()
    text = "Released under the MIT License. Some other words of no note"
    r = licences.scanned(make([text]), "scan").first().scan[0]
    at = [licences.VOCABULARY.index(g) for g in licences.grams_of(text) if g in licences.VOCABULARY]
    z = bias + weights[:, at].sum(1)
    assert r.probability == pytest.approx(np.exp(z - z.max()).max() / np.exp(z - z.max()).sum(), abs=1e-6)
    x, y = licences.variants(9)
    assert ((x @ weights.T + bias).argmax(1) == y).mean() > 0.94


def naive_scan(text, model):
    """What the licence scan makes of a text, from its description: (paragraphs, anchored, notices)."""
    weights, bias, threshold = model
    place = {g: i for i, g in enumerate(licences.VOCABULARY)}
    own = [{c: [licences.grams_of(t) for t in ts] for c, ts in licences.TEMPLATES.items()}.get(c, []) for c in licences.CLASSES]
    tokens = lambda x: re.findall(licences.TOKEN, x.lower())
    holds = lambda x: any(a in x.lower() for a in licences.ANCHORS)

    def judge(x):
        grams = [g for g in licences.grams_of(x) if g in place]
        z = bias + weights[:, [place[g] for g in grams]].sum(1)
        k, sure = int(z.argmax()), round(float(1 / np.exp(z - z.max()).sum()), 6)
        family = licences.CLASSES[k]
        named = [t for t in own[k] if not set(licences.NAMES[family]) & set(t) - set(grams) and not (set(licences.OTHERWISE.get(family, [])) - set(t)) & set(grams)]
        overlap = max((len(set(grams) & set(t)) / len(t) for t in named), default=0.0)
        return (licences.CLASSES[k] if sure >= threshold and overlap >= licences.CONFIRM else "unknown"), sure, round(overlap, 6)

    parts = [p for p in re.split(r"\n[\x20\x09-\x0D]*\n", text or "") if re.search(r"[^\x20\x09-\x0D]", p)]
    anchored, notices = 0, []
    for p in parts:
        if not holds(re.sub(r"[\x20\x09-\x0D]+", " ", p)):
            continue
        lines, found = [x for x in p.split("\n") if tokens(x)], []
        for i in range(len(lines)):
            for j in range(i, min(i + licences.LONGEST + 2, len(lines))):
                if sum(len(tokens(x)) for x in lines[i + 1 : j]) < licences.LONGEST and holds(x := " ".join(lines[i : j + 1])):
                    found.append((i, j, *judge(x)))
        found.sort(key=lambda x: (x[2] == "unknown", -x[4], x[1] - x[0], x[0]))
        anchored += bool(found)
        taken = []
        for x in (x for x in found if x[2] != "unknown"):
            if all(x[1] < y[0] or x[0] > y[1] for y in taken):
                taken.append(x)
        notices += taken
    return len(parts), anchored, notices


def test_licence_query(spark, sf, tmp_path, make):
    """The registered query over a whole table, with repeated rows, extra columns, null and empty texts, against brute force."""
    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    notices = [textwrap.fill(t, w) for own in licences.TEMPLATES.values() for t in own for w in (200, 30)]
    texts = [*docs, *(f"{a[:300]}\n\n{b}\n{a[:60]}" for a, b in zip(docs, notices, strict=False)), *notices[:4], *notices[:4], None, "", " \n\n ", "y" * 300_000]
    make(texts).withColumn("scan", F.lit(1)).withColumn("paragraph", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    rows, model = licences.op1_licence_classifier(spark, str(tmp_path)).orderBy("doc_id").collect(), licences.trained()
    assert len(rows) == len(texts)
    for t, r in zip(texts, rows, strict=True):
        n, anchored, found = naive_scan(t, model)
        assert (r.n_paragraphs, r.n_anchored, r.n_licences, r.families) == (n, anchored, len(found), ",".join(sorted({x[2] for x in found})))
        assert r.probability == pytest.approx(max((x[3] for x in found), default=0), abs=2e-6)
    assert sum(r.n_licences for r in rows) > 60
    make([]).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert licences.op1_licence_classifier(spark, f"{tmp_path}/none").count() == 0


def test_fertility_query(spark, sf):
    """The registered query over a whole table against brute force: base columns, bands by language, verdicts."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in fertility.op2_tokeniser_fertility(spark, sf).collect()}
    assert rows.keys() == docs.keys()
    good, failed = {}, {}
    for k, d in docs.items():
        n, chars, symbols, dup, repeat = naive_stats(d.text)
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        failed[k] = n < 50 or 100 * repeat > 50 * n
        ids = [i for w in re.findall(r"[^\x20\x09-\x0D]+", d.text or "") for i in own.encode(w)]
        p = np.array(list(Counter(ids).values())) / max(len(ids), 1)
        good[k] = np.array([chars / max(len(ids), 1), np.mean([own.is_byte(i) for i in ids]) if ids else 0, -(p * np.log2(p)).sum()])
    quartiles = lambda ks: np.percentile(np.round([good[k] for k in ks], 3), [25, 50, 75], axis=0)
    every = quartiles([k for k in docs if not failed[k]])
    for k, d in docs.items():
        same = [j for j in docs if docs[j].lang == d.lang and not failed[j]]
        w = len(same) / (len(same) + 20)
        q = w * quartiles(same) + (1 - w) * every if same else every
        wide = lambda times: np.maximum.reduce([times * (q[2] - q[0]) / 2, fertility.LEAST_SHARE * q[1], list(fertility.LEAST.values())])  # noqa: B023, E731
        inside = (good[k] >= q[1] - wide(fertility.LOW)).all() and (good[k] <= q[1] + wide(fertility.HIGH)).all()
        assert (rows[k].base_failed, rows[k].kept) == (failed[k], inside and not failed[k])


def naive_lines(texts, least=50):
    """Windows of lines with words, by brute force: the lines that a later copy covers."""
    docs = [[x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)] for t in texts]
    count = lambda lines: sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines)
    seen, dead = set(), set()
    for i, lines in enumerate(docs):
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if count(lines[a:b]) >= least:
                    key = tuple(lines[a:b])
                    if key in seen:
                        dead |= {(i, k) for k in range(a, b)}
                    seen.add(key)
    return dead


def test_line_runs(make):
    p = [prose(n, k) for k, n in enumerate((12, 30, 55, 20, 8, 20, 20))]
    texts = ["\n".join(p[:5]), "\n".join([p[6], *p[1:4], "", "tail"]), "\n".join([p[5], p[5], p[5], p[5], p[5]]), p[2], "\n".join([p[3], p[4], p[5]]), "\n".join(p[:5]), "", "\n\n", "\n".join([p[3], p[4]] * 9)]
    dead = naive_lines(texts)
    out, n, gone = line_runs.without_copies(make(texts))
    rows = out.orderBy("doc_id").collect()
    for i, (t, r) in enumerate(zip(texts, rows, strict=True)):
        with_words, kept, k = 0, [], 0
        for x in t.split("\n"):
            if x.strip():
                if (i, k) not in dead:
                    kept.append(x)
                k += 1
            else:
                kept.append(x)
        assert r.text == "\n".join(kept) and r[n] == k and r[gone] == sum(a == i for a, _ in dead)
    stays = {r.doc_id for r in line_runs.keep_first_runs(make(texts)).collect()}
    assert {0, 6, 7} <= stays and 5 not in stays and 3 not in stays


def test_line_runs_oddities(clash, odd):
    out = line_runs.keep_first_runs(clash)
    assert out.columns == clash.columns
    rows = out.collect()
    assert sum((r.text or "").startswith(odd[4][:20]) for r in rows) == 1 and sum(r.text is None for r in rows) == 1
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert line_runs.keep_first_runs(clash.limit(0)).count() == 0


def test_line_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(tuple(r) for r in line_runs.op4_line_suffix_array(spark, sf).select("doc_id", "n_lines", "n_deleted", "text_sha256").collect())
    assert got == sorted(con.sql(f"SELECT doc_id, n_lines, n_deleted, text_sha256 FROM ({line_runs.ORACLE_SQL})").fetchall())


def naive_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and private_spans.luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans():
    rng = np.random.default_rng(1)
    letters = list("a@b.1+2 -3()4.5@c_9..0 %")
    for _ in range(3000):
        t = "".join(rng.choice(letters, rng.integers(0, 50)))
        assert private_spans.base_spans(t) == naive_spans(t)
    assert private_spans.base_spans("1" * 200_000 + "@" + "." * 1000) == []


def test_private_spans(make, clash, odd):
    texts = ["mail a.b@c.org now", "password=b7db7aa4a5fcc78305 x", "ip 10.0.0.1 and 999.1.1.1", "call +1 (521) 555-2373 in", "card 4111 1111 1111 1111", "plain words only", None, ""]
    rows = private_spans.private_spans(make(texts)).orderBy("doc_id").collect()
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_added) for r in rows] == [(1, 0, 0, 0, 0), (0, 0, 0, 0, 1), (0, 1, 0, 0, 0), (0, 0, 0, 1, 0), (0, 0, 1, 0, 0), (0,) * 5, (0,) * 5, (0,) * 5]
    assert rows[0].spans == "email:5:14" and rows[1].spans == "secret:0:27"
    assert private_spans.private_spans(clash).count() == len(odd)
    x, y = private_spans.examples(800, 5)
    trees, limits = private_spans.trained()
    assert ((trees.chance(x) > 0.5) == y).mean() > 0.97


def test_private_query(spark, sf, tmp_path, make, odd):
    """The registered query's columns against brute force, where kinds start together too; an empty table."""
    from hashlib import sha256

    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts = [*docs, *odd, "4111111111111111@x.com 10.0.0.1@b.c +14155552671@d.e", "1.2.3.4.5@a.b 4111 1111 1111 1111"]
    make(texts).withColumn("p", F.lit(1)).withColumn("spans", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = private_spans.op3_candidate_boosting(spark, str(tmp_path)).orderBy("doc_id").collect()
    added = private_spans.found([t or "" for t in texts], *private_spans.trained())
    generators = list(private_spans.GENERATORS)
    for t, r, (_, more) in zip(texts, rows, added, strict=True):
        base = naive_spans(t)
        shown = [f"{private_spans.BASE[k]}:{a}:{b}" for a, k, b in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert r.base_sha256 == sha256(",".join(shown).encode()).hexdigest() and r.n_added == len(more)
        both = sorted([(a, k, b, private_spans.BASE[k]) for a, k, b in base] + [(a, 4 + generators.index(k), b, k) for a, k, b in more])
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k in both)
    assert rows[-2].spans.startswith("email:0:22,card:0:16")
    make([]).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert private_spans.op3_candidate_boosting(spark, f"{tmp_path}/none").count() == 0


def test_long_private_spans():
    """Values and names of any length are taken whole."""
    rng = np.random.default_rng(7)
    run = lambda of, n: "".join(of[i] for i in rng.integers(0, len(of), n))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    spans = [f"token=eyJ{run(mixed, 700)}", f"AZURE_STORAGE_CONNECTION_STRING={run(mixed, 80)}", run("0123456789abcdef", 300), "A7" + run(mixed[:26] + mixed[52:], 120), "Gh0" + run(mixed, 300)]
    trees, limits = private_spans.trained()
    for s, (base, added) in zip(spans, private_spans.found([f"the token {s} here" for s in spans], trees, limits), strict=True):
        assert not base and (10, 10 + len(s)) in [(a, b) for a, _, b in added]
    number = "4" + run("0123456789", 39)
    assert (5, 45, list(private_spans.GENERATORS).index("number")) in private_spans.candidates(f"card {number} x")
    for t in ("y" * 300_000, "aA1" * 100_000, "7" * 300_000 + "g", "a=" * 100_000, "A_" * 150_000):
        private_spans.found([t], trees, limits)


def test_kneser_ney(spark, make):
    rng, docs, marks = np.random.default_rng(2), [], []
    for i in range(400):
        bad = i % 4 == 0
        words = prose(60, 100 + i).split()
        if bad:
            for k in rng.integers(0, 60, 4):
                words[k] = ["vile", "scumbag", "rotter"][rng.integers(3)]
        docs.append(" ".join(words))
        marks.append((i, 1, int(bad)))
    table = make([*docs, None, ""])
    lab = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    rows = kneser_ney.scored(table, kneser_ney.train(table, lab)).collect()
    assert len(rows) == 402 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0 and r.doc_id < 400) for r in held]) > 0.95
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_kneser_ney_oddities(clash, labels, odd):
    for lab in (labels, labels.limit(0), labels.where("toxic = 1")):
        model = kneser_ney.train(clash, lab)
        rows = kneser_ney.scored(clash, model).collect()
        assert len(rows) == len(odd) and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
        assert len({r.score for r, t in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id)), odd, strict=True) if not (t or "").strip()}) == 1
    assert kneser_ney.scored(clash.limit(0), model).count() == 0
    assert kneser_ney.scored(clash, kneser_ney.train(clash.limit(0), labels)).count() == len(odd)


def naive_model(texts, marks, order):
    """Plain interpolated Kneser-Ney over tuples of symbols, from the definition: probabilities and ratios of words."""
    top = [Counter(), Counter()]
    for t, y in zip(texts, marks, strict=True):
        for w in set(re.findall(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower().encode())):
            x = ["^"] * (order - 1) + list(w) + ["$"]
            top[y].update(tuple(x[i - order + 1 : i + 1]) for i in range(order - 1, len(x)))
    levels = {order - 1: Counter(g[1:] for g in top[0] | top[1])}
    for n in range(order - 2, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def discounted(count, h, x, lower):
        own = {g: n for g, n in count.items() if g[:-1] == h}
        total = sum(own.values())
        return (max(own.get((*h, x), 0) - 0.75, 0) + 0.75 * len(own) * lower) / total if total else lower

    def low(h, x):
        return discounted(levels[len(h) + 1], h, x, low(h[1:], x) if h else 1 / 257)

    chance = lambda y, h, x: discounted(top[y], h, x, low(h[1:], x))

    def ratio(w):
        x = ["^"] * (order - 1) + list(w.encode()) + ["$"]
        return np.clip(sum(np.log(chance(1, h, z) / chance(0, h, z)) for i in range(order - 1, len(x)) for h, z in [(tuple(x[i - order + 1 : i]), x[i])]), -7, 7)

    return top, chance, ratio


@pytest.mark.parametrize("most", [0, kneser_ney.BROADCAST_GRAMS])
def test_kneser_ney_by_definition(spark, make, monkeypatch, most):
    """Counts, ratios and measures equal those of the definition, broadcast or joined, however texts fall into chunks; the
    probabilities of all symbols after a context sum to one."""
    import zlib

    monkeypatch.setattr(kneser_ney, "CHUNK", 500)
    order, texts = 3, [" ".join(prose(5, k % 17).split()) + f" Foul{k % 5} \u00e9t\u00e9" * (k % 3 == 0) for k in range(40)]
    docs = make([*texts, "unseen \u6f22 x", None, ""])
    lab = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(40)], "doc_id bigint, quality int, toxic int")
    used = [k for k in range(40) if zlib.crc32(str(k).encode()) % 4 != 2]
    top, chance, ratio = naive_model([texts[k] for k in used], [int(k % 3 == 0) for k in used], order)
    code = lambda x: {"^": kneser_ney.START, "$": kneser_ney.END}.get(x) or x + 1
    key = lambda g: sum(code(x) << kneser_ney.BITS * i for i, x in enumerate(g[::-1]))
    counts = kneser_ney.counted(kneser_ney.labelled(docs, lab), order)
    assert {r.key: (r.toxic, r.ordinary) for r in counts.collect()} == {key(g): (top[1][g], top[0][g]) for g in top[0] | top[1]}
    rows = {r.key: (r.p_ordinary, r.p_toxic) for r in kneser_ney.probabilities(counts, False, order).collect()}
    for g in top[0] | top[1]:
        assert rows[key(g)] == pytest.approx([chance(y, g[:-1], g[-1]) for y in (0, 1)])
    for h in [("^", "^"), ("^", ord("f")), (ord("a"), ord("b")), (1, 2)]:
        for y in (0, 1):
            assert sum(chance(y, h, x) for x in [*range(256), "$"]) == pytest.approx(1)
    got = {r.doc_id: r.measures for r in kneser_ney.measured(docs.select("doc_id", "text"), kneser_ney.train(docs, lab, order), most).collect()}
    assert len(got) == 43 and got[41] == got[42] == [0] * kneser_ney.MEASURES
    for k, t in enumerate([*texts, "unseen \u6f22 x"]):
        r = np.array([ratio(w) for w in t.lower().split()])
        threes = [r[i : i + 3].mean() for i in range(max(1, len(r) - 2))]
        assert got[k][:3] == pytest.approx([r.mean(), r.max(), max(threes)], abs=1e-4)
        assert got[k][-1] == pytest.approx(np.maximum(r - 2, 0).sum() / len(r) ** 0.5, abs=1e-4)


def test_kneser_ney_plan(spark):
    """One exchange serves all lengths of grams: the driver's memory goes with the plan. Back-offs over all lengths equal
    those of the definition."""
    rng = np.random.default_rng(4)
    grams = {tuple(rng.choice([kneser_ney.START, 98, 99, 256, kneser_ney.END], kneser_ney.ORDER).tolist()) for _ in range(500)}
    key = lambda g: sum(int(x) << kneser_ney.BITS * i for i, x in enumerate(g[::-1]))
    counts = spark.createDataFrame([(key(g), i % 3, 1, 0, i % 2) for i, g in enumerate(sorted(grams))], "key long, toxic long, ordinary long, toxic_part long, ordinary_part long")
    exchanges = {n: kneser_ney.probabilities(counts, True, n)._jdf.queryExecution().executedPlan().toString().count("Exchange ") for n in (3, 6)}
    assert exchanges[3] == exchanges[6] <= 10
    levels = {kneser_ney.ORDER - 1: Counter(g[1:] for g in grams)}
    for n in range(kneser_ney.ORDER - 2, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def low(g):
        if not g:
            return 1 / 257
        own = [n for x, n in levels[len(g)].items() if x[:-1] == g[:-1]]
        return (levels[len(g)][g] - 0.75 + 0.75 * len(own) * low(g[1:])) / sum(own)

    got = {r.gram: r.p for r in kneser_ney.backed_off(counts.select("key")).collect()}
    assert len(got) == len(grams) and all(got[key(g)] == pytest.approx(low(g[1:]), rel=1e-12) for g in grams)


def test_mixing(spark, make):
    good, bad = [prose(60, k) for k in range(60)], [" ".join(["@@ $$ %%"] * 30 + prose(20, k).split()) for k in range(30)]
    docs = make([*good, *bad, None, ""])
    lab = spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id bigint, quality int, toxic int")
    out, s, rate, copies = soft_mixing.mixed(docs, lab)
    rows = out.orderBy("doc_id").collect()
    assert np.mean([r[copies] for r in rows[:60]]) >= 0.95 and all(r[rate] == 1 for r in rows[90:])
    reach = sum(r[rate] * r[s].n_tokens * r[s].p_poor for r in rows)
    has = sum(r[s].n_tokens * r[s].p_poor for r in rows)
    assert reach == pytest.approx(0.4 * has, rel=0.05)
    kept = soft_mixing.take_mixed(docs, lab)
    assert kept.columns == docs.columns and 0.15 * 30 <= kept.where("doc_id between 60 and 89").count() <= 0.65 * 30
    more = soft_mixing.take_mixed(docs, lab, {"good": 2.0}).groupBy("doc_id").count().where("doc_id < 60").collect()
    assert np.mean([r["count"] for r in more]) == pytest.approx(2, abs=0.3)


def test_mixing_soft(make, monkeypatch):
    """The final rates meet the targets for unsure memberships, and small changes of a target have effect."""
    rng = np.random.default_rng(3)
    n, p = rng.integers(1, 100, 200).astype(float), rng.dirichlet([0.3, 0.3, 0.3], 200)
    part = lambda t, i: F.element_at(F.split(t, " "), i + 1)
    monkeypatch.setattr(soft_mixing, "learn", lambda docs, labels: None)
    monkeypatch.setattr(soft_mixing, "memberships", lambda t, model: F.struct(part(t, 0).cast("double").cast("long").alias("n_tokens"), *(part(t, i + 1).cast("double").alias(f"p_{d}") for i, d in enumerate(soft_mixing.DOMAINS))))
    docs = make([" ".join(map(str, [a, *b])) for a, b in zip(n.tolist(), p.tolist(), strict=True)])
    for goal in ((1.0, 0.6, 0.6), (1.0, 0.4, 0.1), (1.4, 1.0, 1.0)):
        out, _, rate, _ = soft_mixing.mixed(docs, None, dict(zip(soft_mixing.DOMAINS, goal, strict=True)))
        r = np.array([x[rate] for x in out.orderBy("doc_id").collect()])
        assert r @ (n[:, None] * p) / (n @ p) == pytest.approx(goal, rel=1e-3)


def test_mixing_reports_misses(make, labels):
    with pytest.warns(UserWarning, match="misses its targets"):
        soft_mixing.mixed(make([prose(30, k) for k in range(5)]), labels.limit(0))


def test_mixing_oddities(clash, labels, odd):
    for lab in (labels, labels.limit(0)):
        out = soft_mixing.take_mixed(clash, lab)
        assert out.columns == clash.columns and 1 <= out.count()
    assert soft_mixing.take_mixed(clash.limit(0), labels).count() == 0


def test_rates_against_projected_gradient(spark):
    """Rates equal those of many plain projected-gradient steps, where some are cut off at zero."""
    rng = np.random.default_rng(3)
    n, p = rng.integers(1, 100, 200).astype(float), rng.dirichlet([0.3, 0.3, 0.3], 200)
    targets = dict(zip(soft_mixing.DOMAINS, (1.0, 0.3, 0.05), strict=True))
    members = spark.createDataFrame([((int(a), *map(float, b)),) for a, b in zip(n, p, strict=True)], f"s struct<{soft_mixing.KINDS.replace(' long', ':long').replace(' double', ':double')}>")
    x = soft_mixing.fit_rates(members, "s", targets)
    goal, y = n @ p * list(targets.values()), np.zeros(3)
    for _ in range(20_000):
        r = np.maximum(0, 1 - p @ y)
        y += 0.5 * ((n * r) @ p - goal) / n.sum()
    assert np.maximum(0, 1 - p @ x) == pytest.approx(r, abs=1e-3)
    assert (r == 0).any() and (n * r) @ p == pytest.approx(goal, rel=1e-3)
