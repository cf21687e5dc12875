from pathlib import Path

import pytest

pytest.importorskip("corpus_pipeline")


def test_stages(spark, clash, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "mixing", "BPE encoding"]
    docs = clash
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == clash.columns
    assert {"doc_id", "tokens", "n_tokens"} <= set(corpus_pipeline.STAGES[-1][1](spark, docs, sf).columns)


def test_run(spark, sf):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(len(r.tokens) == r.n_tokens for r in rows)
    assert len({r.ids_sha256 for r in rows}) >= 0.9 * len(rows)


def test_empty_tables(spark, sf, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_by_brute_force(spark, sf, make):
    """Quality, line and near dedup against brute force, mixing against its rates, encoding against the library."""
    import hashlib

    import corpus_pipeline
    from cuewright.llm import soft_mixing
    from cuewright.llm.common import table
    from tests.llm.conftest import prose
    from tests.llm.test_filters import naive_lines, naive_stats
    from tests.llm.test_near import roots, shingles
    from tests.llm.test_tokens import BYTE, library

    share = "\n".join([prose(40, 901), prose(30, 902)])
    texts = [prose(90, k) + ("\n" + share if k % 5 == 0 else "") for k in range(40)]
    texts += [texts[1], texts[2].replace("ba", "bb", 1), "too few words", "a b c " * 60, None]
    docs = make(texts)
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, sf)
    kept = {r.doc_id for r in good.collect()}
    assert kept == {k for k, t in enumerate(texts) for n, *_, again in [naive_stats(t)] if n >= 50 and 100 * again <= 50 * n}
    live = sorted(kept)
    dead = naive_lines([texts[k] for k in live])
    left = {k: "\n".join(x for j, x in enumerate(texts[k].split("\n")) if (i, j) not in dead) for i, k in enumerate(live)}
    left = {k: t for k, t in left.items() if t}
    lines = stages["line dedup"](spark, good, sf)
    assert {r.doc_id: r.text for r in lines.collect()} == left
    sets = {k: shingles(t) for k, t in left.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    near = stages["MinHash near-dedup"](spark, lines, sf)
    assert {r.doc_id for r in near.collect()} == {k for k, r in roots(list(sets), links).items() if k == r}
    out, _, rate, copies = soft_mixing.mixed(near, table(spark, sf, "labels"))
    want = {r.doc_id: r[copies] for r in out.collect() if abs(r[rate] - r[copies]) < 1 or pytest.fail(f"{r[rate]} became {r[copies]}")}
    mixed = stages["mixing"](spark, near, sf)
    got = [r.doc_id for r in mixed.collect()]
    assert {k: n for k, n in want.items() if n} == {k: got.count(k) for k in set(got)}
    own = library(BYTE)
    for r in stages["BPE encoding"](spark, near, sf).collect():
        ids = own.encode(left[r.doc_id], add_special_tokens=False).ids
        assert r.tokens == ids and r.decoded_sha256 == hashlib.sha256(left[r.doc_id].encode()).hexdigest()


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
    assert set(__spark_entry__.oracle_sql()) <= names
    assert "cuewright.llm" not in "".join(p.read_text() for p in Path(__import__("cuewright").__file__).parent.rglob("*.py") if "llm" not in p.parts)
