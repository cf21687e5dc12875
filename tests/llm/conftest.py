import numpy as np
import pytest

WORDS = "ba be bi bo bu da de di do du fa fe fi fo fu ga ge gi go gu la le li lo lu ma me mi mo mu na ne ni no nu".split()


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(WORDS[i] for i in rng.integers(0, len(WORDS), 3)) for _ in range(n))


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of texts, with ids from 0 or as given."""

    def build(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd():
    """Null, empty, blank, one-word, very long, non-Latin and repeated texts."""
    return [None, "", " \n\t ", "x", prose(60, 1), prose(60, 1), "é漢字 \U0001f44d" * 50, "y" * 300_000, prose(20_000, 2), "a\nb\n\nc", prose(60, 1)]


@pytest.fixture(scope="session")
def clash(make, odd):
    """Those texts with a repeated and a null id, and more columns of names that operators use themselves."""
    from pyspark.sql import functions as F

    ids = [*range(len(odd) - 2), 4, None]
    names = ["key", "node", "row", "score", "kept", "n_lines", "n_deleted", "line_row", "tie", "tokens", "text_hash", "bucket", "mix_rate", "scan", "quality_stats", "_id", "s"]
    return make(odd, ids).withColumns({n: F.lit(1) for n in names})


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
