import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocab=900):
    return [f"w{rng.randrange(vocab)}x" for _ in range(n)]


@pytest.fixture
def make(spark):
    def table(rows, schema=SCHEMA):
        rows = [(i, t, "en", "src0", None if t is None else len(t)) if schema == SCHEMA else r for r in rows for i, t in [r[:2]]]
        return spark.createDataFrame(rows, schema)

    return table


@pytest.fixture
def awkward():
    """(doc_id, text) rows: nulls, empty, blank, very long, repeated and ids that come twice."""
    rng = random.Random(5)
    long = " ".join(words(rng, 30_000))
    same = "ties and repeats " + " ".join(words(rng, 60))
    return [(1, None), (None, "no id here"), (None, None), (2, ""), (3, "  \n\t "), (4, long), (5, long + " end"), (6, same), (6, same), (7, same), (8, "é́ ﬁ İ ß 漢字 🙂  x")]
