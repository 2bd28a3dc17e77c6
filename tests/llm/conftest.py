"""Small tables with every awkward row: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, held_out boolean, label string"


@pytest.fixture
def docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 9.0, 7, None, "x") for i, t in rows], DOCS)

    return make


@pytest.fixture
def awkward():
    return [(1, "alpha beta gamma"), (2, None), (3, ""), (4, "\n\n"), (5, "word " * 30_000), (6, "alpha beta gamma"), (6, "alpha beta gamma"), (None, "nobody's row"), (-7, "é ß 漢字 🙂\tx")]
