from __future__ import annotations

import pytest


@pytest.fixture
def documents(spark):
    """Build a documents table with columns whose names clash with what the operators add."""

    def build(rows):
        return spark.createDataFrame(
            [(i, t, "en", "s", "clash", -1) for i, t in rows],
            "doc_id long, text string, lang string, source string, spans string, n_words int",
        )

    return build


EDGE_TEXTS = [None, "", " ", "\n\n", "a", "word " * 3, "é" * 50, "x" * 20_000, "tie", "tie"]


@pytest.fixture
def edge_rows():
    """Nulls, empty and long texts, ties and repeated rows, with a missing and a repeated id."""
    rows = [(i, t) for i, t in enumerate(EDGE_TEXTS)]
    return [*rows, (None, "no id"), (None, None), (8, "tie"), (3, "another text of row three")]
