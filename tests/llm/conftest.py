"""Odd tables that every operator must take, and brute-force helpers."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, size string, key string, bucket int, digest string, spans string, target int, kept boolean, label int, component_id long, found string"
PROSE = "The quick fox jumps over the lazy dog near the river bank while birds sing songs in the tall green trees above."


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, copies, and columns whose names the operators use themselves."""
    long = " ".join(f"word{i % 977} of{i}" for i in range(40_000)) + ".\nmail a.b@c.de now"
    texts = [
        (1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, PROSE, "en", "b"), (3, "", "en", "a"), (4, None, None, None), (None, PROSE + " more", "en", None), (None, None, None, None),
        (5, long, "en", "a"), (6, "x", "de", "b"), (7, " \n\t ", "de", "b"), (8, "Zoë’s 日本語 text 𝒳 here\nnaïve", "fr", "c"), (9, PROSE.upper() + "!!", "en", "c"), (10, "a " * 300, "en", "c"),
    ]
    rows = [(*t, None if t[1] is None else len(t[1]), 1.0, 1, "s", "k", 1, "d", "p", 1, True, 1, 1, "f") for t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (9, 0, 1), (2, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def collected(df):
    return [tuple(r) for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=repr)
