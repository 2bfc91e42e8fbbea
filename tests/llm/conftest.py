"""Helpers of the operator tests; the Spark session comes from the tests above."""

from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table with columns beside those the operators name."""

    def build(rows):
        full = [(i, t, "en", "src", None if t is None else len(t), "x", 7) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, content string, score int").repartition(3)

    return build


@pytest.fixture(scope="session")
def words():
    """n words of a small made-up language, by seed."""

    def build(n, seed, vocabulary=400):
        r = random.Random(seed)
        return [f"w{r.randrange(vocabulary)}" for _ in range(n)]

    return build
