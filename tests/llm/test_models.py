"""Quality and toxicity: parts against brute force, accuracy on held-out rows, awkward rows."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest

from shelfcast.llm import quality, toxicity

TABLES = "/root/testdata/sf0.1"


def test_marginals_equal_enumeration():
    random = np.random.default_rng(1)
    lengths = np.array([3, 0, 5, 1])
    emission, transitions = random.normal(size=9), random.normal(size=(2, 2))
    found = toxicity.marginals(emission, lengths, transitions)
    begin = 0
    for n in lengths:
        own, total, at = emission[begin : begin + n], 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(own[i] for i in range(n) if tags[i]) + sum(transitions[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            at += w * np.array(tags)
        assert np.allclose(found[begin : begin + n], at / total)
        begin += n


def test_isotonic_equals_definition():
    random = np.random.default_rng(2)
    counts = random.integers(1, 9, 40).astype(float)
    sums = np.round(counts * random.random(40))
    fit = quality.pooled(sums, counts)
    y = sums / counts
    # Min-max formula of isotonic regression.
    brute = [max(min((sums[i : k + 1].sum() / counts[i : k + 1].sum()) for k in range(j, 40)) for i in range(j + 1)) for j in range(40)]
    assert np.allclose(fit, brute) and len(y) == len(fit)


def table(spark, name):
    return spark.read.parquet(f"{TABLES}/{name}.parquet")


def auc(rows, label):
    pos = np.array([r["score"] for r in rows if r[label] == 1])
    neg = np.array([r["score"] for r in rows if r[label] == 0])
    return ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()).item()


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.98), (toxicity, "toxic", 0.95)])
def test_held_out_accuracy(spark, module, label, least):
    found = module.scored(table(spark, "documents"), table(spark, "labels"))
    rows = found.join(table(spark, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert auc([r for r in rows if r["held_out"]], label) > least


ODD = [(1, None), (2, ""), (3, " \n"), (None, "some text"), (4, "x" * 200_000), (4, "x" * 200_000), (5, "a b " * 50_000)]


@pytest.mark.parametrize("module", [quality, toxicity])
@pytest.mark.parametrize("labels", [[], [(3, 1, 1)], [(3, 1, 0), (3, 0, 1), (4, None, None), (None, 1, 1), (5, 0, 0), (7, 1, 1)]])
def test_awkward_rows(spark, documents, module, labels):
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = module.scored(documents(ODD), given).collect()
    assert len(rows) == len(ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["held_out"] is not None for r in rows)
    twice = [r["score"] for r in rows if r["doc_id"] == 4]
    assert twice[0] == twice[1]


def test_spans_are_offsets_in_the_text(spark, documents):
    # İ grows when lower-cased; offsets must stay those of the text.
    clean = [(i, f"İ plain words number {chr(97 + i % 26)} go here") for i in range(10, 200)]
    toxic = [(i, f"İ plain words Badword{'xyz'[i % 3]} go here {chr(97 + i % 26)}") for i in range(200, 300)]
    labels = spark.createDataFrame([(i, 1, int(i >= 200)) for i, _ in clean + toxic], "doc_id long, quality int, toxic int")
    rows = toxicity.scored(documents(clean + toxic), labels).collect()
    texts = dict(clean + toxic)
    spans = {texts[r["doc_id"]][s:e] for r in rows for s, e in zip(r["starts"], r["ends"])}
    assert spans == {"Badwordx", "Badwordy", "Badwordz"}
    assert {r["doc_id"] >= 200 for r in rows if r["predicted"] == 1} == {True}
    assert sum(r["predicted"] for r in rows) == 100


def test_quality_keeps_whole_rows(spark, documents):
    docs = documents([(i, "Good plain prose, with words." if i % 4 else "##% $$$ @@@ %%% ^^^") for i in range(200)])
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    out = quality.kept(docs, labels)
    assert out.columns == docs.columns
    assert {r["doc_id"] % 4 > 0 for r in out.collect()} == {True} and out.count() == 150
