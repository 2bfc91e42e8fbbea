"""Toxic spans by a linear-chain conditional random field with two tags.

1. A bounded sample of labelled documents (``SAMPLE`` of each class, smallest hash of the id
   first; each class is weighted back to its share) gives token labels: words and word
   beginnings that occur in toxic documents significantly more often than elsewhere (log
   likelihood ratio against chance over all candidates) mark the tokens of toxic documents.
2. The field is trained on a bounded sample of the marked token sequences (``SEQUENCES`` of
   ``CHUNK`` tokens) by gradient steps on forward-backward marginals.
3. Every whole text is tagged: forward-backward over all its tokens gives each token's
   marginal. A document's score is a logistic function of its expected number of toxic
   tokens and its largest marginal; tokens with a marginal of at least 0.5 are offending.

A token's features are the word and its beginnings, hashed; labels, language, source and id
are no features.

Defined results: null and empty texts have no tokens and get the score of such a document;
without labels of both classes every score is the toxic share (0.5 without any label); rows
whose id is null have no label and are not held out; of several labels of an id the largest
counts; repeated rows get repeated results. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import fold, hash64, stored, texts_of

TOKEN = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 18
BEGINNINGS = (4, 5, 6)
SAMPLE = 10_000
SEQUENCES = 6_000
CHUNK = 64
STEPS = 400
BATCH = 256
#: Words whose emission a Python worker keeps at hand.
CACHE = 400_000


def lowered(text: str) -> str:
    """Lower case, character by character where that would change the length: offsets stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(lowered(text)) if text else []


def features(word: str) -> list[str]:
    return ["w " + word, *(f"b{n} {word[:n]}" for n in BEGINNINGS if len(word) >= n)]


def buckets(word: str) -> list[int]:
    out = [hash64(f) % BUCKETS for f in features(word)]
    return out + [BUCKETS] * (1 + len(BEGINNINGS) - len(out))


@dataclass(frozen=True)
class Field:
    """Emission weights of tag 1 over tag 0 (one more bucket, always 0), bias, transitions [from, to]."""

    weights: np.ndarray
    bias: float
    transitions: np.ndarray

    def emission(self, word: str) -> float:
        return float(self.weights[buckets(word)].sum()) + self.bias


def marginals(emission: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward probabilities of tag 1 for sequences laid end to end.

    All sequences advance together, longest first, so the number of steps is the longest
    length and the work is the number of tokens. Messages are log odds of tag 1.
    """
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    # active[t]: number of sequences longer than t
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left") if longest else np.zeros(0, int)
    t00, t01, t10, t11 = transitions[0, 0], transitions[0, 1], transitions[1, 0], transitions[1, 1]
    forward, backward = np.zeros(len(emission)), np.zeros(len(emission))
    odds = np.zeros(len(sizes))
    for t in range(longest):
        n = active[t]
        at = begin[:n] + t
        o = odds[:n]
        if t:
            o = np.logaddexp(t01, t11 + o) - np.logaddexp(t00, t10 + o)
        odds[:n] = o + emission[at]
        forward[at] = odds[:n]
    odds = np.zeros(len(sizes))
    for t in range(longest - 2, -1, -1):
        n = active[t + 1]
        at = begin[:n] + t
        o = odds[:n] + emission[at + 1]
        odds[:n] = np.logaddexp(t10, t11 + o) - np.logaddexp(t00, t01 + o)
        backward[at] = odds[:n]
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-(forward + backward)))


def _pairs(marginal: np.ndarray, lengths: np.ndarray, emission: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Expected transition counts [from, to] of equally long sequences (rows), for the gradient."""
    n, size = len(lengths), int(lengths[0])
    m, e = marginal.reshape(n, size), emission.reshape(n, size)
    # With tags x, y of neighbours: P(x, y) from the forward and backward odds of the two.
    f = np.zeros((n, size))
    b = np.zeros((n, size))
    t00, t01, t10, t11 = transitions[0, 0], transitions[0, 1], transitions[1, 0], transitions[1, 1]
    f[:, 0] = e[:, 0]
    for t in range(1, size):
        f[:, t] = np.logaddexp(t01, t11 + f[:, t - 1]) - np.logaddexp(t00, t10 + f[:, t - 1]) + e[:, t]
    for t in range(size - 2, -1, -1):
        o = b[:, t + 1] + e[:, t + 1]
        b[:, t] = np.logaddexp(t10, t11 + o) - np.logaddexp(t00, t01 + o)
    after = (b + e)[:, 1:]
    before = f[:, :-1]
    scores = np.stack([np.full_like(after, t00), t01 + after, t10 + before, t11 + before + after])
    scores -= scores.max(axis=0)
    p = np.exp(scores)
    p /= p.sum(axis=0)
    return p.sum(axis=(1, 2)).reshape(2, 2)


def train_field(ids: np.ndarray, tags: np.ndarray, weight: np.ndarray, seed: int = 7) -> Field:
    """Maximum likelihood by Adam. ids: sequences x CHUNK x features; tags: sequences x CHUNK."""
    random = np.random.default_rng(seed)
    used, inverse = np.unique(ids, return_inverse=True)
    inverse = inverse.reshape(ids.shape)
    theta = np.zeros(len(used) + 5)  # weights, bias, transitions
    theta[-5] = -2.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    fixed = np.flatnonzero(used == BUCKETS)
    for step in range(1, STEPS + 1):
        rows = random.integers(0, len(ids), min(BATCH, len(ids)))
        f, y, w = inverse[rows], tags[rows], weight[rows]
        transitions = theta[-4:].reshape(2, 2)
        e = theta[f].sum(axis=2) + theta[-5]
        lengths = np.full(len(rows), CHUNK)
        m = marginals(e.ravel(), lengths, transitions).reshape(len(rows), CHUNK)
        error = (m - y) * w[:, None]
        grad = np.zeros_like(theta)
        grad[: len(used)] = np.bincount(f.ravel(), np.repeat(error.ravel(), f.shape[2]), len(used))
        grad[-5] = error.sum()
        seen = np.stack([((y[:, :-1] == i) & (y[:, 1:] == j)).sum() for i in (0, 1) for j in (0, 1)])
        grad[-4:] = (_pairs(m, lengths, e.ravel(), transitions).ravel() - seen) * w.mean()
        grad = grad / len(rows) + 1e-4 * theta
        grad[fixed] = 0.0
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta -= 0.1 * (1 - 0.9 * step / STEPS) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(BUCKETS + 1)
    weights[used] = theta[: len(used)]
    weights[BUCKETS] = 0.0
    return Field(weights, float(theta[-5]), theta[-4:].reshape(2, 2).copy())


def _markers(batches):
    counts = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            counts[int(toxic > 0)].update({f for w in set(tokens(text)) for f in features(w)})
    keys = sorted(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array([counts[0][k] for k in keys], pa.int64()), pa.array([counts[1][k] for k in keys], pa.int64())],
        names=["feature", "clean", "toxic"],
    )


def find_markers(sample: DataFrame, n_clean: int, n_toxic: int) -> list[str]:
    """Features bound to toxic documents beyond chance, at most one of any thousand by mistake."""
    counts = sample.mapInArrow(_markers, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = n_clean + n_toxic
    both = F.col("clean") + F.col("toxic")

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = 2 * (
        term(F.col("toxic"), both * n_toxic / n)
        + term(F.col("clean"), both * n_clean / n)
        + term(n_toxic - F.col("toxic"), n_toxic - both * n_toxic / n)
        + term(n_clean - F.col("clean"), n_clean - both * n_clean / n)
    )
    found = counts.where((both > 2) & (F.col("toxic") * n_clean > 4 * (F.col("clean") + 1) * n_toxic)).withColumn("ratio", ratio)
    return [r["feature"] for r in found.where(F.col("ratio") > 32).orderBy(F.desc("ratio"), "feature").limit(20_000).collect()]


def _sequences(markers: frozenset[str]):
    known: dict[str, bool] = {}

    def marked(word: str) -> bool:
        if word not in known:
            if len(known) > CACHE:
                known.clear()
            known[word] = any(f in markers for f in features(word))
        return known[word]

    def cut(batches):
        for batch in batches:
            rows = []
            for text, toxic, weight in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "weight"))):
                words = tokens(text)
                for at in range(0, len(words), CHUNK):
                    part = words[at : at + CHUNK]
                    hits = [int(marked(w)) for w in part]
                    key = hash64(" ".join(part)) >> 1
                    rows.append({"kind": int(any(hits)) + int(toxic > 0 and any(hits)), "key": key, "weight": weight, "words": part, "tags": [h if toxic > 0 else 0 for h in hits]})
            schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("weight", pa.float64()), ("words", pa.list_(pa.string())), ("tags", pa.list_(pa.int8()))])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return cut


@dataclass(frozen=True)
class ToxicityModel:
    field: Field | None
    constant: float
    logistic: np.ndarray


def _tagged(field: Field, texts: list[str | None], cache: dict[str, float]):
    """Marginals of all tokens of ``texts``, and the number of tokens of each."""
    parts, lengths = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = tokens(text)
        lengths[i] = len(words)
        try:
            parts.append(np.fromiter(map(cache.__getitem__, words), np.float64, len(words)))
        except KeyError:
            if len(cache) > CACHE:
                cache.clear()
            for w in set(words).difference(cache):
                cache[w] = field.emission(w)
            parts.append(np.fromiter(map(cache.__getitem__, words), np.float64, len(words)))
    emission = np.concatenate(parts) if parts else np.zeros(0)
    return marginals(emission, lengths, field.transitions), lengths


def _evidence(marginal: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Columns of the document model: 1, log of the expected toxic tokens, largest marginal, empty."""
    out = np.zeros((len(lengths), 4))
    out[:, 0] = 1.0
    out[:, 3] = lengths == 0
    full = lengths > 0
    if full.any():
        starts = (np.cumsum(lengths) - lengths)[full]
        out[full, 1] = np.log1p(np.add.reduceat(marginal, starts))
        out[full, 2] = np.maximum.reduceat(marginal, starts)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(len(beta))
        beta += np.clip(np.linalg.solve(curve, x.T @ (weight * (y - p)) - 1e-1 * beta), -5, 5)
    return beta


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str) -> tuple[DataFrame, int, int]:
    """Texts of the sampled training documents with label and weight; numbers of clean and toxic ones."""
    given = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label"))
        .where(F.col("label").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg((F.max("label") > 0).cast("double").alias("label"))
    )
    totals = {r["label"]: r["count"] for r in given.groupBy("label").count().collect()}
    chosen = None
    for label, total in sorted(totals.items()):
        part = given.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        part = part.withColumn("weight", F.lit(max(1.0, total / SAMPLE)))
        chosen = part if chosen is None else chosen.unionByName(part)
    if len(totals) < 2:
        return None, int(totals.get(0.0, 0)), int(totals.get(1.0, 0))
    chosen = stored(chosen, "toxicity-sample")
    # At most 2 * SAMPLE rows of three numbers: small whatever the input.
    sample = stored(docs.join(F.broadcast(chosen), "doc_id"), "toxicity-texts")
    return sample, int(totals[0.0]), int(totals[1.0])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> ToxicityModel:
    sample, clean, toxic = training_sample(docs, labels, label_col)
    if sample is None:
        return ToxicityModel(None, toxic / (clean + toxic) if clean + toxic else 0.5, np.zeros(4))
    seen = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    markers = frozenset(find_markers(sample, max(1, seen.get(0.0, 0)), max(1, seen.get(1.0, 0))))
    chunks = stored(sample.mapInArrow(_sequences(markers), "kind int, key long, weight double, words array<string>, tags array<byte>"), "toxicity-sequences")
    picked = []
    for kind, share in ((0, 2), (1, 4), (2, 2)):
        picked += chunks.where(F.col("kind") == kind).orderBy("key").limit(SEQUENCES // share).collect()
    if not any(r["kind"] == 2 for r in picked):
        return ToxicityModel(None, toxic / (clean + toxic), np.zeros(4))
    width = 1 + len(BEGINNINGS)
    ids = np.full((len(picked), CHUNK, width), BUCKETS, np.int64)
    tags = np.zeros((len(picked), CHUNK))
    for i, row in enumerate(picked):
        for j, word in enumerate(row["words"]):
            ids[i, j] = buckets(word)
        tags[i, : len(row["tags"])] = row["tags"]
    field = train_field(ids, tags, np.ones(len(picked)))

    def evidence(batches):
        cache: dict[str, float] = {}
        for batch in batches:
            if batch.num_rows:
                x = _evidence(*_tagged(field, batch.column("text").to_pylist(), cache))
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column("label"), batch.column("weight")], names=["a", "b", "c", "d", "label", "weight"])

    rows = sample.select("text", "label", "weight").mapInArrow(evidence, "a double, b double, c double, d double, label double, weight double").toPandas()
    logistic = fit_logistic(rows[["a", "b", "c", "d"]].to_numpy(), rows["label"].to_numpy(), rows["weight"].to_numpy())
    return ToxicityModel(field, 0.0, logistic)


def tagged(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """Per document row: doc_id, score, and with ``spans`` the offending tokens' [start, end) in characters."""
    source = texts_of(docs, id_col, text_col)
    model = fit(source, labels, label_col)
    span_type = pa.list_(pa.int64())

    def run(batches):
        cache: dict[str, float] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            starts: list[list[int]] = [[] for _ in texts]
            ends: list[list[int]] = [[] for _ in texts]
            if model.field is None or not texts:
                score = np.full(len(texts), model.constant)
            else:
                marginal, lengths = _tagged(model.field, texts, cache)
                score = 1 / (1 + np.exp(-np.clip(_evidence(marginal, lengths) @ model.logistic, -30, 30)))
                if spans:
                    first = np.cumsum(lengths) - lengths
                    for i in np.unique(np.searchsorted(first, np.flatnonzero(marginal >= 0.5), side="right") - 1):
                        bad = marginal[first[i] : first[i] + lengths[i]] >= 0.5
                        for found, offending in zip(TOKEN.finditer(lowered(texts[i])), bad):
                            if offending:
                                starts[i].append(found.start())
                                ends[i].append(found.end())
            columns = [batch.column(0), pa.array(score, pa.float64())]
            columns += [pa.array(starts, span_type), pa.array(ends, span_type)] if spans else []
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "starts", "ends"][: len(columns)])

    schema = "doc_id long, score double" + (", starts array<long>, ends array<long>" if spans else "")
    return source.mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted, and the offending spans in characters."""
    return tagged(docs, labels, label_col).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "starts",
        "ends",
    )
