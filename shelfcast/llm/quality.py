"""Quality scores: ridge regression on random Fourier features, calibrated by isotonic regression.

Each text becomes a dozen statistics (shares of letter classes, word and line repetition,
lengths). Random cosine features approximate a Gaussian kernel over the standardised
statistics; every task sums its part of the normal equations, Spark adds the parts, and the
driver solves one system of ``FOURIER + 1`` unknowns. Raw scores are calibrated on a histogram of
the training rows by pooling adjacent violators. All labelled rows of the training folds are
used; only sums of fixed size reach the driver.

Defined results: null and empty texts have statistics of zero and get a score like any other;
rows whose id is null have no label and are not held out; an id with several labels counts
with the smallest; with no training labels every score is 0.5, with one class only it is that
class. Repeated rows get repeated results. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import fold, stored, texts_of, utf8

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "word_spread", "upper", "digit", "symbol", "punctuation",
    "beyond_ascii", "new_words", "top_word", "repeated_lines", "line_words", "shouted_words", "marked_words",
)
FOURIER = 160
RIDGE = 1e-3
SEED = 20
TRAIN_ROWS_PER_TASK = 20_000
BINS = 2_000
#: Raw scores from -0.5 to 1.5 are told apart in BINS steps.
LOWEST, HIGHEST = -0.5, 1.5

_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = (
        1 if "A" <= _ch <= "Z" else 2 if "0" <= _ch <= "9" else 3 if _ch in ".,;:!?'\"()-" else 4 if _c >= 0x80
        else 5 if _ch in " \t\n\r\v\f" else 0 if "a" <= _ch <= "z" else 6
    )


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of ``STATISTICS``."""
    raw = utf8(text)
    words = raw.split()
    if not words:
        return [float(np.log1p(len(raw)))] + [0.0] * (len(STATISTICS) - 1)
    counts = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7) / len(raw)
    n = len(words)
    sizes = np.fromiter(map(len, words), np.float64, n)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shouted = sum(c for w, c in seen.items() if w.isupper() and len(w) > 2)
    marked = sum(c for w, c in seen.items() if not w[-1:].isalnum() and w[-1] < 0x80 and w[-1:] not in b".,;:!?'\")")
    return [
        float(np.log1p(len(raw))),
        float(np.log1p(n)),
        float(sizes.mean()),
        float(sizes.std()),
        float(counts[1]),
        float(counts[2]),
        float(counts[6]),
        float(counts[3]),
        float(counts[4]),
        len(seen) / n,
        max(seen.values()) / n,
        1.0 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        shouted / n,
        marked / n,
    ]


def _measure(batches):
    for batch in batches:
        values = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.float64).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in values.T)], names=["doc_id", *STATISTICS])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)
    return texts_of(docs, id_col, text_col).mapInArrow(_measure, schema)


@dataclass(frozen=True)
class QualityModel:
    """Standardisation, random directions, ridge weights and the calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None
    curve_x: np.ndarray
    curve_y: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        cosines = np.cos(z @ self.directions + self.phases) * np.sqrt(2.0 / len(self.phases))
        return np.hstack([cosines, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.curve_y[0])
        return np.clip(np.interp(self.raw(x), self.curve_x, self.curve_y), 0.0, 1.0)


def pooled(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Isotonic fit of ``sums / counts`` (weights ``counts``) by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for s, c in zip(sums, counts):
        blocks.append([s, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, c2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + c2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), s / c) for s, c, n in blocks])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(s)).to_numpy(zero_copy_only=False) for s in STATISTICS])


def fit(training: DataFrame, seed: int = SEED) -> QualityModel:
    """Fits on a table with the columns ``STATISTICS`` and ``label`` (0 or 1)."""
    moments = training.agg(
        F.count("*").alias("n"),
        F.sum("label").alias("ones"),
        *[F.avg(s).alias(f"m_{s}") for s in STATISTICS],
        *[F.stddev_pop(s).alias(f"s_{s}") for s in STATISTICS],
    ).first()
    n, d = moments["n"], len(STATISTICS)
    random = np.random.default_rng(seed)
    directions = random.standard_normal((d, FOURIER)) / np.sqrt(d)  # kernel width: the typical distance
    phases = random.uniform(0, 2 * np.pi, FOURIER)
    constant = 0.5 if not n else float(moments["ones"]) / n
    if not n or constant in (0.0, 1.0):
        return QualityModel(np.zeros(d), np.ones(d), directions, phases, None, np.zeros(1), np.array([constant]))
    mean = np.array([moments[f"m_{s}"] for s in STATISTICS])
    scale = np.array([moments[f"s_{s}"] or 1.0 for s in STATISTICS])
    plain = QualityModel(mean, scale, directions, phases, None, np.zeros(1), np.zeros(1))
    size = FOURIER + 2

    def equations(batches):
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                z = np.column_stack([plain.fourier(_matrix(batch)), batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False)])
                total += z.T @ z
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i * size + j), pa.array(total[i, j])], names=["cell", "part"])

    rows = (
        training.repartition(1 + n // TRAIN_ROWS_PER_TASK)
        .mapInArrow(equations, "cell long, part double")
        .groupBy("cell")
        .agg(F.sum("part").alias("total"))
        .toPandas()
    )
    both = np.zeros(size * size)
    both[rows["cell"].to_numpy()] = rows["total"].to_numpy()
    both = both.reshape(size, size)
    both = np.triu(both) + np.triu(both, 1).T
    gram, right = both[:-1, :-1] / n, both[:-1, -1] / n
    penalty = RIDGE * np.eye(FOURIER + 1)
    penalty[-1, -1] = 0.0
    weights = np.linalg.solve(gram + penalty * np.trace(gram) / (FOURIER + 1), right)
    fitted = QualityModel(mean, scale, directions, phases, weights, np.zeros(1), np.zeros(1))

    def histogram(batches):
        counts, sums = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            if batch.num_rows:
                at = np.clip(((fitted.raw(_matrix(batch)) - LOWEST) / (HIGHEST - LOWEST) * BINS).astype(np.int64), 0, BINS - 1)
                counts += np.bincount(at, minlength=BINS)
                sums += np.bincount(at, batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False), BINS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at]), pa.array(sums[at])], names=["bin", "n", "ones"])

    bins = (
        training.mapInArrow(histogram, "bin long, n double, ones double")
        .groupBy("bin")
        .agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
        .toPandas()
        .sort_values("bin")
    )
    at, counts, ones = (bins[c].to_numpy() for c in ("bin", "n", "ones"))
    centres = LOWEST + (at + 0.5) * (HIGHEST - LOWEST) / BINS
    level = pooled(ones, counts)
    # One point for each level, at its rows' mean raw score: scores between levels are interpolated.
    starts = np.concatenate(([0], np.flatnonzero(np.diff(level)) + 1))
    weight = np.add.reduceat(counts, starts)
    x = np.add.reduceat(centres * counts, starts) / weight
    return QualityModel(mean, scale, directions, phases, weights, x, level[starts])


def labelled(features: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``features`` in the training folds, with a double column ``label``."""
    given = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label"))
        .where(F.col("label").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    return features.join(given, "doc_id")


def scored(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document row: doc_id, held_out, score and predicted."""
    features = stored(measured(docs, id_col, text_col), "quality-statistics")
    model = fit(stored(labelled(features, labels, label_col), "quality-training"))

    def predict(batches):
        for batch in batches:
            score = model.score(_matrix(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return features.mapInArrow(predict, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, whole rows, without those whose text scores below ``threshold``."""
    features = stored(measured(docs, id_col, text_col), "quality-statistics")
    model = fit(stored(labelled(features, labels, "quality"), "quality-training"))
    at = docs.columns.index(text_col)

    def choose(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t) for t in batch.column(at).cast(pa.string()).to_pylist()])
                batch = batch.filter(pa.array(model.score(x) >= threshold))
            yield batch

    return docs.mapInArrow(choose, docs.schema)
