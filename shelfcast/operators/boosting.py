"""Boosted regression trees over binned features, leaf by leaf, from histograms added up by Spark.

Rows are packed into blocks: one byte for each feature, and the target. A tree starts as one leaf; the leaf whose best split
lowers the squared error most is split next, until there are ``num_leaves``. A split is chosen from a leaf's
histogram (sum of residuals and number of rows for each bin of each feature); of two children only the smaller
one is counted, the other is the difference. Every round adds one tree to what stays unexplained, and
rounds end when the mean absolute error of the validation rows hasn't improved for a number of them.

Residuals are counted in whole steps of a power of two, so that sums are exact in any order: the trees are the same
however rows are dealt into blocks. With several blocks, each pass adds the blocks' histograms of all leaves that may be
split next, and every round writes the blocks with their new scores. A single block has nothing to add up, and
its rounds run where it lies.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.config import PAIR, ForecastConfig
from shelfcast.session import new_scratch

BINS = 256
BLOCK = (
    "horizon int, n_train long, n_valid long, largest double, total double, "
    "train_bins binary, train_y binary, train_score binary, valid_bins binary, valid_y binary, valid_score binary, valid_error double"
)
SCHEMA = pa.schema(
    [("horizon", pa.int32()), ("n_train", pa.int64()), ("n_valid", pa.int64()), ("largest", pa.float64()), ("total", pa.float64())]
    + [(f"{part}_{what}", pa.binary()) for part in ("train", "valid") for what in ("bins", "y", "score")]
    + [("valid_error", pa.float64())]
)
NODE = "horizon int, round int, node int, feature int, bin int, child int, value double"


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root first. ``child`` is the left child of a split (the right one follows it), -1 for a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    child: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row. bins: one row of bytes for each feature."""
        at = np.zeros(bins.shape[1], np.int32)
        rows = np.arange(bins.shape[1]) if self.child[0] >= 0 else np.zeros(0, np.int64)
        while len(rows):
            node = at[rows]
            right = bins[self.feature[node], rows] > self.bin[node]
            at[rows] = self.child[node] + right
            rows = rows[self.child[at[rows]] >= 0]
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(bins)]


@dataclass(frozen=True)
class TreeModel:
    """The start value, the upper bounds of each feature's bins, and the trees."""

    base: float
    edges: tuple[np.ndarray, ...]
    trees: tuple[Tree, ...]

    @property
    def n_trees(self) -> int:
        return len(self.trees)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(bins.shape[1], self.base)
        for tree in self.trees:
            out += tree.predict(bins)
        return out


def binned(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    """One row of bytes for each feature; a value lies in the first bin whose bound it doesn't exceed."""
    return np.stack([np.searchsorted(e, x, side="left").astype(np.uint8) for x, e in zip(columns, edges)])


def histogram(bins: np.ndarray, rows: np.ndarray | None, steps: np.ndarray) -> np.ndarray:
    """Sums and counts, features x bins x 2, of some rows (None: all)."""
    out = np.empty((len(bins), BINS, 2))
    own = steps if rows is None else steps[rows]
    for f, of_feature in enumerate(bins):
        at = of_feature if rows is None else of_feature[rows]
        out[f, :, 0] = np.bincount(at, own, BINS)
        out[f, :, 1] = np.bincount(at, minlength=BINS)
    return out


def best_split(cells: np.ndarray, least_rows: int) -> tuple[float, int, int]:
    """Gain, feature and last left bin of the best split; gain 0 if there is none. Ties: first feature, first bin."""
    left = np.cumsum(cells, axis=1)[:, :-1]
    total = cells[0].sum(axis=0)
    right = total - left
    n = left[..., 1] * right[..., 1]
    apart = left[..., 0] * right[..., 1] - right[..., 0] * left[..., 1]
    allowed = (left[..., 1] >= least_rows) & (right[..., 1] >= least_rows)
    gain = np.where(allowed & (n > 0), (apart / np.maximum(n, 1)) * (apart / max(total[1], 1)), 0.0)
    best = int(np.argmax(gain))
    return float(gain.flat[best]), *divmod(best, BINS - 1)


#: (leaf, feature, last left bin, whether the left child is the smaller one): asks for that child's histogram.
Request = tuple[int, int, int, bool]


def grow(root: np.ndarray, count: Callable[[list[list[int]], list[Request]], list[np.ndarray]], ahead: bool, unit: float, cfg: ForecastConfig) -> Tree:
    """A tree, best leaf first. ``count`` yields histograms for the tree so far; ``ahead``: of all leaves that may be next at once."""
    nodes = [[-1, -1, -1]]  # feature, bin, child
    cells = {0: root}
    splits = {0: best_split(root, cfg.min_leaf_rows)}
    known: dict[int, np.ndarray] = {}
    open_ = [(-splits[0][0], 0)]
    leaves = 1
    while leaves < cfg.num_leaves and open_ and open_[0][0] < 0:
        leaf = open_[0][1]
        if leaf not in known:
            wanted = [k for g, k in heapq.nsmallest(cfg.num_leaves - leaves if ahead else 1, open_) if g < 0 and k not in known]
            asked = []
            for k in wanted:
                _, f, b = splits[k]
                n_left = cells[k][f, : b + 1, 1].sum()
                asked.append((k, f, b, bool(2 * n_left <= cells[k][f, :, 1].sum())))
            for request, found in zip(asked, count(nodes, asked)):
                known[request[0]] = found if request[3] else cells[request[0]] - found
        heapq.heappop(open_)
        _, f, b = splits[leaf]
        nodes[leaf] = [f, b, len(nodes)]
        for child in (known[leaf], cells[leaf] - known[leaf]):
            k = len(nodes)
            nodes.append([-1, -1, -1])
            cells[k], splits[k] = child, best_split(child, cfg.min_leaf_rows)
            heapq.heappush(open_, (-splits[k][0], k))
        del cells[leaf]
        leaves += 1
    value = np.zeros(len(nodes))
    for k, own in cells.items():
        total, n = own[0].sum(axis=0)
        value[k] = cfg.learning_rate * unit * total / n if n else 0.0
    feature, bin_, child = (np.array(x, np.int32) for x in zip(*nodes))
    return Tree(feature, bin_, child, value)


def in_steps(x: np.ndarray, unit: float) -> np.ndarray:
    return np.rint(x / unit)


def unit_for(rows: int, largest: float) -> float:
    """A power of two such that sums of ``rows`` residuals stay exact in double precision."""
    return 2.0 ** (math.ceil(math.log2(max(rows, 1))) + math.ceil(math.log2(max(largest, 2.0**-60) * 8)) - 52)


def best_round(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """Number of trees to keep, and whether patience ran out within ``errors``."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


class OneBlock:
    """The rows of a horizon in this process."""

    ahead = False

    def __init__(self, row: dict, unit: float, base: float) -> None:
        def matrix(data: bytes, n: int) -> np.ndarray:
            return np.frombuffer(data, np.uint8).reshape(-1, n) if n else np.zeros((0, 0), np.uint8)

        self.unit = unit
        self.bins, self.valid = matrix(row["train_bins"], row["n_train"]), matrix(row["valid_bins"], row["n_valid"])
        self.y, self.valid_y = np.frombuffer(row["train_y"]), np.frombuffer(row["valid_y"])
        self.score, self.valid_score = np.full(len(self.y), base), np.full(len(self.valid_y), base)

    def root(self) -> np.ndarray:
        self.steps = in_steps(self.y - self.score, self.unit)
        self.rows: dict[int, np.ndarray | None] = {0: None}
        return histogram(self.bins, None, self.steps)

    def count(self, nodes: list[list[int]], asked: list[Request]) -> list[np.ndarray]:
        (leaf, feature, last, left), = asked
        rows = self.rows.pop(leaf)
        rows = np.arange(len(self.y)) if rows is None else rows
        goes_left = self.bins[feature, rows] <= last
        self.rows[len(nodes)], self.rows[len(nodes) + 1] = rows[goes_left], rows[~goes_left]  # the children's numbers
        return [histogram(self.bins, self.rows[len(nodes) + (not left)], self.steps)]

    def add(self, tree: Tree) -> float:
        """Adds a tree; the summed error of the validation rows, in steps."""
        for leaf, rows in self.rows.items():
            self.score[slice(None) if rows is None else rows] += tree.value[leaf]
        if len(self.valid_y):
            self.valid_score += tree.predict(self.valid)
        return float(in_steps(np.abs(self.valid_y - self.valid_score), self.unit).sum())


class ManyBlocks:
    """The rows of a horizon in a written table of blocks, each with its scores."""

    ahead = True

    def __init__(self, blocks: DataFrame, n_features: int, unit: float, base: float) -> None:
        self.table, self.n_features, self.unit = blocks, n_features, unit
        self._write(lambda bins, score: np.full(len(score), base))

    def _write(self, scored: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        unit, n_features, spark = self.unit, self.n_features, self.table.sparkSession

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    for part in ("train", "valid"):
                        n = row[f"n_{part}"]
                        score = np.frombuffer(row[f"{part}_score"] or bytes(8 * n))
                        row[f"{part}_score"] = scored(np.frombuffer(row[f"{part}_bins"], np.uint8).reshape(n_features, n), score).tobytes()
                    error = np.abs(np.frombuffer(row["valid_y"]) - np.frombuffer(row["valid_score"]))
                    row["valid_error"] = float(in_steps(error, unit).sum())
                    yield pa.RecordBatch.from_pylist([row], schema=batch.schema)

        path = new_scratch(spark, "boosting-round")
        self.table.mapInArrow(run, BLOCK).write.option("compression", "none").parquet(path)
        self.table = spark.read.schema(self.table.schema).parquet(path)

    def _histograms(self, leaves: Callable[[np.ndarray], np.ndarray], asked: list[Request]) -> list[np.ndarray]:
        unit, n_features = self.unit, self.n_features

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    y = np.frombuffer(row["train_y"])
                    bins = np.frombuffer(row["train_bins"], np.uint8).reshape(n_features, len(y))
                    steps = in_steps(y - np.frombuffer(row["train_score"]), unit)
                    at = leaves(bins)
                    for k, (leaf, feature, last, left) in enumerate(asked):
                        rows = np.flatnonzero(at == leaf)
                        if feature >= 0:
                            rows = rows[(bins[feature, rows] <= last) == left]
                        found = histogram(bins, rows, steps).reshape(-1, 2)
                        cell = np.flatnonzero(found[:, 1])
                        yield pa.RecordBatch.from_arrays([pa.array(k * len(found) + cell), pa.array(found[cell, 0]), pa.array(found[cell, 1])], names=["cell", "total", "n"])

        cells = self.table.select("train_bins", "train_y", "train_score").mapInArrow(run, "cell long, total double, n double")
        # At most num_leaves x features x BINS rows.
        sums = cells.groupBy("cell").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
        cell, total, n = (c.to_numpy() for c in sums.columns)
        out = np.zeros((len(asked) * n_features * BINS, 2))
        out[cell, 0], out[cell, 1] = total, n
        return list(out.reshape(len(asked), n_features, BINS, 2))

    def root(self) -> np.ndarray:
        return self._histograms(lambda bins: np.zeros(bins.shape[1], np.int32), [(0, -1, 0, True)])[0]

    def count(self, nodes: list[list[int]], asked: list[Request]) -> list[np.ndarray]:
        so_far = Tree(*(np.array(x, np.int32) for x in zip(*nodes)), np.zeros(0))
        return self._histograms(so_far.leaves, asked)

    def add(self, tree: Tree) -> float:
        self._write(lambda bins, score: score + tree.predict(bins))
        return self.table.agg(F.sum("valid_error")).first()[0]


def boost(rows: OneBlock | ManyBlocks, validates: bool, unit: float, cfg: ForecastConfig) -> list[Tree]:
    """Adds trees until patience runs out, no leaf can be split or all rounds are done; those up to the best round."""
    trees: list[Tree] = []
    errors: list[float] = []
    while len(trees) < cfg.boost_rounds:
        tree = grow(rows.root(), rows.count, rows.ahead, unit, cfg)
        if tree.child[0] < 0:
            break
        trees.append(tree)
        error = rows.add(tree)
        if validates:
            errors.append(error)
            if best_round(errors, cfg.early_stop_rounds)[1]:
                break
    return trees[: best_round(errors, cfg.early_stop_rounds)[0]] if errors else trees


def bin_edges(rows: DataFrame, features: Sequence[str], n_rows: int, cfg: ForecastConfig) -> tuple[np.ndarray, ...]:
    """Upper bounds of at most ``BINS - 1`` bins for each feature: quantiles of a sample chosen by a hash of the row's key."""
    share = min(1.0, cfg.bin_sample_rows / max(n_rows, 1))
    sample = rows.where(F.pmod(F.xxhash64(*PAIR, "time_idx"), F.lit(1_000_000)) < F.lit(1e6 * share))
    quantiles = F.array(*[F.lit(i / (BINS - 2)) for i in range(BINS - 1)])
    found = sample.agg(*[F.percentile_approx(F.col(f).cast("double"), quantiles, F.lit(1_000_000)).alias(f) for f in features]).first()
    return tuple(np.unique(np.array(found[f] or [], np.float64)) for f in features)


def blocks_of(rows: DataFrame, features: Sequence[str], splits: dict[int, tuple[Column, Column]], edges: tuple[np.ndarray, ...], n_blocks: int) -> DataFrame:
    """The rows of each horizon packed into blocks. splits: which rows train and which validate it."""
    horizons = list(splits)
    parts = [F.when(train, 1).when(valid, 2).otherwise(0).cast("int").alias(f"part_{h}") for h, (train, valid) in splits.items()]
    targets = [F.col(f"target_h{h}").cast("double").alias(f"y_{h}") for h in horizons]
    source = rows.select(*PAIR, *[F.col(f).cast("double").alias(f) for f in features], *parts, *targets).repartition(n_blocks, *PAIR).drop(*PAIR)

    def pack(batches):
        bins = [np.zeros((len(features), 0), np.uint8)]
        own: dict[int, tuple[list, list]] = {h: ([], []) for h in horizons}
        for batch in batches:
            columns = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
            bins.append(binned([columns[f] for f in features], edges))
            for h in horizons:
                own[h][0].append(columns[f"part_{h}"])
                own[h][1].append(columns[f"y_{h}"])
        all_bins = np.concatenate(bins, axis=1)
        if not all_bins.shape[1]:
            return
        for h in horizons:
            part, y = (np.concatenate(x) for x in own[h])
            train, valid = part == 1, part == 2
            used = y[part > 0]
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "horizon": h, "n_train": int(train.sum()), "n_valid": int(valid.sum()),
                        "largest": float(np.abs(used).max(initial=0.0)), "total": float(y[train].sum()),
                        "train_bins": all_bins[:, train].tobytes(), "train_y": y[train].tobytes(), "train_score": b"",
                        "valid_bins": all_bins[:, valid].tobytes(), "valid_y": y[valid].tobytes(), "valid_score": b"", "valid_error": 0.0,
                    }
                ],
                schema=SCHEMA,
            )

    return source.mapInArrow(pack, BLOCK)


def fit(blocks: DataFrame, edges: tuple[np.ndarray, ...], horizons: Sequence[int], cfg: ForecastConfig, run_all: Callable[[list[Callable]], list]) -> dict[int, TreeModel]:
    """A model for each horizon from a written table of blocks; ``run_all`` calls functions side by side."""
    sums = blocks.where(F.col("horizon").isin(list(horizons))).groupBy("horizon")
    sums = sums.agg(F.count("*").alias("blocks"), *[F.sum(c).alias(c) for c in ("n_train", "n_valid", "total")], F.max("largest").alias("largest"))
    about = {r["horizon"]: r for r in sums.collect()}
    # Rounded, since a sum of doubles depends on how the rows lie.
    base = {h: round(r["total"] / r["n_train"], 6) for h, r in about.items()}
    unit = {h: unit_for(r["n_train"] + r["n_valid"], r["largest"]) for h, r in about.items()}
    valid = {h: r["n_valid"] > 0 for h, r in about.items()}
    whole = [h for h, r in about.items() if r["blocks"] == 1]
    place = {h: i for i, h in enumerate(whole)}

    def alone(batches):
        for batch in batches:
            for row in batch.to_pylist():
                h = row["horizon"]
                for number, tree in enumerate(boost(OneBlock(row, unit[h], base[h]), valid[h], unit[h], cfg)):
                    n = len(tree.value)
                    columns = [np.full(n, h, np.int32), np.full(n, number, np.int32), np.arange(n, dtype=np.int32), tree.feature, tree.bin, tree.child, tree.value]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in NODE.split(", ")])

    def together(h: int) -> Callable[[], list[Tree]]:
        rows = blocks.where(F.col("horizon") == h)
        return lambda: boost(ManyBlocks(rows, len(edges), unit[h], base[h]), valid[h], unit[h], cfg)

    trees: dict[int, list[Tree]] = {h: [] for h in about}
    if whole:
        index = F.element_at(F.create_map(*[F.lit(x) for item in place.items() for x in item]), F.col("horizon"))
        dealt = blocks.where(F.col("horizon").isin(whole)).repartitionById(len(whole), index)
        # At most boost_rounds x 2 num_leaves rows for each horizon.
        nodes = dealt.mapInArrow(alone, NODE).toPandas().sort_values(["horizon", "round", "node"])
        for (h, _), own in nodes.groupby(["horizon", "round"]):
            trees[h].append(Tree(*(own[c].to_numpy() for c in ("feature", "bin", "child", "value"))))
    many = [h for h in about if h not in place]
    trees |= dict(zip(many, run_all([together(h) for h in many])))
    return {h: TreeModel(base[h], edges, tuple(own)) for h, own in trees.items()}
