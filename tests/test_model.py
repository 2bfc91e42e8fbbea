from __future__ import annotations

import datetime as dt
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.config import FEATURES, ForecastConfig
from shelfcast.operators import boosting, model, panel, prepare, segments
from shelfcast.plans import catalogue


@pytest.fixture(scope="module")
def small():
    return ForecastConfig(min_train_rows=100, boost_rounds=6, early_stop_rounds=3, num_leaves=8, min_leaf_rows=5, learning_rate=0.3)


@pytest.fixture(scope="module")
def features(spark, small):
    """Twelve pairs sold every week for forty weeks, each around its own level."""
    rng = random.Random(1)
    first = dt.date(2024, 1, 2)
    rows = [
        (f"s{i % 3}", f"p{i // 3}", first + dt.timedelta(weeks=w), float(10 * i + rng.randint(0, 3)), 0.1)
        for i in range(12)
        for w in range(40)
    ]
    sales = spark.createDataFrame(
        rows, "store_id string, product_id string, transaction_date date, quantity double, discount double"
    )
    prepared = prepare.prepare_transactions(sales, small)
    weekly = prepare.weekly_sales(prepared)
    pairs = segments.top_pairs(segments.pair_stats(prepared, small), prepared, small)
    return panel.feature_panel(weekly, pairs, small).persist()


@pytest.mark.parametrize(
    "errors, patience, kept, stopped",
    [
        ([5, 4, 3, 2], 2, 4, False),
        ([5, 4, 3, 3, 3, 1], 2, 3, True),  # equal is no improvement
        ([5, 6, 4, 5, 3, 4], 2, 5, False),
        ([1, 2, 3, 4], 3, 1, True),
        ([2.0], 5, 1, False),
    ],
)
def test_patience(errors, patience, kept, stopped):
    assert boosting.best_round(errors, patience) == (kept, stopped)


def test_split_sizes(features, small):
    # 12 pairs, time_idx 0..39, cutoff 33: rows 34..39-h validate.
    found = [(r.horizon, r.train_rows, r.valid_rows) for r in model.split_counts(features, small).collect()]
    assert found == [(h, 12 * 34, 12 * (6 - h)) for h in range(1, 6)]


def test_strict_split_drops_targets_from_the_held_back_weeks(spark, features, small):
    strict = ForecastConfig(**{**small.__dict__, "strict_split": True})
    times = {f"target_time_h{h}": F.lead("time_idx", h).over(panel.by_pair()) for h in range(1, 6)}
    found = [r.train_rows for r in model.split_counts(features.withColumns(times), strict).collect()]
    assert found == [12 * (34 - h) for h in range(1, 6)]


def parts(tree):
    return [x.tolist() for x in (tree.feature, tree.bin, tree.child, tree.value)]


def test_fewer_rounds_are_a_prefix_of_more(features, small):
    patient = replace(small, early_stop_rounds=100, num_leaves=4)
    long, _ = model.train_models(features, replace(patient, boost_rounds=6))
    short, _ = model.train_models(features, replace(patient, boost_rounds=3))
    for h in short:
        # The best round may be an earlier one.
        assert [parts(t) for t in short[h].trees] == [parts(t) for t in long[h].trees[: short[h].n_trees]]


@pytest.mark.parametrize("rows_per_block", [100, 37])
def test_trees_do_not_depend_on_the_blocks(features, small, rows_per_block):
    cfg = replace(small, horizons=(1, 2), boost_rounds=3, early_stop_rounds=2)
    one, _ = model.train_models(features, cfg)
    many, _ = model.train_models(features, replace(cfg, train_rows_per_block=rows_per_block))
    for h in (1, 2):
        assert one[h].base == many[h].base and [parts(t) for t in one[h].trees] == [parts(t) for t in many[h].trees]


def brute_tree(x, residual, leaves, least, rate):
    """Best-first by trying every split of every leaf: (condition path, value) of each leaf."""

    def best(rows):
        found = (0.0, None)
        for f in range(x.shape[1]):
            for bound in np.unique(x[rows, f])[:-1]:
                left = rows[x[rows, f] <= bound]
                right = rows[x[rows, f] > bound]
                if min(len(left), len(right)) < least:
                    continue
                gain = sum(residual[r].sum() ** 2 / len(r) for r in (left, right)) - residual[rows].sum() ** 2 / len(rows)
                if gain > found[0] + 1e-9:
                    found = (gain, (left, right))
        return found

    open_ = [(np.arange(len(x)), best(np.arange(len(x))))]
    while len(open_) < leaves:
        k = max(range(len(open_)), key=lambda i: open_[i][1][0])
        gain, halves = open_[k][1]
        if gain <= 0:
            break
        open_[k : k + 1] = [(r, best(r)) for r in halves]
    out = np.zeros(len(x))
    for rows, _ in open_:
        out[rows] = rate * residual[rows].mean()
    return out


@pytest.mark.parametrize("seed", range(5))
def test_splits_equal_brute_force(seed):
    r = np.random.default_rng(seed)
    x = r.integers(0, 12, (300, 4)).astype(float)
    y = 3 * x[:, 0] + np.where(x[:, 1] > 5, 20.0, 0.0) * (x[:, 2] > 3) + r.normal(size=300)
    cfg = ForecastConfig(num_leaves=9, min_leaf_rows=7, learning_rate=0.5, boost_rounds=3)
    edges = [np.unique(c) for c in x.T]
    bins = boosting.binned(list(x.T), edges)
    unit = boosting.unit_for(300, np.abs(y).max())
    row = {"n_train": 300, "n_valid": 0, "train_bins": bins.tobytes(), "valid_bins": b"", "train_y": y.tobytes(), "valid_y": b""}
    score = np.full(300, y.mean())
    for tree in boosting.boost(boosting.OneBlock(row, unit, y.mean()), False, unit, cfg):
        expected = brute_tree(x, y - score, 9, 7, 0.5)
        assert np.allclose(tree.predict(bins), expected, atol=1e-6)
        score += expected


def test_the_best_round_of_a_validated_fit_is_kept():
    r = np.random.default_rng(3)
    x, v = r.normal(size=(400, 3)), r.normal(size=(80, 3))
    y, w = x[:, 0] + 2 * r.normal(size=400), v[:, 0] + 2 * r.normal(size=80)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 50))) for c in x.T]
    bins, valid = boosting.binned(list(x.T), edges), boosting.binned(list(v.T), edges)
    unit = boosting.unit_for(480, max(np.abs(y).max(), np.abs(w).max()))
    row = {"n_train": 400, "n_valid": 80, "train_bins": bins.tobytes(), "valid_bins": valid.tobytes(), "train_y": y.tobytes(), "valid_y": w.tobytes()}
    cfg = ForecastConfig(num_leaves=15, min_leaf_rows=5, learning_rate=0.4, boost_rounds=60, early_stop_rounds=8)
    kept = boosting.boost(boosting.OneBlock(row, unit, 0.0), True, unit, cfg)
    every = boosting.boost(boosting.OneBlock(row, unit, 0.0), False, unit, cfg)
    errors = [np.abs(w - sum((t.predict(valid) for t in every[: k + 1]), np.zeros(80))).mean() for k in range(len(every))]
    assert 0 < len(kept) < 52 and [parts(t) for t in kept] == [parts(t) for t in every[: len(kept)]]
    assert errors[len(kept) - 1] == pytest.approx(min(errors[: len(kept) + 8]))


def test_constant_targets_grow_no_tree():
    row = {"n_train": 50, "n_valid": 0, "train_bins": bytes(range(50)), "valid_bins": b"", "train_y": np.full(50, 3.0).tobytes(), "valid_y": b""}
    unit = boosting.unit_for(50, 3.0)
    assert boosting.boost(boosting.OneBlock(row, unit, 3.0), False, unit, ForecastConfig()) == []


def test_the_query_trains_with_the_settings_of_the_operator(spark, monkeypatch):
    used = []
    monkeypatch.setattr(model, "train_models", lambda rows, cfg, pairs: used.append(cfg) or ({}, []))
    catalogue.model_forecast(spark, "/root/testdata/sf0.001")
    assert used == [ForecastConfig()]


def test_models_beat_a_constant_and_overrides_follow(features, small):
    models, splits = model.train_models(features, small)
    assert all(models[h] is not None for h in range(1, 6)) and len(splits) == 5
    overrides = model.score_last_points(features, models, small)
    rows = overrides.collect()
    assert len(rows) == 12 and all(len(r.override) == 5 and min(r.override) >= 0 for r in rows)
    level = {(f"s{i % 3}", f"p{i // 3}"): 10 * i + 1.5 for i in range(12)}
    error = sum(abs(r.override[0] - level[r.store_id, r.product_id]) for r in rows) / 12
    constant = sum(abs(v - 56.5) for v in level.values()) / 12
    assert error < constant / 2


def test_models_learn_from_the_given_pairs_and_score_all(features, small):
    few = features.select("store_id", "product_id").where("product_id = 'P3' or product_id = 'p3'").distinct()
    models, splits = model.train_models(features, small, few)
    assert [(s.horizon, s.train_rows) for s in splits] == [(h, 3 * 34) for h in range(1, 6)]
    assert model.score_last_points(features, models, small).count() == 12


def test_a_horizon_without_enough_rows_is_skipped(features, small):
    picky = ForecastConfig(**{**small.__dict__, "horizons": (1, 2), "min_train_rows": 445, "boost_rounds": 2})
    # cutoff is 36 for two horizons: 12 * 37 rows train both, one short of the minimum.
    models, _ = model.train_models(features, picky)
    assert models == {1: None, 2: None}
    assert model.score_last_points(features, models, picky).count() == 0


def test_every_horizon_with_a_labelled_row_is_trained(features):
    cfg = ForecastConfig(horizons=(1, 2), boost_rounds=3, early_stop_rounds=1, num_leaves=4)
    # cutoff is 36: the labelled rows up to it train, and none is left to validate with.
    early = features.where("time_idx <= 36 or time_idx = 39").withColumn("target_h1", F.when(F.col("time_idx") <= 36, F.col("target_h1")))
    none = early.withColumn("target_h2", F.lit(None).cast("double"))
    models, splits = model.train_models(none, cfg)
    assert [(s.train_rows, s.valid_rows) for s in splits] == [(12 * 37, 0), (0, 0)]
    assert models[1].n_trees == 3 and models[2] is None


@pytest.mark.parametrize("missing, expected", [("zero", 0.0), ("base", None)])
def test_skipped_horizons_among_trained_ones(features, small, missing, expected):
    cfg = ForecastConfig(**{**small.__dict__, "horizons": (1, 2), "boost_rounds": 2, "missing_model": missing})
    models, _ = model.train_models(features, cfg)
    rows = model.score_last_points(features, {1: models[1], 2: None}, cfg).collect()
    assert {r.override[1] for r in rows} == {expected}
    assert all(r.override[0] is not None for r in rows)
