from __future__ import annotations

import itertools
import random

import pytest

from shelfcast.config import ForecastConfig
from shelfcast.operators import grid, model, sizes

STATS = (
    "store_id string, product_id string, extinct boolean, recent_quantity double, recent_weeks bigint"
)


def predict(spark, cfg, stores, products, stats, overrides=None, chunks=None):
    """products: id -> (global average or None, representative)."""
    store_df = grid.chunk_stores(spark.createDataFrame([(s,) for s in stores], "store_id string"), cfg)
    product_df = spark.createDataFrame(
        [(p, i + 1, *v) for i, (p, v) in enumerate(sorted(products.items()))],
        "product_id string, product_code bigint, global_avg double, is_representative boolean",
    )
    stats_df = spark.createDataFrame(stats, STATS)
    if overrides is not None:
        rows = spark.createDataFrame(overrides, "store_id string, product_id string, horizon int, prediction double")
        overrides = model.overrides_from_rows(rows, cfg)
    facts = grid.pair_facts(stats_df, store_df, product_df, overrides, len(stores), len(products), cfg)
    pairs = grid.forecast_pairs(store_df, product_df, facts, len(stores), len(products), cfg, chunks)
    rows = grid.forecast(pairs, cfg).collect()
    found = {(r.store_id, r.product_id, r.horizon): r.prediction for r in rows}
    assert len(found) == len(rows)
    codes = {s: i + 1 for i, s in enumerate(sorted(stores))}, {p: i + 1 for i, p in enumerate(sorted(products))}
    assert all((r.store_code, r.product_code) == (codes[0][r.store_id], codes[1][r.product_id]) for r in rows)
    # Every third pair, a pair asked twice and unknown ones, from the compact result.
    asked = [k for i, k in enumerate(itertools.product([*stores, "nowhere"], [*products, "nothing"])) if i % 3 == 0]
    asked += asked[:1]
    asked_df = spark.createDataFrame(asked, "store_id string, product_id string")
    answers = sorted((r.store_id, r.product_id, r.horizon, r.prediction) for r in grid.forecast(grid.asked_pairs(asked_df, store_df, product_df, facts, cfg), cfg).collect())
    if chunks is None:
        assert answers == sorted((*k, h, found[*k, h]) for k in asked for h in cfg.horizons if (*k, h) in found)
    return found


def brute(cfg, stores, products, stats, overrides=()):
    facts = {(s, p): (e, q, n) for s, p, e, q, n in stats}
    values: dict[tuple, dict] = {}
    for s, p, h, v in overrides:
        values.setdefault((s, p), {})[h] = v
    expected = {}
    for s, p, h in itertools.product(stores, products, cfg.horizons):
        average, representative = products[p]
        extinct, quantity, weeks = facts.get((s, p), (False, None, 0))
        value = average or 0.0
        if representative and weeks:
            value = max(0.0, quantity / weeks)
        if (s, p) in values and (s, p) in facts:
            missing = 0.0 if cfg.missing_model == "zero" else value
            value = values[s, p].get(h, missing)
        expected[s, p, h] = 0.0 if extinct else value
    return expected


def random_case(seed):
    rng = random.Random(seed)
    stores = [f"s{i:03d}" for i in range(rng.choice([1, 7, 53]))]
    products = {
        f"p{i:02d}": (rng.choice([None, -1.5, 2.0, 7.25]), rng.random() < 0.5) for i in range(rng.choice([1, 5, 31]))
    }
    pairs = list(itertools.product([*stores, "unknown"], [*products, "unlisted"]))
    stats = []
    for s, p in rng.sample(pairs, rng.randint(0, len(pairs))):
        weeks = rng.choice([0, 0, 1, 3])
        stats.append((s, p, weeks == 0 and rng.random() < 0.5, float(rng.randint(-9, 30)) if weeks else None, weeks))
    overrides = [
        (s, p, h, float(rng.randint(0, 99)))
        for s, p, *_ in rng.sample(stats, len(stats) // 3)
        for h in rng.sample(range(1, 6), rng.randint(1, 5))
    ]
    return stores, products, stats, overrides


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("missing", ["zero", "base"])
def test_grid_against_brute_force(spark, seed, missing):
    cfg = ForecastConfig(store_chunk_size=10, products_per_block=4, missing_model=missing)
    stores, products, stats, overrides = random_case(seed)
    assert predict(spark, cfg, stores, products, stats, overrides) == brute(cfg, stores, products, stats, overrides)


def test_long_store_lists_join_by_block(spark, monkeypatch):
    monkeypatch.setattr(sizes, "BROADCAST_MAX_ROWS", 1)
    cfg = ForecastConfig(store_chunk_size=10, products_per_block=4)
    stores, products, stats, overrides = random_case(2)
    assert predict(spark, cfg, stores, products, stats, overrides) == brute(cfg, stores, products, stats, overrides)


def test_only_the_chunks_asked_for(spark):
    cfg = ForecastConfig(store_chunk_size=2)
    stores = [f"s{i}" for i in range(7)]
    found = predict(spark, cfg, stores, {"p": (1.0, False)}, [], chunks=[1, 3])
    assert sorted({s for s, _, _ in found}) == ["s2", "s3", "s6"]


def test_a_hot_product_known_in_every_store(spark):
    cfg = ForecastConfig(store_chunk_size=50)
    stores = [f"s{i:03d}" for i in range(200)]
    products = {"hot": (1.0, True), "cold": (2.0, False)}
    stats = [(s, "hot", False, float(i), 1) for i, s in enumerate(stores)]
    found = predict(spark, cfg, stores, products, stats)
    assert found == brute(cfg, stores, products, stats)


def test_sales_of_unlisted_products_disturb_nothing(spark, cfg):
    stats = [("a", "p", False, 6.0, 2), ("a", "unlisted", False, 50.0, 1), ("closed", "p", False, 9.0, 1)]
    found = predict(spark, cfg, ["a", "b"], {"p": (4.0, True)}, stats)
    assert found == {(s, "p", h): v for s, v in (("a", 3.0), ("b", 4.0)) for h in range(1, 6)}


def test_an_override_never_revives_an_extinct_pair(spark, cfg):
    stats = [("a", "p", True, None, 0), ("b", "p", False, 4.0, 1)]
    overrides = [(s, "p", h, 9.0) for s in "ab" for h in range(1, 6)]
    found = predict(spark, cfg, ["a", "b"], {"p": (4.0, True)}, stats, overrides)
    assert {found["a", "p", h] for h in range(1, 6)} == {0.0}
    assert {found["b", "p", h] for h in range(1, 6)} == {9.0}


def test_override_rows_round_trip(spark, cfg):
    rows = [("a", "p", 1, 3.0), ("a", "p", 4, 5.0)]
    df = spark.createDataFrame(rows, "store_id string, product_id string, horizon int, prediction double")
    kept = model.overrides_to_rows(model.overrides_from_rows(df, cfg)).collect()
    assert {(r.horizon, r.prediction) for r in kept} == {(1, 3.0), (2, None), (3, None), (4, 5.0), (5, None)}
    zeros = ForecastConfig(missing_model="zero")
    back = model.overrides_to_rows(model.overrides_from_rows(df, zeros)).collect()
    assert {(r.horizon, r.prediction) for r in back} == {(1, 3.0), (2, 0.0), (3, 0.0), (4, 5.0), (5, 0.0)}


def test_many_small_chunks_share_tasks(spark):
    n = 2_000
    stores = spark.range(n).selectExpr("cast(id as string) store_id", "cast(id + 1 as int) store_code", "cast(id as int) store_chunk")
    products = spark.createDataFrame([("p", 1, 2.5)], "product_id string, product_code int, global_avg double")
    facts = spark.createDataFrame(
        [(7, "7", "p", 8, True, None, None)],
        "store_chunk int, store_id string, product_id string, store_code int, extinct boolean, pair_avg double, override array<double>",
    )
    cfg = ForecastConfig(store_chunk_size=1)
    for chunks in (None, list(range(0, n, 2))):
        pairs = grid.forecast_pairs(stores, products, facts, n, 1, cfg, chunks)
        assert pairs.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
        found = {(r.store_chunk, r.store_id, r.base) for r in pairs.collect()}
        assert found == {(i, str(i), 0.0 if i == 7 else 2.5) for i in (chunks or range(n))}
