import datetime as dt

import pytest

from shelfcast.config import ForecastConfig
from shelfcast.operators import evaluate, grid, panel, prepare, segments
from shelfcast.sources.roles import detect_roles
from shelfcast.sources.universe import product_universe, store_universe


@pytest.fixture(scope="module")
def prepared(golden):
    return prepare.prepare_transactions(golden)


@pytest.fixture(scope="module")
def weekly(prepared):
    return prepare.weekly_sales(prepared)


def day(text):
    return dt.date.fromisoformat(text)


def test_weekly(weekly):
    found = {
        (r.store_id, r.product_id, str(r.week_start)): (
            r.quantity, r.trans_count, round(r.discount_mean, 6), r.discount_max,
        )
        for r in weekly.collect()
    }
    assert found == {
        ("S1", "P1", "2023-12-26"): (4, 1, 0.10, 0.10),
        ("S1", "P1", "2024-01-02"): (5, 2, 0.10, 0.20),
        ("S1", "P1", "2024-04-16"): (6, 1, 0, 0),
        ("S1", "P1", "2024-05-14"): (8, 1, 0, 0),
        ("S1", "P2", "2024-01-09"): (5, 1, 0, 0),
        ("S2", "P1", "2024-05-14"): (10, 1, 0.5, 0.5),
        ("S2", "P2", "2024-04-16"): (7, 1, 0, 0),
        ("S2", "P3", "2024-05-14"): (-2, 1, 0, 0),
        ("S3", "P2", "2024-02-20"): (9, 1, 0, 0),
    }


@pytest.mark.parametrize("source", ["prepared", "weekly"])
def test_segments_from_transactions_or_weeks(source, request, prepared, weekly):
    rows = {"prepared": prepared, "weekly": weekly}[source]
    stats = segments.pair_stats(rows)
    by_pair = {(r.store_id, r.product_id): r for r in stats.collect()}
    assert {k: r.weeks_since_sale for k, r in by_pair.items()} == {
        ("S1", "P1"): 0, ("S1", "P2"): 18, ("S2", "P1"): 0, ("S2", "P2"): 4, ("S2", "P3"): 0, ("S3", "P2"): 12,
    }
    assert [k for k, r in by_pair.items() if r.extinct] == [("S1", "P2")]
    assert [tuple(r) for r in segments.extinct_pairs(stats).collect()] == [("S1", "P2")]
    assert {(r[0], r[1]): r[2] for r in segments.recent_pair_average(stats).collect()} == {
        ("S1", "P1"): 7.0, ("S2", "P1"): 10.0, ("S2", "P2"): 7.0, ("S2", "P3"): -2.0,
    }
    assert {r.product_id: (r.total_sales, r.global_avg) for r in segments.product_stats(stats).collect()} == {
        "P1": (33.0, 8.0), "P2": (21.0, 7.0), "P3": (-2.0, -2.0),
    }


def base(spark, golden, prepared, golden_stores, golden_products, cfg):
    roles = detect_roles(golden)
    stores = grid.chunk_stores(store_universe(golden_stores, golden, roles), cfg)
    representative = spark.createDataFrame([("P1",)], "product_id string")
    stats = segments.pair_stats(prepared, cfg)
    products = grid.product_facts(
        product_universe(golden_products, golden, roles), segments.product_stats(stats), representative
    )
    facts = grid.pair_facts(stats, stores, products, None, 3, 4, cfg)
    return grid.forecast(grid.forecast_pairs(stores, products, facts, 3, 4, cfg), cfg)


EXPECTED_BASE = {
    "S1": (7, 0, -2, 0),
    "S2": (10, 7, -2, 0),
    "S3": (8, 7, -2, 0),
}


@pytest.mark.parametrize("chunk_size", [200, 2, 1])
def test_base_forecast(spark, golden, prepared, golden_stores, golden_products, chunk_size):
    cfg = ForecastConfig(store_chunk_size=chunk_size)
    rows = base(spark, golden, prepared, golden_stores, golden_products, cfg).collect()
    assert len(rows) == 60
    found = {(r.store_id, r.product_id, r.horizon): r.prediction for r in rows}
    expected = {
        (s, f"P{i + 1}", h): float(v)
        for s, values in EXPECTED_BASE.items()
        for i, v in enumerate(values)
        for h in range(1, 6)
    }
    assert found == expected


def test_clipped_base(spark, golden, prepared, golden_stores, golden_products):
    rows = base(spark, golden, prepared, golden_stores, golden_products, ForecastConfig(clip_base=True)).collect()
    assert {r.prediction for r in rows if r.product_id == "P3"} == {0.0}


def test_features_step_by_observed_weeks(weekly, prepared, cfg):
    pairs = segments.top_pairs(segments.pair_stats(prepared), prepared, cfg)
    rows = panel.feature_panel(weekly, pairs, cfg).where("store_id = 'S1' and product_id = 'P1'")
    found = [
        (str(r.week_start), r.quantity, r.time_idx, r.qty_lag_1, r.qty_lag_2, r.qty_4w_sum, r.qty_12w_mean,
         r.target_h1, r.is_last)
        for r in rows.orderBy("week_start").collect()
    ]
    assert found == [
        ("2023-12-26", 4, 0, 0, 0, 4, 4.0, 5, False),
        ("2024-01-02", 5, 1, 4, 0, 9, 4.5, 6, False),
        ("2024-04-16", 6, 16, 5, 4, 15, 5.0, 8, False),
        ("2024-05-14", 8, 20, 6, 5, 23, 5.75, None, True),
    ]


def test_naive_backtest(weekly, cfg):
    found = [(r.horizon, r.wmape and round(r.wmape, 6), r.n) for r in evaluate.backtest(weekly, cfg).collect()]
    assert found == [(1, 0.289474, 3), (2, 0.392857, 2), (3, 0.5, 1), (4, None, 0), (5, None, 0)]


def brute_origin(rows, origins):
    """Forecasts from the weeks up to each origin, with every selling product in the sample."""
    error, volume, n = {}, {}, {}
    for origin in origins:
        known = [r for r in rows if r[2] <= origin]
        at = max(r[2] for r in known)
        near = [r for r in known if (at - r[2]).days <= 28]
        totals = {p: sum(q for _, k, _, q in known if k == p) for _, p, _, _ in known}
        for s, p, w, q in rows:
            h = (w - origin).days // 7
            if not 1 <= h <= 5:
                continue
            pair = [r for r in known if r[:2] == (s, p)]
            own, every = [r[3] for r in near if r[:2] == (s, p)], [r[3] for r in near if r[1] == p]
            value = sum(every) / len(every) if every else 0.0
            if own and totals[p] > 0:
                value = max(0.0, sum(own) / len(own))
            if s not in {r[0] for r in known} or (pair and (at - max(r[2] for r in pair)).days // 7 > 12):
                value = 0.0
            error[h] = error.get(h, 0.0) + abs(q - value)
            volume[h] = volume.get(h, 0.0) + abs(q)
            n[h] = n.get(h, 0) + 1
    return sorted((h, round(error[h] / (volume[h] + 1e-8), 9), n[h]) for h in n)


def test_rolling_origin(weekly):
    rows = [(r.store_id, r.product_id, r.week_start, r.quantity) for r in weekly.collect()]
    first = min(r[2] for r in rows)
    origins = [first + dt.timedelta(weeks=k) for k in (0, 1, 15, 17)]
    cfg = ForecastConfig(product_sample_rate=1.0)
    found = sorted((r.horizon, round(r.wmape, 9), r.n) for r in evaluate.rolling_origin(weekly, origins, cfg).collect())
    assert found == brute_origin(rows, origins) and len(found) > 2


def test_rolling_origin_with_models(spark):
    # Two stores that sell a product at different levels: its average is wrong for both.
    rows = [(s, f"p{i}", dt.date(2024, 1, 2) + dt.timedelta(weeks=w), float(10 * i * k), 1, 0.0, 0.0) for i in range(1, 5) for s, k in (("s", 1), ("t", 5)) for w in range(45)]
    weekly = spark.createDataFrame(rows, "store_id string, product_id string, week_start date, quantity double, trans_count bigint, discount_mean double, discount_max double")
    cfg = ForecastConfig(horizons=(1, 2), boost_rounds=30, early_stop_rounds=30, num_leaves=8, min_leaf_rows=3, learning_rate=0.5, product_sample_rate=0.0)
    origins = [dt.date(2024, 1, 2) + dt.timedelta(weeks=k) for k in (38, 42)]
    base, models = ({r.horizon: (r.wmape, r.n) for r in evaluate.rolling_origin(weekly, origins, cfg, use).collect()} for use in (False, True))
    assert {h: n for h, (_, n) in models.items()} == {1: 16, 2: 16}
    assert all(models[h][0] < 0.1 < 0.5 < base[h][0] for h in (1, 2)), (models, base)
