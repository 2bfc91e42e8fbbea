"""Forecast quality per horizon."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.config import PAIR, PRODUCT, STORE, ForecastConfig
from shelfcast.functions.numbers import wmape
from shelfcast.operators import grid, model, panel, segments
from shelfcast.operators.panel import add_targets, naive_forecast
from shelfcast.session import new_scratch
from shelfcast.sources.storage import stage_table


def wmape_by_horizon(rows: DataFrame, pairs: dict[int, tuple[str, str]]) -> DataFrame:
    """horizon, wmape, n for each horizon's (actual, predicted) columns.

    All horizons are one aggregate over unreplicated rows; only the single
    result row is turned into one row per horizon, so an empty horizon stays.
    """
    aggregates = []
    for h, (actual, predicted) in pairs.items():
        both = F.col(actual).isNotNull() & F.col(predicted).isNotNull()
        aggregates += [
            wmape(F.col(actual), F.col(predicted)).alias(f"wmape_{h}"),
            F.count_if(both).alias(f"n_{h}"),
        ]
    rows_per_horizon = F.array(
        *[
            F.struct(
                F.lit(h).cast("int").alias("horizon"),
                F.col(f"wmape_{h}").alias("wmape"),
                F.col(f"n_{h}").alias("n"),
            )
            for h in pairs
        ]
    )
    return rows.agg(*aggregates).select(F.inline(rows_per_horizon))


def backtest(weekly: DataFrame, cfg: ForecastConfig = ForecastConfig()) -> DataFrame:
    """WMAPE of the naive forecast against the observed weeks that followed."""
    rows = add_targets(naive_forecast(weekly), cfg.horizons)
    return wmape_by_horizon(rows, {h: (f"target_h{h}", "pred_naive") for h in cfg.horizons})


def rolling_origin(
    weekly: DataFrame, origins: Sequence[dt.date], cfg: ForecastConfig = ForecastConfig(), use_model: bool = False
) -> DataFrame:
    """horizon, wmape, n of the forecast itself, made at each origin from the weeks up to it.

    At an origin (a week's first day) stores, products, averages, the sample, extinct pairs and, if asked for, the models
    are those that were known then; the sales of the calendar weeks 1 to ``max(horizons)`` after it are looked up in
    that forecast. A pair whose store or product is new was forecast by nothing: 0. One pass over the weekly table for each origin.
    """
    spark = weekly.sparkSession
    steps = (F.datediff("week_start", "_origin") / F.lit(7)).cast("int")
    scored = None
    for origin in origins:
        known = weekly.where(F.col("week_start") <= F.lit(origin))
        stats = stage_table(spark, new_scratch(spark, "origin-pairs"), lambda: segments.pair_stats(known, cfg))
        by_product = segments.product_stats(stats)
        chosen = segments.representative_products(by_product, cfg)
        stores = stage_table(spark, new_scratch(spark, "origin-stores"), lambda: grid.chunk_stores(stats.select(STORE).distinct(), cfg))
        products = stage_table(
            spark, new_scratch(spark, "origin-products"), lambda: grid.product_facts(stats.select(PRODUCT).distinct(), by_product, chosen)
        )
        overrides = None
        if use_model:
            active = segments.active_pairs(segments.top_pairs(stats, known, cfg))
            rows = panel.feature_panel(known, segments.active_pairs(stats), cfg)
            rows = stage_table(spark, new_scratch(spark, "origin-panel"), lambda: rows)
            overrides = model.score_last_points(rows, model.train_models(rows, cfg, active)[0], cfg)
        facts = grid.pair_facts(stats, stores, products, overrides, stores.count(), products.count(), cfg)
        later = weekly.withColumn("_origin", F.lit(origin)).withColumn("horizon", steps)
        later = later.where(F.col("horizon").between(1, max(cfg.horizons))).select(*PAIR, "horizon", "quantity")
        made = grid.forecast(grid.asked_pairs(later.select(*PAIR).distinct(), stores, products, facts, cfg), cfg)
        pairs = later.join(made.select(*PAIR, "horizon", "prediction"), [*PAIR, "horizon"], "left")
        pairs = pairs.select("horizon", "quantity", F.coalesce("prediction", F.lit(0.0)).alias("prediction"))
        scored = pairs if scored is None else scored.unionByName(pairs)
    return scored.groupBy("horizon").agg(
        wmape(F.col("quantity"), F.col("prediction")).alias("wmape"), F.count(F.lit(1)).alias("n")
    )
