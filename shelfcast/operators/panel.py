"""The feature panel of chosen pairs, and the naive forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from shelfcast.config import LAGS, PAIR, PRODUCT, STORE, ForecastConfig


def by_pair() -> WindowSpec:
    """A pair's history. Steps are observed weeks, not calendar weeks: gaps are not filled."""
    return Window.partitionBy(*PAIR).orderBy("week_start")


def panel_rows(weekly: DataFrame, pairs: DataFrame) -> DataFrame:
    """Weekly rows of the chosen pairs, with ``time_idx`` in weeks since the panel's first."""
    start = pairs.agg(F.min("first_week")).scalar()
    rows = weekly.join(pairs.select(*PAIR), PAIR).withColumn("_start", start)
    weeks = F.datediff("week_start", "_start") / F.lit(7)
    return rows.withColumn("time_idx", weeks.cast("int")).drop("_start")


def add_totals(panel: DataFrame) -> DataFrame:
    """Weekly totals of the store and of the product, inside the panel.

    They are summed in parts before the shuffle and joined back, so that no task
    holds all rows of a hot week.
    """
    for key, name in ((STORE, "store_week_total"), (PRODUCT, "product_global_week")):
        totals = panel.groupBy(key, "time_idx").agg(F.sum("quantity").alias(name))
        panel = panel.join(totals, [key, "time_idx"])
    return panel


def add_history(panel: DataFrame) -> DataFrame:
    """Lags, rolling sum and mean. A pair has at most one row per week, so windows stay small."""
    lags = {
        f"qty_lag_{k}": F.coalesce(F.lag("quantity", k).over(by_pair()), F.lit(0.0)) for k in LAGS
    }
    rolling = {
        "qty_4w_sum": F.coalesce(F.sum("quantity").over(by_pair().rowsBetween(-3, 0)), F.lit(0.0)),
        "qty_12w_mean": F.coalesce(F.avg("quantity").over(by_pair().rowsBetween(-11, 0)), F.lit(0.0)),
    }
    return panel.withColumns({**lags, **rolling})


def add_targets(rows: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """The quantity ``h`` observed weeks ahead, null at the end of a pair's history."""
    return rows.withColumns({f"target_h{h}": F.lead("quantity", h).over(by_pair()) for h in horizons})


def add_last_flag(panel: DataFrame) -> DataFrame:
    """Mark each pair's own last row; shares the window of the other columns."""
    return panel.withColumn("is_last", F.lead("week_start", 1).over(by_pair()).isNull())


def feature_panel(weekly: DataFrame, pairs: DataFrame, cfg: ForecastConfig = ForecastConfig()) -> DataFrame:
    # Totals first: their shuffles carry narrow rows, and all pair windows share the last one.
    panel = add_totals(panel_rows(weekly, pairs))
    panel = add_last_flag(add_targets(add_history(panel), cfg.horizons))
    if cfg.strict_split:
        times = {f"target_time_h{h}": F.lead("time_idx", h).over(by_pair()) for h in cfg.horizons}
        panel = panel.withColumns(times)
    return panel


def last_points(panel: DataFrame) -> DataFrame:
    return panel.where("is_last").drop("is_last")


def naive_forecast(weekly: DataFrame) -> DataFrame:
    """Mean of the last four observed weeks, the current one included."""
    return weekly.withColumn("pred_naive", F.avg("quantity").over(by_pair().rowsBetween(-3, 0)))
