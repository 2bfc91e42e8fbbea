"""Facts about pairs and products: last sale, recent averages, samples, top pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.config import PAIR, PRODUCT, ForecastConfig
from shelfcast.functions.calendar import whole_weeks
from shelfcast.operators.prepare import weekly_sales
from shelfcast.operators.ranking import sample_fraction, top_rows

# Weeks that one number can mark.
MOST_BITS = 60


def latest_week(rows: DataFrame) -> Column:
    """The last week of the whole table, as a scalar subquery.

    Of weekly sales it takes the quantity along, though it isn't needed: so the subquery aggregates the same columns as
    `pair_stats` and Spark reuses its shuffle, in place of a second scan.
    """
    if "trans_count" in rows.columns:
        return rows.agg(F.max(F.struct("week_start", "quantity"))["week_start"]).scalar()
    return rows.agg(F.max("week_start")).scalar()


def pair_stats(rows: DataFrame, cfg: ForecastConfig = ForecastConfig()) -> DataFrame:
    """Everything known about a pair, in one aggregation.

    ``rows`` may be prepared transactions or weekly sales: sums and maxima come
    out the same. Weekly rows are counted as they are; for transactions the recent weeks are
    bits set, so that several in one week count once, and more weeks than a number has bits are summed by week first.
    Reading transactions saves the weekly shuffle; reading a written weekly table saves the wide scan.

    The recent mean is ``recent_quantity / recent_weeks``: a mean over weeks
    with a sale, from ``recent_weeks`` weeks before the last week on, inclusive.
    """
    if "trans_count" not in rows.columns and cfg.recent_weeks > MOST_BITS:
        rows = weekly_sales(rows)
    rows = rows.withColumn("_max_week", latest_week(rows))
    age = (F.datediff("_max_week", "week_start") / F.lit(7)).cast("int")
    recent = age <= cfg.recent_weeks
    if "trans_count" in rows.columns:
        weeks_sold = F.count_if(recent)
    else:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), age)
        weeks_sold = F.bit_count(F.coalesce(F.bit_or(F.when(recent, bit)), F.lit(0)))
    stats = rows.groupBy(*PAIR).agg(
        F.min("week_start").alias("first_week"),
        F.max("week_start").alias("last_week"),
        F.sum("quantity").alias("total_sales"),
        F.sum(F.when(recent, F.col("quantity"))).alias("recent_quantity"),
        weeks_sold.cast("bigint").alias("recent_weeks"),
        F.max("_max_week").alias("max_week"),
    )
    weeks = whole_weeks(F.col("max_week"), F.col("last_week"))
    return stats.withColumn("weeks_since_sale", weeks).withColumn(
        "extinct", F.col("weeks_since_sale") > cfg.extinct_weeks
    )


def extinct_pairs(stats: DataFrame) -> DataFrame:
    return stats.where("extinct").select(*PAIR)


def recent_pair_average(stats: DataFrame) -> DataFrame:
    return stats.where("recent_weeks > 0").select(
        *PAIR, (F.col("recent_quantity") / F.col("recent_weeks")).alias("pair_avg")
    )


def product_stats(stats: DataFrame) -> DataFrame:
    """Total and recent mean per product, from the pair facts.

    The mean weighs every (store, week) row alike, hence the sums, not a mean of means.
    """
    sums = stats.groupBy(PRODUCT).agg(
        F.sum("total_sales").alias("total_sales"),
        F.sum("recent_quantity").alias("_quantity"),
        F.sum("recent_weeks").alias("_weeks"),
    )
    return sums.select(
        PRODUCT,
        "total_sales",
        F.when(F.col("_weeks") > 0, F.col("_quantity") / F.col("_weeks")).alias("global_avg"),
    )


def representative_products(products: DataFrame, cfg: ForecastConfig = ForecastConfig()) -> DataFrame:
    """The sample of selling products whose stores get their own recent average."""
    selling = products.where("total_sales > 0").select(PRODUCT)
    return sample_fraction(selling, PRODUCT, cfg.product_sample_rate, cfg.seed)


def distinct_weeks(rows: DataFrame) -> DataFrame:
    return rows.agg(F.countDistinct("week_start").alias("n_weeks"))


def top_pairs(stats: DataFrame, rows: DataFrame, cfg: ForecastConfig = ForecastConfig()) -> DataFrame:
    """The best selling pairs, fewer if their panel would exceed the row cap.

    Ties go to the smaller ids. Extinct pairs are still among them; they are cut
    afterwards (`active_pairs`), so that fewer than ``top_pairs`` may remain.
    """
    n_pairs = stats.count()
    wanted = min(n_pairs, cfg.top_pairs)
    n_weeks = distinct_weeks(rows).first()[0]
    if wanted * n_weeks > cfg.max_panel_rows:
        wanted = min(wanted, max(cfg.max_panel_rows // max(n_weeks, 1), cfg.min_capped_pairs))
    return top_rows(stats, "total_sales", PAIR, n_pairs, wanted)


def active_pairs(pairs: DataFrame, extinct: DataFrame | None = None) -> DataFrame:
    """Pairs that still sell; by their own flag, or against a given list of extinct pairs."""
    if extinct is None:
        return pairs.where(~F.col("extinct"))
    return pairs.join(extinct.select(*PAIR), PAIR, "left_anti")
