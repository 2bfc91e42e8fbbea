"""From raw transactions to weekly sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.config import PAIR, PRODUCT, STORE, ForecastConfig
from shelfcast.functions.calendar import week_start
from shelfcast.functions.parsing import lenient_date, lenient_number
from shelfcast.sources.roles import (
    DATE,
    DISCOUNT,
    QUANTITY,
    Roles,
    detect_roles,
    require_columns,
)


def prepare_transactions(
    transactions: DataFrame, cfg: ForecastConfig = ForecastConfig(), roles: Roles | None = None
) -> DataFrame:
    """store_id, product_id, week_start, quantity, discount; one row per readable transaction.

    A narrow projection: the scan reads five columns and nothing is shuffled.
    Rows without a store, product or readable date are left out.
    """
    roles = roles or detect_roles(transactions)
    require_columns(transactions, roles)
    types = {f.name: f.dataType for f in transactions.schema}
    day = lenient_date(F.col(DATE), types[DATE], cfg.date_formats)
    if DISCOUNT in types:
        discount = lenient_number(F.col(DISCOUNT), types[DISCOUNT])
    else:
        discount = F.lit(0.0)
    usable = F.col(roles.store).isNotNull() & F.col(roles.product).isNotNull()
    return transactions.where(usable).select(
        F.col(roles.store).alias(STORE),
        F.col(roles.product).alias(PRODUCT),
        week_start(day, cfg.week_anchor).alias("week_start"),
        lenient_number(F.col(QUANTITY), types[QUANTITY]).alias("quantity"),
        discount.alias("discount"),
    ).where("week_start is not null")


def weekly_sales(prepared: DataFrame) -> DataFrame:
    """Sales per store, product and week; only weeks with a transaction exist.

    Partial aggregation runs before the shuffle, so a pair that holds a large
    share of all transactions still sends one row per week and task.
    """
    return prepared.groupBy(*PAIR, "week_start").agg(
        F.sum("quantity").alias("quantity"),
        F.count("quantity").alias("trans_count"),
        F.coalesce(F.avg("discount"), F.lit(0.0)).alias("discount_mean"),
        F.coalesce(F.max("discount"), F.lit(0.0)).alias("discount_max"),
    )


def reading_counts(read: DataFrame | Column, weekly: DataFrame) -> DataFrame:
    """One row: transactions read, and those left out for want of a key or a date.

    The first number is given, or comes from file footers; the second comes from the weekly counts.
    No column of the transactions is read again.
    """
    n_read = read.agg(F.count(F.lit(1))).scalar() if isinstance(read, DataFrame) else read
    used = weekly.agg(F.coalesce(F.sum("trans_count"), F.lit(0))).scalar()
    counts = weekly.sparkSession.range(1).select(n_read.cast("bigint").alias("transactions_read"), used.alias("_used"))
    return counts.select(
        "transactions_read", (F.col("transactions_read") - F.col("_used")).alias("transactions_left_out")
    )
