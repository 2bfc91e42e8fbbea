"""The integer-coded layout of the export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.config import EXPORT_COLUMNS, PRODUCT, STORE
from shelfcast.functions.numbers import whole_quantity
from shelfcast.operators.ranking import dense_codes
from shelfcast.operators.sizes import broadcast_if_small

PDV, PRODUTO, SEMANA, QUANTIDADE = EXPORT_COLUMNS


def store_codes(stores: DataFrame) -> DataFrame:
    return dense_codes(stores.select(STORE), STORE, PDV)


def product_codes(products: DataFrame) -> DataFrame:
    return dense_codes(products.select(PRODUCT), PRODUCT, PRODUTO)


def coded_layout(predictions: DataFrame) -> DataFrame:
    """pdv, produto, semana, quantidade (and store_chunk, where present) of rows that carry their codes."""
    kept = [c for c in ("store_chunk",) if c in predictions.columns]
    return predictions.select(
        *kept,
        F.col("store_code").cast("bigint").alias(PDV),
        F.col("product_code").cast("bigint").alias(PRODUTO),
        F.col("horizon").cast("smallint").alias(SEMANA),
        whole_quantity(F.col("prediction")).alias(QUANTIDADE),
    )


def export_layout(
    predictions: DataFrame,
    stores: DataFrame,
    products: DataFrame,
    n_stores: int,
    n_products: int,
) -> DataFrame:
    """The layout of predictions that hold ids only.

    Code maps whose counted size allows it are broadcast, so that the
    predictions are coded in place; larger ones are left to the planner.
    """
    by_store = stores.select(STORE, F.col(PDV).alias("store_code"))
    by_product = products.select(PRODUCT, F.col(PRODUTO).alias("product_code"))
    ids = predictions.drop("store_code", "product_code")
    return coded_layout(ids.join(broadcast_if_small(by_store, n_stores), STORE).join(broadcast_if_small(by_product, n_products), PRODUCT))


def head(coded: DataFrame, rows: int) -> DataFrame:
    """The first rows by (pdv, produto, semana), which is a total order.

    Key by key: the running sum of a key's counts shows the value at which the limit is reached; smaller ones
    are in, and only the rows of that value are looked at by the next key. No task holds all first rows.
    """
    coded = coded.select(*EXPORT_COLUMNS)
    order = (PDV, PRODUTO, SEMANA)
    inside, at, left = F.lit(False), F.lit(True), rows
    for key in order:
        sums = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)  # one row for each value of a key
        counts = coded.where(at).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        reached = counts.select(key, "n", F.sum("n").over(sums).alias("upto")).where(F.col("upto") > left).orderBy(key).first()
        if reached is None:
            return coded.where(inside | at)
        inside = inside | (at & (F.col(key) < reached[key]))
        at = at & (F.col(key) == reached[key])
        left -= reached["upto"] - reached["n"]
    return coded.where(inside)


def fitting_prefix(chunk_bytes: DataFrame, cap_bytes: int) -> DataFrame:
    """store_chunk, bytes, total_bytes of the longest prefix of chunks within the cap.

    The first chunk stays even if it alone is too large. One row per chunk of
    stores comes in, so the unpartitioned window is small.
    """
    order = Window.orderBy("store_chunk")
    total = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    position = F.row_number().over(order)
    return (
        chunk_bytes.select("store_chunk", "bytes", total.alias("total_bytes"), position.alias("_n"))
        .where((F.col("total_bytes") <= cap_bytes) | (F.col("_n") == 1))
        .drop("_n")
    )
