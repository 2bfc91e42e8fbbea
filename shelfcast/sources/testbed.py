"""The benchmark tables seen as a retail feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier as store, brand as product."""
    sales = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return sales.join(parts, sales.l_partkey == parts.p_partkey).select(
        F.col("l_suppkey").alias("store_id"),
        F.col("p_brand").alias("product_id"),
        F.col("l_shipdate").alias("transaction_date"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pdv"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("produto"))


def dense_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation as store, part type as product: few pairs with long histories."""
    sales = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return (
        sales.join(parts, sales.l_partkey == parts.p_partkey)
        .join(orders, sales.l_orderkey == orders.o_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .select(
            F.col("c_nationkey").alias("store_id"),
            F.col("p_type").alias("product_id"),
            F.col("l_shipdate").alias("transaction_date"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_discount").alias("discount"),
        )
    )
