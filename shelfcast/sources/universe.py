"""The stores and products to forecast for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.config import (
    PRODUCT,
    PRODUCT_MASTER_COLUMN,
    STORE,
    STORE_MASTER_COLUMN,
)
from shelfcast.sources.roles import Roles


def _distinct_ids(
    master: DataFrame | None, transactions: DataFrame, master_column: str, role: str, out: str
) -> DataFrame:
    id_type = transactions.schema[role].dataType
    source, name = transactions, role
    if master is not None:
        found = next((c for c in (master_column, role) if c in master.columns), None)
        if found is not None:
            source, name = master, found
    given_type = source.schema[name].dataType
    if isinstance(given_type, T.StringType) != isinstance(id_type, T.StringType):
        raise ValueError(
            f"{name} is {given_type.simpleString()} in the master table but "
            f"{role} is {id_type.simpleString()} in the transactions; no id could match"
        )
    return source.where(F.col(name).isNotNull()).select(F.col(name).cast(id_type).alias(out)).distinct()


def store_universe(stores: DataFrame | None, transactions: DataFrame, roles: Roles) -> DataFrame:
    return _distinct_ids(stores, transactions, STORE_MASTER_COLUMN, roles.store, STORE)


def product_universe(products: DataFrame | None, transactions: DataFrame, roles: Roles) -> DataFrame:
    return _distinct_ids(products, transactions, PRODUCT_MASTER_COLUMN, roles.product, PRODUCT)
