"""Which column plays which part, decided from the schema alone."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from shelfcast.config import PRODUCT_CANDIDATES, STORE_CANDIDATES

DATE = "transaction_date"
QUANTITY = "quantity"
DISCOUNT = "discount"


@dataclass(frozen=True)
class Roles:
    store: str
    product: str


def _first_present(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    return next((name for name in candidates if name in columns), None)


def detect_roles(transactions: DataFrame) -> Roles:
    store = _first_present(transactions.columns, STORE_CANDIDATES)
    product = _first_present(transactions.columns, PRODUCT_CANDIDATES)
    if store is None or product is None:
        raise ValueError(
            f"no store or product column among {transactions.columns}; "
            f"expected one of {STORE_CANDIDATES} and one of {PRODUCT_CANDIDATES}"
        )
    return Roles(store, product)


def require_columns(transactions: DataFrame, roles: Roles) -> None:
    missing = [c for c in (DATE, roles.store, roles.product, QUANTITY) if c not in transactions.columns]
    if missing:
        raise ValueError(f"transactions lack the columns {missing}")
