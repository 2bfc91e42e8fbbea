from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfcast.config import ForecastConfig  # noqa: E402
from shelfcast.session import local_session  # noqa: E402

SALES_SCHEMA = (
    "internal_store_id string, internal_product_id string, transaction_date date, quantity double, discount double"
)

# Each row is there for a rule: Monday belongs to the week before, a sale exactly
# on the recent cutoff counts, 18 weeks without sale are extinct and 12 are not,
# a return gives a negative average.
GOLDEN_SALES = [
    ("S1", "P1", "2024-01-01", 4.0, 0.10),
    ("S1", "P1", "2024-01-02", 2.0, 0.00),
    ("S1", "P1", "2024-01-08", 3.0, 0.20),
    ("S1", "P1", "2024-04-16", 6.0, 0.00),
    ("S1", "P1", "2024-05-14", 8.0, 0.00),
    ("S1", "P2", "2024-01-09", 5.0, 0.00),
    ("S2", "P1", "2024-05-14", 10.0, 0.50),
    ("S2", "P2", "2024-04-17", 7.0, 0.00),
    ("S2", "P3", "2024-05-15", -2.0, 0.00),
    ("S3", "P2", "2024-02-20", 9.0, 0.00),
]


@pytest.fixture(scope="session")
def spark():
    session = local_session("shelfcast-tests", cpus=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def golden(spark):
    rows = [(s, p, dt.date.fromisoformat(d), q, c) for s, p, d, q, c in GOLDEN_SALES]
    return spark.createDataFrame(rows, SALES_SCHEMA)


@pytest.fixture(scope="session")
def golden_stores(spark):
    return spark.createDataFrame([("S1",), ("S2",), ("S3",)], "pdv string")


@pytest.fixture(scope="session")
def golden_products(spark):
    return spark.createDataFrame([("P1",), ("P2",), ("P3",), ("P4",)], "produto string")


@pytest.fixture(scope="session")
def cfg():
    return ForecastConfig()
