import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.config import ForecastConfig
from shelfcast.functions.calendar import week_start, whole_weeks
from shelfcast.functions.numbers import finite_or_zero, whole_quantity
from shelfcast.functions.parsing import lenient_date, lenient_number
from shelfcast.operators.prepare import prepare_transactions, reading_counts, weekly_sales
from shelfcast.sources.roles import detect_roles
from shelfcast.sources.universe import product_universe, store_universe


def one_column(spark, values, dtype, expression):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    column = expression(F.col("x"), df.schema["x"].dataType)
    return [r[0] for r in df.select(column.alias("y")).collect()]


def test_weeks_begin_on_tuesday_every_day_of_forty_years(spark):
    days = pd.date_range("1990-01-01", "2029-12-31")
    expected = days.to_period("W-MON").start_time.date
    df = spark.range(len(days)).select(
        F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("d")
    )
    found = {r.d: r.w for r in df.select("d", week_start(F.col("d")).alias("w")).collect()}
    assert found == dict(zip(days.date, expected))


def test_monday_anchor(spark):
    df = spark.sql("select date'2024-01-08' d, date'2024-01-14' e")
    row = df.select(week_start(F.col("d"), "monday"), week_start(F.col("e"), "monday")).first()
    assert row[0] == row[1] == dt.date(2024, 1, 8)


def test_whole_weeks_rounds_down(spark):
    df = spark.sql("select date'2024-03-26' a, date'2024-01-02' b, date'2024-01-03' c")
    assert tuple(df.select(whole_weeks(F.col("a"), F.col("b")), whole_weeks(F.col("a"), F.col("c"))).first()) == (12, 11)


def test_dates_from_text(spark):
    values = ["2024-01-02", "2024-01-02 23:59:59", "2024-01-02T10:00:00", "nonsense", "2024-02-30", "", None]
    day = dt.date(2024, 1, 2)
    assert one_column(spark, values, "string", lenient_date) == [day, day, day, None, None, None, None]


def test_dates_in_a_given_format(spark):
    parse = lambda c, t: lenient_date(c, t, ("dd/MM/yyyy",))
    assert one_column(spark, ["02/01/2024", "2024-01-03"], "string", parse) == [
        dt.date(2024, 1, 2),
        dt.date(2024, 1, 3),
    ]


def test_dates_from_epoch_nanoseconds(spark):
    stamps = ["2024-01-02 23:59:59.999999999", "1969-12-31 12:00:00", "1970-01-01"]
    values = [pd.Timestamp(s).value for s in stamps]
    expected = [pd.Timestamp(s).date() for s in stamps]
    assert one_column(spark, values, "bigint", lenient_date) == expected


def test_numbers_from_text(spark):
    values = ["1.5", " 2 ", "1e3", "-4", "abc", "12d", "3f", "", "nan", None]
    expected = pd.to_numeric(pd.Series(values), errors="coerce").fillna(0).tolist()
    assert one_column(spark, values, "string", lenient_number) == expected


def test_numbers_that_are_not_numbers(spark):
    assert one_column(spark, [1.0, float("nan"), None], "double", lenient_number) == [1.0, 0.0, 0.0]
    assert one_column(spark, [3, None], "int", lenient_number) == [3.0, 0.0]


def test_rounding_to_whole_quantities(spark):
    values = [0.4, 0.5, 1.5, 2.5, -0.5, -2.0, None, float("nan")]
    assert one_column(spark, values, "double", lambda c, t: whole_quantity(c)) == [0, 1, 2, 3, 0, 0, 0, 0]


def test_finite_guard(spark):
    values = [1.0, -1.0, None, float("nan"), float("inf"), float("-inf")]
    assert one_column(spark, values, "double", lambda c, t: finite_or_zero(c)) == [1.0, 0, 0, 0, 0, 0]


def test_unusable_rows_are_left_out_and_counted(spark):
    rows = [
        ("a", 1, "2024-01-02", "5"),
        ("a", 1, "2024-01-02", "many"),
        ("a", 1, "someday", "5"),
        (None, 1, "2024-01-02", "5"),
        ("a", None, "2024-01-02", "5"),
    ]
    df = spark.createDataFrame(rows, "pdv_id string, sku int, transaction_date string, quantity string")
    prepared = prepare_transactions(df)
    assert sorted(r.quantity for r in prepared.collect()) == [0.0, 5.0]
    assert {r.discount for r in prepared.collect()} == {0.0}
    assert tuple(reading_counts(df, weekly_sales(prepared)).first()) == (5, 3)


def test_roles_take_the_first_candidate(spark):
    df = spark.createDataFrame([], "sku int, produto int, pdv int, store_id int")
    roles = detect_roles(df)
    assert (roles.store, roles.product) == ("store_id", "produto")
    with pytest.raises(ValueError, match="no store or product"):
        detect_roles(spark.createDataFrame([], "a int, sku int"))


@pytest.mark.parametrize("missing", ["transaction_date", "quantity"])
def test_required_columns(spark, golden, missing):
    with pytest.raises(ValueError, match=missing):
        prepare_transactions(golden.drop(missing))


def test_universe_precedence(spark, golden):
    roles = detect_roles(golden)
    both = spark.createDataFrame([("S9", "S8"), (None, "S7"), ("S9", "S6")], "pdv string, internal_store_id string")
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(store_universe(both, golden, roles)) == ["S9"]
    assert ids(store_universe(both.drop("pdv"), golden, roles)) == ["S6", "S7", "S8"]
    other = spark.createDataFrame([("x",)], "name string")
    assert ids(store_universe(other, golden, roles)) == ["S1", "S2", "S3"]
    assert ids(store_universe(None, golden, roles)) == ["S1", "S2", "S3"]
    assert ids(product_universe(None, golden, roles)) == ["P1", "P2", "P3"]


def test_universe_of_another_type(spark, golden):
    roles = detect_roles(golden)
    with pytest.raises(ValueError, match="no id could match"):
        store_universe(spark.createDataFrame([(1,)], "pdv int"), golden, roles)
    numbered = spark.createDataFrame([], "pdv bigint, sku bigint, transaction_date date, quantity double")
    narrow = store_universe(spark.createDataFrame([(1,)], "pdv int"), numbered, detect_roles(numbered))
    assert narrow.schema["store_id"].dataType.simpleString() == "bigint"


def test_config_rejects_nonsense():
    with pytest.raises(ValueError):
        ForecastConfig(week_anchor="friday")
    with pytest.raises(ValueError):
        ForecastConfig(missing_model="maybe")
    with pytest.raises(ValueError):
        ForecastConfig(horizons=(2, 4))
    assert ForecastConfig().fingerprint("a") == ForecastConfig().fingerprint("a") != ForecastConfig().fingerprint("b")
    assert np.isclose(ForecastConfig().product_sample_rate, 0.2)
