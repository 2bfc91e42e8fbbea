"""Every named query against its SQL counterpart, and the plans they run as."""

from __future__ import annotations

import re

import pytest
from oracle_check import compare, duckdb_views

import __spark_entry__ as driver
from shelfcast.plans.catalogue import Feed

SF = "/root/testdata/sf0.001"
ORACLE = driver.oracle_sql()
WRITES_FILES = {"full_run", "full_run_csv", "metrics_csv", "resume_pending", "resumed_run", "export_files", "export_head_file", "full_run_dense", "asked_forecast", "rerun_other_input", "refreshed_run", "refreshed_chunks", "export_replaced", "export_row_groups", "export_capped_prefix", "chunk_files"}
#: Trees and footers are read by numpy and Arrow inside tasks.
IN_ARROW = {"scored_last_points"}
ROWS_ONLY = {"export_files_capped", "model_forecast"}
OWN = set(driver.catalogue.queries())


@pytest.fixture(scope="module")
def con():
    return duckdb_views(SF)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_a_counterpart_or_a_reason():
    assert OWN - set(ORACLE) == ROWS_ONLY
    assert set(ORACLE) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(OWN & set(ORACLE)))
def test_query_equals_sql(spark, con, name):
    df = driver.queries()[name](spark, SF)
    result = compare(con, df, ORACLE[name])
    assert result["columns"] and result["types"] and result["values"], result
    if name not in WRITES_FILES:
        plan = plan_of(df)
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert name in IN_ARROW or ("Python" not in plan and "Pandas" not in plan)


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["store_id", "product_id", "horizon", "prediction"]
    assert df.count() == 10 * 25 * 5


def test_the_scan_reads_what_is_needed(spark):
    plan = plan_of(Feed(spark, SF).weekly)
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "lineitem" in line)
    columns = re.search(r"ReadSchema: struct<(.*?)>", plan[plan.index("lineitem.parquet"):]).group(1)
    assert "l_extendedprice" not in columns and "l_orderkey" not in columns
    assert "IsNotNull(l_suppkey)" in scan


SEGMENTS = (
    "pair_last_sale extinct_pairs recent_product_avg recent_pair_avg product_totals representative_products "
    "distinct_weeks top_pairs top_pairs_capped top_pairs_active panel_totals"
).split()


@pytest.mark.parametrize("name", SEGMENTS)
def test_segment_queries_read_the_transactions_at_most_once(spark, name):
    """Besides what was written before: none, or the one scan of a query that writes nothing; a shuffle that
    a scalar shares counts as it ran, so the plan is read when it has run."""
    df = driver.queries()[name](spark, SF)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final
    assert scans(final) <= 1


def scans(final: str) -> int:
    return sum("FileScan" in line and "l_suppkey" in line for line in final.splitlines())


def test_weekly_sales_shuffle_once_after_partial_aggregation(spark):
    plan = plan_of(Feed(spark, SF).weekly)
    shuffles = [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning", line)]
    assert len(shuffles) == 1 and "partial_sum" in plan


def test_all_pair_windows_share_a_sort(spark):
    plan = plan_of(Feed(spark, SF).panel)
    sorts = [line for line in plan.splitlines() if "+- Sort" in line and "week_start" in line]
    assert len(sorts) == 1 and "lag(" in plan and "lead(" in plan


def test_the_export_has_no_join_above_the_unfolded_grid(spark):
    plan = plan_of(Feed(spark, SF).coded())
    assert "Join" not in plan[: plan.index("Generate inline")]


def test_nothing_is_exchanged_once_the_grid_is_unfolded(spark):
    plan = plan_of(Feed(spark, SF).forecast())
    unfolded = plan[: plan.index("Generate inline")]
    assert "Exchange" not in unfolded and "Sort" not in unfolded
