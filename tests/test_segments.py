import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfcast.config import ForecastConfig
from shelfcast.operators import codes, panel, prepare, ranking, segments


@pytest.mark.parametrize("n, wanted", [(0, 0), (2, 0), (12, 2), (13, 3), (25, 5), (5000, 1000)])
def test_sample_has_the_exact_size_and_rows(spark, n, wanted):
    rows = spark.range(n).select(F.concat(F.lit("P"), "id").alias("product_id"))
    sample = [r[0] for r in ranking.sample_fraction(rows, "product_id", 0.2, 42).collect()]
    keys = sorted(
        (f"P{i}" for i in range(n)), key=lambda k: (hashlib.md5(f"42|{k}".encode()).hexdigest(), k)
    )
    assert sorted(sample) == sorted(keys[:wanted])


def test_sample_does_not_depend_on_partitioning(spark):
    rows = spark.range(300).withColumnRenamed("id", "product_id")
    one = ranking.sample_fraction(rows.repartition(1), "product_id", 0.1, 7).collect()
    many = ranking.sample_fraction(rows.repartition(9), "product_id", 0.1, 7).collect()
    assert sorted(one) == sorted(many) and len(one) == 30


def test_only_selling_products_are_sampled(spark, cfg):
    rows = [(f"P{i}", float(i - 5)) for i in range(16)]  # ten positive totals
    products = spark.createDataFrame(rows, "product_id string, total_sales double")
    chosen = [r[0] for r in segments.representative_products(products, cfg).collect()]
    assert len(chosen) == 2 and all(int(p[1:]) > 5 for p in chosen)
    assert segments.representative_products(products.where("total_sales <= 0"), cfg).count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("dtype", ["string", "bigint"])
@pytest.mark.parametrize("n", [0, 3, 2000])
def test_dense_codes_of_long_and_short_lists(spark, partitions, dtype, n):
    ids = spark.range(n).select((F.col("id") * 7919 % 100003).cast(dtype).alias("x")).repartition(partitions)
    found = {r.x: r.code for r in ranking.dense_codes(ids, "x", "code").collect()}
    assert found == {x: i + 1 for i, x in enumerate(sorted(found))}
    assert len(found) == n


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_positions_over_several_ranges(spark, adaptive):
    rows = spark.range(5000).select((F.col("id") * 31 % 977).alias("a"), F.col("id").alias("b"))
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        found = [(r.a, r.b, r.n) for r in ranking.positions(rows, [F.col("a").desc(), F.col("b")], "n").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    expected = sorted(((i * 31 % 977, i) for i in range(5000)), key=lambda r: (-r[0], r[1]))
    assert sorted(found, key=lambda r: r[2]) == [(*r, k + 1) for k, r in enumerate(expected)]


@pytest.mark.parametrize("wanted", [0, 1, 37, 900, 5000, 6000])
@pytest.mark.parametrize("values", [3, 5000])
def test_top_rows(spark, monkeypatch, wanted, values):
    monkeypatch.setattr(ranking, "ACCURACY", 500)
    rows = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 7 % values).cast("double").alias("v"))
    found = {r.k for r in ranking.top_rows(rows, "v", ["k"], 5000, wanted).collect()}
    assert found == {k for k, _ in sorted(((k, k * 7 % values) for k in range(5000)), key=lambda r: (-r[1], r[0]))[:wanted]}


@pytest.mark.parametrize("rows", [0, 1, 4, 5, 17, 60, 100])
def test_head_is_the_first_rows(spark, rows):
    cells = [(s, p, h, s * p) for s in range(1, 4) for p in range(1, 5) for h in range(1, 6)]
    coded = spark.createDataFrame(cells, "pdv bigint, produto bigint, semana smallint, quantidade bigint").repartition(5)
    assert sorted(tuple(r) for r in codes.head(coded, rows).collect()) == cells[:rows]


@pytest.mark.parametrize("recent", [4, 60, 61, 80])
def test_recent_weeks_of_any_number(spark, recent):
    days = [(f"s{k % 2}", "p", f"2024-{1 + k % 12:02d}-{1 + k % 28:02d}", float(k)) for k in range(200)]
    days += [("s0", "p", "2021-06-01", 5.0), ("s1", "p", "2022-12-13", 7.0)]
    rows = spark.createDataFrame(days, "store_id string, product_id string, day string, quantity double")
    prepared = rows.select("store_id", "product_id", F.expr("cast(date_trunc('week', cast(day as date)) as date)").alias("week_start"), "quantity", F.lit(0.0).alias("discount"))
    cfg = ForecastConfig(recent_weeks=recent)
    brute = {}
    weeks = {(r.store_id, r.week_start) for r in prepared.collect()}
    last = max(w for _, w in weeks)
    for s in ("s0", "s1"):
        brute[s] = sum((last - w).days // 7 <= recent for t, w in weeks if t == s)
    for given in (prepared, prepare.weekly_sales(prepared)):
        assert {r.store_id: r.recent_weeks for r in segments.pair_stats(given, cfg).collect()} == brute


def stats_of(spark, rows):
    prepared = spark.createDataFrame(rows, "store_id string, product_id string, week string, quantity double")
    prepared = prepared.withColumn("week_start", F.col("week").cast("date"))
    return segments.pair_stats(prepared), prepared


def test_ties_at_the_top_go_to_the_smaller_ids(spark):
    rows = [(s, p, "2024-01-02", 5.0) for s in "cab" for p in "yx"]
    stats, prepared = stats_of(spark, rows)
    top = segments.top_pairs(stats, prepared, ForecastConfig(top_pairs=3))
    assert sorted((r.store_id, r.product_id) for r in top.collect()) == [("a", "x"), ("a", "y"), ("b", "x")]


@pytest.mark.parametrize(
    "cap, floor, kept",
    [
        (40, 3, 20),  # 20 pairs x 2 weeks just fit
        (39, 3, 19),  # 39 // 2
        (4, 3, 3),  # the floor exceeds 4 // 2
        (4, 100, 20),  # a floor above the number of pairs keeps them all
    ],
)
def test_panel_row_cap(spark, cap, floor, kept):
    rows = [("s", f"p{i:02d}", w, float(100 - i)) for i in range(20) for w in ("2024-01-02", "2024-01-09")]
    stats, prepared = stats_of(spark, rows)
    cfg = ForecastConfig(max_panel_rows=cap, min_capped_pairs=floor)
    top = segments.top_pairs(stats, prepared, cfg).collect()
    assert sorted(r.product_id for r in top) == [f"p{i:02d}" for i in range(kept)]


def test_extinct_pairs_are_cut_after_the_top(spark):
    rows = [("s", "old", "2023-01-03", 900.0), ("s", "a", "2024-01-02", 5.0), ("s", "b", "2024-01-02", 4.0)]
    stats, prepared = stats_of(spark, rows)
    top = segments.top_pairs(stats, prepared, ForecastConfig(top_pairs=2))
    by_flag = segments.active_pairs(top).collect()
    by_join = segments.active_pairs(top, segments.extinct_pairs(stats)).collect()
    assert [r.product_id for r in by_flag] == [r.product_id for r in by_join] == ["a"]


def test_no_history_at_all(spark):
    stats, prepared = stats_of(spark, [])
    assert stats.count() == 0
    assert segments.top_pairs(stats, prepared).count() == 0


def test_totals_equal_sums_over_windows(spark):
    rows = [(f"s{i % 7}", f"p{i % 11}", f"2024-01-{2 + 7 * (i % 4):02d}", float(i)) for i in range(200)]
    stats, prepared = stats_of(spark, rows)
    weekly = prepared.groupBy("store_id", "product_id", "week_start").agg(F.sum("quantity").alias("quantity"))
    chosen = panel.panel_rows(weekly, stats)
    columns = ["store_id", "product_id", "time_idx", "store_week_total", "product_global_week"]
    total = lambda key: F.sum("quantity").over(Window.partitionBy(key, "time_idx"))
    summed = chosen.withColumns({"store_week_total": total("store_id"), "product_global_week": total("product_id")})
    by_window = sorted(summed.select(columns).collect())
    by_join = sorted(panel.add_totals(chosen).select(columns).collect())
    assert by_window == by_join and len(by_window) == weekly.count()


def test_a_pair_with_a_third_of_all_rows(spark):
    """Weekly sums and pair facts of a hot pair, against pandas."""
    hot = F.col("id") % 3 == 0
    sales = spark.range(60_000).select(
        F.when(hot, 0).otherwise(F.col("id") % 97).cast("bigint").alias("store_id"),
        F.when(hot, 0).otherwise(F.col("id") % 13).cast("bigint").alias("product_id"),
        F.date_add(F.lit("2024-01-02").cast("date"), (F.col("id") * 7919 % 364).cast("int")).alias("transaction_date"),
        (F.col("id") % 50).cast("double").alias("quantity"),
    )
    prepared = prepare.prepare_transactions(sales.repartition(6))
    keys = ["store_id", "product_id", "week_start"]
    frame = prepared.toPandas()
    expected = frame.groupby(keys).quantity.agg(["sum", "count"]).reset_index()
    found = prepare.weekly_sales(prepared).select(*keys, "quantity", "trans_count").toPandas().sort_values(keys)
    assert (found.to_numpy() == expected.sort_values(keys).to_numpy()).all() and len(found) == len(expected)
    stats = segments.pair_stats(prepared)
    assert stats.agg(F.sum("total_sales")).first()[0] == frame.quantity.sum()
    assert stats.count() == len(frame[keys[:2]].drop_duplicates())
