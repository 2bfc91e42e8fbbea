"""The named queries over the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import timedelta
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.config import FEATURES, LAGS, PAIR, PRODUCT, STORE, ExportConfig, ForecastConfig
from shelfcast.functions.numbers import finite_or_zero
from shelfcast.operators import boosting, codes, evaluate, grid, model, panel, prepare, segments
from shelfcast.plans.export_run import MIB, load_predictions, run_export
from shelfcast.plans.forecast_run import open_run, run_forecast, run_summary
from shelfcast.session import new_scratch
from shelfcast.sources import sinks, storage, testbed
from shelfcast.sources.roles import detect_roles, require_columns
from shelfcast.sources.universe import product_universe, store_universe

CFG = ForecastConfig()
SMALL_CHUNKS = replace(CFG, store_chunk_size=25)


def six(column: str) -> Column:
    """Means and ratios to six places: sums of floats depend on their order."""
    return F.round(column, 6).alias(column)


@dataclass
class Feed:
    """The steps shared by the queries, each built when first used.

    What several later steps read is written once (the ``..._table`` steps), so
    that the transactions are not scanned again for each of them.
    """

    spark: SparkSession
    sf_dir: str
    dense: bool = False
    cfg: ForecastConfig = CFG

    @cached_property
    def transactions(self) -> DataFrame:
        view = testbed.dense_transactions if self.dense else testbed.transactions
        return view(self.spark, self.sf_dir)

    @cached_property
    def prepared(self) -> DataFrame:
        return prepare.prepare_transactions(self.transactions, self.cfg)

    @cached_property
    def weekly(self) -> DataFrame:
        return prepare.weekly_sales(self.prepared)

    @cached_property
    def weekly_table(self) -> DataFrame:
        return storage.stage_table(self.spark, new_scratch(self.spark, "weekly"), lambda: self.weekly)

    @cached_property
    def stats(self) -> DataFrame:
        # Weekly sales are written only where another step reads them too.
        weekly = self.weekly_table if "weekly_table" in self.__dict__ else self.weekly
        return segments.pair_stats(weekly, self.cfg)

    @cached_property
    def stats_table(self) -> DataFrame:
        return storage.stage_table(self.spark, new_scratch(self.spark, "pairs"), lambda: self.stats)

    @cached_property
    def by_product(self) -> DataFrame:
        return segments.product_stats(self.stats)

    def top(self) -> DataFrame:
        # The weeks are counted from keys and dates alone, if weekly sales weren't written for another step.
        rows = self.weekly_table if "weekly_table" in self.__dict__ else self.prepared
        return segments.top_pairs(self.stats_table, rows, self.cfg)

    @cached_property
    def panel_rows(self) -> DataFrame:
        return panel.panel_rows(self.weekly_table, segments.active_pairs(self.stats_table))

    @cached_property
    def panel(self) -> DataFrame:
        return panel.feature_panel(self.weekly_table, segments.active_pairs(self.stats_table), self.cfg)

    @cached_property
    def store_list(self) -> DataFrame:
        source = None if self.dense else testbed.stores(self.spark, self.sf_dir)
        return store_universe(source, self.transactions, detect_roles(self.transactions))

    @cached_property
    def product_list(self) -> DataFrame:
        source = None if self.dense else testbed.products(self.spark, self.sf_dir)
        return product_universe(source, self.transactions, detect_roles(self.transactions))

    @cached_property
    def n_stores(self) -> int:
        return self.store_list.count()

    @cached_property
    def n_products(self) -> int:
        return self.product_list.count()

    @cached_property
    def stores(self) -> DataFrame:
        return storage.stage_table(self.spark, new_scratch(self.spark, "stores"), lambda: grid.chunk_stores(self.store_list, self.cfg))

    @cached_property
    def product_table(self) -> DataFrame:
        def build() -> DataFrame:
            by_product = segments.product_stats(self.stats_table)
            representative = segments.representative_products(by_product, self.cfg)
            return grid.product_facts(self.product_list, by_product, representative)

        return storage.stage_table(self.spark, new_scratch(self.spark, "products"), build)

    def forecast_pairs(self, overrides: DataFrame | None = None) -> DataFrame:
        sizes = (self.n_stores, self.n_products)
        facts = grid.pair_facts(
            self.stats_table, self.stores, self.product_table, overrides, *sizes, self.cfg
        )
        return grid.forecast_pairs(self.stores, self.product_table, facts, *sizes, self.cfg)

    def forecast(self, overrides: DataFrame | None = None) -> DataFrame:
        return grid.forecast(self.forecast_pairs(overrides), self.cfg)

    def asked_forecast(self, asked: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
        """The forecast of the asked pairs, from products' values and the pairs that differ."""
        facts = grid.pair_facts(self.stats_table, self.stores, self.product_table, overrides, self.n_stores, self.n_products, self.cfg)
        return grid.forecast(grid.asked_pairs(asked, self.stores, self.product_table, facts, self.cfg), self.cfg)

    def coded(self) -> DataFrame:
        # Rounded first, so that a last-bit difference of a mean cannot flip a half.
        return codes.coded_layout(self.forecast().drop("store_chunk").withColumn("prediction", F.round("prediction", 6)))


def rounded_forecast(predictions: DataFrame) -> DataFrame:
    return predictions.select(*PAIR, "horizon", six("prediction"))


def prepared_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns with unreadable dates and quantities, and no discount column."""
    sales = testbed.table(spark, sf_dir, "lineitem")
    unknown = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")
    text = sales.select(
        F.col("l_suppkey").alias("store_id"),
        F.col("l_partkey").alias("sku"),
        F.when(unknown, "unknown").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("transaction_date"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.col("l_quantity").cast("string"), F.lit(" pcs")))
        .otherwise(F.col("l_quantity").cast("string"))
        .alias("quantity"),
    )
    return prepare.prepare_transactions(text, CFG)


def prepared_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as text in five ways: ISO, compact, with slashes, with month names, and unreadable."""
    sales = testbed.table(spark, sf_dir, "lineitem")
    day, way = F.col("l_shipdate"), F.col("l_linenumber")
    text = sales.select(
        F.col("l_suppkey").alias("store_id"),
        F.col("l_partkey").alias("sku"),
        F.when(way == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(way == 2, F.date_format(day, "yyyyMMdd"))
        .when(way == 3, F.date_format(day, "MM/dd/yyyy"))
        .when(way == 4, F.date_format(day, "MMM d, yyyy"))
        .when(way == 5, F.date_format(day, "M/d/yyyy"))
        .otherwise("not known")
        .alias("transaction_date"),
        F.col("l_quantity").alias("quantity"),
    )
    return prepare.prepare_transactions(text, CFG)


def last_point_overrides(feed: Feed) -> DataFrame:
    """A stand-in for models: a quarter of the four-row sum, for all horizons but the last."""
    value = F.round(F.col("qty_4w_sum") / 4, 6)
    steps = F.explode(F.array(*[F.lit(h) for h in feed.cfg.horizons[:-1]])).alias("horizon")
    rows = panel.last_points(feed.panel).select(*PAIR, steps, value.alias("prediction"))
    return model.overrides_from_rows(rows, feed.cfg)


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks still to do after a run that stopped at its first commit."""
    cfg = replace(SMALL_CHUNKS, use_model=False, chunks_per_commit=3, write_dense=True)
    run = run_forecast(
        spark,
        testbed.transactions(spark, sf_dir),
        testbed.stores(spark, sf_dir),
        testbed.products(spark, sf_dir),
        new_scratch(spark, "resume"),
        cfg,
        max_commits=1,
    )
    return storage.pending_chunks(spark, run.run_dir, spark.read.parquet(f"{run.run_dir}/stores"))


def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run stopped at its first commit and started again: the result is whole."""
    cfg = replace(SMALL_CHUNKS, use_model=False, chunks_per_commit=3, write_dense=True)
    folder = new_scratch(spark, "resume")
    tables = [view(spark, sf_dir) for view in (testbed.transactions, testbed.stores, testbed.products)]
    run_forecast(spark, *tables, folder, cfg, max_commits=1)
    return rounded_forecast(run_forecast(spark, *tables, folder, cfg).predictions)


def _refreshed(spark: SparkSession, sf_dir: str):
    """A dense run over all transactions, refreshed after the smallest store's sales before 1998 were withdrawn."""
    cfg = replace(CFG, store_chunk_size=3, use_model=False, write_dense=True)
    folder = new_scratch(spark, "refresh")
    sales, stores, products = (view(spark, sf_dir) for view in (testbed.transactions, testbed.stores, testbed.products))
    run_forecast(spark, sales, stores, products, folder, cfg, run_id="weekly")
    smallest = stores.agg(F.min(stores.columns[0])).scalar()
    later = sales.where((F.col(STORE) != smallest) | (F.col("transaction_date") >= F.lit("1998-01-01").cast("date")))
    return run_forecast(spark, later, stores, products, folder, cfg, run_id="weekly", refresh=True), f"{folder}/weekly"


def refreshed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_forecast(_refreshed(spark, sf_dir)[0].predictions)


def refreshed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that the refresh computed again."""
    _, folder = _refreshed(spark, sf_dir)
    writes = storage.manifest(spark, folder).where("digest is not null").groupBy("store_chunk").agg(F.count(F.lit(1)).alias("writes"))
    return writes.where("writes > 1").select("store_chunk")


def rerun_other_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over all transactions, then one over those before 1998 into the same folder: the second's result."""
    folder, cfg = new_scratch(spark, "rerun"), replace(SMALL_CHUNKS, use_model=False)
    sales, stores, products = (view(spark, sf_dir) for view in (testbed.transactions, testbed.stores, testbed.products))
    run_forecast(spark, sales, stores, products, folder, cfg)
    early = sales.where(F.col("transaction_date") < F.lit("1998-01-01").cast("date"))
    return rounded_forecast(run_forecast(spark, early, stores, products, folder, cfg).predictions)


def _full_run(spark: SparkSession, sf_dir: str, **options):
    return run_forecast(
        spark,
        testbed.transactions(spark, sf_dir),
        testbed.stores(spark, sf_dir),
        testbed.products(spark, sf_dir),
        new_scratch(spark, "run"),
        replace(SMALL_CHUNKS, use_model=False, **options),
    )


def full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_forecast(_full_run(spark, sf_dir).predictions)


def full_run_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunked table of every cell and its whole copy, as written on request."""
    run = _full_run(spark, sf_dir, write_dense=True, write_full=True)
    return rounded_forecast(spark.read.parquet(f"{run.run_dir}/full_predictions"))


def asked_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast of every pair that was ordered, looked up in a finished run."""
    run = _full_run(spark, sf_dir)
    asked = testbed.transactions(spark, sf_dir).select(STORE, PRODUCT).distinct()
    return rounded_forecast(open_run(spark, run.run_dir).lookup(asked))


def full_run_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _full_run(spark, sf_dir, write_dense=True, write_full=True, write_csv=True)
    schema = "store_id bigint, product_id string, horizon int, prediction double"
    read = spark.read.option("header", True).schema(schema).csv(f"{run.run_dir}/full_predictions_csv")
    return rounded_forecast(read)


def metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _full_run(spark, sf_dir)
    read = spark.read.option("header", True).schema("horizon int, wmape double, n bigint")
    return read.csv(f"{run.run_dir}/metrics_csv").select("horizon", six("wmape"), "n")


def _export(spark: SparkSession, sf_dir: str, cfg: ExportConfig):
    tables = open_run(spark, _full_run(spark, sf_dir).run_dir)
    predictions = tables.predictions().withColumn("prediction", F.round("prediction", 6))
    return run_export(spark, predictions, new_scratch(spark, "export"), cfg, tables.stores, tables.products)


def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(_export(spark, sf_dir, ExportConfig()).path)


def export_head_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(_export(spark, sf_dir, ExportConfig(head_rows=1_000)).head_path)


def export_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export of everything, then one of three horizons to the same path: the second is all that is there."""
    tables = open_run(spark, _full_run(spark, sf_dir).run_dir)
    predictions, out = tables.predictions().withColumn("prediction", F.round("prediction", 6)), new_scratch(spark, "export")
    run_export(spark, predictions, out, ExportConfig(), tables.stores, tables.products)
    return spark.read.parquet(run_export(spark, predictions.where("horizon <= 3"), out, ExportConfig(), tables.stores, tables.products).path)


def export_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codec and row groups found in the footers of an export that prefers a codec executors lack."""
    run = _export(spark, sf_dir, ExportConfig(prefer_brotli=True, row_group_rows=1_000))
    groups = sinks.row_groups(spark, run.path)
    return groups.groupBy("codec").agg(F.sum("rows").alias("n_rows"), F.max("rows").alias("largest_group"))


def export_capped_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export capped at the very size that its first two chunks have without a cap."""
    tables = open_run(spark, _full_run(spark, sf_dir, store_chunk_size=3).run_dir)
    predictions = tables.predictions().withColumn("prediction", F.round("prediction", 6))

    def export(rows: DataFrame, stores: DataFrame, cfg: ExportConfig):
        return run_export(spark, rows, new_scratch(spark, "export"), cfg, stores, tables.products)

    two = export(predictions.where("store_chunk < 2"), tables.stores.where("store_chunk < 2"), ExportConfig())
    capped = export(predictions, tables.stores, ExportConfig(size_cap_mb=two.bytes / MIB))
    return spark.read.parquet(capped.path)


def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the chunks with even numbers, listed by name and read as predictions."""
    run = _full_run(spark, sf_dir, store_chunk_size=3, write_dense=True)
    written = spark.read.parquet(f"{run.run_dir}/predictions").where("store_chunk % 2 = 0")
    files = [row[0] for row in written.select("_metadata.file_path").distinct().collect()]
    return load_predictions(spark, files).select("store_chunk", *PAIR, "horizon", six("prediction"))


def required_columns(feed: Feed) -> DataFrame:
    """For each required column: what is reported of transactions without it, and the rows it has."""
    sales, roles = feed.transactions, detect_roles(feed.transactions)
    reported = []
    for name in (roles.store, roles.product, "transaction_date", "quantity"):
        try:
            require_columns(sales.drop(name), roles)
        except ValueError as error:
            reported.append(F.struct(F.lit(name).alias("dropped"), F.lit(str(error)).alias("reported"), F.count(name).alias("n_values")))
    return sales.agg(F.array(*reported).alias("found")).select(F.inline("found"))


def feature_totals(feed: Feed) -> DataFrame:
    """Each model feature's number of values and their sum over the panel."""
    totals = [F.struct(F.lit(f).alias("feature"), F.count(f).alias("n"), F.round(F.sum(f), 2).cast("double").alias("total")) for f in FEATURES]
    return feed.panel.agg(F.array(*totals).alias("found")).select(F.inline("found"))


def finite_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts less taxes, made infinite, undefined or null by the other columns of a row."""
    value = F.col("l_discount").cast("double") - F.col("l_tax").cast("double")
    odd = (
        F.when(F.col("l_linenumber") == 1, F.lit(float("inf")))
        .when(F.col("l_linenumber") == 2, F.lit(float("-inf")))
        .when(F.col("l_linenumber") == 3, F.lit(float("nan")))
        .when(F.col("l_linenumber") == 4, F.lit(None).cast("double"))
        .otherwise(value)
    )
    sales = testbed.table(spark, sf_dir, "lineitem")
    return sales.select("l_orderkey", "l_linenumber", F.round(finite_or_zero(odd), 6).alias("guarded"))


def scored_last_points(feed: Feed) -> DataFrame:
    """Given trees in place of learned ones: one split for the first horizon, two trees for the second, no further models."""

    def stump(feature: str, low: float, high: float) -> boosting.Tree:
        at = FEATURES.index(feature)
        return boosting.Tree(np.array([at, 0, 0]), np.array([0, 0, 0]), np.array([1, -1, -1]), np.array([0.0, low, high]))

    edges = tuple(np.array([{"qty_4w_sum": 60.0, "qty_lag_1": 20.0}.get(f, 0.0)]) for f in FEATURES)
    first, second = stump("qty_4w_sum", -5.0, 3.0), stump("qty_lag_1", 0.25, 6.5)
    models = {1: boosting.TreeModel(1.0, edges, (first,)), 2: boosting.TreeModel(1.0, edges, (first, second))}
    models |= {h: None for h in feed.cfg.horizons[2:]}
    return model.overrides_to_rows(model.score_last_points(feed.panel, models, feed.cfg))


def export_files_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes decide how many chunks stay, so there is no SQL for the row count."""
    return spark.read.parquet(_export(spark, sf_dir, ExportConfig(size_cap_mb=0.004)).path)


def summary_counts(feed: Feed) -> DataFrame:
    stats = feed.stats_table
    representative = segments.representative_products(segments.product_stats(stats), feed.cfg)
    active = segments.active_pairs(feed.top())
    return run_summary(feed.store_list, feed.product_list, stats, representative, active, feed.cfg)


def rolling_origin_wmape(feed: Feed) -> DataFrame:
    """The base forecast made 5, 9 and 13 weeks before the last week, against what was sold then."""
    last = feed.weekly_table.agg(F.max("week_start")).first()[0]
    origins = [last - timedelta(weeks=k) for k in (5, 9, 13)]
    return evaluate.rolling_origin(feed.weekly_table, origins, feed.cfg).select("horizon", six("wmape"), "n")


def size_capped_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix rule on sizes any engine can work out: 16 bytes per transaction of a chunk."""
    feed = Feed(spark, sf_dir, cfg=SMALL_CHUNKS)
    sales = feed.prepared.groupBy(STORE).agg(F.count(F.lit(1)).alias("n"))
    sizes = feed.stores.join(sales, STORE, "left").groupBy("store_chunk").agg(
        (F.coalesce(F.sum("n"), F.lit(0)) * 16).alias("bytes")
    )
    return codes.fitting_prefix(sizes, 500_000)


def model_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole forecast with models, on the view with long histories."""
    feed = Feed(spark, sf_dir, dense=True)
    features = storage.stage_table(spark, new_scratch(spark, "panel"), lambda: feed.panel)
    models, _ = model.train_models(features, feed.cfg, segments.active_pairs(feed.top()))
    overrides = model.score_last_points(features, models, feed.cfg)
    return feed.forecast(overrides).select(*PAIR, "horizon", "prediction")


Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    def over_feed(build: Callable[[Feed], DataFrame], **options) -> Query:
        return lambda spark, sf_dir: build(Feed(spark, sf_dir, **options))

    week = [*PAIR, "week_start"]
    keep_base, zeros = replace(CFG, missing_model="base"), replace(CFG, missing_model="zero")
    return {
        "prepared_transactions": over_feed(lambda f: f.prepared),
        "prepared_lenient": prepared_lenient,
        "prepared_dates": prepared_dates,
        "universe_stores": over_feed(lambda f: f.store_list),
        "universe_products": over_feed(lambda f: f.product_list),
        "reading_counts": over_feed(lambda f: prepare.reading_counts(f.transactions, f.weekly)),
        "weekly_sales": over_feed(
            lambda f: f.weekly.select(*week, "quantity", "trans_count", six("discount_mean"), "discount_max")
        ),
        "pair_last_sale": over_feed(lambda f: f.stats.select(*PAIR, "last_week", "weeks_since_sale")),
        "extinct_pairs": over_feed(lambda f: segments.extinct_pairs(f.stats)),
        "recent_product_avg": over_feed(
            lambda f: f.by_product.where("global_avg is not null").select(PRODUCT, six("global_avg"))
        ),
        "recent_pair_avg": over_feed(
            lambda f: segments.recent_pair_average(f.stats).select(*PAIR, six("pair_avg"))
        ),
        "product_totals": over_feed(lambda f: f.by_product.select(PRODUCT, "total_sales")),
        "representative_products": over_feed(
            lambda f: segments.representative_products(f.by_product, f.cfg)
        ),
        "distinct_weeks": over_feed(lambda f: segments.distinct_weeks(f.prepared)),
        "top_pairs": over_feed(
            lambda f: f.top().select(*PAIR, "total_sales"),
            cfg=replace(CFG, top_pairs=200),
        ),
        "top_pairs_capped": over_feed(
            lambda f: f.top().select(*PAIR, "total_sales"),
            cfg=replace(CFG, max_panel_rows=400_000),
        ),
        "top_pairs_active": over_feed(
            lambda f: segments.active_pairs(f.top(), segments.extinct_pairs(f.stats_table)).select(*PAIR)
        ),
        "panel_time_idx": over_feed(lambda f: f.panel_rows.select(*week, "quantity", "time_idx")),
        "panel_lags": over_feed(
            lambda f: panel.add_history(f.panel_rows).select(
                *week, *(f"qty_lag_{k}" for k in LAGS)
            )
        ),
        "panel_rolling": over_feed(
            lambda f: panel.add_history(f.panel_rows).select(*week, "qty_4w_sum", six("qty_12w_mean"))
        ),
        "panel_totals": over_feed(
            lambda f: panel.add_totals(f.panel_rows).select(
                *week, "store_week_total", "product_global_week"
            )
        ),
        "panel_targets": over_feed(
            lambda f: panel.add_targets(f.panel_rows, f.cfg.horizons).select(
                *week, *(f"target_h{h}" for h in f.cfg.horizons)
            )
        ),
        "split_counts": over_feed(lambda f: model.split_counts(f.panel, f.cfg), dense=True),
        "pair_last_point": over_feed(
            lambda f: panel.last_points(f.panel).select(
                *week, "time_idx", "quantity", "qty_4w_sum", six("qty_12w_mean")
            )
        ),
        "naive_forecast": over_feed(
            lambda f: panel.naive_forecast(f.weekly).select(*week, six("pred_naive"))
        ),
        "backtest_wmape": over_feed(
            lambda f: evaluate.backtest(f.weekly, f.cfg).select("horizon", six("wmape"), "n")
        ),
        "rolling_origin_wmape": over_feed(rolling_origin_wmape),
        "chunk_ids": over_feed(
            lambda f: f.stores.select(STORE, "store_code", "store_chunk"), cfg=SMALL_CHUNKS
        ),
        "base_forecast_pairs": over_feed(lambda f: f.forecast_pairs().select(*PAIR, "extinct", six("base"))),
        "base_forecast": over_feed(lambda f: rounded_forecast(f.forecast())),
        "override_rows": over_feed(
            lambda f: model.overrides_to_rows(last_point_overrides(f)).select(*PAIR, "horizon", six("prediction")),
            cfg=zeros,
        ),
        "override_apply": over_feed(lambda f: rounded_forecast(f.forecast(last_point_overrides(f))), cfg=zeros),
        "override_keep_base": over_feed(
            lambda f: rounded_forecast(f.forecast(last_point_overrides(f))), cfg=keep_base
        ),
        "store_codes": over_feed(lambda f: codes.store_codes(f.store_list)),
        "product_codes": over_feed(lambda f: codes.product_codes(f.product_list)),
        "export_layout": over_feed(lambda f: f.coded()),
        "export_head": over_feed(lambda f: codes.head(f.coded(), 1_000)),
        "size_capped_prefix": size_capped_prefix,
        "run_summary": over_feed(summary_counts),
        "full_run": full_run,
        "full_run_dense": full_run_dense,
        "asked_forecast": asked_forecast,
        "asked_pairs": over_feed(lambda f: rounded_forecast(f.asked_forecast(f.transactions.select(STORE, PRODUCT).distinct()))),
        "recent_pair_avg_long": over_feed(
            lambda f: segments.recent_pair_average(f.stats).select(*PAIR, six("pair_avg")), cfg=replace(CFG, recent_weeks=80)
        ),
        "full_run_csv": full_run_csv,
        "metrics_csv": metrics_csv,
        "resume_pending": resume_pending,
        "resumed_run": resumed_run,
        "rerun_other_input": rerun_other_input,
        "refreshed_run": refreshed_run,
        "refreshed_chunks": refreshed_chunks,
        "export_files": export_files,
        "export_files_capped": export_files_capped,
        "export_head_file": export_head_file,
        "export_replaced": export_replaced,
        "export_row_groups": export_row_groups,
        "export_capped_prefix": export_capped_prefix,
        "chunk_files": chunk_files,
        "required_columns": over_feed(required_columns),
        "feature_totals": over_feed(feature_totals),
        "finite_guard": finite_guard,
        "scored_last_points": over_feed(scored_last_points, cfg=keep_base),
        "model_forecast": model_forecast,
    }
