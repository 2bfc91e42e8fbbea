"""A whole forecast run, from three tables to predictions on storage."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfcast.config import PAIR, PRODUCT, STORE, ForecastConfig
from shelfcast.operators import evaluate, grid, model, panel, prepare, segments
from shelfcast.session import new_scratch
from shelfcast.sources import sinks, storage
from shelfcast.sources.roles import Roles, detect_roles, require_columns
from shelfcast.sources.universe import product_universe, store_universe

SPLIT_SCHEMA = "horizon int, train_rows bigint, valid_rows bigint"
# Rows of the dense table that one job writes, at most, where batches of chunks are smaller than that.
ROWS_PER_JOB = 20_000_000


@dataclass(frozen=True)
class ForecastRun:
    """Where a run lies and what came of it. Tables are read from storage when used; those of a refreshed run lie
    in a folder of their own, ``run_dir``, below the one that holds its chunks.

    ``predictions`` holds every cell: read from the chunks if these were written, else unfolded when used.
    """

    run_dir: str
    roles: Roles
    predictions: DataFrame
    metrics: DataFrame
    summary: DataFrame
    chunks_written: int
    complete: bool


@dataclass(frozen=True)
class RunTables:
    """The result of a run: stores, one value per product, and the facts of the pairs that differ from it."""

    stores: DataFrame
    products: DataFrame
    facts: DataFrame
    cfg: ForecastConfig

    def lookup(self, asked: DataFrame) -> DataFrame:
        """store_chunk, store_id, product_id, codes, horizon, prediction of the asked pairs (store_id, product_id)."""
        return grid.forecast(grid.asked_pairs(asked, self.stores, self.products, self.facts, self.cfg), self.cfg)

    def predictions(self, chunks: Sequence[int] | None = None) -> DataFrame:
        """The same for every pair, or every pair of some chunks of stores."""
        sizes = self.stores.count(), self.products.count()
        pairs = grid.forecast_pairs(self.stores, self.products, self.facts, *sizes, self.cfg, chunks)
        return grid.forecast(pairs, self.cfg)


def open_run(spark: SparkSession, run_dir: str) -> RunTables:
    """The tables of a finished run."""
    settings = json.loads(spark.read.text(f"{run_dir}/settings").first()[0])
    cfg = ForecastConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()})
    return RunTables(*(spark.read.parquet(f"{run_dir}/{name}") for name in ("stores", "products", "facts")), cfg)


def run_summary(
    stores: DataFrame,
    products: DataFrame,
    stats: DataFrame,
    representative: DataFrame,
    active: DataFrame,
    cfg: ForecastConfig = ForecastConfig(),
) -> DataFrame:
    """One row of counters, each a scalar subquery."""
    count = F.count(F.lit(1))
    counted = stores.sparkSession.range(1).select(
        stores.agg(count).scalar().alias("n_stores"),
        products.agg(count).scalar().alias("n_products"),
        stats.agg(F.count_if(F.col("extinct"))).scalar().alias("extinct_pairs"),
        representative.agg(count).scalar().alias("representative_products"),
        active.agg(count).scalar().alias("top_pairs"),
    )
    expected = F.col("n_stores") * F.col("n_products") * F.lit(len(cfg.horizons))
    return counted.withColumn("expected_predictions", expected)


def digest_columns(df: DataFrame) -> list[Column]:
    """Sums that tell the rows of a table, whatever it is read from and in whatever order."""
    row = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bit_xor(row), F.lit(0)).alias("xor"),
        F.sum(F.shiftright(row, 32)).alias("high"),
        F.sum(row.bitwiseAND(0xFFFFFFFF)).alias("low"),
    ]


def list_digest(df: DataFrame | None) -> str:
    return "none" if df is None else f"{df.columns} {tuple(df.agg(*digest_columns(df)).first())}"


def chunk_digests(stores: DataFrame, products: DataFrame, facts: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """store_chunk, digest: what decides a chunk's rows, which is its stores, the facts of its pairs, the products' values
    and the settings. Averages count to nine places, as sums of floats depend on their order."""

    def digest(columns: list) -> list[Column]:
        row = F.xxhash64(*columns)
        return [F.count(F.lit(1)).alias("rows"), F.bit_xor(row).alias("xor"), F.sum(F.shiftright(row, 32)).alias("high")]

    own = ["store_code", "extinct", F.round("pair_avg", 9), F.transform("override", lambda v: F.round(v, 9))]
    values = F.array(F.lit(0), F.col("product_code"))
    common = products.agg(*digest([PRODUCT, values, F.round("global_avg", 9)]))
    common = common.select(F.concat_ws(",", F.lit(cfg.fingerprint()), "rows", "xor", "high").alias("common"))
    per_chunk = (
        stores.groupBy("store_chunk").agg(*digest([STORE, "store_code"]))
        .select("store_chunk", F.concat_ws(",", "rows", "xor", "high").alias("of_stores"))
    )
    per_facts = (
        facts.groupBy("store_chunk").agg(*digest([*PAIR, *own]))
        .select("store_chunk", F.concat_ws(",", "rows", "xor", "high").alias("of_facts"))
    )
    parts = F.concat_ws("|", common.scalar(), "of_stores", F.coalesce("of_facts", F.lit("")))
    return per_chunk.join(per_facts, "store_chunk", "left").select("store_chunk", F.sha2(parts, 256).alias("digest"))


def _claim(spark: SparkSession, run_dir: str, fingerprint: str, refresh: bool) -> str:
    """The folder for the tables of a run whose chunks lie in ``run_dir``.

    That is ``run_dir`` for the run it began with. Other inputs or settings are refused, unless the run is to be
    refreshed: then their tables lie in a folder of their own below it.
    """
    mark = f"{run_dir}/fingerprint"
    schema = "fingerprint string"
    found = storage.stage_table(spark, mark, lambda: spark.createDataFrame([(fingerprint,)], schema).coalesce(1))
    if (other := found.first()[0]) == fingerprint:
        return run_dir
    if not refresh:
        raise ValueError(f"{run_dir} holds a run over other inputs or settings ({other}); choose another run id")
    return f"{run_dir}/refreshed-{fingerprint}"


def original_names(predictions: DataFrame, roles: Roles) -> DataFrame:
    """The four columns of the result under the names the transactions use."""
    return predictions.select(
        F.col(STORE).alias(roles.store), F.col(PRODUCT).alias(roles.product), "horizon", "prediction"
    )


def run_forecast(
    spark: SparkSession,
    transactions: DataFrame,
    stores: DataFrame | None,
    products: DataFrame | None,
    out_dir: str,
    cfg: ForecastConfig = ForecastConfig(),
    run_id: str | None = None,
    max_commits: int | None = None,
    refresh: bool = False,
) -> ForecastRun:
    """Forecast and write everything below ``out_dir/run_id``.

    The result is a value per product and the facts of the pairs that differ (`open_run`, `RunTables`); the
    dense table of every cell is written in chunks only with ``write_dense``.

    The run id defaults to a hash of the settings that decide results and of the
    rows the transactions, stores and products hold, so that starting the same run
    again goes on where the last attempt stopped, and a run over other data never
    meets old chunks. The rows of the transactions are digested by the scan that sums them by week; should an executor
    be lost then, rows may be digested twice, and the next attempt, not finding such an id, begins anew.
    With a run id of one's own, a folder begun with other inputs
    or settings is refused, unless ``refresh``: then its dense table is brought up to date in place, and only chunks of
    which the facts changed are computed again. (The values of all products belong to every chunk's facts: after a
    change to a product's recent average each chunk has other rows.) ``max_commits`` ends the chunk step early, to be
    continued by a later call.
    """
    roles = detect_roles(transactions)
    require_columns(transactions, roles)
    used = [c for c in (roles.store, roles.product, "transaction_date", "quantity", "discount") if c in transactions.columns]
    seen = Observation()
    read = transactions.select(*used)
    read = read.observe(seen, *digest_columns(read))
    weekly = storage.stage_table(
        spark, new_scratch(spark, "weekly"), lambda: prepare.weekly_sales(prepare.prepare_transactions(read, cfg, roles))
    )
    digest = f"{used} {[seen.get[c] for c in ('rows', 'xor', 'high', 'low')]}"
    fingerprint = cfg.fingerprint(digest, list_digest(stores), list_digest(products))
    chunk_dir = f"{out_dir.rstrip('/')}/{run_id or fingerprint}"
    run_dir = _claim(spark, chunk_dir, fingerprint, refresh)
    settings = json.dumps(asdict(cfg))
    spark.createDataFrame([(settings,)], "value string").coalesce(1).write.mode("overwrite").text(f"{run_dir}/settings")

    def table(name: str, build) -> DataFrame:
        return storage.stage_table(spark, f"{run_dir}/{name}", build)

    # Facts: each table is written once and read by all that follows.
    store_list = table("store_list", lambda: store_universe(stores, transactions, roles))
    n_stores = store_list.count()
    store_table = table("stores", lambda: grid.chunk_stores(store_list, cfg))
    stats = table("pairs", lambda: segments.pair_stats(weekly, cfg))
    by_product = segments.product_stats(stats)
    representative = segments.representative_products(by_product, cfg)
    universe = product_universe(products, transactions, roles)
    product_table = table("products", lambda: grid.product_facts(universe, by_product, representative))
    n_products = product_table.count()
    best = segments.active_pairs(segments.top_pairs(stats, weekly, cfg))
    active = table("top_pairs", lambda: best)

    overrides, splits = None, spark.createDataFrame([], SPLIT_SCHEMA)
    if cfg.use_model and cfg.top_pairs > 0:
        # Every pair that still sells is scored; the top pairs bound the rows to learn from.
        features = table("panel", lambda: panel.feature_panel(weekly, segments.active_pairs(stats), cfg))

        def fit_and_score() -> DataFrame:
            models, sizes = model.train_models(features, cfg, active)
            rows = [(s.horizon, s.train_rows, s.valid_rows) for s in sizes]
            spark.createDataFrame(rows, SPLIT_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
                f"{run_dir}/splits"
            )
            return model.score_last_points(features, models, cfg)

        overrides = table("overrides", fit_and_score)
        splits = spark.read.schema(SPLIT_SCHEMA).parquet(f"{run_dir}/splits")

    def sorted_facts() -> DataFrame:
        # In chunk order, so that a batch of chunks skips the row groups of all others.
        facts = grid.pair_facts(stats, store_table, product_table, overrides, n_stores, n_products, cfg)
        return facts.repartitionByRange("store_chunk", *PAIR).sortWithinPartitions("store_chunk")

    def write_metrics() -> DataFrame:
        metrics = table("metrics", lambda: evaluate.backtest(weekly, cfg).coalesce(1))
        sinks.write_csv(metrics.coalesce(1), f"{run_dir}/metrics_csv")
        return metrics

    def write_dense() -> tuple[int, bool]:
        """Predict the chunks still to do, some batches at a time; how many, and whether none is left."""
        # One id and digest per chunk of stores reach the driver.
        pending = sorted((row[0], row[1]) for row in storage.pending_chunks(spark, chunk_dir, digests).collect())
        most_chunks = ROWS_PER_JOB // max(1, cfg.store_chunk_size * n_products * len(cfg.horizons))
        written = storage.write_chunks(
            spark, chunk_dir, pending, lambda chunks: tables.predictions(chunks).drop("store_code", "product_code"),
            cfg.chunks_per_commit, max_commits, most_chunks,
        )
        return written, written == len(pending)

    # The backtest needs the weekly table only; it runs beside the predictions.
    with ThreadPoolExecutor(1) as pool:
        backtest = pool.submit(inheritable_thread_target(spark)(write_metrics))
        tables = RunTables(store_table, product_table, table("facts", sorted_facts), cfg)
        if cfg.write_dense:
            digests = table("chunk_digests", lambda: chunk_digests(tables.stores, tables.products, tables.facts, cfg).coalesce(1))
        written, complete = write_dense() if cfg.write_dense else (0, True)
        metrics = backtest.result()

    predictions = original_names(storage.read_chunks(spark, chunk_dir, digests) if cfg.write_dense else tables.predictions(), roles)
    if complete and cfg.write_full:
        predictions = table("full_predictions", lambda: predictions)
        if cfg.write_csv:
            sinks.write_csv(predictions, f"{run_dir}/full_predictions_csv")

    def summarise() -> DataFrame:
        counters = run_summary(store_table, product_table, stats, representative, active, cfg)
        reading = prepare.reading_counts(F.lit(seen.get["rows"]), weekly)
        done = store_table
        if cfg.write_dense:
            done = done.join(digests.join(storage.committed_chunks(spark, chunk_dir), ["store_chunk", "digest"]), "store_chunk", "left_semi")
        skipped = F.col("train_rows") < max(1, cfg.min_train_rows)
        per_horizon = F.array_sort(
            F.collect_list(F.struct("horizon", "train_rows", "valid_rows", skipped.alias("skipped")))
        )
        return counters.select(
            "*",
            reading.select("transactions_read").scalar().alias("transactions_read"),
            reading.select("transactions_left_out").scalar().alias("transactions_left_out"),
            splits.agg(per_horizon).scalar().alias("splits"),
            done.agg(F.count(F.lit(1))).scalar().alias("stores_done"),
        )

    # Not a stage: the number of stores done changes from one attempt to the next.
    sinks.write_parquet(summarise(), f"{run_dir}/summary")
    summary = spark.read.parquet(f"{run_dir}/summary")
    return ForecastRun(run_dir, roles, predictions, metrics, summary, written, complete)
