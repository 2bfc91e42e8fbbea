"""The integer export: coded and rounded; on demand capped in size and with a short head copy."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.config import EXPORT_COLUMNS, PRODUCT, STORE, ExportConfig
from shelfcast.operators.codes import (
    PDV,
    PRODUTO,
    SEMANA,
    coded_layout,
    export_layout,
    fitting_prefix,
    head,
    product_codes,
    store_codes,
)
from shelfcast.plans.forecast_run import open_run
from shelfcast.session import new_scratch, path_exists
from shelfcast.sources import sinks, storage
from shelfcast.sources.roles import detect_roles

MIB = 1024 * 1024
BATCH_GROWTH = 8
# Rows of a file of the head copy.
HEAD_FILE_ROWS = 2_000_000


@dataclass(frozen=True)
class ExportRun:
    path: str
    head_path: str | None
    chunks_kept: int
    chunks_total: int
    bytes: int
    codec: str


def folder_bytes(spark: SparkSession, path: str) -> int:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def chunk_bytes(spark: SparkSession, path: str) -> DataFrame:
    """store_chunk, bytes: from the file listing, one row per file; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.groupBy("store_chunk").agg(F.sum("length").alias("bytes"))


class _Prefixes:
    """Coded chunks on scratch storage, and trial outputs made of their prefixes."""

    def __init__(
        self, coded: DataFrame, chunks: list[int], scratch: str, codec: str, cfg: ExportConfig
    ) -> None:
        self.spark = coded.sparkSession
        self.coded, self.chunks, self.scratch, self.codec, self.cfg = coded, chunks, scratch, codec, cfg
        self._stored = 0

    def _store(self, upto: int) -> None:
        """Code the chunks up to a position, each once."""
        if upto > self._stored:
            batch = self.chunks[self._stored : upto]
            rows = self.coded.where(F.col("store_chunk").between(batch[0], batch[-1]))
            writer = rows.write.mode("append").option("compression", self.codec).partitionBy("store_chunk")
            writer.parquet(f"{self.scratch}/coded")
            self._stored = upto

    def estimate(self, cap: int | None) -> int:
        """Chunks that fit going by the sum of their own sizes.

        Chunks are coded in growing batches until the cap is passed: the work
        follows the size of the output, not that of the predictions.
        """
        if cap is None:
            self._store(len(self.chunks))
            return len(self.chunks)
        upto = 1
        while True:
            self._store(upto)
            fitting = fitting_prefix(chunk_bytes(self.spark, f"{self.scratch}/coded"), cap).count()
            if fitting < upto or upto == len(self.chunks):
                return fitting
            upto = min(len(self.chunks), BATCH_GROWTH * upto)

    def write(self, upto: int, path: str) -> int:
        """Merge a prefix into one output, in order, and return its size."""
        self._store(upto)
        rows = self.spark.read.parquet(f"{self.scratch}/coded").where(
            F.col("store_chunk") <= self.chunks[upto - 1]
        )
        total = chunk_bytes(self.spark, f"{self.scratch}/coded").where(
            F.col("store_chunk") <= self.chunks[upto - 1]
        )
        files = math.ceil(total.agg(F.sum("bytes")).first()[0] / self.cfg.target_file_bytes)
        rows = rows.select(*EXPORT_COLUMNS)
        order = [PDV, PRODUTO, SEMANA]
        if files > 1:
            rows = rows.repartitionByRange(files, *order)
        else:
            rows = rows.coalesce(1)  # all of it is at most one file of the target size
        sinks.write_parquet(rows.sortWithinPartitions(*order), path, self.codec, self.cfg.row_group_rows)
        return folder_bytes(self.spark, path)

    def longest(self, cap: int | None) -> int:
        """The longest prefix whose merged output fits; at least one chunk.

        Trials start at the estimate and lengthen in doubling steps until one is
        too large; the border is then found by halving.
        """
        guess = self.estimate(cap)
        if cap is None:
            return guess
        last = len(self.chunks)
        fits, too_long = 0, last + 1
        trial, step = guess, 1
        while fits + 1 < too_long:
            if self.write(trial, f"{self.scratch}/trial-{trial}") <= cap:
                fits = trial
            else:
                too_long = trial
            trial = (fits + too_long) // 2 if too_long <= last else min(fits + step, last)
            step *= 2
        return max(fits, 1)


def load_predictions(spark: SparkSession, source: str | Sequence[str]) -> DataFrame:
    """Predictions under canonical names, from a run's folder, from one of chunk files or from listed chunk files."""
    if not isinstance(source, str):
        return _canonical(storage.read_chunk_files(spark, source))
    folder = source
    if path_exists(spark, f"{folder}/manifest"):
        chunks = spark.read.parquet(f"{folder}/chunk_digests")
        if not storage.pending_chunks(spark, folder, chunks).isEmpty():
            raise ValueError(f"the run in {folder} is unfinished or was refreshed with other input; start it again to complete it")
        return storage.read_chunks(spark, folder, chunks)
    if path_exists(spark, f"{folder}/settings"):
        return open_run(spark, folder).predictions()
    return _canonical(storage.read_chunk_files(spark, folder))


def _canonical(rows: DataFrame) -> DataFrame:
    roles = detect_roles(rows)
    return rows.select(
        "store_chunk", F.col(roles.store).alias(STORE), F.col(roles.product).alias(PRODUCT), "horizon", "prediction"
    )


def run_export(
    spark: SparkSession,
    predictions: DataFrame,
    out_path: str,
    cfg: ExportConfig = ExportConfig(),
    stores: DataFrame | None = None,
    products: DataFrame | None = None,
) -> ExportRun:
    """Write the integer layout of ``predictions`` (store_chunk, store, product, horizon, prediction).

    ``stores`` and ``products`` are the id lists to code by; by default those
    found in the predictions. The code maps are written beside the output. Predictions of a run that carry their codes
    are coded as they are, without a join, if its ``stores`` and ``products`` (with codes) are given.
    """
    out_path = out_path.rstrip("/")
    scratch = new_scratch(spark, "export")
    codes_known = {"store_code", "product_code"} <= set(predictions.columns) and stores is not None and products is not None
    if codes_known and "store_code" in stores.columns and "product_code" in products.columns:
        maps = stores.select(STORE, F.col("store_code").alias(PDV)), products.select(PRODUCT, F.col("product_code").alias(PRODUTO))
        coded = coded_layout(predictions)
    else:
        store_list, product_list = (
            storage.stage_table(spark, f"{scratch}/{column}", lambda: (predictions if given is None else given).select(column).distinct())
            for given, column in ((stores, STORE), (products, PRODUCT))
        )
        maps = tuple(storage.stage_table(spark, f"{scratch}/{name}", lambda: build) for name, build in (("s", store_codes(store_list)), ("p", product_codes(product_list))))
        coded = export_layout(predictions, *maps, store_list.count(), product_list.count())
    sinks.write_parquet(maps[0], f"{out_path}_stores")
    sinks.write_parquet(maps[1], f"{out_path}_products")

    # One id per chunk of stores reaches the driver.
    listed = stores if stores is not None and "store_chunk" in stores.columns else predictions
    chunks = sorted(row[0] for row in listed.select("store_chunk").distinct().collect())
    if not chunks:
        raise ValueError("there are no predictions to export")
    codec = sinks.usable_codec(spark, cfg.prefer_brotli)
    prefixes = _Prefixes(coded, chunks, f"{scratch}/prefixes", codec, cfg)
    cap = None if cfg.size_cap_mb is None else int(cfg.size_cap_mb * MIB)
    kept = prefixes.longest(cap)
    size = prefixes.write(kept, out_path)

    head_path = None
    if cfg.head_rows is not None:
        head_path = f"{out_path}_head{cfg.head_rows}"
        first = head(spark.read.parquet(out_path), cfg.head_rows)
        files = math.ceil(cfg.head_rows / HEAD_FILE_ROWS)
        order = [PDV, PRODUTO, SEMANA]
        first = first.repartitionByRange(files, *order) if files > 1 else first.coalesce(1)
        sinks.write_parquet(first.sortWithinPartitions(*order), head_path, codec, cfg.row_group_rows)
    return ExportRun(out_path, head_path, kept, len(chunks), size, codec)
