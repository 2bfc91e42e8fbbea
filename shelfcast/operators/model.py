"""One boosted-tree model per horizon, trained on the top pairs and applied to all that still sell."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from shelfcast.config import FEATURES, PAIR, ForecastConfig
from shelfcast.functions.numbers import clip_at_zero
from shelfcast.operators import boosting
from shelfcast.operators.boosting import TreeModel
from shelfcast.operators.panel import last_points
from shelfcast.session import new_scratch
from shelfcast.sources.storage import stage_table


@dataclass(frozen=True)
class Split:
    """Sizes of one horizon's training and validation sets."""

    horizon: int
    train_rows: int
    valid_rows: int


def split_conditions(
    horizon: int, last_time: Column, cfg: ForecastConfig = ForecastConfig()
) -> tuple[Column, Column]:
    """Which rows train and which validate the model of one horizon.

    The last weeks are held back. Targets are later *rows*, so a training row's
    target may lie among them; ``strict_split`` drops such rows.
    """
    cutoff = last_time - F.lit(max(cfg.horizons) + 1)
    has_target = F.col(f"target_h{horizon}").isNotNull()
    train = (F.col("time_idx") <= cutoff) & has_target
    if cfg.strict_split:
        train = train & (F.col(f"target_time_h{horizon}") <= cutoff)
    valid = (
        (F.col("time_idx") > cutoff) & (F.col("time_idx") <= last_time - F.lit(horizon)) & has_target
    )
    return train, valid


def split_counts(panel: DataFrame, cfg: ForecastConfig = ForecastConfig()) -> DataFrame:
    """horizon, train_rows, valid_rows, from one aggregate over the panel."""
    last_time = panel.agg(F.max("time_idx")).scalar()
    panel = panel.withColumn("_last", last_time)
    counts = []
    for h in cfg.horizons:
        train, valid = split_conditions(h, F.col("_last"), cfg)
        counts += [F.count_if(train).alias(f"train_{h}"), F.count_if(valid).alias(f"valid_{h}")]
    per_horizon = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon"),
                F.col(f"train_{h}").alias("train_rows"),
                F.col(f"valid_{h}").alias("valid_rows"),
            )
            for h in cfg.horizons
        ]
    )
    return panel.agg(*counts).select(F.inline(per_horizon))


def train_models(
    panel: DataFrame, cfg: ForecastConfig = ForecastConfig(), pairs: DataFrame | None = None
) -> tuple[dict[int, TreeModel | None], list[Split]]:
    """One model per horizon, or None where there are fewer than ``min_train_rows`` labelled rows.

    Only the rows of ``pairs`` are learned from, if given: that bounds the labelled
    rows, and not which pairs are scored later. The rows are written once, packed into blocks of
    ``train_rows_per_block``; horizons are independent and are fitted side by side.
    """
    spark = panel.sparkSession
    if pairs is not None:
        panel = panel.join(pairs.select(*PAIR), PAIR, "left_semi")
    targets = [c for c in panel.columns if c.startswith("target_")]
    rows = stage_table(spark, new_scratch(spark, "training"), lambda: panel.select(*PAIR, *FEATURES, *targets))
    splits = [Split(*row) for row in split_counts(rows, cfg).collect()]
    fitted = [s.horizon for s in splits if s.train_rows >= max(1, cfg.min_train_rows)]
    models: dict[int, TreeModel | None] = {s.horizon: None for s in splits}
    if fitted:
        n_rows, last_time = rows.agg(F.count("*"), F.max("time_idx")).first()
        edges = boosting.bin_edges(rows, FEATURES, n_rows, cfg)
        conditions = {h: split_conditions(h, F.lit(last_time), cfg) for h in fitted}
        n_blocks = math.ceil(n_rows / cfg.train_rows_per_block)
        blocks = stage_table(spark, new_scratch(spark, "blocks"), lambda: boosting.blocks_of(rows, FEATURES, conditions, edges, n_blocks))

        def side_by_side(calls: list) -> list:
            with ThreadPoolExecutor(cfg.fit_parallelism) as pool:
                # Each call gets its own wrapper: the thread inherits the job properties of the caller.
                return [job.result() for job in [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]]

        models |= boosting.fit(blocks, edges, fitted, cfg, side_by_side)
    return models, splits


def score_last_points(
    panel: DataFrame, models: dict[int, TreeModel | None], cfg: ForecastConfig = ForecastConfig()
) -> DataFrame:
    """store_id, product_id, override: one value per horizon for each pair's last row.

    A horizon without a model yields 0, or null (keep the base value) if so
    configured. Empty if there is no model at all.
    """
    if not any(models.values()):
        return panel.where(F.lit(False)).select(*PAIR, F.lit(None).cast("array<double>").alias("override"))
    fitted = {h: m for h, m in models.items() if m is not None}
    points = last_points(panel).select(*PAIR, *[F.col(f).cast("double").alias(f) for f in FEATURES])
    keys = [points.schema[k] for k in PAIR]

    def predict(batches):
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(f)).to_numpy(zero_copy_only=False) for f in FEATURES]
            bins = boosting.binned(columns, next(iter(fitted.values())).edges)
            values = [pa.array(m.predict(bins)) for m in fitted.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *values], names=[*PAIR, *(f"pred_h{h}" for h in fitted)])

    schema = StructType([*keys, *(StructField(f"pred_h{h}", DoubleType()) for h in fitted)])
    missing = F.lit(0.0) if cfg.missing_model == "zero" else F.lit(None).cast("double")
    values = [clip_at_zero(F.col(f"pred_h{h}")) if h in fitted else missing for h in cfg.horizons]
    return points.mapInArrow(predict, schema).select(*PAIR, F.array(*values).alias("override"))


def overrides_to_rows(overrides: DataFrame) -> DataFrame:
    """store_id, product_id, horizon, prediction: one row per value."""
    return overrides.select(*PAIR, F.posexplode("override").alias("_i", "prediction")).select(
        *PAIR, (F.col("_i") + 1).alias("horizon"), "prediction"
    )


def overrides_from_rows(rows: DataFrame, cfg: ForecastConfig = ForecastConfig()) -> DataFrame:
    """The inverse: gather rows per pair; absent horizons are 0 or left to the base."""
    missing = F.lit(0.0) if cfg.missing_model == "zero" else F.lit(None).cast("double")
    values = [
        F.coalesce(F.max(F.when(F.col("horizon") == h, F.col("prediction"))), missing) for h in cfg.horizons
    ]
    return rows.groupBy(*PAIR).agg(F.array(*values).alias("override"))
