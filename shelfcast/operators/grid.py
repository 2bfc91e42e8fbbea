"""One prediction for every store, product and horizon.

The result has stores x products x horizons rows, most of them determined by
the product alone; only pairs that are extinct, have their own recent average or
a model forecast differ. So the primary result is one value per product and the
facts of the pairs that differ: `asked_pairs` answers for any list of pairs from these. The
dense grid is made on request, and never joined or shuffled as such. Its unit of work is a cell, one product in one chunk of stores (at most
``store_chunk_size`` of them): the pairs that differ are attached to their cell
as a short list, cells are spread evenly over tasks, and only then is each cell
unfolded into its stores and horizons, with no exchange behind it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.config import PAIR, PRODUCT, STORE, ForecastConfig
from shelfcast.functions.numbers import clip_at_zero, finite_or_zero
from shelfcast.operators.ranking import dense_codes
from shelfcast.operators.sizes import broadcast_if_small, is_small

# Pairs that a task unfolds, about, where chunks are smaller than that.
PAIRS_PER_TASK = 200_000


def chunk_stores(stores: DataFrame, cfg: ForecastConfig = ForecastConfig()) -> DataFrame:
    """store_id, store_code, store_chunk: stores in ascending order, in chunks of fixed size."""
    coded = dense_codes(stores, STORE, "store_code")
    chunk = F.floor((F.col("store_code") - 1) / F.lit(cfg.store_chunk_size)).cast("int")
    return coded.withColumn("store_chunk", chunk)


def product_facts(universe: DataFrame, stats: DataFrame, representative: DataFrame) -> DataFrame:
    """product_id, product_code, global_avg (null if not sold recently), is_representative."""
    flagged = representative.select(PRODUCT, F.lit(True).alias("is_representative"))
    return (
        dense_codes(universe, PRODUCT, "product_code").join(stats.select(PRODUCT, "global_avg"), PRODUCT, "left")
        .join(flagged, PRODUCT, "left")
        .withColumn("is_representative", F.coalesce("is_representative", F.lit(False)))
    )


def pair_facts(
    stats: DataFrame,
    stores: DataFrame,
    products: DataFrame,
    overrides: DataFrame | None,
    n_stores: int,
    n_products: int,
    cfg: ForecastConfig = ForecastConfig(),
) -> DataFrame:
    """The pairs whose forecast differs from their product's average.

    ``overrides`` holds (store_id, product_id, override), one array of values per
    pair of ``stats``. Inner joins drop pairs of unknown stores and products, so
    that these disturb nothing else.
    """
    own = F.col("recent_quantity") / F.col("recent_weeks")
    flags = broadcast_if_small(products.select(PRODUCT, "is_representative"), n_products)
    pairs = stats.join(flags, PRODUCT).select(
        *PAIR,
        "extinct",
        F.when(F.col("is_representative") & (F.col("recent_weeks") > 0), own).alias("pair_avg"),
    )
    if overrides is None:
        pairs = pairs.withColumn("override", F.lit(None).cast("array<double>"))
    else:
        overrides = overrides.select(*PAIR, "override")
        pairs = pairs.join(overrides, PAIR, "left")
    chunks = broadcast_if_small(stores.select(STORE, "store_code", "store_chunk"), n_stores)
    return pairs.where("extinct or pair_avg is not null or override is not null").join(chunks, STORE)


def base_value(cfg: ForecastConfig) -> Column:
    """The forecast without a model: zero, the pair's own average, or the product's."""
    own = clip_at_zero(F.col("pair_avg"))
    base = F.when(F.col("pair_avg").isNotNull(), own).otherwise(F.coalesce("global_avg", F.lit(0.0)))
    if cfg.clip_base:
        base = finite_or_zero(base)
    return F.when(F.col("extinct"), F.lit(0.0)).otherwise(base)


def forecast_pairs(
    stores: DataFrame,
    products: DataFrame,
    facts: DataFrame,
    n_stores: int,
    n_products: int,
    cfg: ForecastConfig = ForecastConfig(),
    chunks: Sequence[int] | None = None,
) -> DataFrame:
    """store_chunk, store_id, product_id, their codes, extinct, base, override for all pairs of the chunks.

    Codes come with the cell and its lists, so nothing has to be joined to the unfolded rows.
    """
    n_chunks = math.ceil(n_stores / cfg.store_chunk_size) if chunks is None else len(chunks)
    n_blocks = max(1, math.ceil(n_products / cfg.products_per_block))
    n_makers = max(n_blocks, min(n_products, math.ceil(n_chunks * n_products / PAIRS_PER_TASK)))
    if n_makers > 1:
        products = products.repartition(n_makers, PRODUCT)  # or a few tasks would make all cells
    products = products.select(
        PRODUCT,
        "product_code",
        "global_avg",
        F.pmod(F.xxhash64(PRODUCT), F.lit(n_blocks)).cast("int").alias("product_block"),
    )
    if chunks is None:
        cells = products.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(n_chunks - 1, 0)))).alias("store_chunk"))
    else:
        # Many chunks make a table, not an expression of as many literals.
        wanted = F.broadcast(stores.sparkSession.createDataFrame([(int(c),) for c in chunks], "store_chunk int"))
        if chunks:  # the bounds skip the row groups of other chunks
            within = F.col("store_chunk").between(min(chunks), max(chunks))
            stores, facts = stores.where(within), facts.where(within)
        stores, facts = (df.join(wanted, "store_chunk", "left_semi") for df in (stores, facts))
        cells = products.crossJoin(wanted)
    # A list holds one entry per store of the chunk at most.
    entry = F.struct(STORE, "store_code", "extinct", "pair_avg", "override")
    listed = facts.groupBy("store_chunk", PRODUCT).agg(F.collect_list(entry).alias("known"))
    members = stores.groupBy("store_chunk").agg(F.collect_list(F.struct(STORE, "store_code")).alias("members"))

    # Tasks by the pairs to unfold, one per block of a chunk at most: unfolding multiplies rows, which the sizes
    # seen by adaptive execution do not show. Small chunks share a task, or tasks would be as many as chunks.
    cells = cells.join(listed, ["store_chunk", PRODUCT], "left")
    by_pairs = math.ceil(n_chunks * cfg.store_chunk_size * n_products / PAIRS_PER_TASK)
    n_tasks = max(1, min(n_chunks * n_blocks, max(by_pairs, 2 * stores.sparkSession.sparkContext.defaultParallelism)))
    if is_small(n_chunks * cfg.store_chunk_size):
        task = F.col("store_chunk") * F.lit(n_blocks) + F.col("product_block")
        cells = cells.repartitionById(n_tasks, task).join(F.broadcast(members), "store_chunk")
    else:
        # Too many stores to send to every task: each block of a chunk gets its own copy of the list.
        members = members.withColumn("product_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        keys = ["store_chunk", "product_block"]
        cells = cells.repartition(n_tasks, *keys).join(members, keys)

    known = F.coalesce("known", F.array().cast(listed.schema["known"].dataType))
    others = F.transform(
        F.array_except("members", F.transform(known, lambda k: F.struct(k[STORE].alias(STORE), k["store_code"].alias("store_code")))),
        lambda store: F.struct(
            store[STORE].alias(STORE),
            store["store_code"].alias("store_code"),
            F.lit(False).alias("extinct"),
            F.lit(None).cast("double").alias("pair_avg"),
            F.lit(None).cast("array<double>").alias("override"),
        ),
    )
    unfolded = cells.select("store_chunk", PRODUCT, "product_code", "global_avg", F.inline(F.concat(known, others)))
    return unfolded.select(
        "store_chunk", *PAIR, "store_code", "product_code", "extinct", base_value(cfg).alias("base"), "override"
    )


def asked_pairs(
    asked: DataFrame, stores: DataFrame, products: DataFrame, facts: DataFrame, cfg: ForecastConfig = ForecastConfig()
) -> DataFrame:
    """The same columns for the asked pairs only (store_id, product_id); the grid is not unfolded.

    A pair is its product's value unless it is among the facts. Pairs of unknown stores or products
    are left out; a pair asked twice is answered twice.
    """
    own = facts.select(*PAIR, "extinct", "pair_avg", "override")
    found = (
        asked.select(*PAIR)
        .join(stores.select(STORE, "store_code", "store_chunk"), STORE)
        .join(products.select(PRODUCT, "product_code", "global_avg"), PRODUCT)
        .join(own, PAIR, "left")
        .withColumn("extinct", F.coalesce("extinct", F.lit(False)))
    )
    return found.select("store_chunk", *PAIR, "store_code", "product_code", "extinct", base_value(cfg).alias("base"), "override")


def forecast(pairs: DataFrame, cfg: ForecastConfig = ForecastConfig()) -> DataFrame:
    """store_chunk, store_id, product_id, codes, horizon, prediction; an override never revives an extinct pair."""
    horizons = F.explode(F.array(*[F.lit(h) for h in cfg.horizons])).alias("horizon")
    value = F.coalesce(F.get("override", F.col("horizon") - 1), F.col("base"))
    return pairs.select("*", horizons).select(
        "store_chunk",
        *PAIR,
        *[c for c in ("store_code", "product_code") if c in pairs.columns],
        "horizon",
        F.when(F.col("extinct"), F.lit(0.0)).otherwise(value).alias("prediction"),
    )
