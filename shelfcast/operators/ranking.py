"""Ranks over a whole table without sending it through one task.

Rows are put into ordered buckets, each bucket is ranked by itself, and the
number of rows in earlier buckets is added. Only the bucket counts (a few
thousand rows at most, by construction) meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import new_scratch
from shelfcast.sources.storage import stage_table

DIGEST_PREFIX = 3  # hex digits: 4,096 buckets


def global_row_number(rows: DataFrame, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Add the 1-based position of each row under (bucket, order), and ``_total``, the number of rows."""
    rows = rows.withColumn("_bucket", bucket)
    by_bucket = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = (
        rows.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(
            "_bucket",
            F.coalesce(F.sum("_size").over(by_bucket), F.lit(0)).alias("_before"),
            F.sum("_size").over(everything).alias("_total"),
        )
    )
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return (
        rows.withColumn("_within", within)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_bucket", "_before", "_within")
    )


def positions(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the 1-based position of each row under ``order``, a total order of the rows.

    The rows are range-partitioned (every key is looked up among the sorted borders by halving), sorted
    within partitions and written with their place there; the counts of earlier partitions, one row for
    each, are added. Written once, so that all readers see the same ranges.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    path = new_scratch(rows.sparkSession, "positions")
    placed = stage_table(rows.sparkSession, path, lambda: placed)
    # The id of a row is its partition, shifted by 33 bits, plus its place within.
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(offsets, "_part").withColumn(name, F.col("_before") + place + 1).drop("_part", "_before", "_place")


def dense_codes(ids: DataFrame, column: str, code: str) -> DataFrame:
    """Codes 1..n for distinct ids, ascending by id (a dense rank of the list)."""
    return positions(ids, [F.col(column)], code)


#: Relative error of the quantile that bounds the candidates of ``top_rows``.
ACCURACY = 10_000


def top_rows(rows: DataFrame, value: str, ids: list[str], n_rows: int, wanted: int) -> DataFrame:
    """The ``wanted`` rows of the greatest ``value``, ties to the smaller ids.

    A quantile that is surely low enough leaves about twice as many rows as wanted; only these are sorted, by ranges.
    """
    share = (2 * wanted + 1) / max(n_rows, 1) + 2 / ACCURACY
    if share < 1:
        cut = rows.agg(F.percentile_approx(value, 1 - share, ACCURACY)).scalar()
        rows = rows.where(F.col(value) >= cut)
    order = [F.col(value).desc(), *(F.col(c) for c in ids)]
    return positions(rows, order, "_position").where(F.col("_position") <= wanted).drop("_position")


def sample_fraction(rows: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Exactly ``round(fraction * n)`` rows (halves to even) of a table with unique keys.

    The rows with the smallest seeded digests are taken, so the choice depends on
    the keys and the seed only, not on partitioning.
    """
    rows = rows.withColumn("_digest", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))))
    ranked = global_row_number(
        rows, F.substring("_digest", 1, DIGEST_PREFIX), [F.col("_digest"), F.col(key)], "_position"
    )
    wanted = F.bround(F.lit(fraction) * F.col("_total"))
    return ranked.where(F.col("_position") <= wanted).drop("_digest", "_position", "_total")
