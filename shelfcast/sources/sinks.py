"""Final outputs: parquet with a codec and row groups of a given size, and CSV."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from shelfcast.session import new_scratch


def write_parquet(
    df: DataFrame, path: str, codec: str | None = None, row_group_rows: int | None = None
) -> None:
    writer = df.write.mode("overwrite")
    if codec:
        writer = writer.option("compression", codec)
    if row_group_rows:
        writer = writer.option("parquet.block.row.count.limit", row_group_rows)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """path, row_group, rows, codec of the parquet files in a folder; tasks read the footers alone."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                # Hadoop writes file:/x for what is file:///x elsewhere.
                files, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
                with files.open_input_file(inner) as handle:
                    footer = pq.ParquetFile(handle).metadata
                groups = [footer.row_group(i) for i in range(footer.num_row_groups)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "path": [name] * len(groups),
                        "row_group": pa.array(range(len(groups)), pa.int32()),
                        "rows": pa.array([g.num_rows for g in groups], pa.int64()),
                        "codec": pa.array([g.column(0).compression.lower() for g in groups], pa.string()),
                    }
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return files.mapInArrow(footers, "path string, row_group int, rows long, codec string")


def usable_codec(spark: SparkSession, prefer_brotli: bool) -> str:
    """``brotli`` if asked for and installed on the executors, else ``gzip``."""
    if prefer_brotli:
        try:
            write_parquet(spark.range(1), new_scratch(spark, "codec"), "brotli")
            return "brotli"
        except (PySparkException, Py4JError):
            pass
    return "gzip"
