"""Tables of a run on shared storage, and chunks that survive a restart."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from shelfcast.session import path_exists

#: A chunk's entries in the order they were made; the last one counts, and one without a digest withdraws the chunk.
MANIFEST_SCHEMA = "store_chunk int, digest string, entry long"
#: How much larger the next job of `write_chunks` is than the one before.
JOB_GROWTH = 4


def stage_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, computed and written first unless an earlier attempt finished it.

    Later steps read files, so a lost executor costs the tasks it ran and not
    the whole way back to the transactions.
    """
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def manifest(spark: SparkSession, run_dir: str) -> DataFrame:
    """Every entry made so far: one row per chunk and write of it."""
    path = f"{run_dir}/manifest"
    if not path_exists(spark, path):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(path)


def committed_chunks(spark: SparkSession, run_dir: str) -> DataFrame:
    """store_chunk, digest of the chunks that are whole, as last written."""
    last = manifest(spark, run_dir).groupBy("store_chunk").agg(F.max_by("digest", "entry").alias("digest"))
    return last.where("digest is not null")


def _same_chunk(wanted: DataFrame) -> list[str]:
    return ["store_chunk", "digest"] if "digest" in wanted.columns else ["store_chunk"]


def pending_chunks(spark: SparkSession, run_dir: str, wanted: DataFrame) -> DataFrame:
    """The chunks of ``wanted`` (store_chunk and, if it has one, digest) that no finished write has recorded.

    With a digest, a chunk written from other facts is pending again.
    """
    on = _same_chunk(wanted)
    return wanted.select(*on).distinct().join(committed_chunks(spark, run_dir), on, "left_anti")


def write_chunks(
    spark: SparkSession,
    run_dir: str,
    chunks: Sequence[tuple[int, str]],
    build: Callable[[Sequence[int]], DataFrame],
    per_commit: int,
    max_commits: int | None = None,
    most_chunks: int | None = None,
) -> int:
    """Write predictions by chunk, in batches of ``per_commit``; returns the chunks written.

    ``chunks`` are ids with the digest of their facts. A directory alone does not prove that its
    chunk is whole: ids enter the manifest after their batch is committed, a batch that
    broke off is overwritten as a whole by the next attempt, and a chunk to be overwritten is withdrawn first.

    The first batch is a job of its own; later jobs commit growing numbers of batches, of ``most_chunks`` chunks at
    most (or one batch), so that jobs follow the amount of work and not the number of small chunks.
    """
    top = manifest(spark, run_dir).agg(F.max("entry")).first()[0]
    entry = 0 if top is None else top + 1

    def note(batches: Sequence[Sequence[tuple[int, str | None]]]) -> None:
        nonlocal entry
        rows = [(int(c), d, entry + i) for i, batch in enumerate(batches) for c, d in batch]
        spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{run_dir}/manifest")
        entry += len(batches)

    batches = [chunks[i : i + per_commit] for i in range(0, len(chunks), per_commit)][:max_commits]
    if batches and top is not None:
        note([[(c, None) for batch in batches for c, _ in batch]])
    for job in _jobs(batches, per_commit, most_chunks):
        (
            build([c for batch in job for c, _ in batch])
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("store_chunk")
            .parquet(f"{run_dir}/predictions")
        )
        note(job)
    return sum(map(len, batches))


def _jobs(batches: Sequence, per_commit: int, most_chunks: int | None) -> Iterator[Sequence]:
    """Batches by job: one, then ``JOB_GROWTH`` times as many each, up to the limit; one each without a limit."""
    most = max(1, (most_chunks or 0) // per_commit)
    start, size = 0, 1
    while start < len(batches):
        yield batches[start : start + size]
        start, size = start + size, min(most, size * JOB_GROWTH)


def read_chunks(spark: SparkSession, run_dir: str, wanted: DataFrame) -> DataFrame:
    """The committed chunks among ``wanted`` (see `pending_chunks`), and only those."""
    on = _same_chunk(wanted)
    whole = committed_chunks(spark, run_dir).join(wanted.select(*on).distinct(), on, "left_semi")
    # At most one row per chunk of stores.
    return spark.read.parquet(f"{run_dir}/predictions").join(F.broadcast(whole.select("store_chunk")), "store_chunk", "left_semi")


def read_chunk_files(spark: SparkSession, source: str | Sequence[str]) -> DataFrame:
    """Predictions from a folder of ``chunk_<n>.parquet`` files or of ``store_chunk=<n>`` folders.

    ``source`` may also list files, each named ``chunk_<n>.parquet`` or lying in a folder ``store_chunk=<n>``;
    a file that is listed twice is read once.
    """
    if not isinstance(source, str):
        return _listed_chunk_files(spark, sorted(set(source)))
    folder = source
    if not path_exists(spark, folder):
        raise FileNotFoundError(f"no such folder: {folder}")
    rows = _parquet_if_any(spark.read.option("pathGlobFilter", "chunk_*.parquet"), folder)
    if rows is not None:
        return rows.select("*", _chunk_number().alias("store_chunk"))
    rows = _parquet_if_any(spark.read, folder)
    if rows is None or "store_chunk" not in rows.columns:
        raise FileNotFoundError(f"no chunk_*.parquet and no store_chunk=* under {folder}")
    return rows


#: Where a chunk file's path has its number.
CHUNK_NUMBER = r"chunk[_=](\d+)(?:\.parquet$|/[^/]*$)"


def _chunk_number() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), CHUNK_NUMBER, 1).cast("int")


def _listed_chunk_files(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    nameless = [f for f in files if not re.search(CHUNK_NUMBER, f)]
    if not files or nameless:
        raise ValueError(f"files without a chunk number: {nameless}" if files else "no files are listed")
    try:
        rows = spark.read.parquet(*files)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(str(error)) from error
        raise
    return rows.drop("store_chunk").select("*", _chunk_number().alias("store_chunk"))


def _parquet_if_any(reader: DataFrameReader, folder: str) -> DataFrame | None:
    try:
        return reader.parquet(folder)
    except AnalysisException as error:
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise
