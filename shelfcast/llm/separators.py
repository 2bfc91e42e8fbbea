"""Token counts by a scan for separators in flat token files without an index.

Flat files hold nothing but token ids, 16 bits each, little-endian; an end id closes every document. The scan
cuts files into blocks of fixed size and searches each for the end id with vector operations. Documents go
on over borders of blocks, so a block's first end needs to know where the last one before it was: a prefix scan
over the blocks of a file (running maximum of the last end, running sum of the number of ends)
stitches them. A block is one row whatever it holds, so the scan runs over few and small rows.

Defined results: an empty file has no documents; tokens after the last end are a document without an end
(``closed`` is false); a document of just the end id has 0 tokens; a file whose size is no multiple of a token's
raises. Writing: null and empty texts are documents of 0 tokens, null ids stay null, repeated rows are
documents of their own. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import stored, texts_of
from shelfcast.llm.files import Writer, read_range, task_file
from shelfcast.llm.tokenizing import encoder
from shelfcast.session import new_scratch

TOKEN = np.dtype("<u2")
#: The vocabulary's own end-of-text id.
END = 50256
BLOCK_TOKENS = 1 << 20
FILE_BYTES = 64 << 20
#: Blocks of a task, and tasks at most.
TASK_BLOCKS = 8
MOST_TASKS = 20_000


def _write(folder: str, end: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, out, ordinal = encoder(), None, 0
        for batch in batches:
            docs = batch.column(0).to_pylist()
            paths, ordinals, sizes = [], [], []
            for text in batch.column(1).to_pylist():
                if out is None:
                    out, ordinal = Writer(task_file(folder, ".tokens")), 0
                ids = ids_of.encode(text)
                out.write(np.append(ids, end).astype(TOKEN).tobytes())
                paths.append(out.path)
                ordinals.append(ordinal)
                sizes.append(out.size)
                ordinal += 1
                if out.size >= file_bytes:
                    with out:
                        pass
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(ordinals, pa.int64()), pa.array(docs, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "ordinal", "doc_id", "end_byte"])
        if out is not None:
            with out:
                pass

    return run


def write_flat(docs: DataFrame, folder: str | None = None, end: int = END, file_bytes: int = FILE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents as flat files; (path, ordinal, doc_id, end_byte): which document is where in a file's order."""
    folder = folder or new_scratch(docs.sparkSession, "tokens")
    source = texts_of(docs, id_col, text_col)
    return stored(source.mapInArrow(_write(folder, end, file_bytes), "path string, ordinal long, doc_id long, end_byte long"), "separators-written")


BLOCK = "path string, block long, first long, last long, n_ends long, n_tokens long"


def _ends(path: str, block: int, size: int, end: int, block_tokens: int) -> tuple[np.ndarray, int, int]:
    """Places of the end id in a block, in the file's tokens; the block's first token and number of tokens."""
    start = block * block_tokens * TOKEN.itemsize
    ids = np.frombuffer(read_range(path, start, min(size - start, block_tokens * TOKEN.itemsize)), TOKEN)
    return np.flatnonzero(ids == end) + block * block_tokens, block * block_tokens, len(ids)


def count_tokens(files: DataFrame, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per document: path, ordinal (its place in the file), start (token), n_tokens (without the end) and closed.

    files: path and bytes of each flat file.
    """
    width = TOKEN.itemsize
    checked = files.select("path", F.when(F.col("bytes") % width == 0, F.col("bytes")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(" is no whole number of tokens")))).alias("bytes"))
    blocks = checked.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / (block_tokens * width)))).alias("block"))
    blocks = stored(blocks, "separators-blocks")
    # By their few bytes the rows of blocks would all go to one task, so the number of tasks is given.
    tasks = min(MOST_TASKS, max(1, blocks.count() // TASK_BLOCKS))

    def scan(batches):
        for batch in batches:
            rows = [[], [], [], []]
            for path, size, block in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "block"))):
                ends, _, n = _ends(path, block, size, end, block_tokens)
                for column, value in zip(rows, (int(ends[0]) if len(ends) else None, int(ends[-1]) if len(ends) else None, len(ends), n)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in rows)], names=["path", "block", "first", "last", "n_ends", "n_tokens"])

    found = blocks.repartition(tasks, "path", "block").mapInArrow(scan, BLOCK)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    carried = stored(
        found.withColumn("last_before", F.coalesce(F.max("last").over(before), F.lit(-1)))
        .withColumn("ends_before", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
        .withColumn("final", F.col("block") == F.max("block").over(whole)),
        "separators-carried",
    )

    def documents(batches):
        for batch in batches:
            for x in batch.to_pylist():
                ends, at, n = _ends(x["path"], x["block"], (x["block"] * block_tokens + x["n_tokens"]) * width, end, block_tokens)
                starts = np.concatenate(([x["last_before"]], ends[:-1])) + 1 if len(ends) else np.zeros(0, np.int64)
                closed = np.ones(len(ends), bool)
                stop = ends
                open_from = (int(ends[-1]) if len(ends) else x["last_before"]) + 1
                if x["final"] and open_from < at + n:
                    starts, stop, closed = np.append(starts, open_from), np.append(ends, at + n), np.append(closed, False)
                m = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["path"]] * m, pa.string()), pa.array(x["ends_before"] + np.arange(m)), pa.array(starts.astype(np.int64)), pa.array((stop - starts).astype(np.int64)), pa.array(closed)],
                    names=["path", "ordinal", "start", "n_tokens", "closed"],
                )

    return carried.repartition(tasks, "path", "block").mapInArrow(documents, "path string, ordinal long, start long, n_tokens long, closed boolean")


def document_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per document row: doc_id and n_tokens, counted in flat files written from the texts."""
    written = write_flat(docs, id_col=id_col, text_col=text_col)
    files = written.groupBy("path").agg(F.max("end_byte").alias("bytes"))
    counted = stored(count_tokens(files, block_tokens=block_tokens), "separators-counted")
    return written.join(counted, ["path", "ordinal"]).select("doc_id", "n_tokens")
