"""Vector best-fit packing of tokenised documents into sequences.

A document is its token ids and an end id. One longer than a sequence is cut so that all pieces but
the first are full. A bin has three residual capacities: tokens, documents and attention cost (the sum of
squared lengths, the cost of attention within documents). Pieces are placed in decreasing length. Among
the open bins in which a piece fits under every constraint, the one with the largest weighted dot product
of piece and residual, or with the least weighted norm of what would remain, takes it.

Tokens weigh most, so that sequences are few; documents and attention cost weigh a twentieth each and
decide between bins that tokens hardly tell apart.

Full pieces are sequences of their own. All others are spread evenly over groups by a hash of the number
each piece gets when it is written; each group is packed by one task in the order of length and number, with
the bins of equal residual capacities kept together, so a choice looks at the different residuals only. A group ends with
at most a few bins that are not nearly full, so the loss falls with the size of the groups. As pieces are numbered in a
written table, a task that is run again packs the same way.

Defined results: null and empty texts are documents of just the end id; rows that share an id are
documents of their own; null ids stay null;
an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import stored, texts_of
from shelfcast.llm.tokenizing import ID, encoder

LENGTH = 1024
END = 2
#: Pieces of a group; about one bin of each group stays badly filled.
GROUP_PIECES = 100_000
#: Of tokens, documents and attention cost.
WEIGHTS = (1.0, 0.05, 0.05)


def _pieces(length: int, end: int, vocabulary: str | None, ranks: str | None):
    def run(batches):
        ids_of = encoder(vocabulary, ranks)
        tail = np.array([end], ID)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate((ids_of.encode(text), tail))
                cut = len(ids) % length or min(len(ids), length)
                start, piece = 0, 0
                while start < len(ids):
                    stop = cut if piece == 0 else start + length
                    for column, value in zip(out, (doc, piece, start, stop - start, zlib.crc32(ids[start:stop]), number)):
                        column.append(value)
                    start, piece, number = stop, piece + 1, number + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "number"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return run


def best_fit(
    lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float], by: str = "dot"
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. capacity: tokens, documents, cost; by: "dot" or "norm"."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = np.array(capacity, np.float64)
    scale = np.array(weights, np.float64)
    # Bins with the same residual are alike: the first opened is taken first.
    alike: dict[tuple[int, int, int], list[int]] = {}
    residual = np.zeros((64, 3))
    keys: list[tuple[int, int, int] | None] = [None] * 64
    row_of: dict[tuple[int, int, int], int] = {}
    free = list(range(63, -1, -1))
    opened = 0

    def put(key: tuple[int, int, int], which: int) -> None:
        nonlocal residual
        if min(key) <= 0:
            return
        if key in alike:
            heapq.heappush(alike[key], which)
            return
        if not free:
            free.extend(range(2 * len(keys) - 1, len(keys) - 1, -1))
            residual = np.vstack([residual, np.zeros_like(residual)])
            keys.extend([None] * len(keys))
        row = free.pop()
        alike[key], row_of[key], keys[row] = [which], row, key
        residual[row] = key

    def take(key: tuple[int, int, int]) -> int:
        which = heapq.heappop(alike[key])
        if not alike[key]:
            row = row_of.pop(key)
            del alike[key]
            residual[row], keys[row] = 0.0, None
            free.append(row)
        return which

    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        need = np.array((n, 1, n * n), np.float64)
        if (need > full).any():
            raise ValueError(f"a piece of {n} tokens fits in no sequence")
        fits = np.flatnonzero((residual >= need).all(axis=1))
        if len(fits):
            left = residual[fits]
            if by == "dot":
                # In shares of the capacities; fuller bins win, as the residual norm is taken off.
                score = ((left / full) * (need / full) * scale).sum(axis=1) - ((left / full) ** 2 * scale).sum(axis=1)
            else:
                score = -((((left - need) / full) ** 2) * scale).sum(axis=1)
            key = keys[fits[int(np.argmax(score))]]
            which = take(key)
        else:
            key, which, opened = tuple(int(c) for c in capacity), opened, opened + 1
        bins[i], offsets[i] = which, capacity[0] - key[0]
        put((key[0] - n, key[1] - 1, key[2] - n * n), which)
    return bins, offsets


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _pack(capacity, weights, by):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        bins, offsets = best_fit(table.column("length").to_numpy(), capacity, weights, by)
        # Even numbers: packed sequences; odd ones: full pieces.
        ids = ((np.int64(task) << np.int64(32)) + bins) * 2
        table = table.drop_columns(["number"])
        yield from table.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets)).to_batches(65_536)

    return run


def packed(
    docs: DataFrame,
    length: int = LENGTH,
    end: int = END,
    max_documents: int | None = None,
    max_cost: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    by: str = "norm",
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    ranks: str | None = None,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    By default the document and cost capacities are those a sequence of ``length`` tokens can't exceed: the fewest sequences.
    """
    capacity = (length, max_documents or length, max_cost or length * length)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, number long"
    pieces = stored(texts_of(docs, id_col, text_col).mapInArrow(_pieces(length, end, vocabulary, ranks), schema), "packing-pieces")
    whole = pieces.where(F.col("length") == length)
    rest = pieces.where(F.col("length") < length)
    groups = 1 + rest.count() // GROUP_PIECES
    spread = rest.repartition(groups, F.xxhash64("number")).sortWithinPartitions("number")
    alone = whole.select("*", (F.col("number") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).drop("number")
    return alone.unionByName(spread.mapInArrow(_pack(capacity, weights, by), PACKED))
