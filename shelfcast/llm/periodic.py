"""Runs: stretches of words that repeat with a period, found by block convolution at dyadic scales.

A run is a stretch whose smallest period is q (words q apart are the same), at least ``max(least, exponent * q)``
words long, that no neighbouring word continues. For the scale L = 1, 2, 4, … of the periods L to 2L - 1:

1. The text is cut into blocks of L words. A run of at least 4 q words holds a whole block whose copy q words
   later is in the run too, and that copy lies in the 2L words after the block.
2. An exact number-theoretic transform (modulo the prime ``PRIME``, numpy integers, all blocks at
   once) correlates every block with its window: ``sum (x - y)^2 = sum x^2 + sum y^2 - 2 sum x y``. Where that is zero the
   block occurs; a sum that is only a multiple of the prime is no occurrence and goes when words are compared.
3. An occurrence at distance q that no run of a shorter period explains is a seed. It is extended
   word by word, in doubling steps, in both directions, and is a run if long enough.

Texts are dealt out by Spark; a task works on a bounded number of words at a time, but for a single longer
text, whose blocks are still taken a slab at a time. A text of n words takes O(n log^2 n).

Defined results: null and empty texts and those without words have no runs and the empty text as result; null
ids take part; repeated rows get repeated results; words are compared as bytes. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import blank_words, texts_of

#: 15 * 2^27 + 1 with the primitive root 31: fixed values, any such prime below 2^31 would do.
PRIME, ROOT = 2013265921, 31
LEAST = 6
EXPONENT = 4
#: Words that are searched together, and values of a slab of transforms.
CHUNK = 1 << 15
SLAB = 1 << 14

_P = np.uint64(PRIME)
_roots: dict[tuple[int, bool], np.ndarray] = {}

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _mod(x: np.ndarray) -> np.ndarray:
    return x - (x // _P) * _P  # division by a constant is vectorised, the remainder isn't


def _less(x: np.ndarray) -> np.ndarray:
    """Remainder of values below twice the prime: a difference below zero wraps around to a large one."""
    return np.minimum(x, x - _P)


def _powers(n: int, inverse: bool) -> np.ndarray:
    """The first n/2 powers of an n-th root of unity (or of its inverse)."""
    if (n, inverse) not in _roots:
        w = pow(ROOT, (PRIME - 1) // n, PRIME)
        w = pow(w, -1, PRIME) if inverse else w
        out = np.ones(max(1, n // 2), np.uint64)
        done = 1
        while done < len(out):
            step = np.uint64(pow(w, done, PRIME))
            more = min(done, len(out) - done)
            out[done : done + more] = _mod(out[:more] * step)
            done += more
        _roots[n, inverse] = out
    return _roots[n, inverse]


def transform(x: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of every row, in bit-reversed order. x: rows of 2^k values below PRIME."""
    n = x.shape[1]
    x = x.copy()
    while n > 1:
        pairs = x.reshape(x.shape[0], -1, 2, n // 2)
        low, high = pairs[:, :, 0], pairs[:, :, 1]
        total, apart = _less(low + high), low + (_P - high)
        pairs[:, :, 1] = _mod(apart * _powers(n, False))
        pairs[:, :, 0] = total
        n //= 2
    return x


def inverse(x: np.ndarray) -> np.ndarray:
    """The inverse of ``transform``: from bit-reversed to natural order."""
    size = x.shape[1]
    x = x.copy()
    n = 2
    while n <= size:
        pairs = x.reshape(x.shape[0], -1, 2, n // 2)
        low, high = pairs[:, :, 0], _mod(pairs[:, :, 1] * _powers(n, True))
        total, apart = _less(low + high), _less(low + (_P - high))
        pairs[:, :, 0], pairs[:, :, 1] = total, apart
        n *= 2
    return _mod(x * np.uint64(pow(size, -1, PRIME)))


def zero_mismatches(values: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Block starts and distances in [scale, 2 scale) at which the block of ``scale`` values occurs again.

    values: positive integers. Sums of squared differences are exact modulo PRIME, so no
    occurrence is missed; a very rare one too many has to be told apart by comparing values.
    """
    n = len(values)
    blocks = n // scale
    rows = max(1, SLAB // (2 * scale))
    padded = np.zeros((blocks + 2) * scale + scale, np.uint64)
    padded[: min(n, len(padded))] = values[: len(padded)]
    padded = _mod(padded)
    starts, distances = [], []
    for lo in range(0, blocks, rows):
        hi = min(blocks, lo + rows)
        x = padded[lo * scale : hi * scale].reshape(-1, scale)
        window = np.lib.stride_tricks.sliding_window_view(padded[(lo + 1) * scale : (hi + 2) * scale], 2 * scale)[::scale]
        # Read backwards, the block turns the convolution into a correlation; lags below scale don't wrap around.
        backwards = np.zeros((hi - lo, 2 * scale), np.uint64)
        backwards[:, 0] = x[:, 0]
        backwards[:, scale + 1 :] = x[:, :0:-1]
        both = inverse(_mod(transform(backwards) * transform(window)))[:, :scale]
        squares = np.zeros((hi - lo, 2 * scale + 1), np.uint64)
        np.cumsum(_mod(window * window), axis=1, out=squares[:, 1:])
        ahead = squares[:, scale : 2 * scale] - squares[:, :scale]
        own = _mod(x * x).sum(axis=1, dtype=np.uint64)[:, None]
        block, lag = np.nonzero(_mod(own + ahead) == _mod(both + both))
        starts.append((block + lo) * scale)
        distances.append(lag + scale)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(distances)


def _reach(values: np.ndarray, at: int, distance: int, step: int) -> int:
    """How many values from ``at`` on (``step`` 1) or up to it (-1) equal those ``distance`` later."""
    n, found, width = len(values), 0, 16
    while True:
        if step > 0:
            width = min(width, n - distance - at - found)
            here = slice(at + found, at + found + max(0, width))
            there = slice(here.start + distance, here.stop + distance)
            wrong = np.flatnonzero(values[here] != values[there])
        else:
            width = min(width, at - found + 1)
            here = slice(at - found - width + 1, at - found + 1)
            there = slice(here.start + distance, here.stop + distance)
            wrong = np.flatnonzero((values[here] != values[there])[::-1])
        if len(wrong):
            return found + int(wrong[0])
        if width <= 0:
            return found
        found += width
        width *= 2


def find_runs(values: np.ndarray, lengths: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period.

    values: positive integers of one or more texts in a row, of which no two share a value; lengths:
    their numbers of values, longest first (short texts aren't searched for long periods). exponent: 4 or more.
    """
    ends = np.cumsum(lengths)
    runs: list[tuple[int, int, int]] = []
    covered = np.zeros(len(values), np.int64)  # for each place, the end of the longest reaching run known there
    scale = 1
    while True:
        texts = int(np.count_nonzero(lengths >= max(least, exponent * scale)))
        if not texts:
            break
        part = values[: ends[texts - 1]]
        starts, distances = zero_mismatches(part, scale)
        fresh = (starts + distances + scale <= len(part)) & (covered[np.minimum(starts, len(part) - 1)] < starts + distances + scale)
        last: dict[int, int] = {}  # for each distance, up to where its stretches are known
        for start, distance in zip(starts[fresh].tolist(), distances[fresh].tolist()):
            if last.get(distance, -1) >= start + scale:
                continue
            ahead = _reach(part, start, distance, 1)
            if ahead < scale:
                continue  # a multiple of the prime
            begin = start - _reach(part, start - 1, distance, -1)
            last[distance] = start + ahead
            length = start + ahead + distance - begin
            if length < max(least, exponent * distance) or covered[begin] >= begin + length:
                continue
            runs.append((begin, length, distance))
            np.maximum(covered[begin : begin + length], begin + length, out=covered[begin : begin + length])
        scale *= 2
    return np.array(sorted((s, q, n) for s, n, q in runs), np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def _numbered(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths for ``find_runs``: a number for each different word of each text."""
    values, base = [], 1
    for own in words:
        seen: dict[bytes, int] = {}
        numbers = [seen.setdefault(w, len(seen)) for w in own]
        values.append(np.array(numbers, np.uint64) + np.uint64(base))
        base += len(seen)
    return np.concatenate(values), np.array([len(w) for w in words], np.int64)


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([w for w, k in zip(words, keep.tolist()) if k])


def _collapse(rewrite: Rewrite | None, least: int, exponent: int):
    def chunk(ids: list[int | None], words: list[list[bytes]]) -> pa.RecordBatch:
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        values, lengths = _numbered([words[i] for i in order])
        runs = find_runs(values, lengths, least, exponent)
        ends = np.cumsum(lengths)
        found: list[list[tuple[int, int, int]]] = [[] for _ in words]
        for text, (start, length, period) in zip(np.searchsorted(ends, runs[:, 0], side="right").tolist(), runs.tolist()):
            found[order[text]].append((start - int(ends[text] - lengths[text]), length, period))
        flat = np.array([r for own in found for r in own], np.int64).reshape(-1, 3)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(own) for own in found]), pa.int32()), structs)
        texts = pa.array([_kept(w, own).decode("utf-8", "surrogatepass") for w, own in zip(words, found)], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), lists, texts], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches):
        for batch in batches:
            ids: list[int | None] = []
            words: list[list[bytes]] = []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = blank_words(text.as_py())
                if rewrite:
                    own = rewrite(doc_id, own)
                if words and held + len(own) > CHUNK:
                    yield chunk(ids, words)
                    ids, words, held = [], [], 0
                ids.append(doc_id)
                words.append(own)
                held += len(own)
            if words:
                yield chunk(ids, words)

    return run


SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def collapsed(
    docs: DataFrame,
    least: int = LEAST,
    exponent: int = EXPONENT,
    rewrite: Rewrite | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document row: doc_id, n_words, runs (by start, then period) and the text without their repeats.

    Of each run its first period stays. ``rewrite`` may change a text's words before they are searched.
    """
    if exponent < 4:
        raise ValueError("a run shorter than four periods may hold no whole block and its copy")
    return texts_of(docs, id_col, text_col).mapInArrow(_collapse(rewrite, least, exponent), SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: the longest run, and hashes of all runs and of the collapsed text."""
    # Of equally long runs the first by start and period: the greatest of negated places.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.when(F.size("runs") == 0, "").otherwise(F.concat(F.array_join(line, "\n"), F.lit("\n")))

    def sha256(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    return found.withColumn("_longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_longest.start")).alias("start"),
        F.col("_longest.length").alias("length"),
        (-F.col("_longest.period")).alias("period"),
        F.floor(F.col("_longest.length") * 1000 / -F.col("_longest.period")).alias("exponent_milli"),
        sha256(lines).alias("runs_sha256"),
        sha256(F.col("collapsed")).alias("collapsed_sha256"),
    )


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's rewriting: the end of every tenth text, by the crc32 of its id, becomes periodic."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]
