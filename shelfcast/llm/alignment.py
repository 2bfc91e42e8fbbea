"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

1. A text with a space before it is encoded by a byte-level BPE (A) and, as it is, by a piece model (B, which adds the space
   itself). Both give token lengths in bytes, so every token has an end on the same scale of byte offsets.
2. An interval of A and B tokens that begin and end together is searched for a common end near its
   middle: A's ends are tried from the middle outwards, each by bisection among B's ends. It is cut there and both halves go on. An
   interval without a common end inside is a group. All intervals of a chunk of texts take the same step at once (numpy).
3. An A and a B token whose byte ranges overlap are linked: there is one link for each stretch between
   neighbouring ends of either kind. Tasks count the documents of each pair of ids, Spark adds the counts.
4. Links are valued by those counts. The most frequent pairs, at most ``HEAD`` of them, go to every task;
   all others are rarer and are joined by Spark, so nothing sent grows with the corpus and no join key is hot.

Defined results: texts that are null, empty, or not spelled exactly by their tokens (those with U+2581, for one) have no tokens,
groups or links; null ids take part; repeated rows are documents of their own, each counted; an empty table
gives an empty one. A longer text than a chunk is a chunk of its own. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import stored, texts_of, utf8
from shelfcast.llm.tokenizing import RANKS, VOCABULARY, encoder

PIECES = "piece_bpe_32k.model"
#: Bytes of text, or tokens, that are worked on together.
CHUNK = 1 << 19
#: A's ends that are tried one by one before the rest of an interval is searched at once.
TRIES = 16
#: Pairs of ids that go to every task, about 20 bytes each.
HEAD = 1 << 20


@dataclass(frozen=True)
class Files:
    """Paths of the vocabulary files; by default the public ones."""

    vocabulary: str = ""
    ranks: str = ""
    pieces: str = ""

    def paths(self) -> tuple[str, str, str]:
        names = ((self.vocabulary, VOCABULARY), (self.ranks, RANKS), (self.pieces, PIECES))
        return tuple(given or public_tokenizers.path(name) for given, name in names)


class Pair:
    """Both tokenizers of a worker, and the bytes of their tokens by id."""

    def __init__(self, vocabulary: str, ranks: str, pieces: str) -> None:
        self.a = encoder(vocabulary, ranks)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(ranks, "rb") as lines:
            by_id = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
        self.bytes_a = [by_id.get(i, b"") for i in range(max(self.a.tokenizer.get_vocab_size(), max(by_id) + 1))]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.length_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.length_b = np.array([len(t) for t in self.bytes_b], np.int64)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else utf8(piece.replace("▁", " "))

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B for each text; none at all where either doesn't spell the text."""
        none = np.zeros(0, np.int64)
        out_a, out_b = [none] * len(texts), [none] * len(texts)
        full = [i for i, t in enumerate(texts) if t]
        for i, ids_b in zip(full, self.b.encode([texts[i] for i in full], num_threads=1)):
            raw = utf8(" " + texts[i])
            ids_a = self.a.encode(" " + texts[i])
            token_a, token_b = self.bytes_a, self.bytes_b
            if b"".join([token_b[t] for t in ids_b]) == raw and b"".join([token_a[t] for t in ids_a.tolist()]) == raw:
                out_a[i], out_b[i] = ids_a.astype(np.int64), np.frombuffer(array("I", ids_b), np.uint32).astype(np.int64)
        return out_a, out_b


_pairs: dict[tuple[str, str, str], Pair] = {}


def pair_of(files: Files) -> Pair:
    paths = files.paths()
    if paths not in _pairs:
        _pairs[paths] = Pair(*paths)
    return _pairs[paths]


def _nearest(candidates: np.ndarray, ends: np.ndarray) -> tuple[int, int]:
    """The candidate nearest to the middle that is among ``ends``, and its place there (-1, -1: none)."""
    at = np.searchsorted(ends, candidates)
    hits = np.flatnonzero(ends[np.minimum(at, len(ends) - 1)] == candidates)
    if not len(hits):
        return -1, -1
    best = int(hits[np.argmin(np.abs(hits - len(candidates) // 2))])
    return best, int(at[best])


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the A and B tokens that close a group.

    ends_*: increasing byte ends of one or more texts in a row; last_*: index of each text's last token.
    """
    closes_a, closes_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    closes_a[last_a], closes_b[last_b] = True, True
    # Open intervals: first and last token of A and of B; the ends of the last ones are common.
    lo_a, hi_a = np.concatenate(([0], last_a[:-1] + 1)), last_a
    lo_b, hi_b = np.concatenate(([0], last_b[:-1] + 1)), last_b
    tried = np.zeros(len(lo_a), np.int64)
    while True:
        inside = (hi_a - lo_a > tried) & (hi_b > lo_b)
        lo_a, hi_a, lo_b, hi_b, tried = (x[inside] for x in (lo_a, hi_a, lo_b, hi_b, tried))
        if not len(lo_a):
            return closes_a, closes_b
        # From the middle outwards: 0, -1, 1, -2, 2, …
        step = (tried + 1) // 2
        at_a = lo_a + (hi_a - lo_a) // 2 + np.where(tried % 2, -step, step)
        wanted = ends_a[at_a]
        at_b = np.searchsorted(ends_b, wanted)
        found = ends_b[at_b] == wanted
        for i in np.flatnonzero(~found & (tried + 1 >= TRIES)).tolist():
            a, b = _nearest(ends_a[lo_a[i] : hi_a[i]], ends_b[lo_b[i] : hi_b[i]])
            if a >= 0:
                at_a[i], at_b[i], found[i] = lo_a[i] + a, lo_b[i] + b, True
            else:
                hi_a[i] = lo_a[i]  # a group
        closes_a[at_a[found]], closes_b[at_b[found]] = True, True
        rest = ~found
        lo_a, hi_a, lo_b, hi_b, tried = (
            np.concatenate(parts)
            for parts in (
                (lo_a[found], at_a[found] + 1, lo_a[rest]),
                (at_a[found], hi_a[found], hi_a[rest]),
                (lo_b[found], at_b[found] + 1, lo_b[rest]),
                (at_b[found], hi_b[found], hi_b[rest]),
                (np.zeros(2 * np.count_nonzero(found), np.int64), tried[rest] + 1),
            )
        )


#: Ids as packed little-endian numbers of the vocabulary's width; one bit for each token, set where a group ends.
COLUMNS = ("a", "b", "closes_a", "closes_b")
ALIGNED = "doc_id long, a binary, b binary, closes_a binary, closes_b binary"


def _id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _align(files: Files):
    def chunk(ids: list[int | None], texts: list[str | None]) -> pa.RecordBatch:
        pair = pair_of(files)
        each_a, each_b = pair.encode(texts)
        n_a, n_b = (np.array([len(x) for x in each], np.int64) for each in (each_a, each_b))
        a, b = np.concatenate(each_a), np.concatenate(each_b)
        full = n_a > 0
        last_a, last_b = np.cumsum(n_a)[full] - 1, np.cumsum(n_b)[full] - 1
        closes_a, closes_b = shared_cuts(np.cumsum(pair.length_a[a]), np.cumsum(pair.length_b[b]), last_a, last_b)
        columns = []
        for each, closes, n in ((each_a, closes_a, n_a), (each_b, closes_b, n_b)):
            kind = _id_type(len(pair.bytes_a if each is each_a else pair.bytes_b))
            columns.append((pa.array([x.astype(kind).tobytes() for x in each], pa.binary()), pa.array([np.packbits(c).tobytes() for c in np.split(closes, np.cumsum(n)[:-1])], pa.binary())))
        (ids_a, bits_a), (ids_b, bits_b) = columns
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), ids_a, ids_b, bits_a, bits_b], names=["doc_id", *COLUMNS])

    def run(batches):
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                if ids and held + len(text or "") > CHUNK:
                    yield chunk(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                held += len(text or "")
            if ids:
                yield chunk(ids, texts)

    return run


def aligned(docs: DataFrame, files: Files = Files(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, the packed ids a and b, and the bits of the tokens that close a group."""
    return texts_of(docs, id_col, text_col).mapInArrow(_align(files), ALIGNED)


@dataclass
class Chunk:
    """Some documents of an aligned table, their tokens in a row."""

    first: int
    n_a: np.ndarray
    n_b: np.ndarray
    a: np.ndarray
    b: np.ndarray
    closes_a: np.ndarray
    closes_b: np.ndarray

    def documents(self, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sums of ``values``, one for each token, over the documents."""
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts]


def _chunks(batch: pa.RecordBatch, size_a: int, size_b: int) -> Iterator[Chunk]:
    columns = [batch.column(batch.schema.get_field_index(c)) for c in COLUMNS]
    kinds = [np.dtype(_id_type(size)) for size in (size_a, size_b)]
    counts = [pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) // k.itemsize for c, k in zip(columns, kinds)]
    held = np.concatenate(([0], np.cumsum(counts[0] + counts[1])))
    start = 0
    while start < batch.num_rows:
        stop = min(batch.num_rows, max(start + 1, int(np.searchsorted(held, held[start] + CHUNK, side="right")) - 1))
        n = [c[start:stop] for c in counts]
        ids = [np.frombuffer(b"".join(c.slice(start, stop - start).to_pylist()), k).astype(np.int64) for c, k in zip(columns, kinds)]
        bits = [
            np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=m) for x, m in zip(c.slice(start, stop - start).to_pylist(), own.tolist())]).astype(bool)
            for c, own in zip(columns[2:], n)
        ]
        yield Chunk(start, *n, *ids, *bits)
        start = stop


@dataclass(frozen=True)
class Lengths:
    """Bytes of the tokens of both vocabularies by id: all that links need of the tokenizers."""

    a: np.ndarray
    b: np.ndarray


def lengths(files: Files = Files()) -> Lengths:
    pair = pair_of(files)
    return Lengths(pair.length_a, pair.length_b)


def document_links(chunk: Chunk, lengths: Lengths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair of ids (A's times B's vocabulary size, plus B's), document and number of links, by pair and document."""
    a, b = chunk.a, chunk.b
    if not len(a):
        return (np.zeros(0, np.int64),) * 3
    ends_a, ends_b = np.cumsum(lengths.a[a]), np.cumsum(lengths.b[b])
    marks = np.zeros((2, ends_a[-1] + 1), bool)
    marks[0, ends_a], marks[1, ends_b] = True, True
    cuts = np.flatnonzero(marks[0] | marks[1])
    # A stretch belongs to the tokens that end with it or are the next to end.
    in_a, in_b = (np.concatenate(([0], np.cumsum(m[cuts])[:-1])) for m in marks)
    docs = len(chunk.n_a)
    document = np.repeat(np.arange(docs), chunk.n_a)[in_a]
    key = np.sort((a[in_a] * len(lengths.b) + b[in_b]) * docs + document)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first] // docs, key[first] % docs, np.diff(np.append(first, len(key)))


def pair_counts(table: DataFrame, lengths: Lengths) -> DataFrame:
    """Per linked pair of ids: pair, docs (documents that hold it linked), best (no pair of its A id has more)."""
    sizes = len(lengths.a), len(lengths.b)

    def run(batches):
        for batch in batches:
            for chunk in _chunks(batch, *sizes):
                pairs, _, _ = document_links(chunk, lengths)
                found, docs = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(found // sizes[1]), pa.array(docs)], names=["pair", "a", "docs"])

    counted = table.select(*COLUMNS).mapInArrow(run, "pair long, a long, docs long").groupBy("pair", "a").agg(F.sum("docs").alias("docs"))
    best = F.col("docs") == F.max("docs").over(Window.partitionBy("a"))  # at most B's vocabulary for each A id
    return counted.select("pair", "docs", best.alias("best"))


def groups(table: DataFrame, files: Files = Files()) -> DataFrame:
    """An aligned table written out: doc_id, group (from 0), its ids of A and of B."""
    sizes = [len(x) for x in (lengths(files).a, lengths(files).b)]

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for chunk in _chunks(batch, *sizes):
                n = chunk.documents(chunk.closes_a, chunk.n_a)
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.flatnonzero(closes) + 1)), pa.int32()), pa.array(x, pa.int32()))
                    for x, closes in ((chunk.a, chunk.closes_a), (chunk.b, chunk.closes_b))
                ]
                own = pa.array(chunk.first + np.repeat(np.arange(len(n)), n))
                number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([ids.take(own), pa.array(number), *lists], names=["doc_id", "group", "a", "b"])

    return table.select("doc_id", *COLUMNS).mapInArrow(run, "doc_id long, group long, a array<int>, b array<int>")


def head_limit(pairs: DataFrame, head: int) -> int:
    """The least power of two such that at most ``head`` pairs have that many documents or more."""
    rows = pairs.groupBy(F.floor(F.log2("docs")).alias("power")).agg(F.count("*").alias("n")).collect()  # at most 63
    limit, held = 1 << 62, 0
    for row in sorted(rows, key=lambda r: -r["power"]):
        held += row["n"]
        if held > head:
            break
        limit = 1 << row["power"]
    return limit


def _spelled(chunk: Chunk, words: list[bytes], size_a: int) -> list[str]:
    """For each document the hash of ``a1,a2|b1;a3|b2,b3``; words: each id followed by each separator."""
    sizes_a, sizes_b = (np.diff(np.flatnonzero(c), prepend=-1) for c in (chunk.closes_a, chunk.closes_b))
    group_a, group_b = (np.repeat(np.arange(len(s)), s) for s in (sizes_a, sizes_b))
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    code = np.empty(len(chunk.a) + len(chunk.b), np.int64)
    code[np.arange(len(chunk.a)) + (ends_b - sizes_b)[group_a]] = 2 * chunk.a + chunk.closes_a
    code[np.arange(len(chunk.b)) + ends_a[group_b]] = 2 * (size_a + chunk.b) + chunk.closes_b
    out, start = [], 0
    for n in (chunk.n_a + chunk.n_b).tolist():
        spelled = b"".join([words[c] for c in code[start : start + n].tolist()])
        out.append(hashlib.sha256(spelled[:-1]).hexdigest() if n else "")
        start += n
    return out


VALUED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, "
    "rare array<long>, rare_links array<long>"
)


def _value(lengths: Lengths, keys: np.ndarray, docs: np.ndarray, best: np.ndarray):
    sizes = len(lengths.a), len(lengths.b)

    def run(batches):
        words = [b"%d%s" % (i, s) for i in range(sizes[0]) for s in (b",", b"|")]
        words += [b"%d%s" % (i, s) for i in range(sizes[1]) for s in (b",", b";")]
        for batch in batches:
            for chunk in _chunks(batch, *sizes):
                rows = len(chunk.n_a)
                pairs, document, links = document_links(chunk, lengths)
                at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
                known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
                weights = [links, links[known] * best[at[known]], links[known] * docs[at[known]]]
                sums = [np.zeros(rows, np.int64) for _ in weights]
                for total, weight, where in zip(sums, weights, (document, document[known], document[known])):
                    np.add.at(total, where, weight)  # exact in 64 bits, unlike weights of bincount
                order = np.argsort(document[~known], kind="stable")
                rare = np.bincount(document[~known], minlength=rows)
                offsets = pa.array(np.concatenate(([0], np.cumsum(rare))), pa.int32())
                columns = [
                    *(batch.column(batch.schema.get_field_index(c)).slice(chunk.first, rows) for c in ("row", "doc_id")),
                    *(pa.array(x) for x in (chunk.n_a, chunk.n_b, chunk.documents(chunk.closes_a, chunk.n_a), *sums)),
                    pa.array(_spelled(chunk, words, sizes[0]), pa.string()),
                    *(pa.ListArray.from_arrays(offsets, pa.array(x[~known][order])) for x in (pairs, links)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in VALUED.split(", ")])

    return run


def valued(docs: DataFrame, files: Files = Files(), id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Per document row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    table = aligned(docs, files, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    table = stored(table, "alignment-groups")
    sizes = lengths(files)
    pairs = stored(pair_counts(table, sizes), "alignment-pairs")
    limit = head_limit(pairs, head)
    frequent = pairs.where(F.col("docs") >= limit).toPandas().sort_values("pair")  # at most ``head`` rows
    keys, counts, best = (frequent[c].to_numpy(np.int64) for c in ("pair", "docs", "best"))
    rows = stored(table.mapInArrow(_value(sizes, keys, counts, best), VALUED), "alignment-rows")
    rare = rows.where(F.size("rare") > 0).select("row", F.inline(F.arrays_zip(F.col("rare").alias("pair"), F.col("rare_links").alias("links"))))
    sums = (
        rare.join(pairs.where(F.col("docs") < limit), "pair")
        .groupBy("row")
        .agg(F.sum(F.col("links") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("links") * F.col("docs")).alias("more_docs"))
    )
    total = {c: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c) for c, more in (("n_best", F.col("more_best")), ("count_sum", F.col("more_docs")))}
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", total["n_best"], total["count_sum"], "groups_sha256")
