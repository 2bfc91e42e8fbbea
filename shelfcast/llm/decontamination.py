"""Benchmark decontamination by a generalised suffix automaton of the test items.

All items are inserted as word sequences into one automaton. A training text is streamed
through it word by word; the automaton holds the longest suffix read so far that occurs in
an item. Wherever that is at least a window long, the last ``window`` words are a window of
some item. An item shorter than a window counts when all of it occurs.

Spark cuts the items into pieces that share all but one word of a window, so every window lies whole in one piece,
and deals the pieces to shards of about ``SHARD_WORDS`` words. A shard is broadcast, and each worker builds its
automaton: its size is bounded whatever the benchmark's or an item's. A larger benchmark takes more passes, with one shard
at a time on the driver.

Defined results: null and empty texts have no words and no hits; an item without words (or
null) matches nothing; an item with a null id marks words, but is not listed; equal items and
repeated ids count once each per id; rows of documents are judged one by one, so repeated
rows give repeated results. Only the named columns are read.
"""

from __future__ import annotations

import re
import uuid
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import alnum_words, stored, texts_of, utf8

WINDOW = 10
SHARD_WORDS = 500_000
#: Text outside a word, for cutting spans from a text.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.length, self.link, self.next = [0], [-1], [{}]
        coded = []
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            if ids:
                coded.append((item, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.shortest = min([window, *(len(ids) for _, ids in coded)], default=window)
        # Links lead to shorter states, so these are found in the order of length, without walking chains.
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.at_window = [0] * len(self.length)
        for state in order:
            if self.length[state] >= window:
                up = self.link[state]
                self.at_window[state] = self.at_window[up] if self.length[up] >= window else state
        found: dict[int, set] = {}
        whole: dict[int, dict[int, set]] = {}
        for item, ids in coded:
            state, matched = 0, 0
            for at, c in enumerate(ids):
                state, matched = self.step(state, matched, c)
                if matched >= window:
                    found.setdefault(self.at_window[state], set()).add(item)
                elif at == len(ids) - 1:
                    whole.setdefault(state, {}).setdefault(len(ids), set()).add(item)
        self.items = {state: frozenset(x) for state, x in found.items()}
        self.whole = {state: [(n, frozenset(x)) for n, x in by.items()] for state, by in whole.items()}
        #: The nearest state up the links, itself included, at which a short item ends; 0: none.
        self.near = [0] * len(self.length) if whole else []
        for state in order if whole else ():
            self.near[state] = state if state in whole else self.near[self.link[state]]

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A state for the words of ``q`` that are one longer than those of ``p``."""
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return state

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        """State and length of the longest match after one more word."""
        while state and c not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        following = self.next[state].get(c)
        return (0, 0) if following is None else (following, matched + 1)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans (first word, end) of all hits, and the items that occur."""
        n = len(words)
        ids = np.fromiter(map(self.vocabulary.get, words, [-1] * n), np.int64, n)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False]))))
        spans: list[tuple[int, int]] = []
        items: set = set()

        def hit(first: int, end: int, by: frozenset) -> None:
            nonlocal items
            items |= by
            while spans and first <= spans[-1][1]:
                first = min(first, spans.pop()[0])
            spans.append((first, end))

        for first, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - first < self.shortest:
                continue
            state, matched = 0, 0
            for at, c in enumerate(ids[first:end].tolist(), first + 1):
                state, matched = self.step(state, matched, c)
                if matched >= self.window:
                    hit(at - self.window, at, self.items[self.at_window[state]])
                if self.whole:
                    up = self.near[state]
                    while up > 0:
                        for n_item, by in self.whole[up]:
                            if n_item <= matched:
                                hit(at - n_item, at, by)
                        up = self.near[self.link[up]]
        return spans, items


def _pieces(length: int, window: int):
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = alnum_words(text)
                for at in range(0, max(1, len(words) - window + 1) if words else 0, length - window + 1):
                    part = words[at : at + length]
                    for column, value in zip(out, (item, b" ".join(part), len(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.binary(), pa.int64()))], names=["item", "words", "n"])

    return run


def _benchmark(items: DataFrame, item_id: str, item_text: str, window: int) -> tuple[DataFrame, int]:
    """The pieces of all items, each with its shard, and the number of shards."""
    length = max(4 * window, SHARD_WORDS // 50)
    source = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    pieces = stored(source.mapInArrow(_pieces(length, window), "item string, words binary, n long").dropDuplicates(["item", "words"]), "decontamination-pieces")
    n = -(-(pieces.agg(F.sum("n")).first()[0] or 0) // SHARD_WORDS)
    if n <= 1:
        return pieces.withColumn("shard", F.lit(0)), n
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(n)).cast("int"))
    return stored(dealt.repartition("shard").sortWithinPartitions("shard"), "decontamination-shards"), n


def _shard(pieces: DataFrame, shard: int, window: int):
    """One shard, of about ``SHARD_WORDS`` words, for every task."""
    rows = [(row["item"], bytes(row["words"])) for row in pieces.where(F.col("shard") == shard).select("item", "words").collect()]
    return pieces.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows, window))


_automata: dict[str, SuffixAutomaton] = {}


def _built(shared) -> SuffixAutomaton:
    """The automaton of a broadcast shard, built once in each Python worker."""
    key = shared.value[0]
    if key not in _automata:
        _automata.clear()
        _automata[key] = SuffixAutomaton([(item, words.split()) for item, words in shared.value[1]], shared.value[2])
    return _automata[key]


def _passes(keyed: DataFrame, pieces: DataFrame, shards: int, window: int) -> DataFrame:
    """The hits of all rows of ``keyed`` (doc_id, text, row) in every shard; a shard is let go when its pass is written."""
    both = None
    for k in range(shards):
        shared = _shard(pieces, k, window)
        one = stored(_one_pass(keyed, shared), "decontamination-pass")
        shared.unpersist()
        both = one if both is None else both.unionByName(one)
    return both


HITS = "doc_id long, n_words long, starts array<long>, ends array<long>, items array<string>"


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """Per document row: number of words, hit spans in words (merged) and item ids as sorted strings."""

    def scan(batches, shards):
        for batch in batches:
            out = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = alnum_words(text)
                spans, found = [], set()
                for shared in shards:
                    more, by = _built(shared).scan(words)
                    spans, found = (_merged(spans + more), found | by) if more else (spans, found)
                row = (doc, len(words), [s for s, _ in spans], [e for _, e in spans], sorted({str(i) for i in found if i is not None}))
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "n_words", "starts", "ends", "items"])

    pieces, n_shards = _benchmark(items, item_id, item_text, window)
    source = texts_of(docs, id_col, text_col)
    if n_shards <= 1:
        shards = [_shard(pieces, 0, window)] if n_shards else []
        return source.mapInArrow(lambda batches: scan(batches, shards), HITS)
    # One pass for each shard keeps one automaton at a time in memory.
    keyed = stored(source.withColumn("row", F.monotonically_increasing_id()), "decontamination-rows")
    return (
        _passes(keyed, pieces, n_shards, window).groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("starts")).alias("s"),
            F.flatten(F.collect_list("ends")).alias("e"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        .drop("row")
        .mapInArrow(_merge_spans, HITS)
    )


def _one_pass(keyed: DataFrame, shared) -> DataFrame:
    def scan(batches):
        for batch in batches:
            rows = []
            for doc, text, row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "row"))):
                words = alnum_words(text)
                spans, found = _built(shared).scan(words)
                rows.append({"row": row, "doc_id": doc, "n_words": len(words), "starts": [s for s, _ in spans], "ends": [e for _, e in spans], "items": sorted({str(i) for i in found if i is not None})})
            schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return keyed.mapInArrow(scan, "row long, " + HITS)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def _merge_spans(batches):
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            spans = _merged(list(zip(x["s"], x["e"])))
            rows.append({"doc_id": x["doc_id"], "n_words": x["n_words"], "starts": [s for s, _ in spans], "ends": [e for _, e in spans], "items": x["items"]})
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``, each cut replaced by one blank."""
    raw, places = utf8(text), []
    for found in WORD.finditer(raw):
        places.append(found.span())
    kept, at = [], 0
    for first, end in spans:
        kept.append(raw[at : places[first][0]])
        at = places[end - 1][1]
    kept.append(raw[at:])
    return b" ".join(x.strip() for x in kept if x.strip()).decode("utf-8", "surrogatepass")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_coverage: float = 0.5,
) -> DataFrame:
    """``docs`` with hit spans cut out; a document covered beyond ``max_coverage`` is removed.

    Documents without hits come back unchanged, with all their columns. The text of the others
    loses its hit words; a column ``n_chars`` follows it. A benchmark of several shards takes one
    pass for each over the uncut texts; coverage is tested and texts are cut once, by the spans of all.
    """
    at = docs.columns.index(text_col)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    width, schema = len(docs.columns), docs.schema

    def cut(batch: pa.RecordBatch, texts: list, all_spans: list) -> pa.RecordBatch:
        keep, changed = np.ones(len(texts), bool), False
        before = list(texts)
        for i, spans in enumerate(all_spans):
            if spans:
                keep[i] = sum(e - s for s, e in spans) <= max_coverage * len(alnum_words(texts[i]))
                texts[i], changed = without_spans(texts[i], spans), True
        if not changed:
            return batch
        columns = batch.columns
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        if chars is not None:
            old = batch.column(chars).to_pylist()
            columns[chars] = pa.array([o if a == b else len(b) for o, a, b in zip(old, before, texts)], batch.schema.field(chars).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))

    pieces, n_shards = _benchmark(items, item_id, item_text, window)
    if not n_shards:
        return docs
    if n_shards == 1:
        shared = _shard(pieces, 0, window)

        def scan_and_cut(batches):
            for batch in batches:
                texts = batch.column(at).to_pylist()
                yield cut(batch, texts, [_built(shared).scan(alnum_words(t))[0] for t in texts])

        return docs.mapInArrow(scan_and_cut, schema)

    def cut_marked(batches):
        for batch in batches:
            starts, ends = (batch.column(width + k).to_pylist() for k in (0, 1))
            spans = [_merged(list(zip(s, e))) if s else [] for s, e in zip(starts, ends)]
            yield cut(batch.select(list(range(width))), batch.column(at).to_pylist(), spans)

    key, first, last = (f"{name}_{uuid.uuid4().hex}" for name in ("row", "starts", "ends"))
    keyed = stored(docs.withColumn(key, F.monotonically_increasing_id()), "decontamination-rows")
    source = texts_of(keyed, key, text_col).withColumn("row", F.col("doc_id"))
    both = _passes(source, pieces, n_shards, window).where("size(starts) > 0")
    spans = both.groupBy(F.col("row").alias(key)).agg(
        F.flatten(F.collect_list("starts")).alias(first), F.flatten(F.collect_list("ends")).alias(last)
    )
    return keyed.join(spans, key, "left").drop(key).mapInArrow(cut_marked, schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query, derived from ``contamination``."""
    hit = F.aggregate(
        F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda total, x: total + x
    )
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )
