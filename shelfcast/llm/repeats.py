"""Substring dedup by prefix-partitioned suffix trees.

A window is ``window`` consecutive words of one document. A word is removed if a window that covers it
also starts in a document with a smaller id; windows are judged on the input.

1. Texts with equal words are one: the smallest id stands for them, the others repeat all of it.
2. Each window has an anchor, its least hash of ``GRAM`` words. Equal windows have equal anchors, so
   only windows whose anchor occurs in two different texts can repeat; all others drop out here.
3. Suffixes are split by prefixes. Those of neighbouring windows with the same anchor travel as one segment of the text,
   the words that they cover, to the group of the anchor: the words that all its windows share are the group's prefix,
   so a segment is sent once and not once for each of its suffixes. A group of more than ``GROUP_BYTES`` is split by the
   longest prefix there is, a whole window: its suffixes, spelt in the hashes of their halves, are sorted over the
   cluster into ranges of equal size, so that even one window in very many texts is spread over several tasks.
4. A task builds the subtree of each group down to a window's depth. Words are numbered in their order, and places are ranked by
   their next 2, 4, 8, ... words, which sorts the suffixes word by word and tells their common prefixes: suffixes with equal
   ranks of ``window`` words hang below one inner node of that depth. Leaves behind a smaller id repeat; of a sorted
   range the nodes are runs of equal spellings, and a node cut by a border is settled with the border nodes of
   all ranges. Repeating leaves that follow each other in a document are together a maximal repeat.

Subtrees compare the words themselves. Windows of split groups are compared by 128 bits, and so are whole texts.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; rows with
a null id are neither judged nor sources; rows that share an id are no sources for each other, repeated
rows get repeated results. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import blank_words, filter_bit, gram_hashes, id_filter, lists, passing, signed, stored, texts_of, word_hashes

WINDOW = 50
GRAM = 10
#: Text of a subtree; its words and ranks take about 40 times as much in a task.
GROUP_BYTES = 4 << 20
#: Text dealt to a task, which takes it a few groups at a time.
TASK_BYTES = 256 << 20
#: Suffixes of a range: about 40 MB in a task.
RANGE_ROWS = 400_000

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _running(a: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every ``width`` consecutive values."""
    out, have = a, 1
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    return out if have == width else best(out[: len(a) - width + 1], out[width - have :])


def anchors(words: np.ndarray, window: int) -> np.ndarray:
    """The anchor of every window, in order."""
    grams = gram_hashes(words, min(GRAM, window))
    return _running(grams, window - min(GRAM, window) + 1, np.minimum)


#: 128 bits of a text's words: texts with equal ones are equal.
CONTENT = ["c1", "c2"]


def _content(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:16], "little", signed=True)


def _contents(keys: list[tuple[int, int] | None]) -> list[pa.Array]:
    return [pa.array([k and k[i] for k in keys], pa.int64()) for i in (0, 1)]


def _text_key(text: str | None) -> tuple[int, int]:
    return _content(hashlib.sha256(b" ".join(blank_words(text))).digest())


def _describe(window: int):
    def run(batches):
        for batch in batches:
            key, n_words, shas, marks, ends = [], [], [], [], [0]
            for text in batch.column(1).to_pylist():
                words = blank_words(text)
                joined = b" ".join(words)
                full = hashlib.sha256(joined)
                shas.append(full.hexdigest())
                key.append(_content(full.digest()))
                n_words.append(len(words))
                if len(words) >= window:
                    marks.append(np.unique(anchors(word_hashes(words), window)))
                ends.append(ends[-1] + (len(marks[-1]) if len(words) >= window else 0))
            flat = signed(np.concatenate(marks)) if marks else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *_contents(key), pa.array(n_words, pa.int64()), pa.array(shas, pa.string()), lists(ends, pa.array(flat))],
                names=["doc_id", *CONTENT, "n_words", "sha", "anchors"],
            )

    return run


SEGMENT = "anchor long, doc_id long, c1 long, c2 long, start int, words binary"


def _segments(window: int):
    """The words of every run of windows with one shared anchor, and where the run begins."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    names = ["anchor", "doc_id", *CONTENT, "start", "words"]

    def run(batches):
        out, held = [[] for _ in names], 0
        for batch in batches:
            for doc, c1, c2, text, shared in zip(*(batch.column(c).to_pylist() for c in ("doc_id", *CONTENT, "text", "shared"))):
                words = blank_words(text)
                own = np.sort(np.array(shared, np.int64).view(np.uint64))
                marks = anchors(word_hashes(words), window)
                at = np.searchsorted(own, marks)
                starts = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == marks)
                if not len(starts):
                    continue
                kind = marks[starts]
                cut = np.flatnonzero((np.diff(starts) != 1) | (kind[1:] != kind[:-1])) + 1
                first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(starts)])) - 1
                for anchor, begin, end in zip(signed(kind[first]).tolist(), starts[first].tolist(), (starts[last] + window).tolist()):
                    segment = b" ".join(words[begin:end])
                    held += len(segment)
                    for column, value in zip(out, (anchor, doc, c1, c2, begin, segment)):
                        column.append(value)
                if held > GROUP_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
                    out, held = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return run


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of each pair (a, b) among all pairs; equal pairs have equal ranks."""
    return np.unique(a * (b.max(initial=0) + 1) + b, return_inverse=True)[1]


def deep_nodes(words: list[bytes], window: int) -> np.ndarray:
    """For every place that has ``window`` words: the rank of these words in word order, which is its node at that depth."""
    ids: dict[bytes, int] = {}
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    order = np.empty(len(ids), np.int64)
    order[[ids[w] for w in sorted(ids)]] = np.arange(len(ids))
    ranks, have = order[numbers], 1
    while have * 2 <= window:
        ranks = _ranks(ranks[:-have], ranks[have:])
        have *= 2
    return ranks if have == window else _ranks(ranks[: len(words) - window + 1], ranks[window - have :])


def _subtree(segments: pa.Table, window: int) -> pa.RecordBatch:
    """The repeating leaves of the subtrees over whole groups of segments, by segment."""
    texts = segments.column("words").to_pylist()
    sizes = np.array([t.count(b" ") + 1 for t in texts])
    nodes = deep_nodes(b" ".join(texts).split(), window)
    leaves = sizes - window + 1  # of each segment
    owner = np.repeat(np.arange(len(texts)), leaves)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(leaves) - leaves, leaves)
    node = nodes[(np.cumsum(sizes) - sizes)[owner] + within]
    doc = segments.column("doc_id").to_numpy()[owner]
    order = np.lexsort((doc, node))
    new = np.concatenate(([True], np.diff(node[order]) != 0))
    least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    repeats = np.sort(order[doc[order] > least])
    owner, within = owner[repeats], within[repeats]
    lead = np.flatnonzero(np.concatenate(([True], np.diff(owner) != 0))) if len(owner) else owner
    starts = segments.column("start").to_numpy()[owner] + within
    rows = segments.select(["doc_id", *CONTENT]).take(pa.array(owner[lead])).combine_chunks()
    columns = [c.combine_chunks() for c in rows.columns]
    return pa.RecordBatch.from_arrays([*columns, lists(np.append(lead, len(owner)), pa.array(starts.astype(np.int32)))], names=["doc_id", *CONTENT, "starts"])


def _subtrees(window: int):
    """Whole groups, sorted by anchor, a few at a time."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size <= 2 * GROUP_BYTES:
                continue
            table = pa.Table.from_batches(held)
            anchor = table.column("anchor").to_numpy()
            whole = int(np.searchsorted(anchor, anchor[-1]))  # rows before the last group, which may go on
            begins = np.flatnonzero(np.concatenate(([True], np.diff(anchor[:whole]) != 0))) if whole else []
            ends = np.cumsum(pc.binary_length(table.column("words")).to_numpy())
            begin = 0
            while begin < whole:
                taken = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + 2 * GROUP_BYTES))
                after = begins[begins > begin]
                fit = after[after <= taken]
                end = int(fit[-1]) if len(fit) else int(after[0]) if len(after) else whole
                if taken >= whole:
                    end = whole
                yield _subtree(table.slice(begin, end - begin), window)
                begin = end
            rest = table.slice(whole).combine_chunks()
            held, size = rest.to_batches(), rest.nbytes
        if held:
            yield _subtree(pa.Table.from_batches(held), window)

    return run


def _suffixes(window: int):
    """Two letters, id, content and start of every window of a segment."""
    half = window // 2

    def run(batches):
        for batch in batches:
            for doc, c1, c2, start, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", *CONTENT, "start", "words"))):
                words = word_hashes(text.split())
                first, second = gram_hashes(words, half), gram_hashes(words, window - half)
                n = len(words) - window + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(first[:n])), pa.array(signed(second[half : half + n])), *(pa.array(np.full(n, v, np.int64)) for v in (doc, c1, c2)), pa.array(np.arange(start, start + n, dtype=np.int32))],
                    names=["first", "second", "doc_id", *CONTENT, "start"],
                )

    return run


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The deep nodes of a sorted range: leaves behind a smaller id, and the nodes at its borders.

    Rows: (kind, first, second, least, doc_id, c1, c2, starts). Kind 0: leaves that repeat; kind 1: leaves of the first
    node, which may have begun in an earlier range; kind 2: the first and the last node with their least id.
    Neighbouring leaves of one text are one row.
    """
    schema = pa.schema([("kind", pa.int32()), ("first", pa.int64()), ("second", pa.int64()), ("least", pa.int64()), ("doc_id", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("starts", pa.list_(pa.int32()))])
    node, least, in_first = None, None, True

    def border(node, least) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"kind": 2, "first": node[0], "second": node[1], "least": least}], schema=schema)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        a, b, doc = (batch.column(i).to_numpy() for i in range(3))
        new = np.concatenate(([node is None or (a[0], b[0]) != node], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        begins = np.flatnonzero(new)
        if node is not None and in_first and len(begins):
            yield border(node, least)
        number = np.cumsum(new)  # 0: the node of the batch before
        leasts = np.concatenate(([least if least is not None else 0], doc[begins]))[number]  # ids ascend in a node
        head = (number <= (1 if node is None else 0)) if in_first else np.zeros(n, bool)
        repeated = head | (doc > leasts)
        if repeated.any():
            rows = np.flatnonzero(repeated)
            content = [batch.column(i).to_numpy() for i in (3, 4)]
            owner = np.column_stack([number[rows], doc[rows], *(c[rows] for c in content)])
            lead = np.concatenate(([True], (owner[1:] != owner[:-1]).any(axis=1)))
            leads = rows[lead]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(head[leads].astype(np.int32)),
                    *(pa.array(c[leads]) for c in (a, b, leasts, doc, *content)),
                    lists(np.append(np.flatnonzero(lead), len(rows)), batch.column(5).take(pa.array(rows))),
                ],
                schema=schema,
            )
        in_first = in_first and (len(begins) == 0 or (node is None and len(begins) == 1))
        if node is None and len(begins) > 1:
            yield border((int(a[0]), int(b[0])), int(doc[0]))
        node, least = (int(a[-1]), int(b[-1])), int(leasts[-1])
    if node is not None:
        yield border(node, least)


WALKED = "kind int, first long, second long, least long, doc_id long, c1 long, c2 long, starts array<int>"


def repeated_windows(docs: DataFrame, known: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, content, starts) of the windows that repeat a smaller id, and the texts they are of.

    docs: doc_id and text; known: ``_describe`` of them with ``source`` (the smallest id with the same words), stored.
    """
    own = known.where((F.col("doc_id") == F.col("source")) & (F.size("anchors") > 0))
    marks = own.select("doc_id", *CONTENT, F.explode("anchors").alias("anchor"))
    texts_with = marks.groupBy("anchor").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in CONTENT for f in (F.min, F.max)))
    shared = stored(texts_with.where("min_c1 <> max_c1 or min_c2 <> max_c2").select("anchor"), "repeats-shared")
    marked = stored(marks.join(shared, "anchor").groupBy("doc_id", *CONTENT).agg(F.collect_list("anchor").alias("shared")), "repeats-marked")
    bits = id_filter(marked, "doc_id")

    def likely(batches):
        for batch in batches:
            batch = batch.filter(pa.array(passing(bits, batch.column("bit").to_numpy())))
            keys = [_text_key(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_contents(keys)], names=["doc_id", "text", *CONTENT])

    texts = docs.withColumn("bit", filter_bit(F.col("doc_id"))).mapInArrow(likely, "doc_id long, text string, c1 long, c2 long")
    texts = stored(texts.join(marked, ["doc_id", *CONTENT]), "repeats-texts")
    segments = stored(texts.mapInArrow(_segments(window), SEGMENT), "repeats-segments")
    sizes = stored(segments.groupBy("anchor").agg(F.sum(F.length("words")).alias("bytes")), "repeats-sizes")
    total, split_bytes = sizes.agg(F.sum("bytes"), F.sum(F.expr(f"if(bytes > {GROUP_BYTES}, bytes, 0)"))).first()
    least_tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = sizes.where(F.col("bytes") > GROUP_BYTES).select("anchor")
    parts = max(least_tasks, 1 + (total or 0) // TASK_BYTES)
    grouped = segments.join(large, "anchor", "left_anti").repartition(parts, "anchor").sortWithinPartitions("anchor")
    found = grouped.mapInArrow(_subtrees(window), "doc_id long, c1 long, c2 long, starts array<int>")
    if split_bytes:
        found = found.unionByName(_split_groups(segments.join(large, "anchor", "left_semi"), split_bytes, least_tasks, window))
    return stored(found.groupBy("doc_id", *CONTENT).agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")), "repeats-found"), texts


def _split_groups(segments: DataFrame, size: int, least_tasks: int, window: int) -> DataFrame:
    """Repeating windows of groups too large for a task: sorted ranges of whole windows in place of subtrees."""
    suffixes = segments.mapInArrow(_suffixes(window), "first long, second long, doc_id long, c1 long, c2 long, start int")
    suffixes = stored(suffixes, "repeats-suffixes")  # read twice: for the borders of ranges, and to be sorted
    order = ["first", "second", "doc_id", "start"]
    # A window begins at every third word of a segment or so, a word has about six bytes.
    ranges = max(least_tasks, 1 + size // 18 // RANGE_ROWS)
    walked = stored(suffixes.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_walk, WALKED), "repeats-walked")
    borders = walked.where("kind = 2").groupBy("first", "second").agg(F.min("least").alias("least"))
    heads = walked.where("kind = 1").drop("least").join(borders, ["first", "second"]).where("doc_id > least")
    columns = ["doc_id", *CONTENT, "starts"]
    return walked.where("kind = 0").select(columns).unionByName(heads.select(columns))


def covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which words lie in a window that begins at one of ``starts``."""
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return np.cumsum(edges[:-1]) > 0


def _cut(window: int):
    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
                words = blank_words(text)
                gone = covered(np.array(starts, np.int64), len(words), window)
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                for column, value in zip(out, (int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass"))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", *CONTENT)), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())],
                names=["doc_id", *CONTENT, "n_removed", "kept_sha256", "kept"],
            )

    return run


def judged(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(known, cuts): every document row with its source; the texts left of those that lose part of their words."""
    source = texts_of(docs, id_col, text_col)
    described = stored(source.mapInArrow(_describe(window), "doc_id long, c1 long, c2 long, n_words long, sha string, anchors array<long>"), "repeats-described")
    sources = stored(described.groupBy(*CONTENT).agg(F.min("doc_id").alias("source")), "repeats-sources")
    known = stored(described.join(sources, CONTENT), "repeats-known")
    found, texts = repeated_windows(source, known, window)
    cuts = texts.join(found, ["doc_id", *CONTENT]).mapInArrow(_cut(window), "doc_id long, c1 long, c2 long, n_removed long, kept_sha256 string, kept string")
    return known, stored(cuts.dropDuplicates(["doc_id", *CONTENT]), "repeats-cuts")


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, kept_sha256 and, where part of it is left, the kept words."""
    known, cuts = judged(docs, window, id_col, text_col)
    rows = known.join(cuts, ["doc_id", *CONTENT], "left")
    copy = (F.col("doc_id") > F.col("source")) & (F.col("n_words") >= window)
    return rows.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def cut_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, whole rows, with repeated windows cut out of the texts; texts of which nothing is left go.

    A text that loses words is its kept words joined by blanks, and ``n_chars`` follows it; others are unchanged.
    """
    known, cuts = judged(docs, window, id_col, text_col)
    copies = known.where((F.col("doc_id") > F.col("source")) & (F.col("n_words") >= window)).select("doc_id", *CONTENT, F.lit("").alias("kept"))
    changes = stored(cuts.select("doc_id", *CONTENT, "kept").unionByName(copies).dropDuplicates(["doc_id", *CONTENT]), "repeats-changes")
    changed_ids = id_filter(changes, "doc_id")
    at = docs.columns.index(text_col)

    def keyed(batches):
        for batch in batches:
            likely = passing(changed_ids, batch.column(batch.num_columns - 1).to_numpy())
            texts = batch.column(at)
            keys = [_text_key(texts[i].as_py()) if p else None for i, p in enumerate(likely.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_contents(keys)], names=[*(f"c{i}" for i in range(batch.num_columns - 1)), "_c1", "_c2"])

    # Columns go by place, so that names can't clash.
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)) + ", _c1 long, _c2 long"
    rows = plain.withColumn("_bit", filter_bit(F.col(f"c{docs.columns.index(id_col)}").cast("long"))).mapInArrow(keyed, schema)
    changes = changes.select(F.col("doc_id").alias("_doc"), F.col("c1").alias("_k1"), F.col("c2").alias("_k2"), F.col("kept").alias("_kept"))
    on = (F.col(f"c{docs.columns.index(id_col)}").cast("long") == F.col("_doc")) & (F.col("_c1") == F.col("_k1")) & (F.col("_c2") == F.col("_k2"))
    touched = rows.where("_c1 is not null").join(changes, on, "left").where("_kept is null or _kept <> ''")
    columns = []
    for i, f in enumerate(docs.schema.fields):
        c = F.col(f"c{i}")
        if f.name == text_col:
            c = F.coalesce(F.col("_kept"), c)
        elif f.name == "n_chars":
            c = F.when(F.col("_kept").isNotNull(), F.length("_kept")).otherwise(c)
        columns.append(c.cast(f.dataType).alias(f.name))
    same = rows.where("_c1 is null").select([F.col(f"c{i}").alias(f.name) for i, f in enumerate(docs.schema.fields)])
    return same.unionByName(touched.select(columns)) if len(set(docs.columns)) == len(docs.columns) else same.union(touched.select(columns))
