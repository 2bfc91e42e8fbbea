"""N-gram Jaccard join by PartEnum signatures.

Sets are the 64-bit hashes of a text's distinct word shingles. Sizes fall into bands whose ends
differ by half; two sets above the threshold whose smaller one lies in a band differ in at most
``k`` elements. For a band the feature domain is cut into ``n1`` parts and each of these into
``N2`` cells, ``n1`` so large that of any ``k`` differences at most ``K2`` fall into some part. A
signature is the content of a subset of ``N2 - K2`` cells of a part; all such subsets are
enumerated, and a pair above the threshold agrees on one at least. How many it must agree on
follows from the most that differences can spoil: one difference spoils the subsets that hold its
cell, the next one in the same part fewer. If a set can differ from its partners in ``d`` elements,
which its own size bounds, ``lost(d)`` subsets can be spoilt, so a set keeps its ``lost(d) + 1``
fullest ones only: the order depends on a subset's content alone, and the fullest subset that a
pair agrees on is among these in either set.

A set signs for its own band and, if it can be the greater one of a pair, for the bands below.
One shuffle brings equal signatures together, packed by ranges of signatures; each bucket gives
a star of candidates around its set with the least name (never all pairs), which are verified exactly;
buckets that hold much the same sets so have the same star. Where a star has an edge that fails, its
members could still be linked to each other. From large stars those members go that have too many
elements which no other one has, found by one count of elements. Of the others those outside the star's
most frequent component are tested against a few pivots inside it, again while that joins a part of them.
So the rows for a group of near copies grow with its members. What is left is compared in
blocks inside tasks, and only a spanning set of true links comes out. Equal sets are one node from the start.

Sets are told apart by two hashes, 126 bits. The first one names a set in candidates and links; the
few sets of different content that share it (n sets: about n^2 / 2^64) are found by the second one and
named by that. Elements are 64-bit hashes of shingles, compared only between two candidates.

Defined results: null and empty texts and texts without words have an empty set (0 shingles) and
are linked with nothing; rows with a null id take part with their text and have the component
of the texts they equal, their own being null if they are alone; repeated ids are rows of
their own, linked by text only. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import MIX, blank_words, filter_bit, gram_hashes, hash64, id_filter, lists, mixed, passing, scaled, stored, texts_of, word_hashes
from shelfcast.llm.components import components

BAND = 1.5
#: Cells of a part, and how many of them may differ: signatures are subsets of two of three cells.
N2, K2 = 3, 1
SUBSETS = np.array(list(combinations(range(N2), N2 - K2)))
#: Subsets of a part that its first, second, ... differing cell spoils.
SPOILT = [math.comb(N2 - i, N2 - K2) - math.comb(N2 - i - 1, N2 - K2) for i in range(K2 + 1)]
#: Signatures that a task packs, or compares, at a time.
FLUSH = 1_000_000
#: Signatures of a range; ranges are told apart by the upper bits, signatures within by 32 more.
RANGE_ROWS = 100_000
LEAST_RANGES, MOST_RANGES = 10, 20
#: Sets and bytes of a block when the members of a star are compared.
BLOCK_SETS = 4096
BLOCK_BYTES = 16 << 20
#: Stars with more members are tested against so many pivots at a time, as long as that joins a part of those outside.
PIVOT_SETS = 128
PIVOTS = 4
LEAST_JOINED = 0.25


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` consecutive words; of all words if there are fewer; none without words."""
    words = blank_words(text, lower=True)
    if not words:
        return np.zeros(0, np.uint64)
    a = word_hashes(words)
    return np.unique(gram_hashes(a, min(size, len(a))))


@dataclass(frozen=True)
class Identity:
    """Names of sets. ``shared``: the first hashes that different sets have in common; ``bits``: of the first hash."""

    shared: frozenset[int] = frozenset()
    bits: int = 64

    @staticmethod
    def second(elements: np.ndarray) -> int:
        """Signed second hash of a set, odd; 0 for the empty one."""
        return int(np.uint64(hash64(elements.tobytes(), 1) | 1).view(np.int64)) if len(elements) else 0

    def of(self, elements: np.ndarray) -> int:
        """Signed name of a set, odd; 0 for the empty one."""
        if not len(elements):
            return 0
        first = int(np.uint64(hash64(elements.tobytes()) >> (64 - self.bits) | 1).view(np.int64))
        return self.second(elements) if first in self.shared else first


def bands(percent: int, largest: int) -> list[tuple[int, int, int]]:
    """(first size, last size, most differences of a pair whose smaller set is in the band)."""
    out, first = [], 1
    while first <= largest:
        last = max(first, math.floor(first * BAND))
        out.append((first, last, last * (100 - percent) // percent))
        first = last + 1
    return out


def _reaches(percent: int, size: int, band: tuple[int, int, int]) -> bool:
    """Whether a set of ``size`` can be in a pair whose smaller set is in ``band``."""
    return band[0] <= size <= band[1] or (size > band[1] and band[1] * 100 >= size * percent)


def lost(differences: int, n1: int) -> int:
    """The most subsets that so many differences spoil: first one cell of every part, then a second one, and so on."""
    rounds, rest = divmod(differences, n1)
    return sum(n1 * s for s in SPOILT[:rounds]) + (rest * SPOILT[rounds] if rounds <= K2 else 0)


class Signer:
    """Signatures of sets for one threshold."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.bands: list[tuple[int, int, int]] = []
        self.at: dict[int, list[int]] = {}

    def _bands_of(self, size: int) -> list[int]:
        if not self.bands or self.bands[-1][1] < size:
            self.bands = bands(self.percent, size)
        if size not in self.at:
            if len(self.at) > 100_000:
                self.at.clear()
            low = next(i for i, b in enumerate(self.bands) if b[1] >= size)
            found = [low]
            while found[-1] > 0 and _reaches(self.percent, size, self.bands[found[-1] - 1]):
                found.append(found[-1] - 1)
            self.at[size] = found
        return self.at[size]

    def _most_differences(self, size: int, band: tuple[int, int, int]) -> int:
        """Of a set of ``size`` from any partner, where the smaller one of the pair is in ``band``."""
        apart = 100 - self.percent
        if size <= band[1]:
            return size * apart // self.percent
        return min(band[2], (band[1] + size) * apart // (100 + self.percent))

    def sign(self, elements: np.ndarray) -> np.ndarray:
        """Signatures, without those of bands whose pairs can only be equal sets."""
        found = self._bands_of(len(elements))
        parts = [self._of_band(elements, i, self.bands[i][2], self._most_differences(len(elements), self.bands[i])) for i in found]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    @staticmethod
    def _of_band(elements: np.ndarray, band: int, most: int, own: int) -> np.ndarray:
        """``most``: differences of any pair of the band; ``own``: of this set from its partners."""
        if own == 0:
            return np.zeros(0, np.uint64)
        n1 = -(-(most + 1) // (K2 + 1))
        cells = N2 * n1
        mix = mixed(elements ^ scaled(band + 1, 0))
        # The upper half of the bits chooses the cell, the whole value is summed.
        place = ((mix >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
        order = np.argsort(place, kind="stable")
        counts = np.bincount(place.astype(np.int64), minlength=cells)
        sums = np.zeros(cells, np.uint64)
        full = counts > 0
        starts = (np.cumsum(counts) - counts)[full]
        sums[full] = np.add.reduceat(mixed(mix[order]), starts)
        held = counts.reshape(n1, N2)[:, SUBSETS].sum(axis=2).ravel()
        content = sums.reshape(n1, N2)[:, SUBSETS].sum(axis=2, dtype=np.uint64).ravel()
        names = mixed(content + np.arange(len(content), dtype=np.uint64) * MIX[2] + scaled(band, 1) + held.astype(np.uint64))
        kept = min(len(names), lost(own, n1) + 1)
        return names[np.lexsort((names, held))[len(names) - kept :]]


def text_key(text: Column) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(text.cast("string"))


def described(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False, bits: int = 64) -> tuple[DataFrame, Identity]:
    """Per document row: doc_id, n_shingles, set_id (0: empty) and, if wanted, text_key; stored. With the naming used."""
    first = Identity(bits=bits)

    def run(batches):
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            values = [pa.array(v, pa.int64()) for v in (map(len, sets), map(first.of, sets), map(first.second, sets))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *values, *batch.columns[2:]], names=["doc_id", "n_shingles", "set_id", "second", *batch.schema.names[2:]])

    source, schema = texts_of(docs, id_col, text_col), "doc_id long, n_shingles long, set_id long, second long"
    if keyed:
        source, schema = source.withColumn("text_key", text_key(F.col("text"))), schema + ", text_key long"
    found = stored(source.mapInArrow(run, schema), "jaccard-described")
    identity = Identity(_shared_names(found), bits)
    if identity.shared:
        found = found.withColumn("set_id", F.when(F.col("set_id").isin(*identity.shared), F.col("second")).otherwise(F.col("set_id")))
        if _shared_names(found):
            raise RuntimeError("different sets agree in both hashes")
    return found.drop("second"), identity


def _shared_names(found: DataFrame) -> frozenset[int]:
    """Names of more than one set; of n sets about n^2 / 2^64 by chance, a hundred at 4 * 10^10."""
    names = found.groupBy("set_id").agg(F.min("second").alias("lo"), F.max("second").alias("hi"))
    return frozenset(row[0] for row in names.where("lo <> hi").select("set_id").collect())


def _packed(size: int, percent: int, bits: int, identity: Identity):
    """Signatures of a task's texts, packed by range: the lower 32 bits of each and the set it is of."""

    def run(batches):
        signer, seen = Signer(percent), set()
        names: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            name, member = np.concatenate(names), np.concatenate(sets)
            names.clear()
            sets.clear()
            span = (name >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(span, kind="stable")
            found, starts = np.unique(span[order], return_index=True)
            offsets = np.concatenate((starts, [len(order)]))
            short = (name[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(found), lists(offsets, pa.array(short)), lists(offsets, pa.array(member[order]))], names=["span", "signatures", "members"]
            )

        for batch in batches:
            for text in batch.column(1).to_pylist():
                elements = shingles(text, size)
                if not len(elements) or (own := identity.of(elements)) in seen:
                    continue  # equal sets of a task are sent once
                if len(seen) > FLUSH:
                    seen.clear()
                seen.add(own)
                found = signer.sign(elements)
                if len(found):
                    names.append(found)
                    sets.append(np.full(len(found), own, np.int64))
                    held += len(found)
                if held >= FLUSH:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    return run


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packed rows sorted by range: pairs of one set of a bucket with each other one.

    A range is worked off in portions; of those before, only each bucket's chosen set is kept, so
    memory follows the number of different signatures of a range, not the size of a bucket.
    """
    span, known, hubs = None, np.zeros(0, np.int32), np.zeros(0, np.int64)
    names: list[np.ndarray] = []
    members: list[np.ndarray] = []

    def portion() -> pa.RecordBatch:
        nonlocal known, hubs
        name, member = np.concatenate([known, *names]), np.concatenate([hubs, *members])
        names.clear()
        members.clear()
        order = np.lexsort((member, np.arange(len(name)) >= len(known), name))  # those chosen before come first
        name, member = name[order], member[order]
        first = np.concatenate(([True], name[1:] != name[:-1]))
        hub = member[first][np.cumsum(first) - 1]
        known, hubs = name[first], member[first]
        apart = hub != member
        pairs = np.unique(np.column_stack([hub[apart], member[apart]]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["hub", "member"])

    held = 0
    for batch in batches:
        spans = batch.column(0).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(spans[1:] != spans[:-1]) + 1, [len(spans)]))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            if spans[lo] != span:
                if names:
                    yield portion()
                span, known, hubs, held = spans[lo], known[:0], hubs[:0], 0
            part = batch.slice(lo, hi - lo)
            names.append(_flat(part.column(1)))
            members.append(_flat(part.column(2)))
            held += len(names[-1])
            if held >= FLUSH:
                yield portion()
                held = 0
    if names:
        yield portion()


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def similar(shared: np.ndarray | int, x: np.ndarray | int, y: np.ndarray | int, percent: int):
    """Whether 100 * intersection >= percent * union."""
    return 100 * shared >= percent * (x + y - shared)


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            hubs, members = batch.column("hub_elements").to_pylist(), batch.column("member_elements").to_pylist()
            linked = []
            for h, m in zip(hubs, members):
                x, y = np.frombuffer(h, np.uint64), np.frombuffer(m, np.uint64)
                small, large = min(len(x), len(y)), max(len(x), len(y))
                linked.append(100 * small >= percent * large and bool(similar(_shared(x, y), len(x), len(y), percent)))
            size = pa.array(map(len, members), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("member"), size, pa.array(linked, pa.bool_())], names=["hub", "member", "bytes", "linked"])

    return run


def _tested(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """hub, member, bytes of the member's elements and whether the two are linked, of pairs (hub, member)."""
    return stored(
        pairs.join(sets.select(F.col("set_id").alias("member"), F.col("elements").alias("member_elements")), "member")
        .join(sets.select(F.col("set_id").alias("hub"), F.col("elements").alias("hub_elements")), "hub")
        .mapInArrow(_verify(percent), "hub long, member long, bytes long, linked boolean"),
        "jaccard-tested",
    )


def _block_links(percent: int):
    """Spanning links among the sets of two blocks of a star, between different components only."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["member", "side"])
        left, right = rows[rows["side"] != 1], rows[rows["side"] != 0]
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            sets = [np.frombuffer(x, np.uint64) for x in right["elements"]]
            sizes = np.array([len(x) for x in sets])
            owner = np.repeat(np.arange(len(sets)), sizes)
            elements = np.concatenate(sets)
            order = np.argsort(elements, kind="stable")
            elements, owner = elements[order], owner[order]
            names, own = right["member"].to_numpy(), left["component"].to_numpy().copy()
            group = right["component"].to_numpy().copy()
            for k, (member, raw) in enumerate(zip(left["member"], left["elements"])):
                x = np.frombuffer(raw, np.uint64)
                lo, hi = np.searchsorted(elements, x, "left"), np.searchsorted(elements, x, "right")
                span = hi - lo
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(span.sum())
                shared = np.bincount(owner[at], minlength=len(sets))
                hits = np.flatnonzero(similar(shared, len(x), sizes, percent) & (group != own[k]) & (names != member))
                if len(hits):
                    reached, once = np.unique(group[hits], return_index=True)  # one link for each component reached
                    out += [(member, int(names[i])) for i in hits[once]]
                    group[np.isin(group, reached)] = own[k]  # from here on they are one
                    own[np.isin(own, reached)] = own[k]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def linked_sets(docs: DataFrame, known: DataFrame, identity: Identity, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, component) of all sets that are linked with a different one. known, identity: ``described``."""
    source = texts_of(docs, id_col, text_col)
    total = (known.agg(F.sum("n_shingles")).first()[0] or 0) * 2 * (100 - percent) // percent  # signatures, about
    bits = min(MOST_RANGES, max(LEAST_RANGES, (total // RANGE_ROWS).bit_length()))
    packed = source.mapInArrow(_packed(size, percent, bits, identity), "span long, signatures array<int>, members array<long>")
    stars = packed.repartition("span").sortWithinPartitions("span").mapInArrow(_stars, "hub long, member long")
    stars = stored(stars.distinct(), "jaccard-stars")
    wanted = stored(stars.select(F.col("hub").alias("set_id")).unionAll(stars.select("member")).distinct(), "jaccard-wanted")
    # One text for each wanted set; most others are left out where they are read.
    owners = known.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    owners = stored(owners.join(wanted, "set_id"), "jaccard-owners")
    wanted_ids = id_filter(owners, "doc_id")

    def elements(batches):
        for batch in batches:
            batch = batch.filter(pa.array(passing(wanted_ids, batch.column("bit").to_numpy())))
            sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(identity.of, sets), pa.int64()), batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_id", "doc_id", "elements"])

    contents = source.withColumn("bit", filter_bit(F.col("doc_id"))).mapInArrow(elements, "set_id long, doc_id long, elements binary")
    contents = contents.alias("c").join(owners.alias("o"), F.expr("c.set_id = o.set_id and c.doc_id <=> o.doc_id"), "left_semi")
    sets = stored(contents.select("set_id", "elements").dropDuplicates(["set_id"]), "jaccard-sets")
    tested = _tested(stars, sets, percent)
    found = stored(components(_links(tested)), "jaccard-components")
    # Members of stars with failed edges may be linked to each other; a hub itself has been tested with all of its own.
    around = stored(tested.join(tested.where("not linked").select("hub").distinct(), "hub", "left_semi").select("hub", "member", "bytes"), "jaccard-around")
    found, placed, stars = _pivoted(_without_lone(around, found, sets, percent), found, sets, percent)
    return components(_edges(found).unionAll(_rest(placed, stars, sets, percent)))


def _links(tested: DataFrame) -> DataFrame:
    return tested.where("linked").select(F.col("hub").alias("a"), F.col("member").alias("b"))


def _edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _open(around: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members, with their component, of stars whose members are of several ones; and these stars.

    Per star: centre, its most frequent component, the least bytes of a member, and how many members it has and, with their bytes, how many outside of the centre.
    """
    placed = around.join(found.select(F.col("node").alias("member"), "component"), "member", "left")
    placed = stored(placed.select("hub", "member", "bytes", F.coalesce("component", "member").alias("component")), "jaccard-placed")
    parts = placed.groupBy("hub", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("bytes").alias("least"))
    stars = parts.groupBy("hub").agg(
        F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "component", "bytes")).alias("most"), F.min("least").alias("least")
    )
    stars = stars.where("parts > 1").select(
        "hub", "n", "bytes", "least", F.col("most.component").alias("centre"), F.expr("n - most.n").alias("n_outside"), F.expr("bytes - most.bytes").alias("bytes_outside")
    )
    return placed, stored(stars, "jaccard-open")


def _by_element(bits: int):
    """Elements of a task's sets, packed by the range they fall into, and the sets they are of."""

    def run(batches):
        elements: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            name, member = np.concatenate(elements), np.concatenate(owners)
            elements.clear()
            owners.clear()
            span = (name >> np.uint64(32) >> np.uint64(32 - bits)).astype(np.int64)
            order = np.argsort(span, kind="stable")
            found, starts = np.unique(span[order], return_index=True)
            offsets = np.concatenate((starts, [len(order)]))
            values = (pa.array(name[order].view(np.int64)), pa.array(member[order]))
            return pa.RecordBatch.from_arrays([pa.array(found), *(lists(offsets, v) for v in values)], names=["span", "elements", "members"])

        for batch in batches:
            for member, raw in zip(batch.column("set_id").to_pylist(), batch.column("elements").to_pylist()):
                elements.append(np.frombuffer(raw, np.uint64))
                owners.append(np.full(len(elements[-1]), member, np.int64))
                held += len(elements[-1])
                if held >= FLUSH:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    return run


def _own_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packed rows sorted by range: sets and how many elements of the range no other one has.

    A range is worked off in portions; memory follows its number of different elements.
    """
    span, held = None, 0
    known, owner, often = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    names: list[np.ndarray] = []
    members: list[np.ndarray] = []

    def portion() -> None:
        nonlocal known, owner, often
        name, member = np.concatenate([known, *names]), np.concatenate([owner, *members])
        twice = np.concatenate([often, np.zeros(len(name) - len(known), bool)])
        names.clear()
        members.clear()
        known, first, at, n = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
        owner, often = member[first], (n > 1) | (np.bincount(at, twice) > 0)

    def counted() -> pa.RecordBatch:
        portion()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(owner[~often], return_counts=True)], names=["member", "n"])

    for batch in batches:
        for k, now in enumerate(batch.column(0).to_pylist()):
            if now != span:
                if span is not None:
                    yield counted()
                span, held, known, owner, often = now, 0, known[:0], owner[:0], often[:0]
            part = batch.slice(k, 1)
            names.append(_flat(part.column(1)))
            members.append(_flat(part.column(2)))
            held += len(names[-1])
            if held >= FLUSH:
                portion()
                held = 0
    if span is not None:
        yield counted()


def _without_lone(around: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``around`` without those members of a large star that can't be linked with any other one of it.

    These have so many elements that no other member of a large star has, that the rest is too few
    for a link with a set of the star's least size.
    """
    large = _open(around, found)[1].where(F.col("n") > PIVOT_SETS).select("hub", (F.col("least") / 8).cast("long").alias("least"))
    crowd = stored(around.join(large, "hub", "left_semi").groupBy("member").agg((F.max("bytes") / 8).cast("long").alias("size")), "jaccard-crowd")
    total = crowd.agg(F.sum("size")).first()[0]
    if not total:
        return around
    bits = min(MOST_RANGES, (total // RANGE_ROWS).bit_length())
    packed = sets.join(crowd.select(F.col("member").alias("set_id")), "set_id", "left_semi").mapInArrow(_by_element(bits), "span long, elements array<long>, members array<long>")
    own = packed.repartition("span").sortWithinPartitions("span").mapInArrow(_own_elements, "member long, n long").groupBy("member").agg(F.sum("n").alias("n"))
    own = stored(own, "jaccard-own")
    # A link of sets x and y has an intersection of at least percent * (x + y) / (100 + percent).
    gone = around.select("hub", "member", (F.col("bytes") / 8).cast("long").alias("size")).join(large, "hub").join(own, "member")
    gone = stored(gone.where(f"{100 + percent} * (size - n) < {percent} * (size + least)").select("hub", "member"), "jaccard-lone")
    return stored(around.join(gone, ["hub", "member"], "left_anti"), "jaccard-around")


def _pivoted(around: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The components after tests of large stars' members with pivots, and, without the pivots used, members and stars as in ``_open``.

    A pivot is of the star's centre and tested with all members outside, so all its pairs are settled then and
    it leaves the star. A round takes at most ``PIVOTS`` rows for each member outside, and the next one comes only
    if it joins a part of them: all rounds together grow with the members.
    """
    before = None
    while True:
        placed, stars = _open(around, found)
        large = stars.where(F.col("n") > PIVOT_SETS)
        outside = large.agg(F.sum("n_outside")).first()[0] or 0
        if not outside or (before is not None and outside > (1 - LEAST_JOINED) * before):
            return found, placed, stars
        before = outside
        members = placed.join(large.select("hub", "centre"), "hub")
        # The same order in every star: those with much the same members have the same pivots.
        place = F.xxhash64("member")
        pivots = members.where("component = centre").groupBy("hub", F.pmod(place, F.lit(PIVOTS))).agg(F.min_by("member", place).alias("pivot"))
        pivots = stored(pivots.select("hub", "pivot"), "jaccard-pivots")
        pairs = members.where("component <> centre").select("hub", "member").join(pivots, "hub").select(F.col("pivot").alias("hub"), "member").distinct()
        found = stored(components(_edges(found).unionAll(_links(_tested(pairs, sets, percent)))), "jaccard-components")
        around = stored(around.join(pivots.withColumnRenamed("pivot", "member"), ["hub", "member"], "left_anti"), "jaccard-around")


def _blocks(placed: DataFrame, stars: DataFrame) -> DataFrame:
    """Members, by star and pair of blocks, of stars whose members' components differ so far. placed, stars: ``_open``."""

    def blocks_of(n: str, size: str) -> Column:
        return F.ceil(F.greatest(F.col(n) / BLOCK_SETS, F.col(size) / BLOCK_BYTES)).cast("int")

    stars = stars.select("hub", "centre", blocks_of("n_outside", "bytes_outside").alias("lefts"), blocks_of("n", "bytes").alias("rights"))
    members = placed.join(stars, "hub").select("hub", "member", "component", "lefts", "rights", (F.col("component") != F.col("centre")).alias("outside"))
    # Each pair of blocks (i, j): members outside the centre of block i (sides 0 and 2) against all members
    # of block j (sides 1 and 2). In a star of one block a member is sent once for both.
    whole, split, place = members.where("rights = 1"), members.where("rights > 1"), F.xxhash64("member")
    own = whole.select("hub", "member", "component", F.when(F.col("outside"), 2).otherwise(1).alias("side"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    left, right = (F.pmod(place, F.col(c)).cast("int") for c in ("lefts", "rights"))
    left = split.where("outside").select("hub", "member", "component", F.lit(0).alias("side"), left.alias("i"), F.expr("explode(sequence(0, rights - 1))").alias("j"))
    right = split.select("hub", "member", "component", F.lit(1).alias("side"), F.expr("explode(sequence(0, lefts - 1))").alias("i"), right.alias("j"))
    return own.unionByName(left).unionByName(right)


def _rest(placed: DataFrame, stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of a star whose components differ so far."""
    blocks = _blocks(placed, stars).join(sets.withColumnRenamed("set_id", "member"), "member")
    return blocks.groupBy("hub", "i", "j").applyInPandas(_block_links(percent), "a long, b long")


def similar_documents(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """Per document row: doc_id, n_shingles and component_id, the smallest id reachable by links.

    ``bits`` of a set's first hash; few of them only make many sets be named by the second one.
    """
    known, identity = described(docs, size, id_col, text_col, bits=bits)
    groups = stored(linked_sets(docs, known, identity, size, percent, id_col, text_col), "jaccard-groups")
    least = known.where("set_id <> 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    by_set = least.join(groups.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", "least", F.coalesce("component", "set_id").alias("component"))
    by_set = stored(by_set, "jaccard-sets-placed")
    by_group = by_set.groupBy("component").agg(F.min("least").alias("component_id"))
    places = stored(by_set.join(stored(by_group, "jaccard-by-group"), "component").select("set_id", "component_id"), "jaccard-places")
    return known.join(places, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("set_id") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, whole rows, with one row of each group: that with the smallest id.

    Rows are chosen by id and text, so of an id with several texts each is judged by its own group. Among
    the rows without an id one of each group stays too, also beside a row with an id. Texts without words
    are in no group and stay. Further columns may have any names. Of rows that repeat id and text one stays, but for those with neither id nor words.
    """
    known, identity = described(docs, size, id_col, text_col, keyed=True)
    groups = stored(linked_sets(docs, known, identity, size, percent, id_col, text_col), "jaccard-groups")
    rows = F.count("*").alias("rows")
    texts = known.where("set_id <> 0").groupBy("set_id", "doc_id", "text_key").agg(rows)
    texts = texts.join(groups.withColumnRenamed("node", "set_id"), "set_id", "left")
    chosen = texts.groupBy(F.coalesce("component", "set_id").alias("component"), F.isnull("doc_id").alias("no_id")).agg(
        F.min(F.struct("doc_id", "text_key", "rows")).alias("least")
    )
    empty = known.where("set_id = 0").groupBy("doc_id", "text_key").agg(rows)
    empty = empty.withColumn("rows", F.when(F.isnull("doc_id"), 1).otherwise(F.col("rows")))
    keep = stored(chosen.select("least.*").unionByName(empty), "jaccard-kept")
    # Under names that no column of the documents has.
    longest = "_" * (1 + max(map(len, docs.columns)))
    kept_id, kept_key, kept_rows = (f"{longest}{name}" for name in ("id", "key", "rows"))
    keep = keep.select(F.col("doc_id").alias(kept_id), F.col("text_key").alias(kept_key), F.col("rows").alias(kept_rows))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)) & (text_key(F.col(text_col)) == F.col(kept_key))
    found = docs.join(keep, same)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once, repeated = found.where(F.col(kept_rows) == 1), found.where(F.col(kept_rows) > 1).dropDuplicates([id_col, text_col])
    return once.select(columns).unionByName(repeated.select(columns))
