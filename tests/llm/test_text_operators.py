"""Jaccard join, repeats and decontamination against brute force, with the awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import decontamination, jaccard, repeats

ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "one"), (905, "TWO words"), (906, "two\vwords"), (907, "é " * 30)]


def corpus(words):
    base = [words(120, s) for s in range(6)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for k, w in enumerate(base):
        for e in range(5):
            changed = list(w)
            for j in range(e):
                changed[(17 * j + 5 * k) % len(w)] = f"new{j}"
            rows.append((100 + 10 * k + e, " ".join(changed)))
    passage = words(60, 99)
    rows += [(300 + i, " ".join(words(30, 500 + i) + passage + words(10, 600 + i))) for i in range(8)]
    rows.append((400, " ".join(["same"] * 500)))
    rows.append((401, " ".join(["same"] * 90)))
    rows.append((402, " ".join(words(4000, 7))))
    return rows + ODD


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def blank(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_jaccard(rows, size, percent):
    sets = []
    for _, text in rows:
        w = blank(ascii_lower(text))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    place = list(range(len(rows)))

    def root(i):
        while place[i] != i:
            i = place[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                place[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {(doc, len(sets[i]), least[root(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows)}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (3, 60)])
def test_jaccard_equals_brute_force(documents, words, size, percent):
    rows = corpus(words)
    found = {tuple(r) for r in jaccard.similar_documents(documents(rows), size, percent).collect()}
    assert found == brute_jaccard(rows, size, percent)


def test_jaccard_links_members_of_a_star_whose_centre_is_far(documents, words):
    # Copies that differ from the first by more than allowed, but not from each other.
    base = words(200, 3)
    rows = [(0, " ".join(base))]
    for i in range(1, 9):
        changed = list(base)
        for j in range(6 + i // 5):
            changed[j * 29 % 200] = "other"
        changed[150 + i] = "own"
        rows.append((i, " ".join(changed)))
    assert {tuple(r) for r in jaccard.similar_documents(documents(rows), 3, 90).collect()} == brute_jaccard(rows, 3, 90)


def near_group(words, n):
    """Copies of one text with words changed: a third linked with all but the last third, one not with its own kind, one with none."""
    base, rows = words(200, 3), []
    for i in range(n):
        r, changed = random.Random(i), list(base)
        for j in r.sample(range(200), (2, 5, 11)[i % 3]):
            changed[j] = f"own{i}x{j}" if i % 3 != 1 else f"common{i % 7}x{j % 5}"
        rows.append((i, " ".join(changed)))
    return rows


def test_rows_for_a_group_of_near_copies_grow_with_its_members(documents, words, monkeypatch):
    # Blocks, ranges and portions of a few sets only; before, each member went to all pairs of blocks.
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    monkeypatch.setattr(jaccard, "PIVOT_SETS", 8)
    made, blocks = [], jaccard._blocks

    def counted(*given):
        found = blocks(*given)
        made.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "_blocks", counted)
    for n in (90, 180):
        rows = near_group(words, n)
        found = {tuple(r) for r in jaccard.similar_documents(documents(rows), 3, 80).collect()}
        assert found == brute_jaccard(rows, 3, 80)
        assert 1 < len({component for _, _, component in found}) < n
    assert made[1] <= 3 * made[0]


def test_own_elements_are_counted_over_portions_and_ranges(monkeypatch):
    r = np.random.default_rng(0)
    sets = {int(k): np.unique(r.integers(0, 2**64, 40, dtype=np.uint64) >> np.uint64(1) << np.uint64(k % 2)) for k in range(1, 40)}
    shared = np.unique(r.integers(0, 2**64, 30, dtype=np.uint64))
    sets = {k: np.union1d(v, shared[: k % 30]) for k, v in sets.items()}
    batch = pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array([v.tobytes() for v in sets.values()], pa.binary())], names=["set_id", "elements"])
    seen = [e for v in sets.values() for e in v]
    wanted = {k: sum(seen.count(e) == 1 for e in v) for k, v in sets.items()}
    for flush, bits in ((50, 0), (50, 3), (10**6, 2)):
        monkeypatch.setattr(jaccard, "FLUSH", flush)
        packed = pa.Table.from_batches(jaccard._by_element(bits)([batch])).sort_by("span")
        own = dict.fromkeys(sets, 0)
        for out in jaccard._own_elements(packed.to_batches(max_chunksize=3)):
            for member, n in zip(out.column("member").to_pylist(), out.column("n").to_pylist()):
                own[member] += n
        assert own == wanted


def test_signatures_never_miss_a_pair():
    random = np.random.default_rng(0)
    for percent in (90, 80, 60):
        signer, tried = jaccard.Signer(percent), 0
        for _ in range(1500):
            a = np.unique(random.integers(0, 2**63, int(random.integers(1, 300))).astype(np.uint64))
            part = (100 - percent) / 100 * random.random()
            b = np.unique(np.concatenate([a[random.random(len(a)) > part], random.integers(0, 2**63, int(len(a) * part / 2)).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if len(b) and shared < max(len(a), len(b)) and jaccard.similar(shared, len(a), len(b), percent):
                tried += 1
                assert len(np.intersect1d(signer.sign(a), signer.sign(b)))
        assert tried > 200


def test_a_subset_survives_any_placing_of_the_differences():
    # Every way to put k differences into the cells of n1 parts, against the count of subsets that are spoilt.
    r = jaccard.N2 - jaccard.K2
    for k in range(1, 6):
        n1 = -(-(k + 1) // (jaccard.K2 + 1))
        worst = 0
        for hit in itertools.product(range(jaccard.N2 * n1), repeat=k):
            whole = sum(math.comb(jaccard.N2 - len({c for c in hit if c // jaccard.N2 == part}), r) for part in range(n1))
            worst = max(worst, n1 * len(jaccard.SUBSETS) - whole)
        assert worst == jaccard.lost(k, n1) < n1 * len(jaccard.SUBSETS)


def test_sets_that_share_a_name_are_told_apart(documents, words):
    rows = corpus(words)
    found = {tuple(r) for r in jaccard.similar_documents(documents(rows), 3, 90, bits=3).collect()}
    assert found == brute_jaccard(rows, 3, 90)


def test_one_of_each_takes_columns_of_any_name(documents, words):
    text = " ".join(words(50, 1))
    docs = documents([(5, text), (3, text + " end"), (3, text + " end"), (9, None)])
    for name in ("_kept", "_kept_key", "_rows", "rows", "set_id", "component", "text_key", "node", "a.b"):
        docs = docs.withColumn(name, F.lit(7))
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["_rows"], r["a.b"]) for r in out.collect()) == [(3, 7, 7), (9, 7, 7)]
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_keeps_whole_rows_and_repeated_ids(documents, words):
    text = " ".join(words(50, 1))
    rows = [(5, text), (3, text), (3, text), (None, text), (8, " ".join(words(50, 2))), (9, None), (10, "")]
    docs = documents(rows)
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == [(False, 3), (False, 8), (False, 9), (False, 10), (True, 0)]


def test_one_of_each_judges_every_text_of_an_id(documents, words):
    a, b, c, d = (" ".join(words(60, s)) for s in (1, 2, 3, 4))
    near = [b + " end", d + " one", d + " two"]
    rows = [(3, b), (5, a), (5, near[0]), (6, a), (7, c), (7, c + " end"), (7, c), (8, a + " end"), (8, words(9, 9)[0])]
    rows += [(None, d), (None, near[1]), (None, near[2]), (None, d), (None, ""), (None, ""), (9, ""), (9, "")]
    out = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(documents(rows)).collect()]
    assert {(i, t) for i, t in out if i in (3, 5, 6)} == {(3, b), (5, a)}
    assert [t[: len(c)] for i, t in out if i == 7] == [c]
    assert [t for i, t in out if i == 8] == [words(9, 9)[0]]
    assert [t[: len(d)] for i, t in out if i is None and t] == [d]
    assert [t for i, t in out if i is None and not t] == ["", ""] and [t for i, t in out if i == 9] == [""]
    assert len(out) == 8


def brute_repeats(rows, window):
    first = {}
    for doc, text in rows:
        w = blank(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = blank(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_deep_nodes_are_in_word_order():
    r = random.Random(0)
    for window in (1, 2, 7, 8, 50):
        text = [r.choice([b"a", b"b", b"ab", b"z"]) for _ in range(400)] + [b"a"] * 90
        spelt = [tuple(text[i : i + window]) for i in range(len(text) - window + 1)]
        places = {w: i for i, w in enumerate(sorted(set(spelt)))}
        assert repeats.deep_nodes(text, window).tolist() == [places[w] for w in spelt]


def test_subtrees_do_not_depend_on_how_rows_arrive(monkeypatch):
    r = random.Random(1)
    groups = sorted(r.sample(range(1000), 40))
    rows = [(a, r.randrange(9), 1, 2, r.randrange(50), b" ".join(r.choice([b"x", b"y"]) for _ in range(r.randrange(4, 20)))) for a in groups for _ in range(r.randrange(1, 30))]
    names = ["anchor", "doc_id", *repeats.CONTENT, "start", "words"]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def solved(size, batch_rows):
        monkeypatch.setattr(repeats, "GROUP_BYTES", size)
        out = pa.Table.from_batches(repeats._subtrees(4)(iter(table.to_batches(batch_rows)))).to_pylist()
        return sorted((row["doc_id"], start) for row in out for start in row["starts"])

    # Here windows of different groups may be equal, so every group is made distinct by its own letters.
    own = pa.array([w.replace(b"x", b"x%d" % a).replace(b"y", b"y%d" % a) for a, w in zip(table["anchor"].to_pylist(), table["words"].to_pylist())], pa.binary())
    table = table.set_column(5, "words", own)
    whole = solved(1 << 20, 10_000)
    assert len(whole) > 1000
    assert all(solved(size, n) == whole for size, n in ((1, 7), (500, 7), (2000, 100), (5000, 3)))


@pytest.mark.parametrize(("window", "size"), [(50, 4 << 20), (8, 4 << 20), (21, 4 << 20), (50, 3000), (8, 100), (21, 0)])
def test_repeats_equal_brute_force(documents, words, monkeypatch, window, size):
    # Groups of all sizes are subtrees of one task, several at a time, or split into ranges.
    monkeypatch.setattr(repeats, "GROUP_BYTES", size)
    rows = corpus(words)
    found = repeats.without_repeats(documents(rows), window).drop("kept")
    assert sorted(tuple(r) for r in found.collect()) == brute_repeats(rows, window)


def test_repeats_of_repeated_ids_and_no_ids(documents, words):
    text, other = " ".join(words(70, 1)), " ".join(words(70, 2))
    rows = [(1, text), (1, text), (1, other), (2, text + " end"), (None, text), (3, other)]
    found = sorted((str(r["doc_id"]), r["n_removed"]) for r in repeats.without_repeats(documents(rows)).collect())
    assert found == [("1", 0), ("1", 0), ("1", 0), ("2", 70), ("3", 70), ("None", 0)]


def test_cut_repeats_keeps_columns_and_untouched_texts(documents, words):
    passage = " ".join(words(60, 5))
    rows = [(1, "a  b\n" + passage), (2, passage), (3, "head " + passage + " tail"), (4, None), (5, "x\ty"), (None, passage)]
    docs = documents(rows)
    out = repeats.cut_repeats(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(1, "a  b\n" + passage), (3, "head tail"), (4, None), (5, "x\ty"), (None, passage)}
    assert {r["n_chars"] for r in out.where("doc_id = 3").collect()} == {len("head tail")}


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def brute_hits(rows, items, window):
    windows = {}
    for item, text in items:
        w = alnum(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc, text in rows:
        w = alnum(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if by := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= by
        names = sorted(str(i) for i in found if i is not None)
        out.append((str(doc), len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def contaminated(words):
    items = [(i, " ".join(words(14 + i, 50 + i, 60))) for i in range(12)] + [(20, "Short item"), (21, None), (22, "..."), (23, "w1"), (None, " ".join(words(12, 77)))]
    items += [(24, items[0][1]), (25, items[0][1] + " more words here")]
    rows = [(i, " ".join(words(80, i, 60))) for i in range(20)]
    rows += [(40 + i, "Lead-in: " + " ".join(words(5, i)) + ", " + items[i][1].upper() + "! " + " ".join(words(5, i))) for i in range(12)]
    rows += [(60, "a SHORT-item."), (61, " ".join(words(12, 77))), (None, items[3][1])]
    return rows + ODD, items


def test_items_of_one_repeated_word_are_built_and_scanned_in_linear_time():
    same = [b"a"] * 30_000
    automaton = decontamination.SuffixAutomaton([("long", same), ("short", [b"a"] * 3), ("two", [b"b", b"a"])], 10)
    began = time.perf_counter()
    spans, items = automaton.scan(same + [b"x", b"b", b"a"])
    assert spans == [(0, 30_000), (30_001, 30_003)] and items == {"long", "short", "two"}
    assert time.perf_counter() - began < 5


def test_long_items_are_cut_without_losing_a_window(spark, documents, words, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 60)
    long = words(500, 8, 2000)
    items = [(1, " ".join(long)), (1, " ".join(long)), (2, "two words")]
    rows = [(i, " ".join(["x"] + long[i : i + 10] + ["y"])) for i in range(0, 490, 7)] + [(1000, " ".join(long)), (1001, "x two words")]
    found = decontamination.digest(decontamination.contamination(documents(rows), benchmark(spark, items)))
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == brute_hits(rows, items, 10)


@pytest.mark.parametrize("shard", [500_000, 40])
def test_hits_equal_brute_force(spark, documents, words, monkeypatch, shard):
    rows, items = contaminated(words)
    monkeypatch.setattr(decontamination, "SHARD_WORDS", shard)
    found = decontamination.digest(decontamination.contamination(documents(rows), benchmark(spark, items)))
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == brute_hits(rows, items, 10)


def test_decontaminate_cuts_spans_and_keeps_the_rest(spark, documents, words):
    item = " ".join(words(12, 1, 60))
    rows = [(1, "Before, it: " + item.upper() + " - and after it all goes on for quite some words."), (2, item), (3, "clean  text"), (4, None)]
    out = decontamination.decontaminate(documents(rows), benchmark(spark, [(1, item)]))
    kept = {r["doc_id"]: r for r in out.collect()}
    assert set(kept) == {1, 3, 4} and kept[3]["text"] == "clean  text" and kept[4]["text"] is None
    assert item.upper() not in kept[1]["text"] and kept[1]["text"].startswith("Before, it:")
    assert kept[1]["n_chars"] == len(kept[1]["text"])


def test_decontaminate_does_not_depend_on_the_number_of_shards(spark, documents, words, monkeypatch):
    rows, items = contaminated(words)
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    # Windows of two shards that overlap; three tenths of a text hit by each of two; words that only a cut brings together.
    items += [(30, " ".join(a)), (31, " ".join(a[30:] + b[:30])), (32, " ".join(b))]
    rows += [(80, " ".join(words(80, 1, 60) + a[10:] + b[:5] + words(80, 2, 60))), (81, " ".join(a[:30] + words(40, 3, 60) + b[10:]))]
    rows += [(82, " ".join(words(60, 4, 60) + b[:20] + a[:40] + b[20:25] + words(60, 5, 60))), (82, " ".join(words(60, 4, 60) + b[:5] + a + b[5:12] + words(60, 5, 60)))]
    docs = documents(rows)

    def cleaned(shard):
        monkeypatch.setattr(decontamination, "SHARD_WORDS", shard)
        out = decontamination.decontaminate(docs, benchmark(spark, items))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        return sorted(map(str, out.collect()))

    assert cleaned(40) == cleaned(500_000)


def test_empty_tables(spark, documents):
    empty = documents([]).limit(0)
    assert jaccard.similar_documents(empty).count() == 0
    assert repeats.without_repeats(empty).count() == 0
    assert decontamination.contamination(empty, benchmark(spark, [])).count() == 0
    assert decontamination.contamination(documents(ODD), benchmark(spark, [])).where("size(starts) > 0").count() == 0
