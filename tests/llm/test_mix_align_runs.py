"""Mixing, alignment and runs against brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfcast.llm import alignment, mixing, periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size long, range long, copies long, row long, runs int, a int"


def table(spark, rows):
    """doc_id, text, source beside columns with names that the operators use themselves."""
    return spark.createDataFrame([(i, t, s, 1, 2, 3, 4, 5, 6) for i, t, s in rows], SCHEMA).repartition(3)


def brute_mix(rows, weights=(5, 2, 1), share=1.5, most=2):
    size = {s: 0 for _, _, s in rows}
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = {}, share * sum(size.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * left / total > most * size[s]}
        if not above:
            target |= {s: weight[s] * left / total for s in open_}
            break
        target |= {s: float(most * size[s]) for s in above}
        left -= sum(most * size[s] for s in above)
        open_ -= above
    out = []
    for s in names:
        whole = int(target[s] + 0.5)
        rounds, rest = divmod(whole, size[s]) if size[s] else (0, 0)
        own = [(hashlib.md5(":".join(["mix-1"] + [str(x) for x in (i, t) if x is not None]).encode()).hexdigest(), i, len(WORD.findall(t or ""))) for i, t, q in rows if q == s]
        for _, i, n in sorted(own, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
            part = max(0, min(n, rest))
            rest -= part
            out.append((i, n, size[s], round(target[s], 6), rounds * n + part))
    return sorted(out, key=str)


def some_rows(n=300):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.randrange(0, 40)) + r.choice(["", "\n", " x\t"]), r.choice(["a", "b", "c", "é", "", None])) for i in range(n)]
    return rows + [(None, "no id", "a"), (400, None, "b"), (401, "", None), (402, " \n\t ", "c"), (403, "long " * 30_000, "hot")]


def taken(plan):
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.documents_taken(plan).collect()), key=str)


@pytest.mark.parametrize("rows_per_range", [7, 20_000])
def test_mix_equals_brute_force(spark, rows_per_range):
    rows = some_rows()
    found = taken(mixing.mixture(table(spark, rows), rows_per_range=rows_per_range))
    assert found == brute_mix(rows)
    assert sum(r[4] for r in found) == pytest.approx(sum(1.5 * r[1] for r in found), abs=len({r[2] for r in rows}))


def test_repeated_rows_are_cut_in_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES_PER_BLOCK", 16)
    rows = [(7, "one two three", "a")] * 500 + [(8, "four five", "b")] * 20 + [(9, "a b c d", "b")]
    plan = mixing.mixture(table(spark, rows), rows_per_range=5).cache()
    assert plan.count() == 3
    assert taken(plan) == brute_mix(rows)
    texts = mixing.mixed_texts(table(spark, rows), plan).collect()
    assert sum(r["words"] for r in texts) == sum(len(WORD.findall(r["text"])) for r in texts) == sum(r[4] for r in brute_mix(rows))


def test_mixed_texts_are_what_was_taken(spark):
    rows = some_rows(120)
    docs = table(spark, rows)
    plan = mixing.mixture(docs, rows_per_range=9).cache()
    words = Counter()
    whole = {(i, t) for i, t, _ in rows}
    for r in mixing.mixed_texts(docs, plan).collect():
        assert len(WORD.findall(r["text"])) == r["words"]
        own = next(t for i, t in whole if i == r["doc_id"])
        assert r["text"] == own or r["text"].split() == own.split()[: r["words"]]
        words[r["doc_id"]] += r["words"]
    assert words == Counter({r[0]: r[4] for r in taken(plan) if r[4]})


def test_mix_of_nothing(spark):
    none = table(spark, []).limit(0)
    plan = mixing.mixture(none)
    assert mixing.documents_taken(plan).count() == 0 and mixing.mixed_texts(none, plan).count() == 0
    empty = [(1, None, "a"), (2, "", None)]
    assert taken(mixing.mixture(table(spark, empty))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    # A share above what repeats may give stops every source at its most.
    assert [r[4] for r in taken(mixing.mixture(table(spark, [(1, "a b", "x"), (2, "c", "y")]), share=9.0))] == [4, 2]


def byte_table():
    """The usual letters for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def brute_align(rows):
    one = Tokenizer.from_file(path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    letters, docs = byte_table(), []
    for i, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        spelled_a = [bytes(letters[c] for c in one.id_to_token(t)) for t in a]
        spelled_b = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x..>", p) else p.replace("▁", " ").encode() for p in map(two.id_to_piece, b)]
        raw = (" " + (text or "")).encode()
        if b"".join(spelled_a) != raw or b"".join(spelled_b) != raw:
            a, b, spelled_a, spelled_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(t) for t in spelled_a]), np.cumsum([len(t) for t in spelled_b])
        links = [(a[x], b[y]) for x in range(len(a)) for y in range(len(b)) if max(ends_a[x] - len(spelled_a[x]), ends_b[y] - len(spelled_b[y])) < min(ends_a[x], ends_b[y])]
        groups, x, y = [], 0, 0
        for cut in sorted({int(e) for e in ends_a} & {int(e) for e in ends_b}):
            nx, ny = list(ends_a).index(cut) + 1, list(ends_b).index(cut) + 1
            groups.append(",".join(map(str, a[x:nx])) + "|" + ",".join(map(str, b[y:ny])))
            x, y = nx, ny
        docs.append((i, a, b, groups, links))
    count = Counter(p for *_, links in docs for p in set(links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted(
        ((i, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") for i, a, b, groups, links in docs),
        key=str,
    )


TEXTS = [
    "Hello world, hello tokens.", "  two  spaces\n\nand lines\t", "naïve café déjà-vu Ångström", "数字 漢字 text", "emoji 🎉🎉 end", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "1234567890 3.14159", "<s> <unk> </s> <0x41> <|endoftext|>", "piece ▁ mark", "\x00\x01 control", " ", "", None, "x", "the the the", "Hello world, hello tokens.",
]


@pytest.mark.parametrize("head", [1 << 20, 12, 0])
def test_alignment_equals_brute_force(spark, head):
    r = random.Random(3)
    rows = list(enumerate(TEXTS)) + [(100 + k, " ".join(r.choice("alpha beta gamma delta unbelievable tokenisation zxqv".split()) for _ in range(60))) for k in range(20)]
    rows += [(None, "no id here"), (5, "aaa bbb"), (5, "aaa bbb"), (300, "very long " * 300)]
    found = alignment.valued(table(spark, [(i, t, "s") for i, t in rows]), head=head).collect()
    assert sorted((tuple(x) for x in found), key=str) == brute_align(rows)


def test_groups_are_spelled_alike(spark):
    docs = table(spark, [(i, t, "s") for i, t in enumerate(TEXTS)])
    pair = alignment.pair_of(alignment.Files())
    spelled = defaultdict(dict)
    for r in alignment.groups(alignment.aligned(docs)).collect():
        one, two = b"".join(pair.bytes_a[t] for t in r["a"]), b"".join(pair.bytes_b[t] for t in r["b"])
        assert one == two and one
        spelled[r["doc_id"]][r["group"]] = one
    assert {i: b"".join(g[k] for k in range(len(g))).decode() for i, g in spelled.items()} == {i: " " + t for i, t in enumerate(TEXTS) if t and "▁" not in t}


def test_alignment_of_nothing(spark):
    assert alignment.valued(table(spark, []).limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 60), max_size=50), st.sets(st.integers(1, 60), max_size=50)), min_size=1, max_size=4), st.integers(1, 5))
def test_shared_cuts_are_all_common_ends(texts, tries):
    ends_a, ends_b, last_a, last_b = [], [], [], []
    for k, (a, b) in enumerate(texts):
        ends_a += [100 * k + e for e in sorted(a | {61})]
        ends_b += [100 * k + e for e in sorted(b | {61})]
        last_a.append(len(ends_a) - 1)
        last_b.append(len(ends_b) - 1)
    a, b = np.array(ends_a), np.array(ends_b)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(alignment, "TRIES", tries)
        closes_a, closes_b = alignment.shared_cuts(a, b, np.array(last_a), np.array(last_b))
    common = np.intersect1d(a, b)
    assert (a[closes_a] == common).all() and (b[closes_b] == common).all()


def brute_runs(words, least=6, exponent=4):
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                own = words[i : i + length]
                if not any(own[r:] == own[:-r] for r in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)),
    )


def test_runs_equal_brute_force(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("abcdefg"[: 1 + i % 7]) for _ in range(r.randrange(0, 200)))) for i in range(150)]
    rows += [(500 + i, "\t".join((["é", "b", "c", "d", "e"][: 1 + i % 5]) * r.randrange(1, 30)) + " tail") for i in range(60)]
    rows += [(None, "a " * 9), (None, None), (700, ""), (701, " \n"), (702, "x y " * 2500), (703, "w " * 6000), (5, "k l m n " * 5), (5, "k l m n " * 5)]
    found = periodic.digest(periodic.collapsed(table(spark, [(i, t, "s") for i, t in rows]), rewrite=periodic.planted))
    assert sorted((tuple(x) for x in found.collect()), key=str) == sorted((brute_collapse(*row) for row in rows), key=str)
    assert periodic.collapsed(table(spark, []).limit(0)).count() == 0


def test_a_run_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK", 100)
    monkeypatch.setattr(periodic, "SLAB", 64)
    words = [f"w{k % 150}" for k in range(1000)]
    rows = [(1, " ".join(words)), (2, "a b " * 3), (3, "c"), (4, " ".join(words[:599])), (6, "d d d d d")]
    found = {x["doc_id"]: [tuple(run) for run in x["runs"]] for x in periodic.collapsed(table(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert found == {1: [(0, 1000, 150)], 2: [], 3: [], 4: [], 6: []} | {2: brute_runs("a b a b a b".split())}
    kept = periodic.collapsed(table(spark, [(1, "x y z " * 10 + "end", "s")])).first()
    assert kept["collapsed"] == "x y z end"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=90), min_size=1, max_size=4), st.sampled_from([4, 5]))
def test_find_runs(texts, exponent):
    texts = sorted(([str(v).encode() for v in t] for t in texts), key=len, reverse=True)
    values, lengths = periodic._numbered(texts)
    expected, start = [], 0
    for t in texts:
        expected += [(start + s, n, q) for s, n, q in brute_runs(t, exponent=exponent)]
        start += len(t)
    assert [tuple(x) for x in periodic.find_runs(values, lengths, exponent=exponent).tolist()] == expected


def test_multiples_of_the_prime_are_no_runs(monkeypatch):
    monkeypatch.setattr(periodic, "_mod", lambda x: x % np.uint64(periodic.PRIME))
    big = np.array([1, 1 + periodic.PRIME] * 40, np.uint64)  # equal modulo the prime, different as values
    assert [tuple(x) for x in periodic.find_runs(big, np.array([80])).tolist()] == [(0, 80, 2)]


@pytest.mark.parametrize("size", [2, 8, 64])
def test_transform_is_exact(size):
    x = np.random.default_rng(size).integers(0, periodic.PRIME, (3, size)).astype(np.uint64)
    assert (periodic.inverse(periodic.transform(x)) == x).all()
    y = np.zeros((1, size), np.uint64)
    y[0, 1] = 1
    shifted = periodic.inverse(periodic.transform(x) * periodic.transform(y) % np.uint64(periodic.PRIME))
    assert (shifted == np.roll(x, 1, axis=1)).all()
