"""Url trust, archives, token counts, packing and vectors: brute force, round trips, awkward rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfcast.llm import flatgraph, packing, separators, urltrust, warc
from shelfcast.llm.queries import RULES
from shelfcast.llm.tokenizing import encoder

RULE_LIST = [urltrust.split_rule(*r) for r in RULES]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, host string, rank int").repartition(3)


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_trust(rows):
    found, seeds, links = [], {"allow": Counter(), "block": Counter()}, Counter()
    for _, url, html in rows:
        host, path = split_url(url)
        fits = [r for r in RULE_LIST if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rule = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        found.append((host, path, rule))
        if rule:
            seeds[rule[0]][host] += 1
        for link in re.findall(urltrust.LINK, html or ""):
            if (dst := split_url(link if "://" in link else "http:" + link)[0]) and host and dst != host:
                links[host, dst] += 1

    def walk(seed, edges):
        total, out = sum(seed.values()), Counter()
        outgoing = defaultdict(Counter)
        for (a, b), n in edges.items():
            outgoing[a][b] += n
        moving = {h: n / total for h, n in seed.items()}
        while True:
            new = set(moving) - set(out)
            for h, x in moving.items():
                out[h] += (1 - urltrust.DAMPING) * x
            if sum(moving.values()) < urltrust.TOLERANCE and not new:
                return out
            step = Counter()
            for h, x in moving.items():
                for b, n in outgoing[h].items():
                    step[b] += urltrust.DAMPING * x * n / sum(outgoing[h].values())
            moving = step

    trust = walk(seeds["allow"], links)
    distrust = walk(seeds["block"], {(b, a): n for (a, b), n in links.items()})
    out = []
    for (page, _, _), (host, path, rule) in zip(rows, found):
        t, d = trust[host], distrust[host]
        verdict = rule[0] if rule else "block" if t + d > 0 and d >= 0.5 * (t + d) else "allow"
        out.append((page, host, path, rule and rule[1] + rule[2], verdict, round(t, 9), round(d, 9)))
    return sorted(out, key=str)


def test_url_trust_equals_brute_force(spark):
    r = random.Random(4)
    hosts = ["a.com", "WWW.Example.com", "example.com", "b.net", "c.org", "d.org", "e.org", "f.org", "com", "notcom"]
    rows = []
    for i in range(150):
        html = "".join(f'<a href="https://{r.choice(hosts)}/x">' for _ in range(r.randrange(4)))
        rows.append((i, f"https://{r.choice(hosts)}{r.choice(['', '/', '/en/1', '/fr/2?q', '/es/#t', '?a', '#b'])}", html))
    rows += [(200, None, "<a href='https://c.org/'>"), (201, "no scheme", None), (202, "", ""), (203, "x://?q", ""), (None, "https://c.org/", None), (204, "a://b://c/d", ""), (204, "a://b://c/d", "")]
    found = urltrust.judged(pages(spark, rows), RULE_LIST)
    assert sorted(((*x[:5], round(x[5], 9), round(x[6], 9)) for x in found.collect()), key=str) == brute_trust(rows)
    assert urltrust.judged(pages(spark, rows).limit(0), RULE_LIST).count() == 0


def test_distrust_reaches_far_hosts_by_links_of_any_form(spark, monkeypatch):
    monkeypatch.setattr(urltrust, "CUT_ROUNDS", 5)
    forms = ['<a href="http://{}/x">', "<A HREF='//{}/x'>", "<img src=//{}/x>", "<a href = HTTPS://{}?q>"]
    chain = [f"c{i}" for i in range(20)] + ["bad.net"]
    rows = [(i, f"http://{chain[i]}/p", forms[i % 4].format(chain[i + 1])) for i in range(20)]
    rows += [(50, "http://bad.net/es/1", "<p>"), (51, "http://alone/p", '<a data-href="http://bad.net/es/">')]
    # A walk that would end early by its tolerance goes on while it reaches new hosts.
    found = {x["page_id"]: x["verdict"] for x in urltrust.judged(pages(spark, rows), RULE_LIST, tolerance=0.5).collect()}
    assert found == {i: "block" for i in range(20)} | {50: "block", 51: "allow"}


def test_archives_round_trip(spark, tmp_path):
    r = random.Random(5)
    bodies = ["<p>" + " ".join(r.choice(["alpha", "beta", "gamma", "é"]) for _ in range(300)) + "</p>" for _ in range(120)]
    rows = [(i, f"https://h/{i} x\n", bodies[i % 60 if i < 90 else i % 120]) for i in range(400)]
    rows += [(1000, None, None), (1001, "u", ""), (None, "u", bodies[0]), (3, "again", bodies[3]), (3, "other", "new"), (1002, "u", "x" * 3_000_000)]
    table = pages(spark, rows)
    written = warc.write_archives(table, folder=f"file://{tmp_path}/w", file_bytes=20_000).cache()
    assert written.agg({"records": "sum"}).first()[0] == len(rows)
    found = warc.read_archives(written, payloads=True).collect()
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    expected = []
    for i, _, h in rows:
        body = (h or "").encode()
        first = least.get(h or "")
        revisit = i is not None and i != first
        expected.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None, b"" if revisit else body))
    got = [(x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"], bytes(x["payload"])) for x in found]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert warc.read_archives(warc.write_archives(table.limit(0))).count() == 0


def test_archive_begins_with_its_dictionary(tmp_path):
    r = random.Random(5)
    bodies = [("<p>" + " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(300)) + "</p>").encode() for _ in range(100)]
    archive = warc.ArchiveWriter(f"{tmp_path}/a.warc.zst")
    for i, body in enumerate(bodies):
        archive.add(warc.Record(i, "u", body, len(body), hashlib.sha1(body).digest(), None))
    path, _, size = archive.close()
    raw = open(path, "rb").read()
    assert raw[:4] == bytes.fromhex("5d2a4d18") and len(raw) == size
    assert [x.payload for x in warc.read_archive(path)] == bodies


def test_archive_damage_is_noticed(tmp_path):
    archive = warc.ArchiveWriter(f"{tmp_path}/a.warc.zst")
    for i in range(30):
        body = b"some payload %d" % i
        archive.add(warc.Record(i, "u", body, len(body), hashlib.sha1(b"else" if i == 20 else body).digest(), None))
    path, records, _ = archive.close()
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_archive(path))


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab é\n\t '\u00a0", max_size=40))
def test_ids_are_those_of_tokenizers(text):
    if not hasattr(test_ids_are_those_of_tokenizers, "t"):
        t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        t.encode_special_tokens = True
        test_ids_are_those_of_tokenizers.t = t
    assert encoder().encode(text).tolist() == test_ids_are_those_of_tokenizers.t.encode(text, add_special_tokens=False).ids


TEXTS = [(1, None), (2, ""), (3, "short text"), (None, "no id"), (3, "short text"), (4, "word " * 3000), (5, "ñandú 中文 " * 400), (6, "<|endoftext|> as text")]


def expected_ids():
    out = []
    for doc, text in TEXTS:
        t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        t.encode_special_tokens = True
        out.append((doc, (t.encode(text, add_special_tokens=False).ids if text else []) + [2]))
    return out


@pytest.mark.parametrize("options", [{}, {"by": "dot", "weights": (1.0, 1.0, 1.0)}, {"max_documents": 3, "max_cost": 600_000, "length": 700}])
def test_packing_keeps_every_token_and_constraint(documents, options):
    length = options.get("length", 1024)
    rows = packing.packed(documents(TEXTS * 5), **options).collect()
    want = Counter()
    for doc, ids in expected_ids() * 5:
        start, piece = 0, 0
        while start < len(ids):
            n = (len(ids) - start) % length or length
            want[doc, piece, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
            start, piece = start + n, piece + 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length and len(places) <= options.get("max_documents", length)
        assert sum(n * n for _, n in places) <= options.get("max_cost", length * length)
    assert packing.packed(documents(TEXTS).limit(0)).count() == 0


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_best_fit_is_close_to_the_bound(by):
    lengths = np.random.default_rng(0).integers(1, 1024, 5000)
    found = {packing.best_fit(lengths, (1024, 1024, 1024**2), weights, by)[0].max() + 1 for weights in ((1.0, 0.0, 0.0), packing.WEIGHTS)}
    assert max(found) <= 1.02 * lengths.sum() / 1024 + 1


def test_other_capacities_decide_between_bins():
    # By tokens the last piece goes to 450 + 440; 590 + 290 leaves ten tokens more, but has used up more attention cost.
    lengths, full = np.array([590, 450, 440, 290, 60]), (1024, 1024, 1024**2)
    assert packing.best_fit(lengths, full, (1.0, 0.0, 0.0), "norm")[0].tolist() == [0, 1, 1, 0, 1]
    assert packing.best_fit(lengths, full, packing.WEIGHTS, "norm")[0].tolist() == [0, 1, 1, 0, 0]


def test_packing_again_gives_the_same_sequences(spark, documents, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 20)
    out = packing.packed(documents([(None, "no id")] * 40 + [(i, "word " * (i % 7)) for i in range(40)]))
    first = sorted(map(str, out.collect()))
    assert first == sorted(map(str, out.collect())) and len({r["sequence_id"] for r in out.collect()}) >= 3


@pytest.mark.parametrize("block", [1 << 20, 7, 64])
def test_separator_scan_counts_every_document(documents, block):
    found = Counter(tuple(r) for r in separators.document_tokens(documents(TEXTS), block_tokens=block).collect())
    assert found == Counter((doc, len(ids) - 1) for doc, ids in expected_ids())


def test_scan_of_open_and_empty_files(spark, tmp_path):
    end = separators.END
    files = {"a": [end, 5, 6, end, end, 7, 8, 9], "b": [], "c": [1, 2], "d": [end]}
    for name, ids in files.items():
        np.array(ids, "<u2").tofile(tmp_path / name)
    table = spark.createDataFrame([(str(tmp_path / n), 2 * len(ids)) for n, ids in files.items()], "path string, bytes long")
    found = {(r["path"][-1], r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in separators.count_tokens(table, block_tokens=3).collect()}
    assert found == {("a", 0, 0, 0, True), ("a", 1, 1, 2, True), ("a", 2, 4, 0, True), ("a", 3, 5, 3, False), ("c", 0, 0, 2, False), ("d", 0, 0, 0, True)}


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, la, 1) for i, v, la in rows], "vec_id long, embedding array<float>, label int, node int").repartition(3)


def brute_vectors(rows, threshold):
    units = flatgraph.usable([None if v is None else [None if x is None else float(np.float32(x)) for x in v] for _, v, _ in rows])
    near = defaultdict(set)
    for i, (_, _, la) in enumerate(rows):
        for j in range(i):
            if la is not None and la == rows[j][2] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                near[i].add(j)
                near[j].add(i)
    out = []
    for i, (vec, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        least = min(rows[k][0] for k in seen)
        out.append((vec, len(near[i]), least, least == vec))
    return sorted(out)


@pytest.mark.parametrize("size", [1500, 40])
def test_vectors_equal_brute_force(spark, size):
    r = np.random.default_rng(6)
    rows = []
    for k in range(40):
        centre = r.normal(size=12)
        for e in range(8):
            rows.append((len(rows), (centre + r.normal(size=12) * 0.02 * e).tolist(), k % 3))
    rows += [(900 + i, rows[0][1], 0) for i in range(60)]
    rows += [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 12, 0), (1003, [None] + [1.0] * 11, 0), (1004, [float("nan")] * 12, 0), (1005, [float("inf")] * 12, 0), (1006, rows[0][1], None), (1007, [1.0, 2.0], 0), (1008, [1.0, 2.0], 0)]
    found = sorted(tuple(x) for x in flatgraph.near_vectors(vectors(spark, rows), size=size).collect())
    assert found == brute_vectors(rows, 0.98)
    assert flatgraph.near_vectors(vectors(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("spread", [1e-3, 0.045, 1e-12])
def test_a_dense_group_over_many_shards_is_whole(spark, spread):
    r = np.random.default_rng(8)
    centre = r.normal(size=8)
    rows = [(i, (centre + r.normal(size=8) * spread * np.linalg.norm(centre)).tolist(), 1) for i in range(150)] + [(200, (-centre).tolist(), 1)]
    found = sorted(tuple(x) for x in flatgraph.near_vectors(vectors(spark, rows), size=30).collect())
    assert found == brute_vectors(rows, 0.98)


def test_members_are_bounded_by_the_overlap(spark):
    r = np.random.default_rng(9)
    rows = [(int(i), r.normal(size=6).tolist()) for i in range(400)]
    nodes = spark.createDataFrame([(i, i.to_bytes(16, "big"), (np.array(v) / np.linalg.norm(v)).tobytes(), "a") for i, v in rows], "node long, key binary, unit binary, label string")
    members = flatgraph.shards(nodes, 3, 20, 0.4).groupBy("node").agg({"home": "count", "*": "count"}).collect()
    assert len(members) == 400 and max(m[1] for m in members) <= 3
    homes = flatgraph.shards(nodes, 3, 20, 0.4).where("home").groupBy("node").count().collect()
    assert [h["count"] for h in homes] == [1] * 400
