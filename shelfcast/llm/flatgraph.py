"""Embedding near-dedup on a robust-pruned flat graph.

1. Vectors of equal label and equal direction (normalised, compared bit by bit) are one node with a
   count; the graph is over the different ones.
2. The nodes of a label are cut into overlapping shards of about ``size`` nodes: a tree of sampled centres splits what is too
   large. A node goes to its nearest centre, and near a border to the second as well, ``overlap`` copies in all, whatever the
   depth. What centres can't tell apart is split by hash, neighbouring parts overlapping in the same way.
3. In a shard, each node's candidates are pruned robustly: the nearest stays and rules out those that
   are ``alpha`` times nearer to it than to the node. A node's list is the union of its lists of all shards.
4. A search that starts in a node and expands over nodes within the threshold and a little beyond never leaves
   the nodes joined by edges of that length. These parts of the flat graph, which may span many shards, are searched
   each by itself: every node is a query, greedy search from the part's medoid with a beam, then the range is expanded over neighbours
   of hits until no new one is found. Every link is verified by the cosine in double precision.
5. A part of more than ``size`` nodes (a dense group) is cut into its nodes' nearest shards. By their centres and radii two such cells
   hold only links, none (nothing to compare), or some: these are a shard of their own, with lists of their own beside the union.
6. Recall, in links between different vectors, is audited against brute force over all rows in blocks, for random nodes and
   for nodes with near neighbours; below ``RECALL`` the build is repeated with more overlap,
   and with the most it must reach ``LEAST_RECALL``.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with
a null label, link with nothing (0 links, their own component, kept); rows without an id take part with
their vector and get null as component if no vector with an id is reached; repeated rows are vectors of
their own. Vectors of different sizes never link. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import hash64, stored
from shelfcast.llm.components import components

SHARD = 1500
OVERLAP = 3
MOST_OVERLAP = 24
DEGREE = 16
BEAM = 32
ALPHA = 1.2
#: The range is expanded over nodes this much below the threshold.
SLACK = 0.04
#: Queries of the audit (half random, half with near neighbours), and the recall below which the build is repeated.
AUDIT = 512
RECALL = 0.95
#: What must be reached with the most overlap.
LEAST_RECALL = 0.9
#: Vectors that centres are chosen from, for each shard that is split.
CENTRE_SAMPLE = 4096
MOST_CENTRES = 64
#: Bytes of centres that the driver holds and sends at a time.
PORTION_BYTES = 1 << 25
#: Nodes of small parts that a task searches together, on average.
BIN = 200
#: Angles that differ by less are compared vector by vector.
TOLERANCE = 1e-6


def usable(vectors: list[list[float] | None]) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for those that link with nothing."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        if not v or any(x is None for x in v):
            out.append(None)
            continue
        a = np.array(v, np.float64)
        norm = np.sqrt((a / np.abs(a).max()) @ (a / np.abs(a).max())) * np.abs(a).max() if np.isfinite(a).all() and np.abs(a).max() > 0 else 0.0
        out.append(a / norm if norm > 0 and np.isfinite(norm) else None)
    return out


def _prepare(batches):
    for batch in batches:
        units = usable(batch.column("vector").to_pylist())
        labels = batch.column("label").to_pylist()
        ok = [u is not None and label is not None for u, label in zip(units, labels)]
        keys = [xxhash.xxh3_128_digest(f"{label}:{len(u)}:".encode() + u.tobytes()) if good else None for u, label, good in zip(units, labels, ok)]
        units = [u.tobytes() if good else None for u, good in zip(units, ok)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], names=["vec_id", "label", "key", "unit"])


def _matrix(units) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1)


def _centres(rows: pd.DataFrame) -> pd.DataFrame:
    """Centres of a shard that is too large: a few rounds of spherical k-means on its sample.

    None if most of the sample has the same nearest centre: then the shard is split by hash.
    """
    rows = rows.sort_values("key")
    shard, wanted, x = rows["shard"].iloc[0], int(rows["k"].iloc[0]), _matrix(rows["unit"].tolist())
    random = np.random.default_rng(hash64(shard.encode()) % 2**32)
    c = x[random.choice(len(x), min(len(x), wanted), replace=False)]
    for _ in range(4):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1)
        c = np.where((norms > 0)[:, None], sums / np.maximum(norms, 1e-300)[:, None], c)
    most = np.bincount(np.argmax(x @ c.T, axis=1)).max()
    split = most <= 0.7 * len(x)
    return pd.DataFrame({"shard": [shard], "size": [x.shape[1]], "k": [wanted], "centres": [c.tobytes() if split else b""]})


MEMBER = "shard string, node long, key binary, unit binary, budget int, home boolean"


def _split(centres: dict[str, tuple[int, np.ndarray | None]], border: float):
    """Deals the rows of large shards to their parts; ``border``: the angle between centres within which a node is near both."""

    def run(batches):
        for batch in batches:
            shards, keys, units = (batch.column(c).to_pylist() for c in ("shard", "key", "unit"))
            budget = batch.column("budget").to_numpy()
            rows, parts = [], []
            second = np.full(len(shards), -1)
            first = np.zeros(len(shards), np.int64)
            for shard, at in pd.DataFrame({"shard": shards}).groupby("shard").indices.items():
                k, c = centres[shard]
                if c is None or len(c) < 2:
                    first[at] = [hash64(keys[i] + shard.encode()) % k for i in at]
                    second[at] = (first[at] + 1) % k
                    continue
                cosine = _matrix([units[i] for i in at]) @ c.T
                two = np.argpartition(-cosine, 1, axis=1)[:, :2]
                near = np.take_along_axis(cosine, two, 1)
                swap = near[:, 1] > near[:, 0]
                two[swap], near[swap] = two[swap][:, ::-1], near[swap][:, ::-1]
                angle = np.arccos(np.clip(near, -1, 1))
                first[at] = two[:, 0]
                second[at] = np.where(angle[:, 1] - angle[:, 0] <= border, two[:, 1], -1)
            both = (second >= 0) & (budget > 1) & (second != first)
            rows = np.concatenate((np.arange(len(shards)), np.flatnonzero(both)))
            parts = np.concatenate((first, second[both])).tolist()
            budgets = np.concatenate((budget - both, np.ones(np.count_nonzero(both), budget.dtype)))
            kept = batch.take(pa.array(rows))
            home = kept.column("home").to_numpy(zero_copy_only=False) & (np.arange(len(rows)) < len(shards))
            names = pa.array([f"{s}.{p}" for s, p in zip(kept.column("shard").to_pylist(), parts)], pa.string())
            yield pa.RecordBatch.from_arrays([names, *(kept.column(c) for c in ("node", "key", "unit")), pa.array(budgets, pa.int32()), pa.array(home)], names=["shard", "node", "key", "unit", "budget", "home"])

    return run


def shards(nodes: DataFrame, overlap: int, size: int, border: float) -> DataFrame:
    """Overlapping shards of at most about ``size`` nodes; each node has one copy at home, in the nearest one."""
    open_ = nodes.select(
        F.concat_ws("/", "label", (F.length("unit") / 8).cast("int")).alias("shard"), "node", "key", "unit", F.lit(overlap).alias("budget"), F.lit(True).alias("home")
    )
    open_ = stored(open_, "flatgraph-open")
    done = None
    while True:
        counts = stored(open_.groupBy("shard").agg(F.count("*").alias("n"), (F.max(F.length("unit")) / 8).cast("int").alias("d")), "flatgraph-counts")
        large = stored(
            counts.where(F.col("n") > size).withColumn("k", F.least(F.lit(MOST_CENTRES), F.ceil(F.col("n") * 2 / size) + 1).cast("int")), "flatgraph-large"
        )
        small = open_.join(large.select("shard"), "shard", "left_anti")
        small = stored(small, "flatgraph-shards")
        done = small if done is None else done.unionByName(small)
        widest = large.agg(F.count("*").alias("n"), F.max("d").alias("d")).first()
        if not widest["n"]:
            return done
        rest = stored(open_.join(large, "shard"), "flatgraph-rest")
        # The sample of a shard has a bounded size in expectation; only centres reach the driver, of
        # a bounded number of bytes at a time.
        sample = rest.where(F.pmod(F.xxhash64("key", "shard"), F.lit(1_000_000)) < F.lit(1e6 * CENTRE_SAMPLE) / F.col("n"))
        found = stored(sample.groupBy("shard").applyInPandas(_centres, "shard string, size long, k long, centres binary"), "flatgraph-centres")
        portions = 1 + widest["n"] * widest["d"] * 8 * MOST_CENTRES // PORTION_BYTES
        parts = []
        for i in range(portions):
            mine = F.pmod(F.xxhash64("shard"), F.lit(portions)) == i
            centres = {r["shard"]: (r["k"], np.frombuffer(r["centres"], np.float64).reshape(-1, r["size"]) if r["centres"] else None) for r in found.where(mine).collect()}
            own = rest.where(mine).select("shard", "node", "key", "unit", "budget", "home")
            parts.append(stored(own.mapInArrow(_split(centres, border), MEMBER), "flatgraph-open"))
        open_ = parts[0]
        for part in parts[1:]:
            open_ = open_.unionByName(part)


def pruned(x: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust-pruned neighbours of each row (indices, -1 where there are fewer), from its nearest rows."""
    n = len(x)
    wide = min(n - 1, 3 * degree)
    out = np.full((n, degree), -1, np.int64)
    if wide <= 0:
        return out
    for lo in range(0, n, 256):
        hi = min(n, lo + 256)
        cosine = x[lo:hi] @ x.T
        cosine[np.arange(hi - lo), np.arange(lo, hi)] = -np.inf
        near = np.argpartition(-cosine, wide - 1, axis=1)[:, :wide]
        order = np.argsort(-np.take_along_axis(cosine, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        far = np.sqrt(np.maximum(0.0, 2 - 2 * np.take_along_axis(cosine, near, 1)))
        between = x[near]  # rows x wide x size
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("rik,rjk->rij", between, between)))
        open_ = np.ones((hi - lo, wide), bool)
        taken = np.zeros(hi - lo, np.int64)
        rows = np.arange(hi - lo)
        for j in range(wide):
            pick = open_[:, j] & (taken < degree)
            r = rows[pick]
            out[lo + r, taken[r]] = near[r, j]
            taken[r] += 1
            open_[r] &= ~(alpha * apart[r, j] <= far[r])
            if not (open_[:, j + 1 :].any(axis=1) & (taken < degree)).any():
                break
    return out


def search(x: np.ndarray, graph: list[np.ndarray], queries: np.ndarray, beam: int) -> np.ndarray:
    """Greedy beam search for each query row from the medoid; the nodes left in each beam (-1: none)."""
    n, q = len(x), len(queries)
    degree = max(1, max(len(g) for g in graph))
    table = np.full((n, degree), -1, np.int64)
    for i, g in enumerate(graph):
        table[i, : len(g)] = g
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    width = min(beam, n)
    held = np.full((q, width), -1, np.int64)
    score = np.full((q, width), -np.inf)
    expanded = np.zeros((q, width), bool)
    held[:, 0], score[:, 0] = medoid, queries @ x[medoid]
    seen = np.zeros((q, n), bool)
    seen[:, medoid] = True
    rows = np.arange(q)
    for _ in range(4 * width + 8):
        waiting = np.where(expanded | (held < 0), -np.inf, score)
        best = np.argmax(waiting, axis=1)
        active = rows[waiting[rows, best] > -np.inf]
        if not len(active):
            break
        expanded[active, best[active]] = True
        near = table[held[active, best[active]]]
        fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        seen[active[r], near[r, c]] = True
        cosine = np.full(near.shape, -np.inf)
        cosine[r, c] = np.einsum("ij,ij->i", queries[active[r]], x[near[r, c]])
        all_held = np.hstack([held[active], np.where(fresh, near, -1)])
        all_score = np.hstack([score[active], cosine])
        all_done = np.hstack([expanded[active], np.zeros(near.shape, bool)])
        top = np.argsort(-all_score, axis=1, kind="stable")[:, :width]
        held[active] = np.take_along_axis(all_held, top, 1)
        score[active] = np.take_along_axis(all_score, top, 1)
        expanded[active] = np.take_along_axis(all_done, top, 1)
    return held


def expanded(x: np.ndarray, graph: list[np.ndarray], first: np.ndarray, queries: np.ndarray, threshold: float, slack: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each query row: all nodes within the threshold that the range expansion reaches."""
    for q, start in enumerate(first):
        v = queries[q]
        seen = np.zeros(len(x), bool)
        start = start[start >= 0]
        seen[start] = True
        cosine = x[start] @ v
        hits = [start[cosine >= threshold]]
        frontier = start[cosine >= threshold - slack]
        while len(frontier):
            near = np.unique(np.concatenate([graph[i] for i in frontier]))
            near = near[~seen[near]]
            seen[near] = True
            cosine = x[near] @ v
            hits.append(near[cosine >= threshold])
            frontier = near[cosine >= threshold - slack]
        yield q, np.concatenate(hits)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least one joined to it by the pairs a, b."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        i, j = root(i), root(j)
        parent[max(i, j)] = min(i, j)
    return np.array([root(i) for i in range(n)], np.int64)


def _neighbours(degree: int, alpha: float, close: float):
    """A shard's lists by node, and the least node that edges of at least the cosine ``close`` join it to."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node").reset_index(drop=True)
        nodes, x = rows["node"].to_numpy(), _matrix(rows["unit"].tolist())
        near = pruned(x, degree, alpha)
        a, b = both_ways(near)
        short = np.einsum("ij,ij->i", x[a], x[b]) >= close
        order = np.argsort(a, kind="stable")
        lists = np.split(nodes[b[order]], np.cumsum(np.bincount(a, minlength=len(x)))[:-1])
        least = nodes[_roots(len(x), a[short], b[short])]
        return pd.DataFrame({"node": nodes, "near": pd.Series([np.unique(n) for n in lists], dtype=object), "least": least})

    return run


def both_ways(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of pruned neighbours in both directions, so that every node can be reached from its own."""
    i, j = np.nonzero(near >= 0)
    other = near[i, j]
    return np.concatenate([i, other]), np.concatenate([other, i])


def linked(nodes: np.ndarray, x: np.ndarray, near: list, counts: np.ndarray, side: np.ndarray | None, own: tuple[np.ndarray, np.ndarray], threshold: float, beam: int, slack: float) -> tuple[np.ndarray, ...]:
    """For each node of a part: links (copies counted), linked nodes, and the least place joined.

    side: only links between different sides count, if given. Lists that lead out of the part are cut
    off, so ``own`` edges are added where a part isn't whole.
    """
    at = {n: i for i, n in enumerate(nodes.tolist())}
    lists = [[at[n] for n in ids if n in at] for ids in near]
    for a, b in zip(*(e.tolist() for e in own)):
        lists[a].append(b)
    graph = [np.unique(np.array(ids, np.int64)) for ids in lists]
    links, others = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    ends: list[np.ndarray] = []
    for lo in range(0, len(x), 512):
        queries = x[lo : lo + 512]
        first = search(x, graph, queries, beam)
        first = np.hstack([np.arange(lo, lo + len(queries))[:, None], first])
        for q, hits in expanded(x, graph, first, queries, threshold, slack):
            hits = np.unique(hits)
            hits = hits[hits != lo + q]
            if side is not None:
                hits = hits[side[hits] != side[lo + q]]
            links[lo + q], others[lo + q] = counts[hits].sum(), len(hits)
            ends.append(np.column_stack([np.full(len(hits), lo + q), hits]))
    pairs = np.concatenate(ends) if ends else np.zeros((0, 2), np.int64)
    return links, others, _roots(len(x), pairs[:, 0], pairs[:, 1])


FOUND = "node long, links long, others long, least long"


def _search_parts(threshold: float, beam: int, slack: float, sided: bool):
    """Searches the parts (column ``part``) of a table that a task holds; several small ones come together."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.sort_values(["part", "node"]).groupby("part"):
            nodes, x = part["node"].to_numpy(), _matrix(part["unit"].tolist())
            side = part["side"].to_numpy() if sided and part["side"].nunique() > 1 else None
            none = np.zeros(0, np.int64)
            own = both_ways(pruned(x, DEGREE, ALPHA)) if sided else (none, none)
            links, others, least = linked(nodes, x, part["near"].tolist(), part["count"].to_numpy(), side, own, threshold, beam, slack)
            out.append(pd.DataFrame({"node": nodes, "links": links, "others": others, "least": nodes[least]}))
        return pd.concat(out)

    return run


def _measure(rows: pd.DataFrame) -> pd.DataFrame:
    """Centre and radius (an angle) of a cell."""
    x = _matrix(rows["unit"].tolist())
    mean = x.sum(axis=0)
    norm = np.linalg.norm(mean)
    centre = mean / norm if norm > 0 else x[0]
    # Chords are exact where angles are small.
    radius = float(2 * np.arcsin(np.clip(np.linalg.norm(x - centre, axis=1).max() / 2, 0, 1)))
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "cell": [rows["cell"].iloc[0]], "centre": [centre.tolist()], "radius": [radius], "n": [len(x)], "weight": [int(rows["count"].sum())], "first": [int(rows["node"].min())]})


def dense_links(dense: DataFrame, threshold: float) -> DataFrame:
    """Links of the nodes of parts that are too large for one task: part, cell, node, unit, near, count."""
    cells = dense.select("part", "cell", "node", "unit", "count").groupBy("part", "cell")
    cells = stored(cells.applyInPandas(_measure, "part long, cell string, centre array<double>, radius double, n long, weight long, first long"), "flatgraph-cells")
    a, b = (cells.select("part", *(F.col(c).alias(f"{c}_{s}") for c in cells.columns[1:])) for s in "ab")
    # Half the chord is the sine of half the angle.
    chord = F.sqrt(F.aggregate(F.zip_with("centre_a", "centre_b", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))
    angle = F.when(F.col("cell_a") == F.col("cell_b"), 0.0).otherwise(2 * F.asin(F.least(F.lit(1.0), chord / 2)))
    both = a.join(b, "part").withColumn("angle", angle).withColumn("reach", F.col("radius_a") + F.col("radius_b"))
    limit = math.acos(threshold)
    both = both.where(F.col("angle") - F.col("reach") <= limit + TOLERANCE).withColumn("whole", F.col("angle") + F.col("reach") <= limit - TOLERANCE)
    both = stored(both.drop("centre_a", "centre_b"), "flatgraph-cell-pairs")
    # Two cells that hold only links: counted without a look at their nodes, and every node of one joins the other's first.
    own = F.when(F.col("cell_a") == F.col("cell_b"), 1).otherwise(0)
    whole = both.where("whole").groupBy("part", F.col("cell_a").alias("cell")).agg(
        F.sum("weight_b").alias("weight"), F.sum("n_b").alias("n"), F.max(own).alias("itself"), F.min("first_b").alias("join"), F.collect_set("first_b").alias("firsts")
    )
    nodes = dense.join(stored(whole, "flatgraph-whole"), ["part", "cell"])
    links = nodes.select("node", (F.col("weight") - F.col("itself") * F.col("count")).alias("links"), (F.col("n") - F.col("itself")).alias("others"), F.col("join").alias("least"))
    reached = nodes.groupBy("part", "cell").agg(F.min("node").alias("node"), F.first("firsts").alias("firsts"))
    joins = reached.select("node", F.lit(0).cast("long").alias("links"), F.lit(0).cast("long").alias("others"), F.explode("firsts").alias("least"))
    some = both.where("not whole and cell_a <= cell_b").select("part", "cell_a", "cell_b", F.xxhash64("part", "cell_a", "cell_b").alias("pair"))
    sides = F.array(F.struct(F.col("cell_a").alias("cell"), F.lit(0).alias("side")), F.struct(F.col("cell_b").alias("cell"), F.lit(1).alias("side")))
    sides = F.when(F.col("cell_a") == F.col("cell_b"), F.slice(sides, 1, 1)).otherwise(sides)
    some = some.select("part", "cell_a", "cell_b", F.inline(sides))
    dealt = dense.join(some, ["part", "cell"]).withColumn("owner", F.col("part"))
    looked = dealt.groupBy("owner", "cell_a", "cell_b").applyInPandas(_search_parts(threshold, BEAM, SLACK, True), FOUND)
    return links.unionByName(joins).unionByName(looked)


def linked_nodes(nodes: DataFrame, threshold: float, overlap: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(node, links, others, component) of the nodes with links, and (node) of those with near neighbours."""
    border = 2 * math.acos(threshold)
    members = stored(shards(nodes, overlap, size, border), "flatgraph-members")
    lists = members.select("shard", "node", "unit").groupBy("shard").applyInPandas(_neighbours(DEGREE, ALPHA, threshold - SLACK), "node long, near array<long>, least long")
    lists = stored(lists, "flatgraph-lists")
    union = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # overlap lists at most
    parts = components(lists.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    parts = stored(parts.withColumnRenamed("component", "part"), "flatgraph-parts")
    sizes = stored(parts.groupBy("part").agg(F.count("*").alias("part_size")), "flatgraph-sizes")
    home = members.where("home").select("node", F.col("shard").alias("cell"))
    about = nodes.select("node", "unit", "count").join(parts, "node").join(union, "node").join(home, "node").join(sizes, "part")
    about = stored(about, "flatgraph-graph")
    small = about.where(F.col("part_size") <= size)
    bins = 1 + small.count() // BIN
    bin_ = F.pmod(F.xxhash64("part"), F.lit(bins)).alias("bin")
    found = small.select(bin_, "part", "node", "unit", "near", "count").groupBy("bin").applyInPandas(_search_parts(threshold, BEAM, SLACK, False), FOUND)
    found = stored(found.withColumnRenamed("least", "component"), "flatgraph-found")
    dense = stored(dense_links(about.where(F.col("part_size") > size), threshold), "flatgraph-dense")
    joined = components(dense.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    totals = dense.groupBy("node").agg(F.sum("links").alias("links"), F.sum("others").alias("others"))
    totals = totals.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return found.unionByName(totals), parts.select("node")


def brute_links(nodes: DataFrame, queries: list[tuple[int, str, bytes]], threshold: float) -> dict[int, int]:
    """True numbers of different nodes linked to some nodes, against all in blocks. queries: node, label, unit."""
    by_label: dict[tuple[str, int], tuple[list[int], np.ndarray]] = {}
    for label, unit_size in {(label, len(unit)) for _, label, unit in queries}:
        own = [(n, u) for n, la, u in queries if la == label and len(u) == unit_size]
        by_label[label, unit_size] = ([n for n, _ in own], _matrix([u for _, u in own]))

    def run(batches):
        for batch in batches:
            labels, units = batch.column("label").to_pylist(), batch.column("unit").to_pylist()
            totals: dict[int, int] = {}
            place = pd.DataFrame({"label": labels, "size": [len(u) for u in units]}).groupby(["label", "size"]).indices
            for key, at in place.items():
                if key in by_label:
                    names, q = by_label[key]
                    for name, n in zip(names, ((_matrix([units[i] for i in at]) @ q.T) >= threshold).sum(axis=0).tolist()):
                        totals[name] = totals.get(name, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.int64()), pa.array(totals.values(), pa.int64())], names=["node", "n"])

    found = nodes.select("label", "unit").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    return {r["node"]: r["n"] - 1 for r in found.collect()}  # at most AUDIT rows; a vector isn't its own link


def audited_recall(nodes: DataFrame, near: DataFrame, found: DataFrame, threshold: float) -> float:
    """Share of the true links between different nodes that were found, over the audited nodes; 1 if they have none."""
    some = F.xxhash64("key", F.lit(1))
    random = nodes.orderBy(some).limit(AUDIT // 2)
    close = nodes.join(near, "node", "left_semi").orderBy(some).limit(AUDIT // 2)
    rows = random.select("node", "label", "unit").unionByName(close.select("node", "label", "unit")).dropDuplicates(["node"]).collect()
    truth = brute_links(nodes, [(r["node"], r["label"], bytes(r["unit"])) for r in rows], threshold) if rows else {}
    wanted = sum(truth.values())
    if not wanted:
        return 1.0
    seen = found.where(F.col("node").isin(list(truth))).select("node", "others").collect()
    return sum(r["others"] for r in seen) / wanted


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    size: int = SHARD,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Per vector row: vec_id, n_links, component_id, kept."""
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = stored(source.mapInArrow(_prepare, "vec_id long, label string, key binary, unit binary"), "flatgraph-rows")
    nodes = rows.where("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("unit").alias("unit"), F.count("*").alias("count"), F.min("vec_id").alias("least_id"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "flatgraph-nodes")
    while True:
        found, near = linked_nodes(nodes, threshold, overlap, size)
        found = stored(found, "flatgraph-result")
        recall = audited_recall(nodes, near, found, threshold)
        if recall >= RECALL:
            break
        if overlap >= MOST_OVERLAP:
            if recall >= LEAST_RECALL:
                break
            raise RuntimeError(f"recall {recall:.3f} of the audit is below {LEAST_RECALL}")
        overlap *= 2
    placed = nodes.select("key", "node", "count", "least_id").join(found, "node", "left")
    placed = placed.select("key", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links"), "least_id")
    placed = stored(placed, "flatgraph-placed")
    ids = stored(placed.groupBy("component").agg(F.min("least_id").alias("component_id")), "flatgraph-components")
    placed = stored(placed.join(ids, "component").select("key", "n_links", "component_id"), "flatgraph-ids")
    own = F.coalesce(F.col("component_id"), F.col("vec_id"))
    return rows.select("vec_id", "key").join(placed, "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"),
    )
