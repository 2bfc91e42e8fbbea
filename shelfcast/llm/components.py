"""Connected components by alternating large-star and small-star steps on written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import stored

MAX_ROUNDS = 60


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Every neighbour (large: the greater ones; small: the lesser ones) linked to the least of the neighbourhood."""
    both = edges.where("a <> b")
    if small:
        hood = both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        hood = both.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(both.select("b", "a"))
    # The least neighbour comes from a table of its own, so that a node with many edges can be split in the join.
    least = stored(hood.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars-least")
    linked = hood.join(least, "u")
    if small:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u"), "m"))
    else:
        out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return stored(out.where("a <> b").distinct(), "stars-edges")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b")), F.sum(F.hash("b", "a", F.lit(1)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component: the least node reachable.

    Edges are long pairs without nulls; loops and repeated edges don't matter. Each round halves
    what is left of long chains; rounds end when the edges no longer change.
    """
    given = stored(edges.select("a", "b").distinct(), "components-given")
    loops = given.where("a = b").select(F.col("a").alias("node"))
    edges = given.where("a <> b")
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        edges = _stars(_stars(edges, small=False), small=True)
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = members.unionAll(roots)
    alone = loops.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionAll(alone)
