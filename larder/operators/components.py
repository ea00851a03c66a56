"""Connected components by minimum hooking, pointer jumping and contraction.

Every round hooks each vertex to its smallest neighbour, flattens the resulting trees by doubling, and
contracts the edges, so the graph shrinks by at least half its touched vertices per round whatever its
shape (a path of N vertices takes one round of log N jumps). Neighbour lists are never built: a hub
with a third of all edges only enters a partially combined ``min`` and equi-joins whose other side has
one row per vertex, which adaptive execution splits when skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import Scratch


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` of every vertex of ``edges``; the component is its smallest vertex.

    Direction, repeats and self-loops don't matter; edges with a null end are ignored. A vertex whose
    only edges are self-loops forms a component of its own. No edges give no rows.
    """
    scratch = Scratch(edges.sparkSession)
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    first = scratch.save(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    live = first.where("u <> v")
    maps: list[DataFrame] = []
    held = first
    while not live.isEmpty():
        parent = scratch.save(_flatten(live, scratch))
        maps.append(parent)
        up = lambda name: parent.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
        joined = live.join(up("u"), "u").join(up("v"), "v").select(
            F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v"))
        nxt = scratch.save(joined.where("u <> v").distinct())
        if held is not first:
            scratch.drop(held)
        held = live = nxt
    loops = first.where("u = v").select(F.col("u").alias("node"))
    if not maps:
        return loops.select("node", F.col("node").alias("component"))
    # Roots of a later round are vertices of no earlier one: compose from the last round backwards.
    total = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = total.select(F.col("node").alias("root"), F.col("root").alias("final"))
        stepped = earlier.join(later, "root", "left").select("node", F.coalesce("final", "root").alias("root"))
        total = scratch.save(stepped)
    named = total.select("node", F.col("root").alias("component"))
    alone = loops.join(named, "node", "left_anti").select("node", F.col("node").alias("component"))
    return named.unionByName(alone)


def _flatten(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` after hooking each vertex to its smallest neighbour and doubling to the roots."""
    ends = edges.select(F.col("v").alias("node"), F.col("u").alias("to")).unionByName(
        edges.select(F.col("u").alias("node"), F.col("u").alias("to")))
    parent = scratch.save(ends.groupBy("node").agg(F.min("to").alias("root")))
    while True:
        # Two doublings in one written step.
        first = parent.select(F.col("node").alias("root"), F.col("root").alias("h1"))
        once = parent.join(first, "root").select("node", F.col("root").alias("r0"), F.col("h1").alias("root"))
        second = parent.select(F.col("node").alias("root"), F.col("root").alias("h2"))
        jumped = scratch.save(once.join(second, "root").select("node", F.col("h2").alias("root"), (F.col("h2") != F.col("r0")).alias("moved")))
        scratch.drop(parent)
        parent = jumped
        if jumped.where("moved").isEmpty():
            return parent.select("node", "root")
