"""Walks and levels of deep graphs in few rounds: contraction of single-source nodes by pointer jumping (LIN08-13, LIN15, LIN19).

A node with one source is reached if and only if its source is, and its distance or level is the source's and the edge's
weight. So such nodes point to their source; pointers are followed by doubling (a chain of n takes log n joins), the nodes
leave the graph, and their edges start at the root that they point to. Parallel edges that this makes become one, the
lightest or, for levels, the heaviest, whereby more nodes have one source. For levels an edge is left out beforehand if
a path over a node of one target is as heavy, as in runs that all read what the run before read too.

Phases go on while each takes away an eighth of the edges or more; what is left is walked round by round, and contracted
nodes get their values back in reverse order, one join for each phase. Nodes whose pointers lead into a circle aren't
contracted. Each join is on a node's id, and no step multiplies sources by targets, so hot nodes cost their edges.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoint import stored as cut

log = logging.getLogger(__name__)
#: A phase that takes away less than this share of the edges is the last.
WORTHWHILE = 1 / 8


def _pointers(edges: DataFrame, fixed: DataFrame | None) -> DataFrame | None:
    """(id, root, off) of the nodes with one source that lead to a node without that, None if there are none; fixed (id) are never among them."""
    one = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("root"), F.min("w").alias("off")).where("n = 1").drop("n")
    pointers = cut(one if fixed is None else one.join(fixed, "id", "left_anti"))
    size = pointers.count()
    if not size:
        return None
    for jump in range(math.ceil(math.log2(size)) + 2):
        onward = pointers.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("off").alias("more"))
        rows = pointers.join(onward, "root", "left")
        pointers = cut(rows.select("id", F.coalesce("next", "root").alias("root"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"), F.col("next").isNotNull().alias("open")))
        if pointers.where("open").isEmpty():
            break
    log.info("%d nodes of one source, roots after %d jumps", size, jump + 1)
    return pointers.where("not open").drop("open")


def _without_detours(edges: DataFrame) -> DataFrame:
    """edges without those that a path over a node of one target outweighs or equals."""
    one = edges.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("n"), F.min("dst").alias("end"), F.min("w").alias("more")).where("n = 1 and dst != end")
    over = edges.where("src != dst").join(one, "dst").select("src", F.col("end").alias("dst"), (F.col("w") + F.col("more")).alias("over"))
    over = over.groupBy("src", "dst").agg(F.max("over").alias("over"))
    return edges.join(over, ["src", "dst"], "left").where("src = dst or over is null or over < w").drop("over")


def contract(edges: DataFrame, fixed: DataFrame | None, longest: bool) -> tuple[DataFrame, list[DataFrame]]:
    """edges (src, dst, w) of the nodes that stay, and the pointers (id, root, off) of each phase; fixed nodes (id) stay."""
    weight = F.max("w") if longest else F.min("w")
    edges = cut(edges.groupBy("src", "dst").agg(weight.alias("w")))
    phases, left = [], edges.count()
    while left:
        if longest:
            edges = cut(_without_detours(edges))
        pointers = _pointers(edges, fixed)
        if pointers is None:
            break
        phases.append(pointers)
        rows = edges.join(pointers.select(F.col("id").alias("dst")), "dst", "left_anti").join(pointers.select(F.col("id").alias("src"), "root", "off"), "src", "left")
        rows = rows.select(F.coalesce("root", "src").alias("src"), "dst", (F.col("w") + F.coalesce("off", F.lit(0))).alias("w"))
        edges = cut((rows if longest else rows.where("src != dst")).groupBy("src", "dst").agg(weight.alias("w")))
        before, left = left, edges.count()
        log.info("phase %d: %d of %d edges stay", len(phases), left, before)
        if left > before * (1 - WORTHWHILE):
            break
    return edges, phases


def expand(values: DataFrame, phases: list[DataFrame], value: str) -> DataFrame:
    """values (id, value) of the nodes that stayed, and of those contracted."""
    for pointers in reversed(phases):
        below = pointers.join(values.select(F.col("id").alias("root"), F.col(value).alias("base")), "root").select("id", (F.col("base") + F.col("off")).cast("int").alias(value))
        values = cut(values.unionByName(below))
    return values


def distances(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id, hops) of all that edges (src, dst, w) lead to from start (id), itself with 0: the least sum of weights."""
    start = cut(start.select("id").distinct())
    fixed = start.select(F.col("id").alias("dst"))
    edges, phases = contract(edges.where("src != dst").join(fixed, "dst", "left_anti"), start, longest=False)
    best = cut(start.withColumn("hops", F.lit(0)))
    frontier, rounds = best, 0
    while True:
        met = edges.join(frontier.select(F.col("id").alias("src"), "hops"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("hops") + F.col("w")).cast("int").alias("hops"))
        frontier = cut(met.join(best.withColumnRenamed("hops", "known"), "id", "left").where("known is null or hops < known").select("id", "hops"))
        if frontier.isEmpty():
            break
        rounds += 1
        best = cut(best.join(frontier.withColumnRenamed("hops", "less"), "id", "full").select("id", F.least("hops", "less").alias("hops")))
    log.info("%d rounds over what stayed", rounds)
    return expand(best, phases, "hops")


def longest_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): the heaviest path to each node (id) along edges (src, dst, w) between nodes; none on circles and below."""
    edges, phases = contract(edges, None, longest=True)
    gone = None
    for p in phases:
        gone = p.select("id") if gone is None else gone.unionByName(p.select("id"))
    waiting = nodes.select("id").distinct()
    waiting = waiting if gone is None else waiting.join(gone, "id", "left_anti")
    waiting = cut(waiting.join(edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("open")), "id", "left").select("id", F.coalesce("open", F.lit(0)).alias("open"), F.lit(0).alias("level")))
    done, rounds = None, 0
    while not (ready := waiting.where("open = 0").select("id", "level")).isEmpty():
        done = ready if done is None else done.unionByName(ready)
        filled = edges.join(ready.select(F.col("id").alias("src"), "level"), "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("filled"), F.max(F.col("level") + F.col("w")).cast("int").alias("reach"))
        rows = waiting.where("open > 0").join(filled, "id", "left")
        waiting = cut(rows.select("id", (F.col("open") - F.coalesce("filled", F.lit(0))).alias("open"), F.greatest("level", F.coalesce("reach", F.lit(0))).alias("level")))
        rounds += 1
    log.info("%d rounds over what stayed", rounds)
    return nodes.select("id").limit(0).withColumn("level", F.lit(0)) if done is None else expand(done, phases, "level")
