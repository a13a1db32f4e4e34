"""Breadth-first expansion of the reference graph for many roots at once."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.model import INHERITANCE
from codeloom.session import cut

MAX_DEPTH = 6


def edges_of(refs: DataFrame, reverse: bool = False) -> DataFrame:
    """Distinct resolved edges (src, dst): caller to callee, or the other way round."""
    a, b = ("to_symbol_id", "from_symbol_id") if reverse else ("from_symbol_id", "to_symbol_id")
    return refs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("src"), F.col(b).alias("dst")).distinct()


#: Edges of one source that share a task; a source with more is spread over several buckets.
BUCKET_EDGES = 10_000


class Adjacency(NamedTuple):
    """Edges (src, bucket, dst) and, per source, the number of its buckets."""

    edges: DataFrame
    buckets: DataFrame

    def step(self, frontier: DataFrame) -> DataFrame:
        """(root, node): the distinct next nodes of a frontier (root, node).

        A frontier row meets every bucket of its node, so the edges of a hot node are read by as many
        tasks as they need, while all other nodes have one bucket.
        """
        met = frontier.select("root", F.col("node").alias("src")).join(self.buckets, "src")
        met = met.select("root", "src", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
        return met.join(self.edges, ["src", "bucket"]).select("root", F.col("dst").alias("node")).distinct()


def adjacency(edges: DataFrame, bucket_edges: int = BUCKET_EDGES) -> Adjacency:
    """``edges`` (src, dst) written by (src, bucket)."""
    edges = cut(edges)
    buckets = cut(edges.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / bucket_edges).cast("int").alias("buckets")))
    placed = edges.join(buckets, "src").select("src", F.pmod(F.xxhash64("dst"), "buckets").cast("int").alias("bucket"), "dst")
    return Adjacency(cut(placed.repartition("src", "bucket")), buckets)


def expand(edges: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH, bucket_edges: int = BUCKET_EDGES) -> DataFrame:
    """(root, node, depth) of all nodes within ``max_depth`` steps of each root (the root included).

    ``edges``: src, dst; ``roots``: root. Every hop joins the frontier with the edges, drops what
    was reached before and is written to the checkpoint folder; depth is the fewest hops.
    """
    near = adjacency(edges, bucket_edges)
    frontier = cut(roots.select("root").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
    reached = [frontier]
    for depth in range(1, max_depth + 1):
        known = reduce(DataFrame.unionByName, [x.select("root", "node") for x in reached])
        frontier = cut(near.step(frontier).join(known, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        reached.append(frontier)
    return reduce(DataFrame.unionByName, reached)


#: How many times the edges the pairs may be that ``closure`` steps over at once.
JUMP_GROWTH = 32


def closure(edges: DataFrame, roots: DataFrame, growth: int = JUMP_GROWTH) -> DataFrame:
    """(root, node): everything that can be reached from each root, the root itself only over a cycle.

    First the steps are made longer by doubling: ``jumps`` holds the pairs within 2^k edges, and k grows
    while the pairs stay within ``growth`` times the edges (a counted bound, since dense graphs have very
    many pairs). Then the frontier of the roots moves by whole jumps until it finds nothing new.
    """
    jumps = cut(edges.select("src", "dst").distinct())
    n_edges = n = jumps.count()
    while n:
        by = jumps.select("src", F.col("dst").alias("by")).join(jumps.select(F.col("src").alias("by"), "dst"), "by").select("src", "dst")
        wider = cut(jumps.unionByName(by).distinct())
        m = wider.count()
        if m == n or m > growth * n_edges:
            break
        jumps, n = wider, m
    near = adjacency(jumps)
    frontier = cut(near.step(roots.select("root").distinct().select("root", F.col("root").alias("node"))))
    reached = [frontier]
    while True:
        known = reduce(DataFrame.unionByName, reached)
        frontier = cut(near.step(frontier).join(known, ["root", "node"], "left_anti"))
        if frontier.isEmpty():
            return known
        reached = [*reached, frontier] if len(reached) < 8 else [cut(known.unionByName(frontier))]


def truncated(nodes: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, truncated): whether a node at ``max_depth`` has any neighbour, visited or not."""
    last = nodes.where(F.col("depth") == max_depth).join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    roots = nodes.select("root").distinct()
    return roots.join(last.select("root").distinct().withColumn("hit", F.lit(True)), "root", "left").select("root", F.coalesce("hit", F.lit(False)).alias("truncated"))


def graph_edges(nodes: DataFrame, refs: DataFrame, max_depth: int = MAX_DEPTH, reverse: bool = True) -> DataFrame:
    """(root, from_id, to_id, ref_id): every resolved reference of every expanded node, multi-edges kept."""
    at, other = ("to_symbol_id", "from_symbol_id") if reverse else ("from_symbol_id", "to_symbol_id")
    inner = nodes.where(F.col("depth") < max_depth).select("root", F.col("node").alias(at))
    r = refs.where(F.col(at).isNotNull() & F.col(other).isNotNull())
    return inner.join(r, at).select("root", F.col("from_symbol_id").alias("from_id"), F.col("to_symbol_id").alias("to_id"), F.col("id").alias("ref_id"))


def subclasses(refs: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) of everything that inherits from each root over ``extends`` and ``implements``,
    without a depth bound; the root itself is left out."""
    e = edges_of(refs.where(F.col("kind").isin(*INHERITANCE)), reverse=True)
    return closure(e, roots).where(F.col("root") != F.col("node"))


def tiered_layout(nodes: DataFrame) -> DataFrame:
    """Positions of a graph view: 240 per depth to the right, 64 per node of a depth down."""
    row = Window.partitionBy("root", "depth").orderBy("node")
    return nodes.withColumns({"x": F.col("depth") * 240, "y": (F.row_number().over(row) - 1) * 64})
