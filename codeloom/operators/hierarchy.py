"""Paths, depths, roots and loops of parent-child links by parallel tree contraction.

Every round rakes all leaves and compresses unary chains (a chain node whose hash is smaller
than that of its only child and of its parent is spliced out, so no two neighbours go at once).
The removed links are recorded with their round. A forest is empty after a logarithmic number of
rounds; what never empties is a set of loops, each contracted to one link from a node to itself.
The records are then replayed backwards: every record points to a node that outlived its round,
so one join per round yields root, depth and path of all nodes removed in it.

Joins are keyed by the child, which is unique, so a parent with very many children never meets
in one task there; counting the children combines map-side. The replay joins records to parents,
where a hot parent is the left side of an inner join that adaptive execution splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut

ENDLESS = -1


def links_of(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """Distinct links (child, parent) with one parent each; nulls are no links.

    A child with several parents keeps the smallest one; ``dropped_links`` gives the others.
    """
    return _pairs(edges, child, parent).groupBy("child").agg(F.min("parent").alias("parent"))


def _pairs(edges: DataFrame, child: str, parent: str) -> DataFrame:
    e = edges.select(F.col(child).cast("long").alias("child"), F.col(parent).cast("long").alias("parent"))
    return e.where(F.col("child").isNotNull() & F.col("parent").isNotNull())


def dropped_links(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """The distinct links (child, parent) that ``links_of`` leaves out, since their child has a smaller parent."""
    pairs = _pairs(edges, child, parent).distinct()
    return pairs.join(links_of(edges, child, parent).withColumnRenamed("parent", "kept"), "child").where(F.col("parent") != F.col("kept")).select("child", "parent")


def _contract(links: DataFrame, with_path: bool) -> tuple[list[DataFrame], DataFrame]:
    """(records per round, the loops that remain); each link has its weight and what it skips."""
    via = [F.array().cast("array<bigint>").alias("via")] if with_path else []
    edges = cut(links.select("child", "parent", F.lit(1).cast("long").alias("w"), *via))
    records: list[DataFrame] = []
    while True:
        counts = edges.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("child") == F.col("parent"), 1)).alias("loops")).first()
        if counts["n"] == counts["loops"]:
            return records, edges
        seed = F.lit(len(records))
        kids = edges.groupBy(F.col("parent").alias("child")).agg(F.count(F.lit(1)).alias("kids"), F.max("child").alias("only"))
        known = edges.join(kids, "child", "left")
        h = lambda c: F.xxhash64(F.col(c), seed)
        known = known.withColumn(
            "fate",
            F.when(F.col("kids").isNull(), "raked")
            .when((F.col("kids") == 1) & (h("child") < h("only")) & (h("child") < h("parent")), "spliced")
            .otherwise("kept"),
        )
        # A spliced node hands its parent to its only child.
        gift = known.where(F.col("fate") == "spliced").select(
            F.col("only").alias("child"), F.col("parent").alias("up"), F.col("w").alias("up_w"),
            *([F.concat(F.array("child"), "via").alias("up_via")] if with_path else []),
        )
        out = known.join(gift, "child", "left").select(
            "child",
            F.coalesce("up", "parent").alias("parent"),
            (F.col("w") + F.coalesce("up_w", F.lit(0))).alias("w"),
            *([F.when(F.col("up").isNull(), F.col("via")).otherwise(F.concat("via", "up_via")).alias("via")] if with_path else []),
            "fate",
        )
        out = cut(out)
        edges = out.where(F.col("fate") == "kept").drop("fate")
        records.append(out.where(F.col("fate") != "kept").drop("fate"))


def resolve_hierarchy(links: DataFrame, with_path: bool = False) -> DataFrame:
    """One row per child: symbol_id, root_id, depth, and with ``with_path`` also path and loop.

    depth is the number of links to the root. Where the chain of parents never ends, root_id and
    depth are -1. path leads from the symbol to its root, or to the first node of the loop that
    represents it; loop is the list of the loop's nodes for that node, else null. Expects links
    as given by ``links_of``; an empty table gives no rows.
    """
    records, core = _contract(links, with_path)
    ends = links.select(F.col("parent").alias("node")).distinct().join(links.select(F.col("child").alias("node")), "node", "left_anti")
    extra = [F.array("node").alias("path"), F.lit(None).cast("array<bigint>").alias("loop")] if with_path else []
    roots = ends.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), *extra)
    extra = [F.array("child").alias("path"), F.concat(F.array("child"), "via").alias("loop")] if with_path else []
    loops = core.select(F.col("child").alias("node"), F.lit(ENDLESS).cast("long").alias("root"), F.lit(ENDLESS).cast("long").alias("depth"), *extra)
    done = [cut(roots.unionByName(loops))]
    for record in reversed(records):
        known = reduce(DataFrame.unionByName, done).withColumnRenamed("node", "parent")
        depth = F.when(F.col("depth") == ENDLESS, F.lit(ENDLESS)).otherwise(F.col("depth") + F.col("w")).cast("long").alias("depth")
        extra = [F.concat(F.array("child"), "via", "path").alias("path"), F.lit(None).cast("array<bigint>").alias("loop")] if with_path else []
        done.append(cut(record.join(known, "parent").select(F.col("child").alias("node"), "root", depth, *extra)))
    out = reduce(DataFrame.unionByName, done).join(links.select(F.col("child").alias("node")), "node", "left_semi")
    return out.select(F.col("node").alias("symbol_id"), F.col("root").alias("root_id"), "depth", *(["path", "loop"] if with_path else []))


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) of all pairs, from ``resolve_hierarchy(.., with_path=True)``.

    A path that ends at a loop's representative goes on with the loop's nodes that it has not met,
    so every reachable ancestor appears once, at the fewest links; no symbol is its own ancestor.
    """
    loops = resolved.where(F.col("loop").isNotNull()).select(F.col("symbol_id").alias("last"), F.col("loop").alias("round"))
    endless = resolved.where(F.col("depth") == ENDLESS).select("symbol_id", "path", F.element_at("path", -1).alias("last")).join(loops, "last")
    whole = resolved.where(F.col("depth") != ENDLESS).select("symbol_id", "path").unionByName(
        endless.select("symbol_id", F.concat("path", F.array_except("round", "path")).alias("path"))
    )
    return (
        whole.select("symbol_id", F.posexplode("path").alias("distance", "ancestor_id"))
        .where(F.col("distance") > 0)
        .select("ancestor_id", F.col("symbol_id").alias("descendant_id"), F.col("distance").cast("long").alias("distance"))
    )


def extends_edges(refs: DataFrame, graph_edges: DataFrame) -> DataFrame:
    """(c, p): the ``extends`` links of both tables as they are stored."""
    a = refs.where(F.col("kind") == "extends").select(F.col("from_symbol_id").alias("c"), F.col("to_symbol_id").alias("p"))
    b = graph_edges.where(F.col("ref_kind") == "extends").select(F.col("from_id").alias("c"), F.col("to_id").alias("p"))
    return a.unionAll(b)


def extends_links(refs: DataFrame, graph_edges: DataFrame) -> DataFrame:
    """The ``extends`` links of both tables; equal links count once."""
    return links_of(extends_edges(refs, graph_edges), "c", "p")
