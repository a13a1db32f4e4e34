"""Pairs of items that meet in the same basket, by a blocked Gram matrix.

A basket is a row of a binary matrix X over the items of its space (here: the commits of a
repository over its files); X^T X holds how often each pair meets. Items and baskets go by number:
a 64-bit hash, whose seed is changed should two texts ever share a number. The items of a space are
cut into blocks of bounded size along the power of two their basket count lies in (the band):
neighbouring bands that are small share a block, a large band is split by hash. A space of few
items is a single block, and its cells are moved once.

For a pair of blocks the cells of both, for the baskets of one record block, meet in a task, which
sums the products of the sparse rows into one dense tile in numpy; Spark adds the tiles of all
record blocks. With a least Jaccard similarity of 1/2, blocks more than one band apart cannot hold
a wanted pair (max support > 2 * min support) and never meet; items below the least count are left
out the same way. Both prunings are exact.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import cut

#: A block holds at most about twice so many items.
ITEM_BLOCK = 1024
#: Cells (basket, item) of a pair of blocks that one task is given, about.
RECORD_BLOCK = 1_000_000
#: Products that are summed into the tile at a time.
PRODUCTS = 4_000_000

_SCHEMA = "sid long, block_a long, block_b long, i int, j int, n long"


def _ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of range(s, s + n) over the two arrays."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens, lens) + np.repeat(starts, lens)


def _tile(left: np.ndarray, first: np.ndarray, lens: np.ndarray, right: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The summed products of sparse rows: cell k of the left side meets ``lens[k]`` cells of the
    right side from ``first[k]`` on."""
    total = np.zeros(shape[0] * shape[1], np.int64)
    done = np.cumsum(lens)
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PRODUCTS, "right")))
        code = np.repeat(left[at:to].astype(np.int64) * shape[1], lens[at:to]) + right[_ragged(first[at:to], lens[at:to])]
        if len(code):
            total += np.bincount(code, minlength=len(total))
        at = to
    return total.reshape(shape)


def _gram(keys: tuple, pdf: pd.DataFrame, least_count: int, half_jaccard: bool) -> pd.DataFrame:
    """The summed products of one pair of blocks over one record block."""
    sid, block_a, block_b, _ = keys
    basket, loc, side = pdf["b"].to_numpy(), pdf["loc"].to_numpy(), pdf["side"].to_numpy()
    order = np.lexsort((loc, basket))
    basket, loc, side = basket[order], loc[order], side[order]
    if block_a == block_b:
        n = int(loc.max()) + 1
        end = np.searchsorted(basket, basket, "right")
        own = np.arange(len(loc))
        tile = _tile(loc, own + 1, end - own - 1, loc, (n, n))  # the upper triangle
        if int(pdf["parts"].iloc[0]) == 1:  # all baskets are here, so the counts are final
            keep = tile >= max(1, least_count)
            if half_jaccard:
                support = np.bincount(loc, minlength=n)
                keep &= 3 * tile >= support[:, None] + support[None, :]
            i, j = np.nonzero(keep)
        else:
            i, j = np.nonzero(tile)
    else:
        is_a = side == 0
        basket_b, right = basket[~is_a], loc[~is_a]
        first, last = (np.searchsorted(basket_b, basket[is_a], s) for s in ("left", "right"))
        if not len(right) or not is_a.any():
            return pd.DataFrame({c: [] for c in ("sid", "block_a", "block_b", "i", "j", "n")})
        tile = _tile(loc[is_a], first, last - first, right, (int(loc[is_a].max()) + 1, int(right.max()) + 1))
        i, j = np.nonzero(tile)
    return pd.DataFrame({"sid": sid, "block_a": block_a, "block_b": block_b, "i": i.astype(np.int32), "j": j.astype(np.int32), "n": tile[i, j]})


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells (b, i), items (i, sid, space, item, sup), spaces (sid, n_baskets)) with numbers for texts.

    Two texts with one number show as two names of an item, or as two second hashes of a basket or
    a space; then all is numbered anew with another seed.
    """
    for seed in count():
        number = lambda *c, n=2 * seed: F.xxhash64(F.lit(n), *c)
        keyed = rows.select("space", "item", number("space", "basket").alias("b"), number("space", "item").alias("i"))
        cells = cut(keyed.select("b", "i").distinct())
        items = cut(keyed.select("i", "space", "item").distinct().join(cells.groupBy("i").agg(F.count(F.lit(1)).alias("sup")), "i").withColumn("sid", number("space")))
        numbers = rows.select(number("space").alias("sid"), number("space", n=2 * seed + 1).alias("s2"), number("space", "basket").alias("b"), number("space", "basket", n=2 * seed + 1).alias("b2"))
        baskets = numbers.groupBy("b").agg(*[f(c).alias(f"{c}_{x}") for c in ("b2", "sid", "s2") for f, x in ((F.min, "lo"), (F.max, "hi"))])
        spaces = cut(
            baskets.groupBy(F.col("sid_lo").alias("sid")).agg(
                F.count(F.lit(1)).alias("n_baskets"), F.max(F.col("b2_lo") != F.col("b2_hi")).alias("clash"), F.min("s2_lo").alias("lo"), F.max("s2_hi").alias("hi"),
            )
        )
        twice = items.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(1))
        if spaces.where(F.col("clash") | (F.col("lo") != F.col("hi"))).select(F.lit(1)).unionByName(twice).isEmpty():
            return cells, items, spaces.select("sid", "n_baskets")
    raise AssertionError


def _blocks(items: DataFrame, half_jaccard: bool, item_block: int) -> DataFrame:
    """Adds block, low, high (bands of the block) and loc (place in the block) to items."""
    items = items.withColumn("band", F.floor(F.log2("sup")).cast("int") if half_jaccard else F.lit(0))
    bands = items.groupBy("sid", "band").agg(F.count(F.lit(1)).alias("size"))
    below = Window.partitionBy("sid").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)  # a space has few bands
    large = F.col("size") > item_block
    bands = bands.withColumn("group", F.when(large, -1 - F.col("band")).otherwise(F.floor(F.coalesce(F.sum(F.when(~large, F.col("size"))).over(below), F.lit(0)) / item_block)))
    group = Window.partitionBy("sid", "group")
    bands = bands.select("sid", "band", F.min("band").over(group).alias("low"), F.max("band").over(group).alias("high"), F.ceil(F.col("size") / item_block).alias("subs"), large.alias("large"))
    placed = items.join(bands, ["sid", "band"])
    sub = F.when(F.col("large"), F.pmod("i", F.col("subs"))).otherwise(F.lit(0))
    placed = placed.withColumn("block", F.col("low").cast("long") * F.lit(1 << 40) + sub)
    return placed.withColumn("loc", F.row_number().over(Window.partitionBy("sid", "block").orderBy("i")) - 1)


def co_occurrence(baskets: DataFrame, least_count: int = 1, half_jaccard: bool = False, item_block: int = ITEM_BLOCK, record_block: int = RECORD_BLOCK) -> DataFrame:
    """One row per pair of items of one space that meet in at least ``least_count`` baskets.

    ``baskets``: space, basket, item (strings); repeated rows count once, rows with a null are
    left out. Result: space, item_a < item_b, n_a, n_b (baskets with each), n_both, n_baskets
    (of the space), total_either, ratio (n_both / total_either, float), lift (n_both against
    what independent items would give). ``half_jaccard`` keeps only pairs with ratio >= 1/2 and
    prunes by it. An empty table gives no rows.
    """
    cells, items, spaces = _numbered(baskets.select("space", "basket", "item").dropna())
    items = cut(_blocks(items.where(F.col("sup") >= least_count), half_jaccard, item_block))
    blocks = items.groupBy("sid", "block", "low", "high").agg(F.sum("sup").alias("cells"))
    one, two = (blocks.select("sid", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "low", "high", "cells")]) for x in "ab")
    near = F.col("block_a") <= F.col("block_b")
    if half_jaccard:  # bands that overlap or are next to each other
        near &= (F.col("low_b") - F.col("high_a") <= 1) & (F.col("low_a") - F.col("high_b") <= 1)
    parts = F.greatest(F.lit(1), F.ceil((F.col("cells_a") + F.col("cells_b")) / (2 * record_block))).cast("int")
    met = one.join(two, "sid").where(near).select("sid", "block_a", "block_b", parts.alias("parts"))
    sides = F.when(F.col("block_a") == F.col("block_b"), F.array(F.struct(F.col("block_a").alias("block"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("block_a").alias("block"), F.lit(0).alias("side")), F.struct(F.col("block_b").alias("block"), F.lit(1).alias("side")))
    )
    met = met.select("*", F.explode(sides).alias("s")).select("sid", "s.block", "s.side", "block_a", "block_b", "parts")
    placed = cells.join(items.select("i", "sid", "block", "loc"), "i").join(met, ["sid", "block"])
    products = (
        placed.select("sid", "block_a", "block_b", F.pmod("b", "parts").cast("int").alias("part"), "b", "loc", "side", "parts")
        .groupBy("sid", "block_a", "block_b", "part")
        .applyInPandas(lambda k, p: _gram(k, p, least_count, half_jaccard), _SCHEMA)
    )
    pairs = products.groupBy("sid", "block_a", "block_b", "i", "j").agg(F.sum("n").alias("n_both")).where(F.col("n_both") >= least_count)
    for x, place in (("a", "i"), ("b", "j")):
        named = items.select("sid", F.col("block").alias(f"block_{x}"), F.col("loc").alias(place), *([F.col("space")] if x == "a" else []), F.col("item").alias(f"item_{x}"), F.col("sup").alias(f"n_{x}"))
        pairs = pairs.join(named, ["sid", f"block_{x}", place])
    either = F.col("n_a") + F.col("n_b") - F.col("n_both")
    if half_jaccard:
        pairs = pairs.where(2 * F.col("n_both") >= either)
    ordered = F.col("item_a") < F.col("item_b")
    first, last = (F.struct("item_a", "n_a"), F.struct(F.col("item_b").alias("item_a"), F.col("n_b").alias("n_a")))
    pairs = pairs.withColumns({"x": F.when(ordered, first).otherwise(last), "y": F.when(ordered, last).otherwise(first), "total_either": either})
    pairs = pairs.join(spaces, "sid").select("space", F.col("x.item_a").alias("item_a"), F.col("y.item_a").alias("item_b"), F.col("x.n_a").alias("n_a"), F.col("y.n_a").alias("n_b"), "n_both", "n_baskets", "total_either")
    return pairs.select(
        "*", (F.col("n_both") / F.col("total_either")).cast("float").alias("ratio"),
        (F.col("n_both") * F.col("n_baskets") / (F.col("n_a").cast("double") * F.col("n_b"))).alias("lift"),
    )


def touched_files(deltas: DataFrame) -> DataFrame:
    """Baskets (space = repository, basket = sha, item = path) of a ``deltas`` table.

    A commit touches ``new_path``, or ``old_path`` where that is null, with forward slashes.
    """
    path = F.translate(F.coalesce("new_path", "old_path"), "\\", "/")
    return deltas.select(F.substring_index(path, "/", 1).alias("space"), F.col("sha").alias("basket"), path.alias("item"))


def coupled_files(deltas: DataFrame) -> DataFrame:
    """(path_a, path_b): files of one repository that meet in 4 commits or more, in half of the
    commits of either, and at least twice as often as chance gives."""
    pairs = co_occurrence(touched_files(deltas), least_count=4, half_jaccard=True)
    often = F.col("n_both") * F.col("n_baskets") >= 2 * F.col("n_a") * F.col("n_b")
    return pairs.where(often).select(F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"))
