"""Per-key aggregation that stays balanced when a few keys hold most rows.

Rows are spread over fixed-size chunks by a hash that does not follow the key, every chunk is
combined where it lies, and the chunk states are merged in rounds of ``fan_in`` until one state
per key is left. In no round does a task receive more than ``fan_in`` states of one key, however
many rows the key has; the number of rounds is the logarithm of the number of chunks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of a reference (fixed values of the data model).
REF_KINDS = ("call", "import", "extends", "implements", "instantiation", "type_usage")
CHUNK_ROWS = 32_768
FAN_IN = 16


def chunk_count(rows: int, chunk_rows: int = CHUNK_ROWS) -> int:
    return max(1, math.ceil(rows / chunk_rows))


def chunk_of(chunks: int, *cols: str) -> Column:
    """A chunk number in [0, chunks) that equal values of ``cols`` share."""
    return F.pmod(F.xxhash64(*cols), F.lit(chunks)).cast("long")


def tree_merge(states: DataFrame, keys: Sequence[str], sums: Sequence[str], chunks: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merge additive states (one row per key and ``chunk``) to one row per key."""
    width = chunks
    while True:
        width = math.ceil(width / fan_in)
        at = F.floor(F.col("chunk") / fan_in).cast("long").alias("chunk")
        states = states.groupBy(*keys, at).agg(*[F.sum(c).alias(c) for c in sums])
        if width <= 1:
            return states.drop("chunk")


def reference_key_stats(refs: DataFrame, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> tuple[DataFrame, int]:
    """(one row per field and key, number of rows in ``refs``).

    Columns: field (``to_name`` or ``to_symbol_id``), key_value (text, null for the null key),
    n_rows, n_ids (distinct non-null ids), n_files (distinct non-null from_file_id), and
    rows_<kind> for each reference kind, rows_other for null and unknown kinds.

    Exact: a row counts as often as it is stored; ids and files count once per key. Null keys
    form one group per field. An empty table gives no rows. Other columns of ``refs`` are ignored.
    """
    total = refs.count()
    chunks = chunk_count(total, chunk_rows)
    kind_cols = [f"rows_{k}" for k in REF_KINDS] + ["rows_other"]
    fields = F.explode(
        F.array(
            F.struct(F.lit("to_name").alias("field"), F.col("to_name").alias("key_value")),
            F.struct(F.lit("to_symbol_id").alias("field"), F.col("to_symbol_id").cast("string").alias("key_value")),
        )
    ).alias("f")
    # Chunks by id: the copies of an id meet in one chunk, so distinct ids add up over chunks.
    by_id = (
        refs.select("id", "to_name", "to_symbol_id", "kind", chunk_of(chunks, "id").alias("chunk"))
        .repartition("chunk")
        .select("chunk", "id", "kind", fields)
        .select("chunk", "id", "kind", "f.field", "f.key_value")
        .groupBy("chunk", "field", "key_value", "id")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[F.count(F.when(F.col("kind") == k, 1)).alias(f"rows_{k}") for k in REF_KINDS],
        )
        .groupBy("chunk", "field", "key_value")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.count("id").alias("n_ids"),
            F.lit(0).cast("long").alias("n_files"),
            *[F.sum(f"rows_{k}").alias(f"rows_{k}") for k in REF_KINDS],
        )
    )
    # Chunks by (key, file): each pair lies in one chunk, so distinct files add up as well.
    by_file = (
        refs.where(F.col("from_file_id").isNotNull())
        .select("from_file_id", fields)
        .select("from_file_id", "f.field", "f.key_value")
        .distinct()
        .withColumn("chunk", chunk_of(chunks, "field", "key_value", "from_file_id"))
        .groupBy("chunk", "field", "key_value")
        .agg(F.count(F.lit(1)).alias("n_files"))
        .select(
            "chunk", "field", "key_value",
            F.lit(0).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("n_ids"), "n_files",
            *[F.lit(0).cast("long").alias(f"rows_{k}") for k in REF_KINDS],
        )
    )
    sums = ["n_rows", "n_ids", "n_files", *kind_cols[:-1]]
    merged = tree_merge(by_id.unionByName(by_file), ["field", "key_value"], sums, chunks, fan_in)
    known = sum((F.col(c) for c in kind_cols[:-1]), F.lit(0))
    return merged.withColumn("rows_other", F.col("n_rows") - known), total


def key_counts(refs: DataFrame, fan_in: int = FAN_IN) -> tuple[DataFrame, int]:
    """(field, key_value, n_rows) of every key, and the number of rows: ``reference_key_stats`` without
    the distinct counts, which need equal ids in one chunk.

    A chunk is an input split, whose size Spark bounds: its rows are combined where they are read, and
    only one state per key and split is moved and merged.
    """
    read = refs.select("to_name", "to_symbol_id", F.spark_partition_id().alias("chunk"))
    total, last = read.agg(F.count(F.lit(1)), F.coalesce(F.max("chunk"), F.lit(0))).first()
    keyed = read.select("chunk", F.explode(F.array(
        F.struct(F.lit("to_name").alias("field"), F.col("to_name").alias("key_value")),
        F.struct(F.lit("to_symbol_id").alias("field"), F.col("to_symbol_id").cast("string").alias("key_value")),
    )).alias("f"))
    states = keyed.select(F.col("chunk").cast("long").alias("chunk"), "f.*").groupBy("field", "key_value", "chunk").agg(F.count(F.lit(1)).alias("n_rows"))
    return tree_merge(states, ["field", "key_value"], ["n_rows"], last + 1, fan_in), total


def hot_keys(refs: DataFrame, share: float = 0.01) -> DataFrame:
    """(field, key_value) of each non-null key that holds at least ``share`` of all rows."""
    counts, total = key_counts(refs)
    least = F.col("n_rows") >= F.lit(share) * F.lit(total)
    return counts.where(F.col("key_value").isNotNull() & least).select("field", "key_value")
