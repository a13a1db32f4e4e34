"""Incremental maintenance of the index as joins between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: New rows that one task numbers, about.
BUCKET_ROWS = 100_000


def deleted_files(stored: DataFrame, walked: DataFrame) -> DataFrame:
    """Stored files whose path was not walked again."""
    return stored.join(walked.select("path").distinct(), "path", "left_anti")


def changed_files(stored: DataFrame, walked: DataFrame) -> DataFrame:
    """Walked files that are new or have another content hash; equal ones need no work."""
    return walked.join(stored.select("path", "content_hash").distinct(), ["path", "content_hash"], "left_anti")


def upsert_files(stored: DataFrame, walked: DataFrame) -> DataFrame:
    """The stored files after a walk: ids stay with their paths, new paths get the next ids.

    Expects one row per path on either side. New ids follow the path order within hash buckets,
    whose number follows the rows, so no single task orders all new files.
    """
    known = walked.join(stored.select("path", F.col("id").alias("old_id")), "path", "left")
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    buckets = max(1, -(-walked.count() // BUCKET_ROWS))
    fresh = known.where(F.col("old_id").isNull()).withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)))
    sizes = fresh.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("bucket", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("bucket").orderBy("path")
    fresh = fresh.join(F.broadcast(before), "bucket").crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("before") + F.row_number().over(order))
    kept = known.where(F.col("old_id").isNotNull()).withColumn("id", F.col("old_id"))
    columns = ["id", *walked.columns]
    return kept.select(*columns).unionByName(fresh.select(*columns))


def match_symbols(existing: DataFrame, parsed: DataFrame) -> DataFrame:
    """Parsed symbols with the id of the stored symbol they continue, null for new ones.

    Symbols of equal file, qualified name and kind are matched one to one: the first parsed one
    (by start_byte) takes the greatest stored id, and so on. ``existing``: id, file_id,
    qualified_name, kind; ``parsed``: the same keys and start_byte.
    """
    keys = ["file_id", "qualified_name", "kind"]
    old = existing.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("id")))).select(*keys, "turn", F.col("id").alias("old_id"))
    new = parsed.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy("start_byte")))
    return new.join(old, [*keys, "turn"], "left").drop("turn")


def vanished_symbols(existing: DataFrame, matched: DataFrame) -> DataFrame:
    """Stored symbols that no parsed symbol continues."""
    return existing.join(matched.select(F.col("old_id").alias("id")).where(F.col("id").isNotNull()), "id", "left_anti")


def set_null_refs(refs: DataFrame, symbols: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """References with the ends that no longer exist set to null; a self-made foreign key."""
    ids = symbols.select("id").distinct()
    ends = ids if shared is None else ids.unionByName(shared.select("id")).distinct()
    r = refs.join(ids.select(F.col("id").alias("from_symbol_id"), F.lit(True).alias("has_from")), "from_symbol_id", "left")
    r = r.join(ends.select(F.col("id").alias("to_symbol_id"), F.lit(True).alias("has_to")), "to_symbol_id", "left")
    return r.withColumns({
        "from_symbol_id": F.when(F.col("has_from"), F.col("from_symbol_id")), "to_symbol_id": F.when(F.col("has_to"), F.col("to_symbol_id")),
    }).select(*refs.columns)


def without_files(table: DataFrame, gone: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows of a child table that survive the deletion of files (the cascade)."""
    return table.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def replace_rows(old: DataFrame, new: DataFrame, key: str = "file_id") -> DataFrame:
    """``old`` with all rows of the keys in ``new`` replaced by it (imports and references of changed files)."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def over_limit(files: DataFrame, max_bytes: int) -> DataFrame:
    """Files too large to parse: they keep a file row and lose symbols, references and imports."""
    return files.where(F.col("size_bytes") > max_bytes)
