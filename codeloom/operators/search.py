"""Ranked symbol search and point lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import ascii_lower
from codeloom.model import files_now, rows_now

#: Default and greatest number of rows of an interactive search.
DEFAULT_LIMIT, MAX_LIMIT = 25, 500


def search_symbols(symbols: DataFrame, files: DataFrame, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Symbols whose name or qualified name contains ``query``, best first.

    Rank 0 is an exact match (case-sensitive), 1 a prefix and 2 any match (A-Z folded); then the
    shorter qualified name, the name itself and the id decide. An empty query finds nothing; a
    negative limit is none. The top rows are taken per partition before they meet.
    """
    q = F.lit(query)
    folded = ascii_lower(q)
    names = [F.col("name"), F.col("qualified_name")]
    low = [ascii_lower(n) for n in names]
    exact, prefix, hit = F.lit(False), F.lit(False), F.lit(False)
    for n, l in zip(names, low):
        exact |= F.coalesce(n == q, F.lit(False))
        prefix |= F.coalesce(l.startswith(folded), F.lit(False))
        hit |= F.coalesce(l.contains(folded), F.lit(False))
    found = rows_now(symbols.where(hit if query else F.lit(False))).withColumn("rank", F.when(exact, 0).when(prefix, 1).otherwise(2))
    found = found.join(files_now(files).select(F.col("id").alias("file_id"), "path"), "file_id")
    found = found.select("id", "name", "qualified_name", "kind", "path", "start_line", "rank").orderBy("rank", F.length("qualified_name"), "qualified_name", "id")
    return found if limit < 0 else found.limit(min(limit, MAX_LIMIT))


def find_symbol(symbols: DataFrame, symbol_id: int) -> DataFrame:
    return rows_now(symbols.where(F.col("id") == symbol_id))


def symbols_in_files(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """The symbols of every file in file order: path, ordinal, id, name, kind."""
    from pyspark.sql import Window

    order = Window.partitionBy("file_id").orderBy("start_line", "start_col", "id")
    rows = rows_now(symbols).withColumn("ordinal", F.row_number().over(order))
    return rows.join(files_now(files).select(F.col("id").alias("file_id"), "path"), "file_id").select("path", "ordinal", "id", "name", "kind")


def references_to(refs: DataFrame, symbol_id: int) -> DataFrame:
    """All references to a symbol in the order of their ids."""
    return rows_now(refs.where(F.col("to_symbol_id") == symbol_id)).orderBy("id")


def references_from(refs: DataFrame, symbol_id: int) -> DataFrame:
    return rows_now(refs.where(F.col("from_symbol_id") == symbol_id)).orderBy("id")
