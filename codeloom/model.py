"""Enum ranks and the current view of tables that keep older or repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the data model, in rank order.
CONFIDENCES = ("high", "medium", "low")
RISKS = ("low", "medium", "high", "critical")
TEST_REASONS = ("directory_convention", "naming_convention", "direct_import")
INHERITANCE = ("extends", "implements")
LANGUAGES = {
    "rs": "rust", "ts": "type_script", "mts": "type_script", "cts": "type_script", "tsx": "tsx",
    "js": "java_script", "mjs": "java_script", "cjs": "java_script", "jsx": "java_script", "py": "python", "pyi": "python", "go": "go",
}


def rank_of(values: tuple[str, ...], col: str | Column) -> Column:
    """The position of a text in ``values``, null for others."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(*[F.when(c == v, F.lit(i)) for i, v in enumerate(values)])


def text_of(values: tuple[str, ...], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), rank + 1)


def files_now(files: DataFrame) -> DataFrame:
    """One row per file id: the one indexed last (of equal times, the greatest hash)."""
    last = Window.partitionBy("id").orderBy(F.desc("indexed_at"), F.desc_nulls_last("content_hash"))
    return files.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def rows_now(table: DataFrame) -> DataFrame:
    """Rows that are stored more than once, once; the copies of an id are equal."""
    return table.dropDuplicates(["id"])


def commits_now(commits: DataFrame) -> DataFrame:
    return commits.dropDuplicates(["sha"])
