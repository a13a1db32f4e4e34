"""Which source files are valid text of the language their path claims.

Every text is parsed by the generalised LL recogniser, all dialects of its language together; a
file that every dialect rejects is invalid. Stored parser warnings are not consulted: they may be
stale and say more than syntax. Rates are grouped by repository and language.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.handwritten import language_of
from codeloom.syntax.grammars import is_valid


def spread_texts(sources: DataFrame) -> DataFrame:
    """The source files of ``sources`` with a non-null text: file_id, path, language, content, and a
    hash of the text.

    Parsing costs far more than moving a text once, and a split may hold very many texts, so rows
    are spread by one shuffle. Adaptive execution sizes its partitions by their bytes, merging
    small and splitting large ones, so a task holds a bounded amount of text at any size. Copies of a
    text come together.
    """
    src = sources.select("file_id", "path", language_of(F.col("path")).alias("language"), "content", F.xxhash64("content").alias("hash"))
    return src.where(F.col("language").isNotNull() & F.col("content").isNotNull()).hint("rebalance", "hash")


@contextmanager
def no_cycles() -> Iterator[None]:
    """Parsing makes very many small objects and hardly any cycles, which is what the collector looks for."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def syntax_flags(sources: DataFrame) -> DataFrame:
    """(file_id, path, repo, language, is_valid): one row per source file with a non-null text.

    An empty or blank text is valid. Files that are no source files by their extension, and rows
    with a null path or text, give no row; repeated rows give a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with no_cycles():
                ok = [is_valid(p, t) for p, t in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ok, pa.bool_())], ["file_id", "path", "language", "is_valid"])

    flags = spread_texts(sources).mapInArrow(run, "file_id long, path string, language string, is_valid boolean")
    return flags.select("file_id", "path", F.split("path", "/")[0].alias("repo"), "language", "is_valid")


def syntax_rates(flags: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_invalid, invalid_rate) over ``syntax_flags``."""
    stats = flags.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n_files"), F.count(F.when(~F.col("is_valid"), 1)).alias("n_invalid"))
    return stats.withColumn("invalid_rate", F.col("n_invalid") / F.col("n_files"))
