"""Queries over parsed texts: symbols, references, imports and the upkeep of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.model import files_now, rows_now
from codeloom.operators import indexer, parsing
from codeloom.operators import snapshot as N
from codeloom.plans import index_queries as Q
from codeloom.plans.index_queries import _files, _refs, _sources, _symbols


def parsed_symbols(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parsed_symbols(parsing.parse_files(_sources(spark, d)))


def parsed_references(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parsed_references(parsing.parse_files(_sources(spark, d)))


def parsed_warnings(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse_files(_sources(spark, d)).select("file_id", F.explode("warnings").alias("warning"))


def parse_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How far the parsed symbols of files with a text agree with the stored ones."""
    texts = _sources(spark, d).where(F.col("content").isNotNull()).select("file_id").distinct()
    return parsing.agreement(parsed_symbols(spark, d), rows_now(_symbols(spark, d)).join(texts, "file_id", "left_semi"))


def _next_walk(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The stored index as each file was first seen, and a walk that finds the present contents."""
    first = _files(spark, d).groupBy("id").agg(F.min_by(F.struct("path", "language", "content_hash", "size_bytes", "indexed_at"), F.struct("indexed_at", "content_hash")).alias("f")).select("id", "f.*")
    texts = _sources(spark, d).select(F.col("file_id").alias("id"), "content").dropDuplicates(["id"])
    walked = files_now(_files(spark, d)).join(texts, "id", "left").select("path", "size_bytes", "content_hash", "content", "indexed_at")
    return {"files": first, "symbols": _symbols(spark, d), "refs": _refs(spark, d)}, walked


def index_summary(spark: SparkSession, d: str) -> DataFrame:
    return indexer.reindex(*_next_walk(spark, d))[1]


def reindexed_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The symbols after the next walk: kept, continued under their ids, and new."""
    tables, _ = indexer.reindex(*_next_walk(spark, d))
    return tables["symbols"].select("id", "file_id", "qualified_name", "kind")


def vanished_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Stored symbols that the present texts do not continue."""
    parsed = N.match_symbols(rows_now(_symbols(spark, d)).select("id", "file_id", "qualified_name", "kind"), parsed_symbols(spark, d))
    return N.vanished_symbols(rows_now(_symbols(spark, d)), parsed).select("id", "file_id", "qualified_name", "kind")


def cascade_deleted(spark: SparkSession, d: str) -> DataFrame:
    """(kind, n): the symbols that are left when all files without a language go."""
    gone = files_now(_files(spark, d)).where("language is null").select("id")
    return N.without_files(rows_now(_symbols(spark, d)), gone).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def replaced_refs(spark: SparkSession, d: str) -> DataFrame:
    """(kind, n): references when those of all files seen twice are replaced by the unresolved ones among them."""
    twice = _files(spark, d).groupBy("id").agg(F.count_distinct("content_hash").alias("n")).where("n > 1").select(F.col("id").alias("from_file_id"))
    r = rows_now(_refs(spark, d))
    new = r.join(twice, "from_file_id", "left_semi").where("to_symbol_id is null").select(*r.columns)
    return N.replace_rows(r, new, "from_file_id").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def over_limit(spark: SparkSession, d: str) -> DataFrame:
    from codeloom.sources.config import Config

    return N.over_limit(files_now(_files(spark, d)), Config().max_file_size_bytes).select("id", "path", "size_bytes")


_NAMES = "parsed_symbols parsed_references parsed_warnings parse_agreement index_summary reindexed_symbols vanished_symbols cascade_deleted replaced_refs over_limit"
QUERIES = {name: globals()[name] for name in _NAMES.split()}

ORACLE = {
    "cascade_deleted": f"WITH {Q._F}, {Q._SYM} SELECT kind, count(*) AS n FROM s WHERE file_id NOT IN (SELECT id FROM f WHERE language IS NULL) GROUP BY kind",
    "replaced_refs": f"""WITH {Q._REF}, t AS (SELECT id FROM files GROUP BY id HAVING count(DISTINCT content_hash) > 1),
      new AS (SELECT * FROM r WHERE from_file_id IN (SELECT id FROM t) AND to_symbol_id IS NULL)
      SELECT kind, count(*) AS n FROM (SELECT kind FROM r WHERE from_file_id NOT IN (SELECT from_file_id FROM new) UNION ALL SELECT kind FROM new) GROUP BY kind""",
    "over_limit": f"WITH {Q._F} SELECT id, path, size_bytes FROM f WHERE size_bytes > 2097152",
}
