"""Queries of the text problems, one group per problem number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.cooccurrence import co_occurrence, coupled_files, touched_files
from codeloom.llm.doc_pairs import code_pairs, described_functions
from codeloom.llm.handwritten import not_handwritten
from codeloom.llm.mixing import mix_documents
from codeloom.llm.parse_check import syntax_flags, syntax_rates
from codeloom.llm.sentences import sentence_units
from codeloom.llm.tokenize import encode_documents
from codeloom.session import table


def _p1(spark: SparkSession, d: str) -> DataFrame:
    return not_handwritten(table(spark, d, "files"), table(spark, d, "sources"), table(spark, d, "index_config"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d).select("file_id")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax_flags(table(spark, d, "sources")).where(~F.col("is_valid")).select("file_id")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax_rates(syntax_flags(table(spark, d, "sources")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return described_functions(table(spark, d, "symbols"), table(spark, d, "sources")).select("symbol_id")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return code_pairs(table(spark, d, "symbols"), table(spark, d, "sources"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return coupled_files(table(spark, d, "deltas"))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = co_occurrence(touched_files(table(spark, d, "deltas")))
    return pairs.select(
        F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"), F.col("n_both").alias("co_change_count"),
        F.col("total_either").alias("total_commits_either_file"), F.round(F.col("ratio").cast("double"), 5).alias("ratio"), F.round("lift", 6).alias("lift"),
    )


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_documents(table(spark, d, "documents"))


def p8_repeats(spark: SparkSession, d: str) -> DataFrame:
    return mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentence_units(table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_reasons": p1_reasons,
    "p2_found": p2_found,
    "p2_rates": p2_rates,
    "p5_found": p5_found,
    "p5_pairs": p5_pairs,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p7_ids": p7_ids,
    "p8_repeats": p8_repeats,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
}

_TOUCH = r"""
  touch AS (SELECT DISTINCT sha, replace(coalesce(new_path, old_path), '\', '/') AS path FROM deltas
            WHERE sha IS NOT NULL AND coalesce(new_path, old_path) IS NOT NULL),
  t AS (SELECT sha, path, split_part(path, '/', 1) AS repo FROM touch),
  sup AS (SELECT repo, path, count(*) AS n FROM t GROUP BY ALL),
  total AS (SELECT repo, count(DISTINCT sha) AS n FROM t GROUP BY ALL),
  pairs AS (SELECT a.repo, a.path AS path_a, b.path AS path_b, count(*) AS c
            FROM t a JOIN t b ON a.repo = b.repo AND a.sha = b.sha AND a.path < b.path GROUP BY ALL),
  all_of AS (SELECT p.*, x.n AS a, y.n AS b, total.n AS n FROM pairs p
             JOIN sup x ON x.repo = p.repo AND x.path = p.path_a JOIN sup y ON y.repo = p.repo AND y.path = p.path_b
             JOIN total ON total.repo = p.repo)
"""

ORACLE = {
    "p6_found": f"WITH {_TOUCH} SELECT path_a, path_b FROM all_of WHERE c >= 4 AND 2 * c >= a + b - c AND c * n >= 2 * a * b",
    "p6_pairs": f"""WITH {_TOUCH} SELECT path_a, path_b, c AS co_change_count, a + b - c AS total_commits_either_file,
      round(CAST(CAST(c / (a + b - c) AS FLOAT) AS DOUBLE), 5) AS ratio, round(c * n / (CAST(a AS DOUBLE) * b), 6) AS lift FROM all_of""",
}
