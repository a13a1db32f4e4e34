"""Queries of the reports, with their SQL counterparts. Reports that expand the call graph take as
queries every symbol whose id is divisible by 100 and search all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.model import files_now, rows_now
from codeloom.operators import evidence as E
from codeloom.operators import history as H
from codeloom.operators import reports as W
from codeloom.plans import index_queries as Q
from codeloom.plans.index_queries import _commits, _deltas, _files, _refs, _sources, _symbols, _targets
from codeloom.session import table


def _all_symbols(spark: SparkSession, d: str) -> DataFrame:
    return rows_now(_symbols(spark, d)).select(F.col("id").alias("symbol_id"))


def unknown_targets(spark: SparkSession, d: str) -> DataFrame:
    return W.unknown_symbols(_refs(spark, d).select(F.col("to_symbol_id").alias("symbol_id")), _symbols(spark, d))


def symbol_rows(spark: SparkSession, d: str) -> DataFrame:
    return W.symbol_rows(_symbols(spark, d), _files(spark, d))


def references_to(spark: SparkSession, d: str) -> DataFrame:
    return W.references(_refs(spark, d), _files(spark, d), "to_symbol_id")


def references_from(spark: SparkSession, d: str) -> DataFrame:
    return W.references(_refs(spark, d), _files(spark, d), "from_symbol_id")


def change_reading_list(spark: SparkSession, d: str) -> DataFrame:
    return W.reading_items(_targets(spark, d), _symbols(spark, d), _files(spark, d), _refs(spark, d))


def change_reports(spark: SparkSession, d: str) -> DataFrame:
    return W.change_reports(_targets(spark, d), *(t(spark, d) for t in (_symbols, _files, _refs, _deltas, _commits)))


def historical_warnings(spark: SparkSession, d: str) -> DataFrame:
    return W.historical_warnings(_targets(spark, d), *(t(spark, d) for t in (_symbols, _files, _deltas, _commits)))


def risk_reasons(spark: SparkSession, d: str) -> DataFrame:
    return W.risk_reasons(E.blast_radius(_targets(spark, d), _symbols(spark, d), _files(spark, d), _refs(spark, d)), _refs(spark, d), _files(spark, d))


def symbol_profiles(spark: SparkSession, d: str) -> DataFrame:
    return W.symbol_profiles(_targets(spark, d), *(t(spark, d) for t in (_symbols, _files, _refs, _deltas, _commits, _sources)))


def code_evolution(spark: SparkSession, d: str) -> DataFrame:
    return W.code_evolution(files_now(_files(spark, d)).select("path"), _deltas(spark, d), _commits(spark, d))


def ranked_coupling(spark: SparkSession, d: str) -> DataFrame:
    targets = files_now(_files(spark, d)).where("id % 100 = 0").select("path")
    ranked = W.ranked_coupling(H.tracked_coupling(_deltas(spark, d), _commits(spark, d), targets))
    return ranked.select("path", "pos", "file", "co_change_count", "total_commits_either_file")


def files_changed(spark: SparkSession, d: str) -> DataFrame:
    return W.files_changed(_deltas(spark, d))


def parse_warnings(spark: SparkSession, d: str) -> DataFrame:
    return W.current_warnings(table(spark, d, "parse_results"), _files(spark, d))


_NAMES = (
    "unknown_targets symbol_rows references_to references_from change_reading_list change_reports historical_warnings risk_reasons symbol_profiles code_evolution "
    "ranked_coupling files_changed parse_warnings"
)
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_REFERENCES = f"""WITH {Q._F}, {Q._REF} SELECT %s AS symbol_id, r.id AS ref_id, f.path, from_start_line AS line, %s AS other_id, kind, confidence
  FROM r JOIN f ON f.id = r.from_file_id WHERE %s IS NOT NULL"""
_ITEMS = f"""
  firsts AS (
    SELECT to_symbol_id AS symbol_id, 1 AS section, from_symbol_id AS other_id, min(id) AS ref_id FROM r WHERE from_symbol_id IS NOT NULL AND to_symbol_id IN (SELECT symbol_id FROM targets) GROUP BY ALL
    UNION ALL SELECT from_symbol_id, 2, to_symbol_id, min(id) FROM r WHERE to_symbol_id IS NOT NULL AND from_symbol_id IN (SELECT symbol_id FROM targets) GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol_id, section ORDER BY ref_id) AS pos FROM firsts QUALIFY pos <= 3),
  items AS (
    SELECT k.symbol_id, k.section, k.pos, s.qualified_name AS item, CASE k.section WHEN 1 THEN '{W.WHY["callers"]}' ELSE '{W.WHY["callees"]}' END AS why,
      f.path || ':' || r.from_start_line AS evidence, r.confidence
    FROM ranked k JOIN s ON s.id = k.other_id JOIN r ON r.id = k.ref_id JOIN f ON f.id = r.from_file_id
    UNION ALL
    SELECT symbol_id, 3, row_number() OVER (PARTITION BY symbol_id ORDER BY path), path, '{W.WHY["tests"]}', path, CASE WHEN reason = 2 THEN 'high' ELSE 'medium' END FROM tests)
"""
_TRACKED = f"w AS ({Q.ORACLE['tracked_history']})"
_MAJOR = "coalesce(c.files_changed >= 5, false) OR coalesce(regexp_matches(lower(c.summary), 'refactor|rewrite|restructure|redesign'), false)"
_WARNED = f"""warned AS (SELECT s.id AS symbol_id, w.sha, w.seq, f.path, c.summary, c.files_changed FROM s JOIN targets t ON t.symbol_id = s.id JOIN f ON f.id = s.file_id JOIN w ON w.target = f.path
  JOIN c ON c.sha = w.sha WHERE {_MAJOR})"""
_RISK = Q.ORACLE["blast_radius"]
_sql = lambda text: text.replace("'", "''")

ORACLE = {
    "unknown_targets": "SELECT DISTINCT to_symbol_id AS symbol_id FROM refs WHERE to_symbol_id IS NOT NULL AND to_symbol_id NOT IN (SELECT id FROM symbols)",
    "symbol_rows": f"WITH {Q._F}, {Q._SYM} SELECT s.*, f.path FROM s JOIN f ON f.id = s.file_id",
    "references_to": _REFERENCES % ("to_symbol_id", "from_symbol_id", "to_symbol_id"),
    "references_from": _REFERENCES % ("from_symbol_id", "to_symbol_id", "from_symbol_id"),
    "change_reading_list": f"WITH {Q._F}, {Q._SYM}, {Q._REF}, {Q._TARGETS}, {Q._TESTS}, {_ITEMS} SELECT * REPLACE (CAST(section AS INTEGER) AS section, CAST(pos AS INTEGER) AS pos) FROM items",
    "historical_warnings": f"""WITH {_TRACKED}, {Q._F}, {Q._SYM}, {Q._C}, {Q._TARGETS}, {_WARNED}
      SELECT symbol_id, sha, seq, format('{_sql(W.WARNING).replace("%s", "{}").replace("%d", "{}")}', substr(sha, 1, 7), coalesce(summary, ''), files_changed, path) AS text FROM warned""",
    "change_reports": f"""WITH {_TRACKED}, risk AS ({_RISK}), {Q._F}, {Q._SYM}, {Q._REF}, {Q._C}, {Q._TARGETS}, {Q._TESTS}, {_ITEMS}, {_WARNED},
      read AS (SELECT symbol_id, count(*) FILTER (section = 1) AS a, count(*) FILTER (section = 2) AS b, count(*) FILTER (section = 3) AS c,
        max(CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 END) AS worst FROM items GROUP BY ALL),
      n AS (SELECT symbol_id, count(*) AS n FROM warned GROUP BY ALL)
      SELECT s.id AS symbol_id, s.qualified_name, coalesce(read.a, 0) AS n_callers, coalesce(read.b, 0) AS n_callees, coalesce(read.c, 0) AS n_tests, coalesce(n.n, 0) AS n_warnings, risk.risk,
        CASE coalesce(greatest(read.worst, CASE WHEN n.n > 0 THEN 1 END), 1) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence
      FROM risk JOIN s ON s.id = risk.symbol_id LEFT JOIN read ON read.symbol_id = s.id LEFT JOIN n ON n.symbol_id = s.id""",
    "risk_reasons": f"""WITH b AS ({_RISK}), {Q._F}, {Q._REF},
      cited AS (SELECT to_symbol_id AS symbol_id, string_agg(path || ':' || from_start_line, '; ' ORDER BY id) AS evidence FROM (
        SELECT r.*, f.path, row_number() OVER (PARTITION BY to_symbol_id ORDER BY r.id) AS n FROM r LEFT JOIN f ON f.id = r.from_file_id WHERE to_symbol_id IS NOT NULL) WHERE n <= 3 AND path IS NOT NULL GROUP BY ALL),
      why AS (
        SELECT symbol_id, 1 AS pos, format('{_sql(W.PUBLIC).replace("%d", "{}")}', direct_callers) AS text FROM b WHERE direct_callers >= 1 AND is_public
        UNION ALL SELECT symbol_id, 2, format('{_sql(W.WIDE).replace("%d", "{}")}', direct_callers, indirect_callers) FROM b WHERE direct_callers >= 5 OR indirect_callers >= 15
        UNION ALL SELECT symbol_id, 3, '{_sql(W.UNTESTED)}' FROM b WHERE test_suites = 0 AND direct_callers > 0)
      SELECT why.symbol_id, pos, text, CASE WHEN pos < 3 THEN evidence END AS evidence FROM why LEFT JOIN cited ON cited.symbol_id = why.symbol_id""",
    "code_evolution": f"""WITH {_TRACKED}, {Q._F}, {Q._C},
      h AS (SELECT w.target AS path, w.sha, w.seq, c.author_name, {_MAJOR} AS major FROM w JOIN c ON c.sha = w.sha),
      past AS (SELECT path, arg_max(sha, seq) AS introduced, count(*) AS n_commits, count(*) FILTER (major) AS n_major FROM h GROUP BY path),
      a AS (SELECT path, string_agg(author_name, ',' ORDER BY pos, author_name) AS authors FROM (SELECT path, author_name, min(seq) AS pos FROM h WHERE author_name IS NOT NULL GROUP BY ALL) GROUP BY path)
      SELECT DISTINCT f.path, introduced, coalesce(n_commits, 0) AS n_commits, coalesce(n_major, 0) AS n_major, coalesce(authors, '') AS authors, CASE WHEN n_commits > 0 THEN 'medium' ELSE 'low' END AS confidence
      FROM f LEFT JOIN past ON past.path = f.path LEFT JOIN a ON a.path = f.path""",
    "ranked_coupling": f"""WITH k AS ({Q.ORACLE['tracked_coupling']}), v AS (SELECT *, CAST(CASE WHEN total_commits_either_file > 0 THEN co_change_count / total_commits_either_file ELSE 0 END AS FLOAT) AS exact FROM k)
      SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY exact DESC, file) AS INTEGER) AS pos, file, co_change_count, total_commits_either_file FROM v""",
    "files_changed": f"WITH {Q._D} SELECT sha, count(*) AS files_changed FROM d WHERE sha IS NOT NULL GROUP BY sha",
    "parse_warnings": f"""WITH {Q._F}, p AS (SELECT DISTINCT file_id, parsed_hash, warnings[1:25] AS w FROM parse_results)
      SELECT p.file_id, CAST(unnest(range(1, len(w) + 1)) AS INTEGER) AS pos, unnest(w) AS warning FROM p JOIN f ON f.id = p.file_id AND f.content_hash = p.parsed_hash""",
    "symbol_profiles": f"""WITH {_TRACKED}, b AS ({_RISK}), {Q._F}, {Q._SYM}, {Q._TARGETS}, {Q._TESTS},
      k AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY target ORDER BY seq) <= {W.PROFILE_HISTORY}),
      past AS (SELECT target, count(*) AS n, CASE WHEN count(*) < {W.PROFILE_HISTORY} THEN arg_max(sha, seq) END AS introduced FROM k GROUP BY target),
      t AS (SELECT symbol_id, string_agg(path, ',' ORDER BY path) AS tests FROM tests GROUP BY ALL)
      SELECT s.id AS symbol_id, s.qualified_name, f.path, b.direct_callers, b.indirect_callers, coalesce(t.tests, '') AS tests, '' AS config_keys, past.introduced, coalesce(past.n, 0) AS modification_count
      FROM b JOIN s ON s.id = b.symbol_id JOIN f ON f.id = s.file_id LEFT JOIN t ON t.symbol_id = s.id LEFT JOIN past ON past.target = f.path""",
}
# The SQL above has no environment patterns, since no text of the tables reads the environment.
