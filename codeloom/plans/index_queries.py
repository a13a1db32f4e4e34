"""Queries of the index, graph, history and report operators, with their SQL counterparts.

Graph expansions and couplings take as queries every symbol or file whose id is divisible by 100
and search all rows; everything else runs over all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.model import commits_now, files_now, rows_now
from codeloom.operators import evidence as E
from codeloom.operators import extract as X
from codeloom.operators import graph as G
from codeloom.operators import history as H
from codeloom.operators import resolve as R
from codeloom.operators import search as S
from codeloom.operators import snapshot as N
from codeloom.session import cut, table
from codeloom.streaming.ingest import keep_files_snapshot, stream_table, windowed_counts

SEARCH_TEXT = "merge"


def _t(name: str):
    return lambda spark, d: table(spark, d, name)


_files, _symbols, _refs, _deltas, _commits, _sources = map(_t, ("files", "symbols", "refs", "deltas", "commits", "sources"))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(spark, d).where("id % 100 = 0").select(F.col("id").alias("symbol_id")).distinct()


def _nodes(spark: SparkSession, d: str, reverse: bool) -> tuple[DataFrame, DataFrame]:
    edges = cut(G.edges_of(_refs(spark, d), reverse))
    return G.expand(edges, _targets(spark, d).withColumnRenamed("symbol_id", "root")), edges


def files_latest(spark: SparkSession, d: str) -> DataFrame:
    return files_now(_files(spark, d))


def file_list(spark: SparkSession, d: str) -> DataFrame:
    return files_now(_files(spark, d)).select("path").orderBy("path")


def path_functions(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return files_now(_files(spark, d)).select(
        "path", P.file_stem(p).alias("stem"), P.parent_dir(p).alias("dir"), P.extension(p).alias("ext"), P.repo(p).alias("repo"),
        P.detect_language(p).alias("language"), F.coalesce(P.in_test_dir(p), F.lit(False)).alias("in_test_dir"), P.looks_like_test(p).alias("like_test"),
    )


def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    return S.search_symbols(_symbols(spark, d), _files(spark, d), SEARCH_TEXT)


def symbols_in_files(spark: SparkSession, d: str) -> DataFrame:
    return S.symbols_in_files(_symbols(spark, d), _files(spark, d))


def direct_callers(spark: SparkSession, d: str) -> DataFrame:
    return E.direct_callers(_refs(spark, d))


def report_confidence(spark: SparkSession, d: str) -> DataFrame:
    return E.report_confidence(_refs(spark, d))


def resolve_refs(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve_refs(_refs(spark, d), _symbols(spark, d))


def resolve_refs_imports(spark: SparkSession, d: str) -> DataFrame:
    files = files_now(_files(spark, d))
    return R.resolve_refs(_refs(spark, d), _symbols(spark, d), X.imports_of(_sources(spark, d)), files)


def innermost_symbols(spark: SparkSession, d: str) -> DataFrame:
    return R.innermost_symbols(_refs(spark, d), _symbols(spark, d))


def attributed_refs(spark: SparkSession, d: str) -> DataFrame:
    return R.attributed_refs(_refs(spark, d), _symbols(spark, d))


def callers_bfs(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, True)[0]


def callees_bfs(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, False)[0]


def bfs_truncated(spark: SparkSession, d: str) -> DataFrame:
    return G.truncated(*_nodes(spark, d, True))


def bfs_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = _nodes(spark, d, True)
    return G.graph_edges(nodes.where("depth <= 2"), rows_now(_refs(spark, d)), 2)


def _all_edges(spark: SparkSession, d: str, reverse: bool) -> DataFrame:
    # Nodes at the greatest depth have no edges in the graph, so the last hop is not needed.
    roots = _targets(spark, d).withColumnRenamed("symbol_id", "root")
    nodes = G.expand(G.edges_of(_refs(spark, d), reverse), roots, G.MAX_DEPTH - 1)
    return G.graph_edges(nodes, rows_now(_refs(spark, d)), G.MAX_DEPTH, reverse)


def bfs_edges_callers(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the whole expansion, where ``bfs_edges`` has those of its first two levels."""
    return _all_edges(spark, d, True)


def bfs_edges_callees(spark: SparkSession, d: str) -> DataFrame:
    return _all_edges(spark, d, False)


def tiered_layout(spark: SparkSession, d: str) -> DataFrame:
    return G.tiered_layout(_nodes(spark, d, False)[0])


def subclasses_closure(spark: SparkSession, d: str) -> DataFrame:
    return G.subclasses(_refs(spark, d), _targets(spark, d).withColumnRenamed("symbol_id", "root")).select("root", "node")


def related_tests(spark: SparkSession, d: str) -> DataFrame:
    return E.related_tests(_targets(spark, d), _symbols(spark, d), _files(spark, d), _refs(spark, d))


def test_counts(spark: SparkSession, d: str) -> DataFrame:
    """The number of related tests of every symbol."""
    every = rows_now(_symbols(spark, d)).select(F.col("id").alias("symbol_id"))
    return E.test_counts(every, _symbols(spark, d), _files(spark, d), _refs(spark, d))


def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    b = E.blast_radius(_targets(spark, d), _symbols(spark, d), _files(spark, d), _refs(spark, d))
    return b.withColumn("reasons", F.concat_ws("; ", "reasons"))


def reading_list(spark: SparkSession, d: str) -> DataFrame:
    return E.reading_list(rows_now(_symbols(spark, d)).select(F.col("id").alias("symbol_id")), _refs(spark, d))


def config_touches(spark: SparkSession, d: str) -> DataFrame:
    return E.config_touches(_symbols(spark, d), _sources(spark, d))


def file_history(spark: SparkSession, d: str) -> DataFrame:
    return H.file_commits(_deltas(spark, d), _commits(spark, d)).select("path", "sha", "seq", "files_changed")


def introduced_capped(spark: SparkSession, d: str) -> DataFrame:
    h = H.file_commits(_deltas(spark, d), _commits(spark, d)).select(F.col("path").alias("target"), "sha", "seq")
    return H.introduced(h, 2000)


def authors_in_order(spark: SparkSession, d: str) -> DataFrame:
    a = H.authors_in_order(H.file_commits(_deltas(spark, d), _commits(spark, d)))
    return a.select("path", F.concat_ws(",", "authors").alias("authors"))


def major_refactors(spark: SparkSession, d: str) -> DataFrame:
    return H.major_refactors(_commits(spark, d)).select("sha", P.short_sha(F.col("sha")).alias("short_sha"), "files_changed", "summary")


def tracked_history(spark: SparkSession, d: str) -> DataFrame:
    return H.tracked_walk(_deltas(spark, d), _commits(spark, d))


def tracked_introduced(spark: SparkSession, d: str) -> DataFrame:
    return H.introduced(tracked_history(spark, d))


def tracked_introduced_capped(spark: SparkSession, d: str) -> DataFrame:
    return H.introduced(tracked_history(spark, d), 2000)


def tracked_authors(spark: SparkSession, d: str) -> DataFrame:
    names = commits_now(_commits(spark, d)).select("sha", "author_name")
    walk = tracked_history(spark, d).select(F.col("target").alias("path"), "sha", "seq").join(names, "sha")
    return H.authors_in_order(walk).select("path", F.concat_ws(",", "authors").alias("authors"))


def tracked_coupling(spark: SparkSession, d: str) -> DataFrame:
    targets = files_now(_files(spark, d)).where("id % 100 = 0").select("path")
    return H.tracked_coupling(_deltas(spark, d), _commits(spark, d), targets).withColumn("ratio", F.round(F.col("ratio").cast("double"), 5))


def temporal_coupling(spark: SparkSession, d: str) -> DataFrame:
    targets = files_now(_files(spark, d)).where("id % 100 = 0").select("path")
    return H.coupling_of(_deltas(spark, d), targets).withColumn("ratio", F.round(F.col("ratio").cast("double"), 5))


def deleted_files(spark: SparkSession, d: str) -> DataFrame:
    walked = H.deltas_now(_deltas(spark, d)).select("path").distinct()
    return N.deleted_files(files_now(_files(spark, d)), walked).select("id", "path")


def _first_rows(files: DataFrame) -> DataFrame:
    return files.groupBy("id").agg(F.min_by(F.struct("path", "content_hash"), F.struct("indexed_at", "content_hash")).alias("f")).select("id", "f.path", "f.content_hash")


def changed_files(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return N.changed_files(_first_rows(f), files_now(f)).select("id", "path", "content_hash")


def upserted_files(spark: SparkSession, d: str) -> DataFrame:
    """The files seen first count as stored, all current ones as walked."""
    f = _files(spark, d)
    stored = files_now(f).where("indexed_at < 1672531200").select("id", "path")
    return N.upsert_files(stored, files_now(f).select("path", "content_hash")).select("id", "path", "content_hash")


def matched_symbols(spark: SparkSession, d: str) -> DataFrame:
    s = rows_now(_symbols(spark, d))
    m = N.match_symbols(s.select("id", "file_id", "qualified_name", "kind"), s.select(F.col("id").alias("parsed_id"), "file_id", "qualified_name", "kind", "start_byte"))
    return m.select("parsed_id", "old_id")


def set_null_refs(spark: SparkSession, d: str) -> DataFrame:
    exported = rows_now(_symbols(spark, d)).where("is_exported")
    r = N.set_null_refs(rows_now(_refs(spark, d)), exported, table(spark, d, "shared_symbols"))
    return r.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("from_symbol_id").alias("n_from"), F.count("to_symbol_id").alias("n_to"))


def symbol_outline(spark: SparkSession, d: str) -> DataFrame:
    return X.outline(_sources(spark, d))


def import_bindings(spark: SparkSession, d: str) -> DataFrame:
    return X.imports_of(_sources(spark, d))


def stream_files(spark: SparkSession, d: str) -> DataFrame:
    return keep_files_snapshot(spark, stream_table(spark, d, "files"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(spark, d, "events"))


_NAMES = (
    "files_latest file_list path_functions search_ranked symbols_in_files direct_callers report_confidence resolve_refs resolve_refs_imports innermost_symbols attributed_refs "
    "callers_bfs callees_bfs bfs_truncated bfs_edges bfs_edges_callers bfs_edges_callees tiered_layout subclasses_closure related_tests test_counts blast_radius reading_list config_touches file_history "
    "introduced_capped authors_in_order major_refactors tracked_history tracked_introduced tracked_introduced_capped tracked_authors tracked_coupling temporal_coupling deleted_files changed_files upserted_files matched_symbols set_null_refs "
    "symbol_outline import_bindings stream_files event_windows"
)
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_F = "f AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, content_hash DESC NULLS LAST) = 1)"
_SYM = "s AS (SELECT DISTINCT * FROM symbols)"
_REF = "r AS (SELECT DISTINCT * FROM refs)"
_TARGETS = "targets AS (SELECT DISTINCT id AS symbol_id FROM symbols WHERE id % 100 = 0)"
_UP = "translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_D = r"""d AS (SELECT DISTINCT sha, status, replace(old_path, '\', '/') AS old_path, replace(new_path, '\', '/') AS new_path,
  coalesce(replace(new_path, '\', '/'), replace(old_path, '\', '/')) AS path FROM deltas WHERE coalesce(new_path, old_path) IS NOT NULL)"""
_C = "c AS (SELECT DISTINCT ON (sha) * FROM commits)"
_HIST = f"{_D}, {_C}, h AS (SELECT DISTINCT d.path, d.sha, c.seq, c.files_changed, c.author_name FROM d JOIN c ON c.sha = d.sha)"
_IN_TEST = "list_has_any(string_split(regexp_extract(%s, '^(.*)/[^/]*$', 1), '/'), ['tests', '__tests__', 'spec', 'test'])"
_LIKE = f"""({_IN_TEST} OR contains(lower(regexp_extract(%s, '([^/]*)$', 1)), '.test.') OR contains(lower(regexp_extract(%s, '([^/]*)$', 1)), '.spec.')
  OR contains(lower(regexp_extract(%s, '([^/]*)$', 1)), '_test.') OR starts_with(lower(regexp_extract(%s, '([^/]*)$', 1)), 'test_'))"""
_LANG = """CASE regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\\.([^.]*)$', 1) WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'type_script' WHEN 'mts' THEN 'type_script'
  WHEN 'cts' THEN 'type_script' WHEN 'tsx' THEN 'tsx' WHEN 'js' THEN 'java_script' WHEN 'mjs' THEN 'java_script' WHEN 'cjs' THEN 'java_script' WHEN 'jsx' THEN 'java_script'
  WHEN 'py' THEN 'python' WHEN 'pyi' THEN 'python' WHEN 'go' THEN 'go' END"""


def _bfs(src: str, dst: str) -> str:
    return f"""e AS (SELECT DISTINCT {src} AS src, {dst} AS dst FROM refs WHERE from_symbol_id IS NOT NULL AND to_symbol_id IS NOT NULL),
      walk AS (SELECT symbol_id AS root, symbol_id AS node, 0 AS depth FROM targets UNION SELECT w.root, e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.node WHERE w.depth < 6),
      nodes AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY ALL)"""


_CALLERS, _CALLEES = _bfs("to_symbol_id", "from_symbol_id"), _bfs("from_symbol_id", "to_symbol_id")
_ALL_EDGES = """SELECT n.root, r.from_symbol_id AS from_id, r.to_symbol_id AS to_id, r.id AS ref_id FROM nodes n JOIN r ON r.%s = n.node
      WHERE n.depth < 6 AND r.from_symbol_id IS NOT NULL AND r.to_symbol_id IS NOT NULL"""
_TESTS = f"""
  mine AS (SELECT s.id AS symbol_id, f.path AS own FROM s JOIN targets t ON t.symbol_id = s.id JOIN f ON f.id = s.file_id),
  named AS (SELECT symbol_id, path, 1 AS reason FROM (SELECT m.*, f.path, regexp_extract(regexp_extract(own, '([^/]*)$', 1), '^(.+?)(\\.[^.]*)?$', 1) AS stem,
      regexp_extract(f.path, '([^/]*)$', 1) AS name FROM mine m JOIN f ON regexp_extract(f.path, '^(.*)/[^/]*$', 1) = regexp_extract(m.own, '^(.*)/[^/]*$', 1) WHERE f.path <> m.own)
    WHERE stem <> '' AND (starts_with(name, stem || '.test.') OR starts_with(name, stem || '.spec.') OR starts_with(name, stem || '_test.') OR starts_with(name, 'test_' || stem || '.'))),
  placed AS (SELECT symbol_id, path, 0 AS reason FROM mine m JOIN f ON split_part(f.path, '/', 1) || '/' || split_part(f.path, '/', 2) = split_part(m.own, '/', 1) || '/' || split_part(m.own, '/', 2)
    WHERE f.path <> m.own AND {_IN_TEST % "regexp_replace(f.path, '^[^/]*/', '')"}),
  used AS (SELECT DISTINCT m.symbol_id, f.path, 2 AS reason FROM mine m JOIN refs ON refs.to_symbol_id = m.symbol_id JOIN f ON f.id = refs.from_file_id WHERE {_LIKE % (("regexp_replace(f.path, '^[^/]*/', '')",) * 5)}),
  tests AS (SELECT symbol_id, path, max(reason) AS reason FROM (FROM named UNION ALL FROM placed UNION ALL FROM used) GROUP BY ALL)
"""

ORACLE = {
    "files_latest": f"WITH {_F} SELECT * FROM f",
    "stream_files": f"WITH {_F} SELECT * FROM f",
    "file_list": f"WITH {_F} SELECT path FROM f ORDER BY path",
    "path_functions": f"""WITH {_F} SELECT path, regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^(.+?)(\\.[^.]*)?$', 1) AS stem, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir,
      regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\\.([^.]*)$', 1) AS ext, split_part(path, '/', 1) AS repo, {_LANG} AS language, {_IN_TEST % 'path'} AS in_test_dir, {_LIKE % (('path',) * 5)} AS like_test FROM f""",
    "search_ranked": f"""WITH {_F}, {_SYM}, q AS (SELECT s.*, {_UP % 's.name'} AS ln, {_UP % 's.qualified_name'} AS lq FROM s)
      SELECT q.id, name, qualified_name, kind, f.path, start_line,
        CASE WHEN name = '{SEARCH_TEXT}' OR qualified_name = '{SEARCH_TEXT}' THEN 0 WHEN starts_with(ln, '{SEARCH_TEXT}') OR starts_with(lq, '{SEARCH_TEXT}') THEN 1 ELSE 2 END AS rank
      FROM q JOIN f ON f.id = q.file_id WHERE contains(ln, '{SEARCH_TEXT}') OR contains(lq, '{SEARCH_TEXT}')
      ORDER BY rank, length(qualified_name), qualified_name, q.id LIMIT {S.DEFAULT_LIMIT}""",
    "symbols_in_files": f"""WITH {_F}, {_SYM} SELECT f.path, CAST(row_number() OVER (PARTITION BY s.file_id ORDER BY start_line, start_col, s.id) AS INTEGER) AS ordinal, s.id, s.name, s.kind
      FROM s JOIN f ON f.id = s.file_id""",
    "direct_callers": f"WITH {_REF} SELECT to_symbol_id AS symbol_id, count(*) AS direct_callers, count(DISTINCT from_symbol_id) AS distinct_callers FROM r WHERE to_symbol_id IS NOT NULL GROUP BY ALL",
    "report_confidence": f"""WITH {_REF}, m AS (SELECT to_symbol_id AS symbol_id, max(CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 END) AS k FROM r WHERE to_symbol_id IS NOT NULL GROUP BY ALL)
      SELECT symbol_id, CASE coalesce(k, 1) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM m""",
    "resolve_refs": f"""WITH {_REF}, {_SYM}, here AS (SELECT file_id, name, count(*) AS n, min(id) AS id FROM s GROUP BY file_id, name), anywhere AS (SELECT name, count(*) AS n, min(id) AS id FROM s GROUP BY name)
      SELECT r.id AS ref_id, CASE WHEN h.n = 1 THEN h.id WHEN h.n > 1 THEN NULL WHEN a.n = 1 THEN a.id END AS resolved_id,
        CASE WHEN h.n = 1 THEN 'high' WHEN h.n > 1 THEN 'low' WHEN a.n = 1 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN h.n >= 1 THEN 'same_file' ELSE 'global' END AS tier
      FROM r LEFT JOIN here h ON h.file_id = r.from_file_id AND h.name = r.to_name LEFT JOIN anywhere a ON a.name = r.to_name""",
    "innermost_symbols": f"""WITH {_REF}, {_SYM} SELECT r.id AS ref_id, s.id AS symbol_id FROM r JOIN s ON s.file_id = r.from_file_id AND s.start_byte <= r.from_start_byte AND r.from_end_byte <= s.end_byte
      QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY s.end_byte - s.start_byte, s.id) = 1""",
    "attributed_refs": f"""WITH {_REF}, {_SYM}, i AS (SELECT r.id AS ref_id, s.file_id, s.name FROM r JOIN s ON s.file_id = r.from_file_id AND s.start_byte <= r.from_start_byte AND r.from_end_byte <= s.end_byte
      QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY s.end_byte - s.start_byte, s.id) = 1), u AS (SELECT file_id, name, count(*) AS n, min(id) AS id FROM s GROUP BY file_id, name)
      SELECT ref_id, CASE WHEN u.n = 1 THEN u.id END AS symbol_id FROM i JOIN u ON u.file_id = i.file_id AND u.name = i.name""",
    "callers_bfs": f"WITH RECURSIVE {_TARGETS}, {_CALLERS} SELECT * FROM nodes",
    "callees_bfs": f"WITH RECURSIVE {_TARGETS}, {_CALLEES} SELECT * FROM nodes",
    "bfs_truncated": f"WITH RECURSIVE {_TARGETS}, {_CALLERS} SELECT root, bool_or(depth = 6 AND node IN (SELECT src FROM e)) AS truncated FROM nodes GROUP BY root",
    "bfs_edges": f"""WITH RECURSIVE {_TARGETS}, {_CALLERS}, {_REF} SELECT n.root, r.from_symbol_id AS from_id, r.to_symbol_id AS to_id, r.id AS ref_id
      FROM nodes n JOIN r ON r.to_symbol_id = n.node WHERE n.depth < 2 AND r.from_symbol_id IS NOT NULL""",
    "bfs_edges_callers": f"WITH RECURSIVE {_TARGETS}, {_CALLERS}, {_REF} {_ALL_EDGES % 'to_symbol_id'}",
    "bfs_edges_callees": f"WITH RECURSIVE {_TARGETS}, {_CALLEES}, {_REF} {_ALL_EDGES % 'from_symbol_id'}",
    "tiered_layout": f"""WITH RECURSIVE {_TARGETS}, {_CALLEES} SELECT root, node, depth, depth * 240 AS x,
      CAST((row_number() OVER (PARTITION BY root, depth ORDER BY node) - 1) * 64 AS INTEGER) AS y FROM nodes""",
    "subclasses_closure": f"""WITH RECURSIVE {_TARGETS}, e AS (SELECT DISTINCT to_symbol_id AS src, from_symbol_id AS dst FROM refs WHERE kind IN ('extends', 'implements') AND from_symbol_id IS NOT NULL AND to_symbol_id IS NOT NULL),
      walk AS (SELECT symbol_id AS root, symbol_id AS node FROM targets UNION SELECT w.root, e.dst FROM walk w JOIN e ON e.src = w.node) SELECT root, node FROM walk WHERE root <> node""",
    "related_tests": f"""WITH {_F}, {_SYM}, {_TARGETS}, {_TESTS} SELECT symbol_id, path, CASE reason WHEN 0 THEN 'directory_convention' WHEN 1 THEN 'naming_convention' ELSE 'direct_import' END AS reason,
      CASE WHEN reason = 2 THEN 'high' ELSE 'medium' END AS confidence FROM tests""",
    "test_counts": f"""WITH {_F}, {_SYM}, targets AS (SELECT id AS symbol_id FROM s), {_TESTS}, n AS (SELECT symbol_id, count(*) AS n FROM tests GROUP BY ALL)
      SELECT mine.symbol_id, coalesce(n.n, 0) AS test_suites FROM mine LEFT JOIN n ON n.symbol_id = mine.symbol_id""",
    "blast_radius": f"""WITH RECURSIVE {_F}, {_SYM}, {_REF}, {_TARGETS}, {_CALLERS}, {_TESTS},
      suites AS (SELECT symbol_id, count(*) AS n FROM tests GROUP BY ALL),
      own AS (SELECT to_symbol_id AS symbol_id, count(*) AS d, count(DISTINCT from_symbol_id) AS dd FROM r WHERE to_symbol_id IS NOT NULL GROUP BY ALL),
      far AS (SELECT root AS symbol_id, count(*) - 1 AS n FROM nodes GROUP BY ALL),
      c AS (SELECT t.symbol_id, coalesce(own.d, 0) AS direct_callers, greatest(0, far.n - coalesce(own.dd, 0)) AS indirect_callers, s.is_exported AS is_public, coalesce(suites.n, 0) AS test_suites
        FROM targets t JOIN s ON s.id = t.symbol_id LEFT JOIN own ON own.symbol_id = t.symbol_id LEFT JOIN far ON far.symbol_id = t.symbol_id LEFT JOIN suites ON suites.symbol_id = t.symbol_id)
      SELECT *, ['low', 'medium', 'high', 'critical'][1 + least(3, greatest(CASE WHEN direct_callers >= 1 AND is_public THEN 1 ELSE 0 END, CASE WHEN direct_callers >= 5 OR indirect_callers >= 15 THEN 2 ELSE 0 END)
          + CASE WHEN test_suites = 0 AND direct_callers > 0 THEN 1 ELSE 0 END)] AS risk,
        concat_ws('; ', CASE WHEN direct_callers >= 1 AND is_public THEN 'public api with callers' END, CASE WHEN direct_callers >= 5 OR indirect_callers >= 15 THEN 'wide blast radius' END,
          CASE WHEN test_suites = 0 AND direct_callers > 0 THEN 'no related tests' END) AS reasons FROM c""",
    "reading_list": f"""WITH {_REF}, {_SYM}, p AS (
        SELECT to_symbol_id AS symbol_id, 'callers' AS section, from_symbol_id AS other_id, min(id) AS ref_id, 'calls this directly' AS why FROM r WHERE from_symbol_id IS NOT NULL AND to_symbol_id IN (SELECT id FROM s) GROUP BY ALL
        UNION ALL SELECT from_symbol_id, 'callees', to_symbol_id, min(id), 'this depends on it' FROM r WHERE to_symbol_id IS NOT NULL AND from_symbol_id IN (SELECT id FROM s) GROUP BY ALL)
      SELECT symbol_id, section, CAST(row_number() OVER (PARTITION BY symbol_id, section ORDER BY ref_id) AS INTEGER) AS pos, other_id, ref_id, why FROM p QUALIFY pos <= 3""",
    "file_history": f"WITH {_HIST} SELECT path, sha, seq, files_changed FROM h",
    "introduced_capped": f"""WITH {_HIST}, k AS (SELECT path AS target, sha, seq FROM h QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq) <= 2000)
      SELECT target, count(*) AS modification_count, CASE WHEN count(*) < 2000 THEN arg_max(sha, seq) END AS introduced FROM k GROUP BY target""",
    "authors_in_order": f"""WITH {_HIST}, a AS (SELECT path, author_name, min(seq) AS pos FROM h WHERE author_name IS NOT NULL GROUP BY ALL)
      SELECT path, string_agg(author_name, ',' ORDER BY pos, author_name) AS authors FROM a GROUP BY path""",
    "major_refactors": f"WITH {_C} SELECT sha, substr(sha, 1, 7) AS short_sha, files_changed, summary FROM c WHERE coalesce(files_changed >= 5, false) OR coalesce(regexp_matches(lower(summary), 'refactor|rewrite|restructure|redesign'), false)",
    "tracked_history": f"""WITH RECURSIVE {_D}, {_C}, x AS (SELECT d.*, c.seq FROM d JOIN c ON c.sha = d.sha),
      ends AS (SELECT new_path AS path, seq AS end_seq, min(CASE WHEN status = 'renamed' THEN old_path END) AS next_path FROM x WHERE status IN ('renamed', 'added') AND new_path IS NOT NULL GROUP BY ALL),
      starts AS (SELECT DISTINCT path AS target FROM x),
      seg AS (
        SELECT target, target AS path, 0 AS above, false AS renamed, (SELECT min(end_seq) FROM ends e WHERE e.path = target AND e.end_seq > 0) AS end_seq FROM starts
        UNION ALL
        SELECT g.target, e.next_path, g.end_seq, true, (SELECT min(z.end_seq) FROM ends z WHERE z.path = e.next_path AND z.end_seq > g.end_seq)
        FROM seg g JOIN ends e ON e.path = g.path AND e.end_seq = g.end_seq WHERE e.next_path IS NOT NULL),
      sides AS (SELECT sha, seq, old_path AS path FROM x WHERE old_path IS NOT NULL UNION SELECT sha, seq, new_path FROM x WHERE new_path IS NOT NULL),
      w AS (SELECT g.target, d.sha, d.seq, g.path, g.above, g.renamed FROM seg g JOIN sides d ON d.path = g.path WHERE d.seq > g.above AND (g.end_seq IS NULL OR d.seq <= g.end_seq))
      SELECT target, sha, seq, arg_max(path, above) AS tracked_path, bool_or(renamed) AS renamed FROM w GROUP BY target, sha, seq""",
    "temporal_coupling": f"""WITH {_F}, {_D}, t AS (SELECT DISTINCT sha, path FROM d), n AS (SELECT path, count(*) AS n FROM t GROUP BY ALL),
      b AS (SELECT a.path, o.path AS file, count(*) AS c FROM t a JOIN t o ON o.sha = a.sha AND o.path <> a.path WHERE a.path IN (SELECT path FROM f WHERE id % 100 = 0) GROUP BY ALL)
      SELECT b.path, b.file, b.c AS co_change_count, x.n + y.n - b.c AS total_commits_either_file, round(CAST(CAST(b.c / (x.n + y.n - b.c) AS FLOAT) AS DOUBLE), 5) AS ratio
      FROM b JOIN n x ON x.path = b.path JOIN n y ON y.path = b.file""",
    "deleted_files": f"WITH {_F}, {_D} SELECT id, path FROM f WHERE path NOT IN (SELECT path FROM d)",
    "changed_files": f"""WITH {_F}, first AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at, content_hash) = 1)
      SELECT f.id, f.path, f.content_hash FROM f WHERE NOT EXISTS (SELECT 1 FROM first WHERE first.path = f.path AND first.content_hash = f.content_hash)""",
    "matched_symbols": f"""WITH {_SYM}, o AS (SELECT id, file_id, qualified_name, kind, row_number() OVER (PARTITION BY file_id, qualified_name, kind ORDER BY id DESC) AS turn FROM s),
      p AS (SELECT id, file_id, qualified_name, kind, row_number() OVER (PARTITION BY file_id, qualified_name, kind ORDER BY start_byte) AS turn FROM s)
      SELECT p.id AS parsed_id, o.id AS old_id FROM p LEFT JOIN o USING (file_id, qualified_name, kind, turn)""",
    "set_null_refs": f"""WITH {_REF}, x AS (SELECT DISTINCT id FROM symbols WHERE is_exported), y AS (SELECT id FROM x UNION SELECT id FROM shared_symbols)
      SELECT kind, count(*) AS n, count(CASE WHEN from_symbol_id IN (SELECT id FROM x) THEN 1 END) AS n_from, count(CASE WHEN to_symbol_id IN (SELECT id FROM y) THEN 1 END) AS n_to FROM r GROUP BY kind""",
    "event_windows": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}

_WALK = f"w AS ({ORACLE['tracked_history']})"
ORACLE |= {
    "tracked_introduced": f"WITH {_WALK} SELECT target, count(*) AS modification_count, arg_max(sha, seq) AS introduced FROM w GROUP BY target",
    "tracked_introduced_capped": f"""WITH {_WALK}, k AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY target ORDER BY seq) <= 2000)
      SELECT target, count(*) AS modification_count, CASE WHEN count(*) < 2000 THEN arg_max(sha, seq) END AS introduced FROM k GROUP BY target""",
    "tracked_authors": f"""WITH {_WALK}, {_C}, a AS (SELECT target AS path, author_name, min(w.seq) AS pos FROM w JOIN c ON c.sha = w.sha WHERE author_name IS NOT NULL GROUP BY ALL)
      SELECT path, string_agg(author_name, ',' ORDER BY pos, author_name) AS authors FROM a GROUP BY path""",
    "tracked_coupling": f"""WITH {_WALK}, {_F}, {_D}, n AS (SELECT target, count(*) AS n FROM w GROUP BY ALL),
      b AS (SELECT w.target, d.path AS file, count(DISTINCT d.sha) AS c FROM w JOIN d ON d.sha = w.sha AND d.new_path IS DISTINCT FROM w.tracked_path AND d.old_path IS DISTINCT FROM w.tracked_path
        WHERE w.target IN (SELECT path FROM f WHERE id % 100 = 0) GROUP BY ALL)
      SELECT b.target AS path, b.file, b.c AS co_change_count, greatest(0, x.n + y.n - b.c) AS total_commits_either_file,
        round(CAST(CAST(CASE WHEN x.n + y.n > b.c THEN b.c / (x.n + y.n - b.c) ELSE 0 END AS FLOAT) AS DOUBLE), 5) AS ratio
      FROM b JOIN n x ON x.target = b.target JOIN n y ON y.target = b.file""",
}

# The lines, bindings and module paths of the import tier, written with SQL lists.
_LINES = f"""lines AS (SELECT file_id, path, language, unnest(string_split(content, chr(10))) AS line FROM (SELECT file_id, path, content, {_LANG} AS language FROM sources WHERE content IS NOT NULL) WHERE language IS NOT NULL)"""
_BINDINGS = rf"""{_LINES},
  script AS (SELECT file_id, path, regexp_extract(line, '^import\s+(?:type\s+)?(.*?)\s*from\s+["'']([^"'']+)["'']', 1) AS clause, regexp_extract(line, 'from\s+["'']([^"'']+)["'']', 1) AS module
    FROM lines WHERE language IN ('type_script', 'tsx', 'java_script')),
  use AS (SELECT file_id, path, regexp_extract(line, '^\s*(?:pub\s+)?use\s+([^;{{}}]+?)(?:::\{{([^{{}}]*)\}})?\s*;', 1) AS head, regexp_extract(line, '^\s*(?:pub\s+)?use\s+([^;{{}}]+?)(?:::\{{([^{{}}]*)\}})?\s*;', 2) AS names FROM lines WHERE language = 'rust'),
  item AS (
    SELECT file_id, path, module, unnest(string_split(regexp_extract(clause, '\{{([^}}]*)\}}', 1), ',')) AS item FROM script WHERE clause <> ''
    UNION ALL SELECT file_id, path, regexp_extract(line, '^from\s+(\S+)\s+import\s+\(?([^()#]+)', 1), unnest(string_split(regexp_extract(line, '^from\s+(\S+)\s+import\s+\(?([^()#]+)', 2), ',')) FROM lines WHERE language = 'python'
    UNION ALL SELECT file_id, path, CASE WHEN names <> '' THEN head ELSE regexp_replace(head, '::[^:]*$', '') END,
      unnest(CASE WHEN names <> '' THEN string_split(names, ',') ELSE [regexp_extract(head, '([^:]*)$', 1)] END) FROM use WHERE head <> ''),
  w AS (SELECT file_id, path, module, string_split_regex(regexp_replace(trim(item), '^type\s+', ''), '\s+as\s+') AS w FROM item),
  p AS (SELECT file_id, path, string_split_regex(trim(item), '\s+as\s+') AS w FROM (SELECT file_id, path, unnest(string_split(regexp_extract(line, '^import\s+([^#]+)', 1), ',')) AS item FROM lines WHERE language = 'python')),
  g AS (SELECT file_id, path, regexp_extract(line, '^\s*(?:import\s+)?(?:([\w.]+)\s+)?"([^"]+)"\s*$', 1) AS alias, regexp_extract(line, '^\s*(?:import\s+)?(?:([\w.]+)\s+)?"([^"]+)"\s*$', 2) AS module FROM lines WHERE language = 'go'),
  bound AS (SELECT file_id, path, local_name, source_module, imported_name FROM (
    SELECT file_id, path, CASE WHEN len(w) > 1 THEN w[2] ELSE w[1] END AS local_name, module AS source_module, w[1] AS imported_name FROM w
    UNION ALL SELECT file_id, path, regexp_extract(clause, '^([\w$]+)\s*(?:,|$)', 1), module, 'default' FROM script WHERE clause <> ''
    UNION ALL SELECT file_id, path, CASE WHEN len(w) > 1 THEN w[2] ELSE split_part(w[1], '.', 1) END, w[1], w[1] FROM p
    UNION ALL SELECT file_id, path, CASE WHEN alias <> '' THEN alias ELSE regexp_extract(module, '([^/]*)$', 1) END, module, regexp_extract(module, '([^/]*)$', 1) FROM g WHERE module <> '')
    WHERE local_name <> '' AND local_name <> '*')
"""
_MODULES = rf"""
  dirs AS (SELECT *, {_LANG} AS language, list_filter(string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/'), lambda x: x <> '') AS d, string_split(path, '/') AS whole, string_split(source_module, '::') AS parts,
    length(regexp_extract(source_module, '^(\.+)', 1)) AS dots FROM bound),
  rs AS (SELECT *, list_position(whole, 'src') AS src_at, whole[1:list_position(whole, 'src')] AS root, whole[list_position(whole, 'src') + 1:] AS below FROM dirs),
  rm AS (SELECT *, CASE WHEN len(below) = 0 THEN below WHEN regexp_replace(below[-1], '\.rs$', '') IN ('mod', 'lib', 'main') THEN below[1:len(below) - 1] ELSE below[1:len(below) - 1] || [regexp_replace(below[-1], '\.rs$', '')] END AS inner_module FROM rs),
  stems AS (SELECT file_id, path, local_name, source_module, imported_name, language, CASE
    WHEN language IN ('type_script', 'tsx', 'java_script') THEN CASE WHEN regexp_matches(source_module, '^(\./|\.\./)') OR source_module IN ('.', '..') THEN
      list_reduce(list_prepend(array_to_string(d, '/'), string_split(source_module, '/')), lambda a, b: CASE WHEN b IN ('.', '') THEN a WHEN b = '..' THEN regexp_replace(a, '/?[^/]*$', '') WHEN a = '' THEN b ELSE a || '/' || b END) END
    WHEN language = 'python' THEN CASE WHEN starts_with(source_module, '.') THEN
      array_to_string(d[1:greatest(len(d) - (dots - 1), 0)] || list_filter(string_split(regexp_replace(source_module, '^\.+', ''), '.'), lambda x: x <> ''), '/') END
    WHEN language = 'rust' AND src_at > 0 THEN CASE parts[1] WHEN 'crate' THEN array_to_string(root || parts[2:], '/') WHEN 'self' THEN array_to_string(root || inner_module || parts[2:], '/')
      WHEN 'super' THEN array_to_string(root || inner_module[1:len(inner_module) - 1] || parts[2:], '/') END END AS stem FROM rm),
  tails AS (SELECT unnest(['script', 'python', 'rust']) AS family, unnest([{list(R.SUFFIXES["script"])}, {list(R.SUFFIXES["python"])}, {list(R.SUFFIXES["rust"])}]) AS t),
  tail AS (SELECT family, unnest(list_prepend('', t)) AS tail, unnest(range(0, len(t) + 1)) AS pos FROM tails),
  best AS (SELECT file_id, local_name, source_module, imported_name, arg_min(f.id, pos) AS target FROM stems
    JOIN tail ON family = CASE WHEN language IN ('python', 'rust') THEN language ELSE 'script' END JOIN f ON f.path = stem || tail WHERE stem IS NOT NULL GROUP BY ALL),
  bind AS (SELECT s.file_id, s.local_name AS name, count(*) AS n, min(best.target) AS target, min(s.imported_name) AS imported FROM stems s LEFT JOIN best USING (file_id, local_name, source_module, imported_name) GROUP BY ALL)
"""
ORACLE |= {
    "import_bindings": f"WITH {_BINDINGS} SELECT * FROM bound",
    "resolve_refs_imports": f"""WITH {_F}, {_REF}, {_SYM}, {_BINDINGS}, {_MODULES},
      here AS (SELECT file_id, name, count(*) AS n, min(id) AS id FROM s GROUP BY file_id, name), anywhere AS (SELECT name, count(*) AS n, min(id) AS id FROM s GROUP BY name)
      SELECT r.id AS ref_id,
        CASE WHEN h.n >= 1 THEN CASE WHEN h.n = 1 THEN h.id END WHEN b.n >= 1 THEN CASE WHEN b.n = 1 AND t.n = 1 THEN t.id END WHEN a.n = 1 THEN a.id END AS resolved_id,
        CASE WHEN h.n >= 1 THEN CASE WHEN h.n = 1 THEN 'high' ELSE 'low' END WHEN b.n >= 1 THEN CASE WHEN b.n = 1 AND t.n = 1 THEN 'high' WHEN b.n = 1 AND b.target IS NOT NULL THEN 'medium' ELSE 'low' END
          WHEN a.n = 1 THEN 'medium' ELSE 'low' END AS confidence,
        CASE WHEN h.n >= 1 THEN 'same_file' WHEN b.n >= 1 THEN 'import' ELSE 'global' END AS tier
      FROM r LEFT JOIN here h ON h.file_id = r.from_file_id AND h.name = r.to_name LEFT JOIN bind b ON b.file_id = r.from_file_id AND b.name = r.to_name
        LEFT JOIN here t ON t.file_id = b.target AND t.name = b.imported LEFT JOIN anywhere a ON a.name = r.to_name""",
}
