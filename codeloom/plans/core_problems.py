"""Queries of the general data problems: skewed keys (p3) and hierarchies (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.hierarchy import descendants, dropped_links, extends_edges, extends_links, resolve_hierarchy
from codeloom.operators.tree_agg import hot_keys, reference_key_stats
from codeloom.session import cut, table


def _links(spark: SparkSession, d: str) -> DataFrame:
    return cut(extends_links(table(spark, d, "refs"), table(spark, d, "graph_edges")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys(table(spark, d, "refs"))


def p3_per_key(spark: SparkSession, d: str) -> DataFrame:
    return reference_key_stats(table(spark, d, "refs"))[0]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return resolve_hierarchy(_links(spark, d))


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    r = resolve_hierarchy(_links(spark, d), with_path=True)
    return r.where(F.col("depth") >= 0).select("symbol_id", "root_id", "depth", F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(resolve_hierarchy(_links(spark, d), with_path=True).where(F.col("depth") >= 0))


def p4_descendants_all(spark: SparkSession, d: str) -> DataFrame:
    """As ``p4_descendants``, with the symbols on loops and below them."""
    return descendants(resolve_hierarchy(_links(spark, d), with_path=True))


def p4_loops(spark: SparkSession, d: str) -> DataFrame:
    """(loop_id, symbol_id): the members of every loop; the loop is named by its smallest member."""
    r = resolve_hierarchy(_links(spark, d), with_path=True).where(F.col("loop").isNotNull())
    return r.select(F.array_min("loop").alias("loop_id"), F.explode("loop").alias("symbol_id"))


def p4_dropped_links(spark: SparkSession, d: str) -> DataFrame:
    """(child, parent): links of a child beyond the one that counts."""
    return dropped_links(extends_edges(table(spark, d, "refs"), table(spark, d, "graph_edges")), "c", "p")


QUERIES = {
    "p3_found": p3_found,
    "p3_per_key": p3_per_key,
    "p4_found": p4_found,
    "p4_paths": p4_paths,
    "p4_descendants": p4_descendants,
    "p4_descendants_all": p4_descendants_all,
    "p4_loops": p4_loops,
    "p4_dropped_links": p4_dropped_links,
}

_KEYED = """
  SELECT 'to_name' AS field, to_name AS key_value, id, from_file_id, kind FROM refs
  UNION ALL
  SELECT 'to_symbol_id', CAST(to_symbol_id AS VARCHAR), id, from_file_id, kind FROM refs
"""
_LINKS = """
  links AS (
    SELECT child, min(parent) AS parent FROM (
      SELECT from_symbol_id AS child, to_symbol_id AS parent FROM refs WHERE kind = 'extends'
      UNION ALL
      SELECT from_id, to_id FROM graph_edges WHERE ref_kind = 'extends')
    WHERE child IS NOT NULL AND parent IS NOT NULL GROUP BY child),
  walk AS (
    SELECT l.child AS symbol_id, l.parent AS root_id, CAST(1 AS BIGINT) AS depth,
           l.child || '>' || l.parent AS path
    FROM links l WHERE l.parent NOT IN (SELECT child FROM links)
    UNION ALL
    SELECT l.child, w.root_id, w.depth + 1, l.child || '>' || w.path
    FROM links l JOIN walk w ON l.parent = w.symbol_id)
"""

ORACLE = {
    "p3_found": f"""
      SELECT field, key_value FROM ({_KEYED}) WHERE key_value IS NOT NULL
      GROUP BY field, key_value HAVING count(*) >= 0.01 * (SELECT count(*) FROM refs)""",
    "p3_per_key": f"""
      SELECT field, key_value, count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(DISTINCT from_file_id) AS n_files,
        {", ".join(f"count(*) FILTER (kind = '{k}') AS rows_{k}" for k in ("call", "import", "extends", "implements", "instantiation", "type_usage"))},
        count(*) FILTER (kind IS NULL OR kind NOT IN ('call','import','extends','implements','instantiation','type_usage')) AS rows_other
      FROM ({_KEYED}) GROUP BY field, key_value""",
    "p4_found": f"""
      WITH RECURSIVE {_LINKS}
      SELECT l.child AS symbol_id, coalesce(w.root_id, -1) AS root_id, coalesce(w.depth, -1) AS depth
      FROM links l LEFT JOIN walk w ON w.symbol_id = l.child""",
    "p4_paths": f"WITH RECURSIVE {_LINKS} SELECT symbol_id, root_id, depth, path FROM walk",
    "p4_descendants": f"""
      WITH RECURSIVE {_LINKS},
      up AS (
        SELECT child AS descendant_id, parent AS ancestor_id, CAST(1 AS BIGINT) AS distance FROM links WHERE child IN (SELECT symbol_id FROM walk)
        UNION ALL
        SELECT u.descendant_id, l.parent, u.distance + 1 FROM up u JOIN links l ON l.child = u.ancestor_id)
      SELECT ancestor_id, descendant_id, distance FROM up""",
    "p4_descendants_all": f"""
      WITH RECURSIVE {_LINKS},
      up AS (
        SELECT child AS descendant_id, parent AS ancestor_id, CAST(1 AS BIGINT) AS distance, [child, parent] AS seen FROM links WHERE child <> parent
        UNION ALL
        SELECT u.descendant_id, l.parent, u.distance + 1, list_append(u.seen, l.parent)
        FROM up u JOIN links l ON l.child = u.ancestor_id WHERE NOT list_contains(u.seen, l.parent))
      SELECT ancestor_id, descendant_id, distance FROM up""",
    "p4_loops": f"""
      WITH RECURSIVE {_LINKS},
      endless AS (SELECT child, parent FROM links WHERE child NOT IN (SELECT symbol_id FROM walk)),
      trip AS (
        SELECT child AS start, parent AS met, 1 AS n FROM endless
        UNION ALL
        SELECT t.start, e.parent, t.n + 1 FROM trip t JOIN endless e ON e.child = t.met WHERE t.met <> t.start AND t.n <= (SELECT count(*) FROM endless))
      SELECT min(met) AS loop_id, start AS symbol_id FROM trip GROUP BY start HAVING bool_or(met = start)""",
    "p4_dropped_links": """
      WITH e AS (SELECT from_symbol_id AS child, to_symbol_id AS parent FROM refs WHERE kind = 'extends' UNION SELECT from_id, to_id FROM graph_edges WHERE ref_kind = 'extends')
      SELECT child, parent FROM e WHERE child IS NOT NULL AND parent IS NOT NULL QUALIFY parent <> min(parent) OVER (PARTITION BY child)""",
}
