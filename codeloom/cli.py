"""Command line over a folder of index tables, and the making of that folder.

``analyze`` walks a repository and writes the tables; the other commands read them. Commands about
history need the tables of commits and deltas in the same folder.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.render import as_json, export_bundle, export_context
from codeloom.operators import evidence, graph, history, indexer, reports, search
from codeloom.session import ship_code, table
from codeloom.sources.config import load_config
from codeloom.sources.repo_files import scan_repository

COMMANDS = ("search", "symbol", "callers", "callees", "impact", "before", "explain", "tests", "reading-list", "history", "evolution")


def analyze(spark: SparkSession, root: str, out: str, before: str | None = None) -> DataFrame:
    """Index the repository under ``root`` into the new folder ``out``; ``before`` is the folder of the
    index that it continues. Gives the summary. Settings come from ``.codeloom/config.toml``."""
    ship_code(spark)
    config = load_config(os.path.join(root, ".codeloom", "config.toml"))
    stored = {name: spark.read.parquet(f"{before}/{name}.parquet") if before else spark.createDataFrame([], schema) for name, schema in indexer.SCHEMAS.items()}
    tables, summary = indexer.reindex(stored, scan_repository(spark, root, config), config)
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{out}/{name}.parquet")
    return summary


def answer(spark: SparkSession, tables: str, command: str, target: str, depth: int = graph.MAX_DEPTH, form: str = "json") -> DataFrame:
    """The rows of one command; symbol targets are resolved to the best search hit."""
    t = lambda n: table(spark, tables, n)
    if command == "search":
        return search.search_symbols(t("symbols"), t("files"), target)
    if command == "history":
        return history.tracked_walk(t("deltas"), t("commits"), spark.createDataFrame([(target,)], "target string")).orderBy("seq")
    if command == "evolution":
        return reports.code_evolution(spark.createDataFrame([(target,)], "path string"), t("deltas"), t("commits"))
    best = search.search_symbols(t("symbols"), t("files"), target, 1).select(F.col("id").alias("symbol_id"))
    if best.isEmpty():
        raise LookupError(f"no symbol matches {target}")
    if command == "symbol":
        return reports.symbol_rows(t("symbols").join(best.withColumnRenamed("symbol_id", "id"), "id", "left_semi"), t("files"))
    if command in ("callers", "callees"):
        return graph.expand(graph.edges_of(t("refs"), command == "callers"), best.withColumnRenamed("symbol_id", "root"), depth)
    if command == "tests":
        return evidence.related_tests(best, t("symbols"), t("files"), t("refs")).orderBy("path")
    if command == "reading-list":
        return evidence.reading_list(best, t("refs"))
    if command == "impact":
        return export_context(evidence.blast_radius(best, t("symbols"), t("files"), t("refs"), depth), form)
    if command in ("before", "explain"):
        found = reports.contexts(best, *(t(n) for n in ("symbols", "files", "refs", "deltas", "commits", "sources")))
        return export_bundle(found, "text" if command == "before" and form == "json" else form)
    raise ValueError(f"unknown command {command}")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="codeloom", description=__doc__)
    parser.add_argument("tables", help="folder with the Parquet tables of an index (for analyze: the new one)")
    parser.add_argument("command", choices=["analyze", *COMMANDS])
    parser.add_argument("target", help="a symbol's name, a path for history and evolution, or a repository for analyze")
    parser.add_argument("--depth", type=int, default=graph.MAX_DEPTH)
    parser.add_argument("--form", choices=["json", "md", "text"], default="json", help="form of a report")
    parser.add_argument("--continues", help="for analyze: the folder of the index before")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("codeloom").getOrCreate()
    if args.command == "analyze":
        rows = analyze(spark, args.target, args.tables, args.continues)
    else:
        rows = answer(spark, args.tables, args.command, args.target, args.depth, args.form)
    out = rows if rows.columns in (["json"], ["symbol_id", "markdown"], ["symbol_id", "text"]) else as_json(rows, pretty=False)
    for r in out.toLocalIterator():
        print(r[-1])


if __name__ == "__main__":
    main()
