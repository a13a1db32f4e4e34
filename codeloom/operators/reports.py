"""Reports that bring the single findings together: profile, change report, code evolution, references.

Every report takes a frame of targets and answers all of them in one plan; evidence is a text of
the form ``file:line`` or ``sha: summary``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions.render import evidence_line
from codeloom.model import CONFIDENCES, commits_now, files_now, rank_of, rows_now, text_of
from codeloom.operators import evidence as E
from codeloom.operators import history as H
from codeloom.session import cut

#: Most commits that a profile looks at (fixed value).
PROFILE_HISTORY = 2000
# Texts of the reports (fixed values).
WHY = {"callers": "calls this directly", "callees": "this depends on it", "tests": "covers this behavior"}
PUBLIC = "%d caller(s) depend on this symbol and it is part of the public API (exported) — external code the engine can't see may also rely on its current behavior"
WIDE = "wide blast radius: %d direct caller(s) and %d indirect caller(s) reachable through the call graph"
UNTESTED = "no related test file was found for this symbol, even though it has callers — a change here has no automated safety net"
WARNING = 'commit %s ("%s") touched %d file(s) in the same change and looks like a major refactor of %s — review it before assuming today\'s behavior matches what came before'


def unknown_symbols(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """The ids in ``asked`` (symbol_id) that no symbol has."""
    return asked.where(F.col("symbol_id").isNotNull()).select("symbol_id").distinct().join(symbols.select(F.col("id").alias("symbol_id")), "symbol_id", "left_anti")


def require_symbols(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """``asked`` as it is; an error that names an id where a symbol does not exist."""
    missing = unknown_symbols(asked, symbols).limit(1).collect()
    if missing:
        raise LookupError(f"no symbol has the id {missing[0]['symbol_id']}")
    return asked


def symbol_rows(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """All columns of the symbols, repeated rows once, with the path of their file."""
    f = files_now(files).select(F.col("id").alias("file_id"), "path")
    return rows_now(symbols).join(f, "file_id")


def references(refs: DataFrame, files: DataFrame, me: str) -> DataFrame:
    """(symbol_id, pos, ref_id, path, line, other_id, kind, confidence): the references to (``me`` =
    to_symbol_id) or from (from_symbol_id) each symbol, in the order of their ids."""
    other = "from_symbol_id" if me == "to_symbol_id" else "to_symbol_id"
    f = files_now(files).select(F.col("id").alias("from_file_id"), "path")
    r = rows_now(refs.where(F.col(me).isNotNull())).join(f, "from_file_id")
    return r.select(F.col(me).alias("symbol_id"), F.col("id").alias("ref_id"), "path", F.col("from_start_line").alias("line"), F.col(other).alias("other_id"), "kind", "confidence")


def _first_ids(pairs: DataFrame, each: int) -> DataFrame:
    """(symbol_id, other_id, ref_id, pos): the first references of different others."""
    first = pairs.groupBy("symbol_id", "other_id").agg(F.min("ref_id").alias("ref_id"))
    order = Window.partitionBy("symbol_id").orderBy("ref_id")
    return first.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= each)


def reading_items(targets: DataFrame, symbols: DataFrame, files: DataFrame, refs: DataFrame, tests: DataFrame | None = None, each: int = 3) -> DataFrame:
    """(symbol_id, section, pos, item, why, evidence, confidence): what to read before a change.

    The first callers and callees, each with the reference that shows it, then all related tests by
    path. A caller or callee counts among the first ``each`` even if it is no symbol of the index, but
    is not listed then.
    """
    t = targets.select("symbol_id").distinct()
    r = rows_now(refs)
    names = rows_now(symbols).select(F.col("id").alias("other_id"), F.col("qualified_name").alias("item"))
    f = files_now(files).select(F.col("id").alias("from_file_id"), "path")
    place = r.select(F.col("id").alias("ref_id"), "from_file_id", F.col("from_start_line").alias("line"), "confidence")
    none = F.lit(None).cast("string")

    def section(me: str, other: str, number: int, name: str) -> DataFrame:
        pairs = r.where(F.col(other).isNotNull()).select(F.col(me).alias("symbol_id"), F.col(other).alias("other_id"), F.col("id").alias("ref_id")).join(t, "symbol_id", "left_semi")
        first = _first_ids(pairs, each).join(names, "other_id").join(place, "ref_id").join(f, "from_file_id")
        shown = evidence_line(F.lit("reference"), F.col("path"), F.col("line"), none, none, none)
        return first.select("symbol_id", F.lit(number).alias("section"), "pos", "item", F.lit(WHY[name]).alias("why"), shown.alias("evidence"), "confidence")

    tests = E.related_tests(t, symbols, files, refs) if tests is None else tests
    by_path = Window.partitionBy("symbol_id").orderBy("path")
    covered = tests.select("symbol_id", F.lit(3).alias("section"), F.row_number().over(by_path).alias("pos"), F.col("path").alias("item"), F.lit(WHY["tests"]).alias("why"), F.col("path").alias("evidence"), "confidence")
    parts = [section("to_symbol_id", "from_symbol_id", 1, "callers"), section("from_symbol_id", "to_symbol_id", 2, "callees"), covered]
    return reduce(DataFrame.unionByName, parts)


def _history_of(targets: DataFrame, symbols: DataFrame, files: DataFrame, deltas: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbol_id, path) of the targets, and the rename-following walks of these paths."""
    f = files_now(files).select(F.col("id").alias("file_id"), "path")
    own = rows_now(symbols).select(F.col("id").alias("symbol_id"), "file_id").join(targets.select("symbol_id").distinct(), "symbol_id", "left_semi").join(f, "file_id").select("symbol_id", "path")
    return own, H.tracked_walk(deltas, commits, own.select(F.col("path").alias("target")).distinct())


def historical_warnings(targets: DataFrame, symbols: DataFrame, files: DataFrame, deltas: DataFrame, commits: DataFrame) -> DataFrame:
    """(symbol_id, sha, seq, text): the major refactors in the history of each target's file."""
    return _warnings(*_history_of(targets, symbols, files, deltas, commits), commits)


def _warnings(own: DataFrame, walk: DataFrame, commits: DataFrame) -> DataFrame:
    major = H.major_refactors(commits).select("sha", "summary", "files_changed")
    said = walk.select(F.col("target").alias("path"), "sha", "seq").join(major, "sha").join(own, "path")
    text = F.format_string(WARNING, P.short_sha(F.col("sha")), F.coalesce("summary", F.lit("")), "files_changed", "path")
    return said.select("symbol_id", "sha", "seq", text.alias("text"))


def risk_reasons(counts: DataFrame, refs: DataFrame, files: DataFrame, sample: int = 3) -> DataFrame:
    """(symbol_id, pos, text, evidence): why a symbol has its risk; ``counts`` as ``score_risk`` takes
    them. The first references to the symbol are the evidence of all reasons but the missing tests."""
    d, i, n = F.col("direct_callers"), F.col("indirect_callers"), F.col("test_suites")
    reason = lambda pos, when, text, cited: F.when(when, F.struct(F.lit(pos).alias("pos"), text.alias("text"), F.lit(cited).alias("cited")))
    found = F.array_compact(F.array(
        reason(1, (d >= 1) & F.coalesce("is_public", F.lit(False)), F.format_string(PUBLIC, d), True),
        reason(2, (d >= 5) | (i >= 15), F.format_string(WIDE, d, i), True),
        reason(3, (n == 0) & (d > 0), F.lit(UNTESTED), False),
    ))
    rows = counts.select("symbol_id", F.explode(found).alias("r")).select("symbol_id", "r.*")
    to = rows_now(refs.where(F.col("to_symbol_id").isNotNull())).select(F.col("to_symbol_id").alias("symbol_id"), F.col("id").alias("ref_id"), "from_file_id", F.col("from_start_line").alias("line"))
    to = to.join(counts.select("symbol_id"), "symbol_id", "left_semi")
    order = Window.partitionBy("symbol_id").orderBy("ref_id")
    first = to.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).join(files_now(files).select(F.col("id").alias("from_file_id"), "path"), "from_file_id")
    shown = F.concat_ws("; ", F.transform(F.sort_array(F.collect_list(F.struct("n", F.concat("path", F.lit(":"), F.col("line").cast("string")).alias("at")))), lambda x: x["at"]))
    cited = first.groupBy("symbol_id").agg(shown.alias("evidence"))
    return rows.join(cited, "symbol_id", "left").select("symbol_id", "pos", "text", F.when(F.col("cited"), F.col("evidence")).alias("evidence"))


def _confidence(items: DataFrame, warned: DataFrame) -> DataFrame:
    """(symbol_id, n_callers, n_callees, n_tests, n_warnings, rank of the confidence) of the targets that have any."""
    count = lambda k, name: F.count(F.when(F.col("section") == k, 1)).alias(name)
    read = items.groupBy("symbol_id").agg(count(1, "n_callers"), count(2, "n_callees"), count(3, "n_tests"), F.max(rank_of(CONFIDENCES, "confidence")).alias("worst"))
    majors = warned.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n_warnings"))
    rows = read.join(majors, "symbol_id", "full")
    return rows.withColumn("rank", F.greatest("worst", F.when(F.col("n_warnings") > 0, 1))).drop("worst")


def change_reports(targets: DataFrame, symbols: DataFrame, files: DataFrame, refs: DataFrame, deltas: DataFrame, commits: DataFrame) -> DataFrame:
    """(symbol_id, qualified_name, n_callers, n_callees, n_tests, n_warnings, risk, confidence): one report per target.

    Its confidence is the worst among the cited references, the related tests and, where the
    history holds major refactors, medium; medium also where nothing is cited.
    """
    found = _confidence(reading_items(targets, symbols, files, refs), historical_warnings(targets, symbols, files, deltas, commits))
    risk = E.blast_radius(targets, symbols, files, refs).select("symbol_id", "risk")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    all_of = rows_now(symbols).select(F.col("id").alias("symbol_id"), "qualified_name").join(risk, "symbol_id").join(found, "symbol_id", "left")
    confidence = text_of(CONFIDENCES, F.coalesce("rank", F.lit(1))).alias("confidence")
    return all_of.select("symbol_id", "qualified_name", zero("n_callers"), zero("n_callees"), zero("n_tests"), zero("n_warnings"), "risk", confidence)


def symbol_profiles(targets: DataFrame, symbols: DataFrame, files: DataFrame, refs: DataFrame, deltas: DataFrame, commits: DataFrame, sources: DataFrame, limit: int | None = PROFILE_HISTORY) -> DataFrame:
    """(symbol_id, qualified_name, path, direct_callers, indirect_callers, tests, config_keys, introduced,
    modification_count): tests and config keys are sorted texts; the commit that introduced the file is
    null where the history was cut at the limit."""
    own, walk = _history_of(targets, symbols, files, deltas, commits)
    past = H.introduced(walk, limit).withColumnRenamed("target", "path")
    tests = E.related_tests(targets, symbols, files, refs).groupBy("symbol_id").agg(F.concat_ws(",", F.sort_array(F.collect_list("path"))).alias("tests"))
    keys = E.config_touches(symbols, sources).groupBy("symbol_id").agg(F.concat_ws(",", F.sort_array(F.collect_list("key"))).alias("config_keys"))
    names = rows_now(symbols).select(F.col("id").alias("symbol_id"), "qualified_name")
    rows = own.join(names, "symbol_id").join(E.caller_counts(refs, targets), "symbol_id").join(tests, "symbol_id", "left").join(keys, "symbol_id", "left").join(past, "path", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(
        "symbol_id", "qualified_name", "path", "direct_callers", "indirect_callers", text("tests"), text("config_keys"), "introduced", F.coalesce("modification_count", F.lit(0)).cast("long").alias("modification_count"),
    )


def code_evolution(paths: DataFrame, deltas: DataFrame, commits: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, introduced, n_commits, n_major, authors, confidence) of each path, over walks that follow
    renames; authors are in the order of their newest commit. A path without commits has low confidence."""
    walk = H.limit_history(H.tracked_walk(deltas, commits, paths.select(F.col("path").alias("target")).distinct()), limit)
    c = commits_now(commits).select("sha", "author_name", P.is_major_refactor(F.col("files_changed"), F.col("summary")).alias("major"))
    walk = walk.select(F.col("target").alias("path"), "sha", "seq").join(c, "sha")
    past = walk.groupBy("path").agg(F.max_by("sha", "seq").alias("introduced"), F.count(F.lit(1)).alias("n_commits"), F.count(F.when(F.col("major"), 1)).alias("n_major"))
    authors = H.authors_in_order(walk).select("path", F.concat_ws(",", "authors").alias("authors"))
    rows = paths.select("path").distinct().join(past, "path", "left").join(authors, "path", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("path", "introduced", zero("n_commits"), zero("n_major"), F.coalesce("authors", F.lit("")).alias("authors"), F.when(F.col("n_commits") > 0, "medium").otherwise("low").alias("confidence"))


def ranked_coupling(coupling: DataFrame) -> DataFrame:
    """Coupling rows with ``pos``: of each path the strongest ratio first, ties by file."""
    order: Column = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("ratio"), "file"))
    return coupling.withColumn("pos", order)


def files_changed(deltas: DataFrame) -> DataFrame:
    """(sha, files_changed): the number of different deltas of each commit."""
    return H.deltas_now(deltas).where(F.col("sha").isNotNull()).groupBy("sha").agg(F.count(F.lit(1)).alias("files_changed"))


def current_warnings(parse_results: DataFrame, files: DataFrame, most: int = 25) -> DataFrame:
    """(file_id, pos, warning): at most ``most`` warnings of each file's present content."""
    f = files_now(files).select(F.col("id").alias("file_id"), F.col("content_hash").alias("parsed_hash"))
    rows = parse_results.select("file_id", "parsed_hash", F.slice("warnings", 1, most).alias("w")).join(f, ["file_id", "parsed_hash"]).distinct()
    return rows.select("file_id", F.posexplode("w").alias("pos", "warning")).withColumn("pos", F.col("pos") + 1)


def contexts(targets: DataFrame, symbols: DataFrame, files: DataFrame, refs: DataFrame, deltas: DataFrame, commits: DataFrame, sources: DataFrame, limit: int | None = PROFILE_HISTORY) -> DataFrame:
    """One row per target with its profile and its change report, nested: what an export holds.

    Columns: those of ``symbol_profiles``, kind, line, signature, doc_comment, introduced_summary,
    reading (array of item, why, evidence), risk, reasons (array of text), is_public, test_suites,
    warnings (array of text), confidence.
    """
    # Each finding is used more than once, so it is computed once.
    tests = cut(E.related_tests(targets, symbols, files, refs))
    blast = cut(E.blast_radius(targets, symbols, files, refs))
    items = cut(reading_items(targets, symbols, files, refs, tests))
    paths, walk = _history_of(targets, symbols, files, deltas, commits)
    paths, walk = cut(paths), cut(walk)
    warned = cut(_warnings(paths, walk, commits))
    keys = E.config_touches(symbols.join(targets.select(F.col("symbol_id").alias("id")).distinct(), "id", "left_semi"), sources)
    joined = lambda df, c, name: df.groupBy("symbol_id").agg(F.concat_ws(",", F.sort_array(F.collect_list(c))).alias(name))
    listed = lambda df, order, what: df.groupBy("symbol_id").agg(F.sort_array(F.collect_list(F.struct(*order, *what))).alias("a"))
    reading = listed(items, ["section", "pos"], ["item", "why", "evidence"]).select("symbol_id", F.transform("a", lambda x: F.struct(x["item"].alias("item"), x["why"].alias("why"), x["evidence"].alias("evidence"))).alias("reading"))
    why = listed(risk_reasons(blast, refs, files), ["pos"], ["text"]).select("symbol_id", F.col("a.text").alias("reasons"))
    said = listed(warned, ["seq"], ["text"]).select("symbol_id", F.col("a.text").alias("warnings"))
    first = commits_now(commits).select(F.col("sha").alias("introduced"), F.col("summary").alias("introduced_summary"))
    own = rows_now(symbols).select(F.col("id").alias("symbol_id"), "qualified_name", "kind", F.col("start_line").alias("line"), "signature", "doc_comment")
    rows = paths.join(own, "symbol_id").join(blast.select("symbol_id", "direct_callers", "indirect_callers", "risk", "is_public", "test_suites"), "symbol_id")
    rows = rows.join(H.introduced(walk, limit).withColumnRenamed("target", "path"), "path", "left").join(first, "introduced", "left")
    for part in (joined(tests, "path", "tests"), joined(keys, "key", "config_keys"), reading, why, said, _confidence(items, warned).select("symbol_id", "rank")):
        rows = rows.join(part, "symbol_id", "left")
    none = F.array().cast("array<string>")
    return rows.withColumns({
        "tests": F.coalesce("tests", F.lit("")), "config_keys": F.coalesce("config_keys", F.lit("")), "reasons": F.coalesce("reasons", none), "warnings": F.coalesce("warnings", none),
        "modification_count": F.coalesce("modification_count", F.lit(0)).cast("long"), "confidence": text_of(CONFIDENCES, F.coalesce("rank", F.lit(1))),
    }).drop("rank")
