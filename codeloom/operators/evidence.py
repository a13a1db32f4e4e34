"""Reports on symbols: callers, related tests, configuration touches, risk and reading lists.

Every report takes a frame of symbol ids and answers all of them in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.model import CONFIDENCES, RISKS, TEST_REASONS, files_now, rank_of, rows_now, text_of
from codeloom.operators.graph import MAX_DEPTH, edges_of, expand

#: Patterns of environment access, in order of preference (fixed values).
ENV_PATTERNS = (
    r"process\.env\.([A-Za-z_][A-Za-z0-9_]*)",
    r"""process\.env\[\s*['"]([A-Za-z_][A-Za-z0-9_]*)['"]\s*\]""",
    r"""os\.environ(?:\.get)?\[\s*['"]([A-Za-z_][A-Za-z0-9_]*)['"]\s*\]""",
    r"""os\.getenv\(\s*['"]([A-Za-z_][A-Za-z0-9_]*)['"]""",
    r"""std::env::var\(\s*"([A-Za-z_][A-Za-z0-9_]*)"\s*\)""",
    r"""os\.Getenv\(\s*"([A-Za-z_][A-Za-z0-9_]*)"\s*\)""",
)


def direct_callers(refs: DataFrame) -> DataFrame:
    """(symbol_id, direct_callers, distinct_callers): reference rows to each symbol, and the
    distinct symbols they come from. Copies of a row count once; counts combine map-side."""
    r = rows_now(refs.where(F.col("to_symbol_id").isNotNull()))
    pairs = r.groupBy("to_symbol_id", "from_symbol_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(F.col("to_symbol_id").alias("symbol_id")).agg(F.sum("n").alias("direct_callers"), F.count("from_symbol_id").alias("distinct_callers"))


def caller_counts(refs: DataFrame, targets: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(symbol_id, direct_callers, indirect_callers) of the target symbols.

    Indirect callers are the other symbols within ``max_depth`` steps beyond the distinct direct
    ones; a symbol that calls itself counts among the direct ones only, as in the reference.
    """
    t = targets.select("symbol_id").distinct()
    nodes = expand(edges_of(refs, reverse=True), t.select(F.col("symbol_id").alias("root")), max_depth)
    far = nodes.groupBy(F.col("root").alias("symbol_id")).agg((F.count(F.lit(1)) - 1).alias("reached"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    own = direct_callers(refs.join(t.withColumnRenamed("symbol_id", "to_symbol_id"), "to_symbol_id", "left_semi"))
    all_of = t.join(own, "symbol_id", "left").join(far, "symbol_id", "left")
    return all_of.select("symbol_id", zero("direct_callers").alias("direct_callers"), F.greatest(F.lit(0), zero("reached") - zero("distinct_callers")).alias("indirect_callers"))


def _test_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_id, path) of the current files, and those among them whose names look like tests."""
    f = files_now(files).select(F.col("id").alias("file_id"), "path")
    return f, f.where(P.looks_like_test(F.col("path")) | P.file_name(F.col("path")).rlike(r"\.test\.|\.spec\.|_test\.|^test_"))


def _top(path: str) -> Column:
    """The repository and the first directory in it."""
    return F.concat(P.repo(F.col(path)), F.lit("/"), P.first_component(P.in_repo(F.col(path))))


def _own_files(targets: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, own): the file of each target symbol."""
    mine = rows_now(symbols).join(targets.select(F.col("symbol_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("symbol_id"), "file_id")
    return mine.join(files, "file_id").select("symbol_id", F.col("path").alias("own"))


def _named_and_used(mine: DataFrame, files: DataFrame, tests: DataFrame, refs: DataFrame) -> DataFrame:
    """(symbol_id, path, reason): tests by name in the same directory, and by resolved references."""
    named = (
        mine.withColumns({"dir": P.parent_dir(F.col("own")), "stem": P.file_stem(F.col("own"))})
        .join(tests.select("path", P.parent_dir(F.col("path")).alias("dir")), "dir")
        .where((F.col("path") != F.col("own")) & P.matches_test_naming(F.col("path"), F.col("stem"))).select("symbol_id", "path", F.lit(1).alias("reason"))
    )
    calls = rows_now(refs.where(F.col("to_symbol_id").isNotNull())).select(F.col("to_symbol_id").alias("symbol_id"), F.col("from_file_id").alias("file_id"))
    like_tests = files.where(P.looks_like_test(P.in_repo(F.col("path"))))
    used = calls.distinct().join(like_tests, "file_id").join(mine.select("symbol_id"), "symbol_id", "left_semi").select("symbol_id", "path", F.lit(2).alias("reason"))
    return named.unionByName(used)


def related_tests(targets: DataFrame, symbols: DataFrame, files: DataFrame, refs: DataFrame) -> DataFrame:
    """(symbol_id, path, reason, confidence): the test files of each target symbol.

    By name in the same directory (medium), by a test directory under the same first directory of
    the repository (medium), or by a resolved reference from a test-like file (high); the
    strongest reason of a file is kept. All three are equality joins.
    """
    f, tests = _test_files(files)
    mine = _own_files(targets, symbols, f)
    in_dirs = f.where(P.in_test_dir(P.in_repo(F.col("path")))).select("path", _top("path").alias("top"))
    placed = mine.withColumn("top", _top("own")).join(in_dirs, "top").where(F.col("path") != F.col("own")).select("symbol_id", "path", F.lit(0).alias("reason"))
    best = placed.unionByName(_named_and_used(mine, f, tests, refs)).groupBy("symbol_id", "path").agg(F.max("reason").alias("reason"))
    return best.select("symbol_id", "path", text_of(TEST_REASONS, F.col("reason")).alias("reason"), F.when(F.col("reason") == 2, "high").otherwise("medium").alias("confidence"))


def test_counts(targets: DataFrame, symbols: DataFrame, files: DataFrame, refs: DataFrame) -> DataFrame:
    """(symbol_id, test_suites): how many test files ``related_tests`` has for each target.

    Tests in test directories are counted per first directory, once for all symbols there; only what
    is named or used beyond them is looked at one by one, so no symbol is paired with all of them.
    """
    f, tests = _test_files(files)
    mine = _own_files(targets, symbols, f).withColumn("top", _top("own"))
    in_dirs = P.in_test_dir(P.in_repo(F.col("path")))
    per_top = f.where(in_dirs).groupBy(_top("path").alias("top")).agg(F.count_distinct("path").alias("there"))
    more = _named_and_used(mine.select("symbol_id", "own"), f, tests, refs).select("symbol_id", "path").distinct().join(mine, "symbol_id")
    more = more.where(~(F.coalesce(in_dirs, F.lit(False)) & (_top("path") == F.col("top")) & (F.col("path") != F.col("own")))).groupBy("symbol_id").agg(F.count(F.lit(1)).alias("more"))
    own = F.coalesce(P.in_test_dir(P.in_repo(F.col("own"))), F.lit(False)).cast("long")
    n = F.coalesce("there", F.lit(0)) - F.when(F.col("there").isNotNull(), own).otherwise(0) + F.coalesce("more", F.lit(0))
    return mine.join(per_top, "top", "left").join(more, "symbol_id", "left").select("symbol_id", n.alias("test_suites"))


def score_risk(counts: DataFrame) -> DataFrame:
    """Adds ``risk`` and ``reasons`` to symbol_id, direct_callers, indirect_callers, is_public, test_suites.

    The ladder: low; at least medium for a public symbol with callers; at least high for five
    direct or fifteen indirect callers; one step up, to critical at most, without tests.
    """
    d, i, n = F.col("direct_callers"), F.col("indirect_callers"), F.col("test_suites")
    public, wide, untested = (d >= 1) & F.coalesce("is_public", F.lit(False)), (d >= 5) | (i >= 15), (n == 0) & (d > 0)
    rank = F.greatest(F.when(public, 1).otherwise(0), F.when(wide, 2).otherwise(0))
    rank = F.least(rank + untested.cast("int"), F.lit(3))
    reasons = F.array_compact(F.array(F.when(public, "public api with callers"), F.when(wide, "wide blast radius"), F.when(untested, "no related tests")))
    return counts.withColumns({"risk": text_of(RISKS, rank), "reasons": reasons})


def blast_radius(targets: DataFrame, symbols: DataFrame, files: DataFrame, refs: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(symbol_id, direct_callers, indirect_callers, is_public, test_suites, risk, reasons) of the targets."""
    suites = test_counts(targets, symbols, files, refs)
    public = rows_now(symbols).select(F.col("id").alias("symbol_id"), F.col("is_exported").alias("is_public"))
    rows = caller_counts(refs, targets, max_depth).join(public, "symbol_id").join(suites, "symbol_id", "left")
    return score_risk(rows.withColumn("test_suites", F.coalesce("test_suites", F.lit(0)).cast("long")))


def reading_list(targets: DataFrame, refs: DataFrame, each: int = 3) -> DataFrame:
    """(symbol_id, section, pos, other_id, ref_id, why): the first callers and callees of each target.

    References count in the order of their ids; of a caller or callee the first one stands for it.
    """
    r = rows_now(refs)
    t = targets.select("symbol_id").distinct()

    def section(me: str, other: str, name: str, why: str) -> DataFrame:
        pairs = r.where(F.col(other).isNotNull()).join(t.withColumnRenamed("symbol_id", me), me, "left_semi")
        first = pairs.groupBy(F.col(me).alias("symbol_id"), F.col(other).alias("other_id")).agg(F.min("id").alias("ref_id"))
        order = Window.partitionBy("symbol_id").orderBy("ref_id")
        top = first.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= each)
        return top.select("symbol_id", F.lit(name).alias("section"), "pos", "other_id", "ref_id", F.lit(why).alias("why"))

    return section("to_symbol_id", "from_symbol_id", "callers", "calls this directly").unionByName(section("from_symbol_id", "to_symbol_id", "callees", "this depends on it"))


def report_confidence(refs: DataFrame) -> DataFrame:
    """(symbol_id, confidence): the worst confidence of the references to each symbol; symbols
    without any have none here, and a report takes medium for them."""
    worst = rows_now(refs.where(F.col("to_symbol_id").isNotNull())).groupBy(F.col("to_symbol_id").alias("symbol_id")).agg(F.max(rank_of(CONFIDENCES, "confidence")).alias("r"))
    return worst.select("symbol_id", text_of(CONFIDENCES, F.coalesce("r", F.lit(1))).alias("confidence"))


def config_touches(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """(symbol_id, key, line): the environment variables that the lines of each symbol read.

    One row per symbol and key; the earlier pattern, then the earlier place decides. A match counts
    by the line on which it starts. Lines are split and matched inside the JVM.
    """
    lines = sources.where(F.col("content").rlike("env|Getenv")).select("file_id", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    hits = lines.select(
        "file_id", (F.col("at") + 1).alias("line"),
        F.explode(F.array_compact(F.flatten(F.array(*[
            F.transform(F.regexp_extract_all("text", F.lit(p), 1), lambda k, i=i: F.struct(F.lit(i).alias("pattern"), k.alias("key"))) for i, p in enumerate(ENV_PATTERNS)
        ])))).alias("m"),
    ).select("file_id", "line", "m.pattern", "m.key")
    s = rows_now(symbols).select(F.col("id").alias("symbol_id"), "file_id", "start_line", "end_line")
    inside = hits.join(s, "file_id").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    return inside.groupBy("symbol_id", "key").agg(F.min_by("line", F.struct("pattern", "line")).alias("line"))
