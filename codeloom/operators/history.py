"""Commit history of files: touched paths, rename-following walks, coupling and authors.

``seq`` 1 is the newest commit of a repository; a walk goes from newer to older commits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.paths import is_major_refactor, normalize, repo
from codeloom.model import commits_now
from codeloom.session import cut


def deltas_now(deltas: DataFrame) -> DataFrame:
    """Distinct deltas with normalised paths: sha, status, old_path, new_path, path (the touched one)."""
    d = deltas.select("sha", "status", normalize(F.col("old_path")).alias("old_path"), normalize(F.col("new_path")).alias("new_path")).distinct()
    return d.withColumn("path", F.coalesce("new_path", "old_path")).where(F.col("path").isNotNull())


def file_commits(deltas: DataFrame, commits: DataFrame) -> DataFrame:
    """(path, sha, seq, commit_ts, author_name, summary, files_changed): who touched each path, without renames."""
    c = commits_now(commits).select("sha", "seq", "commit_ts", "author_name", "summary", "files_changed")
    return deltas_now(deltas).select("path", "sha").distinct().join(c, "sha")


def tracked_walk(deltas: DataFrame, commits: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(target, sha, seq, tracked_path, renamed): each target's history across renames.

    A commit belongs to the walk if a delta has the tracked path on either side. A rename to it
    goes on with the old path below that commit; the commit that added it ends the walk; a
    deletion does not. One join per rename level, not per commit: a segment (target, path, from
    seq) ends at its newest rename or addition.
    """
    c = commits_now(commits).select("sha", "seq")
    d = cut(deltas_now(deltas).join(c, "sha").withColumn("repo", repo(F.col("path"))))
    ends = d.where(F.col("status").isin("renamed", "added") & F.col("new_path").isNotNull()).select(
        F.col("new_path").alias("path"), F.col("seq").alias("end_seq"), F.when(F.col("status") == "renamed", F.col("old_path")).alias("next_path")
    )
    if targets is None:
        targets = d.select(F.col("path").alias("target")).distinct()
    todo = targets.select("target", F.col("target").alias("path"), F.lit(0).alias("above"), F.lit(False).alias("renamed"))
    segments: list[DataFrame] = []
    while True:
        end = (
            todo.join(ends, "path").where(F.col("end_seq") > F.col("above"))
            .groupBy("target", "path", "above").agg(F.min(F.struct("end_seq", F.col("next_path").isNull().alias("stops"), "next_path")).alias("e"))
        )
        segment = cut(todo.join(end, ["target", "path", "above"], "left").select("target", "path", "above", "renamed", F.col("e.end_seq").alias("end_seq"), F.col("e.next_path").alias("next_path")))
        segments.append(segment)
        todo = segment.where(F.col("next_path").isNotNull()).select("target", F.col("next_path").alias("path"), F.col("end_seq").alias("above"), F.lit(True).alias("renamed"))
        if todo.isEmpty():
            break
    all_segments = reduce(DataFrame.unionByName, segments)
    sides = d.select("sha", "seq", F.explode(F.array_distinct(F.array_compact(F.array("old_path", "new_path")))).alias("path")).distinct()
    inside = (F.col("seq") > F.col("above")) & (F.col("end_seq").isNull() | (F.col("seq") <= F.col("end_seq")))
    walk = all_segments.join(sides, "path").where(inside)
    return walk.groupBy("target", "sha", "seq").agg(F.max_by("path", "above").alias("tracked_path"), F.max("renamed").alias("renamed"))


def limit_history(walk: DataFrame, limit: int | None) -> DataFrame:
    """The newest ``limit`` commits of each target; None keeps all."""
    if limit is None:
        return walk
    order = Window.partitionBy("target").orderBy("seq")
    return walk.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def introduced(walk: DataFrame, limit: int | None = None) -> DataFrame:
    """(target, modification_count, introduced): the oldest commit of a walk, null where the limit
    was reached, since older commits may exist."""
    g = limit_history(walk, limit).groupBy("target").agg(F.count(F.lit(1)).alias("modification_count"), F.max_by("sha", "seq").alias("introduced"))
    return g if limit is None else g.withColumn("introduced", F.when(F.col("modification_count") < limit, F.col("introduced")))


def authors_in_order(commits_of: DataFrame) -> DataFrame:
    """(path, authors): the distinct authors of each path, newest first appearance first."""
    first = commits_of.where(F.col("author_name").isNotNull()).groupBy("path", "author_name").agg(F.min("seq").alias("pos"))
    ordered = first.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("pos", "author_name"))).alias("a"))
    return ordered.select("path", F.col("a.author_name").alias("authors"))


def major_refactors(commits: DataFrame) -> DataFrame:
    return commits_now(commits).where(is_major_refactor(F.col("files_changed"), F.col("summary")))


def coupling_of(deltas: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, file, co_change_count, total_commits_either_file, ratio) of each target path with all
    files that share a commit with it; the number of pairs follows the targets, not all files."""
    t = deltas_now(deltas).select("sha", "path").distinct()
    total = t.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    a = t.join(targets.select("path").distinct(), "path", "left_semi")
    both = a.join(t.select("sha", F.col("path").alias("file")), "sha").where(F.col("path") != F.col("file")).groupBy("path", "file").agg(F.count(F.lit(1)).alias("co"))
    both = both.join(total, "path").join(total.select(F.col("path").alias("file"), F.col("n").alias("m")), "file")
    either = F.greatest(F.col("n") + F.col("m") - F.col("co"), F.lit(0))
    return both.select(
        "path", "file", F.col("co").alias("co_change_count"), either.alias("total_commits_either_file"),
        F.when(either > 0, F.col("co") / either).otherwise(F.lit(0.0)).cast("float").alias("ratio"),
    )


def tracked_coupling(deltas: DataFrame, commits: DataFrame, targets: DataFrame) -> DataFrame:
    """As ``coupling_of``, over walks that follow renames: of each target's walk the commits that touch
    another file under a name, and the walk of that name as the other file's total."""
    walk = cut(tracked_walk(deltas, commits))
    total = walk.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    a = walk.join(targets.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    own = F.col("new_path").eqNullSafe(F.col("tracked_path")) | F.col("old_path").eqNullSafe(F.col("tracked_path"))
    others = a.join(deltas_now(deltas).select("sha", "old_path", "new_path", F.col("path").alias("file")), "sha").where(~own)
    both = others.select("target", "file", "sha").distinct().groupBy("target", "file").agg(F.count(F.lit(1)).alias("co"))
    both = both.join(total, "target").join(total.select(F.col("target").alias("file"), F.col("n").alias("m")), "file")
    either = F.greatest(F.col("n") + F.col("m") - F.col("co"), F.lit(0))
    return both.select(
        F.col("target").alias("path"), "file", F.col("co").alias("co_change_count"), either.alias("total_commits_either_file"),
        F.when(either > 0, F.col("co") / either).otherwise(F.lit(0.0)).cast("float").alias("ratio"),
    )


def symbol_history(walk: DataFrame, hunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(target, sha, seq, confidence): the commits of a walk that touch a span of lines.

    ``hunks``: sha, path, old_start, old_lines, new_start, new_lines; ``spans``: target,
    start_line, end_line. Commits above the first rename must have a hunk that overlaps the span
    (closed intervals of the new side, or of the old side for pure deletions); below a rename lines
    are not mapped, so every commit stays and the confidence of the walk is low.
    """
    w = walk.join(spans, "target")
    start = F.when(F.col("new_lines") > 0, F.col("new_start")).otherwise(F.col("old_start"))
    lines = F.when(F.col("new_lines") > 0, F.col("new_lines")).otherwise(F.col("old_lines"))
    h = hunks.select("sha", F.col("path").alias("tracked_path"), start.alias("s"), (start + F.greatest(lines, F.lit(1)) - 1).alias("e"))
    touched = w.where(~F.col("renamed")).join(h, ["sha", "tracked_path"]).where((F.col("s") <= F.col("end_line")) & (F.col("start_line") <= F.col("e")))
    rows = touched.select("target", "sha", "seq").distinct().unionByName(w.where("renamed").select("target", "sha", "seq"))
    sure = walk.groupBy("target").agg(F.max("renamed").alias("r")).select("target", F.when(F.col("r"), "low").otherwise("high").alias("confidence"))
    return rows.join(sure, "target")
