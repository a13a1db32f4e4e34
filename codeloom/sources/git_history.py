"""The first-parent history of a git repository: commits, deltas and hunks as DataFrames.

The driver asks only how many commits there are. Every task runs ``git log`` over its own stretch of
them and turns the output into rows, so no history passes the driver; all executors must see the
repository. Merges are compared with their first parent, the first commit with the empty tree, and
renames are detected.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import ship_code
from codeloom.sources.repo_files import open_repository

COMMITS = "sha string, author_name string, author_email string, summary string, commit_ts long, files_changed int, seq int"
DELTAS = "sha string, status string, old_path string, new_path string"
HUNKS = "sha string, path string, old_start int, old_lines int, new_start int, new_lines int"
#: Commits of one stretch.
STRETCH = 500
_LOG = ["log", "--first-parent", "--diff-merges=first-parent", "--root", "-M", "--no-color", "--no-ext-diff", "--format=%x01%H%x00%an%x00%ae%x00%ct%x00%s%x00"]
_STATUS = {"A": "added", "D": "deleted", "M": "modified", "T": "modified", "R": "renamed", "C": "added"}
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", re.M)


class NotARepository(ValueError):
    """The folder holds no git repository."""


def _git(root: str, *args: str) -> str:
    run = subprocess.run(["git", "-c", "core.quotePath=off", "-C", root, *args], capture_output=True)
    if run.returncode:
        raise NotARepository(f"{root}: {run.stderr.decode(errors='replace').strip()}")
    return run.stdout.decode("utf-8", "replace")


def count_commits(root: str) -> int:
    """The commits of the first-parent history; 0 for a repository without commits."""
    _git(root, "rev-parse", "--git-dir")
    return int(_git(root, "rev-list", "--first-parent", "--count", "HEAD")) if _has_head(root) else 0


def _has_head(root: str) -> bool:
    return subprocess.run(["git", "-C", root, "rev-parse", "--verify", "-q", "HEAD"], capture_output=True).returncode == 0


def _blocks(out: str) -> Iterator[tuple[list[str], str]]:
    """(sha, author, mail, time, summary) and the rest of each commit in the output of ``git log``."""
    for block in out.split("\x01")[1:]:
        *head, rest = block.split("\x00", 5)
        yield head, rest


def deltas_of(rest: str) -> list[tuple[str, str | None, str | None]]:
    """(status, old path, new path) from the output of ``--name-status -z`` for one commit."""
    words = [w for w in rest.strip("\n").split("\x00") if w.strip("\n")]
    out, i = [], 0
    while i < len(words):
        letter = words[i].strip("\n")[:1]
        if letter in "RC" and i + 2 < len(words):
            out.append((_STATUS[letter], words[i + 1] if letter == "R" else None, words[i + 2]))
            i += 3
        else:
            path = words[i + 1] if i + 1 < len(words) else ""
            out.append((_STATUS.get(letter, "modified"), None if letter == "A" else path, None if letter == "D" else path))
            i += 2
    return out


def hunks_of(rest: str) -> list[tuple[str, int, int, int, int]]:
    """(path, old start, old lines, new start, new lines) from a patch without context."""
    out = []
    for piece in re.split(r"(?m)^diff --git ", rest)[1:]:
        header, _, _ = piece.partition("\n@@ ")
        names = re.findall(r"(?m)^(?:---|\+\+\+) (?:[ab]/)?(.*?)\t?$", header)
        path = next((n for n in reversed(names) if n != "/dev/null"), None)
        if path is not None:
            out += [(path, *(int(n) if n is not None else 1 for n in m.groups())) for m in _HUNK.finditer(piece)]
    return out


def _stretches(spark: SparkSession, root: str) -> DataFrame:
    n = -(-count_commits(root) // STRETCH)
    return spark.range(0, n, 1, max(1, min(n, 10_000))).select((F.col("id") * STRETCH).alias("skip"))


def _rows(spark: SparkSession, root: str, schema: str, options: list[str], make) -> DataFrame:
    root = open_repository(root)
    ship_code(spark)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for skip in pdf["skip"]:
                out = _git(root, *_LOG, *options, f"--skip={skip}", f"--max-count={STRETCH}", "HEAD")
                yield pd.DataFrame([row for i, (head, rest) in enumerate(_blocks(out)) for row in make(int(skip) + i + 1, head, rest)], columns=names)

    return _stretches(spark, root).mapInPandas(run, schema)


def git_commits(spark: SparkSession, root: str) -> DataFrame:
    """The columns of COMMITS; ``seq`` 1 is the newest commit, files_changed the number of its deltas."""
    return _rows(spark, root, COMMITS, ["--name-status", "-z"], lambda seq, h, rest: [(h[0], h[1], h[2], h[4], int(h[3]), len(deltas_of(rest)), seq)])


def git_deltas(spark: SparkSession, root: str) -> DataFrame:
    """The columns of DELTAS; an added file has no old path, a deleted one no new path."""
    return _rows(spark, root, DELTAS, ["--name-status", "-z"], lambda seq, h, rest: [(h[0], *d) for d in deltas_of(rest)])


def git_hunks(spark: SparkSession, root: str) -> DataFrame:
    """The columns of HUNKS: the changed lines of each file of each commit, without context."""
    return _rows(spark, root, HUNKS, ["-p", "-U0"], lambda seq, h, rest: [(h[0], *d) for d in hunks_of(rest)])
