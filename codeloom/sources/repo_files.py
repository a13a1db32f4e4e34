"""Scan of repository folders: paths, sizes, hashes and texts as a DataFrame."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.paths import detect_language
from codeloom.session import ship_code
from codeloom.sources.config import Config


def open_repository(path: str) -> str:
    """The canonical root of a repository; an error where it is missing or no folder."""
    root = os.path.realpath(path)
    if not os.path.isdir(root):
        raise NotADirectoryError(path)
    return root


def resolve_inside(root: str, path: str) -> str:
    """``path`` under ``root``; an error where it leads out of it, through links as well."""
    full = os.path.realpath(os.path.join(root, path))
    if full != root and not full.startswith(root + os.sep):
        raise PermissionError(path)
    return full


def ignore_regex(pattern: str) -> tuple[re.Pattern, bool, bool] | None:
    """(expression over paths below the ignore file, negated, folders only) of one ignore line."""
    line = pattern.rstrip("\r\n")
    line = line.rstrip() if not line.endswith("\\ ") else line
    if not line or line.startswith("#"):
        return None
    negated, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
    folders, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.lstrip("/")
    out = "".join(
        {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, None) or (fnmatch.translate(t)[4:-3] if t[0] == "[" else re.escape(t))
        for t in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]+\]|.", line)
    )
    return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z"), negated, folders


def ignored(path: str, rules: list[tuple[str, re.Pattern, bool, bool]], folder: bool = False) -> bool:
    """Whether a file (or a folder) is ignored: the last rule that matches it or a folder above it decides;
    a file below an ignored folder cannot be taken back."""
    parts = path.split("/")
    for depth in range(1, len(parts) + 1):
        at, is_dir, state = "/".join(parts[:depth]), folder or depth < len(parts), False
        for base, rx, negated, folders in rules:
            if at.startswith(base) and (is_dir or not folders) and rx.match(at[len(base) :]):
                state = not negated
        if state:
            return True
    return False


#: Names of the ignore files of a folder; the later one counts more.
IGNORE_FILES = (".gitignore", ".ignore")
Rules = list[tuple[str, str]]  # (folder below the root with a slash behind it, or as many ``../`` for one above; text)


def _text(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return None


def outer_rules(root: str) -> Rules:
    """The ignore rules that come from outside of the root or beside its files, weakest first: the
    user's global file, ``.git/info/exclude``, and the ignore files of the folders above, up to the one
    that holds ``.git``."""
    base = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    rules: Rules = [("", text) for p in (os.path.join(base, "git", "ignore"), os.path.join(root, ".git", "info", "exclude")) if (text := _text(p)) is not None]
    above: Rules = []
    at, inner = root, ""
    while not os.path.exists(os.path.join(at, ".git")) and (up := os.path.dirname(at)) != at:
        inner = os.path.basename(at) + "/" + inner
        at = up
        above = [("^" + inner, text) for name in IGNORE_FILES if (text := _text(os.path.join(at, name))) is not None] + above
    return rules + above


def compiled(rules: Rules) -> list[tuple[str, re.Pattern, bool, bool]]:
    """The rules of ``ignored``; those of a folder above the root match the whole way down from it."""
    out = []
    for base, text in rules:
        for line in text.splitlines():
            if (rule := ignore_regex(line)) is not None:
                rx, negated, folders = rule
                if base.startswith("^"):  # the way from that folder to the root stands before every path
                    out.append(("", _Below(base[1:], rx), negated, folders))
                else:
                    out.append((base, rx, negated, folders))
    return out


class _Below:
    """A pattern of a folder above the root, over paths below the root."""

    def __init__(self, way: str, rx: re.Pattern):
        self.way, self.rx = way, rx

    def match(self, path: str) -> bool:
        whole = self.way + path
        # A folder between the two may be ignored as a whole, and then all in the root is.
        parts = self.way.rstrip("/").split("/")
        return bool(self.rx.match(whole)) or any(self.rx.match("/".join(parts[: k + 1])) for k in range(len(parts)))


def visit(root: str, folder: str, rules: Rules, config: Config) -> tuple[list[tuple[str, int, int]], list[tuple[str, Rules]]]:
    """One folder: (path, size, modification time in ns) of its files, and its folders with their rules."""
    at = os.path.join(root, folder)
    entries = sorted(os.scandir(at), key=lambda e: e.name)
    rules = rules + [(folder, text) for name in IGNORE_FILES if any(e.name == name for e in entries) and (text := _text(os.path.join(at, name))) is not None]
    tests = compiled(rules)
    files, folders = [], []
    for e in entries:
        path = folder + e.name
        if e.name in config.ignored_dirs:
            continue
        if e.is_dir(follow_symlinks=False):
            if not ignored(path, tests, True):
                folders.append((path + "/", rules))
        elif e.is_file() and not (e.name.rpartition(".")[1] and e.name.rpartition(".")[2] in config.ignored_extensions) and not ignored(path, tests):
            info = e.stat()
            files.append((path, info.st_size, info.st_mtime_ns))
    return files, folders


_LISTED = "path string, size_bytes long, mtime long"


def list_files(spark: SparkSession, root: str, config: Config, at_once: int = 64) -> DataFrame:
    """(path, size_bytes, mtime) of the files to index; names only, no contents.

    Spark's own file listing leaves out names that begin with a dot or an underscore, such as
    ``__init__.py``, so folders are walked here. The driver visits folders from the top only until it
    knows ``at_once`` that are still to be walked; each of these is walked by a task, with the ignore
    rules of the folders above it, so the names of a large tree never meet on the driver.
    """
    todo: list[tuple[str, Rules]] = [("", outer_rules(root))]
    seen: list[tuple[str, int, int]] = []
    while todo and len(todo) < at_once:
        files, folders = visit(root, *todo.pop(0), config)
        seen += files
        todo += folders

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for folder, rules in zip(pdf["folder"], pdf["rules"]):
                pending = [(folder, [tuple(r) for r in json.loads(rules)])]
                found: list[tuple[str, int, int]] = []
                while pending:
                    files, folders = visit(root, *pending.pop(), config)
                    found += files
                    pending += folders
                    if len(found) > 10_000:
                        yield pd.DataFrame(found, columns=["path", "size_bytes", "mtime"])
                        found = []
                yield pd.DataFrame(found, columns=["path", "size_bytes", "mtime"]).astype({"size_bytes": "int64", "mtime": "int64"})

    listed = spark.createDataFrame(seen, _LISTED)
    if not todo:
        return listed
    folders = spark.createDataFrame([(f, json.dumps(r)) for f, r in todo], "folder string, rules string").repartition(len(todo))
    return listed.unionByName(folders.mapInPandas(walk, _LISTED))


def scan_repository(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """(path, language, size_bytes, content_hash, content, indexed_at): the files of a repository by path.

    Ignore files (``.gitignore``, ``.ignore``) count below their folder, deeper ones last, after those of
    the folders above the root, ``.git/info/exclude`` and the user's global file; folders and extensions
    that the configuration names are left out, dotfiles are kept. Files over the size limit or in no
    allowed language have a null content; bytes that are no UTF-8 become the replacement character.
    The hash is of the bytes, or of size and time for files over the limit. The tasks list and read
    below the root, which all executors must see; names are ordered before the texts are read.
    """
    config = config or Config()
    root = open_repository(root)
    ship_code(spark)
    names = list_files(spark, root, config).withColumn("language", detect_language(F.col("path"))).orderBy("path")
    limit, languages = config.max_file_size_bytes, frozenset(config.languages)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):  # texts of few files at a time
                part = pdf.iloc[at : at + 256]
                digests, texts = [], []
                for path, size, mtime, language in zip(part["path"], part["size_bytes"], part["mtime"], part["language"]):
                    raw = None
                    if size <= limit:
                        with open(os.path.join(root, path), "rb") as f:
                            raw = f.read()
                    digests.append(hashlib.sha256(raw if raw is not None else f"{size}:{mtime}".encode()).hexdigest())
                    texts.append(raw.decode("utf-8", "replace") if raw is not None and language in languages else None)
                yield part[["path", "language", "size_bytes"]].assign(content_hash=digests, content=texts)

    rows = names.mapInPandas(read, "path string, language string, size_bytes long, content_hash string, content string")
    return rows.withColumn("indexed_at", F.unix_timestamp())
