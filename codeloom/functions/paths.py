"""Path, name and text expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.model import LANGUAGES

TEST_DIRS = ("tests", "__tests__", "spec", "test")
REFACTOR_WORDS = "refactor|rewrite|restructure|redesign"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalize(path: Column) -> Column:
    """A path with forward slashes."""
    return F.translate(path, "\\", "/")


def repo(path: Column) -> Column:
    return F.split(path, "/")[0]


def in_repo(path: Column) -> Column:
    """The path below its repository, the first segment."""
    return F.regexp_replace(path, "^[^/]*/", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    """The name before its last dot; a name that begins with its only dot is its own stem."""
    return F.regexp_extract(file_name(path), r"^(.+?)(\.[^.]*)?$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def first_component(path: Column) -> Column:
    return F.split(path, "/")[0]


def dir_segments(path: Column) -> Column:
    return F.filter(F.split(parent_dir(path), "/"), lambda s: s != "")


def detect_language(path: Column) -> Column:
    """The language by the last extension, case-sensitive; null for others."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return known[extension(path)]


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 7)


def ascii_lower(text: Column) -> Column:
    """Small letters for A to Z only, as the reference's search folds case."""
    return F.translate(text, _UPPER, _LOWER)


def matches_test_naming(path: Column, stem: Column) -> Column:
    """``<stem>.test.``, ``<stem>.spec.``, ``<stem>_test.`` or ``test_<stem>.`` begins the file name."""
    name = file_name(path)
    begins = [F.concat(stem, F.lit(x)) for x in (".test.", ".spec.", "_test.")] + [F.concat(F.lit("test_"), stem, F.lit("."))]
    hit = F.lit(False)
    for b in begins:
        hit |= name.startswith(b)
    return (stem != "") & hit


def in_test_dir(path: Column) -> Column:
    return F.arrays_overlap(dir_segments(path), F.array(*[F.lit(d) for d in TEST_DIRS]))


def looks_like_test(path: Column) -> Column:
    low = F.lower(file_name(path))
    return in_test_dir(path) | low.contains(".test.") | low.contains(".spec.") | low.contains("_test.") | low.startswith("test_")


def is_major_refactor(files_changed: Column, summary: Column) -> Column:
    return F.coalesce(files_changed >= 5, F.lit(False)) | F.coalesce(F.lower(summary).rlike(REFACTOR_WORDS), F.lit(False))


def line_of(text: Column, at: Column) -> Column:
    """The 1-based line of a 1-based character position."""
    before = F.substring(text, F.lit(1), at - 1)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1


def column_of(text: Column, at: Column) -> Column:
    """The 1-based column, in bytes, of a 1-based character position."""
    before = F.substring(text, F.lit(1), at - 1)
    return F.octet_length(F.substring_index(before, "\n", -1)) + 1


def qualify(scope: Column, name: Column, separator: str, limit: int = 400) -> Column:
    """``scope`` joined with ``name``; a scope of ``limit`` bytes or more grows no further."""
    return F.when(scope.isNull() | (scope == ""), name).when(F.octet_length(scope) >= limit, scope).otherwise(F.concat(scope, F.lit(separator), name))
