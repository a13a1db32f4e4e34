"""Source files that were not written by hand in their repository.

Evidence per file: a path that matches a declared glob, a comment in which a tool signs the
file, minified script text, a directory kept for third-party code, a comment that says where the
file was taken from, one large literal and nothing else, or a size over the limit. A file whose
text repeats, word for word, a file of a third-party directory of any repository counts as well;
these copies meet by a hash join.

Repositories may declare more, or less, in ``.gitattributes`` files: of ``linguist-generated`` and
``linguist-vendored``, each by itself, the deepest directory and there the latest line decides. A
set attribute makes a case; an unset one overrides the evidence of its own sort. Patterns are mined
for the repositories that declare nothing: those that several attribute files declare, and suffixes
or directories of which nearly all files, in several repositories, are declared or carry evidence
of their own. All texts are read once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.syntax.grammars import EXTENSIONS
from codeloom.session import cut

#: Directory names that are kept for third-party code (fixed list).
THIRD_PARTY_DIRS = (
    "vendor", "_vendor", "vendored", "_vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "3rd-party",
    "extern", "external", "externals", "deps", "contrib", "bundled", "node_modules", "bower_components", "jspm_packages", "Godeps", "site-packages",
)
#: Comments in which a tool signs a file, by the beginning of the comment line.
GENERATED = re.compile(
    r"""(?ix)
    (?: code\ generated\b | @generated\b | @?<?auto-?\s?generated>?\s*(?:by|from|file|code|\b[^\W\d]\w*\ v?\d) | <auto-generated | generated\ (?:by|from|with|using)\b
      | (?:this|the)\ (?:file|code|module|source)\b.{0,40}\b(?:(?:auto|machine)[-\s]?(?:matically\s)?(?:generated|made|created|produced)|generated\ (?:by|from|automatically))
      | .{0,20}\bmachine[-\s](?:made|generated)\b | do\ not\ (?:edit|modify)\b.{0,20}\b(?:produced|generated|created|built)\ (?:from|by|with)\b
      | regenerate\ with\b | (?:diese|die)\ datei\ wurde\ automatisch | ce\ fichier\ (?:a\ été|est)\ (?:généré|créé)\ auto | (?:este\ archivo|archivo)\ (?:fue\ )?generado
      | .{0,30}(?:自动生成|自動生成|자동(?:으로)?\ 생성) | (?:этот\ )?файл\ .{0,20}(?:автоматически|сгенерирован) )"""
)
#: Comments that say a file was taken from elsewhere.
TAKEN = re.compile(
    r"""(?ix)
    (?: (?:this\ (?:file\ )?is\ )?an?\ (?:un)?modified\ copy\ of\b | copied\ (?:verbatim\ |unchanged\ )?from\b | vendored\ (?:in\ )?from\b
      | (?:this\ (?:file|module)\ is\ )?part\ of\ (?:the\ )?[\w.-]+\ (?:library|package|project|toolkit|framework|distribution)\b.{0,40}\b(?:bundled|vendored|copied|included|shipped)\b
      | bundled\ (?:here\ )?(?:copy\ of|from|with\ permission)\b | imported\ third[-\s]party\ code\b | taken\ (?:verbatim\ |unchanged\ )?from\b | forked\ from\b | (?:this\ file\ is\ )?part\ of\ the\ upstream\b | third[-\s]party\ code\ from\b )"""
)
_SLASH = re.compile(
    r"""(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|r\#+".*?"\#+)""", re.S
)
_HASH = re.compile(
    r"""(?P<c>\#[^\n]*|(?:(?<=\n)|(?<![^\s]))(?:\"\"\".*?\"\"\"|'''.*?''')(?=\s*(?:\n|\Z)))|(?P<s>\"\"\".*?\"\"\"|'''.*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')""", re.S
)
_SCRIPT = ("java_script", "type_script", "tsx")


def split_comments(text: str, language: str) -> tuple[list[str], str, int]:
    """(comment lines without their marks, the code with every string as ``""``, chars in strings)."""
    lines: list[str] = []
    inside = 0

    def each(m: re.Match) -> str:
        nonlocal inside
        if m.lastgroup == "c":
            for line in m[0].splitlines():
                line = line.strip(" \t/*#!\"'﻿-;")
                if line:
                    lines.append(line)
            return " "
        inside += len(m[0])
        return '""'

    code = (_HASH if language == "python" else _SLASH).sub(each, text)
    return lines, code, inside


def _minified(code: str) -> bool:
    """Code that is packed into long lines with hardly any white space."""
    code = re.sub(r"\[(?:\s*(?:\"\"|[-\w.]+)\s*,?)*\]", "[]", code)
    packed = [x for x in code.splitlines() if len(x) >= 120]
    size = sum(map(len, packed))
    spaces = sum(x.count(" ") for x in packed)
    return size >= 0.5 * len(re.sub(r"\s+", "", code)) and size > 0 and spaces < 0.1 * size and sum(x.count(";") + x.count("{") for x in packed) * 25 > size


_HEAD = re.compile(
    r"^\s*(?:package\s+\w+\s*;?|import\s[^\n]*|use\s[^\n]*;|from\s[^\n]*|#!\[[^\n]*\]|\"\"\s*;?\s*(?=\n\s*(?:export|const|var|let|module|return)\b))",
)


_LITTER = re.compile(r"(?m)^(?:diff --git .*|@@ .*|<<<<<<< .*|=======|>>>>>>> .*)$")
#: A declaration that damage has written down twice.
_DOUBLED = re.compile(r"(?ms)^(\S[^\n]*=.{3,}?)\n\s*\1$")
_DECLARES = frozenset("def class function func fn struct enum trait impl interface type const let var import export use package from".split())


def _one_literal(code: str, inside: int, least: int = 300) -> bool:
    """Nothing but one literal of at least ``least`` characters, but for the name it is given."""
    code = _LITTER.sub("", code)
    size = len(re.sub(r"\s+", "", code)) + inside
    code = _DOUBLED.sub(r"\1", code)
    while m := _HEAD.match(code):
        code = code[m.end() :]
    body = re.sub(r"(?:\"\"|[A-Za-z_]\w*)\s*:(?!:)", ":", code)  # keys
    body = re.sub(r"\b(?:true|false|null|undefined|None|True|False|nil)\b", "0", body)
    first = re.search(r"\"\"|(?<!\w)\d", body)
    if first is None or size < least:
        return False
    before, after = body[: first.start()], re.sub(r"\b0[xX][0-9a-fA-F_]+\b|\b\d[\w.]*", "", body[first.start() :])
    behind = re.findall(r"[^\W\d]\w*", after)  # damage may leave a few words behind the literal
    return len(re.findall(r"[^\W\d]\w*", before)) <= 12 and len(behind) <= 3 and "=" not in after and not _DECLARES.intersection(behind)


def evidence_of(path: str, text: str | None, language: str) -> str | None:
    """The evidence that a text alone gives, or null: generated, taken, data or minified."""
    if not text or not text.strip():
        return None
    lines, code, inside = split_comments(text, language)
    if any(GENERATED.match(x) for x in lines):
        return "generated"
    if any(TAKEN.match(x) for x in lines):
        return "taken"
    if _one_literal(code, inside):
        return "data"
    if language in _SCRIPT and _minified(code):
        return "minified"
    return None


def glob_regex(glob: str) -> str:
    """The regular expression of a glob: ``**`` spans directories, ``*`` and ``?`` do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def language_of(path: Column) -> Column:
    """The language of a path by its last extension, null where it is no source file."""
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.when(F.regexp_extract(path, r"([^/]*)$", 1).rlike(r"[^/]\.[^./]+$"), known[ext])


#: The attributes that count, and what they say of a file.
ATTRIBUTES = {"linguist-generated": "generated", "linguist-vendored": "vendored"}
_ATTRIBUTE_LINE = re.compile(r'\s*(?:"((?:[^"\\]|\\.)*)"|(\S+))\s+(.*\S)')
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def attribute_rules(text: str) -> list[tuple[str, str, bool | None]]:
    """(glob, generated or vendored, set / unset / None for unspecified) of an attribute file, in order.

    Quoted globs, ``[attr]`` macros, ``-attr``, ``!attr`` and ``attr=value`` are understood; comments,
    negative globs and globs of folders (which match no file) are left out.
    """
    out: list[tuple[str, str, bool | None]] = []
    macros: dict[str, list[tuple[str, bool | None]]] = {}
    for line in text.splitlines():
        m = None if line.lstrip().startswith("#") else _ATTRIBUTE_LINE.match(line)
        if m is None:
            continue
        glob = m[2] if m[1] is None else re.sub(r"\\([0-7]{3}|.)", lambda e: chr(int(e[1], 8)) if len(e[1]) == 3 else _ESCAPES.get(e[1], e[1]), m[1])
        said: list[tuple[str, bool | None]] = []
        for word in m[3].split():
            name, _, value = word.lstrip("-!").partition("=")
            state = None if word[0] == "!" else word[0] != "-" and value.lower() not in ("false", "0", "no", "off")
            if name in ATTRIBUTES:
                said.append((ATTRIBUTES[name], state))
            elif name in macros:
                said += macros[name] if state else [(a, None if state is None else False) for a, _ in macros[name]]
        if glob.startswith("[attr]"):
            macros[glob[6:]] = said
        elif said and not glob.startswith("!") and not glob.endswith("/"):
            out += [(glob, a, state) for a, state in said]
    return out


@lru_cache(maxsize=1 << 12)
def _compiled(text: str) -> list[tuple[re.Pattern, str, bool | None]]:
    """The rules of an attribute file over paths below its directory; a glob without a slash matches names at any depth."""
    return [(re.compile(glob_regex(g.lstrip("/") if "/" in g else "**/" + g), re.S), a, state) for g, a, state in attribute_rules(text)]


def declared(paths: DataFrame, attributes: DataFrame) -> DataFrame:
    """(path, generated, vendored): what attribute files say of files; null where they say nothing.

    ``paths``: path; ``attributes``: path, content of the attribute files. A file meets the attribute
    files of the directories above it, each directory by its own key, so no file is paired with the
    rules of its whole repository.
    """
    at_dir = attributes.where(F.col("content").isNotNull()).select(F.regexp_extract("path", r"^(.*?)[^/]*$", 1).alias("dir"), "content").dropDuplicates(["dir"])
    dirs = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(dirs) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(dirs, F.lit(1), k), "/"), F.lit("/"))))
    met = paths.where(F.col("path").isNotNull()).select("path").distinct().select("path", F.explode(above).alias("dir")).join(at_dir, "dir")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, at, text in zip(pdf["path"], pdf["dir"], pdf["content"]):
                said: dict[str, int] = {}
                for rx, a, state in _compiled(text):
                    if rx.match(path[len(at) :]):
                        said[a] = 2 if state is None else int(state)
                rows.append((path, len(at), said.get("generated"), said.get("vendored")))
            yield pd.DataFrame(rows, columns=["path", "depth", "generated", "vendored"]).astype({"generated": "Int32", "vendored": "Int32"})

    said = met.select("path", "dir", "content").mapInPandas(judge, "path string, depth int, generated int, vendored int")
    deepest = lambda a: F.max_by(a, F.when(F.col(a).isNotNull(), F.col("depth")))
    said = said.groupBy("path").agg(*[deepest(a).alias(a) for a in ("generated", "vendored")])
    return said.select("path", *[F.when(F.col(a) < 2, F.col(a) == 1).alias(a) for a in ("generated", "vendored")])


#: A mined pattern holds for this share of its files, in so many files and repositories at least.
MINED_SHARE, MINED_FILES, MINED_REPOS = 0.98, 20, 3
_ATTRIBUTE_FILE = r"(^|/)\.gitattributes$"


def not_handwritten(files: DataFrame, sources: DataFrame, config: DataFrame) -> DataFrame:
    """(file_id, path, reason): one row per source file that was not written by hand.

    ``files``: id, path, size_bytes, indexed_at, of which the latest row of an id counts;
    ``sources``: file_id, path, content, null for a text over the size limit; ``config``: setting,
    setting_value, a table of fixed size, read to the driver. A null text counts as too large,
    unless the size of its file is known and within the limit. Empty and blank texts give no
    evidence and are no copies; files with a null path are left out.
    """
    rows = config.where(F.col("setting").isin("generated_path_globs", "max_file_size_bytes")).collect()
    globs = [glob_regex(r["setting_value"]) for r in rows if r["setting"] == "generated_path_globs"]
    limit = min([int(r["setting_value"]) for r in rows if r["setting"] == "max_file_size_bytes"], default=1 << 62)
    is_rules = F.col("path").rlike(_ATTRIBUTE_FILE)
    src = sources.select("file_id", "path", "content").withColumn("language", language_of(F.col("path"))).where(F.col("language").isNotNull() | is_rules)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            path, text, language = (b.column(i).to_pylist() for i in (1, 2, 3))
            said = [evidence_of(*x) if x[2] else None for x in zip(path, text, language)]
            rules = [None if x[1] else x[0] for x in zip(text, language)]
            cols = [b.column(0), b.column(1), b.column(3), pa.array(said, pa.string()), pa.array(rules, pa.string()), *b.columns[4:]]
            yield pa.RecordBatch.from_arrays(cols, ["file_id", "path", "language", "said", "rules", "digest", "n_bytes"])

    words = F.trim(F.regexp_replace("content", r"\s+", " "))
    digest = F.when(words != "", F.sha2(words, 256))
    read_in = src.select("file_id", "path", "content", "language", digest.alias("digest"), F.octet_length("content").cast("long").alias("n_bytes"))
    told = cut(read_in.mapInArrow(read, "file_id long, path string, language string, said string, rules string, digest string, n_bytes long"))
    attributes = told.where(is_rules).select("path", F.col("rules").alias("content"))
    told = told.where(F.col("language").isNotNull())
    dirs = F.split("path", "/")
    inside = F.arrays_overlap(F.slice(dirs, 2, F.greatest(F.size(dirs) - 2, F.lit(0))), F.array(*[F.lit(x) for x in THIRD_PARTY_DIRS]))
    on_path = F.lit(False)
    for g in globs:
        on_path |= F.col("path").rlike(g)
    sizes = files.groupBy(F.col("id").alias("file_id")).agg(F.max_by("size_bytes", "indexed_at").alias("size_bytes"))
    too_large = F.when(F.col("n_bytes").isNotNull(), F.col("n_bytes") > limit).otherwise(F.coalesce("size_bytes", F.lit(limit + 1)) > limit)
    marks = cut(declared(told, attributes))
    # Word-for-word copies: one row per text of a third-party directory, joined by its hash.
    originals = told.where(inside & F.col("digest").isNotNull()).join(marks.where(~F.col("vendored")), "path", "left_anti").select("digest").distinct().withColumn("copy", F.lit(True))
    one = told.join(sizes, "file_id", "left").join(originals, "digest", "left").join(marks, "path", "left")
    may_g, may_v = F.coalesce("generated", F.lit(True)), F.coalesce("vendored", F.lit(True))  # false where an attribute is unset
    foreign = F.coalesce(inside, F.lit(False))
    reason = (
        F.when(F.col("generated") | F.col("vendored"), "declared").when(may_v & foreign, "third-party directory").when(may_g & on_path, "glob").when(too_large, "too large")
        .when(may_v & (F.col("said") == "taken"), "taken").when(may_g & (F.col("said") != "taken"), F.col("said")).when(may_v & F.col("copy"), "copy")
    )
    found = cut(one.select("file_id", "path", reason.alias("reason"), (may_g & may_v).alias("open")))
    repo = F.split("path", "/")[0]
    declaring = attributes.select(repo.alias("repo")).distinct()
    rest = found.where(F.col("reason").isNull() & F.col("path").isNotNull() & F.col("open")).withColumn("repo", repo).join(declaring, "repo", "left_anti")
    hits = found.where(F.col("reason").isNotNull())
    mined = mined_patterns(found, hits).select("pattern").unionByName(declared_patterns(attributes).select("pattern")).distinct()
    more = rest.select("file_id", "path", F.explode(_patterns()).alias("pattern")).join(mined, "pattern", "left_semi").select("file_id", "path").distinct()
    return hits.select("file_id", "path", "reason").unionByName(more.withColumn("reason", F.lit("mined pattern")))


def _patterns() -> Column:
    """The patterns that a path may be known by: double suffix, name ending, directory and name."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return F.array_compact(
        F.array(
            F.nullif(F.regexp_replace(name, r"^[^.]*(\.[^.]+\.[^.]+)$", "*$1"), name),
            F.nullif(F.regexp_replace(name, r"^.+(_[A-Za-z0-9]+\.[^.]+)$", "*$1"), name),
            F.nullif(F.concat(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.lit("/")), F.lit("/")),
        )
    )


def declared_patterns(attributes: DataFrame) -> DataFrame:
    """(pattern, n_repos): suffixes, name endings and directories that the attribute files of
    ``MINED_REPOS`` repositories or more set, and none unsets, in the form of ``_patterns``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(path.split("/")[0], g, bool(state)) for path, text in zip(pdf["path"], pdf["content"]) for g, _, state in attribute_rules(text)]
            yield pd.DataFrame(rows, columns=["repo", "glob", "on"]).astype({"on": bool})

    rules = attributes.where(F.col("content").isNotNull() & F.col("path").isNotNull()).select("path", "content").mapInPandas(read, "repo string, glob string, on boolean")
    glob = F.regexp_replace("glob", r"^/?(\*\*/)?", "")
    pattern = F.when(glob.rlike(r"^\*[._][\w.-]+$"), glob).when(glob.rlike(r"^[\w.-]+/\*{1,2}$"), F.regexp_replace(glob, r"\*+$", ""))
    by_repo = rules.select("repo", pattern.alias("pattern"), "on").where(F.col("pattern").isNotNull()).groupBy("pattern", "repo").agg(F.min("on").alias("on"))
    return by_repo.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_repos"), F.min("on").alias("on")).where(F.col("on") & (F.col("n_repos") >= MINED_REPOS)).drop("on")


def mined_patterns(files: DataFrame, found: DataFrame) -> DataFrame:
    """(pattern, n_files, n_found, n_repos): double suffixes, name endings and directories of source
    files of which at least ``MINED_SHARE`` were found, in ``MINED_REPOS`` repositories or more."""
    path = files.select("path", F.split("path", "/")[0].alias("repo")).distinct().join(found.select("path", F.lit(1).alias("hit")).distinct(), "path", "left")
    seen = path.select("repo", "hit", F.explode(_patterns()).alias("pattern"))
    by_repo = seen.groupBy("pattern", "repo").agg(F.count(F.lit(1)).alias("n_files"), F.count("hit").alias("n_found"))
    stats = by_repo.groupBy("pattern").agg(F.sum("n_files").alias("n_files"), F.sum("n_found").alias("n_found"), F.count(F.when(F.col("n_found") > 0, 1)).alias("n_repos"))
    return stats.where((F.col("n_files") >= MINED_FILES) & (F.col("n_found") >= MINED_SHARE * F.col("n_files")) & (F.col("n_repos") >= MINED_REPOS))
