"""Resolution of references to symbols: same file, imports, then the whole repository set.

Each tier looks a name up in a table that was aggregated before the join, so a join never fans
out and an ambiguous name resolves to null. The cascade stops at the first tier with a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import detect_language, dir_segments
from codeloom.model import rows_now

#: Suffixes that complete a module path, in order of preference (fixed values).
SUFFIXES = {
    "script": (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"),
    "python": (".py", "/__init__.py"),
    "rust": (".rs", "/mod.rs"),
}


def unique_id(keys: list[str], symbols: DataFrame, prefix: str) -> DataFrame:
    """Per key the number of symbols and, where it is one, its id."""
    g = symbols.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{prefix}_n"), F.min("id").alias("_id"))
    return g.withColumn(f"{prefix}_id", F.when(F.col(f"{prefix}_n") == 1, F.col("_id"))).drop("_id")


def _pop(a: Column) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))


def script_module(path: Column, spec: Column) -> Column:
    """The stem that a relative TypeScript or JavaScript specifier names; null for packages."""
    relative = spec.rlike(r"^(\./|\.\./)") | spec.isin(".", "..")
    steps = F.aggregate(
        F.split(spec, "/"), dir_segments(path),
        lambda acc, p: F.when(p.isin(".", ""), acc).when(p == "..", _pop(acc)).otherwise(F.concat(acc, F.array(p))),
    )
    return F.when(relative, F.array_join(steps, "/"))


def python_module(path: Column, spec: Column) -> Column:
    """The stem of a relative Python import: one dot is the directory, each further dot climbs."""
    dots = F.length(F.regexp_extract(spec, r"^(\.+)", 1))
    base = dir_segments(path)
    base = F.slice(base, 1, F.greatest(F.size(base) - (dots - 1), F.lit(0)))
    rest = F.filter(F.split(F.regexp_replace(spec, r"^\.+", ""), r"\."), lambda s: s != "")
    return F.when(spec.startswith("."), F.array_join(F.concat(base, rest), "/"))


def rust_module(path: Column, spec: Column) -> Column:
    """The stem of a ``crate``, ``super`` or ``self`` path under the first ``src`` directory."""
    full = F.split(path, "/")
    at = F.array_position(full, "src").cast("int")
    root = F.slice(full, 1, at)
    below = F.slice(full, at + 1, F.size(full))
    stem = F.regexp_replace(F.element_at(below, -1), r"\.rs$", "")
    module = F.when(F.size(below) == 0, below).when(stem.isin("mod", "lib", "main"), _pop(below)).otherwise(F.concat(_pop(below), F.array(stem)))
    parts = F.split(spec, "::")
    rest = F.slice(parts, 2, F.size(parts))
    head = parts[0]
    inside = F.when(head == "crate", F.concat(root, rest)).when(head == "self", F.concat(root, module, rest)).when(head == "super", F.concat(root, _pop(module), rest))
    return F.when(at > 0, F.array_join(inside, "/"))


def module_stem(path: Column, spec: Column, language: Column) -> Column:
    return (
        F.when(language.isin("type_script", "tsx", "java_script"), script_module(path, spec))
        .when(language == "python", python_module(path, spec))
        .when(language == "rust", rust_module(path, spec))
    )


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (file_id, path, local_name, source_module, imported_name) with ``target_file_id``:
    the first existing file of the stem and its suffixes."""
    language = detect_language(F.col("path"))
    none = F.array().cast("array<string>")
    tails = F.when(language.isin("type_script", "tsx", "java_script"), F.array(*[F.lit(s) for s in SUFFIXES["script"]]))
    for name in ("python", "rust"):
        tails = tails.when(language == name, F.array(*[F.lit(s) for s in SUFFIXES[name]]))
    rows = imports.withColumn("stem", module_stem(F.col("path"), F.col("source_module"), language))
    keys = ["file_id", "local_name", "source_module", "imported_name"]
    tried = rows.where(F.col("stem").isNotNull()).select(*keys, "stem", F.posexplode(F.concat(F.array(F.lit("")), F.coalesce(tails.otherwise(none), none))).alias("pos", "tail"))
    known = files.select(F.concat(F.col("path")).alias("candidate"), F.col("id").alias("target_file_id"))
    hits = tried.withColumn("candidate", F.concat("stem", "tail")).join(known, "candidate")
    best = hits.groupBy(*keys).agg(F.min_by("target_file_id", "pos").alias("target_file_id"))
    return rows.join(best, keys, "left")


def resolve_refs(refs: DataFrame, symbols: DataFrame, imports: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(ref_id, resolved_id, confidence, tier) of every reference.

    Tiers: same_file, import, global; a null name resolves to nothing. ``imports`` is optional and
    needs ``files``; without it the import tier has no candidates.
    """
    syms = rows_now(symbols).select("id", "file_id", "name")
    r = rows_now(refs).select(F.col("id").alias("ref_id"), F.col("from_file_id").alias("file_id"), F.col("to_name").alias("name"))
    r = r.join(unique_id(["file_id", "name"], syms, "here"), ["file_id", "name"], "left")
    if imports is not None and files is not None:
        bound = import_targets(imports, files)
        bindings = bound.groupBy("file_id", F.col("local_name").alias("name")).agg(
            F.count(F.lit(1)).alias("bound_n"), F.min("target_file_id").alias("target_file_id"), F.min("imported_name").alias("imported_name")
        )
        there = unique_id(["file_id", "name"], syms, "there").withColumnsRenamed({"file_id": "target_file_id", "name": "imported_name"})
        r = r.join(bindings.join(there, ["target_file_id", "imported_name"], "left"), ["file_id", "name"], "left")
    else:
        r = r.withColumns({"bound_n": F.lit(None).cast("long"), "target_file_id": F.lit(None).cast("long"), "there_id": F.lit(None).cast("long")})
    # Names with very many references: the lookup side holds a name once, so only the
    # reference side of this join is uneven, which adaptive execution splits.
    r = r.join(unique_id(["name"], syms, "any"), "name", "left")
    here, bound, one = F.col("here_n") >= 1, F.col("bound_n") >= 1, F.col("bound_n") == 1
    return r.select(
        "ref_id",
        F.when(here, F.col("here_id")).when(bound, F.when(one, F.col("there_id"))).otherwise(F.col("any_id")).alias("resolved_id"),
        F.when(here, F.when(F.col("here_id").isNotNull(), "high").otherwise("low"))
        .when(bound, F.when(one & F.col("there_id").isNotNull(), "high").when(one & F.col("target_file_id").isNotNull(), "medium").otherwise("low"))
        .when(F.col("any_id").isNotNull(), "medium").otherwise("low").alias("confidence"),
        F.when(here, "same_file").when(bound, "import").otherwise("global").alias("tier"),
    )


#: Bytes of a file that share a bin when references are placed in symbols.
BIN_BYTES = 1024


def innermost_symbols(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, symbol_id): the smallest symbol of the same file around each reference.

    Of equal extents the symbol with the smaller id wins; references outside all symbols give no row.
    A reference meets only the symbols that cover the bin in which it begins, not all of its file,
    so a file with very many of both is spread over its bins.
    """
    bin_of = lambda c: F.floor(F.col(c) / BIN_BYTES).cast("int")
    s = rows_now(symbols).where(F.col("start_byte") <= F.col("end_byte")).select(
        F.col("id").alias("symbol_id"), "file_id", "start_byte", "end_byte", F.explode(F.sequence(bin_of("start_byte"), bin_of("end_byte"))).alias("bin")
    )
    r = rows_now(refs).select(F.col("id").alias("ref_id"), F.col("from_file_id").alias("file_id"), "from_start_byte", "from_end_byte", bin_of("from_start_byte").alias("bin"))
    around = r.join(s, ["file_id", "bin"]).where((F.col("start_byte") <= F.col("from_start_byte")) & (F.col("from_end_byte") <= F.col("end_byte")))
    return around.groupBy("ref_id").agg(F.min_by("symbol_id", F.struct(F.col("end_byte") - F.col("start_byte"), "symbol_id")).alias("symbol_id"))


def attributed_refs(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, symbol_id): the symbol that a reference comes from.

    It is found by the name of the innermost symbol around the reference: null where several symbols
    of the file share that name, since a name alone then says nothing; references outside all symbols
    give no row.
    """
    syms = rows_now(symbols).select("id", "file_id", "name")
    named = innermost_symbols(refs, symbols).join(syms.withColumnRenamed("id", "symbol_id"), "symbol_id")
    return named.join(unique_id(["file_id", "name"], syms, "own"), ["file_id", "name"]).select("ref_id", F.col("own_id").alias("symbol_id"))
