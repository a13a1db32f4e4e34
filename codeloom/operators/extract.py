"""Outlines of source files as line-wise jobs: declared symbols and import bindings.

Lines are split and matched by expressions inside the JVM, one pass over the texts and no Python.
This covers declarations that begin a line; nested functions and multi-line heads are not listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import detect_language

#: (language, kind, pattern of a declaring line; group 1 is the name) in order of preference.
DECLARATIONS = (
    ("python", "class", r"^\s*class\s+([^\W\d]\w*)"),
    ("python", "function", r"^(?:async\s+)?def\s+([^\W\d]\w*)"),
    ("python", "method", r"^\s+(?:async\s+)?def\s+([^\W\d]\w*)"),
    ("python", "constant", r"^([A-Z][A-Z0-9_]*)\s*(?::[^=]+)?=(?!=)"),
    ("rust", "struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"),
    ("rust", "trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)"),
    ("rust", "enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"),
    ("rust", "constant", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?([A-Z_]\w*)\s*:"),
    ("rust", "function", r"^(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(\w+)"),
    ("rust", "method", r"^\s+(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(\w+)"),
    ("go", "method", r"^func\s+\([^)]*\)\s+(\w+)"),
    ("go", "function", r"^func\s+(\w+)"),
    ("go", "struct", r"^type\s+(\w+)\s+struct\b"),
    ("go", "interface", r"^type\s+(\w+)\s+interface\b"),
    ("go", "constant", r"^const\s+(\w+)"),
    ("script", "class", r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([\w$]+)"),
    ("script", "interface", r"^(?:export\s+)?interface\s+([\w$]+)"),
    ("script", "enum", r"^(?:export\s+)?(?:const\s+)?enum\s+([\w$]+)"),
    ("script", "type_alias", r"^(?:export\s+)?type\s+([\w$]+)\s*(?:<[^=]*>)?\s*="),
    ("script", "function", r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)"),
    ("script", "constant", r"^(?:export\s+)?const\s+([\w$]+)"),
    ("script", "method", r"^\s+(?:static\s+|async\s+|get\s+|set\s+|public\s+|private\s+|protected\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|do\b)([\w$]+)\s*\([^)]*\)\s*(?::[^{;]+)?\{\s*$"),
)


def _family(language: Column) -> Column:
    return F.when(language.isin("type_script", "tsx", "java_script"), "script").otherwise(language)


def _lines(sources: DataFrame) -> DataFrame:
    rows = sources.where(F.col("content").isNotNull()).withColumn("language", detect_language(F.col("path"))).where("language is not null")
    return rows.select("file_id", "path", "language", F.posexplode(F.split("content", "\n")).alias("at", "line"))


def outline(sources: DataFrame) -> DataFrame:
    """(file_id, path, language, line_no, kind, name, is_exported): declarations by line.

    Exported means ``pub`` in Rust, ``export`` in scripts, a capital first letter in Go and no
    leading underscore in Python.
    """
    lines = _lines(sources)
    family = _family(F.col("language"))
    found = F.coalesce(*[
        F.when((family == lang) & F.col("line").rlike(rx), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line", rx, 1).alias("name")))
        for lang, kind, rx in DECLARATIONS
    ])
    rows = lines.withColumn("d", found).where(F.col("d").isNotNull())
    name = F.col("d.name")
    exported = (
        F.when(F.col("language") == "rust", F.col("line").rlike(r"^\s*pub\b")).when(F.col("language") == "go", name.rlike(r"^\p{Lu}"))
        .when(F.col("language") == "python", ~name.startswith("_")).otherwise(F.col("line").rlike(r"^export\b"))
    )
    return rows.select("file_id", "path", "language", (F.col("at") + 1).alias("line_no"), "d.kind", "d.name", exported.alias("is_exported"))


def imports_of(sources: DataFrame) -> DataFrame:
    """(file_id, path, local_name, source_module, imported_name): the bindings of import lines.

    Named, aliased and default imports of scripts (imported name ``default``), ``from`` and plain
    imports of Python, ``use`` trees of one level of Rust, and the import paths of Go.
    """
    lines = _lines(sources).withColumn("family", _family(F.col("language")))
    script = lines.where("family = 'script'").select("file_id", "path", F.regexp_extract("line", r"""^import\s+(?:type\s+)?(.*?)\s*from\s+["']([^"']+)["']""", 1).alias("clause"), F.regexp_extract("line", r"""from\s+["']([^"']+)["']""", 1).alias("module"), "line")
    script = script.where(F.col("clause") != "")
    default = script.select("file_id", "path", F.regexp_extract("clause", r"^([\w$]+)\s*(?:,|$)", 1).alias("local_name"), "module", F.lit("default").alias("imported_name"))
    braces = script.select("file_id", "path", "module", F.explode(F.split(F.regexp_extract("clause", r"\{([^}]*)\}", 1), ",")).alias("item"))
    python = lines.where("family = 'python'").select("file_id", "path", F.regexp_extract("line", r"^from\s+(\S+)\s+import\s+\(?([^()#]+)", 1).alias("module"), F.explode(F.split(F.regexp_extract("line", r"^from\s+(\S+)\s+import\s+\(?([^()#]+)", 2), ",")).alias("item"))
    plain = lines.where("family = 'python'").select("file_id", "path", F.explode(F.split(F.regexp_extract("line", r"^import\s+([^#]+)", 1), ",")).alias("item"))
    plain = plain.select("file_id", "path", F.split(F.trim("item"), r"\s+as\s+").alias("w")).select("file_id", "path", F.when(F.size("w") > 1, F.col("w")[1]).otherwise(F.split(F.col("w")[0], r"\.")[0]).alias("local_name"), F.col("w")[0].alias("module"), F.col("w")[0].alias("imported_name"))
    rust = lines.where("family = 'rust'").select("file_id", "path", F.regexp_extract("line", r"^\s*(?:pub\s+)?use\s+([^;{}]+?)(?:::\{([^{}]*)\})?\s*;", 1).alias("head"), F.regexp_extract("line", r"^\s*(?:pub\s+)?use\s+([^;{}]+?)(?:::\{([^{}]*)\})?\s*;", 2).alias("group"))
    rust = rust.where(F.col("head") != "")
    tree = rust.select(
        "file_id", "path", F.when(F.col("group") != "", F.col("head")).otherwise(F.regexp_replace("head", r"::[^:]*$", "")).alias("module"),
        F.explode(F.when(F.col("group") != "", F.split("group", ",")).otherwise(F.array(F.regexp_extract("head", r"([^:]*)$", 1)))).alias("item"),
    )
    go = lines.where("family = 'go'").select("file_id", "path", F.regexp_extract("line", r'^\s*(?:import\s+)?(?:([\w.]+)\s+)?"([^"]+)"\s*$', 1).alias("alias"), F.regexp_extract("line", r'^\s*(?:import\s+)?(?:([\w.]+)\s+)?"([^"]+)"\s*$', 2).alias("module")).where(F.col("module") != "")
    go = go.select("file_id", "path", F.when(F.col("alias") != "", F.col("alias")).otherwise(F.regexp_extract("module", r"([^/]*)$", 1)).alias("local_name"), "module", F.regexp_extract("module", r"([^/]*)$", 1).alias("imported_name"))
    items = braces.unionByName(python).unionByName(tree)
    items = items.select("file_id", "path", "module", F.split(F.regexp_replace(F.trim("item"), r"^type\s+", ""), r"\s+as\s+").alias("w"))
    named = items.select("file_id", "path", F.when(F.size("w") > 1, F.col("w")[1]).otherwise(F.col("w")[0]).alias("local_name"), "module", F.col("w")[0].alias("imported_name"))
    every = named.unionByName(default).unionByName(plain).unionByName(go)
    return every.where((F.col("local_name") != "") & (F.col("local_name") != "*")).select("file_id", "path", "local_name", F.col("module").alias("source_module"), "imported_name")
