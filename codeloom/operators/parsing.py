"""Symbols and references of source texts, taken from their trees.

Texts are spread by bytes and parsed once; a row per file comes back with its symbols, references
and warnings as arrays, which Spark explodes. Spans count from 1 in lines and columns and from 0 in
bytes; columns are in bytes as well.
"""

from __future__ import annotations

import gc
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import detect_language
from codeloom.syntax.grammars import dialects_of
from codeloom.syntax.tree import declarations, parse, references

#: Most warnings of a file (fixed value).
MOST_WARNINGS = 25
_SPAN = "start_line int, start_col int, end_line int, end_col int, start_byte int, end_byte int"
_SYMBOL = f"name string, qualified_name string, kind string, {_SPAN}, is_exported boolean, doc_comment string, signature string"
_REFERENCE = f"to_name string, kind string, {_SPAN}"
_SCHEMA = f"file_id long, path string, language string, symbols array<struct<{_SYMBOL.replace(' ', ':').replace(',:', ',')}>>, refs array<struct<{_REFERENCE.replace(' ', ':').replace(',:', ',')}>>, warnings array<string>"
_KINDS = {"class", "constant", "enum", "function", "interface", "method", "struct", "trait", "type_alias", "variable", "module"}


class _Places:
    """Lines, columns and bytes of the offsets of a text."""

    def __init__(self, text: str):
        self.text, self.ascii = text, text.isascii()
        self.starts = [0]
        at = text.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = text.find("\n", at + 1)
        self.bytes = [0]
        if not self.ascii:
            for a, b in zip(self.starts, self.starts[1:]):
                self.bytes.append(self.bytes[-1] + len(text[a:b].encode("utf-8", "surrogatepass")))

    def at(self, offset: int) -> tuple[int, int, int]:
        line = bisect_right(self.starts, offset)
        begin = self.starts[line - 1]
        if self.ascii:
            return line, offset - begin + 1, offset
        width = len(self.text[begin:offset].encode("utf-8", "surrogatepass"))
        return line, width + 1, self.bytes[line - 1] + width

    def span(self, begin: int, end: int) -> dict[str, int]:
        (a, b, c), (x, y, z) = self.at(begin), self.at(end)
        return {"start_line": a, "start_col": b, "end_line": x, "end_col": y, "start_byte": c, "end_byte": z}


def module_of(path: str, dialect: str) -> str:
    """The module of a file by its path below the repository, which begins qualified names."""
    stem = path.split("/", 1)[-1].rpartition(".")[0]
    return stem.replace("/", "::" if dialect == "rust" else ".")


def parse_text(path: str, text: str) -> tuple[list[dict], list[dict], list[str]]:
    """Symbols, references and warnings of one text."""
    for dialect in dialects_of(path):
        tree, places = parse(dialect, text), _Places(text)
        symbols = [
            {"name": d.name, "qualified_name": d.qualified_name, "kind": d.kind, **places.span(d.begin, d.end), "is_exported": d.is_exported, "doc_comment": d.doc, "signature": d.signature}
            for d in declarations(tree, module_of(path, dialect)) if d.kind in _KINDS
        ]
        refs = [{"to_name": r.name, "kind": r.kind, **places.span(r.begin, r.end)} for r in references(tree)]
        return symbols, refs, [] if tree.valid else [f"not valid as {dialect}: only what was recognised is listed"][:MOST_WARNINGS]
    return [], [], []


def parse_files(texts: DataFrame) -> DataFrame:
    """(file_id, path, language, symbols, refs, warnings): one row per source file with a text.

    ``texts``: file_id, path, content. Files of no supported language and null texts give no row; an
    empty text has empty arrays; a damaged text keeps what was recognised and has a warning.
    """
    rows = texts.select("file_id", "path", "content").withColumn("language", detect_language(F.col("path")))
    rows = rows.where(F.col("language").isNotNull() & F.col("content").isNotNull()).hint("rebalance", "file_id", "path")
    schema = texts.sparkSession.createDataFrame([], _SCHEMA).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        for b in batches:
            gc.disable()  # very many small objects, hardly any cycles
            try:
                found = [parse_text(p, t) for p, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            finally:
                gc.enable()
            cols = [pa.array([f[i] for f in found], types.field(3 + i).type) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *cols], schema.names)

    return rows.mapInArrow(run, schema)


def parsed_symbols(parsed: DataFrame) -> DataFrame:
    """One row per symbol of ``parse_files``: file_id, language and the columns of a symbol but its id."""
    return parsed.select("file_id", "language", F.explode("symbols").alias("s")).select("file_id", "language", "s.*")


def parsed_references(parsed: DataFrame) -> DataFrame:
    """One row per reference: from_file_id, to_name, kind and the span with the prefix ``from_``."""
    rows = parsed.select(F.col("file_id").alias("from_file_id"), F.explode("refs").alias("r")).select("from_file_id", "r.*")
    return rows.select("from_file_id", "to_name", "kind", *[F.col(c).alias(f"from_{c}") for c in ("start_line", "start_col", "end_line", "end_col", "start_byte", "end_byte")])


def agreement(symbols: DataFrame, stored: DataFrame) -> DataFrame:
    """(language, kind, n_stored, n_same_span, n_same_name): how far parsed symbols agree with stored ones."""
    keys = ["file_id", "start_byte", "end_byte"]
    mine = symbols.select(*keys, F.col("qualified_name").alias("parsed_name")).dropDuplicates(keys)
    both = stored.join(mine, keys, "left")
    return both.groupBy("language", "kind").agg(
        F.count(F.lit(1)).alias("n_stored"), F.count("parsed_name").alias("n_same_span"), F.count(F.when(F.col("parsed_name") == F.col("qualified_name"), 1)).alias("n_same_name")
    )


