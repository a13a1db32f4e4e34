"""The index of a repository from one walk to the next, as joins between two snapshots.

Files keep their ids by path, symbols by file, qualified name and kind, so what points at them from
outside stays valid. Only files whose content changed are parsed; their references are made anew
and resolved against the symbols of the whole index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.paths import detect_language
from codeloom.model import files_now, rows_now
from codeloom.operators import parsing, resolve, snapshot
from codeloom.operators.extract import imports_of
from codeloom.session import cut
from codeloom.sources.config import Config

_IDS = 100_000  # new rows that one task numbers, about
_SPAN = ["start_line", "start_col", "end_line", "end_col", "start_byte", "end_byte"]
_SYMBOL = ["id", "file_id", "name", "qualified_name", "kind", "language", *_SPAN, "is_exported", "doc_comment", "signature"]
_REF = ["id", "from_file_id", "from_symbol_id", *[f"from_{c}" for c in _SPAN], "to_symbol_id", "to_name", "kind", "confidence"]
SCHEMAS = {
    "files": "id long, path string, language string, content_hash string, size_bytes long, indexed_at long",
    "symbols": "id long, file_id long, name string, qualified_name string, kind string, language string, start_line int, start_col int, end_line int, end_col int, start_byte int, end_byte int, is_exported boolean, doc_comment string, signature string",
    "refs": "id long, from_file_id long, from_symbol_id long, from_start_line int, from_start_col int, from_end_line int, from_end_col int, from_start_byte int, from_end_byte int, to_symbol_id long, to_name string, kind string, confidence string",
}


def numbered(fresh: DataFrame, above: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """``fresh`` with ids above the greatest of ``above``, by ``order`` within hash buckets, whose
    number follows the rows, so that no task orders all of them."""
    top = above.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = cut(fresh)
    buckets = max(1, -(-fresh.count() // _IDS))
    fresh = fresh.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = fresh.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return fresh.join(before, "_bucket").withColumn(name, F.lit(top) + F.col("_before") + place).drop("_bucket", "_before")


def reindex(stored: dict[str, DataFrame], walked: DataFrame, config: Config | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables after the walk, summary): ``stored`` has files, symbols and refs (see ``SCHEMAS``).

    ``walked``: path, size_bytes, content_hash, content (null where too large), indexed_at; one row
    per path. Files of no language are left out, those of a language that the settings leave out are
    counted; files over the size limit keep a row and lose their symbols and references. Files that
    were not walked again go with all that belongs to them; references of others to their symbols
    become unresolved. The summary is one row: files_indexed, files_skipped_unsupported,
    files_skipped_too_large, files_deleted, symbols_indexed, references_indexed, references_resolved.
    """
    config = config or Config()
    files, symbols, refs = files_now(stored["files"]), rows_now(stored["symbols"]), rows_now(stored["refs"])
    walked = walked.withColumn("language", detect_language(F.col("path"))).where(F.col("language").isNotNull())
    allowed = walked.where(F.col("language").isin(config.languages))
    large = F.col("size_bytes") > config.max_file_size_bytes
    known = allowed.join(files.select("path", F.col("id").alias("_id"), F.col("content_hash").alias("_hash")), "path", "left")
    known = cut(known.withColumn("_changed", F.col("_hash").isNull() | (F.col("_hash") != F.col("content_hash"))).withColumn("_large", large))
    columns = ["path", "language", "content_hash", "size_bytes", "indexed_at"]
    fresh = numbered(known.where(F.col("_id").isNull()).drop("_id"), files, ["path"], "_id")
    known = cut(known.where(F.col("_id").isNotNull()).unionByName(fresh))
    new_files = known.select(F.col("_id").alias("id"), *columns)
    gone = snapshot.deleted_files(files, allowed).select("id")
    todo = known.where(F.col("_changed") & ~F.col("_large"))
    emptied = known.where(F.col("_changed") & F.col("_large")).select(F.col("_id").alias("id"))
    touched = cut(gone.unionByName(emptied).unionByName(todo.select(F.col("_id").alias("id"))).distinct())

    texts = todo.select(F.col("_id").alias("file_id"), "path", "content")
    parsed = cut(parsing.parse_files(texts))
    found = parsing.parsed_symbols(parsed)
    again = symbols.join(todo.select(F.col("_id").alias("file_id")), "file_id", "left_semi")
    matched = cut(snapshot.match_symbols(again.select("id", "file_id", "qualified_name", "kind"), found))
    added = numbered(matched.where(F.col("old_id").isNull()).drop("old_id"), symbols, ["file_id", "start_byte", "qualified_name", "kind"])
    made = matched.where(F.col("old_id").isNotNull()).withColumnRenamed("old_id", "id").select(*_SYMBOL).unionByName(added.select(*_SYMBOL))
    new_symbols = cut(snapshot.without_files(symbols, touched).select(*_SYMBOL).unionByName(made))

    kept = snapshot.set_null_refs(snapshot.without_files(refs, touched, "from_file_id"), new_symbols)
    raw = numbered(parsing.parsed_references(parsed), refs, ["from_file_id", "from_start_byte", "to_name", "kind"])
    raw = cut(raw)
    answer = resolve.resolve_refs(raw, new_symbols, imports_of(texts), new_files)
    inside = resolve.attributed_refs(raw, new_symbols)
    made_refs = (
        raw.join(answer.select(F.col("ref_id").alias("id"), F.col("resolved_id").alias("to_symbol_id"), "confidence"), "id")
        .join(inside.select(F.col("ref_id").alias("id"), F.col("symbol_id").alias("from_symbol_id")), "id", "left").select(*_REF)
    )
    made_refs = cut(made_refs)
    new_refs = kept.select(*_REF).unionByName(made_refs)

    counts = walked.agg(F.count(F.when(~F.col("language").isin(config.languages), 1)).alias("files_skipped_unsupported"))
    for part in (
        known.agg(F.count(F.when(F.col("_changed") & ~F.col("_large"), 1)).alias("files_indexed"), F.count(F.when(F.col("_large"), 1)).alias("files_skipped_too_large")),
        gone.agg(F.count(F.lit(1)).alias("files_deleted")), matched.agg(F.count(F.lit(1)).alias("symbols_indexed")),
        made_refs.agg(F.count(F.lit(1)).alias("references_indexed"), F.count("to_symbol_id").alias("references_resolved")),
    ):
        counts = counts.crossJoin(part)  # each side is one row
    return {"files": new_files, "symbols": new_symbols, "refs": new_refs}, counts
