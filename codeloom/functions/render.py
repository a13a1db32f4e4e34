"""JSON and Markdown forms of report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame, pretty: bool = True) -> DataFrame:
    """One column ``json`` with every row as an object; nulls are written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}).alias("json"))


def evidence_line(kind: Column, file: Column, line: Column, sha: Column, summary: Column, key: Column) -> Column:
    """The one-line form of a piece of evidence by its kind."""
    return (
        F.when(kind == "reference", F.concat(file, F.lit(":"), line.cast("string"))).when(kind == "commit", F.concat(F.substring(sha, 1, 7), F.lit(": "), summary))
        .when(kind == "test_file", file).otherwise(F.concat(file, F.lit(" ("), key, F.lit(")")))
    )


def blast_radius_markdown(report: DataFrame) -> DataFrame:
    """(symbol_id, markdown) of rows as ``operators.evidence.blast_radius`` gives them."""
    n = lambda c: F.col(c).cast("string")
    lines = [
        F.concat(F.lit("# Blast radius of symbol "), n("symbol_id")), F.lit(""),
        F.concat(F.lit("- Direct callers: "), n("direct_callers")), F.concat(F.lit("- Indirect callers: "), n("indirect_callers")),
        F.concat(F.lit("- Public API: "), F.when(F.col("is_public"), "yes").otherwise("no")), F.concat(F.lit("- Test suites: "), n("test_suites")),
        F.concat(F.lit("- Risk: "), F.upper("risk")),
    ]
    reasons = F.transform("reasons", lambda r: F.concat(F.lit("  - "), r))
    return report.select("symbol_id", F.concat_ws("\n", *lines, F.array_join(reasons, "\n")).alias("markdown"))


def export_context(report: DataFrame, form: str) -> DataFrame:
    """The report as ``json`` or ``md``; any other form is an error."""
    if form == "json":
        return as_json(report)
    if form == "md":
        return blast_radius_markdown(report)
    raise ValueError(f"unknown form {form}")


def _text(*parts: Column | str) -> Column:
    """The parts in a row as text; null where one of them is null."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _list(values: Column, before: str, empty: str | None = None) -> Column:
    """A line per value of an array of texts, or ``empty`` (nothing if that is null)."""
    lines = F.array_join(F.transform(values, lambda v: F.concat(F.lit(before), v)), "\n")
    return F.when(F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0, lines).otherwise(F.lit(empty))


def _reading() -> Column:
    return F.transform(F.coalesce("reading", F.array().cast("array<struct<item:string,why:string,evidence:string>>")), lambda r: F.concat(F.lit("**"), r["item"], F.lit("**: "), r["why"]))


def context_markdown(contexts: DataFrame) -> DataFrame:
    """(symbol_id, markdown) of rows as ``operators.reports.contexts`` gives them; sections without content are left out."""
    c = F.col
    yes = F.when(c("is_public"), "yes").otherwise("no")
    parts = [
        _text("# ", c("qualified_name"), " (", c("kind"), ")"), _text("\n`", c("path"), ":", c("line"), "`"), _text("\n```\n", c("signature"), "\n```"), F.when(c("doc_comment") != "", _text("\n", c("doc_comment"))),
        F.lit("\n## Evidence"), _text("- Direct callers: ", c("direct_callers")), _text("- Indirect callers: ", c("indirect_callers")),
        _text("- Related tests: ", F.when(c("tests") == "", F.lit(0)).otherwise(F.size(F.split("tests", ",")))),
        F.when(c("introduced").isNotNull(), _text("- Introduced in commit `", F.substring("introduced", 1, 7), "`: ", F.coalesce("introduced_summary", F.lit("")))), _text("- Modification count: ", c("modification_count")),
        F.lit("\n## Before you change this"), _list(_reading(), "1. ", "No specific reading list items. See blast radius below."),
        F.lit("\n## Blast radius"), _text("- Risk: **", F.upper("risk"), "**"), _list(c("reasons"), "  - "), _text("- Public API: ", yes), _text("- Test suites: ", c("test_suites")),
        F.when(F.size("warnings") > 0, "\n## Historical warnings"), _list(c("warnings"), "- "), _text("\n*Confidence: ", c("confidence"), ". Generated by codeloom, evidence-backed, not fabricated.*"),
    ]
    return contexts.select("symbol_id", F.concat_ws("\n", *parts).alias("markdown"))


def context_text(contexts: DataFrame) -> DataFrame:
    """(symbol_id, text): the change report as plain text."""
    c = F.col
    numbered = F.transform(c("reading"), lambda r, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), r["item"], F.lit(": "), r["why"]))
    parts = [
        _text("BEFORE YOU CHANGE THIS: ", c("qualified_name")), F.lit("\nUnderstand first:"), _list(numbered, ""), _text("\nBLAST RADIUS: ", c("qualified_name"), "\n"),
        _text("Direct callers:   ", c("direct_callers")), _text("Indirect callers: ", c("indirect_callers")), _text("Test suites:      ", c("test_suites")), _text("Public API:       ", F.when(c("is_public"), "yes").otherwise("no")),
        _text("Config files:     ", F.when(c("config_keys") == "", F.lit(0)).otherwise(F.size(F.split("config_keys", ",")))), _text("\nRisk: ", F.upper("risk")), _list(c("reasons"), "  - "),
        F.when(F.size("warnings") > 0, "\nHistorical warning:"), _list(c("warnings"), "  "), _text("\nConfidence: ", c("confidence")),
    ]
    return contexts.select("symbol_id", F.concat_ws("\n", *parts).alias("text"))


def export_bundle(contexts: DataFrame, form: str) -> DataFrame:
    """Profile and change report of each target as ``json``, ``md`` or ``text``; any other form is an error."""
    forms = {"json": as_json, "md": context_markdown, "text": context_text}
    if form not in forms:
        raise ValueError(f"unknown export format {form!r}")
    return forms[form](contexts)
