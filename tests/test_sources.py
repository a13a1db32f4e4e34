import json

import pytest
from pyspark.sql import functions as F

from codeloom import cli
from codeloom.functions import render
from codeloom.sources.config import Config, load_config
from codeloom.sources.repo_files import ignore_regex, ignored, list_files, open_repository, resolve_inside, scan_repository


def rules(text, base=""):
    return [(base, *r) for line in text.splitlines() if (r := ignore_regex(line))]


@pytest.mark.parametrize(
    "text,path,want",
    [("*.log", "a/b.log", True), ("/x", "a/x", False), ("/x", "x", True), ("build/", "a/build/c", True), ("build/", "a/build", False), ("*.log\n!keep.log", "keep.log", False), ("a/**/z", "a/b/c/z", True), ("# c", "# c", False), ("d/\n!d/k", "d/k", True), ("f?.[ch]", "fo.c", True)],
)
def test_ignore_rules(text, path, want):
    assert ignored(path, rules(text)) is want


def test_scan(spark, tmp_path):
    files = {"a.py": b"x = 1\n", "lib/b.rs": b"fn \xff f() {}\n", "c.txt": b"t", "skip.log": b"l", "node_modules/d.js": b"1", ".gitignore": b"*.log\n", "lib/.gitignore": b"gen/\n", "lib/gen/e.py": b"1", ".dot.py": b"2", "big.py": b"#" * 50}
    for name, raw in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    rows = scan_repository(spark, str(tmp_path), Config(max_file_size_bytes=40)).collect()
    assert [r["path"] for r in rows] == sorted(r["path"] for r in rows)
    by = {r["path"]: r for r in rows}
    assert set(by) == {"a.py", "lib/b.rs", "c.txt", ".gitignore", "lib/.gitignore", ".dot.py", "big.py"}
    assert by["a.py"]["content"] == "x = 1\n" and by["lib/b.rs"]["content"] == "fn � f() {}\n"
    assert by["big.py"]["content"] is None and by["c.txt"]["content"] is None and by["c.txt"]["language"] is None
    assert by["a.py"]["size_bytes"] == 6 and by["lib/b.rs"]["language"] == "rust"


def test_ignore_files_beside_and_above(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "conf"))
    top = tmp_path / "top"
    for name, text in {
        "conf/git/ignore": "*.glob\n", "top/.gitignore": "*.up\n/root/only.py\n!keep.glob\n", "top/.git/HEAD": "", "top/root/a.py": "1", "top/root/b.up": "1", "top/root/c.glob": "1", "top/root/keep.glob": "1", "top/root/only.py": "1",
        "top/root/sub/only.py": "1", "top/root/sub/.ignore": "!b.up\n", "top/root/sub/b.up": "1", "top/root/sub/x/y/z.py": "1", "own/.git/info/exclude": "*.ex\n", "own/a.ex": "1", "own/b.py": "1",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    listed = lambda p, k: sorted(r["path"] for r in list_files(spark, str(p), Config(), k).collect())
    for k in (1, 2, 64):
        assert listed(top / "root", k) == ["a.py", "keep.glob", "sub/.ignore", "sub/b.up", "sub/only.py", "sub/x/y/z.py"]
    assert listed(tmp_path / "own", 64) == ["b.py"]


def test_paths_stay_inside(tmp_path):
    root = open_repository(str(tmp_path))
    assert resolve_inside(root, "a/b").startswith(root)
    with pytest.raises(PermissionError):
        resolve_inside(root, "../x")
    with pytest.raises(NotADirectoryError):
        open_repository(str(tmp_path / "none"))


def test_config(tmp_path):
    assert load_config(str(tmp_path / "none.toml")) == Config()
    good, bad, odd = tmp_path / "a.toml", tmp_path / "b.toml", tmp_path / "c.toml"
    good.write_text("max_graph_depth = 3\nlanguages = ['go']\ngit_history_limit = 9\nother = 1\n")
    bad.write_text("x = = 1")
    odd.write_text("languages = 'go'")
    assert load_config(str(good)) == Config(max_graph_depth=3, languages=["go"], git_history_limit=9)
    assert Config().ignored_extensions == [] and "coverage" in Config().ignored_dirs
    for p in (bad, odd):
        with pytest.raises(ValueError):
            load_config(str(p))


def test_render(spark):
    row = spark.createDataFrame([(1, 2, 3, True, 0, "high", ["a", "b"])], "symbol_id long, direct_callers long, indirect_callers long, is_public boolean, test_suites long, risk string, reasons array<string>")
    assert json.loads(render.export_context(row, "json").first()["json"])["risk"] == "high"
    assert "- Risk: HIGH\n  - a\n  - b" in render.export_context(row, "md").first()["markdown"]
    with pytest.raises(ValueError):
        render.export_context(row, "xml")
    one = lambda k: spark.range(1).select(render.evidence_line(F.lit(k), F.lit("f"), F.lit(3), F.lit("0123456789"), F.lit("s"), F.lit("K")).alias("x")).first()["x"]
    assert [one(k) for k in ("reference", "commit", "test_file", "config_file")] == ["f:3", "0123456: s", "f", "f (K)"]


def test_command_line(spark, data, capsys):
    assert cli.answer(spark, data, "search", "merge").count() > 0
    assert cli.answer(spark, data, "callers", "merge", depth=1).count() >= 1
    cli.main([data, "impact", "merge", "--form", "md"])
    assert "# Blast radius of symbol" in capsys.readouterr().out
    cli.main([data, "explain", "merge", "--form", "md"])
    shown = capsys.readouterr().out
    assert all(x in shown for x in ("## Evidence\n- Direct callers: ", "## Before you change this", "- Risk: **", "*Confidence: "))
    assert cli.answer(spark, data, "evolution", "no/such/path").first()["confidence"] == "low"
    with pytest.raises(LookupError):
        cli.answer(spark, data, "tests", "no such symbol at all")


def test_export_bundle(spark):
    schema = """symbol_id long, qualified_name string, kind string, path string, line int, signature string, doc_comment string, direct_callers long, indirect_callers long, tests string, config_keys string,
      introduced string, introduced_summary string, modification_count long, reading array<struct<item:string,why:string,evidence:string>>, risk string, reasons array<string>, is_public boolean, test_suites long, warnings array<string>, confidence string"""
    full = (1, "a.f", "function", "r/a.py", 3, "def f()", "Doc.", 2, 1, "t/a,t/b", "K", "0123456789", "first", 4, [("b.g", "calls this directly", "r/b.py:1")], "high", ["x", "y"], True, 2, ["w"], "low")
    bare = (2, "a.g", "function", "r/a.py", 9, None, None, 0, 0, "", "", None, None, 0, None, "low", [], None, 0, [], "medium")
    rows = spark.createDataFrame([full, bare], schema)
    md = {r["symbol_id"]: r["markdown"] for r in render.export_bundle(rows, "md").collect()}
    assert md[1] == (
        "# a.f (function)\n\n`r/a.py:3`\n\n```\ndef f()\n```\n\nDoc.\n\n## Evidence\n- Direct callers: 2\n- Indirect callers: 1\n- Related tests: 2\n- Introduced in commit `0123456`: first\n- Modification count: 4\n\n"
        "## Before you change this\n1. **b.g**: calls this directly\n\n## Blast radius\n- Risk: **HIGH**\n  - x\n  - y\n- Public API: yes\n- Test suites: 2\n\n## Historical warnings\n- w\n\n*Confidence: low. Generated by codeloom, evidence-backed, not fabricated.*"
    )
    assert "No specific reading list items. See blast radius below.\n" in md[2] and "Historical warnings" not in md[2] and "Introduced" not in md[2] and "- Public API: no" in md[2] and "- Related tests: 0" in md[2]
    text = {r["symbol_id"]: r["text"] for r in render.export_bundle(rows, "text").collect()}
    assert text[1].startswith("BEFORE YOU CHANGE THIS: a.f\n\nUnderstand first:\n  1. b.g: calls this directly\n\nBLAST RADIUS: a.f\n\nDirect callers:   2") and text[1].endswith("Historical warning:\n  w\n\nConfidence: low") and "Config files:     1" in text[1]
    assert json.loads(render.export_bundle(rows, "json").where("json like '%a.f%'").first()["json"])["reading"][0]["evidence"] == "r/b.py:1"
    with pytest.raises(ValueError):
        render.export_bundle(rows, "xml")


def test_analyze_and_continue(spark, tmp_path):
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo" / "a.py").write_text("def f():\n    return g()\n\n\ndef g():\n    return 1\n")
    first = cli.analyze(spark, str(tmp_path / "repo"), str(tmp_path / "one")).first()
    assert (first["files_indexed"], first["symbols_indexed"], first["references_resolved"]) == (1, 2, 1)
    (tmp_path / "repo" / "b.go").write_text("package b\n\nfunc B() {}\n")
    second = cli.analyze(spark, str(tmp_path / "repo"), str(tmp_path / "two"), str(tmp_path / "one")).first()
    assert second["files_indexed"] == 1 and spark.read.parquet(f"{tmp_path}/two/symbols.parquet").count() == 3
    assert cli.answer(spark, str(tmp_path / "two"), "callers", "g", 2).count() == 2
