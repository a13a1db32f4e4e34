from codeloom.llm.parse_check import syntax_flags, syntax_rates


def test_operator(spark):
    rows = [(1, "r/a.py", "x = 1", 0), (2, "r/b.py", "x = ", 0), (3, "q/c.go", None, 0), (4, "q/d.md", "# x", 0), (5, None, "x", 0), (None, "q/e.js", "", 0), (2, "r/b.py", "x = ", 0)]
    src = spark.createDataFrame(rows, "file_id long, path string, content string, language int")
    flags = syntax_flags(src)
    assert sorted((r["path"], r["is_valid"]) for r in flags.collect()) == [("q/e.js", True), ("r/a.py", True), ("r/b.py", False), ("r/b.py", False)]
    got = {(r["repo"], r["language"]): (r["n_files"], r["n_invalid"]) for r in syntax_rates(flags).collect()}
    assert got == {("r", "python"): (3, 2), ("q", "java_script"): (1, 0)}
    assert syntax_flags(src.limit(0)).count() == 0
