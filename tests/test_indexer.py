import pytest
from pyspark.sql import functions as F

from codeloom.operators import indexer, parsing
from codeloom.sources.config import Config

WALK = "path string, size_bytes long, content_hash string, content string, indexed_at long"


def empty(spark):
    return {name: spark.createDataFrame([], schema) for name, schema in indexer.SCHEMAS.items()}


def walk(spark, files, at=1):
    return spark.createDataFrame([(p, len(t) if size is None else size, f"h{hash((p, t))}", t, at) for p, t, size in files], WALK)


FIRST = [
    ("r/a.py", "class A:\n    def f(self):\n        return g(1)\n\n\ndef g(x):\n    return x\n", None), ("r/b.py", "def h():\n    return g(2) + lost(3)\n", None),
    ("r/c.go", "package c\n\nfunc Top() int { return help() }\n\nfunc help() int { return 1 }\n", None), ("r/big.py", None, 9_999_999), ("r/d.txt", "text", None), ("r/e.rs", "fn e() {}\n", None),
]


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_first_index_and_the_next(spark):
    config = Config(languages=["python", "go"])
    tables, summary = indexer.reindex(empty(spark), walk(spark, FIRST), config)
    s = summary.first().asDict()
    assert s == {"files_indexed": 3, "files_skipped_unsupported": 1, "files_skipped_too_large": 1, "files_deleted": 0, "symbols_indexed": 6, "references_indexed": 4, "references_resolved": 3}
    assert [p for (p,) in rows(tables["files"], "path")] == ["r/a.py", "r/b.py", "r/big.py", "r/c.go"]
    ids = {r["qualified_name"]: r["id"] for r in tables["symbols"].collect()}
    assert len(set(ids.values())) == 6 and set(ids) == {"a.A", "a.A.f", "a.g", "b.h", "Top", "help"}
    by = {(r["from_symbol_id"], r["to_name"]): (r["to_symbol_id"], r["confidence"]) for r in tables["refs"].collect()}
    assert by == {(ids["a.A.f"], "g"): (ids["a.g"], "high"), (ids["b.h"], "g"): (ids["a.g"], "medium"), (ids["b.h"], "lost"): (None, "low"), (ids["Top"], "help"): (ids["help"], "high")}

    changed = [("r/a.py", "# moved\nclass A:\n    def f(self):\n        return 1\n", None), FIRST[1], ("r/f.py", "def new(): pass\n", None), ("r/big.py", None, 9_999_999)]
    after, summary = indexer.reindex(tables, walk(spark, changed, 2), config)
    s = summary.first().asDict()
    assert (s["files_indexed"], s["files_deleted"], s["symbols_indexed"], s["references_indexed"]) == (2, 1, 3, 0)
    now = {r["qualified_name"]: r["id"] for r in after["symbols"].collect()}
    assert set(now) == {"a.A", "a.A.f", "b.h", "f.new"} and all(now[k] == ids[k] for k in ("a.A", "a.A.f", "b.h")) and now["f.new"] > max(ids.values())
    files = dict(rows(tables["files"], "path", "id"))
    assert {p: i for p, i in rows(after["files"], "path", "id") if p in files} == {p: files[p] for p in ("r/a.py", "r/b.py", "r/big.py")}
    assert {(r["to_name"], r["to_symbol_id"]) for r in after["refs"].collect()} == {("g", None), ("lost", None)}

    again, summary = indexer.reindex(after, walk(spark, changed, 3), config)
    assert summary.first()["files_indexed"] == 0 and rows(again["symbols"], "id", "file_id") == rows(after["symbols"], "id", "file_id") and again["refs"].count() == 2


def test_a_file_that_grew_too_large_loses_its_contents(spark):
    config = Config(max_file_size_bytes=500)
    tables, _ = indexer.reindex(empty(spark), walk(spark, FIRST[:2]), config)
    after, _ = indexer.reindex(tables, walk(spark, [("r/a.py", None, 501), FIRST[1]], 2), config)
    assert rows(after["symbols"], "qualified_name") == [("b.h",)] and after["files"].count() == 2
    assert all(r["to_symbol_id"] is None for r in after["refs"].collect())


def test_empty_walk(spark):
    tables, summary = indexer.reindex(empty(spark), walk(spark, []))
    assert all(t.count() == 0 for t in tables.values()) and summary.first()["files_indexed"] == 0


@pytest.mark.parametrize("text", ["", "é = 1\r\nüber = é\n", "def f(:\n", "x"])
def test_places(text):
    p = parsing._Places(text)
    raw = text.encode()
    for at in range(len(text) + 1):
        line, col, byte = p.at(at)
        assert byte == len(text[:at].encode()) and line == raw[:byte].count(b"\n") + 1 and col == byte - (raw.rfind(b"\n", 0, byte) + 1) + 1


def test_parse_files(spark):
    src = [(1, "r/a/b.py", "# é\ndef f():\n    pass\n", 0), (2, "r/c.py", "def g(:\n", 0), (3, "r/d.py", None, 0), (4, None, "x", 0), (5, "r/e.md", "x", 0), (6, "r/f.go", "", 0), (1, "r/a/b.py", "# é\ndef f():\n    pass\n", 1)]
    parsed = parsing.parse_files(spark.createDataFrame(src, "file_id long, path string, content string, symbols int")).cache()
    assert sorted((r["file_id"], len(r["symbols"]), len(r["warnings"])) for r in parsed.collect()) == [(1, 1, 0), (1, 1, 0), (2, 0, 1), (6, 0, 0)]
    s = parsing.parsed_symbols(parsed).where("file_id = 1").first()
    assert (s["qualified_name"], s["start_line"], s["start_col"], s["start_byte"], s["end_line"], s["end_byte"]) == ("a.b.f", 2, 1, 5, 3, 22)


def test_parsed_symbols_agree_with_the_stored_ones(spark, data):
    from codeloom.plans.parse_queries import parse_agreement

    seen = parse_agreement(spark, data).agg(F.sum("n_stored"), F.sum("n_same_span"), F.sum("n_same_name")).first()
    assert seen[1] >= 0.98 * seen[0] and seen[2] >= 0.97 * seen[0]
