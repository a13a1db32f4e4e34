import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.operators import evidence as E
from codeloom.operators import extract as X
from codeloom.operators import graph as G
from codeloom.operators import resolve as R
from codeloom.operators import search as S
from codeloom.operators import snapshot as N

REF = "id long, from_file_id long, from_symbol_id long, to_symbol_id long, to_name string, kind string, confidence string"
SYM = "id long, file_id long, name string, qualified_name string, kind string, start_line int, start_col int, start_byte int, end_line int, end_byte int, is_exported boolean"
FILE = "id long, path string, content_hash string, indexed_at long"


def syms(spark, rows):
    return spark.createDataFrame([(i, f, n, n, "function", i, 1, s, i, e, x) for i, f, n, s, e, x in rows], SYM)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "path,spec,language,want",
    [
        ("a.ts", "./b", "type_script", "b"),
        ("packages/app/index.ts", "../core/index", "type_script", "packages/core/index"),
        ("a.ts", "react", "type_script", None),
        ("a.ts", "../../x", "type_script", "x"),
        ("pkg/mod.py", ".foo", "python", "pkg/foo"),
        ("pkg/sub/mod.py", "..pkg.foo", "python", "pkg/pkg/foo"),
        ("pkg/mod.py", "os", "python", None),
        ("src/lib.rs", "crate::a::b", "rust", "src/a/b"),
        ("src/a/b.rs", "super::sibling", "rust", "src/a/sibling"),
        ("src/a/mod.rs", "self::inner", "rust", "src/a/inner"),
        ("src/lib.rs", "std::collections::HashMap", "rust", None),
        ("main.go", "fmt", "go", None),
    ],
)
def test_module_paths(spark, path, spec, language, want):
    assert one(spark, R.module_stem(F.lit(path), F.lit(spec), F.lit(language))) == want


@pytest.mark.parametrize(
    "name,stem,ext,lang", [("a/foo.test.ts", "foo.test", "ts", "type_script"), (".gitignore", ".gitignore", "", None), ("x/y.d.ts", "y.d", "ts", "type_script"), ("b/Makefile", "Makefile", "", None), ("c.PY", "c", "PY", None)]
)
def test_path_functions(spark, name, stem, ext, lang):
    assert one(spark, P.file_stem(F.lit(name))) == stem
    assert one(spark, P.extension(F.lit(name))) == ext
    assert one(spark, P.detect_language(F.lit(name))) == lang


def test_line_and_column_count_bytes(spark):
    text = F.lit("é\nab é x")
    assert one(spark, P.line_of(text, F.lit(8))) == 2
    assert one(spark, P.column_of(text, F.lit(8))) == 7


def test_cascade_never_guesses(spark):
    s = syms(spark, [(1, 1, "f", 0, 9, True), (2, 2, "f", 0, 9, True), (3, 2, "g", 10, 19, True), (4, 3, "h", 0, 1, True), (5, 3, "h", 2, 3, True)])
    r = spark.createDataFrame([(1, 1, None, None, "f", "call", "low"), (2, 1, None, None, "g", "call", "low"), (3, 3, None, None, "h", "call", "low"), (4, 4, None, None, "f", "call", "low"), (5, 1, None, None, None, "call", "low"), (5, 1, None, None, None, "call", "low")], REF)
    got = {x["ref_id"]: (x["resolved_id"], x["confidence"], x["tier"]) for x in R.resolve_refs(r, s).collect()}
    assert got == {1: (1, "high", "same_file"), 2: (3, "medium", "global"), 3: (None, "low", "same_file"), 4: (None, "low", "global"), 5: (None, "low", "global")}


def test_import_tier(spark):
    files = spark.createDataFrame([(1, "packages/app/index.ts"), (2, "packages/core/index.ts"), (3, "packages/core/data.json")], "id long, path string")
    s = syms(spark, [(1, 2, "coreUtil", 0, 9, True), (2, 9, "other", 0, 9, True)])
    imports = spark.createDataFrame(
        [(1, "packages/app/index.ts", "util", "../core/index", "coreUtil"), (1, "packages/app/index.ts", "d", "../core/data.json", "d"), (1, "packages/app/index.ts", "other", "react", "other")],
        "file_id long, path string, local_name string, source_module string, imported_name string",
    )
    r = spark.createDataFrame([(1, 1, None, None, "util", "call", "low"), (2, 1, None, None, "d", "call", "low"), (3, 1, None, None, "other", "call", "low")], REF)
    got = {x["ref_id"]: (x["resolved_id"], x["confidence"], x["tier"]) for x in R.resolve_refs(r, s, imports, files).collect()}
    assert got == {1: (1, "high", "import"), 2: (None, "medium", "import"), 3: (None, "low", "import")}


def test_innermost_symbol(spark):
    s = syms(spark, [(1, 1, "outer", 0, 100, True), (2, 1, "inner", 10, 50, True), (3, 1, "twin", 10, 50, True)])
    r = spark.createDataFrame([(1, 1, 20, 30), (2, 1, 60, 70), (3, 1, 95, 120)], "id long, from_file_id long, from_start_byte int, from_end_byte int")
    assert {x["ref_id"]: x["symbol_id"] for x in R.innermost_symbols(r, s).collect()} == {1: 2, 2: 1}


def refs(spark, pairs, kind="call"):
    return spark.createDataFrame([(i + 1, 1, a, b, "x", kind, "high") for i, (a, b) in enumerate(pairs)], REF)


def test_cycle_terminates_and_reports_truncation(spark):
    r = refs(spark, [(1, 2), (2, 1)])
    e = G.edges_of(r, reverse=True)
    roots = spark.createDataFrame([(1,)], "root long")
    nodes = G.expand(e, roots, 6)
    assert {(x["node"], x["depth"]) for x in nodes.collect()} == {(1, 0), (2, 1)}
    assert G.graph_edges(nodes, r, 6).count() == 2
    assert not G.truncated(nodes, e, 6).first()["truncated"]
    assert G.truncated(G.expand(e, roots, 1), e, 1).first()["truncated"]


def test_depth_is_fewest_hops(spark):
    e = G.edges_of(refs(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (None, 1), (1, None)]))
    got = {x["node"]: x["depth"] for x in G.expand(e, spark.createDataFrame([(1,)], "root long"), 1).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def test_hot_sources_are_spread(spark):
    rnd = random.Random(3)
    pairs = [(1, k) for k in range(2, 60)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(80)]
    e = G.edges_of(refs(spark, pairs))
    roots = spark.createDataFrame([(1,), (5,), (9,)], "root long")
    assert sorted(map(tuple, G.expand(e, roots, 3, bucket_edges=4).collect())) == sorted(map(tuple, G.expand(e, roots, 3).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_closure_of_random_graphs(spark, seed):
    rnd = random.Random(seed)
    pairs = {(rnd.randrange(30), rnd.randrange(30)) for _ in range(35)} | {(100 + i, 101 + i) for i in range(9)}
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    want = set()
    for root in after:
        todo, seen = list(after[root]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        want |= {(root, x) for x in seen}
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    for growth in (0, 3, 1000):
        got = [tuple(r) for r in G.closure(e, e.select(e["src"].alias("root")), growth).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_innermost_over_bins(spark):
    rnd = random.Random(5)
    syms = [(i, 1, a, a + rnd.choice([5, 900, 5000])) for i, a in enumerate(rnd.randrange(9000) for _ in range(40))] + [(90, 1, None, 3), (91, 1, 9, 2), (92, None, 0, 9)]
    uses = [(i, 1, a, a + 4) for i, a in enumerate(rnd.randrange(9500) for _ in range(60))] + [(900, None, 1, 2), (901, 1, None, None)]
    s = spark.createDataFrame(syms, "id long, file_id long, start_byte int, end_byte int")
    r = spark.createDataFrame(uses, "id long, from_file_id long, from_start_byte int, from_end_byte int")
    want = {}
    for i, f, a, b in uses:
        around = [(z - y, k) for k, g, y, z in syms if None not in (f, a, b, g, y, z) and f == g and y <= a and b <= z]
        if around:
            want[i] = min(around)[1]
    assert {x["ref_id"]: x["symbol_id"] for x in R.innermost_symbols(r, s).collect()} == want


def test_subclasses(spark):
    r = refs(spark, [(2, 1), (3, 2), (1, 3), (5, 4)], "extends")
    roots = spark.createDataFrame([(1,), (2,), (4,)], "root long")
    assert {(x["root"], x["node"]) for x in G.subclasses(r, roots).collect()} == {(1, 2), (1, 3), (2, 3), (2, 1), (4, 5)}


@pytest.mark.parametrize(
    "d,i,public,tests,want", [(0, 0, True, 0, "low"), (1, 0, True, 1, "medium"), (1, 0, False, 1, "low"), (1, 0, False, 0, "medium"), (5, 0, False, 1, "high"), (0, 15, False, 0, "high"), (5, 0, True, 0, "critical"), (1, 0, None, 1, "low")]
)
def test_risk_ladder(spark, d, i, public, tests, want):
    row = spark.createDataFrame([(1, d, i, public, tests)], "symbol_id long, direct_callers long, indirect_callers long, is_public boolean, test_suites long")
    assert E.score_risk(row).first()["risk"] == want


def test_reading_list_and_callers(spark):
    r = refs(spark, [(10, 1), (10, 1), (11, 1), (12, 1), (13, 1), (None, 1), (1, 20)])
    r = r.unionAll(r.where("id = 1"))
    got = [(x["section"], x["pos"], x["other_id"], x["ref_id"]) for x in E.reading_list(spark.createDataFrame([(1,)], "symbol_id long"), r).orderBy("section", "pos").collect()]
    assert got == [("callees", 1, 20, 7), ("callers", 1, 10, 1), ("callers", 2, 11, 3), ("callers", 3, 12, 4)]
    c = {x["symbol_id"]: (x["direct_callers"], x["distinct_callers"]) for x in E.direct_callers(r).collect()}
    assert c[1] == (6, 4)


def test_related_tests(spark):
    files = spark.createDataFrame([(1, "r/src/a.py", "h", 1), (2, "r/src/test_a.py", "h", 1), (3, "r/src/tests/b.py", "h", 1), (4, "r/lib/tests/c.py", "h", 1), (5, "q/src/tests/d.py", "h", 1)], FILE)
    s = syms(spark, [(1, 1, "f", 0, 9, True)])
    r = spark.createDataFrame([(1, 4, None, 1, "f", "call", "high"), (2, 5, None, None, "f", "call", "low")], REF)
    got = {x["path"]: (x["reason"], x["confidence"]) for x in E.related_tests(spark.createDataFrame([(1,)], "symbol_id long"), s, files, r).collect()}
    assert got == {"r/src/test_a.py": ("naming_convention", "medium"), "r/src/tests/b.py": ("directory_convention", "medium"), "r/lib/tests/c.py": ("direct_import", "high")}


def test_config_touches(spark):
    text = "\nx = process.env.HOME_DIR\ny = os.getenv('TOKEN') + os.getenv('TOKEN')\nos.environ['LATE']\n"
    src = spark.createDataFrame([(1, text), (2, None)], "file_id long, content string")
    s = spark.createDataFrame([(7, 1, "f", "f", "function", 2, 1, 0, 3, 9, True)], SYM)
    assert {(x["symbol_id"], x["key"], x["line"]) for x in E.config_touches(s, src).collect()} == {(7, "HOME_DIR", 2), (7, "TOKEN", 3)}


def test_search_order_and_case(spark):
    files = spark.createDataFrame([(1, "r/a.py", "h", 1)], FILE)
    s = syms(spark, [(1, 1, "Merge", 0, 1, True), (2, 1, "merge", 0, 1, True), (3, 1, "merge_all", 0, 1, True), (4, 1, "do_merge", 0, 1, True), (5, 1, "É", 0, 1, True), (6, 1, "50%", 0, 1, True)])
    names = lambda q, n=25: [r["name"] for r in S.search_symbols(s, files, q, n).collect()]
    assert names("merge") == ["merge", "Merge", "merge_all", "do_merge"]
    assert names("é") == [] and names("") == [] and names("0%") == ["50%"]
    assert names("merge", 1) == ["merge"] and len(names("merge", -1)) == 4


def test_snapshot_keeps_ids(spark):
    stored = spark.createDataFrame([(5, "a", "1"), (7, "b", "1"), (9, "gone", "1")], "id long, path string, content_hash string")
    walked = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")], "path string, content_hash string")
    got = {r["path"]: r["id"] for r in N.upsert_files(stored, walked).collect()}
    assert got["a"] == 5 and got["b"] == 7 and sorted([got["c"], got["d"]]) == [10, 11]
    assert [r["path"] for r in N.deleted_files(stored, walked).collect()] == ["gone"]
    assert {r["path"] for r in N.changed_files(stored, walked).collect()} == {"b", "c", "d"}


def test_symbols_are_matched_as_a_bag(spark):
    old = spark.createDataFrame([(1, 1, "f", "function"), (2, 1, "f", "function"), (3, 1, "g", "function")], "id long, file_id long, qualified_name string, kind string")
    new = spark.createDataFrame([(1, "f", "function", 0), (1, "f", "function", 50), (1, "f", "function", 90), (1, "h", "function", 99)], "file_id long, qualified_name string, kind string, start_byte int")
    m = N.match_symbols(old, new)
    assert [r["old_id"] for r in m.orderBy("start_byte").collect()] == [2, 1, None, None]
    assert [r["id"] for r in N.vanished_symbols(old, m).collect()] == [3]


def test_set_null_and_cascade(spark):
    r = refs(spark, [(1, 2), (3, 9)])
    got = [(x["from_symbol_id"], x["to_symbol_id"]) for x in N.set_null_refs(r, spark.createDataFrame([(1,), (2,)], "id long")).orderBy("id").collect()]
    assert got == [(1, 2), (None, None)]
    assert N.without_files(r, spark.createDataFrame([(1,)], "id long"), "from_file_id").count() == 0


def test_outline_and_imports(spark):
    rows = [
        (1, "r/a.py", "from .base import Base as B, guard\nimport os.path\nclass K(B):\n    def go(self):\n        pass\nLIMIT = 3\n"),
        (2, "r/src/a.rs", "use crate::base::{helper, lookup as look};\nuse std::fmt;\npub struct P;\nimpl P {\n    pub fn run(&self) {}\n}\n"),
        (3, "r/a.ts", 'import D, { x as y } from "./m";\nexport interface I {\n}\nexport function f(a: number) {\n'),
        (4, "r/a.go", 'package m\nimport (\n\tf "fmt"\n\t"a/b"\n)\nfunc (x *T) Do() {\n'),
        (5, "r/a.txt", "class No:\n"), (6, "r/b.py", None),
    ]
    src = spark.createDataFrame(rows, "file_id long, path string, content string")
    got = {(r["file_id"], r["kind"], r["name"], r["is_exported"]) for r in X.outline(src).collect()}
    assert got == {(1, "class", "K", True), (1, "method", "go", True), (1, "constant", "LIMIT", True), (2, "struct", "P", True), (2, "method", "run", True), (3, "interface", "I", True), (3, "function", "f", True), (4, "method", "Do", True)}
    got = {(r["file_id"], r["local_name"], r["source_module"], r["imported_name"]) for r in X.imports_of(src).collect()}
    assert got == {
        (1, "B", ".base", "Base"), (1, "guard", ".base", "guard"), (1, "os", "os.path", "os.path"), (2, "helper", "crate::base", "helper"), (2, "look", "crate::base", "lookup"), (2, "fmt", "std", "fmt"),
        (3, "D", "./m", "default"), (3, "y", "./m", "x"), (4, "f", "fmt", "fmt"), (4, "b", "a/b", "b"),
    }


@pytest.mark.parametrize("name,ends", [("bfs_edges_callers", range(101, 107)), ("bfs_edges_callees", range(94, 100))])
def test_edges_of_all_depths(spark, tmp_path, name, ends):
    from codeloom.plans.index_queries import QUERIES

    rows = [(i, 1, i + 1, i, f"n{i}", "call", "high") for i in range(90, 110)]
    spark.createDataFrame(rows + rows[:15], REF).write.parquet(f"{tmp_path}/refs.parquet")
    syms(spark, [(i, 1, f"n{i}", 0, 9, True) for i in range(91, 110)]).write.parquet(f"{tmp_path}/symbols.parquet")
    want = {(100, i, i - 1, i - 1) for i in ends} if name == "bfs_edges_callers" else {(100, i + 1, i, i) for i in ends}
    got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select("root", "from_id", "to_id", "ref_id").collect()]
    assert len(got) == 6 and set(got) == want
