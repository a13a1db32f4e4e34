import pytest

from codeloom.llm.handwritten import declared, evidence_of, glob_regex, mined_patterns, not_handwritten

LONG = "QUJD" * 200
CODE = "export function f(a) {\n  return a + 1;\n}\n"


@pytest.mark.parametrize(
    "language,text,want",
    [
        ("go", "package x\n\n// Code generated by tool v1. DO NOT EDIT.\n\nfunc f() {}\n", "generated"),
        ("python", '"""Code generated by tool v1. DO NOT EDIT."""\nx = 1\n', "generated"),
        ("java_script", CODE + "// @generated by tool\n", "generated"),
        ("rust", "/* This file was automatically generated. Do not modify it by hand. */\nfn f() {}", "generated"),
        ("type_script", "// <auto-generated> tool v1 </auto-generated>\n" + CODE, "generated"),
        ("python", "# 本文件由 tool 自动生成，请勿修改。\ndef f(): pass\n", "generated"),
        ("java_script", 'const X = "// @generated";\n' + CODE, None),
        ("python", 'X = "# Code generated by tool. DO NOT EDIT."\ndef f(): pass\n', None),
        ("java_script", "// Unlike the generated client, this file is written and reviewed by hand.\n" + CODE, None),
        ("java_script", "// The ids generated here must stay stable between runs.\n" + CODE, None),
        ("java_script", "/** Generated names are prefixed with an id. */\n" + CODE, None),
        ("java_script", "/** Auto-generated method stub */\n" + CODE, None),
        ("rust", "// Vendored from somelib v1 with local patches removed.\nfn f() {}", "taken"),
        ("go", "// This is an unmodified copy of somelib, taken at v3.4.\npackage x\nfunc f() {}", "taken"),
        ("rust", "// Part of the somekit library (v1.2), bundled here for offline builds.\nfn f() {}", "taken"),
        ("rust", "// Part of the merge step; the library is bundled by the release job.\nfn f() {}", None),
        ("rust", f'pub const B: &str = "{LONG}";\n\npub const B: &str = "{LONG}";\n\n}}', "data"),
        ("go", "// Vendor records come from the ledger; nothing here is copied.\npackage x\nfunc f() {}", None),
        ("java_script", f'export const x = "{LONG}";\n', "data"),
        ("python", "ROWS = [\n" + '    {"id": 1, "w": 0.5},\n' * 40 + "]\n", "data"),
        ("rust", "pub static R: &[(&str, f64)] = &[\n" + '    ("a", 0.5),\n' * 60 + "];\n", "data"),
        ("go", "package data\n\nvar x = []byte{\n" + "    0x1f, 0x2a,\n" * 60 + "}\n", "data"),
        ("java_script", f'const ICON = "{LONG}";\n' + CODE, None),
        ("python", f'ICON = "{LONG}"\n\ndef f(a):\n    return a\n', None),
        ("python", "x = [1, 2, 3]\n", None),
        ("java_script", "/*! lib v1 */\n" + "function a(b){return b?a(b-1):0}var c=[1,2,3];if(c){d=e||{}}else f.g('h');" * 12, "minified"),
        ("type_script", CODE * 30, None),
        ("java_script", "", None), ("java_script", " \n", None), ("java_script", None, None),
    ],
)
def test_evidence(language, text, want):
    assert evidence_of("p", text, language) == want


@pytest.mark.parametrize(
    "glob,path,ok",
    [("**/*.pb.go", "r/a/b.pb.go", True), ("**/*.pb.go", "b.pb.go", True), ("**/*.pb.go", "r/b.pbxgo", False), ("**/gen/*_client.ts", "r/gen/a_client.ts", True), ("**/gen/*_client.ts", "r/gen/x/a_client.ts", False), ("*.js", "a/b.js", False), ("a?[bc].js", "axb.js", True), ("d/**", "d/e/f", True)],
)
def test_globs(glob, path, ok):
    import re

    assert bool(re.match(glob_regex(glob), path)) is ok


FILES, SRC, CFG = "id long, path string, size_bytes long, indexed_at long", "file_id long, path string, content string", "setting string, setting_value string"


def run(spark, files, sources, config=(("generated_path_globs", "**/*.g.ts"), ("max_file_size_bytes", "2000"))):
    out = not_handwritten(spark.createDataFrame(files, FILES), spark.createDataFrame(sources, SRC), spark.createDataFrame(list(config), CFG)).collect()
    assert len({r["file_id"] for r in out}) == len(out)
    return {r["file_id"]: r["reason"] for r in out}


def test_operator(spark):
    sources = [
        (1, "r/src/a.ts", CODE), (2, "r/x.g.ts", CODE + "//1"), (3, "r/vendor/lib/b.ts", CODE + "//2"), (4, "q/src/c.ts", CODE + "//2\r\n"), (5, "q/vendors/d.ts", CODE + "//3"),
        (6, "q/e.ts", None), (7, "q/f.ts", None), (8, "q/g.md", None), (9, "q/h.ts", "x" * 3000), (10, "vendor/i.ts", CODE), (11, "q/vendor/j.ts", " "), (12, "q/k.ts", " \n"), (13, None, CODE), (14, "q/l.ts", CODE + "//4"),
    ]
    files = [(6, "q/e.ts", 10, 5), (6, "q/e.ts", 9999, 9), (7, "q/f.ts", 10, 9), (7, "q/f.ts", 9999, 5), (14, "q/l.ts", 9999, 1)]
    want = {2: "glob", 3: "third-party directory", 4: "copy", 6: "too large", 9: "too large", 11: "third-party directory"}
    assert run(spark, files, sources) == want


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [], [(1, "r/a.ts", CODE)], [("languages", "x")]) == {}


def test_attribute_files_by_directory(spark):
    rows = [
        (1, "r/.gitattributes", "*.ts linguist-generated\n# no\nlib/*.ts -linguist-generated"), (2, "r/lib/.gitattributes", "b.ts linguist-vendored=true\n"),
        (3, "r/a.ts", CODE), (4, "r/lib/a.ts", CODE), (5, "r/lib/b.ts", CODE), (6, "q/a.ts", CODE),
    ]
    src = spark.createDataFrame(rows, SRC)
    said = declared(src.where("file_id > 2"), src.where("file_id <= 2")).collect()
    assert {r["path"]: (r["generated"], r["vendored"]) for r in said} == {"r/a.ts": (True, None), "r/lib/a.ts": (False, None), "r/lib/b.ts": (False, True)}
    assert run(spark, [], rows) == {3: "declared", 5: "declared"}


def test_attributes_count_each_by_itself(spark):
    mark = "// @generated by t\n" + CODE
    rows = [
        (1, "r/.gitattributes", "*.ts linguist-generated\n*.ts -linguist-vendored"), (2, "r/a.ts", CODE),
        (3, "q/.gitattributes", '*.ts linguist-generated -linguist-vendored\n"a b.ts" !linguist-generated\n*.js -linguist-generated\nvendor/** -linguist-vendored'),
        (4, "q/a.ts", CODE), (5, "q/a b.ts", CODE), (6, "q/c.js", mark), (7, "q/vendor/d.go", "package d\n"), (8, "q/vendor/e.js", mark),
        (9, "p/.gitattributes", "[attr]made linguist-generated\n*.go made\nx/*.go -made\n!*.js made\nlib/ made\n# *.js made"), (10, "p/a.go", "package a\n"), (11, "p/x/b.go", "// Code generated by t. DO NOT EDIT.\npackage b\n"), (12, "p/lib/c.js", CODE),
        (13, "o/.gitattributes", None), (14, "o/a.ts", CODE),
    ]
    assert run(spark, [], rows) == {2: "declared", 4: "declared", 10: "declared"}


def test_patterns_declared_by_several_repositories_reach_the_others(spark):
    rows = [(i, f"r{i}/.gitattributes", "/**/*.stub.ts linguist-generated\nfetched/** linguist-vendored\n*.odd.ts linguist-generated" + ("\n*.odd.ts -linguist-generated" if i == 1 else "")) for i in range(3)]
    rows += [(10, "z/a.stub.ts", CODE), (11, "z/fetched/b.ts", CODE + "//1"), (12, "z/c.odd.ts", CODE + "//2"), (13, "r0/d.ts", CODE + "//3"), (14, "z/stub.ts", CODE + "//4")]
    assert run(spark, [], rows) == {10: "mined pattern", 11: "mined pattern"}


def test_mined_patterns_reach_other_repositories(spark):
    rows = [(i, f"r{i % 5}/m{i}.gen.ts", "// @generated by t\n" + CODE + f"//{i}") for i in range(60)] + [(100, "z/x.gen.ts", CODE), (101, "z/x.ts", CODE + "//")]
    found = run(spark, [], rows)
    assert found[100] == "mined pattern" and 101 not in found and found[3] == "generated"
    src = spark.createDataFrame(rows, SRC)
    pats = mined_patterns(src, src.where("file_id < 60")).collect()
    assert [r["pattern"] for r in pats] == ["*.gen.ts"]
