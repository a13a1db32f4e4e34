import pytest

from codeloom.llm.doc_pairs import clean_lines, code_pairs, describe, described_functions

EMPTY = [
    None, "", "  \n", "//", "/** */", '""""""', "// ----------", "~~~~", "/// packShard", "Pack shard.", "The pack shard function.", "This is pack_shard.", "Summary of packShard", "TODO", "TODO: document", "todo describe this", "FIXME",
    "n/a", "...", "?", "Description.", "Documentation goes here.", "Auto-generated method stub", "Automatically created stub.", "@param a\n@param b\n@returns", ":param a:\n:param b:\n:return:", "# Arguments\n\n* `a`\n* `b`",
    "{@inheritDoc}", "@private", "See base class.", "See above.", "siehe oben", "same as before", "Ditto.", "(see code)", "eslint-disable-next-line no-console", "noqa: E501", "nolint:errcheck", "2021-03-04", "region: pack shard", "--- helpers ---",
    "pack_shard(a, b);", "описание", "説明なし", "待补充", "À compléter", "por documentar", "Self-explanatory.", "internal", "1.", "clippy: allow", "Getter.",
]
REAL = [
    "Blocks until the shard drains.", "Does nothing on an empty lease.", "See section 5 of the shard format: a two-byte length, then the payload.", "TODO-list aware: skips rows that carry an open mark.",
    "Generated names are prefixed with the id so that two runs never clash.", "Prüft, ob der batch noch gültig ist.", "把 cursor 按时间排序，并丢弃超过 61 条的旧记录。", "bucket 가 비어 있으면 아무 일도 하지 않는다.", "Сжимает chunk до 8 байт и проверяет сумму.",
    "/**\n * Pack shard.\n *\n * @param a upper bound of the ledger, inclusive\n */", "<p>Copies the bundle into the digest.</p>", '"""Gives -1 when the queue was never opened."""', "# Arguments\n\n* `a` - upper bound of the ledger, inclusive",
]


@pytest.mark.parametrize("doc", EMPTY)
def test_says_nothing(doc):
    assert describe(doc, "packShard") is None and describe(doc, "pack_shard") is None


@pytest.mark.parametrize("doc", REAL)
def test_says_something(doc):
    assert describe(doc, "packShard") and describe(doc, None)


def test_clean_lines():
    assert clean_lines("/**\r\n * One <b>two</b>.\r\n *\r\n * @x\r\n */") == ["One  two .", "@x"]


SYM = "id long, file_id long, kind string, name string, qualified_name string, signature string, start_byte int, end_byte int, doc_comment string, description string"


def test_operator(spark):
    doc = "Blocks until the shard drains."
    text = "# é\ndef f():\n    \"\"\"Gives -1 when the queue was never opened.\"\"\"\n    return 1\n\n\ndef k(): pass\n"
    raw = text.encode()
    f, k = raw.index(b"def f"), raw.index(b"def k")
    ends = raw.index(b"return 1") + 8, len(raw) - 1
    rows = [
        (1, 1, "function", "f", "m.f", "def f()", f, ends[0], None, "x"), (1, 1, "function", "f", "m.f", "def f()", f, ends[0], None, "x"), (2, 1, "class", "C", "m.C", None, 0, 1, doc, "x"), (3, 9, "method", "g", "m.g", None, 0, 5, doc, "x"),
        (4, 1, "method", "h", "m.h", None, 0, 99, doc, "x"), (5, 1, "function", "k", "m.k", None, k, ends[1], doc, "x"), (6, 1, "function", "n", None, None, None, None, doc, "x"), (7, 1, "function", "t", "t", None, 0, 1, "TODO", "x"), (8, 1, None, None, None, None, 0, 1, doc, "x"), (9, 1, "function", "q", "q", None, 0, 1, None, "x"),
        (10, None, "function", "z", "z", None, 0, 1, doc, "x"), (11, 2, "function", "y", "y", None, 0, 1, doc, "x"),
    ]
    sym = spark.createDataFrame(rows, SYM)
    src = spark.createDataFrame([(1, "r/a.py", text, 1), (1, "r/a.py", text, 2), (2, "r/b.py", None, 1), (3, None, text, 1), (4, "r/c.md", text, 1), (5, "r/d.go", "", 1)], "file_id long, path string, content string, doc int")
    got = {r["symbol_id"]: (r["description"], r["has_node"]) for r in described_functions(sym, src).collect()}
    assert got == {1: ("Gives -1 when the queue was never opened.", True), 5: (doc, True)} | {i: (doc, False) for i in (3, 4, 6, 10, 11)}
    code = {r["symbol_id"]: r["code"] for r in code_pairs(sym, src).collect()}
    assert code[1] == raw[f : ends[0]].decode() and code[5] == "def k(): pass" and set(code.values()) == {code[1], code[5], None}
    assert described_functions(sym.limit(0), src).count() == 0 and described_functions(sym, src.limit(0)).count() == 6
