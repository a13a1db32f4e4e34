"""Lexing by pieces gives what lexing token by token gives, and saves the work it is there to save."""

import pytest

from codeloom.syntax import lexers, tree
from codeloom.syntax.gll import OFFERS, Grammar
from codeloom.syntax.grammars import STARTS, grammar, tokens_of

PYTHON = [
    "", "\n", "# only\n", "x = 1", "x = 1\n", "\ufeffx = 1  # c", "def f(a, *b):\n    '''doc'''\n    return a\n\n\n# c\ndef g(): pass\n", "if x:\n\ty = [1,\n  2]\n        # deep\n\tz\n", "x = (\n", "x = )\n", "if a:\n  b\n c\n", "  x\n",
    "x = 1 \\\n  + 2\n", "x\n\\\ny\n", "\\\nx\n", "x \\\n", "x = 1\n\\\n\n", "x = 1\n   ", "x = 1\n   # end", "x\f\n\fy\n", "s = rb'a' u\"b\" '''c\n d'''\n", "s = ub'a'\n", "f'{x!r:>{w}} {{}}' + 1\n", "f'{x' + 1\n", "f\"\"\"a\n{b}\"\"\"\n", "x = 012\n", "x = 0x_f + 1_0.e3j + .5\n",
    "x = 1a\n", "é = ²x\n", "x = ٣\n", "x: int = a.b . c\n", "a\r\nb\rc\n", "x = 'a\n", "x\0\n", "x = ...\n", "x = a if b else c ;y\n", "try:\n  a\nexcept* E:\n  b\n", "x = '\\\n'\n", "#a\\\nx", "\\\n#a\n", "x = $\n", "(\n# c\n\n  1)\n",
]
GO = [
    "", "package a\n", "\ufeffpackage a // x\n\n// y\nfunc f() (int, error) { return 1, nil }", "x := a /* b\n c */ + d /* e */\n", "x /* b\n */ y", "a.b.(type)\n", "s := `a\nb` + \"c\\\"\" + 'd' + '\\x41'\n", "x := 'ab'\n", "x := .5 + 0x1p-2 + 1_0i\n", "x := \"a\n", "x /* a", "x // a", "x++ // a\n", "x <- y &^= z\n",
    "é := 1\n", "x\0\n", "x = $\n", "return\n}\n", "  \t\r\n", "x \t", "a...\nb / c /= d\n",
]
RUST = [
    "", "fn f<'a>(x: &'a str) -> Vec<Vec<u8>> { x }\n", "#!/bin/x\nfn f() {}", "#![x]\nfn f() {}", "a >>= b >= c << d; V<V<V<u8>>>", "/* a /* b */ c */ x /* /* /* d */ */ */ y", "/* a /* b */", "/* a **/ x /**/ y //* z\n w", "r\"a\" br#\"b\"c\"# r###\"d\"## \"### e", "r#type r\"open", "b'x' '\\u{1f}' 'a 'b' c\"s\" \"t\\\"\"",
    "1.0 1..2 1.max 0xffu8 1e-3f32 2usize x.0.1", "1a", "a..=b ... c :: d => -> @ ? $ ~", "\"open", "'\\n' '\n'", "é", "// end", "x / y /= z", "a\0b", "`",
]
JS = [
    "", "\ufeff#!x\nlet a = 1", "#!x\nlet a = b\n(c)", "a: for (;;) { break a }", "a // x\n  : while (1) {}", "let x = a / b / c, r = /[/]x/g.test(s)", "let s = `a${b + `c${d}`}e\n` + `f`; let t = 'q\\\nr'", "x = {a: 1, 'b': 2, [c]: 3, d}", "f(a => a\n)\n++b", "class A { #p = 1; static m() { return this.#p } get x() {} }",
    "a ?. b ?? c ?.5 : d", "x = 0xffn + 1.5e3 + .5 + 012", "a\n/* c\n */ b /* d */ c // e", "x >>>= y >> z >= w", "'open", "a = 1 $", "let é = ñ, \u2028 b\u2029c", "if (a) b\nelse c", "function f() {\n  // c\n  return 1 // d\n}\n", "x = y" + " + y" * 900 + " + 'long" + "x" * 2500 + "'; z: a", "export default class {}", "let a-b = 1", "return\n", "let x = <T>(a) => a", "type A<T> = Map<string, Array<T>>\nconst f = <T,>(a: T): T => a", "enum E { A = 1, B }\n",
]
JSX = [
    "x = <a b-c='d' e={f}>text: it's\n  {g} more => </a>", "const f = () =>text\nx = <p>a</p>", "x = <>{a}b<c-d/></>", "x = <A<T> b='1'>{...c}</A>; a = b-c", "f = a => <b>{a ? <i>x</i> : null} : y</b>\nlet z = {a: <p/>}", "x = a=>b-c; l: x",
]


def same(a, b):
    assert a.offers == b.offers and list(a.nexts[: len(a.offers) - 1]) == list(b.nexts[: len(b.offers) - 1])
    real = [i for i, n in enumerate(a.offers) if OFFERS[n][0] not in ("NEWLINE", "INDENT", "DEDENT", "END", "BAD", ";")]
    assert [a.begins(i) for i in real] == [b.begins(i) for i in real]
    assert [a.stops(i) for i in range(len(a.offers))] == [b.stops(i) for i in range(len(a.offers))]


@pytest.mark.parametrize("text", PYTHON)
def test_python(text):
    found, expected = [], []
    same(lexers.python_lexer(text, found), lexers._python_tokens(text, expected))
    assert found == expected


@pytest.mark.parametrize("text", GO)
def test_go(text):
    same(lexers.go_lexer(text), lexers._go_tokens(text))


@pytest.mark.parametrize("text", RUST)
def test_rust(text):
    at = text.find("\n") + 1 if text.startswith("#!/") else 0
    same(lexers.rust_lexer(text), lexers._rust_tokens(text, at))


@pytest.mark.parametrize("text, dialect", [(t, d) for t in JS for d in ("js", "ts", "tsx")] + [(t, d) for t in JSX for d in ("jsx", "tsx")])
def test_javascript(text, dialect, monkeypatch):
    g, fast = grammar(dialect), tokens_of(dialect, text, [])
    ok, nodes = g.parse(fast, STARTS[dialect])
    monkeypatch.setattr(lexers, "_JS_RUNS", {(x, y): lambda *a: [""] for x in (False, True) for y in (False, True)})
    slow = tokens_of(dialect, text, [])
    assert g.parse(slow, STARTS[dialect])[0] is ok
    asked = [i for i, n in enumerate(slow.offers) if n >= 0]
    assert [fast.offers[i] for i in asked] == [slow.offers[i] for i in asked]
    for name in g.index:
        assert g.spans(nodes, name) == g.spans(g.parse(slow, STARTS[dialect])[1], name)
    monkeypatch.undo()
    a, b = tree.parse(dialect, text), tree.Tree(text, dialect, ok, slow, g, nodes)
    assert tree.declarations(a) == tree.declarations(b) and tree.references(a) == tree.references(b)


@pytest.mark.parametrize("dialect, text", [("ts", "export function f(a: number, b = [1, 2]) {\n  const c = a + b[0]\n  return g(c, a, b)\n}\n"), ("rust", "fn f(a: u8, b: Vec<u8>) -> u8 {\n    let c = a + b[0];\n    return g(c, &a, b);\n}\n")])
def test_few_marks(dialect, text, monkeypatch):
    """Configurations are compared with earlier ones only while there are several."""
    calls = []
    monkeypatch.setattr(Grammar, "_fresh", staticmethod(lambda *a, f=Grammar._fresh: calls.append(a) or f(*a)))
    tokens = tokens_of(dialect, text * 20, [])
    assert grammar(dialect).accepts(tokens, STARTS[dialect])
    assert len(calls) < 0.15 * sum(n >= 0 for n in tokens.offers)


@pytest.mark.parametrize("dialect, text", [("python", "x = 1\n"), ("go", "package a\n"), ("rust", "struct A;\n"), ("ts", "let a = 1\n")])
def test_texts_without_functions(dialect, text):
    assert not tree.may_have_functions(dialect, text) and tree.functions(tree.parse(dialect, text)) == []


@pytest.mark.parametrize("dialect, text", [("python", "def f(): pass\n"), ("go", "package a\nfunc f() {}\n"), ("rust", "fn f() {}\n"), ("ts", "const f = a => a\n"), ("js", "function f() {}\n"), ("js", "class A { m() {} }\n"), ("js", "export const f = async function () {}\n")])
def test_texts_with_functions(dialect, text):
    assert tree.may_have_functions(dialect, text) and len(tree.functions(tree.parse(dialect, text))) == 1
