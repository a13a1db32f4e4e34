"""Declarations, references and imports of a text, taken from the recognised rules.

The recogniser keeps every called rule with the places where it began and ended; nesting of these
ranges is the tree. What was recognised before a damage is there even if the text is rejected.
"""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple

from codeloom.syntax.gll import OFFERS, Grammar, Tokens
from codeloom.syntax.grammars import STARTS, _is_expression, grammar, is_blank, tokens_of

#: Longest qualified name in bytes; a scope of that size grows no further (fixed value).
LONGEST_NAME = 400
#: Rules that declare something, by dialect.
_RULES = {
    "python": ("Def", "Class"),
    "go": ("Func", "TypeSpec", "ConstSpec", "VarSpec"),
    "rust": ("Fn", "Struct", "Enum", "Trait", "Impl", "Mod", "Const", "Alias"),
    "js": ("FunctionDecl", "ClassDecl", "Class", "Member", "VarStmt"),
    "ts": ("FunctionDecl", "ClassDecl", "Class", "Member", "VarStmt", "Interface", "TypeAlias", "EnumDecl", "Namespace"),
}
_RULES["jsx"], _RULES["tsx"] = _RULES["js"], _RULES["ts"]
FUNCTIONS = frozenset(("function", "method"))
_KINDS = {
    "Class": "class", "ClassDecl": "class", "Struct": "struct", "Enum": "enum", "Trait": "trait", "Impl": "impl", "Mod": "module", "Const": "constant", "Alias": "type_alias",
    "FunctionDecl": "function", "Interface": "interface", "TypeAlias": "type_alias", "EnumDecl": "enum", "Namespace": "module",
}
_AFTER_WORD = {
    rule: re.compile(rf"[^{{;]*?\b(?:{words})\s*\*?\s*([^\W\d][\w$]*)")
    for rule, words in {
        "Def": "def", "Class": "class", "ClassDecl": "class", "FunctionDecl": "function", "Struct": "struct", "Enum": "enum", "Trait": "trait", "Mod": "mod", "Const": r"const|static|static\s+mut",
        "Alias": "type", "Fn": "fn", "Interface": "interface", "TypeAlias": "type", "EnumDecl": "enum", "Namespace": "namespace|module",
    }.items()
}
_GO_FUNC = re.compile(r"func\s*(?:\(\s*(?:[^\W\d]\w*\s+)?\*?\s*([^\W\d]\w*)[^()]*\)\s*)?([^\W\d]\w*)")
_MEMBER = re.compile(
    r"(?:@[\w$.]+(?:\([^()]*\))?\s*|(?:static|async|get|set|public|private|protected|readonly|abstract|declare|override|accessor)\s+(?![=(;:?!])|\*\s*)*([#\w$]+|\"[^\"]*\"|'[^']*'|\[[^\]]*\])"
)
_VARIABLE = re.compile(r"(?:var|let|const)\s+([^\W\d][\w$]*)\s*!?\s*(?::[^=]*?)?(?:=\s*(async\b\s*)?(function\b|(?:<[^>]*>\s*)?\([^=]*?\)\s*(?::[^=;]*?)?=>|[\w$]+\s*=>)?|[;\n]|$)")
_IMPL = re.compile(r"impl\b\s*(?:<(?:[^<>]|<[^<>]*>)*>\s*)?(?:!?\s*([\w:]+)(?:<[^{]*?>)?\s+for\s+)?&?\s*(?:'\w+\s+)?(?:mut\s+)?(?:dyn\s+)?([\w:]+)")
_MODIFIERS = re.compile(r"(?:export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?|declare\s+|abstract\s+|pub(?:\s*\([^)]*\))?\s+)$")
_MODIFIER_ENDS = ("export", "default", "declare", "abstract", "pub", ")")
_ATTRIBUTE = re.compile(r"\s*(?:#\[[^\n]*\]|@[\w$.]+(?:\([^\n]*\))?)\s*$")
_DOCSTRING = re.compile(r"""[rRuUbB]?(\"\"\"|'''|"|')(.*?)\1""", re.S)
_UPPER = re.compile(r"[A-Z0-9_]*[A-Z][A-Z0-9_]*")
_CALLEE = re.compile(r"(\bnew\s+)?(?:[\w$]+\s*(?:\?\.|\.|::)\s*)*([^\W\d][\w$]*)\s*(?:::\s*<[^<>]*>|<[^<>()]*>)?$")
_HEAD = re.compile(r"(?:&(?:'\w+\s+)?(?:mut\s+)?|\*|\[\]|\[|dyn\s+|impl\s+)*([^\W\d][\w$]*(?:(?:\.|::)[\w$]+)*)")


class Declaration(NamedTuple):
    """A declared symbol; ``begin`` and ``end`` are code point offsets into the text."""

    kind: str
    name: str
    qualified_name: str
    begin: int
    end: int
    signature: str | None
    is_exported: bool
    doc: str | None


class Reference(NamedTuple):
    kind: str
    name: str
    begin: int
    end: int


class Tree(NamedTuple):
    """A text as it was recognised."""

    text: str
    dialect: str
    valid: bool
    tokens: Tokens
    grammar: Grammar
    nodes: list[dict[int, list]]

    def spans(self, rule: str) -> list[tuple[int, int]]:
        """(begin, end) offsets of a rule, the longest end for each begin."""
        begins, stops = self.tokens.begins, self.tokens.stops
        return [(x, y) for a, b in self.grammar.spans(self.nodes, rule) if (x := begins(a)) < (y := stops(b))]


def parse(dialect: str, text: str) -> Tree:
    """The tree of a text; it is valid if the dialect accepts the whole text, or if it is blank."""
    exprs: list[str] = []
    tokens, g = tokens_of(dialect, text, exprs), grammar(dialect)
    ok, nodes = g.parse(tokens, STARTS[dialect])
    return Tree(text, dialect, is_blank(text) or ok and all(map(_is_expression, exprs)), tokens, g, nodes)


def comment_above(text: str, at: int) -> str | None:
    """The comment that ends on the line above an offset, beyond attributes, with its marks."""
    line = text.rfind("\n", 0, at)
    if text[line + 1 : at].strip():
        return None
    above: list[str] = []
    while line > 0:
        before = text.rfind("\n", 0, line)
        body = text[before + 1 : line].strip()
        if not above and body.endswith("*/"):
            opened = text.rfind("/*", 0, line)
            return text[opened:line].strip() if opened >= 0 else None
        if body.startswith("//"):
            above.append(body)
        elif above or not _ATTRIBUTE.fullmatch(body):
            break
        line = before
    return "\n".join(reversed(above)) or None


def _doc_of_block(tree: Tree, blocks: list[tuple[int, int]], begin: int, end: int) -> str | None:
    """The string that is the first statement of the Python block of a declaration."""
    i = bisect.bisect_right(blocks, (begin, 1 << 60))
    while i < len(blocks) and blocks[i][0] < end and blocks[i][1] != end:
        i += 1
    if i == len(blocks) or blocks[i][1] != end:
        return None
    m = _DOCSTRING.match(tree.text, blocks[i][0])
    return m[2] if m else None


def _head(tree: Tree, kind: str, begin: int, end: int) -> str:
    """The signature: the declaration up to its body, on one line."""
    piece = tree.text[begin:end]
    if tree.dialect == "python":
        depth, cut = 0, len(piece)
        for m in re.finditer(r"[()\[\]{}:]", piece):
            depth += (m[0] in "([{") - (m[0] in ")]}")
            if m[0] == ":" and depth == 0:
                cut = m.start()
                break
        piece = piece[:cut]
    else:
        depth = 0
        stop = "{;=" if kind == "type_alias" else "{;"
        for m in re.finditer(r"[()\[\]{;=]", piece):
            depth += (m[0] in "([") - (m[0] in ")]")
            if m[0] in stop and depth == 0:
                piece = piece[: m.start()]
                break
    return re.sub(r"\s+", " ", piece).strip()


def _qualified(scope: str, separator: str, name: str) -> str:
    if not scope:
        return name
    return scope if len(scope.encode()) >= LONGEST_NAME else scope + separator + name


def _found(tree: Tree) -> list[tuple[int, int, str, str, str]]:
    """(begin, end, kind, name, scope of its own) of what the rules declare."""
    text, out = tree.text, []
    bodies = {e for _, e in tree.spans("MethodBody")} if tree.dialect in ("js", "jsx", "ts", "tsx") else set()
    for rule in _RULES[tree.dialect]:
        for begin, end in tree.spans(rule):
            own = ""
            if rule in ("Def", "Fn"):
                m = _AFTER_WORD[rule].match(text, begin, end)
                kind, name = "function", m[1] if m else ""
            elif rule == "Func":
                m = _GO_FUNC.match(text, begin, end)
                kind, name, own = ("method" if m and m[1] else "function"), m[2] if m else "", (m[1] or "") if m else ""
            elif rule == "Member":
                m = _MEMBER.match(text, begin, end)
                kind, name = ("method" if end in bodies else "variable"), m[1] if m else ""
            elif rule == "VarStmt":
                m = _VARIABLE.match(text, begin, end)
                name = m[1] if m else ""
                kind = "function" if m and m[3] else "constant" if text.startswith("const", begin) else "variable"
            elif tree.dialect == "go":
                name = re.compile(r"\w*").match(text, begin)[0]
                rest = text[begin + len(name) : end]
                t = re.match(r"\s*(?:\[[^\]]*\]\s*)?(struct|interface)\b", rest)
                kind = {"ConstSpec": "constant", "VarSpec": "variable"}.get(rule) or (t[1] if t else "type_alias")
                word = {"ConstSpec": "const", "VarSpec": "var"}.get(rule, "type")
                if m := re.search(rf"(?:^|\n)({word}\s+)$", text[max(0, begin - 40) : begin]):
                    begin -= len(m[1])
            elif rule == "Impl":
                m = _IMPL.match(text, begin, end)
                kind, name = "impl", m[2].rpartition("::")[2] if m else ""
            else:
                m = _AFTER_WORD[rule].match(text, begin, end)
                kind, name = _KINDS[rule], m[1] if m else ""
                if rule == "Class" and tree.dialect != "python":  # a class in an expression
                    continue
            if name:
                if m := _MODIFIERS.search(text[max(0, begin - 60) : begin]):
                    begin -= len(m[0])
                out.append((begin, end, kind, name, own))
    if tree.dialect == "python":
        for begin, end in tree.spans("Stmt"):
            if m := re.compile(r"([^\W\d]\w*)\s*(?::[^=\n]+)?=(?!=)").match(text, begin, end):
                out.append((begin, end, "constant" if _UPPER.fullmatch(m[1]) else "variable", m[1], ""))
    return sorted(out, key=lambda x: (x[0], -x[1]))


def _blocks(tree: Tree) -> list[tuple[int, int]]:
    """(begin of the first statement, end) of the indented blocks of a Python text."""
    offers, begins, stops = tree.tokens.offers, tree.tokens.begins, tree.tokens.stops
    return sorted((begins(a + 2), stops(b)) for a, b in tree.grammar.spans(tree.nodes, "Block") if OFFERS[offers[a]] == ("NEWLINE",))


#: Words of which a text with functions or methods has one, by dialect.
_FUNCTION_WORDS = {"python": ("def",), "go": ("func",), "rust": ("fn",)}


def may_have_functions(dialect: str, text: str) -> bool:
    """Whether a text holds a word without which no rule makes a function or a method."""
    return any(word in text for word in _FUNCTION_WORDS.get(dialect, ("function", "=>", "class")))


def functions(tree: Tree) -> list[tuple[int, int, str | None]]:
    """(begin, end, documentation) of the functions and methods of a text, in order: the ranges and
    documentation that ``declarations`` gives, without the rest."""
    text, d, out = tree.text, tree.dialect, []
    if d == "python":
        blocks = _blocks(tree)
        return [(a, b, _doc_of_block(tree, blocks, a, b)) for a, b in tree.spans("Def")]
    if d in ("go", "rust"):
        found = tree.spans("Func" if d == "go" else "Fn")
    else:
        bodies = {e for _, e in tree.spans("MethodBody")}
        found = tree.spans("FunctionDecl") + [x for x in tree.spans("Member") if x[1] in bodies]
        of = [x for x in tree.spans("VarStmt") if text.find("=>", *x) >= 0 or text.find("function", *x) >= 0]
        found += [x for x in of if (m := _VARIABLE.match(text, *x)) and m[3]]
    for begin, end in found:
        before = text[max(0, begin - 60) : begin]
        if before.rstrip().endswith(_MODIFIER_ENDS) and (m := _MODIFIERS.search(before)):
            begin -= len(m[0])
        out.append((begin, end, comment_above(text, begin)))
    return sorted(out, key=lambda x: (x[0], -x[1]))


def declarations(tree: Tree, module: str = "", inside: bool = False) -> list[Declaration]:
    """What a text declares, in order. ``module`` begins the qualified names of Python and Rust;
    variables inside functions are left out unless ``inside``."""
    text, d = tree.text, tree.dialect
    separator = "::" if d == "rust" else "."
    blocks = _blocks(tree) if d == "python" else []
    out: list[Declaration] = []
    above: list[tuple[int, str, str]] = [(len(text) + 1, module if d in ("python", "rust") else "", "")]  # end, scope, kind
    for begin, end, kind, name, own in _found(tree):
        while above[-1][0] <= begin:
            above.pop()
        scope, within = above[-1][1], above[-1][2]
        if within in FUNCTIONS and kind in ("variable", "constant") and not inside:
            continue
        if kind == "function" and (within in ("class", "impl", "trait") or d == "rust" and within == "module"):
            kind = "method"
        qualified = _qualified(_qualified("", separator, own), separator, name) if own else _qualified(scope, separator, name)
        if kind == "impl":
            above.append((end, qualified, kind))
            continue
        head = text[begin:end]
        if d == "python":
            exported = not name.startswith("_")
            doc = _doc_of_block(tree, blocks, begin, end) if kind in ("function", "method", "class") else comment_above_hash(text, begin)
        else:
            doc = comment_above(text, begin)
            if d == "rust":
                exported = head.startswith("pub")
            elif d == "go":
                exported = name[:1].isupper()
            else:
                exported = head.startswith("export") or kind in ("method", "variable") and within == "class" and not re.match(r"(?:[^(={;]*\b)?(?:private|protected)\b", head) and not name.startswith("#")
        out.append(Declaration(kind, name, qualified, begin, end, None if kind in ("constant", "variable") else _head(tree, kind, begin, end), exported, doc))
        if kind in ("class", "trait", "module", "interface", "function", "method", "enum"):
            above.append((end, qualified, kind))
    return out


def comment_above_hash(text: str, at: int) -> str | None:
    """The lines of ``#`` comments right above an offset."""
    lines: list[str] = []
    line = text.rfind("\n", 0, at)
    while line > 0:
        before = text.rfind("\n", 0, line)
        body = text[before + 1 : line].strip()
        if not body.startswith("#"):
            break
        lines.append(body)
        line = before
    return "\n".join(reversed(lines)) or None


def references(tree: Tree) -> list[Reference]:
    """Calls, instantiations, inheritance and used types of a text, in order of place."""
    text, d, out = tree.text, tree.dialect, []

    def add(kind: str, name: str, begin: int) -> None:
        out.append(Reference(kind, name, begin, begin + len(name)))

    for begin, _ in tree.spans("Args" if d in ("python", "js", "jsx", "ts", "tsx") else "Call"):
        piece = text[max(0, begin - 200) : begin]
        m = _CALLEE.search(piece.rstrip())
        if m and not re.search(r"\b(?:class|def|func|fn)\s+\w*$", piece.rstrip()):
            name, at = m[2], max(0, begin - 200) + m.start(2)
            add("instantiation" if m[1] or d == "python" and name[:1].isupper() else "call", name, at)
    if d == "python":
        for begin, end in tree.spans("Class"):
            if m := re.compile(r"class\s+\w+\s*(?:\[[^\]]*\])?\s*\(([^()]*)\)").match(text, begin, end):
                for b in re.finditer(r"(?:^|,)\s*([\w.]+)\s*(?=,|$)", m[1]):
                    name = b[1].rpartition(".")[2]
                    add("extends", name, m.start(1) + b.end(1) - len(name))
    elif d == "rust":
        for begin, end in tree.spans("Impl"):
            if (m := _IMPL.match(text, begin, end)) and m[1]:
                name = m[1].rpartition("::")[2]
                add("implements", name, m.end(1) - len(name))
        for begin, _ in tree.spans("StructBody"):
            if m := re.search(r"([^\W\d]\w*)\s*$", text[max(0, begin - 120) : begin]):
                add("instantiation", m[1], max(0, begin - 120) + m.start(1))
    elif d == "go":
        for begin, _ in tree.spans("Literal"):
            if m := re.search(r"(?<![\w\].])([^\W\d]\w*)\s*$", text[max(0, begin - 120) : begin]):
                add("instantiation", m[1], max(0, begin - 120) + m.start(1))
        for begin, end in tree.spans("TypeSpec"):
            for m in re.compile(r"(?m)^[ \t]*\*?(?:\w+\.)?([A-Z]\w*)[ \t]*(?:`[^`]*`)?[ \t]*$").finditer(text, begin, end):
                add("extends", m[1], m.start(1))
    else:
        for begin, end in tree.spans("Heritage"):
            if m := re.compile(r"(?:[\w$]+\.)*([^\W\d][\w$]*)").match(text, begin, end):
                add("extends", m[1], m.start(1))
        for rule, word, kind in (("ClassDecl", "implements", "implements"), ("Interface", "extends", "extends")) if d in ("ts", "tsx") else ():
            for begin, end in tree.spans(rule):
                if m := re.compile(rf"[^{{]*?\b{word}\s+([^{{]*)").match(text, begin, end):
                    for b in re.finditer(r"(?:^|,)\s*(?:[\w$]+\.)*([^\W\d][\w$]*)", re.sub(r"<[^<>]*>", lambda x: " " * len(x[0]), m[1])):
                        add(kind, b[1], m.start(1) + b.start(1))
    if d in ("rust", "go", "ts", "tsx"):
        for begin, end in tree.spans("Type"):
            if m := _HEAD.match(text, begin, end):
                name = re.split(r"\.|::", m[1])[-1]
                add("type_usage", name, m.end(1) - len(name))
    return sorted(set(out), key=lambda r: (r.begin, r.end, r.kind))
