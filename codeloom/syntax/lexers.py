"""Lexers that offer the recogniser the terminals at a position.

``END`` is the end of the text. A position without a valid terminal offers ``BAD``, which no
grammar knows. Where a language lets one text be read in several ways the lexer offers all.

Most of a text is taken in pieces, a token with the blanks at it, by one call of a regular
expression, and what a piece offers is looked up by its text. Damaged texts, and what pieces do not
cover, are lexed token by token, with the same result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import accumulate

from codeloom.syntax.gll import OFFERS, Tokens, offer

_END, _BAD = offer(("END",)), offer(("BAD",))


def _damaged(offers: list[int], nexts: list, begins: list[int], stops: list[int], at: int, size: int) -> Tokens:
    """The tokens before a place where the text has none."""
    offers.append(_BAD)
    nexts.append(len(offers))
    begins.append(at)
    stops.append(at)
    return _listed(offers, nexts, begins, stops, size)


def _listed(offers: list[int], nexts: list, begins: list[int], stops: list[int], size: int) -> Tokens:
    """Tokens that were all found beforehand; ``stops`` holds the end of each."""
    offers.append(_END)
    begins.append(size)
    return Tokens(offers, nexts, begins.__getitem__, lambda at: stops[at - 1] if at else 0)


class _Known(dict):
    """What pieces of text stand for, by the piece; the short ones are kept."""

    def __init__(self, kind: Callable[[str], object]):
        self.kind = kind

    def __missing__(self, piece: str) -> object:
        out = self.kind(piece)
        if len(piece) <= 40:
            if len(self) >= 1 << 16:
                self.clear()
            self[piece] = out
        return out


#: Marks of pieces that are no plain token: nothing, a line end, a text to be lexed token by token, ...
_SKIP, _LINE, _SLOW, _LATER = -1, -2, -3, -4
_NEXT = list(range(1, 1 << 12))


def _following(size: int) -> list[int]:
    """The positions behind the first ``size`` ones and more, where each token is one position."""
    if len(_NEXT) < size:
        _NEXT.extend(range(len(_NEXT) + 1, 2 * size))
    return _NEXT


def _pieces(find: Callable, text: str, at: int, known: _Known) -> tuple[list[str], list[int], list[int]] | None:
    """The pieces from ``at`` on, where each begins and the last ends, and what they stand for; None
    where not all of the text is covered. Pieces that stand for nothing are left out at the end."""
    pieces = find(text, at)
    edges = list(accumulate(map(len, pieces), initial=at))
    if edges[-1] != len(text):
        return None
    codes = list(map(known.__getitem__, pieces))
    while codes and codes[-1] == _SKIP:
        codes.pop()
    return None if _SLOW in codes else (pieces, edges, codes)


def _of_pieces(offers: list[int], nexts: list, of: list[int], pieces: list[str], edges: list[int], lead: Callable, size: int) -> Tokens:
    """Tokens of pieces. ``of`` has the number of a token's piece, or its complement where the token
    is no text of its own but stands at the end of the piece."""
    offers.append(_END)

    def begins(at: int) -> int:
        if at >= len(of):
            return size
        k = of[at]
        return edges[k] + lead(pieces[k]).end() if k >= 0 else edges[-k]

    def stops(at: int) -> int:
        at -= 1
        while at >= 0 and of[at] < 0:
            at -= 1
        return edges[of[at] + 1] if at >= 0 else 0

    return Tokens(offers, nexts, begins, stops)


def _numbers(words: frozenset[str], soft: frozenset[str] = frozenset(), name: str = "NAME") -> dict[str, int]:
    """Offers of the words of a language; soft words are names as well."""
    return {w: offer((w,)) for w in words} | {w: offer((name, w)) for w in soft}


# ---------------------------------------------------------------- Python

_PY_STRING = re.compile(
    r"""([rRbBuUfFtT]{0,2})(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')""", re.S
)
_PY_STRING_START = re.compile(r"""(?<!\w)([rRbBuUfFtT]{0,2})(\"\"\"|'''|"|')""")
_PY_TOKEN = re.compile(
    r"""[ \t\f]*(?:([rRbBuUfFtT]{0,2}(?:"|'))|([^\W\d]\w*)|((?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w))"""
    r"""|(\r\n|\r|\n)|(\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|>>|<<|<=|>=|==|!=|[-+*/%@&|^]=|[-+*/%@&|^~<>()\[\]{},:.;=])|(\#[^\r\n]*)|(\\(?:\r\n|\r|\n))|\Z)"""
)
_PY_WORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)
_PY_KINDS = _numbers(_PY_WORDS, frozenset(("match", "case", "type")))
_PY_OPS = {op: offer((op,)) for op in "**= //= >>= <<= ... -> := ** // >> << <= >= == != -= += *= /= %= @= &= |= ^= - + * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; =".split()}
_NAME, _STRING, _NUMBER, _NEWLINE, _INDENT, _DEDENT = (offer((k,)) for k in ("NAME", "STRING", "NUMBER", "NEWLINE", "INDENT", "DEDENT"))
_PY_PREFIXES = frozenset(("", "r", "b", "u", "f", "t", "rb", "br", "rf", "fr", "rt", "tr"))
_CLOSE = {"(": ")", "[": "]", "{": "}"}


def _fstring(text: str, at: int, quote: str, exprs: list[str]) -> int:
    """The end of an f-string whose opening quote ends at ``at``, or -1; its expressions go to ``exprs``."""
    while at < len(text):
        if text.startswith(quote, at):
            return at + len(quote)
        two = text[at : at + 2]
        c = two[0]
        if c == "\n" and len(quote) == 1 or c == "}" and two != "}}":
            return -1
        if two in ("{{", "}}") or c == "\\":
            at += 2
        elif c == "{":
            at = _field(text, at + 1, quote, exprs)
            if at < 0:
                return -1
        else:
            at += 1
    return -1


def _field(text: str, at: int, quote: str, exprs: list[str]) -> int:
    """The end of a replacement field that begins at ``at``, or -1."""
    begin, stack = at, []
    while at < len(text):
        c = text[at]
        if m := _PY_STRING_START.match(text, at):
            q = m[2]
            if "f" in m[1].lower() or "t" in m[1].lower():
                at = _fstring(text, m.end(), q, exprs)
            else:
                m = _PY_STRING.match(text, at)
                at = m.end() if m else -1
            if at < 0:
                return -1
            continue
        if not stack and (c in "}:" or c == "!" and text[at + 1 : at + 2] != "="):
            exprs.append(re.sub(r"(?<![=!<>])=\s*$", "", text[begin:at]))
            if c == "!":
                m = re.compile(r"!\s*[rsa]\s*(?=[:}])").match(text, at)
                if m is None:
                    return -1
                at = m.end()
                c = text[at]
            if c == "}":
                return at + 1
            at += 1
            while at < len(text):  # the format
                c = text[at]
                if c == "}":
                    return at + 1
                if c == "{":
                    at = _field(text, at + 1, quote, exprs)
                    if at < 0:
                        return -1
                elif text.startswith(quote, at) or c == "\n" and len(quote) == 1:
                    return -1
                else:
                    at += 1
            return -1
        if c in "([{":
            stack.append(_CLOSE[c])
        elif c in ")]}" and (not stack or stack.pop() != c):
            return -1
        at += 1
    return -1


#: A word as most are.
_WORD = r"[A-Za-z_][A-Za-z_0-9]*+"
_PY_LEAD = re.compile(r"(?:[ \t\f]|\\(?:\r\n|\r|\n))*")
_PY_LINES = r"(?:[ \t\f]*(?:\#[^\r\n]*)?(?:\r\n|\r|\n))"
_PY_FIRST = re.compile(rf"{_PY_LINES}*[ \t\f]*")
_PY_PIECE = re.compile(
    rf"""([ \t\f]*+(?:\\(?:\r\n|\r|\n)[ \t\f]*)*+(?:{_WORD}(?![\w"'])|[()\[\]{{}},]|\.(?![\d.])|=(?!=)|:(?!=)|{_PY_LINES}++[ \t\f]*"""
    r"""|[rRbBuUfFtT]{0,2}(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|[^\W\d]\w*|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|>>|<<|<=|>=|==|!=|[-+*/%@&|^]=|[-+*/%@&|^~<>;]|\.(?!\d)"""
    r"""|(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w)"""
    r"""|(?:\#[^\r\n]*)?\Z))|.+""",
    re.S,
)
_PY_BRACKETS = {offer((a,)): offer((b,)) for a, b in _CLOSE.items()}
_PY_MARKS = frozenset((*_PY_BRACKETS, *_PY_BRACKETS.values(), _LINE, _LATER))


def _python_kind(piece: str) -> int:
    word = piece.lstrip(" \t\f\\\r\n")
    if not word:
        return _SLOW if "\\" in piece else _LINE if "\n" in piece or "\r" in piece else _SKIP
    if word[0] == "#":
        return _LINE if "\n" in word or "\r" in word else _SLOW if "\\" in piece[: -len(word)] else _SKIP
    if (s := _PY_STRING_START.match(word)) is not None:
        prefix = s[1].lower()
        return _SLOW if prefix not in _PY_PREFIXES else _LATER if "f" in prefix or "t" in prefix else _STRING
    if word in _PY_OPS:
        return _PY_OPS[word]
    if word[0].isdecimal() or word[0] == ".":
        return _SLOW if word[0] == "0" and re.fullmatch(r"0[\d_]*[1-9][\d_]*", word) else _NUMBER
    return _PY_KINDS.get(word, _NAME)


def _width(piece: str) -> tuple[int, int]:
    """The columns of the blanks behind the last line end, with tabs of eight columns, and of one."""
    wide = narrow = 0
    for c in piece[max(piece.rfind("\n"), piece.rfind("\r")) + 1 :]:
        wide, narrow = (0, 0) if c == "\f" else ((wide // 8 + 1) * 8, narrow + 1) if c == "\t" else (wide + 1, narrow + 1)
    return wide, narrow


_PY_KNOWN, _PY_WIDTHS = _Known(_python_kind), _Known(_width)


def python_lexer(text: str, exprs: list[str]) -> Tokens:
    """Tokens with NEWLINE, INDENT and DEDENT, up to the first damage; the expressions inside
    f-strings go to ``exprs``."""
    inner: list[str] = []
    if (tokens := _python_pieces(text, inner)) is None:
        return _python_tokens(text, exprs)
    exprs += inner
    return tokens


def _python_pieces(text: str, exprs: list[str]) -> Tokens | None:
    """The tokens of an undamaged text."""
    n = len(text)
    first = _PY_FIRST.match(text, 1 if text.startswith("\ufeff") else 0)
    at = first.end()
    if "\0" in text or text.startswith("\\", at) or (found := _pieces(_PY_PIECE.findall, text, at, _PY_KNOWN)) is None:
        return None
    pieces, edges, codes = found
    offers: list[int] = []
    of: list[int] = []
    levels = [(0, 0)]
    if codes and (top := _PY_WIDTHS[first[0]]) != (0, 0):
        if not (top[0] and top[1]):
            return None
        levels.append(top)
        offers.append(_INDENT)
        of.append(-1)
    closing: list[int] = []
    done = 0
    for i in [i for i, code in enumerate(codes) if code in _PY_MARKS]:
        code = codes[i]
        if code == _LINE:
            offers += codes[done:i]
            of += range(done, i)
            done = i + 1
            if closing:
                continue
            offers.append(_NEWLINE)
            of.append(~i)
            if done == len(codes):
                break
            if text[edges[done]] == "\\":
                return None
            width = _PY_WIDTHS[pieces[i]]
            top = levels[-1]
            if width == top:
                continue
            if width[0] > top[0] and width[1] > top[1]:
                levels.append(width)
                offers.append(_INDENT)
                of.append(~i)
                continue
            if (width[0] > top[0]) != (width[1] > top[1]) or (width[0] == top[0]) != (width[1] == top[1]):
                return None
            while width[0] < levels[-1][0]:
                levels.pop()
                offers.append(_DEDENT)
                of.append(~i)
            if levels[-1] != width:
                return None
        elif code == _LATER:
            begin = edges[i] + _PY_LEAD.match(pieces[i]).end()
            s = _PY_STRING_START.match(text, begin)
            if s is None or _fstring(text, s.end(), s[2], exprs) != edges[i + 1]:
                return None
            codes[i] = _STRING
        elif code in _PY_BRACKETS:
            closing.append(_PY_BRACKETS[code])
        elif not closing or closing.pop() != code:
            return None
    if closing:
        return None
    offers += codes[done:]
    of += range(done, len(codes))
    tail = [_NEWLINE] if offers and offers[-1] not in (_NEWLINE, _DEDENT, _INDENT) else []
    tail += [_DEDENT] * (len(levels) - 1)
    offers += tail
    of += [-len(edges) + 1] * len(tail)
    return _of_pieces(offers, _following(len(offers)), of, pieces, edges, _PY_LEAD.match, n)


def _python_tokens(text: str, exprs: list[str]) -> Tokens:
    """``python_lexer``, token by token."""
    offers: list[int] = []
    begins: list[int] = []
    stops: list[int] = []
    levels = [(0, 0)]
    closing: list[str] = []
    at, n, fresh, last = 1 if text.startswith("\ufeff") else 0, len(text), True, 0
    damaged = lambda at: _damaged(offers, list(range(1, len(offers) + 1)), begins, stops, at, n)
    match, kinds, ops = _PY_TOKEN.match, _PY_KINDS, _PY_OPS
    while True:
        if fresh and not closing:
            wide = narrow = 0  # with tabs of eight columns, and of one
            while at < n and text[at] in " \t\f":
                c = text[at]
                wide, narrow = (0, 0) if c == "\f" else ((wide // 8 + 1) * 8, narrow + 1) if c == "\t" else (wide + 1, narrow + 1)
                at += 1
            if at < n and text[at] not in "#\r\n" and not (text[at] == "\\" and text[at + 1 : at + 2] in ("\n", "\r")):
                top = levels[-1]
                if (wide > top[0]) != (narrow > top[1]) or (wide == top[0]) != (narrow == top[1]):
                    return damaged(at)
                if wide > top[0]:
                    levels.append((wide, narrow))
                    offers.append(_INDENT)
                    begins.append(at)
                    stops.append(last)
                else:
                    while wide < levels[-1][0]:
                        levels.pop()
                        offers.append(_DEDENT)
                        begins.append(at)
                        stops.append(last)
                    if levels[-1] != (wide, narrow):
                        return damaged(at)
            fresh = False
        m = match(text, at)
        if m is None:
            return damaged(at)
        which, end = m.lastindex, m.end()
        if which == 2:
            w = m[2]
            number = kinds.get(w, _NAME)
            begin = end - len(w)
        elif which == 5:
            w = m[5]
            number = ops[w]
            begin = end - len(w)
            if w in "([{":
                closing.append(_CLOSE[w])
            elif w in ")]}" and (not closing or closing.pop() != w):
                return damaged(at)
        elif which == 4:
            at = end
            if not closing:
                if offers and offers[-1] not in (_NEWLINE, _INDENT, _DEDENT):
                    offers.append(_NEWLINE)
                    begins.append(end)
                    stops.append(last)
                fresh = True
            continue
        elif which == 1:
            begin, prefix = m.start(1), m[1][:-1].lower()
            if prefix not in _PY_PREFIXES:
                return damaged(at)
            if "f" in prefix or "t" in prefix:
                s = _PY_STRING_START.match(text, begin)
                end = _fstring(text, s.end(), s[2], exprs) if s else -1
            else:
                s = _PY_STRING.match(text, begin)
                end = s.end() if s else -1
            if end < 0:
                return damaged(at)
            number = _STRING
        elif which == 3:
            w = m[3]
            if w[0] == "0" and re.fullmatch(r"0[\d_]*[1-9][\d_]*", w):
                return damaged(at)
            number, begin = _NUMBER, end - len(w)
        elif which == 6:
            at = end
            continue
        elif which == 7:
            if end >= n:
                return damaged(at)
            at = end
            continue
        else:
            break
        offers.append(number)
        begins.append(begin)
        stops.append(end)
        at = last = end
    if closing or "\0" in text:
        return damaged(at)
    tail = [_NEWLINE] if offers and offers[-1] not in (_NEWLINE, _DEDENT, _INDENT) else []
    for number in tail + [_DEDENT] * (len(levels) - 1):
        offers.append(number)
        begins.append(n)
        stops.append(last)
    return _listed(offers, list(range(1, len(offers) + 1)), begins, stops, n)


# ---------------------------------------------------------------- Go

_GO = re.compile(
    r"""[ \t\r]*(?:([^\W\d]\w*)|(\n)|(<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|<<|>>|&\^|[-+*%&|^]=|/=|[-+*%&|^<>=!()\[\]{},;:~]|\.(?!\d)|/(?![/*]))"""
    r"""|(0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?i?|\d[\d_]*\.?(?:[eE][+-]?\d+)?i?)"""
    r"""|(`[^`]*`|"(?:[^"\\\n]|\\.)*")|('(?:[^'\\\n]|\\(?:[abfnrtv\\'"]|[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}))')|(//[^\n]*)|(/\*.*?\*/)|\Z)""",
    re.S,
)
_GO_WORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
_GO_KINDS = _numbers(_GO_WORDS)
_GO_OPS = {op: offer((op,)) for op in "<<= >>= &^= ... && || <- ++ -- == != <= >= := << >> &^ -= += *= /= %= &= |= ^= - + * / % & | ^ < > = ! ( ) [ ] { } , ; . : ~".split()}
_STR, _NUM, _SEMI = offer(("STR",)), offer(("NUM",)), offer((";",))
_GO_ENDS = frozenset([_NAME, _NUM, _STR, *(offer((w,)) for w in ("break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"))])


_GO_LEAD = re.compile(r"[ \t\r]*")
_GO_PIECE = re.compile(
    rf"""([ \t\r]*+(?:{_WORD}(?!\w)|[()\[\]{{}},;]|\.(?![\d.])|(?:(?://[^\n]*)?\n[ \t\r]*)++"""
    r"""|[^\W\d]\w*|<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|<<|>>|&\^|[-+*%&|^]=|/=|[-+*%&|^<>=!:~]|\.(?!\d)|/(?![/*])"""
    r"""|0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?i?|\d[\d_]*\.?(?:[eE][+-]?\d+)?i?"""
    r"""|`[^`]*`|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\(?:[abfnrtv\\'"]|[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}))'|/\*.*?\*/|(?://[^\n]*)?\Z))|.+""",
    re.S,
)
_GO_MARKS = frozenset((_LINE, _SKIP))


def _go_kind(piece: str) -> int:
    m = _GO.match(piece)
    if (which := m.lastindex) == 1:
        return _GO_KINDS.get(m[1], _NAME)
    if which == 3:
        return _GO_OPS[m[3]]
    if which == 5:
        return _STR
    if which in (4, 6):
        return _NUM
    return _LINE if "\n" in piece else _SKIP


_GO_KNOWN = _Known(_go_kind)


def go_lexer(text: str) -> Tokens:
    """All tokens up to the first damage."""
    if "\0" in text or (found := _pieces(_GO_PIECE.findall, text, 1 if text.startswith("\ufeff") else 0, _GO_KNOWN)) is None:
        return _go_tokens(text)
    pieces, edges, codes = found
    offers: list[int] = []
    of: list[int] = []
    done = 0
    for i in [i for i, code in enumerate(codes) if code in _GO_MARKS] + [len(codes)]:
        offers += codes[done:i]
        of += range(done, i)
        done = i + 1
        if (i == len(codes) or codes[i] == _LINE) and offers and offers[-1] in _GO_ENDS:
            offers.append(_SEMI)
            of.append(-i)  # at the end of the piece before
    return _of_pieces(offers, _following(len(offers)), of, pieces, edges, _GO_LEAD.match, len(text))


def _go_tokens(text: str) -> Tokens:
    """``go_lexer``, token by token."""
    offers: list[int] = []
    begins: list[int] = []
    stops: list[int] = []
    at, n, last = 1 if text.startswith("\ufeff") else 0, len(text), 0
    match, kinds, ops = _GO.match, _GO_KINDS, _GO_OPS

    def line_end() -> None:
        if offers and offers[-1] in _GO_ENDS:
            offers.append(_SEMI)
            begins.append(at)
            stops.append(last)

    while True:
        m = match(text, at)
        if m is None:
            return _damaged(offers, list(range(1, len(offers) + 1)), begins, stops, at, n)
        which, end = m.lastindex, m.end()
        if which == 1:
            w = m[1]
            number, begin = kinds.get(w, _NAME), end - len(w)
        elif which == 3:
            w = m[3]
            number, begin = ops[w], end - len(w)
        elif which == 2:
            line_end()
            at = end
            continue
        elif which == 5:
            number, begin = _STR, m.start(5)
        elif which in (4, 6):
            number, begin = _NUM, m.start(which)
        elif which == 7:  # it stands before its newline, which decides
            at = end
            continue
        elif which == 8:
            if "\n" in m[8]:
                line_end()
            at = end
            continue
        else:
            break
        offers.append(number)
        begins.append(begin)
        stops.append(end)
        at = last = end
    line_end()
    if "\0" in text:
        return _damaged(offers, list(range(1, len(offers) + 1)), begins, stops, n, n)
    return _listed(offers, list(range(1, len(offers) + 1)), begins, stops, n)


# ---------------------------------------------------------------- Rust

_RS_TOKEN = re.compile(
    r"""\s*(?:(b?'(?:[^'\\\n\t]|\\(?:[nrt\\0'"]|x[\da-fA-F]{2}|u\{[\da-fA-F_]{1,8}\}))')|((?:br|cr|r)(\#*)".*?"\3(?!\#))|([bc]?"(?:[^"\\]|\\.)*")|((?:r\#)?[^\W\d]\w*)|(//[^\n]*)|(/\*)"""
    r"""|(<<=|>>=|\.\.\.|\.\.=|&&|\|\||->|=>|::|==|!=|<=|>=|<<|>>|\.\.|[-+*/%&|^]=|[-+*/%&|^<>=!()\[\]{},;.:?@\#$~])|('[^\W\d]\w*)"""
    r"""|((?:0x[\da-fA-F_]+(?:[ui](?:8|16|32|64|128|size))?|0b[01_]+(?:[ui](?:8|16|32|64|128|size))?|0o[0-7_]+(?:[ui](?:8|16|32|64|128|size))?|\d[\d_]*(?:\.(?![.\w])|(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[uif](?:8|16|32|64|128|size))?)(?!\w))|\Z)""",
    re.S,
)
_RS_WORDS = frozenset(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while abstract become box do final macro override priv typeof unsized virtual yield try".split()
)
_RS_KINDS = _numbers(_RS_WORDS, frozenset(("union", "auto", "default", "macro_rules", "raw"))) | {"_": offer(("_",))}
_RS_OPS = {op: offer((op,)) for op in "... ..= && || <<= -> => :: == != <= .. -= += *= /= %= &= |= ^= - + * / % & | ^ < > = ! ( ) [ ] { } , ; . : ? @ # $ ~".split()}
#: Operators that may be read as several (where brackets of types meet): what each of their places
#: offers, with the lengths. ``>1`` and ``<1`` are halves, which only type arguments take.
_RS_SPLIT = {
    ">>=": ((">>=", 3, ">1", 1), (">=", 2, ">1", 1), ("=", 1)), ">>": ((">>", 2, ">1", 1), (">", 1)), ">=": ((">=", 2, ">1", 1), ("=", 1)),
    "<<": (("<<", 2, "<1", 1), ("<", 1)),
}
_RS_PARTS = {op: [(offer(p[::2]), p[1::2]) for p in places] for op, places in _RS_SPLIT.items()}
_CHAR, _LIFE = offer(("CHAR",)), offer(("LIFE",))
_COMMENT_EDGE = re.compile(r"/\*|\*/")


#: Blanks and comments, which may hold one more level of comments.
_RS_INNER = r"(?:[^*/]++|\*(?!/)|/(?!\*)"
_RS_SPACE = rf"\s*+(?:(?://[^\n]*|/\*{_RS_INNER}|/\*{_RS_INNER})*+\*/)*+\*/)\s*+)*+"
_RS_LEAD = re.compile(_RS_SPACE)
_RS_PIECE = re.compile(
    rf"""({_RS_SPACE}"""
    rf"""(?:{_WORD}(?![\w'"\#])|[()\[\]{{}},;@?]|\.(?!\.)|:(?!:)"""
    r"""|b?'(?:[^'\\\n\t]|\\(?:[nrt\\0'"]|x[\da-fA-F]{2}|u\{[\da-fA-F_]{1,8}\}))'|(?:br|cr|r)(?:".*?"(?!\#)|\#".*?"\#(?!\#)|\#\#".*?"\#\#(?!\#))|[bc]?"(?:[^"\\]|\\.)*"|(?!(?:br|cr|r)\#*")(?:r\#)?[^\W\d]\w*"""
    r"""|<<=|>>=|\.\.\.|\.\.=|&&|\|\||->|=>|::|==|!=|<=|>=|<<|>>|\.\.|[-+*%&|^]=|/=|[-+*%&|^<>=!\#$~]|/(?![/*])|'[^\W\d]\w*"""
    r"""|(?:0x[\da-fA-F_]+(?:[ui](?:8|16|32|64|128|size))?|0b[01_]+(?:[ui](?:8|16|32|64|128|size))?|0o[0-7_]+(?:[ui](?:8|16|32|64|128|size))?|\d[\d_]*(?:\.(?![.\w])|(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[uif](?:8|16|32|64|128|size))?)(?!\w)|\Z))|.+""",
    re.S,
)


def _rust_kind(piece: str) -> int:
    at = _RS_LEAD.match(piece).end()
    if at == len(piece):
        return _SKIP
    m = _RS_TOKEN.match(piece, at)
    which = m.lastindex
    if which == 5:
        return _RS_KINDS.get(m[5], _NAME)
    if which == 8:
        return _LATER if m[8] in _RS_PARTS else _RS_OPS[m[8]]
    return _CHAR if which == 1 else _STR if which in (2, 3, 4) else _LIFE if which == 9 else _NUM


_RS_KNOWN = _Known(_rust_kind)


def rust_lexer(text: str) -> Tokens:
    """All tokens up to the first damage."""
    at, n = 1 if text.startswith("\ufeff") else 0, len(text)
    if text.startswith("#!", at) and not re.compile(r"#!\s*\[").match(text, at):
        at = text.find("\n", at) + 1 or n
    if (found := _pieces(_RS_PIECE.findall, text, at, _RS_KNOWN)) is None:
        return _rust_tokens(text, at)
    pieces, edges, codes = found
    if _LATER not in codes:
        return _of_pieces(codes, _following(len(codes)), list(range(len(codes))), pieces, edges, _RS_LEAD.match, n)
    offers: list[int] = []
    nexts: list = []
    of: list[int] = []
    inside: dict[int, int] = {}  # where the places of these operators begin
    done = 0
    for i in [i for i, code in enumerate(codes) if code == _LATER]:
        offers += codes[done:i]
        of += range(done, i)
        nexts += range(len(nexts) + 1, len(offers) + 1)
        done = i + 1
        begin = edges[i] + _RS_LEAD.match(pieces[i]).end()
        here = len(offers)
        for k, (number, lens) in enumerate(_RS_PARTS[text[begin : edges[i + 1]]]):
            offers.append(number)
            nexts.append(here + k + lens[0] if len(lens) == 1 else tuple(here + k + x for x in lens))
            of.append(i)
            inside[here + k] = begin + k
    offers += codes[done:]
    of += range(done, len(codes))
    nexts += range(len(nexts) + 1, len(offers) + 1)
    plain = _of_pieces(offers, nexts, of, pieces, edges, _RS_LEAD.match, n)
    return plain._replace(begins=lambda at: inside[at] if at in inside else plain.begins(at), stops=lambda at: inside[at - 1] + 1 if at - 1 in inside else plain.stops(at))


def _rust_tokens(text: str, at: int) -> Tokens:
    """``rust_lexer``, token by token from ``at`` on."""
    n = len(text)
    offers: list[int] = []
    nexts: list = []
    begins: list[int] = []
    stops: list[int] = []
    match, kinds, ops, parts = _RS_TOKEN.match, _RS_KINDS, _RS_OPS, _RS_PARTS
    while True:
        m = match(text, at)
        if m is None:
            return _damaged(offers, nexts, begins, stops, at, n)
        which, end = m.lastindex, m.end()
        if which == 5:
            w = m[5]
            number, begin = kinds.get(w, _NAME), end - len(w)
        elif which == 8:
            w = m[8]
            begin = end - len(w)
            if (split := parts.get(w)) is not None:
                here = len(offers)
                for i, (number, lens) in enumerate(split):
                    offers.append(number)
                    nexts.append(here + i + lens[0] if len(lens) == 1 else tuple(here + i + k for k in lens))
                    begins.append(begin + i)
                    stops.append(begin + i + 1)
                at = end
                continue
            number = ops[w]
        elif which == 6:
            at = end
            continue
        elif which == 7:
            depth, at = 1, end
            while depth:
                edge = _COMMENT_EDGE.search(text, at)
                if edge is None:
                    return _damaged(offers, nexts, begins, stops, at, n)
                depth += 1 if edge[0] == "/*" else -1
                at = edge.end()
            continue
        elif which is None:
            break
        else:
            if which == 3:
                which = 2
            begin = m.start(which)
            number = _CHAR if which == 1 else _STR if which in (2, 4) else _LIFE if which == 9 else _NUM
        offers.append(number)
        nexts.append(len(offers))
        begins.append(begin)
        stops.append(end)
        at = end
    return _listed(offers, nexts, begins, stops, n)


# ---------------------------------------------------------------- JavaScript, TypeScript

_JS_SKIP = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*.*?\*/)+", re.S)
_JS_BREAK = re.compile(r"[\n\r\u2028\u2029]")
_JS_TOKEN = re.compile(
    r"""((?:[^\W\d]|\$)(?:\w|[$\u200c\u200d])*)"""
    r"""|(>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\*\*|<<|>>|[-+*/%&|^]=|[-+*/%&|^~!<>=?:;,(){}\[\]@]|\.(?!\d))"""
    r"""|((?:0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:0|[1-9][\d_]*)n|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)(?![\w$]))"""
    r"""|("(?:[^"\\\n\r]|\\(?:\r\n|.))*"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*')|(`(?:[^`\\$]|\\.|\$(?!\{))*`)|(`(?:[^`\\$]|\\.|\$(?!\{))*\$\{)|(\#(?:[^\W\d]|\$)[\w$]*)""",
    re.S,
)
_JS_PLAIN = (None, None, None, "NUM", "STR", "TFULL", "THEAD", "PRIV")
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*(?!\w)")
_JS_TREST = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)
_JS_SPECIAL = re.compile(r"[\\`]|\$\{")
_JS_END = offer(("END", "ASI"))
_JS_JSXTEXT = re.compile(r"[^{}<>]+")
_JS_JSXID = re.compile(r"[^\W\d][\w$]*(?:-[\w$]*)+")
_JS_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
#: Words with a meaning of their own that are names elsewhere.
_JS_SOFT = frozenset(
    "let static async await yield of get set as from type interface namespace module declare abstract readonly public private protected override implements keyof infer is asserts satisfies unique accessor global require out target meta using".split()
)
_JS_SPACE = frozenset(" \t\n\r\v\f/")
_JS_KINDS = {w: offer(("IDNAME", w)) for w in _JS_WORDS} | {w: offer(("IDNAME", "NAME", w)) for w in _JS_SOFT}
_JS_NAME = offer(("IDNAME", "NAME"))
_JS_OFFERS = {k: offer((k,)) for k in (
    ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- ** << >> -= += *= /= %= &= |= ^= - + * / % & | ^ ~ ! < > = ? : ; , ( ) { } [ ] @ . NUM STR TFULL THEAD PRIV"
).split()}
_JS_LABEL = {n: offer((*OFFERS[n], "LABEL")) for n in (_JS_NAME, *_JS_KINDS.values()) if OFFERS[n][1] == "NAME"}
#: The same offers behind a line break, where a semicolon may be left out.
_JS_ASI = {n: offer((*OFFERS[n], "ASI")) for n in (_JS_NAME, *_JS_KINDS.values(), *_JS_OFFERS.values(), *_JS_LABEL.values())}


_JS_COLON, _JS_BRACE = _JS_OFFERS[":"], _JS_OFFERS["}"]
#: What a closing brace offers outside of templates, without elements and with them.
_JS_BRACES = {False: offer(("}", "ASI")), True: offer(("}", "RB", "ASI"))}


def _js_run(jsx: bool, templates: bool) -> Callable[..., list[str]]:
    """A token that can be read in one way only (or is a closing brace, where no template may go on), with
    the blanks and line comments behind it; group 1 is empty from a place on where there is none. In
    dialects with elements no text may begin behind it."""
    brace = "" if templates else r"|\}(?=\s)" if jsx else r"|\}"
    word, arrow, more = (r"(?!-)", r"=>(?=\s)", brace) if jsx else ("", "=>", r"|>(?![>=])" + brace)
    return re.compile(
        rf"""((?>(?:[A-Za-z_$][A-Za-z_$0-9]*+(?![\w\u200c\u200d]){word}|[(){{\[\],;:]|\.(?![\d.])"""
        r"""|"(?:[^"\\\n\r]|\\(?:\r\n|.))*"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*'"""
        rf"""|{arrow}|===|!==|\*\*=|&&=|\|\|=|\?\?=|\.\.\.|==|!=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\*\*|[-+*%&|^]=|[-+*%&|^~!?@]|=(?!>)|<(?![<=]){more}"""
        rf"""|(?>(?:[^\W\d]|\$)(?:\w|[$\u200c\u200d])*){word}"""
        r"""|(?:0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:0|[1-9][\d_]*)n|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)(?![\w$])"""
        r"""|`(?:[^`\\$]|\\.|\$(?!\{))*`)[\s\ufeff]*+(?://[^\n\r\u2028\u2029]*[\s\ufeff]*)*+)(?!/))|.+""",
        re.S,
    ).findall


_JS_RUNS = {x: _js_run(*x) for x in ((False, False), (False, True), (True, False), (True, True))}
#: Longest part of a text that is looked at in one go.
_JS_SPAN = 2000


def _js_kind(piece: str) -> int | tuple[int, int, bool]:
    """The offer of a piece; where a line ends or a comment stands behind its token, or it is a colon or a brace,
    (offer, size of the token or 0 without a comment, whether a line ends). The empty piece has (-1, 0, False)."""
    if not piece:
        return -1, 0, False
    m = _JS_TOKEN.match(piece)
    which, size = m.lastindex, m.end()
    number = _JS_KINDS.get(m[1], _JS_NAME) if which == 1 else _JS_OFFERS[m[2] if which == 2 else _JS_PLAIN[which]]
    ends, comment = _JS_BREAK.search(piece, size) is not None, "/" in piece[size:]
    return (number, size * comment, ends) if ends or comment or number in (_JS_COLON, _JS_BRACE) else number


_JS_KNOWN = _Known(_js_kind)


def js_lexer(text: str, jsx: bool) -> Tokens:
    """Tokens found as the parse asks for them, since what they are depends on it; from a place asked
    for, the tokens with one reading are found together, up to one with several."""
    n = len(text)
    offers = [-1] * (n + 1)
    nexts: list = [0] * (n + 1)
    broken = bytearray(n + 1)  # places with a line break before them
    behind: dict[int, int] = {}  # the end of the token before a place, where blanks or comments lie between
    templates = False
    begin = 0  # of the first token
    ahead = [0, -1, 0, ""]  # from, to, end and mark of the last search for the end of a template part
    match, plain, space = _JS_TOKEN.match, _JS_OFFERS, _JS_SPACE
    find, known, brace = _JS_RUNS[jsx, False], _JS_KNOWN, _JS_BRACES[jsx]

    def skip(at: int) -> int:
        two = text[at : at + 2]
        if two:
            c = two[0]
            if c not in space and c < "\x7f":
                return at
            if c == " " and (d := two[1:]) and d not in space and d < "\x7f":
                behind[at + 1] = at
                return at + 1
        m = _JS_SKIP.match(text, at)
        if m is None:
            return at
        end = m.end()
        if _JS_BREAK.search(text, at, end):
            broken[end] = 1
        behind[end] = at
        return end

    def lex(at: int) -> int:
        nonlocal templates, begin, find
        if at == 0:
            first = 1 if text.startswith("\ufeff") else 0
            if text.startswith("#!", first):
                m = _JS_BREAK.search(text, first)
                first = m.start() if m else n
            begin = start = skip(first)
            if start != 0:
                number = offers[0] = offers[start] if offers[start] >= 0 else lex(start)
                nexts[0] = nexts[start]
                return number
        if at >= n:
            offers[at] = number = _JS_END
            nexts[at] = at
            return number
        c = text[at]
        if c not in "/>#" and not (c == "}" and templates) and not (jsx and at and text[at - 1] in ">}"):
            run(at)
            if offers[at] >= 0:
                return offers[at]
        m = match(text, at)
        if m is None:
            return more(at, c, ["BAD"], [at])
        which = m.lastindex
        end = m.end()
        after = skip(end)
        if which == 1:
            number = _JS_KINDS.get(m[1], _JS_NAME)
            if after < n and (d := text[after]) in ":-":
                if d == ":":
                    number = _JS_LABEL.get(number, number)
                elif jsx and after == end and (j := _JS_JSXID.match(text, at)):
                    kinds = [*OFFERS[number], "JSXID"]
                    return more(at, c, kinds, [after] * (len(kinds) - 1) + [skip(j.end())])
        elif which == 2:
            word = m[2]
            number = plain[word]
            if c in "<>/}" and (c in "/}" or len(word) > 1 or jsx and c == ">"):
                kinds, ends = [word], [after]
                if c in "<>" and len(word) > 1:
                    kinds.append(c)
                    ends.append(at + 1)
                if jsx and c in ">}":  # text may begin right behind
                    kinds.append("GT" if c == ">" else "RB")
                    ends.append(at + 1)
                if c == "}" and templates:
                    if not ahead[0] <= end <= ahead[1]:
                        t = _JS_TREST.match(text, end)
                        first = _JS_SPECIAL.search(text, end)
                        ahead[:] = [end, first.start() if first else n, t.end() if t else 0, t[1] if t else ""]
                    if ahead[3]:
                        kinds.append("TTAIL" if ahead[3] == "`" else "TMID")
                        ends.append(skip(ahead[2]))
                return more(at, c, kinds, ends)
        else:
            number = plain[_JS_PLAIN[which]]
            if which == 6:
                templates, find = True, _JS_RUNS[jsx, True]
        if jsx and at and text[at - 1] in ">}":
            kinds = list(OFFERS[number])
            return more(at, c, kinds, [after] * len(kinds))
        if broken[at]:
            nexts[at] = (after,) * len(OFFERS[number]) + (at,)
            offers[at] = number = _JS_ASI[number]
            return number
        offers[at] = number
        nexts[at] = after
        return number

    def run(at: int) -> None:
        limit = at + _JS_SPAN if at + _JS_SPAN < n else n + 1  # a token that ends here may go on
        cut, last, before = broken[at], 0, -1
        for piece in find(text, at, at + _JS_SPAN):
            number = known[piece]
            end = at + len(piece)
            if end >= limit or offers[at] >= 0:
                break
            ends = False
            if number.__class__ is tuple:
                number, size, ends = number
                if number < 0:
                    break
                if ends:
                    broken[end] = 1
                if size:
                    behind[end] = at + size
                if number == _JS_BRACE:
                    offers[at] = brace
                    nexts[at] = (end, at + 1, at) if jsx else (end, at)
                    cut, last, before, at = ends, number, at, end
                    continue
                if number == _JS_COLON and before >= 0:
                    label(before, last, at)
            if cut:
                offers[at] = _JS_ASI[number]
                nexts[at] = (end,) * len(OFFERS[number]) + (at,)
            else:
                offers[at] = number
                nexts[at] = end
            cut, last, before, at = ends, number, at, end
        if before >= 0 and at < n and text[at] == ":":
            label(before, last, at)

    def label(at: int, number: int, end: int) -> None:
        """The colon behind a name makes it a label as well."""
        if (named := _JS_LABEL.get(number)) is not None:
            offers[at] = _JS_ASI[named] if broken[at] else named
            if broken[at]:
                nexts[at] = (end,) * len(OFFERS[named]) + (at,)

    def stop(at: int) -> int:
        end = behind.get(at)
        if end is None:
            end = at
            while end and (text[end - 1].isspace() or text[end - 1] == "\ufeff"):
                end -= 1
        return end

    def more(at: int, c: str, kinds: list[str], ends: list[int]) -> int:
        """The offer of a place that may be read in several ways."""
        if c == "/" and (r := _JS_REGEX.match(text, at)):
            kinds.append("REGEX")
            ends.append(skip(r.end()))
        if broken[at] or c == "}":
            kinds.append("ASI")
            ends.append(at)
        if jsx and at and text[at - 1] in ">}" and (t := _JS_JSXTEXT.match(text, at)):
            kinds.append("JSXTEXT")
            ends.append(t.end())
        offers[at] = number = offer(tuple(kinds))
        nexts[at] = tuple(ends)
        return number

    return Tokens(offers, nexts, lambda at: at or begin, stop, lex)
