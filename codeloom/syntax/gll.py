"""A generalised LL recogniser with a graph-structured stack, for grammars written as EBNF text.

A rule written ``Name :: body ;`` is called: it becomes one deterministic automaton over terminals
and called rules. A rule written ``Name : body ;`` is set into every place that names it before
the automata are made deterministic, so alternatives that begin alike share their beginning and
fork only where they differ. A set-in rule may name itself at its very end, which makes a loop.

A parse works off configurations (state, stack node, position). A stack node stands for one called
rule begun at one position and is shared by all callers; its edges say where to go on, and it
keeps the positions at which it has ended, so every called rule is recognised once per position
whatever the number of callers, left recursion included. One symbol of lookahead discards
configurations that cannot go on. Several start symbols (dialects) run over one stack graph.

A lexer may offer several terminals of different lengths at one position (a division sign or a
regular expression, ``>>`` or ``>``); the grammar takes those that fit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import NamedTuple

_SHIFT, _CALL, _RETURN, _FORK, _STOP = range(5)
_DSL = re.compile(r"'[^'\s]+'|[A-Za-z_]\w*(?:-\[[^\]]*\])?|::|%%|[()|*+?:;%]")

#: Offers (tuples of terminals that a lexer finds at a position) by number, shared by all grammars.
OFFERS: list[tuple[str, ...]] = []
_NUMBER: dict[tuple[str, ...], int] = {}


def offer(kinds: tuple[str, ...]) -> int:
    """The number of an offer."""
    n = _NUMBER.get(kinds)
    if n is None:
        n = _NUMBER[kinds] = len(OFFERS)
        OFFERS.append(kinds)
    return n


class Tokens(NamedTuple):
    """A text as the recogniser reads it.

    ``offers[p]`` is the number of the offer at position p, or -1 where ``lex`` is still to fill it
    in; ``nexts[p]`` is the position behind it, or a tuple with one position per terminal.
    ``begins`` and ``stops`` give, for a position, the text offset at which its token begins and
    the offset at which the token before it ends.
    """

    offers: list[int]
    nexts: list
    begins: Callable[[int], int]
    stops: Callable[[int], int]
    lex: Callable[[int], int] | None = None


def _read(toks: list[str], at: int) -> tuple[tuple, int]:
    """The alternatives from ``at`` on as nested tuples, and the place behind them."""
    choices: list[tuple] = []
    while True:
        items: list[tuple] = []
        while at < len(toks) and toks[at] not in ("|", ")"):
            if toks[at] == "(":
                item, at = _read(toks, at + 1)
                at += 1
            else:
                item, at = ("sym", toks[at]), at + 1
            while at < len(toks) and toks[at] in ("*", "+", "?", "%", "%%"):
                op, at = toks[at], at + 1
                if op[0] == "%":
                    if toks[at] == "(":
                        sep, at = _read(toks, at + 1)
                        at += 1
                    else:
                        sep, at = ("sym", toks[at]), at + 1
                    item = (op, item, sep)
                else:
                    item = (op, item)
            items.append(item)
        choices.append(("seq", items))
        if at >= len(toks) or toks[at] == ")":
            return ("alt", choices), at
        at += 1


class _Row(dict):
    """The actions of a state by offer, filled in as they are asked for."""

    def __init__(self, grammar: Grammar, state: int):
        self.grammar, self.state = grammar, state

    def __missing__(self, number: int) -> tuple:
        act = self[number] = self.grammar.actions(self.state, number)
        return act


class Grammar:
    """A compiled grammar. Terminals are quoted or in capitals; besides ``( ) | * + ?`` there are
    ``X % S`` (X once or more, with S between), ``X %% S`` (the same, S may also come last) and
    ``Name-['x' 'y']`` for a called Name that may not begin with these terminals."""

    def __init__(self, text: str):
        toks = _DSL.findall(re.sub(r"(?m)^\s*#.*$", "", text))
        self.rules: dict[str, tuple] = {}
        called: list[str] = []
        at = 0
        while at < len(toks):
            end = at + 2
            while toks[end] != ";":
                end += 1
            self.rules[toks[at]] = _read(toks[at + 2 : end], 0)[0]
            if toks[at + 1] == "::":
                called.append(toks[at])
            at = end + 1
        self.called = frozenset(called)
        self.barred: dict[str, frozenset[str]] = {}
        self.base: dict[str, str] = {}
        self.moves: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.owner: list[str] = []
        self.start: dict[str, int] = {}
        self.index = {name: i for i, name in enumerate(called)}
        for name in called:
            self._automaton(name)
        self._sets()
        self.starts = [self.start[n] for n in called]
        self.table = [_Row(self, s) for s in range(len(self.moves))]

    def _automaton(self, name: str) -> None:
        edges: list[list[tuple[str | None, int]]] = []

        def state() -> int:
            edges.append([])
            return len(edges) - 1

        made: dict[tuple[str, int], int] = {}

        def build(node: tuple, s: int, e: int, within: tuple[str, ...]) -> None:
            op = node[0]
            if op == "alt":
                for choice in node[1]:
                    build(choice, s, e, within)
            elif op == "seq":
                if not node[1]:
                    edges[s].append((None, e))
                for i, item in enumerate(node[1]):
                    to = e if i == len(node[1]) - 1 else state()
                    build(item, s, to, within)
                    s = to
            elif op == "?":
                edges[s].append((None, e))
                build(node[1], s, e, within)
            elif op == "*":
                m = state()
                edges[s].append((None, m))
                edges[m].append((None, e))
                build(node[1], m, m, within)
            elif op == "+":
                m, n = state(), state()
                edges[s].append((None, m))
                build(node[1], m, n, within)
                edges[n] += [(None, m), (None, e)]
            elif op in ("%", "%%"):
                m, n = state(), state()
                edges[s].append((None, m))
                build(node[1], m, n, within)
                edges[n].append((None, e))
                build(node[2], n, m, within)
                if op == "%%":
                    build(node[2], n, e, within)
            else:
                sym = node[1]
                if sym in self.rules and sym not in self.called:
                    first = made.get((sym, e))
                    if first is None:
                        if sym in within:
                            raise ValueError(f"{sym} must be called (::), it is recursive")
                        made[sym, e] = first = state()
                        build(self.rules[sym], first, e, (*within, sym))
                    edges[s].append((None, first))
                else:
                    edges[s].append((self._symbol(sym), e))

        begin, end = state(), state()
        build(self.rules[name], begin, end, (name,))
        closed_of: dict[int, frozenset[int]] = {}

        def closed(states: Iterable[int]) -> frozenset[int]:
            out: set[int] = set()
            for s0 in states:
                if s0 not in closed_of:
                    todo, seen = [s0], {s0}
                    while todo:
                        for sym, y in edges[todo.pop()]:
                            if sym is None and y not in seen:
                                seen.add(y)
                                todo.append(y)
                    closed_of[s0] = frozenset(x for x in seen if x == end or any(sym is not None for sym, _ in edges[x]))
                out |= closed_of[s0]
            return frozenset(out)

        first = closed([begin])
        number = {first: len(self.moves)}
        self.start[name] = base = len(self.moves)
        todo = [first]
        for now in todo:
            step: dict[str, set[int]] = {}
            for x in now:
                for sym, y in edges[x]:
                    if sym is not None:
                        step.setdefault(sym, set()).add(y)
            to = {}
            for sym, ys in step.items():
                nxt = closed(ys)
                if nxt not in number:
                    number[nxt] = base + len(number)
                    todo.append(nxt)
                to[sym] = number[nxt]
            self.moves.append(to)
            self.final.append(end in now)
            self.owner.append(name)

    def _symbol(self, sym: str) -> str:
        if sym[0] == "'":
            return sym[1:-1]
        if "-[" in sym:
            base, rest = sym.split("-[")
            self.base[sym], self.barred[sym] = base, frozenset(x.strip("'") for x in rest[:-1].split())
            if base not in self.called:
                raise ValueError(f"{base} must be called")
        elif sym in self.called:
            self.base[sym] = sym
        elif not sym.isupper():
            raise ValueError(f"no rule for {sym}")
        return sym

    def _sets(self) -> None:
        first: dict[str, set[str]] = {n: set() for n in self.called}
        nullable = {n: False for n in self.called}
        reach: list[set[str]] = [set() for _ in self.moves]  # terminals that can come next from a state, within its rule
        empties = list(self.final)  # whether the rule can end here without input
        none: frozenset[str] = frozenset()
        changed = True
        while changed:
            changed = False
            for s in range(len(self.moves) - 1, -1, -1):
                r, n = set(reach[s]), empties[s]
                for sym, t in self.moves[s].items():
                    base = self.base.get(sym)
                    if base is None:
                        r.add(sym)
                        continue
                    r |= first[base] - self.barred.get(sym, none)
                    if nullable[base]:
                        r |= reach[t]
                        n = n or empties[t]
                if len(r) != len(reach[s]) or n != empties[s]:
                    reach[s], empties[s], changed = r, n, True
            for name, s in self.start.items():
                if len(first[name]) != len(reach[s]) or nullable[name] != empties[s]:
                    first[name], nullable[name], changed = set(reach[s]), empties[s], True
        follow = {n: {"END"} for n in self.called}  # any rule can be a start
        changed = True
        while changed:
            changed = False
            for s, to in enumerate(self.moves):
                for sym, t in to.items():
                    base = self.base.get(sym)
                    if base is not None:
                        f = follow[base]
                        n = len(f)
                        f |= reach[t]
                        if empties[t]:
                            f |= follow[self.owner[s]]
                        changed |= len(f) != n
        self.first, self.nullable, self.follow, self.reach, self.empties = first, nullable, follow, reach, empties

    def actions(self, state: int, number: int) -> tuple:
        """What a state does at an offer."""
        kinds = OFFERS[number]
        out: list[tuple[int, int, int]] = []
        there = set(kinds)
        for sym, t in self.moves[state].items():
            base = self.base.get(sym)
            if base is None:
                if sym in there:
                    out.append((_SHIFT, kinds.index(sym), t))
                continue
            if self.barred.get(sym, frozenset()) & there:
                continue
            after = self.reach[t] | (self.follow[self.owner[state]] if self.empties[t] else set())
            if self.first[base] & there or self.nullable[base] and after & there:
                out.append((_CALL, self.index[base], t))
        if self.final[state] and self.follow[self.owner[state]] & there:
            out.append((_RETURN, 0, 0))
        return out[0] if len(out) == 1 else (_FORK, tuple(out), 0) if out else (_STOP, 0, 0)

    def parse(self, tokens: Tokens, starts: Iterable[str]) -> tuple[bool, list[dict[int, list]]]:
        """Whether the text derives from one of ``starts``, and the stack nodes of the parse: by
        called rule, then by the position where it begins."""
        # A node: its first edge (state, node), further edges, its first end, further ends, and the
        # configurations that were gone on with in it, kept while others wait.
        root: list = [0, None, None, -1, None, None]
        nodes: list[dict[int, list]] = [{} for _ in self.starts]
        todo: list[tuple] = []
        later = [self.start[s] for s in starts]  # one after the other, so that others need no marks meanwhile
        table, begin = self.table, self.starts
        states = len(table)
        offers, nexts, lex = tokens.offers, tokens.nexts, tokens.lex
        far = -1  # the furthest position of the configurations that came to an end
        while todo or later:
            state, node, pos, act = todo.pop() if todo else (later.pop(), root, 0, None)
            while True:
                if act is None:
                    number = offers[pos]
                    if number < 0:
                        number = lex(pos)
                    op, x, to = table[state][number]
                else:
                    op, x, to = act
                    act = None
                if op == _SHIFT:
                    state = to
                    pos = nexts[pos]
                    if pos.__class__ is tuple:
                        pos = pos[x]
                    if todo and todo[-1][2] < pos:  # those behind catch up, so that most forks are settled soon
                        behind = todo[-1]
                        todo[-1] = state, node, pos, None
                        state, node, pos, act = behind
                elif op == _CALL:
                    child = nodes[x].get(pos)
                    if child is None:
                        nodes[x][pos] = node = [to, node, None, -1, None, None]
                        state = begin[x]
                        continue
                    if not (child[0] == to and child[1] is node):
                        more = child[2]
                        if more is None:
                            more = child[2] = []
                        if not any(s == to and n is node for s, n in more):
                            more.append((to, node))
                            if child[3] >= 0:
                                for end in (child[3], *(child[4] or ())):
                                    if self._fresh(node, end * states + to):
                                        todo.append((to, node, end, None))
                    break
                elif op == _RETURN:
                    if node is root:
                        if "END" in OFFERS[offers[pos]]:
                            return True, nodes
                        break
                    if node[3] < 0:
                        node[3] = pos
                    elif pos == node[3] or node[4] is not None and pos in node[4]:
                        break
                    elif node[4] is None:
                        node[4] = {pos}
                    else:
                        node[4].add(pos)
                    more = node[2]
                    if more is None and not todo and pos > far:  # nothing else is or was here
                        state, node = node[0], node[1]
                        continue
                    callers = ((node[0], node[1]), *(more or ()))
                    node = None
                    for s, n in callers:
                        if self._fresh(n, pos * states + s):
                            if node is None:
                                state, node = s, n
                            else:
                                todo.append((s, n, pos, None))
                    if node is None:
                        break
                elif op == _FORK:
                    for a in x[1:]:
                        todo.append((state, node, pos, a))
                    act = x[0]
                else:
                    break
            if pos > far:
                far = pos
        return False, nodes

    @staticmethod
    def _fresh(node: list, mark: int) -> bool:
        """Whether a configuration in a node is new; it is remembered."""
        if node[5] is None:
            node[5] = {mark}
            return True
        if mark in node[5]:
            return False
        node[5].add(mark)
        return True

    def accepts(self, tokens: Tokens, starts: Iterable[str]) -> bool:
        """Whether the text behind ``tokens`` derives from one of ``starts``."""
        return self.parse(tokens, starts)[0]

    def spans(self, nodes: list[dict[int, list]], name: str) -> list[tuple[int, int]]:
        """(first, behind) positions of the called rule ``name`` wherever it was recognised, longest
        end each, in order. They are there even if the text as a whole was rejected."""
        return sorted([(at, max(node[3], *node[4]) if node[4] else node[3]) for at, node in nodes[self.index[name]].items() if node[3] >= 0])
