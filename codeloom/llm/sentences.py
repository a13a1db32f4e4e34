"""Sentence units of texts in many languages, with abbreviations learned from the corpus.

Layout first: fenced blocks, headings and list items are one unit each, blank lines end units.
Inside paragraphs every terminator is a candidate. Whether a period ends a sentence is decided by
statistics that are counted over all documents, per language, and tested by log-likelihood ratios:
words that stand before a period more often than chance and are followed by small letters or
numbers far more often than other words before a period (abbreviations, and those that never end a
sentence), pairs of a word before and a word after a period that belong together (collocations such
as an ordinal and its month), and words that follow sure ends far more often than they come
elsewhere (sentence starters). Brackets and quotations are never split.

Every row that passes its test is kept. While the rows are few they go to the tasks as they are;
beyond ``MODEL_ROWS`` each document is joined with the rows that its own words ask for.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut

#: A pair or word is kept from this log-likelihood ratio on (0.5 % level of chi square).
LEAST_LLR = 7.88
LEAST_COUNT = 5
#: A sentence starter needs a clearer sign, since ordinary names follow ends now and then as well.
STARTER_LLR = 30.0
#: Up to so many learned rows are held by every task; more are joined.
MODEL_ROWS = 200_000

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_HEADING = re.compile(r"\s*#{1,6}(?:\s|$)")
_ITEM = re.compile(r"\s*(?:[-*+]|(\d{1,9})[.)])\s")
_FENCE = re.compile(r"\s*(```+|~~~+)")
_PAIRS = {"(": ")", "[": "]", "（": "）", "［": "］", "「": "」", "『": "』", "【": "】", "《": "》", "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›"}
_CLOSERS = frozenset(c for v in _PAIRS.values() for c in v) | {'"', "`", "'"}
_BRACKETS = frozenset("([（［【")
_TERM = re.compile(r"[.!?…]+(?=[\s)\]）］」』】》”“»«›\"`']|$)|[。！？｡]+|[।॥؟۔;;]")
_GROUPED = re.compile(r"[()\[\]（）［］「」『』【】《》“”„«»‹›\"`']")
_MARK = re.compile(r"[()\[\]（）［］「」『』【】《》“”„«»‹›\"`]|[.!?…]+|[。！？｡]+|[।॥؟۔;;]")
_SINGLE = re.compile(r"(?<![\w'])'(?=\w)(?:[^']|(?<=\w)'(?=\w))*?[\w.!?,]'(?![\w'])")
_INVISIBLE = "﻿​‌‍⁠"
_THAI = r"[ก-๎]"
_HAN = r"[㐀-䶿一-鿿豈-﫿]"
_GAP_THAI = re.compile(rf"(?<={_THAI})\s+(?={_THAI})")
_GAP_HAN = re.compile(rf"(?<={_HAN})\s+(?={_HAN})")
_NUMBER = re.compile(r"v?\d[\d.,:%-]*")
_GREEK = re.compile(r"[Ͱ-Ͽ]")
_WORD = re.compile(r"\S+")
_STRAY = re.compile(r"<[|/]?\w+[|/]?>")
_IDENT = re.compile(r"\w_\w|[a-z0-9][A-Z]|\w[./]\w|\(\)|^[\w.]+\(|\w::\w|^_")


class Model(NamedTuple):
    """What was learned: words that do not end sentences, and pairs that belong together."""

    abbreviations: dict[str, frozenset[str]]
    pairs: dict[str, frozenset[tuple[str, str]]]
    starters: dict[str, frozenset[str]]


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, is paragraph) of the blocks of a text, in order; other blocks are units."""
    out: list[tuple[int, int, bool]] = []
    para: int | None = None
    end = 0
    fence: tuple[str, int] | None = None
    above = ""  # kind of the line above: blank, unit, item or text
    for m in _LINE.finditer(text):
        if m.start() == m.end():
            break
        line = m[0]
        body = line.strip()
        if fence is not None:
            if body.startswith(fence[0]) and not body.strip(fence[0][0]):
                out.append((fence[1], m.start() + len(line.rstrip()), False))
                fence, above = None, "unit"
            continue
        item = _ITEM.match(line)
        opens = _FENCE.match(line)
        kind = "text"
        if not body:
            kind = "blank"
        elif opens:
            kind = "fence"
        elif _HEADING.match(line):
            kind = "unit"
        elif item and (above != "text" or item[1] in (None, "1")):
            kind = "item"
        elif above == "item" and line[:1] in " \t":
            kind = "more"  # an indented line goes on with its list item
        if kind not in ("text", "more") and para is not None:
            out.append((para, end, True))
            para = None
        if kind == "fence":
            fence = (opens[1], m.start())
        elif kind in ("unit", "item"):
            out.append((m.start(), m.end(), False))
        elif kind == "more":
            out[-1] = (out[-1][0], m.end(), False)
        elif kind == "text":
            para = m.start() if para is None else para
            end = m.end()
        above = "item" if kind == "more" else kind
    if fence is not None:
        out.append((fence[1], len(text), False))
    if para is not None:
        out.append((para, end, True))
    trimmed = []
    for a, b, p in out:
        piece = text[a:b]
        a += len(piece) - len(piece.lstrip())
        b = a + len(piece.strip())
        if b > a:
            trimmed.append((a, b, p))
    return trimmed


def _groups(text: str) -> list[tuple[int, int]]:
    """(opening, closing) positions of the outermost closed brackets and quotations."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = [(m.start(), m.end() - 1) for m in _SINGLE.finditer(text)]
    for m in _MARK.finditer(text):
        c, at = m[0], m.start()
        if c in '"`':
            if any(o == c for o, _ in stack):
                while stack[-1][0] != c:
                    stack.pop()
                found.append((stack.pop()[1], at))
            elif text.find(c, at + 1) >= 0:
                stack.append((c, at))
            continue
        k = next((i for i in range(len(stack) - 1, -1, -1) if c in _PAIRS.get(stack[i][0], "")), None)
        if k is not None:
            found.append((stack[k][1], at))
            del stack[k:]
        elif c in _PAIRS:
            stack.append((c, at))
    found.sort(key=lambda g: (g[0], -g[1]))
    outer: list[tuple[int, int]] = []
    for g in found:
        if not outer or g[0] > outer[-1][1]:
            outer.append(g)
    return outer


@lru_cache(maxsize=1 << 16)
def _kind(word: str) -> tuple[str, str]:
    """(type, case) of a word after a period: case is n(umber), i(dentifier), l(ower), u(pper) or o(ther)."""
    bare = word.strip(_INVISIBLE).lstrip("\"'“„«‹(（[「『»`¿¡" + _INVISIBLE)
    if re.match(r"v?\d", bare):
        return "#", "n"
    bare = re.sub(r"[.,;:!?…)\]}\"'”»“]+$", "", bare)
    first = next((c for c in bare if c.isalpha()), "")
    if _IDENT.search(bare) and not (first.isupper() and not re.search(r"\w[_./(]\w|\(\)", bare)):
        return "@", "i"
    if not first:
        return bare, "o"
    case = "l" if first.islower() else "u" if first.isupper() else "o"
    return bare.casefold(), case


def _before(text: str, at: int) -> str:
    """The type of the word that ends before the period at ``at``."""
    start = at
    while start > 0 and not text[start - 1].isspace():
        start -= 1
    w = text[start:at].lstrip("\"'“„«‹(（[「『`-—" + _INVISIBLE).strip(_INVISIBLE)
    return "#" if _NUMBER.fullmatch(w) else w.casefold()


def _candidates(para: str) -> Iterator[tuple[int, int, str, int | None]]:
    """(start, end, terminator, opening of the group it closes) of the ends there may be."""
    found = list(_TERM.finditer(para))
    if not found:
        return
    groups = _groups(para) if _GROUPED.search(para) else []
    g = 0
    for m in found:
        at, to = m.span()
        while g < len(groups) and groups[g][1] < at:
            g += 1
        if g < len(groups) and groups[g][0] < at:
            close = groups[g][1]
            inner = para[to:close]
            if inner.strip() == "" or all(c in _CLOSERS or c.isspace() for c in inner):
                yield at, close + 1, m[0], groups[g][0]
            continue
        yield at, to, m[0], None


def _next_word(para: str, at: int) -> str:
    """The next word with a letter or digit; marks like ``<pad>`` are passed over."""
    m = _WORD.search(para, at)
    while m and (not any(c.isalnum() for c in m[0]) or _STRAY.fullmatch(m[0])):
        m = _WORD.search(para, m.end())
    return m[0] if m else ""


#: What the text alone says of a candidate: an end, an end unless it closes a group that is not the
#: whole unit so far, or an end if the model agrees.
_END, _GROUP, _ASK = 0, 1, 2


def _judge(para: str, start: int, end: int, mark: str, opened: int | None, w: str, word: str, greek: bool) -> tuple[int, str, str] | None:
    """(verdict, word before, word after) of a candidate between ``w`` and ``word``, or None where it is no end."""
    wide = mark[0] in "。！？｡।॥"
    if mark in ";;" and not greek:
        return None
    if end < len(para) and not wide and not para[end].isspace():
        return None
    if not word:
        return _END, "", ""
    typ, case = _kind(word)
    if opened is not None:
        if case in "lo" or wide:
            if para[opened] in _BRACKETS:
                return (_GROUP, "", "") if case != "l" else None
            return (_END, "", "") if case != "l" and para[:opened].rstrip()[-1:] in (":", "：") else None
        return _END, "", ""
    if wide:
        ends = para[end : end + 1] not in _CLOSERS
    elif mark[0] in "!?؟" or mark in ";;۔":
        ends = case != "l"
    elif len(mark) > 1 or mark == "…":  # suspension points
        ends = case in "uin" or (case == "o" and mark != "…" and not re.match(rf"{_HAN}|[぀-ヿ]", word))
    elif case == "l":
        ends = False
    else:
        initial = len(w) == 1 and w.isalpha() and case == "u" and para[start - 1].isupper()  # before a name
        return _ASK, w, ("u" if case == "u" else "-") + ("i" if initial else "-") + typ
    return (_END, "", "") if ends else None


def _agrees(w: str, after: str, lang: str, model: Model) -> bool:
    """Whether the model takes the period between two words as an end."""
    typ = after[2:]
    for key in (lang, "*"):
        if (w, typ) in model.pairs.get(key, ()):
            return False
    if any(w in model.abbreviations.get(key, ()) for key in (lang, "*")):
        return after[0] == "u" and typ in model.starters.get(lang, ())
    return after[1] != "i"


class Outline(NamedTuple):
    """A text without its characters: rows of six numbers, and the words that the model is asked about.

    (kind, place, behind, start, opened, word): a block that is one unit (kind 0: from, to), a
    paragraph (1: from, to), a gap between letters (2: place, next letter) or a candidate (3: end,
    next character, start of the mark, opening of its group, verdict or 2 + number of its words).
    """

    marks: list[int]
    words: list[str]


def _count(piece: str, end: int, mark: str, opened: int | None, w: str, word: str, key: str, counts: Counter) -> None:
    """Count a candidate as evidence: p(air at a period) or s(tarter after a sure end)."""
    if not word or opened is not None or mark[0] not in ".!?" or (end < len(piece) and not piece[end].isspace()):
        return
    typ, case = _kind(word)
    if mark == ".":
        counts[key, "p", w, case + typ] += 1
    elif mark[0] in "!?" and case == "u":
        counts[key, "s", typ, ""] += 1


def outline(text: str, key: str = "", counts: Counter | None = None, seen: Counter | None = None) -> Outline:
    """The outline of a text. What stands outside of fenced blocks is counted on request: candidates
    in ``counts`` under the language ``key``, all words in ``seen``."""
    marks: list[int] = []
    words: list[str] = []
    no_stops = "。" not in text
    for a, b, is_para in blocks(text):
        piece = text[a:b]
        counted = counts is not None and not piece.startswith(("```", "~~~"))
        if counted and seen is not None:
            seen.update(piece.split())
        marks += (1 if is_para else 0, a, b, 0, 0, 0)
        if is_para:
            for m in _GAP_THAI.finditer(piece):
                marks += (2, a + m.start(), a + m.end(), 0, 0, 0)
            if no_stops:
                for m in _GAP_HAN.finditer(piece):
                    marks += (2, a + m.start(), a + m.end(), 0, 0, 0)
        elif not counted:
            continue
        greek = bool(_GREEK.search(piece))
        for start, end, mark, opened in _candidates(piece):
            word = _next_word(piece, end)
            w = _before(piece, start) if mark == "." and word and opened is None else ""
            if counted:
                _count(piece, end, mark, opened, w, word, key, counts)
            found = _judge(piece, start, end, mark, opened, w, word, greek) if is_para else None
            if found is None:
                continue
            verdict, w, after = found
            nxt = end
            while nxt < len(piece) and piece[nxt].isspace():
                nxt += 1
            if verdict == _ASK:
                verdict += len(words) // 2
                words += (w, after)
            marks += (3, a + end, a + nxt, a + start, -1 if opened is None else a + opened, verdict)
    return Outline(marks, words)


def units_of(marks: list[int], words: list[str], lang: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentence units that an outline has under a model."""
    out: list[tuple[int, int]] = []
    cuts: list[tuple[int, int]] = []
    at = unit = last = -1  # begin of the present piece, of the present unit, end of the paragraph

    def close() -> None:
        nonlocal at
        cuts.append((last, last))
        cuts.sort()
        for end, nxt in cuts:
            if end > at:
                out.append((at, end))
            at = max(at, nxt)
        cuts.clear()

    for i in range(0, len(marks), 6):
        kind, place, behind, start, opened, verdict = marks[i : i + 6]
        if kind < 2:
            if last >= 0:
                close()
            if kind == 0:
                out.append((place, behind))
                last = -1
            else:
                at, unit, last = place, place, behind
        elif kind == 2:
            cuts.append((place, behind))
        elif start >= unit:
            ok = verdict == _END or (opened == unit if verdict == _GROUP else _agrees(words[2 * (verdict - _ASK)], words[2 * (verdict - _ASK) + 1], lang, model))
            if ok:
                cuts.append((place, behind))
                unit = behind
    if last >= 0:
        close()
    return out


def split(text: str, lang: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text, in code points."""
    return units_of(*outline(text), lang, model)


def language_key(lang: str | None) -> str:
    """The first two letters of a language tag in lower case; unknown tags share one key."""
    lang = (lang or "").strip().casefold()
    return {"zho": "zh", "chi": "zh", "deu": "de", "ger": "de", "ell": "el", "gre": "el", "spa": "es"}.get(lang[:3], lang[:2]) or "?"


_READ = "doc_id long, lang string, marks array<int>, words array<string>, kind string, word string, after string, n long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The outline of every document (kind null) and a task's counts (lang, kind, word, after, n). Kinds:
    p(air at a period), w(ord anywhere), s(tarter after a sure end)."""
    counts: Counter = Counter()
    seen: dict[str, Counter] = {}
    names = [c.split()[0] for c in _READ.split(", ")]
    types = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64()]

    def batch(cols: list[list | None], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(cols, types)], names)

    def counted() -> pa.RecordBatch:
        for key, raw in seen.items():
            for w, n in raw.items():
                typ, case = _kind(w)
                if case in "ul":
                    counts[key, "w", typ, ""] += n
        keys = list(counts)
        lang, kind, word, after = ([k[i] for k in keys] for i in range(4))
        out = batch([None, lang, None, None, kind, word, after, [counts[k] for k in keys]], len(keys))
        counts.clear()
        seen.clear()
        return out

    for b in batches:
        ids, langs, marks, words = [], [], [], []
        for i, text, lang in zip(*(b.column(k).to_pylist() for k in range(3))):
            if not text:
                continue
            key = language_key(lang)
            found = outline(text, key, counts, seen.setdefault(key, Counter()))
            if found.marks:
                for col, value in zip((ids, langs, marks, words), (i, key, *found)):
                    col.append(value)
        yield batch([ids, langs, marks, words, None, None, None, None], len(ids))
        if len(counts) + sum(map(len, seen.values())) > 200_000:
            yield counted()
    yield counted()


def _llr(c12, c1, c2, n):
    """Dunning's log-likelihood ratio of a pair as a column."""

    def ll(k, m, p):
        p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(p) + (m - k) * F.log(1 - p)

    p, p1, p2 = c2 / n, c12 / c1, (c2 - c12) / F.greatest(n - c1, F.lit(1))
    return 2 * (ll(c12, c1, p1) + ll(c2 - c12, n - c1, p2) - ll(c12, c1, p) - ll(c2 - c12, n - c1, p))


def read(docs: DataFrame) -> DataFrame:
    """The outlines and counts of all documents, read once and written to the checkpoint folder."""
    return cut(docs.select("doc_id", "text", "lang").mapInArrow(_read, _READ))


def learn(was_read: DataFrame) -> DataFrame:
    """(lang, kind, word, after): what the tests find in the counts over all documents. Kinds:
    a(bbreviation), p(air) and s(tarter); the language ``*`` stands for all together."""
    counted = was_read.where(F.col("kind").isNotNull()).select("lang", "kind", "word", "after", "n")
    counts = counted.groupBy("lang", "kind", "word", "after").agg(F.sum("n").alias("n"))
    pooled = counts.groupBy(F.lit("*").alias("lang"), "kind", "word", "after").agg(F.sum("n").alias("n"))
    counts = cut(counts.unionByName(pooled))
    pairs = counts.where("kind = 'p'")
    goes_on = F.sum(F.when(F.substring("after", 1, 1).isin("l", "n"), F.col("n")).otherwise(0))
    total = pairs.groupBy("lang").agg(F.sum("n").alias("total"), goes_on.alias("on_all"))
    by_word = pairs.groupBy("lang", "word").agg(F.sum("n").alias("c1"), goes_on.alias("on"))
    by_after = pairs.groupBy("lang", "after").agg(F.sum("n").alias("c2"))
    words = counts.where("kind = 'w'").select("lang", F.col("word").alias("typ"), F.col("n").alias("everywhere"))
    all_words = words.groupBy("lang").agg(F.sum("everywhere").alias("n_words"))
    # A word with inner periods is not counted by itself: it always stands before a period.
    with_period = _llr(F.col("c1"), F.greatest("everywhere", "c1"), F.col("total"), F.greatest("n_words", "total")) >= LEAST_LLR
    abbr = cut(
        by_word.join(total, "lang").join(all_words, "lang").join(words.withColumnRenamed("typ", "word"), ["lang", "word"], "left").withColumn("everywhere", F.coalesce("everywhere", "c1"))
        .where((F.col("c1") >= LEAST_COUNT) & (F.col("word") != "#") & (F.col("on") >= 0.9 * F.col("c1")))
        .where(_llr(F.col("on"), F.col("c1"), F.col("on_all"), F.col("total")) >= LEAST_LLR)
        .where(with_period & (F.col("c1") * F.col("n_words") >= F.col("everywhere") * F.col("total"))).select("lang", "word")
    )
    tied = (
        pairs.where(F.col("n") >= LEAST_COUNT).join(by_word, ["lang", "word"]).join(by_after, ["lang", "after"]).join(total, "lang")
        .withColumn("case", F.substring("after", 1, 1)).withColumn("typ", F.expr("substring(after, 2)"))
        .join(words, ["lang", "typ"], "left")
        .where(_llr(F.col("n"), F.col("c1"), F.col("c2"), F.col("total")) >= LEAST_LLR)
        .where(
            ((F.col("case") == "n") & (F.col("n") >= 0.3 * F.col("c1")) & (F.col("word") != "#"))
            | (F.col("case").isin("u", "o", "i") & (F.col("n") >= 0.8 * F.col("c1")) & (F.col("c2") <= 0.05 * F.col("total")))
            | ((F.col("case") == "i") & (F.col("n") >= 0.8 * F.col("c1")))
            | ((F.col("case") == "u") & (F.col("word") == "#") & (F.col("n") >= 0.7 * F.col("everywhere")))
        )
        .select("lang", "word", "typ")
    )
    # Sure ends: ! and ? before a capital, and periods between a word that is no abbreviation and a capital.
    plain = pairs.where(F.col("after").startswith("u") & (F.col("word") != "#") & (F.length("word") > 1)).join(abbr, ["lang", "word"], "left_anti")
    ends = counts.where("kind = 's'").select("lang", F.col("word").alias("typ"), "n").unionByName(plain.select("lang", F.expr("substring(after, 2)").alias("typ"), "n"))
    at_ends = ends.groupBy("lang", "typ").agg(F.sum("n").alias("k"))
    starts = (
        at_ends.join(at_ends.groupBy("lang").agg(F.sum("k").alias("n_ends")), "lang").join(words, ["lang", "typ"]).join(all_words, "lang")
        .where((F.col("k") >= LEAST_COUNT) & (F.col("k") * F.col("n_words") > F.col("everywhere") * F.col("n_ends")))
        .where(_llr(F.col("k"), F.greatest("everywhere", "k"), F.col("n_ends"), F.greatest("n_words", "n_ends")) >= STARTER_LLR).select("lang", "typ")
    )
    kept = abbr.select("lang", F.lit("a").alias("kind"), "word", F.lit("").alias("after")).unionByName(tied.select("lang", F.lit("p").alias("kind"), "word", F.col("typ").alias("after")))
    return cut(kept.unionByName(starts.select("lang", F.lit("s").alias("kind"), F.col("typ").alias("word"), F.lit("").alias("after"))))


def model_of(rows: Iterable[tuple[str, str, str, str]]) -> Model:
    """The model that holds the given rows of ``learn``."""
    found: dict[str, dict[str, set]] = {"a": {}, "p": {}, "s": {}}
    for lang, kind, word, after in rows:
        found[kind].setdefault(lang, set()).add((word, after) if kind == "p" else word)
    return Model(*({k: frozenset(v) for k, v in found[kind].items()} for kind in "aps"))


_UNITS = "doc_id long, start_char long, end_char long"


def _units(batches: Iterator[pa.RecordBatch], shared: Model | None) -> Iterator[pa.RecordBatch]:
    """Rows of _UNITS for batches of doc_id, lang, marks, words and, without a shared model, rows."""
    for b in batches:
        ids, starts, ends = [], [], []
        own = b.column(4).to_pylist() if shared is None else repeat(None)
        for i, lang, marks, words, rows in zip(*(b.column(k).to_pylist() for k in range(4)), own):
            model = shared or model_of((r["lang"], r["kind"], r["word"], r["after"]) for r in rows or ())
            found = units_of(marks, words, lang, model)
            ids += [i] * len(found)
            starts += [s for s, _ in found]
            ends += [e for _, e in found]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "start_char", "end_char"])


def sentence_units(docs: DataFrame, model_rows: int = MODEL_ROWS) -> DataFrame:
    """(doc_id, start_char, end_char): one row per sentence unit of every document.

    Offsets count code points, the end is exclusive, units have no white space at either end and
    cover all other text. Null, empty and blank texts have no units; repeated rows are each split.
    With more than ``model_rows`` learned rows the outlines are joined with those they ask for,
    with the same result.
    """
    was_read = read(docs)
    learned = learn(was_read)
    outlines = was_read.where(F.col("kind").isNull()).select("doc_id", "lang", "marks", "words")
    if learned.limit(model_rows + 1).count() <= model_rows:
        model = model_of(tuple(r) for r in learned.collect())
        return outlines.mapInArrow(lambda batches: _units(batches, model), _UNITS)
    # Equal words of one language ask for the same rows, so they meet by a hash of them.
    outlines = outlines.withColumn("at", F.xxhash64("lang", F.concat_ws("\n", "words")))
    asked = outlines.where(F.size("words") > 0).select("at", "lang", "words").distinct()
    asked = asked.select("at", "lang", "words", F.explode(F.sequence(F.lit(0), (F.size("words") / 2).cast("int") - 1)).alias("i"))
    asked = asked.select("at", "lang", F.element_at("words", 2 * F.col("i") + 1).alias("w"), F.expr("substring(element_at(words, 2 * i + 2), 3)").alias("typ"))
    none = F.lit("")
    keys = F.array(*[F.struct(x.alias("lang"), F.lit(k).alias("kind"), w.alias("word"), a.alias("after")) for x in (F.col("lang"), F.lit("*")) for k, w, a in (("a", F.col("w"), none), ("p", F.col("w"), F.col("typ")), ("s", F.col("typ"), none))])
    asked = asked.select("at", F.explode(keys).alias("k")).select("at", "k.*").distinct()
    own = asked.join(learned, ["lang", "kind", "word", "after"], "left_semi").groupBy("at").agg(F.collect_set(F.struct("lang", "kind", "word", "after")).alias("rows"))
    return outlines.join(own, "at", "left").select("doc_id", "lang", "marks", "words", "rows").mapInArrow(lambda batches: _units(batches, None), _UNITS)
