"""Functions and methods paired with what their documentation says.

Every source text is parsed (but where it lacks the words without which the grammar of its language
makes no function); the function nodes of its tree are visited for their exact ranges and
the documentation attached to them (the comment above, or the first string of a Python body). A
node is one with the symbol of the index that has its file and range. A description is the
documentation without comment marks, markup and lines that say nothing: tags and parameter names without text, directives for
tools, code, dates, labels, pointers to other places, placeholders, and the symbol's own name in
a sentence without content. What is left must hold at least three words of content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.parse_check import no_cycles, spread_texts
from codeloom.syntax.grammars import dialects_of
from codeloom.syntax.tree import functions, may_have_functions, parse

#: Words that carry no content in a description (fixed list).
EMPTY_WORDS = frozenset(
    """a an the this that these it its is are be was of for to in on by with and or as at from
    function functions method methods func fn procedure routine class constructor helper helpers getter setter accessor summary description
    documentation docs doc comment name stub auto generated automatically created todo fixme xxx tbd hack wip placeholder describe document write me
    here goes missing no none na undocumented internal private public deprecated region endregion section self explanatory obvious returns return
    param params parameter parameters args arguments argument result value see above below ditto same before code base parent
    le la les un une des de du el los las uno una unos unas der die das ein eine und et y oder o il lo gli""".split()
)
_MARKS = re.compile(r"^\s*(?:/\*[*!]?|//[/!]?|\*+/|\*(?!\w)|#(?!\[)|\"\"\"|''')+\s?|\s*(?:\*+/|\"\"\"|''')\s*$")
_DIRECTIVE = re.compile(
    r"(?i)^(?:eslint|tslint|jshint|jslint|noqa|nolint|pylint|flake8|mypy|pyright|type:\s*ignore|prettier|biome|ts-(?:ignore|expect|nocheck)|@ts-|clippy|rustfmt|istanbul|c8\s|"
    r"nosonar|nosec|pragma|coverage|go:(?:build|generate|embed|noinline)|lint:|isort|black:|fmt:|yapf|swiftlint|rubocop|spell-?checker|cspell|allow\()"
)
_POINTER = re.compile(
    r"(?i)^\(?(?:see(?:\s+also)?|cf\.?|refer to|same as|as (?:above|before|below)|like (?:above|before)|ditto|siehe|vgl\.?|wie oben|voir|véase|ver|vedi|см\.?|смотри|参见|見よ|참고)\b[^:;]{0,40}$"
)
_TAG = re.compile(
    r"(?i)^(?:[-*+]\s*)?(?:\{?@\w+\}?(?:\s*\{[^}]*\})?|:\w+(?:\s+[\w., ]+)?:|#+\s*\w+$|\w+:$|args?:|returns?:)\s*(?P<rest>.*)$"
)
_PARAM = re.compile(r"(?i)^(?:[-*+]\s*)?(?:\{?@(?:param|arg|argument|throws|exception|typeparam)\}?(?:\s*\{[^}]*\})?\s+[\[\w.$\]=]+|:(?:param|type|raises|arg)(?:\s+[\w., ]+)?\s+\w+:|`[\w.$]+`)\s*(?:[-:–—]\s*)?(?P<rest>.*)$")
_CODE = re.compile(r"^[\w.:<>]+\([^()]*\)\s*;?$|^[\w.]+\s*(?:=|:=|\+=)\s*\S+;?$|;\s*$(?<=[)\]}];)")
_ELEMENT = re.compile(r"</?[A-Za-z][^<>]*>")
_LETTER = re.compile(r"\w")
_RULER = re.compile(r"([-=~*#_.+/\\|])\1*\s*[\w ]{0,20}\s*([-=~*#_.+/\\|])\2+")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\dA-Z_]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")


def clean_lines(doc: str) -> list[str]:
    """The lines of a documentation comment without marks, decoration and markup."""
    out = []
    for line in doc.replace("\r\n", "\n").split("\n"):
        before = None
        line = line.strip()
        while before != line and line and (line[0] in "/*#\"'" or line[-1] in "/\"'"):
            before, line = line, _MARKS.sub("", line).strip()
        if "<" in line:
            line = _ELEMENT.sub(" ", line).strip()
        if _LETTER.search(line) and not (line[0] in "-=~*#_.+/\\|" and _RULER.fullmatch(line)):
            out.append(line)
    return out


def content_words(lines: list[str], name: str, enough: int | None = None) -> int:
    """How many words of content the lines hold beyond the name of the symbol; not counted on where
    there are ``enough``."""
    own = {w.lower() for w in _NAME_PART.findall(name)}
    own |= {name.lower(), *(w + "s" for w in own)}
    count = 0
    for line in lines:
        if _DIRECTIVE.match(line) or _POINTER.match(line) or _CODE.search(line):
            continue
        if m := _PARAM.match(line) or _TAG.match(line):
            line = m["rest"]
        line = line.replace("`", " ").replace(name, " ")
        for w in _WORD.findall(line):
            low = w.lower()
            if low in own or low in EMPTY_WORDS:
                continue
            count += 1 if w.isascii() or not _WIDE.search(w) else max(1, len(w) // 2)
            if enough is not None and count >= enough:
                return count
    return count


def describe(doc: str | None, name: str | None, least: int = 3) -> str | None:
    """The description of a documentation comment, or null where it says nothing."""
    if not doc or not doc.strip():
        return None
    lines = clean_lines(doc)
    return "\n".join(lines) if content_words(lines, name or "", least) >= least else None


_SPAN = ["file_id", "start_byte", "end_byte"]


def _byte_places(text: str, places: list[int]) -> dict[int, int]:
    """The UTF-8 offsets of code point offsets."""
    if text.isascii():
        return {at: at for at in places}
    out, last, size = {}, 0, 0
    for at in sorted(set(places)):
        size += len(text[last:at].encode("utf-8", "surrogatepass"))
        out[at], last = size, at
    return out


#: Characters of texts whose nodes a task keeps for their copies.
_KEPT = 1 << 24


def _nodes(dialect: str, text: str, with_code: bool) -> list[tuple]:
    """(begin, end, documentation, code on request) of the function nodes of a text; places are UTF-8 offsets."""
    if not may_have_functions(dialect, text):
        return []
    found = functions(parse(dialect, text))
    byte = _byte_places(text, [x for a, z, _ in found for x in (a, z)])
    return [(byte[a], byte[z], doc, text[a:z])[: 3 + with_code] for a, z, doc in found]


def function_nodes(sources: DataFrame, with_code: bool = True) -> DataFrame:
    """(file_id, start_byte, end_byte, doc, code): the function and method nodes of all source texts.

    doc is the attached documentation with its marks, null without any; code is the exact text of
    the node, left out on request. A text that its language rejects keeps the nodes that were
    recognised. Null and blank texts have none; repeated rows of a file count once per node. Copies
    of a text that a task meets are parsed once.
    """
    schema = "file_id long, start_byte int, end_byte int, doc string" + ", code string" * with_code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], list[tuple]] = {}
        kept = 0
        for b in batches:
            cols: list[list] = [[] for _ in range(4 + with_code)]
            with no_cycles():
                for file_id, path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                    for dialect in dialects_of(path):
                        found = known.get((dialect, text))
                        if found is None:
                            kept += len(text)
                            if kept > _KEPT:
                                known.clear()
                                kept = len(text)
                            found = known[dialect, text] = _nodes(dialect, text, with_code)
                        for node in found:
                            for col, value in zip(cols, (file_id, *node)):
                                col.append(value)
            types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [*_SPAN, "doc", "code"][: len(cols)])

    return spread_texts(sources).mapInArrow(run, schema)


def described_functions(symbols: DataFrame, sources: DataFrame, with_code: bool = False) -> DataFrame:
    """One row per function or method symbol with a real description.

    Columns: symbol_id, file_id, kind, name, qualified_name, signature, start_byte, end_byte,
    description, has_node and, on request, code. The documentation is that of the symbol's node;
    where no node has its range (a null or damaged text, a stale span), or the node has none, it is
    what the index recorded, and code is null without a node. Repeated rows of a symbol count once;
    a null kind gives no row.
    """
    keep = ["id", "file_id", "kind", "name", "qualified_name", "signature", "start_byte", "end_byte"]
    nodes = function_nodes(sources, with_code).withColumn("has_node", F.lit(True))
    rows = symbols.where(F.col("kind").isin("function", "method")).select(*keep, "doc_comment").join(nodes, _SPAN, "left")
    rest = ["has_node", "code"] if with_code else ["has_node"]
    rows = rows.select(*keep, F.coalesce("has_node", F.lit(False)).alias("has_node"), *rest[1:], F.coalesce("doc", "doc_comment").alias("doc")).where(F.trim("doc") != "")
    names = [*keep, *rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [describe(d, n) for d, n in zip(b.column(len(names)).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(said, pa.string())], [*names, "description"])

    said = rows.mapInArrow(run, rows.drop("doc").schema.add("description", "string")).where(F.col("description").isNotNull())
    return said.dropDuplicates(["id"]).withColumnRenamed("id", "symbol_id")


def code_pairs(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """``described_functions`` with ``code``, the exact text of the symbol's node, without the span."""
    return described_functions(symbols, sources, True).drop("start_byte", "end_byte", "has_node")
