"""Landed HTML as a flat element tree with the literals of its scripts, and selectors over it.

One Arrow pass turns a page into three ordered lists: its elements (with parent and the range of
places that they span), its texts, and the literals assigned to wanted names in scripts. What a field
needs from them (the first element of a class, an element's whole text, the nearest enclosing card)
is an ordinary column expression over these lists.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: Elements that never hold others, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style")
#: Pages that are cut at once within a batch.
PIECE = 100
NAMES = ("antiquity", "usersViews", "postingType", "postingStatus", "tier", "1", "publisher", "visibility", "videoUrl", "videos", "tour360Url", "tourUrl", "latitude", "longitude", "ubicacion")

_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)([^'">]*+(?:(?:"[^"]*"|'[^']*')[^'">]*+)*+)>""", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_BRACKETS = re.compile(r""""[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|\{|\}|\[|\]""", re.S)
_QUOTED = re.compile(r""""([^"\\]*+(?:\\.[^"\\]*+)*+)"|'([^'\\]*+(?:\\.[^'\\]*+)*+)'""", re.S)
_PLAIN = re.compile(r"-?\d+(?:\.\d+)?|true|false|null")

_NODE = pa.struct([("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("parent", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
_TEXT = pa.struct([("at", pa.int32()), ("text", pa.string()), ("raw", pa.bool_())])
_LITERAL = pa.struct([("name", pa.string()), ("at", pa.int32()), ("quoted", pa.bool_()), ("kind", pa.string()), ("text", pa.string())])
_TREE = pa.struct([("nodes", pa.list_(_NODE)), ("texts", pa.list_(_TEXT)), ("literals", pa.list_(_LITERAL))])
TREE = """nodes ARRAY<STRUCT<tag: STRING, attrs: MAP<STRING, STRING>, parent: INT, start: INT, stop: INT>>, texts ARRAY<STRUCT<at: INT, text: STRING, raw: BOOLEAN>>,
  literals ARRAY<STRUCT<name: STRING, at: INT, quoted: BOOLEAN, kind: STRING, text: STRING>>"""


def _attributes(text: str) -> list[tuple[str, str]]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), entities.unescape(double or single or bare))
    return list(found.items())


#: Short ones come again and again.
_known_attributes = lru_cache(maxsize=4096)(_attributes)


def _cut(page: str, nodes: tuple[list, ...], texts: tuple[list, ...], kept: frozenset[str] | None = None, said: bool = True) -> None:
    """Adds a page's elements and texts to the columns of ``_NODE`` and ``_TEXT``, the attributes as lists of pairs.

    ``kept``: the tags of the elements that are added, raw ones with their content; None for all. ``said``: whether texts
    outside raw elements are added. Places are the same in any case.
    """
    tags, attrs, parents, starts, stops = nodes
    places, strings, raws = texts
    first = len(tags)
    opened: list[str] = []  # tags, and the elements' numbers; an element that is not kept has the number of the one around it
    numbers: list[int] = []
    own: list[bool] = []
    at = position = 0
    search, unescape = _MARK.search, entities.unescape
    while mark := search(page, position):
        start, end = mark.span()
        if start > position:
            if said:
                places.append(at)
                strings.append(unescape(page[position:start]))
                raws.append(False)
            at += 1
        position = end
        closing, tag, rest = mark.groups()
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in opened:
                last = None
                while last != tag:
                    last, n = opened.pop(), numbers.pop()
                    if own.pop():
                        stops[n] = at - 1
            continue
        held = kept is None or tag in kept
        if held:
            tags.append(tag)
            attrs.append((_known_attributes(rest) if len(rest) < 100 else _attributes(rest)) if rest else [])
            parents.append(numbers[-1] - first if numbers and numbers[-1] >= first else None)
            starts.append(at)
            stops.append(at)
        at += 1
        if tag in RAW:
            close = _RAW_END[tag].search(page, position)
            inner = page[position : close.start() if close else len(page)]
            if inner:
                if held:
                    places.append(at)
                    strings.append(inner)
                    raws.append(True)
                at += 1
            if held:
                stops[-1] = at - 1
            position = close.end() if close else len(page)
        elif tag not in VOID and not rest.endswith("/"):
            opened.append(tag)
            numbers.append(len(tags) - 1 if held else numbers[-1] if numbers else -1)
            own.append(held)
    if position < len(page):
        if said:
            places.append(at)
            strings.append(unescape(page[position:]))
            raws.append(False)
        at += 1
    for n, mine in zip(numbers, own):
        if mine:
            stops[n] = at


def elements(page: str) -> tuple[list[dict], list[dict]]:
    """Elements in the order of their start, and texts. An end tag closes what is open above its element; one without an open element counts for nothing."""
    nodes, texts = tuple([] for _ in _NODE), tuple([] for _ in _TEXT)
    _cut(page, nodes, texts)
    names = [f.name for f in _NODE]
    return [dict(zip(names, n), index=i) for i, n in enumerate(zip(*nodes))], [dict(zip(("at", "text", "raw"), t)) for t in zip(*texts)]


def _closed(page: str, start: int) -> int | None:
    """Where the bracket at ``start`` closes; brackets inside quotes do not count."""
    depth = 0
    for m in _BRACKETS.finditer(page, start):
        if m[0] in "{[":
            depth += 1
        elif m[0] in "}]":
            depth -= 1
            if not depth:
                return m.end()
    return None


@lru_cache(maxsize=64)
def _assigned(names: tuple[str, ...]) -> re.Pattern[str]:
    """A wanted name in any case and what assigns it. Each alternative starts with a plain character, as the search for those is fast."""
    cases = {"i": "\u0131\u0130", "s": "\u017f", "k": "\u212a"}
    starts = [(n, sorted({n[0].lower(), n[0].upper(), *cases.get(n[0].lower(), "")})) for n in names]
    either = "|".join(f"{re.escape(c)}(?i:{re.escape(n[1:])})" for n, first in starts for c in first)
    return re.compile(rf"""({either})(?!\w)["']?\s*+[=:](?!=)\s*""")


def _joins(before: str) -> bool:
    """Whether a character before a name makes it another one."""
    return before.isalnum() or before in ("_", "$")


def literals(page: str, names: Iterable[str] = NAMES) -> list[dict]:
    """Literals that follow a wanted name (a word) and ``=`` or ``:``, quoted either way (kind s), plain (n) or bracketed (o), in the order of the page."""
    found = []
    for m in _assigned(tuple(names)).finditer(page):
        at, start = m.span()
        before = page[at - 1 : at]
        if _joins(before):
            continue
        quoted_name = before in ("'", '"') and not _joins(page[at - 2 : at - 1] if at > 1 else "")
        if page[start : start + 1] in ("{", "["):
            end = _closed(page, start)
            kind, value = "o", page[start:end] if end else None
        elif quoted := _QUOTED.match(page, start):
            value = quoted[1] if quoted[1] is not None else quoted[2]
            kind, value = "s", re.sub(r"\\(.)", r"\1", value, flags=re.S) if "\\" in value else value
        else:
            plain = _PLAIN.match(page, start)
            kind, value = "n", plain and plain[0]
        if value is not None:
            found.append({"name": m[1], "at": at - quoted_name, "quoted": quoted_name, "kind": kind, "text": value})
    return found


def _offsets(lengths: Iterable[int]) -> pa.Array:
    return pa.array([0, *accumulate(lengths)], pa.int32())


def _lists(kind: pa.StructType, columns: Iterable[list | pa.Array], offsets: list[int]) -> pa.Array:
    made = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, kind)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(made, fields=list(kind)))


def _forest(pages: list[str], names: tuple[str, ...], kept: frozenset[str] | None, said: bool) -> pa.Array:
    nodes, texts, found = tuple([] for _ in _NODE), tuple([] for _ in _TEXT), []
    ends = ([0], [0], [0])
    for page in pages:
        if kept is None or kept or said:
            _cut(page, nodes, texts, kept, said)
        if names:
            found += literals(page, names)
        for end, column in zip(ends, (nodes[0], texts[0], found)):
            end.append(len(column))
    tags, attrs, *places = nodes
    pairs = [pair for held in attrs for pair in held]
    maps = pa.MapArray.from_arrays(_offsets(map(len, attrs)), pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string()))
    lists = [_lists(_NODE, (tags, maps, *places), ends[0]), _lists(_TEXT, texts, ends[1]), _lists(_LITERAL, [[v[f.name] for v in found] for f in _LITERAL], ends[2])]
    return pa.StructArray.from_arrays(lists, fields=list(_TREE))


def _pieces(batches: Iterable[pa.Array], names: tuple[str, ...], kept: frozenset[str] | None = None, said: bool = True) -> Iterator[pa.Array]:
    """The trees of some pages at a time: neither Python nor Arrow holds those of a batch."""
    for pages in batches:
        for i in range(0, len(pages), PIECE):
            yield _forest([page or "" for page in pages.slice(i, PIECE).to_pylist()], names, kept, said)


def _whole(pages: pa.Array, names: tuple[str, ...]) -> pa.Array:
    return pa.concat_arrays([pa.array([], _TREE), *_pieces([pages], names)])


_trees, _bare_trees = partial(_whole, names=NAMES), partial(_whole, names=())


def with_tree(pages: DataFrame, html: str = "html", name: str = "__tree", names: tuple[str, ...] = NAMES, tags: tuple[str, ...] | None = None, texts: bool = True) -> DataFrame:
    """Adds the tree of each page; a null page is empty.

    What no field reads need not be made: ``names`` are the literals that are looked for, ``tags`` the elements that are kept
    (None for all; a parent is then the nearest kept one around), ``texts`` whether texts outside scripts and styles are.
    """
    ship_package(pages.sparkSession)
    kept = None if tags is None else frozenset(tags)

    def trees(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _pieces(batches, names, kept, texts)

    return pages.withColumn(name, F.arrow_udf(trees, TREE)(F.col(html)))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(text: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s ]+", " "))


def some(text: Column) -> Column:
    """Null for an empty text, which is evaluated once (``nullif`` does so twice)."""
    return F.get(F.array_remove(F.array(text), F.lit("")), F.lit(0))


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def has(name: str, value: str) -> Callable[[Column], Column]:
    """Elements whose attribute is exactly ``value``."""
    return lambda n: attr(n, name) == value


def like(name: str, pattern: str) -> Callable[[Column], Column]:
    """Elements in whose attribute the pattern is found, in either case."""
    return lambda n: attr(n, name).rlike(f"(?i){pattern}")


def of_class(token: str) -> Callable[[Column], Column]:
    """Elements that carry the class."""
    return lambda n: attr(n, "class").contains(token) & F.array_contains(F.split(attr(n, "class"), r"\s+"), token)


def tagged(tag: str, *tests: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def test(n: Column) -> Column:
        out = n["tag"] == tag
        for t in tests:
            out = out & t(n)
        return out

    return test


class Tree:
    """Selectors over a tree column. An element that is not there is null, and so is all that follows from it."""

    def __init__(self, column: str = "__tree"):
        self.column = column

    nodes = property(lambda self: F.col(f"{self.column}.nodes"))
    texts = property(lambda self: F.col(f"{self.column}.texts"))
    literals = property(lambda self: F.col(f"{self.column}.literals"))

    def all(self, test: Callable[[Column], Column]) -> Column:
        return F.filter(self.nodes, test)

    def first(self, *tests: Callable[[Column], Column]) -> Column:
        """The first element that the first of the tests finds, else of the next test."""
        return F.coalesce(*[F.get(self.all(t), F.lit(0)) for t in tests])

    def inside(self, node: Column, test: Callable[[Column], Column]) -> Column:
        """Elements below ``node``."""
        return bind(node, lambda x: F.filter(self.nodes, lambda n: (n["start"] > x["start"]) & (n["stop"] <= x["stop"]) & test(n)))

    def around(self, node: Column, test: Callable[[Column], Column]) -> Column:
        """The nearest element around ``node``."""
        return bind(node, lambda x: F.when(x.isNotNull(), F.try_element_at(F.filter(self.nodes, lambda n: (n["start"] < x["start"]) & (n["stop"] >= x["stop"]) & test(n)), F.lit(-1))))

    def parent(self, node: Column) -> Column:
        return bind(node, lambda x: F.get(self.nodes, x["parent"]))

    def strings(self, node: Column) -> Column:
        """The trimmed texts inside an element, without scripts and blanks."""
        trimmed = F.transform(self._said(node), lambda t: F.regexp_replace(t, r"(?U)^[\s ]+|[\s ]+$", ""))
        return F.filter(trimmed, lambda x: x != "")

    def text(self, node: Column) -> Column:
        """An element's whole text, with blanks between its parts."""
        return clean(F.array_join(self._said(node), " "))

    def body(self) -> Column:
        """The whole page's text."""
        return clean(F.array_join(F.filter(self.texts, lambda t: ~t["raw"])["text"], " "))

    def script(self, test: Callable[[Column], Column]) -> Column:
        """The content of the first script that passes."""
        return bind(self.first(tagged("script", test)), lambda x: F.get(F.filter(self.texts, lambda t: (t["at"] == x["start"] + 1) & t["raw"]), F.lit(0))["text"])

    def literal(self, name: str, kinds: str = "sno") -> Column:
        """The first literal of a name, of one of the kinds."""
        return F.get(F.filter(self.literals, lambda v: (v["name"] == name) & F.instr(F.lit(kinds), v["kind"]).cast("boolean")), F.lit(0))["text"]

    def _said(self, node: Column) -> Column:
        return bind(node, lambda x: F.when(x.isNotNull(), F.filter(self.texts, lambda t: (t["at"] >= x["start"]) & (t["at"] <= x["stop"]) & ~t["raw"])["text"]))
