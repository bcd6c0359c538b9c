"""Elements of landed markup (A2, A4, A5): a scan over the tags of a page.

The markup is read as the sequence of its tags, once, with the stack of open elements.
An end tag closes the innermost open element of its name and what is still open inside
it, whatever the depth; one without an open element is ignored; the end of the page
closes the rest.  Comments, scripts and style sheets have no tags.  Attributes may be
quoted either way or not at all.

Spark deals out the pages; the scan runs over the rows of a batch and gives the texts and
attributes that a ``Field`` names; all further work on them (numbers, links, identity) is
built-in expressions.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The scan travels with the job: executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A value is quoted where the quote follows the "="; possessive, so that no tag is read twice.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_TAG = re.compile(rf"<(/)?([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>")
_OTHER = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+>)", re.S)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*+>|\Z", re.I) for name in ("script", "style")}
_ATTRIBUTE = re.compile(r"""([^\s=/>"'][^\s=/>]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
# What stands in a tag up to the first ">", where that is the tag's end whatever follows: no quote is left open.
_SURE = re.compile(r"""(/)?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)""")
# Pages have few kinds of short tags: what is made of one is kept.  Full memos begin anew, so the kinds come back.
SHORT, KEPT = 256, 4096
_KNOWN: dict[str, dict[str, str]] = {}
# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def tags(markup: str, make: Callable, known: dict, raw: bool = True) -> Iterator[tuple[int, int, object]]:
    """(start, end, tag) of the tags in order; comments and the like are null.  ``make(slash, name, attributes)``
    is the tag, kept in ``known`` by what is written.  With ``raw``, what a script or a style sheet holds is passed
    over, up to its end tag."""
    find, get = markup.find, known.get
    start, stop = find("<"), -1
    while start >= 0:
        if stop < start:  # else no ">" stands before the last one found
            stop = find(">", start)
            if stop < 0:
                stop = len(markup) + SHORT
        held = get(head) if (short := stop - start <= SHORT) and (head := markup[start + 1:stop]) else None
        if held is not None:
            at = stop + 1
        else:
            sure = _SURE.fullmatch(markup, start + 1, stop) if short else None
            if tag := sure or _TAG.match(markup, start):
                slash, name, rest = tag.groups()
                held = make(slash, name, rest), _RAW_END.get(name.lower()) if raw and not slash else None
                at = stop + 1 if sure else tag.end()
                if sure:
                    if len(known) >= KEPT:
                        known.clear()
                    known[head] = held
            elif other := _OTHER.match(markup, start):
                yield start, other.end(), None
                start = find("<", other.end())
                continue
            else:
                start = find("<", start + 1)
                continue
        yield start, at, held[0]
        if held[1] is not None:
            at = held[1].search(markup, at).start()
        start = find("<", at)


def attributes(rest: str) -> dict[str, str]:
    """The attributes of a start tag, names in lower case; of repeated ones the first."""
    if (known := _KNOWN.get(rest)) is not None:
        return known
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(rest):
        if (name := name.lower()) not in out:
            out[name] = double or single or bare
    if len(rest) < SHORT:
        if len(_KNOWN) >= KEPT:
            _KNOWN.clear()
        _KNOWN[rest] = out
    return out


@dataclass(frozen=True)
class Node:
    """Elements by tag name (null: any), a class among the blank-separated ones, or an id."""
    tag: str | None = None
    cls: str | None = None
    id: str | None = None

    def matches(self, rest: str) -> bool:
        """Whether a start tag with these attributes is one (the name is already)."""
        if self.cls is None and self.id is None:
            return True
        if self.cls and self.cls not in rest or self.id and self.id not in rest:
            return False
        own = attributes(rest)
        return ((self.cls is None or self.cls in own.get("class", "").split())
                and (self.id is None or self.id == own.get("id")))


@dataclass(frozen=True)
class Field:
    """What is wanted of an element's inside: its first ``node`` or (``every``) all of them, in the open field
    ``inside`` if one is named, with the values of ``attributes``."""
    node: Node
    every: bool = False
    inside: str | None = None
    attributes: tuple[str, ...] = ()


@dataclass(eq=False, slots=True)
class _Found:
    start: int
    rest: str
    at: int
    html: str = ""
    outer: str = ""
    fields: dict[str, list] = field(default_factory=dict)  # name -> [[rest, content start, content], ...]
    open: list[str] = field(default_factory=list)


class Scanner:
    """Scans pages for the elements that are one of ``roots`` (null: the whole markup as one), in order, with their
    fields.  With ``whole`` the first is the whole markup, with those fields (of other names) of it."""

    def __init__(self, roots: tuple[Node, ...] | None, fields: dict[str, Field], xml: bool = False,
                 whole: dict[str, Field] | None = None):
        self.roots, self.xml, self.whole = roots, xml, whole
        named = {**fields, **(whole or {})}
        around = {f.inside for f in named.values()}
        self.wanted: dict[str | None, list[tuple[tuple | None, Node]]] = {}
        for node in roots or ():
            self.wanted.setdefault(node.tag, []).append((None, node))
        for k, f in named.items():
            self.wanted.setdefault(f.node.tag, []).append(((k, f.every, f.inside, k in fields, k in around), f.node))
        self.known: dict[str, tuple] = {}

    def tag(self, slash: str | None, name: str, rest: str) -> tuple:
        """(name, is it an end tag, what is wanted of it, does it end at once, attributes)"""
        name = name if self.xml else name.lower()
        if slash:
            return name, True, (), False, rest
        hits = [k for k, node in [*self.wanted.get(name, []), *self.wanted.get(None, [])] if node.matches(rest)]
        if None in hits:  # one element is one root
            hits = [None, *(k for k in hits if k is not None)]
        return name, False, tuple(hits), rest.endswith("/") or not self.xml and name in VOID, rest

    def scan(self, markup: str) -> list[_Found]:
        found: list[_Found] = []
        live: list[_Found] = []  # open roots
        stack: list[tuple[str, list | None]] = []  # open elements with what ends with them
        open_names: dict[str, int] = {}
        if self.roots is None or self.whole is not None:
            found.append(_Found(0, "", 0))
        if self.roots is None:
            live.append(found[0])

        def close(ends: list, at: int, after: int) -> None:
            for one, slot, tracked in ends:
                if slot is None:
                    one.html, one.outer = markup[one.at:at], markup[one.start:after]
                    live.remove(one)
                else:
                    slot[2] = markup[slot[1]:at]
                    if tracked is not None:
                        one.open.remove(tracked)

        for start, at, tag in tags(markup, self.tag, self.known, raw=not self.xml):
            if tag is None:
                continue
            name, slash, hits, alone, rest = tag
            if slash:
                while open_names.get(name):
                    top, ends = stack.pop()
                    open_names[top] -= 1
                    if ends:
                        close(ends, start, at)
                    if top == name:
                        break
                continue
            ends = None
            if hits:
                ends, root = [], None
                for hit in hits:
                    if hit is None:
                        root = _Found(start, rest, at)
                        found.append(root)
                        ends.append((root, None, None))
                        continue
                    kind, every, inside, of_root, tracked = hit
                    for one in live if of_root else found[:1]:
                        slots = one.fields.get(kind)
                        if (every or not slots) and (inside is None or inside in one.open):
                            slot = [rest, at, ""]
                            if slots is None:
                                one.fields[kind] = [slot]
                            else:
                                slots.append(slot)
                            if tracked:
                                one.open.append(kind)
                            ends.append((one, slot, kind if tracked else None))
                if root is not None:
                    live.append(root)
            if alone:
                if ends:
                    close(ends, at, at)
            else:
                stack.append((name, ends))
                open_names[name] = open_names.get(name, 0) + 1
        for _, ends in reversed(stack):
            if ends:
                close(ends, len(markup), len(markup))
        if self.roots is None or self.whole is not None:
            found[0].html = found[0].outer = markup
        return found


def scan(markup: str, roots: tuple[Node, ...] | None, fields: dict[str, Field], xml: bool = False,
         whole: dict[str, Field] | None = None) -> list[_Found]:
    """One page by a ``Scanner`` of its own."""
    return Scanner(roots, fields, xml, whole).scan(markup)


def _hides(slash: str | None, name: str, rest: str) -> bool:
    """Whether a tag begins a script or a style sheet."""
    return not slash and name.lower() in _RAW_END


_PLAIN: dict[str, tuple] = {}


def plain(markup: str) -> str | None:
    """The text of a piece of markup: what stands between its tags, decoded and stripped, joined by one blank."""
    if "<" not in markup:
        return unescape(markup).strip() or None
    out, at, hidden = [], 0, False
    for start, end, hides in tags(markup, _hides, _PLAIN):
        if not hidden:
            out.append(unescape(markup[at:start]).strip())
        at, hidden = end, bool(hides)
    if not hidden:
        out.append(unescape(markup[at:]).strip())
    return " ".join(filter(None, out)) or None


def scan_elements(pages: DataFrame, body: str, roots: Node | tuple[Node, ...] | None, fields: dict[str, Field],
                  keep: list[str], root_attributes: tuple[str, ...] = (), outer: bool = False, xml: bool = False,
                  text: bool = True) -> DataFrame:
    """One row per element of ``roots`` in ``body``, numbered in page order: the columns ``keep``, ``pos``,
    ``root_text`` (null without ``text``; with ``outer`` in its place ``root_outer``, the element as written), per field ``<name>_text`` (null:
    not there or empty; an array of all if ``every``) and, decoded, the attributes ``root_<a>``, ``<name>_<a>``
    (null: not there or empty).

    A page without such an element, or with a null body, gives no row; with ``roots`` null it gives one.
    """
    roots = (roots,) if isinstance(roots, Node) else roots
    named = [(f"root_{a}", None, a) for a in root_attributes]
    named += [(f"{k}_{a}", k, a) for k, f in fields.items() for a in f.attributes]
    schema = T.StructType([pages.schema[c] for c in keep])
    schema.add("pos", "integer").add("root_text", "string")
    if outer:
        schema.add("root_outer", "string")
    for k, f in fields.items():
        schema.add(f"{k}_text", T.ArrayType(T.StringType()) if f.every else T.StringType())
    for column, _, _ in named:
        schema.add(column, "string")
    kinds = [pa.list_(pa.string()) if f.every else pa.string() for f in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(roots, fields, xml)
        for b in batches:
            rows, pos, texts, whole = [], [], [], []
            cells: list[list] = [[] for _ in fields]
            values: list[list] = [[] for _ in named]
            of_field = [(out, k, f.every) for out, (k, f) in zip(cells, fields.items())]
            of_tag = [(out, k, a) for out, (_, k, a) in zip(values, named)]
            for i, markup in enumerate(b.column("_markup").to_pylist()):
                if markup is None:
                    continue
                for n, one in enumerate(scanner.scan(markup)):
                    rows.append(i)
                    pos.append(n)
                    if text and not outer:
                        texts.append(plain(one.html))
                    if outer:
                        whole.append(one.outer)
                    for out, k, every in of_field:
                        slots = one.fields.get(k)
                        if every:
                            out.append([plain(s[2]) for s in slots or ()])
                        else:
                            out.append(plain(slots[0][2]) if slots else None)
                    for out, k, a in of_tag:
                        if k is None:
                            value = attributes(one.rest).get(a)
                        else:
                            value = attributes(slots[0][0]).get(a) if (slots := one.fields.get(k)) else None
                        out.append(unescape(value) or None if value else None)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(take) for c in keep), pa.array(pos, pa.int32()),
                 pa.array(texts, pa.string()) if text and not outer else pa.nulls(len(rows), pa.string()),
                 *([pa.array(whole, pa.string())] if outer else []), *(pa.array(x, t) for x, t in zip(cells, kinds)),
                 *(pa.array(x, pa.string()) for x in values)], names=schema.names)
    return pages.select(*keep, pages[body].alias("_markup")).mapInArrow(run, schema)


def scan_pages(pages: DataFrame, body: str, roots: Node | tuple[Node, ...], fields: dict[str, Field],
               whole: dict[str, Field], keep: list[str]) -> DataFrame:
    """One row per page with a body, from one scan of it: the columns ``keep``, per field ``<name>_text`` of the
    page's fields ``whole``, and ``elements``: ``root_text`` and, per field, ``<name>_text`` of every element of
    ``roots`` in page order.  Texts are those of ``scan_elements``.
    """
    roots = (roots,) if isinstance(roots, Node) else roots
    kind = lambda f: T.ArrayType(T.StringType()) if f.every else T.StringType()
    element = T.StructType().add("root_text", "string")
    for k, f in fields.items():
        element.add(f"{k}_text", kind(f))
    schema = T.StructType([pages.schema[c] for c in keep])
    for k, f in whole.items():
        schema.add(f"{k}_text", kind(f))
    schema.add("elements", T.ArrayType(element))
    arrow = lambda f: pa.list_(pa.string()) if f.every else pa.string()
    one_type = pa.struct([("root_text", pa.string()), *((f"{k}_text", arrow(f)) for k, f in fields.items())])

    def text(one: _Found, k: str, f: Field):
        slots = one.fields.get(k, [])
        return [plain(s[2]) for s in slots] if f.every else plain(slots[0][2]) if slots else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(roots, fields, whole=whole)
        for b in batches:
            rows, elements = [], []
            cells: list[list] = [[] for _ in whole]
            for i, markup in enumerate(b.column("_markup").to_pylist()):
                if markup is None:
                    continue
                page, *found = scanner.scan(markup)
                rows.append(i)
                for out, (k, f) in zip(cells, whole.items()):
                    out.append(text(page, k, f))
                elements.append([{"root_text": plain(one.html), **{f"{k}_text": text(one, k, f) for k, f in fields.items()}}
                                 for one in found])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(take) for c in keep), *(pa.array(x, arrow(f)) for x, f in zip(cells, whole.values())),
                 pa.array(elements, pa.list_(one_type))], names=schema.names)
    return pages.select(*keep, pages[body].alias("_markup")).mapInArrow(run, schema)
