"""Entries and links out of result pages.

The standard library's parser turns a page into the flat array of its elements, in document order, each with the
number after its last descendant: what is below an element is a slice of the array, and an ancestor one whose range
holds it. That is all that runs in Python; the rules that pick an entry's parts are expressions
over the arrays, and a page's entries become rows before their parts are looked for."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import one_space, trimmed, without_first

# Elements that never have content, those that a like one ends, and the labels of the fields.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
IMPLIED = frozenset(("li", "p", "option"))
COURT_LABEL, PEOPLE_LABEL, ID_LABEL, ADDRESS_LABEL = "Sud", "Sudionici", "OIB", "ADRESA"
MISSING = "N/A"

#: Elements whose text some rule reads, besides any of the class m-date.
SAID = frozenset(("a", "span", "small"))
#: Attributes that some rule reads.
ATTRS = ("href", "target", "id", "data-original-title")
ELEMENTS = f"array<struct<id:int,end:int,parent:int,tag:string,attrs:struct<{','.join(f'`{a}`:string' for a in ATTRS)}>,classes:array<string>,text:string>>"

# Plain markup: text, end tags, and start tags with quoted attributes without references. The parser's general rules make nothing else
# of it, so it is cut by one expression; `_RAW` are the elements whose content isn't markup.
_RAW = "script|style|textarea|title|iframe|noembed|noframes|noscript|plaintext|xmp"
_TAG = rf'</[a-z][a-z0-9]*>|<(?!(?:{_RAW})[ >])[a-z][a-z0-9]*(?: [a-z-]+="[^"<>&]*")*>'
_PLAIN, _PIECE, _ATTR = re.compile(f"(?:[^<]++|{_TAG})*+"), re.compile("<[^>]*>|[^<]+"), re.compile(' ([a-z-]+)="([^"]*)"')


def _head(tag: str, attrs: dict[str, str | None]) -> tuple[str, tuple[str | None, ...], list[str], bool]:
    """What a start tag says: tag, the attributes that are read, classes, whether its text is read."""
    classes = (attrs.get("class") or "").split()
    return tag, tuple((attrs[a] or "") if a in attrs else None for a in ATTRS), classes, tag in SAID or "m-date" in classes


@lru_cache(4096)
def _plain_head(piece: str) -> tuple[str, tuple[str | None, ...], list[str], bool]:
    return _head(piece[1:-1].split(" ", 1)[0], dict(_ATTR.findall(piece)))


class _Flat(HTMLParser):
    """The elements of pages, field by field; `read` takes one page more."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.heads, self.ends, self.parents, self.texts, self.pages = [], [], [], [], [0]
        self.open, self.said, self.first = [], [], 0

    def handle_starttag(self, tag, attrs):
        self._begin(_head(tag, dict(attrs)))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][1] == tag:
                return self._close(k)

    def handle_data(self, data):
        self.said.append(data)

    def _begin(self, head) -> None:
        tag = head[0]
        if tag in IMPLIED and self.open and self.open[-1][1] == tag:
            self._close(len(self.open) - 1)
        at = len(self.heads)
        self.heads.append(head)
        self.ends.append(at + 1)
        self.parents.append(self.open[-1][0] if self.open else -1)
        self.texts.append(None)
        self.open.append((at, tag, len(self.said)))
        if tag in VOID:
            self._close(len(self.open) - 1)

    def _close(self, first: int) -> None:
        for at, _, begun in self.open[first:]:
            self.ends[at] = len(self.heads)
            if self.heads[at][3]:
                self.texts[at] = "".join(self.said[begun:])
        del self.open[first:]

    def read(self, html: str | None) -> None:
        """One page more; one that can't be read has the elements up to there."""
        if html and _PLAIN.fullmatch(html):
            for piece in _PIECE.findall(html):
                if piece[0] != "<":
                    self.said.append(unescape(piece))
                elif piece[1] == "/":
                    self.handle_endtag(piece[2:-1])
                else:
                    self._begin(_plain_head(piece))
        else:
            try:
                self.feed(html or "")
                self.close()
            except Exception:  # noqa: BLE001
                pass
            self.reset()
        self._close(0)
        self.said, self.first = [], len(self.heads)
        self.pages.append(self.first)

    def array(self) -> pa.Array:
        first = np.repeat(self.pages[:-1], np.diff(self.pages))
        parents = np.asarray(self.parents, "i8")
        numbers = [np.arange(len(first)) - first, np.asarray(self.ends, "i8") - first, np.where(parents < 0, -1, parents - first)]
        attrs = [pa.array(x, pa.string()) for x in zip(*(h[1] for h in self.heads), strict=True)] or [pa.array([], pa.string()) for _ in ATTRS]
        classes_at = np.cumsum([0, *(len(h[2]) for h in self.heads)])
        classes = pa.ListArray.from_arrays(pa.array(classes_at, pa.int32()), pa.array([c for h in self.heads for c in h[2]], pa.string()))
        fields = [*(pa.array(x, pa.int32()) for x in numbers), pa.array([h[0] for h in self.heads], pa.string()), pa.StructArray.from_arrays(attrs, names=ATTRS), classes, pa.array(self.texts, pa.string())]
        rows = pa.StructArray.from_arrays(fields, names=["id", "end", "parent", "tag", "attrs", "classes", "text"])
        return pa.ListArray.from_arrays(pa.array(self.pages, pa.int32()), rows)


def elements(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, url, and the page's elements, for each row of `pages`."""
    rows = pages.select(*keep, F.coalesce("url", F.lit("")).alias("url"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # an element takes more room than its markup
                some, made = batch.slice(at, 64), _Flat()
                for html in some.column("html").to_pylist():
                    made.read(html)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in (*keep, "url")), made.array()], [*keep, "url", "elements"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, url string, elements {ELEMENTS}")


_PATH = re.compile("(?:/[A-Za-z0-9_-]+)+")


@lru_cache(1024)
def _root(base: str) -> str:
    return urljoin(base, "/x")[:-2]


def _joined(href: pd.Series, base: pd.Series) -> pd.Series:
    def one(h: str, b: str) -> str:
        return _root(b) + h if _PATH.fullmatch(h) else urljoin(b, h)

    return pd.Series([None if h is None else one(h, b or "") for h, b in zip(href, base, strict=True)], dtype=object)


def absolute(href: Column, base: str) -> Column:
    """A link as seen from its page; null stays null."""
    return F.pandas_udf(_joined, "string")(href, base)


# -- rules over arrays -----------------------------------------------------


def _below(all_: Column, x: Column) -> Column:
    return F.slice(all_, x["id"] + 2, x["end"] - x["id"] - 1)


def _inside(all_: Column, x: Column, test: Callable[[Column], Column] = lambda d: F.lit(True)) -> Column:
    """Of any elements those below x that pass."""
    return F.filter(all_, lambda d: (d["id"] > x["id"]) & (d["id"] < x["end"]) & test(d))


def _first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def _find(all_: Column, test: Callable[[Column], Column]) -> Column:
    return _first(F.filter(all_, test))


def _has_class(x: Column, *names: str) -> Column:
    out = F.array_contains(x["classes"], names[0])
    for name in names[1:]:
        out = out & F.array_contains(x["classes"], name)
    return out


def _link(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: (x["tag"] == "a") & F.coalesce(test(x["attrs"]["href"]), F.lit(False))


def _is_item(x: Column) -> Column:
    return (x["tag"] == "li") & _has_class(x, "item", "row")


def _is_title(x: Column) -> Column:
    return _link(lambda h: F.contains(h, F.lit("/objave/")))(x) & (F.coalesce(x["attrs"]["target"], F.lit("")) == "_blank")


def _under(all_: Column, x: Column, tag: str) -> Column:
    """Whether an element of that tag holds x."""
    return F.exists(all_, lambda p: (p["tag"] == tag) & (p["id"] < x["id"]) & (x["id"] < p["end"]))


def _said(x: Column) -> Column:
    return F.coalesce(trimmed(x["text"]), F.lit(MISSING))


def _range_of(all_: Column, item: Column, number: Column) -> Column:
    """The element of that number: the item or one below it."""
    span = lambda x: F.struct(x["id"].alias("id"), x["end"].alias("end"))
    return F.when(number == item["id"], span(item)).otherwise(_first(F.transform(F.filter(all_, lambda x: x["id"] == number), span)))


_PEOPLE = "array<struct<name:string,oib:string,address:string,role:string>>"


def _is_court_label(below: Column) -> Callable[[Column], Column]:
    return lambda s: (s["tag"] == "small") & (trimmed(s["text"]) == COURT_LABEL) & _under(below, s, "div")


def _is_people_label(s: Column) -> Column:
    return (s["tag"] == "small") & _has_class(s, "text-muted", "d-block") & (trimmed(s["text"]) == PEOPLE_LABEL)


def _person(inside: Column) -> Column:
    """A person out of the elements below a block; without a name it isn't one."""

    def marked(title: str, label: str) -> Column:
        found = _find(inside, lambda n: (n["tag"] == "small") & (F.coalesce(n["attrs"]["data-original-title"], F.lit("")) == title))
        return F.coalesce(trimmed(without_first(found["text"], label)), F.lit(MISSING))

    name = _find(inside, lambda n: (n["tag"] == "span") & ~_has_class(n, "badge"))
    role = _find(inside, lambda n: (n["tag"] == "span") & _has_class(n, "badge-info"))
    return F.struct(trimmed(name["text"]).alias("name"), marked("OIB", ID_LABEL).alias("oib"), marked("Adresa", ADDRESS_LABEL).alias("address"), _said(role).alias("role"))


def _with_court_and_people(rows: DataFrame) -> DataFrame:
    """The court is in the parent of the first label "Sud" inside a div: its first span inside a link. People are in the parent of the
    last label of theirs. One step after the other, as what a lambda refers to is worked out for each element anew."""
    below, item = F.col("below"), F.col("item")
    people = F.filter(below, _is_people_label)
    rows = rows.select("*", _find(below, _is_court_label(below))["parent"].alias("court_at"), F.get(people, F.size(people) - 1)["parent"].alias("people_at"))
    rows = rows.select("*", *[_range_of(below, item, F.col(f"{x}_at")).alias(f"{x}_box") for x in ("court", "people")])
    blocks = _inside(below, F.col("people_box"), lambda b: _has_class(b, "d-block"))
    rows = rows.select("*", _first(_inside(below, F.col("court_box"), lambda n: (n["tag"] == "span") & _under(below, n, "a"))).alias("court"), F.transform(blocks, lambda b: _inside(below, b)).alias("blocks"))
    named = F.filter(F.transform("blocks", _person), lambda p: F.coalesce(p["name"], F.lit("")) != "")
    return rows.select("*", F.coalesce(named, F.array().cast(_PEOPLE)).alias("participants"))


def html_entries(pages: DataFrame, key: str | list[str] = "page_id", full: bool = True) -> DataFrame:
    """One row for each entry of each page (key, url, html), in the page's order; an item without a title isn't one. `full` off: the
    plain form, without people and download link, its court from the link to the courts' pages."""
    keep = [key] if isinstance(key, str) else key
    page = elements(pages, keep)
    items = F.filter("elements", lambda x: _is_item(x) & F.exists(_below(F.col("elements"), x), _is_title))
    # An item leaves its page with the elements below it, not with those of the whole page.
    parts = F.transform(items, lambda x: F.struct(x["id"].alias("id"), x["end"].alias("end"), _below(F.col("elements"), x).alias("below")))
    rows = page.select(*keep, "url", F.posexplode(parts).alias("result_pos", "item")).withColumn("below", F.col("item.below"))
    below = F.col("below")
    if full:
        rows = _with_court_and_people(rows).withColumn("got", _find(below, _link(lambda h: h.endswith("/preuzimanje"))))
    else:
        plain_court = _find(below, _link(lambda h: F.contains(h, F.lit("/objave-sudova/"))))
        rows = rows.withColumns({"court": plain_court, "participants": F.array().cast(_PEOPLE), "got": F.get(F.array().cast(ELEMENTS), F.lit(0))})
    found = rows.select(
        *keep, "url", "result_pos", "court", "got", "participants", _find(below, _is_title).alias("title"),
        _find(below, _link(lambda h: F.contains(h, F.lit("text=")))).alias("number"), _find(below, lambda x: _has_class(x, "m-date")).alias("date"),
    )
    return found.select(
        *keep, "result_pos", _said(F.col("title")).alias("title"), absolute(F.col("title.attrs")["href"], "url").alias("detail_link"), _said(F.col("number")).alias("case_number"), _said(F.col("court")).alias("court"),
        _said(F.col("date")).alias("date"), absolute(F.col("got.attrs")["href"], "url").alias("document_download_link"), trimmed(F.col("got.text")).alias("document_link_text"), "participants",
    )


def html_links(pages: DataFrame, key: str = "page_id", navigation: bool = False) -> DataFrame:
    """One row for each document link in the documents' section of each detail page, or for each link in the list items of its navigation."""
    page, all_ = elements(pages, [key]), F.col("elements")
    if navigation:
        holders = page.select(key, "url", "elements", F.filter(all_, lambda x: x["tag"].isin("nav", "li")).alias("holders"))
        inside = F.filter(all_, lambda x: _link(lambda h: h.isNotNull())(x) & _under(F.col("holders"), x, "nav") & _under(F.col("holders"), x, "li"))
        rows = holders.select(key, "url", F.posexplode(inside).alias("link_pos", "a"))
    else:
        section = _find(all_, lambda x: (x["tag"] == "section") & (F.coalesce(x["attrs"]["id"], F.lit("")) == "dokumenti"))
        rows = page.select(key, "url", "elements", section.alias("section"))
        rows = rows.select(key, "url", F.posexplode(_inside(all_, F.col("section"), _link(lambda h: F.contains(h, F.lit("/preuzimanje"))))).alias("link_pos", "a"))
    return rows.select(key, "link_pos", absolute(F.col("a.attrs")["href"], "url").alias("url"), one_space(trimmed(F.col("a.text"))).alias("text"))
