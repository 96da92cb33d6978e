"""HTML to elements, in one Arrow pass per page (input of the X operators)."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# Elements that extraction looks at; everything else only contributes structure.
KEPT_TAGS = {"p", "h1", "h2", "h3", "h4", "a", "img", "meta", "time", "link", "script", "figcaption", "article", "span", "div", "title"}
KEPT_DIVS = {"date", "author", "category", "tags"}
VOID_TAGS = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
RAW_TAGS = {"script", "style", "template"}

ELEMENT = T.StructType(
    [
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("inside", T.ArrayType(T.StringType())),
    ]
)
GROUPS = {"p": "paragraphs", "a": "anchors", "meta": "metas", "script": "scripts"}
PARSED_TOGETHER = 32  # pages held as Python objects at a time
PAGE = T.StructType([T.StructField(name, T.ArrayType(ELEMENT)) for name in (*GROUPS.values(), "others")])


class _Elements(HTMLParser):
    """Collect elements with their text and the labels of their ancestors, in page order.

    An end tag closes everything up to its nearest open start tag; an end tag without
    one is ignored. Paragraphs therefore nest when they are not closed.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []
        self.open = []

    def handle_starttag(self, tag, attrs):
        given = {name: value or "" for name, value in attrs}
        labels = [tag, *("." + c for c in given.get("class", "").split())]
        if given.get("id"):
            labels.append("#" + given["id"])
        element = None
        useful = tag not in {"div", "span"} or any(k in given.get("class", "").lower() for k in KEPT_DIVS)
        if tag in KEPT_TAGS and useful:
            element = {"tag": tag, "attrs": list(given.items()), "parts": [], "inside": [x for _, known, _ in self.open for x in known]}
            self.found.append(element)
        if tag not in VOID_TAGS:
            self.open.append((tag, labels, element))

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        text = data.strip()
        if not text or not self.open:
            return
        raw = self.open[-1][0] in RAW_TAGS
        for tag, _, element in self.open:
            if element is not None and raw == (tag in RAW_TAGS):
                element["parts"].append(data if raw else text)

    def page(self):
        groups = {name: [] for name in PAGE.names}
        for element in self.found:
            parts, tag = element.pop("parts"), element["tag"]
            element["text"] = "".join(parts) if tag in RAW_TAGS else " ".join(" ".join(parts).split())
            groups[GROUPS.get(tag, "others")].append(element)
        return groups


_ELEMENT = pa.struct([("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("inside", pa.list_(pa.string()))])
_PAGE = pa.struct([(name, pa.list_(_ELEMENT)) for name in PAGE.names])


def _parsed(pages: pa.Array) -> pa.Array:
    """The elements of pages; only a few pages at a time are Python objects."""

    def read(page):
        parser = _Elements()
        parser.feed(page or "")
        parser.close()
        return parser.page()

    parts = [
        pa.array([read(page) for page in pages.slice(start, PARSED_TOGETHER).to_pylist()], _PAGE) for start in range(0, len(pages), PARSED_TOGETHER)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], _PAGE)


@F.arrow_udf(PAGE)
def _page_elements(pages: pa.Array) -> pa.Array:
    return _parsed(pages)


def page_elements(page: Column) -> Column:
    """The elements of a page by kind, each ``array<struct<tag, attrs, text, inside>>``.

    Kinds are ``paragraphs``, ``anchors``, ``metas``, ``scripts`` and ``others``, each in
    page order. ``inside`` lists the tag names, ``.class`` and ``#id`` labels of all
    ancestors, outermost first. Text has single blanks and no scripts or styles.
    """
    return _page_elements(page)
