"""Main text, title and links of HTML pages.

``page_fields`` is an Arrow UDF that walks the tags of each page once. ``simple_main_text``
and ``simple_hrefs`` are built-in expressions for corpora of plain, well-nested markup.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import WHITESPACE, strip

# Elements without content, and elements whose text is not page text.
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_SILENT = frozenset(["script", "style", "template", "rt", "rp"])
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style")}

_MARKUP = re.compile(
    r"<!--(?P<comment>.*?)(?:--!?>|\Z)"
    r"|<[!?](?P<declaration>[^>]*)(?:>|\Z)"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    # A quote delimits a value only directly behind the equals sign.
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        found[name.lower()] = html.unescape(value)
    return found


def read_page(source: str) -> tuple[str | None, str | None, list[str]]:
    """Main text, title and every ``a[href]`` of one page.

    Main text is that of the first ``div role=main``, else the first ``article``, else the
    ``body``; None when the page has none of them. Title is None without a title element.
    """
    texts: dict[str, list[str]] = {}
    open_at: dict[str, int] = {}
    stack: list[str] = []
    opened: Counter[str] = Counter()
    silent = 0
    hrefs: list[str] = []

    def close(name: str) -> None:
        nonlocal silent
        while opened[name]:
            top = stack.pop()
            opened[top] -= 1
            silent -= top in _SILENT
            leave(len(stack))
            if top == name:
                return

    def leave(depth: int) -> None:
        for region in [r for r, start in open_at.items() if start == depth]:
            del open_at[region]

    def add_text(raw: str) -> None:
        if open_at and not silent:
            node = html.unescape(raw).strip(WHITESPACE)
            if node:
                for region in open_at:
                    texts[region].append(node)

    def enter(region: str) -> None:
        if region not in texts:
            texts[region] = []
            open_at[region] = len(stack)

    position = 0
    while (tag := _MARKUP.search(source, position)) is not None:
        if tag["comment"] is None and source[tag.end() - 1] != ">":
            break  # cut off: no tag ends from here on
        add_text(source[position:tag.start()])
        position = tag.end()
        if name := tag["open"]:
            name = name.lower()
            raw = tag["attributes"]
            attributes = _attributes(raw) if raw and name in ("a", "div") else {}
            if name == "a" and "href" in attributes:
                hrefs.append(attributes["href"])
            if name == "div" and attributes.get("role") == "main":
                enter("main")
            elif name in ("article", "body", "title"):
                enter(name)
            if name in _VOID or raw.rstrip().endswith("/"):
                leave(len(stack))
                continue
            if name in _RAW_END:
                end = _RAW_END[name].search(source, position)
                position = end.start() if end else len(source)
            stack.append(name)
            opened[name] += 1
            silent += name in _SILENT
        elif name := tag["close"]:
            close(name.lower())
    add_text(source[position:])
    picked = next((texts[r] for r in ("main", "article", "body") if r in texts), None)
    return (
        None if picked is None else "\n".join(picked),
        "".join(texts["title"]) if "title" in texts else None,
        hrefs,
    )


_PAGE_FIELDS = T.StructType([
    T.StructField("main_text", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("hrefs", T.ArrayType(T.StringType())),
])


@F.arrow_udf(_PAGE_FIELDS)
def page_fields(pages: pa.Array) -> pa.Array:
    """Struct of main text, title and hrefs for each page."""
    rows = [read_page(page) if page is not None else (None, None, []) for page in pages.to_pylist()]
    texts, titles, hrefs = zip(*rows) if rows else ((), (), ())
    return pa.StructArray.from_arrays(
        [pa.array(texts, pa.string()), pa.array(titles, pa.string()), pa.array(hrefs, pa.list_(pa.string()))],
        names=_PAGE_FIELDS.names,
    )


def simple_main_text(page: Column) -> Column:
    """Main text of plain markup: one block by pattern, tags cut, entities decoded.

    Right for pages whose main block holds no element of its own kind, no script and no
    entity beyond those below; ``page_fields`` has no such limits.
    """
    block = F.coalesce(
        *[
            F.nullif(F.regexp_extract(page, rf"(?is)<{opening}[^>]*>(.*?)(?:</{closing}>|$)", 1), F.lit(""))
            for opening, closing in (
                (r'div\s[^>]*role="main"', "div"), ("article", "article"), ("body", "body")
            )
        ]
    )
    nodes = F.transform(F.split(block, r"<[^>]*>"), lambda node: strip(decode_entities(node)))
    return F.array_join(F.filter(nodes, lambda node: node != ""), "\n")


def decode_entities(text: Column) -> Column:
    """Decode the five XML entities and the no-break space."""
    # Entity names and their characters; the ampersand goes last.
    for entity, character in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
        ("&nbsp;", "\xa0"),
    ):
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.regexp_replace(text, "&amp;?", "&")


def simple_hrefs(page: Column) -> Column:
    """Every double-quoted ``a[href]`` by pattern."""
    return F.regexp_extract_all(page, F.lit(r'(?i)<a\s(?:[^>]*?\s)?href="([^"]*)"'), F.lit(1))
