"""HTML extraction: blocks of a page are labelled by a minimum cut."""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import drawn, text_of

# Elements that begin a block, elements without an end, elements whose content is no text.
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section select summary table tbody"
    " td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style template noscript iframe xmp noembed noframes textarea svg math canvas object".split())
CLOSED_BY_SAME = set("li dt dd option tr td th".split())
SIGNS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager topbar skip",
    "header": "header masthead branding logo", "footer": "footer copyright colophon legal",
    "side": "aside sidebar side widget rail related recommended recommendations trending popular share sharing social tags",
    "form": "form search login signin signup subscribe newsletter",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense",
    "notice": "cookie cookies consent gdpr notice notices notification alert modal popup overlay paywall toast hidden",
    "comment": "comment comments disqus reply replies respond discussion",
    "article": "article post entry story articlebody", "main": "main content body prose text",
}
TAG_SIGNS = {
    "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "side", "form": "form", "select": "form",
    "button": "form", "fieldset": "form", "search": "form", "dialog": "notice", "article": "article", "main": "main",
    "head": "notice", "title": "notice",
}
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "side", "search": "form",
         "form": "form", "dialog": "notice", "alert": "notice", "article": "article", "main": "main"}
NAMES = list(SIGNS)
SIGN_OF = {word: name for name, words in SIGNS.items() for word in words.split()}
BAD = {"nav", "header", "footer", "side", "form", "ad", "notice", "comment"}
STATS = ["bias", "is_p", "is_heading", "is_item", "words", "link_share", "stops", "ends", "mark"]
# Prior weights, pulled by training: signs first, then the statistics of the text.
PRIOR = np.array([-6.0 if name in BAD else 3.0 if name == "article" else 1.5 for name in NAMES]
                 + [-1.0, 1.0, 0.5, -0.5, 1.0, -3.0, 1.0, 0.5, -2.0])
SMOOTH = 0.6

_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]+)(\s*=\s*)?|[\s/]*(=)")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TOKENS = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>]|$)", re.I) for name in RAW}
_STOPS = re.compile(r"[.!?;:,]")


def _attributes(page: str, at: int, last: dict[str, int]) -> tuple[int, dict[str, str]]:
    """The place behind the tag's end, and its attributes. A quote delimits a value only behind ``=`` and if it is closed."""
    found: dict[str, str] = {}
    while True:
        while at < len(page) and page[at] in " \t\n\r\f/":
            at += 1
        if at >= len(page):
            return at, found
        if page[at] == ">":
            return at + 1, found
        match = _ATTRIBUTE.match(page, at)
        if match.group(3):
            at = match.end()
            continue
        name, at = match.group(1), match.end()
        value = ""
        if match.group(2) and at < len(page):
            quote = page[at]
            if quote in "\"'" and at < last[quote]:
                end = page.index(quote, at + 1)
                value, at = page[at + 1:end], end + 1
            else:
                end = at
                while end < len(page) and page[end] not in " \t\n\r\f>":
                    end += 1
                value, at = page[at:end], end
        found.setdefault(name.lower(), value)


def _signs(tag: str, attributes: dict[str, str]) -> frozenset[str]:
    signs = {TAG_SIGNS[tag]} if tag in TAG_SIGNS else set()
    for name in ("class", "id", "itemprop"):
        if attributes.get(name) and tag not in ("html", "body"):
            signs.update(SIGN_OF[word] for word in _TOKENS.findall(html.unescape(attributes[name]).lower()) if word in SIGN_OF)
    if attributes.get("role", "").lower() in ROLES:
        signs.add(ROLES[attributes["role"].lower()])
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(
            r"display\s*:\s*none", attributes.get("style", "")[:2000], re.I):
        signs.add("notice")
    return frozenset(signs)


def blocks_of(page: str) -> list[tuple[str, int, str, frozenset[str], int, int]]:
    """Blocks in page order: (text, characters in links, element, signs of it and those around it, parent, grandparent).

    One pass in time linear in the page; elements may be unclosed or cut off.
    """
    last = {quote: page.rfind(quote) for quote in "\"'"}
    out: list = []
    stack: list[tuple[str, int, frozenset[str]]] = [("", 0, frozenset())]
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked, in_link, made, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                tag, own, signs = stack[-1]
                parent = stack[-2][1] if len(stack) > 1 else 0
                out.append((text, min(linked, len(text)), tag, signs, own if tag not in ("p", "li") and not tag.startswith("h")
                            else parent, parent if tag not in ("p", "li") else stack[-3][1] if len(stack) > 2 else 0))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        linked += len(text) if in_link else 0

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    while at < len(page):
        open_at = page.find("<", at)
        if open_at < 0:
            say(page[at:])
            break
        if open_at > at:
            say(page[at:open_at])
        at = open_at + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 1)
            at = len(page) if end < 0 else end + 3
            continue
        closing = page.startswith("/", at)
        name = _NAME.match(page, at + closing)
        if not name:
            if closing or page[at:at + 1] in ("!", "?"):
                end = page.find(">", at)
                at = len(page) if end < 0 else end + 1
            else:
                parts.append("<")
            continue
        tag = name.group().lower()
        at, attributes = _attributes(page, name.end(), last)
        if closing:
            if tag == "a":
                in_link = 0
            elif tag in BLOCKS:
                flush()
                if opened.get(tag):
                    while pop() != tag:
                        pass
            continue
        if tag in RAW:
            if page[at - 2:at] != "/>" or tag not in ("svg", "math"):
                end = _RAW_END[tag].search(page, at)
                at = len(page) if end is None else _attributes(page, end.end(), last)[0]
            continue
        if tag == "a":
            in_link = 1
        elif tag in ("br", "img", "input", "button", "td", "th"):
            parts.append(" ")
        if tag in BLOCKS:
            flush()
            in_link = in_link if tag not in ("p", "div", "li", "article", "section") else 0
            if opened.get("p"):  # a block ends an open paragraph
                while pop() != "p":
                    pass
            if tag in CLOSED_BY_SAME and stack[-1][0] == tag:
                pop()
            if tag not in VOID:
                made += 1
                stack.append((tag, made, stack[-1][2] | _signs(tag, attributes)))
                opened[tag] = opened.get(tag, 0) + 1
        elif tag in ("button", "label") and tag not in VOID:
            flush()
    flush()
    return out


def block_features(blocks: list) -> np.ndarray:
    rows = []
    for text, linked, tag, signs, _, _ in blocks:
        words = text.count(" ") + 1
        rows.append([float(name in signs) for name in NAMES] + [
            1.0, float(tag == "p"), float(len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()),
            float(tag in ("li", "td", "th", "option")), min(1.5, np.log1p(words) / 3), linked / len(text),
            min(1.0, len(_STOPS.findall(text)) / words * 4), float(text[-1] in ".!?\"'…”)"),
            float("©" in text or "all rights reserved" in text.lower())])
    return np.array(rows, float).reshape(-1, len(PRIOR))


def weak_label(signs: frozenset[str]) -> int | None:
    """1 inside an article or main part, 0 inside a part that says what it is, None where markup tells nothing."""
    if signs & (BAD - {"header"}) or "header" in signs and "article" not in signs:
        return 0
    return 1 if signs & {"article", "main"} else None


def fit_blocks(pages: DataFrame, sample_rows: int = 400) -> np.ndarray:
    """Weights of the block classifier from a bounded sample of pages (``sample_rows`` expected, by hash of the id).

    Labels are those that the markup itself tells. Every block counts twice, with its signs and without, so that
    the text alone decides where a page has no telling markup. Weights stay near ``PRIOR`` where
    the sample says nothing. Rows without an id are not learned from.
    """
    share = sample_rows / max(1, pages.count())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, labels = [], []
            for page in batch.column("html").to_pylist():
                known = [block for block in blocks_of(page) if weak_label(block[3]) is not None]
                held.append(block_features(known).astype("<f4").tobytes())
                labels.append(bytes(weak_label(block[3]) for block in known))
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(labels, pa.binary())], names=["x", "y"])

    chosen = pages.filter(drawn(F.col("page_id"), share))
    rows = sorted(chosen.select(text_of(F.col("html")).alias("html")).mapInArrow(encode, "x binary, y binary").collect())
    x = np.frombuffer(b"".join(row["x"] for row in rows), "<f4").reshape(-1, len(PRIOR)).astype(float)
    y = np.frombuffer(b"".join(row["y"] for row in rows), np.uint8).astype(float)
    if not len(y):
        return PRIOR
    masked = x.copy()
    masked[:, :len(NAMES)] = 0
    x, y = np.concatenate([x, masked]), np.concatenate([y, y])
    weights = PRIOR.copy()
    for _ in range(25):  # Newton steps towards the most likely weights under the prior
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + 0.01 * (weights - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + 0.01 * np.eye(len(weights))
        weights = weights - np.linalg.solve(curve, gradient)
    return weights


def minimum_cut(lean: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels that minimise the sum of costs: ``-lean`` of each true node, and the capacity of each edge cut.

    Nodes whose lean exceeds all their open edges have the same label in every minimum cut: they are fixed and
    folded into their neighbours, until none is left. The rest is a max-flow by shortest augmenting levels.
    A node that may be on either side is false.
    """
    near: list[dict[int, float]] = [{} for _ in lean]
    for (a, b), weight in edges.items():
        near[a][b] = near[a].get(b, 0.0) + weight
        near[b][a] = near[b].get(a, 0.0) + weight
    lean, label = list(lean), [None] * len(lean)
    queue = deque(range(len(lean)))
    while queue:
        node = queue.popleft()
        if label[node] is not None or abs(lean[node]) <= sum(near[node].values()):
            if label[node] is not None or lean[node] != 0 or near[node]:
                continue
        label[node] = lean[node] > 0
        for other, weight in near[node].items():
            lean[other] += weight if label[node] else -weight
            del near[other][node]
            queue.append(other)
        near[node] = {}
    rest = [node for node, known in enumerate(label) if known is None]
    if rest:
        for node, side in _max_flow(rest, lean, near).items():
            label[node] = side
    return label


def _max_flow(rest: list[int], lean: list[float], near: list[dict[int, float]]) -> dict[int, bool]:
    """Source side of a minimum cut among ``rest``. Costs above 0 are capacities from the source, others to the sink."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {node: {other: near[node][other] for other in near[node]} for node in rest}
    room[source], room[sink] = {}, {}
    for node in rest:
        if lean[node] > 0:
            room[source][node], room[node][source] = lean[node], 0.0
        else:
            room[node][sink], room[sink][node] = -lean[node], 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            node = queue.popleft()
            for other, left in room[node].items():
                if left > 1e-9 and other not in level:
                    level[other] = level[node] + 1
                    queue.append(other)
        if sink not in level:
            return {node: node in level for node in rest}
        todo = {node: iter(list(room[node])) for node in level}
        path = [source]
        while path:
            node = path[-1]
            if node == sink:
                steps = list(zip(path, path[1:]))
                flow = min(room[a][b] for a, b in steps)
                cut = None
                for at, (a, b) in enumerate(steps):
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                    if room[a][b] <= 1e-9 and cut is None:
                        cut = at
                path = path[:cut + 1]
                todo[path[-1]] = iter([*steps[cut][1:], *todo[path[-1]]])
                continue
            for other in todo[node]:
                if room[node].get(other, 0.0) > 1e-9 and level.get(other, -9) == level[node] + 1:
                    path.append(other)
                    break
            else:
                path.pop()


def main_text(page: str, weights: np.ndarray) -> str:
    """Main text of a page: the blocks on the content side of the cut, one per line."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    lean = block_features(blocks) @ weights
    edges: dict[tuple[int, int], float] = {}
    by_parent: dict[int, int] = {}
    by_grandparent: dict[int, int] = {}
    for at, (_, _, _, _, parent, grandparent) in enumerate(blocks):
        if at:  # neighbours on the page, closer the nearer they are in the tree
            before = blocks[at - 1]
            near = 1.0 if before[4] == parent else 0.5 if parent in before[4:] or before[4] == grandparent else 0.2
            edges[at - 1, at] = SMOOTH * near
        for seen, key, weight in ((by_parent, parent, 0.5), (by_grandparent, grandparent, 0.2)):
            if key in seen and seen[key] != at - 1:
                edges[seen[key], at] = edges.get((seen[key], at), 0.0) + SMOOTH * weight
            seen[key] = at
    kept = minimum_cut(list(lean), edges)
    return "\n".join(block[0] for block, keep in zip(blocks, kept) if keep)


def extracted(page: Column, weights: np.ndarray) -> Column:
    """Main text of a whole page; an empty text for an empty or missing page or one without content."""

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(page or "", weights) for page in batch.to_pylist()], pa.string())

    return extract(text_of(page))
