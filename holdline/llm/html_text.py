"""Main text of HTML pages by a maximum-scoring subsequence.

A page is read as a row of words and tags. Words score positive, more where what stands
around them speaks for main text; tags score negative, more for those seldom met within
it. One linear scan finds the run with the largest sum, the content region, which is
filled up to the element that holds it; of it, the blocks whose surroundings speak for
main text are the result.

The weights come from labelled pages: those of surroundings (the elements a block is in,
the words of their class, id and role, whether most of it is links) by logistic
regression on labelled blocks, those of tags by how much rarer they are in main text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdline.llm import common
from holdline.llm.html_labels import LINKS, MAIN, PROSE, labelled_pages

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)                                   # comment
      | <(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>  # tag
      | </?[A-Za-z][^>]*(?:>|\Z)                                # tag with an open quote or end
      | <[!?/][^>]*(?:>|\Z)                                     # declaration
      | [^<]+ | <""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements whose inside is no page text, that have no inside, that do not
# end a block, and that end an open paragraph.
NO_TEXT = frozenset(
    "script style noscript template title head svg math iframe object canvas audio video select "
    "option button textarea datalist map".split()
)
RAW = frozenset("script style noscript template title iframe textarea svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var wbr".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
# On the squares of the weights of surroundings.
PENALTY = 0.003
# A layout's class may stand above the article itself; what is in these stays out of it.
_FIRM = frozenset("nav aside footer form comment comments discussion responses disqus reply".split())
_OWN_HEADER = frozenset("article entry post story".split())
# Elements open at once; further ones stand beside the last of them, as in browsers.
_DEPTH = 512
_KNOWN = tuple(sorted({p for n in (*MAIN, *LINKS, *PROSE) for p in re.split("[.#-]", n)[1:] if len(p) > 3}))


@dataclass(frozen=True)
class Block:
    text: str
    around: frozenset[str]
    tags: tuple[str, ...]  # those before it
    main: bool  # its label
    path: tuple[int, ...]  # the elements it is in, by their order in the page


@lru_cache(maxsize=20_000)
def _names(value: str) -> frozenset[str]:
    """The words of a class, id or role, and known words that they begin or end with."""
    parts = {p.lower() for p in _NAME_PART.findall(value)}
    more = {k for p in parts for k in _KNOWN if p.startswith(k) or p.endswith(k)}
    if parts & _OWN_HEADER:  # the heading of the article, not of the page
        more, parts = more - {"header"}, parts - {"header"}
    return frozenset(parts | more)


@lru_cache(maxsize=20_000)
def _element(name: str, attributes: str) -> tuple[frozenset[str], bool, bool | None]:
    """What an element says of its inside, whether that is shown, and its label."""
    found, shown, main = {f"<{name}>"}, True, None
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), unescape(value.strip("\"'"))
        if key in ("class", "id", "role"):
            found |= _names(value)
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            shown = False
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            shown = False
        elif key == "data-main":
            main = value != "no"
    return frozenset(found), shown, main


def blocks(html: str | None) -> list[Block]:
    """The page's blocks of text in order. Elements that hold no text to read, and
    hidden ones, are passed over."""
    html = html or ""
    out: list[Block] = []
    # Of each open element: name, surroundings, shown, label, whether it is a link, number.
    stack: list[tuple] = [("", frozenset(), True, False, False, 0)]
    text: list[str] = []
    linked, tags = 0, []

    def flush():
        nonlocal linked, tags
        found = " ".join(unescape("".join(text)).split())
        size = sum(map(len, text))
        text.clear()
        if found:
            top = next(x for x in reversed(stack) if x[0] not in INLINE)
            around = top[1]
            if linked > 0.6 * size:
                around = around | {"own links" if around & {"<article>", "<main>"} else "links"}
            path = tuple(x[5] for x in stack if x[0] not in INLINE and x[0] not in ("html", "body"))
            out.append(Block(found, around, tuple(tags), top[3], path))
            tags = []
        linked = 0

    at = 0
    while at < len(html):
        m = _TOKEN.match(html, at)
        at = m.end()
        name = m[2]
        if name is None:
            if html[m.start()] != "<" or m.end() == m.start() + 1:
                if stack[-1][2]:
                    text.append(m[0])
                    linked += len(m[0]) if stack[-1][4] else 0
            continue
        name, closing = name.lower(), bool(m[1])
        if name not in INLINE:
            flush()
        tags.append(name)
        if closing:
            if any(x[0] == name for x in stack[1:]):
                while stack.pop()[0] != name:
                    pass
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
            at = end.start() if end else len(html)
            continue
        if name in ENDS_PARAGRAPH and any(x[0] == "p" for x in stack):
            while stack.pop()[0] != "p":
                pass
        says, shown, main = _element(name, m[3])
        if len(stack) > _DEPTH:
            continue
        _, above, seen, label, link, _ = stack[-1]
        if name in ("html", "body"):
            says = frozenset((f"<{name}>",))
        elif name in ("article", "main") and not above & _FIRM and not {f"<{f}>" for f in _FIRM} & above:
            above = above & {"<html>", "<body>"}
        if name == "header" and ("<article>" in above or "<main>" in above):
            says = says - {"<header>", "header"}
        seen = seen and shown and name not in NO_TEXT
        label = label if main is None else main
        stack.append((name, above | says, seen, label, link or name == "a", at))
    flush()
    return out


@dataclass(frozen=True)
class Weights:
    around: dict[str, float]
    bias: float
    tags: dict[str, float]  # all negative
    other_tag: float


def fit(pages: Sequence[str]) -> Weights:
    """Weights from pages in which elements with main text carry ``data-main``."""
    seen = [b for page in pages for b in blocks(page)]
    names = sorted({f for b in seen for f in b.around})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(seen), len(names) + 1))
    x[:, -1] = 1
    for row, b in enumerate(seen):
        x[row, [place[f] for f in b.around]] = 1
    y = np.array([b.main for b in seen], float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = x.T @ (x * (p * (1 - p))[:, None]) + PENALTY * np.eye(len(w))
        w = w + np.linalg.solve(curve, x.T @ (y - p) - PENALTY * w)
    inside = Counter(t for b in seen if b.main for t in b.tags)
    outside = Counter(t for b in seen if not b.main for t in b.tags)
    share = len([b for b in seen if not b.main]) / max(1, len([b for b in seen if b.main]))
    tags = {t: -float(np.log1p((outside[t] + 1) / share / (inside[t] + 1))) for t in inside | outside}
    return Weights({f: float(w[i]) for f, i in place.items()}, float(w[-1]), tags, -float(np.log(2)))


@lru_cache(maxsize=1)
def default_weights() -> Weights:
    return fit(labelled_pages())


def _speaks_for(block: Block, weights: Weights) -> float:
    """Log odds that a block so surrounded is main text."""
    return weights.bias + sum(weights.around.get(f, 0.0) for f in block.around)


def main_text(html: str | None, weights: Weights) -> str:
    """The main text of a page; empty for a page without any."""
    found = blocks(html)
    odds = [_speaks_for(b, weights) for b in found]
    best, region, total, first = 0.0, (0, 0), 0.0, 0
    for i, (b, o) in enumerate(zip(found, odds)):
        total += sum(weights.tags.get(t, weights.other_tag) for t in b.tags)
        if total <= 0:
            total, first = 0.0, i
        total += max(o, 0.0) * (b.text.count(" ") + 1)
        if total > best:
            best, region = total, (first, i + 1)
    # All of the innermost element that holds the region, short ends included; of one
    # block, the element around it.
    first, last = region
    ends = [b.path for b in found[first:last]]
    common_path = commonprefix(ends) if len(ends) > 1 else ends[0][:-1] if ends else ()
    if len(common_path) > 1:
        inside = [b.path[: len(common_path)] == common_path for b in found]
        first, last = inside.index(True), len(inside) - inside[::-1].index(True)
    return " ".join(b.text for b, o in zip(found[first:last], odds[first:last]) if o > 0)


_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]
)


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``, from its whole html.

    A null page is an empty one and has an empty text, as has a page without main text.
    Ids and urls may be null or repeated: every row keeps its own. Other columns are
    ignored; an empty table gives no rows.
    """
    weights = weights or default_weights()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")

    def run(batches):
        for ids, urls, htmls in common.columns_of(batches, "page_id", "url", "html"):
            texts = [main_text(h, weights) for h in htmls]
            cols = {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}
            yield common.batch(cols, _SCHEMA)

    ddl = "page_id long, url string, text string, n_chars long"
    return common.bounded_batches(rows).mapInArrow(run, ddl)
