"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text blocks, each with its root-to-leaf path of block-level tags. Elements that are never
article text (``DROPPED`` tags, ``NOISE`` words in class, id or role, hidden ones) go with all they hold. Per path, text length
outside links and punctuation are divided by the number of blocks. Both ratios are smoothed along the page with a
Gaussian, fused with each other and with the ratio of the region around (the nearest article or main element, else the
page), and averaged per path. Neither ratio depends on how often a path occurs. A path is content where its value reaches a
share of the page's usual value, a large share where the page has an article or main element elsewhere. Inside such an element all
text is content but that of elements dropped: cells, items and references are short, linked and without marks.

Pages are independent rows: no shuffle, memory of one page. Null and empty pages, and pages without text, give the empty
text. Broken markup (tags left open, cut off or closed twice) is read as far as it makes sense. Repeated rows
stay, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tag names of HTML by their role.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup "
    "time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = frozenset("head nav header footer aside form button select option menu dialog template svg math object canvas audio video map datalist".split()) | RAW
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"}}
REGION = frozenset(["article", "main"])
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side-?bar|menu|nav\w*|breadcrumbs?|footer|masthead|site-?header|page-?header|cookies?\w*|"
    r"consent|gdpr|notices?|alert|disclaimer|newsletter|subscri\w*|signup|popup|modal|overlay|share|sharing|social|comments?|respond|replies|disqus|related|"
    r"recommended|toolbar|pagination|pager|skip-?link|contentinfo|complementary|navigation|search)(?:$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
NAMED = re.compile(r"(?:^|\s)(class|id|role|style|aria-hidden|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PUNCTUATION = re.compile(r"[,.;:!?…。、，！？；：]")
SPACE = re.compile(r"\s+")

OUTSIDE, PLAIN = 0.5, 0.1
KERNEL = [math.exp(-(i * i) / 2) for i in range(-2, 3)]


@dataclass
class Block:
    path: int
    region: int  # path of the region it lies in, 0 for the page
    text: str
    linked: int  # characters inside links


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    regions: int = 0


def unwanted(attributes: str) -> bool:
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for name, a, b, c in NAMED.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
            return True
        if name in ("class", "id", "role") and NOISE.search(value):
            return True
    return False


def parsed(source: str) -> Page:
    """Blocks of a page in page order, without those in dropped elements."""
    page, paths = Page(), {}
    stack: list[tuple[str, int, int, bool, bool]] = []  # tag, path, region, dropped, in a link
    here = ("", 0, 0, False, False)
    pieces: list[str] = []
    linked = 0
    where = here

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                page.blocks.append(Block(where[1], where[2], text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal where, linked
        if not here[3] and text:
            if not pieces:
                where = here
            pieces.append(text)
            if here[4]:
                linked += len(text.strip())

    at, size = 0, len(source)
    while at < size:
        m = TOKEN.search(source, at)
        if m is None:
            add(source[at:])
            break
        add(source[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            add(" ")
            continue
        block = tag not in INLINE
        if m[1]:
            if any(x[0] == tag for x in reversed(stack)):
                if block:
                    flush()
                while stack.pop()[0] != tag:
                    pass
                here = stack[-1] if stack else ("", 0, 0, False, False)
            continue
        if block:
            flush()
            closes = {"p"} | CLOSES.get(tag, set())
            # A block ends an open paragraph; a cell, row or item ends the one before it, within the same table or list.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    del stack[i:]
                    here = stack[-1] if stack else ("", 0, 0, False, False)
                    if stack and stack[-1][0] in CLOSES.get(tag, ()):
                        continue
                    break
                if stack[i][0] in ("table", "ul", "ol", "dl", "div", "section", "body") or stack[i][0] in REGION:
                    break
        if tag in VOID:
            continue
        dropped = here[3] or tag in DROPPED or unwanted(m[3])
        if tag in ("html", "body") or tag in REGION:
            dropped = here[3]  # a class of the whole page or of its article says nothing against it
        path, region = here[1], here[2]
        if block and not dropped:
            path = paths.setdefault((path, tag), len(paths) + 1)
            if tag in REGION:
                region = path
                page.regions += 1
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            at = end.start() if end else size
        here = (tag, path, region, dropped, here[4] or tag == "a")
        stack.append(here)
    flush()
    return page


def smoothed(values: list[float]) -> list[float]:
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k, w in zip(range(i - 2, i + 3), KERNEL, strict=True):
            if 0 <= k < len(values):
                total += w * values[k]
                weight += w
        out.append(total / weight)
    return out


def ratios(blocks: list[Block], key: str) -> dict[int, tuple[float, float]]:
    """Per path (or region) text length outside links and punctuation, each per block; a block counts one mark more than it has."""
    sums: dict[int, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(getattr(b, key), [0, 0, 0])
        s[0] += 1
        s[1] += len(b.text) - b.linked
        s[2] += len(PUNCTUATION.findall(b.text))
    return {p: (length / n, marks / n + 1) for p, (n, length, marks) in sums.items()}


def content(page: Page) -> list[str]:
    """Texts of the blocks whose path is content."""
    blocks = page.blocks
    if not blocks:
        return []
    own, around = ratios(blocks, "path"), ratios(blocks, "region")
    length = smoothed([own[b.path][0] for b in blocks])
    marks = smoothed([own[b.path][1] for b in blocks])
    fused = [math.sqrt(t * p * math.prod(around[b.region])) for t, p, b in zip(length, marks, blocks, strict=True)]
    of_path: dict[int, list[float]] = {}
    for b, f in zip(blocks, fused, strict=True):
        of_path.setdefault(b.path, []).append(f)
    value = {p: sum(f) / len(f) for p, f in of_path.items()}
    chars = sum(len(b.text) for b in blocks)
    usual = sum(value[b.path] * len(b.text) for b in blocks) / chars
    framed = page.regions and any(b.region for b in blocks)
    return [b.text for b in blocks if b.region or value[b.path] >= usual * (OUTSIDE if framed else PLAIN)]


def main_text(source: str | None) -> str:
    return "\n".join(content(parsed(source))) if source else ""


def extracted(pages: DataFrame, source: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each in column ``out``; the source stays out of the result."""
    schema = T.StructType([f for f in pages.schema if f.name not in (source, out)] + [T.StructField(out, T.StringType())])
    names = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(x) for x in b.column(source).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), texts], names=schema.names)

    return pages.mapInArrow(run, schema)


def sized(pages: DataFrame) -> DataFrame:
    return pages.withColumn("n_chars", F.length("text").cast("long"))
