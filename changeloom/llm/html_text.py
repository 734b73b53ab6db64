"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  First pass: a block inside a menu, header, footer, sidebar, notice, advert, form or comment
section is bad; else its length, link density and stop-word density make it good, bad or, if it is short, ambiguous.  Second
pass: an ambiguous block takes the label of its nearest decided neighbours.  Where a page marks its article (``article``,
``main``), only what is inside counts, and only blocks inside are neighbours; prose isn't needed there for a block to be good.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Comments and declarations, or a tag; quotes that don't close before the next tag are plain characters.
TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?:.*?\]\]>|.*\Z)|<[!?][^>]*+>?|"
                 r"<(/?)([A-Za-z][A-Za-z0-9:_-]*+)((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>?", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")
SMALL_TO_LARGE = re.compile(r"(?<=[a-z])(?=[A-Z])")
SENTENCE_END = re.compile(r"[.!?…](?=\s|$)|[。！？।؟]")

RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes object".split())
END_OF = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frame h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead tr ul".split())
# Open elements that matter for what is around a block; others needn't be closed to be right.
HELD = BLOCK - frozenset("p hr h1 h2 h3 h4 h5 h6 li dd dt td th tr tbody thead tfoot option body html frame".split())
FRAME = frozenset("nav aside footer form button select fieldset dialog menu head".split())
MAIN = frozenset(("article", "main"))
# Words in class names and ids of frames.  The first need no other word; of the others, which everyday names hold as well, the whole
# name must say so, or all its other words must name a container.
FRAME_WORDS = frozenset(
    "ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus "
    "footer gdpr masthead menu modal nav navbar navigation newsletter pager pagination popup respond replies sidebar sponsored toolbar "
    "topbar widget".split())
COMMON_WORDS = frozenset(
    "ad notice notification promo promoted related reply share sharing social sponsor subscribe".split())
CONTAINERS = frozenset(
    "area articles banner bar block bottom box button buttons card container content entries footer form group head header icons inline "
    "inner items left link links list main media module news outer page panel post posts primary right row secondary section site "
    "slot stories strip tools top unit widget wrap wrapper".split()) | FRAME_WORDS
# Names with one of these tell the state or the layout of a page, not what the element is.
STATES = frozenset(
    "active allowed allow closed disabled enabled has hidden hide is layout no not off on open show with without".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())

STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he his in is it its not of on or she that the their they this to was were "
    "which will with you aber als auch auf aus bei das dem den der des die ein eine einen für im ist mit nicht oder sich sie sind und von "
    "war wie zu au aux avec ce ces dans de du elle en est et il la le les leur mais ne ou par pas pour que qui sa se ses son sur un une al "
    "como con del el ella es la las lo los más no o para pero por se sin su sus un una y".split())
SHORT, LONG = 70, 200
MOST_LINKS = 0.5
FEW_STOP_WORDS, MANY_STOP_WORDS = 0.15, 0.28
# A text with fewer known words is in another language: it is prose if it has a sentence end for every so many characters.
NO_STOP_WORDS, SENTENCE = 0.02, 200

GOOD, BAD, AMBIGUOUS = 1, -1, 0


class Block(NamedTuple):
    text: str
    linked: int    # characters in links
    framed: bool   # inside a menu, advert, ...
    main: int      # number of the article it is in, 0 if in none


def _names_frame(name: str) -> bool:
    """Whether a class name or id, such as ``comment-list``, names a frame; ``has-sidebar`` and ``comments-open`` don't."""
    words = WORD.findall(SMALL_TO_LARGE.sub(" ", name).lower())
    if not words or STATES.intersection(words):
        return False
    common = COMMON_WORDS.intersection(words)
    return not FRAME_WORDS.isdisjoint(words) or bool(common) and all(w in CONTAINERS or w in COMMON_WORDS for w in words)


def _is_frame(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in FRAME or (tag == "header" and not in_main):
        return True
    if not attributes or tag in ("html", "body") or tag in MAIN:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if name.lower() == "role":
            if not FRAME_ROLES.isdisjoint(value.lower().split()):
                return True
        elif any(_names_frame(x) for x in value.split()):
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    out: list[Block] = []
    parts: list[str] = []
    linked, in_link, frames, mains, main_number = 0, False, 0, 0, 0
    stack: list[tuple[str, bool, bool]] = []
    open_tags: Counter[str] = Counter()

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, linked, frames > 0, main_number if mains else 0))
            parts.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        if begin > at:
            add(page[at:begin])
        found = TAG.match(page, begin)
        if not found:
            add("<")
            at = begin + 1
            continue
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not found[1] and not found[3].endswith("/"):
                end = END_OF[tag].search(page, at)
                at = end.end() if end else size
            continue
        if tag == "a":
            in_link = not found[1]
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            flush()
            if tag not in HELD:
                continue
            if not found[1]:
                if found[3].endswith("/"):
                    continue
                frame, main = _is_frame(tag, found[3], mains > 0), tag in MAIN
                main = main and not frame and not frames
                if main and not mains:
                    main_number += 1
                frames += frame
                mains += main
                stack.append((tag, frame, main))
                open_tags[tag] += 1
            elif open_tags[tag]:
                while True:
                    name, frame, main = stack.pop()
                    open_tags[name] -= 1
                    frames -= frame
                    mains -= main
                    if name == tag:
                        break
    flush()
    return out


def first_pass(block: Block) -> int:
    """Label by what the block itself shows."""
    if block.framed:
        return BAD
    length = len(block.text)
    if 2 * block.linked > length * 2 * MOST_LINKS:
        return BAD
    words = block.text.lower().split()
    density = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if length < SHORT:
        return AMBIGUOUS
    if density >= MANY_STOP_WORDS or block.main:
        return GOOD
    if density >= FEW_STOP_WORDS:
        return GOOD if length >= LONG else AMBIGUOUS
    if density < NO_STOP_WORDS and SENTENCE * len(SENTENCE_END.findall(block.text)) >= length:
        return GOOD if length >= LONG else AMBIGUOUS
    return BAD


def second_pass(labels: list[int], blocks: list[Block]) -> list[int]:
    """Ambiguous blocks follow the nearest decided neighbours of the same article: both, if they agree, else the nearer one,
    else the good one inside an article and the bad one outside.  Without neighbours a block inside an article is good."""
    n = len(labels)
    before: list[tuple[int, int] | None] = [None] * n
    after: list[tuple[int, int] | None] = [None] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, tuple[int, int]] = {}
        for i in order:
            if labels[i] != AMBIGUOUS:
                if not blocks[i].framed or not blocks[i].main:
                    last[blocks[i].main] = (i, labels[i])
            else:
                side[i] = last.get(blocks[i].main)
    out = list(labels)
    for i, label in enumerate(labels):
        if label != AMBIGUOUS:
            continue
        inside = GOOD if blocks[i].main else BAD
        near = [s for s in (before[i], after[i]) if s]
        if not near:
            out[i] = inside
        elif len(near) == 1 or near[0][1] == near[1][1]:
            out[i] = near[0][1]
        else:
            left, right = i - near[0][0], near[1][0] - i
            out[i] = near[0][1] if left < right else near[1][1] if right < left else inside
    return out


def main_text(page: str | None) -> str:
    """Text of the good blocks, one per line."""
    if not page:
        return ""
    blocks = blocks_of(page)
    if any(b.main and not b.framed for b in blocks):
        blocks = [b for b in blocks if b.main]
    labels = second_pass([first_pass(b) for b in blocks], blocks)
    return "\n".join(b.text for b, label in zip(blocks, labels) if label == GOOD)


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``; ``n_chars`` counts code points.

    NULL and empty pages, and pages without a good block, have an empty text.  Rows are worked on one by one, without a shuffle;
    columns other than ``page_id``, ``url`` and ``html`` are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return source.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
