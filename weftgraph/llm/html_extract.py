"""Main text of web pages: flat text blocks classified by a decision tree."""

from __future__ import annotations

import functools
import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, only
from .html_table import labelled_pages

# Element names of HTML and roles of ARIA.
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_CONTAINER = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table ul td".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp template svg noscript object select button canvas math".split())
_NESTING = frozenset("template svg object math".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_ASIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
_ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_TAG = re.compile(r"([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(role|hidden|data-main)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.IGNORECASE)
_END_OF_TAG = re.compile(r"""[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+>""")
_BORDER = re.compile(rf"</?(?:{'|'.join(sorted(_BLOCK - {'optgroup', 'option', 'title'}))})(?![a-zA-Z0-9:-])", re.IGNORECASE)


class Block:
    __slots__ = ("text", "words", "link_words", "aside", "main", "heading", "item", "label")

    def __init__(self, text, words, link_words, aside, main, heading, item, label):
        self.text, self.words, self.link_words = text, words, link_words
        self.aside, self.main, self.heading, self.item, self.label = aside, main, heading, item, label


def _place(tag: str, attributes: str, inside_main: bool, inside_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element's name or role makes it an aside, or main content, and whether the labelled table marks it as main.

    An article within an article is a reader's comment, as HTML has it; a header within
    main content belongs to it.
    """
    aside = tag in _ASIDE_TAGS or (tag == "header" and not inside_main) or (tag == "article" and inside_article)
    main, label = tag in ("article", "main"), False
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role":
            aside |= value in _ASIDE_ROLES
            main |= value in ("main", "article")
        elif name == "hidden":
            aside = True
        else:
            label = True
    return aside, main, label


def _after_raw(page: str, tag: str, at: int, endless: set[str]) -> int:
    """Where a page goes on after an element whose contents are no text.

    That is behind its end tag. If there is none, or another element of the kind begins
    before it (and the kind does not nest), it was left open: then the next block border
    ends it, so that no article is lost; an open script or style runs to the page's end,
    as browsers have it. ``endless`` remembers names without a further end tag.
    """
    depth, low = 1, at
    marks = re.compile(rf"<(/?){tag}(?![a-zA-Z0-9:-])[^>]*>?", re.IGNORECASE)
    while tag not in endless:
        m = marks.search(page, low)
        if not m:
            endless.add(tag)
            break
        low = m.end()
        if m[1]:
            depth -= 1
            if not depth:
                return low
        elif tag in _NESTING:
            depth += not m[0].endswith("/>")
        elif tag not in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"):  # in those a start tag is just text
            break
    if tag in ("script", "style"):
        return len(page)
    border = _BORDER.search(page, at)
    return border.start() if border else len(page)


def blocks(page: str) -> list[Block]:
    """Flat text blocks of a page in order, with what the classifier needs.

    A block is the text between two borders of block elements; inline markup does not
    end it. Contents of scripts, styles and the like, comments and declarations are no
    text. Unclosed elements and tags are taken as they come (see :func:`_after_raw`); ``<``
    before anything but a tag is text.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
    endless: set[str] = set()
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    in_link, heading, item, low, n = False, False, False, 0, len(page)

    def close() -> None:
        nonlocal heading, item
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                _, aside, main, label = stack[-1]
                link = len(html.unescape("".join(linked)).split()) if linked else 0
                out.append(Block(" ".join(words), len(words), link, aside, main, heading, item, label))
            parts.clear()
            linked.clear()

    def text(piece: str) -> None:
        if piece:
            parts.append(piece)
            if in_link:
                linked.append(piece)

    no_comment_end = False
    while low < n:
        at = page.find("<", low)
        if at < 0:
            text(page[low:])
            break
        text(page[low:at])
        c = page[at + 1 : at + 2]
        if c == "!" and page.startswith("<!--", at):
            end = -1 if no_comment_end else page.find("-->", at + 4)
            no_comment_end |= end < 0
            low = end + 3 if end >= 0 else n
            continue
        if c in "!?" and c:
            end = page.find(">", at)
            low = end + 1 if end >= 0 else n
            continue
        closing = c == "/"
        m = _TAG.match(page, at + 1 + closing)
        if not m:
            text("<")
            low = at + 1
            continue
        tag = m[1].lower()
        end = _END_OF_TAG.match(page, m.end())
        stop = end.end() if end else page.find(">", m.end()) + 1 or n
        attributes, low = page[m.end() : stop - 1], stop
        if tag in _RAW and not closing and not attributes.endswith("/"):
            if tag in _BLOCK:
                close()
            low = _after_raw(page, tag, stop, endless)
            continue
        if tag in ("br", "wbr"):
            text(" " if tag == "br" else "")
        elif tag == "a":
            in_link = not closing
            if in_link:
                linked.append(" ")
        elif tag in _BLOCK:
            close()
            in_link = False
            if tag in _CONTAINER:
                if not closing:
                    _, aside, main, label = stack[-1]
                    a, b, lab = _place(tag, attributes, main, opened["article"] > 0)
                    stack.append((tag, aside or a, (main or b) and not a, (label or lab) and not a))
                    opened[tag] += 1
                elif opened[tag]:
                    while (gone := stack.pop()[0]) != tag:
                        opened[gone] -= 1
                    opened[tag] -= 1
            heading, item = tag in _HEADING and not closing, (tag == "li" and not closing) or (item and tag != "li" and not closing)
        elif tag in ("img", "input"):
            text(" ")
    close()
    return out


NEIGHBOURS = (-1, 1, -2, 2)
FEATURES = ("words", "link density", *(f"{what} {abs(d)} {'before' if d < 0 else 'after'}" for d in NEIGHBOURS for what in ("words", "link density")), "place", "heading", "item")


def features(found: list[Block]) -> np.ndarray:
    """One row per block: its own and its neighbours' word counts and link densities, and what the elements around it say.

    ``place`` is 1 in a page's main element, -1 in an aside element or outside the main
    element of a page that has one, and 0 where the page says nothing.
    """
    n, reach = len(found), 2
    own = np.zeros((n + 2 * reach, 2))
    own[reach : reach + n, 0] = [b.words for b in found]
    own[reach : reach + n, 1] = [min(1.0, b.link_words / b.words) for b in found]
    around = [own[reach + d : reach + d + n] for d in (0, *NEIGHBOURS)]
    elsewhere = -1 if any(b.main for b in found) else 0
    place = [1 if b.main else -1 if b.aside else elsewhere for b in found]
    return np.concatenate([*around, np.array([(p, b.heading, b.item) for p, b in zip(place, found)], float).reshape(n, 3)], axis=1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 4) -> tuple:
    """A binary decision tree by least Gini impurity with at least ``least`` rows a leaf; ties go to the first feature and the lowest threshold."""
    n, share = len(y), y.mean() if len(y) else 0.0
    best = None
    if depth and 0.0 < share < 1.0:
        sizes = np.arange(1, n)
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, left = x[order, j], np.cumsum(y[order])[:-1]
            right = y.sum() - left
            score = left * (1 - left / sizes) + right * (1 - right / (n - sizes))
            score[(v[1:] == v[:-1]) | (sizes < least) | (n - sizes < least)] = np.inf
            k = int(score.argmin()) if n > 1 else 0
            if n > 1 and np.isfinite(score[k]) and (best is None or score[k] < best[0] - 1e-12):
                best = float(score[k]), j, float(v[k] + v[k + 1]) / 2
    if best is None:
        return (bool(share > 0.5),)
    _, j, t = best
    low = x[:, j] <= t
    return j, t, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


@functools.cache
def trained() -> tuple:
    """The tree of the labelled table."""
    pages = [blocks(p) for p in labelled_pages()]
    return grow(np.concatenate([features(p) for p in pages]), np.array([b.label for p in pages for b in p], float))


def main_text(page: str | None, tree: tuple | None = None) -> str:
    """Blocks that the tree takes for main content, joined by an empty line."""
    found = blocks(page) if page else []
    if not found:
        return ""
    keep, tree = [], tree or trained()
    for block, row in zip(found, features(found).tolist()):
        node = tree
        while len(node) > 1:
            node = node[2] if row[node[0]] <= node[1] else node[3]
        if node[0]:
            keep.append(block.text)
    return "\n\n".join(keep)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: ``page_id, url, text, n_chars``.

    Each page becomes flat text blocks with word counts and link densities of the block and
    its neighbours, and the elements it stands in (HTML's names and ARIA's roles, no class
    names); a decision tree trained on a small labelled table tells main content from the
    rest. Character references are decoded, white space in a block becomes one space,
    blocks are joined by two line feeds.

    Null or empty html, and pages without main text, give the empty text; null ids and
    urls stay null; repeated rows give repeated results; an empty table gives none;
    other columns are ignored. Pages are read whole, in one narrow pass.
    """
    tree = trained()

    def fold(batch: pa.RecordBatch) -> dict[str, list]:
        text = [main_text(p, tree) for p in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": text, "n_chars": [len(t) for t in text]}

    return map_rows(only(df, page_id=id_col, url=url_col, html=html_col), fold, "page_id bigint, url string, text string, n_chars bigint")
