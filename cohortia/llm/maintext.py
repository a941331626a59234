"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element.  Lines inside menus, adverts, forms and the like
weigh nothing, and neither does link text.  The weights are summed over sliding windows of lines.  The
text surges where a window rises above the threshold and dives where the windows fall below it; what
stands between is the main text, with the lines of its container and the adjoining lines up to the
next menu, advert or link.  Where most of the text found lies in marked articles, the marks are its boundary;
where most lies elsewhere, a mark only adds its lines.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, whole_text

WINDOW = 3
LEAST = 40

# Comments, raw elements with all they hold, declarations, tags with quoted attributes, and a tag cut off by the end.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^<>"']|"[^"]*"|'[^']*')*)(?:>|\Z)"""
    r"|</?[a-zA-Z][^<>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*|\d+")

# Elements that start a line.
BLOCKS = frozenset(
    ["address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt"]
    + ["fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup"]
    + ["hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section"]
    + ["summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"]
)
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
# Elements that never hold main text.
ASIDE = frozenset(["aside", "button", "dialog", "fieldset", "footer", "form", "head", "menu", "nav", "search"])
# Words in class, id or role that mark the same.
NOISE = frozenset(
    ["ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs"]
    + ["comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "disclaimer", "disqus"]
    + ["footer", "foot", "gdpr", "hidden", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter"]
    + ["notice", "notification", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related"]
    + ["reply", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored"]
    + ["subscribe", "tags", "teaser", "teasers", "toolbar", "topbar", "widget", "widgets", "aside", "header"]
)
# Words that name the text itself; beside a name like "post-header" they keep an element.
MAIN = frozenset(["article", "body", "content", "entry", "main", "post", "story", "text", "title", "headline"])
# Words that say something of the layout around an element, as in "has-sidebar".
LAYOUT = frozenset(["has", "no", "with", "without", "type", "status", "format", "category", "tag"])
ARTICLE_ROLES = frozenset(["main", "article"])
HEADS = frozenset(["header"])


def says_noise(names: str, strict: bool) -> bool:
    """Whether class, id or role names mark something beside the text.

    A name is judged by the place of its words: "newsletter-main" begins with what it is, "article-share" ends
    with it, "post-header" heads the text, "has-sidebar" is about the layout.  A name that is nothing but
    words for the text outweighs compounds, but not a plain "comment" or "ad".  With ``strict``, for
    elements that mark an article, only the first word counts.
    """
    plain = compound = text = False
    for name in names.split():
        words = [w.lower() for w in PART.findall(name)]
        words = [w for w in words if not w.isdigit()]
        if not words or words[0] in LAYOUT:
            continue
        if all(w in MAIN for w in words):
            text = True
        elif all(w in NOISE for w in words):
            plain = True
        elif words[0] in NOISE or (not strict and words[-1] in NOISE and not (words[-1] in HEADS and words[0] in MAIN)):
            compound = True
    return plain or (compound and not text)


class Lines:
    """The lines of a page with their weights, fed by tags and text in page order."""

    def __init__(self):
        self.texts: list[str] = []
        self.marked: list[bool] = []
        self.weights: list[int] = []
        self.open: list[str] = []
        self.links = 0
        self.noise: list[tuple[str, int]] = []
        self.articles = 0
        self.stack: list[tuple[str, bool, int]] = []
        # The container of each line (0 for the page), and how many noise blocks stand before it.
        self.containers: list[int] = []
        self.parents: list[int] = [0]
        self.parts: list[int] = []
        self.seen = self.breaks = 0

    def text(self, piece: str) -> None:
        if not self.noise:
            self.open.append(piece)
            if self.links:
                self.linked.append(piece)

    linked: list[str]

    def end_line(self) -> None:
        if self.open:
            line = " ".join(html.unescape("".join(self.open)).split())
            if line:
                inside = len(" ".join(html.unescape("".join(self.linked)).split()))
                self.texts.append(line)
                self.marked.append(self.articles > 0)
                self.weights.append(max(0, len(line) - 2 * inside))
                self.containers.append(self.stack[-1][2] if self.stack else 0)
                self.parts.append(self.breaks)
            self.open = []
        self.linked = []

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.end_line()
            # An open paragraph or list item ends where the next block starts.
            if self.noise and self.noise[-1][0] == "p" and name != "p":
                self.noise.pop()
        if name == "br":
            self.text(" ")
        if name in VOID:
            return
        if self.noise:
            top, depth = self.noise[-1]
            if top == name:
                self.noise[-1] = (top, 1 if name in ("p", "li") else depth + 1)
            return
        found = [m[1] or m[2] or m[3] or "" for m in NAMES.finditer(attributes)] if attributes else []
        words = {p.lower() for f in found for p in PART.findall(f)}
        article = name in ("article", "main") or bool(words & ARTICLE_ROLES and name in ("div", "section", "td"))
        noisy = name in ASIDE or (name in HEADS and not self.articles)
        if words and name not in ("html", "body"):
            noisy = noisy or says_noise(" ".join(found), strict=name in ("article", "main"))
        if noisy or (attributes and HIDDEN.search(attributes) and name != "body"):
            if name not in BLOCKS:
                self.text(" ")
            else:
                self.breaks += 1
            self.noise.append((name, 1))
            return
        if name == "a":
            self.links = 1
        elif article:
            self.articles += 1
            self.contain(name, True)
        elif name in ("div", "section", "td"):
            self.contain(name, False)

    def contain(self, name: str, article: bool) -> None:
        self.parents.append(self.stack[-1][2] if self.stack else 0)
        self.seen += 1
        self.stack.append((name, article, self.seen))

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.end_line()
        if self.noise:
            top, depth = self.noise[-1]
            if top == name:
                self.noise[-1] = (top, depth - 1)
                if depth <= 1:
                    self.noise.pop()
            elif name in ("body", "html"):
                self.noise = []
            return
        if name == "a":
            self.links = 0
        elif name in ("article", "main", "div", "section", "td"):
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at][0] == name:
                    self.articles -= sum(s[1] for s in self.stack[at:])
                    del self.stack[at:]
                    break


def page_lines(page: str) -> Lines:
    lines = Lines()
    lines.linked = []
    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            lines.text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name:
            name = name.lower()
            if m["close"]:
                lines.end(name)
            else:
                attributes = m["attributes"]
                lines.start(name, attributes)
                if attributes.endswith("/") and name not in VOID and lines.noise and lines.noise[-1] == (name, 1):
                    lines.noise.pop()
    if at < len(page):
        lines.text(page[at:])
    lines.end_line()
    return lines


def main_region(weights: np.ndarray, window: int = WINDOW, least: int = LEAST) -> np.ndarray:
    """Which lines stand between a surge and a dive of the summed weights."""
    n = len(weights)
    total = np.cumsum(np.concatenate(([0], weights)))
    # Window i is lines i .. i + window - 1; windows overhang both ends.
    first = np.arange(1 - window, n)
    sums = total[np.minimum(first + window, n)] - total[np.maximum(first, 0)]
    dense = sums >= least
    keep = np.zeros(n, bool)
    edge = np.diff(np.concatenate(([0], dense.astype(np.int8), [0])))
    for surge, dive in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        # The surge window's last line brings the text, the first line of the last dense window ends it.
        low, high = max(0, first[surge] + window - 1), min(n, first[dive - 1] + 1)
        if low >= high:
            # A text of fewer lines than a window: its heaviest line stands for it.
            at = max(0, first[surge])
            low = at + int(np.argmax(weights[at : min(n, first[dive - 1] + window)]))
            high = low + 1
        keep[low:high] = True
    return keep


def extended(keep: np.ndarray, weights: np.ndarray, containers: np.ndarray, parts: np.ndarray, parents: list[int]) -> np.ndarray:
    """``keep`` with the text lines of its containers, of the smallest one around all of it and of those inside them.

    Then come the adjoining text lines, up to the next noise or link line.
    """
    text = weights > 0
    inside = np.zeros(len(parents), bool)
    common = -1
    for container in np.unique(containers[keep]).tolist():
        inside[container] = True
        # A container has a higher number than the one around it.
        while common >= 0 and container != common:
            container, common = (parents[container], common) if container > common else (container, parents[common])
        common = container
    if common >= 0:
        inside[common] = True
    # The page itself is no container.
    inside[0] = False
    for container, parent in enumerate(parents):
        inside[container] |= inside[parent]
    keep = keep | (text & inside[containers])
    run = np.cumsum(np.concatenate(([True], (np.diff(parts) != 0) | ~text[1:] | ~text[:-1])))
    return keep | (text & np.isin(run, run[keep & text]))


def extract(page: str) -> str:
    """The main text of one page; empty if there is none."""
    lines = page_lines(page)
    if not lines.texts:
        return ""
    marked, weights = np.array(lines.marked), np.array(lines.weights)
    keep = main_region(weights)
    if marked.any() and weights[keep & marked].sum() >= weights[keep & ~marked].sum():
        # Most of the text lies in what the page says is its article: that is its boundary, and short articles stay.
        keep = marked
    else:
        keep = extended(keep, weights, np.array(lines.containers), np.array(lines.parts), lines.parents) | marked
        if not keep.any():
            keep = weights > 0
    return "\n".join(t for t, k in zip(lines.texts, keep.tolist()) if k)


def main_texts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Every row of ``pages`` without its markup column, with ``text`` and ``n_chars`` (code points).

    A missing or empty page has an empty text; white space inside a block is one blank, blocks are
    joined by a line feed.  Columns named ``text`` or ``n_chars`` are replaced.  A map over the rows:
    repeated rows stay, an empty table stays empty.
    """
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    given = pages.select(*[col(c).alias(c) for c in others], whole_text(html_col).alias("text"))
    at = len(others)

    def read(batches):
        for b in batches:
            texts = [extract(p) for p in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(texts, pa.string())], names=b.schema.names)

    found = given.mapInArrow(read, T.StructType(given.schema.fields))
    return found.withColumn("n_chars", F.length("text").cast("long"))
