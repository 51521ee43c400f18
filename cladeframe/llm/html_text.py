"""Main text of HTML pages: flat text blocks classified by a decision tree (operator 2)."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm._common import in_slices

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*+)(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
#: Elements whose content no reader sees, up to their end tag.
_RAW = frozenset("script style noscript template svg iframe textarea title select annotation annotation-xml".split())
#: Elements that end a block of text; all others stand inside one.
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("article aside blockquote body button center details dialog div dl fieldset figure footer form head header hgroup html main menu nav ol section table td th tr ul".split())
_FRAME = frozenset("aside button dialog fieldset footer form head header menu nav".split())
_MAIN = frozenset(("article", "main"))
#: Nouns in class, id or role that hint at something else than the text of the article.
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adbox banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login share sharing social comment comments reply replies respond disqus discussion related recommended recommendations pagination pager widget widgets search copyright legal disclaimer complementary contentinfo toolbar tags skip".split()
)
_HEADS = frozenset("header masthead topbar".split())
#: Words after such a noun that only say that it is a box, and words before it that say it is not one.
_BOXES = frozenset("area bar block body bottom box col column container content group holder inner item items left list main module outer panel right row section slot text top unit wrap wrapper".split())
_STATES = frozenset("has is no not with without".split())


def _hint(attributes: str, in_article: bool) -> bool:
    """Whether a class, id or role names what is no article text: the last noun of a name counts, its modifiers don't."""
    for _, value in _ATTRIBUTE.findall(attributes):
        for name in value.strip("\"'").split():
            words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
            while len(words) > 1 and words[-1] in _BOXES:
                words.pop()
            if words and words[0] not in _STATES and (words[-1] in _HINTS or words[-1] in _HEADS and not in_article):
                return True
    return False


class Box:
    """An element that may hold blocks: what it is, what it is named like, and the words in it."""

    __slots__ = ("anchor", "article", "frame", "framed", "hint", "inside", "parent", "tag", "words")

    def __init__(self, parent: int, tag: str, hint: bool, inside: bool = False, framed: bool = False):
        """inside: in an article; framed: in a frame that is no form. Both hold for the box itself too."""
        self.parent, self.tag, self.hint = parent, tag, hint
        self.words, self.article, self.frame, self.anchor = 0, tag in _MAIN, tag in _FRAME, False
        self.inside, self.framed = inside or self.article, framed or self.frame and tag != "form"


class Block:
    __slots__ = ("box", "linked", "tag", "text", "words")

    def __init__(self, text: str, words: int, linked: int, box: int, tag: str):
        self.text, self.words, self.linked, self.box, self.tag = text, words, linked, box, tag

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def parse(page: str | None) -> tuple[list[Block], list[Box]]:
    """The text blocks of a page in order, character references decoded, white space as one space, trimmed; and the boxes they stand in."""
    page = page or ""
    out: list[Block] = []
    boxes = [Box(-1, "", False)]
    stack = [0]
    parts: list[tuple[str, bool]] = []
    leaf, tag_of_block, link, at = 0, "", 0, 0
    anchors: dict[str, int] = {}
    open_: Counter = Counter()

    def close() -> None:
        nonlocal parts
        if parts:
            words = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            if words:
                linked = sum(len(html.unescape(p).split()) for p, inside in parts if inside)
                out.append(Block(words, words.count(" ") + 1, linked, leaf, tag_of_block))
            parts = []

    def opened(name: str, attributes: str) -> int:
        above = boxes[stack[-1]]
        boxes.append(Box(stack[-1], name, bool(attributes) and name not in ("html", "body") and _hint(attributes, above.inside), above.inside, above.framed))
        return len(boxes) - 1

    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            parts.append((text, link > 0))
        if not m:
            break
        at = m.end()
        ending, name = m[1] or m[4], m[2] or m[5]
        if not name:
            continue
        name, attributes = name.lower(), m[3] or m[6] or ""
        if name in _RAW and not ending:
            if name not in ("svg", "select") or not attributes.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "a":
            link = max(0, link - 1) if ending else 1
            continue
        if name == "br":
            parts.append((" ", False))
            continue
        if name not in _BLOCK:
            continue
        close()
        tag_of_block = "" if ending else name
        if name in _CONTAINER:
            if ending:
                while open_[name]:
                    closed = boxes[stack.pop()].tag
                    open_[closed] -= 1
                    if closed == name:
                        break
            elif not attributes.endswith("/"):
                stack.append(opened(name, attributes))
                open_[name] += 1
        leaf = stack[-1]
        if not ending and name not in _CONTAINER and attributes.strip():
            leaf = opened(name, attributes)
        # The first main, else the first article or h1 outside of frames, stands where the article begins.
        kind = "main" if name == "main" else "text"
        if not ending and (name in _MAIN or name == "h1") and kind not in anchors and not boxes[leaf].framed:
            anchors[kind] = leaf
    close()
    for b in out:
        boxes[b.box].words += b.words
    for box in reversed(boxes[1:]):
        boxes[box.parent].words += box.words
    k = anchors.get("main", anchors.get("text", 0))
    while k > 0:
        boxes[k].anchor, k = True, boxes[k].parent
    return out, boxes


def blocks(page: str | None) -> list[Block]:
    return parse(page)[0]


#: Names of the features, in the order of a row.
FEATURES = ("words", "words_before", "words_after", "density", "density_before", "density_after", "heading", "article", "article_share", "frame", "hint")


def features(page: str | None) -> list[tuple[float, ...]]:
    """Flat features of each block of a page: its words and link density, those of its neighbours, and where it stands.

    article tells whether the innermost semantic element around a block is an article or main, article_share which
    part of the page's words stand in such elements. frame and hint are 0 outside of frames (navigation, header,
    footer, sidebar, form) and of hinted names, else the larger the less of the page's words the element holds, so
    what wraps a whole page weighs little; a form or a name around the place where the article begins weighs nothing.
    """
    return _features(*parse(page))


def _features(found: list[Block], boxes: list[Box]) -> list[tuple[float, ...]]:
    every = max(1, boxes[0].words)
    at: list[tuple[float, float, float]] = [(0.0, 0.0, 0.0)]
    for box in boxes[1:]:
        article, frame, hint = at[box.parent]
        less = 1 - box.words / every
        if box.hint and not box.anchor:
            hint = max(hint, less, 1e-3)
        if box.article:
            article, frame = 1.0, 0.0
        elif box.frame and not (box.tag == "form" and box.anchor) and not (box.tag in ("header", "hgroup") and article):
            article, frame = 0.0, max(less, 1e-3)
        at.append((article, frame, hint))
    share = sum(b.words for b in found if at[b.box][0]) / every
    edge = Block("", 0, 0, 0, "")
    out = []
    for k, b in enumerate(found):
        before, after = found[k - 1] if k else edge, found[k + 1] if k + 1 < len(found) else edge
        article, frame, hint = at[b.box]
        out.append((b.words, before.words, after.words, b.density, before.density, after.density, float(b.tag[:1] == "h" and b.tag[1:].isdigit()), article, share, frame, hint))
    return out


# ---------------------------------------------------------------- the labelled table

PAGES, SEED = 500, 20250317
_NAMED = {
    "menu": ("nav", "menu", "main-nav", "navbar", "topmenu navigation"), "head": ("header", "masthead", "site-header"), "foot": ("footer", "page-footer", "copyright"),
    "side": ("sidebar", "widget", "related-posts sidebar", "sidebar-content"), "ad": ("ad", "ads", "advert", "content-promo", "banner", "sponsored", "body-banner", "advertorial"),
    "notice": ("cookie-notice", "site-notice", "alert", "gdpr"), "share": ("article-share", "social", "post-tags", "entry-newsletter"), "comments": ("comments", "comment-list", "disqus"),
    "text": ("content", "entry", "post-body", "story", "article-body"), "wrap": ("wrapper", "page", "legal", "has-sidebar", "search-results", "notice"),
}
_ELEMENT = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside"}


def labelled_page(draw: random.Random) -> str:
    """A page of the labelled table: text that begins with @ belongs to the article.

    Pages differ in whether their elements are semantic, named, or neither, so that in a part of them nothing but
    word counts and link densities tells text from the rest.
    """
    semantic, named = draw.random() < 0.5, draw.random() < 0.5
    words = lambda n: " ".join(draw.choice(("of", "stone", "river", "later", "Town.", "and", "people")) for _ in range(n))
    some = lambda: draw.choice((draw.randint(1, 4), draw.randint(5, 15), draw.randint(12, 40), draw.randint(30, 200)))
    links = lambda n: "".join(f"<li><a href=x>{words(draw.randint(1, 4))}</a></li>" for _ in range(n))

    def box(kind: str, inside: str) -> str:
        tag = _ELEMENT.get(kind, "div") if semantic else "div"
        name = draw.choice(_NAMED[kind]) if named else draw.choice(("", "x1", "c-7f3a", "kq"))
        return f'<{tag} class="{name}">{inside}</{tag}>' if name else f"<{tag}>{inside}</{tag}>"

    known = semantic or named
    lead = lambda: f"<h1>@{words(draw.randint(2, 9))}</h1>" if draw.random() < 0.7 else ""
    text = [f"<p>@{words(some())}</p>" for _ in range(draw.choice((1, 2, draw.randint(1, 12), draw.randint(3, 12))))]
    if not known:  # without any structure only a text of some size can be told
        text = [f"<p>@{words(draw.randint(25, 160))}</p>" for _ in range(draw.randint(2, 6))]
        if draw.random() < 0.5:
            text.insert(draw.randint(1, len(text) - 1), f"<p>@{words(draw.randint(1, 9))}</p>")
    if draw.random() < 0.4:
        text.insert(draw.randint(0, len(text)), f"<p>@{words(draw.randint(8, 30))} <a href=x>{words(2)}</a> {words(draw.randint(4, 20))}</p>")
    if known and draw.random() < 0.3:
        text.insert(draw.randint(0, len(text)), "<ul>" + "".join(f"<li>@{words(draw.randint(1, 8))}</li>" for _ in range(draw.randint(2, 5))) + "</ul>")
    if semantic and draw.random() < 0.2:
        text.insert(draw.randint(0, len(text)), f"<p>@<a href=x>{words(draw.randint(1, 9))}</a></p>")
    for kind, chance in (("ad", 0.4), ("share", 0.3), ("notice", 0.1)):
        if named and draw.random() < chance:
            text.insert(draw.randint(0, len(text)), box(kind, words(draw.randint(1, 25)) if kind != "share" else draw.choice((words(draw.randint(1, 9)), f"<ul>{links(3)}</ul>"))))
    if semantic and draw.random() < 0.25:
        text.insert(draw.randint(1, len(text)), f"<form>{words(draw.randint(2, 12))} <button>{words(1)}</button></form>")
    if draw.random() < 0.25:
        text.append(f"<ul>{links(draw.randint(3, 6))}</ul>")
    body = lead() + "".join(text)
    if semantic and draw.random() < 0.2:
        body = f"<header>{lead()}</header>" + "".join(text)
    talk = "".join(f"<p>{words(some())}</p>" for _ in range(draw.randint(1, 8)))
    talk = box("comments", draw.choice((talk, f"<article>{talk}</article>" if semantic else talk))) if named and draw.random() < 0.35 else ""
    if semantic:
        tag = draw.choice(("article", "main"))
        main = f"<{tag}>{body}{talk}</{tag}>" if draw.random() < 0.5 else f"<{tag}>{body}</{tag}>{talk}"
    else:
        main = (box("text", body) if draw.random() < 0.7 else body) + talk
    before = [box("head", words(draw.randint(1, 12))), box("menu", f"<ul>{links(draw.randint(3, 8))}</ul>")]
    if known and draw.random() < 0.6:
        before.append(box("ad", words(draw.randint(2, 40))))
    if known and draw.random() < 0.3:
        before.append(box("notice", words(draw.randint(5, 30))))
    if semantic and draw.random() < 0.3:
        before.append(f"<div>{words(draw.randint(2, 60))}</div>")
    after = [box("side", f"<p>{words(draw.randint(2, 60) if known else draw.randint(1, 6))}</p><ul>{links(3)}</ul>")] if draw.random() < 0.4 else []
    after.append(box("foot", words(draw.randint(1, 25) if known else draw.randint(1, 8)) + (f" <a href=x>{words(2)}</a>" if draw.random() < 0.5 else "")))
    rare = draw.choice((0.9, 0.9, 0.5, 0.1))
    keep, after = [x for x in before if draw.random() < rare], [x for x in after if draw.random() < rare]
    whole = "".join(keep) + main + "".join(after)
    if draw.random() < 0.25:
        whole = f"<form action=x>{whole}</form>" if draw.random() < 0.4 else f'<div class="{draw.choice(_NAMED["wrap"])}">{whole}</div>'
    elif semantic and draw.random() < 0.2:
        whole = "".join(keep) + f'<div class="{draw.choice(_NAMED["wrap"])}">{main}</div>' + "".join(after)
    return f"<html><body>{whole}</body></html>"


def labelled_rows(pages: int = PAGES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled table's blocks; the table has so many pages, whatever is extracted with it."""
    draw, rows, marks = random.Random(seed), [], []
    for _ in range(pages):
        page = labelled_page(draw)
        rows += features(page)
        marks += [b.text.startswith("@") for b in blocks(page)]
    return np.array(rows, np.float64), np.array(marks, np.int64)


# ---------------------------------------------------------------- the tree

DEPTH, LEAF = 12, 3


def best_split(x: np.ndarray, y: np.ndarray, leaf: int = LEAF) -> tuple[int, float] | None:
    """The feature and threshold of the least Gini impurity with so many rows on each side; the first of equals."""
    n, found = len(y), None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        value, ones = x[order, f], np.cumsum(y[order])
        k = np.arange(1, n)
        ok = (value[1:] > value[:-1]) & (k >= leaf) & (n - k >= leaf)
        if not ok.any():
            continue
        left, right = ones[:-1], ones[-1] - ones[:-1]
        impurity = np.where(ok, left * (k - left) / k + right * (n - k - right) / (n - k), np.inf)
        at = int(np.argmin(impurity))
        if found is None or impurity[at] < found[0] - 1e-9:
            found = (impurity[at], f, (value[at] + value[at + 1]) / 2)
    return found and (found[1], float(found[2]))


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH):
    """A decision tree: (feature, threshold, below, above), or the label of a leaf."""
    ones = int(y.sum())
    split = best_split(x, y) if depth and 0 < ones < len(y) else None
    if split is None:
        return int(2 * ones >= len(y))
    f, cut = split
    low = x[:, f] <= cut
    below, above = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return below if below == above and isinstance(below, int) else (f, cut, below, above)


@lru_cache(maxsize=1)
def tree():
    return grow(*labelled_rows())


def is_main(row: tuple[float, ...], node=None) -> bool:
    node = tree() if node is None else node
    while not isinstance(node, int):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return bool(node)


def main_text(page: str | None, node=None) -> str:
    found, boxes = parse(page)
    return "\n".join(b.text for b, row in zip(found, _features(found, boxes), strict=True) if is_main(row, node))


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    Needs page_id, url and html; other columns are ignored. A page is cut into flat blocks at block-level tags. Word
    count and link density of a block and of its neighbours, headings, and how much of the page the semantic or
    hinted element around it holds go into a decision tree. It is trained on the driver with the small labelled
    table that labelled_page makes (PAGES pages, the same on each run) and sent to the tasks, some hundred numbers.
    Blocks judged main are joined in page order. Scripts, styles, templates, frames, drawings, text fields and
    what stands in noscript are no blocks; forms, formulas, objects and media fallbacks are blocks like others.
    Unclosed tags and comments end with the page. One pass, no shuffle. A null or blank page has an empty text;
    repeated rows repeat; a page of any length is one value of a task.
    """
    node = tree()

    def run(batches):
        for batch in batches:
            texts = [main_text(t.as_py(), node) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(in_slices(run), "page_id long, url string, text string, n_chars long")
