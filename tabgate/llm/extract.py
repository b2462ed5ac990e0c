"""The main text of web pages: flat text blocks, kept or dropped by a decision tree.

A page is cut into blocks at block-level tags. A block has the features of COLUMNS: its words and link density, those
of the blocks before and after it, and where it stands (in an article, in furniture of the page such as a menu or an
advert, a heading). A tree, grown from the labelled blocks of LABELLED below, decides on each block; the kept ones are
joined in page order.

Furniture is a graded feature: 1 by the element or by a class or id name whose head word is listed (`site-footer`), 0.5 by a
name that only holds such a word (`related-work`), 0 by names of layouts (`no-comments`, `with-sidebar`). A container that
holds what a page is about isn't furniture whatever it is called: the page's first article, or its title and half of
its words, or, for forms and mere hints, a third of its words.

Defined results: a null or empty page has an empty text; scripts, styles, comments and what is not shown are no text;
a tag that is never closed lasts to the end of its container, an unclosed script or comment to the end of the page;
repeated pages are extracted each; further columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgate.llm.tables import bounded_batches

COLUMNS = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "furniture", "heading")

#: Labelled blocks: the features in the order of COLUMNS (links: share of words that are link text), then 1 to keep.
LABELLED = """
8 0 0 0 120 0 1 0 1  1
4 0 0 0 1 0 1 0 1  1
12 0 6 1 60 0 1 0 1  1
1 0 0 0 1 0 1 0 1  1
90 0 8 0 40 0 1 0 0  1
45 0.05 90 0 1 0 1 0 0  1
1 0 45 0 30 0 1 0 0  1
2 0 1 0 1 0 1 0 0  1
30 0.1 2 0 0 0 1 0 0  1
150 0.02 30 0 9 0 1 0 0  1
3 0 8 0 70 0 1 0 0  1
7 0.2 70 0 12 0 1 0 0  1
1 0 3 0 12 0 1 0 0  1
12 0 1 0 9 0 1 0 0  1
300 0.01 12 0 0 0 1 0 0  1
5 0 40 0 40 0 1 0 1  1
2 0 9 0.9 5 0 1 0 0  1
18 0.4 60 0 60 0 1 0 0  1
25 0.6 60 0 60 0 1 0 0  1
11 0.2 4 0 1 0 1 0 0  1
8 0.25 4 0 2 0 1 0 0  1
10 0.3 1 0 1 0 1 0 0  1
9 0.5 12 0 14 0 1 0 0  1
5 0.4 3 0 200 0 1 0 0  1
6 0 18 0 18 0 1 0 1  1
5 0 8 0 5 0 1 0 0  1
5 0 5 0 90 0 1 0 0  1
10 0 30 0 30 0 1 0 1  1
12 0 12 0 12 0 1 0 0  1
13 0 12 0 250 0 1 0 0  1
3 0 12 0 3 0 1 0 1  1
3 0 3 0 20 0 1 0 0  1
7 0 3 1 7 0 1 0 1  1
6 0 20 0 300 0 1 0 1  1
20 0 7 0 0 0 1 0 0  1
2 0 2 0 0 0 1 0 0  1
2 0 11 0 2 0 1 0 1  1
1 0 1 0 1 0 1 0 0  1
1 0 15 0 1 0 1 0 1  1
50 0 5 0 5 0 1 0 0  1
400 0 400 0 400 0 1 0 0  1
35 0 1 1 20 1 1 0 0  1
4 0 9 1 9 1 1 0 0  1
30 0.3 0 0 0 0 1 0 0  1
2 0 0 0 0 0 1 0 0  1
5 1 10 0 3 1 1 0 0  0
2 1 30 0 30 0 1 0 0  0
2 1 5 1 3 1 1 0 0  0
3 1 4 0 2 1 1 0 0  0
4 1 60 0 5 1 1 0 0  0
1 1 2 1 0 0 1 0 0  0
6 1 80 0 0 0 1 0 0  0
1 1 0 0 1 1 0 1 0  0
2 1 1 1 2 1 0 1 0  0
3 1 2 1 9 0 0 1 0  0
9 0 3 1 8 0 0 1 0  0
40 0 8 0 8 0 0 1 0  0
120 0 8 0 0 0 0 1 0  0
12 0 200 0 0 0 0 1 0  0
6 0 0 0 12 0 0 1 1  0
10 0.3 0 0 60 0 0 1 1  0
15 0 90 0 60 0 1 1 0  0
60 0 90 0 60 0 1 1 0  0
4 0 60 0 30 0 1 1 1  0
200 0.1 30 0 12 0 1 1 0  0
1 0 30 0 12 0 1 1 0  0
8 0.5 30 0 12 0 1 1 0  0
80 0 6 0 50 0 0 0 0  1
35 0 80 0 60 0 0 0 0  1
22 0.1 35 0 40 0 0 0 0  1
60 0.2 3 1 25 0 0 0 0  1
14 0 60 0 35 0 0 0 0  1
5 0 60 0 40 0 0 0 0  1
1 0 50 0 45 0 0 0 0  1
9 0 3 1 80 0 0 0 1  1
6 0 2 0.5 45 0 0 0 1  1
4 0 40 0 70 0 0 0 1  1
28 0 60 0 4 1 0 0 0  1
40 0 1 0 4 1 0 0 0  1
90 0.05 50 0 3 1 0 0 0  1
60 0 2 0 1 1 0 0 0  1
25 0 4 0 0 0 0 0 0  1
150 0 0 0 0 0 0 0 0  1
70 0 3 1 2 1 0 0 0  1
3 0 2 1 4 1 0 0 0  0
5 0 0 0 3 1 0 0 0  0
2 1 3 1 4 1 0 0 0  0
4 0.8 2 1 60 0 0 0 0  0
6 0 4 1 2 1 0 0 1  0
10 0.9 60 0 12 0.9 0 0 0  0
30 0.8 9 0.9 20 0.9 0 0 0  0
8 0 60 0 0 0 0 0 0  0
6 0 9 0.5 5 0 0 0 0  0
7 0 5 0 6 0 0 0 0  0
3 0.6 7 0 3 1 0 0 0  0
2 0 0 0 1 1 0 0 0  0
60 0 30 0 60 0 1 0.5 0  1
25 0 2 0 60 0 1 0.5 0  1
120 0.05 2 0 0 0 1 0.5 0  1
2 0 60 0 40 0 1 0.5 1  1
4 0 9 0 12 0 1 0.5 1  1
15 0.1 40 0 30 0 1 0.5 0  1
6 0.8 60 0 4 0.9 1 0.5 0  0
3 1 2 1 3 1 1 0.5 0  0
9 0.7 3 0 0 0 1 0.5 0  0
80 0 6 0 50 0 0 0.5 0  1
30 0 60 0 30 0 0 0.5 0  1
45 0.1 2 0 3 1 0 0.5 0  1
5 0.6 60 0 4 1 0 0.5 0  0
4 0 3 1 6 0.5 0 0.5 0  0
8 0 3 1 5 1 0 0.5 0  0
30 0.8 4 1 9 1 0 0.5 0  0
"""

#: Elements of HTML by how they are read.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section"
    " select summary table tbody tfoot thead tr ul".split()
)
SPACE_TAGS = frozenset("br td th img input".split())
RAW_TAGS = frozenset("script style title textarea template noscript iframe svg math object canvas audio video noembed noframes xmp".split())
CONTAINERS = frozenset(
    "article aside blockquote body button center details dialog div dl fieldset figure footer form header label main menu nav ol"
    " search section select span table tbody td th tr ul li".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE_TAGS = frozenset("nav footer aside form header menu search select button dialog label".split())
#: Words of class and id names, and roles, that mark what isn't the article.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion cookie cookies consent"
    " gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login register sidebar side"
    " aside rail menu menubar nav navbar navigation navigations breadcrumb breadcrumbs pagination pager toolbar topbar footer foot"
    " colophon copyright legal header masthead comment comments commentlist reply replies respond discussion disqus share sharing"
    " social related recommended recommendations trending widget widgets search form contentinfo complementary skip hidden".split()
)
IN_ARTICLE = frozenset("header masthead".split())  # a title may stand in these
#: Words that tell what follows them is absent or a matter of layout; and words that say nothing at the end of a name.
LAYOUT_WORDS = frozenset("no not with without has have hide layout".split())
PLAIN_WORDS = frozenset(
    "section list area box wrap wrapper container content inner outer item items block bar left right top bottom main body text"
    " title link links row col column group panel".split()
)
#: Names of readers' comments; an article in one of these is a comment.
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond discussion disqus".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW_TAGS}


#: How a container is marked; all but FIRM may turn out to hold the page's text.
FIRM, FORM, NAME, HINT, ARTICLE = range(5)


def _mark(tag: str, attributes: str, in_article: bool) -> int | None:
    """How the element itself is marked as furniture, or None."""
    if tag == "form":
        mark = FORM
    else:
        mark = FIRM if tag in FURNITURE_TAGS and not (in_article and tag in IN_ARTICLE) else None
    if mark == FIRM or not attributes or tag in ("html", "body", "main"):
        return mark
    for name, *values in NAMED.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return FIRM
        if name in ("class", "id", "role"):
            for token in value.split():
                found = _name_mark(token, in_article)
                if found is not None:
                    mark = found if mark is None else min(mark, found)
    return mark


@lru_cache(maxsize=4096)
def _name_mark(token: str, in_article: bool) -> int | None:
    pieces = [p for p in re.split(r"[^a-z]+", token) if p]
    while len(pieces) > 1 and pieces[-1] in PLAIN_WORDS:
        pieces.pop()
    marks = [p in FURNITURE_WORDS and not (in_article and p in IN_ARTICLE) for p in pieces]
    if not any(marks) or LAYOUT_WORDS.intersection(pieces):
        return None
    if COMMENT_WORDS.intersection(pieces):
        return FIRM
    return NAME if marks[-1] else HINT


class Page:
    """Collects the blocks of one page: text, words, share of link words, in an article, marked container, heading."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple] = []
        self.open: list[tuple[str, bool, int]] = []  # tag, in an article, marked container
        self.n_open: Counter[str] = Counter()
        # Marked containers, and articles inside them: parent, mark, words, whether a title or the first article is in it.
        self.marked: list[list] = []
        self.parts: list[tuple[str, bool]] = []
        self.heading = ""
        self.link = self.seen_article = False
        self._read(source)
        self._close()

    def _where(self) -> tuple[bool, int]:
        return self.open[-1][1:] if self.open else (False, -1)

    def _close(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(p for p, _ in self.parts)).split())
            if text:
                words = len(text.split(" "))
                linked = len(" ".join(html.unescape(p) for p, link in self.parts if link).split())
                article, within = self._where()
                self.blocks.append((text, words, min(1.0, linked / words), article, within, bool(self.heading)))
                if within >= 0:
                    self.marked[within][2] += words
                    self.marked[within][3] |= self.heading == "h1"
            self.parts = []

    def _tag(self, closing: str, tag: str, attributes: str) -> None:
        if tag in BLOCK_TAGS:
            self._close()
            self.heading = tag if not closing and tag in HEADINGS else ""
        elif tag in SPACE_TAGS:
            self.parts.append((" ", False))
        if tag == "a":
            self.link = not closing and not attributes.rstrip().endswith("/")
        if tag not in CONTAINERS:
            return
        if closing:
            if self.n_open[tag]:  # what closes nothing isn't looked for
                at = len(self.open) - 1
                while self.open[at][0] != tag:
                    at -= 1
                self._leave(at)
        elif not attributes.rstrip().endswith("/"):
            if tag == "li" and self.open and self.open[-1][0] == "li":  # an item ends where the next begins
                self._leave(len(self.open) - 1)
            article, within = self._where()
            mark = _mark(tag, attributes, article)
            if mark is not None:
                self._close()
                within = self._enter(within, mark)
            elif tag in ("article", "main"):
                # What was left open before the first article doesn't hold it.
                if within >= 0 and not self.seen_article:
                    within = self._enter(within, ARTICLE)
                article = self.seen_article = True
            self.open.append((tag, article, within))
            self.n_open[tag] += 1

    def _enter(self, within: int, mark: int) -> int:
        self.marked.append([within, mark, 0, False, mark == ARTICLE])
        return len(self.marked) - 1

    def _leave(self, at: int) -> None:
        if self._where() != (self.open[at - 1][1:] if at else (False, -1)):
            self._close()
        for tag, *_ in self.open[at:]:
            self.n_open[tag] -= 1
        del self.open[at:]

    def _read(self, source: str) -> None:
        at = 0
        while True:
            found = TOKEN.search(source, at)
            text = source[at : found.start() if found else len(source)]
            if text:
                self.parts.append((text, self.link))
            if not found:
                return
            at = found.end()
            closing, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
            if not tag:
                continue
            tag = tag.lower()
            if tag in RAW_TAGS:
                if not closing and not attributes.rstrip().endswith("/"):
                    end = RAW_END[tag].search(source, at)
                    at = end.end() if end else len(source)
                continue
            self._tag(closing, tag, attributes)

    def _furniture(self) -> list[float]:
        """How far each marked container is furniture: by its own mark, if it isn't what holds the text, or by what it is in."""
        total = sum(b[1] for b in self.blocks)
        for within, _, words, title, article in reversed(self.marked):  # what is inside comes later in the list
            if within >= 0:
                outer = self.marked[within]
                outer[2] += words
                outer[3] |= title
                outer[4] |= article
        grades: list[float] = []
        for within, mark, words, title, article in self.marked:
            holds = article or title and 2 * words > total or mark in (FORM, HINT) and 3 * words > total
            own = 1.0 if mark == FIRM else 0.0 if holds else 0.5 if mark == HINT else 1.0
            grades.append(0.0 if mark == ARTICLE else max(own, grades[within] if within >= 0 else 0.0))
        return grades

    def features(self) -> np.ndarray:
        if not self.blocks:
            return np.zeros((0, len(COLUMNS)))
        own = np.array([[b[1], b[2]] for b in self.blocks], float)
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[1:], after[:-1] = own[:-1], own[1:]
        grades = [*self._furniture(), 0.0]  # the last stands for no container
        place = np.array([(b[3], grades[b[4]], b[5]) for b in self.blocks], float)
        return np.column_stack([own, before, after, place])


# ---- the tree ----


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """(column, threshold, tree up to it, tree above it), or (share of 1,): splits that lower the Gini impurity most."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for column in range(x.shape[1]):
        values = np.unique(x[:, column])
        for threshold in (values[1:] + values[:-1]) / 2:
            low = x[:, column] <= threshold
            impurity = sum(s.sum() * p * (1 - p) for s in (low, ~low) for p in [y[s].mean()])
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, column, float(threshold), low)
    if best is None or best[0] > len(y) * share * (1 - share) - 1e-9:
        return (share,)
    _, column, threshold, low = best
    return (column, threshold, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def judge(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0] >= 0.5)
    column, threshold, low, high = tree
    below = x[:, column] <= threshold
    out = np.empty(len(x), bool)
    out[below] = judge(low, x[below])
    out[~below] = judge(high, x[~below])
    return out


@lru_cache(maxsize=1)
def default_tree() -> tuple:
    table = np.array([line.split() for line in LABELLED.split("\n") if line.strip()], float)
    return grow(table[:, :-1], table[:, -1])


def main_text(source: str | None, tree: tuple | None = None) -> str:
    page = Page(source or "")
    kept = judge(tree or default_tree(), page.features())
    return "\n".join(b[0] for b, k in zip(page.blocks, kept.tolist()) if k)


def _extract_rows(batches: Iterator[pa.RecordBatch], tree: tuple) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = (main_text(h.as_py(), tree) for h in batch["html"])
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, html_column: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html_column).alias("html"))
    tree = default_tree()
    texts = rows.mapInArrow(lambda batches: _extract_rows(batches, tree), "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
