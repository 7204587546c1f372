"""Main text of web pages as the maximum-scoring run of tokens.

A page is read as a row of tags and runs of words. A run scores its number of words
times the weight of where it stands (nearest block element, in a link or not), a tag
scores its own weight, never above zero; one linear scan finds the contiguous
stretch with the highest sum. If nearly all its words lie in an <article> or <main>, it is
widened to the innermost such element, so that a long table, list or gallery does
not end the article. Blocks of the stretch are the text, without elements
that are no part of an article wherever they stand: menus, headers, footers, sidebars,
notices, adverts, forms, reader comments, scripts and styles, known by element
name, role, or names in class and id; a <header> in an article is the article's own, and so is what is named
for a search there. A name says so if its last word does, or its first
one and the last one is a plain part (`ad-slot`); names that speak of a page as a
whole (`has-sidebar`, `modal-open`, `ad-free`) and `...-widget` of page builders do not, and words that
also mean other things (`market-share`) only beside plain parts or words of the same kind.

Weights are log odds of being content, counted over all labelled pages: those with
one <article> or <main> that has words, whose inside is content; one inside the other
is one region, one in reader comments is a comment. A place that no labelled page has gets the default weights. The elements themselves are no feature.

Inside a block white space is one space; a <br> is white space. Blocks are joined by
two line feeds. Defined cases: NULL, empty or wordless html has the text ''; unclosed
elements end with their parent, a paragraph also at the next block; an
unclosed menu or the like ends where an article starts; a page without a positive
stretch has the text ''; long pages are read whole; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>", re.S)
NAME = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
# Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe title".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table
tbody td tfoot th thead tr ul""".split())
CONTENT = frozenset(("article", "main"))
# Elements, and words of class, id and role, that mark what is no part of an article.
ASIDE = frozenset("aside button dialog footer form head header menu nav noscript object search select svg template".split())
OWN = frozenset(("header", "search"))  # of an article, inside one
ASIDE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
complementary contentinfo cookie cookies consent disqus footer gdpr login masthead menu modal nav navbar navigation
newsletter notice notification outbrain pagination pager popup promo promoted promotion recommended related replies respond
search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe taboola toolbar topbar
widget""".split())
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
# Words of a name that say so only if its other words are plain parts, of this kind or of a site.
AMBIGUOUS = frozenset("banner menu modal notice notification promotion related respond search share social toolbar".split())
SITE_WORDS = frozenset("btn fixed global mobile my nav page primary secondary site sticky user web wp".split())
WHOLE_WORDS = frozenset(("widget",))  # only if they are all of a name
OF_PAGE_FIRST = frozenset("has is no not with without hide show".split())
OF_PAGE_LAST = frozenset("active closed collapsed disabled enabled fixed free hidden off on open opened shown visible".split())
PLAIN_PARTS = frozenset("""area article articles bar block body bottom box button buttons card container content count form group
holder icon icons inner item items left link links list outer panel post posts region right row section slot stories story
text thread title top unit wrap wrapper zone""".split())

WORD_WEIGHT, LINK_WEIGHT, TAG_WEIGHT = 1.0, -0.5, -0.5
ASIDE_WEIGHT = -0.1
"""Of a word or tag that is left out in any case, so an article may have a long notice in it."""
INSIDE = 0.9
"""Least share of a stretch's words in an element that the stretch is widened to."""
SMOOTHING = 1.0
MOST = 4.0
LEAST_TAG = -0.1


def is_named(attributes: str, words: frozenset) -> bool:
    """Whether a name in class, id or role is one of what the words mean."""
    for m in NAME.finditer(attributes) if "=" in attributes else ():
        for one in next(g for g in m.groups() if g is not None).split():
            parts = [p.lower() for p in PART.findall(one) if not p.isdigit()]
            if not parts or len(parts) > 1 and (parts[0] in OF_PAGE_FIRST or parts[-1] in OF_PAGE_LAST):
                continue
            known = [p in words and (p not in WHOLE_WORDS or len(parts) == 1) for p in parts]
            if all(p in AMBIGUOUS for p, k in zip(parts, known) if k) and not all(
                    k or p in PLAIN_PARTS or p in SITE_WORDS for p, k in zip(parts, known)):
                continue
            if known[-1] or any(known) and parts[-1] in PLAIN_PARTS:
                return True
    return False


def is_aside(name: str, attributes: str, in_article: bool = False) -> bool:
    """Whether an element is known to be no part of an article."""
    if name in ASIDE:
        return not (in_article and name in OWN)
    if name in ("html", "body"):
        return False
    return is_named(attributes, COMMENT_WORDS if name in CONTENT else ASIDE_WORDS - OWN if in_article else ASIDE_WORDS)


class Open:
    """The open elements, with the places of blocks, asides and each name among them, so that
    no step looks through them all."""

    def __init__(self):
        self.names: list[str] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.asides: list[int] = []
        self.comments: list[int] = []
        self.articles = 0

    def push(self, name: str, aside: bool, comment: bool) -> None:
        k = len(self.names)
        self.names.append(name)
        self.at.setdefault(name, []).append(k)
        for kind, here in ((self.blocks, name in BLOCK), (self.asides, aside), (self.comments, comment)):
            if here:
                kind.append(k)
        self.articles += name in CONTENT

    def pop(self, to: int) -> None:
        while len(self.names) > to:
            name = self.names.pop()
            self.at[name].pop()
            for kind in (self.blocks, self.asides, self.comments):
                if kind and kind[-1] == len(self.names):
                    kind.pop()
            self.articles -= name in CONTENT

    def place(self) -> str:
        near = self.names[self.blocks[-1]] if self.blocks else "body"
        return near + (" a" if self.at.get("a") else "")


def tokens(page: str) -> Iterator[tuple[str, str, bool, int]]:
    """(place or tag, text, aside, content): runs of text with the place they stand in,
    and tags with an empty text. `content` is how many <article> and <main> are open."""
    o, endless = Open(), set()
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            yield o.place(), page[at:stop], bool(o.asides), o.articles
        if not m:
            return
        at = m.end()
        if m.group(1) is None:
            continue
        name = m.group(1).lower()
        if page[m.start() + 1] == "/":
            if o.at.get(name):
                o.pop(o.at[name][-1])
            yield "/" + name, "", bool(o.asides), o.articles
            continue
        if name in RAW:
            close = None if name in endless else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if close is None:
                endless.add(name)
            at = close.end() if close else end
            yield name, "", True, o.articles
            continue
        if name in CONTENT and o.asides and not o.comments:
            o.pop(o.asides[0])
        if name in BLOCK and o.blocks:
            last = o.names[o.blocks[-1]]
            if last == "p" or last == name and name in ("li", "dt", "dd", "td", "th", "tr"):
                o.pop(o.blocks[-1])
        yield name, "", bool(o.asides), o.articles
        if name not in VOID and not m.group(2).endswith("/"):
            aside = is_aside(name, m.group(2), o.articles > 0)
            o.push(name, aside, aside and is_named(m.group(2), COMMENT_WORDS))


def counted(page: str) -> Counter | None:
    """(feature, is content) → words or tags, of a labelled page."""
    found: Counter = Counter()
    regions = inside = 0
    for name, text, aside, content in tokens(page):
        if text:
            n = len(html.unescape(text).split())
            if n and not aside:
                found["w " + name, content > 0] += n
                inside += n if content else 0
        else:
            regions += name in CONTENT and not content and not aside
            if name.lstrip("/") not in CONTENT and not aside:
                found["t " + name, content > 0] += 1
    return found if regions == 1 and inside else None


def train(pages: DataFrame, column: str = "html") -> dict[str, float]:
    """Feature → weight, over all labelled pages. Features are names of HTML elements,
    a few hundred at most; other names share one."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch["_html"]:
                for (name, content), n in ((counted(page) if page else None) or {}).items():
                    total[name if name.split()[1].lstrip("/") in BLOCK | VOID | INLINE else name[0] + " other", content] += n
        yield pd.DataFrame([(a, b, n) for (a, b), n in total.items()], columns=["feature", "content", "n"])

    rows = (pages.select(pages[column].alias("_html")).mapInPandas(work, "feature string, content boolean, n long")
            .groupBy("feature").agg(F.sum(F.when(F.col("content"), F.col("n")).otherwise(0)), F.sum("n")).collect())
    out = {}
    for feature, inside, n in rows:
        odds = float(np.clip(np.log((inside + SMOOTHING) / (n - inside + SMOOTHING)), -MOST, MOST))
        out[feature] = odds if feature[0] == "w" else min(odds, LEAST_TAG)
    return out


# Elements inside of blocks.
INLINE = frozenset("""a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong
sub sup time tt u var audio video picture canvas button input script style noscript template iframe svg math title select
textarea object""".split())


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Where the contiguous stretch of highest sum starts and ends, by one scan; of equal
    ones the first; (0, 0) if none is above zero."""
    best = total = 0.0
    start, stretch = 0, (0, 0)
    for k, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, stretch = total, (start, k + 1)
    return stretch


def widened(stretch: tuple[int, int], regions: list[tuple[int, int]], words: list[int]) -> tuple[int, int]:
    """The innermost region with nearly all words of the stretch, else the stretch."""
    before = [0, *itertools.accumulate(words)]
    first, last = stretch
    held = before[last] - before[first]
    fit = [(b - a, a, b) for a, b in regions if held and before[max(first, min(b, last))] - before[min(max(first, a), last)] >= INSIDE * held]
    return min(fit)[1:] if fit else stretch


def main_text(page: str, weights: dict[str, float]) -> str:
    """Blocks of the best stretch, joined by two line feeds."""
    runs: list[tuple[str, bool, bool]] = []  # (text or tag, is text, aside)
    scores: list[float] = []
    words: list[int] = []
    regions: list[tuple[int, int]] = []
    opened: list[int] = []
    for name, text, aside, content in tokens(page):
        while len(opened) > content:
            regions.append((opened.pop(), len(runs)))
        while len(opened) < content:
            opened.append(len(runs))
        n = 0
        if text:
            text = html.unescape(text)
            n = len(text.split())
            plain = LINK_WEIGHT if name.endswith(" a") else WORD_WEIGHT
            score = n * (ASIDE_WEIGHT if aside else weights.get("w " + name, plain))
        else:
            score = ASIDE_WEIGHT if aside else weights.get("t " + name, TAG_WEIGHT)
        runs.append((text or name, bool(text), aside))
        scores.append(score)
        words.append(0 if aside else n)
    regions += [(a, len(runs)) for a in opened]
    first, last = widened(best_stretch(scores), regions, words)  # a block that the stretch cuts is taken whole
    while 0 < first < last and (runs[first - 1][1] or runs[first - 1][0].lstrip("/") not in BLOCK):
        first -= 1
    while first < last < len(runs) and (runs[last][1] or runs[last][0].lstrip("/") not in BLOCK):
        last += 1
    blocks: list[list[str]] = [[]]
    for text, is_text, aside in runs[first:last]:
        if is_text:
            if not aside:
                blocks[-1].append(text)
        elif text.lstrip("/") in BLOCK:
            blocks.append([])
        elif text == "br":
            blocks[-1].append(" ")
    spelled = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(b for b in spelled if b)


def extract(pages: DataFrame, column: str = "html", keep: list[str] | None = None,
            weights: dict[str, float] | None = None) -> DataFrame:
    """The kept columns, `text` and `n_chars`. Without weights, they are trained on the
    labelled ones among these pages."""
    weights = train(pages, column) if weights is None else weights
    source = pages.select(*[pages[c] for c in keep or ["page_id", "url"]], pages[column].alias("_html"))
    names = source.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(p, weights) if p else "" for p in batch["_html"]]
            yield batch[names].assign(text=text, n_chars=[len(t) for t in text])
    return source.mapInPandas(work, f"{schema}, text string, n_chars long")
