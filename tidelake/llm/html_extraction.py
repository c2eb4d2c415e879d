"""Main text of web pages as a maximum-scoring subsequence.

A page becomes a sequence of units: pieces of text and tags. A piece of text scores the weight of its kind (the block
that it stands in, and whether it is a link) for each word, a tag always scores below nought. The contiguous region
of the largest sum is the content; one scan finds it. The weights are logarithmic odds of standing inside the
labelled content, learnt from pages that label it themselves (exactly one <article> or <main> element); a kind that
was never seen gets the weight of the nearest kind that was. Within the region, menus, notices, adverts, forms,
comments and the like are left out by element and by the names in class, id and role, unless a name would take the article itself.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import small_batches

#: Labelled pages that training takes at most (those with the smallest hashes).
LABELLED_PAGES = 2000
#: Fixed names of HTML: elements without an end tag, whose content is not text, and that do not part blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that runs to the end of the page without an end tag, and that is skipped only up to one.
RAW, SKIPPED = frozenset("script style textarea".split()), frozenset("noscript template iframe title".split())
HEAD = frozenset("head html base basefont bgsound link meta".split())
MATH = frozenset("math semantics annotation mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd".split())
#: Elements that end an <svg> that was left open.
NOT_SVG = frozenset("article blockquote body br code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li main ol p pre section small span strong sub sup table ul".split())
INLINE = MATH | frozenset("svg a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Elements and names (in class, id, role) that are never main text.
ASIDE = frozenset("nav header footer aside form button select dialog menu svg".split())
NAMES = re.compile(
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|popup|modal|newsletter|subscri\w+|nav|navs|navbar|menu\w*|breadcrumbs?|sidebar\w*|side|aside|widget\w*|footer|header|masthead|related|recommend\w*|share|sharing|social|comments?|replies|reply|respond|disqus|search|login|signup|pagination|pager|toolbar|contentinfo|complementary|navigation)",
    re.I,
)
#: Parts of a name that only say what holds the thing, and parts that make the name say something of what is around it.
HOLDERS = re.compile(r"(?:\d+|bar|box|form|list|lists|items?|links?|posts?|articles?|stories|wrap|wrapper|container|area|section|block|inner|outer|buttons?|icons?|panel|slot|unit|message|msg|text|body|content|title|left|right|top|bottom|primary|secondary|main|thread)", re.I)
MODIFIERS = frozenset("with without has have no not is layout hide show open closed".split())
_OPEN, _STOP = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)"), re.compile(r">|=\s*([\"'])")
_CLOSE = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW | SKIPPED}
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_BLANK = re.compile(r"\s+")

def says_aside(name: str) -> bool:
    """Whether one token of class, id or role names an aside: as a whole, or by its last part but for holders, as in
    site-footer, comment-list and ad-slot-3; with-sidebar, layout-sidebar-right, side-effects and no-header do not."""
    parts = re.split(r"[-_]+", name.strip("-_"))
    while len(parts) > 1 and HOLDERS.fullmatch(parts[-1]):
        parts.pop()
    return bool(NAMES.fullmatch(parts[-1])) and MODIFIERS.isdisjoint(x.lower() for x in parts)


def named_aside(name: str, attributes: str, within: bool) -> bool:
    """Whether class, id or role make an element an aside. Ids of headings, and of sections within <article> or <main>, name
    what they are about."""
    if name in ("html", "body", "article", "main"):
        return False
    topic = name in ("h1", "h2", "h3", "h4", "h5", "h6") or (within and name == "section")
    return any(says_aside(x) for n, *v in _NAMED.findall(attributes) if not (topic and n.lower() == "id") for x in "".join(v).split())


def tokens(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it closes, name, attributes) of each tag, and with an empty name of what is skipped: comments,
    declarations, scripts and the like with their content. One pass: what was once sought in vain is not sought again,
    so that open quotes and open elements cost no more than others. A quote that nothing closes is a letter."""
    at, vain = 0, set()

    def tag_end(i: int) -> int:
        while stop := _STOP.search(page, i):
            i, quote = stop.end(), stop[1]
            if not quote:
                return i
            if quote not in vain:
                close = page.find(quote, i)
                if close < 0:
                    vain.add(quote)
                else:
                    i = close + 1
        return -1

    while (at := page.find("<", at)) >= 0 and ">" not in vain:
        start, found = at, _OPEN.match(page, at)
        at += 1
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, False, "", ""
        elif found:
            name, end = found[2].lower(), tag_end(found.end())
            if end < 0:  # from here on no tag ends outside of quotes: quotes are letters
                vain.update("\"'")
                end = tag_end(found.end())
            if end < 0:
                vain.add(">")
                continue
            at = end
            if found[1] or name not in _CLOSE:
                yield start, at, bool(found[1]), name, page[found.end() : end - 1]
                continue
            if name in RAW or (page[end - 2] != "/" and name not in vain):
                close = _CLOSE[name].search(page, end)
                if close:
                    at = close.end()
                elif name in RAW:
                    at = len(page)
                else:
                    vain.add(name)
            yield start, at, False, "", ""
        elif page[at : at + 1] in ("!", "?", "/"):
            end = page.find(">", at)
            if end < 0:
                return
            at = end + 1
            yield start, at, False, "", ""


class Open:
    """The open elements, with running counts of what is asked about them, so that depth costs nothing."""

    def __init__(self):
        self.stack: list[tuple[str, bool, tuple[int, int, int]]] = []  # name, whether it is an aside, and (place, words, labels) at its start
        self.asides: list[str] = []
        self.blocks: list[str] = []
        self.count: Counter[str] = Counter()
        self.words, self.labels = 0, 0  # of paragraphs, and <article> or <main>, so far
        self.named: dict[int, tuple[int, bool]] = {}

    def enter(self, name: str, aside: bool, place: int) -> None:
        self.stack.append((name, aside, (place, self.words, self.labels)))
        self.count[name] += 1
        if aside:
            self.asides.append(name)
        if name not in INLINE:
            self.blocks.append(name)

    def leave(self) -> str:
        name, aside, (place, words, labels) = self.stack.pop()
        self.count[name] -= 1
        if aside:
            self.asides.pop()
        if name not in INLINE:
            self.blocks.pop()
        if place >= 0:
            self.named[place] = self.words - words, labels == 0 < self.labels
        return name

    def top(self) -> str:
        return self.stack[-1][0] if self.stack else ""

    def kind(self) -> tuple[str, bool]:
        if self.asides:
            return f"aside {self.asides[0]}", True
        return f"text {self.blocks[-1] if self.blocks else 'body'}" + (" link" if self.count["a"] else ""), False


def units(page: str) -> list[tuple[str, str, bool, bool]]:
    """(kind, text, parts, aside): text is "" for a tag; parts: the tag parts blocks; aside: never main text.

    No name makes an aside of an element that holds the page's first <article> or <main>, or, on a page without these,
    more than half of the words of its paragraphs."""
    seen = Open()
    found = list(_units(page, frozenset(), seen))
    spared = frozenset(at for at, (words, holds) in seen.named.items() if holds or (not seen.labels and 2 * words > seen.words))
    return list(_units(page, spared, Open())) if spared else found


def _units(page: str, spared: frozenset[int], now: Open) -> Iterator[tuple[str, str, bool, bool]]:
    """units, with the elements at spared (places in the page) no asides by name. now ends with, for each element that is
    one, its paragraph words, and whether it holds the first <article> or <main>."""
    at, head = 0, False  # head: nothing yet that cannot stand in <head>, whose end tag may be absent

    def text(end: int) -> tuple[str, str, bool, bool]:
        kind, aside = now.kind()
        if now.count["p"]:
            now.words += len(page[at:end].split())
        return kind, page[at:end], False, aside

    for start, end, closes, name, attributes in tokens(page):
        head = head and not page[at:start].strip()
        if start > at and not head:
            yield text(start)
        at = end
        if not name:
            continue
        if name == "head":
            head = not closes
            continue
        head = head and bool(name in HEAD or closes)
        if head:
            continue
        if name in NOT_SVG and not closes and now.count["svg"] and not now.count["foreignobject"]:
            while now.leave() != "svg":
                pass
        aside, drawn = bool(now.asides), bool(now.count["svg"])
        if closes:
            if now.count[name]:
                while now.leave() != name:
                    pass
        elif name not in VOID and not attributes.endswith("/"):
            if name not in INLINE and not drawn:  # a new block ends what was left open inside a paragraph
                while now.stack and (now.top() == "p" or now.top() in INLINE):
                    now.leave()
            if name == "li" and now.top() == "li":
                now.leave()
            by_name = name not in ASIDE and start not in spared and named_aside(name, attributes, bool(now.count["article"] or now.count["main"]))
            aside = aside or name in ASIDE or by_name
            now.labels += name in ("article", "main")
            now.enter(name, name in ASIDE or by_name, start if by_name else -1)
        yield f"tag {name}", "", name not in INLINE and not drawn, aside
    if at < len(page) and (not head or page[at:].strip()):
        yield text(len(page))
    while now.stack:
        now.leave()


def count_kinds(page: str) -> tuple[Counter, Counter]:
    """Words and tags by kind, inside and outside the one <article> or <main> of a page; empty without such a label."""
    inside, outside, depth = Counter(), Counter(), 0
    name = next((n for n in ("article", "main") if len(re.findall(rf"<{n}[\s>]", page, re.I)) == 1), None)
    if name is None:
        return Counter(), Counter()
    for kind, text, _, aside in units(page):
        if kind == f"tag {name}":
            depth ^= 1
            continue
        (inside if depth and not aside else outside)[kind] += len(text.split()) if text else 1
    return inside, outside


def weights(inside: Counter, outside: Counter) -> dict[str, float]:
    """The weight of each kind: of a word within [-3, 3], of a tag within [-3, -0.05]."""
    found = {}
    for kind in inside | outside:
        odds = math.log((inside[kind] + 0.5) / (outside[kind] + 0.5))
        found[kind] = max(-3.0, min(3.0, odds)) if not kind.startswith("tag") else max(-3.0, min(-0.05, (odds - 3) / 6))
    return found


def weight_of(kind: str, known: dict[str, float]) -> float:
    if kind in known:
        return known[kind]
    if kind.startswith("tag"):
        return -0.5
    if kind.startswith("aside"):
        return -2.0
    return -1.0 if kind.endswith(" link") else 1.0


def best_region(scores: list[float]) -> tuple[int, int]:
    """The half-open bounds of the contiguous part of the largest sum, the first and longest of equals; (0, 0) if no
    part is above nought."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and region[1] and start == region[0]):
            best, region = total, (start, i + 1)
    return region


def extract(page: str | None, known: dict[str, float]) -> str:
    parts = units(page or "")
    # an aside is left out anyway: its words are worth nothing, so that it does not part what stands before and after
    number = lambda k, t: len(t.split()) if t else 1 if k.startswith("tag") else 0
    scores = [(-0.05 if k.startswith("tag") else 0.0) if aside else weight_of(k, known) * number(k, t) for k, t, _, aside in parts]
    start, end = best_region(scores)
    blocks, block = [], []
    for kind, text, new_block, aside in parts[start:end]:
        if new_block:
            blocks.append("".join(block))
            block = []
        elif text and not aside:
            block.append(text)
        elif kind == "tag br":
            block.append(" ")
    blocks.append("".join(block))
    clean = (_BLANK.sub(" ", html.unescape(b)).strip() for b in blocks)
    return "\n".join(b for b in clean if b)


def fit(pages: DataFrame, html_col: str = "html", most: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from at most `most` distinct labelled pages, those that hash smallest; a few hundred numbers. Hashes
    alone choose them: four times as many as are wanted lie below the first bound, however many tasks look."""
    page = F.col(html_col).cast("string")
    labelled = pages.select(page.alias("page"), F.xxhash64(page).alias("h")).where(F.lower("page").rlike("<(article|main)[\\s>]"))
    number = labelled.agg(F.approx_count_distinct("h")).first()[0]
    below = min(2**63 - 1, -(2**63) + 2**64 * 4 * most // max(1, number))
    hashes = [r.h for r in labelled.where(F.col("h") <= below).select("h").distinct().orderBy("h").limit(most).collect()]
    labelled = labelled.where(F.col("h") <= (hashes[-1] if hashes else -(2**63))).groupBy("h").agg(F.first("page").alias("page")).select("page")
    small_batches(pages.sparkSession)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch["page"]:
                i, o = count_kinds(page)
                inside += i
                outside += o
        keys = sorted(inside | outside)
        if keys:
            yield pd.DataFrame({"kind": keys, "i": [inside[k] for k in keys], "o": [outside[k] for k in keys]})

    rows = labelled.mapInPandas(counts, "kind string, i long, o long").groupBy("kind").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).collect()
    return weights(Counter({r.kind: r.i for r in rows}), Counter({r.kind: r.o for r in rows}))


def extract_text(pages: DataFrame, known: dict[str, float], html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with the main text of every whole page. Blocks are trimmed, white space inside is one space, character
    references are decoded, blocks are joined by a line break. Null and empty pages, and pages without a region above
    nought, give the empty text. An existing column `text_col` is replaced."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def main_text(found: pd.Series) -> pd.Series:
        return found.map(lambda p: extract(p, known))

    return pages.withColumn(text_col, main_text(F.coalesce(F.col(html_col).cast("string"), F.lit(""))))
