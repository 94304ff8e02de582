"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block of the page. Elements that are never part
of an article (scripts, forms, navigation, and what tags, roles or class names mark as menu,
advert, notice, sidebar, reader comments and so on) leave a gap of empty lines. A class or id
marks an element if one whole name of it is such a word, alone or beside words that only say
where or what kind of box it is ("comments", "site-nav", "share-buttons"; not "has-sidebar",
"comments-open" or "ad-free").

A line's weight is its text outside links; sums of weights over sliding windows of `WINDOW` lines
rise at a surge point where text begins and are zero at the dive point after it. Text between
the two is kept: where the page says which part is its article, the regions of that part, and blocks
that hold text of their own apart from these, so that a list of links inside it goes (WINDOW lines or
more of nothing but links; fewer are part of the text around them); elsewhere all from the first surge
to the last dive of the main container. That is
found by weight: from the page on, step by step, the container that holds `MAJOR` of what is
around it in several blocks, so that a short box beside the article is left out even where no
name tells what it is. Gaps of elements that were dropped inside that container are no boundary
there. Without any container but the page itself, only a list of links parts its regions.

A form around the page (one that holds an article or most of the text) is no part that is dropped;
its controls are.

Defined results: null or empty html gives an empty text; broken markup never fails (an element
that isn't closed ends with its parent or the page); extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
#: A surge is a window of at least so many characters, or of the page's largest if that is less.
SURGE = 60
#: A region is part of the main container if it has this share of the largest region's text.
SHARE = 0.3
#: A container is descended into if it has this share of the text around it.
MAJOR = 0.6

#: Names of the HTML standard, and of common markup.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead title tr ul".split())
DROPPED = frozenset("aside audio button canvas datalist dialog embed fieldset footer form frame frameset head iframe input map menu nav noembed noframes noscript object optgroup option output progress search select svg template video".split())
RAW = frozenset("script style textarea title xmp".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
ARTICLE = frozenset(["article", "main"])
CONTAINERS = frozenset(["center", "div"])
HINTS = frozenset("ad ads adsbygoogle adv advert advertisement advertising adverts adsense alert banner breadcrumb breadcrumbs byline captcha comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices outbrain pager pagination paywall popup popover promo promotion recommended related reply replies respond responses share sharing sidebar signup social sponsor sponsored subscribe subscription taboola tagcloud tags toolbar topbar topnav widget".split())
#: Words beside those, which say where a box is and what kind of box.
BEFORE = frozenset("article block blog entry global item main page post primary secondary section site story top bottom the wp".split())
AFTER = frozenset("area articles bar block body bottom box btn button buttons container content count form group head heading icons inner item items label left link links list main module nav news panel parent posts primary products reading region right row secondary section slot stories text thread title top unit widget wide wrap wrapper zone".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
READERS, HEADER = frozenset(["comment", "comments", "reply", "replies"]), frozenset(["header"])
SCRIPTS = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: A block: text, characters outside links, inside the article, innermost container.
Line = tuple[str, int, bool, int]


def hinted(names: str, words: frozenset[str] = HINTS) -> bool:
    """Whether a whole one of the names is such a word, beside others that say where it stands only."""
    for x in names.split():
        parts = [p.lower() for p in PART.findall(x)]
        for i, p in enumerate(parts):
            if p in words and BEFORE.issuperset(parts[:i]) and all(q in AFTER or q in words or q.isdigit() for q in parts[i + 1 :]):
                return True
    return False


def unwanted(name: str, attributes: str, in_article: bool, by_name: bool = True) -> bool:
    """Whether an element is none of the article, by its tag, role or (if by_name) class names."""
    if name in DROPPED:
        return True
    if name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body"):
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if found.get("role", "").lower() in ROLES or HIDDEN.search(found.get("style", "")) or found.get("aria-hidden", "").lower() == "true" or "hidden" in found:
        return True
    names = found.get("class", "") + " " + found.get("id", "")
    if not by_name:
        return False
    if name in ARTICLE:
        return hinted(names, READERS)
    return hinted(names) or (not in_article and hinted(names, HEADER))


def _length(markup: str) -> int:
    """Characters of text in a piece of markup, about."""
    return len("".join(TAG.sub(" ", SCRIPTS.sub(" ", markup)).split()))


class Forms:
    """Tells forms around the page, which hold an article or most of the text, from others. Forms don't
    nest: what begins inside one around the page is part of it."""

    END, ARTICLES = re.compile(r"</form\b", re.I), re.compile(r"<(?:article|main)\b", re.I)

    def __init__(self, page: str):
        self.page, self.total, self.until = page, -1, 0

    def around(self, start: int) -> bool:
        """Whether the form whose tag ends here is one."""
        if start <= self.until:
            return True
        end = self.END.search(self.page, start)
        stop = end.start() if end else len(self.page)
        self.total = _length(self.page) if self.total < 0 else self.total
        found = bool(self.ARTICLES.search(self.page, start, stop)) or 2 * _length(self.page[start:stop]) > self.total
        self.until = stop if found else self.until
        return found


def lines_of(page: str, by_name: bool = True) -> tuple[list[Line], list[int]]:
    """Blocks of the page as (text, characters outside links, inside the article, innermost container),
    where gaps are empty; and the container around each container, the page being 0."""
    out: list[Line] = []
    around, within = [0], 0
    chain: list[tuple[str, int]] = []  # open containers by name and number
    opened: dict[str, list[int]] = {x: [] for x in CONTAINERS}  # where in the chain those of a name are
    forms = Forms(page)
    text: list[tuple[str, bool]] = []
    link = article = 0
    skip, depth, at = "", 0, 0  # the element that is dropped, and how many of its name are open

    def flush() -> None:
        if text:
            whole = " ".join(html.unescape("".join(t for t, _ in text)).split())
            if whole:
                plain = " ".join(html.unescape("".join(t for t, a in text if not a)).split())
                out.append((whole, len(plain), article > 0, within))
            text.clear()

    pos, size = 0, len(page)
    while pos < size:
        m = TAG.search(page, pos)
        if not skip and (data := page[pos : m.start() if m else size]):
            text.append((data, link > 0))
        if not m:
            break
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA[") and not skip:
                text.append((html.escape(m[0][9:].removesuffix("]]>")), link > 0))
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW and not closing:
            end = re.compile(rf"</{name}\s*>|</{name}\Z", re.I).search(page, pos)
            pos = end.end() if end else size
            continue
        if skip:
            if skip == "p" and name in BLOCKS and not (closing and name == "p"):
                depth, pos = 0, m.start()  # a paragraph ends where another block begins or its parent ends
            elif name == skip and name not in VOID:
                depth += -1 if closing else 1
            elif name in ARTICLE and not closing and not page.find(f"</{skip}", pos) + 1:
                depth, pos = 0, m.start()  # it is never closed: the article isn't part of it
            if depth <= 0:
                skip = ""
            continue
        if not closing and unwanted(name, attributes, article > 0, by_name) and not (name == "form" and forms.around(pos)):
            flush()
            out.extend([("", 0, False, within)] * WINDOW)
            if name not in VOID and not attributes.endswith("/"):
                skip, depth = name, 1
            continue
        if name in BLOCKS:
            flush()
        elif name in ("br", "td", "th"):
            text.append((" ", link > 0))
        if name in ARTICLE:
            if article + (1 if not closing else -1) in (0, 1):
                out.extend([("", 0, False, within)] * WINDOW)
            article = max(0, article + (-1 if closing else 1))
        elif name == "a":
            link = 0 if closing else 1
        elif name in CONTAINERS:
            if not closing:
                around.append(within)
                within = len(around) - 1
                opened[name].append(len(chain))
                chain.append((name, within))
            elif opened[name]:  # what is open inside it ends too
                last = opened[name][-1]
                while len(chain) > last:
                    ended, number = chain.pop()
                    opened[ended].pop()
                    within = around[number]
    flush()
    return out, around


def regions(lines: list[Line]) -> list[tuple[int, int]]:
    """[surge, dive) points: runs of lines whose windows have text, of which one has enough."""
    weights = [x[1] for x in lines]
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    if not (most := max(sums, default=0)):
        return []
    found, i = [], 0
    while i < len(sums):
        if not sums[i]:
            i += 1
            continue
        j = i
        while j < len(sums) and sums[j]:
            j += 1
        a, b = i, j  # windows from i to j - 1 have text; the surge is at the first line that has
        while not weights[a]:
            a += 1
        while not weights[b - 1]:
            b -= 1
        if max(sums[i:j]) >= min(SURGE, most):
            found.append((a, b))
        i = j
    return found


def container(lines: list[Line], around: list[int], near: list[int]) -> int:
    """The main container of these lines: from the page on, the one that has MAJOR of the weight around it,
    and several of its blocks."""
    weight, blocks = [0] * len(around), [0] * len(around)
    for i in near:
        if lines[i][1]:
            weight[lines[i][3]] += lines[i][1]
            blocks[lines[i][3]] += 1
    best = [0] * len(around)
    for c in range(len(around) - 1, 0, -1):  # what is inside has the larger number
        up = around[c]
        weight[up] += weight[c]
        blocks[up] += blocks[c]
        if weight[c] and (not best[up] or weight[c] >= weight[best[up]]):
            best[up] = c
    found = 0
    while (c := best[found]) and blocks[c] > 1 and weight[c] >= MAJOR * weight[found]:
        found = c
    return found


def unmarked(lines: list[Line], around: list[int], spans: list[tuple[int, int]]) -> list[int]:
    """Places of the lines to keep on a page that marks no article."""

    def large(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        totals = [sum(x[1] for x in lines[a:b]) for a, b in spans]
        return [s for s, n in zip(spans, totals) if n >= SHARE * max(totals)]

    near = [i for a, b in large(spans) for i in range(a, b)]
    inside = container(lines, around, near)
    part = [c == inside for c in range(len(around))]
    for c in range(inside + 1, len(around)):
        part[c] = part[around[c]]
    own = [i for i, x in enumerate(lines) if x[0] and part[x[3]]]  # its gaps are left out
    again = [(own[a], own[b - 1] + 1) for a, b in regions([lines[i] for i in own])]
    if again:
        again = [(again[0][0], again[-1][1])] if inside else large(again)
    return sorted(i for a, b in again for i in own if a <= i < b)


def main_text(page: str | None, by_name: bool = True) -> str:
    """The article's blocks, joined by an empty line; without names only the distribution tells."""
    lines, around = lines_of(page or "", by_name)
    marked = any(x[2] for x in lines)
    if marked:
        lines = [x if x[2] else ("", 0, False, x[3]) for x in lines]
    spans = regions(lines)
    if marked:  # its regions, and blocks of text apart from these; lists of links between regions go
        within = [False] * len(lines)
        for a, b in spans or [(0, len(lines))]:
            within[a:b] = [True] * (b - a)
        at = [i for i, x in enumerate(lines) if within[i] or x[1]]
    else:
        at = unmarked(lines, around, spans) if spans else []
    return "\n\n".join(lines[i][0] for i in at if lines[i][0])


def extract(pages: DataFrame, *keep: str) -> DataFrame:
    """pages(html, ...) -> the kept columns, text, n_chars; kept columns of these names are replaced."""
    keep = tuple(c for c in keep if c not in ("text", "n_chars"))
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("_html")]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    return pages.selectExpr(*keep, "html as _html").mapInArrow(run, schema)
