"""HTML extraction by minimum-cut labelling.

A page becomes a sequence of text blocks with their place in the element tree.
A small classifier gives every block a cost for being called content and a
cost for being called boilerplate: the terminal capacities of a flow network.
Blocks that follow one another, and blocks of one container (by way of the
container's own node), are joined by smoothness edges whose weight falls with
their distance in the tree. The minimum cut is the cheapest labelling; the
blocks on the source side are the text.

Blocks of elements that never hold main text (scripts, menus, asides, hidden
parts, site headers and footers, and forms that do not hold the article) are
boilerplate beforehand. Names that speak of adverts, notices, comments and the
like are a cost only, so that the cut decides: a high one outside articles, a
lower one inside, a small one beside a name of main text, and none for the ids
of headings and of an article's sections, which are made of their titles.
Pages are independent, so this is one map over Arrow batches; a page's
network is as large as its number of blocks.

Defined cases: a null or empty page, or one of boilerplate only, gives an
empty text; a page that breaks off, unclosed elements and stray signs are
read as far as they go; repeated rows are extracted each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col

# Element kinds
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style title textarea noscript template iframe noembed noframes xmp canvas audio video select "
           "datalist desc metadata annotation annotation-xml".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt "
              "ruby s samp small span strike strong sub sup time tt u var wbr img picture source "
              "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts "
              "mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none "
              "semantics tspan".split())
_NEVER = set("nav footer aside button dialog menu fieldset".split())
_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar".split())
# A start tag of these ends an open element of the second set
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}}
_HOLDERS = set("article aside body center details div dl fieldset figure footer form header html li main nav ol "
               "section table td th ul blockquote".split())

# Words of class names, ids and roles
_JUNK = set("ad ads adbox adslot advert adverts advertisement advertisements advertising adsense sponsor sponsored "
            "sponsors promo promos promoted promotion banner banners nav navbar navigation menu menus breadcrumb "
            "breadcrumbs crumbs sidebar sidebars sidenav rail widget widgets footer masthead cookie cookies consent "
            "gdpr notice notices alert popup popover modal overlay toast newsletter subscribe subscription signup "
            "signin login register share sharing sharebar social related recommended recommendations suggested "
            "trending comment comments commentlist disqus reply replies respond discussion pagination pager toolbar "
            "search searchbox copyright legal disclaimer skip skiplink paywall teaser teasers outbrain taboola "
            "complementary contentinfo dialog alertdialog feedback form".split())
_HEAD = {"header", "topbar"}
_GOOD = set("article articlebody content main story post entry body text prose".split())
_MODIFIER = {"with", "has", "no", "without", "is", "js"}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>?""", re.S)
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMING = ("class", "id", "role", "itemprop")
_UNSEEN = re.compile(r"(?i)(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)")
_SENTENCE_END = re.compile(r"""[.!?…。:;]["'”’)\]]*$""")

# Classifier weights (log-odds of being content) and smoothness
REGION, OUTSIDE, PARAGRAPH, HEADING, SENTENCE = 3.0, -3.0, 1.0, 0.5, 0.5
PER_WORD, MOST_WORDS, FEW_WORDS = 0.05, 2.0, -0.6
LINKS, LINKS_INSIDE = -5.0, -2.5  # of text that is all links, outside and inside an article
ADJACENT, PROXIMITY = 1.0, 0.6
# Cost of a name in the list: outside and inside an article or main text, and
# beside a name of main text (or as the id of a section outside)
LISTED, LISTED_INSIDE, LISTED_BESIDE = 8.0, 6.0, 2.0


class _Element:
    """An open element: what its blocks inherit."""

    __slots__ = ("tag", "junk", "region", "listed", "form", "number", "depth", "parent")

    def __init__(self, tag, marks, number, parent):
        self.tag, (self.junk, self.region, self.listed), self.number, self.parent = tag, marks, number, parent
        self.depth = parent.depth + 1 if parent else 0
        self.form = parent and parent.form or (self if tag == "form" else None)


class _Block:
    __slots__ = ("parts", "chars", "linked", "tag", "holder", "junk", "region", "listed", "text")

    def __init__(self, tag, holder):
        self.parts, self.chars, self.linked = [], 0, 0
        self.tag, self.holder, self.junk, self.region = tag, holder, holder.junk, holder.region
        self.listed = holder.listed


def _attributes(raw: str) -> dict[str, str]:
    """Names (the first of each) and values of a start tag's attributes."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), a or b or c)
    return found


def _marks(tag: str, attributes: str, parent: _Element) -> tuple[bool, int, float]:
    """Whether an element is boilerplate as such, its region (2 in an article, 1
    in something called content, 0 elsewhere) and the cost of its names."""
    junk, region, listed = parent.junk or tag in _NEVER, parent.region, parent.listed
    if tag == "header":
        junk = junk or region < 2 and listed < LISTED
    names = []
    if attributes and not junk and tag not in ("html", "body"):
        given = _attributes(attributes)
        if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(given.get("style", "")):
            return True, region, listed
        for kind in _NAMING:
            for name in given.get(kind, "").split():
                if kind == "role" and name.lower() in _ROLES:
                    return True, region, listed
                # a form may be called one
                names.append((kind, {w.lower() for w in _WORD.findall(name)} - ({"form"} if tag == "form" else set())))
    title = tag in _INLINE or len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
    good = named = False
    for kind, words in names:
        if words & _JUNK and not words & _MODIFIER or (words & _HEAD and region < 2 and not words & _GOOD):
            named = named or kind != "id" or not (title or tag == "section" and region)
        elif words & _GOOD:
            good = True
    if named:
        by_id = tag == "section" and all(kind == "id" for kind, words in names if words & _JUNK)
        listed = max(listed, LISTED_BESIDE if good or by_id else LISTED_INSIDE if region else LISTED)
    if listed < LISTED:  # nothing in a list of comments is the article
        region = 2 if tag in ("article", "main") else max(region, int(good))
    return junk, region, listed


def blocks(page: str) -> list[_Block]:
    """The text blocks of a page in order; their ``text`` is normalised."""
    root = _Element("#root", (False, 0, 0.0), 0, None)
    stack, out = [root], []
    block, made, links, at, n = None, 1, 0, 0, len(page)

    def add(raw: str) -> None:
        nonlocal block
        if block is None:
            if not raw.strip():
                return
            holder = next(e for e in reversed(stack) if e.tag not in _INLINE)
            block = _Block(holder.tag, holder)
            out.append(block)
        if "&" in raw:
            raw = html.unescape(raw)
        block.parts.append(raw)
        size = len(raw)
        block.chars += size
        if links:
            block.linked += size

    def close(upto: int) -> None:
        nonlocal links, block
        for e in stack[upto:]:
            if e.tag == "a":
                links -= 1
            elif e.tag not in _INLINE:
                block = None
        del stack[upto:]

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        m = _TAG.match(page, lt)
        if m is None:
            if not page[lt + 1:lt + 2].isalpha() or not page[lt + 1].isascii():
                add("<")
                at = lt + 1
                continue
            m = _LOOSE_TAG.match(page, lt)
            if m is None:  # the page breaks off inside a tag
                break
        at = m.end()
        if m.lastindex is None or m[2] is None:
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                # an inline end tag does not end what holds it
                if tag in _INLINE and stack[i].tag not in _INLINE:
                    break
            if tag not in _INLINE:
                block = None
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not attributes.rstrip().endswith("/") or end:
                at = end.end() if end else n
            continue
        if tag in _INLINE:
            if tag == "a":
                links += 1
            if tag not in _VOID:
                top = stack[-1]
                marks = top.junk, top.region, top.listed
                if attributes and not top.junk:
                    junk, _, listed = _marks(tag, attributes, top)
                    marks = junk, top.region, listed
                if marks != (top.junk, top.region, top.listed):  # an inline advert is a block of its own
                    block = None
                    tag = "span:" + tag
                    if tag == "span:a":
                        links -= 1
                stack.append(_Element(tag, marks, made, top))
                made += 1
            continue
        block = None
        if tag in _VOID:
            continue
        # a new block ends an open paragraph, and list items end their like
        ends = _ENDS.get(tag, ())
        for i in range(len(stack) - 1, 0, -1):
            e = stack[i].tag
            if e == "p" or e in ends:
                close(i)
                if e != "p":
                    break
            elif e in _HOLDERS and e not in ends:
                break
        stack.append(_Element(tag, _marks(tag, attributes, stack[-1]), made, stack[-1]))
        made += 1

    for b in out:
        b.text = " ".join("".join(b.parts).split())
    out = [b for b in out if b.text]
    _close_forms(out)
    return out


def _close_forms(found: list[_Block]) -> None:
    """Blocks of forms are boilerplate, but for a form that holds an article,
    something called content, or most of the page's text."""
    size: dict[int, int] = {}
    held = set()
    total = 0
    for b in found:
        if b.junk:
            continue
        cost = len(b.text)
        total += cost
        form = b.holder.form
        if form is not None:
            size[form.number] = size.get(form.number, 0) + cost
            if b.region > form.region:
                held.add(form.number)
    for b in found:
        form = b.holder.form
        if form is not None and form.number not in held and 2 * size.get(form.number, 0) <= total:
            b.junk = True


def _score(b: _Block, has_region: bool) -> float:
    """Log-odds of a block being content."""
    words = b.text.count(" ") + 1
    # what a name in the list costs grows with the block, so length does not outweigh it
    length = min(PER_WORD * words, MOST_WORDS) if b.listed < LISTED_INSIDE else 0.0
    s = length + (FEW_WORDS if words < 4 else 0.0) - b.listed
    s += (LINKS_INSIDE if b.region == 2 else LINKS) * b.linked / max(1, b.chars)
    if b.tag in ("p", "pre", "blockquote"):
        s += PARAGRAPH
    elif len(b.tag) == 2 and b.tag[0] == "h":
        s += HEADING
    if _SENTENCE_END.search(b.text):
        s += SENTENCE
    if b.region == 2 or b.region and not has_region:
        s += REGION
    elif has_region:
        s += OUTSIDE
    return s


def _distance(a: _Element, b: _Element) -> int:
    d = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        d += 1
    return d


class _Network:
    """Undirected and terminal capacities; minimum cut by augmenting along
    shortest paths in phases."""

    def __init__(self):
        self.to, self.cap, self.out = [], [], []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def edge(self, a: int, b: int, forth: float, back: float) -> None:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.cap.append(forth)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.cap.append(back)

    def _levels(self, s: int, t: int) -> list[int]:
        level = [-1] * len(self.out)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in self.out[u]:
                v = self.to[e]
                if level[v] < 0 and self.cap[e] > 1e-9:
                    level[v] = level[u] + 1
                    queue.append(v)
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        while True:
            level = self._levels(s, t)
            if level[t] < 0:
                return [x >= 0 for x in level]
            used = [0] * len(self.out)
            path, u = [], s
            while True:
                if u == t:
                    flow = min(self.cap[e] for e in path)
                    for e in path:
                        self.cap[e] -= flow
                        self.cap[e ^ 1] += flow
                    k = next(i for i, e in enumerate(path) if self.cap[e] <= 1e-9)
                    u = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                step = None
                while used[u] < len(self.out[u]):
                    e = self.out[u][used[u]]
                    if self.cap[e] > 1e-9 and level[self.to[e]] == level[u] + 1:
                        step = e
                        break
                    used[u] += 1
                if step is not None:
                    path.append(step)
                    u = self.to[step]
                elif path:
                    u = self.to[path.pop() ^ 1]
                    used[u] += 1
                else:
                    break


def label(found: list[_Block]) -> list[bool]:
    """Whether each block is content, by the minimum cut."""
    open_blocks = [b for b in found if not b.junk]
    has_region = any(b.region == 2 for b in open_blocks)
    net = _Network()
    s, t = net.node(), net.node()
    at: dict[int, int] = {}
    holders: dict[int, int] = {}
    last, previous = None, None
    for b in found:
        if b.junk:
            continue
        u = at[id(b)] = net.node()
        odds = _score(b, has_region)
        if odds > 0:
            net.edge(s, u, odds, 0.0)
        else:
            net.edge(u, t, -odds, 0.0)
        if last is not None:
            w = ADJACENT / (1 + _distance(last.holder, b.holder))
            net.edge(previous, u, w, w)
        # the container of the block's element, and that one's container
        e, child, w = b.holder.parent or b.holder, u, PROXIMITY
        for _ in range(2):
            known = e.number in holders
            h = holders.setdefault(e.number, -1)
            if h < 0:
                h = holders[e.number] = net.node()
            net.edge(child, h, w, w)
            if known or e.parent is None:
                break
            e, child, w = e.parent, h, w / 2
        last, previous = b, u
    side = net.source_side(s, t)
    return [not b.junk and side[at[id(b)]] for b in found]


def main_text(page: str | None) -> str:
    """The main text of a page: its content blocks joined by one space."""
    if not page:
        return ""
    found = blocks(page)
    return " ".join(b.text for b, content in zip(found, label(found)) if content)


@F.arrow_udf(T.StringType())
def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        yield pa.array([main_text(p.as_py()) for p in pages], pa.string())


def extract(pages: DataFrame, name: str = "text") -> DataFrame:
    """``pages`` (html and any columns) with the main text instead of the
    html, in column ``name`` (which replaces one of that name)."""
    keep = [c for c in pages.columns if c not in ("html", name)]
    return pages.select(*[col(c) for c in keep], extracted(col("html")).alias(name))
