import html
import re

import pytest

from cases import SF
from filelens.llm import html_mincut as H

PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1><p>A tag line of the site.</p>
</header><div id="cookie-notice"><p>We use cookies on this site to improve it for you.</p></div><nav><a href=x>Home</a></nav>
<div class="content"><h1>Story &amp; title</h1><p>First paragraph of some length, <a href=y>a link</a> and more<br>second
line.</p><p>Sh.</p><ul><li>one item<li>two items</ul><div class="ad">Buy now, our best offer of the year.</div>
<form><p>Sign up for news</p><input></form><p>Last&nbsp;one  with   spaces.</p></div><aside><p>Side text, many words.</p>
</aside><section class="comments"><article class="comment"><p>Great article! I liked it.</p></article></section>
<footer>(c) 2020</footer></body>"""


def test_content_without_boilerplate():
    assert H.main_text(PAGE) == ("Story & title First paragraph of some length, a link and more second line. Sh. "
                                 "one item two items Last one with spaces.")


@pytest.mark.parametrize("page", ["", None, "<nav><a>x</a></nav>", "<script>var t = '<p>no</p>';</script>", "<p", "<!-- x"])
def test_no_content(page):
    assert H.main_text(page) == ""


def test_broken_pages_are_read_as_far_as_they_go():
    assert H.main_text("<article><p>One <b>bold<p>Two &am</article") == "One bold Two &am"
    assert H.main_text("<article><p>a < b &lt; c and 1<2 holds.") == "a < b < c and 1<2 holds."


def test_smoothness_carries_short_blocks():
    p = "<p>A long enough paragraph of running text, with a good number of words in it.</p>"
    blocks = H.blocks(f"<body><div>{p}<div>Yes</div>{p}</div></body>")
    assert H._score(blocks[1], False) < 0 and H.label(blocks) == [True, True, True]


def brute_cut(found):
    """Cheapest labelling by trying all of them (containers take their best)."""
    import itertools

    best = None
    open_ = [b for b in found if not b.junk]
    region = any(b.region == 2 for b in open_)
    holders, edges = {}, []
    for i, b in enumerate(open_):
        if i:
            w = H.ADJACENT / (1 + H._distance(open_[i - 1].holder, b.holder))
            edges.append((("b", i - 1), ("b", i), w))
        e, child, w = b.holder.parent or b.holder, ("b", i), H.PROXIMITY
        for _ in range(2):
            known = e.number in holders
            holders.setdefault(e.number, ("h", e.number))
            edges.append((child, holders[e.number], w))
            if known or e.parent is None:
                break
            e, child, w = e.parent, holders[e.number], w / 2
    names = [("b", i) for i in range(len(open_))] + list(holders.values())
    for bits in itertools.product((True, False), repeat=len(names)):
        at = dict(zip(names, bits))
        cost = sum(max(0, H._score(b, region)) if not at["b", i] else max(0, -H._score(b, region))
                   for i, b in enumerate(open_)) + sum(w for x, y, w in edges if at[x] != at[y])
        if best is None or cost < best - 1e-9:
            best, label = cost, at
    mine = H.label(open_)
    # compare costs: there may be several cheapest labellings
    fixed = {("b", i): v for i, v in enumerate(mine)}
    cheapest = min(
        sum(max(0, H._score(b, region)) if not fixed["b", i] else max(0, -H._score(b, region))
            for i, b in enumerate(open_)) + sum(w for x, y, w in edges if {**fixed, **dict(zip(holders.values(), hb))}[x]
                                                != {**fixed, **dict(zip(holders.values(), hb))}[y])
        for hb in itertools.product((True, False), repeat=len(holders)))
    return best, cheapest


@pytest.mark.parametrize("seed", range(12))
def test_cut_is_minimal(seed):
    import random

    r = random.Random(seed)
    parts = []
    for _ in range(7):
        words = " ".join("word" for _ in range(r.choice([1, 2, 5, 30])))
        tag = r.choice(["p", "div", "li", "h2"])
        parts.append(r.choice(["", "<div>", "</div>"]) + f"<{tag}>{words}{r.choice(['', '.'])}"
                     + (f"<a>{words}</a>" if r.random() < .4 else "") + f"</{tag}>")
    best, mine = brute_cut(H.blocks("<body><div>" + "".join(parts)))
    assert mine == pytest.approx(best)


def by_article(page: str) -> str:
    part = page[page.index("<article>") + 9:].split("</article>")[0]
    part = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", "\0", part))
    return " ".join(x for x in (" ".join(html.unescape(b).split()) for b in part.split("\0")) if x)


def test_query_on_whole_table(spark):
    from filelens.llm.registry import QUERIES

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op1_html_extraction"](spark, SF).collect()
    assert len(got) == len(pages)
    assert all(r.text == by_article(pages[r.page_id]) and r.n_chars == len(r.text) for r in got)


def test_awkward_tables(spark):
    rows = [(1, "u", None, "t"), (None, None, "", "t"), (2, "u", "<p>Some words in a paragraph.</p>", None),
            (2, "u", "<p>Some words in a paragraph.</p>", None), (3, "u", "<article>" + "<p>long text. </p>" * 50000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(df).select("page_id", "text").collect()
    assert sorted(len(r.text) for r in got) == [0, 0, 26, 26, 549999]
    assert H.extract(df.limit(0)).count() == 0


LONG = "This paragraph belongs to the article, and it runs on for long enough to be taken as ordinary text of the page."


@pytest.mark.parametrize("page", [
    '<article><p>{0}</p><section id="discussion"><h2>Discussion</h2><p>{0}</p></section></article>',
    '<article><p>{0}</p><h2 id="social-history">Social history</h2><p>{0}</p></article>',
    '<main><section id="legal-framework"><h2>Legal framework</h2><p>{0}</p></section><p>{0}</p></main>',
    '<div class="content search-theory"><p>{0}</p><p>{0}</p></div>',
    '<article class="post promoted"><p>{0}</p><p>{0}</p></article>',
    '<body><form id="aspnetForm"><nav><a href=x>Home</a></nav><div><p>{0}</p><p>{0}</p></div></form></body>',
])
def test_names_alone_do_not_decide(page):
    kept = re.sub(r"<nav>.*</nav>", "", page).format(LONG)
    assert H.main_text(page.format(LONG)) == " ".join(re.sub(r"<[^>]*>", " ", kept).split())


@pytest.mark.parametrize("part", [
    '<div class="advert"><p>Buy now, our best offer.</p></div>', '<form><p>{0}</p></form>', '<div role="search">{0}</div>',
    '<div hidden><p>{0}</p></div>'])
def test_boilerplate_in_an_article_goes(part):
    assert H.main_text(f"<article><p>{LONG}</p>{part.format(LONG)}<p>{LONG}</p></article>") == f"{LONG} {LONG}"


@pytest.mark.parametrize("part", [
    '<div class="notice"><p>{0} One. Two. Three.</p></div>', '<div id="user-feedback-list"><p>{0}</p><p>{0}</p></div>',
    '<div class="advertisement">{0} {0}</div>', '<p class="cookie-notice">{0} {0}</p>'])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_long_notices_inside_go(tag, part):
    assert H.main_text(f"<{tag}><h1>Title</h1><p>{LONG}</p>{part.format(LONG)}<p>{LONG}</p></{tag}>") == f"Title {LONG} {LONG}"


@pytest.mark.parametrize("part,text", [
    ('<p title="is hidden here">{0}</p>', LONG), ("<p data-x='style=display:none; class=advert'>{0}</p>", LONG),
    ('<p title="a > b" lang=en>{0}</p>', LONG), ('<p aria-hidden="false">{0}</p>', LONG),
    ('<p aria-hidden=true>{0}</p>', ""), ('<p style="color:red; display : none">{0}</p>', ""), ("<p HIDDEN>{0}</p>", "")])
def test_attributes_count_by_name(part, text):
    want = " ".join(x for x in (LONG, text, LONG) if x)
    assert H.main_text(f"<article><p>{LONG}</p>{part.format(LONG)}<p>{LONG}</p></article>") == want


def test_text_that_is_no_paragraph_stays():
    links = "".join(f"<li><a href=x{i}>A work on subject number {i}</a></li>" for i in range(4))
    page = (f"<article><p>{LONG}</p><ul>{links}</ul><p>Where <math><mi>x</mi><mo>=</mo><msup><mi>y</mi><mn>2</mn></msup>"
            f"<annotation>x=y^2</annotation></math> holds.</p><svg><title>t</title><text>Label of the axis</text></svg>"
            f"<object data=x><p>{LONG}</p></object></article>")
    works = " ".join(f"A work on subject number {i}" for i in range(4))
    assert H.main_text(page) == f"{LONG} {works} Where x=y2 holds. Label of the axis {LONG}"


def test_pages_without_an_article_element(spark):
    """The same pages with the article as a plain block: the cut decides by
    text, links and neighbours. Notes in other languages of a few words may
    differ, so whole pages are counted."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    plain = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    same = sum(H.main_text(q) == by_article(p) for p, q in zip(pages, plain))
    assert same >= 0.95 * len(pages)


def test_comments_after_an_article_go():
    comment = f'<article class="comment"><p>{LONG}</p></article>'
    assert H.main_text(f'<article><p>{LONG}</p></article><div id="comments">{comment}{comment}</div>') == LONG
