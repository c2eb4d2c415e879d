"""Maximum-scoring content regions: against brute force, and on pages of known content."""

from __future__ import annotations

import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tests.twins import TESTDATA
from tidelake.llm.html_extraction import best_region, extract, extract_text, fit

PAGE = """<html><head><title>No</title><style>p{}</style></head><body><nav><a href=x>Home</a> <a>News</a></nav>
<div class="cookie-notice">We use cookies, many of them indeed.</div><article><h1>A  title</h1><p>Fish &amp; chips<br>are
 good to eat.<p>Second <b>bold</b>ness here.</p><div class="ad banner">Buy a lot now, buy it here, buy, buy, buy.</div><p>Third &eacute;tude.</p>
<form><p>Your name</p></form><script>"</p>"</script></article><section id="comments"><p>First! Great read.</p></section><footer>&copy; me</footer></body></html>"""


@given(st.lists(st.integers(-5, 5), max_size=40))
def test_best_region_is_that_of_all_regions(scores):
    start, end = best_region(scores)
    best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)), default=0)
    assert sum(scores[start:end]) == max(0, best)


def test_known_page(spark):
    known = fit(spark.read.parquet(str(TESTDATA / "sf0.01/pages.parquet")))
    assert extract(PAGE, known) == "A title\nFish & chips are good to eat.\nSecond boldness here.\nThird étude."
    assert extract(PAGE.replace("article", "div"), known) == extract(PAGE, known)


def test_pages_of_the_table_give_their_articles(spark):
    pages = spark.read.parquet(str(TESTDATA / "sf0.01/pages.parquet"))
    for r in extract_text(pages, fit(pages)).collect():
        assert "track(" not in r.text and "<" not in r.text.replace("< ", "") or "&lt;" in r.html
        assert bool(r.text) == bool(r.html)


def test_odd_pages(spark):
    rows = [(1, None, "u"), (2, "", "u"), (3, "plain words only", None), (4, "<p>" + "long text " * 100_000, "u"), (None, "<p>x y z</p>", "u"), (5, "<<<>>> & &nosuch; <p", "u")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    found = {r.page_id: r.text for r in extract_text(pages, fit(pages)).collect()}
    assert found[1] == found[2] == "" and found[3] == "plain words only" and len(found[4]) == 999_999 and found[None] == "x y z"
    assert extract_text(pages.limit(0), {}).count() == 0


def test_absent_end_tags_and_icons_swallow_nothing():
    text = "A title\nFish and chips are good."
    for head in ("<head><title>No</title><meta charset=x>", "<head><title>No</title><style>p{}</style></head>", "<head><link rel=x>\n<title/>", "<head>"):
        for icon in ("", "<svg class=i />", "<svg><path d='M0'/><g><text>no</text></g><title>no</title></svg>", "<svg><path d='M0'>"):
            for body in ("<body>", ""):
                page = f"<html>{head}{body}<article>{icon}<h1>A title</h1><p>Fish and <b>chips</b> are good.</p></article></html>"
                assert extract(page, {}) == text, page
    assert extract("<article><p>See <svg><path d='M0'/><text>no</text></svg>that <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>", {}) == "See that x=1 holds."
    assert extract("<p>Some words.</p><noscript><p>More words.", {}) == "Some words.\nMore words."
    assert extract("<p>Some words.</p><script>var no = 1;", {}) == "Some words."


def test_names_of_wrappers_and_topics_lose_nothing():
    article = "<article><h1>A title</h1><p>Fish and chips are good to eat.</p></article>"
    for name in ("content with-sidebar", "layout-sidebar-right", "no-header", "has_comments", "widget", "sidebar"):
        for page in (f"<body><div class='{name}'>{article}</div>", f"<body><div id={name.split()[-1]}><div class=x>{article}</div></div>"):
            assert extract(page, {}) == "A title\nFish and chips are good to eat.", page
            assert extract(page.replace("article", "div"), {}) == "A title\nFish and chips are good to eat.", page
    for part in ("<section id='side-effects'>", "<section id=search-algorithms>", "<section id='search'>", "<div id='alert-levels'>", "<div class='related-work'>"):
        for outer in ("article", "main"):
            assert extract(f"<{outer}><p>One two three.</p>{part}<h2 id='related'>Head</h2><p>More words.</p></{part[1:8].split()[0].strip()}></{outer}>", {}) == "One two three.\nHead\nMore words."
    for name in ("sidebar", "site-footer", "comment-list", "ad banner", "cookie-notice", "ad-slot-3", "main-nav-wrapper", "sidebar-left", "x Related-Posts"):
        assert extract(f"<article><p>One two three.</p><div class='{name}'><p>No.</p></div><p>Four five six seven eight nine.</p></article>", {}) == "One two three.\nFour five six seven eight nine.", name
    many = "<div id=comments>" + "<article><p>First, and a great read, all of it.</p></article>" * 9 + "</div>"
    assert extract(f"<body><article><p>One two three.</p></article>{many}", {}) == "One two three."


WORDS = "one two three four five"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<head><title>T</title><body><p>{WORDS}</p>", WORDS),
        (f'<div class="content no-sidebar"><article><p>{WORDS}</p></article></div>', WORDS),
        (f'<div class="page with-comments"><article><p>{WORDS}</p></article></div>', WORDS),
        (f'<div class="post share-enabled"><p>{WORDS}</p></div><p>x y z</p>', f"{WORDS}\nx y z"),
        (f"<article><p>{WORDS} <math><mi>x</mi></math> six</p></article>", f"{WORDS} x six"),
        (f'<article><p title="a>b">{WORDS}</p><p>six</p></article>', f"{WORDS}\nsix"),
        (f'<p>{WORDS}</p><i title="<b>six</b>', f"{WORDS}\nsix"),
    ],
)
def test_whole_articles_stay(page, text):
    assert extract(page, {}) == text


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "a b c" + "</div>" * 100_000, '<a href="x>' * 90_000, "<a b='" * 150_000, "<noscript>" * 100_000, "<div class=ad>" * 70_000 + "<p>a b</p>" * 1000, "<" * 1_000_000, '<a b="c>" ' * 100_000, "<svg>" * 200_000])
def test_a_page_of_a_megabyte_takes_linear_time(page):
    began = time.perf_counter()
    extract(page, {})
    assert time.perf_counter() - began < 10
