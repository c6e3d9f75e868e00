"""Main text: removed elements, implied ends, regions, and tables of pages."""

import random

import pytest
from pyspark.sql import functions as F

from erloom.llm import html

LONG = "A long paragraph of the story with many words in it, number %d."
STORY = [LONG % i for i in range(12)]
BODY = "".join(f"<p>{x}</p>" for x in STORY)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>long text</p><div class='ad'>x</div><p>Short end.</p></article>", ["long text", "Short end."]),
        ("<article><p>Text.</p><figure><img src=x><figcaption>A caption</figcaption></figure><math><mi>x</mi></math><p>More</p></article>", ["Text.", "A caption", "x", "More"]),
        ('<body><div class="main-header-less story"><p>Whole page text here.</p></div></body>', ["Whole page text here."]),
        ('<body class="has-sidebar"><p>Whole page text here.</p></body>', ["Whole page text here."]),
        ("<article><p class=promo>Buy now<p>Real text one.<ul><li class=share>Share<li>Real item</ul><p>End</article>", ["Real text one.", "Real item", "End"]),
        ("<article><h1>Title</h1><div class=promo>Buy<p>Full article text</p></article>", ["Title", "Full article text"]),
        ("<head><title>t</title><p>Body text without a body tag", ["Body text without a body tag"]),
        ("<p>One <b>bold<p>Two</b> rest &amp; &eacute;</p>", ["One bold", "Two rest & é"]),
        ("<article><header><h1>Own</h1></header><p>x</p><footer>By me</footer></article>", ["Own", "x"]),
        ("<div id=comments><article class=comment><p>reader says</p></article></div><main><p>The text</p></main>", ["The text"]),
        ("<div class=cookie-notice>We use</div><div class='siteHeader'>Site</div><form>x<p>y</form><p>Text only</p>", ["Text only"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<nav><ul><li>menu</ul></nav><div class=ad>Buy</div><article></article>", []),
        ("<p>a</p></div></article></p><!-- c --><p>b<![CDATA[x]]></p>", ["a", "b"]),
    ],
)
def test_pages(page, text):
    assert html.main_text(page) == "\n\n".join(text)


@pytest.mark.parametrize("broken", ["<![foo[x]]>", "<![ x ]>", "<![>", "<![]]>", "<![endif]-->", "<![if x>", "<![CDATA[ x>", "<![endif", "<!ELEMENT x [>", "<!>"])
def test_text_after_a_broken_declaration_stays(broken):
    end = "" if broken.endswith(">") else "<p>"  # one that is never closed ends with the next tag
    assert html.main_text(f"<article><p>Before</p>{broken}{end}<p>After</p><p>x[1] ]&gt; y ]></p></article>") == "Before\n\nAfter\n\nx[1] ]> y ]>"


def test_a_declaration_without_any_end_loses_no_text():
    assert html.main_text("<p>Before <![b and more") == "Before <![b and more"


def test_a_failing_parser_gives_no_result(monkeypatch):
    def fail(self, tag):
        raise AssertionError("broken")

    monkeypatch.setattr(html._Lines, "handle_endtag", fail)
    with pytest.raises(AssertionError):
        html.main_text("<p>Before</p><p>After</p>")


def test_no_region_is_lost_beside_an_advert():
    second = "A second section of eighty characters or so, after an advert, on a plain page."
    page = f"<nav>menu</nav><div>{BODY}<div class=ad>Buy</div><p>{second}</p><aside>s</aside><p>End.</p></div><footer>x</footer>"
    assert html.main_text(page) == "\n\n".join([*STORY, second, "End."])


def test_undeclared_menus_are_links_before_the_surge():
    links = "".join(f"<div><a href=x>Page {i}</a></div>" for i in range(9))
    assert html.main_text(f"<div>{links}</div><h1><a href=y>Head</a></h1>{BODY}<div>{links}</div>") == "\n\n".join(["Head", *STORY])


def naive_regions(lines):
    """Windows one by one."""
    part, parts = [], []
    for i, x in enumerate([*lines, None]):
        if x is None:
            parts.append(part)
            part = []
        else:
            part.append((i, x[1]))
    kept = []
    for part in parts:
        high = [sum(n for _, n in part[k : k + html.WINDOW]) for k in range(len(part))]
        least, on = min(html.SURGE, max(high, default=0)), False
        for k, h in enumerate(high):
            on = h > 0 and (on or h >= least)
            if on:
                kept.append(part[k][0])
    return kept


def test_regions_by_single_windows():
    r = random.Random(3)
    for _ in range(300):
        lines = [None if r.random() < 0.1 else ("x", r.choice([0, 0, 0, 5, 30, 90]), False) for _ in range(r.randint(0, 30))]
        got = [i for a, b, _, _ in html._regions(lines) for i in range(a, b)]
        want = naive_regions(lines)
        assert set(got) <= set(want) and {i for i in want if lines[i][1]} == {i for i in got if lines[i][1]}


def test_tables(spark):
    rows = [(1, "u", "<article><p>one</p></article>", "t"), (1, "u", "<article><p>one</p></article>", "t"), (2, None, None, "t"), (None, "v", "", None), (3, "w", "<p>" + "long " * 300_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html.extract(pages).select("page_id", "url", F.md5("text"), "n_chars").collect()), key=str)
    md5 = lambda s: __import__("hashlib").md5(s.encode()).hexdigest()
    want = [(1, "u", md5("one"), 3)] * 2 + [(2, None, md5(""), 0), (None, "v", md5(""), 0), (3, "w", md5(("long " * 300_000).strip()), 1_499_999)]
    assert got == sorted(want, key=str)
    assert html.extract(pages.where("false")).count() == 0
