from __future__ import annotations

import html
import random
import re

import pytest

from wardline.llm import op_html as H

SF = "/root/testdata/sf0.01"


def article_text(page):
    a = page.find("<article>") + len("<article>")
    b = page.find("</article>")
    inside = re.sub(r"<(/?h1|/?p|br)>", " ", page[a : b if b >= 0 else len(page)])
    text = html.unescape(re.sub(r"<[^>]*(>|$)", "", inside))
    return " ".join(x for x in re.split(r"[ \t\n\r\f\v]+", text) if x)


def test_articles_of_the_given_pages_are_exact(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in H.extracted(pages, H.fit(pages)).collect()}
    for r in pages.collect():
        expected = article_text(r["html"])
        assert got[r["page_id"]] == (expected, len(expected))


PAGE = """<html><head><title>t u</title><style>a{b}</style><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<div class="site-header">Home News Contact us now</div><div id=cookie-banner>We use cookies, do you agree with all of that?</div>
<CONTENT><h1>A headline</h1><p>First   paragraph &amp; more,\n with <b>bo</b>ld &lt;words&gt; &#233;.<div class="ad">Buy now, it is cheap, really cheap</div>
<p>Second paragraph has a few words more<br>and a break.<ul><li>one item</li><li>two items</li></ul><form>Your mail: <input><button>Send it</button></form><p>The end of it all has a good many words to close the page with.</p></CONTENT>
<section id="comments"><p>I liked this a lot, thank you for writing it down for all of us.</p></section><aside><p>Related things to read</p></aside><footer>&copy; all of it</footer>"""
TEXT = "A headline First paragraph & more, with bold <words> é. Second paragraph has a few words more and a break. one item two items The end of it all has a good many words to close the page with."


@pytest.mark.parametrize("name", ["article", "main", 'div class="story"'])
def test_boilerplate_around_and_inside_is_left_out(name):
    page = PAGE.replace("</CONTENT>", f"</{name.split()[0]}>").replace("CONTENT", name)
    got = H.extract(page, H.Weights())
    assert got == TEXT


WRAPPED = "<h1>A headline</h1><p>A story of a good many words, so that nobody can take it for a menu.</p>"
STORY = "A headline A story of a good many words, so that nobody can take it for a menu."


@pytest.mark.parametrize("outer", [
    "body class='has-sidebar comments-open'", "div class='content-with-sidebar'", "div class='no-ads'", "div id=sidebar", "form class='search'", "aside", "div class='overflow-hidden'", "div title='hidden'",
])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_wrappers_do_not_hide_the_content(outer, inner):
    tag = outer.split()[0]
    if inner == "div" and (outer == "aside" or "id=sidebar" in outer):  # boilerplate indeed
        return
    page = f"<html><{outer}><{inner}>{WRAPPED}</{inner}></{tag}></html>"
    assert H.extract(page, H.Weights()) == STORY


@pytest.mark.parametrize("attribute", ["hidden", "style='display: none'", "aria-hidden=true", 'class="x" hidden=""'])
def test_hidden_wrappers_stay_hidden(attribute):
    assert H.extract(f"<body><div {attribute}><article>{WRAPPED}</article></div></body>", H.Weights()) == ""


def test_articles_of_comments_stay_out():
    comments = "<div id='comments'><article><p>I liked it a lot</p></article></div>"
    assert H.extract(f"<body class='comments-open'><div class='left-sidebar'><article>{WRAPPED}</article></div>{comments}</body>", H.Weights()) == STORY


def test_best_run_is_the_maximum():
    rnd = random.Random(2)
    for _ in range(500):
        s = [rnd.choice([-3, -1, -0.5, 0, 1, 2]) for _ in range(rnd.randint(0, 14))]
        a, b = H.best_run(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])


@pytest.mark.parametrize("page", ["", "<", "<p", "a < b", "<p>one<p", "&am", "<!-- x", "<script>never", '<a href="x', "<" * 3000, "plain text only", "</div></p></article>x", "<p>\x00é￿"])
def test_broken_markup_is_read_as_far_as_it_goes(page):
    assert isinstance(H.extract(page, H.Weights()), str)


def test_odd_rows(spark):
    big = "<article>" + "<p>word</p>" * 50_000
    rows = [(1, "u", None, "a"), (2, None, "", "b"), (2, None, "<main>x</main>", "c"), (None, "u", big, "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in H.extracted(pages, H.fit(pages)).collect())
    assert got == [(0, 5 * 50_000 - 1), (1, 0), (2, 0), (2, 1)]
    assert H.extracted(pages.where("false"), H.fit(pages.where("false"))).count() == 0


def test_weights_follow_labels():
    counts = {("word", "article", True): 900, ("word", "!nav", False): 100, ("word", "div", True): 300, ("word", "div", False): 5, ("tag", "p", True): 50, ("tag", "li", False): 80, ("tag", "a", False): 90}
    w = H.weigh(counts)
    assert w.words["article"] > 1 and w.words["!nav"] <= -0.5 and w.tags["p"] == H.TAG and w.tags["li"] == H.LEAST_TAG and w.tags["a"] == -0.05
