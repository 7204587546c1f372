import html
import random
import re
import time

import pytest

from tessella.llm import html_text as H

PAGE = """<html><head><title>Title words here</title></head><body><header><h1>Site name</h1></header>
<div id="cookie-notice"><p>We use cookies to improve your stay on this site ok</p></div>
<nav><ul><li><a href=x>Home</a><li><a>About us</a></ul></nav><div class="layout"><div class="sidebar"><p>Popular posts this
week are many and good to read now</p></div><main><article><h1>Real title</h1><p>First paragraph with <a href=y>a link</a> and
<b>bold<br>text &amp; more &lt;words&gt; in it for good measure.<p>Second&nbsp;paragraph has
  more words, enough of them.<div class="ad-slot">Buy this now cheap</div><ul><li>one item<li>two items</ul>
<table><tr><td>cell a</td><td>cell b</td></tr></table><blockquote>Quoted words.</blockquote><form><input><label>Your mail</label>
</form><p>Last one 5 < 6.</p></article><section class="comments"><h2>Comments</h2><p>I liked this article very much and wish to
say so at great length indeed yes</p></section></main></div><footer>&copy; 2024 all rights</footer></body>"""
WANT = "\n\n".join(["Real title", "First paragraph with a link and bold text & more <words> in it for good measure.",
                    "Second paragraph has more words, enough of them.", "one item", "two items", "cell a", "cell b",
                    "Quoted words.", "Last one 5 < 6."])


@pytest.fixture(scope="module")
def weights(spark):
    return H.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def test_article_alone(weights):
    unnamed = PAGE.replace("<main>", "").replace("</main>", "").replace("<article>", '<div class="post">').replace("</article>", "</div>")
    for page in (PAGE, unnamed):
        assert H.main_text(page, weights) == WANT
        assert H.main_text(page, {}) == WANT


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split())
                  for b in re.split(r"</?(?:h1|p)>", inside)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_odd_pages(spark):
    pages = {"": "", "   ": "", "<p>": "", "<p>hi": "hi", "a<b": "a<b", "<div class=ad>x": "", "<!-- x": "", "<script>a": "",
             "</p></p>": "", "<p>a</p><p>a</p>": "a\n\na", "<nav>menu<article><p>text of it": "text of it",
             "<p>" + "word " * 20_000: ("word " * 20_000).strip(), "<div " * 200_000: ("<div " * 200_000).strip(), '<p><a href="<p>">x</a> y z': "x y z"}
    rows = [(k, None, p, "n", 1) for k, p in enumerate(pages)] + [(-1, "u", None, None, None), (0, None, "", "n", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = H.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = "" if r.page_id < 0 else list(pages.values())[r.page_id]
        assert r.text == want, r.page_id
    assert H.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "content-widget", "elementor-widget elementor-widget-text-editor",
                                  "modal-open", "ad-free", "social-science"])
def test_names_of_wrappers_do_not_drop_the_article(weights, name):
    page = f'<body><div class="{name}"><p>Words of the article here.</p><p>And more of them.</p></div></body>'
    assert H.main_text(page, weights) == "Words of the article here.\n\nAnd more of them."


def test_parts_of_pages_go(weights):
    for name in ("site-footer", "sidebar", "cookie-notice", "ad-slot", "related-posts", "post-comments", "comment-12", "share-buttons", "widget"):
        assert H.is_aside("div", f' class="{name}"'), name


def test_articles_among_comments_are_comments(weights):
    said = "".join(f'<article class="comment"><p>Reader {k} has a lot to say about it</p></article>' for k in range(5))
    for remarks in (f'<section class="comments">{said}</section>', said, f"<div id=comments>{said.replace(' class=', ' data-x=')}</div>"):
        page = f"<body><main><article><p>Words of the article here, some more.</p></article></main>{remarks}</body>"
        assert H.main_text(page, weights) == "Words of the article here, some more."
    assert H.counted("<main><article><p>one two</p></article></main>")["w p", True] == 2


def test_the_stretch_is_the_best_of_all():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-3, -1, -0.5, 0, 1, 2]) for _ in range(rng.randint(0, 14))]
        a, b = H.best_stretch(scores)
        best = max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
        assert sum(scores[a:b]) == best and (b > a) == (best > 0)


@pytest.mark.parametrize("inside", ["<ul>" + "<li><a href=x>Link item</a>" * 60 + "</ul>",
                                    "<table>" + "<tr><td>1<td>2</tr>" * 80 + "</table>", "<figure><img src=x><br></figure>" * 80])
def test_long_parts_do_not_end_an_article(weights, inside):
    page = (f"<body><nav><a href=x>Menu of it</a></nav><article><p>{'some words ' * 15}</p>{inside}<p>{'more words ' * 10}</p></article>"
            "<footer>All rights</footer></body>")
    for w in (weights, {}):
        text = H.main_text(page, w)
        assert text.startswith("some words") and text.endswith("more words") and "Menu" not in text and "rights" not in text
        assert ("Link item" in text) == ("Link" in inside) and ("1\n\n2" in text) == ("<td>" in inside)


@pytest.mark.parametrize("part", ['<div class="market-share"><p>Kept here too.</p></div>', '<div class="search"><p>Kept here too.</p></div>',
                                  "<p>Kept <math><mi>x</mi></math> too.</p>", "<header><h1>Kept here too.</h1></header>",
                                  "<div><select><option>no</div><p>Kept here too.</p>", "<div><template>no</div><p>Kept here too.</p>",
                                  "<div><noscript>no</div><p>Kept here too.</p>"])
def test_parts_of_an_article_stay(weights, part):
    text = H.main_text(f"<body><article><p>First words of it, some more.</p>{part}<p>Last words of it all.</p></article></body>", weights)
    kept = "Kept x too." if "math" in part else "Kept here too."
    assert text == f"First words of it, some more.\n\n{kept}\n\nLast words of it all."


def test_long_pages_take_time_in_proportion():
    for page in ("<b>x " * 200_000, "<div>x " * 200_000, "<p>x</i>" * 200_000, "<select>x" * 100_000, "<nav><b>" * 100_000,
                 "<article>x" * 100_000, "<svg>x" * 100_000):
        began = time.time()
        H.main_text(page, {})
        assert time.time() - began < 30
