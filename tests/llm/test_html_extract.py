import random
import time

import pytest

from graphloom.llm.html_extract import best_region, extract, main_text, tokens

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href="/a">Home page</a></li></ul></nav><!-- <p>not this</p> -->
<div class="cookie-notice">We use cookies on this site and more words here</div><div class="ad">Buy now and save</div>
<aside>Related stories of today</aside>
<article><h1>The &amp; title</h1><p>First <b>bo</b>ld   words<br>and more.</p><div class="share-buttons">Share it</div>
<form><input name="q"><button>Send</button></form><p>Second caf&eacute; &#8211; &lt;end&gt;</p>
<section id="comments"><p>A reader says something long about it</p></section></article>
<footer>&copy; someone</footer></body></html>"""
WANTED = "The & title First bold words and more. Second café – <end>"


@pytest.fixture(scope="module")
def weights(spark, sf_dir):
    from graphloom.llm.html_extract import learn_weights

    return learn_weights(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def test_article(weights):
    assert main_text(PAGE, weights) == WANTED


def test_without_article_element(weights):
    page = PAGE.replace("<article>", '<div class="content">').replace("</article>", "</div>")
    assert main_text(page, weights) == WANTED


def test_weights_and_defaults(weights):
    assert weights["word"] > 0 and weights["outside"] < 0 and all(v < 0 for k, v in weights.items() if k != "word")
    plain = {"word": 1.0, "outside": -1.0}
    for page in ("", "<html></html>", "<nav>a b c</nav>", "<p></p>", "<script>x", "<!-- open"):
        assert main_text(page, plain) == ""
    assert main_text("just words", plain) == "just words"
    assert main_text("<p>a < b &am", plain) == "a < b &am"
    assert main_text("<article><p>cut in the mid", plain) == "cut in the mid"
    assert main_text("<p>" + "word " * 20000 + "</p>", plain) == " ".join(["word"] * 20000)


def test_nested_and_unclosed():
    assert [v for k, v, _ in tokens("<div class='ad'><div>x</div>y</div>z") if k == "text"] == ["z"]
    assert [v for k, v, _ in tokens("<nav>never closed<p>z") if k == "text"] == ["never closed", "z"]
    assert [v for k, v, _ in tokens("<p hidden>x</p>y<NAV>a</NAV>") if k == "text"] == ["y"]


def test_class_names(weights):
    main = "<main><div class='intro-teaser'>" + "before " * 30 + "</div><article class='post has-sidebar'><p>The text of it.</p></article>"
    more = "<article class='comment'>" + "A reader " * 40 + "</article><div class='search-form'>Find</div></main>"
    assert main_text(main + more, weights) == "The text of it."
    assert main_text("<div class='content no-sidebar'><p>Some plain text</p></div><div id=side-bar class='sidebar'>x y z " + "w " * 50 + "</div>", weights) == "Some plain text"


def test_best_region_against_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        scores = [rng.choice([-3, -1, -0.25, 0, 0.5, 1, 4]) for _ in range(rng.randrange(0, 25))]
        totals = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        best = max([0, *totals.values()])
        i, j = best_region(scores)
        assert sum(scores[i:j]) == best and (best == 0) == (i == j)
        assert not best or j == min(b for (_, b), t in totals.items() if t == best)


def test_regions_of_pages_without_marks(weights):
    """Blocks of many words between menus and lists of few: the region of all blocks, found without any mark."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    for _ in range(60):
        menu = "".join(f"<ul><li><a href='{word()}'>{word()}</a></li></ul>" for _ in range(rng.randrange(3, 9)))
        blocks = [" ".join(word() for _ in range(rng.randrange(30, 80))) for _ in range(rng.randrange(1, 7))]
        page = f"<html><body><div>{menu}</div><div>" + "".join(f"<p>{b}</p>" for b in blocks) + f"</div><div>{menu}</div></body></html>"
        assert main_text(page, weights) == " ".join(blocks)


@pytest.mark.parametrize("unit", ["<a ", "<nav>", "<a '", '<a "', "<", "</script", "<script>", "<!--", "<div class='ad'>", '<x " > "', "<x '\">\" '", "<a\"<b'", "<p a=\"'", "&amp;", "&", "<title>", "</p", "<x\"'>'"])
def test_hostile_markup(weights, unit):
    for page in (unit * (1_000_000 // len(unit)), "<nav>" + unit * (500_000 // len(unit)) + "</nav>> words", unit * (500_000 // len(unit)) + "'>\">"):
        began = time.process_time()
        main_text(page, weights)
        assert time.process_time() - began < 5


def test_links_decide(weights):
    text = "one two three four five six seven eight nine ten"
    assert main_text(f"<p>{text}</p><div class='share-your-story'><p>{text}</p></div>", weights) == f"{text} {text}"
    assert main_text(f"<p>{text}</p><div class='share'><a>x y</a> <a>z</a> or</div><p>{text}</p>", weights) == f"{text} {text}"


def test_table(spark, sf_dir):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE), (3, "w", "<p>plain words here</p>")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, kind string")
    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert got == sorted([(1, "u", WANTED), (2, None, ""), (None, "v", ""), (1, "u", WANTED), (3, "w", "plain words here")], key=str)
    assert extract(df.limit(0)).count() == 0
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    wanted = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        wanted[r["page_id"]] = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner.replace("<b>", "").replace("</b>", ""))).split())
    assert {r["page_id"]: r["text"] for r in extract(pages).collect()} == wanted
