import math
import random
import time

import pytest
from pyspark.sql import Row

from loomdoc.llm import html_extract
from loomdoc.llm.html_extract import content_lines, extract_pages, main_text, smoothed


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Head</h1><p>First  paragraph &amp; more\n text.<p>Er.</p><div class="ad">Buy</div><ul><li>one</li><li>two</li></ul><aside>see also</aside>
    <form><label>Mail</label><input><button>Send</button></form><p><b>Last</b> one<br>line.</p></article>
    <section id="comments"><article class="comment"><p>Nice!</p></article></section><div class="sidebar"><p>Side</p></div><footer>&copy; foot</footer></body></html>"""
    assert main_text(page) == "Head\nFirst paragraph & more text.\nEr.\none\ntwo\nLast one line."


def test_without_an_article_element():
    body = "<p>" + "word " * 40 + "</p>"
    page = f'<body><div id="top-menu"><a href=/>Home</a></div><div class="page"><div class="content has-sidebar"><h2>Title</h2>{body}<p>Short.</p>{body}</div><div class="sidebar"><p>{"side " * 30}</p></div></div></body>'
    text = ("word " * 40).strip()
    assert main_text(page) == f"Title\n{text}\nShort.\n{text}"


def test_edges():
    assert main_text(None) == main_text("") == main_text("<p> </p>") == ""
    assert main_text("plain text only") == "plain text only"
    assert main_text("<p>a<p>b</p>c") == "a\nb\nc"
    assert main_text('<p class="notice">no<p>yes it is') == "yes it is"
    assert main_text("<article><p>unclosed <b>bold") == "unclosed bold"
    assert main_text("<nav><a href=/>x</a><article><p>text after an open menu</p></article>") == "text after an open menu"
    assert main_text("<article>" + "<p>x y z</p>" * 3000 + "</article>") == "\n".join(["x y z"] * 3000)


def test_smoothing_marks_dense_lines():
    lines = [("a", 5, 0, 1)] * 4 + [("x" * 300, 1, 0, 0)] * 4 + [("b", 5, 0, 1)] * 4
    marks = content_lines(lines)
    assert all(marks[4:8]) and not marks[0] and not marks[-1]


def test_rows(spark):
    rows = spark.createDataFrame([(1, None, None, 5), (2, "u", "<p>é</p>", 6), (2, "u", "<p>é</p>", 6)], "page_id bigint, url string, html string, text int")
    assert sorted(tuple(r) for r in extract_pages(rows).fillna("").collect()) == [(1, "", "", 0), (2, "u", "é", 1), (2, "u", "é", 1)]
    assert extract_pages(rows.limit(0)).count() == 0


def test_scripts_and_styles_in_the_article():
    page = "<body><article><p>a</p><script>var x=1;</script><style>p{color:red}</style><p>b<script>if (1 < 2) y('<p>no</p>')</script>c <style>i{}</style>d</p></article><script>z()</script></body>"
    assert main_text(page) == "a\nbc d"
    assert main_text("<script>x</script><p>text</p><style>y</style>") == "text"


def test_content_lines_choose_among_articles_and_mains():
    long, short = "word " * 80, "an article in two elements ends here with a plain sentence"
    menu = "<div>" + "".join(f"<a href=/{k}>link number {k} of a long list</a> " for k in range(40)) + "</div>"
    text = long.strip()
    assert main_text(f"<article><p>{long}</p><p>{long}</p></article><article><p>{short}</p></article>") == f"{text}\n{text}\n{short}"
    assert main_text(f"<main><p>{long}</p></main><main><p>{long[5:]}</p></main>") == f"{text}\n{text[5:]}"
    # the text outside, a list of links inside the article
    assert f"{text}\n{text}" in main_text(f"<body><article>{menu}</article><div><p>{long}</p><p>{long}</p></div></body>")
    # a linked title stays
    assert main_text(f"<article><h1><a href=/>Title</a></h1><p>{long}</p><p>{short}</p></article>") == f"Title\n{text}\n{short}"


def test_smoothing_against_its_formula():
    rng = random.Random(4)
    for n in (1, 2, 5, 40):
        values, weights = [rng.random() * 300 for _ in range(n)], [rng.choice([0.0, 0.25, 1.0]) for _ in range(n)]
        for sigma in (0.7, 1.0, 2.0):
            r = max(1, math.ceil(2 * sigma))
            for w in (None, weights):
                own = lambda i, j: math.exp(-((i - j) ** 2) / (2 * sigma**2)) * (w[j] if w else 1.0) * (abs(i - j) <= r)  # noqa: B023, E731
                sums = [sum(own(i, j) for j in range(n)) for i in range(n)]
                want = [sum(values[j] * own(i, j) for j in range(n)) / s if s else 0.0 for i, s in enumerate(sums)]
                assert smoothed(values, sigma, w) == pytest.approx(want)


def test_threshold_against_its_formula():
    rng = random.Random(6)
    for _ in range(50):
        lines = [("x" * rng.randrange(1, 200), rng.randrange(1, 8), 0, 0) for _ in range(rng.randrange(1, 30))]
        flat = smoothed([len(t) / tags for t, tags, _, _ in lines], 1.0)
        mean = sum(flat) / len(flat)
        deviation = math.sqrt(sum((x - mean) ** 2 for x in flat) / len(flat))
        assert content_lines(lines) == [x >= (min(mean, deviation) or mean) for x in flat]


def test_ratios_decide_not_tags(monkeypatch):
    long, text = "word " * 80, ("word " * 80).strip()
    menu = "".join(f"<li><a href=/{k}>place {k}</a></li>" for k in range(12))
    # nothing but the ratios tells the menus from the text
    page = f"<body><div><ul>{menu}</ul></div><div><p>{long}</p><p>Short one.</p><p>{long}</p></div><div><ul>{menu}</ul></div></body>"
    assert main_text(page) == f"{text}\nShort one.\n{text}"
    tagged = f"<body><nav><ul>{menu}</ul></nav><article><p>{long}</p><div class=share>Tell others</div></article><footer>Foot</footer></body>"
    assert main_text(tagged) == text
    monkeypatch.setattr(html_extract, "content_lines", lambda lines, *_: [True] * len(lines))
    assert "Tell others" in main_text(tagged) and "Foot" in main_text(tagged)


@pytest.mark.parametrize("name", ["social-science", "sharing-economy", "menu-costs", "banner-1848", "notices-of-the-academy"])
def test_marks_with_a_sense_of_their_own(name):
    text = ("word " * 80).strip()
    assert main_text(f'<article><p>{text}</p><section class="{name}"><p>{text} too</p></section></article>') == f"{text}\n{text} too"


@pytest.mark.parametrize("name", ["share-buttons", "site-footer", "related-posts", "cookie-notice", "ad", "ad-slot-12", "js-newsletter", "mainMenu", "comments", "comment_list"])
def test_plain_marks(name):
    text = ("word " * 80).strip()
    assert main_text(f'<article><p>{text}</p><div class="{name}"><p>{text} too</p></div></article>') == text


def test_time_grows_with_the_page():
    deep = lambda k: "<div>some text" * k + "</div>" * k
    wide = lambda k: "<body>" + "<article>x some text</article>" * k
    stray = lambda k: "<div>" * k + "</span></b></p>" * k + "x"
    for page in (deep, wide, stray):
        times = []
        for k in (1000, 8000):
            began = time.process_time()
            main_text(page(k))
            times.append(time.process_time() - began)
        assert times[1] < 24 * times[0] + 0.2


def test_nulls_and_clashing_columns(spark):
    rows = spark.createDataFrame([(None, "u", "<p>a</p>", "x", 1), (3, None, "<p>b</p>", "y", 2), (None, "u", "<p>a</p>", "x", 1)], "page_id bigint, url string, html string, text string, n_chars int")
    assert sorted(map(str, extract_pages(rows).collect())) == sorted(map(str, [Row(page_id=None, url="u", text="a", n_chars=1)] * 2 + [Row(page_id=3, url=None, text="b", n_chars=1)]))
