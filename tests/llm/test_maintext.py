"""Main text of pages by hand."""

import random

import numpy as np
import pytest

from cohortia.llm.maintext import extract, main_region, main_texts

LONG = "A sentence of the article that is long enough to count as text, with some more words in it."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<html><body></body></html>", ""),
        ("just words", "just words"),
        (f"<nav><a href=x>Home</a></nav><article><h1>T &amp; t</h1><p>One <b>two</b>\n three</p></article><footer>f</footer>", "T & t\nOne two three"),
        ("<article><p><b>a<br><p>b<!-- c > --><script>var t='</p>';</script><style>p{}</style></article>", "a\nb"),
        ("<article><p>Short.</p><aside>side</aside><div class='ad'>buy<div>more</div></div><p>End</p></article>", "Short.\nEnd"),
        ("<article><p>x</p></article><div class=comments><p>reader</p></div>", "x"),
        ("<article><p>x</p><section id='comments'><p>reader <div>deep</div></p></section></article>", "x"),
        ("<article><p>cut &amp; off &copy; here &am", "cut & off © here &am"),
        ("<article><p title=\"a>b\">x &lt;p&gt; &#233;&#x41;</p></article>", "x <p> éA"),
        (f"<div><a href=1>Home</a> <a href=2>News</a></div><div><p>{LONG}</p><p>Short end.</p><p>{LONG}</p></div><div class='cookie-notice'>We</div>", f"{LONG}\nShort end.\n{LONG}"),
        (f"<header><h2>Site</h2></header><main><header><h1>Head</h1></header><p>{LONG}</p><form><p>mail</p></form></main>", f"Head\n{LONG}"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>3<td>4</table></article>", "one\ntwo\n3\n4"),
    ],
)
def test_pages(page, text):
    assert extract(page) == text


def test_surge_and_dive():
    weights = np.array([0, 0, 0, 0, 0, 60, 5, 80, 0, 0, 0, 0, 2, 0])
    keep = np.flatnonzero(main_region(weights, window=3, least=40))
    assert keep.tolist() == [5, 6, 7]
    assert not main_region(np.zeros(5, int)).any()


def test_table(spark):
    rows = [(1, "u", "<article><p>é  b</p></article>"), (2, None, None), (None, "v", ""), (1, "u", "<article><p>é  b</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "7 AS n_chars", "'old' AS text")
    got = sorted((tuple(r) for r in main_texts(df).select("page_id", "url", "text", "n_chars").collect()), key=str)
    assert got == sorted([(1, "u", "é b", 3), (2, None, "", 0), (None, "v", "", 0), (1, "u", "é b", 3)], key=str)
    assert main_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<nav>Menu</nav><h1>Short headline</h1><p>{LONG}</p><p>Closing line.</p><footer>f</footer>", f"Short headline\n{LONG}\nClosing line."),
        ("<p>Fifteen letters</p>" * 5, "\n".join(["Fifteen letters"] * 5)),
        ("<p>Some twenty letters.</p><p>And as many of them.</p>", "Some twenty letters.\nAnd as many of them."),
        (f"<div><p>{LONG}</p><ul><li>one<li>two<li>three<li>four<li>five</ul><p>{LONG}</p></div>", f"{LONG}\none\ntwo\nthree\nfour\nfive\n{LONG}"),
        (f"<div><h2>Head</h2><div class=ad>buy this</div><p>{LONG}</p><div class=ad>buy</div><p>End.</p></div>", f"Head\n{LONG}\nEnd."),
        (f"<p>Tagline</p><p><a href=x>A link of the site</a></p><p>Head</p><p>{LONG}</p>", f"Head\n{LONG}"),
    ],
)
def test_unmarked_pages_keep_short_lines_of_the_text(page, text):
    assert extract(page) == text


def test_densities_locate_the_text_on_marked_pages():
    # The mark bounds the text where the text lies in it; a teaser elsewhere does not hide the text.
    assert extract(f"<p>{LONG}</p><article><h1>T</h1><p>{LONG}</p><p>End</p></article>") == f"T\n{LONG}\nEnd"
    assert extract(f"<article><p>Teaser</p></article><p><a href=x>more of the site</a></p><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div>") == f"Teaser\nT\n{LONG}\n{LONG}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # Text in a plain container beside a marked teaser.
        (f"<div class=box><article><p>{LONG}</p></article></div><nav><a href=x>more of the site</a></nav><div class='content'><h1>T</h1><p>{LONG}</p><p>{LONG} B</p></div>", f"{LONG}\nT\n{LONG}\n{LONG} B"),
        (f"<article class='teaser'><p>{LONG}</p></article><div class='content'><h1>T</h1><p>{LONG} A</p><p>{LONG} B</p></div>", f"T\n{LONG} A\n{LONG} B"),
        # Comments marked as articles.
        (f"<article><p>{LONG}</p></article><article class='comment'><p>reader {LONG}</p></article>", LONG),
        (f"<article class='post'><p>{LONG}</p></article><div><article id='comment-12' class='comment-body'><p>reader</p></article></div>", LONG),
        # A word for the text does not save what a name begins or ends with.
        (f"<article><p>{LONG}</p><div class='newsletter-main'>a</div><div class='cookie-text'>b</div><div class='modal-body'>c</div><div class='cookie-content'>d</div><div class='menu-main'>e</div><div class='footer-content'>f</div><div class='article-share'>g</div><div class='mainMenu'>h</div></article>", LONG),
        # Names about the layout, the head of the text and its parts.
        (f"<article class='post type-post category-social has-sidebar'><div class='post-header'><h1>T</h1></div><div class='entry-content with-sidebar'><p>{LONG}</p></div></article>", f"T\n{LONG}"),
        (f"<div class='content no-sidebar'><p>{LONG}</p></div>", LONG),
    ],
)
def test_names_are_judged_by_the_place_of_their_words(page, text):
    assert extract(page) == text


def brute_page(seed):
    """A page out of known blocks, and the text of those that are its article."""
    rng = random.Random(seed)
    sentence = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(rng.randint(12, 30)))
    text = [f"Head {seed}", *[sentence() for _ in range(rng.randint(3, 8))], "The end."]
    blocks = [f"<h1>{text[0]}</h1>"]
    for line in text[1:]:
        if rng.random() < 0.3:
            blocks.append(rng.choice(["<aside>note</aside>", "<div class='ad-text'>buy now</div>", "<form><p>mail</p></form>", "<script>x='</p>'</script>"]))
        blocks.append(rng.choice(["<p>{}</p>", "<p>{}", "<div><p>{}</p></div>"]).format(line))
    inner = "\n".join(blocks)
    kind = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class='entry-content'>{}</div>", "<section>{}</section>", "<div role='main'>{}</div>"])
    comments = rng.choice(["", "<div class='comments-area'><p>{0}</p></div>", "<article class='comment'><p>{0}</p></article>", "<section id='comments'><article><p>{0}</p></article></section>"])
    side = rng.choice(["", "<div class='sidebar-widget'><p>{0}</p></div>", "<article class='teaser'><p>{0}</p></article>", "<div class='cookie-text'>{0}</div>"])
    menu = "<nav>" + "".join(f"<a href='{i}'>Item {i}</a>" for i in range(5)) + "</nav>"
    page = f"<html><head><title>t</title></head><body class='no-sidebar'>{menu}{side.format(sentence())}{kind.format(inner)}{comments.format(sentence())}<footer><p>{sentence()}</p></footer></body></html>"
    return page, "\n".join(text)


def test_generated_pages_with_and_without_marks():
    for seed in range(400):
        page, text = brute_page(seed)
        assert extract(page) == text, page


def test_a_very_long_page():
    lines = [f"{LONG} {i}" for i in range(30_000)]
    assert extract("<nav>m</nav><div>" + "".join(f"<p>{line}" for line in lines) + "</div>") == "\n".join(lines)
