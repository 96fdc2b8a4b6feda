import html
import random
import re

import pytest
from busloom.llm.html_extract import extract, extract_main_text

ARTICLE = "<article><h1>Title &amp; more</h1><p>One, two,   three and\n four.</p><p>Five &lt;six&gt; seven, eight.<br>Nine</p></article>"
WANT = "Title & more\nOne, two, three and four.\nFive <six> seven, eight. Nine"


def test_boilerplate_goes():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p><p>no, no, no";</script></head><body>
    <header><p>Site, name, here</p></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies, really, we do, a lot.</div>
    <!-- <p>comment, in, html</p> --><div id="sideBar"><p>Side, bar, text, with, commas</p></div>{ARTICLE}<form><p>Sign, up</p><input></form>
    <section class="comments"><article class="comment"><p>Reader, says, so, much, more, than, the, article, does, and, more, of, it, yes.</p></article></section>
    <aside>Aside, too</aside><footer><p>&copy; all, rights</p></footer></body></html>"""
    assert extract(page) == WANT


def test_without_semantic_tags():
    text = "".join(f"<p>Paragraph {i}, with some commas, and enough words to count as a piece of prose.</p>" for i in range(4))
    page = f"<body><div class=top><a href=1>one</a> <a href=2>two</a></div><div><div>{text}</div><div><p>Last, part of it.</p></div></div><div><ul><li><a href=3>three</a><li><a href=4>four</a></ul></div></body>"
    assert extract(page).split("\n") == [f"Paragraph {i}, with some commas, and enough words to count as a piece of prose." for i in range(4)] + ["Last, part of it."]


def test_broken_pages():
    assert extract(None) == extract("") == extract("<!-- open") == extract("<script>x") == extract("<p></p>") == ""
    assert extract("plain  text &eacute;&#8364;&#x41;") == "plain text é€A"
    assert extract("<p>a<p>b</div></p>c") == "a\nb\nc"
    assert extract(ARTICLE[:-30] + "<a href='") .startswith("Title & more\nOne, two, three and four.\nFive <six>")
    assert extract("<article><p title='a > b'>x, y</p><p onclick=\"f('<p>')\">z</p></article>") == "x, y\nz"
    assert extract("<ARTICLE><P>up &AMP; down</P></ARTICLE>") == "up & down"
    assert extract("<article><p>" + "word, " * 50_000 + "</p></article>").count("word") == 50_000
    assert extract("<div>" * 20_000 + "deep" + "</section>" * 20_000 + "</div>" * 20_000) == "deep"
    assert extract("<html><head><title>t</title><body><p>No end of the head, yes.</p>") == "No end of the head, yes."
    assert extract("a < b and c <3 d") == "a < b and c <3 d"


LONG = "A paragraph, with commas, that reads like prose and goes on for a while, as paragraphs of articles do."


def test_names_are_points():
    """What an article holds stays whatever its name, unless the name says nothing else or the text is too little."""
    inside = f"<header><h1>Head</h1></header><p>{LONG}</p>"
    kept = [f'<p class="legal">{LONG} {LONG}</p>', f'<section class="related-work"><p>{LONG}</p></section>', f'<div class="notice"><p>{LONG}</p><p>{LONG}</p></div>', f'<div id="tags"><p>{LONG} {LONG}</p></div>', f'<section id="social-history"><p>{LONG}</p></section>', "<p><label>Label</label> text</p>", f'<div class="no-comments"><p>{LONG}</p></div>', '<ul><li><a href=1>Ref one, 1999</a></li><li><a href=2>Ref two, 2001</a></li></ul>', f'<div data-id="comments" aria-hidden="false"><p>{LONG}</p></div>']
    gone = ['<p class="legal">All rights.</p>', f'<div class="comments"><p>{LONG}</p><p>{LONG}</p></div>', f'<div class="cookie-notice"><p>{LONG}</p></div>', f'<div class="sidebar-box"><p>{LONG}</p></div>', f"<nav><p>{LONG}</p></nav>", f"<div hidden><p>{LONG}</p></div>", f'<div style="display: none"><p>{LONG}</p></div>', f"<footer><p>{LONG}</p></footer>", "<form><label>Mail</label><input></form>", '<div class="shareLinks"><a href=1>x</a></div>', f'<div role="alert"><p>{LONG}</p></div>']
    strip = lambda h: [x for x in (" ".join(re.sub("<[^>]+>", "" if "</li>" not in h else "|", b).split()).strip("|") for b in re.split(r"</p>|</li>", h)) if x]
    for k in kept:
        for body in (f"<article>{inside}{k}</article>", f"<article>{inside}{k}{''.join(gone)}</article>"):
            assert extract(f"<body><nav><a href=0>Home</a></nav>{body}</body>").split("\n") == ["Head", LONG, *strip(k)], k
    for g in gone:
        assert extract(f"<body><article>{inside}{g}<p>Last, one.</p></article></body>").split("\n") == ["Head", LONG, "Last, one."], g


def test_inline_noise():
    for noise in ('<span class="advert"><b>Buy <i>now</i></b></span>', "<span hidden>no <b>no</b></span>", '<span class="ad">a<span>b</span>c</span>', '<b style="visibility:hidden">x<br>y</b>'):
        assert extract(f"<article><p>One, {noise} two</p><p>Three</p></article>") == "One, two\nThree", noise
    assert extract('<article><p>One <span class="advert">open</p><p>Two</p></article>') == "One\nTwo"
    assert extract('<article><p>One <img class="ad">two</p></article>') == "One two"


def test_wrappers_stay():
    """A name, or a form, around the whole page says nothing of the article."""
    for before, after in (('<div class="has-sidebar">', "</div>"), ('<div class="sidebar">', "</div>"), ("<form>", "</form>"), ('<div id="comments">', "</div>")):
        assert extract(f"<body>{before}<div><p>{LONG}</p><p>{LONG}</p></div>{after}</body>") == f"{LONG}\n{LONG}"
    assert extract(f"<body><article><p>{LONG}</p></article><article><p>{LONG}</p></article></body>") == f"{LONG}\n{LONG}"


def made(seed):
    """A page and the text of its article."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(2, 9)))
    prose = lambda n: " ".join(word() + r.choice(["", "", ",", "."]) for _ in range(n))
    blocks, want = [], []
    for _ in range(r.randrange(4, 12)):
        t = prose(r.randrange(15, 60))
        kind = r.randrange(7)
        if kind < 4:
            blocks.append(f"<p>{html.escape(t)}</p>")
        elif kind == 4:
            t = prose(4)
            blocks.append(f"<h2>{t}</h2>")
        elif kind == 5:
            a, b = t.split(" ", 1)
            blocks.append(f"<p><a href='x'>{a}</a>  <!-- x -->\n {b.replace(',', '&#44;')}")
        else:
            items = [prose(12) for _ in range(3)]
            blocks.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            want += items
            continue
        want.append(t)
    noise = lambda: r.choice([
        "<nav><ul>" + "".join(f"<li><a href=/{i}>{word()}</a></li>" for i in range(5)) + "</ul></nav>",
        f"<div class='{r.choice(['ad', 'cookie-notice', 'newsletter-box', 'comments', 'sidebar', 'share', 'promo'])}'><p>{prose(30)}</p><p>{prose(20)}</p></div>",
        f"<aside><p>{prose(40)}</p></aside>", f"<form><p>{prose(9)}</p><label>{word()}</label><input name=q></form>", f"<footer>{prose(12)}</footer>",
        f"<script>var x = '<p>{prose(30)}</p>';</script>", "<ul>" + "".join(f"<li><a href=/{i}>{word()}</a>" for i in range(4)) + "</ul>", f"<header><p>{prose(9)}</p></header>"])
    tag = r.choice(["article", "main", "div", "div class='post-content'", "div id='story'"])
    shell = lambda: "".join(noise() for _ in range(r.randrange(4)))
    return f"<html><head><title>{prose(3)}</title></head><body>{shell()}<{tag}>{''.join(blocks)}</{tag.split()[0]}>{shell()}</body></html>", want


@pytest.mark.parametrize("seed", range(200))
def test_made_pages(seed):
    """The true text of each page is known from how it was made."""
    page, want = made(seed)
    assert extract(page).split("\n") == [" ".join(w.split()) for w in want]


def test_table(spark):
    data = [(1, "u", ARTICLE), (1, "u", ARTICLE), (None, None, None), (3, "v", "")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "'c' as text", "'c' as n_chars", "'c' as __text")
    got = sorted(map(tuple, extract_main_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", WANT, len(WANT))] * 2 + [(None, None, "", 0), (3, "v", "", 0)], key=str)
    assert extract_main_text(pages.limit(0)).collect() == []


def test_points_reach_far_up():
    """A text many wrappers deep still speaks for the container that holds them all."""
    wrapped = "".join("<div>" * 30 + f"<p>Sentence {i}, which is long enough, says something of the matter at hand.</p>" + "</div>" * 30 for i in range(6))
    page = f"<body><div><div><p>Short aside, one line only, that stands alone.</p></div></div><div>{wrapped}</div></body>"
    assert extract(page).count("Sentence") == 6
