import random
import time

import pytest

from pairwright.llm.html_text import extract_text, main_text

LONG = "This is a sentence of the article, with commas; and more. " * 6


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("   ", ""), ("<!-- only -->", ""), ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two&nbsp;\n three", "one\n\ntwo three"),
        ("<nav><a href=/>Home</a></nav><script>var t='</p>';</script><style>p{}</style>", ""),
        ("<article><h1>T</h1><p>a <b>b</b>c<br>d</p></article>", "T\n\na bc d"),
        ("<p>&lt;b&gt; &#233; &eacute; &bogus;</p>", "<b> é é &bogus;"),
        ("<p>a<script>x</p>", "a"),
    ],
)
def test_small_pages(html, text):
    assert main_text(html) == text


def test_boilerplate_goes_and_short_blocks_of_the_article_stay():
    page = f"""<html><head><title>no</title></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/a">Menu one, two.</a></li><li><a>Menu</a></li></ul></nav><div class="ad">Buy this, now! Really. Now!</div>
    <div id="cookie-notice">We use cookies, as you know, for many reasons.</div>
    <article><header><h1>Heading</h1></header><p>{LONG}</p><p>Ok.</p><aside>Aside, text.</aside><form>Name: <input></form>
    <section class="comments"><p>{LONG}</p></section></article>
    <div class="sidebar"><p>{LONG}</p></div><footer>&copy; us, all rights.</footer></body></html>"""
    assert main_text(page) == f"Heading\n\n{LONG.strip()}\n\nOk."


def test_article_without_semantic_tags():
    page = f"<body><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><div><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert main_text(page) == f"Title\n\n{LONG.strip()}\n\n{LONG.strip()}"


@pytest.mark.parametrize("piece", ['<a "', "<p>", "<div>x", "<", "<a href=", "<script>", "<!--", "&amp", "</b>"])
def test_broken_pages_take_linear_time(piece):
    start = time.time()
    main_text(piece * 3000)
    assert time.time() - start < 20


def test_frame(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "clash"), (1, "u", None, "clash"), (2, None, "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["text"], r["n_chars"]) for r in extract_text(df).collect())
    assert got == [("", 0), ("", 0), (LONG.strip(), len(LONG.strip()))]
    assert extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "start, end",
    [
        ('<div class="site has-sidebar"><article>', "</article></div>"), ('<article class="post comments-open">', "</article>"),
        ('<div id="page" class="no-menu"><div>', "</div></div>"), ("<form action=/ method=post><div>", "</div></form>"),
        ("<form><main>", "</main></form>"), ("<main><form><div>", "</div></form></main>"), ('<div class="page sidebar"><article>', "</article></div>"),
    ],
)
def test_names_of_wrappers_and_a_page_wide_form(start, end):
    page = f"""<body>{start}<h1>Title</h1><p>{LONG}</p><p>{LONG}</p><div class="sidebar"><p>Other, more. Text.</p></div>
    <nav>Home, about us.</nav>{end}</body>"""
    assert main_text(page) == f"Title\n\n{LONG.strip()}\n\n{LONG.strip()}"


def test_boilerplate_that_is_longer_than_the_article_goes():
    article = f"<article><p>{LONG}</p><div class='comments'><p>{LONG * 4}</p></div></article>"
    assert main_text(f"<body>{article}<div class='sidebar'><p>{LONG * 9}</p></div></body>") == LONG.strip()
    assert main_text(f"<body><div><p>{LONG}</p></div><nav><p>{LONG * 9}</p></nav></body>") == LONG.strip()


@pytest.mark.parametrize("start, end", [("<article>", "</article>"), ("<main><div><article>", "</article></div></main>"), ('<div class="content">', "</div>")])
def test_short_blocks_in_containers_of_the_article_stay(start, end):
    long = "A sentence of some words, with more. " * 6
    page = f"""<body><nav><a href=/>Home</a></nav>{start}<p>{long}</p><table><tr><th>Year</th><td>1999</td></tr></table>
    <blockquote><p>A quoted sentence.</p></blockquote><section><h2>Part</h2><div><p>Short one.</p></div></section><p>{long}</p>{end}
    <div><a href=1>one</a></div></body>"""
    want = [long.strip(), "Year", "1999", "A quoted sentence.", "Part", "Short one.", long.strip()]
    assert main_text(page).split("\n\n") == want


LONG = ". ".join(["This is a sentence of the article, with some words in it"] * 4) + "."


def paragraphs(n):
    return "".join(f"<p>{i} {LONG}</p>" for i in range(n))


KEPT_OR_NOT = [
    ("<body><h1>Title</h1>" + paragraphs(3) + "<ul><li>one</li><li>two</li></ul></body>", ["Title", "one", "two"], []),
    (
        "<body><nav><a href=x>Home</a></nav><article><h2><a href=#s>Section</a></h2>" + paragraphs(3)
        + "<ul><li><a href=q>linked item</a></li></ul><blockquote><a href=z>A linked quotation.</a></blockquote></article></body>",
        ["Section", "linked item", "A linked quotation."], ["Home"],
    ),
    (
        '<body><div class="top"><a href=x>Home</a> <a href=y>About</a></div><div><h1>The title</h1><p>A lead.</p></div><div>'
        + paragraphs(4) + "</div></body>",
        ["The title", "A lead."], ["Home About"],
    ),
    (
        "<body><article>" + paragraphs(2) + '<section class="related-work"><p>Related work is here.</p></section><section id="market-share">'
        '<p>Market share grew.</p></section><p class="notice-period">The notice period is long.</p><h2 id="search">Search</h2>'
        '<div class="related-posts"><a href=a>Other post</a></div><div class="share-buttons">Share this</div>'
        '<div class="comments-area"><p>I liked this, really, a lot.</p></div><div class="sidebar-notes"><a href=a>Much of it linked</a></div></article></body>',
        ["Related work is here.", "Market share grew.", "The notice period is long.", "Search"],
        ["Other post", "Share this", "I liked this, really, a lot.", "Much of it linked"],
    ),
]


@pytest.mark.parametrize("html, kept, gone", KEPT_OR_NOT)
def test_article_text_is_kept_whole(html, kept, gone):
    blocks = main_text(html).split("\n\n")
    assert [k for k in kept if k not in blocks] == [] and [g for g in gone if g in blocks] == []
    assert f"0 {LONG}" in blocks and f"1 {LONG}" in blocks


def test_recall_and_precision_of_blocks_on_made_pages():
    """Articles put into frames of menus, notices and comments: every block of the article and nothing else."""
    rng = random.Random(12)
    frames = [
        "<html><body><header><a href=/>Home</a></header><article>{}</article><footer>All rights reserved.</footer></body></html>",
        '<body><div id="menu"><ul><li><a href=a>News</a></li></ul></div><div id="content">{}</div><div class="comments"><p>Nice one, thanks!</p></div></body>',
        '<body><div class="cookie-notice">We use cookies.</div><main><div class="ad">Buy now!</div><div>{}</div></main><aside><p>See also this.</p></aside></body>',
        '<body class="has-sidebar"><form>{}</form><div class="sidebar"><a href=x>Other</a></div></body>',
    ]
    off = {"Home", "All rights reserved.", "News", "Nice one, thanks!", "We use cookies.", "Buy now!", "See also this.", "Other"}
    for frame in frames:
        for _ in range(10):
            want, parts = [], []
            for i in range(rng.randint(4, 12)):
                kind = rng.choice(["p", "p", "p", "h2", "li", "blockquote", "td"])
                text = f"{i} {LONG}" if kind == "p" else f"{i} short {kind}"
                want.append(text)
                parts.append({"li": f"<ul><li>{text}</li></ul>", "td": f"<table><tr><td>{text}</td></tr></table>"}.get(kind, f"<{kind}>{text}</{kind}>"))
            want.append(f"end {LONG}")
            parts.append(f"<p>end {LONG}</p>")
            got = main_text(frame.format("".join(parts))).split("\n\n")
            assert got == want and not off.intersection(got)
