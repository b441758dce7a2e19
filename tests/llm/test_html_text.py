from __future__ import annotations

import random
import time

import pytest

from tidewater.llm.html_text import Paths, content, extract, main_text, text_nodes

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a><li>B</ul></nav><div id="cookie-notice">We use cookies, many of them.</div><div class="ad big">Buy now, buy well.</div>
<article><h1>Title &amp; more</h1><p>First   <b>bold</b>
line, long enough; yes.<p>Second&nbsp;line &lt;here&gt;, it goes on.<br>After the break.<!-- hidden --><form>Name: <input></form>
<ul><li>One<li>Two</ul><div class="share">Share</div></article>
<section id="comments"><p>Reader: what a long comment this is, really.</p></section><aside>Side</aside><footer>&copy; 2020</footer></body></html>"""


def test_page():
    assert main_text(PAGE) == "Title & more\nFirst bold line, long enough; yes.\nSecond line <here>, it goes on.\nAfter the break.\nOne\nTwo"


def test_without_semantic_tags():
    page = "<div class=x><a>Home</a><a>About</a></div><div class=y><p>A long text here, with many words; it goes on, and on.</p><p>Another text, with commas, and points. Also long enough.</p></div><div class=z><span>Links</span></div>"
    assert main_text(page) == "A long text here, with many words; it goes on, and on.\nAnother text, with commas, and points. Also long enough."


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<p>", ""), ("plain", "plain"), ("<p>a < b &amp; c", "a < b & c"), ("<article><p>cut off <b>here", "cut off here"), ("<script>only", ""), ("</p></div><p>x", "x"), ("<p title='a>b'>quoted</p>", "quoted"), ("<!-- open <p>never", "")])
def test_broken(page, text):
    assert main_text(page) == text


def test_deep_and_long():
    assert main_text("<div>" * 5_000 + "deep") == "deep"
    assert len(main_text("<p>" + "word, " * 100_000)) == 6 * 100_000 - 1


BODY = "<h1>Title</h1><p>A long text here, with many words; it goes on, and on.</p><p>Another text, with commas, and points. Also long enough.</p>"
TEXT = ["A long text here, with many words; it goes on, and on.", "Another text, with commas, and points. Also long enough."]


@pytest.mark.parametrize("wrap", ["<div class='content-sidebar-wrap'><main>{}</main></div>", "<div class='site no-sidebar'><article>{}</article></div>", "<div id=page class=has-sidebar><div>{}</div><div class=sidebar>Side links</div></div>", "<form id=aspnetForm><div>{}</div></form>", "<form id=aspnetForm><main>{}</main><div class=share>Share</div></form>"])
def test_wrappers_with_marks(wrap):
    lines = main_text("<body><nav>Home</nav>" + wrap.format(BODY) + "<footer>End</footer></body>").split("\n")
    assert [x for x in lines if x != "Title"] == TEXT


@pytest.mark.parametrize("teaser", ["story", "post"])
def test_teaser_does_not_hide_the_text(teaser):
    lines = main_text(f"<div class=x>{BODY}</div><div class={teaser}><p>Read more, here.</p></div>").split("\n")
    assert set(TEXT) <= set(lines)


def test_links_within_main_are_left_out():
    links = "<ul>" + "".join(f"<li><a href=/{k}>See the other page {k}</a></li>" for k in range(9)) + "</ul>"
    assert main_text(f"<main>{BODY}{links}</main>").split("\n")[-2:] == TEXT


def test_short_lines_beside_long_paragraphs():
    page = f"<article><h1>Title</h1><p>{'Long text, with commas; it goes on. ' * 40}</p><ul><li>One thing.<li>Two things.</ul></article>"
    assert main_text("<div class=ad>Buy now, buy well.</div>" + page).split("\n")[::2] == ["Title", "One thing."]
    assert main_text("<div class=ad>Buy now, buy well, and more.</div><article><h1>Short</h1><p>Short text.</article>") == "Short\nShort text."


def test_paths():
    paths = Paths()
    assert [(paths.name(n.path), n.text) for n in text_nodes("<div class='a b'><p>x <i>y</i></p></div>", paths)] == [("/div.a/p", "x y")]


def test_markup_that_is_never_closed():
    assert main_text("<article><p>one</p><svg/><p>two</p><svg></svg></article>") == "one\ntwo"
    assert main_text('<p title="x>hello</p>') == "hello"
    deep = "<div>" * 2_000 + "<nav>Home</nav><p>A text, of some length; it is deep.</p>" + "</div>" * 2_000 + "<footer>End</footer>"
    assert main_text(deep) == "A text, of some length; it is deep."
    began = time.perf_counter()
    main_text("<svg>" * 20_000 + "</x>" * 20_000 + "<p>text</p>" * 100)
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize("name", ["login-article", "ad-hoc"])
def test_words_in_class_names_lose_no_article(name):
    assert set(TEXT) <= set(main_text(f"<body><nav>Home</nav><div class='{name}'>{BODY}</div><footer>End</footer></body>").split("\n"))


def known_page(rng, kind):
    """A page and its article's blocks: with article elements, with class names, in bare divs, or in table cells."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() + rng.choice(["", "", "", "", ","]) for _ in range(n)) + "."
    blocks = [text(rng.randint(25, 90)) for _ in range(rng.randint(4, 12))]
    article = "".join(f"<p>{x}</p>" for x in blocks)
    links = "<ul>" + "".join(f"<li><a href=/{word()}>{word()} {word()}</a></li>" for _ in range(rng.randint(5, 20))) + "</ul>"
    other = "".join(f"<li><a href=/{word()}>{text(6)}</a></li>" for _ in range(6))
    wrap = {"element": "<nav>{l}</nav><article>{a}</article><aside><ul>{o}</ul></aside><footer>{w}</footer>", "class": "<div class=menu>{l}</div><div class=post-content>{a}</div><div class=sidebar><ul>{o}</ul></div><div class=footer>{w}</div>"}
    wrap |= {"bare": "<div>{l}</div><div><div>{a}</div></div><div><ul>{o}</ul></div><div><span>{w}</span></div>", "table": "<table><tr><td>{l}</td><td><div>{a}</div></td><td><ul>{o}</ul></td></tr><tr><td><font>{w}</font></td></tr></table>"}
    return "<html><body>" + wrap[kind].format(l=links, a=article, o=other, w=word()) + "</body></html>", blocks


@pytest.mark.parametrize("kind", ["element", "class", "bare", "table"])
def test_known_articles(kind):
    """Precision and recall in characters, over pages whose article is known."""
    rng = random.Random(kind)
    given = right = wanted = dropped = nodes = 0
    for _ in range(50):
        page, blocks = known_page(rng, kind)
        found = main_text(page).split("\n")
        given, wanted = given + sum(map(len, found)), wanted + sum(map(len, blocks))
        right += sum(len(x) for x in found if x in blocks)
        all_of = text_nodes(page)
        nodes, dropped = nodes + len(all_of), dropped + len(all_of) - len(content(all_of))
    assert right >= 0.98 * given and right >= 0.98 * wanted
    assert kind == "element" or kind == "class" or dropped > 0.3 * nodes  # no element or class says what to drop there: the ratios do


def test_rows(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = extract(pages).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) > 0 for r in rows)
    assert not any(w in r.text for r in rows for w in ("©", "track(", "</"))
    odd = spark.createDataFrame([(1, None, None, "c"), (None, "u", "<p>x", "c"), (None, "u", "<p>x", "c")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, extract(odd).collect()), key=repr) == sorted([(1, None, "", 0), (None, "u", "x", 1), (None, "u", "x", 1)], key=repr)
    assert extract(odd.limit(0)).count() == 0
