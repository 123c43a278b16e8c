"""Blocks of pages, suffix classes against plain substrings, and whole pages."""

import random

import numpy as np
import pytest

from siftrank.llm import main_text
from siftrank.llm.main_text import (
    ARTICLE,
    LONG,
    _chosen,
    covered_tokens,
    main_texts,
    page_blocks,
)


def texts(html):
    return [t for _, t in page_blocks(html)]


def test_blocks():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head>"
        "<body><nav><ul><li><a href='/'>Home</a></ul></nav><!-- <p>no</p> -->"
        "<div class='cookie-notice'>We use cookies</div><div class=\"ad\">Buy</div>"
        "<article><header><h1>A &amp; B</h1><p>by someone</p></header><p><b>First  para.<br>Same"
        "<p>Second &lt;x&gt; <em>para</em>.</p><aside>See also</aside><form>Mail <input></form>"
        "<ul><li>one<li>two</ul><section id='comments'><p>Nice!</p></section></article>"
        "<footer>&copy; x</footer></body>"
    )
    assert page_blocks(page) == [
        (ARTICLE, t) for t in ("A & B", "First para. Same", "Second <x> para.", "one", "two")
    ]


def test_broken_markup():
    assert texts("a < b and <p>c") == ["a < b and", "c"]
    assert texts("<div hidden>x</div><p style='display:none'>y</p><p>z") == ["z"]
    assert texts("<p title=\"unclosed>x</p><p>y</p>")[-1] == "y"
    assert texts("<script>never closed <p>x") == []
    assert texts("</div></p>x") == ["x"]
    assert len(texts("<div>" * 3000 + "deep")) == 1


def test_covered_tokens_are_repeated_substrings():
    r = random.Random(3)
    passage = [r.randrange(50) for _ in range(LONG + 3)]
    for _ in range(40):
        pages = [[r.randrange(50) for _ in range(r.randint(0, 30))] for _ in range(6)]
        for page in pages[:3]:
            at = r.randrange(len(page) + 1)
            page[at:at] = passage
        windows = {}
        for k, page in enumerate(pages):
            for i in range(len(page) - LONG + 1):
                windows.setdefault(tuple(page[i : i + LONG]), set()).add(k)
        want = []
        for page in pages:
            own = [False] * len(page)
            for i in range(len(page) - LONG + 1):
                if len(windows[tuple(page[i : i + LONG])]) >= 3:
                    own[i : i + LONG] = [True] * LONG
            want += own
        tokens = np.array([t for p in pages for t in p], dtype=np.uint64)
        page_of = np.repeat(np.arange(6), [len(p) for p in pages])
        assert covered_tokens(tokens, page_of, 6, 3, 0.1).tolist() == want


def test_whole_pages(spark):
    menu = "<div>Home News Sport Weather Contact us about our site today</div>"
    end = "<div>With the best wishes of the whole team in Enschede</div>"
    rows = [
        (k, f"https://a.nl/{k}", f"{menu}<div>Page {k} has words like x{k} y{k}</div><p>unique {k}</p>{end}")
        for k in range(6)
    ]
    shared = "<article><p>The same sentence stands in each of these articles here.</p></article>"
    rows += [(20 + k, f"https://b.nl/{k}", menu + shared) for k in range(5)]
    rows += [(30, None, None), (31, "http://c.nl", ""), (32, "x", "<p>a &amp; b"), (None, "http://d.nl", "<p>q")]
    rows += [rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "1 AS id", "'h' AS host", "'t' AS text", "0 AS shard"
    )
    found = sorted(((r.page_id, r.text, r.n_chars) for r in main_texts(pages).collect()), key=repr)
    own = [(k, f"Page {k} has words like x{k} y{k}\n\nunique {k}") for k in (0, *range(6))]
    own += [(20 + k, "The same sentence stands in each of these articles here.") for k in range(5)]
    own += [(30, ""), (31, ""), (32, "a & b"), (None, "q")]
    assert found == sorted(((k, t, len(t)) for k, t in own), key=repr)
    assert main_texts(pages.where("false")).collect() == []


def test_large_hosts_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr("siftrank.llm.main_text.SHARD_CHARS", 2_000)
    menu = "<div>Home News Sport Weather Contact us about our site today</div>"
    rows = [(k, "http://a.nl/x", f"{menu}<p>page number {k} of {k * 7} and {k * 3}</p>") for k in range(200)]
    found = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in found.collect()} == {
        k: f"page number {k} of {k * 7} and {k * 3}" for k in range(200)
    }


def found(spark, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in main_texts(pages, **options).collect()}


MENU = "<div>Home News Sport Weather Contact us about our site today</div>"


@pytest.mark.parametrize(
    "page",
    [
        '<body class="has-sidebar"><article>{}</article><div class="sidebar">x</div></body>',
        '<html class="no-ads"><article>{}</article></html>',
        '<body class="single comments-open"><main>{}</main></body>',
        '<article class="post sponsored-by-none">{}</article>',
        '<div class="layout has-sidebar"><article>{}</article></div>',
        '<form id="aspnet"><header>Top</header><article>{}</article><input></form>',
        '<div class="newsletter"><article>{}</article></div>',
        '<div id="content"><p>{}</p><article class="card">A teaser</article></div>',
        '<main>{}<nav>no</nav><div class="comments">Nice!</div></main><div>little</div>',
    ],
)
def test_classes_and_zones_do_not_empty_pages(page):
    own = "The page's own words, rather many of them, so that all else is little beside them."
    blocks = page_blocks(page.format(own))
    assert [t for _, t in blocks if t not in ("A teaser", "little")] == [own]
    none = np.empty(0, np.uint64)
    assert _chosen([blocks], np.zeros(1, np.uint64), (none, none)) == [own]


def test_pages_with_text_beside_a_card(spark):
    body = " ".join(f"word{k}" for k in range(60))
    rows = [(1, "http://a.nl", f"<div id=content><p>{body}</p></div><article>Read more</article>")]
    rows += [(2, "http://a.nl", "<article>Short</article><div>Some line</div>")]
    assert found(spark, rows) == {1: body, 2: "Short"}


@pytest.mark.parametrize(("n", "words"), [(12, 3), (12, 3000), (120, 30), (5, 60_000)])
def test_hosts_and_pages_of_any_size(spark, n, words):
    """The same menu goes from all pages, whatever their number and length."""
    own = {k: " ".join(f"x{k}y{j}" for j in range(words)) for k in range(n)}
    rows = [(k, f"http://a.nl/{k}", f"{MENU}<p>{own[k]}</p>") for k in range(n)]
    assert found(spark, rows) == own


def test_passages_and_copies_stay(spark):
    """What articles share stays, at the same place or not, and so do copies of pages."""
    r = random.Random(5)
    passage = "this passage of rather many words stands in all of these articles as it is"
    rows, own = [], {}
    for k in range(40):
        parts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(20)) for _ in range(6)]
        parts[r.randrange(6) if k % 2 else 0] = passage
        own[k] = "\n\n".join(parts)
        rows.append((k, "http://a.nl/p", MENU + "<article>" + "".join(f"<p>{x}" for x in parts) + "</article>"))
    for k in range(40, 60):
        rows.append((k, "http://a.nl/q", rows[2][2]))
        own[k] = own[2]
    assert found(spark, rows) == own


def test_other_ways_give_the_same(spark, monkeypatch):
    """Substrings joined by host instead of sent, and streams of a page or two."""
    r = random.Random(6)
    rows = []
    for k in range(60):
        host = r.choice(["a.nl", "b.nl", "hot.nl", "hot.nl", "hot.nl"])
        body = "".join(f"<p>{' '.join(f'v{r.randrange(40)}' for _ in range(r.randrange(14)))}" for _ in range(5))
        rows.append((k, f"http://{host}/{k}", r.choice([MENU, MENU, ""]) + body + r.choice([MENU, ""])))
    expected = found(spark, rows)
    assert expected == brute(rows)
    monkeypatch.setattr(main_text, "SENT_ROWS", 0)
    monkeypatch.setattr(main_text, "SHARD_CHARS", 300)
    assert found(spark, rows) == expected


def brute(rows, least=3):
    """Every window of every page of a host, one by one, where the library would look."""
    pages, places = {}, {}

    def windows(stream, blocks):
        for start in stream.starts(stream.numbers()):
            block = stream.block[start]
            behind = len(blocks) - 1 - block
            place = ("front", block) if block <= behind else ("back", behind)
            yield start, (tuple(stream.tokens[start : start + LONG]), place)

    for k, url, html in rows:
        blocks = [t for _, t in page_blocks(html)]
        pages[k] = (url.split("/")[2], blocks, main_text._Stream([[(0, t) for t in blocks]]))
        host, blocks, stream = pages[k]
        for _, window in windows(stream, blocks):
            places.setdefault((host, window), set()).add(int(stream.contents()[0]) >> 58)
    out = {}
    for k, (host, blocks, stream) in pages.items():
        covered = [False] * len(stream.tokens)
        for start, window in windows(stream, blocks):
            if len(places[host, window]) >= least:
                covered[start : start + LONG] = [True] * LONG
        kept = []
        for b, text in enumerate(blocks):
            own = [c for c, x, w in zip(covered, stream.block, stream.is_word) if x == b and w]
            if 2 * sum(own) <= len(own):
                kept.append(text)
        out[k] = "\n\n".join(kept)
    return out


def test_a_very_long_page(spark):
    text = "\n\n".join(f"line {k} of a long page" for k in range(100_000))
    html = "<nav>menu</nav>" + "".join(f"<p>{t}" for t in text.split("\n\n"))
    assert found(spark, [(1, "http://a.nl", html), (2, "http://a.nl", "<p>x")]) == {1: text, 2: "x"}
