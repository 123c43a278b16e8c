"""Link extraction and anchor documents."""

import random

import pytest

from siftrank import anchor_documents, anchor_experiment, experiment
from siftrank.operators.links import (
    anchor_text_documents,
    extract_links,
    gather_anchors,
    page_keys,
)
from siftrank.operators.topics import last_wins
from siftrank.sources.text import parse_topics, topics_from_text

PAGES = "doc_id string, url string, html string"


def links(spark, html, url="http://a.nl/p", **options):
    page = spark.createDataFrame([("p1", url, html)], PAGES)
    found = extract_links(page, **options).orderBy("pos").collect()
    return [(r.target_url, r.anchor_text) for r in found]


def test_comments_inside_an_anchor_leave_their_spaces(spark):
    note = "<ul><li><a class=ref href=/guide/>read <!-- v2 --> the<i>guide</i></a><li>end</ul>"
    assert links(spark, note, "http://docs.example/start") == [
        ("http://docs.example/guide", "read   the guide ")
    ]
    page = spark.createDataFrame([("k7", "http://docs.example/start/index.htm", note)], PAGES)
    assert page_keys(page).collect() == [("http://docs.example/start", "k7")]


def test_anchors_come_by_source_and_place(spark):
    """Three pages speak of a fourth, one of them twice and of others in between."""
    rows = [("m", "http://wiki.example/tea", None)]
    for name, words in (("c", ["leaf"]), ("a", ["hot drink", "tea"]), ("b", ["green\ttea"])):
        body = " / ".join(f"<a href=tea>{w}</a> <a href=cup>cup</a>" for w in words)
        rows.append((name, f"http://wiki.example/{name}", body))
    pages = spark.createDataFrame(rows, PAGES).repartition(2)
    (found,) = anchor_documents(pages).collect()
    assert found.anchors == ["hot drink", "tea", "green tea", "leaf"]
    assert (found.doc_id, found.url, found.n_left_out) == ("m", "http://wiki.example/tea", 0)
    (text,) = anchor_text_documents(anchor_documents(pages), with_url=False).collect()
    assert text.text.split("\t") == found.anchors


def test_only_pages_that_others_link_to_come_out(spark):
    """A ring of pages with one broken link, and links out of the collection."""
    ring = [
        (f"r{k}", f"http://ring.example/{k}", f"<a href={(k + 1) % 5}>to {k}</a><a href=//off/{k}>off</a>")
        for k in range(5)
        if k != 3
    ]
    found = anchor_documents(spark.createDataFrame(ring, PAGES)).collect()
    assert sorted((r.doc_id, r.anchors) for r in found) == [
        ("r0", ["to 4"]),
        ("r1", ["to 0"]),
        ("r2", ["to 1"]),
    ]


def test_links_of_pages_without_an_id_count(spark):
    rows = [(None, "http://p.example/x", "<a href=y>from nowhere</a>"), ("y", "http://p.example/y", "<a href=x>back</a>")]
    found = anchor_documents(spark.createDataFrame(rows, PAGES)).collect()
    assert [(r.doc_id, r.anchors) for r in found] == [("y", ["from nowhere"])]


@pytest.mark.parametrize(
    ("tag", "kept"),
    [
        ("<a rel=nofollow href=x>t</a>", False),
        ('<a href=x rel="nofollow">t</a>', False),
        ("<a href=x REL='NoFollow'>t</a>", False),
        ('<a href=x rel="external nofollow">t</a>', True),
        ("<a href=''>t</a>", False),
        ("<A HREF=x>t</A>", True),
        ("<area href=x>t</area>", False),
        ("<script><a href=x>t</a></script>", False),
        ("<script><a href=x>t</a>", True),
    ],
)
def test_which_tags_are_links(spark, tag, kept):
    assert bool(links(spark, tag)) == kept


def test_last_href_of_a_tag_counts(spark):
    assert links(spark, "<a href=x data-href=y>t</a>") == [("http://a.nl/y", "t")]


def test_elements_are_taken_apart_as_found(spark):
    html = "<a name=n>one</a> <a href=x\n class='c'>two\n<b>three</b></a><a href='y'><img></a>"
    assert links(spark, html) == [("http://a.nl/x", "two  three "), ("http://a.nl/y", " ")]


def test_pages_are_searched_whole_or_up_to_a_limit(spark):
    html = " " * 50_000 + "<a href=x>t</a>"
    assert links(spark, html) == [("http://a.nl/x", "t")]
    assert links(spark, html, page_chars=50_000) == []
    assert links(spark, html[5:], page_chars=50_009) == []
    assert links(spark, html[5:], page_chars=50_010) == [("http://a.nl/x", "t")]


def test_pages_keep_their_scheme(spark):
    pages = spark.createDataFrame(
        [("p", "https://b.nl/", ""), ("q", "http://a.nl", "<a href=https://b.nl>t</a>")], PAGES
    )
    assert anchor_documents(pages).collect() == []
    found = anchor_documents(pages, normalise_scheme=True).collect()
    assert [tuple(r) for r in found] == [("p", "http://b.nl", ["t"], 0)]


def gathered(pages, **options):
    return sorted((r.doc_id, r.url, tuple(r.anchors)) for r in gather_anchors(pages, **options).collect())


def test_smallest_id_counts_where_pages_share_a_url(spark):
    pages = spark.createDataFrame(
        [("p9", "http://b.nl/", ""), ("p3", "http://b.nl", None), ("q", "http://a.nl", "<a href=http://b.nl>t</a>")],
        PAGES,
    )
    for salts in (1, 3):
        assert gathered(pages.repartition(3), salts=salts) == [("p3", "http://b.nl", ("t",))]


def expected_anchors(pages, found, max_chars):
    ids = {}
    for doc_id, url, _ in pages:
        ids[url] = min(doc_id, ids.get(url, doc_id))
    out = {}
    for src, pos, target, anchor in sorted(found):
        if target not in ids:
            continue
        text = out.setdefault((ids[target], target), [])
        if len(target) + sum(len(a) + 1 for a in text) < max_chars:
            text.append(anchor)
    return sorted((d, u, tuple(a)) for (d, u), a in out.items() if a)


@pytest.mark.parametrize("max_chars", [10, 25, 60, 400, 10_000_000])
@pytest.mark.parametrize("salts", [1, 4])
def test_anchor_limit_against_brute_force(spark, max_chars, salts):
    """One page receives most of the links."""
    rng = random.Random(max_chars)
    pages = []
    for i in range(60):
        targets = rng.choices(["http://s/0", f"http://s/{rng.randrange(60)}", "/x"], [3, 2, 1], k=5)
        html = "".join(f"<a href={t}>{'w' * rng.randrange(6)}</a>" for t in targets)
        pages.append((f"p{i}", f"http://s/{i}", html))
    frame = spark.createDataFrame(pages, PAGES).repartition(6)
    found = [tuple(r) for r in extract_links(frame).collect()]
    expected = expected_anchors(pages, found, max_chars)
    assert gathered(frame, max_chars=max_chars, salts=salts) == expected
    whole = {r.url: len(r.anchors) for r in gather_anchors(frame).collect()}
    for r in gather_anchors(frame, max_chars=max_chars, salts=salts).collect():
        assert r.n_left_out == whole[r.url] - len(r.anchors)


def test_links_meet_pages_before_they_are_sorted(spark, tmp_path):
    folder = str(tmp_path / "pages")
    spark.createDataFrame([("p", "http://a", "")], PAGES).write.parquet(folder)
    plan = gather_anchors(spark.read.parquet(folder), max_chars=100, salts=4)
    text = plan._jdf.queryExecution().executedPlan().toString()
    lines = text.split("\n")
    join = next(k for k, line in enumerate(lines) if "ShuffledHashJoin" in line)
    # the pages' text is read once, their ids and URLs once more
    scans = [k for k, line in enumerate(lines) if "FileScan" in line]
    texts = [k for k in scans if "html" in lines[k].split("Batched")[0]]
    assert len(scans) == 2 and len(texts) == 1
    assert not any("Sort [" in line for line in lines[join : texts[0]])


def test_anchors_scored_without_gluing(spark):
    rng = random.Random(6)
    pages = [
        (f"p{i}", f"http://s/{i}", "".join(f"<a href={rng.randrange(12)}>w{rng.randrange(5)} w{rng.randrange(5)}</a>" for _ in range(6)))
        for i in range(10)
    ]
    frame = spark.createDataFrame(pages, PAGES).repartition(3)
    asked = last_wins(parse_topics(topics_from_text(spark, "1:w1 w2\n2:w3 s\n3:http 4 unseen")))
    glued = experiment(anchor_text_documents(anchor_documents(frame)), asked)
    columns = ("qid", "model", "rank", "doc_id")
    summed = anchor_experiment(frame, asked)
    assert sorted(map(tuple, summed.select(*columns).collect())) == sorted(
        map(tuple, glued.select(*columns).collect())
    )
