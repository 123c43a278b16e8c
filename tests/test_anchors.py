"""Anchor text in parts, the filter before it, and the files made of it."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from siftrank import anchor_documents, anchor_parts, read_anchors
from siftrank.operators.anchors import whole_anchors
from siftrank.operators.links import anchor_hits, extract_links, links_to_pages
from siftrank.operators.membership import member_bits, possible_members
from siftrank.sinks.anchors import write_anchor_parts
from siftrank.sinks.text import write_anchors

PAGES = "doc_id string, url string, html string"


def hot_pages(seed, n=60):
    """Most links lead to one page, many out of the collection; some repeat."""
    rng = random.Random(seed)
    pages = []
    for i in range(n):
        targets = rng.choices(
            ["http://s/0", f"http://s/{rng.randrange(n)}", "http://off/x"], [3, 1, 1], k=6
        )
        html = "".join(f"<a href={t}>{'w' * rng.randrange(9)}</a>" for t in targets)
        pages.append((None if i % 9 == 5 else f"p{i}", f"http://s/{i}", html))
    return pages + pages[:3]


def expected_parts(pages, found, max_chars, part_chars):
    ids = {}
    for doc_id, url, _ in pages:
        if doc_id is not None:
            ids[url] = min(doc_id, ids.get(url, doc_id))
    links = {}
    for src, pos, target, anchor in sorted(found, key=lambda r: (r[0] is not None, r)):
        if target in ids:
            links.setdefault(target, []).append(anchor)
    out = []
    for url, anchors in links.items():
        before, parts, kept = 0, {}, 0
        for anchor in anchors:
            if max_chars is None or len(url) + before < max_chars:
                parts.setdefault(before // part_chars, []).append(anchor)
                kept += 1
            before += len(anchor) + 1
        for part, texts in parts.items():
            out.append((ids[url], url, part, part == max(parts), tuple(texts), len(anchors) - kept))
    return sorted(out)


def rows_of(parts):
    return sorted((r.doc_id, r.url, r.part, r.last, tuple(r.anchors), r.n_left_out) for r in parts.collect())


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("limits", [(None, 50), (None, 10**6), (45, 7), (300, 100)])
def test_parts_against_brute_force(spark, seed, limits):
    pages = hot_pages(seed)
    frame = spark.createDataFrame(pages, PAGES).repartition(6)
    found = [tuple(r) for r in extract_links(frame).collect()]
    max_chars, part_chars = limits
    parts = anchor_parts(frame, max_chars=max_chars, part_chars=part_chars, ranges=4)
    expected = expected_parts(pages, found, max_chars, part_chars)
    assert rows_of(parts) == expected
    whole = {r.url: r for r in whole_anchors(parts).collect()}
    for url, row in whole.items():
        texts = [t for r in expected if r[1] == url for t in r[4]]
        assert row.anchors == texts


def test_a_filter_of_hosts_changes_nothing(spark, monkeypatch):
    frame = spark.createDataFrame(hot_pages(4), PAGES).repartition(3)
    expected = rows_of(anchor_parts(frame, part_chars=60, ranges=4))
    monkeypatch.setattr("siftrank.operators.anchors.HOSTS_FROM", 0)
    assert rows_of(anchor_parts(frame, part_chars=60, ranges=4)) == expected


def test_rows_of_a_hot_url_are_bounded(spark):
    pages = [("m", "http://s/m", "")]
    pages += [(f"p{i:04d}", f"http://s/{i}", f"<a href=m>{'x' * 30}</a>" * 4) for i in range(500)]
    frame = spark.createDataFrame(pages, PAGES).repartition(4)
    parts = anchor_parts(frame, part_chars=1000, ranges=4).collect()
    assert len(parts) == 62 and sum(len(r.anchors) for r in parts) == 2000
    assert max(sum(len(a) + 1 for a in r.anchors) for r in parts) <= 1000 + 31
    assert sorted(r.part for r in parts) == list(range(62))
    assert [r.part for r in parts if r.last] == [61]


def test_files_from_parts_are_those_from_rows(spark, tmp_path):
    frame = spark.createDataFrame(hot_pages(3), PAGES).repartition(3)
    parts, rows = str(tmp_path / "parts"), str(tmp_path / "rows")
    write_anchor_parts(anchor_parts(frame, part_chars=20, ranges=4), parts)
    write_anchors(anchor_documents(frame), rows)

    def lines(folder):
        return sorted(r.value for r in spark.read.text(folder).collect())

    assert lines(parts) == lines(rows)
    assert read_anchors(spark, parts).count() == len(lines(rows))
    names = [p.name for p in (tmp_path / "parts").iterdir()]
    assert "_temporary" not in names and "_SUCCESS" in names
    for path in (tmp_path / "parts").glob("*.gz"):
        assert gzip.decompress(path.read_bytes()).endswith((b"\n", b"")) and "part-" in path.name
    with pytest.raises(FileExistsError):
        write_anchor_parts(anchor_parts(frame), parts)


def test_nothing_comes_of_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    assert anchor_parts(none).collect() == []
    out = str(tmp_path / "none")
    write_anchor_parts(anchor_parts(none), out)
    assert spark.read.text(out).collect() == []


def test_no_member_is_held_back(spark):
    keys = spark.range(0, 3000, 3).select(F.concat(F.lit("k"), "id").alias("key"))
    rows = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("v"), "id", F.lit(1).alias("words"))
    rows = rows.unionByName(spark.createDataFrame([(None, 7, 1)], "v string, id long, words int"))
    for bits, most in ((1 << 20, 1010), (1 << 12, 1600)):
        found = possible_members(rows, "v", keys, "key", bits)
        ids = {r.id for r in found.collect()}
        assert ids >= set(range(0, 3000, 3)) and len(ids) < most
        assert found.columns == rows.columns
        assert member_bits(keys, "key", bits).count() <= bits // 4096
    assert possible_members(rows, "v", keys.where("false"), "key").count() == 0
    with pytest.raises(ValueError):
        member_bits(keys, "key", 1000)


def test_links_out_of_the_collection_are_not_shuffled(spark, tmp_path):
    """They are held back between the page's search and the shuffle."""
    pages = [
        (f"p{i}", f"http://s/{i}", f"<a href={i + 1}>in</a>" + "<a href=//off/x>out</a>" * 20)
        for i in range(100)
    ]
    folder = str(tmp_path / "pages")
    spark.createDataFrame(pages, PAGES).write.parquet(folder)
    frame = spark.read.parquet(folder)
    links = links_to_pages(frame, hold_back=True)
    links.collect()
    lines = links._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n")
    text = next(k for k, line in enumerate(lines) if "FileScan" in line and "html" in line.split("Batched")[0])
    exchange = max(k for k in range(text) if "Exchange hashpartitioning(url" in lines[k])
    assert any("BroadcastHashJoin" in line and "_bucket" in line for line in lines[exchange:text])
    found = extract_links(frame).withColumnRenamed("target_url", "url")
    assert found.count() == 2100
    keys = frame.select("url")
    assert possible_members(found, "url", keys, "url").count() in range(99, 102)


def test_hits_of_anchors_search_pages_once(spark, tmp_path):
    folder = str(tmp_path / "pages")
    spark.createDataFrame(hot_pages(1), PAGES).write.parquet(folder)
    plan = anchor_hits(spark.read.parquet(folder), ["w"])._jdf.queryExecution().executedPlan()
    scans = [line for line in plan.toString().split("\n") if "FileScan" in line]
    assert len(scans) <= 4
    assert len([line for line in scans if "html" in line.split("Batched")[0]]) == 1
