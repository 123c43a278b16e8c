"""The web-archive source on files written here."""

import gzip

import pytest
from pyspark import cloudpickle

from siftrank import anchor_documents, read_documents
from siftrank.sources.warc import list_files, read_warc, warc_documents, warc_pages


def record(doc_id, content, kind="response", extra="", lead="", url=None, length=None):
    body = content if isinstance(content, bytes) else content.encode()
    ids = f"WARC-TREC-ID: {doc_id}\n" if doc_id else ""
    head = (
        f"WARC/0.18\nWARC-Type: {kind}\nWARC-Date: 2009-01-01T00:00:00\n"
        f"WARC-Record-ID: <urn:uuid:{doc_id}>\n{ids}"
        f"WARC-Target-URI: {url or f'http://x.nl/{doc_id}'}\n{extra}"
        f"Content-Type: application/http\nContent-Length: {len(body) if length is None else length}\n\n"
    )
    return (head + lead).encode() + body + b"\n\n"


def read(spark, path, *data, **options):
    path.write_bytes(b"".join(data))
    return read_warc(spark, str(path), **options).orderBy("record_no").collect()


def test_record_fields(spark, tmp_path):
    extra = "X-Twice: one\nX-Twice: two: three\nno colon here\n"
    (found,) = read(spark, tmp_path / "a.warc", record("T1", "<p>hé</p>", extra=extra))
    assert (found.record_no, found.warc_type, found.warc_date) == (1, "response", "2009-01-01T00:00:00")
    assert (found.warc_record_id, found.content_type) == ("<urn:uuid:T1>", "application/http")
    assert found.headers == {
        "WARC-TREC-ID": "T1",
        "WARC-Target-URI": "http://x.nl/T1",
        "X-Twice": "two: three",
        "no colon here": "",
    }
    assert bytes(found.content).decode() == "<p>hé</p>"
    assert found.content_length == 10
    assert found.path.endswith("a.warc")


def test_only_responses_are_read(spark, tmp_path):
    data = [record("i", "info", "warcinfo"), record("a", "one"), record("q", "x", "request"), record("b", "two")]
    found = read(spark, tmp_path / "a.warc", *data)
    assert [(r.record_no, bytes(r.content)) for r in found] == [(1, b"one"), (2, b"two")]
    every = read_warc(spark, str(tmp_path / "a.warc"), record_type="")
    assert sorted(r.warc_type for r in every.collect()) == ["request", "response", "response", "warcinfo"]


def test_gzip_members(spark, tmp_path):
    members = b"".join(gzip.compress(record(f"T{i}", f"page {i}")) for i in range(1200))
    found = read(spark, tmp_path / "a.warc.gz", members)
    assert [bytes(r.content) for r in found] == [f"page {i}".encode() for i in range(1200)]


def test_malformed_headers(spark, tmp_path):
    # a blank line before the length, a length that is no number, text before the mark
    blank = record("T1", "page", extra="A: b\n\nC: d\n")
    words = record("T2", "next", extra="Content-Length: many\n")
    found = read(spark, tmp_path / "a.warc", b"junk\n", blank, words)
    assert [bytes(r.content) for r in found] == [b"page", b"next"]
    assert found[0].headers["C"] == "d"


@pytest.mark.parametrize(
    ("lead", "content", "expected"),
    [
        ("\r\n", "abc", b"abc"),
        ("\r\n\r\n", "abcd", b"abcd"),
        ("", "", b""),
        ("", "z", b"z"),
        ("\r\n", "z", b"z"),
        ("", "ab", b"ab"),
    ],
)
def test_line_ends_before_the_payload(spark, tmp_path, lead, content, expected):
    data = record("T1", content, lead=lead)
    found = read(spark, tmp_path / "a.warc", data, record("T2", "follows"))
    assert [bytes(r.content) for r in found] == [expected, b"follows"]


def test_cut_off_record_is_dropped(spark, tmp_path):
    found = read(spark, tmp_path / "a.warc", record("T1", "whole"), record("T2", "cut", length=900))
    assert [bytes(r.content) for r in found] == [b"whole"]
    found = read(spark, tmp_path / "b.warc", record("T1", "whole"), b"WARC/1.0\nWARC-Type: response\n")
    assert len(found) == 1


def test_one_partition_per_file(spark, tmp_path):
    for folder in ("en 1", "en 2", "fr1"):
        (tmp_path / folder).mkdir()
        for name in ("a.warc", "b.warc", "_hidden", ".x"):
            (tmp_path / folder / name).write_bytes(record(folder + name, "x"))
    root = str(tmp_path)
    assert len(list_files(spark, root)) == 6
    assert len(list_files(spark, f"{root}/en *")) == 4
    assert len(list_files(spark, f"{root}/*/")) == 6
    assert len(list_files(spark, f"{root}/*/a.warc")) == 3
    (file,) = list_files(spark, f"{root}/en 1/a.warc")
    assert file.startswith("file:/") and file.endswith(f"{root}/en 1/a.warc")
    with pytest.raises(Exception, match="(?i)not exist|not_found"):
        list_files(spark, f"{root}/nothing")
    frame = read_warc(spark, f"file://{root}/en */*")
    assert frame.rdd.getNumPartitions() == 4
    assert frame.count() == 4
    one = spark.read.format("warc").load(f"{root}/fr1/b.warc")
    assert one.count() == 1


def test_documents(spark, tmp_path):
    page = "HTTP/1.1 200 OK\nServer: x\n\n<html><script>s</script>One <b>two</b>\n"
    (tmp_path / "a.warc").write_bytes(
        record("T1", page, url="http://x.nl/d/Index.html")
        + record(None, "no id", url="http://y")
        + record("T3", b"<p>bad \xff byte")
    )
    records = read_warc(spark, str(tmp_path / "a.warc"))
    found = {r.doc_id: r.text for r in warc_documents(records).collect()}
    assert found == {
        "T1": "http://x.nl/d/\t One two ",
        "T3": "http://x.nl/T3\t bad � byte",
    }
    assert {r.text for r in warc_documents(records, with_url=False).collect()} == {" One two ", " bad � byte"}
    assert read_documents(spark, str(tmp_path / "a.warc")).count() == 2


def test_anchors_from_an_archive(spark, tmp_path):
    link = "HTTP/1.1 200\n\n<a href=/T2>to two</a>"
    (tmp_path / "a.warc").write_bytes(record("T1", link) + record("T2", "<p>"))
    pages = warc_pages(read_warc(spark, str(tmp_path / "a.warc")))
    found = anchor_documents(pages).collect()
    assert [tuple(r) for r in found] == [("T2", "http://x.nl/T2", ["to two"], 0)]


def test_lengths_beyond_32_bits_are_no_lengths(spark, tmp_path):
    bad = "WARC/1.0\nWARC-Type: response\nWARC-TREC-ID: x\nContent-Length: {}\n\n"
    good = "WARC/1.0\nWARC-Type: response\nWARC-TREC-ID: y\nContent-Length: 4\n\ngood\n"
    for n, length in enumerate(("3000000000", "9" * 20, "-1", "4x")):
        file = tmp_path / f"{n}.warc"
        file.write_text(bad.format(length) + "rest: of it\nContent-Length: 4\n\nmore\n" + good)
        found = read_warc(spark, str(file)).collect()
        assert [bytes(r.content) for r in found] == [b"more", b"good"], length


def test_a_cut_off_gzip_file_keeps_its_whole_records(spark, tmp_path):
    record = "WARC/1.0\nWARC-Type: response\nContent-Length: 3000\n\n{}\n"
    whole = [gzip.compress(record.format(str(k) * 3000).encode()) for k in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(whole)[:-15])
    (tmp_path / "b.warc.gz").write_bytes(whole[0] + b"\x00 no gzip")
    found = read_warc(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.content[:1]) for r in found) == [b"0", b"0", b"1"]


def test_tasks_do_not_carry_all_paths():
    from siftrank.sources.warc import WarcReader

    reader = WarcReader(["x" * 1000] * 1000, "response")
    assert len(cloudpickle.dumps(reader)) < 100_000
    assert len(reader.partitions()) == 1000
