"""Text and URL rules against worked examples."""

import pytest
from pyspark.sql import functions as F

from siftrank.functions import text, urls


def apply(spark, rule, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(rule(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(
    ("value", "document", "query"),
    [
        (" Horse, hooves. ", ["horse", "hooves"], ["", "horse", "hooves"]),
        ("caña", ["ca", "a"], ["ca", "a"]),
        ("---", [], []),
        ("to be or not to be", "to be or not to be".split(), "to be or not to be".split()),
        ("A1=b2", ["a1", "b2"], ["a1", "b2"]),
        ("", [], [""]),
    ],
)
def test_tokenizers(spark, value, document, query):
    assert apply(spark, text.document_terms, value) == document
    assert apply(spark, text.query_terms, value) == query


@pytest.mark.parametrize(
    ("rule", "value", "expected"),
    [
        (text.strip_index_page, "http://a.nl/x/INDEX.html", "http://a.nl/x/"),
        (text.strip_index_page, "http://a.nl/x/index.html?q", "http://a.nl/x/index.html?q"),
        (text.strip_protocol_header, "HTTP x<a>\nfoo<b>", "<a>\nfoo<b>"),
        (text.strip_protocol_header, "HTTP/1.1 200\nA: b\n\n<p>", "<p>"),
        (text.strip_protocol_header, "no tag at all", "no tag at all"),
        (text.strip_scripts, "a<SCRIPT>x\ny</script>b<script>z</script>c", "a b c"),
        (text.strip_scripts, "a<script>open", "a<script>open"),
        (text.strip_tags, "a<b\nc>d<>e&amp;", "a d<>e&amp;"),
        (text.collapse_whitespace, " a \n\r\t b ", " a b "),
        (text.clean_anchor_text, "X <!-- test -->rocks", "X  rocks"),
        (text.clean_anchor_text, "\n a<b>c", " a c"),
        (
            text.html_to_text,
            "HTTP/1.0 200\r\n\r\n<html><script>s</script> <p>One\n<b>two</b></p>",
            " One two ",
        ),
    ],
)
def test_text_rules(spark, rule, value, expected):
    assert apply(spark, rule, value) == expected


def test_bad_bytes_are_replaced(spark):
    row = spark.createDataFrame([(bytearray(b"a\xffb\xe2\x82"),)], "c binary")
    assert row.select(text.decode_utf8(F.col("c"))).first()[0] == "a�b�"


@pytest.mark.parametrize(
    ("base", "href", "target"),
    [
        ("http://a.nl", "x.html", "http://a.nl/x.html"),
        ("http://a.nl/dir", "x.html", "http://a.nl/x.html"),
        ("http://a.nl/dir/p.html", "x.html", "http://a.nl/dir/x.html"),
        ("http://a.nl/dir/p.html", "/x/", "http://a.nl/x"),
        ("https://a.nl/p", "https://b.nl/index.html", "http://b.nl"),
        ("http://a.nl/p", "//b.nl/q", "http://a.nl/b.nl/q"),
        ("http://a.nl/dir/p.html", "../x.html", "http://a.nl/x.html"),
        ("http://a.nl/d/p.html", "../x.html", "http://a.nl/d/../x.html"),
        ("http://a.nl/dd/ee/p.html", "../../x.html", "http://a.nl/dd/../x.html"),
        ("http://a.nl/p", "HTTP://b.nl/q", "http://a.nl/HTTP:/b.nl/q"),
        ("http://a.nl/p", "mailto:x@y", "http://a.nl/mailto:x@y"),
        ("http://a.nl/p", "#top", "http://a.nl/#top"),
        ("http://a.nl/p", "b//c/index.htm", "http://a.nl/b/c"),
        ("http://a.nl/p", "ftp://b.nl/q", "http://b.nl/q"),
        ("http://a.nl/p", "/x/index.html/", "http://a.nl/x/index.html"),
        ("http://a.nl/p", "/x\n y", "http://a.nl/xy"),
    ],
)
def test_absolute_url(spark, base, href, target):
    assert apply(spark, urls.absolute_url, base, href) == target


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://a.nl/", "https://a.nl"),
        ("http://a.nl/index.html", "http://a.nl"),
        ("http://a.nl/Index.html", "http://a.nl/Index.html"),
        ("http://a.nl/x//", "http://a.nl/x/"),
    ],
)
def test_page_url(spark, url, expected):
    assert apply(spark, urls.page_url, url) == expected
