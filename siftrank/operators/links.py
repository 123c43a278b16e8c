"""Links of web pages, and anchor documents made of them.

Pages have the columns ``doc_id``, ``url`` and ``html``.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrank.functions.text import clean_anchor_text, strip_scripts
from siftrank.functions.urls import absolute_url, one_scheme, page_url
from siftrank.operators.hits import document_hits
from siftrank.operators.membership import possible_members

# Patterns that decide which links come out.
LINK = r"""(?is)<a ([^>]*)href=["']?([^> '"]+)([^>]*)>(.*?)</a>"""
NOFOLLOW = r"""(?i)rel=["']?nofollow"""


def _link_elements(html: Column, page_chars: int | None) -> Column:
    if page_chars is not None:
        html = F.substring(html, 1, page_chars)
    return F.regexp_extract_all(strip_scripts(html), F.lit(LINK), F.lit(0))


def _with_link(entries: DataFrame) -> DataFrame:
    """Takes the ``element`` apart: ``target_url``, ``anchor_text``, ``follow``.

    The page is searched once, for whole elements; their parts come from the
    short element text.
    """
    columns = entries.columns

    def part(n: int) -> Column:
        return F.regexp_extract("element", LINK, n)

    return entries.select(
        *columns,
        part(2).alias("href"),
        F.concat(part(1), part(3)).alias("attributes"),
        clean_anchor_text(part(4)).alias("anchor_text"),
    ).select(
        *columns,
        absolute_url(F.col("base"), F.col("href")).alias("target_url"),
        "anchor_text",
        (~F.col("attributes").rlike(NOFOLLOW)).alias("follow"),
    )


def extract_links(pages: DataFrame, page_chars: int | None = None) -> DataFrame:
    """``(src_doc_id, pos, target_url, anchor_text)``, ``pos`` from 0 per page.

    ``page_chars`` is how much of a page is searched; ``None`` means all.
    """
    elements = pages.select(
        F.col("doc_id").cast("string").alias("src_doc_id"),
        page_url(F.col("url")).alias("base"),
        # outer, or else the page would be searched once more by a filter
        F.posexplode_outer(_link_elements(F.col("html"), page_chars)).alias("pos", "element"),
    ).filter(F.col("element").isNotNull())
    return (
        _with_link(elements)
        .filter("follow")
        .select("src_doc_id", "pos", "target_url", "anchor_text")
    )


def page_keys(pages: DataFrame, normalise_scheme: bool = False) -> DataFrame:
    """``(url, doc_id)``: the URL under which each page collects its links."""
    url = page_url(F.col("url"))
    return pages.select(
        (one_scheme(url) if normalise_scheme else url).alias("url"),
        F.col("doc_id").cast("string").alias("doc_id"),
    )


def _first_of_url(pages: DataFrame, normalise_scheme: bool) -> DataFrame:
    keys = page_keys(pages, normalise_scheme).filter("url IS NOT NULL AND doc_id IS NOT NULL")
    return keys.groupBy("url").agg(F.min("doc_id").alias("doc_id"))


def links_to_pages(
    pages: DataFrame,
    page_chars: int | None = None,
    normalise_scheme: bool = False,
    hold_back: bool = False,
) -> DataFrame:
    """``(url, doc_id, src, pos, anchor)``: the links that lead to one of the pages.

    Of pages with the same URL the smallest id counts; a page without an id is no
    target, but its links are links. Most links of a crawl lead out of it: they
    meet the pages' URLs in a hash table and go no further. With ``hold_back`` nearly
    all of them are told by a filter before the links are shuffled to that table.
    """
    keys = _first_of_url(pages, normalise_scheme)
    links = extract_links(pages, page_chars).select(
        F.col("target_url").alias("url"),
        F.col("src_doc_id").alias("src"),
        "pos",
        F.col("anchor_text").alias("anchor"),
    )
    if hold_back:
        links = possible_members(links, "url", keys, "url")
    return links.join(keys.hint("shuffle_hash"), "url")


def gather_anchors(
    pages: DataFrame,
    page_chars: int | None = None,
    max_chars: int | None = None,
    salts: int = 1,
    normalise_scheme: bool = False,
) -> DataFrame:
    """``(doc_id, url, anchors, n_left_out)`` for the pages that others link to.

    A page's links are in order of source and position. With ``max_chars`` a link
    is kept while the URL and the anchors before it, with one separator each, are
    shorter than that, and ``n_left_out`` tells how many more links there are.

    A URL may hold a large part of all links. With ``salts`` above 1 the links
    of a URL are therefore first cut in that many parts: a link beyond the
    limit within its part is beyond it in the whole. What is left for one URL
    is at most ``salts`` times the limit. Without a limit a row is as long as
    its links are; :func:`anchor_hits` does without such rows. This is one plan
    without stored steps; all links of a URL pass one task. Where a URL may have a
    large part of them, :func:`siftrank.operators.anchors.anchor_parts` is for that.
    """
    links = links_to_pages(pages, page_chars, normalise_scheme)
    links = links.withColumn("n_links", F.lit(1).cast("long"))
    if max_chars is not None:
        if salts > 1:
            salted = links.withColumn("salt", F.spark_partition_id() % salts)
            links = _within_limit(salted, ["url", "salt"], max_chars).drop("salt")
        links = _within_limit(links, ["url"], max_chars)
    entry = F.struct("src", "pos", "anchor")
    return (
        links.groupBy("url", "doc_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("links"), F.sum("n_links").alias("n_links"))
        .select(
            "doc_id",
            "url",
            F.col("links.anchor").alias("anchors"),
            (F.col("n_links") - F.size("links")).alias("n_left_out"),
        )
    )


def _within_limit(links: DataFrame, group: list[str], max_chars: int) -> DataFrame:
    """The leading links of each group; the first one stands for those left out."""
    ordered = Window.partitionBy(*group).orderBy("src", "pos", "anchor")
    kept = links.withColumns(
        {
            "nth": F.row_number().over(ordered),
            "used": F.coalesce(
                F.sum(F.length("anchor") + 1).over(
                    ordered.rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        }
    ).withColumn("fits", F.length("url") + F.col("used") < max_chars)
    lost = F.sum(F.when(~F.col("fits"), F.col("n_links"))).over(Window.partitionBy(*group))
    n_links = F.col("n_links") + F.when(F.col("nth") == 1, F.coalesce("lost", F.lit(0))).otherwise(0)
    return (
        kept.withColumn("lost", lost)
        .filter("fits")
        .withColumn("n_links", n_links)
        .drop("nth", "used", "fits", "lost")
    )


def anchor_hits(
    pages: DataFrame,
    vocabulary: list[str] | Callable[[DataFrame], DataFrame],
    page_chars: int | None = None,
    normalise_scheme: bool = False,
) -> DataFrame:
    """``(doc_id, dl, tf)``, as of the documents that anchors and URL would make.

    ``vocabulary`` are the words to count, or what makes hits of ``(doc_id, text)``.

    Links are counted one by one and added up by page and term, before and after
    the shuffle, so no row grows with the number of links. A page's URL is one more
    text of it; pages without links come out no more than others without text.
    """
    keys = _first_of_url(pages, normalise_scheme)
    page = [F.col("doc_id"), F.col("url")]
    links = links_to_pages(pages, page_chars, normalise_scheme, hold_back=True)
    texts = links.select(
        F.struct(*page, F.lit(True).alias("link")).alias("doc_id"), F.col("anchor").alias("text")
    ).unionByName(
        keys.select(F.struct(*page, F.lit(False).alias("link")).alias("doc_id"), F.col("url").alias("text"))
    )
    entries = F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("term"), F.col("dl").alias("n"))),
        F.transform(
            F.map_entries("tf"),
            lambda e: F.struct(e["key"].alias("term"), e["value"].cast("long").alias("n")),
        ),
    )
    hits = vocabulary(texts) if callable(vocabulary) else document_hits(texts, vocabulary)
    counted = hits.select("doc_id", F.explode(entries).alias("c"))
    summed = counted.groupBy("doc_id.doc_id", "doc_id.url", "c.term").agg(
        F.sum("c.n").alias("n"), F.max("doc_id.link").alias("linked")
    )
    of_term = F.when(F.col("term").isNotNull(), F.struct("term", F.col("n").cast("int").alias("n")))
    return (
        summed.groupBy("doc_id", "url")
        .agg(
            F.max(F.when(F.col("term").isNull(), F.col("n"))).alias("dl"),
            F.map_from_entries(F.collect_list(of_term)).alias("tf"),
            F.max("linked").alias("linked"),
        )
        .filter("linked")
        .select("doc_id", "dl", "tf")
    )


def anchor_text_documents(anchors: DataFrame, with_url: bool = True) -> DataFrame:
    """Anchor documents as ``(doc_id, text)`` for the retrieval jobs."""
    text = F.array_join("anchors", "\t")
    return anchors.select(
        "doc_id", (F.concat("url", F.lit("\t"), text) if with_url else text).alias("text")
    )
