"""Anchor text by URL, where one URL may have most of the links.

Links out of the collection are held back before anything is shuffled, and the rest
is stored: a page is searched once. URLs whose links fit into one part are gathered
by one shuffle. Links of the others, few of them, are put in order by ranges; what
a range needs of those before it is a sum, so no task holds all links of a URL.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrank.operators.links import extract_links, page_keys
from siftrank.operators.membership import MEMBER_BITS, possible_members
from siftrank.operators.ranges import in_ranges, offsets
from siftrank.session import written

# Characters of a part; a part ends with the link that reaches them.
PART_CHARS = 1 << 20
# Pages from which on links meet a filter of hosts as well.
HOSTS_FROM = MEMBER_BITS // 4
# URLs with several parts that are sent to all tasks at most.
BROADCAST_ROWS = 100_000

def _host() -> Column:
    return F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)


def _used() -> Column:
    return F.length("anchor") + 1


def _stored_links(
    pages: DataFrame, urls: DataFrame, page_chars: int | None, normalise_scheme: bool
) -> tuple[DataFrame, DataFrame]:
    """``(url, doc_id)`` of the pages, and the links that may lead to one."""
    keys = page_keys(urls, normalise_scheme).filter("url IS NOT NULL AND doc_id IS NOT NULL")
    keys = written(keys, "keys")
    links = extract_links(pages, page_chars).select(
        F.col("target_url").alias("url"),
        F.col("src_doc_id").alias("src"),
        "pos",
        F.col("anchor_text").alias("anchor"),
        # tells repeated links apart, so that they can be in several ranges
        F.monotonically_increasing_id().alias("tie"),
    )
    columns = links.columns
    if keys.count() > HOSTS_FROM:
        # a filter of so many URLs lets links pass, but one of their hosts does not
        links = possible_members(
            links.withColumn("host", _host()), "host", keys.select(_host().alias("host")), "host"
        )
    stored = written(possible_members(links, "url", keys, "url").select(columns), "links")
    return keys.groupBy("url").agg(F.min("doc_id").alias("doc_id")), stored


def _pieces(links: DataFrame, max_chars: int | None, part_chars: int, parts: int | None) -> DataFrame:
    """``(doc_id, url, part, anchors, n_anchors)`` of the links of long URLs, stored.

    A link is in the part that the characters before it fall in, with one separator
    after each, and is left out where URL and these reach ``max_chars``.
    """
    ranged = in_ranges(links, ["url", "src", "pos", "anchor", "tie"], parts)
    ranged = ranged.withColumnRenamed("part", "range")
    before = offsets(ranged.withColumnRenamed("range", "part"), ["url"], chars=F.sum(_used()))
    before = before.select(F.col("part").alias("range"), "url", "chars")
    inside = Window.partitionBy("range", "url").orderBy("nth")
    earlier = F.sum(_used()).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.join(before, ["range", "url"]).withColumn(
        "before", F.col("chars") + F.coalesce(earlier, F.lit(0))
    )
    if max_chars is not None:
        placed = placed.filter(F.length("url") + F.col("before") < max_chars)
    part = F.floor(F.col("before") / part_chars).alias("part")
    anchors = F.sort_array(F.collect_list(F.struct("range", "nth", "anchor")))["anchor"]
    pieces = placed.groupBy("doc_id", "url", part).agg(anchors.alias("anchors"))
    return written(pieces.withColumn("n_anchors", F.size("anchors").cast("long")), "pieces")


def anchor_parts(
    pages: DataFrame,
    page_chars: int | None = None,
    max_chars: int | None = None,
    normalise_scheme: bool = False,
    part_chars: int = PART_CHARS,
    ranges: int | None = None,
    urls: DataFrame | None = None,
) -> DataFrame:
    """``(doc_id, url, part, last, anchors, n_left_out)``: anchor text in bounded rows.

    The links to each page, in order of source and position, in parts from 0 on. A
    part has the links before which ``part_chars`` characters a part were used, one
    separator counted after each; its last link may reach beyond that. ``last``
    marks a URL's last part. ``max_chars`` is how much a page gathers; the row that
    a URL has beyond that says in ``n_left_out`` how many links were left out, and a
    URL that is as long itself has no row. Of pages with the same URL the smallest id
    counts. ``ranges`` is into how many the links of long URLs are dealt, by default
    as many as shuffle partitions. ``urls`` are the pages' ids and URLs, where these
    can be had for less than from ``pages``.
    """
    keys, links = _stored_links(
        pages, pages if urls is None else urls, page_chars, normalise_scheme
    )
    totals = links.groupBy("url").agg(F.sum(_used()).alias("chars"), F.count("*").alias("n_links"))
    is_long: Column = F.col("chars") > part_chars
    if max_chars is not None:
        is_long = is_long | (F.length("url") + F.col("chars") > max_chars)
    long = totals.filter(is_long).select("url", "n_links").join(keys, "url")
    long = written(long, "long_urls")
    n_long = long.count()
    if n_long <= BROADCAST_ROWS:
        long = F.broadcast(long)
    rest = links.join(long.select("url"), "url", "left_anti") if n_long else links
    rest = rest.join(keys.hint("shuffle_hash"), "url")
    anchors = F.sort_array(F.collect_list(F.struct("src", "pos", "anchor")))["anchor"]
    short = rest.groupBy("url", "doc_id").agg(anchors.alias("anchors"))
    short = short.select(
        "doc_id",
        "url",
        F.lit(0).cast("long").alias("part"),
        F.lit(True).alias("last"),
        "anchors",
        F.lit(0).cast("long").alias("n_left_out"),
    )
    if not n_long:
        return short
    pieces = _pieces(
        links.join(long.select("url", "doc_id"), "url"), max_chars, part_chars, ranges
    )
    ends = pieces.groupBy("url").agg(F.max("part").alias("end"), F.sum("n_anchors").alias("kept"))
    ends = ends.join(long.select("url", "n_links"), "url")
    return short.unionByName(
        pieces.join(ends, "url").select(
            "doc_id",
            "url",
            "part",
            (F.col("part") == F.col("end")).alias("last"),
            "anchors",
            (F.col("n_links") - F.col("kept")).alias("n_left_out"),
        )
    )


def whole_anchors(parts: DataFrame) -> DataFrame:
    """``(doc_id, url, anchors, n_left_out)``: parts put together, a row per URL.

    Such a row is as long as its links are.
    """
    in_order = F.sort_array(F.collect_list(F.struct("part", "anchors")))["anchors"]
    several = parts.filter("part > 0 OR NOT last").groupBy("doc_id", "url", "n_left_out")
    return (
        parts.filter("part = 0 AND last")
        .select("doc_id", "url", "anchors", "n_left_out")
        .unionByName(
            several.agg(F.flatten(in_order).alias("anchors")).select(
                "doc_id", "url", "anchors", "n_left_out"
            )
        )
    )
