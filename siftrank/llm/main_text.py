"""The main text of web pages, by what a host repeats and by markup.

A page is cut into blocks. The blocks of many pages are one token stream, whose
suffixes are sorted up to the length from which a repeated substring counts as long.
Suffixes that agree so far are a class; classes of all streams are added up by host,
so that it does not matter which pages a task has seen together. A substring that
several pages of a host have in the same place of their layout is what the host
repeats, and blocks that such substrings cover are boilerplate. The markup is checked
after that: it tells menus, forms, adverts and the like, and where an article is, whose
own lines stay although other articles may share them.
"""

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.llm.words import hashed_words, mixed, run_hashes
from siftrank.session import written

# Elements by what their text is.
_RAW = "script|style|noscript|template|iframe|svg|textarea|object|select|canvas|math"
_NEVER = set("nav aside footer form button head title dialog menu fieldset label".split())
_BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p "
    "pre section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Words of class, id and role that tell what an element is.
_AROUND = set(
    "ad ads adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs "
    "comment comments complementary consent contentinfo cookie cookies copyright discussion disqus "
    "footer form gdpr login menu modal nav navbar navigation newsletter notice notices pager "
    "pagination paywall popup promo promoted promotion recommendations recommended related replies "
    "reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar warning widget".split()
)
_TOP = {"header", "masthead"}
_MAIN = {"main", "content", "article", "post", "entry", "story"}

_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# First and last words of a class that is a state of what it stands on.
_STATE_FIRST = set("has no with without is not non js can hide show".split())
_STATE_LAST = set("open opened closed none off on enabled disabled visible hidden".split())
# Elements that are the page, or its text, whatever their class says.
_WHOLE = {"html", "body", "main", "article"}
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?until)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

BODY, MAIN, ARTICLE = 0, 1, 2
_FACTOR = np.uint64(0xA0761D6478BD642F)
LONG = 8
# Of so many suffixes in a row one is counted, and those that begin a block.
STEP = 8
# Characters of text whose suffixes are sorted together.
SHARD_CHARS = 2_000_000
# Numbers of repeated substrings, eight bytes each, that are sent to all tasks at most.
SENT_ROWS = 4_000_000
# Bits of such a number that only depend on the host.
HOST_BITS = 16
# A zone with less text than this share of the text outside of it is no main text.
LEAST_ZONE = 0.25


def _marks(attributes: str) -> set[str]:
    words: set[str] = set()
    for m in _MARKS.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            own = [w.lower() for w in _WORDS.findall(name)]
            if len(own) == 1 or (own and own[0] not in _STATE_FIRST and own[-1] not in _STATE_LAST):
                words.update(own)
    return words


def page_blocks(html: str) -> list[tuple[int, str]]:
    """``(zone, text)`` of each block in page order, without those never part of a text.

    Classes and forms hide an article only if the page has other text: where they
    hide all, what they say of an element that holds an article is not believed.
    """
    return _blocks(html, False) or (_blocks(html, True) if "<" in html else [])


def _blocks(html: str, believe_articles: bool) -> list[tuple[int, str]]:
    blocks: list[tuple[int, str]] = []
    held: list[str] = []
    # open elements that matter: name, zone, and 0 for text, 1 for none because of a class or
    # form, 2 for headings only, 3 for none
    stack: list[tuple[str, int, int]] = [("", BODY, 0)]
    zone = off = at = 0

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            blocks.append((zone, text))

    for m in _TAG.finditer(html):
        begin, end = m.span()
        if begin > at and not off:
            text = html[at:begin]
            held.append(unescape(text) if "&" in text else text)
        at = end
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        is_block = name in _BLOCKS
        if is_block:
            flush()
        elif name == "br":
            held.append(" ")
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    _, zone, off = stack[-1]
                    break
            continue
        if name in _VOID:
            continue
        if is_block:
            top = stack[-1][0]
            if top == "p" or (top == name and name in ("li", "dt", "dd", "td", "th", "tr", "option")):
                stack.pop()
                _, zone, off = stack[-1]
        new_zone, new_off = zone, off
        if off == 1 and believe_articles and name in ("article", "main"):
            new_zone, new_off = ARTICLE if name == "article" else max(zone, MAIN), 0
        elif off != 1 and off != 3:
            attributes = m[4]
            marks = _marks(attributes) if "=" in attributes and name not in _WHOLE else set()
            if name in _NEVER and name != "form":
                new_off = 3
            elif name == "form" or marks & _AROUND:
                new_off = 1
            elif attributes and name not in _WHOLE and _HIDDEN.search(attributes):
                new_off = 3
            elif name == "header" or marks & _TOP:
                new_off = 2 if zone else 1
            elif off == 2 and name in _HEADINGS:
                new_off = 0
            elif name == "article":
                new_zone = ARTICLE
            elif name == "main" or (zone == BODY and is_block and marks & _MAIN):
                new_zone = max(zone, MAIN)
        if is_block or new_off != off:
            if new_off != off and not is_block:
                flush()
            stack.append((name, new_zone, new_off))
            zone, off = new_zone, new_off
    if at < len(html) and not off:
        held.append(unescape(html[at:]))
    flush()
    return blocks


def suffix_classes(tokens: np.ndarray, length: int) -> np.ndarray:
    """For each suffix the number of its class; classes agree in ``length`` tokens.

    Prefix doubling: the order by one token gives that by two, four and so on. Classes
    are numbered in suffix order, so sorting by them gives the suffix array to this
    depth. ``length`` is a power of two; what lies beyond the end counts as one token.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while width < length:
        later = np.zeros_like(rank)
        later[:-width or None] = rank[width:]
        rank = np.unique(rank * (len(rank) + 2) + later, return_inverse=True)[1] + 1
        width *= 2
    return rank


def covered_tokens(
    tokens: np.ndarray, pages: np.ndarray, n_pages: int, least_pages: int, least_share: float
) -> np.ndarray:
    """Which tokens lie in a substring of ``LONG`` tokens that enough pages have."""
    covered = np.zeros(len(tokens) + 1, dtype=np.int64)
    if len(tokens) >= LONG:
        classes = suffix_classes(tokens, LONG)
        once = np.unique(classes * (n_pages + 1) + pages)
        counts = np.bincount(once // (n_pages + 1), minlength=classes.max() + 1)
        often = counts >= max(least_pages, least_share * n_pages)
        # a substring lies within one page
        starts = np.flatnonzero(often[classes[: len(tokens) - LONG + 1]])
        starts = starts[pages[starts] == pages[starts + LONG - 1]]
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + LONG, -1)
    return np.cumsum(covered[:-1]) > 0


class _Stream:
    """The blocks of some pages as one stream of tokens.

    Every block ends with a mark, so that a block's end counts in a substring. For each
    token it says the ``block`` and the ``page``, for each block its ``zone``, its page,
    and its ``place`` in the zone: how many blocks are before it, or behind it if these
    are fewer, and which of both.
    """

    def __init__(self, pages: list[list[tuple[int, str]]]):
        self.n_pages = len(pages)
        flat = pa.array([t for page in pages for _, t in page], type=pa.string())
        parts = list(hashed_words(flat)) if len(flat) else []
        self.lengths = np.concatenate([np.diff(at) for _, _, at in parts] or [[]]).astype(np.int64)
        words = np.concatenate([w for _, w, _ in parts] or [np.empty(0, np.uint64)])
        self.tokens = np.zeros(len(words) + len(self.lengths), dtype=np.uint64)
        self.begins = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.is_word = np.ones(len(self.tokens), dtype=bool)
        self.is_word[self.begins + self.lengths] = False
        self.tokens[self.is_word] = words
        self.block = np.repeat(np.arange(len(self.lengths)), self.lengths + 1)
        self.block_page = np.repeat(np.arange(self.n_pages), [len(p) for p in pages])
        self.page = self.block_page[self.block]
        self.zone = np.array([z for page in pages for z, _ in page], dtype=np.int64)
        key = self.block_page * 3 + self.zone
        order = np.argsort(key, kind="stable")
        fresh = np.diff(key[order], prepend=-1) != 0
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
        size = np.bincount(key, minlength=3 * self.n_pages)
        before = np.empty(len(key), dtype=np.int64)
        before[order] = np.arange(len(key)) - first
        behind = size[key] - 1 - before
        self.place = np.where(before <= behind, 2 * before, 2 * behind + 1)

    def numbers(self) -> np.ndarray:
        """A number for each suffix, of its first ``LONG`` tokens."""
        n = max(0, len(self.tokens) - LONG + 1)
        total = np.zeros(n, dtype=np.uint64)
        for k in range(LONG):
            total = total * _FACTOR + self.tokens[k : k + n]
        return mixed(total)

    def starts(self, numbers: np.ndarray) -> np.ndarray:
        """Suffixes that are looked at: of ``STEP`` in a row the one with the least number,
        and those that begin a block. What repeats is looked at wherever it stands."""
        chosen = np.zeros(len(numbers), dtype=bool)
        if len(numbers) >= STEP:
            n = len(numbers) - STEP + 1
            least, at = numbers[:n].copy(), np.arange(n)
            for k in range(1, STEP):
                less = numbers[k : k + n] < least
                least[less] = numbers[k : k + n][less]
                at[less] = np.flatnonzero(less) + k
            chosen[at] = True
        chosen[self.begins[self.begins < len(numbers)]] = True
        starts = np.flatnonzero(chosen)
        # a substring lies within one page
        return starts[self.page[starts] == self.page[starts + LONG - 1]]

    def keys(self, hosts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that are looked at, and a number for each of substring, host and
        place. ``hosts`` has the number of each page's host, whose first bits it begins with."""
        numbers = self.numbers()
        starts = self.starts(numbers)
        host = hosts[self.page[starts]]
        place = self.place[self.block[starts]].astype(np.uint64)
        own = mixed(numbers[starts] ^ mixed(host * _FACTOR + place))
        shift = np.uint64(64 - HOST_BITS)
        return starts, (host >> shift << shift) | (own >> np.uint64(HOST_BITS))

    def contents(self) -> np.ndarray:
        """A number for each page's text; pages without any have 0."""
        found = np.zeros(self.n_pages, dtype=np.uint64)
        at = np.flatnonzero(np.diff(self.page, prepend=-1))
        if len(at):
            found[self.page[at]] = run_hashes(self.tokens, at)
        return found


def _in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Rows (…, html) with their pages' blocks, about ``SHARD_CHARS`` characters together."""
    for batch in batches:
        first, pages, size = 0, [], 0
        for k, html in enumerate(batch.column(batch.num_columns - 1)):
            pages.append(page_blocks(html.as_py() or ""))
            size += sum(len(t) for _, t in pages[-1])
            if size >= SHARD_CHARS:
                yield batch.slice(first, k + 1 - first), pages
                first, pages, size = k + 1, [], 0
        if pages:
            yield batch.slice(first), pages


def _host_numbers(hosts: pa.Array) -> np.ndarray:
    known = hosts.dictionary_encode()
    numbers = [xxhash.xxh3_64_intdigest(h.encode()) for h in known.dictionary.to_pylist()]
    return np.array(numbers, dtype=np.uint64)[known.indices.to_numpy()]


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (host, html): ``(number, bits)`` for each class of suffixes, host and place, with a
    bit for the text of each page that has it."""
    for batch, pages in _in_pieces(batches):
        stream = _Stream(pages)
        starts, keys = stream.keys(_host_numbers(batch.column(0)))
        if not len(starts):
            continue
        classes = suffix_classes(stream.tokens, LONG)[starts]
        order = np.lexsort((keys, classes))
        ordered = keys[order]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (ordered[1:] != ordered[:-1]) | (classes[order][1:] != classes[order][:-1])
        group = np.flatnonzero(fresh)
        bits = np.uint64(1) << (stream.contents()[stream.page[starts]] >> np.uint64(58))
        columns = [ordered[group], np.bitwise_or.reduceat(bits[order], group)]
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], ["number", "bits"])


def _kept_zones(zones: np.ndarray, lengths: np.ndarray) -> set[int]:
    """The zones that hold the main text: articles, unless they are little beside the rest
    and so are cards, else the main element, unless that is, else all."""
    body, main, article = (int(lengths[zones == z].sum()) for z in (BODY, MAIN, ARTICLE))
    if article and article >= LEAST_ZONE * (main + body):
        return {ARTICLE}
    if main and main >= LEAST_ZONE * body:
        return {MAIN}
    return {BODY, MAIN}


def _chosen(
    pages: list[list[tuple[int, str]]], hosts: np.ndarray, repeated: tuple[np.ndarray, np.ndarray]
) -> list[str]:
    """The main texts of pages, given the sorted numbers of what repeats outside of articles
    and within them."""
    stream = _Stream(pages)
    starts, keys = stream.keys(hosts)
    flags = [_among(keys, known) for known in repeated]
    in_article = stream.zone[stream.block] == ARTICLE
    covered = np.zeros(len(stream.tokens), dtype=bool)
    for f in (0, 1):
        steps = np.zeros(len(stream.tokens) + 1, dtype=np.int64)
        np.add.at(steps, starts[flags[f]], 1)
        np.add.at(steps, starts[flags[f]] + LONG, -1)
        covered |= (np.cumsum(steps[:-1]) > 0) & (in_article == bool(f))
    n_covered = np.bincount(stream.block[covered & stream.is_word], minlength=len(stream.lengths))
    boilerplate = 2 * n_covered > stream.lengths
    texts, first = [], 0
    for blocks in pages:
        last = first + len(blocks)
        zones, lengths = stream.zone[first:last], stream.lengths[first:last]
        drop = boilerplate[first:last].copy()
        article = zones == ARTICLE
        if 2 * lengths[article & drop].sum() > lengths[article].sum():
            # most of an article is its text, whoever else has it
            drop[article] = False
        kept = _kept_zones(zones[~drop], lengths[~drop])
        rows = zip(blocks, drop, strict=True)
        texts.append("\n\n".join(text for (zone, text), gone in rows if zone in kept and not gone))
        first = last
    return texts


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), dtype=bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _extracted(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, url, host, [repeated,] html): ``(id, url, text)``."""
    for batch, pages in _in_pieces(batches):
        hosts = _host_numbers(batch.column(2))
        known = sent.value if sent is not None else _known(batch.column(3))
        texts = pa.array(_chosen(pages, hosts, known), type=pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["id", "url", "text"])


def _known(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of some rows' lists of ``(number, in_articles)``, each once."""
    entries = lists.flatten()
    numbers = entries.field(0).to_numpy().view(np.uint64)
    strict = entries.field(1).to_numpy(zero_copy_only=False)
    return np.unique(numbers), np.unique(numbers[strict])


def repeated_substrings(
    rows: DataFrame, least_pages: int, least_in_articles: int | None = None
) -> DataFrame:
    """``(number, in_articles)`` of what at least so many different pages (host, html) of a
    host have in the same place.

    Pages are told apart by one of 64 bits of their text's number, so copies of a page
    are one page, and now and then two that differ count as one.
    """
    counted = rows.select("host", "html").mapInArrow(_substrings, "number long, bits long")
    pages = F.bit_count(F.bit_or("bits")).alias("pages")
    often = counted.groupBy("number").agg(pages).where(F.col("pages") >= least_pages)
    in_articles = F.lit(False) if least_in_articles is None else F.col("pages") >= least_in_articles
    return often.select("number", in_articles.alias("in_articles"))


@F.arrow_udf(T.LongType())
def _host_part(hosts: pa.Array) -> pa.Array:
    return pa.array((_host_numbers(hosts) >> np.uint64(64 - HOST_BITS)).view(np.int64))


def main_texts(
    pages: DataFrame,
    least_pages: int = 3,
    least_in_articles: int | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``(id_col, url_col, text, n_chars)``, a row per row of ``pages``.

    The blocks of a page's articles, else those of its main element, else all, without
    boilerplate: blocks mostly covered by substrings of eight tokens or more that
    ``least_pages`` different pages of a host have in the same place of their layout.
    Articles are left whole, because titles and first lines that articles share are in
    the same place as well; with ``least_in_articles`` what so many pages have is taken
    from them, too, unless that is most of an article. Articles that are little beside
    the text outside of them are cards. How many pages a host has, and how long they
    are, does not matter.

    Null and empty pages, and pages without any text, have an empty text. Repeated
    rows are kept and count as one page. Null ids are kept; pages without a host in
    their URL are one host's. Very long pages are read whole, one at a time. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    host = F.lower(F.coalesce(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("")))
    rows = rows.select("id", "url", host.alias("host"), "html")
    repeated = written(repeated_substrings(rows, least_pages, least_in_articles), "repeated")
    sent = None
    if repeated.count() <= SENT_ROWS:
        held = repeated.toPandas()
        numbers = held["number"].to_numpy(dtype=np.int64).view(np.uint64)
        strict = numbers[held["in_articles"].to_numpy(dtype=bool)]
        sent = rows.sparkSession.sparkContext.broadcast((np.sort(numbers), np.sort(strict)))
    else:
        # a host's numbers share their first bits, and so are found by them
        part = F.shiftrightunsigned("number", 64 - HOST_BITS).alias("part")
        parts = repeated.groupBy(part).agg(F.collect_list(F.struct("number", "in_articles")).alias("repeated"))
        parts = parts.withColumnRenamed("part", "_part")
        rows = rows.withColumn("_part", _host_part("host")).join(parts, "_part", "left")
        rows = rows.select("id", "url", "host", "repeated", "html")
    id_type = rows.schema["id"].dataType.simpleString()
    texts = rows.mapInArrow(lambda it: _extracted(sent, it), f"id {id_type}, url string, text string")
    return texts.select(
        F.col("id").alias(id_col),
        F.col("url").alias(url_col),
        "text",
        F.length("text").cast("long").alias("n_chars"),
    )
