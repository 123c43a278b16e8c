"""Documents reduced to what any retrieval model needs of them.

One row per input row: its length and how often it holds each query term. The
counting happens inside the row, so the collection is not shuffled, and a
document is never identified by anything but its row: an id that occurs twice
is two documents.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.functions.text import NO_TERM


def _only(vocabulary: list[str] | None) -> str:
    if vocabulary is None:
        return "sort_array(filter(terms, t -> t <> ''))"
    words = [w for w in vocabulary if w.isascii() and w.isalnum()]
    if not words:
        return "CAST(array() AS array<string>)"
    listed = ",".join(f"'{w}'" for w in words)
    return f"sort_array(filter(terms, t -> t IN ({listed})))"


# A run of equal terms starts where a term differs from the one before it, and
# ends where the next run starts.
_STARTS = """
    filter(transform(hits, (t, i) -> i), i -> i = 0 OR get(hits, i) <> get(hits, i - 1))
"""
_RUN_LENGTHS = """
    map_from_entries(transform(starts, (start, n) -> struct(
        get(hits, start) AS term,
        coalesce(get(starts, n + 1), size(hits)) - start AS tf)))
"""


# What is between delimiters; empty before a leading and after a trailing one.
_LENGTH = """
    size(terms) - CAST(get(terms, 0) = '' AS int)
    - CAST(size(terms) > 1 AND get(terms, size(terms) - 1) = '' AS int)
"""


def document_hits(docs: DataFrame, vocabulary: list[str] | None) -> DataFrame:
    """``(doc_id, text)`` → ``(doc_id, dl, tf)``.

    ``dl`` counts every term of the text, ``tf`` maps the terms of
    ``vocabulary`` found in it to their counts, or all for ``None``. Empty
    documents stay.
    """
    terms = F.split(F.lower(F.coalesce("text", F.lit(""))), NO_TERM)
    # each step in a projection of its own: columns used more than once by the
    # next one are then computed once
    return (
        docs.select("doc_id", terms.alias("terms"))
        .selectExpr("doc_id", f"CAST({_LENGTH} AS bigint) AS dl", f"{_only(vocabulary)} AS hits")
        .selectExpr("doc_id", "dl", "hits", f"{_STARTS} AS starts")
        .selectExpr("doc_id", "dl", f"{_RUN_LENGTHS} AS tf")
    )


# Words that are sent to all tasks at most; more meet the documents' words in a shuffle.
BROADCAST_WORDS = 1_000_000


def document_hits_among(docs: DataFrame, words: DataFrame) -> DataFrame:
    """:func:`document_hits` for a vocabulary that is a table, of any size: ``(term)``.

    A document's words are counted inside its row, then meet the vocabulary, and only
    those that are in it are put together again. Nulls and repeated words do no harm.
    """
    vocabulary = words.select("term").where(F.col("term").isNotNull()).distinct()
    vocabulary = vocabulary.withColumn("known", F.lit(True))
    if words.count() <= BROADCAST_WORDS:
        vocabulary = F.broadcast(vocabulary)
    counted = document_hits(docs, None).withColumn("row", F.monotonically_increasing_id())
    # a row of its own keeps documents without any hit
    entry = "struct(CAST(NULL AS string) AS key, 0 AS value)"
    entries = F.explode(F.concat(F.array(F.expr(entry)), F.map_entries("tf"))).alias("e")
    met = (
        counted.select("row", "doc_id", "dl", entries)
        .select("row", "doc_id", "dl", F.col("e.key").alias("term"), F.col("e.value").alias("n"))
        .join(vocabulary, "term", "left")
        .filter(F.col("known") | F.col("term").isNull())
    )
    hit = F.when(F.col("term").isNotNull(), F.struct("term", F.col("n").alias("tf")))
    return (
        met.groupBy("row", "doc_id", "dl")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(hit))).alias("tf"))
        .select("doc_id", "dl", "tf")
    )


def term_frequencies(hits: DataFrame) -> DataFrame:
    """``(doc_id, dl, term, tf)``: one row per document row and query term in it."""
    # explode_outer, because explode would make the optimizer evaluate the
    # tokenizer once more in a filter of its own
    return hits.select(
        "doc_id", "dl", F.explode_outer("tf").alias("term", "tf")
    ).filter(F.col("term").isNotNull())
