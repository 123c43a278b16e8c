"""The jobs: anchor text, simple run, term statistics, baseline runs.

Documents are ``(doc_id, text)``, pages ``(doc_id, url, html)``, topics
``(qid, terms)``. Runs and experiments tokenize when they are called: the
documents' hits, a few percent of the text, are written to the shared folder,
and the DataFrames returned read them from there.
"""

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.operators.anchors import anchor_parts, whole_anchors
from siftrank.operators.hits import document_hits, document_hits_among
from siftrank.operators.links import anchor_hits
from siftrank.operators.models import BASELINES, Model, unsmoothed_lm
from siftrank.operators.scoring import best, floors, not_below, score_documents, union
from siftrank.operators.statistics import counters, of_words, weigh_topics
from siftrank.operators.topics import (
    MAX_POSITIONS,
    TopicSlice,
    as_weighted,
    fetch,
    local,
    topic_slices,
)
from siftrank.session import salts_for, written

# Fixed value: how many documents a run lists per topic and model.
TOP = 1000


def _rank(scored: DataFrame, k: int) -> DataFrame:
    spark = scored.sparkSession
    return best(scored, k, salts_for(spark)).select("qid", "model", "doc_id", "score", "rank")


def anchor_documents(
    pages: DataFrame,
    page_chars: int | None = None,
    max_chars: int | None = None,
    normalise_scheme: bool = False,
) -> DataFrame:
    """Anchor text of the links to each page: ``(doc_id, url, anchors, n_left_out)``.

    ``page_chars`` is how much of a page is searched, ``max_chars`` how many
    characters a page gathers; ``None`` is no limit. ``n_left_out`` counts the
    links beyond that limit. Without a limit a row is as long as a page's links;
    :func:`anchor_parts` has rows of bounded length.
    """
    return whole_anchors(anchor_parts(pages, page_chars, max_chars, normalise_scheme))


def _vocabulary(slices: list[TopicSlice]) -> list[str]:
    """The words of all slices."""
    return sorted(set().union(*(part.vocabulary for part in slices)))


def _hits(docs: DataFrame, words: list[str]) -> DataFrame:
    """Hits of the words: named in the plan if they are few, else joined."""
    if len(words) <= MAX_POSITIONS:
        return document_hits(docs, words)
    rows = docs.sparkSession.createDataFrame([(word,) for word in words], "term string")
    return document_hits_among(docs, rows)


def _stored(docs: DataFrame, slices: list[TopicSlice]) -> DataFrame:
    """Hits of all slices in one pass over the text, as a table."""
    return written(_hits(docs, _vocabulary(slices)), "hits")


def simple_run(docs: DataFrame, topics: DataFrame, k: int = TOP) -> DataFrame:
    """Unsmoothed language model: ``(qid, model, doc_id, score, rank)``.

    A topic without any term gives every document its length as score.
    """
    model = unsmoothed_lm("LM")
    slices = topic_slices(topics)
    hits = _stored(docs, slices)
    n_docs = hits.count()
    runs = []
    for part in slices:
        runs.append(_ranked(hits, n_docs, as_weighted(part.topics), part.longest, [model], k))
        if part.without_terms:
            runs.append(_longest(hits, part.without_terms, model.name, k))
    return union(runs)


def _longest(hits: DataFrame, qids: list[str], model: str, k: int) -> DataFrame:
    """The longest documents, found once and listed for each of the topics."""
    lengths = hits.select(
        F.lit("").alias("qid"),
        F.lit(model).alias("model"),
        "doc_id",
        F.col("dl").cast("double").alias("score"),
    ).filter(F.col("score") > 0)
    every_topic = F.explode(F.array(*[F.lit(q) for q in qids])).alias("qid")
    return _rank(lengths, k).select(every_topic, "model", "doc_id", "score", "rank")


def term_statistics(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """Topics with collection and term statistics, for the baseline run.

    Keeps further columns of ``topics``, such as the position in its file. One
    pass over the text: lazily for a topic set in one slice, else over stored hits.
    """
    slices = topic_slices(topics)
    if len(slices) == 1:
        counted = counters(document_hits(docs, slices[0].vocabulary))
        return weigh_topics(slices[0].topics, counted)
    return union(_weighted(_stored(docs, slices), slices))


def _weighted(hits: DataFrame, slices: list[TopicSlice]) -> list[DataFrame]:
    counted = counters(hits)
    if len(slices) == 1:
        return [weigh_topics(slices[0].topics, counted)]
    return [weigh_topics(p.topics, of_words(counted, p.vocabulary)) for p in slices]


def _ranked(
    hits: DataFrame,
    n_docs: int,
    weighted: DataFrame,
    longest: int,
    models: Sequence[Model],
    k: int,
) -> DataFrame:
    """The best ``k`` by stored hits, which are cheap to read twice.

    Every task would sort, and send, the best ``k`` of its own documents for
    each topic and model. A sample of the hits is ranked first, and what scores
    below its best ``k`` is left out before the sort. A share ``s`` of ``n``
    documents leaves about ``k / s`` per topic, so that both are small at
    ``s = sqrt(k / n)``. Up to ``k`` documents there is nothing to leave out.
    """
    scored = score_documents(hits, weighted, list(models), longest)
    if n_docs > k:
        sample = hits.sample(sqrt(k / n_docs), seed=1)
        some = score_documents(sample, weighted, list(models), longest)
        scored = not_below(scored, local(floors(some, k, salts_for(hits.sparkSession))))
    return _rank(scored, k)


def _run_over_table(
    hits: DataFrame, n_docs: int, weighted: DataFrame, models: Sequence[Model], k: int
) -> DataFrame:
    """Ranked scores for a slice of weighted topics, which are fetched here."""
    part = fetch(_occurring(weighted))
    return _ranked(hits, n_docs, part.topics, part.longest, models, k)


def _occurring(weighted: DataFrame) -> DataFrame:
    """Without the terms that the collection lacks, and topics of only such."""
    return weighted.withColumn(
        "terms", F.filter("terms", lambda t: t["cf"] > 0)
    ).filter(F.size("terms") > 0)


def baseline_run(
    docs: DataFrame,
    weighted: DataFrame,
    models: Sequence[Model] = BASELINES,
    k: int = TOP,
) -> DataFrame:
    """All models in one pass over the documents, from weighted topics."""
    slices = topic_slices(weighted)
    hits = _stored(docs, slices)
    n_docs = hits.count()
    return union([_run_over_table(hits, n_docs, part.topics, models, k) for part in slices])


def experiment(
    docs: DataFrame,
    topics: DataFrame,
    models: Sequence[Model] = BASELINES,
    k: int = TOP,
) -> DataFrame:
    """Statistics and baseline run with one pass over the documents' text.

    Scores need the statistics of the whole collection, so two passes are
    needed, but the second goes over the stored hits.
    """
    slices = topic_slices(topics)
    return _experiment(_stored(docs, slices), slices, models, k)


def anchor_experiment(
    pages: DataFrame,
    topics: DataFrame,
    models: Sequence[Model] = BASELINES,
    k: int = TOP,
    page_chars: int | None = None,
    normalise_scheme: bool = False,
) -> DataFrame:
    """The same over what others call each page, and its URL.

    Anchor text is never put together: each link is counted by itself.
    """
    slices = topic_slices(topics)
    words = _vocabulary(slices)
    hits = anchor_hits(pages, lambda texts: _hits(texts, words), page_chars, normalise_scheme)
    return _experiment(written(hits, "hits"), slices, models, k)


def _experiment(
    hits: DataFrame, slices: list[TopicSlice], models: Sequence[Model], k: int
) -> DataFrame:
    n_docs = hits.count()
    return union([_run_over_table(hits, n_docs, w, models, k) for w in _weighted(hits, slices)])
