"""Documents against topics, and the best of them per topic."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftrank.operators.models import LEADING_POSITIONS, Model, total, totals
from siftrank.session import shuffle_partitions

_DOCUMENT = ["doc_id", "split", "row", "dl"]
_TOPIC = ["n_terms", "query_weight", "n_docs", "coll_len"]


def topic_positions(weighted: DataFrame) -> DataFrame:
    """One row per topic and term position, with the figures of its topic."""
    return weighted.selectExpr(
        "qid",
        "size(terms) AS n_terms",
        "aggregate(terms, 0L, (total, t) -> total + t.qtf) AS query_weight",
        "n_docs",
        "coll_len",
        "CAST(coll_len AS DOUBLE) / CAST(n_docs AS DOUBLE) AS avg_dl",
        "posexplode(terms) AS (pos, t)",
    ).select("qid", "pos", *_TOPIC, "avg_dl", "t.*")


def _met(placed: DataFrame, weighted: DataFrame) -> DataFrame:
    """Every term position at which a document and a topic meet."""
    terms = placed.selectExpr(*_DOCUMENT, "explode_outer(tf) AS (term, tf)").filter("term IS NOT NULL")
    return terms.join(F.broadcast(topic_positions(weighted)), "term")


def _met_in_all(placed: DataFrame, weighted: DataFrame) -> DataFrame:
    """:func:`_met` for the documents that may hold the term of every position of a topic.

    A document is tried for a topic if it holds the topic's rarest term, and its counts
    are looked up there and then: positions are listed only if none is missing. Topics
    that share an id count as one, which is met if as many positions match as one of
    them has: then one of the rarest is among them, however many can be spared.
    """
    positions = topic_positions(weighted)
    figures = [c for c in positions.columns if c not in ("qid", "df", "term")]
    position = F.struct("df", (-F.length("term")).alias("shortness"), "term", *figures)
    topics = (
        positions.groupBy("qid")
        .agg(F.sort_array(F.collect_list(position)).alias("rarest"), F.min("n_terms").alias("least"))
        .selectExpr("qid", "rarest", "size(rarest) - least AS spare")
        .selectExpr("*", "array_distinct(transform(slice(rarest, 1, spare + 1), p -> p.term)) AS keys")
    )
    keys = topics.select(F.col("qid").alias("of"), F.explode("keys").alias("key"))
    missing = "size(filter(rarest, p -> NOT coalesce(map_contains_key(counts, p.term), false)))"
    tried = (
        placed.selectExpr(*_DOCUMENT, "tf AS counts", "explode_outer(map_keys(tf)) AS key")
        .filter("key IS NOT NULL")
        .join(F.broadcast(keys), "key")
        .join(F.broadcast(topics), F.col("of").eqNullSafe(F.col("qid")))
        # a topic of several keys is tried by the first that the document holds
        .filter(f"get(filter(keys, k -> map_contains_key(counts, k)), 0) = key AND {missing} <= spare")
    )
    return (
        tried.selectExpr(*_DOCUMENT, "qid", "counts", "explode(rarest) AS p")
        .selectExpr(*_DOCUMENT, "qid", "p.*", "try_element_at(counts, p.term) AS tf")
        .filter("tf IS NOT NULL")
    )


def _pairs(
    hits: DataFrame, weighted: DataFrame, models: list[Model], longest: int
) -> DataFrame:
    placed = (
        hits.selectExpr(
            "doc_id", "dl", "tf",
            "spark_partition_id() AS split", "monotonically_increasing_id() AS row",
        )
        .repartition(shuffle_partitions(hits.sparkSession), "doc_id", "split")
        .select(*_DOCUMENT, "tf")
    )
    met = _met_in_all if all(m.conjunctive for m in models) else _met
    weights = met(placed, weighted).selectExpr(
        *_DOCUMENT, "qid", "pos", *_TOPIC,
        *[f"{m.weight} AS weight_{n}" for n, m in enumerate(models)],
    )
    aggregates = [
        aggregate.alias(f"total_{n}_{i}")
        for n, m in enumerate(models)
        for i, aggregate in enumerate(totals(m, f"weight_{n}", longest))
    ]
    figures = [F.max(c).alias(c) for c in _TOPIC]
    return weights.groupBy(*_DOCUMENT, "qid").agg(
        F.count("*").alias("n_matched"), *figures, *aggregates
    )


def score_documents(
    hits: DataFrame, weighted: DataFrame, models: list[Model], longest: int
) -> DataFrame:
    """``(qid, model, doc_id, score)`` for all pairs with a score other than 0.

    ``weighted`` must be a checked slice of the topics: it is broadcast, and
    no topic of it has more than ``longest`` terms. The join is on terms, so
    only pairs that share one come into being; the models are such that no
    other pair could score.

    Conjunctive models by themselves never see the pairs that lack a term. Where
    topics are so long that products list factors, they are scored by themselves.

    Hits are shuffled once, before they multiply: a row per document, with its
    counts of query terms but without its text. The documents' matches with
    all topics are then made and added up in the same task. Rows are told
    apart by their place in the input, and sent off by id and input split:
    a task that has to run again sends the same rows to the same places, and
    rows that share an id are still spread.
    """
    strict = [m for m in models if m.conjunctive]
    if longest > LEADING_POSITIONS and 0 < len(strict) < len(models):
        others = [m for m in models if not m.conjunctive]
        return union([score_documents(hits, weighted, part, longest) for part in (strict, others)])
    pairs = _pairs(hits, weighted, models, longest)
    if all(m.conjunctive for m in models):
        pairs = pairs.filter("n_matched = n_terms")
    products = [
        f"{total(m, [c for c in pairs.columns if c.startswith(f'total_{n}_')])} AS total_{n}"
        for n, m in enumerate(models)
    ]
    scores = []
    for n, model in enumerate(models):
        score = model.score.format(total=f"total_{n}")
        if model.conjunctive:
            score = f"CASE WHEN n_matched = n_terms THEN {score} END"
        scores.append(f"named_struct('model', '{model.name}', 'score', CAST({score} AS DOUBLE))")
    return (
        pairs.selectExpr("qid", "doc_id", "dl", "n_matched", *_TOPIC, *products)
        .selectExpr("qid", "doc_id", f"explode(array({', '.join(scores)})) AS s")
        .select("qid", "s.model", "doc_id", "s.score")
        .filter("score <> 0 AND NOT isnan(score)")
    )


def best(scored: DataFrame, k: int | None, salts: int = 1) -> DataFrame:
    """Adds ``rank`` and keeps the best ``k`` per topic and model, or all for ``None``.

    Equal scores are ordered by ``doc_id``. Each task keeps its own best ``k``
    before the shuffle. With ``salts`` above 1 the survivors of a topic are
    first ranked in that many parts, so that no task receives all of them; a
    document among the best of all is among the best of its part.
    """
    best_first = [F.desc("score"), F.asc("doc_id")]

    def ranked(df: DataFrame, *group: str) -> DataFrame:
        window = Window.partitionBy(*group).orderBy(*best_first)
        df = df.withColumn("rank", F.row_number().over(window))
        return df if k is None else df.filter(F.col("rank") <= k)

    if k is not None:
        # without this Spark ranks longer runs only after their shuffle
        conf, limit = scored.sparkSession.conf, "spark.sql.optimizer.windowGroupLimitThreshold"
        if int(conf.get(limit)) < k:
            conf.set(limit, str(k))
    if salts > 1 and k is not None:
        # the part follows the input split: the rows of one task stay together,
        # so salting does not multiply what the task may keep
        salted = scored.withColumn("salt", F.spark_partition_id() % salts)
        scored = ranked(salted, "qid", "model", "salt").drop("salt", "rank")
    return ranked(scored, "qid", "model")


def floors(sampled: DataFrame, k: int, salts: int = 1) -> DataFrame:
    """``(qid, model, floor)``: the ``k``-th best score among some documents.

    Wherever a sample already has ``k`` documents, no document that scores less
    than the last of them is among the best ``k`` of all.
    """
    last = best(sampled, k, salts).filter(F.col("rank") == k)
    return last.select("qid", "model", F.col("score").alias("floor"))


def not_below(scored: DataFrame, floor: DataFrame) -> DataFrame:
    """Leaves out scores that cannot be among the best.

    ``floor`` has at most one row per topic and model and is broadcast. Sums may
    differ in their last bits when they are made again, so it is lowered a little.
    """
    lowest = F.col("floor") - F.abs("floor") * 1e-9
    return (
        scored.join(F.broadcast(floor), ["qid", "model"], "left")
        .filter(F.col("floor").isNull() | (F.col("score") >= lowest))
        .drop("floor")
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
