"""Collection statistics and query-term statistics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counters(hits: DataFrame) -> DataFrame:
    """All statistics in one aggregation: ``(term, df, cf)``.

    The row without a term holds the collection's own figures, with every
    document counted once and by its length: ``df`` is the number of documents,
    ``cf`` the collection length. Counts are summed before the shuffle, which
    moves one row per term and task.
    """
    of_document = F.struct(
        F.lit(None).cast("string").alias("term"), F.col("dl").alias("n")
    )
    of_terms = F.transform(
        F.map_entries("tf"),
        lambda e: F.struct(e["key"].alias("term"), e["value"].cast("long").alias("n")),
    )
    return (
        hits.select(F.explode_outer(F.concat(F.array(of_document), of_terms)).alias("c"))
        .groupBy(F.col("c.term").alias("term"))
        .agg(F.count("*").alias("df"), F.sum("c.n").alias("cf"))
    )


def of_words(counted: DataFrame, words: list[str]) -> DataFrame:
    """The counters of the collection and of the ``words`` of one topic slice."""
    listed = counted.sparkSession.createDataFrame([(w, True) for w in words], "term string, known boolean")
    kept = counted.join(F.broadcast(listed), "term", "left").filter("known OR term IS NULL")
    return kept.drop("known")


def collection_stats(hits: DataFrame) -> DataFrame:
    """One row ``(n_docs, coll_len, avg_dl)``; zeros for an empty collection."""
    return hits.agg(
        F.count("*").alias("n_docs"),
        F.coalesce(F.sum("dl"), F.lit(0)).alias("coll_len"),
    ).withColumn(
        "avg_dl",
        F.try_divide(F.col("coll_len").cast("double"), F.col("n_docs").cast("double")),
    )


def statistics_row(counted: DataFrame) -> DataFrame:
    """``counted`` as one row ``(n_docs, coll_len, terms)``.

    ``terms`` maps each query term to its ``df`` and ``cf``. It holds at most
    the words of one topic slice, so the row is bounded.
    """
    own = F.col("term").isNull()
    return counted.agg(
        F.coalesce(F.max(F.when(own, F.col("df"))), F.lit(0)).alias("n_docs"),
        F.coalesce(F.max(F.when(own, F.col("cf"))), F.lit(0)).alias("coll_len"),
        F.map_from_entries(
            F.collect_list(F.when(~own, F.struct("term", F.struct("df", "cf"))))
        ).alias("terms"),
    )


def weigh_topics(topics: DataFrame, counted: DataFrame) -> DataFrame:
    """Topics with ``qtf = 1``, df and cf at every term position.

    Terms that the collection lacks get zeros. The statistics come in as one
    scalar subquery, so the collection is read once for all of them.
    """
    stats = statistics_row(counted).select(F.struct("*")).scalar()
    carried = [c for c in topics.columns if c != "terms"]

    def weighted(t):
        known = F.try_element_at(F.col("stats.terms"), t)
        return F.struct(
            t.alias("term"),
            F.lit(1).alias("qtf"),
            F.coalesce(known["df"], F.lit(0)).alias("df"),
            F.coalesce(known["cf"], F.lit(0)).alias("cf"),
        )

    return topics.withColumn("stats", stats).select(
        *carried,
        F.transform("terms", weighted).alias("terms"),
        F.col("stats.n_docs").alias("n_docs"),
        F.col("stats.coll_len").alias("coll_len"),
    )
