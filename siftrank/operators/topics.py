"""Topic sets: checked for size, split where they are too large to broadcast.

Topics have the columns ``qid`` and ``terms``; plain topics hold strings,
weighted ones ``struct<term, qtf, df, cf>``.
"""

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Term positions that may be broadcast and written into a plan together.
MAX_POSITIONS = 20_000


@dataclass(frozen=True)
class TopicSlice:
    """Topics of checked size as a local table, and what plans need to know of them."""

    topics: DataFrame
    vocabulary: list[str]
    without_terms: list[str]
    longest: int
    n_docs: int


def _slice(spark: SparkSession, rows: pa.Table) -> TopicSlice:
    terms = rows["terms"].combine_chunks()
    words = terms.flatten()
    if pa.types.is_struct(words.type):
        words = words.field("term")
    lengths = pc.list_value_length(terms)
    return TopicSlice(
        spark.createDataFrame(rows),
        sorted(words.unique().to_pylist()),
        sorted(rows["qid"].filter(pc.equal(lengths, 0)).to_pylist()),
        pc.max(lengths).as_py() or 1,
        (pc.max(rows["n_docs"]).as_py() or 0) if "n_docs" in rows.column_names else 0,
    )


def local(rows: DataFrame) -> DataFrame:
    """A result of at most a few rows per topic, fetched and held as a local table."""
    return rows.sparkSession.createDataFrame(rows.toArrow())


def fetch(topics: DataFrame) -> TopicSlice:
    """Topics that are known to be few, such as a slice with statistics added."""
    return _slice(topics.sparkSession, topics.toArrow())


def topic_slices(topics: DataFrame, max_positions: int = MAX_POSITIONS) -> list[TopicSlice]:
    """The topic set in parts that are each small enough to broadcast.

    Nearly always one part. Topics do not influence each other, so scoring the
    parts one after the other and taking the union gives the same runs. Nothing
    is fetched before Spark has added up how large it is.
    """
    spark = topics.sparkSession
    # a topic takes a place even when it has no terms
    places = F.greatest(F.lit(1), F.size("terms")).cast("long")
    sizes = topics.agg(F.coalesce(F.sum(places), F.lit(0)).alias("all"), F.max(places).alias("most"))
    size = sizes.first()
    if size["all"] <= max_positions:
        return [_slice(spark, topics.toArrow())]
    if size.most > max_positions:
        raise ValueError(f"a topic has {size.most} terms; at most {max_positions} can be broadcast")
    parts = 2 * -(-size["all"] // max_positions)
    while True:
        # by hash of the id: every part keeps whole topics
        part_of = F.pmod(F.xxhash64("qid"), F.lit(parts))
        per_part = topics.groupBy(part_of.alias("part")).agg(F.sum(places).alias("places"))
        if per_part.agg(F.max("places")).first()[0] <= max_positions:
            break
        parts *= 2
    pieces = (topics.filter(part_of == part).toArrow() for part in range(parts))
    return [_slice(spark, rows) for rows in pieces if len(rows)]


def as_weighted(topics: DataFrame) -> DataFrame:
    """Plain topics as weighted ones, for models that need no statistics."""
    return topics.select(
        "qid",
        F.transform(
            "terms",
            lambda t: F.struct(
                t.alias("term"),
                F.lit(1).alias("qtf"),
                F.lit(None).cast("long").alias("df"),
                F.lit(None).cast("long").alias("cf"),
            ),
        ).alias("terms"),
        F.lit(None).cast("long").alias("n_docs"),
        F.lit(None).cast("long").alias("coll_len"),
    )


def last_wins(topics: DataFrame) -> DataFrame:
    """One row per ``qid``: the one that stands last in the file (``seq``)."""
    rest = [F.col(c) for c in topics.columns if c not in ("qid", "seq")]
    return (
        topics.groupBy("qid")
        .agg(F.max_by(F.struct(*rest), "seq").alias("last"))
        .select("qid", *[F.col(f"last.{c}").alias(c) for c in topics.columns if c not in ("qid", "seq")])
    )
