"""Rows in a global order, without a task that holds a whole group.

A group may hold most rows, such as the links to one page. Rows are therefore
dealt out by ranges of their order, not by group, and written as they lie: a
row's ``part`` and its place ``nth`` in it are then facts, also after an executor
is lost. What a group needs to know across parts is a few rows per part.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftrank.session import shuffle_partitions, written

# The lower bits of a running id are the place within its partition.
_PLACE_BITS = 33


def in_ranges(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``df``, written in the order of ``order``, with the columns ``part`` and ``nth``.

    ``part`` grows with the order, ``nth`` counts from 0 within a part. Rows that
    are equal in all of ``order`` stay together; where that may be many, the last
    column should tell them apart.
    """
    parts = parts or shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = ranged.withColumn("_at", F.monotonically_increasing_id())
    placed = at.withColumns(
        {
            "part": F.shiftright("_at", _PLACE_BITS).cast("int"),
            "nth": F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)),
        }
    )
    return written(placed.drop("_at"), "ranges")


def offsets(ranged: DataFrame, group: list[str], **sums) -> DataFrame:
    """``(part, *group, first, …)``: of each part's rows of a group, the least ``nth``
    and, for each of ``sums``, what the group's earlier parts add up to.

    Adjacent parts share a group only at their border, so besides one row for each
    group there is at most one more for each part.
    """
    per_part = ranged.groupBy("part", *group).agg(
        F.min("nth").alias("first"), *(column.alias(name) for name, column in sums.items())
    )
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        "part",
        *group,
        "first",
        *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in sums),
    )
