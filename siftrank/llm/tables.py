"""Intermediate tables that a later join finds in the right place, and samples by hash."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank.session import new_folder, new_table, shuffle_partitions


def written_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write ``df`` to the shared folder in buckets by ``key`` and read it back.

    Grouping or joining by the key then moves the other side only.
    """
    spark = df.sparkSession
    table = new_table(name)
    (
        df.write.bucketBy(shuffle_partitions(spark), key)
        .option("path", new_folder(spark, name))
        .option("compression", "zstd")
        .saveAsTable(table)
    )
    return spark.table(table)


def in_share(key: Column, share: float) -> Column:
    """Whether a key's hash is among that share of all hashes, be it ever so small."""
    least = -(1 << 63) + int(min(1.0, share) * (1 << 64))
    return F.xxhash64(key) <= F.lit(min(least, (1 << 63) - 1))
