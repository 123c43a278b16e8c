"""Which rows may have a partner, told before they are shuffled."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a filter: at most 32 MB go to each executor, whatever the keys.
MEMBER_BITS = 1 << 28
# 64-bit words that are kept, and looked up, together.
_WORDS = 64


def _place(key: Column, bits: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(bits - 1))


def member_bits(keys: DataFrame, key: str, bits: int = MEMBER_BITS) -> DataFrame:
    """``(bucket, words)``: a bit for the hash of each key, built by aggregation.

    At most ``bits`` / 4096 rows of 64 words, so it may be broadcast for any number
    of keys. With many more keys than bits it lets most through, but never holds
    back a row that has a partner.
    """
    if bits & (bits - 1) or bits < 64 * _WORDS:
        raise ValueError(f"bits must be a power of two from {64 * _WORDS} on")
    place = F.col("place")
    bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
    words = (
        keys.select(_place(F.col(key), bits).alias("place"))
        .groupBy(F.shiftright(place, 6).alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
    )
    entry = F.struct((F.col("word") % _WORDS).cast("int").alias("nth"), "bits")
    held = F.map_from_entries(F.collect_list(entry))
    return words.groupBy(F.floor(F.col("word") / _WORDS).alias("bucket")).agg(held.alias("words"))


def possible_members(
    rows: DataFrame, column: str, keys: DataFrame, key: str, bits: int = MEMBER_BITS
) -> DataFrame:
    """The ``rows`` whose ``column`` may be among the keys; few others pass.

    The filter is broadcast, its size being bounded, and costs the rows no shuffle.
    Nulls have a hash as well, so that no filter for them computes the column twice.
    """
    found = F.broadcast(member_bits(keys, key, bits))
    place = F.col("_place")
    placed = rows.withColumn("_place", _place(F.col(column), bits))
    bucket = F.floor(F.shiftright(place, 6) / _WORDS)
    met = placed.withColumn("_bucket", bucket).join(
        found.select(F.col("bucket").alias("_bucket"), F.col("words").alias("_words")), "_bucket"
    )
    word = F.try_element_at("_words", (F.shiftright(place, 6) % _WORDS).cast("int"))
    hit = F.expr("shiftleft(1L, CAST(_place & 63 AS INT))").bitwiseAND(F.coalesce(word, F.lit(0)))
    return met.filter(hit != 0).select(*rows.columns)
