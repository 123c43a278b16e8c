"""Global order in parts."""

from pyspark.sql import functions as F

from siftrank.operators.ranges import in_ranges, offsets


def test_places_and_sums_over_parts_of_a_hot_group(spark):
    """A group of two thirds of the rows is in several parts; numbers stay whole."""
    rows = [("hot" if i % 3 else f"g{i % 7}", i, i % 11) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(5)
    ranged = in_ranges(df, ["g", "i"], parts=4)
    assert ranged.select("part").distinct().count() == 4
    assert ranged.filter("g = 'hot'").select("part").distinct().count() > 1
    before = offsets(ranged, ["g"], rows=F.count("*"), total=F.sum("v"))
    numbered = ranged.join(before, ["part", "g"]).withColumn(
        "nth_in_group", F.col("nth") - F.col("first") + F.col("rows")
    )
    groups = {}
    for r in sorted(numbered.collect(), key=lambda r: (r.g, r.i)):
        groups.setdefault(r.g, []).append(r)
    for found in groups.values():
        assert [r.nth_in_group for r in found] == list(range(len(found)))
        for r in found:
            assert r.total == sum(x.v for x in found if x.part < r.part)


def test_nothing_in_no_parts(spark):
    df = spark.createDataFrame([], "g string, i long")
    assert in_ranges(df, ["g", "i"], parts=4).collect() == []
