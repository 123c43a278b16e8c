"""Shards by a weighted tree: shares, movement, slots."""

import math
import zlib
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from samples import TEXTS
from siftrank.llm.sharding import Leaf, regular_tree, shard_of, sharded


def brute_shard(key, leaves):
    """The descent, node by node, over the leaves below each."""
    below = [leaf for leaf in leaves if leaf.weight > 0]
    for level in ("region", "rack", "shard"):
        weights = {}
        for leaf in below:
            name = getattr(leaf, level)
            weights[name] = weights.get(name, 0) + leaf.weight

        def draw(name):
            digest = md5(f"{level} {name}:{key}".encode()).hexdigest()
            return -math.log((int(digest[:13], 16) + 0.5) / 16**13) / weights[name]

        chosen = min(weights, key=draw)
        below = [leaf for leaf in below if getattr(leaf, level) == chosen]
    return below[0].shard


def shards(spark, leaves, n=4000):
    keys = spark.range(n).select(F.col("id").cast("string").alias("key"))
    rows = keys.select("key", shard_of(F.col("key"), leaves).alias("shard")).collect()
    return {r.key: r.shard for r in rows}


UNEVEN = [
    Leaf(0, 0, 0, 1.0), Leaf(0, 0, 1, 3.0), Leaf(0, 1, 2, 2.0),
    Leaf(1, 2, 3, 0.5), Leaf(1, 2, 4, 1.5), Leaf(1, 3, 5, 4.0), Leaf(1, 3, 6, 0.0),
]


@pytest.mark.parametrize("leaves", [UNEVEN, regular_tree(16), regular_tree(19)])
def test_against_the_descent_node_by_node(spark, leaves):
    found = shards(spark, leaves, 500)
    assert found == {key: brute_shard(key, leaves) for key in found}


def test_shares_follow_weights(spark):
    count = Counter(shards(spark, UNEVEN, 24_000).values())
    total = sum(leaf.weight for leaf in UNEVEN)
    for leaf in UNEVEN:
        expected = 24_000 * leaf.weight / total
        assert abs(count[leaf.shard] - expected) <= 5 * math.sqrt(expected)


@pytest.mark.parametrize("n", [16, 17, 18, 24])
def test_one_more_shard_takes_rows_only_into_itself(spark, n):
    before, after = shards(spark, regular_tree(n)), shards(spark, regular_tree(n + 1))
    moved = [key for key in before if before[key] != after[key]]
    assert moved and all(after[key] == n for key in moved)
    assert abs(len(moved) / len(before) - 1 / (n + 1)) < 0.02


def test_movement_is_confined_to_subtrees_whose_weights_change(spark):
    heavier = [leaf._replace(weight=2.0) if leaf.shard == 4 else leaf for leaf in UNEVEN]
    place = {leaf.shard: leaf for leaf in UNEVEN}
    before, after = shards(spark, UNEVEN), shards(spark, heavier)
    moved = [(place[before[k]], place[after[k]]) for k in before if before[k] != after[k]]
    assert moved
    for old, new in moved:
        assert new.region == 1
        if old.region == 1:
            assert new.rack == 2
        if old.rack == 2:
            assert new.shard == 4
    gone = [leaf._replace(weight=0.0) if leaf.shard == 0 else leaf for leaf in UNEVEN]
    after = shards(spark, gone)
    moved = [(place[before[k]], place[after[k]]) for k in before if before[k] != after[k]]
    assert all(old.region == 0 for old, _ in moved)
    assert all(old.rack == 0 for old, new in moved if new.region == 0)
    assert all(old.shard == 0 for old, new in moved if new.rack == 0)


def test_trees_that_cannot_be(spark):
    for leaves in ([Leaf(0, 0, 0), Leaf(1, 1, 0)], [Leaf(0, 0, 0), Leaf(1, 0, 1)], [Leaf(0, 0, 0, 0.0)]):
        with pytest.raises(ValueError):
            shard_of(F.col("id"), leaves)


def test_odd_rows(odd, nothing):
    found = sharded(odd, regular_tree(16), regular_tree(17)).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS
    )
    for r in found:
        key = "" if r.doc_id is None else r.doc_id
        assert r.shard == brute_shard(key, regular_tree(16))
        assert r.grown_shard in (r.shard, 16)
    for shard, n in Counter(r.shard for r in found).items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))
    assert sharded(nothing, regular_tree(16)).collect() == []


def test_slots_of_an_id_that_holds_most_rows(spark):
    """Equal rows are numbered too, over several parts."""
    docs = spark.range(4000).select(
        F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text")
    )
    found = sharded(docs.repartition(6), regular_tree(4)).collect()
    by_shard = {}
    for r in found:
        by_shard.setdefault(r.shard, []).append((r.slot, r.doc_id))
    for rows in by_shard.values():
        rows.sort()
        assert [slot for slot, _ in rows] == list(range(len(rows)))
        assert [i for _, i in rows] == sorted(i for _, i in rows)
    plan = sharded(docs, regular_tree(4))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
