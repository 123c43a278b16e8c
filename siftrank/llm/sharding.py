"""Shards by a weighted hash tree of regions, racks and shards.

A row descends the tree. At each node every child draws a number from a hash of
the row's key and the child's name, divided by the child's weight, and the least
draw wins: a child gets a share in proportion to its weight. The draws of other
children do not change when one child's weight does, so rows move only into a
subtree that gains weight, or out of one that loses some, and within a subtree
whose weights stay nothing moves.

Everything is DataFrame functions. A row is never grouped with others to find its
shard, so no key is too frequent; slots come from a global order that splits
shards over as many parts as are needed.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank.operators.ranges import in_ranges, offsets
from siftrank.session import written

# Hexadecimal digits of a digest that make a draw: 52 bits, exact as a double.
DRAW_DIGITS = 13


class Leaf(NamedTuple):
    """A shard, where it stands, and its weight."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def regular_tree(
    n_shards: int, first: int = 16, per_rack: int = 4, racks_per_region: int = 2
) -> list[Leaf]:
    """``n_shards`` shards of weight 1, given by their number alone.

    The ``first`` shards, those that the cluster began with, fill racks and regions
    in order. Each later one stands in a region of its own, so that it takes rows
    from all others but nothing moves between those.
    """
    leaves = []
    per_region = per_rack * racks_per_region
    for shard in range(min(n_shards, first)):
        leaves.append(Leaf(shard // per_region, shard // per_rack, shard))
    for shard in range(first, n_shards):
        above = leaves[-1]
        leaves.append(Leaf(above.region + 1, above.rack + 1, shard))
    return leaves


def _children(leaves: list[Leaf]) -> dict[str, dict[str, float]]:
    """For the root ``''`` and each node, its children's names and weights."""
    children: dict[str, dict[str, float]] = {}
    for leaf in leaves:
        if leaf.weight <= 0:
            continue
        above = ""
        for name in (f"region {leaf.region}", f"rack {leaf.rack}", f"shard {leaf.shard}"):
            below = children.setdefault(above, {})
            below[name] = below.get(name, 0.0) + leaf.weight
            above = name
    return children


def _least_draw(key: Column, nodes: Column) -> Column:
    """The name of that one of ``nodes``, an array of ``(name, weight)``, which draws least."""

    def draw(node: Column) -> Column:
        digest = F.md5(F.concat(node["name"], F.lit(":"), key).cast("binary"))
        number = F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("double")
        uniform = (number + 0.5) / F.lit(float(16**DRAW_DIGITS))
        return F.struct((-F.ln(uniform) / node["weight"]).alias("draw"), node["name"].alias("name"))

    return F.array_min(F.transform(nodes, draw))["name"]


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of each key, which is text; a null key is the empty one.

    Leaves of weight 0 get nothing. Shards, racks and regions are known by their
    numbers, so those have to be unique in the whole tree.
    """
    if len({leaf.shard for leaf in leaves}) < len(leaves):
        raise ValueError("shards need numbers of their own")
    above: dict[int, int] = {}
    if any(above.setdefault(leaf.rack, leaf.region) != leaf.region for leaf in leaves):
        raise ValueError("a rack stands in one region")
    key = F.coalesce(key.cast("string"), F.lit(""))
    children = _children(leaves)
    if not children:
        raise ValueError("no shard has any weight")

    def listed(below: dict[str, float]) -> Column:
        return F.array(
            *(
                F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"))
                for name, weight in below.items()
            )
        )

    def level(kind: str) -> Column:
        nodes = {name: below for name, below in children.items() if name.startswith(kind)}
        flat = (part for name, below in nodes.items() for part in (F.lit(name), listed(below)))
        return F.create_map(*flat)

    region = _least_draw(key, listed(children[""]))
    rack = _least_draw(key, level("region")[region])
    return F.substring_index(_least_draw(key, level("rack")[rack]), " ", -1).cast("int")


def sharded(
    docs: DataFrame,
    leaves: list[Leaf],
    grown: list[Leaf] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id_col, size, text_crc32, shard, slot, grown_shard)``, a row per row of ``docs``.

    ``size`` is the UTF-8 bytes of the text plus 1, ``text_crc32`` their checksum;
    a null text has neither bytes nor words. The id alone decides the shard: rows
    with equal ids share it, and null ids go where the empty id does. ``slot``
    counts a shard's rows from 0 without gaps, by id (null first), then checksum;
    rows equal in both are numbered in any order. ``grown_shard`` is the shard in
    the tree ``grown``, null without one. Other columns are ignored, whatever their
    names, and an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = F.col(id_col).cast("string")
    none = F.lit(None).cast("int")
    # a table of a few numbers per row: the text is read once
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        shard_of(key, leaves).alias("shard"),
        (none if grown is None else shard_of(key, grown)).alias("grown_shard"),
        # tells repeated rows apart, so that no part has to hold all of them
        F.monotonically_increasing_id().alias("tie"),
    )
    ranged = in_ranges(written(rows, "rows"), ["shard", "id", "text_crc32", "tie"])
    # at most a row for each shard and one for each part
    before = F.broadcast(offsets(ranged, ["shard"], earlier=F.count("*")))
    numbered = ranged.join(before, ["part", "shard"])
    return numbered.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        "shard",
        (F.col("nth") - F.col("first") + F.col("earlier")).alias("slot"),
        "grown_shard",
    )
