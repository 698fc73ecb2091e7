"""Shards by a hierarchical weighted hash tree.

A key goes down a tree of regions, racks and shards. At every level each child draws -ln(u) / weight, u being a hash in
(0, 1) of the key and the child's name, and the least draw wins; a child's weight is the sum of its shards' weights. A
key thus takes a child in proportion to the weights. When a weight grows, only keys whose draw of that child falls
below their least one move, all of them to it: movement stays inside the subtrees whose weights change. A shard that is
added opens a region of its own, so that it takes keys, and no key moves between the shards there were.

The draws are column expressions over a literal map of the tree, so texts are neither shuffled nor seen by Python. The
slots of a shard are places in one order of all rows, which is cut in ranges: a shard, a key or a text that has a
third of all rows is spread over many of them.

A null key is a key of its own, and equal keys share a shard; a null text has size 1 and the checksum of an empty one.
Repeated rows get slots of their own. An empty table has no rows, and other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptline.operators.ids import dense_ids
from scriptline.session import written

#: Hexadecimal digits of a hash that make a draw: 52 bits, which a double holds exactly.
DIGITS = 13


@dataclass(frozen=True)
class Node:
    """A shard (with its own number and weight), or a region or rack of them."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 0.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight

    def shards(self) -> list[int]:
        return [self.shard] if self.shard is not None else [s for c in self.children for s in c.shards()]


def _leaf(number: int, weight: float = 1.0) -> Node:
    return Node(f"shard {number}", shard=number, own_weight=weight)


def cluster(regions: int, racks: int, shards: int, weights: dict[int, float] | None = None) -> Node:
    """A tree of so many regions, racks in each and shards in each of those, numbered from 0."""
    made, number = [], 0
    for r in range(regions):
        inside = []
        for k in range(racks):
            leaves = tuple(_leaf(n, (weights or {}).get(n, 1.0)) for n in range(number, number + shards))
            inside.append(Node(f"rack {r}.{k}", leaves))
            number += shards
        made.append(Node(f"region {r}", tuple(inside)))
    return Node("all", tuple(made))


def with_shard(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and a rack of its own."""
    region, number = len(tree.children), max(tree.shards()) + 1
    return Node(tree.name, (*tree.children, Node(f"region {region}", (Node(f"rack {region}.0", (_leaf(number, weight),)),))))


def levels(tree: Node) -> list[dict[str, tuple[Node, ...]]]:
    """For each level: the children of its nodes, by their names. All shards must be equally deep."""
    levels, now = [], [tree]
    while any(n.children for n in now):
        if not all(n.children for n in now):
            raise ValueError("shards at different depths")
        levels.append({n.name: n.children for n in now})
        now = [c for n in now for c in n.children]
    return levels


def draw(key: Column, name: Column, weight: Column) -> Column:
    hashed = F.substring(F.md5(F.concat_ws("|", key.cast("string"), name).cast("binary")), 1, DIGITS)
    u = (F.conv(hashed, 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    return -F.log(u) / weight


def shard_of(key: Column, tree: Node) -> Column:
    """The shard of a key."""
    at = F.lit(tree.name)
    for level in levels(tree):
        if len(level) == 1:
            children = _children(next(iter(level.values())))
        else:
            named = [x for name, nodes in level.items() for x in (F.lit(name), _children(nodes))]
            children = F.element_at(F.create_map(*named), at)
        drawn = F.transform(children, lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("draw"), c["name"].alias("name")))
        at = F.array_min(drawn)["name"]
    return F.substring(at, len("shard ") + 1, 20).cast("int")


def _children(nodes: tuple[Node, ...]) -> Column:
    return F.array(*(F.struct(F.lit(n.name).alias("name"), F.lit(float(n.weight)).alias("weight")) for n in nodes))


def assign(docs: DataFrame, tree: Node, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard): slots are gapless in each shard, by key, size and checksum.

    size is the text's bytes in UTF-8 and one more; grown_shard is the shard with one more.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        shard_of(F.col(key), tree).alias("shard"),
        shard_of(F.col(key), with_shard(tree)).alias("grown_shard"),
    )
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "sharded")
    ranked = dense_ids(rows, [F.col(c) for c in ("shard", "key", "size", "text_crc32", "row")], "place")
    # One row per shard: the tree, which is a literal of the plan, bounds it.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begin = rows.groupBy("shard").count().select("shard", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("begin"))
    placed = ranked.join(F.broadcast(begin), "shard").withColumn("slot", F.col("place") - F.col("begin"))
    return placed.select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot", "grown_shard")
