"""Sharding by a hierarchical weighted hash tree of regions, racks and shards.

A document descends: of the regions it takes the one of the least draw, then of that region's racks, then of that rack's
shards. A node's draw is exponential, from a hash of id and node, with the weight of its whole subtree as rate; so a node
gets its share by weight, and a descent costs one draw for each child on the way. Where a weight changes, the draws of
the node's ancestors change with their weights, and documents move only into or out of these subtrees, or inside them.

A shard that is added opens a region of its own: no weight that was there changes, so it takes documents only into
itself (the key law). base says how many shards the balanced part of the tree was laid out for; the shards beyond it were
added. It is stored with the layout and growth never changes it: with one base, the tree of one more shard is the same tree
with one more region, whatever their number.

All steps are DataFrame operations; only ids, sizes and checksums are shuffled, never texts.

Cases: a null text has no bytes, so size 16 and checksum 0; rows with a null id go by the hash's seed, together, to one
shard, but not into one task; slots go by a hash of id, size and checksum, and rows that share all three get slots side
by side; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bucketed, expanded, materialize, offsets

OVERHEAD = 16
ROWS = 10_000


@dataclass(frozen=True)
class Node:
    """A region, rack or shard: its number, its subtree's weight, and what it holds."""

    number: int
    weight: float
    children: tuple[Node, ...] = ()


def tree(n_shards: int, shards_per_rack: int = 5, racks_per_region: int = 2, weights: dict[int, float] | None = None, base: int = 1) -> tuple[Node, ...]:
    """The regions of n_shards shards. A shard weighs 1 unless weights says otherwise, and 0 takes it out, with what is left empty.

    base: the shards that racks and regions were laid out for, n_shards at most; each one beyond is a region of its own."""
    per_region = shards_per_rack * racks_per_region
    if not 1 <= base <= n_shards:
        raise ValueError("a layout has as many shards as its base, or more")

    def over(number: int, children: list[Node]) -> list[Node]:
        children = [c for c in children if c.weight > 0]
        return [Node(number, sum(c.weight for c in children), tuple(children))] if children else []

    def leaf(i: int) -> Node:
        return Node(i, float((weights or {}).get(i, 1.0)))

    out = []
    for region in range(-(-base // per_region)):
        racks = []
        for rack in range(region * racks_per_region, (region + 1) * racks_per_region):
            racks += over(rack, [leaf(i) for i in range(rack * shards_per_rack, min((rack + 1) * shards_per_rack, base))])
        out += over(region, racks)
    first_region, first_rack = -(-base // per_region), -(-base // per_region) * racks_per_region
    for i in range(base, n_shards):
        out += over(first_region + i - base, over(first_rack + i - base, [leaf(i)]))
    return tuple(out)


def draw(doc_id: Column, level: str, number: Column, weight: Column) -> Column:
    """Exponential with weight as rate, from a hash of the id and the node."""
    uniform = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(level), number), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(uniform) / weight


def _nodes(nodes: tuple[Node, ...]) -> Column:
    return F.array(*[F.struct(F.lit(n.number).alias("number"), F.lit(n.weight).alias("weight")) for n in nodes])


def _least(doc_id: Column, level: str, nodes: Column) -> Column:
    """struct(draw, number) of the node of least draw."""
    return F.array_min(F.transform(nodes, lambda n: F.struct(draw(doc_id, level, n["number"], n["weight"]).alias("draw"), n["number"].alias("number"))))


def descend(docs: DataFrame, regions: tuple[Node, ...], doc_id: str = "doc_id") -> DataFrame:
    """docs with region, rack, shard, and __draw of the region: three choices, each among the children of the one before."""
    racks = [k for r in regions for k in r.children]

    def below(nodes, chosen: str) -> Column:
        """The children of the chosen node."""
        parents = F.create_map(*[x for n in nodes for x in (F.lit(n.number), _nodes(n.children))])
        return F.element_at(parents, F.col(chosen))

    key = F.col(doc_id)
    out = docs.withColumn("__r", _least(key, "region", _nodes(regions)))
    out = out.withColumns({"__draw": F.col("__r.draw"), "region": F.col("__r.number")}).drop("__r")
    out = out.withColumn("rack", _least(key, "rack", below(regions, "region"))["number"])
    return out.withColumn("shard", _least(key, "shard", below(racks, "rack"))["number"])


def assign(docs: DataFrame, n_shards: int, doc_id: str = "doc_id", text: str = "text", **shape) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack): a row for each document. slot counts from 0 in each shard without a gap."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    regions = tree(n_shards, **shape)
    (added,) = {n.number for n in tree(n_shards + 1, **shape | {"weights": None})} - {n.number for n in tree(n_shards, **shape | {"weights": None})}
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(value) + OVERHEAD).cast("long").alias("size"), F.crc32(value.cast("binary")).alias("text_crc32"))
    # rows that share id, size and checksum are counted, so that no number of them meets in one task
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    rows = descend(rows, regions)
    taken = draw(F.col("doc_id"), "region", F.lit(added), F.lit(float((shape.get("weights") or {}).get(n_shards, 1.0)))) < F.col("__draw")
    rows = materialize(rows.withColumn("grown_shard", F.when(taken, n_shards).otherwise(F.col("shard"))).drop("__draw"))
    order = F.xxhash64("doc_id", "size", "text_crc32", F.lit("slot"))
    rows = bucketed(rows.withColumn("__order", order), F.pmod("__order", F.lit(1 << 30)) / float(1 << 30), ROWS * n_shards)
    before = offsets(rows, ["shard"], {"n": F.col("copies")}).select(F.col("shard").alias("__s"), F.col("__bucket").alias("__b"), "__before_n")
    rows = rows.join(before, (rows.shard == before["__s"]) & (rows["__bucket"] == before["__b"]))
    here = W.partitionBy("shard", "__bucket").orderBy("__order", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    first = F.col("__before_n") + F.coalesce(F.sum("copies").over(here), F.lit(0))
    rows = expanded(rows.withColumn("__first", first), "copies", "__copy")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__first") + F.col("__copy")).cast("long").alias("slot"), "grown_shard", "region", "rack")
