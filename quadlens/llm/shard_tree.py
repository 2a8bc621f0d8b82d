"""Sharding by a tree of regions, racks and shards, descended with weighted hash draws. Column expressions only.

At each level a row draws, for each child, an exponential number by its hash and the child's weight, and takes the child
with the smallest. A child's draw depends on the row, the child's name and its weight alone. So a changed weight moves rows
only into the subtrees that grew, or out of those that shrank, and leaves the draws below all others as they were.
A shard that is added opens a region of its own: the only rows that move are those for which it draws lowest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadlens.llm.common import only, parts_of

#: Rows that one window of slots aims at.
SLOT_ROWS = 20_000


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; a shard has a number and no children."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int = -1


def inner(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def regular_tree(shards: int, racks: int = 2, per_rack: int = 4) -> Node:
    """Full regions of racks x per_rack shards of weight 1; what is over forms regions of one shard each."""
    size = racks * per_rack
    regions = [inner(f"region{r}", [inner(f"rack{r}.{k}", [Node(f"shard{n}", 1.0, shard=n) for n in
                                    range(r * size + k * per_rack, r * size + (k + 1) * per_rack)])
                                    for k in range(racks)]) for r in range(shards // size)]
    root = inner("root", regions)
    for n in range(shards // size * size, shards):
        root = added(root, n)
    return root


def added(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own."""
    region = inner(f"region-of-{shard}", [inner(f"rack-of-{shard}", [Node(f"shard{shard}", weight, shard=shard)])])
    return inner(root.name, [*root.children, region])


def draw(key: Column, node: Node) -> Column:
    """An exponential number with the node's weight as rate, from 52 bits of the hash of key and name."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 12).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(node.weight))


def descend(key: Column, node: Node) -> Column:
    """The shard below the node. Branches that a row does not take are not evaluated."""
    if not node.children:
        return F.lit(node.shard)
    alive = [c for c in node.children if c.weight > 0]
    if len(alive) == 1:
        return descend(key, alive[0])
    taken = F.array_min(F.array(*(F.struct(draw(key, c), F.lit(i).alias("i")) for i, c in enumerate(alive))))["i"]
    if not any(c.children for c in alive):
        return F.element_at(F.array(*(F.lit(c.shard) for c in alive)), taken + 1)

    def below(i: Column) -> Column:
        out = F.when(i == 0, descend(key, alive[0]))
        for n, child in enumerate(alive[1:], 1):
            out = out.when(i == n, descend(key, child))
        return out
    # as the argument of a one-element transform the draw is made once for a row, not once for each branch
    return F.element_at(F.transform(F.array(taken), below), 1)


def with_shards(df: DataFrame, key: str, trees: dict[str, Node]) -> DataFrame:
    """Adds a column of shard numbers for each named tree. Null keys share one place."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return df.withColumns({name: descend(k, tree).cast("int") for name, tree in trees.items()})


def with_slots(df: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Adds a place within the shard, gapless from 0.

    No task holds a shard: rows are dealt by hash into buckets within shards, the buckets' counts give each its first slot.
    Rows that are equal in all of `order` are interchangeable.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(4 * parts_of(spark))))
    counts = keyed.groupBy(shard, "_b").count()
    before = Window.partitionBy(shard).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(shard).alias("_s"), F.col("_b").alias("_c"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(shard, "_b").orderBy(*order)))
    joined = ranked.join(first, (F.col(shard) == F.col("_s")) & (F.col("_b") == F.col("_c")))
    return joined.withColumn(slot, (F.col("_first") + F.col("_r") - 1).cast("long")).drop("_b", "_r", "_s", "_c", "_first")


def place(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for every row, by the law `key`.

    size: UTF-8 bytes of the text (null: none) plus 16. Null and empty texts have the checksum 0. Repeated rows share the
    shard and take one slot each; rows with a null key share one shard. An empty table gives an empty result.
    """
    tree = regular_tree(shards)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = only(df, key, text).select(key, (F.length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = with_shards(rows, key, {"shard": tree, "grown_shard": added(tree, shards)})
    slotted = with_slots(rows, "shard", [key, "text_crc32", "size"])
    return slotted.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
