"""Sharding by a hierarchical weighted hash tree.

Shards stand in racks, racks in regions.  A row's key makes a weighted draw for every shard; the draw
of a rack is the best of its shards' and that of a region the best of its racks'.  With
exponential draws the best of some is again a draw by the sum of their weights, so a node is
chosen in proportion to what it holds.  The key descends from the root to the region, the rack
and the shard with the best draw.  A draw depends on the key, the shard and the shard's own weight alone, so a
new weight changes the draws of the nodes above that shard and of no other: rows move between that subtree
and the rest, never between two places whose weights stayed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Of the integer mixer: its factor and the range of its results.
FACTOR = 0x45D9F3B
RANGE = 1 << 32
#: Draws of one projection: generated code of more would be too long for the JVM to compile.
LAYER = 8


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree: its number, where it stands and the weight of its draws."""

    number: int
    region: int
    rack: int
    weight: float = 1.0


def tree(shards: int, per_rack: int = 4, racks: int = 2) -> list[Shard]:
    """Equal shards from 0, filled rack by rack and region by region; one more leaves the others where they are."""
    return [Shard(i, i // (per_rack * racks), i // per_rack) for i in range(shards)]


def mixed(x: int) -> int:
    """A bijection of 32-bit numbers."""
    x = ((x ^ x >> 16) * FACTOR) % RANGE
    x = ((x ^ x >> 16) * FACTOR) % RANGE
    return x ^ x >> 16


def _mixed(x: Column) -> Column:
    """The same over a long column; no product leaves 63 bits."""
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftrightunsigned(x, 16)) * F.lit(FACTOR).cast("long")).bitwiseAND(RANGE - 1)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 16))


def key_hash(key: Column) -> Column:
    """32 bits of a long key; a null key is one key, that of -1."""
    key = F.coalesce(key.cast("long"), F.lit(-1).cast("long"))
    low, high = key.bitwiseAND(RANGE - 1), F.shiftrightunsigned(key, 32)
    return _mixed(_mixed(high).bitwiseXOR(low))


def _draw(hashed: Column, number: int, weight: float) -> Column:
    """The logarithm of a number in (0, 1] over the weight: the larger the better, and the more so the heavier the shard."""
    own = _mixed(hashed.bitwiseXOR(F.lit(mixed(number + 1)).cast("long")))
    return F.log((own + 1).cast("double") / F.lit(float(RANGE))) / F.lit(float(weight))


def _best(draws: list[Column]) -> Column:
    return F.greatest(*draws) if len(draws) > 1 else draws[0]


def _first(best: Column, nodes: list[tuple[int, Column]]) -> Column:
    """The smallest of the nodes whose draw is the best."""
    return F.coalesce(*[F.when(draw == best, F.lit(node)) for node, draw in sorted(nodes, key=lambda n: n[0])])


def descend(rows: DataFrame, key: Column, trees: dict[str, list[Shard]]) -> DataFrame:
    """``rows`` with a struct(region, rack, shard) under the name of each tree: the leaf that ``key`` comes to.

    Each level takes the node with the best draw, of equals the smallest.  Shards without weight
    take nothing.  Trees share the draws of shards of one number and weight.
    """
    leaves = sorted({(s.number, s.weight) for shards in trees.values() for s in shards if s.weight > 0})
    if any(not any(s.weight > 0 for s in shards) for shards in trees.values()):
        raise ValueError("no shard has a weight")
    own = {leaf: f"_draw{i}" for i, leaf in enumerate(leaves)}
    found = rows.withColumn("_hashed", key_hash(key))
    for start in range(0, len(leaves), LAYER):
        found = found.withColumns({own[leaf]: _draw(F.col("_hashed"), *leaf) for leaf in leaves[start:start + LAYER]})
    for name, shards in trees.items():
        racks: dict[tuple[int, int], list[tuple[int, Column]]] = {}
        for s in shards:
            if s.weight > 0:
                racks.setdefault((s.region, s.rack), []).append((s.number, F.col(own[s.number, s.weight])))
        of_rack = {at: f"_rack{i}" for i, at in enumerate(racks)}
        regions: dict[int, list[tuple[int, Column]]] = {}
        for (region, rack), at in of_rack.items():
            regions.setdefault(region, []).append((rack, F.col(at)))
        of_region = {region: f"_region{i}" for i, region in enumerate(regions)}
        best = F.col("_best")
        found = found.withColumns({of_rack[at]: _best([d for _, d in inside]) for at, inside in racks.items()})
        found = found.withColumns({of_region[region]: _best([d for _, d in inside]) for region, inside in regions.items()})
        found = found.withColumn("_best", _best([F.col(c) for c in of_region.values()]))
        found = found.withColumn("_region", _first(best, [(region, F.col(c)) for region, c in of_region.items()]))
        found = found.withColumn("_rack", F.coalesce(*[
            F.when(F.col("_region") == region, _first(best, inside)) for region, inside in regions.items()
        ]))
        found = found.withColumn("_shard", F.coalesce(*[
            F.when((F.col("_region") == region) & (F.col("_rack") == rack), _first(best, inside)) for (region, rack), inside in racks.items()
        ]))
        leaf = F.struct(F.col("_region").alias("region"), F.col("_rack").alias("rack"), F.col("_shard").alias("shard"))
        found = found.withColumn(name, leaf).drop(*of_rack.values(), *of_region.values(), "_best", "_region", "_rack", "_shard")
    return found.drop("_hashed", *own.values())


def placed(rows: DataFrame, shards: list[Shard], key: str = "doc_id") -> DataFrame:
    """``rows`` with the ``region``, ``rack`` and ``shard`` of their ``key``, without any shuffle.

    Columns of these names are replaced.  Rows of one key, repeats included, share their shard; a null
    key is a key of its own; an empty table stays empty.
    """
    found = descend(rows, F.col(key), {"_leaf": shards})
    return found.withColumns({c: F.col(f"_leaf.{c}") for c in ("region", "rack", "shard")}).drop("_leaf")


def numbered(rows: DataFrame, within: str, order: list[str]) -> DataFrame:
    """``rows`` with a ``slot``: 0, 1, 2 ... within each value of ``within``, along ``order`` (nulls last).

    Rows are dealt by ranges of both and of a number of their own, so neither a shard nor a key that fills
    most of the table is in one task; each range counts for itself and is moved on by the ranges before it.
    """
    ordered = [F.col(within), *[F.col(c).asc_nulls_last() for c in order], F.col("_number")]
    numbers = stored(rows, "placed").withColumn("_number", F.monotonically_increasing_id())
    ranged = numbers.repartitionByRange(*ordered).sortWithinPartitions(*ordered).drop("_number")
    # A place is the number of a range, then the row's place there in 33 bits.
    dealt = stored(ranged.withColumn("_place", F.monotonically_increasing_id()), "slots")
    dealt = dealt.withColumn("_range", F.shiftright("_place", 33))
    sizes = dealt.groupBy(within, "_range").agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(within, "_range", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    # Of a row a range and one more a shard: ranges are cut, so this is the size of the shuffle's plan, not of the data.
    return (
        dealt.join(F.broadcast(shifts), [within, "_range"])
        .withColumn("slot", F.col("_place") + F.col("_shift")).drop("_place", "_range", "_shift")
    )


def assignment(docs: DataFrame, shards: list[Shard], grown: list[Shard]) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) its size, checksum, shard and slot there, and its shard in a grown tree.

    The size is the bytes of the text and one more; a null text has none and the checksum of an empty one.  Slots
    follow doc_id (null last), then checksum and size; rows alike in all of these are numbered in any order.  The shard is
    decided by doc_id alone, so equal texts of different ids are not kept together.  Other columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    leaves = descend(read, F.col("doc_id"), {"_now": shards, "_grown": grown})
    rows = leaves.withColumns({"shard": F.col("_now.shard"), "grown_shard": F.col("_grown.shard")}).drop("_now", "_grown")
    return numbered(rows, "shard", ["doc_id", "text_crc32", "size"])
