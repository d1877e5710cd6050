"""Hierarchical weighted hash tree: region, then rack, then shard, each level a weighted hash draw.

At each level the children of the chosen node draw ``-ln(u) / weight`` with ``u`` hashed from the key and
the child's label, and the smallest draw wins, so a child is taken with probability weight / total.  A
draw depends only on the key, the label and the child's own weight: when a weight grows, keys move only
into that child; when it shrinks, only out of it.  Movement is thereby confined to the subtrees whose
weights change.  A shard added by :func:`grow` hangs under a region of its own, so the only changed weight
is that of a branch holding nothing but the new shard, and keys move only into it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import hash_unit, shuffle_width


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: str
    rack: str
    weight: float = 1.0


def topology(n_shards: int, per_rack: int = 4, racks_per_region: int = 2) -> list[Leaf]:
    """Equal-weight shards 0 .. n-1, ``per_rack`` to a rack and ``racks_per_region`` racks to a region."""
    return [Leaf(i, f"r{i // (per_rack * racks_per_region)}", f"k{i // per_rack}") for i in range(n_shards)]


def grow(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region and rack of its own."""
    n = max(leaf.shard for leaf in leaves) + 1
    return [*leaves, Leaf(n, f"grown{n}", f"grown{n}", weight)]


def _descend(key: list[Column], level: str, parent: Column, children: dict[str, list[tuple[str, float]]]) -> Column:
    """The child that draws lowest among those that ``children`` lists for ``parent``."""
    table = F.create_map(*[x for p, cs in children.items() for x in (F.lit(p), F.array(*[F.struct(F.lit(n).alias("n"), F.lit(float(w)).alias("w")) for n, w in cs]))])
    draws = F.transform(table[parent], lambda c: F.struct((-F.log(hash_unit(*key, F.lit(level), c["n"])) / c["w"]).alias("d"), c["n"].alias("n")))
    return F.array_min(draws)["n"]


def with_shard(df: DataFrame, leaves: list[Leaf], key: list[str], out: str = "shard") -> DataFrame:
    """Adds ``out`` (int): the shard each row's key descends to.  Narrow: no shuffle, no state but the tree.

    A null key is a key like any other.  Rows with equal keys share a shard.
    """
    if not leaves or any(leaf.weight <= 0 for leaf in leaves):
        raise ValueError("the tree needs shards of positive weight")
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for leaf in leaves:
        tree.setdefault(leaf.region, {}).setdefault(leaf.rack, {})[leaf.shard] = leaf.weight
    cols = [F.coalesce(F.col(k).cast("string"), F.lit("\0null")) for k in key]
    total = lambda racks: sum(sum(s.values()) for s in racks.values())
    regions, racks, shards = {"": []}, {}, {}
    for r, of_region in tree.items():
        regions[""].append((r, sum(sum(x.values()) for x in of_region.values())))
        racks[r] = [(f"{r}/{k}", sum(x.values())) for k, x in of_region.items()]
        shards |= {f"{r}/{k}": [(str(i), w) for i, w in x.items()] for k, x in of_region.items()}
    region = _descend(cols, "region", F.lit(""), regions)
    return df.withColumn(out, _descend(cols, "shard", _descend(cols, "rack", region, racks), shards).cast("int"))


def with_slot(df: DataFrame, place: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Adds ``slot``: gapless from 0 within each shard in some order, without sorting a shard in one task.

    Rows of a shard are cut by a hash of the ``order`` columns into as many cells as the session has shuffle
    partitions, so that only rows equal in all of these must share one; ``place`` (the same rows, without the
    payload) gives the cell sizes, whose running sums are the cells' offsets: shards x partitions rows at most,
    which bounds the broadcast.
    """
    cells = shuffle_width(df.sparkSession)
    cell = F.pmod(F.xxhash64(*order, F.lit("cell")), F.lit(cells)).cast("int")
    sizes = place.withColumn("__cell", cell).groupBy(F.col(shard).alias("__shard"), F.col("__cell").alias("__c")).count()
    before = Window.partitionBy("__shard").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy(shard, "__cell").orderBy(*order)
    ranked = df.withColumn("__cell", cell).withColumn("__rank", F.row_number().over(within).cast("long") - 1)
    joined = ranked.join(F.broadcast(offsets), (F.col(shard) == F.col("__shard")) & (F.col("__cell") == F.col("__c")))
    return joined.withColumn("slot", F.col("__rank") + F.col("__offset")).drop("__cell", "__rank", "__shard", "__c", "__offset")


def assign_shards(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Rows ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` under the ``key`` law.

    Null text has size 16 and the crc of no bytes; repeated rows get slots of their own; an empty table gives
    an empty result; further columns are ignored.
    """
    leaves = topology(n_shards)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = with_shard(rows, leaves, ["doc_id"])
    slotted = with_slot(with_shard(rows, grow(leaves), ["doc_id"], "grown_shard"), rows, "shard", ["doc_id", "size", "text_crc32"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
