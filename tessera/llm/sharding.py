"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

Every row descends the tree.  At each level each child draws
``-ln(u(key, child)) / weight(child)`` and the smallest draw wins, so a child gets
its share by weight, and a change of weights moves rows only into or out of the
subtrees whose weights changed.  A shard that joins is hung below the root as a
region of its own (:func:`grow`): no older subtree changes its weight, hence rows
move only into the new shard.  Key and shard list alone decide (law ``key``).

Slots are numbered without sorting a shard in one task: equal rows are counted
first, (shard, bucket) groups are numbered apart, and a small table of bucket
sizes gives each bucket its offset.

Defined results: a null key hashes like any other value and has its own place;
a null text has no bytes (size 8, crc32 0); repeated rows get slots of their own;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import table, uniform


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(regions: int = 2, racks: int = 3, shards: int = 4) -> tuple[Leaf, ...]:
    """A full tree of equal weights."""
    return tuple(Leaf(f"r{g}", f"k{k}", (g * racks + k) * shards + s) for g in range(regions) for k in range(racks) for s in range(shards))


def grow(tree: tuple[Leaf, ...], weight: float = 1.0) -> tuple[Leaf, ...]:
    """One more shard, as a region of its own."""
    n = max((x.shard for x in tree), default=-1) + 1
    return (*tree, Leaf(f"joined{n}", "k0", n, weight))


def shard_of(key: Column, tree: tuple[Leaf, ...]) -> Column:
    """The shard of a key, as one Spark expression.  Children of weight 0 get nothing.

    The tree is a constant: ``children[node]`` has the path, weight and node number of
    each child; three nested draws lead from the root to a leaf.
    """
    live = [x for x in tree if x.weight > 0]
    if not live:
        raise ValueError("the tree has no shard of positive weight")
    children: list[dict[str, list]] = [{}]
    shards = [-1]

    def child(node: int, path: str, weight: float, shard: int = -1) -> int:
        known = children[node].setdefault(path, [0.0, len(children)])
        known[0] += weight
        if known[1] == len(children):
            children.append({})
            shards.append(shard)
        return known[1]

    for x in live:
        region = child(0, f"/{x.region}", x.weight)
        rack = child(region, f"/{x.region}/{x.rack}", x.weight)
        child(rack, f"/{x.region}/{x.rack}/{x.shard}", x.weight, x.shard)
    none = F.array().cast("array<struct<path:string,weight:double,node:int>>")
    kids = F.array(*[F.array(*[F.struct(F.lit(p).alias("path"), F.lit(float(w)).alias("weight"), F.lit(n).alias("node")) for p, (w, n) in c.items()]) if c else none for c in children])

    def draw(c: Column) -> Column:
        return F.struct((-F.ln(uniform(key, c["path"])) / c["weight"]).alias("d"), c["node"].alias("node"))

    at = F.lit(0)
    for _ in range(3):
        at = F.array_min(F.transform(F.element_at(kids, at + 1), draw))["node"]
    return F.element_at(F.array(*map(F.lit, shards)), at + 1)


def with_slots(df: DataFrame, shard: str = "shard", buckets: int = 1024, chunk: int = 50_000) -> DataFrame:
    """Number the rows of each shard from 0 without a gap; more than ``chunk`` copies of a row are dealt over tasks."""
    cols = df.columns
    dense = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.pmod(F.xxhash64(*[F.col(c) for c in cols], F.lit("slot")), F.lit(buckets)))
    sizes = dense.groupBy(shard, "_b").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy(shard).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(shard).alias("_s"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_b").orderBy(*[c for c in cols if c != shard]).rowsBetween(Window.unboundedPreceding, -1)
    dense = dense.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    out = dense.join(starts, (dense[shard] == starts["_s"]) & (dense["_b"] == starts["_bb"]))
    out = out.select(*cols, "_n", (F.col("_start") + F.col("_in")).alias("_first"))
    few = out.where(F.col("_n") <= chunk).select(*cols, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias("slot"))
    parts = F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1, F.lit(chunk).cast("long")))
    many = out.where(F.col("_n") > chunk).select(*cols, (F.col("_first") + F.col("_n")).alias("_end"), parts.alias("_from")).repartition("_from")
    return few.unionByName(many.select(*cols, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + chunk, F.col("_end")) - 1)).alias("slot")))


def shard_documents(docs: DataFrame, tree: tuple[Leaf, ...] | None = None, key: str = "doc_id", text: str = "text", buckets: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    tree = tree or topology()
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(raw).cast("long") + 8).alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    placed = rows.select("*", shard_of(F.col("doc_id"), tree).alias("shard"), shard_of(F.col("doc_id"), grow(tree)).alias("grown_shard"))
    return with_slots(placed, buckets=buckets).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.col("grown_shard").cast("int"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
