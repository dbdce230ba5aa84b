"""Shards by a hierarchical weighted hash tree.

The shards are leaves of a tree of regions, racks and shards. A document
descends the tree: at each node every child draws an exponential time from a
hash of (document id, child), divided by the child's weight, and the earliest
draw wins. A child's draw depends on nothing but the id, the child and the
child's weight, so when weights change only documents for which a changed
child starts or stops winning move, and a move stays inside the subtrees whose
weights changed. Weight here is the number of shards below a node.

``tree(n)`` fills racks and regions in order. A number of shards that fills
its regions grows by opening a new region: the new shard is all there is in
it, so it takes documents only into itself.

DataFrame functions only. Texts are read in the scan task and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Children of a full region, and shards of a full rack.
RACKS, SHARDS = 2, 5

Node = tuple[int, float]


def tree(n_shards: int, racks: int = RACKS, shards: int = SHARDS, weights: Sequence[float] | None = None):
    """Levels of the tree of ``n_shards`` shards: for each level the list of
    each parent's children (child id, weight). Ids count from 0 on a level,
    a shard's id is its number. ``weights``: of the shards, 1.0 by default."""
    if n_shards < 1:
        raise ValueError("a tree needs at least one shard")
    w = [1.0] * n_shards if weights is None else [float(x) for x in weights]
    if len(w) != n_shards or any(x <= 0 for x in w):
        raise ValueError("weights must be positive, one for each shard")
    leaves = list(enumerate(w))
    rack_kids = [leaves[i:i + shards] for i in range(0, n_shards, shards)]
    rack_nodes = [(i, sum(x for _, x in kids)) for i, kids in enumerate(rack_kids)]
    region_kids = [rack_nodes[i:i + racks] for i in range(0, len(rack_nodes), racks)]
    region_nodes = [(i, sum(x for _, x in kids)) for i, kids in enumerate(region_kids)]
    return [[region_nodes], region_kids, rack_kids]


def _children(level: list[list[Node]]) -> Column:
    """The level's children as one literal, indexed by parent."""
    text = ", ".join(
        "array(" + ", ".join(f"named_struct('id', {i}, 'w', {w!r}D)" for i, w in kids) + ")" for kids in level
    )
    return F.expr(f"array({text})")


def place(key: Column, levels, seed: int = 42) -> Column:
    """Shard number of ``key`` in the tree."""
    node = F.lit(0)
    for depth, level in enumerate(levels):
        kids = F.element_at(_children(level), node + 1)
        node = F.array_min(F.transform(kids, _draws(key, depth, seed)))["id"]
    return node


def _draws(key: Column, depth: int, seed: int):
    def draw(child: Column) -> Column:
        h = F.xxhash64(F.lit(seed), F.lit(depth), child["id"], key)
        u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / child["w"]).alias("t"), child["id"].alias("id"))

    return draw


def assign(
    docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
    rows_per_bucket: int = 2000, weights: Sequence[float] | None = None,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard), a row per input row.

    ``size``: UTF-8 bytes of the text (null: none) plus 16. ``text_crc32``: of
    the text's bytes (null: of none). ``slot``: gapless from 0 in each shard,
    by hash bucket, then id, checksum and size. ``grown_shard``: with one more
    shard. A null id is a key like any other (the same shard for all of them);
    repeated rows get slots of their own; an empty table gives no rows.

    Slots are numbered without one task per shard: rows are dealt by
    (shard, bucket), with about ``rows_per_bucket`` rows each, numbered there
    and moved on by the counts of the buckets before. A hot id (repeated rows)
    is spread over buckets by its checksum.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    grown = None if weights is None else [*weights, 1.0]
    n_buckets = max(1, -(-docs.count() // (n_shards * rows_per_bucket)))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        place(key, tree(n_shards, weights=weights)).cast("int").alias("shard"),
        place(key, tree(n_shards + 1, weights=grown)).cast("int").alias("grown_shard"),
    ).withColumn("_b", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(
        "shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_start")
    )
    inside = Window.partitionBy("shard", "_b").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("_i", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "_b"]).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("_start") + F.col("_i")).cast("long").alias("slot"), "grown_shard",
    )
