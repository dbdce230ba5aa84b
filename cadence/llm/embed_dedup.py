"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on many random directions. On one direction two
vectors whose cosine is at least the threshold lie close together, so a
window around the one, in the sorted projections, holds the other with a known
chance; for strangers the chance is far smaller. The number of directions on
which a pair collides is counted, and only pairs that pass a count are
verified with the exact cosine. ``calibrate`` takes the count from the
binomial law, so that a pair right at the threshold is lost with a small
chance only; closer pairs collide more often.

To deal the work out, a few more directions each are cut into cells, and the
vectors that share all cells of a table (and the label) meet in a task, which
sorts, counts and verifies. The number of tables follows from the recall
asked for. A pair counts in the first table where it meets, so links are
counted without listing pairs: a task returns a vector's number of links and
its smallest reachable vector there. Equal vectors are one row with a
multiplicity. A cell of more than ``TILE`` rows is cut into blocks, and each
pair of blocks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import connected_components, groups_of, materialise

#: Directions in a table's cells, width of a cell, directions that are
#: counted, half width of a window.
CELL_DIRECTIONS, CELL_WIDTH, COUNTED, WINDOW = 6, 1.5, 32, 0.75
#: Rows of a cell (or block of a cell) in one task.
TILE = 1024
#: Cells cut into blocks that may be broadcast (24 bytes each); beyond, a join.
MAX_BROADCAST_CELLS = 50_000
SEED = 20240601


def calibrate(threshold: float, recall: float) -> tuple[int, int]:
    """(tables, least count) for a pair right at ``threshold``."""
    d = sqrt(max(2.0 - 2.0 * threshold, 1e-12))  # spread of the projections' difference
    inside = erf(WINDOW / d / sqrt(2.0))
    slip = (1.0 - recall) / 4  # a quarter of what may be lost goes to the count

    def at_least(n: int) -> float:
        return sum(comb(COUNTED, i) * inside**i * (1 - inside) ** (COUNTED - i) for i in range(n, COUNTED + 1))

    least = max(n for n in range(COUNTED + 1) if at_least(n) >= 1.0 - slip)
    r = CELL_WIDTH / d
    cell = erf(r / sqrt(2.0)) - 2.0 / (sqrt(2.0 * pi) * r) * (1.0 - exp(-r * r / 2.0))
    meet = min(cell**CELL_DIRECTIONS, 1 - 1e-12)
    return max(1, ceil(log(3 * slip) / log(1.0 - meet))), least


@lru_cache(maxsize=8)
def _directions(dim: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell directions, cell offsets, counted directions) of a dimension."""
    rng = np.random.default_rng(SEED + dim)
    cells = rng.standard_normal((dim, tables * CELL_DIRECTIONS))
    offsets = rng.uniform(0, CELL_WIDTH, tables * CELL_DIRECTIONS)
    mix = rng.integers(1, 2**62, CELL_DIRECTIONS, dtype=np.int64) * 2 + 1
    counted = np.random.default_rng(SEED + 10_007 * dim).standard_normal((dim, COUNTED))
    return np.vstack([cells, offsets[None, :]]), mix, counted


def _unit(column: pa.Array) -> np.ndarray:
    x = np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _cell_keys(x: np.ndarray, tables: int) -> np.ndarray:
    """A 64-bit key of each row's cell in each table."""
    both, mix, _ = _directions(x.shape[1], tables)
    at = np.floor((x @ both[:-1] + both[-1]) / CELL_WIDTH).astype(np.int64).reshape(len(x), tables, CELL_DIRECTIONS)
    with np.errstate(over="ignore"):
        key = np.zeros((len(x), tables), dtype=np.int64)
        for j in range(CELL_DIRECTIONS):
            key = (key ^ (at[:, :, j] * mix[j])) * np.int64(-7046029254386353131)
            key ^= key >> 29
    return key


def collisions(p: np.ndarray, window: float = WINDOW) -> np.ndarray:
    """On how many columns of ``p`` each pair of rows lies within the window:
    each column is sorted, and a row's window is a range of ranks."""
    n = len(p)
    counts = np.zeros((n, n), dtype=np.uint8)
    for j in range(p.shape[1]):
        order = np.argsort(p[:, j], kind="stable")
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        line = p[order, j]
        lo = np.searchsorted(line, p[:, j] - window, "left").astype(np.int32)
        hi = np.searchsorted(line, p[:, j] + window, "right").astype(np.int32)
        counts += (rank[None, :] >= lo[:, None]) & (rank[None, :] < hi[:, None])
    return counts


def _local_roots(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id reachable from each of n nodes over the pairs (a, b)."""
    low = ids.copy()
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        if np.array_equal(new, low):
            return low
        low = new


def _tile_links(group: pa.Table, table: int, tables: int, same_block: bool, threshold: float, least: int):
    """(ids, links, roots) of the linked rows of one tile."""
    ids = group.column("rep").to_numpy()
    x = _unit(group.column("embedding").combine_chunks())
    keys = np.stack(group.column("keys").combine_chunks().to_numpy(zero_copy_only=False))
    many = group.column("mult").to_numpy()
    block = group.column("b").to_numpy()
    _, _, counted = _directions(x.shape[1], tables)
    hit = collisions(x @ counted) >= least
    a, b = np.nonzero(np.triu(hit, 1))
    if not same_block:
        across = block[a] != block[b]
        a, b = a[across], b[across]
    if table and len(a):
        fresh = ~(keys[a, :table] == keys[b, :table]).any(axis=1)
        a, b = a[fresh], b[fresh]
    good = np.zeros(len(a), dtype=bool)
    for at in range(0, len(a), 200_000):
        s = slice(at, at + 200_000)
        good[s] = (x[a[s]] * x[b[s]]).sum(axis=1) >= threshold
    a, b = a[good], b[good]
    if not len(a):
        return None
    n = np.zeros(len(ids), dtype=np.int64)
    np.add.at(n, a, many[b])
    np.add.at(n, b, many[a])
    roots = _local_roots(len(ids), a, b, ids)
    on = n > 0
    return ids[on], n[on], roots[on]


def usable(embedding: Column, label: Column) -> Column:
    """Not null, no null or non-finite component, not zero, with a label."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists(embedding, lambda v: v != 0)
    return label.isNotNull() & F.coalesce(~bad & some, F.lit(False))


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, recall: float = 0.98,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per input row.

    Links join vectors of equal label and dimension with a cosine, in double
    precision, of at least ``threshold``. ``n_links`` counts the other rows
    linked directly, ``component_id`` is the smallest vec_id reachable (the
    own one included), ``kept`` tells whether that is the row's own. Vectors
    that are null, zero or hold null or non-finite components, and rows with a
    null label or null id, link with nothing. Repeated rows are links of each
    other; an empty table gives no rows.
    """
    tables, least = calibrate(threshold, recall)
    e, lab = F.col(vector_col), F.col(label_col)
    rows = vectors.select(
        F.col(id_col).alias("vec_id"),
        F.when(usable(e, lab) & F.col(id_col).isNotNull(), F.xxhash64(lab, e)).alias("h1"),
        F.xxhash64(F.lit(1), e, lab).alias("h2"), lab.alias("label"), e.alias("embedding"),
    )
    groups = materialise(
        rows.where(F.col("h1").isNotNull()).groupBy("h1", "h2").agg(
            F.min("vec_id").cast("long").alias("rep"), F.count(F.lit(1)).alias("mult"),
            F.any_value("embedding").alias("embedding"),
            F.any_value(F.xxhash64("label", F.size("embedding"))).alias("space"),
        )
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            emb = batch.column(3)
            sizes = np.array([len(v) for v in emb])
            for dim in np.unique(sizes):
                take = pa.array(np.flatnonzero(sizes == dim))
                part = batch.take(take)
                keys = _cell_keys(_unit(part.column(3)), tables)
                flat = pa.array(keys.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), type=pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*batch.schema.names, "keys"])

    src = groups.select("rep", "mult", "space", "embedding")
    kind = src.schema["embedding"].dataType.simpleString()
    keyed = materialise(src.mapInArrow(deal, f"rep long, mult long, space long, embedding {kind}, keys array<long>"))
    cells = keyed.select("space", F.posexplode("keys").alias("t", "cell"))
    big = cells.groupBy("space", "t", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE).select(
        "space", "t", "cell", F.ceil(F.col("n") / TILE).cast("int").alias("blocks")
    )
    big = materialise(big)
    if big.count() <= MAX_BROADCAST_CELLS:
        big = F.broadcast(big)
    dealt = keyed.select("*", F.posexplode("keys").alias("t", "cell")).join(big, ["space", "t", "cell"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn(
        "o", F.explode(F.sequence(F.lit(0), blocks - 1))
    ).select(
        "space", "t", "cell", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "rep", "mult", "keys", "embedding"
    )
    where = ["space", "t", "cell", "i", "j"]
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, *where).sortWithinPartitions(*where)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in groups_of(batches, where):
            if group.num_rows < 2:
                continue
            found = _tile_links(group, int(key[1]), tables, key[3] == key[4], threshold, least)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["rep", "n", "root"])

    found = materialise(dealt.mapInArrow(verify, "rep long, n long, root long"))
    direct = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    info = (
        groups.select("h1", "h2", "rep", "mult").join(direct, "rep", "left")
        .join(comp.withColumnRenamed("id", "rep"), "rep", "left")
        .select("h1", "h2", (F.col("mult") - 1 + F.coalesce("n", F.lit(0).cast("long"))).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id"))
    )
    return rows.select("vec_id", "h1", "h2").join(info, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
