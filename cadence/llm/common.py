"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.session import checkpoint_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables, by any path Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever else the table has (other
    columns may differ from them in case only)."""
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{df.columns.index(n)}").alias(n) for n in names])


def wrapped(df: DataFrame, *names: str) -> DataFrame:
    """(row, the columns of exactly these names): ``row`` holds the whole row
    in one struct, so that no other column can clash with what a stage adds."""
    fields = [f"_{i}" for i in range(len(df.columns))]
    plain = df.toDF(*fields)
    return plain.select(F.struct(*fields).alias("row"), *[F.col(f"_{df.columns.index(n)}").alias(n) for n in names])


def unwrapped(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` from the rows that ``wrapped`` made of it."""
    return rows.select(*[F.col(f"row._{i}").alias(c) for i, c in enumerate(like.columns)])


#: UTF-8 byte -> itself in a term (A-Z lower-cased), space between terms. Terms
#: are runs of letters, digits and characters beyond ASCII.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, repeats included."""
    return text.translate(TERM_BYTES).split() if text else []


def fold(id_col: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (null id: null)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string")) % F.lit(n)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


def batch_columns(batch: pa.RecordBatch, *names: str) -> list:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The consecutive groups of equal key columns in a sorted partition.

    A group may reach over several batches; it is handed out whole. Callers
    bound the size of a group (tiles), so a group fits in memory.
    """
    held: list[pa.RecordBatch] = []
    held_key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = batch_columns(batch, *keys)
        arrays = [c.to_numpy(zero_copy_only=False) for c in cols]
        change = np.zeros(batch.num_rows, dtype=bool)
        for a in arrays:
            change[1:] |= a[1:] != a[:-1]
        starts = np.r_[0, np.flatnonzero(change), batch.num_rows]
        for lo, hi in zip(starts[:-1], starts[1:]):
            key = tuple(a[lo] for a in arrays)
            piece = batch.slice(lo, hi - lo)
            if key == held_key:
                held.append(piece)
                continue
            if held:
                yield held_key, pa.Table.from_batches(held)
            held, held_key = [piece], key
    if held:
        yield held_key, pa.Table.from_batches(held)


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every id that has an edge.

    ``edges``: (src long, dst long), undirected, self loops allowed. Returns
    (id long, component long). Alternates the two star contractions: every
    node links its larger neighbours to its smallest one, then its smaller
    neighbours and itself to the smallest. Both keep reachability, and at the
    fixed point every component is a star around its smallest id. Everything
    stays in distributed tables; each round is checkpointed in the shared
    folder, so a lost executor costs one round. A hub's rows meet one row of
    the per-node minimum in an inner join, which AQE splits when it is skewed.
    """
    e = materialise(
        edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    loops = e.where("u = v").select(F.col("u").alias("id"))
    links = e.where("u > v")
    while True:
        # large star: both directions, larger neighbours move to the minimum
        both = links.union(links.select("v", "u"))
        low = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        low = low.select("n", F.least("n", "m").alias("m"))
        large = (
            both.where("v > u").join(low, both["u"] == low["n"])
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # small star: u's smaller neighbours (and u) move to the minimum
        small_min = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        moved = large.join(small_min, large["u"] == small_min["n"])
        small = (
            moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small_min.select(F.col("n").alias("u"), F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        nxt = materialise(small)
        same = nxt.join(links, ["u", "v"], "left_anti").isEmpty() and links.join(nxt, ["u", "v"], "left_anti").isEmpty()
        links = nxt
        if same:
            break
    stars = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    centres = links.select(F.col("v").alias("id")).union(loops).distinct()
    alone = centres.join(stars, "id", "left_anti").select("id", F.col("id").alias("component"))
    return stars.union(alone)
