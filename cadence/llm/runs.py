"""Periodic runs of words: maximal stretches that repeat a short piece.

A run has a smallest period q and at least ``max(least, 3 * q)`` words, and no
neighbouring word continues it. Method, by scale tiles: for every octave of
periods [Q, 2Q) a document is covered by tiles of 12 Q words that overlap by
6 Q. A run of the octave has at least 3 q words, so each tile that it crosses
holds a fragment of at least that many, and fragments in neighbouring tiles
overlap. Tiles are solved by themselves: every Q words lies a boundary, and a
fragment covers one with Q equal words ahead; Q-gram hashes tell where that may
be, and Z-functions forwards and backwards from the boundary give the exact
extent for all periods at once. The fragments (never the tiles) are shuffled
by document and period and stitched where they overlap; of equal stretches the
smallest period stays.

A document costs O(n log n) steps; only documents with a fragment have their
text carried to the last step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.llm.common import materialise, pick

#: Words of the shortest run.
LEAST = 24
#: Lowest octave: it has the periods below 2 * BASE, whose runs of LEAST words
#: or more hold 2 * BASE equal words.
BASE = 8
#: Words of a tile and between tile starts, in units of its octave.
TILE, STRIDE = 12, 6
#: Compared (boundary, period) cells in one step.
CELLS = 1_000_000
FRAGMENT = pa.struct([("period", pa.int64()), ("s", pa.int64()), ("x", pa.int64())])
RUN_TYPE = "array<struct<start:long,length:long,period:long>>"


def z_function(s: list, upto: int) -> list[int]:
    """z[i] for i < upto: how many items from i on equal those from 0 on."""
    n, z, left, right = len(s), [0] * upto, 0, 0
    for i in range(1, upto):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve_tile(tile: list[int], hits: list[tuple[int, list[int]]]) -> list[tuple[int, int, int]]:
    """Fragments (period, s, x) of a tile: the items s..x-1 equal those one
    period later. ``hits``: boundaries with the periods that may cross them."""
    out, reached = [], {}
    for c, periods in hits:
        periods = [q for q in periods if reached.get(q, -1) <= c]
        if not periods:
            continue
        far = max(periods)
        ahead = z_function(tile[c:], far + 1)
        before = tile[:c][::-1]
        back = z_function([*before, -1, *tile[:c + far][::-1]], c + 2 + far) if c else None
        for q in periods:
            s, x = c - (back[c + 1 + far - q] if back else 0), c + ahead[q]
            reached[q] = x
            if x - s + q >= max(LEAST, 3 * q):
                out.append((q, s, x))
    return out


def fragments(words: list) -> list[tuple[int, int, int]]:
    """Fragments of all tiles of a document, in its own word numbers."""
    n, out = len(words), []
    if n < LEAST:
        return out
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    grams, factor, width = mixed ^ (mixed >> np.uint64(29)), 0xBF58476D1CE4E5B9, 1
    octave = BASE
    while octave == BASE or 3 * octave <= n:
        while width < octave:  # hashes of twice as many words
            grams = grams[:-width] * np.uint64(factor) + grams[width:]
            factor, width = factor * factor % (1 << 64), 2 * width
        first = 1 if octave == BASE else octave
        periods = np.arange(first, min(2 * octave, n // 3 + 1))
        if len(grams) > first:
            out += _octave(ids, grams, octave, periods)
        octave *= 2
    return out


def _octave(ids: np.ndarray, grams: np.ndarray, octave: int, periods: np.ndarray) -> list[tuple[int, int, int]]:
    by_tile: dict[int, dict[int, list[int]]] = {}
    n, last, stride, size = len(ids), len(grams), STRIDE * octave, TILE * octave
    step = max(1, CELLS // len(periods)) * octave
    for lo in range(0, last, step):
        bounds = np.arange(lo, min(lo + step, last), octave)
        there = bounds[:, None] + periods[None, :]
        same = (grams[np.minimum(there, last - 1)] == grams[bounds][:, None]) & (there < last)
        for b, p in zip(*(v.tolist() for v in np.nonzero(same))):
            c, q = int(bounds[b]), int(periods[p])
            for j in (c // stride - 1, c // stride):
                tiled = j >= 0 and (j == 0 or (j + 1) * stride < n) and c + q + octave <= j * stride + size
                if tiled:
                    by_tile.setdefault(j, {}).setdefault(c - j * stride, []).append(q)
    out = []
    for j, hits in by_tile.items():
        at = j * stride
        out += [(q, s + at, x + at) for q, s, x in solve_tile(ids[at:at + size].tolist(), sorted(hits.items()))]
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, found, whole, carried = [], [], [], []
        for text in batch.column(1):
            words = (text.as_py() or b"").split()
            own = fragments(words)
            n.append(len(words))
            found.append([{"period": q, "s": s, "x": x} for q, s, x in own])
            joined = b" ".join(words)
            whole.append(None if own else joined)
            carried.append(joined if own else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(FRAGMENT)),
             pa.array(whole, pa.binary()), pa.array(carried, pa.binary())],
            names=["id", "n_words", "fragments", "collapsed", "words"])


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops the words of every run after its first period."""
    for batch in batches:
        left = []
        for words, runs in zip(batch.column(2), batch.column(3).to_pylist()):
            words = words.as_py().split()
            keep = np.ones(len(words), dtype=bool)
            for r in runs:
                keep[r["start"] + r["period"]:r["start"] + r["length"]] = False
            left.append(b" ".join([words[i] for i in np.flatnonzero(keep)]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), pa.array(left, pa.binary())],
            names=["id", "n_words", "runs", "collapsed"])


def stitch(found: DataFrame) -> DataFrame:
    """(key, start, length, period) of the runs, from rows (key, period, s, x)
    of fragments. Fragments of one run overlap; two runs of one period don't."""
    w = Window.partitionBy("key", "period").orderBy("s", "x")
    before = F.max("x").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("_new", F.when(before >= F.col("s"), 0).otherwise(1))
    numbered = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("key", "period", "_run").agg(F.min("s").alias("start"), F.max("x").alias("x"))
    length = (F.col("x") - F.col("start") + F.col("period")).alias("length")
    return whole.select("key", "start", length, "period").groupBy("key", "start", "length").agg(F.min("period").alias("period"))


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", derive: dict[str, Column] | None = None
) -> DataFrame:
    """(id, n_words long, runs, collapsed string), one row per row of ``docs``.

    ``runs`` are structs (start, length, period) in words, by start and period;
    ``collapsed`` is the text without the words that any run holds after its
    first period, joined by single spaces. ``derive`` names columns over
    ``collapsed`` to return in its place, so that texts without a run are not
    kept. Words are separated by space and U+0009 to U+000D. Null, empty and
    short texts have no runs; repeated rows and null ids each get their row.
    Other columns are ignored.
    """
    derive = derive or {"collapsed": F.col("collapsed")}
    src = pick(docs, id_col, text_col).toDF("id", "text")
    kind = src.schema["id"].dataType.simpleString()
    text = F.col("collapsed").cast("string").alias("collapsed")

    def derived(df: DataFrame, *others: str) -> DataFrame:
        told = df.select(*others, text)
        return told.select(*others, *[c.alias(n) for n, c in derive.items()])

    scanned = src.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(
        _scan, f"id {kind}, n_words long, fragments array<struct<period:long,s:long,x:long>>, collapsed binary, words binary")
    scanned = materialise(derived(scanned, "id", "n_words", "fragments", "words"))
    plain = scanned.where(F.col("words").isNull()).select("id", "n_words", F.array().cast(RUN_TYPE).alias("runs"), *derive)
    periodic = scanned.where(F.col("words").isNotNull()).withColumn("key", F.monotonically_increasing_id())
    found = periodic.select("key", F.inline("fragments"))
    runs = stitch(found).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    told = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    joined = periodic.select("key", "id", "n_words", "words").join(runs, "key").select("id", "n_words", "words", told.alias("runs"))
    collapsed = joined.mapInArrow(_collapse, f"id {kind}, n_words long, runs {RUN_TYPE}, collapsed binary")
    out = plain.unionByName(derived(collapsed, "id", "n_words", "runs"))
    return out.withColumnRenamed("id", id_col)
