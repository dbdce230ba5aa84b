"""Best-fit packing of token sequences by hierarchical residual packing.

Texts become pieces of at most ``capacity`` tokens in the scan tasks. Each
partition packs its pieces best-fit, longest first, into bins. Bins that are
full to within ``slack`` tokens are closed. The underfull bins of ``fan_in``
partitions meet in one task, where they are items of another best-fit round;
what is still underfull goes up the tree, until one node is left. Only bins
move up, as rows (length, the level-0 bins inside); texts and ids stay.

A node hands at most ``max_open`` bins up, the emptiest ones; fuller ones are
closed as they are. That bounds every task, at no loss of pieces: it can only
cost filling, in tables whose partitions leave more than that many underfull
bins each.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import id_bytes, materialise

#: Rows tokenised before a result batch goes back to Spark.
SLICE_ROWS = 256
#: Space-separated chunks whose ids a worker remembers; starts anew beyond.
CACHE_ENTRIES = 1_000_000
#: The id that ends every document.
END = b"\0\0\0\0"
_TWO_SPACES = re.compile(r"\s\s")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Tokeniser:
    """Ids of whole texts by a ``tokenizers`` file.

    A byte-level pre-tokeniser starts a new pre-token at a lone space between
    two other characters, so a text may be cut before such spaces and the
    chunks, most of which repeat, encoded once each.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        if not text or text[0].isspace() or text[-1].isspace() or _TWO_SPACES.search(text):
            return _SINGLE_SPACE.split(text)
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        cut = [self.chunks(t) for t in texts]
        new = list(set().union(*(c[1:] for c in cut)).difference(cache))
        found = self.library.encode_batch_fast([" " + c for c in new], add_special_tokens=False)
        long: dict[str, bytes] = {}
        for c, e in zip(new, found):
            (cache if len(c) <= 48 else long)[c] = id_bytes(e.ids)
        heads = self.library.encode_batch_fast([c[0] for c in cut], add_special_tokens=False)
        look = cache.__getitem__ if not long else lambda c: cache[c] if c in cache else long[c]
        return [
            id_bytes(h.ids) + b"".join(map(look, c[1:]))
            for h, c in zip(heads, cut)
        ]


@lru_cache(maxsize=2)
def tokeniser(path: str) -> Tokeniser:
    """One per worker process."""
    return Tokeniser(path)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids binary): each text's ids and the end
    id, cut from the back into pieces of ``capacity`` ids when there are more,
    so the first piece may be shorter. Null text counts as empty."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                ids = tokeniser(path).encode(part.column(1).to_pylist())
                rows, number, start, length, body = [], [], [], [], []
                for r, b in enumerate(ids):
                    b += END
                    n = len(b) // 4
                    lo, k = 0, 0
                    hi = n if n <= capacity else (n % capacity or capacity)
                    while lo < n:
                        rows.append(r)
                        number.append(k)
                        start.append(lo)
                        length.append(hi - lo)
                        body.append(b[4 * lo:4 * hi])
                        lo, hi, k = hi, hi + capacity, k + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows, type=pa.int64())), pa.array(number, type=pa.int32()),
                        pa.array(start, type=pa.int64()), pa.array(length, type=pa.int64()),
                        pa.array(body, type=pa.binary()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return src.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit, longest first: (bin, offset) of each item and the bins' fill.

    Bins wait in lists by free space; a bitmap of the lists in use gives the
    tightest bin that still takes an item."""
    n = len(lengths)
    bin_of, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, fill = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = used >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = waiting[free].pop()
            if not waiting[free]:
                used ^= 1 << free
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += size
        left = free - size
        if left:
            if not waiting[left]:
                used |= 1 << left
            waiting[left].append(b)
    return bin_of, offset, np.array(fill, dtype=np.int64)


def _open_bins(fill: np.ndarray, capacity: int, slack: int, max_open: int) -> np.ndarray:
    """Which bins go on: not nearly full, the emptiest ``max_open`` at most."""
    go = capacity - fill > slack
    if go.sum() > max_open:
        order = np.argsort(fill, kind="stable")
        go[order[max_open:]] = False
    return go


def _merger(capacity: int, slack: int, max_open: int, fan_in: int, last: bool):
    """Best-fit of the bins that meet at one node of the tree."""

    def merge(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("bin", ignore_index=True)
        bin_of, offset, fill = best_fit(items["fill"].to_numpy(), capacity)
        go = np.zeros(len(fill), dtype=bool) if last else _open_bins(fill, capacity, slack, max_open)
        inside: list[list[int]] = [[] for _ in fill]
        at: list[list[int]] = [[] for _ in fill]
        for b, o, ids, offs in zip(bin_of, offset, items["inside"], items["at"]):
            inside[b].extend(int(x) for x in ids)
            at[b].extend(int(x) + int(o) for x in offs)
        return pd.DataFrame({
            "node": np.full(len(fill), int(key[0]) // fan_in), "bin": [x[0] for x in inside], "fill": fill,
            "inside": inside, "at": at, "go": go,
        })

    return merge


def pack(
    docs: DataFrame, path: str, capacity: int = 2048, derive: dict[str, Column] | None = None, keep_ids: bool = False,
    fan_in: int = 8, slack: int = 4, max_open: int = 4096, local_pieces: int = 8192, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, sequence_id, offset[, ids, derived
    columns]): every piece with its place in a sequence of at most
    ``capacity`` tokens, gapless from 0.

    ``derive`` adds columns computed from ``ids`` before they are dropped. Small
    partitions are joined (without a shuffle) until each holds about
    ``local_pieces`` pieces: best-fit wastes less the more it can choose from.
    Null text counts as empty (a piece of the end id alone); repeated rows are
    packed each; an empty table gives no rows; other columns are ignored.
    """
    cut = pieces(docs, path, capacity, id_col, text_col).withColumns(derive or {})
    rows = materialise(cut if keep_ids else cut.drop("ids"))
    rows = rows.coalesce(max(1, -(-rows.count() // local_pieces)))
    parts = rows.rdd.getNumPartitions()
    top = parts <= 1

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if not held:
            return
        at = TaskContext.get().partitionId()
        lengths = np.concatenate([f["length"].to_numpy() for f in held])
        bin_of, offset, fill = best_fit(lengths, capacity)
        go = np.zeros(len(fill), dtype=bool) if top else _open_bins(fill, capacity, slack, max_open)
        lo = 0
        for f in held:
            b, hi = bin_of[lo:lo + len(f)], lo + len(f)
            yield f.assign(bin=(at << 33) + b, bin_fill=fill[b], bin_open=go[b], offset=offset[lo:hi], part=at)
            lo = hi

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = materialise(rows.mapInPandas(
        local, schema + ", bin long, bin_fill long, bin_open boolean, offset long, part long"
    ))
    kept = [c for c in rows.columns]
    closed = placed.where("not bin_open").select(*kept, F.col("bin").alias("sequence_id"), "offset")
    if top:
        return closed

    # a bin: id, fill, the level-0 bins in it and their offsets
    bins = (
        placed.where("bin_open").select("part", "bin", "bin_fill").distinct()
        .select(F.floor(F.col("part") / fan_in).alias("node"), "bin", F.col("bin_fill").alias("fill"),
                F.array("bin").alias("inside"), F.array(F.lit(0).cast("long")).alias("at"))
    )
    done: list[DataFrame] = []
    nodes = -(-parts // fan_in)
    while True:
        last = nodes <= 1

        out = materialise(bins.groupBy("node").applyInPandas(
            _merger(capacity, slack, max_open, fan_in, last),
            "node long, bin long, fill long, inside array<long>, at array<long>, go boolean",
        ))
        done.append(out.where("not go"))
        if last:
            break
        bins, nodes = out.where("go").drop("go"), -(-nodes // fan_in)
    final = done[0]
    for d in done[1:]:
        final = final.unionByName(d)
    moves = final.select(F.col("bin").alias("sequence_id"), F.explode(F.arrays_zip("inside", "at")).alias("m")).select(
        "sequence_id", F.col("m.inside").alias("bin"), F.col("m.at").alias("base")
    )
    opened = placed.where("bin_open").join(moves, "bin").select(
        *kept, "sequence_id", (F.col("offset") + F.col("base")).alias("offset")
    )
    return closed.unionByName(opened)
