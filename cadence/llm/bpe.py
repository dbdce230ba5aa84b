"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token starts as a linked list of its bytes. Every neighbouring pair that
some merge joins lies, by its left position, in the bucket of that merge's
rank. A bitmap has one bit per rank for the buckets in use, and the level
above it one bit per word below, so find-first-set on one word per level gives
the smallest waiting rank. A merge changes the pairs on its two
sides; their old entries stay in the buckets and are skipped when met (the
position's present rank is another by then). The cost grows with the length
of a pre-token times a constant, whatever its length.

Spark reads and splits the texts; ``mapInArrow`` encodes a few hundred rows at
a time, one text after the other, so memory holds one slice and a bounded
cache of short pre-tokens. No shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import id_bytes

#: Width of a bitmap word, and its single bits.
SHIFT = 8
WORD = 1 << SHIFT
MASK = WORD - 1
BIT = [1 << i for i in range(WORD)]
#: Rows encoded before a result batch goes back to Spark.
SLICE_ROWS = 256
#: Short pre-tokens whose ids a worker remembers; the store starts anew beyond.
CACHE_ENTRIES, CACHE_CHARS = 1_000_000, 48
#: Pre-tokens of a text held at once.
MATCHES = 200_000


class RankQueue:
    """Positions by merge rank; takes the smallest rank first.

    ``words`` has a bit per rank, ``top`` a bit per word in use. Words are
    ``WORD`` bits wide: Python finds the lowest set bit of such an integer in
    one step, so two levels do for vocabularies up to WORD * WORD and more.
    """

    def __init__(self, n_ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.words = [0] * (n_ranks // WORD + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        i = rank >> SHIFT
        if not self.words[i]:
            self.top |= 1 << i
        self.words[i] |= BIT[rank & MASK]

    def pop(self) -> tuple[int, list[int]] | None:
        """The smallest waiting rank and all positions in its bucket."""
        top = self.top
        if not top:
            return None
        i = (top & -top).bit_length() - 1
        word = self.words[i]
        low = word & -word
        self.words[i] = word = word ^ low
        if not word:
            self.top = top ^ (1 << i)
        rank = (i << SHIFT) | (low.bit_length() - 1)
        return rank, self.buckets.pop(rank)


class Codec:
    """Ranks of a tiktoken file, its pattern and a rank queue."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        push, pop, longest = self.queue.push, self.queue.pop, self.longest
        n = len(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        # rank of the pair that starts here; -1: none, or merged away
        pair = [get(piece[i:i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        for i, r in enumerate(pair):
            if r >= 0:
                push(r, i)
        left_over = n
        while (found := pop()) is not None:
            rank, places = found
            if len(places) > 1:
                places.sort()
            for k, i in enumerate(places):
                if pair[i] != rank:
                    continue
                gone = after[i]
                end = after[i] = after[gone]
                pair[gone] = -1
                before[end] = i
                left_over -= 1
                lower = False
                r = -1
                if end < n:
                    stop = after[end]
                    if stop - i <= longest:
                        r = get(piece[i:stop], -1)
                        if r >= 0:
                            push(r, i)
                            lower = r < rank
                pair[i] = r
                left = before[i]
                if left >= 0:
                    r = get(piece[left:end], -1) if end - left <= longest else -1
                    if r != pair[left]:
                        pair[left] = r
                        if r >= 0:
                            push(r, left)
                            lower |= r < rank
                if lower:  # a smaller rank has come up: it goes first
                    for j in places[k + 1:]:
                        push(rank, j)
                    break
        ranks, out, i = self.ranks, [], 0
        for _ in range(left_over):
            end = after[i]
            out.append(ranks[piece[i:end]])
            i = end
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if len(text) <= MATCHES:
            return self._ids(self.pattern.findall(text))
        found, parts = self.pattern.finditer(text), []
        while some := [m.group() for m in islice(found, MATCHES)]:
            parts.append(self._ids(some))
        return b"".join(parts)

    def _ids(self, pieces: list[str]) -> bytes:
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        out = list(map(cache.get, pieces))
        for i, known in enumerate(out):
            if known is None:
                p = pieces[i]
                known = cache.get(p)
                if known is None:
                    known = id_bytes(self.merge(p.encode()))
                    if len(p) <= CACHE_CHARS:
                        cache[p] = known
                out[i] = known
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        tokens, out = self.tokens, []
        for at in range(0, len(ids), 4 * MATCHES):
            some = np.frombuffer(ids[at:at + 4 * MATCHES], dtype="<u4").tolist()
            out.append(b"".join(map(tokens.__getitem__, some)))
        return b"".join(out)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per worker process."""
    return Codec(path, pattern)


def _with_column(name: str, source: str, convert) -> callable:
    """A mapInArrow function that adds the binary column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                column = part.column(part.schema.get_field_index(source))
                made = [convert(v.as_py()) for v in column]
                arrays = [*part.columns, pa.array(made, type=pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, name])

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): the ids of each text, little-endian u32.

    Each match of ``pattern`` is encoded by itself; there are no special
    tokens. Null text counts as empty (no ids); repeated rows stay; an empty
    table gives no rows; other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fn = _with_column("ids", "text", lambda t: codec(path, pattern).encode(t))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(fn, f"doc_id {kind}, text string, ids binary").select("doc_id", "ids")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, decoded binary): the bytes that the ids stand for. Null
    ids decode to no bytes; an id outside the vocabulary is an error."""
    src = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))
    fn = _with_column("decoded", "ids", lambda b: codec(path, pattern).decode(b))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(fn, f"doc_id {kind}, ids binary, decoded binary")
