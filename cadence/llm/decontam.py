"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``window`` consecutive words (a shorter item is
one window), a window into shingles of up to ``SHINGLE`` words. Shingles are
ordered by rarity, their document frequency over all documents. A window
occurs in a document only if all its shingles do, so of that order a prefix of
one shingle is necessary: its rarest. The join takes a document's occurrences
of such prefix shingles to the windows that wait for them. The shingle's place
in the window fixes where the window would lie; the length bound drops places
that reach over either end of the document, and the words of that window are
compared one by one, which is exact.

The windows are the small side: they are measured, then broadcast. Above
``max_index_bytes`` they go in hash blocks, each with its own scans, and the
blocks' spans are united per document. The documents are scanned twice (once
for the shingles' frequencies) and never shuffled in the usual case of one
block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import materialise, pick, terms

#: Words of a window's shingles (of its whole, if it has fewer).
SHINGLE = 3
#: Estimated bytes of one block of windows, and of a window beside its words.
MAX_INDEX_BYTES = 64 * 1024 * 1024
WINDOW_BYTES = 400
#: Words of the documents that are handled in one step.
STEP_WORDS = 500_000
SPANS = "array<struct<start:long,stop:long>>"


def item_windows(items: DataFrame, window: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item string, words string): the distinct windows of every item, their
    words joined by spaces. No words: no window. A null id is ''."""
    src = pick(items, item_col, text_col).toDF("item", "text")
    src = src.select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, text in enumerate(batch.column(1)):
                words = terms(text.as_py())
                own = {b" ".join(words[j:j + window]) for j in range(max(1, len(words) - window + 1))} if words else ()
                ids += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(found, pa.binary())], names=["item", "words"])

    return src.mapInArrow(cut, "item string, words binary").distinct()


class Index:
    """Windows of one block: their word numbers, shingles and items."""

    def __init__(self, rows: list) -> None:
        by_words: dict[bytes, list[str]] = {}
        for r in rows:
            by_words.setdefault(bytes(r["words"]), []).append(r["item"])
        cut = [w.split() for w in sorted(by_words)]
        self.items = [sorted(by_words[w]) for w in sorted(by_words)]
        self.word = {w: i for i, w in enumerate(sorted({x for w in cut for x in w}))}
        self.size = np.array([len(w) for w in cut], dtype=np.int64)
        self.words = np.full((len(cut), self.size.max()), -2, dtype=np.int64)
        for i, w in enumerate(cut):
            self.words[i, :len(w)] = [self.word[x] for x in w]
        # shingles of 1, 2, ... words are numbered by (number of all but the
        # last word, last word)
        flat = np.full((len(cut), self.words.shape[1] + SHINGLE), -1, dtype=np.int64)
        flat[:, :self.words.shape[1]] = np.maximum(self.words, -1)
        flat = flat.ravel()
        self.codes: list[np.ndarray] = []
        for k in range(2, SHINGLE + 1):
            code = self._code(self._numbers(flat, k - 1), flat, k)
            self.codes.append(np.unique(code[code >= 0]))
        self.offsets = np.cumsum([0, len(self.word), *[len(c) for c in self.codes]])
        self.n_shingles = int(self.offsets[-1])
        self.width = np.minimum(self.size, SHINGLE)
        self.flat_shape = (len(cut), self.words.shape[1] + SHINGLE)
        self.flat = flat

    def _code(self, head: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """Code of the k words at each place, -1 where the index lacks any."""
        tail = np.r_[ids[k - 1:], np.full(k - 1, -1)]
        return np.where((head >= 0) & (tail >= 0), head * len(self.word) + tail, -1)

    def _numbers(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Number among the shingles of k words at each place, or -1."""
        numbers = ids
        for j in range(2, k + 1):
            code, known = self._code(numbers, ids, j), self.codes[j - 2]
            numbers = np.full(len(ids), -1)
            maybe = np.flatnonzero(code >= 0)
            if len(maybe) and len(known):
                at = np.minimum(np.searchsorted(known, code[maybe]), len(known) - 1)
                right = known[at] == code[maybe]
                numbers[maybe[right]] = at[right]
        return numbers

    def shingles(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Shingle of k words at each place of a sequence of word numbers
        (-1: a word that the index lacks, or a gap), or -1."""
        numbers = self._numbers(ids, k)
        return np.where(numbers >= 0, numbers + self.offsets[k - 1], -1)

    def widths(self) -> list[int]:
        return np.unique(self.width).tolist()

    def choose(self, frequency: dict[int, int]) -> None:
        """Takes each window's rarest shingle for its prefix. A window with a
        shingle that no document has is left out."""
        df = np.zeros(self.n_shingles, dtype=np.int64)
        for s, n in frequency.items():
            df[s] = n
        windows, shingles, places = [], [], []
        for k in self.widths():
            grid = self.shingles(self.flat, k).reshape(self.flat_shape)
            for i in np.flatnonzero(self.width == k).tolist():
                own = grid[i, :self.size[i] - k + 1]
                rarest = min(range(len(own)), key=lambda j: (df[own[j]], own[j], j))
                if df[own[rarest]]:
                    windows.append(i)
                    shingles.append(int(own[rarest]))
                    places.append(rarest)
        order = np.argsort(np.array(shingles, dtype=np.int64), kind="stable")
        self.waiting = np.array(windows, dtype=np.int64)[order]
        self.place = np.array(places, dtype=np.int64)[order]
        self.starts = np.searchsorted(np.array(shingles, dtype=np.int64)[order], np.arange(self.n_shingles + 1))

    def occurrences(self, ids: np.ndarray, doc: np.ndarray, first: np.ndarray, stop: np.ndarray):
        """(place, window) of all windows in a sequence of documents. ``doc``:
        number of each word's document; ``first``, ``stop``: its bounds."""
        found = []
        for k in self.widths():
            s = self.shingles(ids, k)
            at = np.flatnonzero(s >= 0)
            s = s[at]
            n = self.starts[s + 1] - self.starts[s]
            at, lo, n = at[n > 0], self.starts[s][n > 0], n[n > 0]
            slot = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            at, window = np.repeat(at, n), self.waiting[slot]
            own, start = doc[at], at - self.place[slot]
            fits = (self.width[window] == k) & (start >= first[own]) & (start + self.size[window] <= stop[own])
            start, window = start[fits], window[fits]
            for j in range(self.words.shape[1]):
                more = self.size[window] > j
                same = ~more
                same[more] = ids[start[more] + j] == self.words[window[more], j]
                start, window = start[same], window[same]
            found.append((start, window))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _steps(batches: Iterator[pa.RecordBatch], index: Index):
    """(ids of the documents, hashes, word numbers with a gap after each
    document, number of words of each)."""
    for batch in batches:
        keys, ids, sizes = [], [], []
        for row, text in enumerate(batch.column(batch.num_columns - 1)):
            words = terms(text.as_py())
            keys.append(row)
            sizes.append(len(words))
            ids += map(index.word.get, words, repeat(-1))
            ids.append(-1)
            if len(ids) >= STEP_WORDS:
                yield batch.take(pa.array(keys, pa.int64())), np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.int64)
                keys, ids, sizes = [], [], []
        if keys:
            yield batch.take(pa.array(keys, pa.int64())), np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.int64)


def _frequencies(texts: DataFrame, shared) -> dict[int, int]:
    """Document frequency of the index's shingles over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        total = np.zeros(index.n_shingles, dtype=np.int64)
        for _, ids, sizes in _steps(batches, index):
            doc = np.repeat(np.arange(len(sizes)), sizes + 1)
            for k in index.widths():
                s = index.shingles(ids, k)
                at = np.flatnonzero(s >= 0)
                once = np.unique(doc[at] * index.n_shingles + s[at])
                total += np.bincount(once % index.n_shingles, minlength=index.n_shingles)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["key", "n"])

    rows = texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return {r["key"]: r["n"] for r in rows}


def _spans(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for rows, ids, sizes in _steps(batches, index):
            first = np.cumsum(sizes + 1) - sizes - 1
            doc = np.repeat(np.arange(len(sizes)), sizes + 1)
            start, window = index.occurrences(ids, doc, first, first + sizes)
            depth = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(depth, start, 1)
            np.add.at(depth, start + index.size[window], -1)
            edge = np.diff(np.r_[0, np.cumsum(depth) > 0].astype(np.int8))
            lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            spans: list[list[dict]] = [[] for _ in sizes]
            for a, b, d in zip(lo.tolist(), hi.tolist(), doc[lo].tolist()):
                spans[d].append({"start": a - int(first[d]), "stop": b - int(first[d])})
            items: list[set] = [set() for _ in sizes]
            for d, w in np.unique(np.stack([doc[start], window], axis=1), axis=0).tolist():
                items[d].update(index.items[w])
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:-1], pa.array(sizes), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                 pa.array([sorted(i) for i in items], pa.list_(pa.string()))],
                names=["doc_id", "hash", "n_words", "spans", "items"])

    return run


def united(spans: Column) -> Column:
    """Overlapping and touching spans made one, in order."""
    return F.aggregate(
        F.sort_array(spans), F.array().cast(SPANS),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["stop"] >= s["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], s["stop"]).alias("stop")))),
        ).otherwise(F.concat(done, F.array(s))),
    )


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", max_index_bytes: int = MAX_INDEX_BYTES,
) -> DataFrame:
    """(id, n_words long, spans, items), one row per row of ``docs``.

    ``spans`` are the stretches (start, stop) of words that occurring windows
    cover, ``items`` the ids (as strings, in order) of the items that have such
    a window. Words are runs of letters, digits and characters beyond ASCII,
    lower-cased in A-Z. Null and empty texts have no words; an item without
    words has no window, an item without an id is ''. Repeated rows and null
    ids each get their row; other columns are ignored.
    """
    spark = docs.sparkSession
    windows = item_windows(items, window, item_col, item_text_col)
    size = windows.agg(F.sum(F.octet_length("words") + F.octet_length("item") + WINDOW_BYTES)).first()[0] or 0
    blocks = math.ceil(2 * size / max_index_bytes) if size > max_index_bytes else 1
    texts = pick(docs, id_col, text_col).toDF("doc_id", "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    texts = texts.select("doc_id", F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text"))
    schema = f"doc_id {kind}, hash long, n_words long, spans {SPANS}, items array<string>"
    parts = []
    for b in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        index = Index(rows)
        counting = spark.sparkContext.broadcast(index)
        frequency = _frequencies(texts.select("text"), counting)
        counting.destroy()
        index.choose(frequency)
        parts.append(texts.mapInArrow(_spans(spark.sparkContext.broadcast(index)), schema))
    if not parts:
        none = F.split(F.trim(F.regexp_replace(F.col("text").cast("string"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")), " ")
        n = F.size(F.filter(F.coalesce(none, F.array().cast("array<string>")), lambda x: x != "")).cast("long")
        out = texts.select("doc_id", n.alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    elif len(parts) == 1:
        out = parts[0]
    else:
        # rows of one id and text have equal results: the blocks meet by both
        key = [F.col("doc_id"), F.col("hash")]
        base = materialise(parts[0])
        found = base.where(F.size("spans") > 0)
        for p in parts[1:]:
            found = found.unionByName(p.where(F.size("spans") > 0))
        found = found.dropDuplicates(["doc_id", "hash", "spans", "items"]).groupBy(*key).agg(
            F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
        found = found.select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), united(F.col("s")).alias("s"), "i")
        met = base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")), "left")
        out = met.select("doc_id", "n_words", F.coalesce("s", F.array().cast(SPANS)).alias("spans"),
                         F.coalesce("i", F.array().cast("array<string>")).alias("items"))
    return out.select(F.col("doc_id").alias(id_col), "n_words", "spans", "items")
