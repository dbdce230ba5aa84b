"""Ranked lexical search, reversed: the documents stream past the items.

The items' terms form an inverted index (term -> items that hold it, how
often), which is broadcast. A scan task counts each document's terms, walks the
postings of those that the index has, adds up a score per item and keeps the
best ``k`` documents of each item in a bounded heap; only the heaps are
shuffled and merged. Document statistics (number and length of documents, in
how many a term occurs) come from a first scan over all documents.

The index is measured before it is collected. Above ``max_index_bytes`` the
items go in hash blocks, each with its own pair of scans; an item's heap lives
in one block, so the result is the same. Weights and scores are integers.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.llm.common import pick, terms

#: Estimated bytes of the postings of one block of items.
MAX_INDEX_BYTES = 64 * 1024 * 1024
#: Bytes of a posting beside its term.
POSTING_BYTES = 64
#: Parts that an item's heaps are merged in first.
MERGE_BUCKETS = 32
#: Keys of the statistics rows that are no term: documents with a term, all terms.
N_DOCS, N_TERMS = -1, -2


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term binary, times long). Rows that repeat an item count once;
    rows of one id with different texts make one item. No text: no terms."""
    src = pick(items, item_col, text_col).toDF("item", "text").where(F.col("text").isNotNull()).distinct()
    kind = src.schema["item"].dataType.simpleString()
    src = src.select("item", F.col("text").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, times = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                counts = Counter(terms(text))
                ids += [i] * len(counts)
                found += counts.keys()
                times += counts.values()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(found, pa.binary()), pa.array(times, pa.int64())],
                names=["item", "term", "times"])

    found = src.mapInArrow(count, f"item {kind}, term binary, times long")
    return found.groupBy("item", "term").agg(F.sum("times").alias("times"))


class Index:
    """Postings of one block of items, by term number."""

    def __init__(self, rows: list) -> None:
        self.items = sorted({r["item"] for r in rows}, key=lambda i: (i is None, i))
        number = {i: n for n, i in enumerate(self.items)}
        by_term: dict[bytes, list[tuple[int, int]]] = {}
        for r in rows:
            by_term.setdefault(bytes(r["term"]), []).append((number[r["item"]], r["times"]))
        self.terms = {t: n for n, t in enumerate(sorted(by_term))}
        lists = [sorted(by_term[t]) for t in self.terms]
        self.starts = np.cumsum([0] + [len(p) for p in lists])
        self.item_of = np.array([i for p in lists for i, _ in p], dtype=np.int64)
        self.times = np.array([t for p in lists for _, t in p], dtype=np.int64)

    def weigh(self, stats: dict[int, int]) -> None:
        """Term weights from (term number -> documents that hold it)."""
        self.n_docs, self.n_terms = stats.get(N_DOCS, 0), stats.get(N_TERMS, 0)
        self.weights = np.array(
            [math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * stats.get(t, 0) + 1))) for t in range(len(self.terms))],
            dtype=np.int64)

    def counted(self, text: bytes | None) -> tuple[int, Counter]:
        """(number of terms of a text, how often it holds each indexed term)."""
        words = terms(text)
        counts = Counter(map(self.terms.get, words))
        counts.pop(None, None)
        return len(words), counts

    def scores(self, n: int, counts: Counter) -> np.ndarray:
        """Score of a document of ``n`` terms for every item."""
        out = np.zeros(len(self.items), dtype=np.int64)
        m = 75 + 25 * n * self.n_docs // self.n_terms
        found = np.fromiter(counts.keys(), np.int64, len(counts))
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        part = self.weights[found] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
        lo, size = self.starts[found], self.starts[found + 1] - self.starts[found]
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        np.add.at(out, self.item_of[at], np.repeat(part, size) * self.times[at])
        return out


def _statistics(texts: DataFrame, shared) -> dict[int, int]:
    """Sums over all documents; at most a row per indexed term comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        held = np.zeros(len(index.terms), dtype=np.int64)
        docs = length = 0
        for batch in batches:
            for text in batch.column(1):
                n, counts = index.counted(text.as_py())
                docs, length = docs + (n > 0), length + n
                held[list(counts)] += 1
        some = np.flatnonzero(held)
        keys, sums = np.r_[N_DOCS, N_TERMS, some], np.r_[docs, length, held[some]]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sums, pa.int64())], names=["key", "n"])

    rows = texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return {r["key"]: r["n"] for r in rows}


def _heaps(shared, k: int):
    """The best ``k`` documents of each item in one scan task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        heaps: list[list[tuple]] = [[] for _ in index.items]
        bar = np.ones(len(heaps), dtype=np.int64)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, counts = index.counted(text.as_py())
                if not counts:
                    continue
                scores = index.scores(n, counts)
                # of equal scores the smaller id is ahead, an id before none
                order = -math.inf if doc_id is None else -doc_id
                for item in np.flatnonzero(scores >= bar).tolist():
                    heap, entry = heaps[item], (int(scores[item]), order)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        bar[item] = heap[0][0]
        rows = [(i, s, None if o == -math.inf else -o) for i, heap in enumerate(heaps) for s, o in heap]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
            names=["item", "score", "doc_id"])

    return run


def _best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", max_index_bytes: int = MAX_INDEX_BYTES,
) -> DataFrame:
    """(item id, rank int, doc_id long, score long): the ``k`` documents with
    the highest score above 0 for each item; ties by ascending doc_id, a null
    id last. Fewer rows where fewer documents score; none for an item without
    terms. Every row of ``docs`` is a document, so repeated rows rank one after
    the other. Null and empty texts have no terms and count in no statistic.
    Ids are integers. Other columns of both tables are ignored.
    """
    spark = docs.sparkSession
    wanted = item_terms(items, item_col, item_text_col)
    size = wanted.agg(F.sum(F.octet_length("term") + POSTING_BYTES)).first()[0] or 0
    blocks = math.ceil(2 * size / max_index_bytes) if size > max_index_bytes else 1
    texts = pick(docs, id_col, text_col).toDF("doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    kind = wanted.schema["item"].dataType.simpleString()
    out = spark.createDataFrame([], f"{item_col} {kind}, rank int, doc_id long, score long")
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        index = Index(rows)
        counting = spark.sparkContext.broadcast(index)
        stats = _statistics(texts, counting)
        counting.destroy()
        if not stats.get(N_TERMS):
            break
        index.weigh(stats)
        found = texts.mapInArrow(_heaps(spark.sparkContext.broadcast(index), k), "item int, score long, doc_id long")
        found = found.withColumn("_b", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_BUCKETS)))
        best = _best(_best(found, ["item", "_b"], k), ["item"], k)
        names = spark.createDataFrame(list(enumerate(index.items)), f"item int, {item_col} {kind}")
        # at most k rows per item meet one row per item of this block
        out = out.unionByName(best.join(F.broadcast(names), "item").select(item_col, "rank", "doc_id", "score"))
    return out
