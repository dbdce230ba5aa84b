"""Toxicity by the nearest labelled examples.

The vector space: every word of a bounded sample of labelled texts (on request
also the beginnings of its words). A text's unit vector holds their TF-IDF
weights; document frequencies are counted over the whole corpus. IDF alone
ranks rare topical words first, so a term's weight is its IDF times a relevance
that grows smoothly with its likelihood-ratio statistic against the label,
from ``LEAST_WEIGHT`` for a term that tells nothing to 1. No term is left out:
any text that shares a word with an example gets neighbours.

Examples lie in an inverted index of blocks; each list keeps its largest weight
in each block, and long lists lie in rows over all examples. A query adds up
its short lists and the long ones with the largest possible products. The
largest weights of the others, block by block, bound what an example can still
get; only those that can reach the k-th sum so far are scored in full, so the
cosines and the neighbours are exact.
Neighbours vote with their squared cosine and the inverse of their label's
sampling rate; a constant of doubt pulls weak evidence towards the base rate.

Bounded on the driver: the sampled examples (``max_toxic``, ``max_clean``,
each of at most ``MAX_CHARS`` characters) and so their terms. Sampling takes
the smallest hashes of texts, so it is the same on every run. Everything else
runs over all rows in scan tasks.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import materialise

#: Sampled examples of either label, and characters of the longest.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1000, 3000, 200_000
#: Relevance of a term: ``LEAST_WEIGHT`` plus the square of g / (g + HALF_G2),
#: g being its test statistic if it is likelier in texts of label 1, else 0.
LEAST_WEIGHT, HALF_G2 = 0.02, 25.0
#: Neighbours, examples in a block, doubt in votes.
K, BLOCK, DOUBT = 15, 64, 0.5
#: A list is long if one in so many examples is in it; so many of the longest
#: are kept as rows over all examples, so many of a query's are added unbounded.
LONG, LONG_ROWS, FIRST = 8, 1000, 16
_WORD, _GAP = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")
#: Characters of a text whose words are held at once.
WORDS = 200_000
#: Rows whose texts are held at once, and how many texts a task remembers.
SLICE_ROWS, REMEMBERED = 500, 50_000
#: A word's hash is the sum of its letters times the powers of an odd base,
#: modulo 2 ** 64; a beginning's has the mark added.
_BASE, _MARK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def term_counts(text: str, starts: tuple[int, ...] = (4, 5)) -> dict[str, int]:
    """Occurrences of each word and of the beginnings, of these lengths, of
    longer words."""
    out: dict[str, int] = {}
    for m in _WORD.finditer(text.lower()):
        w = m.group()
        out[w] = out.get(w, 0) + 1
        for n in starts:
            if len(w) > n:
                p = "^" + w[:n]
                out[p] = out.get(p, 0) + 1
    return out


class Vocabulary:
    """Terms and their weights. A text's words are found and looked up all at
    once: each gets a 64-bit hash, the hashes are searched among those of the
    terms, and what is found is compared letter by letter. So no text leaves
    anything behind in a worker."""

    def __init__(self, terms: list[str], weight: np.ndarray | None = None):
        self.terms = sorted(terms)
        self.weight = np.ones(len(self.terms)) if weight is None else weight
        beginning = np.array([t[0] == "^" for t in self.terms], dtype=bool)
        words = [t.removeprefix("^") for t in self.terms]
        size = np.array([len(w) for w in words], dtype=np.int64)
        #: Letters of the terms one after the other, without the mark.
        self.letters, self.first = _codes("".join(words)), np.r_[0, np.cumsum(size)]
        self.kind, self.longest = 2 * size + beginning, int(size.max(initial=0))
        self.starts = sorted(set(size[beginning].tolist()))
        self._powers(self.longest)
        place = np.arange(len(self.letters)) - np.repeat(self.first[:-1], size)
        key = np.add.reduceat(self.letters * self.up[place], self.first[:-1]) if len(words) else np.zeros(0, dtype=np.uint64)
        key[beginning] += _MARK
        #: Term numbers by ascending hash, and the hashes.
        self.by_key = np.argsort(key, kind="stable")
        self.keys = key[self.by_key]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two terms have one hash: change _BASE")

    @cached_property
    def number(self) -> dict[str, int]:
        """Term -> its number."""
        return {t: i for i, t in enumerate(self.terms)}

    @cached_property
    def terms(self) -> list[str]:
        """The terms, ascending."""
        text = self.letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        ends = zip(self.first[:-1].tolist(), self.first[1:].tolist(), (self.kind % 2).tolist())
        return ["^" * mark + text[lo:hi] for lo, hi, mark in ends]

    def _powers(self, n: int) -> None:
        """``up`` and ``down``: the powers of ``_BASE`` and of its inverse, for
        at least ``n`` letters."""
        if n > len(self.up):
            n = 1 << max(n - 1, 4095).bit_length()
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, dtype=np.uint64)]) for b in (_BASE, _INVERSE))

    up = down = np.zeros(0, dtype=np.uint64)

    def counts(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each whole text: numbers of the terms in it, ascending, and how
        often each occurs. Short texts are looked up together."""
        held, size = [], 0
        for text in texts:
            low = text.lower()
            if held and size + len(low) > WORDS:
                yield from self._found(held)
                held, size = [], 0
            if len(low) > WORDS:
                parts = [next(self._found([piece])) for piece in _pieces(low, self.longest)]
                at, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                yield at, np.bincount(where, np.concatenate([p[1] for p in parts]), len(at)).astype(np.int64)
            else:
                held.append(low)
                size += len(low)
        if held:
            yield from self._found(held)

    def _found(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``counts`` of lower-case texts."""
        code = _codes(" ".join(texts))
        self._powers(len(code))
        inside = np.zeros(len(code) + 2, dtype=np.int8)
        inside[1:-1] = _in_words().take(code)
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, size = edges[::2], edges[1::2] - edges[::2]
        total = np.zeros(len(code) + 1, dtype=np.uint64)
        np.cumsum(code * self.up[:len(code)], out=total[1:])
        key, kind = (total[start + size] - total[start]) * self.down[start], 2 * size
        if self.starts:
            some = [start[size > n] for n in self.starts]
            key = np.concatenate([key, *((total[s + n] - total[s]) * self.down[s] + _MARK for s, n in zip(some, self.starts))])
            kind = np.concatenate([kind, *(np.full(len(s), 2 * n + 1) for s, n in zip(some, self.starts))])
            start = np.concatenate([start, *some])
        order = np.argsort(key)
        at = np.searchsorted(self.keys, key[order])
        at[at == len(self.keys)] = 0
        known = np.flatnonzero(self.keys[at] == key[order]) if len(self.keys) else at[:0]
        term, order = self.by_key[at[known]], order[known]
        right = self._spelled(term, code, start[order], kind[order])
        if not right.all():
            term, order = term[right], order[right]
        # by text, then by term
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cell = (np.searchsorted(begin, start[order], side="right") - 1) * len(self.weight) + term
        cell, n = np.unique(cell, return_counts=True)
        bounds = np.searchsorted(cell, np.arange(len(texts) + 1) * len(self.weight)).tolist()
        for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
            yield cell[lo:hi] - i * len(self.weight), n[lo:hi]

    def _spelled(self, term: np.ndarray, code: np.ndarray, start: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Whether the words from ``start`` on are these terms."""
        right = self.kind[term] == kind
        place, size = _spread(self.first, np.where(right, term, 0))
        shift = np.where(right, start - self.first[term], 0)
        # a shift of 0 compares anything: those are wrong already
        wrong = self.letters.take(place) != code.take(place + np.repeat(shift, size), mode="clip")
        at = np.flatnonzero(wrong)
        if len(at):
            right[np.searchsorted(np.cumsum(size), at, side="right")] = False
        return right

    def matches(self, text: str) -> dict[int, int]:
        """Occurrences of the terms in a whole text, by term number."""
        at, n = next(self.counts([text]))
        return dict(zip(at.tolist(), n.tolist()))

    def terms_in(self, chunk: str) -> tuple[int, ...]:
        """Numbers of the terms in a lower-case run without white space, one
        by one: what ``counts`` finds for all words at once."""
        # a run of letters only is one word
        words = (chunk,) if chunk.isalpha() else _WORD.findall(chunk)
        if not self.starts:
            return tuple([i for w in words if (i := self.number.get(w)) is not None])
        out = []
        for w in words:
            for t in (w, *("^" + w[:n] for n in self.starts if len(w) > n)):
                if (i := self.number.get(t)) is not None:
                    out.append(i)
        return tuple(out)

    def __getstate__(self):
        # the letters stand for the terms; powers are made again
        return {k: v for k, v in self.__dict__.items() if k not in ("terms", "number", "up", "down")}

    def vectors(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The texts' unit vectors (terms, weights); empty if one holds no
        term."""
        for at, n in self.counts(texts):
            raw = (1.0 + np.log(n)) * self.weight[at]
            norm = np.sqrt((raw * raw).sum())
            yield (at, raw / norm) if norm else (at[:0], raw[:0])


@lru_cache(maxsize=1)
def _in_words() -> np.ndarray:
    """Code point -> 1 if words are made of it, else 0."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.int8)
    for m in _WORD.finditer("".join(map(chr, range(sys.maxunicode + 1)))):
        table[m.start():m.end()] = 1
    return table


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _pieces(text: str, longest: int) -> Iterator[str]:
    """The words of a text, about ``WORDS`` characters at a time. No word is
    cut but one that is longer than the ``longest`` term, and it stays so."""
    at = 0
    while at < len(text):
        end = at + WORDS
        gap = _GAP.search(text, end)
        stop = gap.start() if gap else len(text)
        yield text[at:min(stop, end + longest + 1)]
        at = stop


def _spread(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of all entries of some lists, number of entries in each)."""
    low = first[rows]
    size = first[rows + 1] - low
    end = np.cumsum(size)
    return np.repeat(low - end + size, size) + np.arange(end[-1] if len(end) else 0), size


def _add(score: np.ndarray, weights: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
    """Adds the rows ``at`` times their weights, one after the other: many
    small copies cost more than they save."""
    part = np.empty(len(score))
    for w, r in zip(weights.tolist(), at.tolist()):
        np.multiply(rows[r], w, out=part)
        np.add(score, part, out=score)


def _kth(score: np.ndarray, k: int) -> float:
    """The k-th largest score; 0 if there are fewer."""
    n = len(score)
    return float(np.partition(score, n - k)[n - k]) if n >= k else 0.0


class BlockMaxIndex:
    """Inverted lists over vectors of positive weights, with the largest weight
    of each list in each block of ``block`` examples; and the vectors."""

    def __init__(self, vectors: list[tuple[tuple[int, float], ...]], ids: list[int], block: int = BLOCK):
        flat = [x for v in vectors for x in v]
        self._build(
            np.array([len(v) for v in vectors], dtype=np.int64), np.array([t for t, _ in flat], dtype=np.int64),
            np.array([w for _, w in flat], dtype=np.float64), np.array(ids, dtype=np.int64), block,
        )

    @classmethod
    def of(cls, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> BlockMaxIndex:
        """From the vectors one after the other: terms and weights in each."""
        new = cls.__new__(cls)
        new._build(sizes.astype(np.int64), terms.astype(np.int64), weights.astype(np.float64), ids.astype(np.int64), block)
        return new

    def _build(self, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, block: int) -> None:
        n, self.block, self.n_blocks = len(ids), block, -(-len(ids) // block)
        row = np.repeat(np.arange(n), sizes)
        # alike examples side by side: bounds of blocks get tight
        heaviest = np.full(n, -1, dtype=np.int64)
        by_weight = np.lexsort((terms, weights, row))
        heaviest[row[by_weight]] = terms[by_weight]
        order = np.lexsort((np.arange(n), ids, heaviest))
        self.ids, self.row = ids[order], order
        at = np.empty(n, dtype=np.int64)
        at[order] = np.arange(n)
        place = at[row]
        o = np.lexsort((place, terms))
        place, terms = place[o], terms[o]
        every = np.arange(int(terms[-1]) + 2 if len(terms) else 1)
        self.n_terms = len(every) - 1
        self.first, self.places, self.weights = np.searchsorted(terms, every), place, weights[o]
        key = terms * max(self.n_blocks, 1) + place // block
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
        tops = np.maximum.reduceat(self.weights, starts) if len(starts) else self.weights
        top_blocks, top_terms = place[starts] // block, terms[starts]
        self.top = np.zeros(self.n_terms)
        np.maximum.at(self.top, top_terms, tops)
        # long lists and their largest weights by block also as dense rows
        size = np.diff(self.first)
        long = np.argsort(-size, kind="stable")[:LONG_ROWS]
        long = np.sort(long[size[long] * LONG >= max(n, 1)])
        self.long_row = np.full(self.n_terms, -1, dtype=np.int32)
        self.long_row[long] = np.arange(len(long))
        self.long, self.long_tops = np.zeros((len(long), n)), np.zeros((len(long), self.n_blocks))
        row = self.long_row[terms]
        self.long[row[row >= 0], place[row >= 0]] = self.weights[row >= 0]
        row = self.long_row[top_terms]
        self.long_tops[row[row >= 0], top_blocks[row >= 0]] = tops[row >= 0]

    def search(self, query: tuple[tuple[int, float], ...], k: int) -> list[tuple[float, int, int]]:
        """``nearest`` for a query of (term, weight) pairs."""
        return self.nearest(np.array([t for t, _ in query], dtype=np.int64), np.array([w for _, w in query]), k)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int, int]]:
        """The ``k`` nearest by cosine (above zero), ties by smaller id:
        (cosine, example id, example number).

        The short lists are added first, and of the long ones the ``FIRST``
        with the largest possible products. What the others can still add is
        bounded by their largest weights in each block; an example whose sum
        and bound stay below the k-th sum is no neighbour. Only what is left
        gets its weights in the other lists."""
        n = len(self.ids)
        known = (terms < self.n_terms) & (weights > 0)
        terms, weights = terms[known], weights[known]
        if not n or not len(terms):
            return []
        row = self.long_row.take(terms)
        short, long = row < 0, np.flatnonzero(row >= 0)
        at, size = _spread(self.first, terms[short])
        score = np.bincount(self.places.take(at), self.weights.take(at) * np.repeat(weights[short], size), n)
        if len(long) > FIRST:
            long = long[np.argsort(-weights[long] * self.top[terms[long]], kind="stable")]
        row, weights = row[long], weights[long]
        score = score.astype(np.float64, copy=False)
        _add(score, weights[:FIRST], self.long, row[:FIRST])
        row, weights = row[FIRST:], weights[FIRST:]
        near, least = None, _kth(score, k)
        if len(row):
            if least > 0.0:
                bound = np.repeat(weights @ self.long_tops[row], self.block)[:n]
                near = np.flatnonzero(score + bound >= least - 1e-9)
            if near is not None and 4 * len(near) < n:
                score = score[near] + np.einsum("i,ij->j", weights, self.long[row[:, None], near])
            else:
                near = None
                _add(score, weights, self.long, row)
            least = _kth(score, k)
        best = np.flatnonzero(score >= max(least - 1e-9, 1e-300))
        return self._best(best if near is None else near[best], score[best], k)

    def _best(self, near: np.ndarray, score: np.ndarray, k: int) -> list[tuple[float, int, int]]:
        score, ids, row = np.round(score, 12), self.ids[near], self.row[near]
        best = np.lexsort((row, ids, -score))[:k]
        found = zip(score[best].tolist(), ids[best].tolist(), row[best].tolist())
        return [x for x in found if x[0] > 0.0]


class Model:
    """Vocabulary, index, labels and rates; scores texts."""

    def __init__(self, vocabulary: Vocabulary, index: BlockMaxIndex, toxic: np.ndarray, vote: tuple[float, float], base: float, empty: float, k: int = K, doubt: float = DOUBT):
        self.vocabulary, self.index, self.toxic, self.vote = vocabulary, index, toxic, vote
        self.base, self.empty, self.k, self.doubt = base, empty, k, doubt
        self._known: dict[bytes, tuple[float, list[int], list[float]]] = {}

    def score(self, text: str) -> tuple[float, list[int], list[float]]:
        """``scores`` of one text."""
        return self.scores([text])[0]

    def scores(self, texts: list[str]) -> list[tuple[float, list[int], list[float]]]:
        """(score, ids of the nearest examples, their cosines) of each text.
        Copies of a text are scored once."""
        names = [blake2b(t.encode("utf-8", "surrogatepass"), digest_size=20).digest() for t in texts]
        new = {name: t for name, t in zip(names, texts) if name not in self._known}
        found = {name: self._known[name] for name in names if name not in new}
        for name, vector in zip(new, self.vocabulary.vectors(new.values())):
            found[name] = self._vote(*vector)
        if len(self._known) > REMEMBERED:
            self._known.clear()
        self._known.update((name, found[name]) for name in new)
        return [found[name] for name in names]

    def _vote(self, terms: np.ndarray, weights: np.ndarray) -> tuple[float, list[int], list[float]]:
        if not len(terms):
            return self.empty, [], []
        near = self.index.nearest(terms, weights, self.k)
        yes = no = 0.0
        for cos, _, row in near:
            w = cos * cos * self.vote[int(self.toxic[row])]
            if self.toxic[row]:
                yes += w
            else:
                no += w
        value = (yes + self.doubt * self.base) / (yes + no + self.doubt)
        return value, [i for _, i, _ in near[:3]], [c for c, _, _ in near[:3]]

    def fresh(self) -> Model:
        """The same model with nothing remembered, for one task."""
        return Model(self.vocabulary, self.index, self.toxic, self.vote, self.base, self.empty, self.k, self.doubt)

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Some rows at a time: their texts are copied."""
    return (batch.slice(at, SLICE_ROWS) for at in range(0, batch.num_rows, SLICE_ROWS))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> tuple[DataFrame, int, int]:
    """((doc_id, text, toxic) of the sampled labelled texts; how many labelled
    texts of label 1, of label 0 there are). An id labelled both ways counts as
    label 1. Exact copies under one label are one text, carried by their
    smallest id, in the sample and in the totals: many copies of one text are
    no evidence that its words go with its label. Texts that only share
    passages, and one text under both labels, stay apart. Texts of over
    ``MAX_CHARS`` characters are no examples. Only ids and hashes
    are shuffled; the sampled ones are at most max_toxic + max_clean, so they
    are broadcast to the scan of the documents."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= MAX_CHARS)
    hashes = texts.select("doc_id", F.md5("text").alias("h")).distinct()
    once = materialise(hashes.join(known, "doc_id").groupBy("toxic", "h").agg(F.min("doc_id").alias("doc_id")))
    sizes = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [once.where(F.col("toxic") == y).orderBy("h").limit(n) for y, n in ((1, max_toxic), (0, max_clean))]
    picked = some[0].union(some[1])
    rows = texts.withColumn("h", F.md5("text")).join(F.broadcast(picked), ["doc_id", "h"])
    return rows.dropDuplicates(["doc_id", "h"]).select("doc_id", "text", "toxic"), sizes.get(1, 0), sizes.get(0, 0)


def relevant_terms(sample: DataFrame, n_toxic: int, n_clean: int, starts: tuple[int, ...]) -> tuple[list[str], np.ndarray]:
    """All terms of the sampled texts and the relevance of each, by the
    likelihood-ratio statistic of its presence against the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for t in term_counts(text, starts):
                    c = seen.get(t)
                    if c is None:
                        c = seen[t] = [0, 0]
                    c[y] += 1
            if len(seen) > 500_000:
                yield _term_rows(seen)
                seen = {}
        yield _term_rows(seen)

    counts = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "term string, clean long, toxic long")
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    n1, n0 = float(max(n_toxic, 1)), float(max(n_clean, 1))
    rate = (a + b) / (n1 + n0)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g2 = 2 * (part(a, n1 * rate) + part(b, n0 * rate) + part(n1 - a, n1 * (1 - rate)) + part(n0 - b, n0 * (1 - rate)))
    got = (
        counts.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
        .select("term", F.when(a / n1 > b / n0, F.greatest(g2, F.lit(0.0))).otherwise(0.0).alias("g2")).orderBy("term").toArrow()
    )
    g = got["g2"].to_numpy()
    return got["term"].to_pylist(), LEAST_WEIGHT + (g / (g + HALF_G2)) ** 2


def _term_rows(seen: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(seen), type=pa.string()), pa.array([c[0] for c in seen.values()], type=pa.int64()),
         pa.array([c[1] for c in seen.values()], type=pa.int64())],
        names=["term", "clean", "toxic"],
    )


def document_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many texts of the whole corpus each term is, and of how many."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        df, n = np.zeros(len(v.terms), dtype=np.int64), 0
        for batch in batches:
            for part in _slices(batch):
                n += part.num_rows
                for at, _ in v.counts(part.column(0).to_pylist()):
                    df[at] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[n, df[at]].astype(np.int64))], names=["term", "n"]
        )

    out = np.zeros(len(vocabulary.terms), dtype=np.int64)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    got = texts.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = got["term"].to_numpy(), got["n"].to_numpy()
    out[at[at >= 0]] = n[at >= 0]
    total = int(n[at < 0].sum())
    shared.destroy()
    return out, total


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, starts: tuple[int, ...] = (), k: int = K, doubt: float = DOUBT) -> Model:
    """A model from labelled rows: ``labels`` (doc_id, toxic 0/1) of ``docs``
    (doc_id, text). Callers leave out the ids they hold out. No labels: every
    score is 0; examples of one label only: every score is that label's rate."""
    sample, all_toxic, all_clean = labelled_sample(docs, labels, max_toxic, max_clean)
    sample = materialise(sample)
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    terms, relevance = relevant_terms(sample, n1, n0, starts) if n1 and n0 else ([], np.zeros(0))
    bare = Vocabulary(terms)
    order = np.array(sorted(range(len(terms)), key=terms.__getitem__), dtype=np.int64)
    df, total = document_frequencies(docs, bare) if terms else (np.zeros(0), 0)
    vocabulary = Vocabulary(terms, np.log((2.0 + total) / (1.0 + df)) * relevance[order])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            vecs = list(v.vectors(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([x for x, _ in vecs], type=pa.list_(pa.int32())),
                 pa.array([w for _, w in vecs], type=pa.list_(pa.float64()))],
                names=["doc_id", "toxic", "at", "w"],
            )

    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic").mapInArrow(
        run, "doc_id long, toxic int, at array<int>, w array<double>"
    ).where(F.size("at") > 0).orderBy("doc_id", "at", "w").toArrow().combine_chunks()
    shared.destroy()

    def flat(name: str) -> np.ndarray:
        return rows[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)

    sizes = rows["at"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    toxic = rows["toxic"].to_numpy().astype(np.int8)
    index = BlockMaxIndex.of(sizes, flat("at"), flat("w"), rows["doc_id"].to_numpy())
    base = all_toxic / max(all_toxic + all_clean, 1)
    # of the texts without any term, how many are of label 1 in the corpus
    bare1 = all_toxic * (1 - (toxic == 1).sum() / n1) if n1 else 0.0
    bare0 = all_clean * (1 - (toxic == 0).sum() / n0) if n0 else 0.0
    empty = float(bare1 / (bare1 + bare0)) if bare1 + bare0 else base
    vote = (all_clean / n0 if n0 else 1.0, all_toxic / n1 if n1 else 1.0)
    least = min(vote)
    return Model(vocabulary, index, toxic, (vote[0] / least, vote[1] / least), float(base), empty, k, doubt)


def score(docs: DataFrame, model: Model, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(id columns, score, evidence array<long>, cosines array<double>), a row
    per input row; null text counts as empty. Texts without any term score
    the rate of label 1 among such texts. Repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*[F.col(c) for c in id_cols], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.fresh()
        for part in chain.from_iterable(map(_slices, batches)):
            got = model.scores(part.column(len(id_cols)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array([g[0] for g in got], type=pa.float64()),
                 pa.array([g[1] for g in got], type=pa.list_(pa.int64())), pa.array([g[2] for g in got], type=pa.list_(pa.float64()))],
                names=[*id_cols, "score", "evidence", "cosines"],
            )

    return src.mapInArrow(run, f"{kinds}, score double, evidence array<long>, cosines array<double>")


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0 (null id: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
