"""Language identification by error-correcting output codes.

Every learned language has a codeword. For each bit a binary n-gram classifier
is a table of log odds: how much likelier a hashed character n-gram is in the
languages whose codeword has the bit than in the others. A text's margin for a
bit is the mean log odds of its n-grams. Decoding sums, over the bits, the
logistic loss of each language's codeword against the margins (bits that the
languages' own statistics separate well weigh more) and takes the smallest
loss; a small gap to the second smallest flags ambiguity.

The n-gram counts cover all training rows: each scan task counts into one
table per language, and only (language, n-gram, count) rows are shuffled. What
reaches the driver is a table of languages x ``FEATURES``, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed n-grams of a language model: letter pairs and triples share it.
BITS = 15
FEATURES = 1 << BITS
#: Characters in one vectorised step.
STEP_CHARS = 400_000
#: Added to every n-gram count.
SMOOTH = 0.5
#: N-grams' worth of doubt added to a text, so that short texts score low.
DOUBT = 8.0
#: How steeply a normalised margin turns into loss.
STEEP = 4.0
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-case code point of a letter, or space."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = ord(c.lower()[0])
    return table


def _steps(texts: list[str]) -> Iterator[list[int]]:
    """Numbers of texts that are handled together (a very long one alone)."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > STEP_CHARS:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(t)
    if held:
        yield held


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of pairs, hashes of triples, start of each text's hashes).

    Both have an entry for each character of ' text '; entries that would
    reach over a text's end, or hold no letter, are ``FEATURES``."""
    codes = _letters()[np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), dtype="<u4")]
    sizes = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    ends = starts + sizes
    a, b, c = codes, np.r_[codes[1:], 32].astype(np.uint32), np.r_[codes[2:], 32, 32].astype(np.uint32)
    shift = np.uint32(32 - BITS)
    two = ((a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)) * np.uint32(0x27D4EB2F)) >> shift
    three = ((a * np.uint32(0xC2B2AE3D) ^ b * np.uint32(0x9E3779B1) ^ c * np.uint32(0x165667B1)) * np.uint32(0x85EBCA77)) >> shift
    two, three = two.astype(np.int32), three.astype(np.int32)
    blank2 = (a == 32) & (b == 32)
    two[blank2] = FEATURES
    three[blank2 & (c == 32)] = FEATURES
    two[ends - 1] = FEATURES
    three[ends - 1] = FEATURES
    three[ends - 2] = FEATURES
    return two, three, starts


def ngram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram int, n long) over all rows with a language and a text."""
    src = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by: dict[str, list[str]] = {}
            for lang, t in zip(langs, texts):
                by.setdefault(lang, []).append(t)
            for lang, own in by.items():
                sums = table.setdefault(lang, np.zeros(FEATURES + 1, dtype=np.int64))
                for step in _steps(own):
                    two, three, _ = grams([own[i] for i in step])
                    sums += np.bincount(two, minlength=FEATURES + 1)
                    sums += np.bincount(three, minlength=FEATURES + 1)
        for lang, sums in table.items():
            at = np.flatnonzero(sums[:FEATURES])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), type=pa.string()), pa.array(at.astype(np.int32)), pa.array(sums[at])],
                names=["lang", "gram", "n"],
            )

    return src.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def codewords(k: int) -> np.ndarray:
    """k rows of +1/-1, any two of which differ in about half the bits or
    more. Up to six languages: all splits into two parts. Beyond: rows of a
    Sylvester-Hadamard matrix without its constant columns."""
    if k <= 1:
        return np.zeros((k, 0), dtype=np.int8)
    if k <= 6:
        cols = [c for c in product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(cols, dtype=np.int8).T
    n = 8
    while n < 2 * k:
        n *= 2
    rows = np.arange(1, k + 1)
    code = np.array([[1 - 2 * (int(r & c).bit_count() & 1) for c in range(1, n)] for r in rows], dtype=np.int8)
    return code[:, np.abs(code.sum(axis=0)) < k]


class Model:
    """Codewords, the bits' log odds and what decoding needs."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        bits = self.code.shape[1]
        self.odds = np.zeros((FEATURES + 1, bits), dtype=np.float32)
        if not bits:
            return
        p = counts + SMOOTH
        p = p / p.sum(axis=1, keepdims=True)
        for b in range(bits):
            yes = self.code[:, b] > 0
            self.odds[:FEATURES, b] = np.log(p[yes].mean(axis=0)) - np.log(p[~yes].mean(axis=0))
        expected = p @ self.odds[:FEATURES].astype(np.float64)
        self.scale = np.maximum(np.abs(expected).mean(axis=0), 1e-9)
        sure = np.maximum((expected * self.code).min(axis=0), 1e-9)
        self.weight = sure / sure.mean()

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(normalised margins, number of n-grams) of each text."""
        bits = self.code.shape[1]
        out, used = np.zeros((len(texts), bits)), np.zeros(len(texts), dtype=np.int64)
        for step in _steps(texts):
            two, three, starts = grams([texts[i] for i in step])
            used[step] = np.add.reduceat((two < FEATURES).astype(np.int64) + (three < FEATURES), starts)
            if bits:
                sums = np.add.reduceat(self.odds[two] + self.odds[three], starts, axis=0, dtype=np.float64)
                out[step] = sums / (used[step] + DOUBT)[:, None] / self.scale
        return out, used

    def predict(self, texts: list[str], gap: float):
        """(language, score, bits, ambiguous) of each text."""
        k = len(self.langs)
        margins, used = self.margins(texts)
        if k == 0:
            return [(UNKNOWN, 0.0, "", True)] * len(texts)
        loss = np.logaddexp(0.0, -STEEP * margins[:, None, :] * self.code[None]) @ self.weight if k > 1 else np.zeros((len(texts), 1))
        order = np.argsort(loss, axis=1, kind="stable")
        best = loss[np.arange(len(texts)), order[:, 0]]
        share = 1.0 / np.exp(np.minimum(best[:, None] - loss, 0.0)).sum(axis=1)
        second = loss[np.arange(len(texts)), order[:, 1]] - best if k > 1 else np.full(len(texts), np.inf)
        return [
            (self.langs[order[i, 0]], float(share[i]), "".join("1" if m > 0 else "0" for m in margins[i]), bool(second[i] < gap))
            if used[i] else (UNKNOWN, 0.0, "", True)
            for i in range(len(texts))
        ]


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model from all rows of ``docs`` with a language and a text. No such
    rows: a model that answers ``und``; one language: always that one."""
    rows = ngram_counts(docs, lang_col, text_col).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(langs), FEATURES))
    number = {lang: i for i, lang in enumerate(langs)}
    counts[rows["lang"].map(number).to_numpy(dtype=np.int64), rows["gram"].to_numpy(dtype=np.int64)] = rows["n"]
    return Model(langs, counts)


def identify(
    docs: DataFrame, model: Model, gap: float = 1.0, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text"
) -> DataFrame:
    """(id columns, lang_pred, score, bits, ambiguous), a row per input row.

    ``score``: the best language's share of exp(-loss), 0 to 1. Null text and
    text without letters: ``und`` with score 0. Only the text is looked at;
    repeated rows stay; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*[F.col(c) for c in id_cols], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = shared.value.predict(batch.column(len(id_cols)).to_pylist(), gap)
            lang, score, bits, unsure = zip(*made) if made else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(lang, type=pa.string()), pa.array(score, type=pa.float64()),
                 pa.array(bits, type=pa.string()), pa.array(unsure, type=pa.bool_())],
                names=[*id_cols, "lang_pred", "score", "bits", "ambiguous"],
            )

    return src.mapInArrow(run, f"{kinds}, lang_pred string, score double, bits string, ambiguous boolean")


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2 (null id: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
