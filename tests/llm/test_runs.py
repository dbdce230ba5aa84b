"""Periodic runs against a check of every period, and the whole query."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadence.llm import queries, runs
from tests.conftest import SF_CHECK
from tests.llm.test_native_ops import ODD, SCHEMA


def brute(words):
    """(start, length, period) of all runs, by trying every period."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids, n, found = np.array([number[w] for w in words], dtype=np.int64), len(words), {}
    for q in range(1, n // 3 + 1):
        same = np.r_[0, (ids[:-q] == ids[q:]).astype(np.int8), 0]
        edge = np.diff(same)
        for s, x in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if x - s + q >= max(24, 3 * q):
                found.setdefault((s, x - s + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digests(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    found = brute(words)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1] * 10**12 // r[2], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()),
        sha(b" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


def stitched(words):
    """Runs from the tiles of one document, stitched in plain Python."""
    merged = {}
    for q, s, x in sorted(runs.fragments(words), key=lambda f: (f[0], f[1])):
        own = merged.setdefault(q, [])
        if own and s <= own[-1][1]:
            own[-1][1] = max(own[-1][1], x)
        else:
            own.append([s, x])
    least = {}
    for q in sorted(merged):
        for s, x in merged[q]:
            least.setdefault((s, x - s + q), q)
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 9)), max_size=8))
def test_tiles_find_every_run(parts):
    words = [str(w) for piece, times in parts for w in piece * times]
    assert stitched(words) == brute(words)


@pytest.mark.parametrize("period", [1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 100, 333])
@pytest.mark.parametrize("times", [3, 5, 40])
def test_run_over_many_tiles(period, times):
    rng = random.Random(period * times)
    piece = [f"w{rng.random()}" for _ in range(period)]
    before = [f"b{i}" for i in range(rng.randrange(300))]
    words = before + (piece * (times + 1))[:period * times + rng.randrange(period)] + ["end"]
    words += [f"c{i}" for i in range(200)]
    assert stitched(words) == brute(words)
    if period * times >= 24:
        assert (len(before), period) in {(s, q) for s, _, q in stitched(words)}


def test_z_function():
    s = [1, 1, 2, 1, 1, 2, 1, 1, 1]
    want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
    assert runs.z_function(s, len(s))[1:] == want[1:]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_CHECK}/documents.parquet")


def test_query_against_every_period(spark, docs):
    """The whole result of the registered query."""
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, SF_CHECK).collect()]
    want = [digests(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(got) == sorted(want)
    assert sum(r[1] > 0 for r in got) > 50


def test_odd_rows(spark):
    odd = spark.createDataFrame([*ODD, (9, "a b c d e f g h " * 9, "", "", 0, "", "")], SCHEMA)
    odd = odd.select("*", *[F.lit("x").alias(c) for c in ("n_words", "runs", "TEXT", "key", "words", "id", "Doc_Id")])
    got = runs.find_runs(odd).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        if r.doc_id in (3, 4):
            assert (r.n_words, r.runs, r.collapsed) == (0, [], "")
    by_id = {r.doc_id: r for r in got if r.runs}
    assert [tuple(x) for x in by_id[8].runs] == [(0, 30000, 1)] and by_id[8].collapsed == "word"
    assert [tuple(x) for x in by_id[9].runs] == [(0, 72, 8)] and by_id[9].collapsed == "a b c d e f g h"
    assert runs.find_runs(odd.limit(0)).count() == 0


def test_planting_keeps_odd_rows(spark):
    rows = [(i, t) for i in [*range(40), None] for t in (None, "", " \t\n", "one", " a  b\tc é d e f g h\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = queries.with_planted_runs(df).collect()
    want = [(i, b" ".join(planted(i, (t or "").encode().split())).decode()) for i, t in rows]
    key = lambda r: (r[0] is None, r)
    assert sorted(((r[0], " ".join((r[1] or "").split())) for r in got), key=key) == sorted(want, key=key)
