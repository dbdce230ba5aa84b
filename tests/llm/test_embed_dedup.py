"""Embedding near-dedup against brute force."""

import numpy as np
import pytest

from cadence.llm import embed_dedup as ed
from tests.conftest import SF_CHECK
from tests.llm.test_native_ops import components

SF_LARGE = "/root/testdata/sf0.1"


def brute(rows, threshold=0.93):
    """rows: (vec_id, embedding or None, label or None)."""
    ok = []
    for k, (i, e, lab) in enumerate(rows):
        good = i is not None and lab is not None and e is not None and len(e) and all(v is not None for v in e)
        if good and np.isfinite(np.array(e, dtype=float)).all() and np.any(np.array(e, dtype=float)):
            ok.append(k)
    pairs = []
    by = {}
    for k in ok:
        by.setdefault((rows[k][2], len(rows[k][1])), []).append(k)
    for ks in by.values():
        x = np.array([rows[k][1] for k in ks], dtype=np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        pairs += [(ks[i], ks[j]) for i, j in zip(a, b)]
    comp = components(range(len(rows)), pairs)
    n = np.zeros(len(rows), int)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    least = {}
    for k, c in comp.items():
        if rows[k][0] is not None:
            least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    return sorted(((r[0], int(n[k]), least.get(comp[k]), r[0] is not None and least.get(comp[k]) == r[0]) for k, r in enumerate(rows)), key=repr)


def result(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_calibration():
    tables, least = ed.calibrate(0.93, 0.98)
    assert 8 <= tables <= 20 and 20 <= least < ed.COUNTED
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    o = rng.standard_normal((400, 64))
    o -= (o * x).sum(1)[:, None] * x
    o /= np.linalg.norm(o, axis=1)[:, None]
    y = 0.9301 * x + np.sqrt(1 - 0.9301**2) * o  # right at the threshold
    kx, ky = ed._cell_keys(x, tables), ed._cell_keys(y, tables)
    counted = ed._directions(64, tables)[2]
    passed = (kx == ky).any(axis=1) & ((np.abs((x - y) @ counted) <= ed.WINDOW).sum(axis=1) >= least)
    assert passed.mean() > 0.94


def test_collisions_match_plain_comparison():
    p = np.random.default_rng(1).standard_normal((60, 9))
    want = (np.abs(p[:, None, :] - p[None, :, :]) <= ed.WINDOW).sum(axis=2)
    assert np.array_equal(ed.collisions(p), want)


@pytest.mark.parametrize("tile", [1024, 7])
def test_matches_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(ed, "TILE", tile)
    df = spark.read.parquet(f"{SF_LARGE if tile > 100 else SF_CHECK}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert result(ed.near_duplicates(df)) == brute(rows)


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows, i = [], 0
    for b in base:
        for cos in (1.0, 0.935, 0.95, 0.98):
            o = rng.standard_normal(32)
            o -= (o @ b) * b
            v = cos * b + np.sqrt(1 - cos * cos) * o / np.linalg.norm(o)
            rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2 if cos < 0.9 else 0))
            i += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got, want = result(ed.near_duplicates(df)), brute(rows)
    assert sum(r[1] for r in want) >= 0.9 * 300 * 6
    assert sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_odd_rows(spark):
    v, w = [1.0, 2.0, 3.0], [2.0, 4.0, 6.0]
    rows = [
        (5, v, 1), (5, v, 1), (3, w, 1), (9, v, 2), (10, v, None), (11, None, 1), (12, [0.0, 0.0, 0.0], 1),
        (13, [1.0, None, 3.0], 1), (14, [1.0, float("nan"), 3.0], 1), (15, [1.0, float("inf"), 3.0], 1),
        (16, [], 1), (17, [1.0, 2.0], 1), (18, [1.0, 2.0], 1), (None, v, 1), (20, [-1.0, -2.0, -3.0], 1),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    assert result(ed.near_duplicates(df)) == brute(rows)
    assert ed.near_duplicates(df.limit(0)).count() == 0
