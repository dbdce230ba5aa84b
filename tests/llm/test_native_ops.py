"""SimHash near-dedup, sharding and document fingerprints against brute force."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cadence.llm import fingerprints as fps
from cadence.llm import sharding, simhash_dedup
from tests.conftest import SF_CHECK

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, fp string"
ODD = [
    (1, "One two three four five six seven eight", "en", "a", 3, "x", "y"),
    (1, "One two three four five six seven eight", "en", "a", 3, "x", "y"),
    (2, "one TWO three four five six seven eight", None, None, None, None, None),
    (3, None, "en", "a", 3, "x", "y"),
    (4, "", "en", "a", 3, "x", "y"),
    (None, "null id", "en", "a", 3, "x", "y"),
    (6, "single", "en", "a", 3, "x", "y"),
    (7, " \t\x0b two words  é\n", "en", "a", 3, "x", "y"),
    (8, "word " * 30000, "en", "a", 3, "x", "y"),
    (9, "İstanbul \U0001f600\U0001f600\U0001f600 x", "en", "a", 3, "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_CHECK}/documents.parquet")


def simhash(text, k=3):
    t = (text or "").translate(str.maketrans(simhash_dedup.UPPER, simhash_dedup.LOWER))
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] * bool(w)
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_simhash(rows, radius=3):
    rows = [(i, simhash(t)) for i, t in rows]
    v = np.array([f for _, f in rows], dtype=np.uint64)
    pairs = [
        (a, b) for a in range(len(v))
        for b in np.flatnonzero(np.bitwise_count(v ^ v[a]) <= radius) if a < b
    ]
    comp = components(range(len(v)), pairs)
    least = {}
    for n, c in comp.items():
        if rows[n][0] is not None:
            least[c] = min(least.get(c, rows[n][0]), rows[n][0])
    return sorted(((i, f"{f:016x}", least.get(comp[n])) for n, (i, f) in enumerate(rows)), key=repr)


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_simhash_matches_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    out = simhash_dedup.near_duplicates(docs)
    assert got(out, "doc_id", "fingerprint", "component_id") == brute_simhash(rows)


def test_simhash_odd_rows(spark, odd):
    rows = [(r[0], r[1]) for r in ODD]
    assert got(simhash_dedup.near_duplicates(odd), "doc_id", "fingerprint", "component_id") == brute_simhash(rows)
    assert simhash_dedup.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    # 3 and 4 (no words) are one group, 1 and 2 are another; the null id stays
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 3, None, 6, 7, 8, 9], key=repr)


def test_simhash_links_on_planted_distances(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    vals = list(base)
    for b in base:
        for k in range(1, 6):
            bits = rng.choice(64, k, replace=False)
            vals.append(np.uint64(int(b) ^ sum(1 << int(x) for x in bits)))
    v = np.unique(np.array(vals, dtype=np.uint64))
    df = spark.createDataFrame([(int(x.astype(np.int64)),) for x in v], "fp long")
    want = {
        tuple(sorted((int(v[a].astype(np.int64)), int(v[b].astype(np.int64)))))
        for a in range(len(v)) for b in range(a) if np.bitwise_count(v[a] ^ v[b]) <= 3
    }
    for segments in (2, 3, 4):
        found = [(r.a, r.b) for r in simhash_dedup.links(df, 3, segments).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    for blocks in (4, 6):
        found = [(r.a, r.b) for r in fps.near_pairs(df, 3, blocks).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_sharding_laws(spark, docs):
    out = sharding.assign(docs, rows_per_bucket=10).toPandas()
    src = {r.doc_id: r.text for r in docs.collect()}
    assert len(out) == len(src) and set(out["shard"]) == set(range(40))
    moved = out[out["shard"] != out["grown_shard"]]
    assert set(moved["grown_shard"]) == {40} and 5 <= len(moved) <= 60
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    for r in out.itertuples():
        raw = src[r.doc_id].encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
    counts = out["shard"].value_counts()
    assert counts.max() < 2.5 * counts.mean()


def brute_place(key, levels, seed=42):
    """The tree walk with the plain hash library."""
    node = 0

    def chain(*vals):
        h = seed_bytes = 42
        for x in vals:
            if isinstance(x, int):
                h = xxhash.xxh64_intdigest(x.to_bytes(4, "little", signed=True), h)
            else:
                h = xxhash.xxh64_intdigest(x.encode(), h)
        return h

    for depth, level in enumerate(levels):
        draws = []
        for i, w in level[node]:
            u = ((chain(seed, depth, i, key) >> 11) + 0.5) / 2**53
            draws.append((-math.log(u) / w, i))
        node = min(draws)[1]
    return node


def test_sharding_places_by_the_tree(spark, docs):
    weights = [1.0 + (i % 3) for i in range(13)]
    levels = sharding.tree(13, weights=weights)
    got_ = docs.select("doc_id", sharding.place(F.col("doc_id").cast("string"), levels).alias("s")).collect()
    assert all(r.s == brute_place(str(r.doc_id), levels) for r in got_)


def test_sharding_confines_movement(spark, docs):
    """A heavier shard draws documents only into the region it is in."""
    old, new = [1.0] * 40, [1.0] * 40
    new[17] = 3.0
    a = docs.select("doc_id", sharding.place(F.col("doc_id").cast("string"), sharding.tree(40, weights=old)).alias("o"),
                    sharding.place(F.col("doc_id").cast("string"), sharding.tree(40, weights=new)).alias("n"))
    moved = [r for r in a.collect() if r.o != r.n]
    assert moved and all(10 <= r.n < 20 for r in moved)
    with pytest.raises(ValueError):
        sharding.tree(0)


def test_sharding_odd_rows(spark, odd):
    out = sharding.assign(odd, 3, rows_per_bucket=1).collect()
    assert len(out) == len(ODD)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        if r.doc_id in (3, 4):
            assert (r["size"], r.text_crc32) == (16, 0)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.assign(odd.limit(0), 3).count() == 0


def brute_fp(text):
    w = re.split(r"\s+", text.lower(), flags=re.ASCII)
    w = [x for x in w if x]
    ts = list(zip(w, w[1:])) if len(w) > 1 else [(x, None) for x in w]
    votes, total = [0] * 64, 0
    for a, b in ts:
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        if b is not None:
            h = xxhash.xxh64_intdigest(b.encode(), h)
        wt = len(a) + len(b or "")
        total += wt
        for i in range(64):
            votes[i] += wt * (h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * votes[i] > total)


def brute_fingerprints(rows):
    rows = [(i, t or "") for i, t in rows]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    fp = {t: brute_fp(t) for _, t in rows}
    allfp = np.array([fp[t] for _, t in rows], dtype=np.uint64)
    out = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        c = len(t) // 3
        e = t[:len(t) - c] + nxt[:c]
        f, g = fp[t], brute_fp(e)
        like = lambda a, b: 1 - (a ^ b).bit_count() / 64
        near = int((np.bitwise_count(allfp ^ np.uint64(f)) <= 3).sum()) - 1
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{f:016x}", f"{g:016x}", like(f, g), like(f, fp[nxt]), near))
    return sorted(out, key=repr)


COLS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near")


def test_fingerprints_match_brute_force(spark, docs):
    some = docs.where("doc_id % 3 = 0")
    rows = [(r.doc_id, r.text) for r in some.collect()]
    out = fps.document_fingerprints(some)
    assert got(out, *COLS) == brute_fingerprints(rows)


def test_fingerprints_odd_rows(spark, odd):
    rows = [(r[0], r[1]) for r in ODD if r[0] != 9]
    assert got(fps.document_fingerprints(odd.where("doc_id is null or doc_id <> 9")), *COLS) == brute_fingerprints(rows)
    assert fps.document_fingerprints(odd.limit(0)).count() == 0
    assert fps.document_fingerprints(odd).count() == len(ODD)
    one = fps.document_fingerprints(odd.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_one_id_with_most_rows(spark):
    """Repeated and null ids and many equal rows: the order has no seams, and
    none of them is one task's work alone."""
    rows = [(None, f"{i:03d} null id and text {i % 7}") for i in range(400)]
    rows += [(5, f"{i:03d} five") for i in range(200)] + [(7, "the same row " * 4)] * 500 + [(i, f"own {i}") for i in range(8, 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = sorted(((*a, *b) for a, b in zip(order, order[1:] + order[:1])), key=repr)
    out = fps.next_in_order(df)
    assert sorted((tuple(r[c] for c in ("doc_id", "text", "next_id", "next_text")) for r in out.collect()), key=repr) == want
    assert got(fps.document_fingerprints(df), *COLS) == brute_fingerprints(rows)


def test_equal_texts_are_dealt_to_many_tasks(spark):
    df = spark.createDataFrame([(i, "a b c" if i % 2 else f"x{i} y") for i in range(4000)], "doc_id long, text string")
    one = df.select(F.xxhash64("text").alias("fp"))
    assert fps.hot_fingerprints(one).count() == 1


def test_plans_hold_no_python(spark, docs):
    for df in (sharding.assign(docs), fps.document_fingerprints(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|MapInPandas", plan)


def test_edits_and_neighbours_are_told_apart(spark):
    con = duckdb.connect()
    assert con.sql("select 1").fetchall()
    df = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    out = fps.document_fingerprints(df).where("n_chars > 600").agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    assert out.e > 0.65 and out.n < 0.6
