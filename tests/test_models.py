"""Fixture cases for the similarity job, the annotation queue and smart-mix
inputs (small createDataFrame fixtures)."""

import datetime as dt
import json

import numpy as np
from pyspark.sql import functions as F

from cadence.operators import similarity as sim
from cadence.plans import queue as qu

AS_OF = dt.datetime(2024, 6, 1)


def dump_fixture(spark):
    rng = np.random.default_rng(42)
    rows = []
    for a in range(10):
        for u in rng.choice(20, size=rng.integers(4, 20), replace=False):
            rows.append(("s1", dt.date(2024, 5, 1), int(u), f"artist-{a:02d}", int(rng.integers(1, 100))))
    return spark.createDataFrame(rows, "slug string, dump_date date, user_id long, artist_mbid string, listen_count long")


def test_id_map_and_bm25_rows(spark):
    recs = spark.createDataFrame(
        [(1, "b", 10), (2, "a", 20), (3, "a", 30), (1, "c", 40), (2, "b", 50)],
        "user_id long, artist_mbid string, listen_count long")
    got = [r.artist_id for r in recs.join(sim.dense_ids(recs), "artist_mbid").orderBy("listen_count").collect()]
    assert got == [1, 0, 0, 2, 1]
    w = {(r.user_id, r.artist_mbid): r.weight for r in sim.bm25(recs).collect()}
    # N = max user id + 1 = 4 rows; idf(a) = ln 4 - ln(1 + 2)
    n, avg = 4.0, 150 / 4.0
    row1 = 50.0
    norm = 0.2 + 0.8 * row1 / avg
    assert np.isclose(w[(1, "b")], 10 * 101 / (100 * norm + 10) * (np.log(n) - np.log1p(2)))


def test_similarity_pairs_properties(spark):
    recs = dump_fixture(spark)
    agg = sim.dump_aggregate(recs, AS_OF)
    numbers = sim.dense_ids(agg)
    model = sim.fit_als(sim.bm25(agg), numbers, rank=8, max_iter=5)
    lab = numbers.select(F.col("artist_id").cast("int").alias("id"), "artist_mbid")
    factors = model.itemFactors.join(lab, "id")
    pairs = sim.cosine_pairs(factors, block_size=3).collect()
    ids = sorted({r.artist_mbid for r in lab.collect()})
    n = len(ids)
    off = [r for r in pairs if r.artist_mbid_a != r.artist_mbid_b]
    assert len(off) == n * (n - 1) // 2 and all(r.artist_mbid_a < r.artist_mbid_b for r in off)
    assert all(-1.0 - 1e-9 <= r.score_value <= 1.0 + 1e-9 for r in off)
    assert len({(r.artist_mbid_a, r.artist_mbid_b) for r in off}) == len(off)

    def subset(fr, to):
        f = spark.createDataFrame([(x,) for x in fr], "m string")
        t = spark.createDataFrame([(x,) for x in to], "m string")
        return sim.cosine_pairs(factors, block_size=3, from_ids=f, to_ids=t).collect()

    assert len(subset(ids[:2], ids[2:4])) == 4
    assert len(subset(ids[:3], ids[1:4])) == 6
    again = sim.cosine_pairs(
        sim.fit_als(sim.bm25(agg), numbers, rank=8, max_iter=5).itemFactors.join(lab, "id"),
        block_size=3).collect()
    key = lambda rs: sorted((r.artist_mbid_a, r.artist_mbid_b, round(r.score_value, 6)) for r in rs)
    assert key(again) == key(pairs)


def test_cosine_search_finds_smaller_and_larger_ids(spark):
    rng = np.random.default_rng(5)
    v = {f"{i:03d}": [float(x) for x in rng.normal(size=6)] for i in range(40)}
    rows = [*v.items(), (None, [1.0] * 6)]
    asked = ["000", "017", "018", "039"]
    got = sim.cosine_search(spark.createDataFrame(rows, "id string, v array<double>"),
                            spark.createDataFrame([(a,) for a in [*asked, None, "x"]], "m string"), "id", "v", block_size=4).collect()
    assert sorted((r.artist_mbid_a, r.artist_mbid_b) for r in got) == [(a, b) for a in asked for b in sorted(v) if b != a]
    for r in got:
        a, b = np.array(v[r.artist_mbid_a]), np.array(v[r.artist_mbid_b])
        assert np.isclose(r.score_value, a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def test_min_users_filter(spark):
    recs = spark.createDataFrame(
        [("s", dt.date(2024, 5, 1), u, "x", 1) for u in range(3)] + [("s", dt.date(2024, 5, 1), u, "y", 1) for u in range(4)]
        + [("s", dt.date(2022, 1, 1), 9, "y", 1)],
        "slug string, dump_date date, user_id long, artist_mbid string, listen_count long")
    got = {r.artist_mbid for r in sim.dump_aggregate(recs, AS_OF).collect()}
    assert got == {"y"}


def test_http_failure_rules(spark):
    errs = ["HTTPSConnectionPool: status=None", "HTTPError status=500", "HTTPError status=404 not found", "timed out"]
    rows = [(f"m{i}", "artist", json.dumps({"_success": False, "error": e}), dt.datetime(2024, 1, 1))
            for i, e in enumerate(errs)]
    rows.append(("m9", "label", json.dumps({"_success": False, "error": "timed out"}), dt.datetime(2024, 1, 1)))
    rows.append(("m8", "artist", json.dumps({"_success": True}), dt.datetime(2024, 1, 1)))
    ann = spark.createDataFrame(rows, "mbid string, entity string, payload_json string, ts_utc timestamp_ntz")
    assert sorted(r.mbid for r in qu.http_failures(ann).collect()) == ["m0", "m3"]


def test_updated_entities_due(spark):
    now = dt.datetime(2024, 5, 10)
    ann = spark.createDataFrame(
        [("r1", "release", "{}", now - dt.timedelta(days=2)), ("rg1", "release-group", "{}", now - dt.timedelta(days=2)),
         ("r2", "release", "{}", now)], "mbid string, entity string, payload_json string, ts_utc timestamp_ntz")
    recs = spark.createDataFrame(
        [("d1", "release", now - dt.timedelta(days=1), "r1",
          json.dumps({"containers": [{"mbid": "rg1", "entity": "release-group"}]})),
         ("d2", "release", now - dt.timedelta(days=1), "r2", json.dumps({"containers": []}))],
        "slug string, dump_entity string, dump_timestamp timestamp_ntz, mbid string, json_data string")
    assert sorted(r.mbid for r in qu.updated_entities(ann, recs).collect()) == ["r1", "rg1"]


def test_clusterable_tracks_rules(spark):
    from cadence.plans.smart_mix import clusterable_tracks

    files = spark.createDataFrame(
        [("a", "ta", "A", "AA", "x", "xx", [1.0], True, 90), ("b", "tb", "B", None, "y", None, None, False, 90),
         ("c", "tc", "C", None, None, None, [1.0], True, 90), ("d", "td", "D", None, "z", None, [1.0], True, 90),
         ("e", "te", "E", None, "w", None, [1.0], True, 90)],
        "filepath string, track_name string, artist_name string, album_artist_name string, artist_mbid string, "
        "album_artist_mbid string, embedding array<double>, embedding_success boolean, embedding_duration_seconds int")
    counts = spark.createDataFrame([("u", p, n) for p, n in [("a", 3.0), ("b", 3.0), ("c", 3.0), ("d", 1.0)]],
                                   "username string, filepath string, lifetime_listen_count double")
    none = spark.createDataFrame([], "username string, filepath string")
    got = {(r.filepath, r.artist_name) for r in clusterable_tracks(counts, none, files).collect()}
    assert got == {("a", "AA")}
    loved = spark.createDataFrame([("u", "e")], "username string, filepath string")
    assert {r.filepath for r in clusterable_tracks(counts, loved, files).collect()} == {"a", "e"}


def test_seed_weights_missing_path_is_zero_listens(spark):
    import math

    from cadence.plans.playlists import recently_played, seed_weights_from_listens

    seeds = spark.createDataFrame([("p", "u", "a"), ("p", "u", "b")], "playlist_id string, username string, filepath string")
    fc = spark.createDataFrame([("u", "a", 5.0, 1.0, 0.5), ("u", "c", 1.0, 0.0, 0.9), ("u", "d", 2.0, 2.0, 0.7),
                                ("u", "e", 2.0, 1.0, 0.8)],
                               "username string, filepath string, lifetime_listen_count double, "
                               "last30_listen_count double, recency_score double")
    w = {r.filepath: r.weight for r in seed_weights_from_listens(seeds, fc).collect()}
    assert math.isclose(w["a"], math.log(7.0)) and math.isclose(w["b"], math.log(2.0))
    rp = [r.filepath for r in recently_played(fc, limit=2).orderBy("recency_score", ascending=False).collect()]
    assert rp == ["e", "d"]  # c has no listens in 30 days; limit 2 by recency


def test_leaf_selection_on_handmade_tree():
    from cadence.operators.clustering import leaf_labels_from_mst

    nodes = ["a1", "a2", "a3", "b1", "b2", "b3", "z"]
    edges = [("a1", "a2", 0.1), ("a2", "a3", 0.1), ("b1", "b2", 0.1), ("b2", "b3", 0.12),
             ("a3", "b1", 1.0), ("b3", "z", 3.0)]
    lab = leaf_labels_from_mst(nodes, edges)
    assert lab["z"] == -1
    assert lab["a1"] == lab["a2"] == lab["a3"] >= 0
    assert lab["b1"] == lab["b2"] == lab["b3"] >= 0 and lab["b1"] != lab["a1"]
    # all points in one tight group: no split -> no clusters (all noise)
    assert set(leaf_labels_from_mst(["x", "y", "w"], [("x", "y", 0.1), ("y", "w", 0.1)]).values()) == {-1}


def test_conditioner_registry(spark, tmp_path):
    """A registered model comes back; a wrong id or a changed model is refused."""
    import pytest

    from cadence.operators import conditioner as cond

    rng = np.random.default_rng(0)
    df = spark.createDataFrame([([float(x) for x in v],) for v in rng.standard_normal((60, 8))], "embedding array<double>")
    model = cond.fit(df, "embedding", 3)
    path = str(tmp_path / "models")
    name = cond.save(spark, model, path)
    back = cond.load(spark, path, name)
    assert back.model_id == name and np.allclose(back.components, model.components)
    # components are orthonormal and ordered by the variance they explain
    assert np.allclose(model.components @ model.components.T, np.eye(3), atol=1e-8)
    x = np.array([r.embedding for r in df.collect()]) - model.mean
    var = ((x @ model.components.T) ** 2).sum(axis=0)
    assert (np.diff(var) <= 1e-9).all()
    with pytest.raises(ValueError):
        cond.load(spark, path, "pca_d3_000000")
    other = cond.Conditioner(mean=model.mean, components=model.components + 1e-3)
    bad = spark.read.parquet(path).withColumn("components", F.lit([[float(v) for v in c] for c in other.components]))
    bad.write.parquet(path + "-bad")
    with pytest.raises(ValueError):
        cond.load(spark, path + "-bad", name)
