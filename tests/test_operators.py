"""Operator-level tests on small fixtures (plain-Python / numpy references)."""

import datetime as dt

import pandas as pd

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import conditioner as cond
from cadence.operators import merge as mg
from cadence.operators import quota, sampling, spikes
from cadence.operators.priority import priority_merge
from cadence.operators.sets import symmetrise


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(0)
    X = rng.standard_normal((100, 32))
    df = spark.createDataFrame([(i, [float(v) for v in X[i]]) for i in range(100)], "id long, embedding array<double>")
    m = cond.fit(df, "embedding", 5)
    Xc = X - X.mean(axis=0)
    _, _, vt = np.linalg.svd(Xc, full_matrices=False)
    comps = vt[:5]
    idx = np.argmax(np.abs(comps), axis=1)
    comps = comps * np.sign(comps[np.arange(5), idx])[:, None]
    assert np.allclose(m.components, comps, atol=1e-6)
    out = cond.transform(df, m).orderBy("id").collect()
    got = np.array([r.conditioned_embedding for r in out])
    assert np.allclose(got, Xc @ comps.T, atol=1e-6)
    # refit is deterministic (same fingerprint)
    assert cond.fit(df, "embedding", 5).model_id == m.model_id


def test_cull_rules():
    rows = pd.DataFrame([dict(filepath=p, recording_mbid=r, artist_mbid=a, album_artist_mbid=aa)
                         for p, r, a, aa in [("1", "r1", "x", "x"), ("2", "r2", "x", "x"), ("3", "r3", "x", "x"),
                                             ("2", "r9", "y", "y"), ("4", "r4", "z", None)]])
    taken = quota.walk(quota.cull_keys(rows), lambda k: quota.CULL_ROOM[k[0]], 10)
    assert list(rows["filepath"].iloc[taken]) == ["1", "2", "4"]


def test_greedy_quota_skips_seeds_and_null_artists(spark):
    rows = [("p", str(i), float(i), None if i == 2 else f"a{i}", f"a{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "playlist_id string, filepath string, distance double, artist_mbid string, album_artist_mbid string")
    seeds = spark.createDataFrame([("p", "0")], "playlist_id string, filepath string")
    got = quota.greedy_quota(df, limit=3, quota=2, seed_paths=seeds).orderBy("rank").collect()
    assert [(r.filepath, r["rank"]) for r in got] == [("1", 0), ("3", 1), ("4", 2)]
    plain = quota.greedy_quota(df, limit=3, quota=None).orderBy("rank").collect()
    assert [r.filepath for r in plain] == ["0", "1", "2"]


def test_pruning_before_the_walk_changes_nothing(spark):
    import random

    rng = random.Random(0)
    artists = ["a", "b", "c", *sorted(quota.SPECIAL_PURPOSE_ARTISTS)[:2]]
    rows = [(f"p{p}", f"{p}-{i}", rng.random(), rng.choice(artists), rng.choice(artists)) for p in range(40) for i in range(30)]
    schema = "playlist_id string, filepath string, distance double, artist_mbid string, album_artist_mbid string"
    got = {}
    for r in quota.greedy_quota(spark.createDataFrame(rows, schema), limit=7, quota=2).orderBy("rank").collect():
        got.setdefault(r.playlist_id, []).append(r.filepath)
    for p in range(40):
        counts, want = {}, []
        for _, f, _, a, b in sorted((r for r in rows if r[0] == f"p{p}"), key=lambda r: r[2]):
            if len(want) < 7 and all(counts.get(x, 0) < 2 for x in {a, b}):
                want.append(f)
                for x in {a, b} - quota.SPECIAL_PURPOSE_ARTISTS:
                    counts[x] = counts.get(x, 0) + 1
        assert got[f"p{p}"] == want


def test_concatenated_json_over_lines(spark):
    from cadence.plans import ingest

    text = '{"id": "a"}{"id":\n "b{", "x": {"y": "}\\""}}\n oops {"id": "c"} {"nope": 1} {"id": "d"\n'
    df = spark.createDataFrame([("12-release", text), ("13-artist", None), ("14-artist", "")], "slug string, value string")
    records, bad = ingest.scan_entity_dump(df)
    assert sorted((r.packet_number, r.entity, r.mbid) for r in records.collect()) == [(12, "release", x) for x in ("a", "b{", "c")]
    assert sorted(r.bad for r in bad.collect()) == ["oops", '{"id": "d"']


def test_timeline_of_a_single_year(spark):
    from cadence.functions.scalars import timeline

    df = spark.createDataFrame([(2000, 2000), (1999, 2001), (None, None)], "a int, b int")
    assert [r.t for r in df.select(timeline("a", "b").alias("t")).collect()] == ["2000-2000", "1999-2001", None]


def test_spike_counts_against_brute_force(spark):
    base = dt.datetime(2024, 1, 1)
    offs = [0, 1, 2, 3, 4, 5, 23.5, 24, 24.5, 60, 61, 62, 63, 64, 65, 66]
    rows = [(f"m{i}", "u", "r", base + dt.timedelta(hours=h), "t", "l", "a") for i, h in enumerate(offs)]
    df = spark.createDataFrame(rows, "listen_md5 string, username string, recording_mbid string, "
                                     "listen_at_ts_utc timestamp_ntz, track_name string, release_name string, "
                                     "artist_name string")
    got = {r.listen_md5: r.next_24h_listen_count for r in spikes.next_24h_counts(df).collect()}
    for i, h in enumerate(offs):
        want = sum(1 for g in offs if h < g < h + 24)
        assert got[f"m{i}"] == want
    kept = spikes.track_play_spikes(df, min_count=5).collect()
    # m1 (h=1) sees 7 later plays inside 24h, more than any other start
    assert len(kept) == 1 and kept[0].start_listen_md5 == "m1"


def test_upsert_insert_replace(spark):
    t = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, s string, v int")
    s = spark.createDataFrame([(2, "B", 200), (3, "c", 30)], "k int, s string, v int")
    up = {r.k: (r.s, r.v) for r in mg.upsert(t, s, ["k"], update_cols=["v"]).collect()}
    assert up == {1: ("a", 10), 2: ("b", 200), 3: ("c", 30)}
    ins = {r.k: (r.s, r.v) for r in mg.insert_absent(t, s, ["k"]).collect()}
    assert ins == {1: ("a", 10), 2: ("b", 20), 3: ("c", 30)}
    g = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "grp int, s string, v int")
    empty = g.limit(0)
    keys = spark.createDataFrame([(1,)], "grp int")
    rep = mg.replace_groups(g, empty, ["grp"], groups=keys).collect()
    assert [(r.grp, r.s) for r in rep] == [(2, "c")]


def test_incremental_empty_target_loads_all(spark):
    src = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1.0), ("a", dt.datetime(2024, 1, 2), 2.0)],
                                "k string, ts timestamp_ntz, v double")
    out = mg.incremental_merge(src.limit(0), src, ["k"], "ts").collect()
    assert [(r.k, r.v) for r in out] == [("a", 2.0)]


def test_priority_merge_first_list_wins(spark):
    def lst(xs):
        return spark.createDataFrame([(x, i) for i, x in enumerate(xs)], "k long, pos long")

    lists = [("a", lst([1, 2, 3]), F.col("pos")), ("b", lst([3, 4, 5]), F.col("pos")), ("c", lst([5, 6, 7]), F.col("pos"))]
    five = priority_merge(lists, "k", 5).collect()
    assert [r.k for r in five] == [1, 2, 3, 4, 5]
    assert {r.k: r.source for r in five}[3] == "a"
    assert [r.k for r in priority_merge(lists, "k").collect()] == [1, 2, 3, 4, 5, 6, 7]


def test_weighted_sample_counts_and_determinism(spark):
    df = spark.createDataFrame([(f"u{u}", f"i{i}", float(i)) for u in range(3) for i in range(20)],
                               "g string, item string, score double")
    s1 = sampling.weighted_sample(df, ["g"], ["g", "item"], -F.col("score"), 5).collect()
    s2 = sampling.weighted_sample(df, ["g"], ["g", "item"], -F.col("score"), 5).collect()
    assert len(s1) == 15 and sorted(map(tuple, s1)) == sorted(map(tuple, s2))


def test_symmetrise_diagonal_once(spark):
    cf = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5)], "artist_mbid_a string, artist_mbid_b string, score_value double")
    got = sorted((r.artist_mbid_a, r.artist_mbid_b) for r in symmetrise(cf).collect())
    assert got == [("a", "a"), ("a", "b"), ("b", "a")]


def test_replace_playlists_only_stale_or_forced(spark):
    from cadence.plans import queue as qu

    now = dt.datetime(2024, 5, 18, 12, 0, 0)
    coll = spark.createDataFrame(
        [("u", "fresh", [6, 18], dt.datetime(2024, 5, 18, 7)), ("u", "stale", [6, 18], dt.datetime(2024, 5, 18, 5)),
         ("u", "never", [6], None)],
        "username string, collection_name string, refresh_at_hours_utc array<int>, refreshed_at_utc timestamp_ntz")
    stored = spark.createDataFrame([("u", c, 0, "old") for c in ["fresh", "stale", "never"]],
                                   "username string, collection_name string, order_index int, filepath string")
    new = spark.createDataFrame([("u", c, 0, "new") for c in ["fresh", "stale", "never"]], stored.schema)
    tracks, stamped = qu.replace_playlists(stored, new, coll, now)
    got = {r.collection_name: r.filepath for r in tracks.collect()}
    assert got == {"fresh": "old", "stale": "new", "never": "new"}
    st = {r.collection_name: r.refreshed_at_utc for r in stamped.collect()}
    assert st["stale"] == now and st["fresh"] == dt.datetime(2024, 5, 18, 7)
    forced, _ = qu.replace_playlists(stored, new, coll, now, force=True)
    assert {r.filepath for r in forced.collect()} == {"new"}


def test_staleness_targets(spark):
    from cadence.plans import queue as qu

    coll = spark.createDataFrame([("c", "u", [6, 18], None)],
                                 "collection_name string, username string, refresh_at_hours_utc array<int>, "
                                 "refreshed_at_utc timestamp_ntz")
    for now, want in [(dt.datetime(2024, 5, 18, 12), dt.datetime(2024, 5, 18, 6)),
                      (dt.datetime(2024, 5, 18, 0), dt.datetime(2024, 5, 17, 18)),
                      (dt.datetime(2024, 5, 18, 21), dt.datetime(2024, 5, 18, 18)),
                      (dt.datetime(2024, 5, 18, 6), dt.datetime(2024, 5, 18, 6))]:
        assert qu.stale_collections(coll, now).first().refresh_target == want


def test_json_list_hash_matches_a_json_dump(spark):
    import hashlib
    import json

    from cadence.functions.scalars import json_list_hash

    names = ["plain", 'q"uo\\te', "Björk é", "日本 \U0001f600", "tab\tnl\n\x01\x7f", ""]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, n long")
    got = {r.n: r.h for r in df.select("n", json_list_hash(F.col("name"), (F.col("n"), "num")).alias("h")).collect()}
    assert got == {i: hashlib.md5(json.dumps([n, i]).encode()).hexdigest() for i, n in enumerate(names)}


def test_spikes_by_running_counts(spark):
    """No sliding frame, whose every row costs a walk through its day, and the
    24h suppression keeps what a comparison of all pairs keeps."""
    import datetime as dt
    import random
    import re

    rng = random.Random(5)
    day = dt.timedelta(days=1)
    rows = [(f"m{i}", "u", "r" + str(i % 2), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(60) * 7200)) for i in range(90)]
    df = spark.createDataFrame(rows, "listen_md5 string, username string, recording_mbid string, listen_at_ts_utc timestamp_ntz").selectExpr(
        "*", "'t' track_name", "'l' release_name", "'a' artist_name")
    kept = spikes.track_play_spikes(df, min_count=1, suppression="24h")
    frames = re.findall(r"RangeFrame, ([^,]*),", kept._jdf.queryExecution().optimizedPlan().toString())
    assert frames and set(frames) == {"unboundedpreceding$()"}
    ahead = {m: (k, t, sum(k == k2 and t < t2 < t + day for _, _, k2, t2 in rows)) for m, _, k, t in rows}
    spiky = [x for x in ahead.values() if x[2] >= 1]
    want = {m for m, (k, t, c) in ahead.items() if c >= 1 and not any(
        k2 == k and abs(t2 - t) < day and (c2 > c or c2 == c and t2 < t) for k2, t2, c2 in spiky)}
    assert {r.start_listen_md5 for r in kept.collect()} == want


def test_loves_meet_files_once(spark):
    """A user's loves of a recording are one row when they meet its files."""
    import datetime as dt

    from cadence.plans.activity import loved_tracks

    t = dt.datetime(2024, 1, 1)
    loves = spark.createDataFrame([("u", "r", t + dt.timedelta(hours=i % 50)) for i in range(200)] + [("u", None, t)],
                                  "username string, recording_mbid string, feedback_at timestamp_ntz")
    none = spark.createDataFrame([], "username string, recording_mbid string, period_start_at_utc timestamp_ntz")
    files = spark.createDataFrame([(f"f{i}", "r") for i in range(30)], "filepath string, recording_mbid string")
    out = loved_tracks(loves, none, files)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join"):]
    rows = out.collect()
    assert len(rows) == 30 and {(tuple(r.recording_mbids), r.love_at) for r in rows} == {(("r",), t)}
