"""Feedback, tags, dump times, positions, closure and sync on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cadence.operators import ranking
from cadence.plans import ingest, library, queue, sync


def test_feedback_pages(spark):
    a, b = "11111111-1111-1111-1111-111111111111", "22222222-2222-2222-2222-222222222222"
    pages = [
        f'{{"feedback":[{{"user_id":"u","recording_mbid":"{a}","score":1,"created":10}},{{"user_id":"u","recording_mbid":"bad","score":1,"created":1}}]}}',
        f'{{"count":1,"feedback":[{{"user_id":"u","recording_mbid":"{a}","score":1,"created":20,"track_metadata":{{"t":{{"x":1}}}}}},'
        f'{{"user_id":"v","recording_mbid":"{b}","score":1,"created":5}}]}}', '{"feedback":[]}', "no json", None]
    rows, bad = ingest.scan_feedback_pages(spark.createDataFrame([(p,) for p in pages], "value string"))
    got = {(r.username, r.recording_mbid): (r.feedback_at, r.track_metadata) for r in rows.collect()}
    assert got == {("u", a): (dt.datetime(1970, 1, 1, 0, 0, 20), '{"t":{"x":1}}'), ("v", b): (dt.datetime(1970, 1, 1, 0, 0, 5), "{}")}
    assert bad.count() == 1
    view = sync.feedback_view(rows.withColumn("insert_ts_utc", F.lit(dt.datetime(2024, 1, 1))))
    assert view.columns == ["feedback_md5", "username", "score", "recording_mbid", "feedback_at", "_ingest_insert_ts_utc"]


def test_tag_names(spark):
    docs = [
        ("1", '{"date":[""],"originalyear":[],"year":["2001","1"],"origyear":["1999"],"album artist":["B"]}'),
        ("2", '{"date":["2002-03"],"year":["2001"],"albumartist":["A"],"album artist":["B"],"genre":[]}'),
        ("3", '{"origyear":["1999"],"albumartist":[""],"title":["t"]}'), ("4", "{}"), ("5", None),
    ]
    got = library.file_tags(spark.createDataFrame(docs, "filepath string, tags_json string")).orderBy("filepath").collect()
    assert [(r.date, r.album_artist, r.title, r.genre) for r in got] == [
        ("2001", "B", None, None), ("2002-03", "A", None, None), ("1999", None, "t", None), (None,) * 4, (None,) * 4]


def test_dump_times(spark):
    rows = [("12-artist", "2025-12-04 23:31:59.823155+00\n"), ("13-release-group", "2025-12-04 23:31:59+00"), ("14-x", "noon"), ("15-x", None)]
    got = ingest.dump_file_info(spark.createDataFrame(rows, "slug string, timestamp string")).orderBy("slug").collect()
    assert [r.dump_timestamp for r in got] == [dt.datetime(2025, 12, 4, 23, 31, 59, 823155), dt.datetime(2025, 12, 4, 23, 31, 59), None, None]
    assert (got[1].packet_number, got[1].entity) == (13, "release-group")


@pytest.mark.parametrize("ranges", [1, 7])
def test_positions_of_one_hot_group(spark, ranges):
    rows = [("u", i * 7919 % 2000, f"f{i}") for i in range(2000)] + [("v", 5, "x"), (None, 1, "y"), (None, 1, "z")]
    df = spark.createDataFrame(rows, "username string, at int, filepath string")
    got = ranking.number_rows(df, "username", [F.desc("at"), F.col("filepath")], ranges=ranges).collect()
    assert {(r.username, r.filepath): r.order_index for r in got if r.username != "u"} == {("v", "x"): 0, (None, "y"): 0, (None, "z"): 1}
    hot = sorted((r for r in got if r.username == "u"), key=lambda r: r.order_index)
    assert [r.at for r in hot] == list(range(1999, -1, -1)) and [r.order_index for r in hot] == list(range(2000))


def test_append_continues(spark):
    df = spark.createDataFrame([("u", 3, "a"), ("u", 4, "b"), ("v", 1, "c")], "username string, at int, filepath string")
    first = ranking.number_rows(df, "username", [F.col("at")])
    more = spark.createDataFrame([("u", 1, "d"), ("u", 0, "e"), ("w", 0, "f")], df.schema)
    got = ranking.append_rows(first, more, "username", [F.col("at")])
    assert {(r.username, r.filepath): r.order_index for r in got.collect()} == {
        ("u", "a"): 0, ("u", "b"): 1, ("v", "c"): 0, ("u", "e"): 2, ("u", "d"): 3, ("w", "f"): 0}


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_closure_of_a_deep_chain(spark, bound):
    """A chain of 12 with a cycle back, a shortcut and a known id in it."""
    edges = [(f"n{i}", f"n{i + 1}", "artist") for i in range(12)] + [("n5", "n0", "artist"), ("n0", "n2", "artist"), ("n1", "k", "release"), ("k", "z", "x")]
    e = spark.createDataFrame(edges, "src string, dst string, dst_entity string")
    seeds, known = spark.createDataFrame([("n0",)], "mbid string"), spark.createDataFrame([("k",)], "mbid string")
    got = {r.mbid: r.depth for r in queue.dependents_closure(seeds, e, known, max_broadcast_ids=bound).collect()}
    assert got == {"n1": 1, "n2": 1, **{f"n{i}": i - 1 for i in range(3, 13)}}
    assert queue.dependents_closure(seeds.limit(0), e, known).count() == 0


def test_sync(spark):
    key = "collection_name string, playlist_id string"
    here = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("b", "3"), ("c", "4")], key)
    there = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "5"), ("d", "6")], key)
    got = {r[0]: tuple(r)[1:] for r in sync.collections_in_sync(here, there).collect()}
    assert got == {"a": (2, 2, 2, True), "b": (1, 1, 0, False), "c": (1, 0, 0, False), "d": (0, 1, 0, False)}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_jobs_read_what_was_computed_once(spark, tmp_path, monkeypatch):
    """The table queries' commits read stored sums, the rounds of the closure
    stored edges."""
    import datetime as dt

    from cadence.plans import models

    t = dt.datetime(2000, 9, 1)
    given = {
        "orders": ([(1, 7, t), (2, 8, t), (3, None, t)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        "lineitem": ([(1, 5, 2.0), (1, 5, 3.0), (2, 6, 1.0), (3, None, 1.0)], "l_orderkey long, l_suppkey long, l_quantity double"),
        "supplier": ([(5, "s", 1, 1.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "part": ([(k, "p", "b", "t", 3) for k in range(30)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")}
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    firsts, create = [], models._table
    monkeypatch.setattr(models, "_table", lambda first, *a: (firsts.append(first), create(first, *a))[1])
    got = sorted(((r.slug, r.user_id, r.listen_count) for r in models.q_table_append(spark, str(tmp_path)).collect()), key=str)
    assert got == [("20000901", 7, 5), ("20000901", 8, 1)]
    models.q_table_replace_group(spark, str(tmp_path))
    models.q_table_versions(spark, str(tmp_path))
    assert len(firsts) == 3 and not any("Join" in _plan(f) or "Aggregate" in _plan(f) for f in firsts)
    edges, closure = [], models.qu.dependents_closure
    monkeypatch.setattr(models.qu, "dependents_closure", lambda s, e, k: (edges.append(e), closure(s, e, k))[1])
    assert models.q_dependents_closure(spark, str(tmp_path)).count() > 0
    assert "json" not in _plan(edges[0])
