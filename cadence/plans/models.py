"""Registered warehouse models over the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from cadence.plans import listen_counts as lc
from cadence.plans.common import round_doubles
from cadence.plans.registry import register
from cadence.session import stored
from cadence.sources import testdata as td

AS_OF = td.LISTEN_AS_OF
# A later clock puts the test listens 90..150 days in the past (revisit models).
REVISIT_AS_OF = dt.datetime(2024, 5, 15)


def grain(spark: SparkSession, sf_dir: str, as_of=AS_OF) -> DataFrame:
    base = lc.recency_base(td.listens(spark, sf_dir), td.releases(spark, sf_dir), as_of)
    return lc.listen_grain(base, as_of)


@register("artist_listen_counts")
def q_artist_listen_counts(spark, sf_dir):
    return round_doubles(lc.artist_listen_counts(grain(spark, sf_dir), td.artists(spark, sf_dir), AS_OF))


@register("recording_listen_counts")
def q_recording_listen_counts(spark, sf_dir):
    return round_doubles(lc.recording_listen_counts(grain(spark, sf_dir), td.recordings(spark, sf_dir), AS_OF))


@register("release_listen_counts")
def q_release_listen_counts(spark, sf_dir):
    return round_doubles(lc.release_listen_counts(grain(spark, sf_dir), td.releases(spark, sf_dir), AS_OF))


@register("release_group_listen_counts")
def q_release_group_listen_counts(spark, sf_dir):
    return round_doubles(
        lc.release_group_listen_counts(grain(spark, sf_dir), td.release_groups(spark, sf_dir), AS_OF)
    )


# --- library maps and activity models ----------------------------------------

from pyspark.sql import functions as F  # noqa: E402

from cadence.operators import spikes as sp  # noqa: E402
from cadence.plans import activity as act  # noqa: E402
from cadence.plans import library as lib  # noqa: E402


def name_map(spark, sf_dir):
    return lib.name_map(td.raw_name_map(spark, sf_dir))


def file_map(spark, sf_dir):
    return lib.map_file_recording(td.files(spark, sf_dir), name_map(spark, sf_dir))


@register("name_map_flatten")
def q_name_map_flatten(spark, sf_dir):
    return name_map(spark, sf_dir).withColumn("artist_mbids", F.array_join("artist_mbids", ","))


@register("file_maps")
def q_file_maps(spark, sf_dir):
    return lib.file_maps_long(td.files(spark, sf_dir), name_map(spark, sf_dir))


@register("file_listen_counts")
def q_file_listen_counts(spark, sf_dir):
    return round_doubles(
        act.file_listen_counts(td.listens(spark, sf_dir), file_map(spark, sf_dir), td.files(spark, sf_dir), AS_OF)
    )


@register("file_play_rollup")
def q_file_play_rollup(spark, sf_dir):
    return act.file_play_rollup(td.listens(spark, sf_dir), file_map(spark, sf_dir))


@register("daily_stats")
def q_daily_stats(spark, sf_dir):
    return round_doubles(act.daily_user_listen_stats(td.listens(spark, sf_dir), file_map(spark, sf_dir), AS_OF))


@register("play_spikes")
def q_play_spikes(spark, sf_dir):
    return sp.track_play_spikes(td.listens(spark, sf_dir))


@register("play_spikes_24h")
def q_play_spikes_24h(spark, sf_dir):
    return sp.track_play_spikes(td.listens(spark, sf_dir), suppression="24h")


@register("loved_tracks")
def q_loved_tracks(spark, sf_dir):
    lt = act.loved_tracks(
        td.feedback(spark, sf_dir), sp.track_play_spikes(td.listens(spark, sf_dir)), file_map(spark, sf_dir)
    )
    return lt.withColumn("recording_mbids", F.array_join("recording_mbids", ","))


@register("unmapped_listens")
def q_unmapped_listens(spark, sf_dir):
    return act.unmapped_listens(td.listens(spark, sf_dir), file_map(spark, sf_dir), AS_OF).drop("artist_mbids")


@register("revisit_releases")
def q_revisit_releases(spark, sf_dir):
    g = grain(spark, sf_dir, REVISIT_AS_OF)
    rg = lc.release_group_listen_counts(g, td.release_groups(spark, sf_dir), REVISIT_AS_OF)
    return round_doubles(act.revisit_releases(rg))


@register("revisit_tracks")
def q_revisit_tracks(spark, sf_dir):
    g = grain(spark, sf_dir, REVISIT_AS_OF)
    rc = lc.recording_listen_counts(g, td.recordings(spark, sf_dir), REVISIT_AS_OF)
    return round_doubles(act.revisit_tracks(rc, file_map(spark, sf_dir), td.files(spark, sf_dir)))


# --- ingest flatten, scalar functions, recommendations -------------------------

from cadence.functions import scalars as S  # noqa: E402
from cadence.operators.sets import symmetrise  # noqa: E402
from cadence.plans import ingest  # noqa: E402
from cadence.plans import recommend as rec  # noqa: E402


@register("listen_flatten")
def q_listen_flatten(spark, sf_dir):
    df = ingest.flatten_listens(td.raw_listens(spark, sf_dir))
    return df.withColumn("artist_mbids", F.array_join("artist_mbids", ","))


@register("uuid_year_casts")
def q_uuid_year_casts(spark, sf_dir):
    o = td.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    canon = td.mbid("o", k)
    raw = (
        F.when(k % 5 == 0, canon)
        .when(k % 5 == 1, F.upper(canon))
        .when(k % 5 == 2, F.regexp_replace(canon, "-", ""))
        .when(k % 5 == 3, F.concat(F.lit("urn:uuid:"), canon))
        .otherwise(F.concat(F.lit("{"), F.substring(canon, 1, 30), F.lit("}")))
    )
    date_txt = F.when(k % 7 == 0, F.lit("19.5-01-01")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select(
        k.alias("o_orderkey"),
        raw.alias("raw_id"),
        S.try_cast_uuid(raw).alias("strict_uuid"),
        S.try_uuid(raw).alias("lenient_uuid"),
        date_txt.alias("date_text"),
        S.extract_year(date_txt).alias("year"),
    )


@register("surrogate_keys")
def q_surrogate_keys(spark, sf_dir):
    li = td.table(spark, sf_dir, "lineitem")
    maybe_null = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag"))
    return li.select(
        "l_orderkey",
        "l_linenumber",
        S.surrogate_key("l_orderkey", "l_linenumber", maybe_null).alias("surrogate_key"),
        S.md5_join("l_orderkey", "l_suppkey").alias("pair_md5"),
        S.recording_md5(F.concat(F.lit(" Track "), F.col("l_partkey").cast("string")), F.col("l_returnflag"),
                        F.col("l_linestatus")).alias("recording_md5"),
        S.json_list_hash(F.col("l_returnflag"), (F.col("l_orderkey"), "num")).alias("list_hash"),
    )


@register("dim_flatten")
def q_dim_flatten(spark, sf_dir):
    return td.artists(spark, sf_dir)


def similar_activity(spark, sf_dir):
    return rec.similar_user_activity(td.raw_similar_activity(spark, sf_dir), td.task_count(spark, sf_dir, "lineitem"))


@register("similar_activity")
def q_similar_activity(spark, sf_dir):
    return round_doubles(similar_activity(spark, sf_dir))


@register("release_additions")
def q_release_additions(spark, sf_dir):
    files, nm = td.files(spark, sf_dir), name_map(spark, sf_dir)
    out = rec.library_release_additions(
        similar_activity(spark, sf_dir), td.releases(spark, sf_dir),
        lib.map_file_release_group(files, nm), td.release_groups(spark, sf_dir),
    )
    return round_doubles(out)


@register("artist_recommends")
def q_artist_recommends(spark, sf_dir):
    files, nm = td.files(spark, sf_dir), name_map(spark, sf_dir)
    ac = lc.artist_listen_counts(grain(spark, sf_dir), td.artists(spark, sf_dir), AS_OF)
    out = rec.artist_recommends(ac, lib.map_file_artist(files, nm), symmetrise(td.cf_scores(spark, sf_dir)),
                                td.artists(spark, sf_dir))
    return round_doubles(out)


# --- similarity model ------------------------------------------------------------

from cadence.operators import similarity as sim  # noqa: E402

EXCLUDED_DUMP_USER = 1


def _dump_agg(spark, sf_dir):
    return sim.dump_aggregate(td.dump_records(spark, sf_dir), td.DUMP_AS_OF, EXCLUDED_DUMP_USER)


@register("dump_aggregate")
def q_dump_aggregate(spark, sf_dir):
    return _dump_agg(spark, sf_dir)


@register("bm25")
def q_bm25(spark, sf_dir):
    return round_doubles(sim.bm25(_dump_agg(spark, sf_dir)))


@register("item_similarity")
def q_item_similarity(spark, sf_dir):
    recs = td.dump_records(spark, sf_dir)
    known = recs.select("artist_mbid").distinct()
    return round_doubles(sim.artist_similarity(recs, known, td.DUMP_AS_OF, EXCLUDED_DUMP_USER))


# --- collections: sampling and the entity universe ---------------------------------

from cadence.plans import collections as col  # noqa: E402


@register("weighted_sample")
def q_weighted_sample(spark, sf_dir):
    g = grain(spark, sf_dir, REVISIT_AS_OF)
    rr = act.revisit_releases(lc.release_group_listen_counts(g, td.release_groups(spark, sf_dir), REVISIT_AS_OF))
    return round_doubles(col.sample_revisit_releases(rr, count=15))


@register("top_artists_sample")
def q_top_artists_sample(spark, sf_dir):
    ac = lc.artist_listen_counts(grain(spark, sf_dir), td.artists(spark, sf_dir), AS_OF)
    return col.sample_top_artists(ac, "30", count=15)


def _asked_files(spark, sf_dir):
    """(all files with their vectors, the ids whose vector number is divisible by 100)."""
    f = td.table(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("artist_mbid"), "embedding", "vec_id")
    return f.drop("vec_id"), f.where(F.col("vec_id") % 100 == 0).select("artist_mbid")


@register("embedding_cosine_search")
def q_embedding_cosine_search(spark, sf_dir):
    """Files whose vector number is divisible by 100 against all other files."""
    f, asked = _asked_files(spark, sf_dir)
    return round_doubles(sim.cosine_search(f, asked, "artist_mbid", "embedding", 256))


@register("dense_ids")
def q_dense_ids(spark, sf_dir):
    return sim.dense_ids(td.dump_records(spark, sf_dir))


@register("mbid_universe")
def q_mbid_universe(spark, sf_dir):
    return col.mbid_universe(td.listens(spark, sf_dir), td.files(spark, sf_dir), name_map(spark, sf_dir),
                             similar_activity(spark, sf_dir), td.releases(spark, sf_dir), td.feedback(spark, sf_dir))


# --- merges and data quality -------------------------------------------------------

import datetime as _dt  # noqa: E402

from cadence.operators import merge as mg  # noqa: E402
from cadence.operators import quality as dq  # noqa: E402
from cadence.operators import tables as tb  # noqa: E402

MERGE_SPLIT = _dt.date(1999, 1, 1)
MERGE_OVERLAP = _dt.date(1998, 1, 1)


def _dump_table(spark, sf_dir):
    """Dump table keyed by (slug, user_id, artist_mbid)."""
    return _named(_dump_sums(spark, sf_dir))


def _dump_sums(spark, sf_dir):
    """The dump table before its keys are spelled out: a slug is the text of a
    dump date, an artist's id that of a supplier number."""
    return td.dump_lines(spark, sf_dir).groupBy("dump_date", "user_id", "l_suppkey").agg(F.sum("listen_count").alias("listen_count"))


def _named(sums):
    return sums.select(F.date_format("dump_date", "yyyyMMdd").alias("slug"), "user_id", td.mbid("s", F.col("l_suppkey")).alias("artist_mbid"),
                       "dump_date", "listen_count")


def _stored_dump_table(spark, sf_dir):
    """The dump table for queries whose jobs read it several times: summed once."""
    return _named(stored(_dump_sums(spark, sf_dir), "dump-sums"))


def _target_source(spark, sf_dir, dump_table=_dump_table):
    t = dump_table(spark, sf_dir)
    target = t.where(F.col("dump_date") < F.lit(MERGE_SPLIT))
    source = t.where(F.col("dump_date") >= F.lit(MERGE_OVERLAP)).withColumn(
        "listen_count", F.col("listen_count") * 10)
    return target, source


KEY = ["slug", "user_id", "artist_mbid"]


@register("upsert_merge")
def q_upsert_merge(spark, sf_dir):
    target, source = _target_source(spark, sf_dir)
    return mg.upsert(target, source, KEY, update_cols=["listen_count"])


@register("insert_absent")
def q_insert_absent(spark, sf_dir):
    target, source = _target_source(spark, sf_dir)
    return mg.insert_absent(target, source, KEY)


@register("replace_group")
def q_replace_group(spark, sf_dir):
    target, source = _target_source(spark, sf_dir)
    return mg.replace_groups(target, source, ["slug"])


@register("incremental_merge")
def q_incremental_merge(spark, sf_dir):
    """Annotations-style incremental load: orders as (key, ts) rows."""
    o = td.table(spark, sf_dir, "orders").select(
        td.mbid("o", F.col("o_orderkey") % 5000).alias("mbid"), F.col("o_orderdate").alias("ts_utc"),
        F.col("o_totalprice").alias("value"))
    target = mg.incremental_merge(None, o.where(F.col("ts_utc") < F.lit(_dt.datetime(1999, 1, 1))), ["mbid"],
                                  "ts_utc", tiebreak=["value"])
    return round_doubles(mg.incremental_merge(target, o, ["mbid"], "ts_utc", tiebreak=["value"]))


def _table(first, partition_by=None):
    """A new table in the scratch folder."""
    from cadence.session import scratch_path

    return tb.Table.create(first, scratch_path(first.sparkSession, "table"), partition_by)


@register("table_append")
def q_table_append(spark, sf_dir):
    """A dump table that came in four appended parts, one of them twice."""
    t = _stored_dump_table(spark, sf_dir).withColumn("part", F.col("user_id") % 4)
    table = _table(t.where("part = 0"))
    for part in (1, 2, 2, 3):
        table.append(t.where(F.col("part") == part), batch=part)
    return table.read().drop("part")


@register("table_replace_group")
def q_table_replace_group(spark, sf_dir):
    """Dumps loaded again take the place of the stored ones, slug by slug."""
    target, source = _target_source(spark, sf_dir, _stored_dump_table)
    table = _table(target)
    table.replace(source, ["slug"])
    return table.read()


@register("table_versions")
def q_table_versions(spark, sf_dir):
    """What each version holds: load, replaced groups (one year of them
    deleted), append, full refresh, and the compacted state before it."""
    target, source = _target_source(spark, sf_dir, _stored_dump_table)
    table = _table(target)
    year = target.where(F.year("dump_date") == 1997)
    table.replace(source, ["slug"], groups=source.select("slug").unionByName(year.select("slug")))
    table.append(year)
    table.compact()
    table.refresh(source)
    out = None
    for c in table.log():
        told = table.read(c["version"]).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("listen_count").alias("listens")).select(
            F.lit(c["version"]).alias("version"), F.lit(c["kind"]).alias("kind"), "n_rows", "listens")
        out = told if out is None else out.unionByName(told)
    return out


@register("stream_merge")
def q_stream_merge(spark, sf_dir):
    """The last listen of every (user, recording) by a stream of micro-batches
    that is stopped and started again; its first batch is delivered twice."""
    from cadence.session import join_path, scratch_path

    li = td.listens_from_events(td.events_stream(spark, sf_dir)).select("username", "recording_mbid", "listen_md5", "listen_at_ts_utc")
    keys, order = ["username", "recording_mbid"], ["listen_at_ts_utc", "listen_md5"]
    first = td.listens(spark, sf_dir).select(*li.columns)
    table = _table(first.limit(0))
    path = scratch_path(spark, "stream-merge")
    tb.merge_stream(li, table, keys, order, join_path(path, "once"))
    tb.merge_stream(li, table, keys, order, join_path(path, "once"))
    tb.merge_stream(li, table, keys, order, join_path(path, "again"))
    return table.read()


@register("listen_count_totals")
def q_listen_count_totals(spark, sf_dir):
    """The four listen-count tables from one stored listen grain: rows and
    lifetime listens per user."""
    g = stored(grain(spark, sf_dir), "listen-grain")
    tables = {
        "artist": lc.artist_listen_counts(g, td.artists(spark, sf_dir), AS_OF),
        "recording": lc.recording_listen_counts(g, td.recordings(spark, sf_dir), AS_OF),
        "release": lc.release_listen_counts(g, td.releases(spark, sf_dir), AS_OF),
        "release-group": lc.release_group_listen_counts(g, td.release_groups(spark, sf_dir), AS_OF),
    }
    out = None
    for name, t in tables.items():
        told = t.groupBy("username").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("lifetime_listen_count").alias("listens")).select(
            F.lit(name).alias("entity"), "username", "n_rows", "listens")
        out = told if out is None else out.unionByName(told)
    return out


@register("dq_unique")
def q_dq_unique(spark, sf_dir):
    return dq.unique(td.dump_records(spark, sf_dir), KEY)


@register("dq_not_null_proportion")
def q_dq_not_null_proportion(spark, sf_dir):
    f = td.files(spark, sf_dir)
    return round_doubles(dq.not_null_proportion(f, "album_artist_mbid", 0.9).unionByName(
        dq.not_null_proportion(f, "artist_mbid", 0.9)))


@register("dq_groupby_having")
def q_dq_groupby_having(spark, sf_dir):
    return dq.groupby_having(file_map(spark, sf_dir), ["filepath"], F.count(F.lit(1)) == 1)


# --- exports and streaming ------------------------------------------------------------

from cadence.operators import export as ex  # noqa: E402
from cadence.streaming import listens as stl  # noqa: E402


def _exported_playlists(spark, sf_dir):
    from cadence.plans.playlists import knn_weighted

    return knn_weighted(spark, sf_dir).withColumnsRenamed({"position": "order_index", "distance": "match_distance"})


def _descriptions(tracks):
    return tracks.select("playlist_id").distinct().withColumn("description", F.concat(F.lit("Songs like "), "playlist_id"))


@register("playlist_m3u8")
def q_playlist_m3u8(spark, sf_dir):
    t = _exported_playlists(spark, sf_dir)
    return ex.playlist_m3u8(t, description=_descriptions(t))


@register("playlist_json")
def q_playlist_json(spark, sf_dir):
    return ex.playlist_json(_exported_playlists(spark, sf_dir), description="Songs like ")


@register("playlist_xspf")
def q_playlist_xspf(spark, sf_dir):
    t = _exported_playlists(spark, sf_dir)
    return ex.playlist_xspf(t, description=_descriptions(t))


LATENESS = "1 hour"


def _drained(spark, stream, keys):
    """(rows by key, watermark) of a stream that is drained into a new table."""
    from cadence.session import join_path, scratch_path

    table = _table(spark.createDataFrame([], stream.schema))
    return table.read, stl.run_to_table(stream, table, keys, join_path(scratch_path(spark, "stream"), "checkpoint"), LATENESS)


@register("stream_daily_stats")
def q_stream_daily_stats(spark, sf_dir):
    s = stl.daily_listen_stats_stream(td.listens_from_events(td.events_stream(spark, sf_dir)), LATENESS)
    read, mark = _drained(spark, s, ["username", "listen_date"])
    end = (F.col("listen_date") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")
    return round_doubles(read().withColumn("is_closed", end <= F.lit(mark).cast("timestamp_ntz")))


@register("stream_dedupe")
def q_stream_dedupe(spark, sf_dir):
    a = td.listens_from_events(td.events_stream(spark, sf_dir))
    b = td.listens_from_events(td.events_stream(spark, sf_dir))
    path = stl.run_to_parquet(stl.dedupe_listens_stream(a.unionByName(b)), "stream-dedupe")
    return stl.read_sink(spark, path).drop("artist_mbids")


# --- annotation queue and maintenance ------------------------------------------------

from cadence.plans import annotations as an  # noqa: E402
from cadence.plans import queue as qu  # noqa: E402

QUEUE_AS_OF = td.DUMP_AS_OF
OLD_BEFORE = _dt.datetime(1996, 1, 1)
COLLECTION_NOW = _dt.datetime(2024, 5, 18, 12, 0, 0)
LATEST_PACKET = int(_dt.datetime(2002, 1, 1).replace(tzinfo=_dt.timezone.utc).timestamp() // 3600)
INBOX_MARK = _dt.datetime(2024, 1, 1, 4, 0, 0)


def _queue_inputs(spark, sf_dir):
    return td.queue_mbids(spark, sf_dir), td.annotations(spark, sf_dir), td.mb_dump_records(spark, sf_dir)


@register("http_failures")
def q_http_failures(spark, sf_dir):
    return qu.http_failures(td.annotations(spark, sf_dir))


@register("updated_entities")
def q_updated_entities(spark, sf_dir):
    return qu.updated_entities(td.annotations(spark, sf_dir), td.mb_dump_records(spark, sf_dir))


@register("refresh_queue")
def q_refresh_queue(spark, sf_dir):
    m, a, r = _queue_inputs(spark, sf_dir)
    return qu.refresh_queue(m, a, r, OLD_BEFORE, limit=200)


@register("queue_log")
def q_queue_log(spark, sf_dir):
    m, a, r = _queue_inputs(spark, sf_dir)
    return qu.queue_log(m, a, r, OLD_BEFORE)


@register("dangling_delete")
def q_dangling_delete(spark, sf_dir):
    kept = qu.drop_dangling(td.annotations(spark, sf_dir), td.queue_mbids(spark, sf_dir), QUEUE_AS_OF)
    return kept.select("mbid", "entity", "ts_utc")


@register("dependents_closure")
def q_dependents_closure(spark, sf_dir):
    """From all annotated artists; releases and release groups whose part
    number is no multiple of 3 are not annotated yet, but their payloads are
    there to be read in the next round."""
    a = td.entity_annotations(spark, sf_dir)
    artists = a.where(F.col("entity") == "artist").select("mbid")
    part = td.table(spark, sf_dir, "part").where(F.col("p_partkey") % 3 == 0)
    known = artists.unionByName(part.select(td.mbid("p", F.col("p_partkey")).alias("mbid")))
    # every round reads the edges: the payloads are parsed once
    return qu.dependents_closure(artists, stored(an.dependents(a), "dependents"), known)


@register("dependents")
def q_dependents(spark, sf_dir):
    return an.dependents(td.entity_annotations(spark, sf_dir))


@register("artists_flatten")
def q_artists_flatten(spark, sf_dir):
    a = an.flatten_artists(td.entity_annotations(spark, sf_dir))
    return a.select("artist_mbid", "artist_name", "artist_type", "disambiguation", "release_count", "earliest_release_year",
                    "latest_release_year", "active_years", "tags_string", "_ingest_insert_ts_utc",
                    F.json_array_length("release_list").alias("n_releases"))


@register("recordings_flatten")
def q_recordings_flatten(spark, sf_dir):
    r = an.flatten_recordings(td.entity_annotations(spark, sf_dir))
    return r.select("recording_mbid", "recording_title", "recording_length_ms", "artist_credit_phrase", "_ingest_insert_ts_utc",
                    F.json_array_length("release_list").alias("n_releases"))


@register("releases_flatten")
def q_releases_flatten(spark, sf_dir):
    r = an.flatten_releases(td.entity_annotations(spark, sf_dir))
    return r.select("release_mbid", "release_title", "release_group_mbid", "release_year", "artist_credit_phrase",
                    "_ingest_insert_ts_utc", F.json_array_length("artist_credit_list").alias("n_credits"))


@register("release_groups_flatten")
def q_release_groups_flatten(spark, sf_dir):
    r = an.flatten_release_groups(td.entity_annotations(spark, sf_dir))
    return r.select("release_group_mbid", "release_group_title", "release_count", "release_group_year", "first_release_date",
                    "release_group_type", "release_group_primary_type", "artist_credit_phrase", "_ingest_insert_ts_utc")


@register("map_recording_release")
def q_map_recording_release(spark, sf_dir):
    return an.map_recording_release(an.flatten_recordings(td.entity_annotations(spark, sf_dir)))


@register("map_release_group_artist")
def q_map_release_group_artist(spark, sf_dir):
    return an.map_release_group_artist(an.flatten_release_groups(td.entity_annotations(spark, sf_dir)))


@register("gap_packets")
def q_gap_packets(spark, sf_dir):
    li = td.table(spark, sf_dir, "lineitem")
    dumps = li.select(td._entity(F.col("l_orderkey")).alias("entity"),
                      (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 3600).cast("long").alias("packet_number"))
    return qu.gap_packets(dumps, LATEST_PACKET, td.ENTITIES + ["label"])


@register("inbox")
def q_inbox(spark, sf_dir):
    new, _mark = qu.inbox(td.file_birth(spark, sf_dir), INBOX_MARK)
    return new


@register("stale_collections")
def q_stale_collections(spark, sf_dir):
    return qu.stale_collections(td.collections(spark, sf_dir), COLLECTION_NOW)


@register("regex_exclude")
def q_regex_exclude(spark, sf_dir):
    return qu.exclude_by_patterns(td.files(spark, sf_dir).select("filepath"), td.exclude_patterns(spark, sf_dir))


@register("anti_new_recordings")
def q_anti_new_recordings(spark, sf_dir):
    return qu.new_recordings(td.files(spark, sf_dir), td.raw_name_map(spark, sf_dir))


@register("loves_diff")
def q_loves_diff(spark, sf_dir):
    from cadence.plans.playlists import _file_counts, recently_played

    loved = act.loved_tracks(td.feedback(spark, sf_dir), sp.track_play_spikes(td.listens(spark, sf_dir)),
                             file_map(spark, sf_dir))
    starred = recently_played(_file_counts(spark, sf_dir))
    return qu.loves_diff(loved, starred)


@register("playlist_file_counts")
def q_playlist_file_counts(spark, sf_dir):
    return qu.playlist_file_counts(td.playlist_tracks(spark, sf_dir), td.files(spark, sf_dir))


# --- ML: embedding conditioning ----------------------------------------------------------

from cadence.operators import conditioner as cond  # noqa: E402

CONDITIONED_DIMS = 50


@register("pca_condition")
def q_pca_condition(spark, sf_dir):
    """Fit on successful embeddings, score them; failed files keep NULL."""
    f = td.files(spark, sf_dir).select("filepath", "embedding_success", "embedding")
    ok = f.where(F.col("embedding_success"))
    model = cond.fit(ok, "embedding", CONDITIONED_DIMS)
    scored = cond.transform(f.withColumn("embedding", F.when(F.col("embedding_success"), F.col("embedding"))), model)
    return scored.select(
        "filepath", "embedding_success",
        F.transform("conditioned_embedding", lambda x: F.round(x, 6)).alias("conditioned_embedding"),
        F.lit(model.model_id).alias("model_id"),
    )


# --- dump scan, collections ------------------------------------------------------------


@register("listen_dump_scan")
def q_listen_dump_scan(spark, sf_dir):
    return ingest.count_pairs(ingest.scan_listen_dump(td.listen_dump_lines(spark, sf_dir)))


def _loved(spark, sf_dir):
    return act.loved_tracks(td.feedback(spark, sf_dir), sp.track_play_spikes(td.listens(spark, sf_dir)),
                            file_map(spark, sf_dir))


@register("loved_collection")
def q_loved_collection(spark, sf_dir):
    return col.loved_collection(_loved(spark, sf_dir), td.files(spark, sf_dir))


@register("cull_tracks")
def q_cull_tracks(spark, sf_dir):
    g = grain(spark, sf_dir, REVISIT_AS_OF)
    rc = lc.recording_listen_counts(g, td.recordings(spark, sf_dir), REVISIT_AS_OF)
    rt = act.revisit_tracks(rc, file_map(spark, sf_dir), td.files(spark, sf_dir))
    return col.revisit_tracks_collection(rt, td.files(spark, sf_dir))


@register("local_files_view")
def q_local_files_view(spark, sf_dir):
    lf = lib.local_files(td.raw_local_files(spark, sf_dir), td.raw_embeddings(spark, sf_dir),
                         td.birth_timestamps(spark, sf_dir))
    return lf.withColumn("embedding_dims", F.size("embedding")).drop("embedding")


@register("play_count_export")
def q_play_count_export(spark, sf_dir):
    files = td.files(spark, sf_dir)
    g = grain(spark, sf_dir)
    return qu.play_count_export(
        act.file_play_rollup(td.listens(spark, sf_dir), file_map(spark, sf_dir)),
        lc.artist_listen_counts(g, td.artists(spark, sf_dir), AS_OF),
        lc.release_listen_counts(g, td.releases(spark, sf_dir), AS_OF),
        qu.media_catalogue(files), AS_OF)


INGEST_TO = _dt.datetime(2024, 1, 29, 12, 0, 0)


@register("ingest_window")
def q_ingest_window(spark, sf_dir):
    """Per customer-user: where the next listen fetch starts (users u0..u9
    have listens; extra users from the customer table have none)."""
    users = td.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), (F.col("c_custkey") % 20).cast("string")).alias("username")).distinct()
    return qu.ingest_windows(td.listens(spark, sf_dir), users, INGEST_TO)


@register("signature_roundtrip")
def q_signature_roundtrip(spark, sf_dir):
    """Sign every stored playlist, garble every 3rd comment, parse back."""
    t = td.playlist_tracks(spark, sf_dir).select("playlist_id", "collection_id", "collection_name").distinct()
    pl = t.select(
        td.mbid("c", F.col("collection_id")).alias("collection_id"), td.mbid("p", F.col("playlist_id")).alias("playlist_id"),
        "collection_name", F.lit(0).alias("collection_order_index"),
        F.date_format(F.lit(_dt.datetime(2024, 1, 1)), "yyyy-MM-dd'T'HH:mm:ss").alias("playlist_create_at"),
        F.concat(F.lit("Songs for "), F.col("collection_name")).alias("description"))
    signed = qu.sign_playlists(pl, _dt.datetime(2024, 5, 18, 12, 30))
    garbled = signed.withColumn("comment", F.when(
        F.substring(F.col("playlist_id"), 1, 1).isin("0", "1", "2", "3", "4"),
        F.concat(F.col("description"), F.lit(qu.SIGNATURE_PREFIX + " ***"))).otherwise(F.col("comment")))
    p = qu.parse_signatures(garbled)
    return p.select("playlist_id", "collection_name",
                    F.col("signature.playlist_id").alias("sig_playlist_id"),
                    F.col("signature.collection_id").alias("sig_collection_id"),
                    F.col("signature.collection_order_index").alias("sig_order_index"),
                    F.col("signature.signed_at").alias("signed_at"))


@register("revisit_release_playlists")
def q_revisit_release_playlists(spark, sf_dir):
    g = grain(spark, sf_dir, REVISIT_AS_OF)
    rr = act.revisit_releases(lc.release_group_listen_counts(g, td.release_groups(spark, sf_dir), REVISIT_AS_OF))
    sampled = col.sample_revisit_releases(rr, count=15)
    files = td.files(spark, sf_dir)
    return col.release_track_playlists(sampled, lib.map_file_release_group(files, name_map(spark, sf_dir)), files)


@register("top_artists_playlists")
def q_top_artists_playlists(spark, sf_dir):
    """Per user: top artists (lifetime history) sampled; per artist a
    playlist seeded from the artist's files (entity-routed lookup)."""
    from cadence.operators.sets import symmetrise as _sym
    from cadence.plans.playlists import _file_counts, playlist_from_files

    files, nm = td.files(spark, sf_dir), name_map(spark, sf_dir)
    ac = lc.artist_listen_counts(grain(spark, sf_dir), td.artists(spark, sf_dir), AS_OF)
    top = col.sample_top_artists(ac, "lifetime", count=15)
    requests = stored(top.select(F.concat_ws(":", "username", "artist_mbid").alias("playlist_id"), "username",
                                 F.col("artist_mbid").alias("mbid"), "artist_name"), "playlist-requests")
    # the universe has a branch for each entity: the payloads are parsed once
    similar = stored(similar_activity(spark, sf_dir).select("entity", "mbid").distinct(), "similar-ids")
    universe = col.mbid_universe(td.listens(spark, sf_dir), files, nm, similar, td.releases(spark, sf_dir), td.feedback(spark, sf_dir))
    sources = col.files_for_mbids(requests.drop("artist_name"), universe, lib.file_maps_long(files, nm))
    fc = _file_counts(spark, sf_dir)
    out = playlist_from_files(files, sources, _sym(td.cf_scores(spark, sf_dir)), fc, limit=20, seed_count=1,
                              recency_fac=0.5)
    desc = requests.select("playlist_id", F.concat(F.lit("Songs like "), F.col("artist_name")).alias("description"))
    return out.join(desc, "playlist_id").withColumn("match_distance", F.round("match_distance", 6))


# --- smart mixes ---------------------------------------------------------------------------


def _smart_mix(spark, sf_dir):
    from cadence.plans import smart_mix as sm
    from cadence.plans.playlists import _file_counts

    files = td.files(spark, sf_dir)
    tracks = sm.clusterable_tracks(_file_counts(spark, sf_dir), _loved(spark, sf_dir), files)
    return sm.smart_mix_clusters(tracks, symmetrise(td.cf_scores(spark, sf_dir)))


@register("smart_mix_clusters")
def q_smart_mix_clusters(spark, sf_dir):
    membership, _ = _smart_mix(spark, sf_dir)
    return membership


@register("smart_mix_playlists")
def q_smart_mix_playlists(spark, sf_dir):
    """The clusters' playlists."""
    from cadence.plans import smart_mix as sm
    from cadence.plans.playlists import _file_counts

    membership, stats = _smart_mix(spark, sf_dir)
    out = sm.smart_mix_playlists(membership, stats, td.files(spark, sf_dir), symmetrise(td.cf_scores(spark, sf_dir)),
                                 _file_counts(spark, sf_dir))
    return out.withColumn("match_distance", F.round("match_distance", 6))


@register("cluster_stats")
def q_cluster_stats(spark, sf_dir):
    _, stats = _smart_mix(spark, sf_dir)
    return round_doubles(stats.drop("label"))


@register("collection_registry")
def q_collection_registry(spark, sf_dir):
    users = td.listens(spark, sf_dir).select("username").distinct()
    return qu.create_collections(users, td.collections(spark, sf_dir)).withColumn(
        "refresh_at_hours_utc", F.array_join(F.transform("refresh_at_hours_utc", lambda h: h.cast("string")), ","))


@register("entity_dump_scan")
def q_entity_dump_scan(spark, sf_dir):
    d, _ = ingest.scan_entity_dump(td.entity_dump_files(spark, sf_dir))
    return d.select("slug", "packet_number", "entity", "mbid", F.size("containers").alias("n_containers"),
                    F.array_join(F.array_sort(F.transform("containers", lambda c: F.concat(c["entity"], F.lit(":"), c["mbid"]))),
                                 ",").alias("containers"))


@register("entity_dump_quarantine")
def q_entity_dump_quarantine(spark, sf_dir):
    """What the dump packets hold besides JSON objects."""
    _, bad = ingest.scan_entity_dump(td.entity_dump_files(spark, sf_dir))
    return bad.groupBy("slug").agg(F.count(F.lit(1)).alias("n_bad"), F.min("bad").alias("bad"))


@register("entity_dump_broken")
def q_entity_dump_broken(spark, sf_dir):
    """Dump files with damaged objects, in ranges that cut through objects:
    what is recovered and how much goes to quarantine, per packet."""
    records, bad = ingest.scan_entity_dump(td.broken_dump_ranges(spark, sf_dir))
    ids = F.array_join(F.sort_array(F.collect_list("mbid")), ",")
    return records.groupBy("slug").agg(F.count(F.lit(1)).alias("n_objects"), F.md5(ids).alias("ids_md5")).join(
        bad.groupBy("slug").agg(F.count(F.lit(1)).alias("n_bad")), "slug")


# --- maintenance: retention, new-or-modified gate, column update, key sets ----------------

RETENTION_CUTOFF = _dt.date(1996, 8, 1)


def _dump_parents(spark, sf_dir):
    """Listen dumps (slug, date, remote modify time)."""
    r = td.dump_records(spark, sf_dir)
    return r.groupBy("slug").agg(F.max("dump_date").alias("dump_date"),
                                 F.count(F.lit(1)).alias("_n")).select(
        "slug", "dump_date",
        (F.col("dump_date").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("_n") % 5).cast("int")))
        .alias("ftp_modify_ts"))


@register("retention_drop")
def q_retention_drop(spark, sf_dir):
    parents, children = mg.retention(_dump_parents(spark, sf_dir), td.dump_records(spark, sf_dir), "slug",
                                     "dump_date", RETENTION_CUTOFF)
    return children.groupBy("slug").agg(F.count(F.lit(1)).alias("n_records"), F.sum("listen_count").alias("listens"))


@register("new_or_modified")
def q_new_or_modified(spark, sf_dir):
    """Remote dumps to (re)load: unknown locally, or modified since stored.
    Known = dumps before 2000; stored modify time is an hour older for
    slugs whose day-of-month is even."""
    remote = _dump_parents(spark, sf_dir)
    known = remote.where(F.col("dump_date") < F.lit(_dt.date(2000, 1, 1))).select(
        "slug", F.when(F.dayofmonth("dump_date") % 2 == 0, F.col("ftp_modify_ts") - F.expr("INTERVAL 1 HOUR"))
        .otherwise(F.col("ftp_modify_ts")).alias("stored_modify_ts"))
    j = remote.join(known, "slug", "left")
    return j.where(F.col("stored_modify_ts").isNull() | (F.col("ftp_modify_ts") > F.col("stored_modify_ts"))).select(
        "slug", "dump_date", "ftp_modify_ts", F.col("stored_modify_ts").isNull().alias("is_new"))


@register("column_update")
def q_column_update(spark, sf_dir):
    """Null out the conditioned embedding of listed files (label 3), keep the rest."""
    emb = td.raw_embeddings(spark, sf_dir)
    listed = td.files(spark, sf_dir).where(F.col("label") == 3).select(
        "filepath", F.lit(None).cast("array<float>").alias("conditioned_embedding"))
    out = mg.update_column(emb, listed, ["filepath"], "conditioned_embedding")
    return out.select("filepath", "success", F.size("conditioned_embedding").alias("conditioned_dims"))


@register("key_set_checks")
def q_key_set_checks(spark, sf_dir):
    """Known artists vs dump artists: intersection and both differences
    (``playlist_sync`` tells whether sets are equal)."""
    from cadence.operators.sets import two_way_difference

    known = td.artists(spark, sf_dir).select("artist_mbid")
    dump = similar_activity(spark, sf_dir).where(F.col("entity") == "artist").select(
        F.col("mbid").alias("artist_mbid")).distinct()
    only_known, only_dump = two_way_difference(known, dump, ["artist_mbid"])
    both = known.intersect(dump)
    return (both.withColumn("side", F.lit("both"))
            .unionByName(only_known.withColumn("side", F.lit("known_only")))
            .unionByName(only_dump.withColumn("side", F.lit("dump_only"))))


@register("first_per_key")
def q_first_per_key(spark, sf_dir):
    """unique_by: the first listen (by time, then id) of every (user, recording)."""
    from pyspark.sql.window import Window as W

    li = td.listens(spark, sf_dir)
    w = W.partitionBy("username", "recording_mbid").orderBy("listen_at_ts_utc", "listen_md5")
    return li.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).select(
        "username", "recording_mbid", "listen_md5", "listen_at_ts_utc")


@register("path_and_flags")
def q_path_and_flags(spark, sf_dir):
    """Relative/absolute library paths and boolean text parsing."""
    f = td.files(spark, sf_dir).select("filepath", "vec_id")
    txt = F.element_at(F.array(F.lit("1"), F.lit("TRUE"), F.lit(" true "), F.lit("0"), F.lit("no")),
                       (F.col("vec_id") % 5 + 1).cast("int"))
    return f.select(
        "filepath",
        S.path_relative("filepath", "lib").alias("relative"),
        S.path_absolute(S.path_relative("filepath", "lib"), "/music").alias("absolute"),
        txt.alias("flag_text"), S.parse_bool_text(txt).alias("flag"))


# --- more payload scans, request grid, not-null / orphan checks -------------------------

SIMILAR_ENTITIES = ["artists", "releases", "recordings"]
SIMILAR_RANGES = ["month", "year", "all_time"]


@register("artist_stats_flatten")
def q_artist_stats_flatten(spark, sf_dir):
    df = ingest.flatten_artist_stats(td.raw_artist_stats(spark, sf_dir))
    return df.withColumn("n_listeners", F.size(F.from_json("listeners", "array<string>"))).drop("listeners")


@register("listen_page_scan")
def q_listen_page_scan(spark, sf_dir):
    return ingest.scan_listen_pages(td.listen_pages(spark, sf_dir))


@register("request_grid")
def q_request_grid(spark, sf_dir):
    """Similar-user requests: every user x entity x time range (by explode)."""
    users = td.listens(spark, sf_dir).select("username").distinct()
    grid = F.array(*[F.struct(F.lit(e).alias("entity"), F.lit(r).alias("time_range"))
                     for e in SIMILAR_ENTITIES for r in SIMILAR_RANGES])
    return users.select("username", F.explode(grid).alias("g")).select("username", "g.entity", "g.time_range")


@register("dq_not_null")
def q_dq_not_null(spark, sf_dir):
    return dq.not_null(td.files(spark, sf_dir), "album_artist_mbid").select("filepath")


@register("dq_orphans")
def q_dq_orphans(spark, sf_dir):
    """File -> artist links whose artist is missing from the artist dimension."""
    fa = lib.map_file_artist(td.files(spark, sf_dir), name_map(spark, sf_dir))
    return dq.orphans(fa, td.artists(spark, sf_dir), ["artist_mbid"])


@register("stream_spike_counts")
def q_stream_spike_counts(spark, sf_dir):
    """Streaming per-listen 24h look-ahead counts, filtered to spikes (>= 5):
    final for the listens whose window the watermark has closed, so far for
    the others."""
    s = stl.next_24h_counts_stream(td.listens_from_events(td.events_stream(spark, sf_dir)), LATENESS)
    read, mark = _drained(spark, s, ["listen_md5"])
    at = F.col("listen_at_ts_utc").cast("timestamp_ntz")
    return read().where(F.col("next_24h_listen_count") >= 5).withColumn("listen_at_ts_utc", at).withColumn(
        "is_closed", at + F.expr("INTERVAL 1 DAY") <= F.lit(mark).cast("timestamp_ntz"))


LOG_NOW = _dt.datetime(2001, 8, 1, 0, 5, 0)
LOG_TIMEOUT_SECONDS = 300


@register("queue_log_gate")
def q_queue_log_gate(spark, sf_dir):
    """Throttled snapshots: a source gets a new queue-log snapshot only when
    its last one is older than the timeout (or it has none)."""
    o = td.table(spark, sf_dir, "orders")
    # logs exist for three of the four sources ('old' was never snapshotted)
    src = F.element_at(F.array(*[F.lit(x) for x in qu.SOURCES[:3]]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    logs = o.select(
        src.alias("source"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") % 900).cast("int"))).alias("as_of_ts_utc"))
    last = logs.groupBy("source").agg(F.max("as_of_ts_utc").alias("last_log_at"))
    srcs = spark.createDataFrame([(s,) for s in qu.SOURCES], "source string")
    return srcs.join(last, "source", "left").select(
        "source", "last_log_at",
        (F.col("last_log_at").isNull()
         | (F.col("last_log_at") < F.lit(LOG_NOW) - F.expr(f"INTERVAL {LOG_TIMEOUT_SECONDS} SECONDS"))).alias("due"))
