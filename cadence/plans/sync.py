"""Stored playlists and feedback: views, replacement, and what is out of step
with the media server."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.plans import ingest
from cadence.plans import library as lib
from cadence.plans import queue as qu
from cadence.plans.registry import register
from cadence.sources import testdata as td

COLLECTION_COLUMNS = ["collection_id", "collection_name", "username", "refresh_at_hours_utc", "create_at_utc", "refreshed_at_utc"]
PLAYLIST_COLUMNS = ["playlist_id", "collection_id", "collection_order_index", "title", "description", "create_at_utc"]
TRACK_COLUMNS = ["track_id", "playlist_id", "track_order_index", "filepath", "recording_mbid", "release_mbid", "release_group_mbid",
                 "artist_mbid", "album_artist_mbid", "track_length_seconds", "match_distance", "is_seed"]


def collections_view(stored: DataFrame) -> DataFrame:
    return stored.select(*COLLECTION_COLUMNS)


def playlists_view(stored: DataFrame) -> DataFrame:
    return stored.select(*PLAYLIST_COLUMNS)


def tracks_view(stored: DataFrame) -> DataFrame:
    return stored.select(*TRACK_COLUMNS)


def feedback_view(feedback: DataFrame) -> DataFrame:
    """Typed feedback as the models read it; its time of landing is ``insert_ts_utc``."""
    return feedback.select("feedback_md5", "username", "score", "recording_mbid", "feedback_at",
                           F.col("insert_ts_utc").alias("_ingest_insert_ts_utc"))


def collections_in_sync(stored: DataFrame, server: DataFrame) -> DataFrame:
    """(collection_name, n_stored, n_server, n_both, in_sync): whether the
    playlist ids of a collection are the same set on both sides. Both frames
    hold (collection_name, playlist_id); ids may repeat."""
    key = ["collection_name", "playlist_id"]
    here = stored.select(*key, F.lit(1).alias("here"), F.lit(0).alias("there"))
    there = server.select(*key, F.lit(0).alias("here"), F.lit(1).alias("there"))
    ids = here.unionByName(there).groupBy(*key).agg(F.max("here").alias("here"), F.max("there").alias("there"))
    return ids.groupBy("collection_name").agg(
        F.sum("here").alias("n_stored"), F.sum("there").alias("n_server"), F.sum(F.col("here") * F.col("there")).alias("n_both"),
        F.min((F.col("here") == F.col("there"))).alias("in_sync"))


NOW = dt.datetime(2024, 5, 18, 12, 0, 0)
LANDED = dt.datetime(2024, 2, 1)


@register("feedback_scan")
def q_feedback_scan(spark, sf_dir):
    """Feedback pages, one row per loved recording of a user."""
    rows, _ = ingest.scan_feedback_pages(td.feedback_pages(spark, sf_dir))
    return feedback_view(rows.withColumn("insert_ts_utc", F.lit(LANDED).cast("timestamp_ntz")))


@register("tag_aliases")
def q_tag_aliases(spark, sf_dir):
    """File tags under the names of the library."""
    return lib.file_tags(td.raw_tags(spark, sf_dir)).select("filepath", "title", "album", "artist", "album_artist", "date", "genre")


@register("dump_timestamps")
def q_dump_timestamps(spark, sf_dir):
    return ingest.dump_file_info(td.dump_timestamp_files(spark, sf_dir))


def _tracks(spark, sf_dir):
    """Stored tracks with their position in the playlist."""
    from cadence.operators.ranking import number_rows

    return number_rows(td.playlist_tracks(spark, sf_dir), "playlist_id", [F.col("filepath")], "track_order_index")


@register("playlist_views")
def q_playlist_views(spark, sf_dir):
    """Collections, playlists and tracks, joined by their ids."""
    collections, playlists, tracks = td.stored_playlists(spark, sf_dir, _tracks(spark, sf_dir))
    c = collections_view(collections).select("collection_id", "collection_name", "username")
    p = playlists_view(playlists).select("playlist_id", "collection_id", "collection_order_index", "title")
    t = tracks_view(tracks).select("track_id", "playlist_id", "track_order_index", "filepath", "artist_mbid", "is_seed")
    return t.join(p, "playlist_id").join(c, "collection_id")


@register("playlist_replace")
def q_playlist_replace(spark, sf_dir):
    """New playlists take the place of the stale collections' stored ones."""
    old = _tracks(spark, sf_dir).select("username", "collection_name", "playlist_id", "track_order_index", "filepath")
    fresh = F.col("collection_name") == "smart-mix"
    collections = old.select("username", "collection_name").distinct().withColumns({
        "refresh_at_hours_utc": F.array(F.lit(6), F.lit(18)),
        "refreshed_at_utc": F.lit(NOW).cast("timestamp_ntz") - F.when(fresh, F.expr("INTERVAL 2 HOURS")).otherwise(F.expr("INTERVAL 9 HOURS"))})
    new = old.where(F.col("track_order_index") % 3 == 0).withColumns({
        "track_order_index": F.floor(F.col("track_order_index") / 3).cast("int"), "playlist_id": F.concat("playlist_id", F.lit("/new"))})
    tracks, stamped = qu.replace_playlists(old, new, collections, NOW)
    return tracks.join(stamped.select("username", "collection_name", "refreshed_at_utc"), ["username", "collection_name"])


@register("playlist_sync")
def q_playlist_sync(spark, sf_dir):
    """Which collections hold the same playlists here and on the server. There,
    playlist n = 13 is missing and collection 2 has one more."""
    stored = td.playlist_tracks(spark, sf_dir).select("collection_name", "playlist_id")
    more = stored.where("collection_name = 'loved-tracks'").withColumn("playlist_id", F.lit("pl99"))
    return collections_in_sync(stored, stored.where("playlist_id <> 'pl13'").unionByName(more))


@register("loves_diff_starred")
def q_loves_diff_starred(spark, sf_dir):
    """Loved tracks against the stars of the media server."""
    from cadence.plans.models import _loved

    return qu.loves_diff(_loved(spark, sf_dir), td.starred(spark, sf_dir))


@register("cf_symmetrise_pairs")
def q_cf_symmetrise_pairs(spark, sf_dir):
    from cadence.operators.sets import symmetrise
    from cadence.plans.common import round_doubles

    return round_doubles(symmetrise(td.cf_pairs(spark, sf_dir)))


@register("cf_baseline_pairs")
def q_cf_baseline_pairs(spark, sf_dir):
    from cadence.operators.sets import symmetrise
    from cadence.operators.stats import cf_baseline
    from cadence.plans.common import round_doubles

    return round_doubles(cf_baseline(symmetrise(td.cf_pairs(spark, sf_dir))))


@register("cf_calibration_pairs")
def q_cf_calibration_pairs(spark, sf_dir):
    from cadence.operators.sets import symmetrise
    from cadence.operators.stats import cf_calibration_grid
    from cadence.plans.common import round_doubles

    return round_doubles(cf_calibration_grid(symmetrise(td.cf_pairs(spark, sf_dir))))
