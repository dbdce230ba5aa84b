"""Playlist exports: nested JSON documents, M3U8 and XSPF text.

One document per playlist: tracks are collected per playlist (bounded by the
playlist length) and ordered by their order index inside the array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACK_FIELDS = ["filepath", "recording_mbid", "release_mbid", "release_group_mbid", "artist_mbid",
                "album_artist_mbid", "track_length_seconds", "match_distance", "is_seed"]


def _ordered_tracks(tracks: DataFrame, group: str, order: str, fields: list[str]) -> DataFrame:
    t = F.struct(F.col(order).alias("_o"), *[F.col(f) for f in fields])
    return tracks.groupBy(group).agg(F.sort_array(F.collect_list(t)).alias("_t"))


def playlist_json(tracks: DataFrame, group: str = "playlist_id", order: str = "order_index",
                  title: str | None = None, description: str | None = None,
                  fields: list[str] = TRACK_FIELDS) -> DataFrame:
    """(group, json): {"playlist": [...tracks...], "title", "description"};
    NULL fields are dropped."""
    present = [f for f in fields if f in tracks.columns]
    g = _ordered_tracks(tracks, group, order, present)
    items = F.transform("_t", lambda x: F.struct(*[x[f].alias(f) for f in present]))
    doc = [items.alias("playlist")]
    if title:
        doc.append(F.lit(title).alias("title") if title not in tracks.columns else F.col(title))
    if description:
        doc.append(F.concat(F.lit(description), F.col(group)).alias("description"))
    return g.select(group, F.to_json(F.struct(*doc)).alias("json"))


def playlist_m3u8(tracks: DataFrame, group: str = "playlist_id", order: str = "order_index",
                  description: DataFrame | None = None) -> DataFrame:
    """#EXTM3U, optional #PLAYLIST:<description>, then '#EXTINF:<secs>,' and
    the path for every track."""
    g = _ordered_tracks(tracks, group, order, ["filepath", "track_length_seconds"])
    lines = F.flatten(F.transform("_t", lambda x: F.array(
        F.concat(F.lit("#EXTINF:"), F.coalesce(x["track_length_seconds"], F.lit(0)).cast("string"), F.lit(",")),
        x["filepath"])))
    if description is not None:
        g = g.join(description, group, "left")
        head = F.when(F.col("description").isNotNull(),
                      F.array(F.lit("#EXTM3U"), F.concat(F.lit("#PLAYLIST:"), F.col("description")))
                      ).otherwise(F.array(F.lit("#EXTM3U")))
    else:
        head = F.array(F.lit("#EXTM3U"))
    return g.select(group, F.array_join(F.concat(head, lines), "\n").alias("m3u8"))


def _xml_escape(c):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def playlist_xspf(tracks: DataFrame, group: str = "playlist_id", order: str = "order_index",
                  creator: str = "cadence", description: DataFrame | None = None) -> DataFrame:
    """XSPF document per playlist; durations in milliseconds. ``description``
    (group, description) becomes the annotation."""
    g = _ordered_tracks(tracks, group, order, ["filepath", "track_length_seconds"])
    note = F.lit("")
    if description is not None:
        g = g.join(description.select(group, "description"), group, "left")
        note = F.coalesce(F.concat(F.lit("<annotation>"), _xml_escape(F.col("description")), F.lit("</annotation>")), F.lit(""))
    track_xml = F.transform("_t", lambda x: F.concat(
        F.lit("<track><location>"), _xml_escape(x["filepath"]), F.lit("</location>"),
        F.when(x["track_length_seconds"].isNotNull() & (x["track_length_seconds"] != 0),
               F.concat(F.lit("<duration>"), (x["track_length_seconds"] * 1000).cast("string"), F.lit("</duration>"))
               ).otherwise(F.lit("")),
        F.lit("</track>")))
    return g.select(group, F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><playlist version="1" xmlns="http://xspf.org/ns/0/">'),
        F.lit(f"<creator>{creator}</creator>"), note, F.lit("<trackList>"), F.array_join(track_xml, ""),
        F.lit("</trackList></playlist>")).alias("xspf"))
