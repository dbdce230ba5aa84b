"""Dimensions, maps and dependents read from annotation payloads.

An annotation is (mbid, entity, payload_json, ts_utc); the payload is
``{"_success": ..., "_args": {"entity": ...}, "data": {<entity>: {...}}}``.
Everything is a projection of one row: lists inside a payload are taken apart
with array functions, so the only shuffle is the distinct of one map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.scalars import extract_year, json_get, json_sub, timeline, try_cast_uuid, try_uuid

P = "payload_json"
IDS = "array<struct<id:string,date:string>>"
TAGS = "array<struct<name:string,count:string>>"
CREDITS = "array<struct<artist:struct<id:string>>>"


def of_entity(annotations: DataFrame, entity: str) -> DataFrame:
    """Successful annotations of one entity."""
    return annotations.where((F.col("entity") == entity) & (json_get(P, "$._success") == "true"))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def flatten_artists(annotations: DataFrame) -> DataFrame:
    """Artists with the span of their dated releases and their tags, the most
    used first (equal counts: by name)."""
    at = "$.data.artist."
    years = F.filter(
        F.transform(F.from_json(json_sub(P, at + "release-list"), IDS), lambda r: extract_year(r["date"])), lambda y: y.isNotNull())
    tags = F.transform(
        F.from_json(json_sub(P, at + "tag-list"), TAGS),
        lambda t: F.struct((-_int(t["count"])).alias("o"), F.nullif(F.trim(t["name"]), F.lit("")).alias("name")))
    rows = of_entity(annotations, "artist").select(
        F.col("mbid").alias("artist_mbid"),
        json_get(P, at + "name").alias("artist_name"),
        json_get(P, at + "type").alias("artist_type"),
        json_get(P, at + "disambiguation").alias("disambiguation"),
        *[json_sub(P, at + path).alias(path.replace("-", "_")) for path in
          ("alias-list", "url-relation-list", "artist-relation-list", "release-list", "tag-list")],
        _int(json_get(P, at + "release-count")).alias("release_count"),
        F.array_min(years).alias("earliest_release_year"),
        F.array_max(years).alias("latest_release_year"),
        F.nullif(F.array_join(F.transform(F.array_sort(tags), lambda t: t["name"]), ", "), F.lit("")).alias("tags_string"),
        F.col("ts_utc").alias("_ingest_insert_ts_utc"),
    )
    return rows.withColumn("active_years", timeline("earliest_release_year", "latest_release_year"))


def artist_dimension(facts: DataFrame, key: str) -> DataFrame:
    """Artists by ``key`` from one row per tag and release date (``tag``,
    ``release_date``): their tags, the most frequent first (equal counts: by
    name), and the span of their dated releases."""
    tags = (
        facts.groupBy(key, "tag").agg(F.count(F.lit(1)).alias("c"))
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("o"), F.col("tag")))).alias("t"))
        .select(key, F.array_join(F.transform("t", lambda x: x["tag"]), ", ").alias("tags_string"))
    )
    year = extract_year("release_date")
    base = facts.groupBy(key).agg(F.min(year).alias("_y0"), F.max(year).alias("_y1"))
    return base.join(tags, key, "left").select(key, "tags_string", timeline("_y0", "_y1").alias("active_years"))


def flatten_recordings(annotations: DataFrame) -> DataFrame:
    at = "$.data.recording."
    return of_entity(annotations, "recording").select(
        F.col("mbid").alias("recording_mbid"),
        json_get(P, at + "title").alias("recording_title"),
        _int(json_get(P, at + "length")).alias("recording_length_ms"),
        json_sub(P, at + "tag-list").alias("tag_list"),
        json_sub(P, at + "release-list").alias("release_list"),
        json_sub(P, at + "artist-credit").alias("artist_credit_list"),
        json_get(P, at + "artist-credit-phrase").alias("artist_credit_phrase"),
        F.col("ts_utc").alias("_ingest_insert_ts_utc"),
    )


def flatten_releases(annotations: DataFrame) -> DataFrame:
    at = "$.data.release."
    return of_entity(annotations, "release").select(
        F.col("mbid").alias("release_mbid"),
        json_get(P, at + "title").alias("release_title"),
        try_cast_uuid(json_get(P, at + "release-group.id")).alias("release_group_mbid"),
        extract_year(json_get(P, at + "date")).alias("release_year"),
        json_sub(P, at + "artist-credit").alias("artist_credit_list"),
        json_sub(P, at + "label-info-list").alias("label_info_list"),
        json_sub(P, at + "url-relation-list").alias("url_relation_list"),
        json_get(P, at + "artist-credit-phrase").alias("artist_credit_phrase"),
        F.col("ts_utc").alias("_ingest_insert_ts_utc"),
    )


def flatten_release_groups(annotations: DataFrame) -> DataFrame:
    at = "$.data.release-group."
    first = json_get(P, at + "first-release-date")
    return of_entity(annotations, "release-group").select(
        F.col("mbid").alias("release_group_mbid"),
        json_get(P, at + "title").alias("release_group_title"),
        json_get(P, at + "release-count").alias("release_count"),
        extract_year(first).alias("release_group_year"),
        first.alias("first_release_date"),
        json_get(P, at + "type").alias("release_group_type"),
        json_get(P, at + "primary-type").alias("release_group_primary_type"),
        json_sub(P, at + "artist-credit").alias("artist_credit_list"),
        json_sub(P, at + "tag-list").alias("tag_list"),
        json_sub(P, at + "url-relation-list").alias("url_relation_list"),
        json_get(P, at + "artist-credit-phrase").alias("artist_credit_phrase"),
        F.col("ts_utc").alias("_ingest_insert_ts_utc"),
    )


def map_recording_release(recordings: DataFrame) -> DataFrame:
    """A row per release in a recording's release list (a malformed id: NULL)."""
    each = recordings.select("recording_mbid", F.explode(F.from_json("release_list", IDS)).alias("r"))
    return each.select("recording_mbid", try_cast_uuid(F.col("r.id")).alias("release_mbid"))


def map_release_group_artist(release_groups: DataFrame) -> DataFrame:
    """Credited artists of release groups, each once."""
    each = release_groups.select("release_group_mbid", F.explode(F.from_json("artist_credit_list", CREDITS)).alias("c"))
    return each.select("release_group_mbid", try_cast_uuid(F.col("c.artist.id")).alias("artist_mbid")).where(
        F.col("artist_mbid").isNotNull()).distinct()


def dependents(annotations: DataFrame) -> DataFrame:
    """(src, dst, dst_entity): what successful payloads name as dependent:
    releases of an artist, the release group of a release. The entity is the
    one the payload was asked for (``_args``)."""
    asked = json_get(P, "$._args.entity")
    releases = F.transform(
        F.from_json(json_sub(P, "$.data.artist.release-list"), IDS),
        lambda r: F.struct(try_uuid(r["id"]).alias("dst"), F.lit("release").alias("dst_entity")))
    group = json_get(P, "$.data.release.release-group.id")
    groups = F.when(group.isNotNull(), F.array(F.struct(try_uuid(group).alias("dst"), F.lit("release-group").alias("dst_entity"))))
    found = F.when(asked == "artist", releases).when(asked == "release", groups)
    return (
        annotations.where(json_get(P, "$._success") == "true")
        .select(F.col("mbid").alias("src"), F.explode(found).alias("d"))
        .select("src", "d.dst", "d.dst_entity").where(F.col("dst").isNotNull()).distinct()
    )
