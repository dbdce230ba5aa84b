"""Library models: name-lookup flatten and file <-> entity maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.functions.scalars import json_get, try_cast_uuid
from cadence.operators.sets import union_distinct


def name_map(raw: DataFrame) -> DataFrame:
    """Successful lookups only; ids strictly uuid-cast (bad ids -> NULL)."""
    p = F.col("payload_json")
    return raw.where(F.col("success")).select(
        "recording_md5",
        "recording_name",
        "release_name",
        "artist_name",
        F.from_json(F.get_json_object(p, "$.artist_mbids"), "array<string>").alias("artist_mbids"),
        try_cast_uuid(json_get(p, "$.recording_mbid")).alias("recording_mbid"),
        try_cast_uuid(json_get(p, "$.release_mbid")).alias("release_mbid"),
        try_cast_uuid(json_get(p, "$.metadata.release.release_group_mbid")).alias("release_group_mbid"),
        json_get(p, "$.release_name").alias("mapped_release_name"),
        json_get(p, "$.recording_name").alias("mapped_recording_name"),
        json_get(p, "$.artist_credit_name").alias("mapped_artist_name"),
    )


def _lookup(files: DataFrame, nm: DataFrame, col: str) -> DataFrame:
    return (
        files.select("filepath", "recording_md5")
        .join(nm.select("recording_md5", col), "recording_md5")
        .where(F.col(col).isNotNull())
        .select("filepath", col)
    )


def map_file_recording(files: DataFrame, nm: DataFrame) -> DataFrame:
    return union_distinct(
        [
            _lookup(files, nm, "recording_mbid"),
            files.where(F.col("recording_mbid").isNotNull()).select("filepath", "recording_mbid"),
        ]
    )


def map_file_release(files: DataFrame, nm: DataFrame) -> DataFrame:
    return union_distinct(
        [
            _lookup(files, nm, "release_mbid"),
            files.where(F.col("release_mbid").isNotNull()).select("filepath", "release_mbid"),
        ]
    )


def map_file_release_group(files: DataFrame, nm: DataFrame) -> DataFrame:
    return union_distinct(
        [
            _lookup(files, nm, "release_group_mbid"),
            files.where(F.col("release_group_mbid").isNotNull()).select("filepath", "release_group_mbid"),
        ]
    )


def map_file_artist(files: DataFrame, nm: DataFrame) -> DataFrame:
    looked_up = (
        files.select("filepath", "recording_md5")
        .join(nm.select("recording_md5", "artist_mbids"), "recording_md5")
        .where(F.size("artist_mbids") > 0)
        .select("filepath", F.explode("artist_mbids").alias("artist_mbid"))
    )
    return union_distinct(
        [
            looked_up,
            files.where(F.col("artist_mbid").isNotNull()).select("filepath", "artist_mbid"),
            files.where(F.col("album_artist_mbid").isNotNull()).select(
                "filepath", F.col("album_artist_mbid").alias("artist_mbid")
            ),
        ]
    )


def file_maps_long(files: DataFrame, nm: DataFrame) -> DataFrame:
    """All four maps as (entity, filepath, mbid)."""
    parts = [
        ("recording", map_file_recording(files, nm), "recording_mbid"),
        ("release", map_file_release(files, nm), "release_mbid"),
        ("release-group", map_file_release_group(files, nm), "release_group_mbid"),
        ("artist", map_file_artist(files, nm), "artist_mbid"),
    ]
    out = None
    for ent, df, col in parts:
        d = df.select(F.lit(ent).alias("entity"), "filepath", F.col(col).alias("mbid"))
        out = d if out is None else out.unionByName(d)
    return out


# --- local files view ---------------------------------------------------------------

from cadence.functions.scalars import extract_year  # noqa: E402


# The tag names under which files carry an attribute; the first
# one with a value counts.
TAG_NAMES = {
    "album": ["album"],
    "title": ["title"],
    "artist": ["artist"],
    "tracknumber": ["tracknumber"],
    "discnumber": ["discnumber"],
    "genre": ["genre"],
    "date": ["date", "originalyear", "year", "origyear"],
    "album_artist": ["albumartist", "album artist"],
    "musicbrainz_trackid": ["musicbrainz_trackid"],
    "musicbrainz_artistid": ["musicbrainz_artistid"],
    "musicbrainz_albumid": ["musicbrainz_albumid"],
    "musicbrainz_albumartistid": ["musicbrainz_albumartistid"],
    "musicbrainz_discid": ["musicbrainz_discid"],
    "musicbrainz_albumstatus": ["musicbrainz_albumstatus"],
    "musicbrainz_albumtype": ["musicbrainz_albumtype"],
    "musicbrainz_releasetrackid": ["musicbrainz_releasetrackid"],
    "musicbrainz_releasegroupid": ["musicbrainz_releasegroupid"],
}


def file_tags(raw: DataFrame) -> DataFrame:
    """Files with raw tags (``tags_json``: a list of values per tag name) ->
    one column per attribute: of its tag names, the first value of the first
    one that has any text there; else NULL."""
    others = [c for c in raw.columns if c != "tags_json"]
    tags = raw.select(*others, F.from_json("tags_json", "map<string,array<string>>").alias("_tags"))
    first = lambda name: F.nullif(F.get(F.try_element_at("_tags", F.lit(name)), F.lit(0)), F.lit(""))
    return tags.select(*others, *[F.coalesce(*[first(n) for n in names]).alias(a) for a, names in TAG_NAMES.items()])


def local_files_metadata(raw: DataFrame) -> DataFrame:
    j = F.col("json_data")
    return raw.select(
        "filepath",
        "recording_md5",
        F.least("file_created_at", "file_modified_at").alias("file_created_at"),
        json_get(j, "$.title").alias("track_name"),
        json_get(j, "$.album").alias("album_name"),
        json_get(j, "$.artist").alias("artist_name"),
        json_get(j, "$.album_artist").alias("album_artist_name"),
        json_get(j, "$.date").alias("track_date"),
        json_get(j, "$.length").cast("double").alias("track_length_seconds"),
        try_cast_uuid(json_get(j, "$.musicbrainz_trackid")).alias("recording_mbid"),
        try_cast_uuid(json_get(j, "$.musicbrainz_albumid")).alias("release_mbid"),
        try_cast_uuid(json_get(j, "$.musicbrainz_releasegroupid")).alias("release_group_mbid"),
        try_cast_uuid(json_get(j, "$.musicbrainz_artistid")).alias("artist_mbid"),
        try_cast_uuid(json_get(j, "$.musicbrainz_albumartistid")).alias("album_artist_mbid"),
    )


def local_files_embedding(raw: DataFrame) -> DataFrame:
    """Embedding runs usable downstream: conditioned, or failed (a success
    without a conditioned embedding is still waiting for the model)."""
    return raw.where(F.col("conditioned_embedding").isNotNull() | (F.col("success") == F.lit(False)))


def local_files(raw_meta: DataFrame, raw_emb: DataFrame, births: DataFrame) -> DataFrame:
    """Files with metadata, their usable embedding run and the earliest known
    creation time (NULL-skipping least of birth and created)."""
    m = local_files_metadata(raw_meta).withColumn("track_year", extract_year("track_date"))
    e = local_files_embedding(raw_emb).select(
        "filepath", F.col("success").alias("embedding_success"),
        F.col("duration_seconds").alias("embedding_duration_seconds"),
        F.col("conditioned_embedding").alias("embedding"))
    return (
        m.join(e, "filepath", "left")
        .join(births.select("filepath", "birth_at"), "filepath", "left")
        .withColumn("file_created_at", F.least("birth_at", "file_created_at"))
        .drop("birth_at")
    )
