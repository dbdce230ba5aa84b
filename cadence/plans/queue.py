"""Annotation refresh queue and related maintenance models."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.functions.scalars import micros
from cadence.operators.priority import priority_merge
from cadence.session import checkpoint_dir

ENTITIES = ["artist", "release", "release-group", "recording"]
SOURCES = ["new", "http_fail", "updated", "old"]
UPDATE_BUFFER_MINUTES = 20

_SUCCESS = "coalesce(try_cast(get_json_object(payload_json, '$._success') as boolean), true)"


def unannotated(mbids: DataFrame, ann: DataFrame) -> DataFrame:
    return mbids.where(F.col("entity").isin(ENTITIES)).join(ann.select("mbid"), "mbid", "left_anti")


def http_failures(ann: DataFrame) -> DataFrame:
    """Failed annotations without an HTTP status (or status=None)."""
    err = F.coalesce(F.get_json_object("payload_json", "$.error"), F.lit(""))
    return ann.where(
        ~F.expr(_SUCCESS)
        & F.col("entity").isin(ENTITIES)
        & (~err.like("%status=%") | err.like("%status=None%"))
    ).select("mbid", "entity")


def last_updates(records: DataFrame) -> DataFrame:
    """Latest dump time per (entity, mbid) of records and their containers."""
    rec = records.where(F.col("dump_entity").isin(ENTITIES)).select(
        F.col("dump_entity").alias("entity"), "mbid", F.col("dump_timestamp").alias("ts"))
    cont = records.where(F.col("dump_entity").isin(ENTITIES)).select(
        F.explode(F.from_json(F.get_json_object("json_data", "$.containers"),
                              "array<struct<mbid:string,entity:string>>")).alias("c"),
        F.col("dump_timestamp").alias("ts"),
    ).where(F.col("c.mbid").isNotNull() & F.col("c.entity").isNotNull() & F.col("c.entity").isin(ENTITIES)).select(
        F.col("c.entity").alias("entity"), F.col("c.mbid").alias("mbid"), "ts")
    return rec.unionByName(cont).groupBy("entity", "mbid").agg(F.max("ts").alias("ts"))


def updated_entities(ann: DataFrame, records: DataFrame) -> DataFrame:
    """Annotations older than the entity's last dump update (+ buffer)."""
    lu = last_updates(records)
    return ann.join(lu, ["entity", "mbid"]).where(
        F.col("ts_utc") < F.col("ts") + F.expr(f"INTERVAL {UPDATE_BUFFER_MINUTES} MINUTES")
    ).select("mbid", "entity")


def old_annotations(mbids: DataFrame, ann: DataFrame, before: dt.datetime) -> DataFrame:
    return mbids.where(F.col("entity").isin(ENTITIES)).join(
        ann.select("mbid", "ts_utc"), "mbid").where(F.col("ts_utc") < F.lit(before)).select("mbid", "entity", "ts_utc")


def refresh_queue(mbids, ann, records, before, limit: int | None = 200) -> DataFrame:
    """new -> http failures -> updated -> old, first list wins, up to
    ``limit``. Within a list: md5 order; old annotations oldest first."""
    by_hash = F.md5("mbid")
    lists = [
        ("new", unannotated(mbids, ann).select("mbid", "entity"), by_hash),
        ("http_fail", http_failures(ann), by_hash),
        ("updated", updated_entities(ann, records), by_hash),
        ("old", old_annotations(mbids, ann, before), F.format_string("%020d", micros("ts_utc"))),
    ]
    q = priority_merge([(n, d.select("mbid", "entity", o.alias("_o")), F.col("_o")) for n, d, o in lists],
                       "mbid", limit)
    return q.select("mbid", "entity", "source", F.col("_prio").alias("priority"))


def queue_log(mbids, ann, records, before) -> DataFrame:
    """Queue size per source x entity (zero-filled)."""
    lists = {
        "new": unannotated(mbids, ann),
        "http_fail": http_failures(ann),
        "updated": updated_entities(ann, records),
        "old": old_annotations(mbids, ann, before).select("mbid", "entity"),
    }
    counts = None
    for s, d in lists.items():
        c = d.groupBy("entity").agg(F.count(F.lit(1)).alias("queue_size")).withColumn("source", F.lit(s))
        counts = c if counts is None else counts.unionByName(c)
    spark = mbids.sparkSession
    grid = spark.createDataFrame([(s, e) for s in SOURCES for e in ENTITIES], "source string, entity string")
    return grid.join(counts, ["source", "entity"], "left").select(
        "source", "entity", F.coalesce("queue_size", F.lit(0)).cast("long").alias("queue_size"))


def drop_dangling(ann: DataFrame, mbids: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Annotations left after deleting failed ones whose id left the
    universe and that are older than a month."""
    victims = ann.join(mbids.select("mbid"), "mbid", "left_anti").where(
        ~F.expr(_SUCCESS) & (F.col("ts_utc") < F.lit(as_of) - F.expr("INTERVAL 1 MONTH")))
    return ann.join(victims.select("mbid"), "mbid", "left_anti")


#: Rows of a round's ids that are broadcast to look them up among the known.
MAX_BROADCAST_IDS = 1_000_000


def dependents_closure(seeds: DataFrame, edges: DataFrame, annotated: DataFrame,
                       max_broadcast_ids: int = MAX_BROADCAST_IDS) -> DataFrame:
    """Breadth-first expansion: dependents of the seeds that are not yet
    annotated, then their dependents, ... until no new ids appear.

    Each round writes its own ids to the shared checkpoint folder and nothing
    else: the known ids are the annotated ones and the rounds so far, read side
    by side. A round's ids are looked up among them (broadcast while they are
    few, so that the known ones stay where they are)."""
    spark = seeds.sparkSession
    checkpoint_dir(spark)
    found: list[DataFrame] = []
    frontier = seeds.select("mbid")
    for depth in count(1):
        reached = (
            frontier.join(edges, frontier["mbid"] == edges["src"])
            .select(F.col("dst").alias("mbid"), F.col("dst_entity").alias("entity"))
            .distinct().checkpoint()
        )
        n = reached.count()
        if n == 0:
            break
        asked = reached.select("mbid").distinct()
        asked = F.broadcast(asked) if n <= max_broadcast_ids else asked
        known = [annotated.select("mbid"), seeds.select("mbid"), *[r.select("mbid") for r in found]]
        known = reduce(DataFrame.unionByName, [k.join(asked, "mbid", "left_semi") for k in known])
        new = reached.join(known.distinct(), "mbid", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if new.isEmpty():
            break
        found.append(new)
        frontier = new.select("mbid")
    if not found:
        return spark.createDataFrame([], "mbid string, entity string, depth int")
    return reduce(DataFrame.unionByName, found)


def gap_packets(dumps: DataFrame, latest: int, entities: list[str], backfill: int = 7 * 24 + 1) -> DataFrame:
    """Packets to fetch per entity: last known + 1 .. latest; the latest
    ``backfill`` packets when none is known."""
    spark = dumps.sparkSession
    ents = spark.createDataFrame([(e,) for e in entities], "entity string")
    last = dumps.groupBy("entity").agg(F.max("packet_number").alias("last"))
    start = F.coalesce(F.col("last"), F.lit(latest - backfill)) + 1
    return ents.join(last, "entity", "left").where(start <= latest).select(
        "entity", F.explode(F.sequence(start.cast("long"), F.lit(latest).cast("long"))).alias("packet_number"))


def inbox(births: DataFrame, mark: dt.datetime) -> tuple[DataFrame, object]:
    """Files born after the high-water mark, and the new mark."""
    new = births.where(F.col("birth_at") > F.lit(mark))
    return new, new.agg(F.max("birth_at")).first()[0] or mark


def last_refresh_target(hours, now: dt.datetime):
    """Latest of {today, yesterday} x hours that is <= now (NULL without
    hours). Hours outside 0..23 do not count."""
    hours = F.filter(hours, lambda h: h.between(0, 23))
    today = F.lit(dt.datetime(now.year, now.month, now.day))
    cands = F.concat(
        F.transform(hours, lambda h: today + F.make_dt_interval(hours=h)),
        F.transform(hours, lambda h: today - F.expr("INTERVAL 1 DAY") + F.make_dt_interval(hours=h)),
    )
    return F.array_max(F.filter(cands, lambda t: t <= F.lit(now)))


def stale_collections(coll: DataFrame, now: dt.datetime) -> DataFrame:
    target = last_refresh_target(F.col("refresh_at_hours_utc"), now)
    return coll.select(
        "collection_name", "username", target.cast("timestamp_ntz").alias("refresh_target"),
        (F.col("refreshed_at_utc").isNull() | (F.size("refresh_at_hours_utc") == 0)
         | (F.col("refreshed_at_utc") < target)).alias("is_stale"),
    )


def exclude_by_patterns(paths: DataFrame, patterns: DataFrame, per_regex: int = 500) -> DataFrame:
    """Drop paths matched at their start by any rule. Rules are configuration;
    they are OR-ed into anchored regexes of ``per_regex`` rules each, which
    are evaluated in the scan, so no join is needed."""
    rules = [r[0] for r in patterns.where(F.col(patterns.columns[0]).isNotNull()).toLocalIterator()]
    for at in range(0, len(rules), per_regex):
        rx = "^(?:" + "|".join(f"(?:{p})" for p in rules[at:at + per_regex]) + ")"
        paths = paths.where(~F.col("filepath").rlike(rx))
    return paths


def new_recordings(files: DataFrame, raw_name_map: DataFrame, max_len: int = 245) -> DataFrame:
    """Library name triples never looked up (work list for the name lookup)."""
    base = files.where(
        F.col("recording_md5").isNotNull()
        & (F.length(F.concat_ws("", "artist_name", "track_name", "album_name")) < max_len)
    ).select("recording_md5", F.col("track_name").alias("recording_name"),
             F.col("album_name").alias("release_name"), "artist_name").distinct()
    return base.join(raw_name_map.select("recording_md5"), "recording_md5", "left_anti")


def loves_diff(loved: DataFrame, starred: DataFrame) -> DataFrame:
    """Two-way difference: loved here but not starred there ('to_star'),
    starred there but not loved here ('to_submit')."""
    k = ["username", "filepath"]
    a = loved.select(*k).distinct()
    b = starred.select(*k).distinct()
    return a.join(b, k, "left_anti").withColumn("direction", F.lit("to_star")).unionByName(
        b.join(a, k, "left_anti").withColumn("direction", F.lit("to_submit")))


def playlist_file_counts(tracks: DataFrame, files: DataFrame,
                         excluded=("loved-tracks", "revisit-tracks", "revisit-releases")) -> DataFrame:
    """Files in more than one playlist of a user (outside excluded collections)."""
    agg = (
        tracks.where(~F.col("collection_name").isin(*excluded))
        .groupBy("username", "filepath")
        .agg(F.count_distinct("playlist_id").alias("playlist_count"),
             F.array_join(F.sort_array(F.collect_set("collection_name")), ",").alias("collection_names"))
        .where(F.col("playlist_count") > 1)
    )
    return agg.join(files.select("filepath", "track_name", "album_name", "artist_name", "album_artist_name"),
                    "filepath").select("username", "filepath", "track_name", "album_name", "artist_name",
                                       "album_artist_name", "playlist_count", "collection_names")


def media_catalogue(files: DataFrame) -> DataFrame:
    """Media-server ids: (item_type, key, item_id) for files (by path), artists
    and albums (by catalogue id)."""
    def ids(kind, key):
        return files.where(F.col(key).isNotNull()).select(
            F.lit(kind).alias("item_type"), F.col(key).alias("key")).distinct()

    media = files.select(F.lit("media_file").alias("item_type"), F.col("filepath").alias("key"))
    parts = [media, ids("artist", "artist_mbid"), ids("artist", "album_artist_mbid"), ids("album", "release_mbid")]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.distinct().withColumn("item_id", F.md5(F.concat_ws(":", "item_type", "key")))


def play_count_export(file_rollup: DataFrame, artist_counts: DataFrame, release_counts: DataFrame,
                      catalogue: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Play counts for the media server: files (rounded fractional counts,
    last listen), artists and albums (lifetime counts per user, last listen
    date = as_of - recency days); ids resolved by join, misses skipped."""
    day = F.lit(as_of.date())
    files = file_rollup.select(
        F.lit(None).cast("string").alias("username"), F.lit("media_file").alias("item_type"),
        F.col("filepath").alias("key"), F.col("listen_count").cast("long").alias("play_count"),
        F.to_date("last_listen").alias("play_date"))
    arts = artist_counts.select(
        "username", F.lit("artist").alias("item_type"), F.col("artist_mbid").alias("key"),
        F.col("lifetime_listen_count").alias("play_count"),
        F.date_sub(day, F.col("listen_recency_days").cast("int")).alias("play_date"))
    albs = release_counts.select(
        "username", F.lit("album").alias("item_type"), F.col("release_mbid").alias("key"),
        F.col("lifetime_listen_count").alias("play_count"),
        F.date_sub(day, F.col("listen_recency_days").cast("int")).alias("play_date"))
    return files.unionByName(arts).unionByName(albs).join(catalogue, ["item_type", "key"]).select(
        "username", "item_type", "item_id", "play_count", "play_date")


SIGNATURE_PREFIX = " --- signed playlist:"
SIGNATURE_SCHEMA = ("collection_id string, playlist_id string, collection_name string, "
                    "collection_order_index int, playlist_create_at string, signed_at string")


def sign_playlists(playlists: DataFrame, signed_at: dt.datetime, description: str = "description",
                   prefix: str = SIGNATURE_PREFIX) -> DataFrame:
    """Append the signature comment (prefix, a space, url-safe base64 JSON) to
    each playlist's description. ``prefix`` is the marker that the media
    server's comments carry."""
    from cadence.functions.scalars import url_safe_b64_json

    at = F.lit(signed_at.strftime("%Y-%m-%dT%H:%M:%SZ")).alias("signed_at")
    payload = F.struct("collection_id", "playlist_id", "collection_name", "collection_order_index",
                       "playlist_create_at", at)
    return playlists.withColumn(
        "comment", F.concat(F.coalesce(F.col(description), F.lit("")), F.lit(prefix + " "), url_safe_b64_json(payload)))


def parse_signatures(df: DataFrame, comment: str = "comment", prefix: str = SIGNATURE_PREFIX) -> DataFrame:
    """Decode signatures from comments; NULL when absent or garbled."""
    import re

    from cadence.functions.scalars import parse_url_safe_b64_json

    sig = parse_url_safe_b64_json(F.col(comment), SIGNATURE_SCHEMA, re.escape(prefix) + r"\s*")
    return df.withColumn("signature", F.when(F.col(comment).contains(prefix), sig))


def ingest_windows(listens: DataFrame, users: DataFrame, to_ts: dt.datetime, buffer_days: int = 3) -> DataFrame:
    """Per user: fetch window (last stored listen - buffer, to_ts]; users
    without listens start from the beginning (NULL). Windows that are not
    increasing are flagged invalid."""
    last = listens.groupBy("username").agg(F.max("listen_at_ts_utc").alias("last_listen_at"))
    frm = F.col("last_listen_at") - F.expr(f"INTERVAL {int(buffer_days)} DAYS")
    return users.join(last, "username", "left").select(
        "username", "last_listen_at", frm.alias("from_ts"), F.lit(to_ts).cast("timestamp_ntz").alias("to_ts"),
        (frm.isNull() | (frm < F.lit(to_ts))).alias("valid"))


# Collection names and refresh hours (UTC) per collection.
COLLECTION_REFRESH_HOURS = {
    "loved-tracks": None,
    "revisit-tracks": None,
    "revisit-releases": [7],
    "smart-mixes": [7],
    "top-artists": [7],
}


def create_collections(users: DataFrame, existing: DataFrame, replace: bool = False) -> DataFrame:
    """Every user gets the five collections; existing ones are kept unless
    ``replace`` (then they are recreated, unrefreshed, with the default hours)."""
    from cadence.operators.merge import insert_absent, upsert

    defs = F.array(*[
        F.struct(F.lit(n).alias("collection_name"),
                 (F.array(*[F.lit(x) for x in h]) if h is not None else F.lit(None)).cast("array<int>")
                 .alias("refresh_at_hours_utc"))
        for n, h in COLLECTION_REFRESH_HOURS.items()])
    want = users.select("username").distinct().select("username", F.explode(defs).alias("d")).select(
        F.col("d.collection_name").alias("collection_name"), "username",
        F.col("d.refresh_at_hours_utc").alias("refresh_at_hours_utc"),
        F.lit(None).cast("timestamp_ntz").alias("refreshed_at_utc"))
    key = ["username", "collection_name"]
    if replace:
        return upsert(existing.select(*want.columns), want, key)
    return insert_absent(existing.select(*want.columns), want, key)


def replace_playlists(stored: DataFrame, new: DataFrame, collections: DataFrame, now: dt.datetime,
                      force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Swap in new playlists for collections that are stale (or forced):
    their stored tracks are replaced as a group and refreshed_at is
    stamped. Returns (tracks, collections)."""
    from cadence.operators.merge import replace_groups, update_column

    key = ["username", "collection_name"]
    st = stale_collections(collections, now)
    gate = st if force else st.where(F.col("is_stale"))
    chosen = new.select(*key).distinct().join(gate.select(*key), key, "left_semi")
    tracks = replace_groups(stored, new.join(chosen, key, "left_semi").select(*stored.columns), key, groups=chosen)
    stamped = update_column(collections, chosen.withColumn("refreshed_at_utc", F.lit(now).cast("timestamp_ntz")),
                            key, "refreshed_at_utc")
    return tracks, stamped
