"""Domain frames derived from the driver's test tables.

The test tables are a generic star schema plus an event stream; these
adapters give them the shape of listening histories and a media library so
every model runs over whole tables and grows with them. Each adapter is a
lazy projection (column pruning and filter pushdown reach the parquet scan).

Identifiers are uuid-shaped: ``mbid(kind, n)`` hyphenates md5(kind || n).
The same derivations are written in SQL in ``cadence.oracle`` so an
independent engine can check every query.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.scalars import uuid_from_hex

# Fixed reference clocks for the test tables (events span 2024-01-01..30,
# orders 1995-01-01..2001-08-01).
LISTEN_AS_OF = dt.datetime(2024, 1, 31, 0, 0, 0)
DUMP_AS_OF = dt.datetime(2001, 8, 1, 0, 0, 0)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table. Files written as a single row group scan as one
    task; such a scan is spread round-robin over the session's parallelism
    so per-row work before the first shuffle is not single-threaded (a no-op
    for inputs that already split into enough tasks). Column pruning still
    reaches the scan below the repartition."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    want = spark.sparkContext.defaultParallelism
    if name in SPREAD_TABLES and df.rdd.getNumPartitions() < want:
        df = df.repartition(want)
    return df


#: Rows of a table that a task takes where it must hold them (sorts, groups).
TASK_ROWS = 250_000


def task_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Tasks for steps that hold rows of a table: as many as the session has
    cores, more for more rows (counted by the files' footers)."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").count()
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


# Tables with per-row derivations heavy enough to spread.
SPREAD_TABLES = {"events", "lineitem", "orders", "customer", "part", "embeddings"}


def mbid(kind: str, n) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return uuid_from_hex(F.md5(F.concat(F.lit(kind), n.cast("string"))))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


# --- listening history ----------------------------------------------------

def listens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed listens: one row per event."""
    return listens_from_events(table(spark, sf_dir, "events"))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream (new parquet files = new events)."""
    schema = table(spark, sf_dir, "events").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events*.parquet")
        .option("maxFilesPerTrigger", 1)
        .parquet(sf_dir)
    )


def listens_from_events(e: DataFrame) -> DataFrame:
    """Event rows -> listens (works on batch and streaming frames)."""
    k = _k()
    return e.select(
        F.md5(F.col("event_id").cast("string")).alias("listen_md5"),
        F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("username"),
        mbid("r", k % 12).alias("recording_mbid"),
        mbid("l", k % 25).alias("release_mbid"),
        F.array(mbid("a", k % 12), mbid("a", k % 7)).alias("artist_mbids"),
        F.col("ts").alias("listen_at_ts_utc"),
        F.round(F.col("value") * 1000).cast("long").alias("duration_ms"),
        F.concat(F.lit("Track "), (k % 12).cast("string")).alias("track_name"),
        F.concat(F.lit("Release "), (k % 25).cast("string")).alias("release_name"),
        F.concat(F.lit("Artist "), (k % 12).cast("string")).alias("artist_name"),
        F.col("event_type"),
    )


def raw_listens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _build_raw_listens(spark, sf_dir)


def _build_raw_listens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed listen payloads: (listen_md5, username, json_data, ts) with the
    listen document as JSON text, as an API page would deliver it."""
    e = table(spark, sf_dir, "events")
    k = _k()
    doc = F.struct(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("listened_at"),
        F.md5(F.concat(F.lit("msid"), (k % 12).cast("string"))).alias("recording_msid"),
        F.struct(
            F.concat(F.lit("Track "), (k % 12).cast("string")).alias("track_name"),
            F.concat(F.lit("Artist "), (k % 12).cast("string")).alias("artist_name"),
            F.concat(F.lit("Release "), (k % 25).cast("string")).alias("release_name"),
            F.struct(
                F.round(F.col("value") * 1000).cast("long").alias("duration_ms"),
                ((k % 12) + 1).cast("string").alias("tracknumber"),
            ).alias("additional_info"),
            F.struct(
                mbid("r", k % 12).alias("recording_mbid"),
                mbid("l", k % 25).alias("release_mbid"),
                F.array(mbid("a", k % 12), mbid("a", k % 7)).alias("artist_mbids"),
            ).alias("mbid_mapping"),
        ).alias("track_metadata"),
    )
    return e.select(
        F.md5(F.col("event_id").cast("string")).alias("listen_md5"),
        F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("username"),
        F.to_json(doc).alias("json_data"),
        F.col("ts").alias("listen_at_ts_utc"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loved recordings: 'purchase' events are love feedback (score 1)."""
    return (
        listens(spark, sf_dir)
        .where(F.col("event_type") == "purchase")
        .select(
            "username",
            "recording_mbid",
            F.lit(1).alias("score"),
            F.col("listen_at_ts_utc").alias("feedback_at"),
        )
    )


# --- catalogue dimensions (from part) ---------------------------------------

def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 25
    return table(spark, sf_dir, "part").select(
        mbid("l", n).alias("release_mbid"),
        mbid("g", n % 12).alias("release_group_mbid"),
        F.concat(F.lit("Release "), n.cast("string")).alias("release_title"),
        F.concat(F.lit("Artist "), (n % 12).cast("string")).alias("artist_credit_phrase"),
    ).distinct()


def release_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 12
    return table(spark, sf_dir, "part").select(
        mbid("g", n).alias("release_group_mbid"),
        F.concat(F.lit("Album "), n.cast("string")).alias("release_group_title"),
        F.concat(F.lit("Artist "), (n % 12).cast("string")).alias("artist_credit_phrase"),
        (F.lit(1990) + n).cast("int").alias("release_group_year"),
    ).distinct()


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 10
    return table(spark, sf_dir, "part").select(
        mbid("r", n).alias("recording_mbid"),
        F.concat(F.lit("Track "), n.cast("string")).alias("recording_title"),
        F.concat(F.lit("Artist "), (n % 12).cast("string")).alias("artist_credit_phrase"),
    ).distinct()


def artist_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat artist annotation facts: one row per part: artist number
    n = p_partkey % 11, a tag (p_type) and a release date text
    ('<1990 + p_size % 25>-01-01'; sizes over 45 give a malformed date)."""
    p = table(spark, sf_dir, "part")
    date_txt = F.when(F.col("p_size") > 45, F.lit("19.5-xx")).otherwise(
        F.concat((F.lit(1990) + F.col("p_size") % 25).cast("string"), F.lit("-01-01")))
    return p.select(
        (F.col("p_partkey") % 11).alias("n"),
        F.lower(F.col("p_type")).alias("tag"),
        date_txt.alias("release_date"),
    )


def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated artists (ids 0..10; artist 11 is never annotated) with tags
    ordered by count desc then name, and the active-years timeline.
    Aggregates on the artist number; ids are derived on the result."""
    from cadence.plans.annotations import artist_dimension

    return artist_dimension(artist_annotations(spark, sf_dir), "n").select(
        mbid("a", F.col("n")).alias("artist_mbid"),
        F.concat(F.lit("Artist "), F.col("n").cast("string")).alias("artist_name"),
        "tags_string",
        "active_years",
    )


# --- media library (from embeddings) ----------------------------------------

def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library files with audio embeddings."""
    v = F.col("vec_id")
    length = F.lit(30) + v % 300
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("lib/"), F.col("label").cast("string"), F.lit("/"),
                 F.lpad(v.cast("string"), 6, "0"), F.lit(".flac")).alias("filepath"),
        F.col("embedding"),
        (v % 37 != 0).alias("embedding_success"),
        F.least(length, F.lit(90)).cast("int").alias("embedding_duration_seconds"),
        (length.cast("double") + F.lit(0.5)).alias("track_length_seconds"),
        mbid("r", v % 10).alias("recording_mbid"),
        mbid("l", v % 25).alias("release_mbid"),
        mbid("g", v % 25 % 8).alias("release_group_mbid"),
        mbid("a", F.col("label")).alias("artist_mbid"),
        F.when(v % 4 != 0, mbid("a", v % 13)).alias("album_artist_mbid"),
        F.concat(F.lit("Track "), (v % 10).cast("string")).alias("track_name"),
        F.concat(F.lit("Album "), (v % 25 % 8).cast("string")).alias("album_name"),
        F.concat(F.lit("Artist "), F.col("label").cast("string")).alias("artist_name"),
        F.when(v % 4 != 0, F.concat(F.lit("Artist "), (v % 13).cast("string"))).alias("album_artist_name"),
        F.md5(F.concat_ws("-", F.concat(F.lit("Track "), (v % 10).cast("string")),
                          F.concat(F.lit("Album "), (v % 25 % 8).cast("string")),
                          F.concat(F.lit("Artist "), F.col("label").cast("string")))).alias("recording_md5"),
        F.col("label"),
        v.alias("vec_id"),
    )


def cf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored half of the artist similarity table: a <= b (string order),
    diagonal 1.0, off-diagonal ((i*j) % 7) / 7 over nation keys as artists."""
    # the 25 nation keys as one bounded array; pairs i <= j by exploding it
    # twice (a dimension, not data: no join needed)
    keys = table(spark, sf_dir, "nation").agg(F.sort_array(F.collect_list("n_nationkey")).alias("k"))
    pairs = keys.select(F.explode("k").alias("i"), "k").select(
        "i", F.explode(F.filter("k", lambda x: x >= F.col("i"))).alias("j"))
    ia, jb = mbid("a", F.col("i")), mbid("a", F.col("j"))
    return pairs.select(
        F.least(ia, jb).alias("artist_mbid_a"),
        F.greatest(ia, jb).alias("artist_mbid_b"),
        F.when(F.col("i") == F.col("j"), F.lit(1.0))
        .otherwise(((F.col("i") * F.col("j")) % 7).cast("double") / 7.0)
        .alias("score_value"),
    )


def cf_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored half of a similarity table that grows: artists (suppliers) on
    neighbouring lines of an order, score n / (n + 2) for n such places, and
    the diagonal with 1.0."""
    from pyspark.sql.window import Window

    # dealt by number: sorts of a task stay as small whatever the table's size
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey")
    li = li.repartition(task_count(spark, sf_dir, "lineitem"), "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey")
    near = li.select(F.col("l_suppkey").alias("x"), F.lead("l_suppkey").over(w).alias("y")).where("x <> y")
    pairs = near.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    scored = pairs.select("x", "y", (F.col("n") / (F.col("n") + 2.0)).alias("score_value"))
    same = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("x")).distinct().select("x", F.col("x").alias("y"), F.lit(1.0).alias("score_value"))
    a, b = mbid("s", F.col("x")), mbid("s", F.col("y"))
    return scored.unionByName(same).select(F.least(a, b).alias("artist_mbid_a"), F.greatest(a, b).alias("artist_mbid_b"), "score_value")


def starred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars of the media server: two of twenty users for every file."""
    v = F.col("vec_id")
    return files(spark, sf_dir).select("filepath", F.explode(F.array(v % 20, (v * 7 + 3) % 20)).alias("n")).select(
        F.concat(F.lit("u"), F.col("n").cast("string")).alias("username"), "filepath").distinct()


def feedback_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback API pages as JSON texts, one per (user, day): a love for each
    purchase; every 11th entry has a malformed id."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    user = F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"))
    entry = F.struct(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("created"),
        F.when(F.col("event_id") % 11 == 0, F.lit("NOT-A-UUID")).otherwise(mbid("r", F.col("event_id") % 3000)).alias("recording_mbid"),
        F.lit(1).alias("score"), user.alias("user_id"),
        F.when(F.col("event_id") % 2 == 0, F.struct(F.concat(F.lit("Track "), F.col("event_id").cast("string")).alias("track_name"))).alias("track_metadata"))
    pages = e.select(user.alias("u"), F.to_date("ts").alias("d"), entry.alias("f")).groupBy("u", "d").agg(F.collect_list("f").alias("feedback"))
    return pages.select(F.to_json(F.struct(F.size("feedback").alias("count"), "feedback")).alias("value"))


def raw_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tags of the library files: the date under one of four names, or
    empty, the album artist under one of two, some lists without a value."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    one = lambda c: F.array(c.cast("string"))
    year = (F.lit(1990) + v % 30).cast("string")
    who = F.concat(F.lit("Artist "), (v % 13).cast("string"))
    none = F.array().cast("array<string>")
    doc = F.struct(
        one(F.concat(F.lit("Track "), v.cast("string"))).alias("title"), F.array(F.lit("Album"), F.lit("other")).alias("album"),
        F.when(v % 7 != 0, one(F.concat(F.lit("Artist "), F.col("label").cast("string")))).alias("artist"),
        F.when(v % 5 == 0, one(F.concat(year, F.lit("-05-01")))).when(v % 5 < 3, one(F.lit(""))).when(v % 5 == 3, none).alias("date"),
        F.when(v % 5 == 1, one(year)).alias("originalyear"), F.when(v % 5 == 2, one(year)).alias("year"),
        F.when(v % 5 >= 3, one(year)).alias("origyear"),
        F.when(v % 3 == 0, one(who)).when(v % 3 == 1, none).alias("albumartist"),
        F.when(v % 3 == 1, one(F.concat(who, F.lit("*")))).alias("album artist"), none.alias("genre"))
    return e.select(_lib_path(v).alias("filepath"), F.to_json(doc).alias("tags_json"))


def dump_timestamp_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slug, timestamp): a dump packet per order with the text of its
    timestamp file; every 17th is garbled, every 19th missing."""
    k = F.col("o_orderkey")
    text = F.concat(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit("."),
                    F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit("+00\n"))
    return table(spark, sf_dir, "orders").select(
        F.concat_ws("-", k.cast("string"), _entity(k)).alias("slug"),
        F.when(k % 17 == 0, F.lit("at noon")).when(k % 19 != 0, text).alias("timestamp"))


def stored_playlists(spark: SparkSession, sf_dir: str, tracks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(collections, playlists, tracks) as stored, from numbered
    ``playlist_tracks``."""
    made = F.lit(dt.datetime(2024, 5, 1)).cast("timestamp_ntz")
    pn = F.substring("playlist_id", 3, 9).cast("int")
    c = tracks.select("collection_id", "collection_name", "username").distinct().select(
        mbid("c", F.col("collection_id")).alias("collection_id"), "collection_name", "username",
        F.array(F.lit(7)).alias("refresh_at_hours_utc"), made.alias("create_at_utc"), F.lit(None).cast("timestamp_ntz").alias("refreshed_at_utc"))
    p = tracks.select("playlist_id", "collection_id", "collection_name").distinct().select(
        mbid("p", pn).alias("playlist_id"), mbid("c", F.col("collection_id")).alias("collection_id"),
        F.floor(pn / 4).cast("int").alias("collection_order_index"), F.concat_ws(" ", "collection_name", pn.cast("string")).alias("title"),
        F.lit("").alias("description"), made.alias("create_at_utc"))
    f = files(spark, sf_dir).select("filepath", "recording_mbid", "release_mbid", "release_group_mbid", "artist_mbid", "album_artist_mbid",
                                    F.floor("track_length_seconds").cast("int").alias("track_length_seconds"))
    t = tracks.join(f, "filepath").select(
        mbid("t", F.concat_ws("/", "playlist_id", "filepath")).alias("track_id"), mbid("p", pn).alias("playlist_id"), "track_order_index",
        *f.columns, F.lit(0.5).alias("match_distance"), (F.col("track_order_index") == 0).alias("is_seed"))
    return c, p, t


def playlist_seeds(spark: SparkSession, sf_dir: str, per_playlist: int = 3) -> DataFrame:
    """One playlist per library label; seeds are the label's files with the
    smallest md5(filepath), weights 1..n by that order. Owner 'u<label%10>'."""
    from pyspark.sql.window import Window

    f = files(spark, sf_dir).select("filepath", "label")
    w = Window.partitionBy("label").orderBy(F.md5("filepath"), "filepath")
    return (
        f.withColumn("seed_rank", F.row_number().over(w))
        .where(F.col("seed_rank") <= per_playlist)
        .select(
            F.concat(F.lit("p"), F.col("label").cast("string")).alias("playlist_id"),
            F.concat(F.lit("u"), (F.col("label") % 10).cast("string")).alias("username"),
            "filepath",
            F.col("seed_rank").cast("double").alias("weight"),
        )
    )


# --- dumps (orders x lineitem) -------------------------------------------------

def dump_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listen-dump rows: user = customer, artist = supplier, one row per
    order line (slug = order date)."""
    return dump_lines(spark, sf_dir).select(
        F.date_format("dump_date", "yyyyMMdd").alias("slug"), "dump_date", "user_id", mbid("s", F.col("l_suppkey")).alias("artist_mbid"),
        "listen_count")


def dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dump_records`` with the supplier's number for the artist."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderdate").cast("date").alias("dump_date"), F.col("o_custkey").alias("user_id"), "l_suppkey",
        F.col("l_quantity").cast("long").alias("listen_count"))


def raw_name_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _build_raw_name_map(spark, sf_dir)


def _build_raw_name_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed name-lookup results keyed by recording_md5 (one per
    p_partkey % 40: title 'Track n%10', album 'Album n%8', artist 'Artist n%10').
    Every 7th lookup failed; every 11th returned a malformed recording id."""
    n = F.col("n")
    title = F.concat(F.lit("Track "), (n % 10).cast("string"))
    album = F.concat(F.lit("Album "), (n % 8).cast("string"))
    artist = F.concat(F.lit("Artist "), (n % 10).cast("string"))
    payload = F.struct(
        F.when(n % 11 == 0, F.lit("NOT-A-UUID")).otherwise(mbid("r", (n + 3) % 10)).alias("recording_mbid"),
        mbid("l", n % 25).alias("release_mbid"),
        F.array(mbid("a", n % 10), mbid("a", (n + 1) % 10)).alias("artist_mbids"),
        F.struct(F.struct(mbid("g", n % 8).alias("release_group_mbid")).alias("release")).alias("metadata"),
        title.alias("recording_name"),
        album.alias("release_name"),
        artist.alias("artist_credit_name"),
    )
    return (
        table(spark, sf_dir, "part")
        .select((F.col("p_partkey") % 40).alias("key"))
        .groupBy("key")
        # the number is an aggregate, no key: filters on the payload can't be
        # moved below, where every part's payload would be built and parsed
        .agg(F.max("key").alias("n"))
        .select(
            F.md5(F.concat_ws("-", title, album, artist)).alias("recording_md5"),
            title.alias("recording_name"),
            album.alias("release_name"),
            artist.alias("artist_name"),
            (n % 7 != 0).alias("success"),
            F.when(n % 7 != 0, F.to_json(payload)).otherwise(F.lit('{"error": "not found"}')).alias("payload_json"),
        )
    )


def raw_similar_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _build_raw_similar_activity(spark, sf_dir)


def _build_raw_similar_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed similar-user activity payloads: one per order. The order's
    customer is the similar user; entity and range come from the order key;
    the payload lists one row per order line (duplicates possible)."""
    # both dealt by the order, so that join and grouping hold as many rows in a
    # task whatever the tables' size
    n = task_count(spark, sf_dir, "lineitem")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").repartition(n, "o_orderkey")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity").repartition(n, "l_orderkey")
    e = (F.col("o_orderkey") % 3).cast("int")
    # one id per line, of the payload's entity
    line_id = (
        F.when(e == 0, mbid("a", F.col("l_suppkey") % 25))
        .when(e == 1, mbid("l", F.col("l_partkey") % 25))
        .otherwise(mbid("r", F.col("l_partkey") % 12))
    )
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice",
        F.struct(line_id.alias("id"), F.col("l_quantity").cast("long").alias("listen_count")).alias("row"),
    )
    g = j.groupBy("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").agg(F.collect_list("row").alias("rows"))
    ent = F.element_at(F.array(F.lit("artists"), F.lit("releases"), F.lit("recordings")), e + 1)
    from_ts = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))

    def rows_as(field):
        return F.transform("rows", lambda r: F.struct(r["id"].alias(field), r["listen_count"]))

    doc = F.struct(
        from_ts.alias("from_ts"),
        (from_ts + F.lit(30 * 86400)).alias("to_ts"),
        F.when(e == 0, rows_as("artist_mbid")).alias("artists"),
        F.when(e == 1, rows_as("release_mbid")).alias("releases"),
        F.when(e == 2, rows_as("recording_mbid")).alias("recordings"),
    )
    return g.select(
        F.md5(F.col("o_orderkey").cast("string")).alias("payload_id"),
        F.concat(F.lit("u"), (F.col("o_custkey") % 10).cast("string")).alias("from_username"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("to_username"),
        ent.alias("entity"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("month")).otherwise(F.lit("year")).alias("time_range"),
        ((F.col("o_totalprice") % 100) / 100.0).alias("user_similarity"),
        F.to_json(doc).alias("json_data"),
    )


# --- annotation queue domain (orders, lineitem, customer) --------------------------

ENTITIES = ["artist", "release", "release-group", "recording"]
ERRORS = ["HTTPSConnectionPool: status=None", "HTTPError status=500", "connection reset by peer"]


def _entity(n) -> Column:
    return F.element_at(F.array(*[F.lit(e) for e in ENTITIES]), (n % 4 + 1).cast("int"))


def queue_mbids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity universe of the queue: one id per order."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(mbid("o", k).alias("mbid"), _entity(k).alias("entity"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _build_annotations(spark, sf_dir)


def _build_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored annotations: every non-pending order (entity 'label' for every
    9th key: an entity the queue never handles; low-priority orders failed),
    plus failed annotations of customer ids that no longer exist."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    ok = F.col("o_orderpriority") != "5-LOW"
    err = F.element_at(F.array(*[F.lit(e) for e in ERRORS]), (k % 3 + 1).cast("int"))
    from_orders = o.where(F.col("o_orderstatus") != "P").select(
        mbid("o", k).alias("mbid"),
        F.when(k % 9 == 0, F.lit("label")).otherwise(_entity(k)).alias("entity"),
        F.to_json(F.struct(ok.alias("_success"), F.when(~ok, err).alias("error"))).alias("payload_json"),
        F.col("o_orderdate").alias("ts_utc"),
    )
    c = table(spark, sf_dir, "customer")
    orphans = c.select(
        mbid("c", F.col("c_custkey")).alias("mbid"),
        F.lit("artist").alias("entity"),
        F.lit('{"_success":false,"error":"status=404 not found"}').alias("payload_json"),
        (F.lit(dt.datetime(1995, 1, 1)) + F.make_dt_interval(hours=F.col("c_custkey").cast("int")))
        .cast("timestamp_ntz").alias("ts_utc"),
    )
    return from_orders.unionByName(orphans)


def mb_dump_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _build_mb_dump_records(spark, sf_dir)


def _build_mb_dump_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity dump records: one per order line, dumped at its ship date, with
    one container (the part's order id)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("mb-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("slug"),
        _entity(F.col("l_orderkey")).alias("dump_entity"),
        F.col("l_shipdate").alias("dump_timestamp"),
        mbid("o", F.col("l_orderkey")).alias("mbid"),
        F.to_json(F.struct(F.array(F.struct(mbid("o", F.col("l_partkey")).alias("mbid"),
                                            _entity(F.col("l_partkey")).alias("entity"))).alias("containers"))
                  ).alias("json_data"),
    )


def entity_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation payloads of all four entities: an artist per supplier, a
    recording, a release and a release group per part. Every 17th lookup
    failed. Artists with s_suppkey % 4 = 0 have one release, so one year; every
    9th has a malformed date as well. Every 13th release names a malformed
    group, every 5th recording a malformed release."""
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    n, k = F.col("s_suppkey").cast("long"), F.col("p_partkey").cast("long")

    def payload(entity: str, key: Column, doc: Column) -> Column:
        ok = key % 17 != 0
        return F.to_json(F.struct(
            ok.alias("_success"), F.struct(F.lit(entity).alias("entity")).alias("_args"),
            F.when(~ok, F.lit("status=404 not found")).alias("error"), F.when(ok, F.struct(doc.alias(entity))).alias("data")))

    def row(df: DataFrame, kind: str, entity: str, key: Column, doc: Column) -> DataFrame:
        return df.select(mbid(kind, key).alias("mbid"), F.lit(entity).alias("entity"), payload(entity, key, doc).alias("payload_json"),
                         (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(mins=(key % 1000).cast("int"))).cast("timestamp_ntz").alias("ts_utc"))

    def credits(key: Column) -> Column:
        return F.array(*[F.struct(F.struct(a.alias("id")).alias("artist")) for a in
                         (mbid("s", key % 100 + 1), mbid("s", key % 7 + 1), F.lit("unknown"))])

    date = lambda key, i: F.when((key % 9 == 0) & (i == 1), F.lit("19.x-01")).otherwise(
        F.concat((1990 + (key * 7 + i * 3) % 30).cast("string"), F.lit("-02-03")))
    releases = F.transform(F.sequence(F.lit(0).cast("long"), n % 4), lambda i: F.struct(
        mbid("p", (n * 5 + i) % 400 + 1).alias("id"), date(n, i).alias("date")))
    tags = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")), lambda i: F.struct(
        F.concat(F.lit("tag "), ((n + i) % 6).cast("string")).alias("name"), ((n * (i + 2)) % 5).cast("string").alias("count")))
    artist = F.struct(F.col("s_name").alias("name"), F.when(n % 2 == 0, F.lit("Group")).otherwise(F.lit(" ")).alias("type"),
                      releases.alias("release-list"), F.when(n % 6 != 0, tags).alias("tag-list"), (n % 4 + 1).cast("string").alias("release-count"))
    release = F.struct(
        F.col("p_name").alias("title"), F.struct(F.when(k % 13 == 0, F.lit("BAD")).otherwise(mbid("g", k % 50)).alias("id")).alias("release-group"),
        F.concat((1950 + F.col("p_size")).cast("string"), F.lit("-05")).alias("date"), credits(k).alias("artist-credit"),
        F.col("p_brand").alias("artist-credit-phrase"))
    group = F.struct(
        F.col("p_type").alias("title"), (k % 3 + 1).cast("string").alias("release-count"),
        F.when(k % 8 != 0, F.concat((1960 + F.col("p_size")).cast("string"), F.lit("-01-01"))).alias("first-release-date"),
        F.lit("Album").alias("type"), F.lit("Album").alias("primary-type"), credits(k).alias("artist-credit"),
        F.col("p_brand").alias("artist-credit-phrase"))
    recording = F.struct(
        F.col("p_name").alias("title"), (k * 1000).cast("string").alias("length"),
        F.array(F.struct(mbid("p", k).alias("id")), F.struct(F.when(k % 5 == 0, F.lit("x")).otherwise(mbid("p", k + 1)).alias("id"))).alias("release-list"),
        credits(k).alias("artist-credit"), F.col("p_brand").alias("artist-credit-phrase"))
    return (
        row(s, "s", "artist", n, artist)
        .unionByName(row(p, "r", "recording", k, recording))
        .unionByName(row(p, "p", "release", k, release))
        .unionByName(row(p, "g", "release-group", k, group))
    )


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlist collections with refresh hours (one per customer)."""
    c = table(spark, sf_dir, "customer")
    n = F.col("c_nationkey")
    hours = F.when(F.col("c_custkey") % 5 == 0, F.array().cast("array<int>")).otherwise(
        F.array((n % 24).cast("int"), ((n + 12) % 24).cast("int")))
    now = dt.datetime(2024, 5, 18, 12, 0, 0)
    refreshed = F.when(F.col("c_custkey") % 7 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(
        (F.lit(now) - F.make_dt_interval(hours=(F.col("c_custkey") % 48).cast("int"))).cast("timestamp_ntz"))
    return c.select(
        F.concat(F.lit("coll-"), F.col("c_custkey").cast("string")).alias("collection_name"),
        F.concat(F.lit("u"), (F.col("c_custkey") % 10).cast("string")).alias("username"),
        hours.alias("refresh_at_hours_utc"),
        refreshed.alias("refreshed_at_utc"),
    )


def playlist_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored playlists: every file sits in two of 14 playlists; playlist n
    belongs to collection n % 4 (owner u<collection % 2>)."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    fp = F.concat(F.lit("lib/"), F.col("label").cast("string"), F.lit("/"), F.lpad(v.cast("string"), 6, "0"), F.lit(".flac"))
    pl = F.explode(F.array((v % 7).cast("int"), ((v + 4) % 7 + 7).cast("int")))
    t = e.select(fp.alias("filepath"), pl.alias("pn"))
    names = F.array(*[F.lit(x) for x in ["top-artists", "smart-mix", "loved-tracks", "revisit-tracks"]])
    cid = F.col("pn") % 4
    return t.select(
        "filepath",
        F.concat(F.lit("pl"), F.col("pn").cast("string")).alias("playlist_id"),
        cid.alias("collection_id"),
        F.element_at(names, (cid + 1).cast("int")).alias("collection_name"),
        F.concat(F.lit("u"), (cid % 2).cast("string")).alias("username"),
    )


def file_birth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File birth timestamps (one minute apart by vec_id)."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    fp = F.concat(F.lit("lib/"), F.col("label").cast("string"), F.lit("/"), F.lpad(v.cast("string"), 6, "0"), F.lit(".flac"))
    return e.select(fp.alias("filepath"),
                    (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(mins=v.cast("int")))
                    .cast("timestamp_ntz").alias("birth_at"))


def exclude_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path exclusion rules (regexes anchored at the path start)."""
    r = table(spark, sf_dir, "region")
    return r.select(F.concat(F.lit("lib/"), (F.col("r_regionkey") * 2).cast("string"), F.lit("/00"),
                             F.col("r_regionkey").cast("string")).alias("pattern"))


def listen_dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listen dump as lines of JSON (one per order line) with every id shape
    the dump parser meets: id lists, scalar ids, upper case / bare hex /
    urn-prefixed ids, malformed ids, empty lists and missing ids."""
    return _build_listen_dump_lines(spark, sf_dir)


def _build_listen_dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    a = mbid("s", F.col("l_suppkey"))
    b = mbid("s", F.col("l_suppkey") + 1)
    n = F.col("l_linenumber")
    arr_t = "array<string>"
    ids = (
        F.when(n == 1, F.array(a, F.lit("NOT-A-UUID")))
        .when(n == 2, F.array(F.upper(F.regexp_replace(a, "-", ""))))
        .when(n == 3, F.array().cast(arr_t))
        .when(n == 4, F.array(F.lit("bad")))
        .when(n == 7, F.array(a, b))
        .otherwise(F.lit(None).cast(arr_t))
    )
    one = (
        F.when(n.isin(3, 4), a)
        .when(n == 6, F.concat(F.lit("urn:uuid:"), a))
        .otherwise(F.lit(None).cast("string"))
    )
    doc = F.struct(
        F.col("o_custkey").alias("user_id"),
        F.struct(F.struct(ids.alias("artist_mbids"), one.alias("artist_mbid")).alias("additional_info")).alias("track_metadata"),
    )
    return j.select(F.to_json(doc).alias("value"))


# --- local library sources (metadata payloads, embedding runs, birth times) ----------

def _lib_path(v) -> Column:
    return F.concat(F.lit("lib/"), F.col("label").cast("string"), F.lit("/"), F.lpad(v.cast("string"), 6, "0"),
                    F.lit(".flac"))


def raw_local_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed file metadata: tag documents (JSON) plus file times. Every 9th
    file has a malformed date, every 11th an upper-case recording id."""
    return _build_raw_local_files(spark, sf_dir)


def _build_raw_local_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    rec = mbid("r", v % 10)
    tags = F.struct(
        F.concat(F.lit("Track "), (v % 10).cast("string")).alias("title"),
        F.concat(F.lit("Album "), (v % 25 % 8).cast("string")).alias("album"),
        F.concat(F.lit("Artist "), F.col("label").cast("string")).alias("artist"),
        F.when(v % 4 != 0, F.concat(F.lit("Artist "), (v % 13).cast("string"))).alias("album_artist"),
        F.when(v % 9 == 0, F.lit("19.5")).otherwise(
            F.concat((F.lit(1990) + v % 30).cast("string"), F.lit("-05-01"))).alias("date"),
        (F.lit(30) + v % 300).cast("string").alias("length"),
        F.when(v % 11 == 0, F.upper(rec)).otherwise(rec).alias("musicbrainz_trackid"),
        mbid("l", v % 25).alias("musicbrainz_albumid"),
        mbid("g", v % 25 % 8).alias("musicbrainz_releasegroupid"),
        mbid("a", F.col("label")).alias("musicbrainz_artistid"),
        F.when(v % 4 != 0, mbid("a", v % 13)).alias("musicbrainz_albumartistid"),
    )
    t0 = dt.datetime(2023, 1, 1)
    return e.select(
        _lib_path(v).alias("filepath"),
        F.md5(F.concat_ws("-", F.concat(F.lit("Track "), (v % 10).cast("string")),
                          F.concat(F.lit("Album "), (v % 25 % 8).cast("string")),
                          F.concat(F.lit("Artist "), F.col("label").cast("string")))).alias("recording_md5"),
        F.to_json(tags).alias("json_data"),
        (F.lit(t0) + F.make_dt_interval(hours=v.cast("int"))).cast("timestamp_ntz").alias("file_created_at"),
        (F.lit(t0) + F.make_dt_interval(hours=(v * 7 % 1000).cast("int"))).cast("timestamp_ntz").alias("file_modified_at"),
    )


def raw_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding runs: failed every 37th file; conditioned embedding not yet
    computed for every 5th file."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    ok = v % 37 != 0
    return e.select(
        _lib_path(v).alias("filepath"),
        ok.alias("success"),
        F.when(~ok, F.lit("decode error")).alias("fail_reason"),
        F.least(F.lit(30) + v % 300, F.lit(90)).cast("int").alias("duration_seconds"),
        F.when(ok, F.col("embedding")).alias("embedding"),
        F.when(ok & (v % 5 != 0), F.col("embedding")).alias("conditioned_embedding"),
    )


def birth_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 3 == 0)
    v = F.col("vec_id")
    return e.select(_lib_path(v).alias("filepath"),
                    (F.lit(dt.datetime(2022, 6, 1)) + F.make_dt_interval(mins=v.cast("int")))
                    .cast("timestamp_ntz").alias("birth_at"))


def entity_dump_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity dump packets as whole texts: (slug = <packet>-<entity>, value),
    JSON objects one after the other, on one line or over several; every 13th
    object lacks an id."""
    return _build_entity_dump_files(spark, sf_dir)


def _build_entity_dump_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey")
    packet = (k / 300).cast("long")
    ent = _entity(packet)
    credits = F.array(F.struct(F.struct(mbid("a", k % 11).alias("id")).alias("artist")),
                      F.struct(F.struct(mbid("a", (k + 1) % 11).alias("id")).alias("artist")))
    obj = F.when(k % 13 == 0, F.lit('{"junk": 1}')).otherwise(F.to_json(F.struct(
        mbid("p", k).alias("id"),
        F.when(ent.isin("release", "release-group"), credits).alias("artist-credit"),
        F.when(ent == "release", F.struct(mbid("g", k % 50).alias("id"))).alias("release-group"),
    )))
    # some objects are broken over lines, some share one; every 60th is
    # followed by a token that is no JSON
    obj = F.when(k % 7 == 0, F.regexp_replace(obj, ",", ",\n")).otherwise(obj)
    obj = F.when(k % 60 == 1, F.concat(obj, F.lit(" oops "))).otherwise(obj)
    lines = p.select(F.concat_ws("-", packet.cast("string"), ent).alias("slug"), k, obj.alias("obj"),
                     F.when(k % 3 == 2, F.lit("\n")).otherwise(F.lit("  ")).alias("gap"))
    # a packet holds 300 objects at most
    return lines.groupBy("slug").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("p_partkey", "obj", "gap"))), lambda x: F.concat(x["obj"], x["gap"])), "").alias("value"))


def broken_dump_ranges(spark: SparkSession, sf_dir: str, chars: int = 700) -> DataFrame:
    """Line-by-line dump files of 1000 parts in ranges of ``chars`` characters
    (slug, file, block, line, value). Of ten objects the fourth has a stray
    quote behind it, the sixth lacks its last brace, the eighth the end of a
    string."""
    k = F.col("p_partkey").cast("long")
    obj = F.to_json(F.struct(mbid("p", k).alias("id"), F.array(F.struct(F.struct(mbid("a", k % 11).alias("id")).alias("artist"))).alias("artist-credit"),
                             F.concat(F.lit('a "quoted" {name} '), k.cast("string")).alias("name")))
    line = (F.when(k % 10 == 3, F.concat(obj, F.lit(' stray"')))
            .when(k % 10 == 5, F.substring(obj, 1, F.length(obj) - 1))
            .when(k % 10 == 7, F.concat(F.substring(obj, 1, F.length(obj) - 2), F.lit("}"))).otherwise(obj))
    # a file holds 1000 lines at most
    slug = F.concat(F.floor(k / 1000).cast("string"), F.lit("-release-group"))
    text = table(spark, sf_dir, "part").select(slug.alias("slug"), k.alias("k"), line.alias("line")).groupBy("slug").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("text"))
    starts = F.sequence(F.lit(0), F.floor(F.length("text") / chars).cast("int"))
    return text.select("slug", F.col("slug").alias("file"), F.explode(starts).alias("n"), "text").select(
        "slug", "file", F.lit(0).cast("long").alias("block"), F.col("n").cast("long").alias("line"),
        F.substring("text", F.col("n") * chars + 1, F.lit(chars)).alias("value"))


def raw_artist_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed artist-stats results (one per supplier as an artist); every
    6th lookup failed."""
    return _build_raw_artist_stats(spark, sf_dir)


def _build_raw_artist_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    ok = k % 6 != 0
    base = 1_700_000_000
    listeners = F.transform(F.sequence(F.lit(1), (k % 4 + 1).cast("int")), lambda i: F.struct(
        F.concat(F.lit("u"), ((k + i) % 10).cast("string")).alias("user_name"), (i * 7).alias("listen_count")))
    data = F.struct(
        F.lit("all_time").alias("stats_range"), F.col("s_name").alias("artist_name"),
        F.lit(base).alias("from_ts"), (F.lit(base) + k * 3600).alias("to_ts"), (F.lit(base) + k * 60).alias("last_updated"),
        (F.col("s_nationkey") * 3).alias("total_user_count"), F.abs(F.col("s_acctbal")).cast("int").alias("total_listen_count"),
        listeners.alias("listeners"))
    payload = F.struct(ok.alias("success"), F.when(~ok, F.lit("HTTP 204: No data in range.")).alias("error"),
                       F.when(ok, data).alias("data"))
    return s.select(mbid("s", k).alias("mbid"), F.to_json(payload).alias("payload_json"),
                    F.lit(dt.datetime(2024, 2, 1)).cast("timestamp_ntz").alias("ts_utc"))


def listen_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listen API pages as JSON texts: one page per (user, UTC day) with the
    listens of that day."""
    return _build_listen_pages(spark, sf_dir)


def _build_listen_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = _k()
    user = F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"))
    listen = F.struct(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("listened_at"),
        F.md5(F.concat(F.lit("msid"), (k % 12).cast("string"))).alias("recording_msid"),
        F.struct(F.concat(F.lit("Track "), (k % 12).cast("string")).alias("track_name"),
                 F.concat(F.lit("Artist "), (k % 12).cast("string")).alias("artist_name")).alias("track_metadata"),
    )
    pages = e.select(user.alias("u"), F.to_date("ts").alias("d"), listen.alias("l")).groupBy("u", "d").agg(
        F.collect_list("l").alias("listens"))
    doc = F.struct(F.struct(F.size("listens").alias("count"), F.col("u").alias("user_id"),
                            F.array_max(F.transform("listens", lambda x: x["listened_at"])).alias("latest_listen_ts"),
                            F.col("listens").alias("listens")).alias("payload"))
    return pages.select(F.to_json(doc).alias("value"))
