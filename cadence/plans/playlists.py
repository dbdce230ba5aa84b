"""Playlist queries over the test library: weighted kNN and its variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.operators.knn import weighted_knn
from cadence.operators.sets import symmetrise
from cadence.plans.registry import register
from cadence.session import stored
from cadence.sources import testdata as td


def _knn_output(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("playlist_id").orderBy("distance", F.md5("filepath"))
    return df.select(
        "playlist_id",
        F.row_number().over(w).alias("position"),
        "filepath",
        "recording_mbid",
        "release_mbid",
        "release_group_mbid",
        "artist_mbid",
        "album_artist_mbid",
        F.round("distance", 6).alias("distance"),
        "track_length_seconds",
    )


@register("knn_weighted")
def knn_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label playlist: weighted 3-seed kNN with CF re-scaling."""
    lib = td.files(spark, sf_dir)
    seeds = td.playlist_seeds(spark, sf_dir)
    cf = symmetrise(td.cf_scores(spark, sf_dir))
    return _knn_output(weighted_knn(lib, seeds, cf))


@register("knn_in_balls")
def knn_in_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same playlists, 50 tracks each, from a library laid out in balls."""
    from cadence.operators.balls import lay_out

    lib, balls = lay_out(td.files(spark, sf_dir), 64)
    cf = symmetrise(td.cf_scores(spark, sf_dir))
    return _knn_output(weighted_knn(stored(lib, "library"), td.playlist_seeds(spark, sf_dir), cf, limit=50, balls=stored(balls, "balls")))


# --- playlist composition ------------------------------------------------------

from cadence.functions.scalars import listen_weight, recency_weight  # noqa: E402
from cadence.operators.quota import first_rows, greedy_quota  # noqa: E402

RECENCY_FAC = 0.5


def seed_weights_from_listens(seeds: DataFrame, file_counts: DataFrame) -> DataFrame:
    """Seed weight ln(2 + lifetime listens of the playlist owner); missing -> 0 listens."""
    fc = file_counts.select("username", "filepath", "lifetime_listen_count")
    return seeds.join(fc, ["username", "filepath"], "left").select(
        "playlist_id", "username", "filepath", listen_weight("lifetime_listen_count").alias("weight")
    )


def recently_played(file_counts: DataFrame, limit: int | None = None) -> DataFrame:
    """Per user: files played in the last 30 days; the ``limit`` most recent
    ones, if asked."""
    rows = file_counts.where((F.col("last30_listen_count") > 0) & F.col("recency_score").isNotNull()).select(
        "username", "filepath", "recency_score")
    if limit is None:
        return rows
    return first_rows(rows, ["username"], [F.desc("recency_score"), F.col("filepath")], limit)


def recency_candidate_weights(file_counts: DataFrame, fac: float = RECENCY_FAC) -> DataFrame:
    """(username, filepath, weight = 1 / (1 + recency * fac)) for the users' recent files."""
    return recently_played(file_counts).select(
        "username", "filepath", recency_weight("recency_score", fac).alias("weight")
    )


def _file_counts(spark, sf_dir):
    from cadence.plans import activity as act
    from cadence.plans.models import AS_OF, file_map

    counts = act.file_listen_counts(td.listens(spark, sf_dir), file_map(spark, sf_dir), td.files(spark, sf_dir), AS_OF)
    return stored(counts, "file-counts")


@register("knn_predicate_weights")
def knn_predicate_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listen-weighted seeds, candidates penalised by the owner's recent plays."""
    lib = td.files(spark, sf_dir)
    fc = _file_counts(spark, sf_dir)
    seeds = seed_weights_from_listens(td.playlist_seeds(spark, sf_dir), fc)
    cw = recency_candidate_weights(fc)
    cf = symmetrise(td.cf_scores(spark, sf_dir))
    return _knn_output(weighted_knn(lib, seeds, cf, cw))


def playlist_from_files(lib: DataFrame, seeds: DataFrame, cf: DataFrame, file_counts: DataFrame, *,
                        limit: int = 20, limit_per_artist: int = 2, seed_count: int = 1,
                        recency_fac: float = RECENCY_FAC, shuffle: str | None = None) -> DataFrame:
    """Seeds (``seed_count`` sampled by hash) first, then the greedy
    quota-limited nearest tracks; 0-based order_index per playlist.
    ``shuffle``: a seed to shuffle the tracks after the seeds by hash."""
    seeds = stored(seeds, "playlist-seeds")
    sw = seed_weights_from_listens(seeds, file_counts)
    cw = recency_candidate_weights(file_counts, recency_fac) if recency_fac > 0 else None
    # no cut before the quota: a near artist may fill any number of places
    near = weighted_knn(lib, sw, cf, cw, limit=None, quota=limit_per_artist, wanted=limit - seed_count)
    picked = greedy_quota(near, limit=limit - seed_count, quota=limit_per_artist,
                          seed_paths=seeds.select("playlist_id", "filepath"), out_col="_rank")
    ws = Window.partitionBy("playlist_id").orderBy(F.md5(F.concat("playlist_id", "filepath")), "filepath")
    chosen = (
        seeds.withColumn("_rn", F.row_number().over(ws))
        .where(F.col("_rn") <= seed_count)
        .join(lib.select("filepath", "recording_mbid", "release_mbid", "release_group_mbid", "artist_mbid",
                         F.coalesce("album_artist_mbid", "artist_mbid").alias("album_artist_mbid"),
                         F.floor("track_length_seconds").cast("int").alias("track_length_seconds")),
              "filepath")
        .select("playlist_id", "filepath", "recording_mbid", "release_mbid", "release_group_mbid",
                "artist_mbid", "album_artist_mbid", "track_length_seconds",
                F.lit(0.0).alias("match_distance"), F.lit(True).alias("is_seed"),
                (F.col("_rn") - 1).alias("_rank"))
    )
    if shuffle is not None:
        by = F.md5(F.concat_ws("|", F.lit(shuffle), "playlist_id", "filepath"))
        picked = picked.withColumn("_rank", F.row_number().over(Window.partitionBy("playlist_id").orderBy(by, "filepath")) - 1)
    rest = picked.select("playlist_id", "filepath", "recording_mbid", "release_mbid", "release_group_mbid",
                         "artist_mbid", "album_artist_mbid", "track_length_seconds",
                         F.col("distance").alias("match_distance"), F.lit(False).alias("is_seed"),
                         (F.col("_rank") + seed_count).alias("_rank"))
    w = Window.partitionBy("playlist_id").orderBy("_rank")
    return chosen.unionByName(rest).withColumn("order_index", F.row_number().over(w) - 1).drop("_rank")


def seeds_below(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(playlist_id, username, filepath): library files whose path starts with
    the ``prefix`` of a request (playlist_id, username, prefix). Paths are cut
    at the distinct lengths of the prefixes, so the join is on equality."""
    lengths = [r[0] for r in requests.select(F.length("prefix")).distinct().collect() if r[0] is not None]
    if not lengths:
        return requests.join(files, F.lit(False)).select("playlist_id", "username", "filepath")
    starts = F.array_distinct(F.array(*[F.substring("filepath", 1, n) for n in sorted(lengths)]))
    return files.select("filepath", F.explode(starts).alias("prefix")).join(requests, "prefix").select(
        "playlist_id", "username", "filepath").distinct()


@register("folder_seeds")
def folder_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder or path prefix per nation; some match nothing."""
    n = F.col("n_nationkey")
    requests = td.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("playlist_id"), F.concat(F.lit("u"), (n % 10).cast("string")).alias("username"),
        F.when(n % 3 == 0, F.concat(F.lit("lib/"), (n % 12).cast("string"), F.lit("/")))
        .when(n % 3 == 1, F.concat(F.lit("lib/"), (n % 10).cast("string"), F.lit("/0001")))
        .otherwise(F.lit("lib")).alias("prefix"))
    return seeds_below(requests, td.files(spark, sf_dir))


@register("playlist_greedy")
def playlist_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = td.files(spark, sf_dir)
    fc = _file_counts(spark, sf_dir)
    out = playlist_from_files(lib, td.playlist_seeds(spark, sf_dir), symmetrise(td.cf_scores(spark, sf_dir)), fc)
    return out.withColumn("match_distance", F.round("match_distance", 6))
