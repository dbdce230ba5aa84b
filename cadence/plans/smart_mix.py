"""Smart mixes: density clusters of a user's frequently played or loved
tracks, filtered to 3..8 artists, tightest first, described by their top
artists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.operators import clustering as cl
from cadence.session import stored

MIN_LISTENS = 2
MIN_TRACKS = 50
MAX_CLUSTERS = 15


def clusterable_tracks(file_counts: DataFrame, loved: DataFrame, files: DataFrame,
                       min_listens: int = MIN_LISTENS) -> DataFrame:
    """Frequently played (> min_listens) or loved files with an embedding
    longer than 60 s and an artist; the album artist stands for the track."""
    t = file_counts.where(F.col("lifetime_listen_count") > min_listens).select("username", "filepath").unionByName(
        loved.select("username", "filepath")).distinct()
    f = files.where(F.col("embedding_success") & (F.col("embedding_duration_seconds") > 60)
                    & F.col("artist_mbid").isNotNull()).select(
        "filepath", "track_name",
        F.coalesce("album_artist_name", "artist_name").alias("artist_name"),
        F.coalesce("album_artist_mbid", "artist_mbid").alias("artist_mbid"),
        "embedding")
    return t.join(f, "filepath")


def smart_mix_clusters(tracks: DataFrame, cf: DataFrame | None, max_clusters: int = MAX_CLUSTERS,
                       min_tracks: int = MIN_TRACKS) -> tuple[DataFrame, DataFrame]:
    """(membership, stats) of the kept clusters per user. Users with at most
    ``min_tracks`` tracks get none."""
    # the clustering makes several passes over the tracks: materialise them once
    tracks = stored(tracks, "tracks")
    n = tracks.groupBy("username").agg(F.count(F.lit(1)).alias("_n"))
    t = tracks.join(n.where(F.col("_n") > min_tracks).select("username"), "username")
    labels = stored(cl.hdbscan_labels(t, cf).where(F.col("label") >= 0), "labels")
    members = t.drop("embedding").join(labels, ["username", "filepath"])
    stats = members.groupBy("username", "label").agg(
        F.count(F.lit(1)).alias("n_tracks"), F.count_distinct("artist_mbid").alias("n_artists"))
    stats = stats.where((F.col("n_artists") > 2) & (F.col("n_artists") < 9))
    stats = stored(stats, "cluster-stats")
    # of the clusters that can be kept
    md = cl.cluster_mean_distance(t, labels.join(stats.select("username", "label"), ["username", "label"], "left_semi"), cf)
    w = Window.partitionBy("username").orderBy("mean_distance", "label")
    kept = stats.join(md, ["username", "label"]).withColumn("cluster_rank", F.row_number().over(w)).where(
        F.col("cluster_rank") <= max_clusters)
    per_artist = members.join(kept.select("username", "label"), ["username", "label"]).where(
        F.lower("artist_name") != "various artists").groupBy("username", "label", "artist_name").agg(
        F.count(F.lit(1)).alias("c"))
    wa = Window.partitionBy("username", "label").orderBy(F.desc("c"), "artist_name")
    desc = per_artist.withColumn("_r", F.row_number().over(wa)).where(F.col("_r") <= 5).groupBy("username", "label").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "artist_name"))), lambda x: x["artist_name"]),
                     ", ").alias("artists"))
    stats_out = kept.join(desc, ["username", "label"], "left").select(
        "username", "cluster_rank", "n_tracks", "n_artists", "mean_distance",
        F.concat(F.lit("Songs like: "), F.coalesce("artists", F.lit(""))).alias("description"),
        F.concat(F.lit("Smart Mix "), F.col("cluster_rank").cast("string")).alias("title"), "label")
    membership = members.join(kept.select("username", "label", "cluster_rank"), ["username", "label"]).select(
        "username", "cluster_rank", "filepath", "artist_mbid", "artist_name")
    return membership, stats_out


def smart_mix_playlists(membership: DataFrame, stats: DataFrame, files: DataFrame, cf: DataFrame | None,
                        file_counts: DataFrame, limit: int = 20, recency_fac: float = 0.5, shuffle: str = "0") -> DataFrame:
    """A playlist per kept cluster: its tracks seed the weighted search, one of
    them opens the playlist, the rest are similar tracks. Titles number the
    clusters that gave a playlist, the tightest first."""
    from cadence.plans.playlists import playlist_from_files

    # read by the search, the seeds and the titles: written once
    seeds = membership.select(
        F.concat_ws(":", "username", "cluster_rank").alias("playlist_id"), "username", "filepath").checkpoint()
    tracks = playlist_from_files(files, seeds, cf, file_counts, limit=limit, seed_count=1, recency_fac=recency_fac, shuffle=shuffle)
    titled = stats.select(F.concat_ws(":", "username", "cluster_rank").alias("playlist_id"), "username", "cluster_rank", "description")
    w = Window.partitionBy("username").orderBy("cluster_rank")
    titled = titled.join(tracks.select("playlist_id").distinct(), "playlist_id", "left_semi").withColumn(
        "title", F.concat(F.lit("Smart Mix "), F.row_number().over(w).cast("string")))
    return tracks.join(titled.select("playlist_id", "username", "title", "description"), "playlist_id")
