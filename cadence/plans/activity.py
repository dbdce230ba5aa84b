"""Listening-activity models: per-file counts, daily stats, spikes, loves,
unmapped listens and revisit candidates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.functions.scalars import (
    elapsed_days,
    inv_recency_pct,
    recency_pct,
    surrogate_key,
)
from cadence.plans.listen_counts import cutoff

FILE_WINDOWS = (7, 30, 90)


def _per_user_recording(listens: DataFrame, as_of: dt.datetime, windows=FILE_WINDOWS) -> DataFrame:
    """Pre-aggregate listens to (user, recording) before they meet the file
    map: a listen that maps to k files counts 1/k on each, so every sum
    factorises through this grain."""
    ts = F.col("listen_at_ts_utc")
    days = elapsed_days(as_of, ts)
    return (
        listens.where(F.col("recording_mbid").isNotNull())
        .groupBy("username", "recording_mbid")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(ts >= cutoff(as_of, d)).alias(f"n_{d}") for d in windows],
            F.sum(recency_pct(days)).alias("s_recency"),
            F.sum(F.ln(inv_recency_pct(days))).alias("s_ln_inv"),
            F.max(ts).alias("last_listen"),
        )
    )


def _files_per_recording(file_map: DataFrame) -> DataFrame:
    return file_map.groupBy("recording_mbid").agg(F.count(F.lit(1)).alias("k"))


def file_listen_counts(listens: DataFrame, file_map: DataFrame, files: DataFrame,
                       as_of: dt.datetime) -> DataFrame:
    """Per (filepath, user): fractional listen counts (lifetime, 7/30/90 days),
    recency and revisit scores."""
    pu = _per_user_recording(listens, as_of)
    fm = file_map.join(_files_per_recording(file_map), "recording_mbid")
    j = pu.join(fm, "recording_mbid")
    frac = lambda c: F.sum(F.col(c) / F.col("k"))
    agg = j.groupBy("filepath", "username").agg(
        frac("n").alias("lifetime_listen_count"),
        frac("n_7").alias("last07_listen_count"),
        frac("n_30").alias("last30_listen_count"),
        frac("n_90").alias("last90_listen_count"),
        F.round(F.sum("s_recency"), 5).alias("recency_score"),
        (F.exp(F.sum("s_ln_inv")) * F.log(F.sum("n") + F.lit(1))).alias("revisit_score"),
    )
    names = files.select("filepath", "track_name", "album_name", "artist_name", "album_artist_name")
    return agg.join(names, "filepath").select(
        surrogate_key("filepath", "username").alias("filepath_username_id"),
        "filepath",
        "username",
        "track_name",
        "album_name",
        "artist_name",
        "album_artist_name",
        "lifetime_listen_count",
        "last07_listen_count",
        "last30_listen_count",
        "last90_listen_count",
        "recency_score",
        "revisit_score",
    )


def file_play_rollup(listens: DataFrame, file_map: DataFrame) -> DataFrame:
    """Per file over all users: rounded fractional play count (> 0 only) and
    the last listen time."""
    pu = (
        listens.where(F.col("recording_mbid").isNotNull())
        .groupBy("recording_mbid")
        .agg(F.count(F.lit(1)).alias("n"), F.max("listen_at_ts_utc").alias("last_listen"))
    )
    fm = file_map.join(_files_per_recording(file_map), "recording_mbid")
    return (
        pu.join(fm, "recording_mbid")
        .groupBy("filepath")
        .agg(
            F.round(F.sum(F.col("n") / F.col("k"))).cast("int").alias("listen_count"),
            F.max("last_listen").alias("last_listen"),
        )
        .where(F.col("listen_count") > 0)
    )


def daily_user_listen_stats(listens: DataFrame, file_map: DataFrame, as_of: dt.datetime,
                            days: int = 90) -> DataFrame:
    """Per (user, date) for the last ``days`` days: listens, distinct
    recordings and releases, hours, share of listens mapped to a file.
    listen_md5 is the listens key, so distinct listens are plain counts."""
    start = (as_of - dt.timedelta(days=days)).date()
    d = F.to_date("listen_at_ts_utc")
    # one aggregate of the last days serves counts, distinct counts and share
    per = (
        listens.where(d >= F.lit(start))
        .groupBy("username", d.alias("listen_date"), "recording_mbid", "release_mbid")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("ms"))
    )
    mapped = file_map.select("recording_mbid").distinct().withColumn("_mapped", F.lit(True))
    known = F.when(F.col("recording_mbid").isNotNull(), F.col("n"))
    counts = per.join(mapped, "recording_mbid", "left").groupBy("username", "listen_date").agg(
        F.sum("n").alias("count_listens"),
        F.count_distinct("recording_mbid").alias("count_recordings"),
        F.count_distinct("release_mbid").alias("count_releases"),
        (F.sum("ms") / F.lit(3_600_000.0)).alias("sum_listen_hours"),
        (F.coalesce(F.sum(F.when(F.col("_mapped"), F.col("n"))), F.lit(0)) / F.sum(known)).alias("pct_listens_mapped_to_file"),
    )
    return counts.select(
        surrogate_key("username", "listen_date").alias("user_date_key"),
        "username",
        "listen_date",
        "count_listens",
        "count_recordings",
        "count_releases",
        "sum_listen_hours",
        F.coalesce("pct_listens_mapped_to_file", F.lit(0.0)).alias("pct_listens_mapped_to_file"),
    )


def loved_tracks(feedback: DataFrame, spikes: DataFrame, file_map: DataFrame) -> DataFrame:
    """Explicit loves plus play spikes, mapped to files, per (user, file). Of a
    user's loves of one recording only the first counts, so the others go
    before the recording meets its files."""
    loves = feedback.select("username", "recording_mbid", F.col("feedback_at").alias("love_at")).unionByName(
        spikes.select("username", "recording_mbid", F.col("period_start_at_utc").alias("love_at"))
    )
    loves = loves.where(F.col("recording_mbid").isNotNull()).groupBy("username", "recording_mbid").agg(F.min("love_at").alias("love_at"))
    return (
        loves.join(file_map, "recording_mbid")
        .groupBy("username", "filepath")
        .agg(
            F.sort_array(F.collect_set("recording_mbid")).alias("recording_mbids"),
            F.min("love_at").alias("love_at"),
        )
    )


def unmapped_listens(listens: DataFrame, file_map: DataFrame, as_of: dt.datetime,
                     days: int = 14) -> DataFrame:
    """Recent listens whose recording maps to no file."""
    start = as_of - dt.timedelta(days=days)
    return (
        listens.where(F.col("recording_mbid").isNotNull() & (F.col("listen_at_ts_utc") > F.lit(start)))
        .join(file_map.select("recording_mbid").distinct(), "recording_mbid", "left_anti")
    )


def revisit_releases(rg_counts: DataFrame) -> DataFrame:
    old = F.col("last150_listen_count") - F.col("last90_listen_count")
    n = F.col("lifetime_recording_count")
    return rg_counts.where(
        n.between(4, 20)
        & (F.col("last30_listen_count") < 5)
        & (old >= 5)
        & (old >= n * 1.5)
        & (F.col("revisit_score") > 1.05)
    ).select(
        "release_group_mbid",
        "release_group_title",
        F.col("artist_credit_phrase").alias("artist_name"),
        "username",
        "revisit_score",
        n.alias("num_recordings"),
        old.alias("listens_old"),
        F.col("last90_listen_count").alias("listens_recent"),
    )


def revisit_tracks(rec_counts: DataFrame, file_map: DataFrame, files: DataFrame) -> DataFrame:
    """Revisit-worthy recordings, one library file each (smallest md5 path)."""
    old = F.col("last150_listen_count") - F.col("last90_listen_count")
    recs = rec_counts.where(
        (F.col("last90_listen_count") <= 2)
        & (F.col("last14_listen_count") == 0)
        & (old >= 2)
        & (F.col("revisit_score") > 1.05)
    ).select(
        "recording_mbid",
        "recording_title",
        F.col("artist_credit_phrase").alias("artist_name"),
        "username",
        "revisit_score",
        old.alias("listens_old"),
        F.col("last90_listen_count").alias("listens_recent"),
    )
    lf = files.where(F.col("artist_mbid").isNotNull()).select("filepath", "artist_mbid", "album_artist_mbid")
    j = recs.join(file_map, "recording_mbid").join(lf, "filepath")
    w = Window.partitionBy("recording_mbid", "username").orderBy(F.md5("filepath"), "filepath")
    return (
        j.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") == 1)
        .select(
            "recording_mbid",
            "username",
            "filepath",
            "recording_title",
            "artist_name",
            "artist_mbid",
            "album_artist_mbid",
            "revisit_score",
            "listens_old",
            "listens_recent",
        )
    )
