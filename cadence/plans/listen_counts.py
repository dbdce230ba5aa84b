"""Listen aggregates per user and entity (artist, recording, release,
release group) with rolling windows, recency and revisit scores.

Plan: the recency base is aggregated once to a fine grain
(user, recording, release, release group, artist list) -- a single shuffle
of the listens with map-side partial aggregation -- and every table is
derived from that grain. Windowed distinct counts use "latest listen of the
entity >= cutoff" on the grain instead of ``count(distinct case ...)``,
which would make Spark Expand every input row once per distinct aggregate.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.functions.scalars import (
    elapsed_days,
    inv_recency_pct,
    recency_pct,
    surrogate_key,
)

ALL_WINDOWS = (7, 14, 30, 60, 90, 120, 150)
ARTIST_WINDOWS = (14, 30, 60, 90)
RELEASE_WINDOWS = (14, 30, 60, 90)
RECORDING_WINDOWS = (14, 30, 60, 90, 120, 150)
RELEASE_GROUP_WINDOWS = (14, 30, 60, 90, 120, 150)


def cutoff(as_of: dt.datetime, days: int):
    return F.lit(as_of - dt.timedelta(days=days))


def recency_base(listens: DataFrame, releases: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Scored listens: inner join to releases for the release group; keep rows
    with recording, release and artist list present."""
    rel = releases.select("release_mbid", "release_group_mbid")
    days = elapsed_days(as_of, F.col("listen_at_ts_utc"))
    return (
        listens.where(
            F.col("recording_mbid").isNotNull()
            & F.col("release_mbid").isNotNull()
            & F.col("artist_mbids").isNotNull()
        )
        .join(rel, "release_mbid")
        .select(
            "username",
            "recording_mbid",
            "release_mbid",
            "release_group_mbid",
            "artist_mbids",
            "listen_at_ts_utc",
            days.alias("listen_recency_days"),
            recency_pct(days).alias("recency_pct"),
            inv_recency_pct(days).alias("inv_recency_pct"),
        )
    )


def listen_grain(base: DataFrame, as_of: dt.datetime, windows=ALL_WINDOWS) -> DataFrame:
    """One row per (user, recording, release, release group, artist list)."""
    ts = F.col("listen_at_ts_utc")
    return base.groupBy(
        "username", "recording_mbid", "release_mbid", "release_group_mbid", "artist_mbids"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(ts >= cutoff(as_of, d)).alias(f"n_{d}") for d in windows],
        F.sum("recency_pct").alias("s_recency"),
        F.sum(F.ln("inv_recency_pct")).alias("s_ln_inv"),
        F.min("listen_recency_days").alias("min_days"),
        F.sum("listen_recency_days").alias("sum_days"),
        F.max(ts).alias("max_ts"),
    )


def _entity_table(
    grain: DataFrame,
    entity: str,
    dim: DataFrame,
    dim_cols: list[str],
    windows,
    distinct_of: list[tuple[str, str]],
    key_name: str,
    as_of: dt.datetime,
) -> DataFrame:
    keys = ["username", entity]
    main = grain.groupBy(*keys).agg(
        F.min("min_days").alias("listen_recency_days"),
        F.round(F.sum("sum_days") / F.sum("n")).alias("avg_listen_recency_days"),
        F.round(F.sum("s_recency"), 5).alias("recency_score"),
        (F.exp(F.sum("s_ln_inv")) * F.log(F.sum("n") + F.lit(1))).alias("revisit_score"),
        F.sum("n").alias("lifetime_listen_count"),
        *[F.sum(f"n_{d}").alias(f"last{d}_listen_count") for d in windows],
    )
    cols = [
        "listen_recency_days",
        "avg_listen_recency_days",
        "recency_score",
        "revisit_score",
        "lifetime_listen_count",
    ]
    for col, label in distinct_of:
        cols.append(f"lifetime_{label}_count")
    for d in windows:
        cols.append(f"last{d}_listen_count")
        for col, label in distinct_of:
            cols.append(f"last{d}_{label}_count")
    if distinct_of:
        # all distinct counts in one pass: (kind of thing, thing) rows with the
        # latest listen, then counted by kind and cutoff
        things = F.explode(F.array(*[F.struct(F.lit(label).alias("kind"), F.col(col).alias("thing")) for col, label in distinct_of]))
        latest = (
            grain.select(*keys, "max_ts", things.alias("t"))
            .where(F.col("t.thing").isNotNull())
            .groupBy(*keys, F.col("t.kind").alias("kind"), F.col("t.thing").alias("thing"))
            .agg(F.max("max_ts").alias("mt"))
            .groupBy(*keys)
            .agg(*[
                F.count_if((F.col("kind") == label) & (F.lit(True) if d is None else F.col("mt") >= cutoff(as_of, d)))
                .alias(f"lifetime_{label}_count" if d is None else f"last{d}_{label}_count")
                for _, label in distinct_of for d in (None, *windows)
            ])
        )
        main = main.join(latest, keys, "left")
    for col, label in distinct_of:
        for c in [f"lifetime_{label}_count"] + [f"last{d}_{label}_count" for d in windows]:
            main = main.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    out = main.join(dim.select(entity, *dim_cols), entity)
    return out.select(
        surrogate_key("username", entity).alias(key_name),
        "username",
        entity,
        *dim_cols,
        *cols,
    )


def artist_listen_counts(grain: DataFrame, artists: DataFrame, as_of) -> DataFrame:
    """Per user x artist. A listen counts once per element of its artist list
    (duplicates count twice)."""
    g = grain.select("*", F.explode("artist_mbids").alias("artist_mbid"))
    return _entity_table(
        g, "artist_mbid", artists, ["artist_name"], ARTIST_WINDOWS,
        [("recording_mbid", "recording"), ("release_group_mbid", "release_group")],
        "user_artist_key", as_of,
    )


def recording_listen_counts(grain: DataFrame, recordings: DataFrame, as_of) -> DataFrame:
    return _entity_table(
        grain, "recording_mbid", recordings, ["recording_title", "artist_credit_phrase"],
        RECORDING_WINDOWS, [], "user_recording_key", as_of,
    )


def release_listen_counts(grain: DataFrame, releases: DataFrame, as_of) -> DataFrame:
    return _entity_table(
        grain, "release_mbid", releases, ["release_title", "artist_credit_phrase"],
        RELEASE_WINDOWS, [("recording_mbid", "recording")], "user_release_key", as_of,
    )


def release_group_listen_counts(grain: DataFrame, release_groups: DataFrame, as_of) -> DataFrame:
    return _entity_table(
        grain, "release_group_mbid", release_groups, ["release_group_title", "artist_credit_phrase"],
        RELEASE_GROUP_WINDOWS, [("recording_mbid", "recording")], "user_release_group_key", as_of,
    )
