"""Play spikes: listens followed by many repeats of the same track within 24h.

The look-ahead count is no self join and no sliding frame (whose every row
costs a walk through its frame), but running counts over days of a key. The
open window (t, t+24h) of a listen on day d covers what follows it on day d and
what comes before t+24h on day d+1: the listen is counted on its own day, then
it visits the next one at t+24h, among that day's listens. No window partition
holds more than two days of one key, and each row costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.functions.scalars import MICROS_PER_DAY, micros

DEFAULT_MIN_COUNT = 5


def next_24h_counts(listens: DataFrame, keys=("username", "recording_mbid"),
                    ts: str = "listen_at_ts_utc") -> DataFrame:
    """Every listen with the number of same-key listens strictly inside
    (t, t + 24h)."""
    keys = list(keys)
    base = listens.where(F.col("recording_mbid").isNotNull()).withColumn("_us", micros(ts)).withColumn("_day", _day("_us"))
    day = Window.partitionBy(*keys, "_day")
    upto = day.orderBy("_us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = base.withColumn("_own", F.count("_us").over(day) - F.count("_us").over(upto))
    visits = _visits(own, keys, 1)
    before = day.orderBy("_us").rangeBetween(Window.unboundedPreceding, -1)
    # listens of unknown time are peers: each sees all of them, visits included
    counted = visits.withColumn("_next", F.count(F.when(~F.col("_visit") | F.col("_us").isNull(), 1)).over(before)).where("_visit")
    return counted.withColumn("next_24h_listen_count", F.col("_own") + F.col("_next")).select(
        *listens.columns, "next_24h_listen_count")


def _day(us: str):
    return F.floor(F.col(us) / F.lit(MICROS_PER_DAY)).cast("long")


def _visits(df: DataFrame, keys: list[str], days: int) -> DataFrame:
    """Each row twice: on its day (``_visit`` false; only what the windows need)
    and, whole, ``days`` days on."""
    slim = {c: F.when(F.col("_visit"), F.col(c)).alias(c) for c in df.columns if c not in (*keys, "_us", "_day", "next_24h_listen_count")}
    moved = df.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("_visit"))
    shift = F.when(F.col("_visit"), F.lit(days)).otherwise(F.lit(0)).cast("long")
    at = {"_us": (F.col("_us") + shift * MICROS_PER_DAY).alias("_us"), "_day": (F.col("_day") + shift).alias("_day")}
    return moved.select(*[at.get(c, slim.get(c, F.col(c))) for c in df.columns], "_visit")


def spike_candidates(listens: DataFrame, min_count: int = DEFAULT_MIN_COUNT) -> DataFrame:
    return next_24h_counts(listens).where(F.col("next_24h_listen_count") >= min_count)


def suppress_global(spikes: DataFrame, keys=("username", "recording_mbid"),
                    ts: str = "listen_at_ts_utc") -> DataFrame:
    """Keep the strongest spike per key (earliest on equal counts; exact ties
    keep all). Partial-aggregate the best (count, start) per key, then semi
    join on (key, count, start) so a hot key is spread by its values."""
    keys = list(keys)
    best = spikes.groupBy(*keys).agg(
        F.max(F.struct(F.col("next_24h_listen_count").alias("c"), (-micros(ts)).alias("t"))).alias("m")
    ).select(*keys, F.col("m.c").alias("_c"), (-F.col("m.t")).alias("_t"))
    s = spikes.withColumn("_t", micros(ts))
    return s.join(
        best,
        [*(s[k] == best[k] for k in keys), s["next_24h_listen_count"] == best["_c"], s["_t"] == best["_t"]],
        "left_semi",
    ).drop("_t")


def suppress_24h(spikes: DataFrame, keys=("username", "recording_mbid"),
                 ts: str = "listen_at_ts_utc") -> DataFrame:
    """Documented intent: drop a spike when a stronger one (or an equally
    strong, earlier one) of the same key starts less than 24h away."""
    keys = list(keys)
    c = F.col("next_24h_listen_count")
    s = spikes.withColumn("_us", micros(ts)).withColumn("_day", _day("_us"))
    day = Window.partitionBy(*keys, "_day")
    before = day.orderBy("_us").rangeBetween(Window.unboundedPreceding, -1)
    after = day.orderBy(F.desc("_us")).rangeBetween(Window.unboundedPreceding, -1)
    there = F.when(~F.col("_visit"), c)
    # less than 24h away are all spikes of the own day, those of the day before
    # that come after t-24h, and those of the day after that come before t+24h
    s = s.withColumns({"_own": F.max(c).over(day), "_first": F.max(c).over(before)})
    s = _visits(s, keys, -1).withColumn("_prev", F.max(there).over(after)).where("_visit").drop("_visit")
    s = s.withColumns({"_us": F.col("_us") + MICROS_PER_DAY, "_day": F.col("_day") + 1})
    s = _visits(s, keys, 1).withColumn("_next", F.max(there).over(before)).where("_visit")
    m1, m2 = F.greatest("_own", "_prev", "_next"), F.greatest("_first", "_prev")
    return s.where(~((m1 > c) | (F.coalesce(m2, F.lit(-1)) == c))).select(*spikes.columns)


def track_play_spikes(listens: DataFrame, min_count: int = DEFAULT_MIN_COUNT,
                      suppression: str = "global") -> DataFrame:
    cand = spike_candidates(listens, min_count)
    if suppression == "global":
        kept = suppress_global(cand)
    elif suppression == "24h":
        kept = suppress_24h(cand)
    else:
        raise ValueError("suppression must be 'global' or '24h'")
    return kept.select(
        F.col("listen_md5").alias("start_listen_md5"),
        "recording_mbid",
        "username",
        F.col("listen_at_ts_utc").alias("period_start_at_utc"),
        "next_24h_listen_count",
        "track_name",
        "release_name",
        "artist_name",
    )
