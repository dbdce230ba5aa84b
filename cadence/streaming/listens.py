"""Structured Streaming variants of the listen models.

Sources are file streams. Deduplication appends to a parquet sink; the models
with windows run in update mode into a table of commits
(``operators.tables``): every micro-batch puts the windows it touched in the
place of their former rows, so the table is complete at any time, open windows
included, and nothing but the stream is read. ``run_to_table`` returns the
watermark, which tells the closed windows from the open ones; a batch that a
restart delivers again is passed over.

A job that names its folder resumes where the last run stopped; the registered
queries start anew in fresh folders below ``spark.checkpoint.dir``.
``availableNow`` drains what is there and stops (the polling daemon becomes a
scheduled trigger).
"""

from __future__ import annotations

import datetime as dt
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from cadence.operators.tables import Table
from cadence.session import join_path, scratch_path

#: Batches after which a table of commits is written as one.
COMPACT_EVERY = 50
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_parquet(df: DataFrame, name: str, output_mode: str = "append", path: str | None = None) -> str:
    """Drain a streaming frame into a parquet sink; returns the sink path."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    q = (
        df.writeStream.format("parquet")
        .option("path", join_path(path, "data"))
        .option("checkpointLocation", join_path(path, "_checkpoint"))
        .outputMode(output_mode)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return join_path(path, "data")


def run_to_table(df: DataFrame, table: Table, keys: list[str], checkpoint: str, lateness: str) -> dt.datetime | None:
    """Drain a streaming frame in update mode into ``table``, rows by ``keys``.
    Returns the watermark after the last batch (None if there was no row)."""

    def apply(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            table.replace(batch, keys, batch=number)
        if number % COMPACT_EVERY == COMPACT_EVERY - 1:
            table.compact()

    q = df.writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    marks = [p["eventTime"] for p in q.recentProgress if p["eventTime"]]
    late = pd.Timedelta(lateness)
    times = [pd.Timestamp(m["max"]) - late for m in marks if "max" in m] + [pd.Timestamp(m["watermark"]) for m in marks if "watermark" in m]
    return max(times).tz_localize(None).to_pydatetime() if times else None


def daily_listen_stats_stream(listens: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Per (user, UTC day) tumbling window: listens, distinct recordings and
    releases, hours; late listens within ``lateness`` still count."""
    ts = F.col("listen_at_ts_utc").cast("timestamp")
    return (
        listens.withColumn("_ts", ts)
        .withWatermark("_ts", lateness)
        .groupBy("username", F.window("_ts", "1 day"))
        .agg(
            F.count(F.lit(1)).alias("count_listens"),
            F.size(F.collect_set("recording_mbid")).cast("long").alias("count_recordings"),
            F.size(F.collect_set("release_mbid")).cast("long").alias("count_releases"),
            (F.sum("duration_ms") / F.lit(3_600_000.0)).alias("sum_listen_hours"),
        )
        .select("username", F.to_date(F.col("window.start")).alias("listen_date"), "count_listens",
                "count_recordings", "count_releases", "sum_listen_hours")
    )


def dedupe_listens_stream(listens: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Re-delivered listens (same listen_md5) are dropped while within the
    watermark; state for a key is released once the watermark passes."""
    return (
        listens.withColumn("_ts", F.col("listen_at_ts_utc").cast("timestamp"))
        .withWatermark("_ts", lateness)
        .dropDuplicatesWithinWatermark(["listen_md5"])
        .drop("_ts")
    )


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


DAY_MS = 24 * 3600 * 1000


def _told(md5s: list, user: str, recording: str, us: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    texts = pd.DataFrame({"listen_md5": md5s, "username": [user] * len(md5s), "recording_mbid": [recording] * len(md5s)}, dtype=object)
    return texts.assign(listen_at_ts_utc=pd.to_datetime(us, unit="us"), next_24h_listen_count=counts.astype(np.int64))


class NextDayCounts(StatefulProcessor):
    """Listens of one (user, recording, day) and of the day after: state is a
    list that only grows, and goes by a timer when no window is open."""

    def init(self, handle) -> None:
        self.handle = handle
        self.listens = handle.getListState("listens", "listen_md5 string, us long, probe boolean")

    def handleInputRows(self, key, rows, timerValues):
        user, recording, bucket = key
        fresh = [r for pdf in rows for r in pdf[["listen_md5", "us", "probe"]].itertuples(index=False, name=None)]
        fresh = [(m, int(us), bool(p)) for m, us, p in fresh]
        held = [tuple(x) for x in self.listens.get()] if self.listens.exists() else []
        self.listens.appendList(fresh)
        self.handle.registerTimer((bucket + 2) * DAY_MS)
        every = held + fresh
        times = np.sort(np.array([us for _, us, _ in every], dtype=np.int64))
        probes = [(m, us) for m, us, p in every if p]
        us = np.array([u for _, u in probes], dtype=np.int64)
        counts = np.searchsorted(times, us + DAY_MS * 1000, "left") - np.searchsorted(times, us, "right")
        if probes:
            yield _told([m for m, _ in probes], user, recording, us, counts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.listens.clear()
        return iter(())

    def close(self) -> None:
        pass


def next_24h_counts_stream(listens: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Per listen the number of same (user, recording) listens strictly inside
    (t, t + 24h), told again whenever it may have changed. A listen is counted
    in its own day's state and, as a target only, in the day before, so a hot
    key is spread over its days."""
    listens.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ts = F.col("listen_at_ts_utc").cast("timestamp")
    day = F.floor(F.unix_millis("_ts") / DAY_MS).cast("long")
    places = F.explode(F.array(F.struct(day.alias("bucket"), F.lit(True).alias("probe")), F.struct((day - 1).alias("bucket"), F.lit(False).alias("probe"))))
    return (
        listens.where(F.col("recording_mbid").isNotNull())
        .withColumn("_ts", ts)
        .withWatermark("_ts", lateness)
        .select("username", "recording_mbid", "listen_md5", "_ts", F.unix_micros("_ts").alias("us"), places.alias("p"))
        .select("username", "recording_mbid", "p.bucket", "listen_md5", "_ts", "us", "p.probe")
        .groupBy("username", "recording_mbid", "bucket")
        .transformWithStateInPandas(
            NextDayCounts(), "listen_md5 string, username string, recording_mbid string, listen_at_ts_utc timestamp, next_24h_listen_count long",
            "Update", "eventTime")
    )
