"""Windowed streams in update mode: restarts, late rows, closed windows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cadence.operators.tables import Table
from cadence.streaming import listens as stl

SCHEMA = "listen_md5 string, username string, recording_mbid string, release_mbid string, duration_ms long, listen_at_ts_utc timestamp_ntz"


def feed(spark, source, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))


def test_counts_over_restarts(spark, tmp_path):
    """Listens in three runs, some late: the table always holds the counts of
    all listens so far, and state goes when its windows are over."""
    rng = random.Random(3)
    base = dt.datetime(2024, 3, 1)
    rows = [(f"m{i}", f"u{rng.randrange(2)}", rng.choice(["r", "s", None]), "l", 1000,
             base + dt.timedelta(hours=i * 0.7 + rng.random())) for i in range(150)]
    source, checkpoint, table, seen, mark = tmp_path / "in", str(tmp_path / "ck"), None, [], None
    for part in (rows[:60], rows[60:61], rows[61:]):
        feed(spark, source, part)
        seen += [r for r in part if r[2]]
        s = stl.next_24h_counts_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source)))
        table = table or Table.create(spark.createDataFrame([], s.schema), str(tmp_path / "t"))
        mark = stl.run_to_table(s, table, ["listen_md5"], checkpoint, "1 hour")
        day = dt.timedelta(days=1)
        want = {m: sum(u == v and r == q and t < w < t + day for _, v, q, _, _, w in seen) for m, u, r, _, _, t in seen}
        assert {r.listen_md5: r.next_24h_listen_count for r in table.read().collect()} == want
        newest = max(r[5] for r in seen if r in part) - dt.timedelta(hours=1)
        assert abs((mark - newest).total_seconds()) < 0.01 or mark >= newest
    assert mark > base + dt.timedelta(days=3)


def test_days_over_restarts(spark, tmp_path):
    base = dt.datetime(2024, 3, 1)
    rows = [(f"m{i}", "u", f"r{i % 3}", "l", 3_600_000, base + dt.timedelta(hours=5 * i)) for i in range(12)]
    source, checkpoint, table = tmp_path / "in", str(tmp_path / "ck"), None
    for part in (rows[:4], rows[4:]):
        feed(spark, source, part)
        s = stl.daily_listen_stats_stream(spark.readStream.schema(SCHEMA).parquet(str(source)))
        table = table or Table.create(spark.createDataFrame([], s.schema), str(tmp_path / "t"))
        stl.run_to_table(s, table, ["username", "listen_date"], checkpoint, "1 hour")
    got = {r.listen_date.day: (r.count_listens, r.count_recordings, r.sum_listen_hours) for r in table.read().collect()}
    assert got == {1: (5, 3, 5.0), 2: (5, 3, 5.0), 3: (2, 2, 2.0)}
    assert table.read().where(F.col("username") != "u").count() == 0
