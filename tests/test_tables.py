"""Tables that change by commits, and streams merged into them."""

import pytest
from pyspark.sql import functions as F

from cadence.operators import tables as tb

SCHEMA = "k string, g int, v int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_commits_and_versions(spark, tmp_path):
    make = lambda r: spark.createDataFrame(r, SCHEMA)
    t = tb.Table.create(make([("a", 1, 1), ("b", 1, 2), ("c", 2, 3), (None, None, 4)]), str(tmp_path / "t"), ["g"])
    t.append(make([("d", 2, 5)]))
    t.replace(make([("b", 1, 9)]), ["g"])  # the group, not the key
    t.replace(make([(None, 3, 7), ("c", 2, 8)]), ["k"])
    t.replace(make([]), ["g"], groups=spark.createDataFrame([(2,), (99,)], "g int"))  # deletes
    got = [[(r.k, r.g, r.v) for r in t.read(v).collect()] for v in range(5)]
    want = [
        {("a", 1, 1), ("b", 1, 2), ("c", 2, 3), (None, None, 4)},
        {("a", 1, 1), ("b", 1, 2), ("c", 2, 3), (None, None, 4), ("d", 2, 5)},
        {("b", 1, 9), ("c", 2, 3), (None, None, 4), ("d", 2, 5)},
        {("b", 1, 9), ("d", 2, 5), (None, 3, 7), ("c", 2, 8)},
        {("b", 1, 9), (None, 3, 7)},
    ]
    assert [set(g) for g in got] == want and [len(g) for g in got] == [len(w) for w in want]
    t.compact()
    assert rows(t.read()) == rows(t.read(4)) and t.version() == 5
    assert len(tb.Table(spark, t.path).log()) == 6
    with pytest.raises(ValueError, match="no version 9"):
        t.read(9)


def test_a_batch_counts_once_and_a_failed_commit_not_at_all(spark, tmp_path):
    t = tb.Table.create(spark.createDataFrame([("a", 1, 1)], SCHEMA), str(tmp_path / "t"))
    more = spark.createDataFrame([("b", 1, 1)], SCHEMA)
    assert t.append(more, batch=0) and not t.append(more, batch=0) and t.append(more, batch=1)
    broken = more.withColumn("v", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        t.append(broken, batch=2)
    assert t.version() == 2 and t.read().count() == 3
    assert t.append(more, batch=2)
    with pytest.raises(Exception, match="(?i)already.exists"):
        t._commit(3, "append", more, [], None, None)


def test_stream_restarts(spark, tmp_path):
    """Three files, a restart after each, one delivered again from scratch."""
    source, checkpoint = tmp_path / "in", str(tmp_path / "ck")
    t = tb.Table.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "t"))
    files = [[("a", 1, 1), ("a", 2, 2), ("b", 1, 5)], [("a", 1, 0), ("c", 1, 1)], [("b", 9, 6), ("a", 2, 7)]]

    def stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))

    for f in files:
        spark.createDataFrame(f, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        tb.merge_stream(stream(), t, ["k"], ["g", "v"], checkpoint)
    assert rows(t.read()) == [("a", 2, 7), ("b", 9, 6), ("c", 1, 1)] and t.version() == 3
    tb.merge_stream(stream(), t, ["k"], ["g", "v"], checkpoint)
    tb.merge_stream(stream(), t, ["k"], ["g", "v"], str(tmp_path / "other"))
    assert rows(t.read()) == [("a", 2, 7), ("b", 9, 6), ("c", 1, 1)] and t.version() == 3
