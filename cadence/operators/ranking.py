"""Positions in long ordered lists.

``row_number`` over a group sorts the whole group in one task. Here rows are
dealt by ranges of (group, order), numbered within their range, and shifted by
the rows of the group in the ranges before: one hot group is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.session import checkpoint_dir


def number_rows(df: DataFrame, by: str, order: list[Column], out_col: str = "order_index", ranges: int | None = None) -> DataFrame:
    """``df`` with the 0-based position of each row in its group. ``order``
    must tell the rows of a group apart for the positions to be fixed."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written once: the ranges must be the same for the counts and the numbers
    dealt = df.repartitionByRange(n, F.col(by), *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    shifts = sizes.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = Window.partitionBy("_range", by).orderBy(*order)
    numbered = dealt.withColumn("_nth", F.row_number().over(own) - 1)
    same = numbered[by].eqNullSafe(shifts["_by"]) & (numbered["_range"] == shifts["_r"])
    return numbered.join(shifts, same).select(*df.columns, (F.col("_nth") + F.col("_shift")).cast("int").alias(out_col))


def append_rows(stored: DataFrame, new: DataFrame, by: str, order: list[Column], out_col: str = "order_index") -> DataFrame:
    """``stored`` and, behind the last position of each group, ``new``."""
    last = stored.groupBy(F.col(by).alias("_by")).agg((F.max(out_col) + 1).alias("_next"))
    more = number_rows(new, by, order, out_col)
    more = more.join(last, more[by].eqNullSafe(last["_by"]), "left").withColumn(
        out_col, (F.col(out_col) + F.coalesce("_next", F.lit(0))).cast("int"))
    return stored.unionByName(more.select(*stored.columns))
