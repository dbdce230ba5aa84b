"""Data-quality checks. Each returns the violating rows (empty = pass)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNull())


def unique(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keys occurring more than once, with their counts."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_records")).where(F.col("n_records") > 1)


def not_null_proportion(df: DataFrame, col: str, at_least: float) -> DataFrame:
    """One row (column, proportion) when the non-null share is below ``at_least``."""
    return (
        df.agg(F.avg(F.col(col).isNotNull().cast("double")).alias("proportion"))
        .select(F.lit(col).alias("column_name"), "proportion")
        .where(F.col("proportion") < at_least)
    )


def groupby_having(df: DataFrame, group: list[str], condition: Column) -> DataFrame:
    """Groups whose aggregate ``condition`` is false (e.g. count(*) == 1)."""
    return df.groupBy(*group).agg(condition.alias("_ok")).where(~F.col("_ok")).drop("_ok")


def orphans(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Foreign-key violations: child rows without a parent."""
    return child.join(parent.select(*key).distinct(), key, "left_anti")
