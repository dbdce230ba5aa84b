"""Set operators: symmetrise, union-distinct maps, two-way differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symmetrise(pairs: DataFrame, a: str = "artist_mbid_a", b: str = "artist_mbid_b",
               value: str = "score_value") -> DataFrame:
    """(a, b) and (b, a) for a stored half; the diagonal appears once.
    One scan: each row explodes into itself plus its mirror."""
    both = F.when(
        F.col(a) == F.col(b),
        F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y"))),
    ).otherwise(
        F.array(
            F.struct(F.col(a).alias("x"), F.col(b).alias("y")),
            F.struct(F.col(b).alias("x"), F.col(a).alias("y")),
        )
    )
    return pairs.select(F.explode(both).alias("p"), value).select(
        F.col("p.x").alias(a), F.col("p.y").alias(b), value
    )


def union_distinct(frames: list[DataFrame]) -> DataFrame:
    """UNION DISTINCT by column name: one distinct after the union (the
    partial aggregate de-duplicates map-side)."""
    return reduce(lambda x, y: x.unionByName(y), frames).distinct()


def two_way_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(left - right, right - left) on key columns."""
    lk = left.select(*keys).distinct()
    rk = right.select(*keys).distinct()
    return lk.join(rk, keys, "left_anti"), rk.join(lk, keys, "left_anti")
