"""Priority merge of ordered candidate lists (first list wins per key)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def priority_merge(lists: list[tuple[str, DataFrame, Column]], key: str, n: int | None = None) -> DataFrame:
    """lists: (source name, frame, order-within-list column). Rows are
    de-duplicated by ``key`` keeping the earliest list (then the earliest
    position); the result is ordered by (list, position) and cut at ``n``.
    The de-duplication is a partial aggregate (min of a struct), so a key
    repeated across lists never gathers in one place."""
    parts = []
    for prio, (name, df, order) in enumerate(lists):
        parts.append(df.select("*", F.lit(prio).alias("_prio"), order.alias("_ord"), F.lit(name).alias("source")))
    u = reduce(lambda a, b: a.unionByName(b), parts)
    cols = [c for c in u.columns if c not in (key, "_prio", "_ord")]
    best = u.groupBy(key).agg(F.min(F.struct("_prio", "_ord", *cols)).alias("b"))
    out = best.select(key, *[F.col(f"b.{c}").alias(c) for c in ["_prio", "_ord", *cols]])
    out = out.orderBy("_prio", "_ord", key)
    if n is not None:
        out = out.limit(n)
    return out.drop("_ord")
