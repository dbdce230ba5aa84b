"""Keyed merges for tables without MERGE support (plain parquet).

Each returns the new version of the target as a DataFrame; keys are shuffled
once per merge. ``operators.tables`` has tables that change by commits, without
a rewrite of what is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _dedupe(df: DataFrame, key: list[str], order: list | None) -> DataFrame:
    """One row per key inside a batch (last by ``order`` wins)."""
    if not order:
        return df.dropDuplicates(key)
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def upsert(target: DataFrame, source: DataFrame, key: list[str], update_cols: list[str] | None = None,
           order: list | None = None) -> DataFrame:
    """Insert new keys; for existing keys overwrite only ``update_cols``
    (default: every non-key column)."""
    if not key:
        raise ValueError("upsert needs a key")
    cols = [c for c in target.columns if c not in key]
    upd = set(cols if update_cols is None else update_cols)
    s = _dedupe(source, key, order).select(*key, *[F.col(c).alias(f"_s_{c}") for c in cols], F.lit(True).alias("_s"))
    t = target.select(*key, *[F.col(c).alias(f"_t_{c}") for c in cols], F.lit(True).alias("_t"))
    j = t.join(s, key, "full_outer")
    out = []
    for c in cols:
        if c in upd:
            out.append(F.when(F.col("_s").isNotNull(), F.col(f"_s_{c}")).otherwise(F.col(f"_t_{c}")).alias(c))
        else:
            out.append(F.when(F.col("_t").isNotNull(), F.col(f"_t_{c}")).otherwise(F.col(f"_s_{c}")).alias(c))
    return j.select(*key, *out)


def insert_absent(target: DataFrame, source: DataFrame, key: list[str], order: list | None = None) -> DataFrame:
    """First writer wins: add only source keys the target lacks."""
    new = _dedupe(source, key, order).join(target.select(*key), key, "left_anti")
    return target.unionByName(new.select(*target.columns))


def replace_groups(target: DataFrame, source: DataFrame, group_cols: list[str],
                   groups: DataFrame | None = None) -> DataFrame:
    """Every group named in ``groups`` (default: the groups present in the
    source) is replaced by the source rows -- an empty source deletes it."""
    g = (groups if groups is not None else source).select(*group_cols).distinct()
    return target.join(g, group_cols, "left_anti").unionByName(source.select(*target.columns))


def incremental_merge(target: DataFrame | None, source: DataFrame, key: list[str], ts: str,
                      lookback_minutes: int = 5, tiebreak: list[str] = ()) -> DataFrame:
    """Take source rows newer than max(target ts) - lookback and replace
    them by key (latest ts per key wins, then ``tiebreak`` descending); an
    empty or absent target loads everything."""
    order = [ts, *tiebreak]
    if target is None:
        return _dedupe(source, key, order)
    mx = target.agg(F.max(ts).alias("m")).first()["m"]
    fresh = source if mx is None else source.where(F.col(ts) > F.lit(mx) - F.expr(f"INTERVAL {int(lookback_minutes)} MINUTES"))
    fresh = _dedupe(fresh, key, order)
    return target.join(fresh.select(*key), key, "left_anti").unionByName(fresh.select(*target.columns))


def update_column(target: DataFrame, updates: DataFrame, key: list[str], col: str) -> DataFrame:
    """Set one column for the listed keys (others unchanged)."""
    u = updates.select(*key, F.col(col).alias("_new"), F.lit(True).alias("_hit"))
    return target.join(u, key, "left").select(
        *[F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(c)).alias(c) if c == col else F.col(c)
          for c in target.columns]
    )


def retention(parents: DataFrame, children: DataFrame, key: str, ts: str, cutoff) -> tuple[DataFrame, DataFrame]:
    """Drop parents older than ``cutoff`` and their children."""
    kept = parents.where(F.col(ts) >= F.lit(cutoff))
    return kept, children.join(kept.select(key), key, "left_semi")
