"""Distribution statistics (exact percentiles)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cf_baseline(cf: DataFrame) -> DataFrame:
    """Per artist a: min / median / mean / max / count of exp(score) over its
    pairs; then the quartiles of those medians and the baseline
    ln(median of medians), attached as constant columns."""
    e = F.exp("score_value")
    per = cf.groupBy("artist_mbid_a").agg(
        F.min(e).alias("min_score"),
        F.percentile(e, 0.5).alias("median_score"),
        F.avg(e).alias("avg_score"),
        F.max(e).alias("max_score"),
        F.count(F.lit(1)).alias("n"),
    )
    q = per.agg(
        F.percentile("median_score", 0.25).alias("q1"),
        F.percentile("median_score", 0.5).alias("q2"),
        F.percentile("median_score", 0.75).alias("q3"),
    ).first()
    if q["q2"] is None:
        base = None
    else:
        base = math.log(q["q2"]) if q["q2"] > 0 else None
    return per.select(
        "*",
        F.lit(q["q1"]).cast("double").alias("median_q1"),
        F.lit(q["q2"]).cast("double").alias("median_q2"),
        F.lit(q["q3"]).cast("double").alias("median_q3"),
        F.lit(base).cast("double").alias("baseline"),
    )


# The scalars whose multiplier curves are compared.
CALIBRATION_SCALARS = [0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0]


def cf_calibration_grid(cf: DataFrame, step: float = 0.01, scalars=CALIBRATION_SCALARS) -> DataFrame:
    """Multiplier curves exp(s * (similarity - baseline)) over the observed
    score range (min .. max, ``step`` apart) for each candidate scalar; the
    baseline is ln(median of per-artist median exp(score))."""
    base = cf_baseline(cf).select("baseline").limit(1)
    rng = cf.agg(F.min("score_value").alias("lb"), F.max("score_value").alias("ub"))
    n = F.ceil((F.col("ub") - F.col("lb")) / F.lit(step)).cast("int")
    b = base.first()
    baseline = b["baseline"] if b else None
    sims = rng.select(F.explode(F.sequence(F.lit(0), n - 1)).alias("i"), "lb").select(
        (F.col("lb") + F.col("i") * F.lit(step)).alias("similarity"))
    sc = F.explode(F.array(*[F.lit(float(s)) for s in scalars])).alias("scalar")
    return sims.select("similarity", sc).select(
        "similarity", "scalar",
        F.exp(F.col("scalar") * (F.col("similarity") - F.lit(baseline))).alias("multiplier"))
