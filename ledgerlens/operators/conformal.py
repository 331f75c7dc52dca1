"""Split-conformal triage on calibrated probabilities.

Quantiles are exact order statistics, found from per-value counts and counts
below each value (``metrics.with_ranks``); neither the calibration set nor its
distinct values are gathered into one task.  Results are unrounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.metrics import with_ranks

BANDS = ("high_confidence_fraud", "high_confidence_legit", "review_needed")


def _value_counts(values: DataFrame, col: str) -> DataFrame:
    """(_v value, _c count, _below rows strictly below) over the whole column."""
    vc = values.groupBy((F.col(col) + 0.0).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    return with_ranks(vc, [], "_v", ["_c"]).withColumnRenamed("_c_below", "_below")


def _q_level(n: Column, alpha: float) -> Column:
    return F.least(F.lit(1.0), F.ceil((n + 1) * F.lit(1.0 - alpha)) / n)


def conformal_threshold(calib: DataFrame, alpha: float = 0.05, p: str = "score", y: str = "is_fraud") -> DataFrame:
    """One row ``(n, q_level, threshold)``: "higher" quantile of 1-p (fraud) / p (legit); 0.5 if empty."""
    s = calib.select(F.when(F.col(y) == 1, F.lit(1.0) - F.col(p)).otherwise(F.col(p)).alias("_s"))
    vc = _value_counts(s, "_s")
    n = vc.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n"))
    idx = F.ceil((F.col("n") - 1) * _q_level(F.col("n"), alpha))
    pick = (vc.crossJoin(n).filter((F.col("_below") <= idx) & (idx < F.col("_below") + F.col("_c")))
            .select(F.col("_v")))
    out = n.crossJoin(pick.agg(F.min("_v").alias("_v")))
    return out.select(
        F.col("n").cast("long").alias("n"),
        F.when(F.col("n") == 0, F.lit(None).cast("double")).otherwise(_q_level(F.col("n"), alpha)).alias("q_level"),
        F.when(F.col("n") == 0, F.lit(0.5)).otherwise(F.col("_v")).alias("threshold"))


def conformal_triage(df: DataFrame, threshold: DataFrame, p: str = "score") -> DataFrame:
    """Prediction sets -> band and confidence.  ``threshold`` is the one-row fit."""
    fraud = F.lit(1.0) - F.col(p) <= F.col("threshold")
    legit = F.col(p) <= F.col("threshold")
    band = (F.when(fraud & ~legit, "high_confidence_fraud").when(legit & ~fraud, "high_confidence_legit")
            .otherwise("review_needed"))
    conf = (F.when(band == "high_confidence_fraud", F.col(p)).when(band == "high_confidence_legit", F.lit(1.0) - F.col(p))
            .otherwise(F.lit(1.0) - F.abs(F.col(p) - 0.5) * 2.0))
    # The fit is a single row: broadcasting it is bounded by construction.
    return (df.crossJoin(F.broadcast(threshold.select("threshold")))
            .withColumns({"confidence_band": band, "confidence": conf}).drop("threshold"))


def conformal_interval_fit(calib: DataFrame, alpha: float = 0.05, p: str = "score", y: str = "is_fraud") -> DataFrame:
    """Variant: ``q_hat`` = linear-interpolated quantile of |p - y| (numpy default method)."""
    s = calib.select(F.abs(F.col(p) - F.col(y)).alias("_s"))
    vc = _value_counts(s, "_s")
    n = vc.agg(F.sum("_c").alias("n"))
    h = (F.col("n") - 1) * _q_level(F.col("n"), alpha)
    lo_i, hi_i = F.floor(h), F.least(F.floor(h) + 1, F.col("n") - 1)
    j = vc.crossJoin(n)
    at = lambda i: F.min(F.when((F.col("_below") <= i) & (i < F.col("_below") + F.col("_c")), F.col("_v")))
    agg = j.groupBy("n").agg(at(lo_i).alias("_lo"), at(hi_i).alias("_hi"), F.first(h).alias("_h"))
    lo, hi = F.col("_lo"), F.col("_hi")
    frac = F.col("_h") - F.floor(F.col("_h"))
    return agg.select(F.col("n").cast("long").alias("n"), (lo + (hi - lo) * frac).alias("q_hat"))


def conformal_interval(df: DataFrame, fit: DataFrame, p: str = "score") -> DataFrame:
    q = F.col("q_hat")
    low, high = F.col(p) - q, F.col(p) + q
    inc_f, inc_l = high > 0.5, low < 0.5
    band = (F.when(inc_f & ~inc_l, "high_confidence_fraud").when(inc_l & ~inc_f, "high_confidence_legit")
            .otherwise("review_needed"))
    return (df.crossJoin(F.broadcast(fit.select("q_hat")))
            .withColumns({"confidence_band": band,
                          "interval_low": F.greatest(F.lit(0.0), low),
                          "interval_high": F.least(F.lit(1.0), high)}).drop("q_hat"))


def conformal_metrics(bands: DataFrame, y: str = "is_fraud", band: str = "confidence_band") -> DataFrame:
    """Coverage, average set size (review = 2), review rate and band counts."""
    b, lab = F.col(band), F.col(y)
    covered = ((b.isin("high_confidence_fraud", "review_needed") & (lab == 1))
               | (b.isin("high_confidence_legit", "review_needed") & (lab == 0)))
    n = F.count(F.lit(1))
    return bands.agg(
        F.when(n > 0, F.count_if(covered) / n).otherwise(F.lit(0.0)).alias("empirical_coverage"),
        F.avg(F.when(b == "review_needed", 2).otherwise(1)).alias("average_set_size"),
        F.avg((b == "review_needed").cast("int")).alias("review_rate"),
        F.count_if(b == "high_confidence_fraud").alias("n_high_confidence_fraud"),
        F.count_if(b == "review_needed").alias("n_review_needed"),
        F.count_if(b == "high_confidence_legit").alias("n_high_confidence_legit"))


def band_breakdown(bands: DataFrame, band: str = "confidence_band") -> DataFrame:
    return bands.groupBy(F.col(band).alias("confidence_band")).agg(F.count(F.lit(1)).alias("n"))
