"""Drift monitoring with an actual retraining: report, fitted model, registered run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import features as fx
from ledgerlens.operators import governance as gv
from ledgerlens.operators import models as md
from ledgerlens.operators.registry import ModelRegistry
from ledgerlens.operators.splits import chronological_split
from ledgerlens.sources.io import written

MODEL_TYPE = "xgb_tabular"


def stamp(prefix: str, time: str = "timestamp") -> Column:
    """An id from the data: ``prefix``, the latest time and the number of rows."""
    return F.concat(F.lit(f"{prefix}_"), F.date_format(F.max(time), "yyyyMMddHHmmss"), F.lit("_"), F.count(F.lit(1)).cast("string"))


def run_record(train: DataFrame, whole: DataFrame, model_type: str = MODEL_TYPE) -> DataFrame:
    """The registry's record of a model fitted on ``train``, a part of ``whole``: valid from the latest time of ``whole``."""
    ids = whole.agg(stamp(f"run_{model_type}").alias("run_id"), F.max("timestamp").alias("valid_from"))
    size = train.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("is_fraud").cast("long")).alias("positives"))
    return ids.crossJoin(size).select("run_id", F.lit(model_type).alias("model_type"), "valid_from", "rows", "positives")  # one row each


def retrain(gold: DataFrame, registry: ModelRegistry, max_iter: int = 120) -> str:
    """Fit boosted trees on the earliest 70 % of the rows (by time), save and register them; returns the run id."""
    train = chronological_split(gold).where(F.col("split") == "train").drop("split")
    train = written(train, "retrain")
    return registry.register(md.train_gbt(train, fx.FEATURE_MATRIX, max_iter=max_iter), run_record(train, gold))


def monitor(ref: DataFrame, cur: DataFrame, registry: ModelRegistry, threshold: float = 0.2, trigger_retrain: bool = False,
            max_iter: int = 120) -> DataFrame:
    """The drift report of current against reference gold features.

    Past the threshold, with ``trigger_retrain``, a model is trained on the current side and registered; the report
    names it, and otherwise the run that the registry has as its latest.  The report's id follows from the current rows.
    """
    score = written(gv.drift_score(gv.drift_features(ref, cur, fx.FEATURE_MATRIX), threshold=threshold), "drift-score")
    drifted = bool(score.first()["is_drift"])
    fitted = retrain(cur, registry, max_iter) if drifted and trigger_retrain else None
    rows = ref.agg(F.count(F.lit(1)).alias("reference_rows")).crossJoin(
        cur.agg(F.count(F.lit(1)).alias("current_rows"), stamp("drift").alias("report_id")))
    text = lambda v: F.lit(v).cast("string")
    return score.crossJoin(rows).select(  # one row each
        "report_id", text(fitted or registry.latest()).alias("run_id"), "drift_score", "is_drift", "threshold",
        F.lit(fitted is not None).alias("retrain_triggered"), text(fitted).alias("retrain_run_id"),
        F.lit("fallback_zscore").alias("detector"), F.lit(len(fx.FEATURE_MATRIX)).alias("n_features"), "reference_rows", "current_rows")
