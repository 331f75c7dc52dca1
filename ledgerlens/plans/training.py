"""Training / scoring compositions (Spark ML): the reference's train -> calibrate -> triage flow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import conformal as cf
from ledgerlens.operators import features as fx
from ledgerlens.operators import metrics as mt
from ledgerlens.operators import models as md
from ledgerlens.operators import splits as sp
from ledgerlens.sources.io import fresh_dir, written


@dataclass
class TrainResult:
    model: object
    calibrator: object
    threshold: DataFrame
    test_scored: DataFrame
    metrics: DataFrame
    model_type: str = "xgb_tabular"
    calibration: str = "isotonic"


def split_features(tx: DataFrame, time_split: bool = False) -> DataFrame:
    """Gold features of the whole frame, then the split (as the reference does)."""
    gold = written(fx.gold_features(tx), "gold")  # read by every split and fit
    return sp.chronological_split(gold) if time_split else sp.random_split(gold, seed=7)


def part(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("split") == name).drop("split")


def fit_model(model_type: str, train: DataFrame, feats: list[str]):
    if model_type == "xgb_tabular":
        return md.train_gbt(train, feats)
    if model_type == "graphsage_only":
        return md.train_sage_lr(train, feats)
    return md.train_hybrid(train, feats)


def score_split(model_type: str, model, frame: DataFrame, feats: list[str]) -> DataFrame:
    if model_type == "xgb_tabular":
        return md.score(model, frame)
    # graph models embed each split on its own graph (no edges across splits)
    emb = md.sage_embeddings(frame, feats)
    return md.score(model, frame.join(emb, "tx_id"))


def train_pipeline(tx: DataFrame, model_type: str = "xgb_tabular", calibration: str = "isotonic",
                   time_split: bool = False) -> TrainResult:
    """features -> split -> fit -> calibrate on validation -> conformal on validation -> test metrics."""
    feats = fx.FEATURE_MATRIX
    s = split_features(tx, time_split)
    train, valid, test = part(s, "train"), part(s, "validation"), part(s, "test")
    model = fit_model(model_type, train, feats)
    v_raw = written(score_split(model_type, model, valid, feats).select("is_fraud", "raw_score"), "calibration")  # fit and threshold read it
    t_raw = score_split(model_type, model, test, feats)
    cal = md.fit_platt(v_raw) if calibration == "platt" else md.fit_isotonic(v_raw)
    v_cal = md.calibrate(cal, v_raw)
    t_cal = md.calibrate(cal, t_raw)
    thr = written(cf.conformal_threshold(v_cal), "threshold")  # one row, read by every triage
    tri = written(cf.conformal_triage(t_cal, thr).drop("features"), "scored")  # read by every metric
    m = mt.all_metrics(tri).crossJoin(cf.conformal_metrics(tri).select("review_rate"))
    return TrainResult(model, cal, thr, tri, m, model_type, calibration)


def run_record(spark, res: TrainResult, run_id: str) -> DataFrame:
    """Save the fitted parts below the shared location, read the model again and return the run's one-row record."""
    from pyspark.ml import PipelineModel

    folder = fresh_dir(spark, "run")
    res.model.write().save(f"{folder}/model")
    again = PipelineModel.load(f"{folder}/model")
    if res.calibrator is not None:  # too few rows: scores stay as they are
        res.calibrator.write().save(f"{folder}/calibrator")
        res.calibrator = type(res.calibrator).load(f"{folder}/calibrator")
    return res.metrics.select(
        F.lit(run_id).alias("run_id"), F.lit(res.model_type).alias("model_type"), F.lit(res.calibration).alias("calibration"),
        F.lit(len(again.stages)).alias("model_stages"), F.lit(len(fx.FEATURE_MATRIX)).alias("n_features"), "*")
