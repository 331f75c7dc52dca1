"""Drift monitoring: a model is trained when the score passes, saved, registered and usable."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import features as fx
from ledgerlens.operators import models as md
from ledgerlens.operators.registry import ModelRegistry
from ledgerlens.plans.monitoring import monitor


def _gold(spark, seed, shift=0.0, rows=120):
    dice = random.Random(seed)
    data = [(f"t{i}", int(dice.random() < 0.3), dt.datetime(2024, 1, 1 + seed) + dt.timedelta(minutes=i),
             *[dice.random() + shift for _ in fx.FEATURE_MATRIX]) for i in range(rows)]
    return spark.createDataFrame(data, "tx_id string, is_fraud int, timestamp timestamp_ntz, " + ", ".join(f"{c} double" for c in fx.FEATURE_MATRIX))


def test_retraining_saves_a_model_that_loads(spark, tmp_path):
    registry = ModelRegistry(spark, f"{tmp_path}/registry")
    ref, cur = _gold(spark, 1), _gold(spark, 2, shift=1.0)
    row = monitor(ref, cur, registry, trigger_retrain=True, max_iter=2).first()
    assert row.is_drift and row.retrain_triggered and row.retrain_run_id == row.run_id == registry.latest()
    record = registry.runs().collect()
    assert len(record) == 1 and record[0].rows == 84 and record[0].valid_from == cur.agg(F.max("timestamp")).first()[0]
    scored = md.score(registry.load(row.run_id), cur).select("raw_score").collect()
    assert len(scored) == 120 and all(0 <= r.raw_score <= 1 for r in scored) and len({r.raw_score for r in scored}) > 1
    again = monitor(ref, cur, registry, trigger_retrain=True, max_iter=2).first()
    assert again.retrain_run_id == row.run_id and registry.runs().count() == 1  # the same data: the same run, replaced
    with pytest.raises(KeyError):
        registry.load("run_none")


def test_no_drift_no_training(spark, tmp_path):
    registry = ModelRegistry(spark, f"{tmp_path}/registry")
    ref = _gold(spark, 1)
    row = monitor(ref, _gold(spark, 2), registry, trigger_retrain=True).first()
    assert not row.is_drift and not row.retrain_triggered and row.run_id is None and row.retrain_run_id is None
    row = monitor(ref, _gold(spark, 2, shift=1.0), registry, trigger_retrain=False).first()
    assert row.is_drift and not row.retrain_triggered and registry.latest() is None


def test_the_run_valid_at_a_time(spark, tmp_path):
    registry = ModelRegistry(spark, f"{tmp_path}/registry")
    for seed in (1, 5):
        cur = _gold(spark, seed, shift=float(seed))
        monitor(_gold(spark, 0), cur, registry, trigger_retrain=True, max_iter=1)
    runs = {r.valid_from: r.run_id for r in registry.runs().collect()}
    assert len(runs) == 2
    at = sorted(runs)
    rows = spark.createDataFrame([(i, "xgb_tabular", t) for i, t in enumerate([at[0] - dt.timedelta(1), at[0], at[1] - dt.timedelta(seconds=1), at[1]])],
                                 "id int, model_type string, at timestamp_ntz")
    got = {r.id: r.run_id for r in registry.valid_at(rows, "model_type", "at").collect()}
    assert got == {0: None, 1: runs[at[0]], 2: runs[at[0]], 3: runs[at[1]]}
