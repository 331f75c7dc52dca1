"""Spark ML paths, federated averaging and the shared-folder rule on small frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import models as md
from ledgerlens.session import ensure_checkpoint_dir


def _frame(spark, n=200, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0.5).astype(int)
    rows = [(f"t{i}", int(y[i]), "ab"[i % 2], *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "tx_id string, is_fraud int, channel string, f0 double, f1 double, f2 double")


def test_gbt_scores_are_probabilities_and_stable(spark):
    df, feats = _frame(spark), ["f0", "f1", "f2"]
    a, b = (md.score(md.train_gbt(df, feats, max_iter=5), df).orderBy("tx_id").collect() for _ in range(2))
    assert all(0 <= r.raw_score <= 1 for r in a) and [r.raw_score for r in a] == [r.raw_score for r in b]
    pos, neg = ([r.raw_score for r in a if r.is_fraud == k] for k in (1, 0))
    assert np.mean(pos) > np.mean(neg) + 0.3


@pytest.mark.parametrize("method", ["platt", "isotonic"])
def test_calibration_is_monotone_and_bounded(spark, method):
    rng = np.random.default_rng(2)
    raw = rng.random(300)
    rows = [(f"t{i}", int(rng.random() < raw[i] ** 2), float(raw[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "tx_id string, is_fraud int, raw_score double")
    cal = md.fit_platt(df) if method == "platt" else md.fit_isotonic(df)
    out = [(r.raw_score, r.score) for r in md.calibrate(cal, df).orderBy("raw_score").collect()]
    assert all(0 <= s <= 1 for _, s in out) and all(b[1] >= a[1] - 1e-12 for a, b in zip(out, out[1:]))


def test_fedavg_equals_plain_loop(spark):
    df, feats = _frame(spark), ["f0", "f1", "f2"]
    (xs,) = md.scaled(df, [], feats)
    w, b, stats = md.fedavg(xs, 3, rounds=2, epochs=2)
    rows = xs.collect()
    x = {c: np.array([[r.x_0, r.x_1, r.x_2] for r in rows if r.channel == c]) for c in "ab"}
    y = {c: np.array([r.is_fraud for r in rows if r.channel == c]) for c in "ab"}
    gw, gb = np.zeros(3), 0.0
    for _ in range(2):
        parts = []
        for c in "ab":
            lw, lb = gw.copy(), gb
            for _ in range(2):
                err = 1 / (1 + np.exp(-(x[c] @ lw + lb))) - y[c]
                lw, lb = lw - 0.1 * (x[c].T @ err / len(err) + 1e-4 * lw), lb - 0.1 * err.mean()
            parts.append((lw, lb, len(y[c])))
        n = sum(p[2] for p in parts)
        gw, gb = sum(p[0] * p[2] for p in parts) / n, sum(p[1] * p[2] for p in parts) / n
    assert np.allclose(w, gw, atol=1e-9) and abs(b - gb) < 1e-9
    assert {r.channel: r.samples for r in stats.collect()} == {"a": 100, "b": 100}


def test_cluster_without_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_replay_detects_a_changed_score(spark):
    from ledgerlens.operators import audit as au

    d = spark.createDataFrame([("t1", "run", 0.25, 0.5, "review_needed")], "tx_id string, model_run_id string, score double, raw_score double, confidence_band string")
    a = d.select(au.replay_hash_col()).first()[0]
    assert a == d.select(au.replay_hash_col()).first()[0] != d.withColumn("score", F.lit(0.26)).select(au.replay_hash_col()).first()[0]


def test_a_client_meets_its_model_in_parts(spark):
    """Finding F31: rows of one client are spread over tasks when they meet the client's model."""
    rows = [(c, float(i % 2), i / 10, -i / 7) for i in range(40) for c in ("a", "b")]
    df = spark.createDataFrame(rows, "channel string, is_fraud double, x_0 double, x_1 double")
    joined = []
    step = md._local_step

    def spy(data, *rest):
        joined.append(data)
        return step(data, *rest)

    md._local_step = spy
    try:
        w, _, _ = md.fedavg(df, 2, rounds=1, epochs=1)
    finally:
        md._local_step = step
    assert joined[0].groupBy("channel").agg(F.countDistinct("_part").alias("n")).agg(F.min("n")).first()[0] > 10
    want = [sum((0.5 - r[1]) * r[2 + i] for r in rows) / len(rows) * -0.1 for i in range(2)]
    assert all(abs(a - b) < 1e-9 for a, b in zip(w, want, strict=True))


def test_a_fit_does_not_run_a_task_for_every_small_part(spark, monkeypatch):
    """Findings F17, F21, F30: boosting runs its many stages over parts of ``TASK_ROWS`` rows."""
    seen = []

    class Estimator:
        def fit(self, df):
            seen.append((df.rdd.getNumPartitions(), df.count(), df.agg(F.sum("weight")).first()[0]))

    df = _frame(spark).repartition(40)
    md._fit_weighted(Estimator(), df)
    monkeypatch.setattr(md, "TASK_ROWS", 50)
    md._fit_weighted(Estimator(), df)
    positives = df.where("is_fraud = 1").count()
    assert [s[:2] for s in seen] == [(1, 200), (4, 200)] and abs(seen[0][2] - 2 * (200 - positives)) < 1e-6


def test_isotonic_fit_takes_one_point_a_score(spark):
    """Finding F29: rows of equal score are fitted as one weighted point, with the result of fitting all rows."""
    from pyspark.ml.regression import IsotonicRegression

    rng = np.random.default_rng(5)
    rows = [(f"t{i}", int(rng.random() < 0.1 + (i % 13) / 16), (i % 13) / 13) for i in range(400)]
    df = spark.createDataFrame(rows, "tx_id string, is_fraud int, raw_score double")
    fit = md.fit_isotonic(df)
    assert fit.getWeightCol() == "_points"
    plain = IsotonicRegression(featuresCol="raw_score", labelCol="y", predictionCol="want").fit(df.withColumn("y", F.col("is_fraud").cast("double")))
    both = plain.transform(md.calibrate(fit, df)).collect()
    assert all(abs(r.score - r.want) < 1e-12 for r in both)
    with pytest.raises(Exception, match="Labels MUST NOT be Null"):
        md.fit_isotonic(df.withColumn("is_fraud", F.when(F.col("tx_id") != "t5", F.col("is_fraud"))))
