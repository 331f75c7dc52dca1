"""Model queries (Spark ML; rows-only oracles except one federated step)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import audit as au
from ledgerlens.operators import conformal as cf
from ledgerlens.operators import features as fx
from ledgerlens.operators import governance as gv
from ledgerlens.operators import metrics as mt
from ledgerlens.operators import models as md
from ledgerlens.oracle import canonical as oc
from ledgerlens.oracle import features as of
from ledgerlens.oracle import metrics as om
from ledgerlens.plans import training as tr
from ledgerlens.plans.q_metrics import TEST, VAL, split_frame
from ledgerlens.plans.q_metrics import part as split_part
from ledgerlens.plans.registry import query
from ledgerlens.sources import canonical as cn
from ledgerlens.sources.io import written

FM = fx.FEATURE_MATRIX


def _splits(spark, sf):
    s = tr.split_features(cn.tx_events(spark, sf))
    return tr.part(s, "train"), tr.part(s, "validation"), tr.part(s, "test")


@query("train_gbt")
def train_gbt(spark, sf):
    """Boosted trees (120 rounds, depth 5, lr 0.1, subsample 0.8, weighted positives); test-split scores."""
    train, _, test = _splits(spark, sf)
    return md.score(md.train_gbt(train, FM), test).select("tx_id", "is_fraud", "raw_score")


@query("train_sage_lr")
def train_sage_lr(spark, sf):
    train, _, test = _splits(spark, sf)
    m = md.train_sage_lr(train, FM)
    return tr.score_split("graphsage_only", m, test, FM).select("tx_id", "is_fraud", "raw_score")


@query("train_hybrid")
def train_hybrid(spark, sf):
    train, _, test = _splits(spark, sf)
    m = md.train_hybrid(train, FM)
    return tr.score_split("graphsage_xgb", m, test, FM).select("tx_id", "is_fraud", "raw_score")


def _calibrated(spark, sf, method):
    train, valid, test = _splits(spark, sf)
    m = md.train_gbt(train, FM)
    v, t = written(md.score(m, valid).select("is_fraud", "raw_score"), "calibration"), md.score(m, test)  # a fit reads its rows often
    cal = md.fit_platt(v) if method == "platt" else md.fit_isotonic(v)
    return md.calibrate(cal, t).select("tx_id", "is_fraud", "raw_score", "score")


@query("calibrate_platt")
def calibrate_platt(spark, sf):
    return _calibrated(spark, sf, "platt")


@query("calibrate_isotonic")
def calibrate_isotonic(spark, sf):
    return _calibrated(spark, sf, "isotonic")


#: Validation and test scores; the fit itself is stated in closed form: the greatest of the least means.
_ISOTONIC_SQL = f"""WITH v AS (SELECT score AS x, sum(is_fraud) AS s, count(*) AS n FROM ({VAL}) v GROUP BY score),
c AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(s) OVER w AS s, sum(n) OVER w AS n, sum(s) OVER w - s AS s0, sum(n) OVER w - n AS n0
      FROM v WINDOW w AS (ORDER BY x)),
m AS (SELECT a.i AS a, b.i AS i, b.x, min(CAST(b.s - a.s0 AS DOUBLE) / (b.n - a.n0)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS least
      FROM c a JOIN c b ON a.i <= b.i),
g AS (SELECT i, x, max(least) AS y FROM m GROUP BY i, x),
e AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM g),
t AS (SELECT tx_id, is_fraud, score AS raw_score, greatest(least(score, (SELECT max(x) FROM g)), (SELECT min(x) FROM g)) AS z FROM ({TEST}) t)
SELECT tx_id, is_fraud, round(raw_score, 6) AS raw_score, round(CASE WHEN x1 IS NULL OR z = x0 THEN y0 ELSE y0 + (y1 - y0) * (z - x0) / (x1 - x0) END, 6) AS score
FROM t ASOF JOIN e ON e.x0 <= t.z"""

#: Newton steps of the two-parameter logistic likelihood from zero.
_PLATT_SQL = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT score AS x, CAST(is_fraud AS DOUBLE) AS y, count(*) AS n FROM ({VAL}) v GROUP BY ALL),
r AS (
  SELECT 0 AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
  UNION ALL
  SELECT k + 1, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
    SELECT k, a, b, sum(n * (y - p)) AS ga, sum(n * (y - p) * x) AS gb, sum(n * p * (1 - p)) AS haa, sum(n * p * (1 - p) * x) AS hab,
           sum(n * p * (1 - p) * x * x) AS hbb
    FROM (SELECT r.k, r.a, r.b, v.x, v.y, v.n, 1 / (1 + exp(-(r.a + r.b * v.x))) AS p FROM r, v WHERE r.k < 20) z GROUP BY k, a, b) s),
f AS (SELECT a, b FROM r WHERE k = 20)
SELECT tx_id, is_fraud, round(score, 6) AS raw_score, round(1 / (1 + exp(-(a + b * score))), 4) AS score FROM ({TEST}) t, f"""


def _calibrated_scores(spark, sf, fit):
    s = split_frame(spark, sf).withColumnRenamed("score", "raw_score")
    model = fit(written(split_part(s, "validation"), "calibration"))
    return md.calibrate(model, split_part(s, "test")).select("tx_id", "is_fraud", "raw_score", "score")


@query("calibrate_isotonic_scores", _ISOTONIC_SQL)
def calibrate_isotonic_scores(spark, sf):
    """Isotonic calibration of given scores: fitted on the validation split, applied to the test split."""
    return gv.round_doubles(_calibrated_scores(spark, sf, md.fit_isotonic))


@query("calibrate_platt_scores", _PLATT_SQL)
def calibrate_platt_scores(spark, sf):
    """Platt calibration of given scores, to four places."""
    out = _calibrated_scores(spark, sf, md.fit_platt)
    return out.select("tx_id", "is_fraud", F.round("raw_score", 6).alias("raw_score"), F.round("score", 4).alias("score"))


@query("train_pipeline")
def train_pipeline(spark, sf):
    """One run record: features, split, a graph per split, the hybrid fitted on features and embeddings; model and
    calibrator saved and read again, metrics of the test split."""
    res = tr.train_pipeline(cn.tx_events(spark, sf), "graphsage_xgb")
    return tr.run_record(spark, res, "run_graphsage_xgb_0001")


@query("score_batch")
def score_batch(spark, sf):
    """Fit once, then score *every* transaction: model -> calibrator -> conformal band."""
    res = tr.train_pipeline(cn.tx_events(spark, sf))
    allf = fx.gold_features(cn.tx_events(spark, sf))
    scored = md.calibrate(res.calibrator, md.score(res.model, allf))
    return cf.conformal_triage(scored, res.threshold).select("tx_id", "raw_score", "score", "confidence_band", "confidence")


@query("end_to_end")
def end_to_end(spark, sf):
    """data -> train -> score every transaction -> explain -> hash -> record -> report -> replay."""
    res = tr.train_pipeline(cn.tx_events(spark, sf))
    gold = fx.gold_features(cn.tx_events(spark, sf))
    tri = cf.conformal_triage(md.calibrate(res.calibrator, md.score(res.model, gold)), res.threshold)
    d = au.explained(tri.withColumn("model_run_id", F.lit("run_xgb_tabular_0001")), fx.FEATURE_COLUMNS)
    recorded = written(d.withColumn("decision_id", au.decision_hash_col()).withColumn("replay_hash", au.replay_hash_col()), "recorded")
    rep = au.audit_reports(recorded)
    return rep.select("decision_id", "model_run_id", "tx_id", "confidence_band", "score", "replay_hash",
                      (au.replay_hash_col() == F.col("replay_hash")).alias("replay_matched"), "markdown")


# ------------------------------------------------------------------ federated

GOLD_EV = of.gold_features(oc.TX_EVENTS)


def _fed_sql() -> str:
    tr_sql = f"SELECT * FROM ({om.random(GOLD_EV)}) s WHERE split = 'train'"
    stats = ", ".join(f"avg({c}) AS m_{i}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{i}"
                      for i, c in enumerate(FM))
    xs = ", ".join(f"({c} - m_{i}) / s_{i} AS x_{i}" for i, c in enumerate(FM))
    g = ", ".join(f"sum(x_{i} * (0.5 - is_fraud)) AS g_{i}" for i in range(len(FM)))
    ws = " UNION ALL ".join(
        f"SELECT '{c}' AS param, round(sum((-0.1 * g_{i} / n) * (CAST(n AS DOUBLE) / total)), 6) AS value FROM c"
        for i, c in enumerate(FM))
    return f"""WITH t AS ({tr_sql}), st AS (SELECT {stats} FROM t),
x AS (SELECT CAST(channel AS VARCHAR) AS channel, is_fraud, {xs} FROM t, st),
c AS (SELECT channel, count(*) AS n, sum(0.5 - is_fraud) AS se, {g}, sum(count(*)) OVER () AS total FROM x GROUP BY channel)
{ws} UNION ALL SELECT 'bias', round(sum((-0.1 * se / n) * (CAST(n AS DOUBLE) / total)), 6) FROM c"""


@query("fedavg_round", _fed_sql())
def fedavg_round(spark, sf):
    """One round x one local epoch of federated averaging (clients = channels) from a zero model."""
    train, _, _ = _splits(spark, sf)
    (xs,) = md.scaled(train, [], FM)
    w, b, _ = md.fedavg(xs, len(FM), client="channel", rounds=1, epochs=1)
    rows = [(c, float(round(v, 6))) for c, v in zip(FM, w)] + [("bias", float(round(b, 6)))]
    return spark.createDataFrame(rows, "param string, value double")


@query("fed_train")
def fed_train(spark, sf):
    """5 rounds x 3 epochs, then isotonic calibration on validation, conformal triage and test metrics."""
    train, valid, test = _splits(spark, sf)
    xs, xv, xt = md.scaled(train, [valid, test], FM)
    w, b, _ = md.fedavg(xs, len(FM), client="channel", rounds=5, epochs=3)
    v, t = md.fed_predict(xv, w, b), md.fed_predict(xt, w, b)
    cal = md.fit_isotonic(v)
    vc, tc = md.calibrate(cal, v), md.calibrate(cal, t)
    tri = cf.conformal_triage(tc, cf.conformal_threshold(vc))
    tri = written(tri, "federated")
    return mt.all_metrics(tri).crossJoin(cf.conformal_metrics(tri).select("empirical_coverage", "review_rate"))
