"""Metrics, conformal triage, fairness, KPI thresholds on fixed score vectors."""

import numpy as np

from ledgerlens.operators import conformal as cf
from ledgerlens.operators import governance as gv
from ledgerlens.operators import metrics as mt


def _scores(spark, y, p, extra=None):
    rows = [(f"t{i}", int(a), float(b), (extra[i] if extra else "g")) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "tx_id string, is_fraud int, score double, grp string")


def _ap(y, p):
    # step-wise average precision by brute force over distinct thresholds
    y, p = np.asarray(y), np.asarray(p)
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        sel = p >= t
        tp = (y[sel] == 1).sum()
        r, prec = tp / y.sum(), tp / sel.sum()
        ap += (r - prev_r) * prec
        prev_r = r
    return ap


def test_fixed_vector_model_checks(spark):
    df = _scores(spark, [0, 0, 0, 0, 1, 1, 1, 1], [.1, .2, .3, .4, .6, .7, .8, .9])
    m = mt.model_checks(df).first()
    assert m.pr_auc == 1.0 and m.roc_auc == 1.0 and abs(m.brier_score - 0.075) < 1e-12 and m.all_passed


def test_ranking_metrics_match_brute_force_with_ties(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    p = np.round(np.clip(0.3 * y + rng.random(300) * 0.7, 0, 1), 2)  # many ties
    r = mt.ranking_metrics(_scores(spark, y, p)).first()
    assert abs(r.pr_auc - _ap(y, p)) < 1e-6
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(r.roc_auc - auc) < 1e-6


def test_ece_bins_last_closed(spark):
    df = _scores(spark, [1, 0, 1], [1.0, 0.05, 0.95])
    e = mt.calibration_metrics(df).first()
    # bin 9 holds 1.0 and 0.95 (acc 1, conf .975); bin 0 holds .05 (acc 0, conf .05)
    assert abs(e.ece - (abs(1 - 0.975) * 2 / 3 + 0.05 / 3)) < 1e-12


def test_conformal_bands_fixed_vector(spark):
    df = _scores(spark, [0, 0, 0, 1, 1], [.1, .3, .5, .7, .9])
    thr = cf.conformal_threshold(df)
    assert thr.first().threshold == 0.5
    bands = [r.confidence_band for r in cf.conformal_triage(df, thr).orderBy("score").collect()]
    assert bands == ["high_confidence_legit", "high_confidence_legit", "review_needed",
                     "high_confidence_fraud", "high_confidence_fraud"]


def test_conformal_metrics_set_size(spark):
    rows = [("high_confidence_fraud", 1), ("review_needed", 1), ("high_confidence_legit", 0),
            ("high_confidence_legit", 0), ("review_needed", 0)]
    df = spark.createDataFrame(rows, "confidence_band string, is_fraud int")
    m = cf.conformal_metrics(df).first()
    assert m.empirical_coverage == 1.0 and m.average_set_size == 1.4 and m.review_rate == 0.4


def test_fairness_groups_and_summary(spark):
    df = _scores(spark, [1, 0, 1, 0], [.9, .6, .2, .1], extra=["a", "a", "b", "b"])
    g = {r.group: r for r in gv.fairness_groups(df, "grp").collect()}
    assert g["a"].selection_rate == 1.0 and g["b"].selection_rate == 0.0
    assert g["a"].true_positive_rate == 1.0 and g["b"].false_positive_rate == 0.0
    s = gv.fairness_summary(gv.fairness_groups(df, "grp")).first()
    assert s.demographic_parity_difference == 1.0 and s.disparate_impact_ratio == 0.0


def test_kpi_status_directions(spark):
    long = spark.createDataFrame([("pr_auc", 0.9), ("pr_auc", 0.75), ("ece", 0.04), ("ece", 0.2), ("other", 1.0)],
                                 "metric string, value double")
    out = [(r.metric, r.value, r.status) for r in gv.kpi_status(long).collect()]
    assert ("pr_auc", 0.9, "good") in out and ("pr_auc", 0.75, "warning") in out
    assert ("ece", 0.04, "good") in out and ("ece", 0.2, "critical") in out and ("other", 1.0, "neutral") in out


def test_drift_floor_flags_even_with_higher_threshold(spark):
    ref = spark.createDataFrame([(float(x),) for x in range(10)], "f double")
    cur = spark.createDataFrame([(float(x) + 5,) for x in range(10)], "f double")
    d = gv.drift_score(gv.drift_features(ref, cur, ["f"]), threshold=0.9).first()
    assert d.is_drift and d.drift_score > 0.2


def test_scores_are_not_quantised(spark):
    fine = _scores(spark, [1, 0, 0, 1], [4e-7, 3e-7, 2e-7, 1e-7])
    r = mt.ranking_metrics(fine).first()
    assert r.pr_auc == 0.75 and r.recall_at_1pct_fpr == 0.5 and r.roc_auc == 0.5
    below = _scores(spark, [0, 1], [0.4999996, 0.4999996], extra=["a", "b"])
    assert [g.selection_rate for g in gv.fairness_groups(below, "grp").collect()] == [0.0, 0.0]
    thr = cf.conformal_threshold(_scores(spark, [0, 0, 1], [1e-7, 3e-7, 1 - 2e-7])).first()
    assert thr.threshold == 3e-7


def test_ranking_metrics_across_pieces_and_groups(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 400)
    p = rng.random(400) ** 8  # many tiny scores, several score pieces
    df = _scores(spark, np.concatenate([y, y[:50]]), np.concatenate([p, p[:50]]), extra=["a"] * 400 + [None] * 50)
    r = {x.grp: x for x in mt.all_metrics(df, group="grp").collect()}
    for key, yy, pp in (("a", y, p), (None, y[:50], p[:50])):
        pos, neg = pp[yy == 1], pp[yy == 0]
        assert abs(r[key].pr_auc - _ap(yy, pp)) < 1e-12
        assert abs(r[key].roc_auc - (pos[:, None] > neg[None, :]).mean()) < 1e-12
        assert abs(r[key].brier - ((pp - yy) ** 2).mean()) < 1e-12


def test_one_pass_profiles_match_plain_definitions(spark):
    schema = "tx_id string, amount double, mcc string, is_fraud int"
    ref = spark.createDataFrame([("a", 1.0, "x", 0), ("b", 5.0, None, 1), ("c", None, "y", 0)], schema)
    cur = spark.createDataFrame([("d", 7.0, "z", 0), ("d", 2.0, "x", 0), ("e", 0.5, None, 0), (None, None, "q", 0)], schema)
    got = {(r.check, r.column): r.value for r in gv.integrity_checks(ref, cur).collect()}
    assert got["out_of_reference_range", "amount"] == 2 and got["unseen_categories", "mcc"] == 2
    assert got["duplicate_keys", "tx_id"] == 1 and got["constant_current", "is_fraud"] == 1 and got["constant_current", "mcc"] == 0
    assert got["null_count_reference", "amount"] == 1 and got["null_count_current", "tx_id"] == 1
    p = {r.column: r for r in gv.dataset_drift_profile(ref, cur).collect()}
    assert p["amount"].ref_median == 3.0 and p["amount"].cur_median == 2.0 and abs(p["amount"].cur_null_rate - 0.25) < 1e-12
    assert p["amount"].ref_target_rate == 1 / 3 and p["amount"].cur_target_rate == 0.0
