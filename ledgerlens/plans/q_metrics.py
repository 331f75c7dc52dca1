"""Splits, metrics, conformal triage and governance queries over the scored frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.columns import epoch_micros
from ledgerlens.operators import conformal as cf
from ledgerlens.operators import features as fx
from ledgerlens.operators import governance as gv
from ledgerlens.operators import metrics as mt
from ledgerlens.operators import splits as sp
from ledgerlens.operators.registry import ModelRegistry
from ledgerlens.oracle import canonical as oc
from ledgerlens.oracle import features as of
from ledgerlens.oracle import metrics as om
from ledgerlens.plans.registry import query
from ledgerlens.sources import canonical as cn
from ledgerlens.sources.io import fresh_dir, written

SC = om.SC
VAL, TEST = om.split_part(SC, "validation"), om.split_part(SC, "test")


def scored(spark, sf):
    return cn.scored(spark, sf).withColumnRenamed("raw_score", "score")


def split_frame(spark, sf):
    return sp.chronological_split(scored(spark, sf))


def part(frame, name):
    return frame.filter(F.col("split") == name).drop("split")


def triaged(spark, sf):
    s = split_frame(spark, sf)
    return cf.conformal_triage(part(s, "test"), cf.conformal_threshold(part(s, "validation")))


def r6(df, only=None):
    """Rounding happens in a query's last projection only."""
    return gv.round_doubles(df, only=only)


M5 = om.METRIC_COLS
BAND_COLS = ["confidence"]
INTERVAL_COLS = ["interval_low", "interval_high"]
COVER_COLS = ["empirical_coverage", "average_set_size", "review_rate"]


# ------------------------------------------------------------------ splits

@query("chronological_split", om.chrono(SC))
def chronological_split(spark, sf):
    return split_frame(spark, sf)


@query("random_split", om.random(SC))
def random_split(spark, sf):
    return sp.random_split(scored(spark, sf), seed=7)


ROLL_W = 86_400_000_000


@query("rolling_folds", f"""WITH k AS (SELECT epoch_us("timestamp") AS _ts FROM ({oc.TX_EVENTS}) e),
lo AS (SELECT min(_ts) AS _lo, max(_ts) AS _hi FROM k),
h AS (SELECT CAST(floor((_ts - _lo) / {ROLL_W}) AS BIGINT) AS _b, count(*) AS _cnt FROM k, lo GROUP BY 1),
hb AS (SELECT *, coalesce(sum(_cnt) OVER (ORDER BY _b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before FROM h)
SELECT CAST(row_number() OVER (ORDER BY _b) - 1 AS INTEGER) AS fold,
       make_timestamp(_lo + _b * {ROLL_W}) AS window_start, make_timestamp(_lo + (_b + 1) * {ROLL_W}) AS window_end,
       CAST(_before AS BIGINT) AS train_rows, CAST(_cnt AS BIGINT) AS test_rows
FROM hb, lo WHERE _b >= 10 AND _lo + (_b + 1) * {ROLL_W} <= _hi AND _before > 100 AND _cnt > 10""")
def rolling_folds(spark, sf):
    return sp.rolling_folds(cn.tx_events(spark, sf), window_days=1)


@query("rolling_folds_fallback", f"""SELECT 0 AS fold, CAST(NULL AS TIMESTAMP) AS window_start, CAST(NULL AS TIMESTAMP) AS window_end,
  CAST(floor(count(*) * 0.7::DOUBLE) AS BIGINT) AS train_rows, count(*) - CAST(floor(count(*) * 0.85::DOUBLE) AS BIGINT) AS test_rows
FROM ({oc.TX_EVENTS}) e""")
def rolling_folds_fallback(spark, sf):
    """Windows too long for the data: the chronological split stands in as the only fold."""
    return sp.rolling_folds(cn.tx_events(spark, sf), window_days=60)


@query("concat_splits", SC)
def concat_splits(spark, sf):
    s = split_frame(spark, sf)
    return sp.concat_splits(part(s, "train"), part(s, "validation"), part(s, "test"))


# ------------------------------------------------------------------ metrics

@query("pr_auc", f"SELECT round(pr_auc, 6) AS pr_auc FROM ({om.ranking(SC)}) r")
def pr_auc(spark, sf):
    return r6(mt.ranking_metrics(scored(spark, sf)).select("pr_auc"))


@query("roc_auc", f"SELECT round(roc_auc, 6) AS roc_auc FROM ({om.ranking(SC)}) r")
def roc_auc(spark, sf):
    return r6(mt.ranking_metrics(scored(spark, sf)).select("roc_auc"))


@query("recall_at_fpr", f"SELECT round(recall_at_1pct_fpr, 6) AS recall_at_1pct_fpr FROM ({om.ranking(SC)}) r")
def recall_at_fpr(spark, sf):
    return r6(mt.ranking_metrics(scored(spark, sf)).select("recall_at_1pct_fpr"))


@query("brier", f"SELECT round(brier, 6) AS brier FROM ({om.calibration(SC)}) c")
def brier(spark, sf):
    return r6(mt.calibration_metrics(scored(spark, sf)).select("brier"))


@query("ece", f"SELECT round(ece, 6) AS ece FROM ({om.calibration(SC)}) c")
def ece(spark, sf):
    return r6(mt.calibration_metrics(scored(spark, sf)).select("ece"))


@query("reliability_curve", om.reliability(SC))
def reliability_curve(spark, sf):
    return r6(mt.reliability_curve(scored(spark, sf)))


@query("all_metrics", om.rounded(om.all_metrics(SC), M5))
def all_metrics(spark, sf):
    return r6(mt.all_metrics(scored(spark, sf)))


def scored_exact(spark, sf):
    return cn.scored_exact(spark, sf).withColumnRenamed("raw_score", "score")


@query("all_metrics_exact", om.rounded(om.all_metrics(om.SX), M5))
def all_metrics_exact(spark, sf):
    """The metrics on scores finer than 1e-6."""
    return r6(mt.all_metrics(scored_exact(spark, sf)))


@query("model_checks", f"""SELECT round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, round(brier, 6) AS brier_score, pr_auc > 0.5 AS pr_auc_pass,
  roc_auc > 0.6 AS roc_auc_pass, brier < 0.25 AS brier_pass, (pr_auc > 0.5 AND roc_auc > 0.6 AND brier < 0.25) AS all_passed
FROM ({om.all_metrics(SC)}) m""")
def model_checks(spark, sf):
    return r6(mt.model_checks(scored(spark, sf)))


@query("metrics_by_model", om.rounded(om.all_metrics(om.MODELS, ("model",)), M5))
def metrics_by_model(spark, sf):
    return r6(mt.all_metrics(cn.scored_models(spark, sf), group="model"))


@query("compare_runs", f"""SELECT first(model ORDER BY pr_auc DESC, model DESC) AS best_pr_auc,
  first(model ORDER BY roc_auc DESC, model DESC) AS best_roc_auc,
  first(model ORDER BY recall_at_1pct_fpr DESC, model DESC) AS best_recall_at_1pct_fpr,
  first(model ORDER BY brier ASC, model ASC) AS best_brier, first(model ORDER BY ece ASC, model ASC) AS best_ece
FROM ({om.all_metrics(om.MODELS, ('model',))}) m""")
def compare_runs(spark, sf):
    return mt.compare_runs(mt.all_metrics(cn.scored_models(spark, sf), group="model"))


RUNS_SQL = f"""SELECT model || '_' || strftime(CAST("timestamp" AS DATE), '%Y%m%d') AS run_id, is_fraud, score
FROM ({om.MODELS}) m"""


def eval_runs(spark, sf):
    """One evaluation run per (model, day): the runs table of the dashboards."""
    m = cn.scored_models(spark, sf)
    return m.select(F.concat_ws("_", "model", F.translate(F.col("timestamp").cast("date").cast("string"), "-", "")).alias("run_id"),
                    "is_fraud", "score")


@query("run_history", f"""SELECT run_id, round(pr_auc, 4) AS pr_auc FROM ({om.ranking(RUNS_SQL, ('run_id',))}) r
ORDER BY run_id DESC LIMIT 20""")
def run_history(spark, sf):
    r = mt.ranking_metrics(eval_runs(spark, sf), group="run_id")
    return r.select("run_id", F.round("pr_auc", 4).alias("pr_auc")).orderBy(F.desc("run_id")).limit(20)


# ------------------------------------------------------------------ conformal

THR, TRI = om.THR, om.TRI


@query("conformal_threshold", THR)
def conformal_threshold(spark, sf):
    return cf.conformal_threshold(part(split_frame(spark, sf), "validation"))


@query("conformal_triage", om.rounded(TRI, BAND_COLS))
def conformal_triage(spark, sf):
    return r6(triaged(spark, sf), BAND_COLS)


TRI_X = om.triage(om.split_part(om.SX, "test"), om.conformal_threshold(om.split_part(om.SX, "validation")))


@query("conformal_triage_exact", om.rounded(TRI_X, BAND_COLS))
def conformal_triage_exact(spark, sf):
    """Fit and triage on scores finer than 1e-6."""
    s = sp.chronological_split(scored_exact(spark, sf))
    return r6(cf.conformal_triage(part(s, "test"), cf.conformal_threshold(part(s, "validation"))), BAND_COLS)


@query("conformal_interval", om.rounded(om.interval(TEST, om.interval_fit(VAL)), INTERVAL_COLS))
def conformal_interval(spark, sf):
    s = split_frame(spark, sf)
    return r6(cf.conformal_interval(part(s, "test"), cf.conformal_interval_fit(part(s, "validation"))), INTERVAL_COLS)


@query("conformal_metrics", om.conformal_metrics(TRI))
def conformal_metrics(spark, sf):
    return r6(cf.conformal_metrics(triaged(spark, sf)))


@query("review_rate", f"SELECT round(avg(CAST(confidence_band = 'review_needed' AS INTEGER)), 6) AS review_rate FROM ({TRI}) t")
def review_rate(spark, sf):
    return triaged(spark, sf).agg(F.round(F.avg((F.col("confidence_band") == "review_needed").cast("int")), 6).alias("review_rate"))


@query("band_breakdown", f"SELECT confidence_band, count(*) AS n FROM ({TRI}) t GROUP BY 1")
def band_breakdown(spark, sf):
    return cf.band_breakdown(triaged(spark, sf))


# ------------------------------------------------------------------ fairness

FG = om.fairness_groups(SC, "channel")
FG_COLS = ["avg_score", "selection_rate", "fraud_rate", "true_positive_rate", "false_positive_rate"]


@query("fairness_groups", om.rounded(FG, FG_COLS))
def fairness_groups(spark, sf):
    return gv.round_doubles(gv.fairness_groups(scored(spark, sf), "channel"))


@query("fairness_groups_exact", om.rounded(om.fairness_groups(om.SX, "channel"), FG_COLS))
def fairness_groups_exact(spark, sf):
    """The group table on scores finer than 1e-6."""
    return r6(gv.fairness_groups(scored_exact(spark, sf), "channel"))


@query("fairness_summary", om.fairness_summary(FG))
def fairness_summary(spark, sf):
    return r6(gv.fairness_summary(gv.fairness_groups(scored(spark, sf), "channel")))


@query("fairness_overall", om.fairness_overall(SC))
def fairness_overall(spark, sf):
    return r6(gv.fairness_overall(scored(spark, sf)))


def _audit_sql(col: str, audit_id: str) -> str:
    return (f"SELECT '{audit_id}' AS audit_id, '{col}' AS sensitive_column, 0.5::DOUBLE AS threshold, * FROM "
            f"({om.fairness_summary(om.fairness_groups(SC, col))}) s, ({om.fairness_overall(SC)}) o")


@query("fairness_audit", _audit_sql("channel", "fairness_channel") + " UNION ALL " + _audit_sql("mcc", "fairness_mcc"))
def fairness_audit(spark, sf):
    s = scored(spark, sf)
    return r6(gv.fairness_audit(s, "channel", audit_id="fairness_channel").unionByName(
        gv.fairness_audit(s, "mcc", audit_id="fairness_mcc")))


# ------------------------------------------------------------------ drift

def _halves_sql(frame: str) -> str:
    return f"""SELECT *, epoch_us("timestamp") < (SELECT (min(epoch_us("timestamp")) + max(epoch_us("timestamp"))) // 2 FROM ({frame}) z) AS _is_ref
FROM ({frame}) h"""


def halves(df):
    """Reference = first half of the time span, current = second half (midpoint in integer micros)."""
    k = df.withColumn("_t", epoch_micros("timestamp"))
    mid = k.agg(((F.min("_t") + F.max("_t")) / 2).alias("_lo"), F.min("_t").alias("_a"), F.max("_t").alias("_b"))
    mid = mid.select(F.floor((F.col("_a") + F.col("_b")) / F.lit(2)).cast("long").alias("_mid"))
    j = k.crossJoin(mid)  # one row
    return (j.filter(F.col("_t") < F.col("_mid")).drop("_t", "_mid"),
            j.filter(F.col("_t") >= F.col("_mid")).drop("_t", "_mid"))


def _side_sql(is_ref: bool) -> str:
    """Features of one half of the data, built from that half alone."""
    half = f"SELECT * EXCLUDE (_is_ref) FROM ({_halves_sql(oc.TX_EVENTS)}) s WHERE {'' if is_ref else 'NOT '}_is_ref"
    return of.gold_features(half)


def _drift_sql() -> str:
    parts = []
    for c in fx.FEATURE_MATRIX:
        parts.append(f"SELECT '{c}' AS feature, (SELECT avg({c}) FROM r) AS ref_mean, (SELECT avg({c}) FROM k) AS cur_mean, "
                     f"(SELECT stddev_pop({c}) FROM r) AS ref_std")
    return f"""WITH r AS ({_side_sql(True)}), k AS ({_side_sql(False)}), f AS ({" UNION ALL ".join(parts)})
SELECT feature, round(ref_mean, 5) AS ref_mean, round(cur_mean, 5) AS cur_mean, round(ref_std, 5) AS ref_std,
       round(abs(cur_mean - ref_mean) / CASE WHEN ref_std = 0 THEN 1.0 ELSE ref_std END, 5) AS z FROM f"""


def drift_sides(spark, sf):
    """Reference and current features, each built from its own half and written once."""
    ref, cur = halves(cn.tx_events(spark, sf))
    return written(fx.gold_features(ref), "gold-ref"), written(fx.gold_features(cur), "gold-cur")


@query("drift_zscore", _drift_sql())
def drift_zscore(spark, sf):
    return gv.round_doubles(gv.drift_features(*drift_sides(spark, sf), fx.FEATURE_MATRIX), 5)


_Z_SQL = _drift_sql().replace('round(ref_mean, 5) AS ref_mean, round(cur_mean, 5) AS cur_mean, round(ref_std, 5) AS ref_std',
                              'ref_mean, cur_mean, ref_std')


def _monitor_sql(drift: str, halves_frame: str, retrains: bool) -> str:
    """The report's ids follow from the current rows: latest time and number."""
    cur = f"SELECT * FROM ({_halves_sql(halves_frame)}) b WHERE NOT _is_ref"
    run = f"""(SELECT 'run_xgb_tabular_' || strftime(max("timestamp"), '%Y%m%d%H%M%S') || '_' || CAST(count(*) AS VARCHAR) FROM ({cur}) r)"""
    fitted = f"CASE WHEN s >= 0.2 THEN {run} END" if retrains else "CAST(NULL AS VARCHAR)"
    return f"""SELECT (SELECT 'drift_' || strftime(max("timestamp"), '%Y%m%d%H%M%S') || '_' || CAST(count(*) AS VARCHAR) FROM ({cur}) x) AS report_id,
  {fitted} AS run_id, round(s, 6) AS drift_score, s >= 0.2 AS is_drift, 0.2::DOUBLE AS threshold,
  {'s >= 0.2' if retrains else 'false'} AS retrain_triggered, {fitted} AS retrain_run_id,
  'fallback_zscore' AS detector, {len(fx.FEATURE_MATRIX)} AS n_features,
  (SELECT count(*) FROM ({_halves_sql(halves_frame)}) a WHERE _is_ref) AS reference_rows, (SELECT count(*) FROM ({cur}) c) AS current_rows
FROM (SELECT avg(least(greatest(abs(cur_mean - ref_mean) / CASE WHEN ref_std = 0 THEN 1.0 ELSE ref_std END / 3.0, 0.0), 1.0)) AS s
      FROM ({drift}) d) x"""


@query("drift_monitor", _monitor_sql(_Z_SQL, oc.TX_EVENTS, True))
def drift_monitor(spark, sf, threshold: float = 0.2, trigger_retrain: bool = True):
    """The drift report: score of current against reference features; past the threshold a model is trained."""
    from ledgerlens.plans.monitoring import monitor

    ref, cur = drift_sides(spark, sf)
    return r6(monitor(ref, cur, ModelRegistry(spark, fresh_dir(spark, "registry")), threshold, trigger_retrain))


def _shifted(df):
    """A current side that has drifted: larger amounts, other places."""
    return df.withColumns({"amount": F.col("amount") * 50, "lat": F.col("lat") + 60, "lon": F.col("lon") + 90})


def _shifted_drift_sql() -> str:
    """``_Z_SQL`` with the current half changed before its features are built."""
    half = f"SELECT * EXCLUDE (_is_ref) FROM ({_halves_sql(oc.TX_EVENTS)}) s WHERE NOT _is_ref"
    moved = f"SELECT * REPLACE (amount * 50 AS amount, lat + 60 AS lat, lon + 90 AS lon) FROM ({half}) m"
    return _Z_SQL.replace(_side_sql(False), of.gold_features(moved))


@query("drift_monitor_retrained", _monitor_sql(_shifted_drift_sql(), oc.TX_EVENTS, True))
def drift_monitor_retrained(spark, sf):
    """A current side that has drifted: boosted trees are fitted on it, saved and registered, and the report names the run."""
    from ledgerlens.plans.monitoring import monitor

    ref, cur = halves(cn.tx_events(spark, sf))
    ref, cur = written(fx.gold_features(ref), "gold-ref"), written(fx.gold_features(_shifted(cur)), "gold-cur")
    return r6(monitor(ref, cur, ModelRegistry(spark, fresh_dir(spark, "registry")), trigger_retrain=True, max_iter=10))


# ------------------------------------------------------------------ KPIs

def _kpi_long_sql() -> str:
    m = om.all_metrics(SC)
    cov = om.conformal_metrics(TRI)
    fs = om.fairness_summary(FG)
    return f"""SELECT 'pr_auc' AS metric, pr_auc AS value FROM ({m}) a UNION ALL SELECT 'ece', ece FROM ({m}) a
UNION ALL SELECT 'brier_score', brier FROM ({m}) a UNION ALL SELECT 'recall_at_1pct_fpr', recall_at_1pct_fpr FROM ({m}) a
UNION ALL SELECT 'roc_auc', roc_auc FROM ({m}) a UNION ALL SELECT 'coverage', empirical_coverage FROM ({cov}) c
UNION ALL SELECT 'disparity_ratio', disparate_impact_ratio FROM ({fs}) f"""


KPI_VALUES = ", ".join(f"('{m}', {g}::DOUBLE, {y}::DOUBLE, {str(lb).upper()})" for m, g, y, lb in gv.KPI_THRESHOLDS)


@query("kpi_status", f"""SELECT metric, round(value, 6) AS value, CASE WHEN green IS NULL THEN 'neutral'
  WHEN lower_is_better THEN CASE WHEN value <= green THEN 'good' WHEN value <= yellow THEN 'warning' ELSE 'critical' END
  ELSE CASE WHEN value >= green THEN 'good' WHEN value >= yellow THEN 'warning' ELSE 'critical' END END AS status
FROM ({_kpi_long_sql()}) l LEFT JOIN (VALUES {KPI_VALUES}) t(metric, green, yellow, lower_is_better) USING (metric)""")
def kpi_status(spark, sf):
    s = scored(spark, sf)
    m = mt.all_metrics(s)
    cov = cf.conformal_metrics(triaged(spark, sf))
    fs = gv.fairness_summary(gv.fairness_groups(s, "channel"))
    long = m.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(c).alias("value")) for k, c in (
        ("pr_auc", "pr_auc"), ("ece", "ece"), ("brier_score", "brier"), ("recall_at_1pct_fpr", "recall_at_1pct_fpr"),
        ("roc_auc", "roc_auc"))])))
    long = long.unionByName(cov.select(F.lit("coverage").alias("metric"), F.col("empirical_coverage").alias("value")))
    long = long.unionByName(fs.select(F.lit("disparity_ratio").alias("metric"), F.col("disparate_impact_ratio").alias("value")))
    return r6(gv.kpi_status(long))


# ------------------------------------------------------------------ query traces

TRACE_SQL = """SELECT 'trace_' || CAST(u.conv_id AS VARCHAR) || '_' || CAST(u.turn AS VARCHAR) AS trace_id,
  u.text AS prompt, CASE WHEN a.text IS NULL THEN 'fallback' ELSE 'llm' END AS path,
  CASE WHEN a.text IS NULL THEN 0.0::DOUBLE ELSE CAST(length(a.text) AS DOUBLE) / 250.0::DOUBLE END AS latency_seconds,
  CASE WHEN a.text IS NULL THEN 'no_response' ELSE '' END AS error
FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'"""


@query("query_trace_summary", f"""SELECT count(*) AS total_queries, count(*) FILTER (WHERE path = 'llm') AS llm_queries,
  count(*) FILTER (WHERE path = 'fallback') AS fallback_queries, round(coalesce(avg(latency_seconds), 0), 3) AS avg_latency_seconds,
  round(coalesce(max(latency_seconds), 0), 3) AS max_latency_seconds, count(*) FILTER (WHERE error <> '') AS error_count
FROM ({TRACE_SQL}) t""")
def query_trace_summary(spark, sf):
    from ledgerlens.operators.audit import query_trace_summary as qts, trace_log
    return qts(trace_log(spark, sf))
