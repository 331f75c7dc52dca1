"""Governance store queries: audit / drift report lists, model cards, KPI counts, data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.columns import epoch_micros
from ledgerlens.operators import features as fx
from ledgerlens.operators import governance as gv
from ledgerlens.operators import graph as gr
from ledgerlens.operators import metrics as mt
from ledgerlens.operators import sketches as sk
from ledgerlens.oracle import canonical as oc
from ledgerlens.oracle import features as of
from ledgerlens.oracle import graph as og
from ledgerlens.oracle import metrics as om
from ledgerlens.plans.q_metrics import RUNS_SQL, _halves_sql, eval_runs, halves
from ledgerlens.plans.registry import query
from ledgerlens.sources import canonical as cn
from ledgerlens.sources.io import fresh_dir, written
from ledgerlens.sources.versioned import VersionedTable

MODELS = ["logit", "amount_rank", "blend"]
SENSITIVE = ["channel", "mcc"]
AUDITS = [(m, c) for m in MODELS for c in SENSITIVE]
NOW_SQL = f"(SELECT max(\"timestamp\") FROM ({oc.TX_EVENTS}) n)"


def _model_sql(m: str) -> str:
    return f"SELECT * FROM ({om.MODELS}) x WHERE model = '{m}'"


def _stamped(df, now, minutes):
    """``created_at`` = the newest time plus the report's number of minutes (``now``: one row)."""
    return df.crossJoin(now).withColumn("created_at", F.col("_now") + F.make_dt_interval(mins=minutes)).drop("_now")


def _number(values, of):
    """Position of a column's value in a fixed list."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(of)).cast("int") - 1


def fairness_store(spark, sf):
    """One audit per (model, sensitive column), all in one grouped pass."""
    sm = cn.scored_models(spark, sf)
    a = gv.fairness_audits(sm, "model", SENSITIVE)
    a = _stamped(a, sm.agg(F.max("timestamp").alias("_now")),
                 _number(MODELS, "model") * len(SENSITIVE) + _number(SENSITIVE, "sensitive_column"))
    return gv.round_doubles(a.select(
        F.concat(F.lit("fa_"), "model", F.lit("_"), "sensitive_column").alias("audit_id"), F.col("model").alias("run_id"),
        "sensitive_column", "threshold", "demographic_parity_difference", "disparate_impact_ratio",
        "equal_opportunity_difference", "created_at"))


FAIRNESS_STORE_SQL = " UNION ALL ".join(
    f"""SELECT 'fa_{m}_{c}' AS audit_id, '{m}' AS run_id, '{c}' AS sensitive_column, 0.5::DOUBLE AS threshold,
  demographic_parity_difference, disparate_impact_ratio, equal_opportunity_difference, {NOW_SQL} + INTERVAL {i} MINUTE AS created_at
FROM ({om.fairness_summary(om.fairness_groups(_model_sql(m), c))}) s""" for i, (m, c) in enumerate(AUDITS))


def drift_store(spark, sf):
    """One drift report per model, all in grouped passes."""
    sm = cn.scored_models(spark, sf)
    d = gv.drift_reports(sm, "model", "score", epoch_micros("timestamp"))
    d = _stamped(d, sm.agg(F.max("timestamp").alias("_now")), _number(MODELS, "model") + 10)
    return gv.round_doubles(d.select(
        F.concat(F.lit("dr_"), "model").alias("report_id"), F.col("model").alias("run_id"), "drift_score", "is_drift",
        F.lit(False).alias("retrain_triggered"), "created_at"))


def _drift_sql(i: int, m: str) -> str:
    f = _model_sql(m)
    h = f"""SELECT *, epoch_us("timestamp") < (SELECT (min(epoch_us("timestamp")) + max(epoch_us("timestamp"))) // 2 FROM ({f}) z) AS _is_ref FROM ({f}) h"""
    z = ("abs(avg(score) FILTER (WHERE NOT _is_ref) - avg(score) FILTER (WHERE _is_ref)) / CASE WHEN stddev_pop(score) "
         "FILTER (WHERE _is_ref) = 0 THEN 1.0 ELSE stddev_pop(score) FILTER (WHERE _is_ref) END")
    return f"""SELECT 'dr_{m}' AS report_id, '{m}' AS run_id, round(least(greatest({z} / 3.0, 0.0), 1.0), 6) AS drift_score,
  least(greatest({z} / 3.0, 0.0), 1.0) >= 0.2 AS is_drift, false AS retrain_triggered, {NOW_SQL} + INTERVAL {10 + i} MINUTE AS created_at
FROM ({h}) g"""


DRIFT_STORE_SQL = " UNION ALL ".join(_drift_sql(i, m) for i, m in enumerate(MODELS))


@query("fairness_recent", f"""SELECT audit_id, sensitive_column, demographic_parity_difference, disparate_impact_ratio
FROM ({FAIRNESS_STORE_SQL}) f ORDER BY created_at DESC LIMIT 10""")
def fairness_recent(spark, sf):
    return fairness_store(spark, sf).orderBy(F.desc("created_at")).limit(10).select(
        "audit_id", "sensitive_column", "demographic_parity_difference", "disparate_impact_ratio")


@query("drift_recent", f"""SELECT report_id, drift_score, is_drift, retrain_triggered FROM ({DRIFT_STORE_SQL}) d
ORDER BY created_at DESC LIMIT 10""")
def drift_recent(spark, sf):
    return drift_store(spark, sf).orderBy(F.desc("created_at")).limit(10).select(
        "report_id", "drift_score", "is_drift", "retrain_triggered")


@query("latest_report_per_run", f"""SELECT run_id, audit_id, sensitive_column, disparate_impact_ratio, created_at
FROM ({FAIRNESS_STORE_SQL}) f QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY created_at DESC) = 1""")
def latest_report_per_run(spark, sf):
    return gv.latest_per_key(fairness_store(spark, sf), "run_id", "created_at").select(
        "run_id", "audit_id", "sensitive_column", "disparate_impact_ratio", "created_at")


def _card(cols):
    """Markdown model card text from metrics + latest fairness + latest drift."""
    return F.concat_ws("\n", F.concat(F.lit("# Model card: "), cols["run_id"]),
                       F.concat(F.lit("- PR-AUC: "), cols["pr_auc"].cast("decimal(18,6)").cast("string")),
                       F.concat(F.lit("- Brier: "), cols["brier"].cast("decimal(18,6)").cast("string")),
                       F.concat(F.lit("- ECE: "), cols["ece"].cast("decimal(18,6)").cast("string")),
                       F.concat(F.lit("- Disparate impact: "), F.coalesce(cols["di"].cast("decimal(18,6)").cast("string"), F.lit("n/a"))),
                       F.concat(F.lit("- Drift score: "), F.coalesce(cols["drift"].cast("decimal(18,6)").cast("string"), F.lit("n/a"))))


@query("model_card_rows", f"""WITH m AS ({om.rounded(om.all_metrics(om.MODELS, ('model',)), om.METRIC_COLS)}),
f AS (SELECT * FROM ({FAIRNESS_STORE_SQL}) x QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY created_at DESC) = 1),
d AS (SELECT * FROM ({DRIFT_STORE_SQL}) y QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY created_at DESC) = 1)
SELECT m.model AS run_id, pr_auc, roc_auc, brier, ece, f.disparate_impact_ratio, d.drift_score,
  concat_ws(chr(10), '# Model card: ' || m.model, '- PR-AUC: ' || CAST(CAST(pr_auc AS DECIMAL(18,6)) AS VARCHAR),
    '- Brier: ' || CAST(CAST(brier AS DECIMAL(18,6)) AS VARCHAR), '- ECE: ' || CAST(CAST(ece AS DECIMAL(18,6)) AS VARCHAR),
    '- Disparate impact: ' || coalesce(CAST(CAST(f.disparate_impact_ratio AS DECIMAL(18,6)) AS VARCHAR), 'n/a'),
    '- Drift score: ' || coalesce(CAST(CAST(d.drift_score AS DECIMAL(18,6)) AS VARCHAR), 'n/a')) AS card
FROM m LEFT JOIN f ON f.run_id = m.model LEFT JOIN d ON d.run_id = m.model""")
def model_card_rows(spark, sf):
    m = gv.round_doubles(mt.all_metrics(cn.scored_models(spark, sf), group="model")).withColumnRenamed("model", "run_id")
    f = gv.latest_per_key(fairness_store(spark, sf), "run_id", "created_at").select("run_id", "disparate_impact_ratio")
    d = gv.latest_per_key(drift_store(spark, sf), "run_id", "created_at").select("run_id", "drift_score")
    j = m.join(f, "run_id", "left").join(d, "run_id", "left")
    card = _card({"run_id": F.col("run_id"), "pr_auc": F.col("pr_auc"), "brier": F.col("brier"), "ece": F.col("ece"),
                  "di": F.col("disparate_impact_ratio"), "drift": F.col("drift_score")})
    return j.select("run_id", "pr_auc", "roc_auc", "brier", "ece", "disparate_impact_ratio", "drift_score", card.alias("card"))


KPI_METRICS = ("pr_auc", "ece", "brier", "recall_at_1pct_fpr")


@query("kpi_counts", f"""WITH m AS ({om.all_metrics(om.SC)})
SELECT 'runs' AS item, CAST(count(DISTINCT run_id) AS DOUBLE) AS n FROM ({RUNS_SQL}) r
UNION ALL SELECT 'fairness_audits', count(*) FROM ({FAIRNESS_STORE_SQL}) f
UNION ALL SELECT 'drift_reports', count(*) FROM ({DRIFT_STORE_SQL}) d
UNION ALL SELECT 'decisions', count(*) FROM ({om.TRI}) t
UNION ALL SELECT 'federated_clients', count(DISTINCT channel) FROM ({om.SC}) c""" + "".join(
    f" UNION ALL SELECT '{c}', round({c}, 3) FROM m" for c in KPI_METRICS))
def kpi_counts(spark, sf):
    """Dashboard cards: whole counts of runs, audits, reports, decisions and federated clients, and the metric values."""
    from ledgerlens.plans.q_metrics import scored, triaged
    s = scored(spark, sf)
    card = lambda df, name, n: df.agg(n.cast("double").alias("n")).select(F.lit(name).alias("item"), "n")
    rows = F.count(F.lit(1))
    parts = [card(eval_runs(spark, sf), "runs", F.count_distinct("run_id")), card(fairness_store(spark, sf), "fairness_audits", rows),
             card(drift_store(spark, sf), "drift_reports", rows), card(triaged(spark, sf), "decisions", rows),
             card(s, "federated_clients", F.count_distinct("channel")),
             mt.all_metrics(s).select(F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.round(c, 3).alias("n")) for c in KPI_METRICS])))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("latest_model", f"""SELECT run_id, max("timestamp") AS registered_at FROM (
  SELECT model || '_' || strftime(CAST("timestamp" AS DATE), '%Y%m%d') AS run_id, "timestamp" FROM ({om.MODELS}) m) r
GROUP BY run_id ORDER BY registered_at DESC, run_id DESC LIMIT 1""")
def latest_model(spark, sf):
    """Newest model-registry row (one registry row per evaluation run)."""
    m = cn.scored_models(spark, sf).select(
        F.concat_ws("_", "model", F.translate(F.col("timestamp").cast("date").cast("string"), "-", "")).alias("run_id"), "timestamp")
    reg = m.groupBy("run_id").agg(F.max("timestamp").alias("registered_at"))
    return reg.orderBy(F.desc("registered_at"), F.desc("run_id")).limit(1)


# ------------------------------------------------------------------ data checks

def _halves_ev(spark, sf):
    return halves(cn.tx_events(spark, sf))


def _integrity_sql() -> str:
    cols = {"amount": "n", "lat": "n", "lon": "n", "is_fraud": "n", '"timestamp"': "", **{c: "t" for c in (
        "user_id", "merchant_id", "device_id", "account_id", "currency", "channel", "mcc")}, "tx_id": ""}
    out = []
    for c, kind in cols.items():
        name = c.strip('"')
        out += [f"SELECT 'null_count_reference' AS \"check\", '{name}' AS \"column\", count(*) FILTER ({c} IS NULL) AS value FROM r",
                f"SELECT 'null_count_current', '{name}', count(*) FILTER ({c} IS NULL) FROM k",
                f"SELECT 'constant_current', '{name}', CAST(count(DISTINCT {c}) <= 1 AS BIGINT) FROM k"]
        if kind == "n":
            out.append(f"SELECT 'out_of_reference_range', '{name}', count(*) FILTER ({c} < (SELECT min({c}) FROM r) OR {c} > (SELECT max({c}) FROM r)) FROM k")
        if kind == "t":
            out.append(f"SELECT 'unseen_categories', '{name}', count(DISTINCT {c}) FROM k WHERE {c} NOT IN (SELECT {c} FROM r WHERE {c} IS NOT NULL)")
    out.append("SELECT 'duplicate_keys', 'tx_id', count(tx_id) - count(DISTINCT tx_id) FROM k")
    return f"WITH h AS ({_halves_sql(oc.TX_EVENTS)}), r AS (SELECT * FROM h WHERE _is_ref), k AS (SELECT * FROM h WHERE NOT _is_ref) " + " UNION ALL ".join(out)


@query("integrity_checks", _integrity_sql())
def integrity_checks(spark, sf):
    ref, cur = _halves_ev(spark, sf)
    return gv.integrity_checks(ref, cur)


def _profile_sql() -> str:
    part = """SELECT '{c}' AS "column", avg({c}) FILTER (_is_ref) AS ref_mean, avg({c}) FILTER (NOT _is_ref) AS cur_mean,
  stddev_pop({c}) FILTER (_is_ref) AS ref_std, stddev_pop({c}) FILTER (NOT _is_ref) AS cur_std,
  avg(CAST({c} IS NULL AS INTEGER)) FILTER (_is_ref) AS ref_null_rate, avg(CAST({c} IS NULL AS INTEGER)) FILTER (NOT _is_ref) AS cur_null_rate,
  quantile_cont(CAST({c} AS DOUBLE), 0.5) FILTER (_is_ref) AS ref_median, quantile_cont(CAST({c} AS DOUBLE), 0.5) FILTER (NOT _is_ref) AS cur_median FROM g"""
    body = " UNION ALL ".join(part.format(c=c) for c in [*fx.FEATURE_MATRIX, "is_fraud"])
    r = lambda c: f"round({c}, 5) AS {c}"
    return f"""WITH g AS ({_halves_sql(of.gold_features(oc.TX_EVENTS))}), p AS ({body})
SELECT "column", {r('ref_mean')}, {r('cur_mean')}, round(cur_mean - ref_mean, 5) AS mean_delta, {r('ref_std')}, {r('cur_std')},
  {r('ref_null_rate')}, {r('cur_null_rate')}, {r('ref_median')}, {r('cur_median')},
  round((SELECT avg(is_fraud) FROM g WHERE _is_ref), 5) AS ref_target_rate, round((SELECT avg(is_fraud) FROM g WHERE NOT _is_ref), 5) AS cur_target_rate
FROM p"""


@query("dataset_drift_profile", _profile_sql())
def dataset_drift_profile(spark, sf):
    ref, cur = halves(written(fx.gold_features(cn.tx_events(spark, sf)), "gold"))
    return gv.round_doubles(gv.dataset_drift_profile(ref.select(*fx.FEATURE_MATRIX, "is_fraud"), cur.select(*fx.FEATURE_MATRIX, "is_fraud")), 5)


# ------------------------------------------------------------------ feature-frame variants

@query("channel_one_hot", f"""SELECT *, CAST(channel = 'web' AS INTEGER) AS channel_web, CAST(channel = 'mobile' AS INTEGER) AS channel_mobile,
  CAST(channel = 'pos' AS INTEGER) AS channel_pos FROM ({oc.TX_EVENTS}) t""")
def channel_one_hot(spark, sf):
    return fx.channel_one_hot(cn.tx_events(spark, sf))


@query("fill_null_features", f"""SELECT t.tx_id, coalesce(CAST(x.triangles AS DOUBLE), 0.0) AS triangles
FROM ({oc.TX_EVENTS}) t LEFT JOIN ({og.triangles(og.projection(oc.TX_EVENTS))}) x ON x.node_id = t.tx_id""")
def fill_null_features(spark, sf):
    """Triangle counts left-joined to every transaction (null where none), nulls filled with 0.0."""
    tx = cn.tx_events(spark, sf)
    tri = gr.triangle_count(gr.shared_entity_projection(tx))
    j = tx.select("tx_id").join(tri, tx.tx_id == tri.node_id, "left").select("tx_id", F.col("triangles").cast("double"))
    return fx.fill_null_features(j, ["triangles"])


@query("feature_matrix", f"SELECT tx_id, CAST(is_fraud AS INTEGER) AS is_fraud, "
       f"{', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in fx.FEATURE_MATRIX)} FROM ({of.gold_features(oc.TX_LINEITEM)}) g")
def feature_matrix(spark, sf):
    with fx.in_steps():
        return fx.feature_matrix(fx.gold_features(cn.tx_lineitem(spark, sf)))


# ------------------------------------------------------------------ stored sketches

SKETCHED = [*fx.FEATURE_MATRIX, "is_fraud"]


def _sketch_sql() -> str:
    part = """SELECT '{c}' AS "column", _is_ref, count(*) AS n, count(*) - count({c}) AS nulls, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high
FROM g GROUP BY _is_ref"""
    pick = ", ".join(f"any_value({c}) FILTER ({'' if s == 'ref' else 'NOT '}_is_ref) AS {s}_{c if c != 'n' else 'rows'}"
                     for s in ("ref", "cur") for c in ("n", "nulls", "low", "high"))
    return f"""WITH g AS ({_halves_sql(of.gold_features(oc.TX_EVENTS))}), p AS ({' UNION ALL '.join(part.format(c=c) for c in SKETCHED)})
SELECT "column", {pick}, true AS medians_in_bound, true AS distinct_in_bound FROM p GROUP BY "column\""""


@query("sketch_drift", _sketch_sql())
def sketch_drift(spark, sf):
    """Daily sketches, appended to a stored table and merged into both halves; the medians' ranks and the distinct counts
    are held against the data's own."""
    gold = written(fx.gold_features(cn.tx_events(spark, sf)), "gold")
    ref, cur = halves(gold)
    table = VersionedTable(spark, fresh_dir(spark, "sketches"), ["run_id", "column"], buckets=4)
    for side, df in (("ref", ref), ("cur", cur)):
        table.append(sk.sketch_runs(df, F.concat(F.lit(f"{side}-"), F.to_date("timestamp").cast("string")), SKETCHED))
    both = written(sk.compare(table.read(), F.col("run_id").startswith("ref-")), "sketch-profile")
    exact = None
    for side, df in (("ref", ref), ("cur", cur)):
        long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in SKETCHED])))
        at = long.join(F.broadcast(both.select("column", F.col(f"{side}_median").alias("m"))), "column").groupBy("column").agg(  # a row a column
            F.count_if(F.col("x") < F.col("m")).alias("below"), F.count_if(F.col("x") <= F.col("m")).alias("upto"), F.count("x").alias("n"), F.countDistinct("x").alias("d"))
        fine = at.select("column", ((F.col("below") <= (0.5 + sk.RANK_ERROR) * F.col("n")) & (F.col("upto") >= (0.5 - sk.RANK_ERROR) * F.col("n"))).alias(f"{side}_m"),
                         F.col("d").alias(f"{side}_d"))
        exact = fine if exact is None else exact.join(fine, "column")
    j = both.join(exact, "column")
    near = lambda s: F.abs(F.col(f"{s}_distinct") - F.col(f"{s}_d")) <= F.greatest(F.lit(1.0), sk.DISTINCT_ERROR * F.col(f"{s}_d"))
    return j.select("column", *[f"{s}_{c}" for s in ("ref", "cur") for c in ("rows", "nulls", "low", "high")],
                    (F.col("ref_m") & F.col("cur_m")).alias("medians_in_bound"), (near("ref") & near("cur")).alias("distinct_in_bound"))
