"""Governance helpers: latest-per-key upserts, KPI status, run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.cleansing import dedup_latest


def latest_per_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """Upsert semantics over an append-only log: keep the newest row per key."""
    return dedup_latest(df, key, [order_col])


# KPI thresholds (green, yellow, lower_is_better) of the reference dashboard.
KPI_THRESHOLDS = [
    ("pr_auc", 0.85, 0.70, False),
    ("ece", 0.05, 0.10, True),
    ("brier_score", 0.12, 0.20, True),
    ("recall_at_1pct_fpr", 0.60, 0.40, False),
    ("coverage", 0.93, 0.88, False),
    ("disparity_ratio", 0.80, 0.65, False),
]
DRIFT_FLOOR = 0.2  # fixed value: drift is flagged at this score whatever the caller's threshold


def fairness_groups(df: DataFrame, sensitive: str, y: str = "is_fraud", p: str = "score",
                    threshold: float = 0.5) -> DataFrame:
    """Per group: count, mean score, selection rate, fraud rate, TPR / FPR (null if no denominator)."""
    if sensitive not in df.columns:
        raise ValueError(f"sensitive column not found: {sensitive}")
    pred = (F.col(p) >= F.lit(float(threshold))).cast("int")
    lab = F.coalesce(F.col(y).cast("int"), F.lit(0)) if y in df.columns else F.lit(0)
    base = df.select(F.col(sensitive).cast("string").alias("group"), pred.alias("_pred"), lab.alias("_y"),
                     F.col(p).cast("double").alias("_p"))
    g = base.groupBy("group").agg(
        F.count(F.lit(1)).alias("count"), F.sum("_p").alias("_sp"), F.sum("_pred").alias("positive_predictions"),
        F.sum("_y").alias("_ap"), F.sum(F.col("_pred") * F.col("_y")).alias("_tp"),
        F.sum(F.col("_pred") * (1 - F.col("_y"))).alias("_fp"))
    c = F.col("count")
    return g.select(
        "group", "count",
        (F.col("_sp") / c).alias("avg_score"),
        (F.col("positive_predictions") / c).alias("selection_rate"),
        (F.col("_ap") / c).alias("fraud_rate"),
        F.when(F.col("_ap") > 0, F.col("_tp") / F.col("_ap")).alias("true_positive_rate"),
        F.when(c - F.col("_ap") > 0, F.col("_fp") / (c - F.col("_ap"))).alias("false_positive_rate"),
        F.col("positive_predictions").cast("long").alias("positive_predictions"),
        (c - F.col("positive_predictions")).cast("long").alias("negative_predictions"))


def round_doubles(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    """Round doubles for output (operators themselves return unrounded values)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if f.dataType.typeName() == "double" and (only is None or f.name in only)
                       else F.col(f.name) for f in df.schema.fields])


def fairness_summary(groups: DataFrame) -> DataFrame:
    """Demographic-parity difference, disparate-impact ratio, equal-opportunity difference."""
    s = groups.agg(F.max("selection_rate").alias("_mx"), F.min("selection_rate").alias("_mn"),
                   F.max("true_positive_rate").alias("_tmx"), F.min("true_positive_rate").alias("_tmn"),
                   F.count(F.lit(1)).alias("n_groups"))
    return s.select(
        F.coalesce(F.col("_mx") - F.col("_mn"), F.lit(0.0)).alias("demographic_parity_difference"),
        F.when(F.col("_mx") > 0, F.col("_mn") / F.col("_mx")).otherwise(F.lit(1.0)).alias("disparate_impact_ratio"),
        (F.col("_tmx") - F.col("_tmn")).alias("equal_opportunity_difference"),
        "n_groups")


def fairness_overall(df: DataFrame, y: str = "is_fraud", p: str = "score", threshold: float = 0.5) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col(p).cast("double")).alias("mean_score"),
                  F.avg((F.col(p) >= F.lit(float(threshold))).cast("int")).alias("positive_rate"))


def fairness_audit(df: DataFrame, sensitive: str, y: str = "is_fraud", p: str = "score",
                   threshold: float = 0.5, audit_id: str = "fairness_0001") -> DataFrame:
    """One audit row: summary + overall, tagged with the sensitive column and threshold."""
    summ = fairness_summary(fairness_groups(df, sensitive, y, p, threshold))
    over = fairness_overall(df, y, p, threshold)
    return summ.crossJoin(over).select(
        F.lit(audit_id).alias("audit_id"), F.lit(sensitive).alias("sensitive_column"),
        F.lit(float(threshold)).alias("threshold"), "*")


def drift_features(ref: DataFrame, cur: DataFrame, features: list[str]) -> DataFrame:
    """Per feature |mean_cur - mean_ref| / std_ref (population std; 0 -> 1), long form."""
    r = ref.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(features)],
                *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(features)])
    k = cur.agg(*[F.avg(c).alias(f"c_{i}") for i, c in enumerate(features)])
    wide = r.crossJoin(k)  # two one-row aggregates
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{i}").alias("ref_mean"),
                              F.col(f"c_{i}").alias("cur_mean"), F.col(f"s_{i}").alias("ref_std"))
                     for i, c in enumerate(features)])
    long = wide.select(F.inline(rows))
    std = F.when(F.col("ref_std") == 0, F.lit(1.0)).otherwise(F.col("ref_std"))
    return long.withColumn("z", F.abs(F.col("cur_mean") - F.col("ref_mean")) / std)


def drift_score(feat: DataFrame, threshold: float = DRIFT_FLOOR) -> DataFrame:
    s = feat.agg(F.avg(F.least(F.greatest(F.col("z") / 3.0, F.lit(0.0)), F.lit(1.0))).alias("_s"))
    return s.select(F.col("_s").alias("drift_score"),
                    ((F.col("_s") >= DRIFT_FLOOR) | (F.col("_s") >= threshold)).alias("is_drift"),
                    F.lit(float(threshold)).alias("threshold"))


def kpi_status(metrics_long: DataFrame, spark=None) -> DataFrame:
    """(metric, value) -> status good / warning / critical by direction-aware thresholds; unknown -> neutral."""
    spark = spark or metrics_long.sparkSession
    th = spark.createDataFrame(KPI_THRESHOLDS, "metric string, green double, yellow double, lower_is_better boolean")
    j = metrics_long.join(F.broadcast(th), "metric", "left")  # six fixed rows
    v, g, yl = F.col("value"), F.col("green"), F.col("yellow")
    status = (F.when(F.col("green").isNull(), "neutral")
              .when(F.col("lower_is_better"), F.when(v <= g, "good").when(v <= yl, "warning").otherwise("critical"))
              .otherwise(F.when(v >= g, "good").when(v >= yl, "warning").otherwise("critical")))
    return j.select("metric", "value", status.alias("status"))


def _stacked(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    """One row per (row, column): the value as text and, for numbers, as a double."""
    kinds = dict(df.dtypes)
    number = lambda c: F.col(c).cast("double") if kinds[c] in ("double", "float", "int", "bigint") else F.lit(None).cast("double")
    return df.select(F.lit(side).alias("side"), F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), number(c).alias("num")) for c in columns])))


def integrity_checks(ref: DataFrame, cur: DataFrame, key: str = "tx_id") -> DataFrame:
    """Two-dataset integrity profile (re-aimed validation suite), one row per (check, column).

    Checks: null count in each dataset, constant column in current (at most one distinct value), current rows outside
    the reference range of a numeric column, categories of a text column unseen in reference (null is no category),
    rows repeating a key.  Both datasets are read once: everything follows from (column, value) counts.
    """
    kinds = dict(cur.dtypes)
    num = [c for c in cur.columns if kinds[c] in ("double", "int", "bigint")]
    txt = [c for c in cur.columns if kinds[c] == "string" and c != key]
    both = _stacked(ref, cur.columns, "r").unionByName(_stacked(cur, cur.columns, "c"))
    is_ref = (F.col("side") == "r").cast("long")
    v = both.groupBy("column", "value", "num").agg(F.sum(is_ref).alias("r"), F.sum(1 - is_ref).alias("c"))
    has = F.col("value").isNotNull()
    per = v.groupBy("column").agg(
        F.sum(F.when(~has, F.col("r")).otherwise(0)).alias("null_ref"), F.sum(F.when(~has, F.col("c")).otherwise(0)).alias("null_cur"),
        F.count_if(has & (F.col("c") > 0)).alias("distinct"), F.count_if(has & (F.col("c") > 0) & (F.col("r") == 0)).alias("unseen"),
        F.sum("c").alias("rows"), F.min(F.when(F.col("r") > 0, F.col("num"))).alias("lo"),
        F.max(F.when(F.col("r") > 0, F.col("num"))).alias("hi"))
    # a row a column
    out = v.join(F.broadcast(per.select("column", "lo", "hi")), "column").groupBy("column").agg(
        F.sum(F.when((F.col("num") < F.col("lo")) | (F.col("num") > F.col("hi")), F.col("c")).otherwise(0)).alias("outside"))
    one = per.join(out, "column")
    check = lambda name, value, on=F.lit(True): F.when(on, F.struct(F.lit(name).alias("check"), value.cast("long").alias("value")))
    checks = F.array(
        check("null_count_reference", F.col("null_ref")), check("null_count_current", F.col("null_cur")),
        check("constant_current", F.col("distinct") <= 1),
        check("out_of_reference_range", F.col("outside"), F.col("column").isin(*num) if num else F.lit(False)),
        check("unseen_categories", F.col("unseen"), F.col("column").isin(*txt) if txt else F.lit(False)),
        check("duplicate_keys", F.col("rows") - F.col("null_cur") - F.col("distinct"), F.col("column") == key))
    return one.select("column", F.inline(F.array_compact(checks))).select("check", "column", "value")


def dataset_drift_profile(ref: DataFrame, cur: DataFrame, target: str = "is_fraud") -> DataFrame:
    """Per numeric column: mean / std / null rate / exact median of both datasets and their deltas, plus target rates.

    One stacked pass gives (side, column, value) counts; medians are order statistics of those counts.
    """
    from ledgerlens.operators.metrics import with_ranks

    kinds = dict(cur.dtypes)
    num = [c for c in cur.columns if kinds[c] in ("double", "int", "bigint") and c in ref.columns]
    both = _stacked(ref, num, "ref").unionByName(_stacked(cur, num, "cur"))
    v = both.groupBy("side", "column", (F.col("num") + 0.0).alias("num")).agg(F.count(F.lit(1)).alias("c"))
    known = v.where("num is not null")
    basic = v.groupBy("side", "column").agg(
        F.sum("c").alias("rows"), F.sum(F.when(F.col("num").isNotNull(), F.col("c")).otherwise(0)).alias("n"),
        (F.sum(F.col("num") * F.col("c")) / F.sum(F.when(F.col("num").isNotNull(), F.col("c")))).alias("mean"))
    ranked = with_ranks(known, ["side", "column"], "num", ["c"]).join(basic, ["side", "column"])
    at = lambda i: F.max(F.when((F.col("c_below") <= i) & (i < F.col("c_below") + F.col("c")), F.col("num")))
    spread = ranked.groupBy("side", "column").agg(
        F.sqrt(F.sum(F.col("c") * F.pow(F.col("num") - F.col("mean"), 2)) / F.sum("c")).alias("std"),
        ((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2.0).alias("median"))
    side = basic.join(spread, ["side", "column"], "left").withColumn("null_rate", 1 - F.col("n") / F.col("rows"))
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    wide = side.groupBy("column").agg(*[pick(s, c).alias(f"{s}_{c}") for s in ("ref", "cur") for c in ("mean", "std", "null_rate", "median")])
    rates = wide.where(F.col("column") == target).select(F.col("ref_mean").alias("ref_target_rate"), F.col("cur_mean").alias("cur_target_rate"))
    return wide.crossJoin(rates).select(  # one row
        "column", "ref_mean", "cur_mean", (F.col("cur_mean") - F.col("ref_mean")).alias("mean_delta"), "ref_std", "cur_std",
        "ref_null_rate", "cur_null_rate", "ref_median", "cur_median", "ref_target_rate", "cur_target_rate")


def fairness_audits(df: DataFrame, by: str, sensitive: list[str], y: str = "is_fraud", p: str = "score",
                    threshold: float = 0.5) -> DataFrame:
    """Fairness summaries for every (``by``, sensitive column) in one grouped pass over the scores."""
    pred, lab = (F.col(p) >= F.lit(float(threshold))).cast("int"), F.coalesce(F.col(y).cast("int"), F.lit(0))
    long = df.select(by, pred.alias("_pred"), lab.alias("_y"), F.inline(F.array(*[F.struct(
        F.lit(c).alias("sensitive_column"), F.col(c).cast("string").alias("group")) for c in sensitive])))
    g = long.groupBy(by, "sensitive_column", "group").agg(
        F.count(F.lit(1)).alias("_c"), F.sum("_pred").alias("_sel"), F.sum("_y").alias("_ap"), F.sum(F.col("_pred") * F.col("_y")).alias("_tp"))
    rates = g.select(by, "sensitive_column", (F.col("_sel") / F.col("_c")).alias("_s"),
                     F.when(F.col("_ap") > 0, F.col("_tp") / F.col("_ap")).alias("_t"))
    s = rates.groupBy(by, "sensitive_column").agg(F.max("_s").alias("_mx"), F.min("_s").alias("_mn"), F.max("_t").alias("_tmx"),
                                                  F.min("_t").alias("_tmn"))
    return s.select(by, "sensitive_column", F.lit(float(threshold)).alias("threshold"),
                    (F.col("_mx") - F.col("_mn")).alias("demographic_parity_difference"),
                    F.when(F.col("_mx") > 0, F.col("_mn") / F.col("_mx")).otherwise(F.lit(1.0)).alias("disparate_impact_ratio"),
                    (F.col("_tmx") - F.col("_tmn")).alias("equal_opportunity_difference"))


def drift_reports(df: DataFrame, by: str, column: str, time_us: Column, threshold: float = DRIFT_FLOOR) -> DataFrame:
    """Per ``by`` value the drift score of one column, first against second half of its time span, in grouped passes."""
    k = df.select(by, F.col(column).cast("double").alias("_x"), time_us.alias("_t"))
    mid = k.groupBy(by).agg(F.floor((F.min("_t") + F.max("_t")) / F.lit(2)).cast("long").alias("_mid"))
    j = k.join(mid, by)
    is_ref = F.col("_t") < F.col("_mid")
    s = j.groupBy(by).agg(F.avg(F.when(is_ref, F.col("_x"))).alias("_rm"), F.avg(F.when(~is_ref, F.col("_x"))).alias("_cm"),
                          F.stddev_pop(F.when(is_ref, F.col("_x"))).alias("_rs"))
    z = F.abs(F.col("_cm") - F.col("_rm")) / F.when(F.col("_rs") == 0, F.lit(1.0)).otherwise(F.col("_rs"))
    score = F.least(F.greatest(z / 3.0, F.lit(0.0)), F.lit(1.0))
    return s.select(by, score.alias("drift_score"), ((score >= DRIFT_FLOOR) | (score >= threshold)).alias("is_drift"))
