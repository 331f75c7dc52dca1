"""Model-quality metrics as distributed aggregations over exact scores.

Rows are first aggregated to one row per distinct score (a double, never rounded).  What depends on score order
(PR-AUC, ROC-AUC, recall at an FPR, order statistics) then needs counts above and below each score: the distinct
scores are cut into pieces that are a monotone function of the score, running counts work inside a piece, and the
totals of the other pieces (a few thousand rows at most) are carried.  No window runs over all scores.

Results are unrounded doubles.  Every function takes ``group`` columns; with none it computes one global row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UNB = Window.unboundedPreceding


def _g(group: Sequence[str] | str | None) -> list[str]:
    if not group:
        return []
    return [group] if isinstance(group, str) else list(group)


def prep(df: DataFrame, y: str = "is_fraud", p: str = "score", group=None) -> DataFrame:
    """(group..., _y int, _s score); negative zero counts as zero."""
    return df.select(*_g(group), F.col(y).cast("int").alias("_y"), (F.col(p).cast("double") + 0.0).alias("_s"))


def score_piece(s: str | Column) -> Column:
    """A piece number that never falls as the value rises: 1/4096 steps up to 1, logarithmic ones beyond and near 0."""
    s = F.col(s) if isinstance(s, str) else s
    a = F.abs(s)
    size = (F.when(a > 1, F.floor(F.log(a) * 200) + 5000).when(a >= 1.0 / 16, F.floor(a * 4096))
            .otherwise(F.greatest(F.floor(F.log(a) * 24) - 100, F.lit(-30_000)))) + 40_000
    return F.when(s > 0, size).when(s < 0, -size).otherwise(F.lit(0)).cast("long")


def with_ranks(values: DataFrame, group: list[str], order: str, counts: Sequence[str]) -> DataFrame:
    """Add ``<c>_below``: the sum of ``c`` over rows of the group with a smaller ``order``; ``order`` is distinct there."""
    d = values.withColumn("_piece", score_piece(order))
    w = Window.partitionBy(*group, "_piece").orderBy(order).rowsBetween(_UNB, -1)
    local = d.withColumns({f"_l_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in counts})
    per = d.groupBy(*group, "_piece").agg(*[F.sum(c).alias(f"_t_{c}") for c in counts])
    wp = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("_piece").rowsBetween(_UNB, -1)
    carry = per.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_piece").alias("_cp"),
                       *[F.coalesce(F.sum(f"_t_{c}").over(wp), F.lit(0)).alias(f"_b_{c}") for c in counts])  # a row a piece
    cond = F.col("_piece") == F.col("_cp")
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    j = local.join(carry, cond)
    return j.select(*values.columns, *[(F.col(f"_l_{c}") + F.col(f"_b_{c}")).alias(f"{c}_below") for c in counts])


def score_counts(df: DataFrame, y: str = "is_fraud", p: str = "score", group=None) -> DataFrame:
    """One row per (group, distinct score): count and positives."""
    g = _g(group)
    return prep(df, y, p, g).groupBy(*g, "_s").agg(F.count(F.lit(1)).alias("_c"), F.sum("_y").cast("long").alias("_pos"))


def _join_group(a: DataFrame, b: DataFrame, g: list[str]) -> DataFrame:
    if not g:
        return a.crossJoin(b)  # one row each side or a one-row aggregate
    r = b.select(*[F.col(c).alias(f"_j_{c}") for c in g], *[c for c in b.columns if c not in g])
    cond = F.lit(True)
    for c in g:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_j_{c}"))
    return a.join(r, cond).drop(*[f"_j_{c}" for c in g])


def ranking_metrics(df: DataFrame, y: str = "is_fraud", p: str = "score", group=None,
                    target_fpr: float = 0.01) -> DataFrame:
    """PR-AUC (step-wise average precision), ROC-AUC (mid-rank) and recall at FPR <= target.

    All three are 0.0 when a group holds a single class (reference behaviour).
    """
    g = _g(group)
    sc = score_counts(df, y, p, g)
    totals = sc.groupBy(*g).agg(F.sum("_c").alias("_n"), F.sum("_pos").alias("_P"))
    r = _join_group(with_ranks(sc, g, "_s", ["_c", "_pos"]), totals, g)
    # selected at a threshold: everything not below it
    r = r.withColumns({"_cum": F.col("_n") - F.col("_c_below"), "_tpc": F.col("_P") - F.col("_pos_below")})
    fpr = (F.col("_cum") - F.col("_tpc")).cast("double") / (F.col("_n") - F.col("_P")).cast("double")
    agg = r.groupBy(*g, "_n", "_P").agg(
        F.sum(F.col("_pos") * F.col("_tpc") / F.col("_cum")).alias("_ap"),
        # positives above negatives, ties half: doubled to stay whole
        F.sum(F.col("_pos").cast("decimal(38,0)") * ((F.col("_c_below") - F.col("_pos_below")) * 2 + F.col("_c") - F.col("_pos"))).alias("_wins"),
        F.max(F.when(fpr <= F.lit(target_fpr), F.col("_tpc"))).alias("_tp_at"))
    neg = F.col("_n") - F.col("_P")
    one_class = (F.col("_P") == 0) | (neg == 0)
    return agg.select(
        *g,
        F.when(one_class, F.lit(0.0)).otherwise(F.col("_ap") / F.col("_P")).alias("pr_auc"),
        F.when(one_class, F.lit(0.0)).otherwise(F.col("_wins").cast("double") / (F.lit(2.0) * F.col("_P") * neg)).alias("roc_auc"),
        F.when(one_class, F.lit(0.0)).otherwise(F.coalesce(F.col("_tp_at"), F.lit(0)) / F.col("_P")).alias("recall_at_1pct_fpr"),
    )


def _bin(s: Column, bins: int = 10) -> Column:
    """Equal bins of [0, 1], lower edge included, the last one closed; null outside.  Edges are the doubles i * (1 / bins)."""
    step = 1.0 / bins
    inner = sum((s >= F.lit(i * step)).cast("int") for i in range(1, bins))
    return F.when((s >= 0) & (s <= 1), inner)


def calibration_metrics(df: DataFrame, y: str = "is_fraud", p: str = "score", group=None) -> DataFrame:
    """Brier score and 10-bin ECE (last bin closed), 0.0 on empty input."""
    g = _g(group)
    bins = prep(df, y, p, g).groupBy(*g, _bin(F.col("_s")).alias("_b")).agg(
        F.count(F.lit(1)).alias("_c"), F.sum("_y").alias("_sy"), F.sum("_s").alias("_sp"),
        F.sum(F.pow(F.col("_s") - F.col("_y"), 2)).alias("_sq"))
    agg = bins.groupBy(*g).agg(
        F.sum("_c").alias("_n"), F.sum("_sq").alias("_sq"),
        F.sum(F.when(F.col("_b").isNotNull(), F.abs(F.col("_sy") - F.col("_sp")))).alias("_gap"))
    n = F.col("_n")
    zero = n.isNull() | (n == 0)
    return agg.select(
        *g, F.when(zero, F.lit(0.0)).otherwise(F.col("_sq") / n).alias("brier"),
        F.when(zero, F.lit(0.0)).otherwise(F.coalesce(F.col("_gap"), F.lit(0.0)) / n).alias("ece"))


def reliability_curve(df: DataFrame, y: str = "is_fraud", p: str = "score", bins: int = 10) -> DataFrame:
    return prep(df, y, p).groupBy(_bin(F.col("_s"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), (F.sum("_y") / F.count(F.lit(1))).alias("fraction_positive"),
        (F.sum("_s") / F.count(F.lit(1))).alias("mean_predicted")).where("bin is not null")


def all_metrics(df: DataFrame, y: str = "is_fraud", p: str = "score", group=None, prefix: str = "") -> DataFrame:
    """PR-AUC, ROC-AUC, Brier, ECE and recall@1%FPR in one row per group."""
    g = _g(group)
    out = _join_group(ranking_metrics(df, y, p, g), calibration_metrics(df, y, p, g), g)
    cols = ["pr_auc", "roc_auc", "brier", "ece", "recall_at_1pct_fpr"]
    return out.select(*g, *[F.col(c).alias(prefix + c) for c in cols])


def model_checks(df: DataFrame, y: str = "is_fraud", p: str = "score") -> DataFrame:
    """Fallback model gate: PR-AUC > 0.5, ROC-AUC > 0.6, Brier < 0.25."""
    m = all_metrics(df, y, p)
    return m.select(
        "pr_auc", "roc_auc", F.col("brier").alias("brier_score"),
        (F.col("pr_auc") > 0.5).alias("pr_auc_pass"), (F.col("roc_auc") > 0.6).alias("roc_auc_pass"),
        (F.col("brier") < 0.25).alias("brier_pass"),
    ).withColumn("all_passed", F.col("pr_auc_pass") & F.col("roc_auc_pass") & F.col("brier_pass"))


def compare_runs(metrics: DataFrame, model_col: str = "model") -> DataFrame:
    """Best model per metric: max for PR-AUC / ROC-AUC / recall, min for Brier / ECE."""
    return metrics.agg(
        F.max_by(model_col, F.struct("pr_auc", F.col(model_col))).alias("best_pr_auc"),
        F.max_by(model_col, F.struct("roc_auc", F.col(model_col))).alias("best_roc_auc"),
        F.max_by(model_col, F.struct("recall_at_1pct_fpr", F.col(model_col))).alias("best_recall_at_1pct_fpr"),
        F.min_by(model_col, F.struct("brier", F.col(model_col))).alias("best_brier"),
        F.min_by(model_col, F.struct("ece", F.col(model_col))).alias("best_ece"),
    )
