"""Dataset splits: chronological, seeded random, rolling folds, concatenation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.columns import epoch_micros
from ledgerlens.operators.ranking import global_row_number


def _assign(ranked: DataFrame, train_ratio: float, validation_ratio: float, rn: str = "_rn") -> DataFrame:
    """Cut a 0-based global rank into train / validation / test by floor boundaries."""
    total = ranked.agg(F.count(F.lit(1)).alias("_n"))  # one row
    train_end = F.floor(F.col("_n") * F.lit(float(train_ratio)))
    val_end = F.floor(F.col("_n") * F.lit(float(train_ratio + validation_ratio)))
    return (ranked.crossJoin(total)
            .withColumn("split", F.when(F.col(rn) < train_end, "train")
                        .when(F.col(rn) < val_end, "validation").otherwise("test"))
            .drop("_n", rn))


def chronological_split(df: DataFrame, train_ratio: float = 0.7, validation_ratio: float = 0.15) -> DataFrame:
    """Label rows train/validation/test by time rank (ties by ``tx_id``); floor cut-offs.

    The global rank is computed without a single-task window (see
    ``ranking.global_row_number``).
    """
    keyed = df.withColumn("_ts", epoch_micros("timestamp"))
    ranked = global_row_number(keyed, ["_ts", "tx_id"], name="_rn").drop("_ts")
    return _assign(ranked, train_ratio, validation_ratio)


def shuffle_key(seed: int, key: str = "tx_id"):
    """Seeded, engine-independent shuffle order: sha256 of ``seed:key``."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def random_split(df: DataFrame, train_ratio: float = 0.7, validation_ratio: float = 0.15, seed: int = 7) -> DataFrame:
    """Seeded shuffle then the same floor cut-offs as the chronological split."""
    keyed = df.withColumn("_shuffle", shuffle_key(seed))
    ranked = global_row_number(keyed, ["_shuffle"], name="_rn").drop("_shuffle")
    return _assign(ranked, train_ratio, validation_ratio)


def rolling_folds(df: DataFrame, window_days: int = 7, min_train: int = 100, min_test: int = 10) -> DataFrame:
    """Rolling evaluation folds (variant): one row per kept fold.

    Window starts are ``min + 10*w, +w, ...`` while ``start + w <= max``;
    fold k trains on everything before its start and tests on
    ``[start, start + w)``.  Candidates with train <= ``min_train`` or test
    <= ``min_test`` rows are skipped and the rest numbered from 0; when none
    is left, the chronological split is the only fold.  Sizes
    come from a histogram of rows per window bucket (bounded by span / w),
    so the data is scanned once and never joined per fold.
    """
    w_us = window_days * 86_400_000_000
    k = df.select(epoch_micros("timestamp").alias("_ts"))
    lo = k.agg(F.min("_ts").alias("_lo"), F.max("_ts").alias("_hi"))
    hist = (k.crossJoin(lo).groupBy(F.floor((F.col("_ts") - F.col("_lo")) / F.lit(w_us)).cast("long").alias("_b"))
            .agg(F.count(F.lit(1)).alias("_cnt")))
    from pyspark.sql import Window
    hist = hist.withColumn("_before", F.coalesce(F.sum("_cnt").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per bucket
    cand = hist.crossJoin(lo).filter(
        (F.col("_b") >= 10) & (F.col("_lo") + (F.col("_b") + 1) * w_us <= F.col("_hi")))
    kept = cand.filter((F.col("_before") > min_train) & (F.col("_cnt") > min_test))
    start = F.col("_lo") + F.col("_b") * w_us
    to_ts = lambda c: F.timestamp_add("MICROSECOND", c, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    folds = kept.select(
        (F.row_number().over(Window.orderBy("_b")) - 1).cast("int").alias("fold"),
        to_ts(start).alias("window_start"), to_ts(start + w_us).alias("window_end"),
        F.col("_before").cast("long").alias("train_rows"), F.col("_cnt").cast("long").alias("test_rows"))
    # no fold qualifies: the chronological split (0.7 / 0.15 / 0.15) is the only one, without a window
    n = hist.agg(F.sum("_cnt").alias("_n")).crossJoin(kept.agg(F.count(F.lit(1)).alias("_kept")))  # one row
    none = F.lit(None).cast("timestamp_ntz")
    whole = n.where("_kept = 0 and _n > 0").select(
        F.lit(0).alias("fold"), none.alias("window_start"), none.alias("window_end"),
        F.floor(F.col("_n") * 0.7).cast("long").alias("train_rows"),
        (F.col("_n") - F.floor(F.col("_n") * 0.85)).cast("long").alias("test_rows"))
    return folds.unionByName(whole)


def fold_rows(df: DataFrame, folds: DataFrame, fold: int, role: str) -> DataFrame:
    """Materialise one side of one fold (train = all rows before the window start)."""
    f = folds.filter(F.col("fold") == fold).select("window_start", "window_end")
    cond = (F.col("timestamp") < F.col("window_start")) if role == "train" else \
        ((F.col("timestamp") >= F.col("window_start")) & (F.col("timestamp") < F.col("window_end")))
    return df.crossJoin(F.broadcast(f)).filter(cond).drop("window_start", "window_end")  # f has one row


def concat_splits(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
