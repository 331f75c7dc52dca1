"""Stored, mergeable column sketches: datasets are compared without being read again.

Every run (a day, a load, a model's training set) leaves one row per column: counts, range, sums, a quantile sketch (KLL)
and a distinct-count sketch (HyperLogLog).  Rows of several runs merge into one profile; two profiles give medians, null
rates, distinct counts, a population stability index and the largest rank difference.  All of it is a few kilobytes a
column and run, whatever the data's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILE_K = 400  # rank error below RANK_ERROR
RANK_ERROR = 0.02
DISTINCT_BITS = 14
DISTINCT_ERROR = 0.05
BINS = 10
GRID = 200


def sketch_runs(df: DataFrame, run: Column, columns: list[str]) -> DataFrame:
    """One row per (run_id, column): rows, nulls, total, squares, low, high, ``quantiles`` and ``distinct`` sketches.

    Values count as doubles; NaN counts as null.  Partial sketches are built where the rows are; a run's rows never meet.
    """
    clean = df.select(run.cast("string").alias("run_id"), *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"x{i}")
                                                             for i, c in enumerate(columns)])
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(columns)):
        x = F.col(f"x{i}")
        aggs += [F.count(x).alias(f"n{i}"), F.sum(x).alias(f"t{i}"), F.sum(x * x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
                 F.kll_sketch_agg_double(x, F.lit(QUANTILE_K)).alias(f"q{i}"), F.hll_sketch_agg(x.cast("string"), F.lit(DISTINCT_BITS)).alias(f"d{i}")]
    wide = clean.groupBy("run_id").agg(*aggs)
    return wide.select("run_id", F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col("rows"), (F.col("rows") - F.col(f"n{i}")).alias("nulls"), F.col(f"t{i}").alias("total"), F.col(f"s{i}").alias("squares"),
        F.col(f"lo{i}").alias("low"), F.col(f"hi{i}").alias("high"), F.col(f"q{i}").alias("quantiles"), F.col(f"d{i}").alias("distinct"))
        for i, c in enumerate(columns)])))


def merged(sketches: DataFrame, by: Column) -> DataFrame:
    """The profiles of groups of runs: one row per (side, column)."""
    return sketches.groupBy(by.alias("side"), "column").agg(
        *[F.sum(c).alias(c) for c in ("rows", "nulls", "total", "squares")], F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def quantile(p: float, sketch: str = "quantiles") -> Column:
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(float(p)))


def profile(side: DataFrame) -> DataFrame:
    """Readable figures of merged sketches; a column without values has nulls there."""
    n = F.col("rows") - F.col("nulls")
    some = lambda c: F.when(n > 0, c)
    mean = F.col("total") / n
    return side.select("side", "column", "rows", "nulls", "low", "high", some(mean).alias("mean"),
                       some(F.sqrt(F.greatest(F.col("squares") / n - mean * mean, F.lit(0.0)))).alias("std"),
                       some(quantile(0.5)).alias("median"), F.hll_sketch_estimate("distinct").alias("distinct"), "quantiles")


def compare(sketches: DataFrame, reference: Column, bins: int = BINS) -> DataFrame:
    """Reference runs (where ``reference`` is true) against the others, column by column.

    ``psi``: stability index over the reference's quantile bins (shares floored at 1e-4); ``rank_shift``: the largest
    difference of ranks at the bins' ends.  Columns that one side lacks, or has no values of, get nulls.
    """
    sides = profile(merged(sketches, F.when(reference, "ref").otherwise("cur")))
    pick = lambda s: sides.where(F.col("side") == s).select("column", *[F.col(c).alias(f"{s}_{c}") for c in sides.columns if c not in ("side", "column")])
    both = pick("ref").join(pick("cur"), "column", "full")
    # ranks are read off a grid of each side's quantiles: a sketch gives ranks of constants only
    grid = F.array(*[F.lit((k + 0.5) / GRID) for k in range(GRID)])
    both = both.withColumns({f"_{s}": F.when(F.col(f"{s}_median").isNotNull(), F.kll_sketch_get_quantile_double(f"{s}_quantiles", grid)) for s in ("ref", "cur")})
    ends = [F.get("_ref", F.lit(round(k * GRID / bins))) for k in range(1, bins)]
    rank = lambda s, x: F.size(F.filter(f"_{s}", lambda v: v <= x)) / float(GRID)
    ok = F.col("ref_median").isNotNull() & F.col("cur_median").isNotNull()
    ranked = both.withColumn("_r", F.when(ok, F.array(F.lit(0.0), *[rank("ref", x) for x in ends], F.lit(1.0)))) \
                 .withColumn("_c", F.when(ok, F.array(F.lit(0.0), *[rank("cur", x) for x in ends], F.lit(1.0))))
    share = lambda a: F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda k: F.greatest(F.get(a, k) - F.get(a, k - 1), F.lit(1e-4)))
    terms = F.zip_with(share(F.col("_r")), share(F.col("_c")), lambda r, c: (c - r) * F.log(c / r))
    shift = F.zip_with("_r", "_c", lambda r, c: F.abs(r - c))
    return ranked.select("column", *[c for c in both.columns if c not in ("column", "_ref", "_cur") and not c.endswith("_quantiles")],
                         F.when(ok, F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)).alias("psi"), F.when(ok, F.array_max(shift)).alias("rank_shift"))
