"""Stored sketches against exact figures."""

import math
import random

from pyspark.sql import functions as F

from ledgerlens.operators import sketches as sk


def _data(seed, n, shift=0.0):
    dice = random.Random(seed)
    return [(f"run{i % 7}", dice.gauss(shift, 1), float(dice.randrange(300)), dice.choice([None, math.nan, 1.0, 1.0])) for i in range(n)]


def _sketched(spark, rows, prefix=""):
    df = spark.createDataFrame(rows, "run string, a double, b double, c double").repartition(5)
    return sk.sketch_runs(df, F.concat(F.lit(prefix), "run"), ["a", "b", "c"])


def test_merged_quantiles_keep_the_bound(spark):
    rows = _data(1, 20_000)
    side = sk.merged(_sketched(spark, rows), F.lit("all"))
    for i, c in ((1, "a"), (2, "b")):
        own = sorted(r[i] for r in rows)
        got = side.where(F.col("column") == c).select(*[sk.quantile(p).alias(f"q{k}") for k, p in enumerate((0.01, 0.25, 0.5, 0.9, 0.99))]).first()
        for p, x in zip((0.01, 0.25, 0.5, 0.9, 0.99), got, strict=True):
            below, upto = sum(v < x for v in own) / len(own), sum(v <= x for v in own) / len(own)
            assert below <= p + sk.RANK_ERROR and upto >= p - sk.RANK_ERROR
    r = {x["column"]: x for x in sk.profile(side).collect()}
    assert (r["a"].rows, r["a"].nulls) == (20_000, 0) and r["a"].low == min(x[1] for x in rows) and r["a"].high == max(x[1] for x in rows)
    assert abs(r["a"].distinct - 20_000) <= sk.DISTINCT_ERROR * 20_000 and abs(r["b"].distinct - 300) <= 15
    mean = sum(x[1] for x in rows) / 20_000
    assert abs(r["a"]["mean"] - mean) < 1e-9 and abs(r["a"]["std"] - math.sqrt(sum((x[1] - mean) ** 2 for x in rows) / 20_000)) < 1e-9
    assert r["c"].nulls == sum(x[3] is None or math.isnan(x[3]) for x in rows) and r["c"]["median"] == 1.0


def test_comparison_sees_a_shift(spark):
    same = _sketched(spark, _data(1, 8000), "ref").unionByName(_sketched(spark, _data(2, 8000), "cur"))
    moved = _sketched(spark, _data(1, 8000), "ref").unionByName(_sketched(spark, _data(2, 8000, shift=1.0), "cur"))
    ref = F.col("run_id").startswith("ref")
    a = {r["column"]: r for r in sk.compare(same, ref).collect()}
    b = {r["column"]: r for r in sk.compare(moved, ref).collect()}
    assert a["a"].psi < 0.02 and a["a"].rank_shift < 0.05
    assert b["a"].psi > 0.5 and 0.3 < b["a"].rank_shift < 0.45  # 2 * Phi(1/2) - 1 = 0.38
    assert abs(b["b"].psi) < 0.02


def test_sides_without_values(spark):
    one = _sketched(spark, [("r", None, 1.0, math.nan)], "ref").unionByName(_sketched(spark, [("r", 1.0, 2.0, None)], "cur"))
    got = {r["column"]: r for r in sk.compare(one, F.col("run_id").startswith("ref")).collect()}
    assert got["a"].psi is None and got["a"].ref_median is None and got["a"].ref_nulls == 1 and got["a"].cur_median == 1.0
    assert got["b"].psi is not None and got["c"].psi is None
    assert sk.compare(_sketched(spark, []), F.col("run_id").startswith("ref")).count() == 0
