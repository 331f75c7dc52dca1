"""What large jobs leave on disk: one exchange at a time, nothing that is read no more; and fits of the whole method."""

import glob
import os
import time
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.operators import features as fx
from ledgerlens.operators import graph as gr
from ledgerlens.operators import models as md
from ledgerlens.plans import q_etl, q_features, q_models
from ledgerlens.session import ensure_checkpoint_dir
from ledgerlens.sources import io
from ledgerlens.sources.versioned import VersionedTable
from tests.test_features import _random_rows


def _shuffles(spark):
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob.glob(f"{d.getPath()}/**/shuffle_*", recursive=True)}


def _left(spark, label):
    return glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix('file://')}/{label}-*")


def _raw(spark):
    rows = [(f"t{u:02d}-{i}", f"u{u:02d}", "v", "a", "e", str(i + 1), f"2024-01-{1 + i % 28:02d}T00:00:00", f"name {u}", f"n{u}@x.org", f"TX{u:05d}", u % 2)
            for u in range(20) for i in range(40)]
    rows += rows[:30] + [("bad", "u00", "v", "a", "e", "n/a", "", "name", "m", " ", 0)]  # rows that come twice, one invalid
    df = spark.createDataFrame(rows, "`Transaction ID` string, `Beneficiary-ID` string, vendor_id string, payment_account_id string, endpoint_id string, "
                                     "amount string, event_time string, full_name string, email_address string, taxpayer_id string, is_fraud int")
    return df.repartition(4, F.xxhash64("Transaction ID"))


def test_a_write_lets_go_of_its_shuffle_files(spark):
    before = _shuffles(spark)
    io.written(spark.range(5000).groupBy((F.col("id") % 100).alias("k")).count(), "release-test")
    made, until = _shuffles(spark) - before, time.time() + 20
    io.written(spark.range(10), "release-test")
    while made & _shuffles(spark) and time.time() < until:
        time.sleep(0.2)
    assert not made & _shuffles(spark)


def test_loads_lie_by_user_and_leave_nothing(spark, monkeypatch):
    """Findings F1, F6, F8, F19: hashes that repeat within a user take hardly any space; the same rows are loaded."""
    raw = _raw(spark)
    monkeypatch.setattr(q_etl.cn, "raw_government", lambda s, d: raw)
    staged = {x: set(_left(spark, x)) for x in ("silver-typed", "export")}
    plain = q_etl._silver(raw)
    want = sorted(map(str, plain.drop("etl_run_id").collect()))
    got = q_etl.load_run_idempotent(spark, "")
    for run in ("etl_run_0001", "etl_run_0002"):
        assert sorted(map(str, got.where(F.col("etl_run_id") == run).select(plain.drop("etl_run_id").columns).collect())) == want
    assert len(want) == 800
    assert {x: set(_left(spark, x)) for x in staged} == staged
    users = got.select("user_id", F.input_file_name().alias("f")).groupBy("f").agg(F.collect_list("user_id").alias("u")).collect()
    assert all(r.u == sorted(r.u) for r in users)  # a user's rows lie side by side


def test_gold_in_steps_equals_one_plan(spark, monkeypatch):
    """Findings F2, F5, F9, F11, F12, F21: one scan's exchange at a time; columns that no scan reads stay out of the exchanges."""
    from ledgerlens.operators import pieces

    df, _ = _random_rows(spark, 11, 140)
    ridden = df.withColumn("note", F.concat(F.lit("n"), "amount")).withColumn("_hash", F.unhex(F.sha2(F.col("user_id"), 256)))
    for frame, rows in ((df, 25), (ridden, pieces.HOT_ROWS)):
        whole = fx.gold_features(frame)
        want = sorted(map(str, whole.collect()))
        with monkeypatch.context() as m:
            m.setattr(pieces, "HOT_ROWS", rows)
            with fx.in_steps():
                out = fx.gold_features(frame)
            assert out.columns == whole.columns and sorted(map(str, out.collect())) == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        main = [line.split("RepartitionByExpression [")[1] for line in plan.splitlines() if "RepartitionByExpression [" in line]
        assert not [x for x in main if x.startswith(("merchant_id", "device_id", "account_id"))]
    monkeypatch.setattr(q_features, "tx_lineitem", lambda s, d: df)
    plan = q_features.gold_features(spark, "")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [merchant_id" not in plan and "RepartitionByExpression [user_id" in plan


def test_appended_batches_leave_only_the_state(spark):
    """Finding F5: the frames that an append stands on are deleted."""
    labels = ("state-scanned", "state-source", "scan-others")
    before, new = {x: set(_left(spark, x)) for x in labels}, set(_left(spark, "state-new"))
    df, _ = _random_rows(spark, 12, 60)
    df = df.where(F.col("timestamp").isNotNull())
    out = q_features.appended(spark, df, 1).features()
    assert out.count() == df.count() and {x: set(_left(spark, x)) for x in labels} == before
    assert len(set(_left(spark, "state-new")) - new) <= 1  # the day's rows, not the history


def test_large_joins_of_graphs_run_in_rounds(spark, monkeypatch):
    """Findings F7, F10, F14, F15, F20: any number of rounds gives the same counts and means."""
    labels, write = [], gr.written
    monkeypatch.setattr(gr, "written", lambda df, label: labels.append(label) or write(df, label))
    rng = np.random.default_rng(5)
    pairs = [(f"n{a:02d}", f"n{b:02d}") for a, b in rng.integers(0, 40, (400, 2))]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    plain = {}
    near = {n: {y for x, y in [*pairs, *[(b, a) for a, b in pairs]] if x == n and y != n} for n in {x for p in pairs for x in p}}
    for n in near:
        plain[n] = sum(len(near[n] & near[m]) for m in near[n]) // 2
    for cell, rounds in ((10**6, 1), (20, 4)):
        for hub in (3, 20):
            labels.clear()
            found = {r.node_id: r.triangles for r in gr.triangle_count(edges, cell_edges=cell, hub_degree=hub).collect()}
            assert found == {n: t for n, t in plain.items() if t} and labels.count("triangles-found") == rounds - 1
    nodes = spark.createDataFrame([(f"n{i:02d}", float(i)) for i in range(40)], "tx_id string, f double")
    want = sorted(map(str, gr.neighbor_mean(nodes, edges, ["f"], micro_exact=True).collect()))
    monkeypatch.setattr(gr, "CELL_LINKS", 30)
    labels.clear()
    assert sorted(map(str, gr.neighbor_mean(nodes, edges, ["f"], micro_exact=True).collect())) == want
    assert labels == ["cell-parts"] * 3


def test_an_upsert_exchanges_and_keeps_its_rows_once(spark, tmp_path):
    """Finding F4: the first upsert's rows are what is stored; merged rows leave no copy behind."""
    before = _left(spark, "upsert")
    t = VersionedTable(spark, f"{tmp_path}/t", ["k"], buckets=3)
    df = spark.createDataFrame([(i % 50, i, f"v{i}") for i in range(120)], "k int, at int, v string")
    plan = t._latest(df, ["at"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    folders = lambda: {f for f in os.listdir(f"{tmp_path}/t/data") if not f.startswith(".")}
    t.upsert(df, ["at"])
    assert len(folders()) == 1 and _left(spark, "upsert") == before
    t.upsert(spark.createDataFrame([(k, 1000, "new") for k in range(30)], "k int, at int, v string"), ["at"])
    assert len(folders()) == 2  # the two versions
    got = {r.k: r.v for r in t.read().collect()}
    assert got == {k: "new" if k < 30 else f"v{max(i for i in range(120) if i % 50 == k)}" for k in range(50)}
    t.upsert(df.limit(0), ["at"])
    assert t.read().count() == 50


def test_fits_hold_their_inputs_alone(spark, monkeypatch):
    """Findings F3, F13, F16, F18: a fit keeps no columns that the estimator does not read."""
    seen, weights = [], md.class_weights
    monkeypatch.setattr(md, "class_weights", lambda df: seen.append(df.columns) or weights(df))
    df = spark.range(200).select(F.col("id").cast("string").alias("tx_id"), (F.col("id") % 3 == 0).cast("int").alias("is_fraud"),
                                 (F.col("id") % 3).cast("double").alias("f0"), F.col("id").cast("double").alias("f1"))
    model = md.train_gbt(df, ["f0", "f1"], max_iter=2)
    assert seen == [["is_fraud", "f0", "f1"]] and model.stages[1].getOrDefault("featureSubsetStrategy") == "0.8"
    assert md.score(model, df).where("raw_score > 0.5").count() == df.where("is_fraud = 1").count()


def test_train_pipeline_builds_graphs_and_keeps_the_calibrator(spark, monkeypatch):
    """Finding F22: the named method fits on features and the embeddings of a graph per split."""
    graphs, fits = [], []
    embed, hybrid = md.sage_embeddings, md.train_hybrid
    monkeypatch.setattr(md, "sage_embeddings", lambda split, feats: graphs.append(split.count()) or embed(split, feats))
    monkeypatch.setattr(md, "train_hybrid", lambda train, feats: fits.append(hybrid(train, feats, max_iter=2)) or fits[-1])
    t0 = datetime(2024, 1, 1)
    rows = [(f"t{i}", f"u{i % 7}", f"m{i % 5}", f"d{i % 9}", f"a{i % 6}", float(i * 37 % 101), "USD", t0 + timedelta(hours=i), 1.0, 2.0,
             "web", "x", int(i * 37 % 101 > 70)) for i in range(120)]
    tx = spark.createDataFrame(rows, "tx_id string, user_id string, merchant_id string, device_id string, account_id string, amount double, currency string, "
                                     "timestamp timestamp_ntz, lat double, lon double, channel string, mcc string, is_fraud int")
    monkeypatch.setattr(q_models.cn, "tx_events", lambda s, d: tx)
    before = set(_left(spark, "run"))
    r = q_models.train_pipeline(spark, "").first()
    assert sorted(graphs) == [18, 18, 84] and (r.model_type, r.run_id, r.calibration) == ("graphsage_xgb", "run_graphsage_xgb_0001", "isotonic")
    assert [c for c in fits[0].stages[0].getInputCols() if c.startswith("emb_")] == [f"emb_{j}" for j in range(16)]
    (made,) = set(_left(spark, "run")) - before
    assert {"model", "calibrator"} <= set(os.listdir(made))
