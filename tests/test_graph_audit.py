"""Graph links, ranking, hashing, redaction, search against brute force."""

import hashlib
import json
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.operators import audit as au
from ledgerlens.operators import graph as gr
from ledgerlens.operators import search as se
from ledgerlens.operators.ranking import global_row_number

SCHEMA = "tx_id string, user_id string, merchant_id string, device_id string, account_id string, timestamp timestamp_ntz"


def test_prior_links_lookback_then_time_filter(spark):
    t0 = datetime(2024, 1, 1)
    days = [0, 1, 2, 3, 4, 5, 40]
    rows = [(f"t{i}", "u", f"m{i}", f"d{i}", f"a{i}", t0 + timedelta(days=d)) for i, d in enumerate(days)]
    e = gr.prior_link_edges(spark.createDataFrame(rows, SCHEMA)).filter(F.col("edge_type") == "user")
    pairs = {(r.src, r.dst) for r in e.collect()}
    # t5 links to its 5 predecessors; t6 (35+ days later) keeps none of its last 5
    assert {("t0", "t5"), ("t4", "t5")} <= pairs and not any("t6" in p for p in pairs)
    assert ("t5", "t0") in pairs  # both directions


def test_triangles_brute_force(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("b", "d"), ("d", "e")]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r.node_id: r.triangles for r in gr.triangle_count(df).collect()}
    adj = {}
    for s, d in edges:
        adj.setdefault(s, set()).add(d)
        adj.setdefault(d, set()).add(s)
    want = {u: sum(len(adj[u] & adj[v]) for v in adj[u]) // 2 for u in adj}
    assert got == {k: v for k, v in want.items() if v}


def test_global_row_number_is_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"))
    out = global_row_number(df, ["k"], num_partitions=7).collect()
    assert sorted(r.row_number for r in out) == list(range(5000))
    assert all(r.row_number == r.k for r in out)


def test_decision_hash_is_key_order_invariant_hex(spark):
    base = dict(tx_id="t", user_id="u", merchant_id="m", device_id="d", account_id="a", amount=1.5, currency="USD",
                timestamp=datetime(2024, 1, 1), lat=1.0, lon=2.0, channel="web", mcc="x", score=0.5,
                confidence=0.5, confidence_band="review_needed", model_run_id="r", raw_score=0.4, explanation="why")
    a = spark.createDataFrame([base])
    b = spark.createDataFrame([dict(reversed(list(base.items())))])
    ha = a.select(au.decision_hash_col().alias("h")).first().h
    hb = b.select(au.decision_hash_col().alias("h")).first().h
    assert ha == hb and len(ha) == 64
    doc = a.select(F.to_json(F.struct(F.col("model_run_id"), au.payload_struct().alias("payload"),
                                      au.prediction_struct().alias("prediction"))).alias("j")).first().j
    assert hashlib.sha256(doc.encode()).hexdigest() == ha and list(json.loads(doc)) == sorted(json.loads(doc))


def test_redaction(spark):
    df = spark.createDataFrame([('User U_000123 from device D_000456 {"lat": 12.5}',)], "t string")
    out = df.select(au.redact_text(F.col("t")).alias("t")).first().t
    assert out == "User [REDACTED] from device [REDACTED] {[REDACTED]}"


def test_nearest_l2_brute_force(spark):
    rng = np.random.default_rng(1)
    ref = rng.normal(size=(40, 3))
    q = rng.normal(size=(6, 3))
    rdf = spark.createDataFrame([(f"r{i}", i % 2, *map(float, v)) for i, v in enumerate(ref)], "tx_id string, is_fraud int, a double, b double, c double")
    qdf = spark.createDataFrame([(f"q{i}", *map(float, v)) for i, v in enumerate(q)], "tx_id string, a double, b double, c double")
    got = {(r.query_id, r.rank): r.ref_id for r in se.nearest_l2(qdf, rdf, ["a", "b", "c"], k=3).collect()}
    for i, v in enumerate(q):
        order = np.argsort(np.sqrt(((ref - v) ** 2).sum(1)))[:3]
        assert [got[(f"q{i}", k + 1)] for k in range(3)] == [f"r{j}" for j in order]


def test_nearest_over_many_tiles_equals_brute_force(spark, monkeypatch):
    """Any number of reference rows and queries; ties go to the smaller id; empty sides give no rows."""
    import numpy as np

    monkeypatch.setattr(se, "TILE_ROWS", 16)
    monkeypatch.setattr(se, "QUERY_ROWS", 7)
    monkeypatch.setattr(se, "PIVOTS", 5)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(230, 3)) + rng.integers(0, 4, 230)[:, None] * 3, 1)
    x[5] = x[100] = x[17]
    ref = spark.createDataFrame([(f"r{i:03d}", i % 2, *map(float, v)) for i, v in enumerate(x)], "tx_id string, is_fraud int, a double, b double, c double")
    q = np.concatenate([x[:20], np.round(rng.normal(size=(11, 3)) * 8, 1)])
    qdf = spark.createDataFrame([(f"q{i:02d}", 0, *map(float, v)) for i, v in enumerate(q)], ref.schema)
    got = se.nearest_l2(qdf, ref, ["a", "b", "c"], k=4).collect()
    want = []
    for i, v in enumerate(q):
        d = ((x - v) ** 2)
        d = d[:, 0] + d[:, 1] + d[:, 2]
        for rank, j in enumerate(np.lexsort((np.arange(len(x)), d))[:4], 1):
            want.append((f"q{i:02d}", rank, f"r{j:03d}", j % 2, round(float(np.sqrt(d[j])), 6)))
    assert sorted((r.query_id, r["rank"], r.ref_id, r.label, r.distance) for r in got) == sorted(want)
    assert se.nearest_l2(qdf, ref.limit(0), ["a", "b", "c"]).count() == 0
    assert se.nearest_l2(qdf.limit(0), ref, ["a", "b", "c"]).count() == 0


def test_regions_of_the_search_are_opened_by_place(spark):
    """Tiles of one part of the space lie apart: a query near its neighbours reaches a few of many regions."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.exponential(1e5, (8000, 1)), rng.normal(size=(8000, 3))], axis=1)
    tree = se._Tree(x[::4], 64)
    region = tree.regions_of(x)
    assert tree.regions == 64 and np.bincount(region).max() < 3 * len(x) / 64
    tree.bound(*[np.array([f(x[region == r], axis=0) for r in range(64)]) for f in (np.min, np.max)])
    q = x[:200]
    reach = np.sort(((q[:, None] - x[None]) ** 2).sum(2), axis=1)[:, 2]
    rows, found = tree.reached(q, reach)
    assert len(rows) < 4 * len(q) and set(zip(range(200), region[:200])) <= set(zip(rows.tolist(), found.tolist()))


def test_nearest_without_distances(spark, monkeypatch):
    """Rows with a null or infinite component come last, by id; a query with one lists the smallest ids."""
    monkeypatch.setattr(se, "TILE_ROWS", 4)
    rows = [(f"r{i:02d}", i % 2, float(i), None if i % 5 == 0 else float("inf") if i % 7 == 0 else 1.0) for i in range(20)]
    ref = spark.createDataFrame(rows, "tx_id string, is_fraud int, a double, b double")
    q = spark.createDataFrame([("q0", 0, 6.2, 1.0), ("q1", 0, None, 1.0)], ref.schema)
    got = {(r.query_id, r["rank"]): r.ref_id for r in se.nearest_l2(q, ref, ["a", "b"], k=3).collect()}
    assert [got["q0", i] for i in (1, 2, 3)] == ["r06", "r08", "r04"] and [got["q1", i] for i in (1, 2, 3)] == ["r00", "r01", "r02"]
    few = {(r.query_id, r["rank"]): r.ref_id for r in se.nearest_l2(q, ref.where("a < 2"), ["a", "b"], k=3).collect()}
    assert [few["q0", i] for i in (1, 2)] == ["r01", "r00"] and [few["q1", i] for i in (1, 2)] == ["r00", "r01"] and len(few) == 4


def test_previous_rows_match_lag_across_many_pieces(spark):
    """A hot key cut into pieces of time: carried tails reproduce lag(1..k) and lead(1..k) exactly."""
    from pyspark.sql import Window

    from ledgerlens.operators.pieces import PIECE_US, order_keys, previous_rows
    rows = [(f"t{i:04d}", "hot" if i % 4 else f"k{i % 9}", (i * 7919) % 1000) for i in range(600)]
    df = spark.createDataFrame(rows, "tx_id string, key string, ts long")
    keyed = df.withColumns(order_keys(F.col("ts") * (PIECE_US // 7)))
    w = Window.partitionBy("key").orderBy("ts", "tx_id")
    for following, fn, k in ((False, F.lag, 3), (True, F.lead, 9)):
        got = {r.tx_id: [p.tx_id for p in r._prev] for r in previous_rows(keyed, "key", ["tx_id"], k, following).collect()}
        for r in df.select("tx_id", F.array(*[fn("tx_id", o).over(w) for o in range(1, k + 1)]).alias("want")).collect():
            assert got[r.tx_id] == [x for x in r.want if x is not None]


def test_previous_rows_exchange_the_frame_and_a_piece_number(spark, monkeypatch):
    """Only hot entities (found by buckets) are cut; the order key ``_id`` is made after the exchange; null keys are an entity."""
    from pyspark.sql import Window

    from ledgerlens.operators import pieces as pc
    monkeypatch.setattr(pc, "HOT_ROWS", 60)
    monkeypatch.setattr(pc, "HOT_BUCKETS", 2)
    rows = [(f"t{i:04d}", ("hot", None, f"k{i % 40}")[i % 3], (i * 7919) % 1000) for i in range(400)]
    df = spark.createDataFrame(rows, "tx_id string, key string, ts long")
    keyed = df.withColumn("_ts", F.col("ts") * (pc.PIECE_US // 7))
    assert sorted(r._h for r in pc.hot_entities(keyed, ["key"]).collect()) == ["key=khot", "key=n"]
    w = Window.partitionBy("key").orderBy("ts", "tx_id")
    for following, fn in ((False, F.lag), (True, F.lead)):
        found = pc.previous_rows(keyed, "key", ["tx_id"], 9, following)
        got = {r.tx_id: [p.tx_id for p in r._prev] for r in found.collect()}
        for r in df.select("tx_id", F.array(*[fn("tx_id", o).over(w) for o in range(1, 10)]).alias("want")).collect():
            assert got[r.tx_id] == [x for x in r.want if x is not None]


def test_triangles_by_coloured_cells(spark):
    import itertools
    import random

    from ledgerlens.operators.graph import triangle_count

    dice = random.Random(4)
    nodes = [f"n{i}" for i in range(60)]
    pairs = {tuple(sorted(dice.sample(nodes, 2))) for _ in range(400)} | {("n0", x) for x in nodes[1:]}  # n0 is a hub
    want = {}
    for t in itertools.combinations(nodes, 3):
        if all(tuple(sorted(p)) in pairs for p in itertools.combinations(t, 2)):
            for x in t:
                want[x] = want.get(x, 0) + 1
    rows = [*pairs, *[(b, a) for a, b in list(pairs)[:50]], ("n1", "n1")]  # both directions, a loop
    edges = spark.createDataFrame(rows, "src string, dst string")
    for cell in (10, 300, 10**6):
        found = triangle_count(edges, cell_edges=cell)
        assert {r.node_id: r.triangles for r in found.collect()} == want
    assert triangle_count(edges.limit(0)).count() == 0
    assert triangle_count(edges.limit(1)).count() == 0


def test_triangles_from_lists_and_cells(spark):
    """Findings F10, F15: corners that are no hub count their triangles from lists, hubs from cells, with equal results."""
    import itertools
    import random

    dice = random.Random(7)
    nodes = [f"n{i:02d}" for i in range(40)]
    pairs = {tuple(sorted(dice.sample(nodes, 2))) for _ in range(250)} | {(h, x) for h in nodes[::13] for x in nodes if x > h}
    want = {}
    for t in itertools.combinations(nodes, 3):
        if all(p in pairs for p in itertools.combinations(t, 2)):
            for x in t:
                want[x] = want.get(x, 0) + 1
    edges = spark.createDataFrame(list(pairs), "src string, dst string")
    for hub in (0, 3, 12, 18, 64):
        found = gr.triangle_count(edges, cell_edges=50, hub_degree=hub).collect()
        assert {r.node_id: r.triangles for r in found} == want


def test_triangle_rows_grow_with_the_edges(spark, monkeypatch):
    """Findings F10, F15: edges of a graph without hubs are copied into no cell."""
    seen = []
    cells = gr._cells
    monkeypatch.setattr(gr, "_cells", lambda e, n: seen.append(e.count()) or cells(e, n))
    edges = spark.range(300).select(F.col("id").alias("src"), F.explode(F.array(*[F.col("id") + k for k in (1, 2, 3)])).alias("dst"))
    found = {r.node_id: r.triangles for r in gr.triangle_count(edges).collect()}
    assert seen == [0] and found[150] == 9 and found[0] == 3


def test_neighbours_are_aggregated_in_cells(spark, monkeypatch):
    """Findings F4, F12, F14, F20: a node's row goes to cells, not to edges; any cells, repeated and null ids give the plain results."""
    monkeypatch.setattr(gr, "CELL_LINKS", 20)
    rng = np.random.default_rng(3)
    ids = [*[f"n{i}" for i in range(30)], "n4", "n9", None]
    x = [(i, float(rng.integers(0, 50)) / 8, None if k % 7 == 3 else float(k)) for k, i in enumerate(ids)]
    pairs = [(f"n{a}", f"n{b}", int(rng.integers(0, 9))) for a, b in rng.integers(0, 33, (150, 2)) if b != 5] + [(None, "n1", 0), ("n1", None, 0)]
    nodes = spark.createDataFrame(x, "tx_id string, f double, g double")
    placed = spark.createDataFrame(pairs, "src string, dst string, place long")
    rows = {}
    for i, f, g in x:
        rows.setdefault(i, []).append((f, g))
    mean = lambda v: sum(v) / len(v) if v else 0.0
    near = lambda i: [r for s, d, _ in pairs if i is not None and s is not None and d == i for r in rows.get(s, [])]
    want = sorted((str(i), round(mean([f for f, _ in near(i)]), 9), round(mean([g for _, g in near(i) if g is not None]), 9)) for i in ids)
    for edges in (placed, placed.drop("place")):
        got = gr.neighbor_mean(nodes, edges, ["f", "g"]).collect()
        assert sorted((str(r.tx_id), round(r.f, 9), round(r.g, 9)) for r in got) == want
        exact = gr.neighbor_mean(nodes, edges, ["f"], micro_exact=True).collect()
        assert all(abs(r.f - w[1]) <= 1e-6 for r, w in zip(sorted(exact, key=lambda r: str(r.tx_id)), sorted(w[:2] for w in want), strict=True) if str(r.tx_id) not in ("n4", "n9"))
    plan = gr.neighbor_mean(nodes, placed, ["f"])._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan

    one = spark.createDataFrame([(i, f, None if i == "n7" else float(k)) for k, (i, f, _) in enumerate(x)], "tx_id string, f double, g double")
    draw = np.random.default_rng(11)
    w, a = draw.normal(0.0, 0.15, size=(2, 8)), draw.normal(0.0, 0.15, size=(16,))
    wh = {}
    for k, (i, f, _) in enumerate(x):
        if i != "n7":
            wh.setdefault(i, []).append(np.array([f, float(k)]) @ w)
    for r in gr.attention_mean(one, placed, ["f", "g"]).collect():
        e = [(np.concatenate([s, d]) @ a, s) for p, q, _ in pairs if q == r.tx_id and q is not None and p is not None
             for s in wh.get(p, []) for d in wh.get(q, [])]
        z = np.array([np.exp(v if v > 0 else 0.2 * v) for v, _ in e])
        plain = sum(zi * s for zi, (_, s) in zip(z, e)) / z.sum() if e else np.zeros(8)
        assert np.allclose([r[f"att_{j}"] for j in range(8)], plain, atol=2e-6)


def test_lineage_sends_no_store_through_the_driver(spark):
    """Finding F1: the stores of a decision are joined by sorting, however small they look."""
    from ledgerlens.plans.q_audit import lineage

    made = spark.sql("select concat('x', id) decision_id, 't' tx_id, 'r' model_run_id, timestamp_ntz'2024-01-01' valid_from, 'm' model_id, "
                     "'1' model_version, 'c' calibration_version, 'f' conformal_version from range(1)")
    one = lambda c: spark.sql(f"select concat('x', id) decision_id, '{{}}' {c} from range(1)")
    hist = spark.sql("select concat('x', id) decision_id, array('replayed') _h, 1L n_replays from range(1)")
    out = lineage(made, one("payload_json"), one("feature_json"), one("markdown"), hist)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 4 and "Broadcast" not in plan
    assert [(r.has_report, r.replay_history, r.n_replays) for r in out.collect()] == [(True, ["replayed"], 1)]


def test_decisions_are_fetched_without_exchanging_texts(spark):
    """Finding F37: parts are joined by the id's bytes, JSON is written after the joins; repeated ids meet as before."""
    from datetime import datetime

    from pyspark.sql import functions as F

    from ledgerlens.operators import audit as au
    from ledgerlens.operators import features as fx
    from ledgerlens.plans.q_audit import fetched
    from ledgerlens.sources.io import written

    rows = [(f"t{i}", "u", "m", "d", "a", 10.5 * i, "USD", datetime(2024, 1, i), 1.0, 2.0, "web", None if i == 2 else "x", 0.25 * i, 0.9, "review_needed", 0.5, "run")
            for i in (1, 2, 3, 3)]
    names = "tx_id user_id merchant_id device_id account_id amount currency timestamp lat lon channel mcc score confidence confidence_band raw_score model_run_id"
    kinds = "string string string string string double string timestamp_ntz double double string string double double string double string"
    d = spark.createDataFrame(rows, ", ".join(f"{a} {b}" for a, b in zip(names.split(), kinds.split(), strict=True)))
    d = d.withColumns({c: F.lit(float(i)) for i, c in enumerate(fx.FEATURE_COLUMNS)})
    d = written(au.explained(d, fx.FEATURE_COLUMNS).withColumn("decision_id", au.decision_hash_col()), "decisions")
    got = fetched(d)
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join Inner" in line]
    report = au.audit_reports(d).select(*au.report_columns())
    body = F.to_json(F.struct(*[c for c in sorted(report.columns) if c != "markdown"])).alias("report_json")
    want = (d.select("decision_id", F.to_json(au.payload_struct()).alias("payload_json"))
            .join(d.select("decision_id", F.to_json(au.prediction_struct()).alias("prediction_json")), "decision_id")
            .join(report.select("decision_id", body), "decision_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 2 + 2 ** 3
    assert len(joins) == 2 and not any("to_json" in line for line in plan[joins[0]:])
