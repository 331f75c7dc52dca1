"""Decision log, explanations, audit reports, canned governance reports and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import audit as au
from ledgerlens.operators import conformal as cf
from ledgerlens.operators import features as fx
from ledgerlens.operators import search as se
from ledgerlens.operators.cleansing import dedup_latest
from ledgerlens.operators.splits import chronological_split
from ledgerlens.oracle import audit as oa
from ledgerlens.oracle import canonical as oc
from ledgerlens.oracle import features as of
from ledgerlens.oracle.metrics import chrono
from ledgerlens.plans.q_metrics import part, split_frame
from ledgerlens.plans.registry import query
from ledgerlens.sources import canonical as cn
from ledgerlens.sources.io import fresh_dir, written
from ledgerlens.sources.tables import table
from ledgerlens.sources.versioned import VersionedTable, as_of

RUN = oa.RUN
DEC = oa.DECISIONS
FEATS = fx.FEATURE_COLUMNS


def scored_decisions(spark, sf, gold=None):
    """Every scored transaction with its raw and calibrated score, triage band and features (``gold``, if built before)."""
    s = split_frame(spark, sf)
    tri = cf.conformal_triage(s.drop("split"), cf.conformal_threshold(part(s, "validation")))
    raw = F.round(F.least(F.col("amount"), F.lit(400.0)) / 400.0, 6)
    gold = (fx.gold_features(cn.tx_events(spark, sf)) if gold is None else gold).select(F.col("tx_id").alias("_g"), *FEATS)
    return tri.join(gold, F.col("tx_id") == F.col("_g")).select(
        F.lit(RUN).alias("model_run_id"), *tri.columns, raw.alias("raw_score"), *FEATS)


def decisions(spark, sf, gold=None):
    """All decisions with explanation; the id is the hash of run, payload and prediction.  Written once per call."""
    d = au.explained(scored_decisions(spark, sf, gold), FEATS)
    return written(d.withColumn("decision_id", au.decision_hash_col()), "decisions")


def split_gold(spark, sf):
    """Gold features with their split; written before the split too, which reads them twice to range-partition them."""
    return written(chronological_split(written(fx.gold_features(cn.tx_events(spark, sf)), "gold")), "split-gold")


def store(spark, sf):
    """The decision store (decisions, predictions, transactions, reports), keyed by decision_id; JSON only at this edge."""
    d = decisions(spark, sf)
    preds = d.select("decision_id", "tx_id", "model_run_id", F.to_json(au.prediction_struct()).alias("prediction_json"),
                     F.col("timestamp").alias("created_at"), au.replay_hash_col().alias("replay_hash"))
    txs = d.select("decision_id", F.to_json(au.payload_struct()).alias("payload_json"),
                   F.col("timestamp").alias("created_at"))
    rep = au.audit_reports(d).select(*au.report_columns())
    return d, preds, txs, rep.select("decision_id", report_json(), "markdown")


def report_json():
    """All report columns but the markdown, in the order of their names."""
    return F.to_json(F.struct("confidence", "counterfactual_summary", "decision_id", "decision_outcome", "explanation", "fraud_probability",
                              "replay_instructions", "top_drivers")).alias("report_json")


def features_table(d):
    return d.select("decision_id", au.features_json(FEATS).alias("feature_json"), F.col("timestamp").alias("created_at"))


PRED_SQL = (f"SELECT decision_id, tx_id, model_run_id, CAST(to_json({oa.PREDICTION}) AS VARCHAR) AS prediction_json, "
            f"\"timestamp\" AS created_at, {oa.REPLAY_HASH % 'score'} AS replay_hash FROM ({DEC}) d")
TXS_SQL = (f"SELECT decision_id, CAST(to_json({oa.PAYLOAD}) AS VARCHAR) AS payload_json, \"timestamp\" AS created_at "
           f"FROM ({DEC}) d")
FEAT_SQL = f"SELECT decision_id, {oa.FEATURES_JSON} AS feature_json, \"timestamp\" AS created_at FROM ({DEC}) d"
_BODY = ", ".join(f"'{c}': {c}" for c in ("confidence", "counterfactual_summary", "decision_id", "decision_outcome", "explanation",
                                        "fraud_probability", "replay_instructions", "top_drivers"))
REP_SQL = f"SELECT decision_id, CAST(to_json({{{_BODY}}}) AS VARCHAR) AS report_json, markdown FROM ({oa.reports()}) r"


# ------------------------------------------------------------------ decision log

@query("decision_hash", f"SELECT tx_id, decision_id AS decision_hash FROM ({DEC}) d")
def decision_hash(spark, sf):
    d = au.explained(scored_decisions(spark, sf), FEATS)
    return d.select("tx_id", au.decision_hash_col().alias("decision_hash"))


_RECORDED = " UNION ALL ".join(
    f"SELECT '{name}' AS store, decision_id, {body} AS body, created_at AS recorded_at FROM ({sql}) x{i}"
    for i, (name, body, sql) in enumerate((
        ("transactions", "payload_json", TXS_SQL), ("features", "feature_json", FEAT_SQL),
        ("predictions", "model_run_id || ' ' || prediction_json", PRED_SQL),
        ("audit_reports", "report_json", f"SELECT r.*, t.created_at FROM ({REP_SQL}) r JOIN ({TXS_SQL}) t USING (decision_id)"))))


STORE_BUCKETS = 16


@query("record_decisions", f"""WITH p AS ({PRED_SQL}), first AS ({_RECORDED}),
again AS (SELECT store, decision_id, CASE store WHEN 'predictions' THEN replace(body, '{RUN} ', 'run_logit_0002 ') ELSE body END AS body,
            recorded_at + INTERVAL 1 DAY AS recorded_at
          FROM first WHERE decision_id IN (SELECT decision_id FROM p WHERE prediction_json LIKE '%"decision":"high_confidence_fraud"%'))
SELECT store, decision_id, body, recorded_at FROM (SELECT * FROM first UNION ALL SELECT * FROM again) u
QUALIFY row_number() OVER (PARTITION BY store, decision_id ORDER BY recorded_at DESC) = 1""")
def record_decisions(spark, sf):
    """A stored upsert of all four tables by decision id: one commit switches them together, re-recorded decisions replace
    the earlier rows, and only buckets that hold one of them are written again."""
    d, preds, txs, rep = store(spark, sf)
    one = lambda df, name, body: df.select(F.lit(name).alias("store"), "decision_id", body.alias("body"), F.col("created_at").alias("recorded_at"))
    first = (one(txs, "transactions", F.col("payload_json")).unionByName(one(features_table(d), "features", F.col("feature_json")))
             .unionByName(one(preds, "predictions", F.concat("model_run_id", F.lit(" "), "prediction_json")))
             .unionByName(one(rep.join(txs.select("decision_id", "created_at"), "decision_id"), "audit_reports", F.col("report_json"))))
    fraud = d.where(F.col("confidence_band") == "high_confidence_fraud").select("decision_id")
    newer = F.when(F.col("store") == "predictions", F.regexp_replace("body", f"^{RUN} ", "run_logit_0002 ")).otherwise(F.col("body"))
    again = first.join(fraud, "decision_id", "left_semi").select(
        "store", "decision_id", newer.alias("body"), (F.col("recorded_at") + F.expr("INTERVAL 1 DAY")).alias("recorded_at"))
    recorded = VersionedTable(spark, fresh_dir(spark, "decision-store"), ["store", "decision_id"], buckets=STORE_BUCKETS)
    recorded.upsert(first, ["recorded_at"])
    recorded.upsert(again, ["recorded_at"])
    return recorded.read()


REPLAY_SQL = f"""SELECT decision_id, 'replayed' AS status, created_at + INTERVAL 1 DAY AS replayed_at FROM ({PRED_SQL}) p
UNION ALL SELECT decision_id, 'verified', "timestamp" + INTERVAL 2 DAY FROM ({DEC}) d WHERE amount > 100"""


def replay_events(d):
    """Every decision is replayed after a day; those over 100 are verified a day later."""
    e1 = d.select("decision_id", F.lit("replayed").alias("status"), (F.col("timestamp") + F.expr("INTERVAL 1 DAY")).alias("replayed_at"))
    e2 = d.where(F.col("amount") > 100).select(
        "decision_id", F.lit("verified").alias("status"), (F.col("timestamp") + F.expr("INTERVAL 2 DAY")).alias("replayed_at"))
    return e1.unionByName(e2)


@query("replay_log", f"""SELECT e.decision_id, e.status, e.replayed_at, p.prediction_json, p.replay_hash
FROM ({REPLAY_SQL}) e JOIN ({PRED_SQL}) p USING (decision_id)""")
def replay_log(spark, sf):
    """Append replay events to the stored log and return the stored decision each one replays (no recompute)."""
    d, preds, _, _ = store(spark, sf)
    log = VersionedTable(spark, fresh_dir(spark, "replay-log"), ["decision_id"], buckets=STORE_BUCKETS)
    events = replay_events(d)
    for status in ("replayed", "verified"):
        log.append(events.where(F.col("status") == status))
    return log.read().join(preds.select("decision_id", "prediction_json", "replay_hash"), "decision_id").select(
        "decision_id", "status", "replayed_at", "prediction_json", "replay_hash")


# Tampering fixture: the stored scores of some decisions are altered after recording.
TAMPER = "amount > 150 AND CAST(regexp_extract(tx_id, '[0-9]+$') AS BIGINT) % 7 = 0"


@query("replay_verify", f"""SELECT decision_id, stored_hash, replay_hash, stored_hash = replay_hash AS matched,
  CASE WHEN stored_hash <> replay_hash THEN CAST(to_json({{'replay_hash': replay_hash, 'stored_hash': stored_hash}}) AS VARCHAR) END AS diff
FROM (SELECT decision_id, {oa.REPLAY_HASH % 'score'} AS stored_hash,
  {oa.REPLAY_HASH % f"CASE WHEN {TAMPER} THEN score + 0.125 ELSE score END"} AS replay_hash FROM ({DEC}) d) x""")
def replay_verify(spark, sf):
    """Recompute the hash of every stored prediction's scores, band, model and transaction and compare with the recorded one."""
    d = decisions(spark, sf).withColumn("stored_hash", au.replay_hash_col())
    tampered = F.expr(TAMPER.replace("'[0-9]+$')", "'[0-9]+$', 0)"))
    stored = d.withColumn("score", F.when(tampered, F.col("score") + 0.125).otherwise(F.col("score")))
    re = stored.withColumn("replay_hash", au.replay_hash_col())
    differs = F.col("stored_hash") != F.col("replay_hash")
    return re.select("decision_id", "stored_hash", "replay_hash", (~differs).alias("matched"),
                     F.when(differs, F.to_json(F.struct("replay_hash", "stored_hash"))).alias("diff"))


# ------------------------------------------------------------------ explanations

@query("counterfactual_rules", f"SELECT decision_id, {oa.counterfactual()} AS counterfactual_summary FROM ({DEC}) d")
def counterfactual_rules(spark, sf):
    return decisions(spark, sf).select("decision_id", au.counterfactual_text().alias("counterfactual_summary"))


@query("top_drivers", f"SELECT decision_id, top_drivers FROM ({DEC}) d")
def top_drivers(spark, sf):
    return decisions(spark, sf).select("decision_id", "top_drivers")


#: Importances as a fitted model would give them.
WEIGHTS = {c: round(1.0 / (i + 1), 6) for i, c in enumerate(FEATS)}
_WEIGHTED = ", ".join(f"abs(CAST({c} AS DOUBLE) * {w!r}::DOUBLE) AS {c}" for c, w in WEIGHTS.items())


@query("top_drivers_weighted", oa.drivers(f"SELECT decision_id, {_WEIGHTED} FROM ({DEC}) d", FEATS))
def top_drivers_weighted(spark, sf):
    """Drivers ranked by |importance * value|."""
    d = decisions(spark, sf)
    return d.select("decision_id", F.transform(au.top_drivers(d, FEATS, weights=WEIGHTS), au.friendly).alias("top_drivers"))


@query("top_features_abs", oa.drivers(DEC, FEATS, k=5, friendly_names=False))
def top_features_abs(spark, sf):
    d = decisions(spark, sf)
    return d.select("decision_id", au.top_drivers(d, FEATS, k=5).alias("top_drivers"))


@query("explanation_text", f"SELECT decision_id, explanation FROM ({DEC}) d")
def explanation_text(spark, sf):
    return decisions(spark, sf).select("decision_id", "explanation")


def _reports_with_cases_sql() -> str:
    """Every decision against all rows of the training split: the three nearest by feature distance."""
    d = " + ".join(f"(CAST(q.{c} AS DOUBLE) - CAST(r.{c} AS DOUBLE)) * (CAST(q.{c} AS DOUBLE) - CAST(r.{c} AS DOUBLE))" for c in fx.FEATURE_MATRIX)
    line = "c.id || ' | label=' || CAST(c.label AS VARCHAR) || ' | distance=' || CAST(CAST(CAST(round(sqrt(c.d), 6) AS DECIMAL(18,6)) AS DECIMAL(18,3)) AS VARCHAR)"
    return f"""WITH g AS MATERIALIZED ({chrono(of.gold_features(oc.TX_EVENTS))}),
n AS (SELECT q.tx_id, list_transform(min({{'d': {d}, 'id': r.tx_id, 'label': r.is_fraud}}, 3), lambda c: {line}) AS nearest_similar_cases
      FROM g q, g r WHERE r.split = 'train' GROUP BY q.tx_id),
d AS ({DEC}), x AS ({oa.reports('SELECT * FROM d')})
SELECT x.* EXCLUDE (markdown), n.nearest_similar_cases, x.markdown || chr(10) || chr(10) || '## Nearest similar prior cases' || chr(10) ||
  array_to_string(list_transform(n.nearest_similar_cases, lambda s: '- ' || s), chr(10)) AS markdown
FROM x JOIN d USING (decision_id) JOIN n USING (tx_id)"""


@query("audit_report", _reports_with_cases_sql())
def audit_report(spark, sf):
    """Reports of all decisions, each with its three nearest cases among the training rows."""
    gold = split_gold(spark, sf)
    cases = au.similar_cases(gold, part(gold, "train"), fx.FEATURE_MATRIX)
    return au.audit_reports(decisions(spark, sf, gold), cases).select(
        *au.report_columns(), F.transform("nearest_similar_cases", au.case_line).alias("nearest_similar_cases"))


def _stamp_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


@query("export_markdown", f"""SELECT decision_id, '| ' || decision_id || ' | ' || tx_id || ' | ' || confidence_band || ' | ' ||
  CAST(CAST(CAST(score AS DECIMAL(18,6)) AS DECIMAL(18,4)) AS VARCHAR) || ' | ' || {_stamp_sql('"timestamp"')} || ' |' AS line,
  CAST(to_json({{'calibrated_score': CAST(score AS DECIMAL(18,6)), 'confidence_band': confidence_band, 'decision_id': decision_id,
    'recorded_at': {_stamp_sql('"timestamp"')}, 'tx_id': tx_id}}) AS VARCHAR) AS json
FROM ({DEC}) d""")
def export_markdown(spark, sf):
    """Export of every decision as a table row and as JSON."""
    d = decisions(spark, sf)
    stamp = au.ts_text(F.col("timestamp"))
    cells = F.concat_ws(" | ", "decision_id", "tx_id", "confidence_band", F.col("score").cast("decimal(18,6)").cast("decimal(18,4)").cast("string"), stamp)
    doc = F.struct(F.col("score").cast("decimal(18,6)").alias("calibrated_score"), "confidence_band", "decision_id",
                   stamp.alias("recorded_at"), "tx_id")
    return d.select("decision_id", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"), F.to_json(doc).alias("json"))


@query("redact_text", f"SELECT doc_id, {oa.redact('text')} AS text FROM documents")
def redact_text(spark, sf):
    """Regex redaction over whole document texts."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", au.redact_text(F.col("text")).alias("text"))


_NOTE_SQL = oa.redact("'User ' || user_id || ' from device ' || device_id || ' {' || '\"lat\": ' || CAST(CAST(lat AS DECIMAL(18,6)) AS VARCHAR) || '}'")


@query("redact_report", f"""SELECT decision_id, CAST(to_json({{'decision_id': decision_id, 'user_id': '[REDACTED]', 'device_id': '[REDACTED]',
  'amount': CAST(amount AS DECIMAL(18,2)), 'note': {_NOTE_SQL},
  'place': {{'lat': '[REDACTED]', 'channel': channel, 'inner': {{'account_id': '[REDACTED]', 'mcc': mcc}}}},
  'history': [{_NOTE_SQL}, 'none'], 'parties': [{{'user_id': '[REDACTED]', 'role': 'payer'}}]}}) AS VARCHAR) AS report_json
FROM ({DEC}) d""")
def redact_report(spark, sf):
    """Keys are redacted at every depth, strings also inside lists."""
    d = decisions(spark, sf)
    note = F.concat(F.lit("User "), F.col("user_id"), F.lit(" from device "), F.col("device_id"), F.lit(' {"lat": '),
                    F.col("lat").cast("decimal(18,6)").cast("string"), F.lit("}"))
    place = F.struct("lat", "channel", F.struct("account_id", "mcc").alias("inner"))
    rep = d.select("decision_id", F.struct(
        "decision_id", "user_id", "device_id", F.col("amount").cast("decimal(18,2)").alias("amount"), note.alias("note"),
        place.alias("place"), F.array(note, F.lit("none")).alias("history"),
        F.array(F.struct("user_id", F.lit("payer").alias("role"))).alias("parties")).alias("report"))
    return rep.select("decision_id", F.to_json(au.redact_struct(rep, "report")).alias("report_json"))


#: Stored documents of three shapes; the marks stand where the redacted text differs.
_JSON_SHAPES = (
    ('{"case":{"parties":{"payer":{"user_id":', '"U_%1"', ',"age":%2}},"amount":%3},"steps":[[{"device_id":', '{"raw":"D_%1","n":[1,2]}', ',"ok":true}],["User ',
     'U_%1', ' paid",null,-0.50]]}'),
    ('[{"lat":', '%3', ',"note":"from ', 'D_%1', '"},[],[[["', 'A_%1', '"],{}]],1e5]'),
    ('no json: ', 'U_%1', ' and %2'),
)


def _shape(parts, redacted: bool) -> list[str]:
    """A shape's parts; every second one is personal: as a value of a listed key a string, else part of a text."""
    mark = lambda i: '"[REDACTED]"' if parts[i - 1].endswith('":') else "[REDACTED]"
    return [mark(i) if redacted and i % 2 else x for i, x in enumerate(parts)]


def _json_sql() -> str:
    def text(parts):
        s = "'" + "".join(_shape(parts, True)).replace("'", "''") + "'"
        return f"replace(replace(replace({s}, '%1', lpad(CAST(user_id AS VARCHAR), 6, '0')), '%2', CAST(user_id % 90 AS VARCHAR)), '%3', CAST(user_id * 0.25::DECIMAL(4,2) AS VARCHAR))"
    return f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN {text(_JSON_SHAPES[0])} WHEN 1 THEN {text(_JSON_SHAPES[1])} ELSE {text(_JSON_SHAPES[2])} END AS document FROM events"


@query("redact_json", _json_sql())
def redact_json(spark, sf):
    """Stored JSON of undeclared shape, redacted at every depth."""
    ev = table(spark, sf, "events").select("event_id", "user_id")
    uid = F.col("user_id")
    fill = {"%1": F.lpad(uid.cast("string"), 6, "0"), "%2": (uid % 90).cast("string"), "%3": (uid * F.lit(0.25).cast("decimal(4,2)")).cast("string")}

    def text(parts):
        out = F.lit("".join(_shape(parts, False)))
        for k, v in fill.items():
            out = F.replace(out, F.lit(k), v)
        return out

    kind = F.col("event_id") % 3
    stored_ = F.when(kind == 0, text(_JSON_SHAPES[0])).when(kind == 1, text(_JSON_SHAPES[1])).otherwise(text(_JSON_SHAPES[2]))
    return ev.select("event_id", au.redact_json(stored_).alias("document"))


# ------------------------------------------------------------------ lookups & joins

@query("decision_fetch", f"""SELECT p.decision_id, t.payload_json, p.prediction_json, r.report_json
FROM ({PRED_SQL}) p JOIN ({TXS_SQL}) t USING (decision_id) JOIN ({REP_SQL}) r USING (decision_id)""")
def decision_fetch(spark, sf):
    """Payload + prediction + report; a decision missing any of them is not found (inner joins)."""
    return fetched(decisions(spark, sf))


def fetched(d):
    """The stored parts of every decision, joined by its id as bytes; texts that follow from a part are written out at the end."""
    key = F.unhex("decision_id").alias("_k")
    preds = d.select(key, F.struct("score", "confidence", "confidence_band", "explanation", "raw_score").alias("_p"))
    txs = d.select(key, F.struct(*au.PAYLOAD_FIELDS).alias("_t"))
    rules = [c for c, _, _ in au.COUNTERFACTUAL_RULES]
    reps = d.select(key, F.struct("score", "confidence", "confidence_band", "top_drivers", *rules).alias("_r"))
    sorted_ = lambda df: df.hint("merge")  # noqa: E731 - all three grow with the decisions
    j = preds.join(sorted_(txs), "_k").join(sorted_(reps), "_k").withColumn("decision_id", F.lower(F.hex("_k")))
    j = j.select("decision_id", "_p", "_r", "_t.*").select("decision_id", "_p", "_r", F.to_json(au.payload_struct()).alias("payload_json"))
    j = j.select("decision_id", "_r", "payload_json", "_p.*").select(
        "decision_id", "_r", "payload_json", F.to_json(au.prediction_struct()).alias("prediction_json"))
    j = j.select("decision_id", "payload_json", "prediction_json", "_r.*").withColumn(
        "explanation", au.explanation_text(F.col("confidence_band"), F.col("top_drivers"), F.col("score")))
    texts = ["payload_json", "prediction_json"]
    return au.audit_reports(j).select(*texts, *au.report_columns()).select("decision_id", *texts, report_json())


@query("recent_decisions", f"""SELECT p.decision_id, p.model_run_id, json_extract_string(p.prediction_json, '$.decision') AS decision,
  json_extract_string(p.prediction_json, '$.calibrated_probability') AS probability, r.markdown IS NOT NULL AS has_report
FROM ({PRED_SQL}) p LEFT JOIN ({REP_SQL}) r USING (decision_id) ORDER BY p.decision_id DESC LIMIT 10""")
def recent_decisions(spark, sf):
    _, preds, _, rep = store(spark, sf)
    j = preds.join(rep.select("decision_id", "markdown"), "decision_id", "left")
    return j.select("decision_id", "model_run_id", F.get_json_object("prediction_json", "$.decision").alias("decision"),
                    F.get_json_object("prediction_json", "$.calibrated_probability").alias("probability"),
                    F.col("markdown").isNotNull().alias("has_report")).orderBy(F.desc("decision_id")).limit(10)


# The registry's versions of a run's fitted parts, with the days after the first transaction from which they hold.
VERSION_DAYS = (0, 9, 17)
VERSIONS_SQL = f"""SELECT '{RUN}' AS model_run_id, (SELECT min("timestamp") FROM ({oc.TX_EVENTS}) e) + to_days(CAST(v.days AS INTEGER)) AS valid_from,
  'logit' AS model_id, CAST(v.n AS VARCHAR) AS model_version, 'identity-' || CAST(v.n AS VARCHAR) AS calibration_version,
  'split-0.05-' || CAST(v.n AS VARCHAR) AS conformal_version
FROM (VALUES {', '.join(f"({i + 1}, {x})" for i, x in enumerate(VERSION_DAYS))}) v(n, days)"""


def registered_versions(spark, sf):
    """The stored table of versions: each registered by an append of its own, valid until its run's next one."""
    table_ = VersionedTable(spark, fresh_dir(spark, "versions"), ["model_run_id"], buckets=2)
    start = cn.tx_events(spark, sf).agg(F.min("timestamp").alias("t"))
    for i, days in enumerate(VERSION_DAYS, 1):
        table_.append(start.select(
            F.lit(RUN).alias("model_run_id"), (F.col("t") + F.make_dt_interval(days=F.lit(days))).alias("valid_from"),
            F.lit("logit").alias("model_id"), F.lit(str(i)).alias("model_version"), F.lit(f"identity-{i}").alias("calibration_version"),
            F.lit(f"split-0.05-{i}").alias("conformal_version")))
    return table_.read()


@query("decision_lineage", f"""SELECT p.decision_id, p.tx_id, p.model_run_id, v.valid_from AS version_from, v.model_id, v.model_version,
  v.calibration_version, v.conformal_version, t.payload_json, f.feature_json, r.decision_id IS NOT NULL AS has_report,
  coalesce(list(e.status ORDER BY e.replayed_at DESC) FILTER (WHERE e.status IS NOT NULL), []) AS replay_history,
  count(e.status) AS n_replays
FROM ({PRED_SQL}) p JOIN ({TXS_SQL}) t USING (decision_id) JOIN ({FEAT_SQL}) f USING (decision_id)
ASOF LEFT JOIN ({VERSIONS_SQL}) v ON v.model_run_id = p.model_run_id AND v.valid_from <= p.created_at
LEFT JOIN ({REP_SQL}) r ON r.decision_id = p.decision_id LEFT JOIN ({REPLAY_SQL}) e ON e.decision_id = p.decision_id
GROUP BY p.decision_id, p.tx_id, p.model_run_id, v.valid_from, v.model_id, v.model_version, v.calibration_version, v.conformal_version,
  t.payload_json, f.feature_json, r.decision_id""")
def decision_lineage(spark, sf):
    """What led to a decision: the versions of its run that were valid when it was made (as-of join), inputs, report, replays."""
    d, preds, txs, rep = store(spark, sf)
    hist = replay_events(d).groupBy("decision_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("replayed_at", "status")), asc=False), lambda x: x["status"]).alias("_h"),
        F.count(F.lit(1)).alias("n_replays"))
    made = as_of(preds.select("decision_id", "tx_id", "model_run_id", "created_at"), registered_versions(spark, sf), "model_run_id",
                 "created_at", "valid_from")
    return lineage(made, txs, features_table(d), rep, hist)


def lineage(made, txs, feats, rep, hist):
    """All stores grow with the decisions, and a few of their columns look small in files: no side is sent through the driver."""
    sorted_ = lambda df: df.hint("merge")
    j = (made.join(sorted_(txs.select("decision_id", "payload_json")), "decision_id")
         .join(sorted_(feats.select("decision_id", "feature_json")), "decision_id")
         .join(sorted_(rep.select("decision_id", F.lit(True).alias("_r"))), "decision_id", "left")
         .join(sorted_(hist), "decision_id", "left"))
    return j.select("decision_id", "tx_id", "model_run_id", F.col("valid_from").alias("version_from"), "model_id", "model_version",
                    "calibration_version", "conformal_version", "payload_json", "feature_json",
                    F.col("_r").isNotNull().alias("has_report"),
                    F.coalesce("_h", F.array().cast("array<string>")).alias("replay_history"),
                    F.coalesce("n_replays", F.lit(0)).alias("n_replays"))


@query("audit_export", f"""SELECT r.decision_id, t.created_at, r.markdown FROM ({REP_SQL}) r JOIN ({TXS_SQL}) t USING (decision_id)
WHERE t.created_at >= (SELECT max(created_at) FROM ({TXS_SQL}) z) - INTERVAL 3 DAY ORDER BY r.decision_id""")
def audit_export(spark, sf, since_days: int = 3):
    """Reports joined to transactions created in the last N days (relative to the newest), ordered by id."""
    _, _, txs, rep = store(spark, sf)
    newest = txs.agg(F.max("created_at").alias("_now"))
    j = rep.join(txs, "decision_id").crossJoin(newest)  # newest: one row
    j = j.filter(F.col("created_at") >= F.col("_now") - F.make_dt_interval(days=F.lit(since_days)))
    return j.select("decision_id", "created_at", "markdown").orderBy("decision_id")


def _lists_sql() -> str:
    from ledgerlens.plans.q_governance import DRIFT_STORE_SQL, FAIRNESS_STORE_SQL
    from ledgerlens.plans.q_metrics import RUNS_SQL, TRACE_SQL
    lists = {"decisions": f"SELECT decision_id AS item, created_at AS _at FROM ({PRED_SQL}) p",
             "fairness_audits": f"SELECT audit_id AS item, created_at AS _at FROM ({FAIRNESS_STORE_SQL}) f",
             "drift_reports": f"SELECT report_id AS item, created_at AS _at FROM ({DRIFT_STORE_SQL}) d",
             "runs": f"SELECT DISTINCT run_id AS item, CAST(NULL AS TIMESTAMP) AS _at FROM ({RUNS_SQL}) r",
             "traces": f"SELECT trace_id AS item, CAST(NULL AS TIMESTAMP) AS _at FROM ({TRACE_SQL}) t"}
    return " UNION ALL ".join(f"(SELECT '{k}' AS list, item, _at AS created_at FROM ({v}) x ORDER BY _at DESC NULLS LAST, item DESC LIMIT 10)"
                              for k, v in lists.items())


@query("status_latest_n", _lists_sql())
def status_latest_n(spark, sf, n: int = 10):
    """The newest entries of every list the status page shows (by time, then id)."""
    from ledgerlens.operators.audit import trace_log
    from ledgerlens.plans.q_governance import drift_store, fairness_store
    from ledgerlens.plans.q_metrics import eval_runs
    none = F.lit(None).cast("timestamp_ntz")
    lists = [("decisions", decisions(spark, sf), F.col("decision_id"), F.col("timestamp")),
             ("fairness_audits", fairness_store(spark, sf), F.col("audit_id"), F.col("created_at")),
             ("drift_reports", drift_store(spark, sf), F.col("report_id"), F.col("created_at")),
             ("runs", eval_runs(spark, sf).select("run_id").distinct(), F.col("run_id"), none),
             ("traces", trace_log(spark, sf), F.col("trace_id"), none)]
    out = None
    for name, df, item, at in lists:
        top = df.select(F.lit(name).alias("list"), item.alias("item"), at.cast("timestamp_ntz").alias("created_at")).orderBy(
            F.col("created_at").desc_nulls_last(), F.col("item").desc()).limit(n)
        out = top if out is None else out.unionByName(top)
    return out


@query("flagged_recent", f"""SELECT decision_id, model_run_id, prediction_json FROM ({PRED_SQL}) p
WHERE lower(prediction_json) LIKE '%high_confidence_fraud%' ORDER BY decision_id DESC LIMIT 10""")
def flagged_recent(spark, sf):
    _, preds, _, _ = store(spark, sf)
    return preds.filter(F.lower("prediction_json").like("%high_confidence_fraud%")).select(
        "decision_id", "model_run_id", "prediction_json").orderBy(F.desc("decision_id")).limit(10)


@query("decisions_recent", f"SELECT decision_id, model_run_id, prediction_json FROM ({PRED_SQL}) p ORDER BY decision_id DESC LIMIT 10")
def decisions_recent(spark, sf):
    _, preds, _, _ = store(spark, sf)
    return preds.select("decision_id", "model_run_id", "prediction_json").orderBy(F.desc("decision_id")).limit(10)


@query("group_stat_join", f"""WITH t AS ({oc.TX_EVENTS}),
m AS (SELECT merchant_id, avg(is_fraud) AS merchant_fraud_rate FROM t GROUP BY 1),
dv AS (SELECT device_id, count(DISTINCT user_id) AS device_sharing_degree FROM t GROUP BY 1),
ac AS (SELECT account_id, count(DISTINCT device_id) AS devices_per_account FROM t GROUP BY 1),
u AS (SELECT user_id, avg(amount) AS _m, stddev_samp(amount) AS _s FROM t GROUP BY 1)
SELECT t.*, round(m.merchant_fraud_rate, 6) AS merchant_fraud_rate, dv.device_sharing_degree, ac.devices_per_account,
  round((t.amount - u._m) / greatest(u._s, 1e-6), 6) AS amount_zscore
FROM t LEFT JOIN m USING (merchant_id) LEFT JOIN dv USING (device_id) LEFT JOIN ac USING (account_id) LEFT JOIN u USING (user_id)""")
def group_stat_join(spark, sf):
    """Variant (label-leaky) whole-table group statistics joined back to every row."""
    t = cn.tx_events(spark, sf)
    m = t.groupBy("merchant_id").agg(F.avg("is_fraud").alias("merchant_fraud_rate"))
    dv = t.groupBy("device_id").agg(F.countDistinct("user_id").alias("device_sharing_degree"))
    ac = t.groupBy("account_id").agg(F.countDistinct("device_id").alias("devices_per_account"))
    u = t.groupBy("user_id").agg(F.avg("amount").alias("_m"), F.stddev_samp("amount").alias("_s"))
    j = t.join(m, "merchant_id", "left").join(dv, "device_id", "left").join(ac, "account_id", "left").join(u, "user_id", "left")
    return j.select(*t.columns, F.round("merchant_fraud_rate", 6).alias("merchant_fraud_rate"), "device_sharing_degree",
                    "devices_per_account",
                    F.round((F.col("amount") - F.col("_m")) / F.greatest(F.col("_s"), F.lit(1e-6)), 6).alias("amount_zscore"))


@query("time_window_filter", f"""SELECT * FROM ({oc.TX_EVENTS}) t
WHERE "timestamp" >= (SELECT max("timestamp") FROM ({oc.TX_EVENTS}) x) - INTERVAL 7 DAY
  AND "timestamp" <= (SELECT max("timestamp") FROM ({oc.TX_EVENTS}) x)""")
def time_window_filter(spark, sf, days: int = 7):
    """Rows in ``[ref - days, ref]`` (both ends inclusive); ``ref`` = newest timestamp."""
    t = cn.tx_events(spark, sf)
    ref = t.agg(F.max("timestamp").alias("_ref"))
    j = t.crossJoin(ref)  # one row
    return j.filter((F.col("timestamp") >= F.col("_ref") - F.make_dt_interval(days=F.lit(days)))
                    & (F.col("timestamp") <= F.col("_ref"))).drop("_ref")


W7 = 7 * 86_400_000_000


@query("rolling_graph_windows", f"""WITH t AS (SELECT tx_id, epoch_us("timestamp") AS _ts FROM ({oc.TX_EVENTS}) e),
b AS (SELECT min(_ts) AS lo, max(_ts) AS hi FROM t),
ends AS (SELECT unnest(generate_series(lo + {W7}, hi, {W7})) AS _end FROM b)
SELECT make_timestamp(_end) AS window_end, t.tx_id FROM ends JOIN t ON t._ts >= _end - {W7} AND t._ts <= _end""")
def rolling_graph_windows(spark, sf, window_days: int = 7, step_days: int = 7):
    """Windows ending at min+w, min+w+step, ... <= max; each row lands in every inclusive window
    containing it.  Window ends are enumerated per row arithmetically (no range join)."""
    w, st = window_days * 86_400_000_000, step_days * 86_400_000_000
    t = cn.tx_events(spark, sf).select("tx_id", fx.epoch_micros("timestamp").alias("_ts"))
    b = t.agg(F.min("_ts").alias("_lo"), F.max("_ts").alias("_hi"))
    j = t.crossJoin(b)  # one row
    first_end = F.col("_lo") + w
    k_lo = F.greatest(F.ceil((F.col("_ts") - first_end) / F.lit(st)), F.lit(0)).cast("long")
    k_hi = F.floor((F.col("_ts") + w - first_end) / F.lit(st)).cast("long")
    k_max = F.floor((F.col("_hi") - first_end) / F.lit(st)).cast("long")
    ks = F.when(F.least(k_hi, k_max) >= k_lo, F.sequence(k_lo, F.least(k_hi, k_max))).otherwise(F.array().cast("array<long>"))
    ex = j.select("tx_id", "_lo", F.explode(ks).alias("_k"))
    end = F.col("_lo") + w + F.col("_k") * st
    return ex.select(F.timestamp_add("MICROSECOND", end, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).alias("window_end"), "tx_id")


# A request payload's fields in canonical order with their types.
PAYLOAD_TYPES = {"tx_id": "string", "user_id": "string", "merchant_id": "string", "device_id": "string", "account_id": "string",
                 "amount": "double", "currency": "string", "timestamp": "string", "lat": "double", "lon": "double",
                 "channel": "string", "mcc": "string", "is_fraud": "int"}
_FULL = f"""SELECT event_id, CAST(to_json({{{', '.join(f"'{c}': {c}" if c not in ('amount', 'lat', 'lon', 'timestamp') else f"'{c}': {oa._jv(c)}" for c in PAYLOAD_TYPES if c not in ('currency', 'is_fraud'))}}}) AS VARCHAR) AS p
FROM ({oc.TX_EVENTS}) t JOIN (SELECT event_id FROM events) e ON t.tx_id = 'ev_' || CAST(e.event_id AS VARCHAR)"""
_GET = ", ".join(
    (f"TRY_CAST(json_extract_string(p, '$.{c}') AS DOUBLE) AS {c}" if k == "double" else
     f"coalesce(TRY_CAST(json_extract_string(p, '$.{c}') AS INTEGER), 0) AS {c}" if k == "int" else
     f"coalesce(json_extract_string(p, '$.{c}'), 'USD') AS {c}" if c == "currency" else
     f"CAST(json_extract_string(p, '$.{c}') AS TIMESTAMP) AS \"{c}\"" if c == "timestamp" else
     f"json_extract_string(p, '$.{c}') AS {c}") for c, k in PAYLOAD_TYPES.items())


@query("payload_to_frame", f"""SELECT {_GET} FROM (SELECT CASE WHEN event_id % 2 = 0 THEN p
  ELSE substr(p, 1, length(p) - 1) || ',"currency":"EUR","is_fraud":1}}' END AS p FROM ({_FULL}) f) x""")
def payload_to_frame(spark, sf):
    """JSON request payloads -> typed canonical rows with defaults (currency USD, is_fraud 0), parsed in bulk."""
    t = cn.tx_events(spark, sf, extra=[F.col("event_id")])
    given = [c for c in PAYLOAD_TYPES if c not in ("currency", "is_fraud")]
    rows = t.select("event_id", F.to_json(F.struct(*[au._json_val(c).alias(c) for c in given])).alias("p"))
    more = F.concat(F.expr("substring(p, 1, length(p) - 1)"), F.lit(',"currency":"EUR","is_fraud":1}'))
    rows = rows.select(F.when(F.col("event_id") % 2 == 0, F.col("p")).otherwise(more).alias("p"))
    schema = ", ".join(f"`{c}` {k}" for c, k in PAYLOAD_TYPES.items())
    r = rows.select(F.from_json("p", schema).alias("r"))
    default = {"currency": F.lit("USD"), "is_fraud": F.lit(0)}
    return r.select(*[F.coalesce(F.col(f"r.{c}"), default[c]).alias(c) if c in default
                      else F.col("r.timestamp").cast("timestamp_ntz").alias(c) if c == "timestamp" else F.col(f"r.{c}").alias(c)
                      for c in PAYLOAD_TYPES])


# ------------------------------------------------------------------ search

FM = fx.FEATURE_MATRIX
GOLD_EV = of.gold_features(oc.TX_EVENTS)
REF_SQL = f"SELECT * FROM ({chrono(GOLD_EV)}) s WHERE split = 'train'"


def _l2_sql() -> str:
    d = " + ".join(f"(CAST(q.{c} AS DOUBLE) - CAST(r.{c} AS DOUBLE)) * (CAST(q.{c} AS DOUBLE) - CAST(r.{c} AS DOUBLE))" for c in FM)
    return f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, ref_id, label, round(distance, 6) AS distance FROM (
  SELECT q.tx_id AS query_id, r.tx_id AS ref_id, r.is_fraud AS label, sqrt({d}) AS distance,
         row_number() OVER (PARTITION BY q.tx_id ORDER BY sqrt({d}), r.tx_id) AS rank
  FROM ({chrono(GOLD_EV)}) q, ({REF_SQL}) r WHERE q.split = 'test') x WHERE rank <= 3"""


@query("nearest_l2", _l2_sql())
def nearest_l2(spark, sf):
    """Top-3 analogues of every test transaction among all training rows."""
    g = split_gold(spark, sf)
    return se.nearest_l2(part(g, "test"), part(g, "train"), FM, k=3).withColumn("rank", F.col("rank").cast("int"))


def _emb_sql_dot(a: str, b: str, dim: int = 64) -> str:
    return " + ".join(f"CAST({a}[{i + 1}] AS DOUBLE) * CAST({b}[{i + 1}] AS DOUBLE)" for i in range(dim))


CENTROIDS_SQL = ("SELECT label AS query_id, [" + ", ".join(f"round(avg(CAST(embedding[{i + 1}] AS DOUBLE)), 6)" for i in range(64))
                 + "] AS embedding FROM embeddings GROUP BY label")


@query("vector_search", f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, match_id, round(distance, 6) AS distance FROM (
  SELECT q.query_id, c.vec_id AS match_id,
    {" + ".join(f"(CAST(q.embedding[{i + 1}] AS DOUBLE) - CAST(c.embedding[{i + 1}] AS DOUBLE)) * (CAST(q.embedding[{i + 1}] AS DOUBLE) - CAST(c.embedding[{i + 1}] AS DOUBLE))" for i in range(64))} AS distance,
    row_number() OVER (PARTITION BY q.query_id ORDER BY distance, c.vec_id) AS rank
  FROM embeddings c, ({CENTROIDS_SQL}) q) x WHERE rank <= 5""")
def vector_search(spark, sf):
    """Exact flat search (squared L2) of every label centroid over the whole embeddings table."""
    emb = table(spark, sf, "embeddings")
    q = se.label_centroids(emb, 64)
    return se.vector_search(q, emb, 64, k=5).withColumn("rank", F.col("rank").cast("int"))


@query("nearest_cosine", f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, match_id, label, round(similarity, 6) AS similarity FROM (
  SELECT q.query_id, c.vec_id AS match_id, c.label,
    ({_emb_sql_dot('q.embedding', 'c.embedding')}) / (greatest(sqrt({_emb_sql_dot('q.embedding', 'q.embedding')}), 1e-10)
      * greatest(sqrt({_emb_sql_dot('c.embedding', 'c.embedding')}), 1e-10)) AS similarity,
    row_number() OVER (PARTITION BY q.query_id ORDER BY similarity DESC, c.vec_id) AS rank
  FROM embeddings c, ({CENTROIDS_SQL}) q WHERE c.label = 1) x WHERE rank <= 5""")
def nearest_cosine(spark, sf):
    """Variant: top-5 by cosine similarity among label-1 ("fraud-only") vectors, per label centroid."""
    emb = table(spark, sf, "embeddings")
    q = se.label_centroids(emb, 64)
    return se.nearest_cosine(q, emb, 64, k=5, fraud_only=True).withColumn("rank", F.col("rank").cast("int"))
