"""DuckDB oracles for decisions, explanations, reports, lookups and search."""

from ledgerlens.operators.audit import COUNTERFACTUAL_DEFAULT, COUNTERFACTUAL_RULES, FRIENDLY_NAMES, PAYLOAD_FIELDS
from ledgerlens.oracle.features import FEATURE_ORDER, gold_features
from ledgerlens.oracle.canonical import TX_EVENTS
from ledgerlens.oracle.metrics import SC, THR, triage

GOLD_EV = gold_features(TX_EVENTS)
RUN = "run_logit_0001"

#: Every scored transaction, triaged with the threshold fitted on the validation split.
TRI_ALL = triage(SC, THR)
SCORED_DECISIONS = (f"SELECT '{RUN}' AS model_run_id, t.*, round(least(t.amount, 400.0::DOUBLE) / 400.0::DOUBLE, 6) AS raw_score, "
                    f"{', '.join('g.' + c for c in FEATURE_ORDER)} FROM ({TRI_ALL}) t JOIN ({GOLD_EV}) g USING (tx_id)")


def _jv(n: str) -> str:
    if n == "amount":
        return "CAST(amount AS DECIMAL(18,2))"
    if n in ("lat", "lon"):
        return f"CAST({n} AS DECIMAL(18,6))"
    if n == "timestamp":
        return "strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S.%f')"
    return n


PAYLOAD = "{" + ", ".join(f"'{n}': {_jv(n)}" for n in sorted(PAYLOAD_FIELDS)) + "}"
PREDICTION = ("{'calibrated_probability': CAST(score AS DECIMAL(18,6)), 'confidence': CAST(confidence AS DECIMAL(18,6)), "
              "'decision': confidence_band, 'explanation': explanation, 'raw_probability': CAST(raw_score AS DECIMAL(18,6))}")
REPLAY_HASH = ("sha256(CAST(to_json({'calibrated_score': CAST(%s AS DECIMAL(18,6)), 'confidence_band': confidence_band, "
               "'model_type': model_run_id, 'raw_score': CAST(raw_score AS DECIMAL(18,6)), 'tx_id': tx_id}) AS VARCHAR))")
FEATURES_JSON = ("CAST(to_json({" + ", ".join(f"'{c}': CAST({c} AS DECIMAL(18,6))" for c in sorted(FEATURE_ORDER)) + "}) AS VARCHAR)")
HASH = f"sha256(CAST(to_json({{'model_run_id': model_run_id, 'payload': {PAYLOAD}, 'prediction': {PREDICTION}}}) AS VARCHAR))"


def pct(p: str) -> str:
    centi = f"CAST(floor((CAST(round({p} * 1000000) AS BIGINT) + 50) / 100) AS BIGINT)"
    return f"(CAST({centi} // 100 AS VARCHAR) || '.' || lpad(CAST({centi} % 100 AS VARCHAR), 2, '0') || '%')"


def friendly(x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FRIENDLY_NAMES.items())
    return f"CASE {x} {cases} ELSE replace({x}, '_', ' ') END"


def drivers(frame: str, feats: list[str], k: int = 3, friendly_names: bool = True, key: str = "decision_id") -> str:
    items = ", ".join(f"{{'s': abs(CAST({c} AS DOUBLE)), 'pos': {i}, 'name': '{c}'}}" for i, c in enumerate(feats))
    name = friendly("u.it.name") if friendly_names else "u.it.name"
    return f"""SELECT {key}, list({name} ORDER BY u.rn) AS top_drivers FROM (
  SELECT {key}, it, row_number() OVER (PARTITION BY {key} ORDER BY it.s DESC, it.pos DESC) AS rn
  FROM (SELECT {key}, unnest([{items}]) AS it FROM ({frame}) f) x) u WHERE u.rn <= {k} GROUP BY {key}"""


def _q(text: str) -> str:
    return text.replace("'", "''")


def counterfactual() -> str:
    acts = ", ".join(f"CASE WHEN {c} > {t} THEN '{_q(a)}' END" for c, t, a in COUNTERFACTUAL_RULES)
    lst = f"list_filter([{acts}], lambda x: x IS NOT NULL)"
    chosen = f"CASE WHEN len({lst}) = 0 THEN ['{COUNTERFACTUAL_DEFAULT}'] ELSE {lst} END"
    return f"'A lower-risk alternative would be to ' || array_to_string(({chosen})[1:2], ', ') || '.'"


def explanation(band: str, phrases: str, p: str) -> str:
    joined = (f"CASE WHEN len({phrases}) > 1 THEN array_to_string({phrases}[1:len({phrases}) - 1], ', ') || ', and ' || "
              f"{phrases}[len({phrases})] ELSE array_to_string({phrases}, ', ') END")
    return (f"'This transaction was routed to ' || {band} || ' because the strongest signals were ' || {joined} || "
            f"'. The calibrated fraud probability is ' || {pct(p)} || '.'")


#: decision_id is the hash of run, payload and prediction (its explanation included).
DECISIONS = (f"SELECT {HASH} AS decision_id, e.* FROM (SELECT d.*, td.top_drivers, "
             f"{explanation('d.confidence_band', 'td.top_drivers', 'd.score')} AS explanation "
             f"FROM ({SCORED_DECISIONS}) d JOIN ({drivers(SCORED_DECISIONS, FEATURE_ORDER, key='tx_id')}) td USING (tx_id)) e")


def reports(frame: str = DECISIONS) -> str:
    nl = "chr(10)"
    md = (f"concat_ws({nl}, '# Audit Report: ' || decision_id, '', '- Outcome: **' || confidence_band || '**', "
          f"'- Confidence: **' || {pct('confidence')} || '**', '- Calibrated fraud probability: **' || {pct('score')} || '**', "
          f"'', '## Top drivers', array_to_string(list_transform(top_drivers, lambda x: '- ' || x), {nl}), '', '## Explanation', "
          f"explanation, '', '## Counterfactual summary', counterfactual_summary, '', '## Replay', '`replay ' || decision_id || '`')")
    return f"""WITH r AS (SELECT *, {counterfactual()} AS counterfactual_summary, 'replay ' || decision_id AS replay_instructions FROM ({frame}) d)
SELECT decision_id, confidence_band AS decision_outcome, CAST(confidence AS DECIMAL(18,6)) AS confidence,
  CAST(score AS DECIMAL(18,6)) AS fraud_probability, top_drivers, explanation, counterfactual_summary, replay_instructions, {md} AS markdown FROM r"""


PII = [r"U_\d{6}", r"D_\d{6}", r"A_\d{6}", r'"lat":\s*[\d.-]+', r'"lon":\s*[\d.-]+']


def redact(x: str) -> str:
    for p in PII:
        x = f"regexp_replace({x}, '{p}', '[REDACTED]', 'g')"
    return x
