"""DuckDB oracles for metrics, splits, conformal and governance queries."""

from ledgerlens.oracle.canonical import SCORED, SCORED_EXACT, SCORED_MODELS

SC = f"SELECT * EXCLUDE (raw_score), raw_score AS score FROM ({SCORED}) s0"


def _gsel(g):
    return "".join(f"{c}, " for c in g)


def _part(g):
    return "PARTITION BY " + ", ".join(g) if g else ""


def _on(g, a="a", b="b") -> str:
    return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in g) or "TRUE"


def ranking(frame: str, g=()) -> str:
    """By definition: precision at every positive's threshold, pairs of a positive and a negative, best recall within the FPR."""
    gs = _gsel(g)
    gb = "GROUP BY " + ", ".join(g) if g else ""
    ga = "".join(f"a.{c}, " for c in g)
    gab = f"GROUP BY {ga.rstrip(', ')}" if g else ""
    sel = "".join(f"n.{c}, " for c in g)
    return f"""WITH f AS (SELECT {gs}CAST(is_fraud AS INTEGER) AS y, score AS s FROM ({frame}) f0),
c AS (SELECT {gs}s, count(*) AS c, sum(y) AS pos FROM f GROUP BY {gs}s),
n AS (SELECT {gs}CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS p FROM f {gb}),
t AS (SELECT {ga}a.s, a.pos, CAST(sum(b.c) AS DOUBLE) AS sel, CAST(sum(b.pos) AS DOUBLE) AS tp
      FROM c a JOIN c b ON {_on(g)} AND b.s >= a.s WHERE a.pos > 0 GROUP BY {ga}a.s, a.pos),
ap AS (SELECT {ga}sum(a.pos * a.tp / a.sel) AS ap, max(CASE WHEN (a.sel - a.tp) / (n.n - n.p) <= 0.01::DOUBLE THEN a.tp END) AS at
       FROM t a JOIN n ON {_on(g, "a", "n")} {gab}),
w AS (SELECT {ga}sum(CAST(a.pos * (b.c - b.pos) AS DOUBLE) * CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) AS wins
      FROM c a JOIN c b ON {_on(g)} WHERE a.pos > 0 AND b.c > b.pos {gab})
SELECT {sel}
  CASE WHEN n.p = 0 OR n.n = n.p THEN 0.0::DOUBLE ELSE ap.ap / n.p END AS pr_auc,
  CASE WHEN n.p = 0 OR n.n = n.p THEN 0.0::DOUBLE ELSE w.wins / (n.p * (n.n - n.p)) END AS roc_auc,
  CASE WHEN n.p = 0 OR n.n = n.p THEN 0.0::DOUBLE ELSE coalesce(ap.at, 0) / n.p END AS recall_at_1pct_fpr
FROM n LEFT JOIN ap ON {_on(g, "n", "ap")} LEFT JOIN w ON {_on(g, "n", "w")}"""


def _bin(s="score") -> str:
    return "CASE WHEN %s >= 0 AND %s <= 1 THEN %s END" % (s, s, " + ".join(
        f"CAST({s} >= {i * 0.1!r}::DOUBLE AS INTEGER)" for i in range(1, 10)))


def calibration(frame: str, g=()) -> str:
    gs = _gsel(g)
    gb = ("GROUP BY " + ", ".join(g)) if g else ""
    return f"""WITH b AS (SELECT {gs}{_bin()} AS b, count(*) AS c, sum(is_fraud) AS sy, sum(score) AS sp, sum((score - is_fraud) * (score - is_fraud)) AS sq
             FROM ({frame}) f0 GROUP BY ALL)
SELECT {gs}coalesce(sum(sq) / CAST(sum(c) AS DOUBLE), 0.0::DOUBLE) AS brier,
       coalesce(sum(CASE WHEN b IS NOT NULL THEN abs(sy / CAST(c AS DOUBLE) - sp / CAST(c AS DOUBLE)) * CAST(c AS DOUBLE) END) / CAST(sum(c) AS DOUBLE), 0.0::DOUBLE) AS ece
FROM b {gb}"""


METRIC_COLS = ["pr_auc", "roc_auc", "brier", "ece", "recall_at_1pct_fpr"]


def all_metrics(frame: str, g=()) -> str:
    cols = ", ".join(METRIC_COLS)
    if g:
        return (f"SELECT {', '.join(g)}, {cols} FROM ({ranking(frame, g)}) r "
                f"JOIN ({calibration(frame, g)}) c USING ({', '.join(g)})")
    return f"SELECT {cols} FROM ({ranking(frame)}) r, ({calibration(frame)}) c"


def reliability(frame: str) -> str:
    return f"""SELECT {_bin()} AS bin, count(*) AS count,
       round(CAST(sum(is_fraud) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS fraction_positive,
       round(sum(score) / CAST(count(*) AS DOUBLE), 6) AS mean_predicted
FROM ({frame}) f0 WHERE score >= 0 AND score <= 1 GROUP BY 1"""


def chrono(frame: str, train=0.7, val=0.15) -> str:
    return f"""SELECT * EXCLUDE (_rn, _n), CASE WHEN _rn < floor(_n * {train!r}::DOUBLE) THEN 'train'
  WHEN _rn < floor(_n * {train + val!r}::DOUBLE) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY "timestamp", tx_id) - 1 AS _rn, count(*) OVER () AS _n FROM ({frame}) c) r"""


def random(frame: str, seed=7, train=0.7, val=0.15) -> str:
    return f"""SELECT * EXCLUDE (_rn, _n), CASE WHEN _rn < floor(_n * {train!r}::DOUBLE) THEN 'train'
  WHEN _rn < floor(_n * {train + val!r}::DOUBLE) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY sha256('{seed}:' || tx_id)) - 1 AS _rn, count(*) OVER () AS _n FROM ({frame}) c) r"""


def split_part(frame: str, part: str) -> str:
    return f"SELECT * EXCLUDE (split) FROM ({chrono(frame)}) s WHERE split = '{part}'"


def conformal_threshold(calib: str, alpha=0.05) -> str:
    q = f"least(1.0::DOUBLE, ceil((n + 1) * {1.0 - alpha!r}::DOUBLE) / CAST(n AS DOUBLE))"
    return f"""WITH s AS (SELECT CASE WHEN is_fraud = 1 THEN 1.0::DOUBLE - score ELSE score END AS _s FROM ({calib}) c),
o AS (SELECT _s, row_number() OVER (ORDER BY _s) - 1 AS _i FROM s), n AS (SELECT count(*) AS n FROM s)
SELECT n, CASE WHEN n = 0 THEN NULL ELSE {q} END AS q_level, coalesce(_s, 0.5::DOUBLE) AS threshold
FROM n LEFT JOIN o ON _i = ceil((n - 1) * {q})"""


def triage(frame: str, thr: str) -> str:
    fraud, legit = "1.0::DOUBLE - score <= threshold", "score <= threshold"
    band = (f"CASE WHEN ({fraud}) AND NOT ({legit}) THEN 'high_confidence_fraud' "
            f"WHEN ({legit}) AND NOT ({fraud}) THEN 'high_confidence_legit' ELSE 'review_needed' END")
    return f"""SELECT * EXCLUDE (threshold, confidence_band_), confidence_band_ AS confidence_band,
  CASE WHEN confidence_band_ = 'high_confidence_fraud' THEN score
       WHEN confidence_band_ = 'high_confidence_legit' THEN 1.0::DOUBLE - score
       ELSE 1.0::DOUBLE - abs(score - 0.5::DOUBLE) * 2.0::DOUBLE END AS confidence
FROM (SELECT f.*, t.threshold, {band} AS confidence_band_ FROM ({frame}) f, (SELECT threshold FROM ({thr}) x) t) z"""


def interval_fit(calib: str, alpha=0.05) -> str:
    return f"""WITH s AS (SELECT abs(score - is_fraud) AS _s FROM ({calib}) c),
n AS (SELECT count(*) AS n FROM s),
q AS (SELECT n, (n - 1) * least(1.0::DOUBLE, ceil((n + 1) * {1.0 - alpha!r}::DOUBLE) / CAST(n AS DOUBLE)) AS h FROM n),
o AS (SELECT _s AS _v, row_number() OVER (ORDER BY _s) - 1 AS _i FROM s)
SELECT CAST(q.n AS BIGINT) AS n, lo._v + (hi._v - lo._v) * (q.h - floor(q.h)) AS q_hat
FROM q JOIN o lo ON lo._i = floor(q.h) JOIN o hi ON hi._i = least(floor(q.h) + 1, q.n - 1)"""


def interval(frame: str, fit: str) -> str:
    return f"""SELECT * EXCLUDE (q_hat),
  CASE WHEN score + q_hat > 0.5 AND NOT (score - q_hat < 0.5) THEN 'high_confidence_fraud'
       WHEN score - q_hat < 0.5 AND NOT (score + q_hat > 0.5) THEN 'high_confidence_legit' ELSE 'review_needed' END AS confidence_band,
  greatest(0.0::DOUBLE, score - q_hat) AS interval_low, least(1.0::DOUBLE, score + q_hat) AS interval_high
FROM ({frame}) f, (SELECT q_hat FROM ({fit}) x) q"""


def conformal_metrics(bands: str) -> str:
    b = "confidence_band"
    return f"""SELECT CASE WHEN count(*) > 0 THEN round(CAST(count(*) FILTER (WHERE ({b} IN ('high_confidence_fraud', 'review_needed') AND is_fraud = 1)
          OR ({b} IN ('high_confidence_legit', 'review_needed') AND is_fraud = 0)) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) ELSE 0.0::DOUBLE END AS empirical_coverage,
  round(avg(CASE WHEN {b} = 'review_needed' THEN 2 ELSE 1 END), 6) AS average_set_size,
  round(avg(CAST({b} = 'review_needed' AS INTEGER)), 6) AS review_rate,
  count(*) FILTER (WHERE {b} = 'high_confidence_fraud') AS n_high_confidence_fraud,
  count(*) FILTER (WHERE {b} = 'review_needed') AS n_review_needed,
  count(*) FILTER (WHERE {b} = 'high_confidence_legit') AS n_high_confidence_legit
FROM ({bands}) x"""


def fairness_groups(frame: str, col: str, t=0.5) -> str:
    rate = lambda num, den: f"CASE WHEN count(*) FILTER (WHERE {den}) > 0 THEN CAST(count(*) FILTER (WHERE {num} AND {den}) AS DOUBLE) / CAST(count(*) FILTER (WHERE {den}) AS DOUBLE) END"
    pred = f"score >= {t!r}::DOUBLE"
    return f"""SELECT CAST({col} AS VARCHAR) AS "group", count(*) AS count, avg(score) AS avg_score,
  {rate(pred, 'true')} AS selection_rate, {rate('is_fraud = 1', 'true')} AS fraud_rate,
  {rate(pred, 'is_fraud = 1')} AS true_positive_rate, {rate(pred, 'is_fraud = 0')} AS false_positive_rate,
  count(*) FILTER (WHERE {pred}) AS positive_predictions, count(*) FILTER (WHERE NOT ({pred})) AS negative_predictions
FROM ({frame}) f GROUP BY 1"""


def rounded(sql: str, cols: list[str]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in cols)}) FROM ({sql}) rr"


def fairness_summary(groups: str) -> str:
    return f"""SELECT coalesce(round(max(selection_rate) - min(selection_rate), 6), 0.0::DOUBLE) AS demographic_parity_difference,
  CASE WHEN max(selection_rate) > 0 THEN round(min(selection_rate) / max(selection_rate), 6) ELSE 1.0::DOUBLE END AS disparate_impact_ratio,
  round(max(true_positive_rate) - min(true_positive_rate), 6) AS equal_opportunity_difference,
  count(*) AS n_groups FROM ({groups}) g"""


def fairness_overall(frame: str, t=0.5) -> str:
    return f"""SELECT count(*) AS rows, round(avg(score), 6) AS mean_score,
  round(avg(CAST(score >= {t!r}::DOUBLE AS INTEGER)), 6) AS positive_rate FROM ({frame}) f"""


MODELS = SCORED_MODELS


#: Scores that are no multiples of 1e-6 (plain IEEE arithmetic, so both engines hold the same doubles).
SX = f"SELECT * EXCLUDE (raw_score), raw_score AS score FROM ({SCORED_EXACT}) x0"

VAL, TEST = split_part(SC, "validation"), split_part(SC, "test")
THR = conformal_threshold(VAL)
TRI = triage(TEST, THR)
