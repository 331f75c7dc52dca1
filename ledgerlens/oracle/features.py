"""Feature oracles written as self-joins over prior rows (independent of windows)."""

from ledgerlens.oracle.canonical import CANON_COLS

HOUR, DAY, WEEK = 3_600_000_000, 86_400_000_000, 604_800_000_000
WINDOWS = (("1h", HOUR), ("24h", DAY), ("7d", WEEK))

PRIOR = "(b._ts < a._ts OR (b._ts = a._ts AND b.tx_id < a.tx_id))"


def keyed(frame_sql: str) -> str:
    return (
        "WITH t AS (" + frame_sql + "), k AS (SELECT *, epoch_us(\"timestamp\") AS _ts, "
        "CAST(round(amount * 100) AS BIGINT) AS _cents, CAST(round(lat * 1000000) AS BIGINT) AS _lat6, "
        "CAST(round(lon * 1000000) AS BIGINT) AS _lon6 FROM t)"
    )


def _user_aggs() -> str:
    parts = []
    for name, d in WINDOWS:
        f = f"FILTER (WHERE a._ts - b._ts <= {d})"
        parts.append(f"CAST(count(b.tx_id) {f} AS DOUBLE) AS user_txn_count_{name}")
        parts.append(f"CAST(coalesce(sum(b._cents) {f}, 0) AS DOUBLE) / 100.0::DOUBLE AS user_spend_{name}")
        parts.append(
            f"CAST(count(DISTINCT b.merchant_id) FILTER (WHERE a._ts - b._ts <= {d} AND b.merchant_id <> a.merchant_id) AS DOUBLE)"
            f" AS new_merchants_{name}")
    for name, d in WINDOWS[1:]:
        parts.append(
            f"CAST(count(DISTINCT b.merchant_id) FILTER (WHERE a._ts - b._ts <= {d} AND b.merchant_id <> a.merchant_id) + 1 AS DOUBLE)"
            f" AS merchants_seen_{name}")
    n = "count(b.tx_id)"
    nd = f"CAST({n} AS DOUBLE)"
    lat_m = f"CAST(sum(b._lat6) AS DOUBLE) / {nd} / 1000000.0::DOUBLE"
    lon_m = f"CAST(sum(b._lon6) AS DOUBLE) / {nd} / 1000000.0::DOUBLE"
    hav = (f"2.0::DOUBLE * 6371.0::DOUBLE * atan2(sqrt(pow(sin(radians(a.lat - ({lat_m})) / 2.0::DOUBLE), 2) + "
           f"cos(radians({lat_m})) * cos(radians(a.lat)) * pow(sin(radians(a.lon - ({lon_m})) / 2.0::DOUBLE), 2)), "
           f"sqrt(1.0::DOUBLE - (pow(sin(radians(a.lat - ({lat_m})) / 2.0::DOUBLE), 2) + "
           f"cos(radians({lat_m})) * cos(radians(a.lat)) * pow(sin(radians(a.lon - ({lon_m})) / 2.0::DOUBLE), 2))))")
    parts.append(f"CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE round({hav}, 6) END AS distance_from_user_centroid_km")
    parts.append(f"CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE CAST(a._ts - max(b._ts) AS DOUBLE) / 1000000.0::DOUBLE END AS seconds_since_last_txn")
    s1 = "sum(b._cents)"
    s2 = "sum(CAST(b._cents AS HUGEINT) * b._cents)"
    var_c = f"(CAST(CAST({n} AS HUGEINT) * {s2} - CAST({s1} AS HUGEINT) * {s1} AS DOUBLE) / CAST({n} * {n} AS DOUBLE))"
    dev = f"(CAST(a._cents * {n} - {s1} AS DOUBLE) / {nd})"
    z = f"CASE WHEN {var_c} = 0 THEN {dev} / 100.0::DOUBLE ELSE {dev} / sqrt({var_c}) END"
    parts.append(f"CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE round({z}, 6) END AS user_amount_zscore")
    return ",\n  ".join(parts)


def _uh_cte() -> str:
    """All user-keyed features for every row (one self-join)."""
    return f"""
uh AS (
  SELECT a.tx_id, {_user_aggs()}
  FROM k a LEFT JOIN k b ON b.user_id = a.user_id AND {PRIOR}
  GROUP BY a.tx_id, a._ts, a._cents, a.lat, a.lon, a.merchant_id
)"""


def _eh_cte() -> str:
    """Account / device / merchant / (user, device) features (correlated subqueries)."""
    return f"""
eh AS (
  SELECT a.tx_id,
    CAST((SELECT count(DISTINCT b.device_id) FROM k b WHERE b.account_id = a.account_id AND {PRIOR}) AS DOUBLE) AS devices_per_account,
    CAST((SELECT count(DISTINCT b.user_id) FROM k b WHERE b.device_id = a.device_id AND {PRIOR}) AS DOUBLE) AS device_sharing_degree,
    coalesce((SELECT round(CAST(sum(b.is_fraud) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6)
              FROM k b WHERE b.merchant_id = a.merchant_id AND {PRIOR}), 0.0::DOUBLE) AS merchant_fraud_prevalence,
    CASE WHEN EXISTS (SELECT 1 FROM k b WHERE b.user_id = a.user_id AND b.device_id = a.device_id AND {PRIOR})
         THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS is_new_device_for_user
  FROM k a
)"""


def feature_query(frame_sql: str, columns: list[str], source: str) -> str:
    body = keyed(frame_sql) + "," + (_uh_cte() if source == "uh" else _eh_cte())
    cols = ", ".join(f"{source}.{c}" for c in columns)
    return body + f"\nSELECT {CANON_COLS}, {cols} FROM k JOIN {source} USING (tx_id)"


def category_codes_ctes() -> str:
    parts = []
    for c in ("channel", "mcc", "currency"):
        parts.append(f"""
first_{c} AS (
  SELECT {c} AS value, CAST(row_number() OVER (ORDER BY _ts, tx_id) - 1 AS INTEGER) AS code
  FROM (SELECT {c}, _ts, tx_id FROM k QUALIFY row_number() OVER (PARTITION BY {c} ORDER BY _ts, tx_id) = 1) f
)""")
    return ",".join(parts)


def categorical_codes(frame_sql: str) -> str:
    return keyed(frame_sql) + "," + category_codes_ctes() + f"""
SELECT {', '.join('k.' + c.strip() for c in CANON_COLS.split(','))},
       coalesce(fc.code, 0) AS channel_code, coalesce(fm.code, 0) AS mcc_code, coalesce(fu.code, 0) AS currency_code
FROM k LEFT JOIN first_channel fc ON k.channel = fc.value
       LEFT JOIN first_mcc fm ON k.mcc = fm.value
       LEFT JOIN first_currency fu ON k.currency = fu.value"""


FEATURE_ORDER = [
    "user_txn_count_1h", "user_spend_1h", "new_merchants_1h",
    "user_txn_count_24h", "user_spend_24h", "new_merchants_24h",
    "user_txn_count_7d", "user_spend_7d", "new_merchants_7d",
    "distance_from_user_centroid_km", "seconds_since_last_txn", "user_amount_zscore",
    "devices_per_account", "device_sharing_degree", "merchant_fraud_prevalence",
    "is_new_device_for_user",
]
ENTITY = {"devices_per_account", "device_sharing_degree", "merchant_fraud_prevalence", "is_new_device_for_user"}


def gold_features(frame_sql: str) -> str:
    cols = ", ".join(("eh." if c in ENTITY else "uh.") + c for c in FEATURE_ORDER)
    return (keyed(frame_sql) + "," + _uh_cte() + "," + _eh_cte() + "," + category_codes_ctes() + f"""
SELECT {', '.join('k.' + c.strip() for c in CANON_COLS.split(','))}, {cols},
       coalesce(fc.code, 0) AS channel_code, coalesce(fm.code, 0) AS mcc_code, coalesce(fu.code, 0) AS currency_code
FROM k JOIN uh USING (tx_id) JOIN eh USING (tx_id)
       LEFT JOIN first_channel fc ON k.channel = fc.value
       LEFT JOIN first_mcc fm ON k.mcc = fm.value
       LEFT JOIN first_currency fu ON k.currency = fu.value""")


def gold_features_raw(frame_sql: str) -> str:
    """``gold_features`` on a frame whose ids repeat: features are joined by row number, not by id."""
    keyed_rows = keyed(frame_sql).replace("SELECT *, epoch_us", "SELECT *, row_number() OVER () AS _rid, epoch_us", 1)
    uh = _uh_cte().replace("SELECT a.tx_id,", "SELECT a._rid,").replace("GROUP BY a.tx_id,", "GROUP BY a._rid,")
    eh = _eh_cte().replace("SELECT a.tx_id,", "SELECT a._rid,")
    cols = ", ".join(("eh." if c in ENTITY else "uh.") + c for c in FEATURE_ORDER)
    return keyed_rows + "," + uh + "," + eh + f"""
SELECT k.tx_id, k.user_id, k.merchant_id, k.amount, k."timestamp", {cols}
FROM k JOIN uh USING (_rid) JOIN eh USING (_rid)"""
