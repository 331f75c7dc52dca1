"""DuckDB text of the canonical frames (mirrors ``sources.canonical``)."""

TX_EVENTS = """
SELECT 'ev_' || CAST(event_id AS VARCHAR) AS tx_id,
       'user_' || CAST(user_id AS VARCHAR) AS user_id,
       'm_' || CAST(event_id * 7 % 40 AS VARCHAR) AS merchant_id,
       'd_' || json_extract_string(props, '$.k') AS device_id,
       'acct_' || CAST(user_id % 60 AS VARCHAR) AS account_id,
       CAST(value AS DOUBLE) AS amount,
       'USD' AS currency,
       CAST(ts AS TIMESTAMP) AS "timestamp",
       25.0::DOUBLE + CAST(user_id * 37 % 2300 AS DOUBLE) / 100.0::DOUBLE + CAST(event_id % 7 AS DOUBLE) / 10.0::DOUBLE AS lat,
       -120.0::DOUBLE + CAST(user_id * 53 % 4800 AS DOUBLE) / 100.0::DOUBLE + CAST(event_id % 5 AS DOUBLE) / 10.0::DOUBLE AS lon,
       CASE WHEN event_type IN ('click', 'view') THEN 'web' WHEN event_type = 'signup' THEN 'mobile' ELSE 'pos' END AS channel,
       event_type AS mcc,
       CAST(((value > 150 AND event_id % 3 = 0) OR event_id % 41 = 0) AS INTEGER) AS is_fraud
FROM events
"""

SCORED = """
SELECT t.*, round(1.0 / (1.0 + exp(-(
         -5.0 + least(e.value, 400.0) * 0.025
         + CAST(e.event_id % 3 = 0 AS DOUBLE) * 1.2 + CAST((e.event_id * 13) % 7 = 0 AS DOUBLE) * 0.8
         + CAST(e.event_id % 41 = 0 AS DOUBLE) * 2.5))), 6) AS raw_score
FROM (""" + TX_EVENTS + """) t JOIN events e ON t.tx_id = 'ev_' || CAST(e.event_id AS VARCHAR)
"""

SCORED_EXACT = """
SELECT t.*, e.value / (e.value + 37.3::DOUBLE) * 0.9::DOUBLE + CAST(e.event_id % 1000 AS DOUBLE) / 10000000.0::DOUBLE AS raw_score
FROM (""" + TX_EVENTS + """) t JOIN events e ON t.tx_id = 'ev_' || CAST(e.event_id AS VARCHAR)
"""

TX_LINEITEM_RAW = """
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS tx_id,
       'cust_' || CAST(o_custkey AS VARCHAR) AS user_id,
       'supp_' || CAST(l_suppkey AS VARCHAR) AS merchant_id,
       'part_' || CAST(l_partkey % 500 AS VARCHAR) AS device_id,
       'acct_' || CAST(o_custkey % 300 AS VARCHAR) AS account_id,
       CAST(l_extendedprice AS DOUBLE) AS amount,
       'USD' AS currency,
       CAST(l_shipdate AS TIMESTAMP) AS "timestamp",
       -60.0::DOUBLE + CAST(o_custkey * 37 % 12000 AS DOUBLE) / 100.0::DOUBLE AS lat,
       -170.0::DOUBLE + CAST(l_suppkey * 53 % 34000 AS DOUBLE) / 100.0::DOUBLE AS lon,
       o_orderpriority AS channel,
       c_mktsegment AS mcc,
       CAST(l_returnflag = 'R' AND l_linenumber % 4 = 0 AS INTEGER) AS is_fraud,
       l_partkey AS part_key, l_suppkey AS supp_key, l_quantity AS qty
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
"""

CANON_COLS = ('tx_id, user_id, merchant_id, device_id, account_id, amount, currency, "timestamp", '
              'lat, lon, channel, mcc, is_fraud')

TX_LINEITEM = (
    "SELECT " + CANON_COLS + " FROM (" + TX_LINEITEM_RAW + ") r "
    "QUALIFY row_number() OVER (PARTITION BY tx_id ORDER BY \"timestamp\" DESC, amount DESC, "
    "part_key DESC, supp_key DESC, qty DESC) = 1"
)

RAW_GOVERNMENT = """
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS "Transaction ID",
       CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE 'cust_' || CAST(o_custkey AS VARCHAR) END AS "Beneficiary-ID",
       'supp_' || CAST(l_suppkey AS VARCHAR) AS vendor_id,
       'acct_' || CAST(o_custkey % 300 AS VARCHAR) AS payment_account_id,
       CASE WHEN l_orderkey % 67 = 0 THEN NULL ELSE 'part_' || CAST(l_partkey % 500 AS VARCHAR) END AS endpoint_id,
       CASE WHEN l_orderkey % 61 = 0 THEN 'n/a'
            WHEN l_orderkey % 53 = 0 THEN CAST(CAST(-l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)
            ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount,
       CASE WHEN l_suppkey % 10 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
       CASE WHEN l_orderkey % 71 = 0 THEN ''
            WHEN l_orderkey % 73 = 0 THEN 'not-a-date'
            WHEN l_orderkey % 5 = 0 THEN strftime(CAST(l_shipdate AS TIMESTAMP) + to_hours(l_linenumber), '%Y-%m-%dT%H:%M:%S') || 'Z'
            WHEN l_orderkey % 7 = 0 THEN strftime(CAST(l_shipdate AS TIMESTAMP) + to_hours(l_linenumber), '%Y-%m-%dT%H:%M:%S') || '+02:00'
            ELSE strftime(CAST(l_shipdate AS TIMESTAMP) + to_hours(l_linenumber), '%Y-%m-%dT%H:%M:%S') END AS event_time,
       CASE WHEN l_orderkey % 83 = 0 THEN NULL
            ELSE -60.0::DOUBLE + CAST(o_custkey * 37 % 12000 AS DOUBLE) / 100.0::DOUBLE END AS latitude,
       -170.0::DOUBLE + CAST(l_suppkey * 53 % 34000 AS DOUBLE) / 100.0::DOUBLE AS longitude,
       o_orderpriority AS source_channel,
       c_mktsegment AS merchant_category,
       c_name AS full_name,
       lower(c_name) || '@example.org' AS email_address,
       CASE WHEN l_orderkey % 97 = 0 THEN '  ' ELSE 'TX' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS taxpayer_id,
       CAST(l_returnflag = 'R' AND l_linenumber % 4 = 0 AS INTEGER) AS is_fraud
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
"""

HEALTHCARE = """
SELECT 'clm_' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS claim_id,
       'pat_' || CAST(o_custkey AS VARCHAR) AS patient_id,
       'prov_' || CAST(l_suppkey AS VARCHAR) AS provider_id,
       l_extendedprice AS claim_amount,
       CAST(l_shipdate AS TIMESTAMP) AS claim_timestamp,
       c_name AS patient_name
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
"""

IEEE_CIS = """
SELECT l_orderkey * 10 + l_linenumber AS "TransactionID",
       CAST(date_diff('second', TIMESTAMP '1995-01-01 00:00:00', CAST(l_shipdate AS TIMESTAMP)) + l_linenumber * 60 AS BIGINT) AS "TransactionDT",
       l_extendedprice AS "TransactionAmt", l_returnflag AS "ProductCD",
       CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE o_custkey END AS card1,
       c_mktsegment AS card4, c_nationkey AS addr1, l_suppkey % 100 AS addr2,
       CASE WHEN l_linenumber % 2 = 0 THEN 'desktop' ELSE 'mobile' END AS "DeviceType",
       CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'dev_' || CAST(l_partkey % 50 AS VARCHAR) END AS "DeviceInfo",
       CAST(l_returnflag = 'R' AND l_linenumber % 4 = 0 AS INTEGER) AS "isFraud"
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
"""

CREDIT_CARD = """
SELECT event_id, CAST(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP)) AS BIGINT) AS "Time",
       (value - 100.0::DOUBLE) / 37.0::DOUBLE AS "V1",
       CAST(user_id % 13 - 6 AS DOUBLE) / 3.0::DOUBLE AS "V2",
       value AS "Amount",
       CAST((value > 150 AND event_id % 3 = 0) OR event_id % 41 = 0 AS INTEGER) AS "Class"
FROM events
"""

ADAPTER_IEEE = """
SELECT CAST("TransactionID" AS VARCHAR) AS tx_id,
       coalesce(CAST(card1 AS VARCHAR), CAST("TransactionID" AS VARCHAR)) AS user_id,
       coalesce("ProductCD", 'ieee_product') AS merchant_id,
       coalesce("DeviceInfo", "DeviceType", 'unknown_device') AS device_id,
       coalesce(CAST(card1 AS VARCHAR), 'card') || '_' || coalesce(card4, 'na') AS account_id,
       coalesce(TRY_CAST("TransactionAmt" AS DOUBLE), 0.0::DOUBLE) AS amount,
       'USD' AS currency,
       TIMESTAMP '2017-12-01 00:00:00' + to_seconds(coalesce(TRY_CAST("TransactionDT" AS BIGINT), 0)) AS "timestamp",
       coalesce(TRY_CAST(addr1 AS DOUBLE), 0.0::DOUBLE) AS lat,
       coalesce(TRY_CAST(addr2 AS DOUBLE), 0.0::DOUBLE) AS lon,
       coalesce("DeviceType", 'online') AS channel,
       coalesce("ProductCD", 'retail') AS mcc,
       coalesce(TRY_CAST("isFraud" AS INTEGER), 0) AS is_fraud
FROM (""" + IEEE_CIS + ") s"

_BUCKET = ("coalesce(CAST(CAST(round(TRY_CAST(\"V1\" AS DOUBLE), 2) AS DECIMAL(18,2)) AS VARCHAR), '0') || '_' || "
           "coalesce(CAST(CAST(round(TRY_CAST(\"V2\" AS DOUBLE), 2) AS DECIMAL(18,2)) AS VARCHAR), '0')")

ADAPTER_CREDIT_CARD = """
SELECT 'ccf_' || CAST(event_id AS VARCHAR) AS tx_id,
       'user_' || """ + _BUCKET + """ AS user_id,
       'credit_card_network' AS merchant_id, 'card_terminal' AS device_id,
       'acct_' || """ + _BUCKET + """ AS account_id,
       coalesce(TRY_CAST("Amount" AS DOUBLE), 0.0::DOUBLE) AS amount,
       'EUR' AS currency,
       TIMESTAMP '2023-01-01 00:00:00' + to_seconds(coalesce(TRY_CAST("Time" AS BIGINT), 0)) AS "timestamp",
       0.0::DOUBLE AS lat, 0.0::DOUBLE AS lon, 'card_present' AS channel, 'consumer_credit' AS mcc,
       coalesce(TRY_CAST("Class" AS INTEGER), 0) AS is_fraud
FROM (""" + CREDIT_CARD + ") s"

SCORED_MODELS = """
SELECT tx_id, "timestamp", channel, mcc, is_fraud, m.model, m.score FROM (""" + SCORED + """) s,
LATERAL (VALUES ('logit', raw_score),
                ('amount_rank', round(least(amount, 400.0) / 400.0, 6)),
                ('blend', round((raw_score + round(least(amount, 400.0) / 400.0, 6)) / 2.0, 6))) m(model, score)
"""
