"""DuckDB oracle for the ETL chain over ``raw_government`` (fixed, known columns)."""

from ledgerlens.oracle.canonical import RAW_GOVERNMENT

RUN_ID = "etl_run_0001"
INGESTED_AT = "2026-01-01T00:00:00+00:00"
SOURCE_SYSTEM = "government_finance"

RAW_COLS = ['"Transaction ID"', '"Beneficiary-ID"', "vendor_id", "payment_account_id", "endpoint_id", "amount",
            "currency", "event_time", "latitude", "longitude", "source_channel", "merchant_category",
            "full_name", "email_address", "taxpayer_id", "is_fraud"]


def _sha_trim(c: str) -> str:
    return f"CASE WHEN trim(CAST({c} AS VARCHAR)) <> '' THEN sha256(trim(CAST({c} AS VARCHAR))) END"


PROFILED = ("SELECT * REPLACE ('[REDACTED]' AS full_name, '[REDACTED]' AS email_address), 'fintech' AS sector FROM ("
            + RAW_GOVERNMENT + ") r0")

NORMALIZED = """SELECT "Transaction ID" AS tx_id, "Beneficiary-ID" AS user_id, vendor_id AS merchant_id,
  payment_account_id AS account_id, endpoint_id AS device_id, amount, currency, event_time AS "timestamp",
  latitude AS lat, longitude AS lon, source_channel AS channel, merchant_category AS mcc, full_name,
  email_address, taxpayer_id, is_fraud, sector FROM ({src}) p"""

ZONE = "'(Z|[+-][0-9]{2}:[0-9]{2})$'"


def coerce_ts(c: str) -> str:
    text = f"trim(CAST({c} AS VARCHAR))"
    zone = f"regexp_extract({text}, {ZONE}, 1)"
    local = f"TRY_CAST(regexp_replace({text}, {ZONE}, '') AS TIMESTAMP)"
    minutes = (f"CASE WHEN {zone} = '' OR {zone} = 'Z' THEN 0 ELSE "
               f"(CASE WHEN substr({zone}, 1, 1) = '-' THEN -1 ELSE 1 END) * "
               f"(CAST(substr({zone}, 2, 2) AS INTEGER) * 60 + CAST(substr({zone}, 5, 2) AS INTEGER)) END")
    return f"CASE WHEN {text} = '' THEN NULL ELSE {local} - to_minutes({minutes}) END"


HASHED = ("SELECT *, " + _sha_trim("full_name") + " AS full_name_hash, " + _sha_trim("email_address")
          + " AS email_address_hash, " + _sha_trim("taxpayer_id") + " AS taxpayer_id_hash FROM ({src}) n")

CASTED = """SELECT CAST(tx_id AS VARCHAR) AS tx_id,
  coalesce(CAST(user_id AS VARCHAR), 'unknown_user') AS user_id,
  coalesce(CAST(merchant_id AS VARCHAR), 'unknown_merchant') AS merchant_id,
  coalesce(CAST(device_id AS VARCHAR), 'unknown_device') AS device_id,
  coalesce(CAST(account_id AS VARCHAR), 'unknown_account') AS account_id,
  TRY_CAST(amount AS DOUBLE) AS amount,
  coalesce(CAST(currency AS VARCHAR), 'USD') AS currency,
  """ + coerce_ts('"timestamp"') + """ AS "timestamp",
  coalesce(TRY_CAST(lat AS DOUBLE), 0.0::DOUBLE) AS lat,
  coalesce(TRY_CAST(lon AS DOUBLE), 0.0::DOUBLE) AS lon,
  coalesce(CAST(channel AS VARCHAR), 'government_batch') AS channel,
  coalesce(CAST(mcc AS VARCHAR), 'public_services') AS mcc,
  coalesce(TRY_CAST(is_fraud AS INTEGER), 0) AS is_fraud,
  full_name, email_address, taxpayer_id, sector, full_name_hash, email_address_hash, taxpayer_id_hash
FROM ({src}) h"""

VALID = """SELECT * FROM ({src}) c WHERE tx_id IS NOT NULL AND amount IS NOT NULL AND amount >= 0
  AND "timestamp" IS NOT NULL"""

_OTHER = sorted(["user_id", "merchant_id", "device_id", "account_id", "currency", "lat", "lon", "channel", "mcc",
                 "is_fraud", "full_name", "email_address", "taxpayer_id", "sector", "full_name_hash",
                 "email_address_hash", "taxpayer_id_hash"])
DEDUP = ("SELECT * FROM ({src}) v QUALIFY row_number() OVER (PARTITION BY tx_id ORDER BY \"timestamp\" DESC, "
         "amount DESC, " + ", ".join(f"{c} DESC" for c in _OTHER) + ") = 1")

RECORD_HASH = """sha256(concat_ws('|', coalesce(tx_id, ''), coalesce(user_id, ''), coalesce(merchant_id, ''),
  coalesce(device_id, ''), coalesce(account_id, ''), coalesce(CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR), ''),
  coalesce(currency, ''), coalesce(strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f'), ''),
  coalesce(CAST(CAST(lat AS DECIMAL(18,6)) AS VARCHAR), ''), coalesce(CAST(CAST(lon AS DECIMAL(18,6)) AS VARCHAR), ''),
  coalesce(channel, ''), coalesce(mcc, ''), coalesce(CAST(is_fraud AS VARCHAR), '')))"""

def silver_cols(run_id: str = RUN_ID, source_system: str = SOURCE_SYSTEM) -> str:
    return ('tx_id, user_id, merchant_id, device_id, account_id, amount, currency, "timestamp", lat, lon, '
            'channel, mcc, is_fraud, sector, full_name_hash, email_address_hash, taxpayer_id_hash, '
            f"'{run_id}' AS etl_run_id, '{source_system}' AS source_system, '{INGESTED_AT}' AS ingested_at")


def chain(*stages: str, src: str = PROFILED) -> str:
    out = src
    for s in stages:
        out = s.replace("{src}", out)
    return out


#: The silver chain hashes original values: rows are typed and de-duplicated unmasked, then the survivors are hashed.
UNMASKED = "SELECT *, 'fintech' AS sector FROM (" + RAW_GOVERNMENT + ") r0"
_HASH_COLS = ", full_name_hash, email_address_hash, taxpayer_id_hash"
CASTED_RAW = CASTED.replace(_HASH_COLS, "")
DEDUP_RAW = DEDUP
for _c in ("full_name_hash", "email_address_hash", "taxpayer_id_hash"):
    DEDUP_RAW = DEDUP_RAW.replace(f", {_c} DESC", "")


def silver(run_id: str = RUN_ID, source_system: str = SOURCE_SYSTEM) -> str:
    base = chain(NORMALIZED, CASTED_RAW, VALID, DEDUP_RAW, HASHED, src=UNMASKED)
    return f"SELECT *, {RECORD_HASH} AS record_hash FROM (SELECT {silver_cols(run_id, source_system)} FROM ({base}) d) s"


def quality() -> str:
    valid = chain(NORMALIZED, HASHED, CASTED, VALID)
    sil = silver()
    nulls = ", ".join(
        f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_{c.strip(chr(34))}"
        for c in ['tx_id', 'user_id', 'merchant_id', 'device_id', 'account_id', 'amount', 'currency',
                  '"timestamp"', 'lat', 'lon', 'channel', 'mcc', 'is_fraud'])
    return f"""WITH r AS (SELECT count(*) AS rows_extracted FROM ({PROFILED}) x),
v AS (SELECT count(*) AS vb FROM ({valid}) y),
s AS (SELECT count(*) AS rows_valid, {nulls} FROM ({sil}) z)
SELECT rows_extracted, rows_valid, rows_extracted - rows_valid AS rows_invalid, rows_valid AS rows_loaded,
       vb - rows_valid AS duplicates_removed, * EXCLUDE (rows_extracted, rows_valid, vb)
FROM r, v, s"""
