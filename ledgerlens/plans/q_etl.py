"""Scan / source / sink and cleansing queries over the raw government export."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators import adapters as ad
from ledgerlens.operators import etl as ops
from ledgerlens.operators.ranking import global_row_number
from ledgerlens.oracle import canonical as oc
from ledgerlens.oracle import etl as oe
from ledgerlens.plans.etl import DEFAULT_INGESTED_AT, DEFAULT_RUN_ID, DEFAULT_SOURCE_SYSTEM, run_etl
from ledgerlens.plans.registry import query
from ledgerlens.sources import canonical as cn
from ledgerlens.sources import io

RAW_PATH = "/lake/raw/government_transactions.parquet"


def _profiled(spark, sf):
    return ops.apply_sector_profile(cn.raw_government(spark, sf), "fintech")


def _silver(raw, run_id=DEFAULT_RUN_ID, source_system=DEFAULT_SOURCE_SYSTEM, by_user=False):
    return ops.prepare_silver(raw, run_id, source_system, DEFAULT_INGESTED_AT, profile="fintech", by_user=by_user)[1]


def _export(spark, sf):
    """The raw export, written once: loads read it without joining its sources again, whose exchanges are gone by then."""
    return io.written(cn.raw_government(spark, sf), "export")


def _load(raw, run_id, write, last=False):
    """Silver of ``raw`` into a sink, by user; what it stands on goes at once, and the export too after the ``last`` load."""
    silver = _silver(raw, run_id=run_id, by_user=True)
    if last:
        io.discard(raw)
    write(silver)
    io.discard(silver)


# ------------------------------------------------------------------ cleansing

@query("sector_profile", f"""SELECT claim_id AS tx_id, patient_id AS user_id, provider_id AS merchant_id,
  claim_amount AS amount, claim_timestamp AS "timestamp", '[REDACTED]' AS patient_name,
  'claims_portal' AS channel, 'healthcare_claim' AS mcc, 'USD' AS currency, 'healthcare' AS sector
FROM ({oc.HEALTHCARE}) h""")
def sector_profile(spark, sf):
    return ops.apply_sector_profile(cn.healthcare_claims(spark, sf), "healthcare")


@query("normalize_columns", oe.chain(oe.NORMALIZED))
def normalize_columns(spark, sf):
    return ops.normalize_columns(_profiled(spark, sf))


@query("fill_defaults", f"""SELECT "Transaction ID" AS tx_id, vendor_id AS merchant_id, amount,
  event_time AS "timestamp", 'unknown_user' AS user_id, 'unknown_device' AS device_id,
  'unknown_account' AS account_id, 'USD' AS currency, 0.0::DOUBLE AS lat, 0.0::DOUBLE AS lon,
  'government_batch' AS channel, 'public_services' AS mcc, 0 AS is_fraud
FROM ({oc.RAW_GOVERNMENT}) r""")
def fill_defaults(spark, sf):
    """Sparse legacy export (5 columns): every other canonical column is defaulted."""
    sparse = cn.raw_government(spark, sf).select("Transaction ID", "vendor_id", "amount", "event_time")
    return ops.fill_defaults(ops.normalize_columns(sparse), DEFAULT_SOURCE_SYSTEM)


@query("fill_defaults_tx_id", f"""SELECT vendor_id AS merchant_id, amount, event_time AS "timestamp",
  row_number AS source_row_number, 'unknown_user' AS user_id, 'unknown_device' AS device_id,
  'unknown_account' AS account_id, 'USD' AS currency, 0.0::DOUBLE AS lat, 0.0::DOUBLE AS lon,
  'government_batch' AS channel, 'public_services' AS mcc, 0 AS is_fraud,
  'government_finance_' || CAST(row_number AS VARCHAR) AS tx_id
FROM (SELECT vendor_id, amount, event_time, CAST(row_number() OVER (ORDER BY "Transaction ID", vendor_id, amount,
        event_time) - 1 AS BIGINT) AS row_number FROM ({oc.RAW_GOVERNMENT}) r) x""")
def fill_defaults_tx_id(spark, sf):
    """No transaction id in the source: ``tx_id = source_system_rowno`` from an explicit row order."""
    raw = cn.raw_government(spark, sf)
    keyed = global_row_number(raw.select("Transaction ID", "vendor_id", "amount", "event_time"),
                              ["Transaction ID", "vendor_id", "amount", "event_time"], name="source_row_number")
    return ops.fill_defaults(ops.normalize_columns(keyed.drop("Transaction ID")), DEFAULT_SOURCE_SYSTEM)


@query("pseudonymous_user", f"""SELECT "Transaction ID" AS tx_id,
  CASE WHEN trim(taxpayer_id) <> '' THEN 'user_' || substr(sha256(trim(taxpayer_id)), 1, 12) END AS user_id
FROM ({oc.RAW_GOVERNMENT}) r""")
def pseudonymous_user(spark, sf):
    raw = cn.raw_government(spark, sf).select("Transaction ID", "taxpayer_id")
    return ops.pseudonymous_user(ops.normalize_columns(raw)).select("tx_id", "user_id")


@query("pii_hash", oe.chain(oe.NORMALIZED, oe.HASHED))
def pii_hash(spark, sf):
    return ops.pii_hash(ops.normalize_columns(_profiled(spark, sf)))


@query("coerce_timestamp", f"""SELECT "Transaction ID" AS tx_id, event_time, {oe.coerce_ts('event_time')} AS parsed
FROM ({oc.RAW_GOVERNMENT}) r""")
def coerce_timestamp(spark, sf):
    raw = cn.raw_government(spark, sf)
    return raw.select(F.col("Transaction ID").alias("tx_id"), "event_time",
                      ops.coerce_timestamp(F.col("event_time")).alias("parsed"))


@query("cast_canonical", oe.chain(oe.NORMALIZED, oe.HASHED, oe.CASTED))
def cast_canonical(spark, sf):
    return ops.cast_canonical(ops.pii_hash(ops.normalize_columns(_profiled(spark, sf))))


@query("validity_filter", oe.chain(oe.NORMALIZED, oe.HASHED, oe.CASTED, oe.VALID))
def validity_filter(spark, sf):
    return ops.validity_filter(ops.cast_canonical(ops.pii_hash(ops.normalize_columns(_profiled(spark, sf)))))


@query("dedup_latest", oe.chain(oe.NORMALIZED, oe.HASHED, oe.CASTED, oe.VALID, oe.DEDUP))
def dedup_latest(spark, sf):
    from ledgerlens.operators.cleansing import dedup_latest as dd
    valid = ops.validity_filter(ops.cast_canonical(ops.pii_hash(ops.normalize_columns(_profiled(spark, sf)))))
    order = ["timestamp", "amount"] + sorted(c for c in valid.columns if c not in ("tx_id", "timestamp", "amount"))
    return dd(valid, "tx_id", order)


@query("record_hash", f"SELECT tx_id, record_hash FROM ({oe.silver()}) s")
def record_hash(spark, sf):
    return _silver(cn.raw_government(spark, sf)).select("tx_id", "record_hash")


@query("silver_table", oe.silver())
def silver_table(spark, sf):
    return _silver(cn.raw_government(spark, sf))


@query("etl_quality_report", oe.quality())
def etl_quality_report(spark, sf):
    return run_etl(cn.raw_government(spark, sf), source_path=RAW_PATH).quality


# ------------------------------------------------------------------ adapters

@query("adapter_ieee_cis", oc.ADAPTER_IEEE)
def adapter_ieee_cis(spark, sf):
    return ad.adapter_ieee_cis(cn.ieee_cis_source(spark, sf))


@query("adapter_credit_card", oc.ADAPTER_CREDIT_CARD)
def adapter_credit_card(spark, sf):
    return ad.adapter_credit_card(cn.credit_card_source(spark, sf), row_key="event_id")


@query("prepare_dataset", oc.ADAPTER_IEEE)
def prepare_dataset(spark, sf):
    """Adapter -> time-sorted parquet write -> read back (the prepared canonical dataset)."""
    out = io.fresh_dir(spark, "prepared") + "/ieee_cis.parquet"
    canon = ad.adapter_ieee_cis(cn.ieee_cis_source(spark, sf))
    canon.repartitionByRange("timestamp", "tx_id").sortWithinPartitions("timestamp", "tx_id").write.parquet(out)
    return spark.read.parquet(out)


_MANIFEST = """SELECT '{name}' AS dataset, count(*) AS rows, min("timestamp") AS first_time, max("timestamp") AS last_time,
  sum(is_fraud) AS frauds, '{at}' AS prepared_at FROM ({sql}) {name}_x"""
PREPARED = (("ieee_cis", "2026-01-01"), ("credit_card", "2026-01-02"))


@query("prepared_datasets", " UNION ALL ".join(_MANIFEST.format(name=n, at=a, sql=q) for (n, a), q in zip(
    PREPARED, (oc.ADAPTER_IEEE, oc.ADAPTER_CREDIT_CARD))) + " ORDER BY prepared_at DESC LIMIT 10")
def prepared_datasets(spark, sf):
    """Prepare both sources, write a manifest row for each and list the newest."""
    frames = {"ieee_cis": ad.adapter_ieee_cis(cn.ieee_cis_source(spark, sf)),
              "credit_card": ad.adapter_credit_card(cn.credit_card_source(spark, sf), row_key="event_id")}
    base, out = io.fresh_dir(spark, "prepared"), None
    for name, at in PREPARED:
        frames[name].write.parquet(f"{base}/{name}")
        m = spark.read.parquet(f"{base}/{name}").agg(
            F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"),
            F.sum("is_fraud").alias("frauds")).select(F.lit(name).alias("dataset"), "*", F.lit(at).alias("prepared_at"))
        m.write.mode("append").parquet(f"{base}/manifest")
    return spark.read.parquet(f"{base}/manifest").orderBy(F.desc("prepared_at")).limit(10)


# ------------------------------------------------------------------ bronze & sinks

BRONZE_SQL = (f"SELECT *, '{DEFAULT_RUN_ID}' AS etl_run_id, '{DEFAULT_SOURCE_SYSTEM}' AS source_system, "
              f"'{RAW_PATH}' AS source_path FROM ({oe.PROFILED}) p")


@query("bronze_snapshot", BRONZE_SQL)
def bronze_snapshot(spark, sf):
    return run_etl(cn.raw_government(spark, sf), source_path=RAW_PATH).bronze


_RAW_KEYS = sorted(c.strip('"') for c in oe.RAW_COLS + ["sector"])


def _json_sql() -> str:
    def val(c):
        q = f'"{c}"'
        return f"CAST({q} AS DECIMAL(18,6))" if c in ("latitude", "longitude") else q
    fields = ", ".join(f"'{c}': {val(c)}" for c in _RAW_KEYS)
    order = ", ".join(f'"{c}" NULLS FIRST' for c in _RAW_KEYS)
    return (f"SELECT '{DEFAULT_RUN_ID}' AS etl_run_id, '{DEFAULT_SOURCE_SYSTEM}' AS source_system, "
            f"'{RAW_PATH}' AS source_path, CAST(row_number() OVER (ORDER BY {order}) - 1 AS BIGINT) AS source_row_number, "
            f"CAST(to_json({{{fields}}}) AS VARCHAR) AS raw_record_json FROM ({oe.PROFILED}) p")


@query("bronze_raw_json", _json_sql())
def bronze_raw_json(spark, sf):
    prof = _profiled(spark, sf)
    keyed = global_row_number(prof, sorted(prof.columns), name="_row")
    return ops.bronze_raw_json(keyed, DEFAULT_RUN_ID, DEFAULT_SOURCE_SYSTEM, RAW_PATH, row_number_col="_row")


def _roundtrip(spark, sf, fmt):
    raw = cn.raw_government(spark, sf)
    path = io.fresh_dir(spark, "src") + f"/government.{fmt}"
    io.write_source(raw, path)
    back = io.read_source(spark, path, schema=raw.schema if fmt == "json" else None,
                          options=io.CSV_READ_OWN if fmt == "csv" else None)
    return io.cast_like(back, raw.schema) if fmt == "csv" else back


@query("read_source", oc.RAW_GOVERNMENT)
def read_source(spark, sf):
    return _roundtrip(spark, sf, "parquet")


@query("read_source_csv", oc.RAW_GOVERNMENT)
def read_source_csv(spark, sf):
    return _roundtrip(spark, sf, "csv")


@query("read_source_json", oc.RAW_GOVERNMENT)
def read_source_json(spark, sf):
    return _roundtrip(spark, sf, "json")


@query("write_layers", oe.silver())
def write_layers(spark, sf):
    """Bronze / silver / gold layers partitioned by run id plus current snapshots; read back current silver."""
    base = io.fresh_dir(spark, "lake")
    raw = _export(spark, sf)
    res = run_etl(raw, source_path=RAW_PATH, by_user=True)
    silver_path = io.write_layer(res.silver, base, "silver")
    io.discard(res.silver)
    silver = spark.read.parquet(silver_path)  # written once, read back for the fan-out
    io.write_layer(res.bronze, base, "bronze")
    io.discard(raw)
    from ledgerlens.operators.features import gold_features, in_steps
    # hashes travel as bytes, in half the space of their hex text
    hashes = [c for c in silver.columns if c.endswith("_hash")]
    with in_steps():
        built = gold_features(silver.withColumns({c: F.unhex(c) for c in hashes}))
    gold = built.withColumns({c: F.lower(F.hex(c)) for c in hashes})
    gold_path = io.write_layer(gold, base, "gold")
    io.discard(built)
    io.write_current(silver, base, "transactions.parquet")
    io.write_current(spark.read.parquet(gold_path).select(*gold.columns), base, "features.parquet")  # built once
    return spark.read.parquet(f"{base}/current/transactions.parquet")


def _silver_cols():
    return ("tx_id, user_id, merchant_id, device_id, account_id, amount, currency, \"timestamp\", lat, lon, channel, "
            "mcc, is_fraud, sector, full_name_hash, email_address_hash, taxpayer_id_hash, source_system, ingested_at, "
            "record_hash, etl_run_id")


@query("load_run_idempotent", f"""SELECT {_silver_cols()} FROM ({oe.silver('etl_run_0001')}) a
UNION ALL SELECT {_silver_cols()} FROM ({oe.silver('etl_run_0002')}) b""")
def load_run_idempotent(spark, sf):
    """Load run 1 twice and run 2 once with dynamic partition overwrite: each run appears exactly once."""
    base = io.fresh_dir(spark, "warehouse")
    raw = _export(spark, sf)
    for run in ("etl_run_0001", "etl_run_0001", "etl_run_0002"):
        _load(raw, run, lambda s: io.write_layer(s, base, "silver_transactions"), last=run == "etl_run_0002")
    return spark.read.parquet(f"{base}/silver_transactions")


@query("load_run_drifted", f"""SELECT {_silver_cols()}, NULL AS reviewer FROM ({oe.silver('etl_run_0001')}) a
UNION ALL SELECT {_silver_cols().replace(' sector,', ' NULL AS sector,')}, 'r' || CAST(length(tx_id) AS VARCHAR) AS reviewer FROM ({oe.silver('etl_run_0002')}) b""")
def load_run_drifted(spark, sf):
    """A run with a new column and without an old one joins the table: the merged schema holds both, no history is lost."""
    base = io.fresh_dir(spark, "warehouse")
    raw = _export(spark, sf)
    _load(raw, "etl_run_0001", lambda s: io.write_layer(s, base, "silver_transactions"))
    drifted = lambda s: s.drop("sector").withColumn("reviewer", F.concat(F.lit("r"), F.length("tx_id").cast("string")))
    _load(raw, "etl_run_0002", lambda s: io.write_layer(drifted(s), base, "silver_transactions"), last=True)
    return spark.read.option("mergeSchema", "true").parquet(f"{base}/silver_transactions")


LEDGER_RUNS = [("etl_run_0001", "2026-01-01 00:00:00"), ("etl_run_0002", "2026-01-02 00:00:00"),
               ("etl_run_0001", "2026-01-03 00:00:00")]


@query("etl_run_ledger", f"""WITH q AS ({oe.quality()}),
runs AS (SELECT * FROM (VALUES {', '.join(f"('{r}', TIMESTAMP '{t}')" for r, t in LEDGER_RUNS)}) v(run_id, created_at))
SELECT run_id, 'transactions' AS dataset_name, '{DEFAULT_SOURCE_SYSTEM}' AS source_system, rows_extracted, rows_valid,
       rows_invalid, rows_loaded, duplicates_removed, created_at
FROM runs, q QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY created_at DESC) = 1
ORDER BY created_at DESC LIMIT 10""")
def etl_run_ledger(spark, sf):
    """Every load records its run in the stored ledger, an upsert by run id; the query lists the ledger's newest runs."""
    from ledgerlens.plans.etl import record_run, run_ledger
    q = io.written(run_etl(cn.raw_government(spark, sf), source_path=RAW_PATH).quality, "quality")
    ledger = run_ledger(spark, io.fresh_dir(spark, "ledger"))
    for run, at in LEDGER_RUNS:
        record_run(ledger, q, run, at)
    return ledger.read().orderBy(F.desc("created_at")).limit(10)


@query("lakehouse_views", oe.silver("etl_run_0002"))
def lakehouse_views(spark, sf):
    """``etl_silver`` view = the latest run's partition (max run id; partition pruning)."""
    from ledgerlens.plans.lakehouse import build_views
    base = io.fresh_dir(spark, "lakeviews")
    raw = _export(spark, sf)
    for run in ("etl_run_0001", "etl_run_0002"):
        _load(raw, run, lambda s: io.write_layer(s, base, "silver"), last=run == "etl_run_0002")
    build_views(spark, base)
    return spark.table("etl_silver").select(*[c.strip('"') for c in _silver_cols().replace(' ', '').split(',')])


LAKE_SQL = ("select channel, count(*) as n_tx, round(sum(amount), 2) as total_amount, "
            "sum(is_fraud) as n_fraud from transactions group by channel")


@query("lakehouse_query", f"""SELECT * FROM (SELECT channel, count(*) AS n_tx, round(sum(amount), 2) AS total_amount,
  CAST(sum(is_fraud) AS BIGINT) AS n_fraud FROM ({oe.silver()}) t GROUP BY channel) q LIMIT 1000""")
def lakehouse_query(spark, sf):
    from ledgerlens.plans.lakehouse import build_views, query_lakehouse
    base = io.fresh_dir(spark, "lakeq")
    io.write_current(_silver(cn.raw_government(spark, sf)), base, "transactions.parquet")
    build_views(spark, base)
    return query_lakehouse(spark, LAKE_SQL, limit=1000)


@query("parquet_profile")
def parquet_profile(spark, sf):
    return io.parquet_profile(spark, f"{sf.rstrip('/')}/lineitem.parquet")


@query("legacy_migration", oe.silver(source_system="legacy_rules_engine"))
def legacy_migration(spark, sf):
    """Legacy CSV export -> parquet -> full silver ETL (fintech profile)."""
    raw = cn.raw_government(spark, sf)
    d = io.fresh_dir(spark, "legacy")
    io.write_source(raw, f"{d}/legacy.csv")
    io.write_source(io.read_source(spark, f"{d}/legacy.csv", options=io.CSV_READ_OWN), f"{d}/legacy.parquet")
    migrated = spark.read.parquet(f"{d}/legacy.parquet")
    return _silver(migrated, source_system="legacy_rules_engine")


@query("object_store_roundtrip", oe.silver())
def object_store_roundtrip(spark, sf):
    store = io.ObjectStore(spark, io.fresh_dir(spark, "objects"))
    name = "etl/silver/etl_run_0001_transactions.parquet"
    _load(_export(spark, sf), DEFAULT_RUN_ID, lambda s: store.save_parquet(s, name), last=True)
    if not store.exists(name):
        raise RuntimeError("object not written")
    return store.load_parquet(name)


@query("storage_sync", oc.RAW_GOVERNMENT)
def storage_sync(spark, sf):
    """Copy a dataset in any supported format (here JSON) to an object as parquet."""
    raw = cn.raw_government(spark, sf)
    d = io.fresh_dir(spark, "sync")
    io.write_source(raw, f"{d}/current_transactions.json")
    store = io.ObjectStore(spark, f"{d}/bucket")
    store.save_parquet(io.read_source(spark, f"{d}/current_transactions.json", schema=raw.schema),
                       "data/current_transactions.parquet")
    return store.load_parquet("data/current_transactions.parquet")
