"""ETL hand cases (quality counts, defaults, sector profiles, timestamps)."""

from datetime import datetime

from pyspark.sql import functions as F

from ledgerlens.operators import etl as ops
from ledgerlens.plans.etl import run_etl


def _quality_case(spark):
    rows = [("dup_tx", "b1", "v1", 100.0, "2024-01-01T10:00:00"),
            ("dup_tx", "b1", "v1", 120.0, "2024-01-01T11:00:00"),
            ("bad_tx", "b2", "v2", -5.0, "2024-01-01T12:00:00")]
    return spark.createDataFrame(rows, "transaction_id string, beneficiary_id string, vendor_id string, "
                                       "amount double, event_time string")


def test_quality_counts_include_duplicates_in_invalid(spark):
    res = run_etl(_quality_case(spark), run_id="r1")
    q = res.quality.first()
    assert (q.rows_extracted, q.rows_valid, q.rows_invalid, q.rows_loaded, q.duplicates_removed) == (3, 1, 2, 1, 1)
    silver = res.silver.collect()
    assert len(silver) == 1 and silver[0].amount == 120.0 and silver[0].tx_id == "dup_tx"
    assert res.bronze.count() == 3 and res.gold.count() == 1


def test_sparse_export_gets_every_default(spark):
    df = _quality_case(spark).select("transaction_id", "beneficiary_id", "vendor_id", "amount", "event_time")
    _, silver = ops.prepare_silver(df, "r1", "legacy", "t0")
    row = silver.filter(F.col("tx_id") == "dup_tx").first()
    assert row.device_id == "unknown_device" and row.account_id == "unknown_account"
    assert row.currency == "USD" and row.lat == 0.0 and row.channel == "government_batch"
    assert row.mcc == "public_services" and row.is_fraud == 0 and row.sector == "fintech"


def test_healthcare_profile_masks_and_renames(spark):
    df = spark.createDataFrame([("c1", "p1", "prov1", 50.0, "2024-02-01T00:00:00", "Jane Doe")],
                               "claim_id string, patient_id string, provider_id string, claim_amount double, "
                               "claim_timestamp string, patient_name string")
    out = ops.apply_sector_profile(df, "healthcare").first()
    assert out.tx_id == "c1" and out.patient_name == "[REDACTED]" and out.channel == "claims_portal"


def test_hashes_are_of_the_values_or_of_the_mask(spark):
    """Default: hash first, then mask; the other order hashes the mask of masked columns."""
    import hashlib

    df = spark.createDataFrame([("t1", "u", 1.0, "2024-01-01T00:00:00", "Alice", "T-1")],
                               "transaction_id string, beneficiary_id string, amount double, event_time string, "
                               "full_name string, taxpayer_id string")
    for hash_first, text in ((True, b"Alice"), (False, b"[REDACTED]")):
        _, silver = ops.prepare_silver(df, "r", "s", "t", hash_first=hash_first)
        row = silver.first()
        assert row.full_name_hash == hashlib.sha256(text).hexdigest()
        assert row.taxpayer_id_hash == hashlib.sha256(b"T-1").hexdigest()
        assert "full_name" not in silver.columns and "taxpayer_id" not in silver.columns


def test_pseudonymous_user_from_tax_id(spark):
    df = spark.createDataFrame([(" 123 ",), ("  ",)], "taxpayer_id string")
    out = [r.user_id for r in ops.pseudonymous_user(df).collect()]
    import hashlib
    assert out[0] == "user_" + hashlib.sha256(b"123").hexdigest()[:12] and out[1] is None


def test_coerce_timestamp_zones_and_bad_text(spark):
    df = spark.createDataFrame([("2024-01-01T10:00:00Z",), ("2024-01-01T10:00:00+02:00",), ("2024-01-01 10:00:00",),
                                ("",), ("not-a-date",), (None,)], "t string")
    out = [r.p for r in df.select(ops.coerce_timestamp(F.col("t")).alias("p")).collect()]
    assert out[0] == datetime(2024, 1, 1, 10) and out[1] == datetime(2024, 1, 1, 8)
    assert out[2] == datetime(2024, 1, 1, 10) and out[3:] == [None, None, None]


def test_normalize_aliases_do_not_clobber_existing_targets(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Transaction ID` int, `tx_id` int, `Vendor-ID` int")
    assert ops.normalize_columns(df).columns == ["transaction_id", "tx_id", "merchant_id"]


def test_energy_profile_renames_masks_and_adds(spark):
    df = spark.createDataFrame([("m1", "c1", "u1", "inv1", 12.5, "2024-03-01T00:00:00", "1 Main St")],
                               "meter_id string, customer_id string, utility_id string, invoice_id string, invoice_amount double, "
                               "invoice_timestamp string, service_address string")
    out = ops.apply_sector_profile(df, "energy").first()
    assert (out.device_id, out.user_id, out.merchant_id, out.tx_id) == ("m1", "c1", "u1", "inv1")
    assert out.service_address == "[REDACTED]" and out.channel == "billing_batch" and out.mcc == "utility_billing"
    _, silver = ops.prepare_silver(df, "r", "s", "t", profile="energy")
    row = silver.first()
    assert row.amount == 12.5 and row.currency == "USD"


def test_drifted_runs_keep_their_columns(spark):
    from ledgerlens.sources import io

    base = io.fresh_dir(spark, "drift-test")
    a = spark.createDataFrame([("t1", 1.0, "r1")], "tx_id string, amount double, etl_run_id string")
    b = spark.createDataFrame([("t2", "x", "r2")], "tx_id string, extra string, etl_run_id string")
    io.write_layer(a, base, "silver")
    io.write_layer(b, base, "silver")
    got = spark.read.option("mergeSchema", "true").parquet(f"{base}/silver").orderBy("tx_id").collect()
    assert [(r.tx_id, r.amount, r.extra) for r in got] == [("t1", 1.0, None), ("t2", None, "x")]


def test_lake_views_take_the_latest_run_and_limits_are_told(spark):
    from ledgerlens.plans.lakehouse import build_views, query_lakehouse, truncated
    from ledgerlens.sources import io

    base = io.fresh_dir(spark, "view-test")
    for run, n in (("r1", 3), ("r2", 5)):
        io.write_layer(spark.range(n).withColumn("etl_run_id", F.lit(run)), base, "silver")
    assert build_views(spark, base) == ["etl_silver"]
    assert query_lakehouse(spark, "select * from etl_silver", limit=4).count() == 4
    assert truncated(spark, "select * from etl_silver", 4) and not truncated(spark, "select * from etl_silver", 5)


def test_written_layers_are_compressed(spark, tmp_path):
    """Findings F2, F3, F22, F33: layers of hashes are written small and read back whole."""
    from ledgerlens.sources import io

    df = spark.range(2000, numPartitions=1).selectExpr("sha2(cast(id as string), 256) as h", "'same text in every row' as t", "cast(id as string) as k")
    path = io.write_source(df, f"{tmp_path}/x.parquet")
    parts = [p for p in (tmp_path / "x.parquet").iterdir() if p.name.startswith("part-")]
    assert parts and all(p.name.endswith(".zstd.parquet") for p in parts)
    assert sum(p.stat().st_size for p in parts) < 2000 * 50  # a hash alone has 64 characters
    assert sorted(io.read_source(spark, path).collect()) == sorted(df.collect())


def test_text_sources_are_compressed(spark, tmp_path):
    from ledgerlens.sources import io
    df = spark.createDataFrame([("a", 1.5), ("", None)], "x string, y double")
    for kind in ("csv", "json"):
        path = io.write_source(df, f"{tmp_path}/t.{kind}")
        assert all(f.name.endswith(f".{kind}.gz") for f in (tmp_path / f"t.{kind}").glob("part-*"))
        back = io.read_source(spark, path, schema=df.schema, options=io.CSV_READ_OWN)
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_layers_build_gold_once_with_hashes_as_bytes(spark, monkeypatch):
    import ledgerlens.operators.features as fx
    from ledgerlens.plans import q_etl

    seen, base, build = [], [], fx.gold_features
    monkeypatch.setattr(fx, "gold_features", lambda df: seen.append(dict(df.dtypes)) or build(df))
    fresh = q_etl.io.fresh_dir
    monkeypatch.setattr(q_etl.io, "fresh_dir", lambda s, label: base.append(fresh(s, label)) or base[-1])
    rows = [(f"t{i}", f"u{i % 3}", "m", "d", "a", float(i), f"2024-01-0{1 + i % 5}T00:00:00", f"n{i}", None) for i in range(12)]
    raw = spark.createDataFrame(rows, "transaction_id string, beneficiary_id string, vendor_id string, endpoint_id string, "
                                      "payment_account_id string, amount double, event_time string, full_name string, taxpayer_id string")
    monkeypatch.setattr(q_etl.cn, "raw_government", lambda s, d: raw)
    silver = q_etl.write_layers(spark, "")
    assert [t for c, t in seen[0].items() if c.endswith("_hash")] == ["binary"] * 3 and len(seen) == 1
    hashes = ["tx_id", "full_name_hash", "taxpayer_id_hash", "record_hash"]
    want = sorted(map(str, silver.select(hashes).collect()))
    lake = next(b for b in base if "lake" in b)
    for path in (f"{lake}/gold", f"{lake}/current/features.parquet"):
        assert sorted(map(str, spark.read.parquet(path).select(hashes).collect())) == want
