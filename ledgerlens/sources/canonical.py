"""Canonical transaction frames derived from the driver tables.

The driver ships no fraud data, so the canonical frames are derived with
integer arithmetic that DuckDB reproduces exactly (see ``oracle.canonical``).
The derivation rules are fixed values of this project, not of the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.columns import money_text, ts_text
from ledgerlens.sources.tables import table

CANONICAL_COLUMNS = [
    "tx_id", "user_id", "merchant_id", "device_id", "account_id", "amount", "currency",
    "timestamp", "lat", "lon", "channel", "mcc", "is_fraud",
]


def _txt(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def tx_events(spark: SparkSession, sf_dir: str, extra: list[Column] | None = None) -> DataFrame:
    """``events`` as transactions: exact microsecond times, unique ids."""
    ev = table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    return ev.select(
        F.concat(F.lit("ev_"), _txt(eid)).alias("tx_id"),
        F.concat(F.lit("user_"), _txt(uid)).alias("user_id"),
        F.concat(F.lit("m_"), _txt(eid * 7 % 40)).alias("merchant_id"),
        F.concat(F.lit("d_"), F.get_json_object("props", "$.k")).alias("device_id"),
        F.concat(F.lit("acct_"), _txt(uid % 60)).alias("account_id"),
        F.col("value").cast("double").alias("amount"),
        F.lit("USD").alias("currency"),
        F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        (F.lit(25.0) + (uid * 37 % 2300).cast("double") / 100.0 + (eid % 7).cast("double") / 10.0).alias("lat"),
        (F.lit(-120.0) + (uid * 53 % 4800).cast("double") / 100.0 + (eid % 5).cast("double") / 10.0).alias("lon"),
        F.when(F.col("event_type").isin("click", "view"), "web")
        .when(F.col("event_type") == "signup", "mobile").otherwise("pos").alias("channel"),
        F.col("event_type").alias("mcc"),
        (((F.col("value") > 150) & (eid % 3 == 0)) | (eid % 41 == 0)).cast("int").alias("is_fraud"),
        *(extra or []),
    )


def _order_lines(li: DataFrame, od: DataFrame, cu: DataFrame) -> DataFrame:
    """Lines with their order and its customer.  Orders meet customers first, so that the lines are exchanged once."""
    return li.join(od.join(cu, od.o_custkey == cu.c_custkey), li.l_orderkey == od.o_orderkey)


def tx_lineitem_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined to its order and customer; ``tx_id`` is NOT unique here.

    Keeps ``part_key``/``supp_key``/``qty`` for deterministic de-duplication.
    Both joins are equi-joins on the keys; AQE picks broadcast only once it has
    measured the build side, otherwise sort-merge.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_shipdate")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = _order_lines(li, od, cu)
    ck = F.col("o_custkey")
    return j.select(
        F.concat(_txt("l_orderkey"), F.lit("-"), _txt("l_linenumber")).alias("tx_id"),
        F.concat(F.lit("cust_"), _txt(ck)).alias("user_id"),
        F.concat(F.lit("supp_"), _txt("l_suppkey")).alias("merchant_id"),
        F.concat(F.lit("part_"), _txt(F.col("l_partkey") % 500)).alias("device_id"),
        F.concat(F.lit("acct_"), _txt(ck % 300)).alias("account_id"),
        F.col("l_extendedprice").cast("double").alias("amount"),
        F.lit("USD").alias("currency"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("timestamp"),
        (F.lit(-60.0) + (ck * 37 % 12000).cast("double") / 100.0).alias("lat"),
        (F.lit(-170.0) + (F.col("l_suppkey") * 53 % 34000).cast("double") / 100.0).alias("lon"),
        F.col("o_orderpriority").alias("channel"),
        F.col("c_mktsegment").alias("mcc"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 4 == 0)).cast("int").alias("is_fraud"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        F.col("l_quantity").alias("qty"),
    )


# Tie-break for "latest per tx_id" on the lineitem frame: timestamp, then
# amount, part, supplier, quantity, all descending.
LINEITEM_DEDUP_ORDER = ["timestamp", "amount", "part_key", "supp_key", "qty"]


def tx_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical lineitem transactions, one row per ``tx_id`` (latest wins)."""
    from ledgerlens.operators.cleansing import dedup_latest

    raw = tx_lineitem_raw(spark, sf_dir)
    return dedup_latest(raw, "tx_id", LINEITEM_DEDUP_ORDER).select(*CANONICAL_COLUMNS)


def raw_government(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A messy government-style export derived from lineitem/orders/customer.

    Alias headers (some with spaces / capitals), PII columns, blank and null
    ids, negative and non-numeric amounts, ISO times with and without a zone,
    blank and unparseable times - all injected by modulus on the keys.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_returnflag", "l_shipdate")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    j = _order_lines(li, od, cu)
    ok, ln, ck = F.col("l_orderkey"), F.col("l_linenumber"), F.col("o_custkey")
    price = F.col("l_extendedprice")
    amount_text = (F.when(ok % 61 == 0, F.lit("n/a"))
                   .when(ok % 53 == 0, money_text(-price))
                   .otherwise(money_text(price)))
    base_time = ts_text(F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(hours=ln), sep="T", micros=False)
    event_time = (F.when(ok % 71 == 0, F.lit(""))
                  .when(ok % 73 == 0, F.lit("not-a-date"))
                  .when(ok % 5 == 0, F.concat(base_time, F.lit("Z")))
                  .when(ok % 7 == 0, F.concat(base_time, F.lit("+02:00")))
                  .otherwise(base_time))
    return j.select(
        F.concat(_txt(ok), F.lit("-"), _txt(ln)).alias("Transaction ID"),
        F.when(ok % 89 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("cust_"), _txt(ck))).alias("Beneficiary-ID"),
        F.concat(F.lit("supp_"), _txt("l_suppkey")).alias("vendor_id"),
        F.concat(F.lit("acct_"), _txt(ck % 300)).alias("payment_account_id"),
        F.when(ok % 67 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("part_"), _txt(F.col("l_partkey") % 500))).alias("endpoint_id"),
        amount_text.alias("amount"),
        F.when(F.col("l_suppkey") % 10 == 0, "EUR").otherwise("USD").alias("currency"),
        event_time.alias("event_time"),
        F.when(ok % 83 == 0, F.lit(None).cast("double"))
        .otherwise(F.lit(-60.0) + (ck * 37 % 12000).cast("double") / 100.0).alias("latitude"),
        (F.lit(-170.0) + (F.col("l_suppkey") * 53 % 34000).cast("double") / 100.0).alias("longitude"),
        F.col("o_orderpriority").alias("source_channel"),
        F.col("c_mktsegment").alias("merchant_category"),
        F.col("c_name").alias("full_name"),
        F.concat(F.lower(F.col("c_name")), F.lit("@example.org")).alias("email_address"),
        F.when(ok % 97 == 0, F.lit("  ")).otherwise(F.concat(F.lit("TX"), F.lpad(_txt(ck), 9, "0"))).alias("taxpayer_id"),
        ((F.col("l_returnflag") == "R") & (ln % 4 == 0)).cast("int").alias("is_fraud"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with a closed-form fraud probability (no trained model).

    ``raw_score`` is a logistic of amount and id flags rounded to 6 decimals,
    so every metric / conformal / fairness operator stays SQL-checkable.  It is
    computed in the same projection as the canonical columns (one scan, no join).
    """
    eid = F.col("event_id")
    logit = (F.lit(-5.0) + F.least(F.col("value"), F.lit(400.0)) * 0.025
             + (eid % 3 == 0).cast("double") * 1.2 + ((eid * 13) % 7 == 0).cast("double") * 0.8
             + (eid % 41 == 0).cast("double") * 2.5)
    return tx_events(spark, sf_dir, extra=[F.round(1.0 / (1.0 + F.exp(-logit)), 6).alias("raw_score")])


def scored_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with a score that is no multiple of 1e-6, from plain IEEE arithmetic only."""
    score = F.col("value") / (F.col("value") + F.lit(37.3)) * F.lit(0.9) + (F.col("event_id") % 1000).cast("double") / F.lit(10000000.0)
    return tx_events(spark, sf_dir, extra=[score.alias("raw_score")])


def healthcare_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A healthcare-sector export (claim headers) derived from lineitem/orders/customer."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    j = _order_lines(li, od, cu)
    return j.select(
        F.concat(F.lit("clm_"), _txt("l_orderkey"), F.lit("-"), _txt("l_linenumber")).alias("claim_id"),
        F.concat(F.lit("pat_"), _txt("o_custkey")).alias("patient_id"),
        F.concat(F.lit("prov_"), _txt("l_suppkey")).alias("provider_id"),
        F.col("l_extendedprice").alias("claim_amount"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("claim_timestamp"),
        F.col("c_name").alias("patient_name"),
    )


def ieee_cis_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IEEE-CIS style raw columns derived from lineitem/orders/customer."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    j = _order_lines(li, od, cu)
    secs = F.timestamp_diff("SECOND", F.lit("1995-01-01 00:00:00").cast("timestamp_ntz"),
                            F.col("l_shipdate").cast("timestamp_ntz")) + F.col("l_linenumber") * 60
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("TransactionID"),
        secs.alias("TransactionDT"),
        F.col("l_extendedprice").alias("TransactionAmt"),
        F.col("l_returnflag").alias("ProductCD"),
        F.when(F.col("o_custkey") % 50 == 0, F.lit(None).cast("long")).otherwise(F.col("o_custkey")).alias("card1"),
        F.col("c_mktsegment").alias("card4"),
        F.col("c_nationkey").alias("addr1"),
        (F.col("l_suppkey") % 100).alias("addr2"),
        F.when(F.col("l_linenumber") % 2 == 0, "desktop").otherwise("mobile").alias("DeviceType"),
        F.when(F.col("l_partkey") % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("dev_"), _txt(F.col("l_partkey") % 50))).alias("DeviceInfo"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 4 == 0)).cast("int").alias("isFraud"),
    )


def credit_card_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anonymised credit-card style columns derived from events (``event_id`` is the row key)."""
    ev = table(spark, sf_dir, "events")
    secs = F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return ev.select(
        F.col("event_id"),
        secs.alias("Time"),
        ((F.col("value") - 100.0) / 37.0).alias("V1"),
        ((F.col("user_id") % 13 - 6).cast("double") / 3.0).alias("V2"),
        F.col("value").alias("Amount"),
        (((F.col("value") > 150) & (F.col("event_id") % 3 == 0)) | (F.col("event_id") % 41 == 0)).cast("int").alias("Class"),
    )


# Fixed values of this project: three closed-form "models" over the events
# table, used wherever several scored runs are compared.
def scored_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long frame (model, tx_id, timestamp, channel, is_fraud, score): three score columns stacked."""
    s = scored(spark, sf_dir)
    amount_rank = F.round(F.least(F.col("amount"), F.lit(400.0)) / 400.0, 6)
    blend = F.round((F.col("raw_score") + amount_rank) / 2.0, 6)
    return s.select(
        "tx_id", "timestamp", "channel", "mcc", "is_fraud",
        F.inline(F.array(
            F.struct(F.lit("logit").alias("model"), F.col("raw_score").alias("score")),
            F.struct(F.lit("amount_rank").alias("model"), amount_rank.alias("score")),
            F.struct(F.lit("blend").alias("model"), blend.alias("score")))))
