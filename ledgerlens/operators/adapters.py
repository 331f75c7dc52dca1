"""Public-dataset adapters to the canonical transaction schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Adapter base times and constants used by the reference.
IEEE_BASE = "2017-12-01 00:00:00"
CREDIT_CARD_BASE = "2023-01-01 00:00:00"


def _s(c: str):
    return F.col(c).cast("string")


def adapter_ieee_cis(df: DataFrame, row_key: str = "TransactionID") -> DataFrame:
    """IEEE-CIS style columns -> canonical; ``row_key`` replaces the reference's file row index."""
    secs = F.coalesce(F.col("TransactionDT").try_cast("long"), F.lit(0))
    return df.select(
        _s("TransactionID").alias("tx_id"),
        F.coalesce(_s("card1"), _s(row_key)).alias("user_id"),
        F.coalesce(_s("ProductCD"), F.lit("ieee_product")).alias("merchant_id"),
        F.coalesce(_s("DeviceInfo"), _s("DeviceType"), F.lit("unknown_device")).alias("device_id"),
        F.concat(F.coalesce(_s("card1"), F.lit("card")), F.lit("_"), F.coalesce(_s("card4"), F.lit("na"))).alias("account_id"),
        F.coalesce(F.col("TransactionAmt").try_cast("double"), F.lit(0.0)).alias("amount"),
        F.lit("USD").alias("currency"),
        F.timestamp_add("SECOND", secs, F.lit(IEEE_BASE).cast("timestamp_ntz")).alias("timestamp"),
        F.coalesce(F.col("addr1").try_cast("double"), F.lit(0.0)).alias("lat"),
        F.coalesce(F.col("addr2").try_cast("double"), F.lit(0.0)).alias("lon"),
        F.coalesce(_s("DeviceType"), F.lit("online")).alias("channel"),
        F.coalesce(_s("ProductCD"), F.lit("retail")).alias("mcc"),
        F.coalesce(F.col("isFraud").try_cast("int"), F.lit(0)).alias("is_fraud"),
    )


def adapter_credit_card(df: DataFrame, row_key: str) -> DataFrame:
    """Anonymised credit-card style columns -> canonical; user bucket = round(V1,2)_round(V2,2)."""
    def b(c: str):
        return F.coalesce(F.round(F.col(c).try_cast("double"), 2).cast("decimal(18,2)").cast("string"), F.lit("0"))
    bucket = F.concat(b("V1"), F.lit("_"), b("V2"))
    secs = F.coalesce(F.col("Time").try_cast("long"), F.lit(0))
    return df.select(
        F.concat(F.lit("ccf_"), _s(row_key)).alias("tx_id"),
        F.concat(F.lit("user_"), bucket).alias("user_id"),
        F.lit("credit_card_network").alias("merchant_id"),
        F.lit("card_terminal").alias("device_id"),
        F.concat(F.lit("acct_"), bucket).alias("account_id"),
        F.coalesce(F.col("Amount").try_cast("double"), F.lit(0.0)).alias("amount"),
        F.lit("EUR").alias("currency"),
        F.timestamp_add("SECOND", secs, F.lit(CREDIT_CARD_BASE).cast("timestamp_ntz")).alias("timestamp"),
        F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"),
        F.lit("card_present").alias("channel"), F.lit("consumer_credit").alias("mcc"),
        F.coalesce(F.col("Class").try_cast("int"), F.lit(0)).alias("is_fraud"),
    )
