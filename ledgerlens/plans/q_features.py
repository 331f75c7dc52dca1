"""Feature queries (window functions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import features as fx
from ledgerlens.operators.feature_state import FeatureState
from ledgerlens.oracle import canonical as oc
from ledgerlens.oracle import features as of
from ledgerlens.plans.registry import query
from ledgerlens.sources.io import discard, fresh_dir, written
from ledgerlens.sources.canonical import tx_events, tx_lineitem, tx_lineitem_raw

EV, LI = oc.TX_EVENTS, oc.TX_LINEITEM


def _cols(prefix: str, names=("1h", "24h", "7d")) -> list[str]:
    return [f"{prefix}_{n}" for n in names]


@query("user_velocity", of.feature_query(EV, [c for n in ("1h", "24h", "7d") for c in (f"user_txn_count_{n}", f"user_spend_{n}")], "uh"))
def user_velocity(spark, sf):
    return fx.user_velocity(tx_events(spark, sf))


@query("user_velocity_ties", of.feature_query(LI, [c for n in ("1h", "24h", "7d") for c in (f"user_txn_count_{n}", f"user_spend_{n}")], "uh"))
def user_velocity_ties(spark, sf):
    """Same operator on day-granular lineitem times (many same-instant ties)."""
    return fx.user_velocity(tx_lineitem(spark, sf))


@query("new_merchants", of.feature_query(EV, _cols("new_merchants"), "uh"))
def new_merchants(spark, sf):
    return fx.new_merchants(tx_events(spark, sf))


@query("merchants_seen", of.feature_query(EV, _cols("merchants_seen", ("24h", "7d")), "uh"))
def merchants_seen(spark, sf):
    return fx.merchants_seen(tx_events(spark, sf))


@query("centroid_distance", of.feature_query(EV, ["distance_from_user_centroid_km"], "uh"))
def centroid_distance(spark, sf):
    return fx.centroid_distance(tx_events(spark, sf))


@query("seconds_since_last", of.feature_query(EV, ["seconds_since_last_txn"], "uh"))
def seconds_since_last(spark, sf):
    return fx.seconds_since_last(tx_events(spark, sf))


@query("amount_zscore", of.feature_query(EV, ["user_amount_zscore"], "uh"))
def amount_zscore(spark, sf):
    return fx.amount_zscore(tx_events(spark, sf))


@query("devices_per_account", of.feature_query(LI, ["devices_per_account"], "eh"))
def devices_per_account(spark, sf):
    return fx.devices_per_account(tx_lineitem(spark, sf))


@query("device_sharing", of.feature_query(EV, ["device_sharing_degree"], "eh"))
def device_sharing(spark, sf):
    return fx.device_sharing(tx_events(spark, sf))


@query("merchant_prevalence", of.feature_query(EV, ["merchant_fraud_prevalence"], "eh"))
def merchant_prevalence(spark, sf):
    return fx.merchant_prevalence(tx_events(spark, sf))


@query("new_device_flag", of.feature_query(LI, ["is_new_device_for_user"], "eh"))
def new_device_flag(spark, sf):
    return fx.new_device_flag(tx_lineitem(spark, sf))


@query("categorical_codes", of.categorical_codes(EV))
def categorical_codes(spark, sf):
    return fx.categorical_codes(tx_events(spark, sf))


@query("gold_features", of.gold_features(LI))
def gold_features(spark, sf):
    with fx.in_steps():
        return fx.gold_features(tx_lineitem(spark, sf))


@query("gold_features_events", of.gold_features(EV))
def gold_features_events(spark, sf):
    return fx.gold_features(tx_events(spark, sf))


@query("gold_features_skewproof", of.gold_features(LI))
def gold_features_skewproof(spark, sf):
    """The gold features under their earlier second name: there is one, skew-proof, formulation."""
    with fx.in_steps():
        return fx.gold_features(tx_lineitem(spark, sf))


@query("gold_features_skewproof_events", of.gold_features(EV))
def gold_features_skewproof_events(spark, sf):
    return fx.gold_features(tx_events(spark, sf))


@query("gold_features_repeated_ids", of.gold_features_raw(oc.TX_LINEITEM_RAW))
def gold_features_repeated_ids(spark, sf):
    """The features of the lineitem frame before de-duplication: repeated ids stay rows of their own."""
    df = tx_lineitem_raw(spark, sf)
    with fx.in_steps():
        return fx.gold_features(df).select("tx_id", "user_id", "merchant_id", "amount", "timestamp", *fx.FEATURE_COLUMNS)


def appended(spark, df, days: int):
    """A feature store that got all but the last ``days`` days first, then day after day."""
    df = written(df, "state-source")
    last = df.agg(F.max(F.col("timestamp").cast("date")).alias("d")).first()["d"]
    back = F.date_diff(F.lit(last), F.col("timestamp").cast("date"))
    state = FeatureState(spark, fresh_dir(spark, "feature-state"))
    state.append(0, df.where(back >= days))
    for k in range(days):
        state.append(k + 1, df.where(back == days - 1 - k))
    discard(df)
    return state


@query("gold_features_appended", of.gold_features(LI))
def gold_features_appended(spark, sf):
    """The gold features from a stored state: history first, then the last two days as appended batches."""
    return appended(spark, tx_lineitem(spark, sf), 2).features()


@query("gold_features_appended_events", of.gold_features(EV))
def gold_features_appended_events(spark, sf):
    return appended(spark, tx_events(spark, sf), 2).features()
