"""Leakage-safe behavioural features (point-in-time, prior rows only).

Semantics (fixed by the reference behaviour):

* a feature of row *r* sees only rows strictly before *r* in ``(timestamp, tx_id)`` order; rows equal in both do not
  see each other;
* a sliding window of length D contains prior rows with ``ts(r) - t <= D``.

There is one formulation (``operators.pieces``): histories are cut into pieces of time, each key needs one exchange,
every aggregate is a running prefix (sliding windows are differences of two prefixes, distinct merchants are counted
by activations) and piece totals carry the rest.  Rows are never joined back by ``tx_id``, so repeated and null ids
stay rows of their own.  Money is summed in cents and coordinates in micro-degrees: sums are exact and independent of
partitioning; amounts count to the cent and coordinates to 1e-6 degrees.
"""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.columns import epoch_micros, haversine_km, r6
from ledgerlens.operators.pieces import (
    PIECE_US, WHOLE, carried, entity, first_of_pair, gather, hot_entities, hot_pairs, hot_totals, order_keys, packed, prior,
    prior_scan, unpacked, window_scan)
from ledgerlens.sources.io import discard, written

# Window names and lengths used by the reference's features.
WINDOWS = {"1h": 3_600_000_000, "24h": 86_400_000_000, "7d": 604_800_000_000}

FEATURE_COLUMNS = [
    "user_txn_count_1h", "user_spend_1h", "new_merchants_1h",
    "user_txn_count_24h", "user_spend_24h", "new_merchants_24h",
    "user_txn_count_7d", "user_spend_7d", "new_merchants_7d",
    "distance_from_user_centroid_km", "seconds_since_last_txn", "user_amount_zscore",
    "devices_per_account", "device_sharing_degree", "merchant_fraud_prevalence",
    "is_new_device_for_user",
]
CODE_COLUMNS = ["channel_code", "mcc_code", "currency_code"]

USER_SUMS = {"n": "_one", "spend": "_cents", "s2": "_s2", "lat": "_lat6", "lon": "_lon6"}


def with_order_keys(df: DataFrame) -> DataFrame:
    """Add ``_ts`` / ``_id`` (order), ``_cents``, its square, micro-degree coordinates and ``_one``."""
    cents = F.round(F.col("amount") * 100).cast("long")
    return df.withColumns({
        **order_keys(epoch_micros("timestamp")),
        "_cents": cents,
        "_s2": cents.cast("decimal(38,0)") * cents,
        "_lat6": F.round(F.col("lat") * 1_000_000).cast("long"),
        "_lon6": F.round(F.col("lon") * 1_000_000).cast("long"),
        "_one": F.lit(1).cast("long"),
    })


def _user_history(k: DataFrame, sums=("n", "spend", "s2", "lat", "lon"), sliding=(), windows=WINDOWS, last=False,
                  distinct: str | None = None) -> DataFrame:
    """The one scan over users: all-time sums, sliding sums, latest prior time, distinct merchants in windows."""
    if distinct:
        # previous time of the same merchant, and one of equal rows to stand for the merchant
        k = prior_scan(k, ["user_id", "merchant_id"], last="_prev_m", once="_once")
    return window_scan(k, "user_id", windows, {f"_u_{n}": USER_SUMS[n] for n in sums}, [f"_u_{n}" for n in sliding],
                       last="_u_last" if last else None, distinct=("_u_dm", "_prev_m") if distinct else None)


def _pairs(k: DataFrame, a: str, b: str, flag: str) -> DataFrame:
    """Rows with ``flag`` 0, and each (a, b) pair once with 1 at its first time: the piece totals of a first-seen flag."""
    first = k.groupBy(a, b).agg(F.min("_ts").alias("_ts")).withColumn(flag, F.lit(1).cast("long"))
    return first.unionByName(k.select(a, b, "_ts", F.lit(0).cast("long").alias(flag)))


def _devices_scan(k: DataFrame, base: DataFrame) -> DataFrame:
    k = prior_scan(k, ["account_id", "device_id"], first="_first_ad", totals_of=base)
    return prior_scan(k, ["account_id"], sums={"_a_devices": "_first_ad"}, totals_of=_pairs(base, "account_id", "device_id", "_first_ad"))


def _sharing_scan(k: DataFrame, base: DataFrame) -> DataFrame:
    k = prior_scan(k, ["user_id", "device_id"], sums={"_ud_n": "_one"}, first="_first_ud", totals_of=base)
    return prior_scan(k, ["device_id"], sums={"_d_users": "_first_ud"}, totals_of=_pairs(base, "user_id", "device_id", "_first_ud"))


def _velocity() -> dict[str, Column]:
    out: dict[str, Column] = {}
    for w in WINDOWS:
        out[f"user_txn_count_{w}"] = F.col(f"_u_n_{w}").cast("double")
        out[f"user_spend_{w}"] = F.col(f"_u_spend_{w}") / 100.0
    return out


def _seen_in_window(length: int) -> Column:
    """1 when the current merchant is among the user's prior rows in the window."""
    return (F.col("_prev_m").isNotNull() & (F.col("_prev_m") >= F.col("_ts") - length)).cast("long")


def _new_merchants() -> dict[str, Column]:
    return {f"new_merchants_{w}": (F.col(f"_u_dm_{w}") - _seen_in_window(d)).cast("double") for w, d in WINDOWS.items()}


def _centroid() -> Column:
    n = F.col("_u_n")
    lat = F.col("_u_lat").cast("double") / n / 1_000_000.0
    lon = F.col("_u_lon").cast("double") / n / 1_000_000.0
    return F.when(n == 0, F.lit(0.0)).otherwise(r6(haversine_km(lat, lon, F.col("lat"), F.col("lon"))))


def _gap() -> Column:
    return F.when(F.col("_u_last").isNull(), F.lit(0.0)).otherwise((F.col("_ts") - F.col("_u_last")) / 1_000_000.0)


def _zscore() -> Column:
    n, s1, s2 = F.col("_u_n"), F.col("_u_spend"), F.col("_u_s2")
    var_c = (n.cast("decimal(38,0)") * s2 - s1.cast("decimal(38,0)") * s1).cast("double") / (n * n).cast("double")
    dev = (F.col("_cents") * n - s1).cast("double") / n
    return F.when(n == 0, F.lit(0.0)).otherwise(r6(F.when(var_c == 0, dev / 100.0).otherwise(dev / F.sqrt(var_c))))


def _prevalence() -> Column:
    return F.when(F.col("_m_n") == 0, F.lit(0.0)).otherwise(r6(F.col("_m_fraud") / F.col("_m_n")))


# ---------------------------------------------------------------- operators

def user_velocity(df: DataFrame) -> DataFrame:
    """Prior count / spend per user in 1h, 24h, 7d."""
    k = _user_history(with_order_keys(df), sums=("n", "spend"), sliding=("n", "spend"))
    return k.select(*df.columns, *[c.alias(n) for n, c in _velocity().items()])


def new_merchants(df: DataFrame) -> DataFrame:
    """Distinct prior merchants of the user in each window, the current one excluded."""
    k = _user_history(with_order_keys(df), sums=("n",), distinct="merchants")
    return k.select(*df.columns, *[c.alias(n) for n, c in _new_merchants().items()])


def merchants_seen(df: DataFrame) -> DataFrame:
    """Variant: distinct prior merchants in 24h / 7d *including* the current one."""
    wins = {w: WINDOWS[w] for w in ("24h", "7d")}
    k = _user_history(with_order_keys(df), sums=("n",), windows=wins, distinct="merchants")
    return k.select(*df.columns, *[(F.col(f"_u_dm_{w}") - _seen_in_window(d) + 1).cast("double").alias(f"merchants_seen_{w}")
                                   for w, d in wins.items()])


def centroid_distance(df: DataFrame) -> DataFrame:
    k = prior_scan(with_order_keys(df), ["user_id"], sums={"_u_n": "_one", "_u_lat": "_lat6", "_u_lon": "_lon6"})
    return k.select(*df.columns, _centroid().alias("distance_from_user_centroid_km"))


def seconds_since_last(df: DataFrame) -> DataFrame:
    k = prior_scan(with_order_keys(df), ["user_id"], last="_u_last")
    return k.select(*df.columns, _gap().alias("seconds_since_last_txn"))


def amount_zscore(df: DataFrame) -> DataFrame:
    k = prior_scan(with_order_keys(df), ["user_id"], sums={"_u_n": "_one", "_u_spend": "_cents", "_u_s2": "_s2"})
    return k.select(*df.columns, _zscore().alias("user_amount_zscore"))


def devices_per_account(df: DataFrame) -> DataFrame:
    base = with_order_keys(df)
    k = _devices_scan(base, base)
    return k.select(*df.columns, F.col("_a_devices").cast("double").alias("devices_per_account"))


def device_sharing(df: DataFrame) -> DataFrame:
    base = with_order_keys(df)
    k = _sharing_scan(base, base)
    return k.select(*df.columns, F.col("_d_users").cast("double").alias("device_sharing_degree"))


def merchant_prevalence(df: DataFrame) -> DataFrame:
    k = prior_scan(with_order_keys(df), ["merchant_id"], sums={"_m_n": "_one", "_m_fraud": "is_fraud"})
    return k.select(*df.columns, _prevalence().alias("merchant_fraud_prevalence"))


def new_device_flag(df: DataFrame) -> DataFrame:
    k = prior_scan(with_order_keys(df), ["user_id", "device_id"], sums={"_ud_n": "_one"})
    return k.select(*df.columns, (F.col("_ud_n") == 0).cast("double").alias("is_new_device_for_user"))


def category_mappings(df: DataFrame, columns: tuple[str, ...] = ("channel", "mcc", "currency")) -> DataFrame:
    """Fit categorical codes: code = order of first appearance in (timestamp, tx_id) order, from 0.

    Returns a long frame ``(column, value, code)``.  One pass over the data: ``min(struct(ts, tx_id))`` per combination of
    values is a partial aggregate, and only combinations are stacked; the rank then runs over distinct values only.
    """
    earliest = F.min(F.struct(F.col("_ts").alias("_t"), "tx_id")).alias("_first")
    combos = (df.select(epoch_micros("timestamp").alias("_ts"), "tx_id", *[F.col(c).cast("string").alias(f"_v_{c}") for c in columns])
              .groupBy(*[f"_v_{c}" for c in columns]).agg(earliest))
    stacked = combos.select("_first", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_v_{c}").alias("value")) for c in columns])))
    return number_first_values(stacked.groupBy("column", "value").agg(F.min("_first").alias("_first")))


def number_first_values(first: DataFrame) -> DataFrame:
    """Codes from (column, value, _first: (_t, tx_id)), in order of first appearance."""
    # ranks by pieces of time: the values first seen in earlier pieces, plus the rank inside the piece
    first = first.withColumn("_p", F.coalesce(F.floor(F.col("_first._t") / PIECE_US), F.lit(-(1 << 40)))).repartition("column", "_p")
    local = first.withColumn("_rank", F.row_number().over(Window.partitionBy("column", "_p").orderBy("_first")) - 1)
    per = first.groupBy("column", "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("column").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    carry = per.select(F.col("column").alias("_c"), F.col("_p").alias("_cp"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    j = local.join(carry, (F.col("column") == F.col("_c")) & (F.col("_p") == F.col("_cp")))
    return j.select("column", "value", (F.col("_before") + F.col("_rank")).cast("int").alias("code"))


CODE_SALTS = 16


def apply_category_codes(df: DataFrame, mappings: DataFrame,
                         columns: tuple[str, ...] = ("channel", "mcc", "currency")) -> DataFrame:
    """Attach a fitted dictionary; unseen values get code 0 (reference behaviour).

    The dictionary table is joined on (value, salt), each entry copied once per salt, so that a frequent category is
    spread over tasks; when the dictionary is measured to be small, AQE broadcasts it instead.
    """
    res = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(CODE_SALTS)).cast("int"))
    for c in columns:
        m = mappings.filter(F.col("column") == c).select(
            F.coalesce(F.concat(F.lit("v"), "value"), F.lit("n")).alias("_v"), F.col("code").alias(f"{c}_code"),
            F.explode(F.sequence(F.lit(0), F.lit(CODE_SALTS - 1))).alias("_s"))
        value = F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))
        res = res.join(m, (value == F.col("_v")) & (F.col("_salt") == F.col("_s")), "left").drop("_v", "_s")
        res = res.withColumn(f"{c}_code", F.coalesce(F.col(f"{c}_code"), F.lit(0)).cast("int"))
    return res.drop("_salt")


def categorical_codes(df: DataFrame) -> DataFrame:
    return apply_category_codes(df, category_mappings(df))


def feature_expressions() -> dict[str, Column]:
    """The feature columns over the results of all scans."""
    return {
        **_velocity(), **_new_merchants(),
        "distance_from_user_centroid_km": _centroid(), "seconds_since_last_txn": _gap(), "user_amount_zscore": _zscore(),
        "devices_per_account": F.col("_a_devices").cast("double"), "device_sharing_degree": F.col("_d_users").cast("double"),
        "merchant_fraud_prevalence": _prevalence(), "is_new_device_for_user": (F.col("_ud_n") == 0).cast("double"),
    }


ENTITIES = ["user_id", "merchant_id", "device_id", "account_id"]
#: Sums that scans of hot entities carry from piece to piece, in the order of ``hot_totals``.
CARRIED = ["_one", "is_fraud", "_cents", "_s2", "_lat6", "_lon6"]


def _prior_merchant(rows: DataFrame, hot: DataFrame, totals: DataFrame) -> DataFrame:
    d = with_order_keys(gather(rows, "merchant_id", epoch_micros("timestamp"), hot))
    d = packed(d, rows.columns, "merchant_id", "_p", "_ts", "_id", "is_fraud")
    d = prior(d, ["merchant_id"], {"_f": F.sum("is_fraud")}, {"_label": F.max("is_fraud")})
    j = carried(d, "merchant_id", totals)
    before = lambda i: F.coalesce(F.col("_c")[i].cast("long"), F.lit(0))
    fraud = F.when(F.col("_label").isNotNull(), F.coalesce("_f", F.lit(0)))  # none for rows without a label
    return j.select(*unpacked(rows.columns), (F.col("_before") + before(0)).alias("_m_n"), (fraud + before(1)).alias("_m_fraud"))


def _prior_others(rows: DataFrame, key: str, other: str, out: str, hot: DataFrame, pairs: DataFrame, known: str | None = None,
                  flag: str | None = None) -> DataFrame:
    """Adds ``out``: how many values of ``other`` the entity had in prior rows; ``known``: 0 on the pair's earliest rows, else 1;
    ``flag``: 1 on one of them, else 0."""
    d = with_order_keys(gather(rows, key, epoch_micros("timestamp"), hot, firsts=(pairs, other)))
    d = packed(d, rows.columns, key, other, "_p", "_e", "_ts", "_id")
    flags = {"_new": first_of_pair(key, other, ties=False).cast("long")}
    if known:
        flags[known] = F.when(first_of_pair(key, other, ties=True), 0).otherwise(1)
    d = prior(d.withColumns(flags).where("_e = 0"), [key], {"_n": F.sum("_new")})
    w = Window.partitionBy("_h").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    per = pairs.groupBy("_h", F.floor(F.col("_t") / PIECE_US).alias("_q")).agg(F.count(F.lit(1)).alias("_k"))
    # every piece of the entity that holds a first time; a later piece takes the latest of these before it
    upto = per.select(F.col("_h").alias("_ch"), F.struct(F.col("_q"), (F.coalesce(F.sum("_k").over(w), F.lit(0)) + F.col("_k")).alias("_n")).alias("_s"))
    lists = upto.groupBy("_ch").agg(F.sort_array(F.collect_list("_s"), asc=False).alias("_cs"))  # a piece an element
    j = d.join(F.broadcast(lists), F.when(F.col("_p") != WHOLE, entity(key)) == F.col("_ch"), "left")
    earlier = F.get(F.filter("_cs", lambda s: s["_q"] < F.col("_p")), F.lit(0))["_n"]
    return j.select(*unpacked(rows.columns), *([known] if known else []), *([F.col("_new").alias(flag)] if flag else []),
                    (F.coalesce("_n", F.lit(0)) + F.coalesce(earlier, F.lit(0))).alias(out))


def _prior_user(rows: DataFrame, hot: DataFrame, totals: DataFrame) -> DataFrame:
    """The scan over users, all in one exchange: sums, sliding sums, distinct merchants.

    Distinct merchants as in ``window_scan``, but a row counts from its own place on where its merchant has not been
    seen within the window; only other rows get an activation of their own, after the exchange.
    """
    d = with_order_keys(gather(rows, "user_id", epoch_micros("timestamp"), hot, max(WINDOWS.values())))
    d = packed(d, rows.columns, "user_id", "merchant_id", "_p", "_e", "_ts", "_id", *USER_SUMS.values())
    d = prior(d, ["user_id", "merchant_id"], {"_prev_m": F.max("_ts")})
    ends = {w: F.col("_prev_m") + length + 1 for w, length in WINDOWS.items()}
    late = {w: F.coalesce(ends[w] > F.col("_ts"), F.lit(False)) for w in WINDOWS}
    place = lambda t, i, w: F.struct(t.alias("_ts"), i.alias("_id"), F.lit(w).alias("_w"))
    marks = [F.when((F.col("_once") == 1) & late[w], place(ends[w], F.lit("0"), w)) for w in WINDOWS]
    d = d.withColumn("_a", F.array_compact(F.array(place(F.col("_ts"), F.col("_id"), ""), *marks)))
    is_row = F.col("_w") == ""
    home = is_row & (F.col("_e") == 0)
    kind = {c: d.schema[c].dataType for c in [*USER_SUMS.values(), "_once"]}
    value = lambda c, when: F.coalesce(F.when(when, F.col(c)), F.lit(0).cast(kind[c]))
    active = lambda w: F.when(is_row, F.when(late[w], 0).otherwise(F.col("_once"))).otherwise((F.col("_w") == w).cast("long"))
    d = d.withColumns({f"_late_{w}": late[w] for w in WINDOWS}).withColumnRenamed("_ts", "_at_ts").drop("_id", "_before", "merchant_id")
    late = {w: F.col(f"_late_{w}") for w in WINDOWS}
    d = d.select("*", F.inline("_a")).select(
        "user_id", "_p", "_ts", "_id", home.alias("_home"), F.when(is_row, F.col("_ts")).alias("_row_ts"),
        *[F.when(home, F.col(c)).alias(c) for c in ("_cents", "_prev_m", "_row")],
        *[value(c, home).alias(f"_h_{n}") for n, c in USER_SUMS.items()],  # rows of the piece itself
        *[value(USER_SUMS[n], is_row).alias(f"_w_{n}") for n in ("n", "spend")],  # and those repeated from the piece before
        value("_once", is_row).alias("_w_once"), *[active(w).alias(f"_act_{w}") for w in WINDOWS])
    older = lambda length: Window.partitionBy("user_id", "_p").orderBy("_ts").rangeBetween(Window.unboundedPreceding, -length - 1)
    sums = [*[f"_h_{n}" for n in USER_SUMS], "_w_n", "_w_spend", *[f"_act_{w}" for w in WINDOWS]]
    d = prior(d, ["user_id"], {**{f"_p_{c}": F.sum(c) for c in sums}, "_last": F.max("_row_ts")})
    # after the scan by place, whose order serves both
    d = d.withColumns({f"_o_{n}_{w}": F.coalesce(F.sum(f"_w_{n}").over(older(length)), F.lit(0)) for w, length in WINDOWS.items() for n in ("n", "spend", "once")})
    j = carried(d.where("_home"), "user_id", totals)
    upto = lambda c: F.coalesce(f"_p_{c}", F.lit(0).cast(d.schema[f"_p_{c}"].dataType))
    before = lambda n: F.coalesce(F.col("_c")[CARRIED.index(USER_SUMS[n])].cast(kind[USER_SUMS[n]]), F.lit(0))
    return j.select(
        *unpacked(rows.columns), "_ts", "_cents", "_prev_m", F.coalesce("_last", F.col("_c")[len(CARRIED)].cast("long")).alias("_u_last"),
        *[(upto(f"_h_{n}") + before(n)).alias(f"_u_{n}") for n in USER_SUMS],
        *[(upto(f"_w_{n}") - F.col(f"_o_{n}_{w}")).alias(f"_u_{n}_{w}") for n in ("n", "spend") for w in WINDOWS],
        *[(upto(f"_act_{w}") - F.col(f"_o_once_{w}")).alias(f"_u_dm_{w}") for w in WINDOWS])


def scanned(df: DataFrame, firsts: bool = False, steps: bool = False) -> DataFrame:
    """``df`` with the results of all scans, as ``feature_expressions`` takes them; ``firsts`` adds the flags of pairs first seen.

    One exchange per entity type, of the frame's own columns and the results so far: merchant, account, device and
    last user, whose scan adds most columns.  Histories stay whole; those of hot entities are cut into pieces.

    ``steps``: every scan but the last is written before the next, so that one exchange is on disk at a time; ``df``
    is not read afterwards.
    """
    if steps:
        return _scanned_in_steps(df, firsts)
    base = with_order_keys(df)
    hot = hot_entities(base, ENTITIES)
    totals = hot_totals(base, ENTITIES, hot, CARRIED)
    pairs = hot_pairs(base, [("device_id", "user_id"), ("account_id", "device_id")], hot)
    k = _prior_merchant(df, hot, totals)
    k = _prior_others(k, "account_id", "device_id", "_a_devices", hot, pairs, flag="_first_ad" if firsts else None)
    k = _prior_others(k, "device_id", "user_id", "_d_users", hot, pairs, known="_ud_n", flag="_first_ud" if firsts else None)
    return _prior_user(k, hot, totals)


def _scanned_in_steps(df: DataFrame, firsts: bool) -> DataFrame:
    base = with_order_keys(df)
    hot = written(hot_entities(base, ENTITIES), "scan-hot")
    totals = written(hot_totals(base, ENTITIES, hot, CARRIED), "scan-totals")
    pairs = written(hot_pairs(base, [("device_id", "user_id"), ("account_id", "device_id")], hot), "scan-pairs")
    k = written(_prior_merchant(df, hot, totals), "scan-merchants")
    for out in (lambda k: _prior_others(k, "account_id", "device_id", "_a_devices", hot, pairs, flag="_first_ad" if firsts else None),
                lambda k: _prior_others(k, "device_id", "user_id", "_d_users", hot, pairs, known="_ud_n", flag="_first_ud" if firsts else None)):
        before, k = k, written(out(k), "scan-others")
        discard(before)
    out = _prior_user(k, hot, totals)
    out._folders = [*k._folders, *hot._folders, *totals._folders]  # see ``discard``
    discard(pairs)
    return out


_STEPS: ContextVar[bool] = ContextVar("steps", default=False)


@contextmanager
def in_steps():
    """``gold_features`` built inside runs its scans one by one (``scanned``): for sinks of large tables, whose disk one plan would fill."""
    token = _STEPS.set(True)
    try:
        yield
    finally:
        _STEPS.reset(token)


#: Columns that scans and codes read.  All others ride along: in steps they are put back by row number afterwards.
SCANNED_COLUMNS = ["tx_id", *ENTITIES, "amount", "timestamp", "lat", "lon", "is_fraud", "channel", "mcc", "currency"]
_BLOCK_BITS = 12  # rows that lie together are put back together


def _riders_back(k: DataFrame, rows: DataFrame, riders: list[str]) -> DataFrame:
    """``k`` with the ``riders`` of ``rows`` by ``_no``, in the order of ``rows``: columns that repeat in neighbouring rows stay small."""
    block, none = F.shiftright("_no", _BLOCK_BITS).alias("_block"), lambda s: F.lit(None).cast(s)
    a = k.select(block, "_no", F.struct(*[c for c in k.columns if c != "_no"]).alias("_k"))
    b = rows.select(block, "_no", F.struct(*[F.col(f"`{c}`") for c in riders]).alias("_r"))
    both = a.withColumn("_r", none(b.schema["_r"].dataType)).unionByName(b.withColumn("_k", none(a.schema["_k"].dataType)))
    both = both.repartition("_block").groupBy("_block", "_no").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("_k", "_r")])
    return both.sortWithinPartitions("_block", "_no").select("_k.*", *[F.col(f"_r.`{c}`").alias(c) for c in riders])


def _gold_in_steps(df: DataFrame, mappings: DataFrame | None) -> DataFrame:
    feats, riders = feature_expressions(), [c for c in df.columns if c not in SCANNED_COLUMNS]
    rows = written(df.withColumn("_no", F.monotonically_increasing_id()) if riders else df, "gold-source")
    codes = written(mappings if mappings is not None else category_mappings(rows), "gold-codes")
    narrow = rows.drop(*riders)
    scans = scanned(narrow, steps=True)
    k = scans.select(*narrow.columns, *[feats[c].alias(c) for c in FEATURE_COLUMNS])
    kept = [*codes._folders, *scans._folders]
    if riders:
        k = written(k, "gold-narrow")
        discard(scans)
        kept = [*codes._folders, *k._folders, *rows._folders]
        k = _riders_back(k, rows, riders).select(*df.columns, *FEATURE_COLUMNS)
    else:
        discard(rows)
    out = apply_category_codes(k, codes)
    out._folders = kept  # see ``discard``
    return out


def gold_features(df: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """All point-in-time features plus category codes (``build_features``), see ``scanned``.

    ``mappings``: a fitted category dictionary; by default one is fitted on ``df``.
    """
    if _STEPS.get():
        return _gold_in_steps(df, mappings)
    k = scanned(df)
    feats = feature_expressions()
    out = k.select(*df.columns, *[feats[c].alias(c) for c in FEATURE_COLUMNS])
    return apply_category_codes(out, mappings if mappings is not None else category_mappings(df))


# Columns never used as model inputs (identifiers, labels, lineage) - fixed values of the reference.
EXCLUDED_FROM_MATRIX = {
    "tx_id", "user_id", "merchant_id", "device_id", "account_id", "currency", "timestamp", "channel", "mcc",
    "is_fraud", "sector", "etl_run_id", "source_system", "ingested_at", "record_hash",
}
# Explicit numeric feature list (decision: ``*_hash`` text columns never leak into the matrix).
FEATURE_MATRIX = ["amount", "lat", "lon", *FEATURE_COLUMNS, *CODE_COLUMNS]


def feature_matrix(df: DataFrame, with_vector: bool = False) -> DataFrame:
    """tx_id, label and the numeric feature columns as doubles (optionally an ML vector)."""
    out = df.select("tx_id", F.col("is_fraud").cast("int").alias("is_fraud"),
                    *[F.col(c).cast("double").alias(c) for c in FEATURE_MATRIX])
    if with_vector:
        from pyspark.ml.feature import VectorAssembler
        out = VectorAssembler(inputCols=FEATURE_MATRIX, outputCol="features").transform(out)
    return out


def channel_one_hot(df: DataFrame) -> DataFrame:
    """Variant encoding: channel_web / channel_mobile / channel_pos as 0/1 ints."""
    return df.withColumns({f"channel_{v}": (F.col("channel") == v).cast("int") for v in ("web", "mobile", "pos")})


def fill_null_features(df: DataFrame, columns: list[str] | None = None, value: float = 0.0) -> DataFrame:
    """Variant: null -> 0.0 on the listed feature columns."""
    return df.na.fill(value, subset=columns or [c for c in FEATURE_COLUMNS if c in df.columns])
