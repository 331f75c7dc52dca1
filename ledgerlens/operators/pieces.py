"""Point-in-time aggregates over entity histories, cut into pieces of time.

A window over one entity puts all of the entity's rows into one task.  Here a history is cut into pieces
``(key, floor(time / PIECE_US))``: the piece is a function of the row alone, so nothing is sampled or checkpointed
and every branch of the plan sees the same pieces.  Rows are exchanged once on ``(key, piece)``; running aggregates
work inside a piece and a small table of piece totals carries what earlier pieces hold.

"Prior" means strictly earlier in ``(_ts, _id)``.  Rows that agree in both do not see each other, so repeated rows
have defined values and stay separate rows.

Scans of sparse entities would carry as many piece totals as they have rows.  ``hot_entities`` names the entities with
more than ``HOT_ROWS`` rows; ``gather`` cuts only those into pieces and brings every other history together whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE_US = 28 * 86_400_000_000
_UNB = Window.unboundedPreceding
_NO_TIME = -(1 << 60)  # rows without a time come first
HOT_ROWS = 250_000
HOT_BUCKETS = 16_384
WHOLE = -(1 << 50)  # the piece of a history that is not cut


def order_keys(ts: Column, tx: str = "tx_id") -> dict[str, Column]:
    """``_ts`` and ``_id``, both never null."""
    return {"_ts": F.coalesce(ts, F.lit(_NO_TIME)), "_id": F.concat(F.lit("1"), F.coalesce(F.col(tx).cast("string"), F.lit("")))}


def piece(ts: str = "_ts") -> Column:
    return F.floor(F.col(ts) / PIECE_US)


def _tokens(keys: Sequence[str]) -> dict[str, Column]:
    """Join-safe stand-ins for the keys: a null key is an entity of its own."""
    return {f"_k{i}": F.coalesce(F.concat(F.lit("k"), F.col(k).cast("string")), F.lit("n")) for i, k in enumerate(keys)}


def _totals(d: DataFrame, tokens: Sequence[str], sums: dict[str, str]) -> DataFrame:
    return d.groupBy(*tokens, "_p").agg(F.max("_ts").alias("_t_last"), F.count(F.lit(1)).alias("_t_n"),
                                        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])


def piece_totals(df: DataFrame, keys: Sequence[str], sums: dict[str, str] | None = None) -> DataFrame:
    """The totals of every (key, piece) of ``df``, in the form that scans take as ``earlier``."""
    tok = _tokens(keys)
    return _totals(df.withColumns({**tok, "_p": piece()}), list(tok), sums or {})


def _carried(totals: DataFrame, tokens: list[str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """Per (key, piece) the combined totals of earlier pieces; ``aggs``: output -> (sum or max, column)."""
    w = Window.partitionBy(*tokens).orderBy("_p").rowsBetween(_UNB, -1)  # a row a piece
    comb = {"sum": F.sum, "max": F.max}
    return totals.select(*[F.col(t).alias(f"_c_{t[1:]}") for t in tokens], F.col("_p").alias("_c_p"),
                         *[comb[how](c).over(w).alias(n) for n, (how, c) in aggs.items()])


def _join(local: DataFrame, carry: DataFrame, tokens: list[str]) -> DataFrame:
    cond = F.col("_p") == F.col("_c_p")
    for t in tokens:
        cond = cond & (F.col(t) == F.col(f"_c_{t[1:]}"))
    return local.join(carry, cond).drop("_c_p", *[f"_c_{t[1:]}" for t in tokens])


def prior_scan(df: DataFrame, keys: Sequence[str], sums: dict[str, str] | None = None, last: str | None = None,
               first: str | None = None, once: str | None = None, totals_of: DataFrame | None = None,
               earlier: DataFrame | None = None) -> DataFrame:
    """Add per-key aggregates over prior rows.

    ``sums``: output -> column (sum over prior rows, 0 if none); ``last``: time of the latest prior row (null if
    none); ``first``: 1 on exactly one of the key's earliest rows, else 0; ``once``: 1 on exactly one of the key's rows
    that are equal in ``(_ts, _id)``.  ``df`` needs ``_ts`` and ``_id``.

    Piece totals are taken from ``totals_of`` (default: ``df``), which must give the same totals per key and piece.
    In a chain of scans it should be the frame the chain began with: a plan that reads each step twice doubles with
    every step.

    ``earlier``: stored totals of rows that are not in ``df`` and come before all of its pieces, as (the keys' tokens,
    ``_p``, ``_t_last``, ``_t_n`` and ``_t_<output>`` for ``sums``); see ``piece_totals``.
    """
    sums = sums or {}
    tok = _tokens(keys)
    tokens = list(tok)
    d = df.withColumns({**tok, "_p": piece()}).repartition(*tokens, "_p")
    run = Window.partitionBy(*tokens, "_p").orderBy("_ts", "_id").rangeBetween(_UNB, Window.currentRow)
    peers = Window.partitionBy(*tokens, "_p", "_ts", "_id")
    cols: dict[str, Column] = {n: F.sum(c).over(run) - F.sum(c).over(peers) for n, c in sums.items()}
    if last:
        one = F.count(F.lit(1))
        same = Window.partitionBy(*tokens, "_p", "_ts").orderBy("_id").rangeBetween(_UNB, Window.currentRow)
        before = Window.partitionBy(*tokens, "_p").orderBy("_ts").rangeBetween(_UNB, -1)
        cols[last] = F.when(one.over(same) > one.over(peers), F.col("_ts")).otherwise(F.max("_ts").over(before))
    if first:
        cols[first] = F.row_number().over(Window.partitionBy(*tokens, "_p").orderBy("_ts", "_id"))
    if once:
        cols[once] = (F.row_number().over(peers.orderBy("_ts", "_id")) == 1).cast("long")
    local = d.withColumns(cols)
    base = d if totals_of is None else totals_of.withColumns({**tok, "_p": piece()})
    totals = _totals(base, tokens, sums)
    if earlier is not None:
        totals = totals.unionByName(earlier.select(totals.columns))
    carry = _carried(totals, tokens, {**{f"_c_{n}": ("sum", f"_t_{n}") for n in sums}, "_c_last": ("max", "_t_last"),
                                      "_c_n": ("sum", "_t_n")})
    j = _join(local, carry, tokens)
    out: dict[str, Column] = {n: F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.col(n) for n in sums}
    if last:
        out[last] = F.coalesce(F.col(last), F.col("_c_last"))
    if first:
        out[first] = (F.col("_c_n").isNull() & (F.col(first) == 1)).cast("long")
    return j.withColumns(out).drop("_p", "_c_last", "_c_n", *tokens, *[f"_c_{n}" for n in sums])


def window_scan(df: DataFrame, key: str, windows: dict[str, int], sums: dict[str, str], sliding: Sequence[str] = (),
                last: str | None = None, distinct: tuple[str, str] | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """All-time and sliding sums over the prior rows of one key.

    Adds ``<out>`` (sum of a column over all prior rows) for ``sums`` (output -> column), ``<out>_<window>`` (the
    same over prior rows with ``ts - t <= length``) for the outputs in ``sliding``, ``last`` (time of the latest
    prior row), and with ``distinct=(prefix, prev)`` the number of distinct values ``<prefix>_<window>`` among the
    prior rows in the window, where column ``prev`` holds the time of the row's previous occurrence of the same
    value for the key and ``_once`` is 1 on one of equal rows.

    A row counts as the first of its value inside a later row's window exactly when that row is later than
    ``prev + length``.  So each row is activated at the later of its own time and ``prev + length + 1``; activations
    seen, less the rows that lie before the window, are the distinct values.  Every aggregate is a prefix; the end of
    a piece, as long as the longest window, is repeated in the next piece so that a window start lies in reach.

    ``earlier`` as in ``prior_scan``.  Sliding results are then right for rows that lie at least the longest window
    behind the start of the first piece of ``df``: for them every earlier row is activated and before the window, so
    its activation and its own row cancel out.
    """
    reach = max(windows.values())
    tok = _tokens([key])
    payload = df.columns
    values = list(sums)
    marks = [f"_act_{w}" for w in windows] if distinct else []
    events = [F.struct(F.col("_ts").alias("at"), F.col("_id").alias("id"), F.lit("").alias("w"))]
    if distinct:
        prev = F.col(distinct[1])
        late = lambda d: prev + d + 1 > F.col("_ts")
        events += [F.struct(F.when(late(d), prev + d + 1).otherwise(F.col("_ts")).alias("at"),
                            F.when(late(d), "0").otherwise(F.col("_id")).alias("id"), F.lit(w).alias("w"))
                   for w, d in windows.items()]
    is_row = F.col("_e.w") == ""
    num = lambda c: F.when(is_row, F.col(c)).otherwise(F.lit(0).cast(df.schema[c].dataType))
    rows = df.select("*", tok["_k0"].alias("_k0"), F.explode(F.array(*events)).alias("_e"))
    if distinct:
        rows = rows.where(is_row | (F.col("_once") == 1))
    rows = rows.select(
        "_k0", F.col("_e.at").alias("_ts"), F.col("_e.id").alias("_id"), F.when(is_row, F.struct(*payload)).alias("_row"),
        is_row.cast("long").alias("_one"), *[num(sums[n]).alias(f"_v_{n}") for n in values],
        *[(F.col("_e.w") == w).cast("long").alias(f"_act_{w}") for w in (windows if distinct else ())],
        *([num("_once").alias("_once")] if distinct else []))
    home = piece()
    again = F.col("_ts") >= (home + 1) * PIECE_US - reach
    d = rows.withColumn("_home", home).withColumn(
        "_p", F.explode(F.when(again, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home"))))
    d = d.withColumn("_own", F.col("_p") == F.col("_home")).withColumn("_row", F.when(F.col("_own"), F.col("_row")))
    d = d.drop("_home").repartition("_k0", "_p")
    run = Window.partitionBy("_k0", "_p").orderBy("_ts", "_id").rangeBetween(_UNB, Window.currentRow)
    peers = Window.partitionBy("_k0", "_p", "_ts", "_id")
    total = {**{n: f"_v_{n}" for n in values}, "_n": "_one", **{m: m for m in marks}}
    cols = {f"_l_{n}": F.sum(c).over(run) - F.sum(c).over(peers) for n, c in total.items()}
    for w, length in windows.items():
        older = Window.partitionBy("_k0", "_p").orderBy("_ts").rangeBetween(_UNB, -length - 1)
        for n in sliding:
            cols[f"_o_{n}_{w}"] = F.coalesce(F.sum(f"_v_{n}").over(older), F.lit(0))
        if distinct:
            cols[f"_o_once_{w}"] = F.coalesce(F.sum("_once").over(older), F.lit(0))
    if last:
        same = Window.partitionBy("_k0", "_p", "_ts").orderBy("_id").rangeBetween(_UNB, Window.currentRow)
        before = Window.partitionBy("_k0", "_p").orderBy("_ts").rangeBetween(_UNB, -1)
        cols["_l_last"] = F.when(F.sum("_one").over(same) > F.sum("_one").over(peers), F.col("_ts")).otherwise(
            F.max(F.when(F.col("_one") == 1, F.col("_ts"))).over(before))
    local = d.withColumns(cols).where("_own and _row is not null")
    every = {**total, **({"once": "_once"} if distinct else {})}
    totals = d.groupBy("_k0", "_p").agg(
        F.max(F.when(F.col("_own") & (F.col("_one") == 1), F.col("_ts"))).alias("_t_last"),
        *[F.sum(F.when(F.col("_own"), F.col(c))).alias(f"_t_{n}") for n, c in every.items()],
        *[F.sum(F.when(~F.col("_own"), F.col(c))).alias(f"_x_{n}") for n, c in every.items()])
    if earlier is not None:
        zero = F.lit(0).cast("long")
        known = {"_t_last": F.col("_t_last"), "_t__n": F.col("_t_n"), **{f"_t_{n}": F.col(f"_t_{n}") for n in values}}
        totals = totals.unionByName(earlier.select("_k0", "_p", *[known.get(c, zero).alias(c) for c in totals.columns if c not in ("_k0", "_p")]))
    carry = _carried(totals, ["_k0"], {**{f"_c_{n}": ("sum", f"_t_{n}") for n in every}, "_c_last": ("max", "_t_last")})
    repeated = totals.select(F.col("_k0").alias("_c_k0"), F.col("_p").alias("_c_p"), *[f"_x_{n}" for n in every])
    carry = carry.withColumnRenamed("_c_k0", "_q_k0").withColumnRenamed("_c_p", "_q_p").join(
        repeated, (F.col("_q_k0") == F.col("_c_k0")) & (F.col("_q_p") == F.col("_c_p"))).drop("_q_k0", "_q_p")
    # what lies before the repeated end of the previous piece
    carry = carry.select("_c_k0", "_c_p", "_c_last", *[
        (F.coalesce(F.col(f"_c_{n}"), F.lit(0)) - F.coalesce(F.col(f"_x_{n}"), F.lit(0))).alias(f"_c_{n}") for n in every])
    j = _join(local, carry, ["_k0"])
    out = [(F.col(f"_c_{n}") + F.col(f"_l_{n}")).alias(n) for n in values]
    out += [(F.col(f"_l_{n}") - F.col(f"_o_{n}_{w}")).alias(f"{n}_{w}") for n in sliding for w in windows]
    if distinct:
        out += [(F.col(f"_c__act_{w}") + F.col(f"_l__act_{w}") - F.col("_c_once") - F.col(f"_o_once_{w}")).alias(f"{distinct[0]}_{w}")
                for w in windows]
    if last:
        out.append(F.coalesce("_l_last", "_c_last").alias(last))
    return j.select(*[F.col(f"_row.`{c}`").alias(c) for c in payload], *out)


def previous_rows(df: DataFrame, key: str, carry_cols: Sequence[str], k: int, following: bool = False, hot: DataFrame | None = None) -> DataFrame:
    """Add ``_prev``: the ``carry_cols`` of the up to ``k`` prior (or following) rows of the key, nearest first.

    ``df`` needs ``_ts``, and ``_id`` or ``tx_id``.  Histories stay whole, those of ``hot`` entities (``hot_entities`` of
    the key by default) are cut: ``lag`` works inside a piece, and the first ``k`` rows of a piece take the missing ones
    from the last ``k`` rows of the pieces before (at most ``k`` pieces of ``k`` rows).
    """
    hot = hot_entities(df, [key]) if hot is None else hot
    ords = [F.col(c).desc() if following else F.col(c).asc() for c in ("_ts", "_id")]
    p_ord = F.col("_p").desc() if following else F.col("_p").asc()
    d = gather(df, key, F.col("_ts"), hot).drop("_e")
    if "_id" not in df.columns:  # follows from a column that is exchanged anyway
        d = d.withColumns({"_id": order_keys(F.col("_ts"))["_id"]})
    w = Window.partitionBy(key, "_p").orderBy(*ords)
    item = lambda off: F.struct(*[F.lag(c, off).over(w).alias(c) for c in carry_cols])
    local = d.select("*", F.row_number().over(w).alias("_li"), F.array(*[item(o) for o in range(1, k + 1)]).alias("_lags"))
    back = Window.partitionBy(key, "_p").orderBy(*[F.col(c).asc() if following else F.col(c).desc() for c in ("_ts", "_id")])
    # one condition with the row number: it stays above the exchange, which both branches then share
    tails = (d.select(entity(key).alias("_ch"), "_p", F.row_number().over(back).alias("_i"), *carry_cols)
             .where(F.when(F.col("_p") != WHOLE, F.col("_i")) <= k)
             .groupBy("_ch", "_p").agg(F.sort_array(F.collect_list(F.struct("_i", *carry_cols))).alias("_t")))
    wc = Window.partitionBy("_ch").orderBy(p_ord).rowsBetween(-k, -1)
    carry = tails.select("_ch", F.col("_p").alias("_cp"), F.slice(F.flatten(F.reverse(F.collect_list("_t").over(wc))), 1, k).alias("_carry"))
    j = local.join(F.broadcast(carry), (entity(key) == F.col("_ch")) & (F.col("_p") == F.col("_cp")), "left")  # k rows a piece of a hot entity
    inside = F.slice(F.col("_lags"), 1, F.least(F.col("_li") - 1, F.lit(k)).cast("int"))
    earlier = F.transform(F.coalesce(F.col("_carry"), F.array()), lambda x: F.struct(*[x[c].alias(c) for c in carry_cols]))
    return j.withColumn("_prev", F.slice(F.concat(inside, earlier), 1, k)).drop("_ch", "_cp", "_p", "_li", "_lags", "_carry")


# ---------------------------------------------------------------- whole histories, hot ones in pieces

def entity(key: str) -> Column:
    """One text for an entity of any kind: the column's name and the key, a null key being an entity of its own."""
    return F.concat(F.lit(f"{key}="), F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n")))


def hot_entities(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """(_h): the entities of every kind in ``keys`` with more than ``rows`` rows; there are at most rows / ``rows`` a kind.

    Buckets of entities are counted first: only entities of a bucket with so many rows are counted one by one.
    """
    most = HOT_ROWS if rows is None else rows
    bucket = lambda k: F.pmod(F.xxhash64(F.lit(k), F.col(k).cast("string")), F.lit(HOT_BUCKETS)).cast("int")
    full = (df.select(F.explode(F.array(*[bucket(k) for k in keys])).alias("_b"))
            .groupBy("_b").agg(F.count(F.lit(1)).alias("_bn")).where(F.col("_bn") > most).select("_b"))
    each = df.select(F.inline(F.array(*[F.struct(bucket(k).alias("_b"), entity(k).alias("_h")) for k in keys])))
    n = each.join(F.broadcast(full), "_b", "left_semi").groupBy("_h").agg(F.count(F.lit(1)).alias("_hn"))
    return n.where(F.col("_hn") > most).select("_h")


def hot_totals(df: DataFrame, keys: Sequence[str], hot: DataFrame, sums: Sequence[str]) -> DataFrame:
    """(_ch, _cp, _c): per hot entity and piece the sums over its earlier pieces, and last the latest time in them.

    One array, so that all scans of a chain read one and the same table.
    """
    rows = df.select(F.explode(F.array(*[entity(k) for k in keys])).alias("_h"), piece().alias("_cp"), "_ts", *sums).join(F.broadcast(hot), "_h")
    per = rows.groupBy("_h", "_cp").agg(F.max("_ts").alias("_t"), *[F.sum(c).cast("decimal(38,0)").alias(f"_s{i}") for i, c in enumerate(sums)])
    w = Window.partitionBy("_h").orderBy("_cp").rowsBetween(_UNB, -1)  # a row a piece
    carried = [F.coalesce(F.sum(f"_s{i}").over(w), F.lit(0)).cast("decimal(38,0)") for i in range(len(sums))]
    return per.select(F.col("_h").alias("_ch"), "_cp", F.array(*carried, F.max("_t").over(w).cast("decimal(38,0)")).alias("_c"))


def hot_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], hot: DataFrame) -> DataFrame:
    """(_h, _key, _other, _t, _kind): every pair (entity, value of the other column) of hot entities, with its first time."""
    item = lambda a, b: F.struct(entity(a).alias("_h"), F.lit(a).alias("_kind"), F.col(a).cast("string").alias("_key"), F.col(b).cast("string").alias("_other"))
    rows = df.select(F.inline(F.array(*[item(a, b) for a, b in pairs])), "_ts").join(F.broadcast(hot), "_h")
    return rows.groupBy("_h", "_kind", "_key", "_other").agg(F.min("_ts").alias("_t"))  # the kind follows from _h


def gather(df: DataFrame, key: str, ts: Column, hot: DataFrame, reach: int = 0, firsts: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Bring every entity's rows together, hot entities by pieces of time, in one exchange of ``df``'s columns.

    Adds ``_p`` (``WHOLE`` for a history that is not cut) and ``_e``: 0 for rows, 1 for the rows of a hot entity that
    are repeated in its next piece because they lie in its last ``reach``, 2 for marks of ``firsts=(hot_pairs, other
    column)`` that stand in the piece where the pair was first seen.
    """
    at = F.coalesce(ts, F.lit(_NO_TIME))
    home = F.when(F.col("_h").isNotNull(), F.floor(at / PIECE_US)).otherwise(F.lit(WHOLE))
    place = lambda p, e: F.struct(p.alias("_p"), F.lit(e).alias("_e"))
    d = df.join(F.broadcast(hot), entity(key) == F.col("_h"), "left")
    if reach:
        again = F.col("_h").isNotNull() & (at >= (F.floor(at / PIECE_US) + 1) * PIECE_US - reach)
        places = F.when(again, F.array(place(home, 0), place(home + 1, 1))).otherwise(F.array(place(home, 0)))
        d = d.select(*df.columns, F.inline(places))
    else:
        d = d.select(*df.columns, home.alias("_p"), F.lit(0).alias("_e"))
    if firsts:
        marks, other = firsts
        kind = {c: df.schema[c].dataType for c in (key, other)}
        marks = marks.where(F.col("_kind") == key).select(
            F.col("_key").cast(kind[key]).alias(key), F.col("_other").cast(kind[other]).alias(other),
            F.floor(F.col("_t") / PIECE_US).alias("_p"), F.lit(2).alias("_e"))
        d = d.unionByName(marks, allowMissingColumns=True)
    return d.repartition(key, "_p")


def carried(df: DataFrame, key: str, totals: DataFrame) -> DataFrame:
    """Add ``_c`` of ``hot_totals`` to gathered rows: null for whole histories."""
    cut = F.when(F.col("_p") != WHOLE, entity(key))
    return df.join(F.broadcast(totals), (cut == F.col("_ch")) & (F.col("_p") == F.col("_cp")), "left").drop("_ch", "_cp")


def packed(df: DataFrame, payload: Sequence[str], *needed: str) -> DataFrame:
    """The ``payload`` as one column ``_row`` beside what a scan works on: sorts and windows copy it as one value."""
    return df.select(*dict.fromkeys(needed), F.struct(*[F.col(f"`{c}`") for c in payload]).alias("_row"))


def unpacked(payload: Sequence[str]) -> list[Column]:
    return [F.col(f"_row.`{c}`").alias(c) for c in payload]


def prior(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column], peers: dict[str, Column] | None = None) -> DataFrame:
    """Add ``_before``, the number of prior rows with the same ``keys`` in the piece, and per output of ``aggs`` an aggregate
    of them (null if there is none).  ``peers``: aggregates of the rows equal to a row, itself included.

    Aggregates run by place, one window for all; rows equal in (_ts, _id) do not see each other, so each takes those of the
    first of them.  ``_once`` is 1 on that first row.
    """
    by = Window.partitionBy(*keys, "_p").orderBy("_ts", "_id")
    d = df.withColumns({"_at": F.row_number().over(by), **{n: c.over(by.rowsBetween(_UNB, -1)) for n, c in aggs.items()}})
    equal = Window.partitionBy(*keys, "_p", "_ts", "_id")
    d = d.withColumns({"_first": F.min(F.struct("_at", *aggs)).over(equal), **{n: c.over(equal) for n, c in (peers or {}).items()}})
    return d.withColumns({"_before": (F.col("_first._at") - 1).cast("long"), "_once": (F.col("_at") == F.col("_first._at")).cast("long"), **{n: F.col(f"_first.{n}") for n in aggs}}).drop("_first", "_at")


def first_of_pair(key: str, other: str, ties: bool) -> Column:
    """Whether a row is the pair's earliest (one of them, or with ``ties`` all that are equal in (_ts, _id))."""
    w = Window.partitionBy(key, "_p", other).orderBy("_e", "_ts", "_id")
    here = F.max("_e").over(w.rowsBetween(_UNB, Window.unboundedFollowing)) == 2
    return (F.col("_e") == 0) & ((F.rank() if ties else F.row_number()).over(w) == 1) & ((F.col("_p") == WHOLE) | here)
