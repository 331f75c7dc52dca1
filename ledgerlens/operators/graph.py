"""Transaction graphs as edge DataFrames, and graph aggregations as joins.

Edges are never produced by self-joining an entity group (a hot merchant
would explode quadratically).  Links to the previous / next k transactions of
the same entity come from ``pieces.previous_rows``, which cuts a hot entity's
history into pieces of time, so the edge count is at most ``2 * k`` per
transaction and entity type and no entity fills a task.
Neighbour aggregation works in cells of edges: each node's features go once to
every cell that holds an edge of it, and leave it as one partial result a
destination.  Links of one entity and piece of time share a cell (``place``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.columns import epoch_micros
from ledgerlens.operators.pieces import entity, hot_entities, order_keys, piece, previous_rows
from ledgerlens.sources.io import discard, written

# Entity types linked in the transaction graph.
ENTITY_KEYS = [("user", "user_id"), ("merchant", "merchant_id"), ("device", "device_id"), ("account", "account_id")]
DAY_US = 86_400_000_000


def _keyed(df: DataFrame) -> DataFrame:
    """The columns that links need, written once: every entity type and the count of hot entities read them."""
    return written(df.select("tx_id", "user_id", "merchant_id", "device_id", "account_id", order_keys(epoch_micros("timestamp"))["_ts"].alias("_ts")), "links")


def _links(k: DataFrame, etype: str, col: str, n: int, max_gap_us: int | None, following: bool, places: bool, hot: DataFrame) -> DataFrame:
    """Both-direction edges between each tx and its up to ``n`` prior (or following) tx of the entity."""
    p = previous_rows(k.select("tx_id", col, "_ts"), col, ["tx_id", "_ts"], n, following, hot)

    def keep(x: Column) -> Column:
        ok = x["tx_id"].isNotNull()
        if max_gap_us is not None:
            ok = ok & (F.abs(F.col("_ts") - x["_ts"]) <= max_gap_us)
        return ok

    def both(x: Column) -> Column:
        return F.array(F.struct(x["tx_id"].alias("src"), F.col("tx_id").alias("dst")),
                       F.struct(F.col("tx_id").alias("src"), x["tx_id"].alias("dst")))

    pairs = F.flatten(F.transform(F.filter("_prev", keep), both))
    place = [F.xxhash64(entity(col), piece()).alias("place")] if places else []
    return p.where("tx_id is not null").select(F.inline(pairs), *place).withColumn("edge_type", F.lit(etype))


def _all_links(df: DataFrame, n: int, gap: int | None, following: bool, places: bool = False) -> DataFrame:
    k = _keyed(df)
    hot = written(hot_entities(k, [col for _, col in ENTITY_KEYS]), "hot")
    out = None
    for etype, col in ENTITY_KEYS:
        e = _links(k, etype, col, n, gap, following, places, hot)
        out = e if out is None else out.unionByName(e)
    return out


def prior_link_edges(df: DataFrame, window_days: int | None = 30, max_links: int = 5, places: bool = False) -> DataFrame:
    """Each tx linked to the last ``max_links`` earlier tx of the same user / merchant / device /
    account, kept only if within ``window_days`` (lookback first, then the time filter).

    ``places`` adds ``place``, equal for the links of one entity and piece of time: neighbour aggregation takes these together."""
    return _all_links(df, max_links, window_days * DAY_US if window_days is not None else None, False, places)


def shared_entity_projection(df: DataFrame, next_k: int = 4) -> DataFrame:
    """Variant projection: each tx linked to the next ``next_k`` tx sharing an entity, both directions."""
    return _all_links(df, next_k, None, True)


def distinct_pairs(df: DataFrame) -> DataFrame:
    """Distinct user-device, user-merchant and account-device pairs, in one pass."""
    pairs = [("user_device", "user_id", "device_id"), ("user_merchant", "user_id", "merchant_id"),
             ("account_device", "account_id", "device_id")]
    return df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("pair_type"), F.col(a).alias("a"), F.col(b).alias("b"))
                                        for n, a, b in pairs]))).distinct()


def hetero_nodes(df: DataFrame) -> DataFrame:
    """Distinct nodes per type with the number of transactions touching each, in one pass."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(e).alias("node_type"), F.col(c).alias("node_id"))
                                        for e, c in [("transaction", "tx_id"), *ENTITY_KEYS]]))).groupBy(
        "node_type", "node_id").agg(F.count(F.lit(1)).alias("n_tx"))


# Typed relations of the heterogeneous graph.
TX_RELATIONS = [("user", "user_id", "initiates", "transaction", "tx_id", True),
                ("transaction", "tx_id", "at", "merchant", "merchant_id", False),
                ("transaction", "tx_id", "via", "device", "device_id", False),
                ("transaction", "tx_id", "from", "account", "account_id", False)]
PAIR_RELATIONS = [("user", "user_id", "uses", "device", "device_id"),
                  ("user", "user_id", "shops_at", "merchant", "merchant_id"),
                  ("account", "account_id", "linked", "device", "device_id")]


def _edge(st: str, sc: str, rel: str, dt: str, dc: str) -> Column:
    return F.struct(F.lit(st).alias("src_type"), F.col(sc).alias("src"), F.lit(rel).alias("rel"),
                    F.lit(dt).alias("dst_type"), F.col(dc).alias("dst"))


def hetero_edges(df: DataFrame) -> DataFrame:
    """Four per-transaction relations plus three de-duplicated entity relations."""
    tx = df.select(F.inline(F.array(*[_edge(*r[:5]) for r in TX_RELATIONS])))
    pairs = df.select(F.inline(F.array(*[_edge(*r) for r in PAIR_RELATIONS]))).distinct()
    return tx.unionByName(pairs)


def degree_features(edges: DataFrame) -> DataFrame:
    """In / out degree of every node of the typed graph, in one pass over the edges."""
    ends = F.array(F.struct(F.col("src_type").alias("node_type"), F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                   F.struct(F.col("dst_type").alias("node_type"), F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return edges.select(F.inline(ends)).groupBy("node_type", "node_id").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


CELL_EDGES = 200_000
_BLOCK = 1_000_000  # neighbours looked up at once in a cell


def _cell_triangles(key: tuple[pa.Scalar, ...], cell: pa.Table) -> pa.Table:
    """Triangles per node of one cell's edges whose corners have the cell's three colours, by neighbour intersection."""
    ends = pa.chunked_array([*cell["a"].chunks, *cell["b"].chunks]).combine_chunks().dictionary_encode()
    n, m = len(ends.dictionary), cell.num_rows
    node = ends.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    colour = np.zeros(n, np.int64)
    colour[node[:m]], colour[node[m:]] = cell["ca"].to_numpy(), cell["cb"].to_numpy()
    rank = np.empty(n, np.int64)
    rank[np.argsort(np.bincount(node, minlength=n), kind="stable")] = np.arange(n)
    # every edge leads to its end of higher degree, so no node has more than about sqrt(2 * edges) ways out
    u, v = np.minimum(rank[node[:m]], rank[node[m:]]), np.maximum(rank[node[:m]], rank[node[m:]])
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    edge = u * n + v
    out = np.searchsorted(u, np.arange(n + 1))
    ways = out[v + 1] - out[v]
    held = np.empty(n, np.int64)
    held[rank] = colour
    want = np.sort([k.as_py() for k in key])
    found = np.zeros(n, np.int64)
    total = np.cumsum(ways)
    at = 0
    while at < m:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _BLOCK, side="right")))
        w = ways[at:to]
        first = np.repeat(np.arange(at, to), w)
        third = v[np.repeat(out[v[at:to]] - (np.cumsum(w) - w), w) + np.arange(w.sum())] if w.sum() else np.empty(0, np.int64)
        look = u[first] * n + third
        pos = np.minimum(np.searchsorted(edge, look), m - 1)
        hit = edge[pos] == look
        corners = np.stack([u[first[hit]], v[first[hit]], third[hit]], axis=1)
        own = (np.sort(held[corners], axis=1) == want).all(1)
        found += np.bincount(corners[own].ravel(), minlength=n)
        at = to
    mine = np.flatnonzero(found[rank])
    return pa.table({"node_id": ends.dictionary.take(pa.array(mine)), "n": found[rank][mine]})


HUB_DEGREE = 64
ROUNDS = 4  # large joins run in so many rounds, each written before the next, so that a part of the rows is exchanged at a time


def _listed_triangles(e: DataFrame, between: DataFrame, rounds: int = 1) -> DataFrame:
    """(node_id, n): triangles whose lowest corner is no hub, found from that corner's list of higher neighbours.

    ``e`` (a, b, hub): the edges of such corners, ``hub`` telling whether b is one; ``between`` (a, b): edges of two hubs.
    At each entry the rest of the list meets the entry's own list, or, at hubs, the edges between hubs.  A round takes the
    entries of a part of the nodes b.
    """
    out = written(e.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("hub", "b"))).alias("_out")), "triangle-lists")
    every = out.where(F.size("_out") > 1).select("a", "_out", F.posexplode("_out").alias("_i", "_e")).where(F.col("_i") + 1 < F.size("_out"))
    corner = lambda c, n: F.struct(c.alias("node_id"), n.cast("long").alias("n"))
    two = F.array(corner(F.col("a"), F.size("_third")), corner(F.col("b"), F.size("_third")))
    three = F.array(*[corner(F.col(c), F.lit(1)) for c in ("a", "b", "_c")])
    found = None
    for r in range(rounds):
        mine = lambda c: F.pmod(F.xxhash64(c), F.lit(rounds)) == r  # noqa: B023, E731
        ways = every.where(mine(F.col("_e.b"))).select("a", F.col("_e.hub").alias("hub"), F.col("_e.b").alias("b"),
                                                       F.slice(F.col("_out.b"), F.col("_i") + 2, F.size("_out")).alias("_far"))
        own = out.where(mine(F.col("a"))).select(F.col("a").alias("b"), F.col("_out.b").alias("_own"))
        met = ways.where(~F.col("hub")).drop("hub").join(own, "b").select(
            "a", "b", F.array_intersect("_far", "_own").alias("_third")).where(F.size("_third") > 0)
        pairs = ways.where("hub").select("a", "b", F.explode("_far").alias("_c"))
        closed = pairs.join(between.where(mine(F.col("a"))).select(F.col("a").alias("b"), F.col("b").alias("_c")), ["b", "_c"])
        part = met.select(F.inline(F.concat(two, F.transform("_third", lambda c: corner(c, F.lit(1)))))).unionByName(
            closed.select(F.inline(three)))
        if r < rounds - 1:  # the last one runs with what follows
            part = written(part.groupBy("node_id").agg(F.sum("n").alias("n")), "triangles-found")
        found = part if found is None else found.unionByName(part)
    return found


def _cells(e: DataFrame, cell_edges: int) -> DataFrame:
    """(node_id, n): triangles of ``e`` (a, b) by coloured cells."""
    colours = max(1, math.ceil(math.sqrt(6 * e.count() / cell_edges)))
    colour = lambda c: F.pmod(F.xxhash64(c), F.lit(colours)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(colours - 1))).alias("_o")
    cells = e.withColumn("ca", colour("a")).withColumn("cb", colour("b")).select("a", "b", "ca", "cb", other)
    triple = F.array_sort(F.array("ca", "cb", "_o"))
    cells = cells.select("a", "b", "ca", "cb", *[F.get(triple, F.lit(i)).alias(f"_c{i}") for i in range(3)])
    kind = e.schema["a"].dataType.simpleString()
    return cells.groupBy("_c0", "_c1", "_c2").applyInArrow(_cell_triangles, f"node_id {kind}, n long")


def triangle_count(edges: DataFrame, cell_edges: int = CELL_EDGES, hub_degree: int = HUB_DEGREE) -> DataFrame:
    """Triangles through each node of the undirected simple graph (nodes without triangles omitted).

    Hubs are the nodes with more than ``hub_degree`` neighbours; all other nodes rank below them.  A triangle whose
    lowest corner is no hub is found from that corner's list, which has at most ``hub_degree`` entries, so these rows
    grow with the edges, not faster.  Triangles of three hubs are counted in cells of the edges between hubs: nodes get one of C
    colours by hash and every triple of colours is a cell, which holds the edges between its colours; a triangle is
    counted in the one cell of its corners' colours.  C grows with the root of the number of edges, so a cell has about
    ``cell_edges`` of them at any size, each edge is copied C times, and the edges of a node of any degree spread over
    the cells of its colour.  Neighbours are intersected inside a cell.
    """
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter(
        F.col("a") != F.col("b")).distinct()
    e = plain = written(e, "triangle-edges")
    rounds = max(1, min(ROUNDS, plain.count() // cell_edges))
    ends = e.select(F.explode(F.array("a", "b")).alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    hubs = written(ends.where(F.col("_n") > hub_degree).select("_h"), "triangle-hubs")
    for c in ("a", "b"):
        e = e.join(hubs.select(F.col("_h").alias(c), F.lit(True).alias(f"_hub_{c}")), c, "left")
    a_hub, b_hub = F.col("_hub_a").isNotNull(), F.col("_hub_b").isNotNull()
    between = written(e.where(a_hub & b_hub).select("a", "b"), "triangle-core")
    listed = e.where(~(a_hub & b_hub)).select(F.when(a_hub, F.col("b")).otherwise(F.col("a")).alias("a"),
                                              F.when(a_hub, F.col("a")).otherwise(F.col("b")).alias("b"), (a_hub | b_hub).alias("hub"))
    found = _listed_triangles(listed, between, rounds)
    discard(plain, hubs)  # the lists are written
    found = found.unionByName(_cells(between, cell_edges))
    return found.groupBy("node_id").agg(F.sum("n").alias("triangles"))


def motif_features(df: DataFrame, projection: DataFrame) -> DataFrame:
    """Per transaction: typed-graph in/out degree and triangles on the projection (0 if none)."""
    deg = degree_features(hetero_edges(df)).filter(F.col("node_type") == "transaction").drop("node_type")
    tri = triangle_count(projection)
    return (df.select("tx_id").join(deg, F.col("tx_id") == F.col("node_id"), "left").drop("node_id")
            .join(tri, F.col("tx_id") == F.col("node_id"), "left").drop("node_id")
            .select("tx_id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"),
                    F.coalesce("out_degree", F.lit(0)).alias("out_degree"),
                    F.coalesce("triangles", F.lit(0)).alias("triangles")))


CELL_LINKS = 500_000


def _matches(wanted: pa.ChunkedArray, ids: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair (position in ``wanted``, position in ``ids``) of equal ids."""
    held = ids.combine_chunks().dictionary_encode()
    code = held.indices.to_numpy(zero_copy_only=False)
    n = np.bincount(code, minlength=len(held.dictionary))
    at = pc.fill_null(pc.index_in(wanted.combine_chunks(), value_set=held.dictionary), -1).to_numpy(zero_copy_only=False)
    found = np.flatnonzero(at >= 0)
    w, start = n[at[found]], (np.cumsum(n) - n)[at[found]]
    return np.repeat(found, w), np.argsort(code, kind="stable")[np.repeat(start - (np.cumsum(w) - w), w) + np.arange(w.sum())]


def _by_destination(dst: pa.ChunkedArray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The destinations of the edges ``at``, the order that brings them together, and where each begins in it."""
    ends = dst.combine_chunks().dictionary_encode()
    code = ends.indices.to_numpy(zero_copy_only=False)[at]
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[order], prepend=-1))
    return ends.dictionary.take(pa.array(code[order][first])), order, first


def _in_cells(nodes: DataFrame, edges: DataFrame, ends: list[str], reduce, schema: str) -> DataFrame:
    """``reduce(edges, nodes)`` over cells of edges and the nodes (id, ...) at their ``ends``, as rows of ``schema``.

    A cell holds whole places (edges without ``place``: whole destinations); there are as many as keep ``CELL_LINKS``
    edges in each, and any way of cutting gives the same totals over the cells.  Many cells are gone through in rounds.
    """
    e = edges.where("src is not null and dst is not null")
    place = F.col("place") if "place" in edges.columns else F.xxhash64("dst")
    cells = max(1, math.ceil(edges.count() / CELL_LINKS))
    e = e.select("src", "dst", F.pmod(place, F.lit(cells)).cast("int").alias("_cell"))
    rounds, parts = min(ROUNDS, cells), None
    for r in range(rounds):
        own = e.where(F.pmod("_cell", F.lit(rounds)) == r)
        members = own.select(F.col("_cell").alias("_in"), F.explode(F.array(*ends)).alias("id")).distinct().join(nodes, "id")
        part = own.groupBy("_cell").cogroup(members.groupBy("_in")).applyInArrow(reduce, schema)
        if r < rounds - 1:  # the last one runs with what follows
            part = written(part, "cell-parts")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def neighbor_mean(nodes: DataFrame, edges: DataFrame, features: list[str], key: str = "tx_id",
                  micro_exact: bool = False) -> DataFrame:
    """Mean of source features per destination (parallel edges counted); isolated nodes get 0.

    ``micro_exact``: features carry at most 6 decimals, so sums are taken over
    exact integer micro-units and the mean is rounded half-up to 6 decimals
    from the exact ratio (identical in every engine, independent of the
    order in which partial sums arrive).
    """
    unit = (lambda c: F.round(F.col(c) * 1_000_000).cast("long")) if micro_exact else (lambda c: F.col(c).cast("double"))
    names = [f"_f{i}" for i in range(len(features))]
    src = nodes.select(F.col(key).alias("id"), *[unit(c).alias(n) for c, n in zip(features, names)])

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        at, row = _matches(left["src"], right["id"])
        dst, order, first = _by_destination(left["dst"], at)
        row, n = row[order], np.diff(first, append=len(at))
        out = {"dst": dst, "_n": n}
        for c in names:
            column = right[c].combine_chunks()
            total = lambda x: np.add.reduceat(x[row], first) if len(first) else x[:0]
            known = total(column.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)) if column.null_count else n
            out[c] = pa.array(total(column.fill_null(0).to_numpy(zero_copy_only=False)), mask=known == 0)
            out[f"_no{c}"] = n - known
        return pa.table(out)

    kind = "long" if micro_exact else "double"
    id_kind = edges.schema["dst"].dataType.simpleString()
    parts = _in_cells(src, edges, ["src"], sums, ", ".join([f"dst {id_kind}, _n long", *[f"{c} {kind}, _no{c} long" for c in names]]))
    agg = parts.groupBy("dst").agg(F.sum("_n").alias("_n"), *[F.sum(x).alias(x) for c in names for x in (c, f"_no{c}")])
    if micro_exact:
        mean = lambda c: F.floor((F.col(c) * 2 + F.col("_n")) / (F.col("_n") * 2)) / 1_000_000.0
    else:
        mean = lambda c: F.col(c) / (F.col("_n") - F.col(f"_no{c}"))
    agg = agg.select(F.col("dst").alias("_dst"), *[mean(c).alias(c) for c in names])
    return nodes.select(key).join(agg, F.col(key) == F.col("_dst"), "left").select(
        key, *[F.coalesce(F.col(n), F.lit(0.0)).alias(c) for c, n in zip(features, names)])


def sage_weights(in_dim: int, hidden: int = 32, out: int = 16, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Seeded N(0, 0.15) weights, generated once on the driver (a few KB) and inlined as literals."""
    rng = np.random.default_rng(seed)
    w1 = rng.normal(0.0, 0.15, size=(in_dim * 2, hidden))
    w2 = rng.normal(0.0, 0.15, size=(hidden * 2, out))
    return w1, w2


def _dense(cols: list[Column], w: np.ndarray, act=F.tanh) -> list[Column]:
    """Dense layer as inlined Column arithmetic (for narrow layers; codegen-friendly)."""
    outs = []
    for j in range(w.shape[1]):
        acc = None
        for i, c in enumerate(cols):
            term = c * F.lit(float(w[i, j]))
            acc = term if acc is None else acc + term
        outs.append(act(acc) if act is not None else acc)
    return outs


def _dense_array(cols: list[Column], w: np.ndarray, act=F.tanh) -> Column:
    """Dense layer as one array expression: ``transform(W^T, w -> sum(x * w))``.

    The weights are a literal array (a few KB), so the generated code stays
    small however wide the layer is (inlining 1,400 products per row exceeds
    the JVM's 64 KB method limit and disables codegen for the stage).  The
    sum runs left to right, exactly like the inlined form.
    """
    x = F.array(*[c.cast("double") for c in cols])
    wt = F.array(*[F.array(*[F.lit(float(v)) for v in w[:, j]]) for j in range(w.shape[1])])
    dot = F.transform(wt, lambda wj: F.aggregate(F.zip_with(x, wj, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v))
    return F.transform(dot, act) if act is not None else dot


def sage_encode(nodes: DataFrame, edges: DataFrame, features: list[str], hidden: int = 32, out: int = 16,
                seed: int = 7, key: str = "tx_id") -> DataFrame:
    """Two mean-aggregation layers ``tanh([h, mean(h_nbr)] . W)`` with frozen seeded weights.

    Each layer is one mean over neighbours; the dense products are
    array expressions over literal weights (JVM-side, no Python per row).  The
    second layer takes the mean of the products, which are half as wide as
    the hidden rows: ``mean(h) . W = mean(h . W)``.
    """
    w1, w2 = sage_weights(len(features), hidden, out, seed)
    h0 = nodes.select(key, *[F.col(c).cast("double").alias(c) for c in features])
    n1 = neighbor_mean(h0, edges, features, key).select(key, *[F.col(c).alias(f"n_{c}") for c in features])
    l1 = h0.join(n1, key).select(
        key, _dense_array([F.col(c) for c in features] + [F.col(f"n_{c}") for c in features], w1).alias("_h1"))
    hid = [F.col("_h1")[j] for j in range(hidden)]
    own, far = [f"own_{j}" for j in range(out)], [f"far_{j}" for j in range(out)]
    h1 = l1.select(key, _dense_array(hid, w2[:hidden], None).alias("_own"), _dense_array(hid, w2[hidden:], None).alias("_far"))
    h1 = h1.select(key, *[F.col(f"_{n[:3]}")[j].alias(n) for names in (own, far) for j, n in enumerate(names)])
    h1 = written(h1, "sage-layer")  # the layer's own rows and their neighbours' means
    n2 = neighbor_mean(h1, edges, far, key)
    l2 = h1.select(key, *own).join(n2, key)
    return l2.select(key, *[F.round(F.tanh(F.col(o) + F.col(f)), 6).alias(f"emb_{j}") for j, (o, f) in enumerate(zip(own, far))])


def attention_mean(nodes: DataFrame, edges: DataFrame, features: list[str], out_dim: int = 8, seed: int = 11,
                   key: str = "tx_id") -> DataFrame:
    """Single-head attention aggregation with frozen seeded weights (variant, forward only).

    score(e) = LeakyReLU_0.2(a . [W x_src, W x_dst]); softmax over each
    destination's incoming edges (stabilised by the per-destination max,
    which leaves the softmax unchanged); output = sum alpha * W x_src.
    Nodes without incoming edges get 0.
    """
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, 0.15, size=(len(features), out_dim))
    a = rng.normal(0.0, 0.15, size=(2 * out_dim,))
    wh_cols = _dense([F.col(c).cast("double") for c in features], w, act=None)
    wh_names = [f"wh_{j}" for j in range(out_dim)]
    wh = nodes.select(key, *[c.alias(n) for c, n in zip(wh_cols, wh_names)])
    # edges at a node with a null feature do not count
    rows = wh.select(F.col(key).alias("id"), *wh_names).where(F.col(wh_names[0]).isNotNull())

    def attend(left: pa.Table, right: pa.Table) -> pa.Table:
        """Per destination of a cell: the greatest score, and the sums of exp(score - greatest) and of its products."""
        at, src = _matches(left["src"], right["id"])
        also, to = _matches(left["dst"].take(pa.array(at)), right["id"])
        at, src = at[also], src[also]
        dst, order, first = _by_destination(left["dst"], at)
        src, to = src[order], to[order]
        column = lambda c: right[c].to_numpy()
        raw = np.zeros(len(src))
        for j, c in enumerate(wh_names):
            raw = raw + (column(c)[src] * a[j] + column(c)[to] * a[out_dim + j])
        e = np.where(raw > 0, raw, raw * 0.2)
        n = np.diff(first, append=len(at))
        top = np.maximum.reduceat(e, first) if len(first) else e
        x = np.exp(e - np.repeat(top, n))
        total = lambda v: np.add.reduceat(v, first) if len(first) else v
        return pa.table({"dst": dst, "_top": top, "_z": total(x), **{c: total(x * column(c)[src]) for c in wh_names}})

    kind = edges.schema["dst"].dataType.simpleString()
    parts = _in_cells(rows, edges, ["src", "dst"], attend, ", ".join([f"dst {kind}, _top double, _z double", *[f"{n} double" for n in wh_names]]))
    # a row a cell and destination
    scale = F.exp(F.col("_top") - F.max("_top").over(Window.partitionBy("dst")))
    parts = parts.withColumn("_x", scale)
    agg = parts.groupBy("dst").agg(*[F.sum(F.col(c) * F.col("_x")).alias(c) for c in ["_z", *wh_names]])
    res = agg.select("dst", *[(F.col(n) / F.greatest(F.col("_z"), F.lit(1e-10))).alias(n) for n in wh_names])
    return nodes.select(key).join(res, nodes[key] == res["dst"], "left").select(
        key, *[F.round(F.coalesce(F.col(n), F.lit(0.0)), 6).alias(f"att_{j}") for j, n in enumerate(wh_names)])
