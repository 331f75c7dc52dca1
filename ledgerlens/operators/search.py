"""Exact nearest-neighbour search in bounded cells, opened by distance to the boxes of a split tree.

Items are cut into regions by a tree of splits (one component against one value), fitted on a bounded sample; a region
with more than ``TILE_ROWS`` items is dealt into several tiles.  The tree and the box around each region's items, at most
``PIVOTS`` of them whatever the data, are known to every task.  A query first searches a tile of its own region; its k-th
best distance there is an upper bound, and only tiles of regions whose box lies no farther are opened.  Every
(tile, query block) cell is one bounded group: products of matrices tell which items can be near enough, and the distances
of those are taken by differences.  The local lists are merged per query.  The sample decides about time only: both
sides may have any size, nothing is refused or cut, and no pair rows are made.

Cosine search is the same search on unit vectors.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.sources.io import written

PIVOTS = 4096  # regions of the tree, at most
SAMPLE_ROWS = 32  # a region
TILE_ROWS = 4096
QUERY_ROWS = 32_768
_STEP = 256  # queries held against a tile at once


def _matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in col.chunks]
    return (np.concatenate(flat) if flat else np.empty(0)).reshape(-1, width).astype(np.float64)


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows by differences, so that equal vectors are exactly 0 and ties are ties."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        d = q[:, j] - c[:, j]
        out += d * d
    return out


class _Tree:
    """Splits ``x[dim] < cut``; the leaves are the regions, in ``region`` (-1 for inner nodes)."""

    def __init__(self, sample: np.ndarray, regions: int):
        self.dim, self.cut, self.kids, self.region = [0], [0.0], [(0, 0)], [-1]
        heap, leaves, at = [(-len(sample), 0)], [], {0: sample}
        while heap:
            n, node = heapq.heappop(heap)
            x = at.pop(node)
            found = self._split(x) if len(heap) + len(leaves) + 1 < regions else None
            if found is None:
                leaves.append(node)
                continue
            self.dim[node], self.cut[node] = found
            left = x[:, found[0]] < found[1]
            self.kids[node] = (len(self.dim), len(self.dim) + 1)
            for side in (x[left], x[~left]):
                at[len(self.dim)] = side
                heapq.heappush(heap, (-len(side), len(self.dim)))
                for values, v in ((self.dim, 0), (self.cut, 0.0), (self.kids, (0, 0)), (self.region, -1)):
                    values.append(v)
        for r, node in enumerate(leaves):
            self.region[node] = r
        self.regions = len(leaves)

    @staticmethod
    def _split(x: np.ndarray) -> tuple[int, float] | None:
        if len(x) < 2:
            return None
        for j in np.argsort(-x.std(0), kind="stable"):
            cut = np.median(x[:, j])
            above = x[x[:, j] > x[:, j].min(), j]
            if len(above):
                return int(j), float(max(cut, above.min()))
        return None

    def regions_of(self, x: np.ndarray) -> np.ndarray:
        dim, cut, kids, region = np.array(self.dim), np.array(self.cut), np.array(self.kids), np.array(self.region)
        node, todo = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(todo := todo[region[node[todo]] < 0]):
            at = node[todo]
            node[todo] = kids[at, np.where(x[todo, dim[at]] < cut[at], 0, 1)]
        return region[node].astype(np.int32)

    def bound(self, lo: np.ndarray, hi: np.ndarray) -> None:
        """Take the regions' boxes; a node's box is around its children's."""
        self.lo, self.hi = np.empty((len(self.dim), lo.shape[1])), np.empty((len(self.dim), lo.shape[1]))
        for node in reversed(range(len(self.dim))):  # children have higher numbers
            if (r := self.region[node]) >= 0:
                self.lo[node], self.hi[node] = lo[r], hi[r]
            else:
                a, b = self.kids[node]
                self.lo[node], self.hi[node] = np.minimum(self.lo[a], self.lo[b]), np.maximum(self.hi[a], self.hi[b])

    def reached(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, region) for every region whose box is no farther from the row than its squared ``reach``."""
        rows, found = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, i = todo.pop()
            q = x[i]
            gap = np.maximum(np.maximum(self.lo[node] - q, q - self.hi[node]), 0.0)
            i = i[(gap * gap).sum(1) <= reach[i] * (1 + 1e-9) + 1e-12]
            if len(i) and self.region[node] >= 0:
                rows.append(i)
                found.append(np.full(len(i), self.region[node], np.int32))
            elif len(i):
                todo += [(kid, i) for kid in self.kids[node]]
        return np.concatenate(rows), np.concatenate(found)


def _near(x: np.ndarray, c: np.ndarray, k: int, reach: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of c, squared distance): for each row of x its k nearest of c, ties to the earlier row of c.

    With ``reach`` only those within it.  Products of centred matrices give distances up to a rounding error; what
    that error leaves open is decided by exact distances.
    """
    shift = c.mean(0)
    cs = c - shift
    cn = (cs * cs).sum(1)
    rows, items, dist = [], [], []
    for lo in range(0, len(x), _STEP):
        q = x[lo:lo + _STEP]
        qs = q - shift
        qn = (qs * qs).sum(1)
        about = qn[:, None] + cn[None, :] - 2.0 * (qs @ cs.T)
        # components subtracted, squared and summed: a few units in the last place of the centred lengths
        slack = ((qn + cn.max()) * (8 * x.shape[1] + 64) * np.finfo(float).eps)[:, None]
        limit = np.full((len(q), 1), np.inf) if reach is None else reach[lo:lo + _STEP, None]
        if reach is None and len(c) > k:
            limit = np.partition(about, k - 1, axis=1)[:, k - 1:k] + slack
        i, j = np.nonzero(~(about > limit + slack))
        d = _exact(q[i], c[j])
        if reach is not None:
            keep = d <= reach[lo + i]
            i, j, d = i[keep], j[keep], d[keep]
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k
        rows.append(i[top] + lo)
        items.append(j[top])
        dist.append(d[top])
    return tuple(np.concatenate(p) if p else np.empty(0, t) for p, t in ((rows, np.int64), (items, np.int64), (dist, float)))


def _finite(vec: str, width: int) -> Column:
    """Whether a vector has ``width`` components that are all finite numbers."""
    ok = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    return F.coalesce((F.size(vec) == width) & F.forall(vec, lambda e: F.coalesce(ok(e), F.lit(False))), F.lit(False))


def _tiles(items: DataFrame, width: int) -> tuple[DataFrame, _Tree, list[int], list[int]]:
    """Items with a tile number, the tree, and for each of its regions the first tile and the number of tiles."""
    n = items.count()
    wanted = max(1, min(PIVOTS, math.ceil(n / TILE_ROWS)))
    share = min(1.0, wanted * SAMPLE_ROWS / max(n, 1))
    drawn = items.where(F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))).select("vec")
    tree = _Tree(_matrix(drawn.limit(4 * wanted * SAMPLE_ROWS).toArrow()["vec"], width), wanted)

    def assign(batches):
        for b in batches:
            x = _matrix(pa.chunked_array([b.column(1)]), width)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.regions_of(x))], names=["id", "vec", "label", "region"])

    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    near = written(items.select("id", "vec", "label").mapInArrow(
        assign, f"id {kinds['id']}, vec array<double>, label {kinds['label']}, region int"), "search-items")

    def corners(batches):
        for b in batches:
            x, r = _matrix(pa.chunked_array([b.column(0)]), width), b.column(1).to_numpy()
            order = np.argsort(r, kind="stable")
            x, (held, at, many) = x[order], np.unique(r[order], return_index=True, return_counts=True)
            if len(held):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held), pa.array(many), _vectors(np.minimum.reduceat(x, at)), _vectors(np.maximum.reduceat(x, at))],
                    names=["region", "n", "lo", "hi"])

    part = near.select("vec", "region").mapInArrow(corners, "region int, n long, lo array<double>, hi array<double>")
    box = part.groupBy("region").agg(F.sum("n").alias("n"), F.array(*[F.min(F.col("lo")[i]) for i in range(width)]).alias("lo"),
                                     F.array(*[F.max(F.col("hi")[i]) for i in range(width)]).alias("hi")).toArrow()  # a row a region
    lo, hi, parts = np.full((tree.regions, width), np.inf), np.full((tree.regions, width), -np.inf), np.ones(tree.regions, np.int64)
    held = box["region"].to_numpy()
    if len(held):
        lo[held], hi[held] = _matrix(box["lo"], width), _matrix(box["hi"], width)
        parts[held] = -(-box["n"].to_numpy() // TILE_ROWS)
    tree.bound(lo, hi)
    start = np.concatenate([[0], np.cumsum(parts)])[:-1]
    dealt = near.sparkSession.createDataFrame(pa.table({"region": np.arange(tree.regions, dtype=np.int32), "_a": start, "_n": parts}))
    tiled = near.join(F.broadcast(dealt), "region").withColumn("tile", (F.col("_a") + F.pmod(F.xxhash64("id"), "_n")).cast("int"))
    return tiled.select("id", "vec", "label", "tile"), tree, start.tolist(), parts.tolist()


def nearest(queries: DataFrame, items: DataFrame, width: int, k: int) -> DataFrame:
    """``(qid, vec)`` against ``(id, vec, label)``: rows ``qid, id, label, d2`` (squared distance), at most k a query.

    Ties go to the smaller id.  Vectors have ``width`` components; a distance to or from one that is not finite is NaN
    and comes after all others.  Empty inputs give no rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    q_kind = queries.schema["qid"].dataType.simpleString()
    hit = f"qid {q_kind}, id {kinds['id']}, label {kinds['label']}, d2 double"
    usual = _finite("vec", width)
    finite = items.where(usual)
    placed = queries.select("qid", "vec").where(usual)
    smallest = F.broadcast(items.select("id", "label").orderBy("id", "label").limit(k))  # what a query without distances lists
    strange = queries.where(~usual).select("qid").crossJoin(smallest).select("qid", "id", "label", F.lit(float("nan")).alias("d2"))
    if finite.isEmpty():
        beyond = placed.select("qid").crossJoin(smallest).select("qid", "id", "label", F.lit(float("nan")).alias("d2"))
        return _best(strange.unionByName(beyond), k)
    tiled, tree, start, parts = _tiles(finite, width)
    if len(finite.limit(k).take(k)) < k:  # only then are items without a distance among the best
        rest = F.broadcast(items.where(~usual).select("id", "label").orderBy("id", "label").limit(k))
        strange = strange.unionByName(placed.select("qid").crossJoin(rest).select("qid", "id", "label", F.lit(float("nan")).alias("d2")))
    first_tile, tiles_of = np.array(start), np.array(parts)

    def home(batches):
        for b in batches:
            r = tree.regions_of(_matrix(pa.chunked_array([b.column(1)]), width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first_tile[r].astype(np.int32))], names=["qid", "vec", "tile"])

    def by_id(table: pa.Table) -> pa.Table:
        return table.take(pc.sort_indices(table["id"], null_placement="at_start"))

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        """The queries of a block with the hits in their own tile, the nearest first."""
        x, right = _matrix(left["vec"], width), by_id(right)
        if not right.num_rows:  # a region that holds no item
            i, j, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        else:
            i, j, d = _near(x, _matrix(right["vec"], width), k, None)
        ends = pa.array(np.searchsorted(i, np.arange(len(x) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, c) for c in (
            right["id"].take(pa.array(j)).combine_chunks(), right["label"].take(pa.array(j)).combine_chunks(), pa.array(d))]
        return pa.table([left["qid"], left["vec"], left["tile"], *lists], names=["qid", "vec", "tile", "ids", "labels", "d2s"])

    def further(left: pa.Table, right: pa.Table) -> pa.Table:
        """The hits of a block's queries within their reach in a tile."""
        i, j, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if left.num_rows and right.num_rows:
            right = by_id(right)
            i, j, d = _near(_matrix(left["vec"], width), _matrix(right["vec"], width), k, left["reach"].to_numpy())
        return pa.table({"qid": left["qid"].take(pa.array(i)), "id": right["id"].take(pa.array(j)), "label": right["label"].take(pa.array(j)), "d2": d})

    def cells(q: DataFrame, search, schema: str) -> DataFrame:
        """Search every query in the tile it names; a tile goes once to every block of its queries."""
        sizes = q.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS)).cast("int").alias("_n"))
        sizes = F.broadcast(written(sizes, "search-blocks"))  # a row a tile
        dealt = q.join(sizes, "tile").withColumn("qb", F.pmod(F.xxhash64("qid", "vec"), "_n").cast("int")).drop("_n")
        members = tiled.join(sizes, "tile").select("id", "vec", "label", F.col("tile").alias("c_tile"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("c_qb"))
        return dealt.groupBy("tile", "qb").cogroup(members.groupBy("c_tile", "c_qb")).applyInArrow(search, schema)

    def beyond(batches):
        """Every query once for each other tile whose box it reaches."""
        for b in batches:
            x, own = _matrix(pa.chunked_array([b.column(1)]), width), b.column(2).to_numpy()
            reach = np.array([np.inf if v is None else v for v in b.column(3).to_pylist()], dtype=float)
            i, r = tree.reached(x, reach)
            many = tiles_of[r]
            i, tile = np.repeat(i, many), np.repeat(first_tile[r] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            other = tile != own[i]
            i, tile = pa.array(i[other]), tile[other]
            yield pa.RecordBatch.from_arrays([b.column(0).take(i), b.column(1).take(i), pa.array(tile.astype(np.int32)), pa.array(reach).take(i)],
                                             names=["qid", "vec", "tile", "reach"])

    asked = written(placed.mapInArrow(home, f"qid {q_kind}, vec array<double>, tile int"), "search-queries")
    own = written(cells(asked, first, f"qid {q_kind}, vec array<double>, tile int, ids array<{kinds['id']}>, labels array<{kinds['label']}>, "
                                      "d2s array<double>"), "search-first")
    more = own.select("qid", "vec", "tile", F.get("d2s", F.lit(k - 1)).alias("reach")).mapInArrow(
        beyond, f"qid {q_kind}, vec array<double>, tile int, reach double")
    hits = own.select("qid", F.inline(F.arrays_zip("ids", "labels", "d2s"))).toDF("qid", "id", "label", "d2")
    return _best(hits.unionByName(cells(more, further, hit)).unionByName(strange), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("d2", "id")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _ranked(found: DataFrame, order: list[Column]) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))


def _vector(features: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in features])


def nearest_l2(queries: DataFrame, reference: DataFrame, features: list[str], k: int = 3,
               qkey: str = "tx_id", rkey: str = "tx_id", label: str = "is_fraud") -> DataFrame:
    """Per query row, the ``k`` reference rows nearest in Euclidean distance (with their label)."""
    q = queries.select(F.col(qkey).alias("qid"), _vector(features).alias("vec"))
    r = reference.select(F.col(rkey).alias("id"), _vector(features).alias("vec"), F.col(label).alias("label"))
    top = _ranked(nearest(q, r, len(features), k), [F.col("d2"), F.col("id")])
    return top.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("ref_id"), "label",
                      F.round(F.sqrt("d2"), 6).alias("distance"))


def nearest_cosine(queries: DataFrame, corpus: DataFrame, dim: int, k: int = 5, qkey: str = "query_id",
                   ckey: str = "vec_id", vec: str = "embedding", label: str = "label",
                   fraud_only: bool = False) -> DataFrame:
    """Top-k corpus vectors by cosine similarity per query (norms floored at 1e-10)."""
    c = corpus.filter(F.col(label) == 1) if fraud_only else corpus

    def unit(v: str) -> Column:
        x = F.transform(F.col(v), lambda e: e.cast("double"))
        norm = F.greatest(F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e)), F.lit(1e-10))
        return F.transform(x, lambda e: e / norm)

    q = queries.select(F.col(qkey).alias("qid"), unit(vec).alias("vec"))
    items = c.select(F.col(ckey).alias("id"), unit(vec).alias("vec"), F.col(label).alias("label"))
    top = _ranked(nearest(q, items, dim, k), [F.col("d2"), F.col("id")])
    # unit vectors: |a - b|^2 = 2 - 2 cos
    return top.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("match_id"), "label",
                      F.round(F.lit(1.0) - F.col("d2") / 2.0, 6).alias("similarity"))


def label_centroids(corpus: DataFrame, dim: int, vec: str = "embedding", label: str = "label") -> DataFrame:
    """One mean vector per label (a partial/final aggregate; at most one row per label)."""
    aggs = [F.avg(F.col(vec)[i].cast("double")).alias(f"_m{i}") for i in range(dim)]
    g = corpus.groupBy(label).agg(*aggs)
    return g.select(F.col(label).alias("query_id"),
                    F.array(*[F.round(F.col(f"_m{i}"), 6) for i in range(dim)]).alias(vec))


def vector_search(queries: DataFrame, corpus: DataFrame, dim: int, k: int = 5, qkey: str = "query_id",
                  ckey: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Exact flat search: top-k corpus rows per query by *squared* L2 distance."""
    q = queries.select(F.col(qkey).alias("qid"), F.transform(F.col(vec), lambda e: e.cast("double")).alias("vec"))
    c = corpus.select(F.col(ckey).alias("id"), F.transform(F.col(vec), lambda e: e.cast("double")).alias("vec"), F.lit(0).alias("label"))
    top = _ranked(nearest(q, c, dim, k), [F.col("d2"), F.col("id")])
    return top.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("match_id"), F.round("d2", 6).alias("distance"))
