"""Exact top-k search by columnar branch and bound over tiles of integer vectors.

Vectors are quantised to integers and dealt into tiles along their principal axes; queries are dealt into blocks in
the same order.  Each query first searches the tile it would lie in, which gives it a floor: its k-th score there.  A
(query block, tile) cell, one bounded group, is opened only where the tile's box can reach a floor of the block, and
only for the rows that can.  Inside a cell the tile lies in vertical layout, one matrix per block of dimensions:
scores accumulate dimension block by block, and after each block the candidates whose partial score plus the
remaining mass (product of the suffix norms, Cauchy-Schwarz) stays below the k-th best are compacted away.
The cells' local top k are merged per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import finite_vector, matrix, stored
from ledgerlens.llm.tiles import (
    BOX, LEAD, POINT, boxes, most_product, number_by_cell, prefixed, principal_axes, project, second_moment,
)
from ledgerlens.operators.ranking import global_row_number

BLOCK_DIMS = 16
EXACT_FLOAT = 2.0 ** 53
#: Bounds are widened by this share of the masses they are made of: far above the rounding of doubles at any width met.
ROUNDING = 1e-10


def quantise(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``(vec_id, v array<long>)`` with v = floor(scale * x), x as double; unusable vectors are left out."""
    v = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return (vectors.where(F.col(id_col).isNotNull() & finite_vector(vec_col))
            .select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")))


def cell_topk(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, floors: np.ndarray | None = None):
    """Top k of one cell: arrays (query id, candidate id, score).  ``q`` and ``c`` are int64 matrices of equal width.

    ``floors`` are scores that k candidates of a query are known to reach; hits below them are left out.
    """
    rows, ids, scores = _search_cell(q, q_ids, c, c_ids, k, floors)
    return q_ids[rows], ids, scores


def _search_cell(q, q_ids, c, c_ids, k, floors):
    """As ``cell_topk``, with the place of the query in ``q`` instead of its id."""
    d = c.shape[1]
    peak = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(d, 1)
    if peak < EXACT_FLOAT:  # every partial sum is an integer below 2**53: float64 products are exact and use BLAS
        q, c = q.astype(np.float64), c.astype(np.float64)
    cuts = list(range(0, d, BLOCK_DIMS)) + [d]
    cols = [np.ascontiguousarray(c[:, a:b]) for a, b in zip(cuts, cuts[1:], strict=False)] or [c]
    sq_c = np.stack([(b.astype(np.float64) ** 2).sum(1) for b in cols])
    # rest[j]: norm of what follows block j
    rest_c = [np.sqrt(sq_c[j + 1:].sum(0)) for j in range(len(cols))]
    out_q, out_c, out_s = [], [], []
    for i in range(len(q)):
        qb = [q[i, a:b] for a, b in zip(cuts, cuts[1:], strict=False)] or [q[i]]
        sq_q = [float((b.astype(np.float64) ** 2).sum()) for b in qb]
        rest_q = [np.sqrt(sum(sq_q[j + 1:])) for j in range(len(qb))]
        alive = np.nonzero(c_ids != q_ids[i])[0]
        if not len(alive):
            continue
        part = (cols[0] @ qb[0])[alive]
        floor_score = -np.inf if floors is None else floors[i]
        if floor_score == -np.inf and len(alive) > 4 * k and len(cols) > 1:
            # first bound: the full scores of the most promising candidates after one block
            seed = np.argpartition(-part, 2 * k)[:2 * k]
            full = part[seed]
            for j in range(1, len(cols)):
                full = full + cols[j][alive[seed]] @ qb[j]
            floor_score = np.sort(full)[-k]
        for j in range(len(cols)):
            if j:
                part = part + cols[j][alive] @ qb[j]
            mass = rest_q[j] * rest_c[j][alive]
            # above 2**53 the parts are rounded as they meet the bounds, which are widened to match
            slack = ROUNDING * (np.abs(part.astype(np.float64)) + mass) + 1e-6
            stay = part + mass + slack >= floor_score
            if not stay.all():
                alive, part, mass, slack = alive[stay], part[stay], mass[stay], slack[stay]
            if j + 1 < len(cols) and len(part) > 4 * k:
                # a candidate's score is at least its partial score minus the remaining mass
                low = part - mass - slack
                floor_score = max(floor_score, np.partition(low, len(low) - k)[len(low) - k])
        top = np.lexsort((c_ids[alive], -part))[:k]
        out_q.append(np.full(len(top), i))
        out_c.append(c_ids[alive[top]])
        out_s.append(part[top].astype(np.int64))
    if not out_q:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def topk_search(queries: DataFrame, candidates: DataFrame, k: int, tile_rows: int = 4096,
                query_rows: int = 4096) -> DataFrame:
    """The k candidates with the highest inner product for every query row, the query's own id excluded.

    Both inputs are ``(vec_id long, v array<long>)`` (see ``quantise``).  Returns ``query_id, rank, vec_id, score``;
    ties go to the smaller ``vec_id``; fewer than k rows when there are fewer candidates.  Shorter vectors count as
    padded with zeros; empty vectors score 0.  Repeated ids are separate candidates.  Empty inputs give no rows.
    Cells hold at most about ``tile_rows`` x ``query_rows`` vectors whatever the table size.
    """
    spark = candidates.sparkSession
    size = candidates.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    nq = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    if not size.n or not nq.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(size.d, nq.d, 1)
    lead, tiles = min(LEAD, width), -(-(size.n + nq.n) // tile_rows)
    moment = second_moment(candidates, width, units=False)
    step = float(np.sqrt(np.trace(moment) / size.n)) / 4 or 1.0
    both = candidates.select("vec_id", "v", F.lit(False).alias("asked")).unionByName(
        queries.select("vec_id", "v", F.lit(True).alias("asked")))
    rows = number_by_cell(project(both, principal_axes(moment), units=False), step, ["vec_id", "asked", "v"], "at")
    rows = rows.withColumn("tile", F.floor(F.col("at") / tile_rows))
    held = rows.where("not asked")
    asked = rows.where("asked").select(F.col("at").alias("row"), F.col("vec_id").alias("q_id"), F.col("v").alias("q_v"),
                                       F.col("tile").alias("home"), *[F.col(c).alias(c) for c in ("p", "rest", "norm")])

    def parts(ids: pa.ChunkedArray, vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        return matrix(vectors, width, np.int64), ids.to_numpy()

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        (q, q_ids), (c, c_ids) = parts(left["q_id"], left["q_v"]), parts(right["vec_id"], right["v"])
        at, _, s = _search_cell(q, q_ids, c, c_ids, k, None)
        full = np.nonzero(np.bincount(at, minlength=len(q)) == k)[0]
        least = np.full(len(q), np.iinfo(np.int64).max)
        np.minimum.at(least, at, s)
        return pa.table({"row": left["row"].to_numpy()[full], "floor": least[full]})

    floors = stored(asked.select("row", "q_id", "q_v", "home").groupBy("home").cogroup(
        held.select("vec_id", "v", "tile").groupBy("tile")).applyInArrow(first, "row long, floor long"), "topk-floors")
    asked = asked.join(floors, "row", "left").withColumn("floor", F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf"))))
    asked = global_row_number(asked.drop("home"), ["row"], "place").withColumn("block", F.floor(F.col("place") / query_rows))
    q_box = boxes(asked, "block", lead, F.min("floor").alias("floor")).select(
        "block", *[F.col(c).alias(f"q_{c}") for c in (*BOX, "norm", "floor")])
    c_box = boxes(held, "tile", lead)

    def reaches(a, b, norms, floor):
        mass = F.col(norms[0]) * F.col(norms[1])
        return most_product(a, b, lead) + ROUNDING * mass + 1e-6 >= F.col(floor) - ROUNDING * F.abs(floor)

    listed = q_box.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumn("tile", F.col("tile").cast("long"))
    opened = stored(listed.join(c_box, "tile").where(
        (F.col("q_floor") == float("-inf")) | reaches(prefixed("q_"), BOX, ("q_norm", "norm"), "q_floor")), "topk-opened")
    own = opened.withColumnRenamed("norm", "box_norm")
    q = asked.join(own.select("block", "tile", *BOX, "box_norm"), "block").where(
        (F.col("floor") == float("-inf")) | reaches(POINT, BOX, ("norm", "box_norm"), "floor"))
    c = held.join(opened.drop("norm", *BOX), "tile").where(
        (F.col("q_floor") == float("-inf")) | reaches(POINT, prefixed("q_"), ("norm", "q_norm"), "q_floor"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, s = cell_topk(*parts(left["q_id"], left["q_v"]), *parts(right["vec_id"], right["v"]), k, left["floor"].to_numpy())
        return pa.table({"query_id": a, "vec_id": b, "score": s})

    hits = (q.select("q_id", "q_v", "floor", F.col("block").alias("q_block"), F.col("tile").alias("q_tile"))
            .groupBy("q_block", "q_tile")
            .cogroup(c.select("vec_id", "v", "block", "tile").groupBy("block", "tile"))
            .applyInArrow(search, "query_id long, vec_id long, score long"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
