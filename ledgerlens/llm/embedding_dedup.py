"""Embedding near-duplicates by PCA-ordered tiled comparison with suffix-norm bounds.

Vectors are normalised and rotated to the principal axes of the whole table, so the leading dimensions carry most of
the mass.  They are cut into tiles along the leading axes; a pair of tiles is one bounded group, opened only where the
tiles' boxes and suffix norms leave room for a link.  Inside it the leading dimensions are multiplied first; a pair lives on only while its partial product plus the product of the suffix norms
can still reach the threshold.  Identical vectors are collapsed to one weighted row beforehand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import components, finite_vector, matrix, stored
from ledgerlens.llm.tiles import (
    BOX, LEAD, POINT, boxes, least_distance2, most_product, number_by_cell, prefixed, principal_axes, project,
    second_moment, unit,
)

BLOCK_DIMS = 16
SLACK = 1e-9
ROWS_AT_ONCE = 512  # rows of a link matrix widened to numbers at once


def tile_links(ra, xa, rb, xb, threshold: float, same: bool) -> np.ndarray:
    """Boolean link matrix of two tiles; ``r*`` rotated unit vectors, ``x*`` original vectors."""
    d = ra.shape[1]
    cuts = list(range(0, d, BLOCK_DIMS)) + [d]
    na, nb = np.sqrt((xa * xa).sum(1)), np.sqrt((xb * xb).sum(1))
    links = np.zeros((len(ra), len(rb)), dtype=bool)
    suffix = lambda r, j: np.sqrt(np.maximum((r[:, cuts[j + 1]:] ** 2).sum(1), 0))
    for lo in range(0, len(ra), 512):
        a = ra[lo:lo + 512]
        part = a[:, :cuts[1]] @ rb[:, :cuts[1]].T
        alive = part + np.outer(suffix(a, 0), suffix(rb, 0)) >= threshold - SLACK
        j = 1
        # many pairs left: whole products for the next block; few left: only those pairs
        while j < len(cuts) - 1 and alive.mean() > 0.05:
            part += a[:, cuts[j]:cuts[j + 1]] @ rb[:, cuts[j]:cuts[j + 1]].T
            alive &= part + np.outer(suffix(a, j), suffix(rb, j)) >= threshold - SLACK
            j += 1
        i, k = np.nonzero(alive)
        s = part[i, k]
        while j < len(cuts) - 1 and len(i):
            s = s + np.einsum("ij,ij->i", a[i, cuts[j]:cuts[j + 1]], rb[k, cuts[j]:cuts[j + 1]])
            stay = s + suffix(a, j)[i] * suffix(rb, j)[k] >= threshold - SLACK
            i, k, s = i[stay], k[stay], s[stay]
            j += 1
        sure = s >= threshold + SLACK
        edge = np.nonzero(~sure)[0]
        if len(edge):  # too close to call on rotated values: the plain cosine of the given vectors decides
            p, q = i[edge] + lo, k[edge]
            sure[edge] = np.einsum("ij,ij->i", xa[p], xb[q]) / (na[p] * nb[q]) >= threshold
        links[i[sure] + lo, k[sure]] = True
    if same:
        np.fill_diagonal(links, False)
    return links


def _spanning(links: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray):
    """Star edges (vertex, smallest id reachable inside the cell)."""
    big = np.iinfo(np.int64).max
    la, lb = ids_a.copy(), ids_b.copy()
    rows, cols = np.nonzero(links.any(1))[0], np.nonzero(links.any(0))[0]
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    m, xa, xb = links[np.ix_(rows, cols)], la[rows], lb[cols]
    slabs = [slice(lo, lo + ROWS_AT_ONCE) for lo in range(0, len(rows), ROWS_AT_ONCE)]
    while True:
        nb = xb
        for s in slabs:
            nb = np.minimum(nb, np.where(m[s], xa[s, None], big).min(0))
        na = np.concatenate([np.minimum(xa[s], np.where(m[s], nb[None, :], big).min(1)) for s in slabs])
        if np.array_equal(na, xa) and np.array_equal(nb, xb):
            break
        xa, xb = na, nb
    v, r = np.concatenate([ids_a[rows], ids_b[cols]]), np.concatenate([xa, xb])
    return v[v != r], r[v != r]


def _weighed(links: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row and of each column, counted with the other side's multiplicities."""
    slabs = [slice(lo, lo + ROWS_AT_ONCE) for lo in range(0, len(links), ROWS_AT_ONCE)]
    of_rows = np.concatenate([np.zeros(0, np.int64), *(links[s] @ wb for s in slabs)])
    return of_rows, sum((wa[s] @ links[s] for s in slabs), np.zeros(links.shape[1], np.int64))


def near_tiles(tiles: DataFrame, threshold: float, lead: int) -> DataFrame:
    """Ordered pairs ``tile, other`` whose boxes leave room for a cosine >= ``threshold``, with the box of ``other``.

    Unit vectors with cosine >= t differ by at most sqrt(2 - 2t): boxes meet in the buckets of that width on the first
    axis, and a pair is kept in the first bucket that both reach.
    """
    far2 = max(0.0, 2 - 2 * threshold) + 1e-6
    width = float(np.sqrt(far2))
    at = lambda c: F.floor(F.get(c, F.lit(0)) / width)
    a = tiles.select("tile", *[F.col(c).alias(f"a_{c}") for c in BOX], at("low").alias("a_from"),
                     F.explode(F.sequence(at("low"), at("high"))).alias("bucket"))
    b = tiles.select(F.col("tile").alias("other"), *BOX, (at("low") - 1).alias("b_from"),
                     F.explode(F.sequence(at("low") - 1, at("high") + 1)).alias("bucket"))
    met = a.join(b, "bucket").where(F.col("bucket") == F.greatest("a_from", "b_from"))
    return met.where((most_product(prefixed("a_"), BOX, lead) >= threshold - SLACK)
                     & (least_distance2(prefixed("a_"), BOX, lead) <= far2) | (F.col("tile") == F.col("other"))).select(
        "tile", "other", *BOX)


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9,
                    tile_rows: int = 4096) -> DataFrame:
    """Per vector: ``vec_id, n_links, component_id, kept`` for links with cosine >= ``threshold`` in double precision.

    Null, zero, and non-finite vectors link with nothing and stand alone; shorter vectors count as padded with zeros.
    Identical vectors are compared once and count with their multiplicity; repeated ids give one row each.  Rows
    with a null id are left out.  An empty table gives no rows.  No pair is ever written: a cell returns link counts
    per vector and a spanning star of its links.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    base = base.where("vec_id is not null")
    usable = finite_vector("v") & F.exists("v", lambda x: x != 0)
    # trailing zeros and the sign of zero do not change a cosine: one spelling per vector
    last = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("v"), F.lit(1))), F.lit(0),
                       lambda acc, i: F.when(F.get("v", i - 1) != 0, i).otherwise(acc))
    spelled = base.where(usable).select("vec_id", F.transform(F.slice("v", F.lit(1), last), lambda x: x + 0.0).alias("v"))
    spelled = spelled.withColumn("fp", F.sha2(F.to_json("v"), 256))
    classes = stored(spelled.groupBy("fp").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"),
                                               F.any_value("v").alias("v")), "vectors")
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    if not size.n:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    width = size.d
    axes, lead = principal_axes(second_moment(classes, width, units=True)), min(LEAD, width)
    far2 = max(0.0, 2 - 2 * threshold) + 1e-6
    placed = number_by_cell(project(classes.select("rep", "m", "v"), axes, units=True), float(np.sqrt(far2)) / 2, ["rep"], "at")
    placed = placed.withColumn("tile", F.floor(F.col("at") / tile_rows))
    near = stored(near_tiles(stored(boxes(placed, "tile", lead), "boxes"), threshold, lead), "near")
    # a row goes to another tile only where its own place leaves room for a link with that tile's box
    room = (most_product(POINT, BOX, lead) >= threshold - SLACK) & (least_distance2(POINT, BOX, lead) <= far2)
    cells = placed.join(near, "tile").where(room | (F.col("tile") == F.col("other"))).select(
        "rep", "m", "v", "tile", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"))

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ti, tj = key[0].as_py(), key[1].as_py()
        ids, w = table["rep"].to_numpy(), table["m"].to_numpy()
        x, t = matrix(table["v"], width), table["tile"].to_numpy()
        r = unit(x) @ axes
        a = np.nonzero(t == ti)[0]
        b = a if ti == tj else np.nonzero(t == tj)[0]
        links = tile_links(r[a], x[a], r[b], x[b], threshold, ti == tj)
        of_a, of_b = _weighed(links, w[a], w[b])
        n = [(ids[a], of_a)] + ([] if ti == tj else [(ids[b], of_b)])
        v = np.concatenate([i[k > 0] for i, k in n])
        n = np.concatenate([k[k > 0] for _, k in n])
        ea, eb = _spanning(links, ids[a], ids[b])
        return pa.table({"v": np.concatenate([v, ea]),
                         "u": pa.array(np.concatenate([np.zeros(len(v), np.int64), eb]),
                                       mask=np.arange(len(v) + len(ea)) < len(v)),
                         "n": np.concatenate([n, np.zeros(len(ea), np.int64)]).astype(np.int64)})

    found = stored(cells.groupBy("ti", "tj").applyInArrow(compare, "v long, u long, n long"), "links")
    n_links = found.where("u is null").groupBy("v").agg(F.sum("n").alias("n"))
    roots = components(found.where("u is not null").select(F.col("v").alias("a"), F.col("u").alias("b")))
    per_class = (classes.select("fp", "rep", "m").join(n_links, F.col("rep") == F.col("v"), "left").drop("v")
                 .join(roots, F.col("rep") == F.col("v"), "left")
                 .select("fp", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"),
                         F.coalesce("root", "rep").alias("component_id")))
    # a class may hold a third of all rows: its row is copied once per salt that occurs
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(64)).cast("int")
    member = spelled.select("vec_id", "fp", salt.alias("salt"))
    seen = member.select("fp", "salt").distinct().join(per_class, "fp")
    linked = member.join(seen, ["fp", "salt"]).select("vec_id", "n_links", "component_id")
    alone = base.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                                 F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
