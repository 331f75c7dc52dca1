"""Tiles of vectors along their principal axes, with a table of boxes that bounds what two tiles can share.

Rows are rotated to the principal axes of the whole table and numbered in the order of their grid cells on the leading
axes; a tile is a run of such numbers, so every tile is full and none is more than full.  A box holds a tile's range on
each leading axis and the range of the norms of what follows (the suffix norms).  Boxes are rows of a table: what the
driver holds does not grow with the number of tiles.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import matrix
from ledgerlens.operators.ranking import global_row_number

LEAD = 8


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(big > 0, big, 1.0)  # no overflow or underflow of the squares
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def second_moment(vectors: DataFrame, width: int, units: bool) -> np.ndarray:
    """Sum of u u' over all vectors ``v`` (as unit vectors or as given): one width x width matrix a task, added by Spark."""

    def moments(batches):
        total = np.zeros((width, width))
        for b in batches:
            u = matrix(b.column(0), width)
            u = unit(u) if units else u
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["i", "x"])

    rows = vectors.select("v").mapInArrow(moments, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(width * width)
    for r in rows:  # width**2 numbers
        out[r.i] = r.x
    return out.reshape(width, width)


def principal_axes(moment: np.ndarray) -> np.ndarray:
    return np.linalg.eigh(moment)[1][:, ::-1].copy()  # strongest axis first


def project(rows: DataFrame, axes: np.ndarray, units: bool) -> DataFrame:
    """``rows`` with ``p`` (place on the leading axes), ``rest`` (norm of what follows) and ``norm`` of the vector ``v``."""
    width = len(axes)
    lead = min(LEAD, width)
    schema = T.StructType([*rows.schema.fields, T.StructField("p", T.ArrayType(T.DoubleType())),
                           T.StructField("rest", T.DoubleType()), T.StructField("norm", T.DoubleType())])

    def rotate(batches):
        for b in batches:
            x = matrix(b.column("v"), width)
            r = (unit(x) if units else x) @ axes
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * lead)
            p = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(r[:, :lead]).ravel()))
            rest = np.sqrt((r[:, lead:] ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, p, pa.array(rest), pa.array(np.sqrt((r * r).sum(1)))],
                                             names=schema.names)

    return rows.mapInArrow(rotate, schema)


def number_by_cell(rows: DataFrame, step: float, ties: Sequence[str], name: str) -> DataFrame:
    """Projected ``rows`` numbered from 0 in the order of their grid cells, ``step`` wide, on the leading axes."""
    cell = F.transform("p", lambda x: F.floor(x / F.lit(step)))
    return global_row_number(rows.withColumn("_cell", cell), ["_cell", *ties], name).drop("_cell")


def boxes(rows: DataFrame, key: str, lead: int, *more: Column) -> DataFrame:
    """One row a ``key``: ``low``, ``high`` on every leading axis, ``rest_low``, ``rest_high``, ``norm`` (the largest)."""
    at = [F.get("p", F.lit(i)) for i in range(lead)]
    return rows.groupBy(key).agg(F.array(*map(F.min, at)).alias("low"), F.array(*map(F.max, at)).alias("high"),
                                 F.min("rest").alias("rest_low"), F.max("rest").alias("rest_high"),
                                 F.max("norm").alias("norm"), *more)


#: Names of the columns that hold a box; a row's own place is a box without extent.
BOX = ("low", "high", "rest_low", "rest_high")
POINT = ("p", "p", "rest", "rest")


def prefixed(prefix: str, names: Sequence[str] = BOX) -> tuple[str, ...]:
    return tuple(f"{prefix}{n}" for n in names)


def most_product(a: Sequence[str], b: Sequence[str], lead: int) -> Column:
    """No inner product between the two boxes is larger: ranges on the leading axes, Cauchy-Schwarz on the suffixes."""
    total = F.col(a[3]) * F.col(b[3])
    for i in range(lead):
        la, ha, lb, hb = (F.get(c, F.lit(i)) for c in (a[0], a[1], b[0], b[1]))
        total = total + (F.greatest(la * lb, la * hb) if a[0] == a[1] else F.greatest(la * lb, la * hb, ha * lb, ha * hb))
    return total


def least_distance2(a: Sequence[str], b: Sequence[str], lead: int) -> Column:
    """No squared distance between the two boxes is smaller; the suffixes differ by their norms at least."""
    gap = lambda la, ha, lb, hb: F.greatest(lb - ha, la - hb, F.lit(0.0))
    total = F.pow(gap(*(F.col(c) for c in (a[2], a[3], b[2], b[3]))), F.lit(2.0))
    for i in range(lead):
        total = total + F.pow(gap(*(F.get(c, F.lit(i)) for c in (a[0], a[1], b[0], b[1]))), F.lit(2.0))
    return total
