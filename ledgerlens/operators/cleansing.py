"""Cleansing operators shared by ETL and the canonical frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup_latest(df: DataFrame, key: str | Sequence[str], order_desc: Sequence[str], keep: Column | None = None) -> DataFrame:
    """Keep one row per ``key``: the greatest by ``order_desc`` (lexicographic).

    Written as ``groupBy(key).agg(max(struct(order..., rest...)))`` rather than
    ``row_number()`` over a window: the aggregate runs a partial (map-side)
    pass, so even a key duplicated across a third of the input is collapsed to
    one row per map task before the shuffle instead of landing in one task.
    Remaining columns act as the final tie-break, so the result is
    deterministic whenever rows differ at all.

    ``keep``: optional row predicate evaluated inside the aggregate (rows failing
    it contribute nothing; keys with no kept row disappear).
    """
    cols, keys = list(df.columns), [key] if isinstance(key, str) else list(key)
    rest = [c for c in cols if c not in keys and c not in order_desc]
    packed = F.struct(*[F.col(c) for c in order_desc], *[F.col(c) for c in rest])
    if keep is not None:
        packed = F.when(keep, packed)
    best = df.groupBy(*keys).agg(F.max(packed).alias("_best"))
    if keep is not None:
        best = best.filter(F.col("_best").isNotNull())
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in cols if c not in keys]).select(*cols)
