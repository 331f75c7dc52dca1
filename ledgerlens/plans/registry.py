"""Query registry: name -> (Spark callable, DuckDB oracle SQL or None).

Operator modules register their headline queries with ``@query``; the entry
point in ``__spark_entry__.py`` only assembles the dictionaries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    fn: QueryFn
    sql: str | None


_REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query name {name}")
        _REGISTRY[name] = Entry(name, fn, sql)
        return fn
    return deco


def entries() -> dict[str, Entry]:
    # Importing the query modules fills the registry.
    from ledgerlens.plans import queries  # noqa: F401
    return dict(_REGISTRY)
