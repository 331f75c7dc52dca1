"""Lakehouse views and ad-hoc SQL over the lake layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def _run_ids(spark: SparkSession, path: str) -> list[str]:
    """The run ids of a layer, from the names of its partition folders; no data is read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
    return [n.split("=", 1)[1] for n in names if n.startswith("etl_run_id=")]


def build_views(spark: SparkSession, base: str) -> list[str]:
    """Register ``transactions``, ``features`` (current snapshots) and ``etl_silver`` / ``etl_gold``.

    ``etl_silver`` / ``etl_gold`` expose the latest run only: the filter on
    the partition column ``etl_run_id`` is pruned at planning time, so only
    that run's files are listed and read.
    """
    base = base.rstrip("/")
    made = []
    for view, rel in (("transactions", "current/transactions.parquet"), ("features", "current/features.parquet")):
        if _exists(spark, f"{base}/{rel}"):
            spark.read.parquet(f"{base}/{rel}").createOrReplaceTempView(view)
            made.append(view)
    for view, layer in (("etl_silver", "silver"), ("etl_gold", "gold")):
        if _exists(spark, f"{base}/{layer}"):
            df = spark.read.parquet(f"{base}/{layer}")
            latest = max(_run_ids(spark, f"{base}/{layer}"), default=None)
            df.filter(F.col("etl_run_id") == latest).createOrReplaceTempView(view)
            made.append(view)
    return made


def query_lakehouse(spark: SparkSession, sql: str, limit: int = 1000) -> DataFrame:
    """Run ad-hoc SQL over the registered views, wrapped in an outer limit (limit pushdown by Catalyst).

    ``truncated`` below tells whether the limit has cut rows off.
    """
    return spark.sql(f"select * from ({sql}) limit {int(limit)}")


def truncated(spark: SparkSession, sql: str, limit: int = 1000) -> bool:
    return spark.sql(f"select * from ({sql}) limit {int(limit) + 1}").count() > limit
