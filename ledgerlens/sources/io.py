"""Sources and sinks: suffix-dispatched reads, layered writes, object names.

All paths go through Spark's filesystem layer, so ``s3a://`` / ``abfss://``
/ ``hdfs://`` bases work unchanged on a cluster.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import scratch_path

CSV_WRITE = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
             "nullValue": "\\N"}
# Layers hold hashes, which the default codec cannot make smaller.
PARQUET_CODEC = "zstd"
# Text sources repeat their keys and constants in every row; readers know the codec by the files' suffix.
TEXT_CODEC = "gzip"
# Files this library writes mark nulls explicitly, so empty text survives a round trip.
CSV_READ_OWN = {"nullValue": "\\N"}


def read_source(spark: SparkSession, path: str, schema: T.StructType | None = None,
                options: dict | None = None) -> DataFrame:
    """Dispatch on suffix: csv / json / parquet; anything else is an error.

    CSV is read with an explicit all-string schema (no inference pass over
    the data) unless a schema is given; typing happens later with ``try_cast``.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix == "csv":
        reader = spark.read.option("header", "true").options(**(options or {}))
        if schema is None:
            header = spark.read.option("header", "true").csv(path).columns  # reads the header line only
            schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        return reader.schema(schema).csv(path)
    if suffix == "json":
        if schema is None:
            raise ValueError("a json source needs a schema: inferring one reads the whole input")
        return spark.read.schema(schema).json(path)
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported source format: .{suffix}" if suffix else "unsupported source format: (none)")


def write_source(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    w = df.write.mode(mode)
    if suffix == "csv":
        w.options(**CSV_WRITE).csv(path, compression=TEXT_CODEC)
    elif suffix == "json":
        w.json(path, compression=TEXT_CODEC)
    elif suffix == "parquet":
        w.parquet(path, compression=PARQUET_CODEC)
    else:
        raise ValueError(f"unsupported sink format: .{suffix}")
    release(df.sparkSession)
    return path


def cast_like(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Type an all-string frame back to ``schema`` (non-strict)."""
    return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the shared checkpoint location (never machine-local on a cluster)."""
    return scratch_path(spark, f"{label}-{uuid.uuid4().hex[:12]}")


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs.

    Spark removes a shuffle once the driver's garbage collector has found its plan unused, which on a driver with free
    memory may be never.  Called after every write; the files of the write before last are gone then at the latest.
    """
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once below the shared location and read it back: for frames that several branches of a job use."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path, compression=PARQUET_CODEC)
    release(df.sparkSession)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._folders = [path]
    return back


def discard(*frames: DataFrame) -> None:
    """Delete the folders behind frames that nothing reads any more: ``written`` ones, and those that name theirs as ``_folders``."""
    for df in frames:
        for path in getattr(df, "_folders", ()):
            p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class ObjectStore:
    """Save / load / exists of parquet objects by name under a base URI."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def target(self, name: str) -> str:
        return f"{self.base}/{name.lstrip('/')}"

    def save_parquet(self, df: DataFrame, name: str) -> str:
        df.write.mode("overwrite").parquet(self.target(name), compression=PARQUET_CODEC)
        release(self.spark)
        return self.target(name)

    def load_parquet(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.target(name))

    def exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.target(name))
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return bool(fs.exists(p))


def write_layer(df: DataFrame, base: str, layer: str, run_col: str = "etl_run_id") -> str:
    """Write one lake layer partitioned by run id; re-running a run replaces only its partition."""
    path = f"{base.rstrip('/')}/{layer}"
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(run_col).parquet(path, compression=PARQUET_CODEC))
    release(df.sparkSession)
    return path


def write_current(df: DataFrame, base: str, name: str) -> str:
    path = f"{base.rstrip('/')}/current/{name}"
    df.write.mode("overwrite").parquet(path, compression=PARQUET_CODEC)
    release(df.sparkSession)
    return path


def parquet_profile(spark: SparkSession, path: str) -> DataFrame:
    """Row count, column count, column names and schema string of a parquet dataset."""
    df = spark.read.parquet(path)
    cols = ",".join(df.columns)
    schema = df.schema.simpleString()
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).alias("n_columns"), F.lit(cols).alias("columns"),
        F.lit(schema).alias("schema"))
