"""Helpers shared by the operators: stored intermediate tables, Arrow access, salted look-backs, components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.io import fresh_dir

#: ASCII white space of the word rules: space, \\t, \\n, \\v, \\f, \\r.  ``bytes.split()`` splits on exactly these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SALTS = 64


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back: lineage ends at a table all executors share."""
    spark = df.sparkSession
    path = fresh_dir(spark, f"llm-{label}")
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete tables made by ``stored``; nothing that is still to run may read them."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def agg_back(df: DataFrame, keys: Sequence[str], aggs: dict[str, tuple[str, Column]], spread: Column) -> DataFrame:
    """Attach per-key aggregates to every row without putting a hot key into one task.

    ``aggs`` maps an output name to ``(combiner, input)`` with combiner ``min``, ``max`` or ``sum``.  Rows are
    salted by ``spread``; partial results per (key, salt) are combined per key (at most ``SALTS`` rows a key) and
    joined back on (key, salt), so each task sees 1/SALTS of a hot key.
    """
    keys = list(keys)
    comb = {"min": F.min, "max": F.max, "sum": F.sum}
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    part = salted.groupBy(*keys, "_salt").agg(*[comb[how](c).alias(n) for n, (how, c) in aggs.items()])
    part = stored(part, "partial")
    tot = part.groupBy(*keys).agg(*[comb[how](n).alias(n) for n, (how, _) in aggs.items()])
    back = part.select(*keys, "_salt").alias("p").join(
        tot.alias("t"), [F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    back = back.select(*[F.col(f"p.{k}").alias(f"_b_{k}") for k in keys], F.col("p._salt").alias("_b_salt"), *aggs)
    cond = F.col("_salt") == F.col("_b_salt")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    return salted.join(back, cond).drop("_salt", "_b_salt", *[f"_b_{k}" for k in keys])


def matrix(col: pa.ChunkedArray | pa.Array, width: int, dtype=np.float64) -> np.ndarray:
    """A list column without nulls as a zero-padded (rows, width) matrix."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], type=arr.type)
    n = len(arr)
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    if len(flat) == n * width:
        lengths_equal = n == 0 or bool((np.diff(arr.offsets.to_numpy()) == width).all())
        if lengths_equal:
            return flat.reshape(n, width)
    out = np.zeros((n, width), dtype=dtype)
    off = arr.offsets.to_numpy() - arr.offsets[0].as_py()
    for i in range(n):
        out[i, :off[i + 1] - off[i]] = flat[off[i]:off[i + 1]]
    return out


BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small: both ends of a task hold whole batches, and grow them by doubling.

    Sets the session's batch limits unless they are already lower.
    """
    limits = (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS))
    for key, most in limits:
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def release_memory() -> None:
    """Hand freed memory back to the system: a worker outlives its task and may next stand beside a hungrier one."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def values(column: pa.Array, rows: int = 512):
    """The Python values of an Arrow column, made a slice at a time so that long texts are not all copied at once."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def finite_vector(name: str) -> Column:
    """True when the vector is not null and every component is finite."""
    ok = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(name).isNotNull() & ok


# ---------------------------------------------------------------- connected components

def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over one block of edges: every non-root vertex with the smallest vertex of its component."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[:len(a)], inv[len(a):]
    lab = np.arange(len(ids))
    while True:  # hook to the smaller label, then jump pointers
        m = np.minimum(lab[x], lab[y])
        new = lab.copy()
        np.minimum.at(new, lab[x], m)
        np.minimum.at(new, lab[y], m)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, lab):
            break
        lab = new
    keep = lab != np.arange(len(ids))
    return ids[keep], ids[lab[keep]]


def _contract(batches):
    """Replace the edges of a partition by a spanning star per component, block by block."""
    held: list[np.ndarray] = []
    size = 0

    def flush():
        a, b = (np.concatenate(c) for c in zip(*held, strict=True))
        return forest(a, b)

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
        if size > 2_000_000:
            v, r = flush()
            if len(v) > 1_000_000:  # mostly distinct: hand the block on and start afresh
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(r)], names=["v", "u"])
                held, size = [], 0
            else:
                held, size = [(v, r)], len(v)
    if held:
        v, r = flush()
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(r)], names=["v", "u"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` of long ids: rows (v, root), root the smallest id, v not root.

    Partition-local union-find first replaces each partition's edges by stars.  Then the alternating large-star /
    small-star steps run until nothing changes; each is a min per vertex attached to its edges through salted
    partials, so a vertex with very many edges is spread over tasks.  Every step ends in a stored table.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u")
    e = stored(e.mapInArrow(_contract, "v long, u long"), "edges")
    if e.isEmpty():
        return spark.createDataFrame([], "v long, root long")

    def mark(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()

    before = mark(e)
    while True:
        both = e.union(e.select("u", "v"))
        m = agg_back(both, ["v"], {"m": ("min", F.col("u"))}, F.col("u"))
        large = m.where("u > v").select(F.col("u").alias("v"), F.least("m", "v").alias("u")).where("v <> u")
        large = stored(large.distinct(), "large")
        m = agg_back(large, ["v"], {"m": ("min", F.col("u"))}, F.col("u"))
        small = m.select("v", F.col("m").alias("u")).union(m.where("u <> m").select(F.col("u"), F.col("m")))
        e = stored(small.distinct(), "small")
        after = mark(e)
        if after == before:
            return e.select("v", F.col("u").alias("root"))
        before = after


def attach(df: DataFrame, keys: Sequence[str], other: DataFrame, spread: Column) -> DataFrame:
    """Left join of ``other`` (one row per key) onto every row, null-safe, without putting a hot key into one task.

    The (key, salt) pairs that occur fetch the row of ``other`` first, so it is copied at most ``SALTS`` times a key;
    the rows then join on (key, salt).
    """
    keys = list(keys)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    pairs = salted.select(*keys, "_salt").distinct().alias("p")
    rest = [c for c in other.columns if c not in keys]
    seen = pairs.join(other.alias("o"), [F.col(f"p.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys], "left")
    seen = stored(seen.select(*[F.col(f"p.{k}").alias(f"_b_{k}") for k in keys], F.col("p._salt").alias("_b_salt"), *rest),
                  "attach")
    cond = F.col("_salt") == F.col("_b_salt")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    return salted.join(seen, cond, "left").drop("_salt", "_b_salt", *[f"_b_{k}" for k in keys])
