"""Global ordering without a single task.

``row_number() over (order by ...)`` with no partition pulls every row into
one task.  ``global_row_number`` instead range-partitions on the order key
(Spark samples the key, so a hot value is split across partitions), sorts
within partitions, and adds to each row the count of all rows in earlier
partitions.  Only one small row per partition reaches the offset step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import ensure_checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id = partition index << 33 | row index in partition


def global_row_number(df: DataFrame, order: Sequence[str | Column], name: str = "row_number",
                      num_partitions: int | None = None, checkpoint: bool = True) -> DataFrame:
    """Add a dense 0-based row number in ``order`` (which must be a total order).

    The range-partitioned, locally sorted frame is checkpointed to the shared
    checkpoint folder so that both the per-partition counts and the final
    projection read the very same partition layout, even if executors are
    lost and tasks rerun.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    tagged = ordered.withColumn("_mid", F.monotonically_increasing_id())
    if checkpoint:
        ensure_checkpoint_dir(spark)
        tagged = tagged.checkpoint(eager=True)
    pid = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    sizes = tagged.groupBy(pid.alias("_pid")).agg((F.max(local) + 1).alias("_size"))
    # One row per partition: the window below runs over at most n rows.
    offsets = sizes.select(
        "_pid", F.coalesce(F.sum("_size").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)).alias("_offset"))
    out = tagged.join(F.broadcast(offsets), pid == F.col("_pid"))
    return out.withColumn(name, F.col("_offset") + local).drop("_mid", "_pid", "_offset")
