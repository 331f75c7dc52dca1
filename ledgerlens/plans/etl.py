"""ETL compositions: bronze, silver, gold, quality, layered writes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import etl as ops
from ledgerlens.operators.features import gold_features
from ledgerlens.sources.versioned import VersionedTable

# Caller-supplied run identity (the reference derives it from the wall clock
# at one-second resolution, so two runs in a second collide).
DEFAULT_RUN_ID = "etl_run_0001"
DEFAULT_INGESTED_AT = "2026-01-01T00:00:00+00:00"
DEFAULT_SOURCE_SYSTEM = "government_finance"


@dataclass
class EtlResult:
    bronze: DataFrame
    valid: DataFrame
    silver: DataFrame
    quality: DataFrame

    @property
    def gold(self) -> DataFrame:
        """Gold features of silver, built on first use (fitting codes and sizing keys runs small jobs)."""
        if not hasattr(self, "_gold"):
            self._gold = gold_features(self.silver)
        return self._gold


def run_etl(raw: DataFrame, run_id: str = DEFAULT_RUN_ID, source_system: str = DEFAULT_SOURCE_SYSTEM,
            source_path: str = "", profile: str | None = ops.DEFAULT_PROFILE,
            ingested_at: str = DEFAULT_INGESTED_AT, row_number_col: str | None = None, by_user: bool = False) -> EtlResult:
    """Profile -> bronze -> silver -> gold, all lazy (but for ``by_user``, see ``prepare_silver``); callers decide what to persist/write.

    Silver is the fan-out point (gold, counts and the quality report all read
    it), so writers should persist or write it once and read it back.
    """
    profiled = ops.apply_sector_profile(raw, profile) if profile else raw
    bronze = ops.bronze_snapshot(profiled, run_id, source_system, source_path)
    valid, silver = ops.prepare_silver(raw, run_id, source_system, ingested_at,
                                       row_number_col=row_number_col, profile=profile, by_user=by_user)
    quality = ops.quality_report(profiled, valid, silver)
    return EtlResult(bronze, valid, silver, quality)


def run_ledger(spark: SparkSession, folder: str) -> VersionedTable:
    """The ledger of loads: one row a run id.  Loads that finish at the same time both stay."""
    return VersionedTable(spark, folder, ["run_id"], buckets=4)


def record_run(ledger: VersionedTable, quality: DataFrame, run_id: str, created_at: str, dataset: str = "transactions",
               source_system: str = DEFAULT_SOURCE_SYSTEM) -> int:
    """Write a run's summary into the ledger; a run recorded again replaces its row.  Returns the ledger's version."""
    row = quality.select(
        F.lit(run_id).alias("run_id"), F.lit(dataset).alias("dataset_name"), F.lit(source_system).alias("source_system"), "rows_extracted",
        "rows_valid", "rows_invalid", "rows_loaded", "duplicates_removed", F.lit(created_at).cast("timestamp_ntz").alias("created_at"))
    return ledger.upsert(row, ["created_at"])
