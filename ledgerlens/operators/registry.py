"""Model registry: fitted pipelines saved in the shared folder, their records in a versioned table."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.versioned import VersionedTable, as_of

RECORD = "run_id string, model_type string, valid_from timestamp_ntz, rows long, positives long, model_path string"


class ModelRegistry:
    """Runs of fitted models; a run's record appears once its model is saved."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.table = VersionedTable(spark, f"{self.folder}/runs", ["run_id"], buckets=4)

    def register(self, model: PipelineModel, record: DataFrame) -> str:
        """Save the model and upsert its one-row record (run_id, model_type, valid_from, rows, positives); a run
        registered again replaces its former self.  Returns the run id."""
        row = record.first()
        path = f"{self.folder}/models/{row['run_id']}"
        model.write().overwrite().save(path)
        self.table.upsert(record.withColumn("model_path", F.lit(path)), ["valid_from"])
        return row["run_id"]

    def runs(self) -> DataFrame:
        """All records; none before the first registration."""
        if not self.table.versions():
            return self.spark.createDataFrame([], RECORD)
        return self.table.read()

    def latest(self) -> str | None:
        """The run that is valid last; run ids break ties."""
        row = self.runs().orderBy(F.desc("valid_from"), F.desc("run_id")).select("run_id").first()
        return row["run_id"] if row else None

    def load(self, run_id: str) -> PipelineModel:
        row = self.runs().where(F.col("run_id") == run_id).select("model_path").first()
        if row is None:
            raise KeyError(f"no run {run_id}")
        return PipelineModel.load(row["model_path"])

    def valid_at(self, rows: DataFrame, model_type: str, at: str) -> DataFrame:
        """Attach to each row the run of its model type that was valid at its time."""
        return as_of(rows, self.runs().drop("model_path"), model_type, at, "valid_from")
