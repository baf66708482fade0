"""Folders per micro-batch: a batch that runs again replaces its own folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

BATCH = "batch_id"
RUN = "run_id"


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream of this checkpoint; a new one has another."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def put_batch(df: DataFrame, path: str, batch_id: int, run: str | None = None) -> None:
    folder = path if run is None else f"{path}/{RUN}={run}"
    df.write.mode("overwrite").parquet(f"{folder}/{BATCH}={batch_id}")


def other_batches(spark: SparkSession, path: str, batch_id: int, run: str) -> DataFrame | None:
    """What every batch but this one of this run wrote; none at the very start."""
    stored = _stored(spark, path)
    own = (F.col(RUN) == run) & (F.col(BATCH) == batch_id)
    return None if stored is None else stored.filter(~own)


def before_batch(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What the batches before this one wrote; none at the very start."""
    stored = _stored(spark, path)
    return None if stored is None else stored.filter(F.col(BATCH) < batch_id)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def drain(writer: DataStreamWriter, checkpoint: str) -> None:
    """Work off all input that is there, then stop; a rerun goes on from there."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def file_stream(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    """Parquet files as a stream, a bounded number of files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
