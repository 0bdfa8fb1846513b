"""The experiment log as a stream: one row of state a tag, folded as the log grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.track import RECORD, experiments_fold


def stream_log(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The records of JSON lines files that are there and that come."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_trigger).json(path)


def fold_stream(log: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Fold what there is now into the state kept in ``checkpoint``, and write the tags that changed to ``out``/batch=<id>.

    The fold is a streaming aggregation: of each leaf the state has the last value that isn't null with its seq, so
    records may come in any order, and a run that starts again goes on where the last one ended. A batch that is done
    again after a failure replaces its own rows.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return experiments_fold(log).writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, out: str) -> DataFrame:
    """The tags' last rows in what fold_stream has written, as experiments_fold gives them for the whole log."""
    rows = spark.read.parquet(out)
    columns = [c for c in rows.columns if c not in ("tag", "batch")]
    return rows.groupBy("tag").agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("tag", "r.*")
