"""The review reducer as a stream: every micro-batch updates the states of the records that it touched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from deskmill.operators.review import states


def review_states(actions: DataFrame) -> DataFrame:
    """Streaming actions to states; the aggregate is the batch one, so replaying a log gives the batch result."""
    return states(actions)


def writer(actions: DataFrame, checkpoint: str, out: str) -> DataStreamWriter:
    """Changed states appended under ``out`` as Parquet, one folder a micro-batch. A batch that is run again after a failure overwrites its
    own folder, so nothing is written twice; nothing comes to the driver."""

    def append(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/log/batch_id={batch}")

    return review_states(actions).writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The latest state of each record, from the log."""
    log = spark.read.parquet(f"{out}/log").drop("batch_id")
    newest = log.groupBy("analysis_id").agg(F.max("batch").alias("batch"))
    return log.join(newest, ["analysis_id", "batch"], "left_semi").drop("batch")
