"""Result rows as they arrive: a stream of files into the table of latest rows.

Chunks of a run are files; a file source picks up each once, and the batch is written with its
number, so a batch that is tried again overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rows(spark: SparkSession, folder: str, schema: str, fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(folder)


def into_table(stream: DataFrame, target: str, checkpoint: str, key: str = "index"):
    """Appends batches under ``batch=N``; ``latest_rows`` reads the last row of each key."""

    def put(batch: DataFrame, number: int) -> None:
        batch.where(F.col(key).isNotNull()).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rows(spark: SparkSession, target: str, key: str = "index") -> DataFrame:
    df = spark.read.parquet(target)
    others = [c for c in df.columns if c not in (key, "batch")]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(key, "r.*")


def running_accuracy(stream: DataFrame, key: str = "subject") -> DataFrame:
    """Accuracy by group as rows come in; the state is one row for each group."""
    right = F.count_if(F.coalesce("ok", F.lit(False)))
    return stream.where(F.col(key).isNotNull()).groupBy(key).agg(right.alias("correct"), F.count("*").alias("total"))
