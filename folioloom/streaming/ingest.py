"""File-stream ingest: new markup files are parsed and appended, each micro-batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from folioloom.sources import markup


def markup_stream(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), xhtml of files as they arrive."""
    return spark.readStream.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("xhtml"))


def ingest(stream: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the elements of each micro-batch below ``out``, in a folder per batch, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        markup.text_elements(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
