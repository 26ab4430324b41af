"""Structured Streaming jobs: live query-log counts, and continuous ingest into a chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_corpus
from ..sources.clustered import Files


def daily_stream(log: DataFrame, watermark: str = "1 day") -> DataFrame:
    """day and n of a streamed log (ts: timestamp); rows later than the watermark are dropped, a day is emitted when it is closed."""
    counts = log.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.to_date("window.start").alias("day"), "n")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that is there now to a parquet table, and stop. Started again, it goes on where it stopped."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_stream(docs: DataFrame, path: str, checkpoint: str, max_size: int = 4000) -> None:
    """Chunk streamed documents (document_id, text) into the table at ``path``.

    Each micro-batch has a partition of its own, written over when the batch is run again, so a restart repeats no chunk. The table's folder
    is there even if no document came.
    """
    Files(docs.sparkSession, path).folder(path)

    def batch(rows: DataFrame, number: int) -> None:
        chunk_corpus(rows, max_size).write.mode("overwrite").parquet(f"{path}/batch={number}")

    docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A stream of one table in a folder: of the files in its own folder if ``name``.parquet is one, else of the files of that name at any depth."""
    own = f"{folder.rstrip('/')}/{name}.parquet"
    if Files(spark, own).is_folder(own):
        return spark.readStream.schema(schema).parquet(own)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", "true").parquet(folder)
