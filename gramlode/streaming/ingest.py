"""Append-only corpora: micro-batches of new texts go into an index as added files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gramlode.operators import index as ix
from gramlode.sources import storage


def add_batch(batch: DataFrame, path: str, max_size: int = ix.MAX_FILE_SIZE) -> None:
    """Idempotent: a batch that is replayed replaces its own files."""
    spark = batch.sparkSession
    if not storage.exists(spark, f"{path}/CURRENT"):
        ix.build(batch, path, max_size)
        return
    index = ix.open_index(spark, path)
    ix.update(index, batch, batch.select("path", F.lit("changed").alias("change")))


def index_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """``stream`` has a corpus' columns. Processes all that is there, then ends."""
    return stream.writeStream.foreachBatch(lambda df, _: add_batch(df, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
