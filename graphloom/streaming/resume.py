"""Records processed as they arrive. Articles never interact, so there is no state between batches but the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.sources.readers import WIKI


def process_new(spark: SparkSession, source: str, checkpoint: str, batch: Callable[[DataFrame, int], None], schema: str = WIKI) -> StreamingQuery:
    """Hands the JSON records that came since the last run to ``batch`` and ends.

    The checkpoint takes the place of a list of finished keys: a file is read once, also if a
    run is broken off.
    """
    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_chunks(out: str, chunker: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A batch function that appends chunks; a batch that is run again replaces its own files."""

    def run(records: DataFrame, batch_id: int) -> None:
        rows = records.select(F.col("id").alias("doc_id"), "title", "text")
        chunker(rows).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return run
