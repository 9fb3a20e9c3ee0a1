"""Running a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ragloom.session import scratch_path
from ragloom.sources.archive import archive_batch


IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def drain(stream: DataFrame, label: str = "stream", idle_batches: bool = True, path: str | None = None) -> DataFrame:
    """Process what is available into a parquet table of the shared folder and read it.

    A stream with timeouts in real time would get batches without data for ever;
    it is drained with ``idle_batches`` off. A ``path`` that was drained to before
    goes on from there.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    before = spark.conf.get(IDLE)
    spark.conf.set(IDLE, str(idle_batches).lower())
    try:
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/data")
            .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(IDLE, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def archive_stream(turns: DataFrame, path: str, checkpoint: str, enabled: bool = True) -> StreamingQuery:
    """Archive finished turns; a replayed batch replaces itself."""
    return (
        turns.writeStream.foreachBatch(archive_batch(path, enabled)).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
