"""Event-time progress of a stream that loses no late row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The column that carries the watermark; it is null in every row that is left.
CLOCK = "_clock"


def with_clock(rows: DataFrame, at: Column, lateness: str) -> DataFrame:
    """``rows`` with a watermark that follows ``at``, ``lateness`` behind the newest row.

    Spark drops rows older than the watermark before a stateful operator sees
    them. Here each row comes with a copy that only moves the watermark and is
    filtered out behind it; the row itself has no event time and is never dropped.
    """
    # a row without a time moves nothing
    moments = F.array(F.lit(None).cast("timestamp"), F.coalesce(at.cast("timestamp"), F.timestamp_seconds(F.lit(0))))
    return rows.withColumn(CLOCK, F.explode(moments)).withWatermark(CLOCK, lateness).filter(F.col(CLOCK).isNull())
