"""Conversation archive: id, time, question, answer, escalated."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_log = logging.getLogger(__name__)


def archive_rows(turns: DataFrame, batch: str) -> DataFrame:
    """``id, created_at, question, answer, escalated, batch`` with defaults for what is missing."""
    made = F.col("created_at") if "created_at" in turns.columns else F.lit(None).cast("timestamp")
    return turns.select(
        F.expr("uuid()").alias("id"), F.coalesce(made, F.current_timestamp()).alias("created_at"), "question", "answer",
        F.coalesce("escalated", F.lit(False)).alias("escalated"), F.lit(batch).alias("batch"),
    )


def _replace(turns: DataFrame, path: str, batch: str) -> None:
    """Write a batch into its own partition; written again, it replaces itself and nothing else."""
    rows = archive_rows(turns, batch)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def archive_turns(turns: DataFrame, path: str, enabled: bool = True) -> bool:
    """Append turns. A failure is logged and never reaches the caller, as answers must not wait for the archive."""
    if not enabled:
        return False
    try:
        _replace(turns, path, f"b-{uuid.uuid4().hex}")
        return True
    except Exception:
        _log.exception("could not archive conversations")
        return False


def archive_batch(path: str, enabled: bool = True):
    """``foreachBatch`` writer into the same layout. A batch that runs again replaces its own rows.

    A failure fails the batch: its offsets stay open, and the rows come again when the stream is restarted.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if enabled:
            _replace(batch, path, f"s-{batch_id}")

    return write
