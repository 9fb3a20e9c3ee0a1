"""Ranked lists: fuse, fill in, trim, interleave."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.vectors import cosine_distance
from ragloom.params import Params
from ragloom.session import broadcast_within


def reciprocal_rank_fusion(dense: DataFrame, sparse: DataFrame, rrf_k: int) -> DataFrame:
    """``(query_id, id, score)``: ``1/(k+rank)`` from each list, summed."""
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col(r)), F.lit(0.0))
    d = dense.select("query_id", "id", F.col("rnk").alias("_d"))
    s = sparse.select("query_id", "id", F.col("rnk").alias("_s"))
    return d.join(s, ["query_id", "id"], "full_outer").select(
        "query_id", "id", (part("_d") + part("_s")).alias("score")
    )


def take_best(scored: DataFrame, k: int) -> DataFrame:
    """First ``k`` of every query by score, ties by id, numbered in ``rnk``."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= k)


def _fetched(ids: DataFrame, chunks: DataFrame, n_rows: int, params: Params) -> DataFrame:
    """The chunk rows of the distinct ``ids``.

    Ids carry the number of their stored block, so where they are sent to a table
    stored by ``block`` only the blocks that hold them are read; only ids are sent.
    """
    on = ["id"]
    if "block" in chunks.columns:
        # ids count from 0; said as a condition, it makes the optimizer prune blocks by the ids
        ids = ids.filter("id >= 0").withColumn("block", F.floor(F.col("id") / params.id_block).cast("bigint"))
        on = ["block", "id"]
    return chunks.join(broadcast_within(ids, n_rows, 32, params.broadcast_bytes), on).drop("block")


def with_payload(ranked: DataFrame, chunks: DataFrame, n_rows: int, params: Params = Params()) -> DataFrame:
    """Fetch chunk columns for ranked ids; ids come first and the payload last."""
    return _fetched(ranked.select("id").distinct(), chunks, n_rows, params).join(
        broadcast_within(ranked, n_rows, 64, params.broadcast_bytes), "id")


def with_distance(
    ranked: DataFrame, queries: DataFrame, chunks: DataFrame, n_rows: int, params: Params = Params()
) -> DataFrame:
    """Like ``with_payload``, and measure the dense distance of every row.

    Query vectors meet the few fetched rows, not the chunk table.
    """
    found = with_payload(ranked.drop("distance"), chunks, n_rows, params)
    return (
        found.join(queries.select("query_id", "vector"), "query_id")
        .withColumn("distance", cosine_distance("embedding", "vector"))
        .drop("vector", "embedding")
    )


def keep_close(ranked: DataFrame, k: int, min_keep: int, max_distance: float) -> DataFrame:
    """Keep the first ``min_keep`` and whatever lies within ``max_distance``; then the first ``k``."""
    order = Window.partitionBy("query_id").orderBy("rnk")
    kept = ranked.filter(
        (F.col("rnk") <= min(min_keep, k)) | F.coalesce(F.col("distance") <= max_distance, F.lit(False))
    )
    return kept.withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= k)


def weak_match(queries: DataFrame, retrieved: DataFrame, max_distance: float) -> DataFrame:
    """``(query_id, weak)``: something came back and all of it lies beyond the threshold."""
    beyond = F.coalesce(F.col("distance") > max_distance, F.lit(True))
    flags = retrieved.groupBy("query_id").agg(F.bool_and(beyond).alias("weak"))
    return queries.select("query_id").join(flags, "query_id", "left").select(
        "query_id", F.coalesce("weak", F.lit(False)).alias("weak")
    )


def round_robin(lists: DataFrame, k: int, group: str = "group_id", item: str = "id") -> DataFrame:
    """Interleave ranked lists: rank 1 of every list, then rank 2, first seen wins.

    ``lists`` has ``group, list_no, rnk, item`` and any payload. An item's place
    is its smallest (rank, list); the first ``k`` places are the result.
    """
    # at most (lists x k) rows per group get here, whatever the table size
    best = Window.partitionBy(group, item).orderBy("rnk", "list_no")
    order = Window.partitionBy(group).orderBy("rnk", "list_no")
    return (
        lists.withColumn("_seen", F.row_number().over(best))
        .filter(F.col("_seen") == 1)
        .withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") <= k)
        .drop("_seen", "rnk")
        .withColumnRenamed("_place", "rnk")
    )
