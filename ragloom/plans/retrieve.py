"""Retrieval of many queries at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.operators.cells import cell_topk
from ragloom.operators.dense import dense_topk
from ragloom.operators.embedding import Embedder, embed
from ragloom.operators.exclusion import exclusion_groups, with_exclusions
from ragloom.operators.fusion import (
    keep_close, reciprocal_rank_fusion, round_robin, take_best, with_distance, with_payload,
)
from ragloom.operators.lexical import query_terms, ranked_terms
from ragloom.params import Params
from ragloom.plans.ingest import KnowledgeBase
from ragloom.session import settled


def embed_queries(queries: DataFrame, embedder: Embedder, text: str = "text", task_types: bool = False) -> DataFrame:
    return embed(queries, embedder, F.col(text), "query", task_types, out="vector")


def candidates(
    queries: DataFrame, kb: KnowledgeBase, width: int, params: Params, hybrid: bool, dense: DataFrame, rows: int
) -> DataFrame:
    """Ranked candidates with chunk columns, ``distance`` and (hybrid) ``score``.

    ``queries`` has ``query_id, text, vector``; ``dense`` is their dense ranking of ``rows`` rows.
    """
    if not hybrid:
        found = dense.withColumn("score", F.lit(None).cast("double"))
        return with_payload(found, kb.chunks.drop("embedding"), rows, params)
    terms, _ = settled(query_terms(queries))
    sparse = ranked_terms(terms, kb.index, kb.counts, width, params)
    if not exclusion_groups(terms).isEmpty():
        sparse = with_exclusions(sparse, queries, terms, kb.index, kb.counts, kb.chunks, width, params)
    sparse, _ = settled(sparse)
    # fused rows are ranked before the payload join, which cannot change their order
    fused, rows = settled(take_best(reciprocal_rank_fusion(dense, sparse, params.rrf_k), width))
    return with_distance(fused, queries, kb.chunks, rows, params)


def retrieve(
    queries: DataFrame,
    kb: KnowledgeBase,
    embedder: Embedder,
    params: Params = Params(),
    k: int | None = None,
    hybrid: bool | None = None,
    task_types: bool = False,
    approximate: bool = False,
) -> DataFrame:
    """Answer every query with its ``k`` most relevant chunks.

    In: ``query_id, text``. Out: ``query_id, rnk, id, doc_title, category,
    source_url, content, distance, score, hybrid``. ``hybrid`` says which way
    ran: without a lexeme index the dense ranking answers alone. ``approximate``
    takes the dense ranking from the inverted file, if there is one; the
    distances of what is returned are exact either way.
    """
    ways = [params.hybrid if hybrid is None else hybrid]
    return next(retrieve_ways(queries, kb, embedder, params, k, ways, task_types, approximate))


def retrieve_ways(
    queries: DataFrame,
    kb: KnowledgeBase,
    embedder: Embedder,
    params: Params = Params(),
    k: int | None = None,
    ways: Sequence[bool] = (False, True),
    task_types: bool = False,
    approximate: bool = False,
) -> Iterator[DataFrame]:
    """``retrieve`` for every ``hybrid`` of ``ways``; query vectors and the dense ranking are computed once."""
    k = params.top_k if k is None else k
    width = max(params.candidate_k, k)
    vectors, _ = settled(embed_queries(queries.select("query_id", "text"), embedder, task_types=task_types))
    # a ranking holds at most ``width`` rows a query; settled, it is read from here on
    if approximate and kb.cells is not None:
        near = cell_topk(vectors, kb.cells, width, params.probe_share, params)
    else:
        near = dense_topk(vectors, kb.chunks, width, params)
    dense, rows = settled(near)
    for wanted in ways:
        hybrid = wanted and kb.index is not None and kb.counts is not None
        ranked = candidates(vectors, kb, width, params, hybrid, dense, rows)
        yield keep_close(ranked, k, params.min_keep, params.max_distance).select(
            "query_id", "rnk", "id", "doc_title", "category", "source_url", "content",
            "distance", "score", F.lit(hybrid).alias("hybrid"),
        )


def multi_requirement_retrieve(
    texts: DataFrame,
    sub_queries: DataFrame,
    kb: KnowledgeBase,
    embedder: Embedder,
    params: Params = Params(),
    hybrid: bool | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Answer long texts by the whole text plus each of its sub-queries.

    ``texts``: ``group_id, text``; ``sub_queries``: ``group_id, list_no`` (from
    1), ``text``. All lists run as one retrieval job and interleave; list 0 is
    the text cut to ``fit_embed_chars``. Without sub-queries it stands alone.
    """
    whole = texts.select("group_id", F.lit(0).alias("list_no"),
                         F.substring("text", 1, params.fit_embed_chars).alias("text"))
    lists = whole.unionByName(sub_queries.select("group_id", "list_no", "text"))
    asked = lists.select(F.struct("group_id", "list_no").alias("_key"), "text")
    keyed = asked.select(F.to_json("_key").alias("query_id"), "_key", "text")
    found = retrieve(keyed, kb, embedder, params, params.fit_top_k, hybrid, approximate=approximate)
    key_type = keyed.schema["_key"].dataType
    placed = found.withColumn("_key", F.from_json("query_id", key_type)).select(
        F.col("_key.group_id").alias("group_id"), F.col("_key.list_no").alias("list_no"),
        *[c for c in found.columns if c != "query_id"],
    )
    return round_robin(placed, params.fit_top_k)
