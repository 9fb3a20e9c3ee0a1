"""Loads that embed only what is new, and promotions that have to be earned."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ragloom.operators.chunking import embedding_input
from ragloom.operators.embedding import VectorStore, embed_stored
from ragloom.plans.promotion import guarded_promotion
from ragloom.plans.retrieve import retrieve_ways
from ragloom.session import one_row, scratch_path
from ragloom.sources.tables import full_reload
from workload.evaluation import TRUTH, labelled, truth
from workload.registry import query
from workload.retrieval import six
from workload.sqlparts import sql
from workload.tables import EMBEDDER, PARAMS, knowledge_base, web_queries

L = F.col


@query(sql("""
  SELECT (SELECT count(DISTINCT input) FROM inputs) AS first_load, count(DISTINCT input) AS second_load, count(*) AS changed,
         (SELECT count(*) FROM inputs) AS chunks, 0::BIGINT AS differing
  FROM (SELECT replace(input, chr(10) || chr(10), chr(10) || chr(10) || 'changed ') AS input FROM inputs WHERE id % 100 = 0)"""))
def embed_by_content(spark, sf_dir):
    """All chunks embedded into an empty store; then again, with one in a hundred changed."""
    store = VectorStore(scratch_path(spark, "vectors"), "hashing")
    chunks = knowledge_base(spark, sf_dir).chunks
    text = embedding_input(L("doc_title"), L("category"), L("content"))
    first, n_first = embed_stored(chunks.withColumn("input", text), EMBEDDER, L("input"), store, out="found")
    changed = F.when(L("id") % 100 == 0, F.replace(text, F.lit("\n\n"), F.lit("\n\nchanged "))).otherwise(text)
    second, n_second = embed_stored(chunks.withColumn("input", changed), EMBEDDER, L("input"), store, out="found")
    differing = first.unionByName(second.filter("id % 100 != 0")).filter(L("found") != L("embedding"))
    return one_row(
        second.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(L("id") % 100 == 0).alias("changed")),
        differing.agg(F.count(F.lit(1)).alias("differing")),
    ).select(F.lit(n_first).cast("long").alias("first_load"), F.lit(n_second).cast("long").alias("second_load"), "changed", "chunks", "differing")


_LIVE = """
  (SELECT recall FROM dense_scores WHERE cls = 'overall') AS live_dense, (SELECT recall FROM hybrid_scores WHERE cls = 'overall') AS live_hybrid, (SELECT count(*) FROM chunks) AS n,
  (SELECT avg((query_id NOT IN (SELECT query_id FROM hybrid_titles WHERE distance <= {far}))::INT) FROM negatives) AS rejection""".format(far=PARAMS.max_distance)


@query(sql("""
  SELECT 'worse' AS attempt, live_dense = 0 AND live_hybrid = 0 AS promoted, 0::DOUBLE AS recall_dense, 0::DOUBLE AS recall_hybrid,
         round(rejection, 6) AS rejection, CASE WHEN live_dense = 0 AND live_hybrid = 0 THEN n ELSE 0 END AS renamed FROM live_scores
  UNION ALL SELECT 'as good', live_hybrid >= live_dense, round(live_dense, 6), round(live_hybrid, 6), round(rejection, 6),
         CASE WHEN live_hybrid >= live_dense THEN n ELSE 0 END FROM live_scores""", live_scores=f"SELECT {_LIVE}", **TRUTH))
def guarded_promote(spark, sf_dir):
    """A shadow without titles is refused, one with titles in capitals takes over."""
    kb = knowledge_base(spark, sf_dir)
    texts = web_queries(spark, sf_dir)
    found = truth(spark, sf_dir)
    known = labelled(spark, sf_dir, found).join(texts, "query_id")
    negatives = found.filter("expect IS NULL").select("query_id").join(texts, "query_id")

    def answer(chunks, queries):
        dense, hybrid = retrieve_ways(queries, replace(kb, chunks=chunks), EMBEDDER, PARAMS)
        return dense, hybrid

    full_reload(kb.chunks, "chunks_guarded")
    rows, seen = [], {}
    for attempt, title in (("worse", F.lit("untitled")), ("as good", F.upper("doc_title"))):
        full_reload(kb.chunks.withColumn("doc_title", title), "chunks_candidate")
        made = guarded_promotion(spark, "chunks_candidate", "chunks_guarded", known, negatives, answer, PARAMS.max_distance, known=seen)
        renamed = spark.table("chunks_guarded").filter((L("doc_title") == F.upper("doc_title")) | (L("doc_title") == "untitled")).count()
        rows.append((attempt, made.promoted, made.shadow.recall_dense, made.shadow.recall_hybrid, made.shadow.rejection, renamed))
    kind = "attempt string, promoted boolean, recall_dense double, recall_hybrid double, rejection double, renamed long"
    return spark.createDataFrame(rows, kind).select("attempt", "promoted", *six("recall_dense", "recall_hybrid", "rejection"), "renamed")
