"""Driver tables in the shapes the toolkit expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom import Params
from ragloom.operators.embedding import HashingEmbedder
from ragloom.plans.ingest import KnowledgeBase, build_knowledge_base

# Fixture documents have no blank lines, so a line is a paragraph. Hashed word
# vectors lie further apart than model vectors, so the threshold is wider.
PARAMS = Params(paragraph_separator="\n", embedding_dim=256, max_distance=0.62)
EMBEDDER = HashingEmbedder(PARAMS.embedding_dim)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as parsed articles: title lang/source/doc_id, category source."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat_ws("/", "lang", "source", "doc_id").alias("title"),
        F.col("source").alias("category"),
        F.lit(None).cast("string").alias("source_url"),
        F.col("text").alias("body"),
    )


def web_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as web-style queries: any of their sentences may match."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.regexp_replace("text", r"[.,\n]+ *", " or ").alias("text"),
    )


_built: dict[tuple[str, str], KnowledgeBase] = {}


def knowledge_base(spark: SparkSession, sf_dir: str) -> KnowledgeBase:
    """Documents ingested once per session, then read by every retrieval query."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = build_knowledge_base(articles(spark, sf_dir), ["doc_id"], EMBEDDER, PARAMS)
    return _built[key]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with the role names the validator knows."""
    role = F.when(F.col("role") == "assistant", "model").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").withColumn("role", role)
