"""Vectors by content, leases, and promotions that have to be earned."""

import pytest
from pyspark.sql import functions as F

from ragloom import Params
from ragloom.operators.embedding import HashingEmbedder, ModelEmbedder, VectorStore, embed_stored
from ragloom.plans.ingest import build_knowledge_base
from ragloom.plans.promotion import Scores, compared, guarded_promotion
from ragloom.session import scratch_path
from ragloom.sources.tables import current_version, full_reload, promote, reading

EMB = HashingEmbedder(32)


def vectors(df):
    return {r["id"]: list(r["embedding"]) for r in df.collect()}


def test_only_new_inputs_are_embedded(spark):
    store = VectorStore(scratch_path(spark, "store"), "m1")
    rows = spark.range(200).select("id", F.concat(F.lit("text "), F.col("id") % 100).alias("t"), F.lit(0).alias("digest"))
    first, n = embed_stored(rows, EMB, F.col("t"), store)
    assert n == 100 and first.count() == 200 and first.columns == ["id", "t", "digest", "embedding"]
    changed = rows.withColumn("t", F.when(F.col("id") == 7, "new").when(F.col("id") == 8, None).otherwise(F.col("t")))
    second, n = embed_stored(changed, EMB, F.col("t"), store)
    assert n == 2  # one in a hundred, and the null
    plain = vectors(changed.withColumn("embedding", EMB.vector(F.col("t"))))
    assert vectors(second) == plain
    assert embed_stored(changed, EMB, F.col("t"), store)[1] == 0
    # another model or another role shares nothing
    assert embed_stored(rows, EMB, F.col("t"), VectorStore(store.path, "m2"))[1] == 100
    assert embed_stored(rows, EMB, F.col("t"), store, "query", True)[1] == 100
    assert embed_stored(rows.filter("false"), EMB, F.col("t"), store)[1] == 0


def test_a_failing_embedder_stores_nothing(spark):
    store = VectorStore(scratch_path(spark, "store"), "m")
    bad = ModelEmbedder(lambda: lambda texts, role: [[0.0]] * len(texts), 4)
    with pytest.raises(Exception):
        embed_stored(spark.range(3).withColumn("t", F.lit("x")), bad, F.col("t"), store)
    assert store.read(spark).count() == 0


def test_a_reload_embeds_what_changed(spark):
    store, params = VectorStore(scratch_path(spark, "store"), "m"), Params()
    arts = spark.range(100).select(F.col("id").alias("i"), F.concat(F.lit("T"), "id").alias("title"), F.lit(None).cast("string").alias("category"),
                                   F.lit(None).cast("string").alias("source_url"), F.concat(F.lit("body "), "id").alias("body"))
    build_knowledge_base(arts, ["i"], EMB, params, lexical=False, store=store)
    before = store.read(spark).count()
    kb = build_knowledge_base(arts.withColumn("body", F.when(F.col("i") == 3, "other").otherwise(F.col("body"))), ["i"], EMB, params, lexical=False, store=store)
    assert (before, store.read(spark).count(), kb.chunks.count()) == (100, 101, 100)


def test_a_version_is_held_while_it_is_read(spark):
    where = scratch_path(spark, "tables")
    full_reload(spark.range(3), "l_live", where)
    with reading(spark, "l_live") as outer, reading(spark, "l_live") as inner:
        full_reload(spark.range(5), "l_live", where)
        assert outer.version == inner.version != current_version(spark, "l_live")
        assert outer.rows.count() == 3 and spark.table("l_live").count() == 5
    assert not spark.catalog.tableExists(outer.version)
    with reading(spark, "l_live", seconds=-1) as gone:  # a lease that ran out holds nothing
        full_reload(spark.range(7), "l_live", where)
        assert not spark.catalog.tableExists(gone.version)
    assert spark.table("l_live").count() == 7


def test_compared():
    good = Scores(0.5, 0.6, 0.4, 0.5, 1.0)
    assert compared(None, good) == () == compared(good, good)
    assert compared(None, Scores(0.7, 0.6, 0, 0, 0)) == ("hybrid recall below dense recall",)
    assert compared(good, Scores(0.5, 0.55, 0.4, 0.5, 0.9)) == ("recall_hybrid below live", "rejection below live")
    assert compared(good, Scores(0.5, 0.55, 0.4, 0.5, 0.9), tolerance=0.1) == ()


def test_a_worse_shadow_is_refused(spark):
    where = scratch_path(spark, "tables")
    rows = spark.createDataFrame([(i, f"title {i}") for i in range(6)], "id long, doc_title string")
    labelled = spark.createDataFrame([(i, "c", [f"title {i}"], f"q{i}") for i in range(6)], "query_id long, cls string, expect array<string>, text string")
    negatives = spark.createDataFrame([(100, "no")], "query_id long, text string")

    def answer(chunks, queries):
        found = queries.join(chunks, queries["query_id"] == chunks["id"]).select("query_id", F.lit(1).alias("rnk"), "doc_title", F.lit(0.1).alias("distance"))
        return found, found

    promote_it = lambda: guarded_promotion(spark, "g_shadow", "g_live", labelled, negatives, answer, 0.5)
    full_reload(rows, "g_shadow", where)
    assert promote_it().promoted and spark.table("g_live").count() == 6  # nothing was live
    full_reload(rows.filter("id < 4"), "g_shadow", where)
    refused = promote_it()
    assert not refused.promoted and "recall_dense below live" in refused.reasons and spark.table("g_live").count() == 6
    full_reload(rows.withColumn("doc_title", F.upper("doc_title")), "g_shadow", where)
    assert promote_it().promoted and spark.table("g_live").first()["doc_title"].startswith("TITLE")
    assert promote(spark, "g_shadow", "g_live").count() == 6
