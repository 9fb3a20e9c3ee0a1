import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom import Params
from ragloom.operators.chunking import embedding_input, in_order, number_rows, pack_chunks
from ragloom.operators.embedding import HashingEmbedder, ModelEmbedder, checked_width, embed, split_by_width
from ragloom.functions.vectors import is_width
from ragloom.operators.lexical import _in_order, packed_postings, postings, stored_postings, term_counts, unpacked
from ragloom.plans.ingest import build_knowledge_base


def packed_by_loop(paras, limit):
    out, cur = [], ""
    for p in paras:
        if cur and len(cur) + len(p) + 2 > limit:
            out.append(cur)
            cur = ""
        cur = f"{cur}\n\n{p}" if cur else p
    return out + [cur] if cur else out


def test_packing_equals_a_loop(spark):
    rnd = random.Random(1)
    docs = [["x" * rnd.randint(1, 60) for _ in range(rnd.randint(0, 30))] for _ in range(60)]
    docs.append(["y" * 500, "z"])
    bodies = [(i, "\n \t\n".join(f"  {p} " for p in d)) for i, d in enumerate(docs)]
    got = pack_chunks(spark.createDataFrame(bodies, "i int, body string"), Params(chunk_max_chars=80))
    chunks = {}
    for r in got.orderBy("i", "chunk_no").collect():
        chunks.setdefault(r["i"], []).append(r["content"])
    assert [chunks.get(i, []) for i in range(len(docs))] == [packed_by_loop(d, 80) for d in docs]
    assert all(len(c) <= 80 or "\n\n" not in c for cs in chunks.values() for c in cs)


def test_packing_needs_no_shuffle(spark):
    plan = pack_chunks(spark.createDataFrame([("a",)], "body string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_dense_ids_over_many_partitions(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(13)
    got = number_rows(in_order(rows, ["k"])).collect()
    assert sorted((r["id"], r["k"]) for r in got) == [(i + 1, i) for i in range(5000)]


@pytest.mark.parametrize("category, want", [(None, "T\n\nc"), ("", "T\n\nc"), ("K", "T — K\n\nc")])
def test_embedding_input(one, category, want):
    assert one(embedding_input(F.col("t"), F.col("k"), F.col("c")), t="T", k=category, c="c") == want


def test_hashing_embedder(spark):
    df = spark.createDataFrame([(0, "b a a"), (1, "a b a!"), (2, "..."), (3, None)], "i int, t string")
    got = [np.array(r["embedding"]) for r in embed(df, HashingEmbedder(32), F.col("t")).orderBy("i").collect()]
    assert np.array_equal(got[0], got[1]) and abs(np.linalg.norm(got[0]) - 1) < 1e-6
    assert not got[2].any() and not got[3].any()


def test_model_embedder_and_roles(spark):
    df = spark.createDataFrame([("abc",)], "t string")
    load = lambda: lambda texts, role: np.array([[len(t), 1.0 if role == "query" else 0.0] for t in texts])
    model = ModelEmbedder(load, 2)
    assert embed(df, model, F.col("t"), "query", task_types=True).head()["embedding"] == [3.0, 1.0]
    assert embed(df, model, F.col("t"), "query").head()["embedding"] == [3.0, 0.0]
    with pytest.raises(ValueError):
        embed(df, model, F.col("t"), "other")


def test_incomplete_batch_fails(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)
    short = ModelEmbedder(lambda: lambda texts, role: np.zeros((1, 2)), 2)
    with pytest.raises(Exception, match="embedder gave"):
        embed(df, short, F.col("t")).collect()


def test_width(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, None])], "i int, embedding array<float>")
    ok, bad = split_by_width(df, 2)
    assert [r["i"] for r in ok.collect()] == [1] and {r["i"] for r in bad.collect()} == {2, 3, 4}
    with pytest.raises(Exception, match="not 2 wide"):
        checked_width(df, 2).collect()


def test_knowledge_base(spark):
    articles = spark.createDataFrame(
        [("b.md", "B", None, None, "one\n\ntwo"), ("a.md", "A", "k", "u", "three")],
        "path string, title string, category string, source_url string, body string")
    kb = build_knowledge_base(articles, ["path"], HashingEmbedder(8), Params(chunk_max_chars=4))
    got = [tuple(r) for r in kb.chunks.select("id", "doc_title", "content").orderBy("id").collect()]
    assert got == [(1, "A", "three"), (2, "B", "one"), (3, "B", "two")]
    assert {(r["term"], r["df"]) for r in kb.counts.collect()} == {("b", 2), ("three", 1), ("one", 1), ("two", 1)}


def test_hashing_embedder_equals_a_loop(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["a", "bé", "c3", "Ünd", "日本"]) for _ in range(rnd.randint(0, 9))) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in embed(df, HashingEmbedder(16), F.col("t")).collect():
        want = np.zeros(16)
        for w in r["t"].lower().split():
            code = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            want[(code >> 1) % 16] += 1 - 2 * (code & 1)
        assert np.allclose(r["embedding"], want / (np.linalg.norm(want) or 1))


@pytest.mark.parametrize("batch", [3, 17, 10_000])
def test_stored_index_equals_postings(spark, batch):
    rnd = random.Random(4)
    words = "lock row rows limit queries bulk the of guide".split()
    ids = sorted(rnd.sample(range(1, 200), 90))
    rnd.shuffle(ids[40:50])
    rows = [(i, rnd.choice(["Row locks", "", None]), " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))) for i in ids]
    chunks = spark.createDataFrame(rows, "id bigint, doc_title string, content string").coalesce(2)
    small = Params(id_block=50, term_buckets=3)
    columns = ["bucket", "term", "id", "positions", "titled"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(map(tuple, stored_postings(chunks, params=small).select(columns).collect()))
        assert got == sorted(map(tuple, postings(chunks, params=small).select(columns).collect())) and got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_index_travels_a_row_per_run_of_a_term(spark):
    """Postings of a term in consecutive chunks are shuffled as one row."""
    chunks = spark.range(1, 401, numPartitions=2).selectExpr("id", "'T' AS doc_title", "'lock row' AS content")
    packed = packed_postings(chunks, params=Params(id_block=1000))
    assert packed.count() == 4


def test_index_of_a_knowledge_base_is_stored_packed(spark):
    """A row per term and run of chunks, written where the chunks lie; unpacked it is what ``postings`` gives."""
    rows = [(i, f"T{i}", None, None, f"lock row lock w{i % 3}") for i in range(90)]
    articles = spark.createDataFrame(rows, "i int, title string, category string, source_url string, body string")
    kb = build_knowledge_base(articles, ["i"], HashingEmbedder(8), Params(term_buckets=3))
    columns = ["bucket", "term", "id", "positions", "titled"]
    got = sorted(map(tuple, unpacked(kb.index).select(columns).collect()))
    assert got == sorted(map(tuple, postings(kb.chunks, params=Params(term_buckets=3)).select(columns).collect()))
    assert kb.index.count() < len(got) / 2
    assert sorted(map(tuple, term_counts(kb.index).collect())) == sorted(map(tuple, term_counts(unpacked(kb.index)).collect()))
    plan = packed_postings(kb.chunks)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_postings_keep_their_order_however_wide_the_numbers():
    rnd = np.random.default_rng(6)
    code, row, place = rnd.integers(0, 9, 400), rnd.integers(0, 5, 400), rnd.permutation(400)
    title = rnd.integers(0, 2, 400).astype(bool)
    want = sorted(zip(code.tolist(), row.tolist(), place.tolist(), title.tolist()))
    for far in (1, 1 << 45):  # the second does not fit into one number
        got = _in_order(code, row, place * far, title)
        assert [(c, r, p // far, t) for c, r, p, t in zip(*(x.tolist() for x in got))] == want


def test_width_sees_holes_beside_any_number(spark):
    rows = [([1.0, 2.0],), ([1.0, None],), ([float("nan"), None],), ([float("nan"), 1.0],), ([1.0],), (None,)]
    for kind in ("float", "double"):
        got = [r[0] for r in spark.createDataFrame(rows, f"v array<{kind}>").select(is_width(F.col("v"), 2)).collect()]
        assert got == [True, False, False, True, False, False]
