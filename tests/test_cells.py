"""Search in stored cells against dense_topk, and queries of exclusions alone against plain sets."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragloom import Params
from ragloom.operators.cells import build_cells, cell_search, cell_topk
from ragloom.operators.dense import dense_topk
from ragloom.operators.exclusion import allowed_ids, allowed_topk, bitmap_ids, exclusion_groups, left_out
from ragloom.operators.lexical import query_terms
from ragloom.plans.ingest import with_cells
from ragloom.plans.retrieve import retrieve
from ragloom.session import written
from test_retrieval import EMB, answers, corpus, frames, kb, rows  # noqa: F401

SMALL = Params(cells=12, code_bits=64, cell_rounds=2, slab_rows=60)


def clustered(seed, n, dim=16, clusters=8):
    rnd = np.random.default_rng(seed)
    v = rnd.normal(size=(clusters, dim))[rnd.integers(0, clusters, n)] + 0.35 * rnd.normal(size=(n, dim))
    v[: n // 3] = v[0]  # one vector holds a third of all rows
    v[n // 3] = 0
    return np.round(v, 3)


@pytest.fixture(scope="module")
def index(spark):
    _, chunks = frames(spark, clustered(1, 1), clustered(2, 600))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one file
    made = build_cells(chunks, SMALL)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return chunks, made


def test_every_vector_is_stored_once_and_a_hot_cell_in_parts(spark, index):
    chunks, made = index
    assert made.sizes.sum() == 600 and made.sizes.max() >= 200
    assert sorted(r["id"] for r in made.vectors.select("id").collect()) == list(range(600))
    hot = made.vectors.filter(F.col("cell") == int(made.sizes.argmax()))
    assert hot.select(F.input_file_name()).distinct().count() > 1
    assert len(made.centres) >= 12 and (made.reach <= np.pi).all()


@pytest.mark.parametrize("params", [SMALL, SMALL.but(query_block=7)])
def test_exact_search_equals_dense(spark, index, params):
    chunks, made = index
    queries, _ = frames(spark, np.vstack([clustered(3, 20), np.zeros((1, 16))]), np.zeros((1, 16)))
    assert rows(cell_topk(queries, made, 9, None, params)) == rows(dense_topk(queries, chunks, 9))


def test_approximate_search_finds_nearly_all_and_measures_little(spark, index):
    chunks, made = index
    queries, _ = frames(spark, clustered(2, 600)[250:290], np.zeros((1, 16)))
    found, counts = cell_search(queries, made, 5, 0.2, SMALL)
    exact = {(a, b) for a, b, _, _ in rows(dense_topk(queries, chunks, 5))}
    seen = {(a, b): d for a, b, d, _ in rows(found)}
    assert len(exact & set(seen)) >= 0.9 * len(exact)
    count = counts.head()
    assert count["pairs"] == 40 * 600 and count["measured"] <= count["scanned"] and count["measured"] < 0.3 * count["pairs"]
    every = {(a, b): d for a, b, d, _ in rows(dense_topk(queries, chunks, 600))}
    assert all(every[pair] == d for pair, d in seen.items())


def test_only_probed_cells_are_read(spark, index):
    from ragloom.operators.cells import Asked, _scan, codes

    _, made = index
    wanted = np.zeros((1, len(made.centres)), bool)
    wanted[0, 3] = True
    v = clustered(4, 2)[1:]
    asked = Asked(v, np.linalg.norm(v, axis=1), codes(v, 64), np.zeros_like(wanted, float), wanted, np.full(1, np.inf), np.full(1, 64))
    plan = _scan(made, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "Exchange" not in plan


def test_nothing_stored_and_nothing_asked(spark, index):
    none = build_cells(spark.createDataFrame([], "id long, embedding array<float>"), SMALL)
    queries, _ = frames(spark, clustered(3, 2), np.zeros((1, 16)))
    assert cell_topk(queries, none, 3, 0.5, SMALL).count() == 0
    assert cell_topk(queries.filter("false"), index[1], 3, 0.5, SMALL).count() == 0


def test_many_queries_shuffle_no_vector(spark):
    queries, chunks = frames(spark, clustered(5, 30), clustered(6, 200))
    params = Params(query_block=4, slab_rows=50)
    assert rows(dense_topk(queries, chunks, 4, params)) == rows(dense_topk(queries, chunks, 4))
    from ragloom.operators.dense import Best, _partial, _stacked

    sent = spark.sparkContext.broadcast(_stacked(queries.collect()))
    stored = written(chunks, "vectors")
    plan = _partial(stored, sent, 30, 4, Best.scan_batch, np.full(30, 0.5))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_a_send_holds_many_blocks_and_copies_are_measured_once(spark, monkeypatch):
    from ragloom.operators import dense

    v = clustered(7, 900, dim=8)
    v[300:600] = v[301]  # another crowd of copies
    queries, chunks = frames(spark, v, v)
    want = rows(dense_topk(queries, chunks, 5))
    units = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    away = np.where((np.linalg.norm(v, axis=1) > 0)[:, None] & (np.linalg.norm(v, axis=1) > 0)[None, :], np.round(1 - units @ units.T, 9) + 0.0, np.inf)
    assert [r[:2] for r in want] == [(q, int(i)) for q in range(900) for i in sorted(sorted(range(900), key=lambda i: (away[q, i], i))[:5])]
    jobs = []
    monkeypatch.setattr(dense, "written", lambda df, label, *a: jobs.append(label) or written(df, label, *a))
    # 225 blocks of four in one send, a sample of a few rows for the bounds, the vectors dealt out evenly
    monkeypatch.setattr(dense, "SPREAD_PAIRS", 1000)
    assert rows(dense_topk(queries, chunks, 5, Params(query_block=4, slab_rows=20))) == want
    assert jobs == ["spread", "nearest"]


def test_missing_vectors_and_other_widths_are_no_matrix():
    from ragloom.operators.dense import matrix

    kind = pa.list_(pa.float32())
    assert matrix(pa.array([[1, 2], [3, 4]], kind)).tolist() == [[1, 2], [3, 4]] and len(matrix(pa.array([], kind))) == 0
    for bad in ([[1, 2], None, [3, 4], None], [[1], [2, 3, 4]]):
        with pytest.raises(ValueError):
            matrix(pa.array(bad, kind))


def test_bounds_of_the_scan_hold_back_no_pair():
    from ragloom.operators.dense import Best, Queries

    rnd = np.random.default_rng(8)
    v = np.round(rnd.normal(size=(3000, 6)), 1)  # many ties
    asked, best = Queries(v[:200]), Best(200, 4)
    asked.vectors[3] = 0
    measured = []
    offer_pairs = best.offer_pairs
    best.offer_pairs = lambda q, *rest: measured.append(len(q)) or offer_pairs(q, *rest)
    for lo in range(0, 3000, 500):
        best.scan(np.arange(lo, lo + 500), v[lo : lo + 500], asked)
    got = best.batch()
    assert sum(measured) < 0.1 * 200 * 3000
    length = np.linalg.norm(v, axis=1)
    for q in range(200):
        s = np.outer(length[q : q + 1], length)[0]
        d = np.where(s > 0, np.round(1 - np.divide(v @ v[q], s, out=np.zeros(3000), where=s > 0), 9) + 0.0, np.inf)
        assert [i for n, i in zip(got["_q"].to_pylist(), got["id"].to_pylist(), strict=True) if n == q] == sorted(range(3000), key=lambda i: (d[i], i))[:4]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables not here")
@pytest.mark.parametrize("name", ["knn_cells_recall", "retrieve_cells_recall"])
def test_recall_on_the_tables(spark, name):
    from workload import load

    found = load().QUERIES[name](spark, "/root/testdata/sf0.001").head()
    assert found["recall"] >= 0.9 and found["measured"] < 0.3 * found["pairs"]


def test_retrieve_from_cells(spark, kb):  # noqa: F811
    stored = with_cells(kb, Params(cells=6, code_bits=64))
    assert answers(spark, stored, approximate=True, params=Params(probe_share=1.0, code_bits=64, code_slack=99.0)) == answers(spark, kb)
    assert answers(spark, kb, approximate=True) == answers(spark, kb)


# --- exclusions -----------------------------------------------------------------

ASKED = {1: "-lock", 2: "-lock or -row", 3: '-"bulk guide"', 4: "-lock -row", 5: "-unknownword", 6: "row or -test", 7: "row -lock"}


def holds(doc, text):
    from test_retrieval import occurrences

    found = {}
    for t, p, _ in occurrences(doc):
        found.setdefault(t, set()).add(p)
    words = text.strip('"').split()
    return all(w in found for w in words) and (len(words) == 1 or any(p + 1 in found[words[1]] for p in found[words[0]]))


ALLOWED = {
    1: lambda d: not holds(d, "lock"), 2: lambda d: not (holds(d, "lock") and holds(d, "row")), 3: lambda d: not holds(d, '"bulk guide"'),
    4: lambda d: not holds(d, "lock") and not holds(d, "row"), 5: lambda d: True, 6: lambda d: not holds(d, "test"),
}


def test_allowed_ids_and_their_ranking(spark):
    docs, index, counts = corpus(spark)
    docs = [d for d in docs if d[0] != 0]
    chunks = spark.createDataFrame([(d[0], [float(d[0] % 7), 1.0, float(d[0] % 3)]) for d in docs], "id long, embedding array<float>")
    terms = query_terms(spark.createDataFrame(list(ASKED.items()), "query_id long, text string"))
    groups = exclusion_groups(terms)
    out = left_out(terms, index, counts).cache()
    found = allowed_ids(groups, out, chunks).select("query_id", F.explode(bitmap_ids("part", "ids")).alias("id")).collect()
    want = {q: {d[0] for d in docs if f(d)} for q, f in ALLOWED.items()}
    assert {q: {r["id"] for r in found if r["query_id"] == q} for q in want} == want
    queries = groups.select("query_id", F.array(F.lit(1.0), F.lit(2.0), F.lit(0.5)).alias("vector")).distinct()
    every = {(a, b): d for a, b, d, _ in rows(dense_topk(queries, chunks, 200))}
    best = sorted((q, i, every[q, i], n + 1) for q, ids in want.items() for n, i in enumerate(sorted(ids, key=lambda i: (every[q, i], i))[:6]))
    for params in (Params(), Params(broadcast_bytes=0)):
        assert rows(allowed_topk(queries, out, chunks, 6, params)) == best
    assert allowed_topk(queries.filter("false"), out, chunks, 6).count() == 0


def test_bitmaps_are_unfolded_a_few_at_a_time(spark, monkeypatch):
    from ragloom.operators import exclusion

    sets = spark.range(-70000, 70000, 3).select((F.col("id") % 5).alias("query_id"), F.col("id").alias("v")).groupBy(
        "query_id", F.bitmap_bucket_number("v").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("ids"))
    found = exclusion.bitmap_rows(sets)
    assert found.columns == ["query_id", "part", "id"]
    want = sets.select("query_id", "part", F.explode(bitmap_ids("part", "ids")).alias("id"))
    assert want.count() == found.count() == len(range(-70000, 70000, 3)) and found.exceptAll(want).isEmpty()
    monkeypatch.setattr(exclusion, "UNFOLDED", 1)
    assert exclusion.bitmap_rows(sets).exceptAll(want).isEmpty()


def test_cosines_to_centres_are_held_a_few_rows_at_a_time(monkeypatch):
    from ragloom.operators import cells

    v = cells.unit(clustered(9, 500))
    centres = cells.unit(clustered(10, 40))
    whole = cells.similarities(v, centres)
    seen = []
    similarities = cells.similarities
    monkeypatch.setattr(cells, "CELLS", 1000)
    monkeypatch.setattr(cells, "similarities", lambda u, c: seen.append(len(u) * len(c)) or similarities(u, c))
    cell, near = cells.nearest_centre(v, centres)
    assert max(seen) <= 1000 and (cell == whole.argmax(axis=1)).all() and (near == whole.max(axis=1)).all()
    assert [len(x) for x in cells.nearest_centre(v[:0], centres)] == [0, 0]


def test_codes_are_looked_at_where_a_distance_counts(spark, index):
    queries, _ = frames(spark, np.vstack([clustered(2, 600)[250:320], np.zeros((1, 16))]), np.zeros((1, 16)))
    for k in (5, 40):
        found, counts = cell_search(queries, index[1], k, 0.5, SMALL)
        assert rows(cell_topk(queries, index[1], k, 0.5, SMALL)) == rows(found) and counts.head()["measured"] > 0


def test_exclusions_in_retrieval(spark, kb):  # noqa: F811
    queries = spark.createDataFrame([(1, "-lock"), (2, "deploy or -guide"), (3, "the of")], "query_id long, text string")
    found = retrieve(queries, kb, EMB, k=4).collect()
    texts = {q: [r["content"].split() for r in found if r["query_id"] == q] for q in (1, 2, 3)}
    assert len(texts[1]) == 4 and sum("lock" in t for t in texts[1]) < 4
    assert any("deploy" in t for t in texts[2])
