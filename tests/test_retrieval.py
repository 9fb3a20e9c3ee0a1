import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom import Params
from ragloom.functions.text import STOP_WORDS
from ragloom.operators import lexical
from ragloom.operators.dense import approximate_topk, dense_topk, plane_code
from ragloom.operators.embedding import HashingEmbedder
from ragloom.operators.fusion import keep_close, reciprocal_rank_fusion, round_robin, weak_match
from ragloom.operators.lexical import cover_rank, match_terms, postings, query_terms, ranked_terms, sparse_topk, term_counts
from ragloom.plans.ingest import KnowledgeBase, build_knowledge_base
from ragloom.plans.retrieve import multi_requirement_retrieve, retrieve


# --- dense --------------------------------------------------------------------

def vectors(seed, n, dim=6):
    rnd = np.random.default_rng(seed)
    v = rnd.integers(-2, 3, (n, dim)).astype(float)
    v[n // 2:] = v[: n - n // 2]  # copies, hence equal distances
    v[0] = 0
    return v


def brute(qs, cs, k):
    out = []
    for qi, q in enumerate(qs):
        rows = []
        for ci, c in enumerate(cs):
            scale = np.linalg.norm(q) * np.linalg.norm(c)
            rows.append((round(1 - q @ c / scale, 9) if scale else np.inf, ci))
        out += [(qi, ci, None if d == np.inf else d, r + 1) for r, (d, ci) in enumerate(sorted(rows)[:k])]
    return out


def frames(spark, qs, cs, parts=3):
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)], "query_id bigint, vector array<float>")
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cs)], "id bigint, embedding array<float>")
    return q, c.repartition(parts)


def rows(df):
    return sorted((r["query_id"], r["id"], r["distance"], r["rnk"]) for r in df.collect())


@pytest.mark.parametrize("params", [Params(), Params(query_block=5, slab_rows=40)])
def test_dense_topk_equals_brute_force(spark, params):
    qs, cs = vectors(1, 12), vectors(2, 160)
    got = dense_topk(*frames(spark, qs, cs), 7, params)
    want = sorted(brute(qs, cs, 7))
    assert [(a, b, r) for a, b, _, r in rows(got)] == [(a, b, r) for a, b, _, r in want]
    assert [d for *_, d, _ in rows(got)] == pytest.approx([d for *_, d, _ in want], nan_ok=True)


def test_dense_topk_with_fewer_chunks_than_k_or_no_queries(spark):
    qs, cs = vectors(1, 3), vectors(2, 4)
    assert rows(dense_topk(*frames(spark, qs, cs), 9)) == sorted(brute(qs, cs, 9))
    q, c = frames(spark, qs, cs)
    assert dense_topk(q.filter("false"), c, 3).count() == 0


def test_approximate_is_exact_over_what_it_probes(spark):
    rnd = np.random.default_rng(3)
    qs, cs = rnd.normal(size=(5, 8)), rnd.normal(size=(300, 8))
    q, c = frames(spark, qs, cs)
    coded = c.withColumn("code", plane_code(F.col("embedding"), 4, 8))
    assert rows(approximate_topk(q, coded, 4, 4, radius=4)) == rows(dense_topk(q, c, 4))
    near = {(r["query_id"], r["id"]) for r in approximate_topk(q, coded, 4, 4, radius=1).collect()}
    assert len(near) == 20
    grid = Params(query_block=2, slab_rows=70)
    assert rows(approximate_topk(q, coded, 4, 4, 1, grid)) == rows(approximate_topk(q, coded, 4, 4, 1))


def test_dense_plan_limits_before_the_shuffle(spark):
    q, c = frames(spark, vectors(1, 3), vectors(2, 20))
    plan = dense_topk(q, c, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# --- lexical ------------------------------------------------------------------

TITLES = ["Row locks", "Limits and queries", "The bulk guide", "of the and", None]
WORDS = "lock row rows limit limits query bulk the of guide deploy test".split()


def corpus(spark, n=120):
    rnd = random.Random(5)
    docs = [(i, rnd.choice(TITLES), " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 14)))) for i in range(n)]
    chunks = spark.createDataFrame(docs, "id bigint, doc_title string, content string")
    index = postings(chunks)
    return docs, index, term_counts(index)


def stem(w):
    if w.endswith("ies") and not w.endswith(("eies", "aies")):
        return w[:-3] + "y"
    if w.endswith("es") and not w.endswith(("aes", "ees", "oes")):
        return w[:-1]
    return w[:-1] if w.endswith("s") and not w.endswith(("us", "ss")) else w


def tokens(text, shift=0, weight=1.0):
    found = re.findall(r"[^\W_]+", (text or "").lower())
    return [(stem(w), i + 1 + shift, weight) for i, w in enumerate(found) if w not in STOP_WORDS]


def occurrences(doc):
    title = tokens(doc[1])
    return title + tokens(doc[2], max([p for _, p, _ in title], default=0), 0.4)


def naive_group(occ, group):
    """(matches, score) of one alternative: words, phrases, exclusions."""
    at = {}
    for t, p, _ in occ:
        at.setdefault(t, set()).add(p)

    def holds(terms, adjacent):
        if not adjacent:
            return all(t in at for t, _ in terms)
        return any(all(p + off - terms[0][1] in at.get(t, ()) for t, off in terms) for p in at.get(terms[0][0], ()))

    wanted = set()
    for negated, adjacent, terms in group:
        if not terms:
            continue
        if holds(terms, adjacent) == negated:
            return False, 0.0
        if not negated:
            wanted |= {t for t, _ in terms}
    if not wanted:
        return False, 0.0
    mine = sorted((p, t, w) for t, p, w in occ if t in wanted)
    covers = {}
    for j in range(len(mine)):
        last = {t: p for p, t, _ in mine[: j + 1]}
        if len(last) == len(wanted):
            covers.setdefault(min(last.values()), mine[j][0])
    score = 0.0
    for p, q in covers.items():
        inside = [w for pos, _, w in mine if p <= pos <= q]
        score += (len(inside) / sum(1 / w for w in inside)) / (1 + (q - p) - (len(inside) - 1))
    return True, score


QUERIES = {
    1: ("row lock", [[(False, False, [("row", 0)]), (False, False, [("lock", 0)])]]),
    2: ("limits", [[(False, False, [("limit", 0)])]]),
    3: ('"bulk guide" or deploy test', [[(False, True, [("bulk", 0), ("guide", 1)])],
                                        [(False, False, [("deploy", 0)]), (False, False, [("test", 0)])]]),
    4: ("query -lock", [[(False, False, [("query", 0)]), (True, False, [("lock", 0)])]]),
    5: ('guide -"row lock"', [[(False, False, [("guide", 0)]), (True, True, [("row", 0), ("lock", 1)])]]),
    6: ("the of and", [[]]),
    7: ("unknownword row", [[(False, False, [("unknownword", 0)]), (False, False, [("row", 0)])]]),
    8: ("row row ROWS", [[(False, False, [("row", 0)])]]),
    9: ('"lock the row"', [[(False, True, [("lock", 0), ("row", 2)])]]),
    10: ("bulk row test limit", [[(False, False, [(t, 0)]) for t in ("bulk", "row", "test", "limit")]]),
    11: ("-lock", [[(True, False, [("lock", 0)])]]),
    12: ("", [[]]),
}


@pytest.mark.parametrize("pass_terms", [200_000, 8])
def test_matching_and_ranking_equal_a_naive_scan(spark, pass_terms):
    docs, index, counts = corpus(spark)
    asked = spark.createDataFrame([(i, t) for i, (t, _) in QUERIES.items()], "query_id bigint, text string")
    params = Params(pass_terms=pass_terms)  # few terms at a time take several passes
    terms = query_terms(asked)
    ranks = cover_rank(match_terms(terms, index, counts, params))
    got = {(r["query_id"], r["id"]): r["score"] for r in ranks.collect()}
    best = {(r["query_id"], r["id"]): (r["rnk"], r["score"]) for r in ranked_terms(terms, index, counts, 5, params).collect()}
    assert best == {(r["query_id"], r["id"]): (r["rnk"], r["score"]) for r in sparse_topk(ranks, 5).collect()}
    want = {}
    for qid, (_, groups) in QUERIES.items():
        for doc in docs:
            parts = [naive_group(occurrences(doc), g) for g in groups if g]
            if any(ok for ok, _ in parts):
                want[qid, doc[0]] = sum(s for ok, s in parts if ok)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_sparse_ties_fall_to_the_id(spark):
    ranks = spark.createDataFrame([(1, 9, 0.5), (1, 3, 0.5), (1, 4, 0.9)], "query_id bigint, id bigint, score double")
    assert [(r["id"], r["rnk"]) for r in sparse_topk(ranks, 2).orderBy("rnk").collect()] == [(4, 1), (3, 2)]


# --- fusion -------------------------------------------------------------------

def test_rrf(spark):
    d = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id bigint, id bigint, rnk int")
    s = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id bigint, id bigint, rnk int")
    got = {r["id"]: r["score"] for r in reciprocal_rank_fusion(d, s, 60).collect()}
    assert got == {10: 1 / 61, 11: 1 / 62 + 1 / 61, 12: 1 / 62}


def test_keep_close_filters_before_it_cuts(spark):
    far, near = 0.9, 0.1
    ranked = [(1, i, d, i) for i, d in enumerate([far, far, far, far, near, near, near], 1)] + [(2, 1, None, 1), (2, 2, None, 2)]
    df = spark.createDataFrame(ranked, "query_id bigint, id bigint, distance double, rnk int")
    got = [(r["query_id"], r["id"], r["rnk"]) for r in keep_close(df, 5, 3, 0.52).orderBy("query_id", "rnk").collect()]
    assert got == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 5, 4), (1, 6, 5), (2, 1, 1), (2, 2, 2)]
    assert keep_close(df, 2, 3, 0.52).filter("query_id = 1").count() == 2


def test_round_robin_equals_a_loop(spark):
    rnd = random.Random(2)
    data, want = [], set()
    for g in range(40):
        lists = [rnd.sample(range(12), rnd.randint(0, 8)) for _ in range(rnd.randint(1, 5))]
        data += [(g, n, i, r + 1) for n, lst in enumerate(lists) for r, i in enumerate(lst)]
        fused = []
        for rank in range(8):
            for lst in lists:
                if rank < len(lst) and lst[rank] not in fused and len(fused) < 6:
                    fused.append(lst[rank])
        want |= {(g, i, r + 1) for r, i in enumerate(fused)}
    df = spark.createDataFrame(data, "group_id int, list_no int, id int, rnk int")
    assert {(r["group_id"], r["id"], r["rnk"]) for r in round_robin(df, 6).collect()} == want


def test_weak_match(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id bigint")
    found = spark.createDataFrame([(1, 0.6), (1, 0.7), (2, 0.6), (2, 0.1)], "query_id bigint, distance double")
    assert {r["query_id"]: r["weak"] for r in weak_match(queries, found, 0.52).collect()} == {1: True, 2: False, 3: False}


# --- composed -----------------------------------------------------------------

EMB = HashingEmbedder(64)


@pytest.fixture(scope="module")
def kb(spark):
    rnd = random.Random(9)
    arts = [(i, f"T{i}", None, None, " ".join(rnd.choice(WORDS) for _ in range(12))) for i in range(60)]
    df = spark.createDataFrame(arts, "i int, title string, category string, source_url string, body string")
    return build_knowledge_base(df, ["i"], EMB)


def answers(spark, kb, parts=None, **kw):
    q = spark.createDataFrame([(1, "row lock"), (2, "deploy test guide"), (3, "zzz")], "query_id bigint, text string")
    if parts:
        kb = KnowledgeBase(kb.chunks.repartition(parts), kb.index.repartition(parts), kb.counts)
    return sorted(tuple(r) for r in retrieve(q, kb, EMB, **kw).collect())


def test_retrieval_does_not_depend_on_partitioning(spark, kb):
    assert answers(spark, kb) == answers(spark, kb, parts=1) == answers(spark, kb, parts=7)


def test_large_query_sets_give_the_same(spark, kb):
    assert answers(spark, kb) == answers(spark, kb, params=Params(query_block=2, slab_rows=25))


def test_payload_reads_only_blocks_with_hits(spark, kb):
    small = Params(id_block=7)
    arts = spark.range(60).select(F.col("id").alias("i"), F.concat(F.lit("T"), "id").alias("title"), F.lit(None).cast("string").alias("category"),
                                  F.lit(None).cast("string").alias("source_url"), F.concat(F.lit("word"), "id").alias("body"))
    stored = build_knowledge_base(arts, ["i"], EMB, small, lexical=False)
    q = spark.createDataFrame([(1, "word3")], "query_id bigint, text string")
    found = retrieve(q, stored, EMB, small, hybrid=False)
    assert found.orderBy("rnk").first()["doc_title"] == "T3"
    plan = found._jdf.queryExecution().executedPlan().toString()
    pruned = [x for x in re.findall(r"PartitionFilters: \[[^\]]*", plan) if "block" in x]
    assert pruned and all("dynamicpruning" in x for x in pruned), pruned
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fallback_says_so(spark, kb):
    dense_only = answers(spark, KnowledgeBase(kb.chunks))
    assert {r[-1] for r in dense_only} == {False} and dense_only == answers(spark, kb, hybrid=False)
    assert {r[-1] for r in answers(spark, kb)} == {True}


def test_multi_requirement_without_sub_queries_is_the_whole_text(spark, kb):
    texts = spark.createDataFrame([(1, "row lock"), (2, "deploy")], "group_id bigint, text string")
    subs = spark.createDataFrame([(2, 1, "test guide"), (2, 2, "limit")], "group_id bigint, list_no int, text string")
    got = multi_requirement_retrieve(texts, subs, kb, EMB).collect()
    alone = retrieve(texts.withColumnRenamed("group_id", "query_id"), kb, EMB, k=8).collect()
    pick = lambda rs, key, v: [r["id"] for r in sorted(rs, key=lambda r: r["rnk"]) if r[key] == v]
    assert pick(got, "group_id", 1) == pick(alone, "query_id", 1)
    assert len(pick(got, "group_id", 2)) == 8 and {r["list_no"] for r in got if r["group_id"] == 2} == {0, 1, 2}


def test_a_pass_holds_what_may_be_sent(spark):
    """Many queries are one pass while their plan fits, several when it does not; both give the same."""
    _, index, counts = corpus(spark)
    texts = [(i, f'{WORDS[i % 12]} -{WORDS[(i * 5 + 1) % 12]} or "{WORDS[(i * 7) % 12]} {WORDS[(i * 3 + 1) % 12]}"') for i in range(60)] + [(None, "lock row"), (7, "bulk")]
    terms = query_terms(spark.createDataFrame(texts, "query_id int, text string")).cache()
    one, many = Params(pass_terms=8), Params(pass_terms=8, broadcast_bytes=40)
    assert [len(list(lexical._passes(terms, terms.count(), p))) for p in (one, many)] == [1, math.ceil(terms.count() / 8)]
    for answer in (lambda p: match_terms(terms, index, counts, p), lambda p: ranked_terms(terms, index, counts, 3, p)):
        got, want = (collections.Counter(map(str, answer(p).collect())) for p in (one, many))
        assert got == want and got
    assert lexical._plan(terms.limit(0), counts, one) is None


def test_waiting_offers_give_the_same_best():
    rnd = np.random.default_rng(8)
    top, all_ = lexical._Top(50, 3), []
    for _ in range(300):
        n = int(rnd.integers(0, 5))
        q, s, i = rnd.integers(0, 50, n), rnd.integers(0, 9, n) / 8, rnd.integers(0, 10**6, n)
        top.offer(q, s, i)
        all_ += zip(q.tolist(), s.tolist(), i.tolist())
    top.settle()
    want = [x for k in range(50) for x in sorted((x for x in all_ if x[0] == k), key=lambda x: (-x[1], x[2]))[:3]]
    assert [*zip(top.q.tolist(), top.s.tolist(), top.i.tolist())] == want
