"""Ingestion and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom.operators.dense import (
    approximate_topk, candidate_fraction, dense_topk, plane_code, plane_signs,
)
from ragloom.operators.chunking import embedding_input, paragraphs, pack_chunks
from ragloom.operators.embedding import width_report
from ragloom.operators.fusion import (
    keep_close, reciprocal_rank_fusion, round_robin, weak_match,
)
from ragloom.operators.lexical import (
    cover_rank, flat_postings, match_terms, query_terms, ranked_terms, sparse_topk, term_counts,
)
from ragloom.plans.ingest import KnowledgeBase, chunk_articles
from ragloom.plans.retrieve import embed_queries, multi_requirement_retrieve, retrieve
from ragloom.session import one_row, scratch_path
from ragloom.sources.articles import parse_articles, scan_articles, write_articles
from workload.registry import query
from workload.sqlparts import SPACES, STOPS, cosine, sql, stem, words
from workload.tables import EMBEDDER, PARAMS, articles, knowledge_base, table, web_queries

L = F.col


def big(*names):
    return [L(n).cast("bigint").alias(n) for n in names]


def six(*names):
    return [F.round(L(n), 6).alias(n) for n in names]


# --- articles and chunks ----------------------------------------------------

@query(f"""
  SELECT source || ' ' || doc_id AS title, source AS category, trim(replace(text, chr(13) || chr(10), chr(10)), {SPACES}) AS body
  FROM documents""")
def article_scan(spark, sf_dir):
    """Documents written as files, one each, and read back as articles."""
    path = scratch_path(spark, "articles")
    head = F.format_string("---\ntitle: %s %d\ncategory: %s\n---\n", "source", "doc_id", "source")
    write_articles(table(spark, sf_dir, "documents").select(F.concat(head, "text")), path)
    return parse_articles(scan_articles(spark, path, "*.txt")).select("title", "category", "body")


@query(sql(f"""
  SELECT doc_id, CASE WHEN lang = 'en' THEN source || ' ' || doc_id ELSE 'Untitled' END AS title,
    CASE WHEN lang = 'en' THEN '' END AS category,
    CASE WHEN lang = 'en' THEN 'http://' || source || '.example/' END AS source_url,
    trim(replace(text, chr(13) || chr(10), chr(10)), {SPACES}) AS body FROM documents"""))
def frontmatter_parse(spark, sf_dir):
    """One language gets a header with a BOM, CRLF, a repeated key and an empty value."""
    header = F.format_string(
        "﻿---\r\ntitle: \"%s: %d\"\ncategory:\nno colon here\nsource_url: http://%s.example/\ntitle: '%s %d\n---\n",
        "lang", "doc_id", "source", "source", "doc_id",
    )
    raw = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(L("lang") == "en", F.concat(header, "text")).otherwise(L("text")).alias("raw")
    )
    return parse_articles(raw)


@query(sql("SELECT doc_id, n - 1 AS para_no, p FROM paras"))
def paragraph_split(spark, sf_dir):
    return articles(spark, sf_dir).select(
        "doc_id", F.posexplode(paragraphs(L("body"), PARAMS.paragraph_separator)).alias("para_no", "p")
    ).select("doc_id", *big("para_no"), "p")


@query(sql("SELECT doc_id, chunk_no::BIGINT AS chunk_no, content FROM packed"))
def chunk_pack(spark, sf_dir):
    packed = pack_chunks(articles(spark, sf_dir), PARAMS)
    return packed.select("doc_id", *big("chunk_no"), "content")


@query(sql("SELECT id, doc_title, content FROM chunks"))
def chunk_ids(spark, sf_dir):
    return chunk_articles(articles(spark, sf_dir), ["doc_id"], PARAMS).select("id", "doc_title", "content")


@query(sql("SELECT id, input FROM inputs"))
def embed_input(spark, sf_dir):
    chunks = knowledge_base(spark, sf_dir).chunks
    return chunks.select("id", embedding_input(L("doc_title"), L("category"), L("content")).alias("input"))


@query(sql("""
  SELECT id, b AS axis, round(x, 6) AS x FROM (
    SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS b FROM inputs_vec) WHERE x <> 0"""))
def hash_embed(spark, sf_dir):
    """Chunk vectors, one row per non-zero axis."""
    chunks = knowledge_base(spark, sf_dir).chunks
    return (
        chunks.select("id", F.posexplode("embedding").alias("axis", "x"))
        .filter("x != 0")
        .select("id", *big("axis"), F.round(L("x").cast("double"), 6).alias("x"))
    )


@query("""
  SELECT count(*) FILTER (WHERE len(v) = 64) AS accepted, count(*) FILTER (WHERE len(v) <> 64) AS rejected
  FROM (SELECT CASE WHEN label = 3 THEN list_append(embedding, 0) ELSE embedding END AS v FROM embeddings)""")
def width_check(spark, sf_dir):
    """One label's vectors are made a number too wide and must be turned away."""
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "embedding",
        F.when(L("label") == 3, F.array_append("embedding", F.lit(0).cast("float"))).otherwise(L("embedding")),
    )
    return width_report(rows, 64)


# --- dense ------------------------------------------------------------------

def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.select(L("vec_id").alias("query_id"), L("embedding").alias("vector"))
    return queries, rows.select(L("vec_id").alias("id"), "embedding", "label")


_PAIRS = {
    "vecs": "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings",
    "pairs": f"SELECT a.vec_id AS query_id, b.vec_id AS id, {cosine('a.v', 'b.v')} AS distance FROM vecs a, vecs b",
    "near": f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance NULLS LAST, id) AS rnk
      FROM pairs QUALIFY rnk <= {PARAMS.candidate_k}""",
}
_KNN = sql("SELECT query_id, id, rnk, round(distance, 6) AS distance FROM near", **_PAIRS)


@query(_KNN)
def knn_dense(spark, sf_dir):
    """Every vector against every vector, nearest twelve."""
    queries, chunks = _vectors(spark, sf_dir)
    near = dense_topk(queries, chunks, PARAMS.candidate_k, PARAMS)
    return near.select("query_id", "id", *big("rnk"), *six("distance"))


@query(_KNN)
def knn_dense_grid(spark, sf_dir):
    """The same answer through bounded (query block, chunk slab) cells."""
    queries, chunks = _vectors(spark, sf_dir)
    small = PARAMS.but(query_block=200, slab_rows=150)
    near = dense_topk(queries, chunks, PARAMS.candidate_k, small)
    return near.select("query_id", "id", *big("rnk"), *six("distance"))


@query(sql(f"""
  SELECT query_id, id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY rnk) AS rnk
  FROM near WHERE rnk <= {PARAMS.min_keep} OR distance <= {PARAMS.max_distance}
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rnk) <= {PARAMS.top_k}""", **_PAIRS))
def knn_threshold_min_keep(spark, sf_dir):
    queries, chunks = _vectors(spark, sf_dir)
    near = dense_topk(queries, chunks, PARAMS.candidate_k, PARAMS)
    kept = keep_close(near, PARAMS.top_k, PARAMS.min_keep, PARAMS.max_distance)
    return kept.select("query_id", "id", *big("rnk"), *six("distance"))


_PLANES, _RADIUS = 5, 1
_SIGNS = ", ".join(
    f"({p}, [{', '.join(str(x) for x in row)}]::DOUBLE[])" for p, row in enumerate(plane_signs(_PLANES, 64))
)
_CODED = {
    **_PAIRS,
    "codes": f"""
      SELECT vec_id, sum(CASE WHEN list_dot_product(v, s) > 0 THEN 1 << p ELSE 0 END)::INT AS code
      FROM vecs, (VALUES {_SIGNS}) t(p, s) GROUP BY vec_id""",
    "probed": f"""
      SELECT query_id, id, distance FROM pairs JOIN codes a ON a.vec_id = query_id JOIN codes b ON b.vec_id = id
      WHERE bit_count(xor(a.code, b.code)) <= {_RADIUS}""",
    "approx": f"""
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance NULLS LAST, id) AS rnk
      FROM probed QUALIFY rnk <= {PARAMS.candidate_k}""",
}


def _approximate(spark, sf_dir):
    queries, chunks = _vectors(spark, sf_dir)
    coded = chunks.withColumn("code", plane_code(L("embedding"), _PLANES, 64))
    return queries, coded, approximate_topk(queries, coded, PARAMS.candidate_k, _PLANES, _RADIUS, PARAMS)


@query(sql("SELECT query_id, id, rnk, round(distance, 6) AS distance FROM approx", **_CODED))
def knn_approximate(spark, sf_dir):
    return _approximate(spark, sf_dir)[2].select("query_id", "id", *big("rnk"), *six("distance"))


@query(sql("""
  SELECT round((SELECT count(*) FROM approx JOIN near USING (query_id, id)) / (SELECT count(*) FROM near), 6) AS recall,
         (SELECT count(*) FROM probed) AS measured, (SELECT count(*) FROM pairs) AS pairs,
         round((SELECT count(*) FROM probed) / (SELECT count(*) FROM pairs), 6) AS fraction""", **_CODED))
def ann_recall(spark, sf_dir):
    """Recall against the exact answer, and the share of pairs measured for it."""
    queries, coded, approx = _approximate(spark, sf_dir)
    exact = dense_topk(queries, coded, PARAMS.candidate_k, PARAMS).select("query_id", "id", F.lit(1).alias("_e"))
    found = exact.join(approx.select("query_id", "id", F.lit(1).alias("_a")), ["query_id", "id"], "left")
    recall = found.agg((F.count("_a") / F.count("_e")).alias("recall"))
    coded_queries = queries.withColumn("code", plane_code(L("vector"), _PLANES, 64))
    share = candidate_fraction(coded_queries, coded, _PLANES, _RADIUS)
    return one_row(recall, share).select(*six("recall"), "measured", "pairs", *six("fraction"))


# --- sparse -----------------------------------------------------------------

@query(sql("SELECT id, term, pos::BIGINT AS pos, weight FROM post"))
def lexeme_index(spark, sf_dir):
    return flat_postings(knowledge_base(spark, sf_dir).index).select("id", "term", *big("pos"), "weight")


@query(sql("SELECT term, count(DISTINCT id) AS df FROM post GROUP BY term"))
def term_frequency(spark, sf_dir):
    return term_counts(knowledge_base(spark, sf_dir).index)


def _matches(spark, sf_dir, queries=None):
    kb = knowledge_base(spark, sf_dir)
    queries = web_queries(spark, sf_dir) if queries is None else queries
    return match_terms(query_terms(queries), kb.index, kb.counts, PARAMS)


@query(sql("SELECT query_id, grp::BIGINT AS grp, id, count(*) AS occurrences FROM entries GROUP BY ALL"))
def term_match(spark, sf_dir):
    return _matches(spark, sf_dir).select(
        "query_id", *big("grp"), "id", "occurrences"
    )


@query(sql("""
  SELECT DISTINCT query_id, id FROM (
    SELECT query_id, grp, i, id FROM phrase_words JOIN post USING (term) JOIN phrase_size USING (query_id, grp, i)
    GROUP BY query_id, grp, i, id, n, pos - off HAVING count(*) = n)
  WHERE id NOT IN (SELECT id FROM post WHERE term = 'en')""",
    asked=r"""SELECT item_id AS query_id, '"' || regexp_replace(replace(text, '"', ' '), '[.\n]+ *', '" -en or "', 'g') || '" -en' AS text
              FROM benchmark""",
    phrase_words=f"""
      SELECT query_id, grp, i, off, {stem("w")} AS term FROM (
        SELECT query_id, grp, i, unnest(l) AS w, generate_subscripts(l, 1) AS off FROM (
          SELECT *, {words("piece")} AS l FROM pieces WHERE starts_with(piece, '"')))
      WHERE w NOT IN ({STOPS})""",
    phrase_size="SELECT query_id, grp, i, count(*) AS n FROM phrase_words GROUP BY ALL"))
def phrase_match(spark, sf_dir):
    """Any sentence of a passage as a phrase, in chunks without one excluded word."""
    asked = table(spark, sf_dir, "benchmark").select(
        L("item_id").alias("query_id"),
        F.concat(F.lit('"'), F.regexp_replace(F.replace("text", F.lit('"'), F.lit(" ")), r"[.\n]+ *", '" -en or "'),
                 F.lit('" -en')).alias("text"),
    )
    return _matches(spark, sf_dir, asked).select("query_id", "id").distinct()


@query(sql("SELECT query_id, id, round(score, 6) AS score FROM ranks"))
def cover_density(spark, sf_dir):
    return cover_rank(_matches(spark, sf_dir)).select("query_id", "id", *six("score"))


@query(sql("SELECT query_id, id, round(score, 6) AS score, rnk FROM sparse"))
def sparse_ranking(spark, sf_dir):
    kb = knowledge_base(spark, sf_dir)
    top = ranked_terms(query_terms(web_queries(spark, sf_dir)), kb.index, kb.counts, PARAMS.candidate_k, PARAMS)
    return top.select("query_id", "id", *six("score"), *big("rnk"))


# --- fused ------------------------------------------------------------------

@query(sql("SELECT query_id, id, round(score, 9) AS score FROM fused"))
def rrf_fuse(spark, sf_dir):
    kb = knowledge_base(spark, sf_dir)
    queries = embed_queries(web_queries(spark, sf_dir), EMBEDDER)
    dense = dense_topk(queries, kb.chunks, PARAMS.candidate_k, PARAMS)
    sparse = sparse_topk(cover_rank(_matches(spark, sf_dir)), PARAMS.candidate_k)
    fused = reciprocal_rank_fusion(dense, sparse, PARAMS.rrf_k)
    return fused.select("query_id", "id", F.round("score", 9).alias("score"))


_SHOWN = ["query_id", "id", "doc_title", "category", "content"]


@query(sql("""
  SELECT query_id, rnk, id, doc_title, category, content, round(distance, 6) AS distance, round(score, 9) AS score
  FROM hybrid JOIN chunks USING (id)"""))
def hybrid_retrieve(spark, sf_dir):
    """Flagship: passages as queries against all document chunks, dense and sparse fused."""
    found = retrieve(web_queries(spark, sf_dir), knowledge_base(spark, sf_dir), EMBEDDER, PARAMS)
    return found.select(*_SHOWN, *big("rnk"), *six("distance"), F.round("score", 9).alias("score"))


@query(sql("""
  SELECT query_id, rnk, id, doc_title, category, content, round(distance, 6) AS distance, false AS hybrid
  FROM dense_kept JOIN chunks USING (id)"""))
def dense_fallback(spark, sf_dir):
    """Hybrid is asked for, but the knowledge base has no lexeme index."""
    kb = KnowledgeBase(knowledge_base(spark, sf_dir).chunks)
    found = retrieve(web_queries(spark, sf_dir), kb, EMBEDDER, PARAMS, hybrid=True)
    return found.select(*_SHOWN, *big("rnk"), *six("distance"), "hybrid")


@query(sql(f"""
  SELECT query_id, coalesce(bool_and(distance > {PARAMS.max_distance}), false) AS weak
  FROM asked LEFT JOIN hybrid USING (query_id) GROUP BY query_id"""))
def weak_match_flag(spark, sf_dir):
    queries = web_queries(spark, sf_dir)
    found = retrieve(queries, knowledge_base(spark, sf_dir), EMBEDDER, PARAMS)
    return weak_match(queries, found, PARAMS.max_distance)


@query(sql(f"""
  SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY rnk, query_id) AS rnk
  FROM (SELECT label, query_id, id, rnk FROM near JOIN vecs ON vec_id = query_id
        QUALIFY row_number() OVER (PARTITION BY label, id ORDER BY rnk, query_id) = 1)
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY rnk, query_id) <= {PARAMS.fit_top_k}""", **_PAIRS))
def round_robin_fuse(spark, sf_dir):
    """The nearest-neighbour lists of one label's vectors, interleaved."""
    queries, chunks = _vectors(spark, sf_dir)
    near = dense_topk(queries, chunks, PARAMS.candidate_k, PARAMS)
    labels = chunks.select(L("id").alias("query_id"), "label")
    lists = near.join(labels, "query_id").withColumnRenamed("query_id", "list_no")
    return round_robin(lists, PARAMS.fit_top_k, group="label").select("label", "id", *big("rnk"))


def requirement_lists(spark, sf_dir):
    """Passages as long texts, and their sentences as sub-queries."""
    from ragloom.operators.conversation import sub_queries

    texts = table(spark, sf_dir, "benchmark").select(L("item_id").alias("group_id"), "text")
    lines = texts.select(L("group_id").alias("query_id"), F.regexp_replace("text", r"\. *", "\n").alias("text"))
    subs = sub_queries(lines).select(L("query_id").alias("group_id"), L("n").alias("list_no"), "text")
    return texts, subs


FIT = PARAMS.fit_top_k
REQUIREMENT_PARTS = {
    "sub_lines": rf"""
      SELECT item_id, i, trim(regexp_replace(line, '^[-*0-9.) \t]+', ''), {SPACES}) AS text FROM (
        SELECT item_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (
          SELECT item_id, string_split(regexp_replace(text, '\. *', chr(10), 'g'), chr(10)) AS l FROM benchmark))""",
    "subs": """
      SELECT item_id, text, row_number() OVER (PARTITION BY item_id ORDER BY i) AS list_no
      FROM sub_lines WHERE length(text) BETWEEN 3 AND 160
      QUALIFY count(*) OVER (PARTITION BY item_id) >= 2 AND list_no <= 5""",
    "asked": f"""
      SELECT item_id * 10 AS query_id, left(text, {PARAMS.fit_embed_chars}) AS text FROM benchmark
      UNION ALL SELECT item_id * 10 + list_no, text FROM subs""",
    "hybrid": f"""
      SELECT query_id, id, score, distance, row_number() OVER (PARTITION BY query_id ORDER BY rnk) AS rnk
      FROM (SELECT * FROM ranked WHERE rnk <= {PARAMS.min_keep} OR distance <= {PARAMS.max_distance})
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rnk) <= {FIT}""",
    "first_seen": """
      SELECT query_id // 10 AS group_id, id, rnk, query_id % 10 AS list_no FROM hybrid
      QUALIFY row_number() OVER (PARTITION BY query_id // 10, id ORDER BY rnk, query_id % 10) = 1""",
    "interleaved": f"""
      SELECT group_id, id, list_no, row_number() OVER (PARTITION BY group_id ORDER BY rnk, list_no) AS rnk
      FROM first_seen QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY rnk, list_no) <= {FIT}""",
}


@query(sql("SELECT group_id, id, list_no, rnk, doc_title FROM interleaved JOIN chunks USING (id)", **REQUIREMENT_PARTS))
def multi_requirement(spark, sf_dir):
    texts, subs = requirement_lists(spark, sf_dir)
    found = multi_requirement_retrieve(texts, subs, knowledge_base(spark, sf_dir), EMBEDDER, PARAMS)
    return found.select("group_id", "id", *big("list_no", "rnk"), "doc_title")
