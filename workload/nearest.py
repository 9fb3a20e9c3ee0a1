"""Search in stored cells: approximate, and exact by bounds."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from ragloom.operators.cells import build_cells, cell_search, cell_topk
from ragloom.operators.dense import dense_topk
from ragloom.plans.ingest import with_cells
from ragloom.plans.retrieve import embed_queries, retrieve
from ragloom.session import one_row
from workload.registry import query
from workload.retrieval import _KNN, _PAIRS, _SHOWN, _vectors, big, six
from workload.sqlparts import cosine, sql
from workload.tables import EMBEDDER, PARAMS, knowledge_base, web_queries

# The vectors of the driver table point everywhere alike, so more cells are read.
SCATTERED = PARAMS.but(probe_share=0.7)
ROUNDS = "abcdef"[: PARAMS.cell_rounds]


def _round(before: str, name: str) -> dict[str, str]:
    """One Lloyd round: who belongs to which centre of ``before``, and the centres ``name``."""
    return {
        f"of_{before}": f"""
          SELECT id, cell FROM trained, {before}
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(list_dot_product(u, c), 9) DESC, cell) = 1""",
        f"sums_{before}": f"""
          SELECT cell, list(s ORDER BY d) AS t FROM (
            SELECT cell, d, sum(x) AS s FROM (SELECT cell, unnest(u) AS x, generate_subscripts(u, 1) AS d FROM of_{before} JOIN trained USING (id))
            GROUP BY ALL) GROUP BY cell""",
        name: f"""
          SELECT cell, CASE WHEN t IS NULL THEN c ELSE list_transform(t, lambda x: round(x / sqrt(list_dot_product(t, t)), 6)) END AS c
          FROM {before} LEFT JOIN sums_{before} USING (cell)""",
    }


def cell_parts(held: str, wanting: str, params, exact: bool = False) -> dict[str, str]:
    """CTEs from ``held`` (id, v) and ``wanting`` (query_id, v) to ``probed`` (query_id, id, distance) and ``by_cells``."""
    first, k, bits = [f"first_{r}" for r in ROUNDS], params.candidate_k, params.code_bits
    second = [f"second_{r}" for r in ROUNDS]
    unit = "CASE WHEN list_dot_product(v, v) > 0 THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) ELSE v END"
    code = lambda key, source: f"""
      SELECT {key}, string_agg(CASE WHEN list_dot_product(v, plane) > 0 THEN '1' ELSE '0' END, '' ORDER BY p)::BIT AS code
      FROM {source}, hyperplanes GROUP BY {key}"""  # noqa: E731
    parts = {
        "vectors_held": f"SELECT id, v, {unit} AS u FROM {held}",
        "vectors_asked": f"SELECT query_id, v, {unit} AS u FROM {wanting}",
        "trained": "SELECT id, u FROM vectors_held WHERE list_dot_product(v, v) > 0",
        "first_start": f"""
          SELECT row_number() OVER (ORDER BY md5(id::VARCHAR), id) - 1 AS cell, list_transform(u, lambda x: round(x, 6)) AS c FROM trained
          QUALIFY cell < (SELECT least({params.max_cells}, greatest(1, round(sqrt(count(*))))) FROM vectors_held)""",
    }
    before = "first_start"
    for name in first:
        parts |= _round(before, name)
        last, before = before, name
    parts |= {
        f"of_{before}": _round(before, "_")[f"of_{before}"],
        "crowded": f"""
          SELECT cell, ceil(n / mean) - 1 AS more
          FROM (SELECT cell, count(*) AS n, (SELECT count(*) FROM trained) / (SELECT count(*) FROM first_start) AS mean FROM of_{last} GROUP BY cell)
          WHERE n > 4 * mean""",
        "second_start": f"""
          SELECT cell, c FROM {before} UNION ALL
          SELECT (SELECT count(*) FROM first_start) + row_number() OVER (ORDER BY cell, place) - 1, list_transform(u, lambda x: round(x, 6)) FROM (
            SELECT cell, u, more, row_number() OVER (PARTITION BY cell ORDER BY md5(id::VARCHAR), id) AS place
            FROM of_{before} JOIN crowded USING (cell) JOIN trained USING (id)) WHERE place <= more""",
    }
    unsplit, before = before, "second_start"
    for name in second:
        parts |= _round(before, name)
        before = name
    theta = "acos(greatest(-1, least(1, 1 - distance)))"
    parts |= {
        "centres": f"""
          SELECT * FROM {before} WHERE (SELECT count(*) FROM crowded) > 0
          UNION ALL SELECT * FROM {unsplit} WHERE (SELECT count(*) FROM crowded) = 0""",
        "stored": """
          SELECT id, cell, acos(greatest(-1, least(1, s))) AS away FROM (SELECT id, cell, round(list_dot_product(u, c), 9) AS s FROM vectors_held, centres)
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, cell) = 1""",
        "cell_sizes": "SELECT cell, count(*) AS n, max(away) AS reach FROM stored GROUP BY cell",
        "toward": """
          SELECT query_id, cell, n, reach, acos(greatest(-1, least(1, s))) AS near,
                 sum(n) OVER (PARTITION BY query_id ORDER BY s DESC, cell) - n AS ahead
          FROM (SELECT query_id, cell, round(list_dot_product(u, c), 9) AS s FROM vectors_asked, centres) JOIN cell_sizes USING (cell)""",
        "seeds": f"SELECT query_id, cell FROM toward WHERE ahead < {params.cell_seeds * k}",
        "seeded": f"""
          SELECT query_id, id, {cosine('q.v', 'h.v')} AS distance FROM seeds JOIN stored USING (cell)
          JOIN vectors_asked AS q USING (query_id) JOIN vectors_held AS h USING (id)""",
        "limits": f"""
          SELECT query_id, {theta} AS theta,
                 floor({bits} * {theta} / pi() + {params.code_slack} * sqrt({bits} * {theta} / pi() * (1 - {theta} / pi()))) AS differ
          FROM seeded WHERE distance IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) = {k}""",
        "hyperplanes": f"""
          SELECT p, list(('0x' || substr(md5(p || ':' || d), 1, 8))::BIGINT::DOUBLE - 2147483648 ORDER BY d) AS plane
          FROM range({bits}) AS x(p), range((SELECT max(len(v)) FROM vectors_held)) AS y(d) GROUP BY p""",
        "codes_held": code("id", "vectors_held"),
        "codes_asked": code("query_id", "vectors_asked"),
        "reached": "SELECT query_id, cell, near FROM toward LEFT JOIN limits USING (query_id) ANTI JOIN seeds USING (query_id, cell) WHERE " + (
            "theta IS NULL OR near - reach <= theta + 0.000001" if exact else f"ahead < {params.probe_share} * (SELECT count(*) FROM stored)"),
        "further": f"""
          SELECT query_id, id, {cosine('q.v', 'h.v')} AS distance FROM reached JOIN stored USING (cell)
          JOIN vectors_asked AS q USING (query_id) JOIN vectors_held AS h USING (id) LEFT JOIN limits USING (query_id)
          JOIN codes_held AS ch USING (id) JOIN codes_asked AS cq USING (query_id)
          WHERE theta IS NULL OR (abs(near - away) <= theta + 0.000001 AND {'true' if exact else 'bit_count(xor(ch.code, cq.code)) <= differ'})""",
        "probed": "SELECT * FROM seeded UNION ALL SELECT * FROM further",
        "by_cells": f"""
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance NULLS LAST, id) AS rnk
          FROM probed QUALIFY rnk <= {k}""",
    }
    return parts


_SCATTERED_SQL = {
    **_PAIRS, "held_vectors": "SELECT vec_id AS id, v FROM vecs", "wanting_vectors": "SELECT vec_id AS query_id, v FROM vecs",
    **cell_parts("held_vectors", "wanting_vectors", SCATTERED),
}
_CHUNKS_SQL = {**cell_parts("inputs_vec", "asked_vec", PARAMS)}
_RECALL = """
  SELECT round((SELECT count(*) FROM by_cells JOIN {exact} USING (query_id, id)) / (SELECT count(*) FROM {exact}), 6) AS recall,
         (SELECT sum(n)::BIGINT FROM toward SEMI JOIN (SELECT query_id, cell FROM seeds UNION SELECT query_id, cell FROM reached) USING (query_id, cell)) AS scanned,
         (SELECT count(*) FROM probed) AS measured, (SELECT count(*) FROM vectors_held, vectors_asked) AS pairs"""


@lru_cache(8)
def _cells(app: str, sf_dir: str, which: str):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if which == "chunks":
        return with_cells(knowledge_base(spark, sf_dir), PARAMS)
    return build_cells(_vectors(spark, sf_dir)[1], SCATTERED)


def _index(spark, sf_dir, which):
    """Cells are built once per session."""
    return _cells(spark.sparkContext.applicationId, sf_dir, which)


@query(sql("SELECT query_id, id, rnk, round(distance, 6) AS distance FROM by_cells", **_SCATTERED_SQL))
def knn_cells(spark, sf_dir):
    """Every vector against the nearest cells of all vectors, nearest twelve."""
    near = cell_topk(_vectors(spark, sf_dir)[0], _index(spark, sf_dir, "vectors"), PARAMS.candidate_k, SCATTERED.probe_share, SCATTERED)
    return near.select("query_id", "id", *big("rnk"), *six("distance"))


@query(_KNN)
def knn_bounded(spark, sf_dir):
    """The exact answer from the cells: bounds decide what need not be measured."""
    near = cell_topk(_vectors(spark, sf_dir)[0], _index(spark, sf_dir, "vectors"), PARAMS.candidate_k, None, SCATTERED)
    return near.select("query_id", "id", *big("rnk"), *six("distance"))


def _recall(exact, found, counts):
    seen = exact.select("query_id", "id", F.lit(1).alias("_e")).join(found.select("query_id", "id", F.lit(1).alias("_a")), ["query_id", "id"], "left")
    recall = seen.agg((F.count("_a") / F.count("_e")).alias("recall"))
    return one_row(recall, counts).select(*six("recall"), "scanned", "measured", "pairs")


@query(sql(_RECALL.format(exact="near"), **_SCATTERED_SQL))
def knn_cells_recall(spark, sf_dir):
    """Recall of the cells on vectors without any clusters, and the pairs looked at for it."""
    queries, chunks = _vectors(spark, sf_dir)
    found, counts = cell_search(queries, _index(spark, sf_dir, "vectors"), PARAMS.candidate_k, SCATTERED.probe_share, SCATTERED)
    return _recall(dense_topk(queries, chunks, PARAMS.candidate_k, SCATTERED), found, counts)


@query(sql(_RECALL.format(exact="dense"), **_CHUNKS_SQL))
def retrieve_cells_recall(spark, sf_dir):
    """Recall of the cells of the document chunks for the passages, and the pairs looked at for it."""
    kb, queries = _index(spark, sf_dir, "chunks"), embed_queries(web_queries(spark, sf_dir), EMBEDDER)
    found, counts = cell_search(queries, kb.cells, PARAMS.candidate_k, PARAMS.probe_share, PARAMS)
    return _recall(dense_topk(queries, kb.chunks, PARAMS.candidate_k, PARAMS), found, counts)


@query(sql("""
  SELECT query_id, rnk, id, doc_title, category, content, round(distance, 6) AS distance, round(score, 9) AS score
  FROM hybrid JOIN chunks USING (id)""", **_CHUNKS_SQL, dense="SELECT * FROM by_cells"))
def retrieve_approximate(spark, sf_dir):
    """Hybrid retrieval whose dense side is answered from the cells."""
    found = retrieve(web_queries(spark, sf_dir), _index(spark, sf_dir, "chunks"), EMBEDDER, PARAMS, approximate=True)
    return found.select(*_SHOWN, *big("rnk"), *six("distance"), F.round("score", 9).alias("score"))
