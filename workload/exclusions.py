"""Queries of exclusions alone, against all chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom.operators.exclusion import allowed_ids, bitmap_rows, exclusion_groups, left_out
from ragloom.operators.lexical import query_terms
from ragloom.plans.retrieve import retrieve
from workload.registry import query
from workload.retrieval import _SHOWN, big, six
from workload.sqlparts import sql
from workload.tables import EMBEDDER, PARAMS, knowledge_base, table

# One word to leave out; every third query has a second alternative of that kind, every third a word that is wanted.
_ASKED = r"""
  SELECT item_id AS query_id, '-' || w[1] || CASE item_id % 3 WHEN 0 THEN ' or -fr or -"' || w[1] || ' ' || w[2] || '"' WHEN 1 THEN ' or ' || w[3] ELSE ' -' || w[2] END AS text
  FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark) WHERE len(w) > 2"""

_PARTS = {
    "asked": _ASKED,
    # places of the parts of every piece, phrases and words alike
    "lookups": "SELECT query_id, grp, i, starts_with(piece, '-\"') AS phrase, off, term FROM terms JOIN pieces USING (query_id, grp, i) WHERE negated",
    "lookup_size": "SELECT query_id, grp, i, count(*) AS n FROM lookups GROUP BY ALL",
    "holders": """
      SELECT query_id, grp, i, id FROM (
        SELECT query_id, grp, i, id, n, CASE WHEN phrase THEN pos - off ELSE 0 END AS begin, off
        FROM lookups JOIN lookup_size USING (query_id, grp, i) JOIN post USING (term))
      GROUP BY query_id, grp, i, id, n, begin HAVING count(DISTINCT off) = n""",
    "barred": "SELECT DISTINCT query_id, grp, id FROM holders",
    "only_barring": "SELECT query_id, grp FROM terms GROUP BY ALL HAVING bool_and(negated)",
    "kept_ids": "SELECT DISTINCT query_id, id FROM (SELECT query_id, grp, id FROM only_barring, chunks) ANTI JOIN barred USING (query_id, grp, id)",
    "matched": "SELECT * FROM has_all ANTI JOIN barred USING (query_id, grp, id)",
}
_SPARSE = {
    "scored_ids": """
      SELECT query_id, id, coalesce(score, 0) AS score, distance
      FROM (SELECT query_id, id FROM ranks UNION SELECT query_id, id FROM kept_ids) LEFT JOIN ranks USING (query_id, id) JOIN distances USING (query_id, id)""",
    "sparse": f"""
      SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE WHEN score = 0 THEN distance END NULLS LAST, id) AS rnk
      FROM scored_ids QUALIFY rnk <= {PARAMS.candidate_k}""",
}


def _asked(spark, sf_dir):
    w = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))
    one, two, three = (F.get("w", F.lit(i)) for i in range(3))
    tail = (
        F.when(F.col("item_id") % 3 == 0, F.concat(F.lit(' or -fr or -"'), one, F.lit(" "), two, F.lit('"')))
        .when(F.col("item_id") % 3 == 1, F.concat(F.lit(" or "), three)).otherwise(F.concat(F.lit(" -"), two))
    )
    rows = table(spark, sf_dir, "benchmark").select("item_id", w.alias("w")).filter(F.size("w") > 2)
    return rows.select(F.col("item_id").alias("query_id"), F.concat(F.lit("-"), one, tail).alias("text"))


@query(sql("""
  SELECT query_id, (id - 1) // 32768 + 1 AS part, count(*) AS ids, min(id) AS first, max(id) AS last, sum(id)::BIGINT AS total
  FROM kept_ids GROUP BY ALL""", **_PARTS))
def exclusion_sets(spark, sf_dir):
    """All chunks without what is left out, as sets of ids."""
    kb, terms = knowledge_base(spark, sf_dir), query_terms(_asked(spark, sf_dir))
    sets = allowed_ids(exclusion_groups(terms), left_out(terms, kb.index, kb.counts, PARAMS), kb.chunks)
    return bitmap_rows(sets.select("query_id", "part", "ids")).groupBy("query_id", "part").agg(
        F.count("id").alias("ids"), F.min("id").alias("first"), F.max("id").alias("last"), F.sum("id").alias("total"))


@query(sql("""
  SELECT query_id, rnk, id, doc_title, category, content, round(distance, 6) AS distance, round(score, 9) AS score
  FROM hybrid JOIN chunks USING (id)""", **_PARTS, **_SPARSE))
def exclusion_retrieve(spark, sf_dir):
    """Hybrid retrieval where the full-text side has little but exclusions to go by."""
    found = retrieve(_asked(spark, sf_dir), knowledge_base(spark, sf_dir), EMBEDDER, PARAMS)
    return found.select(*_SHOWN, *big("rnk"), *six("distance"), F.round("score", 9).alias("score"))
