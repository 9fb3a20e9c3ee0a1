"""SQL building blocks for the oracles: named CTEs, pulled in where referenced."""

from __future__ import annotations

import re

from ragloom.functions.text import NOT_WORD, SPACE_CHARS, STOP_WORDS
from workload.tables import PARAMS

DIM = PARAMS.embedding_dim
SPACES = "'" + SPACE_CHARS + "'"
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '{NOT_WORD}'), lambda w: w <> '')"


def stem(w: str) -> str:
    return f"""CASE
      WHEN ends_with({w}, 'ies') AND NOT (ends_with({w}, 'eies') OR ends_with({w}, 'aies')) THEN left({w}, length({w}) - 3) || 'y'
      WHEN ends_with({w}, 'es') AND NOT (ends_with({w}, 'aes') OR ends_with({w}, 'ees') OR ends_with({w}, 'oes')) THEN left({w}, length({w}) - 1)
      WHEN ends_with({w}, 's') AND NOT (ends_with({w}, 'us') OR ends_with({w}, 'ss')) THEN left({w}, length({w}) - 1)
      ELSE {w} END"""


def cosine(a: str, b: str) -> str:
    """Distance of two lists, null when either has zero length; never minus zero."""
    return (
        f"round(1 - list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * "
        f"sqrt(list_dot_product({b}, {b})), 0), 9) + 0.0"
    )


def hashed_vectors(source: str, key: str, text: str) -> dict[str, str]:
    """CTEs ``<source>_vec(key, v)``: signed word hashing to unit float vectors."""
    return {
        f"{source}_cell": f"""
          SELECT {key}, (code >> 1) % {DIM} AS b, sum(1 - 2 * (code & 1))::DOUBLE AS s FROM (
            SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT AS code
            FROM (SELECT {key}, unnest({words(text)}) AS w FROM {source})) GROUP BY ALL""",
        f"{source}_len": f"SELECT {key}, sqrt(sum(s * s)) AS l FROM {source}_cell GROUP BY ALL",
        f"{source}_vec": f"""
          SELECT {key}, list(coalesce(CASE WHEN l > 0 THEN s / l END, 0)::FLOAT::DOUBLE ORDER BY b) AS v
          FROM (SELECT {key}, b FROM {source}, range({DIM}) r(b))
          LEFT JOIN {source}_cell USING ({key}, b) LEFT JOIN {source}_len USING ({key}) GROUP BY {key}""",
    }


# Read web-style queries of the CTE ``asked(query_id, text)``; no phrases here.
PIECES = r"""regexp_extract_all(text, '(-?"[^"]*"?|[^\s\x{00A0}"]+)', 1)"""

PARTS: dict[str, str] = {
    # --- ingestion
    "articles": """
      SELECT doc_id, lang || '/' || source || '/' || doc_id AS title, source AS category,
             NULL::VARCHAR AS source_url, text AS body FROM documents""",
    "paras": f"""
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, p, length(p) AS len FROM (
        SELECT doc_id, i, trim(raw, {SPACES}) AS p FROM (
          SELECT doc_id, unnest(string_split(body, chr(10))) AS raw,
                 generate_subscripts(string_split(body, chr(10)), 1) AS i FROM articles)) WHERE p <> ''""",
    "pack": f"""
      SELECT doc_id, n, 0 AS chunk_no, len AS used FROM paras WHERE n = 1
      UNION ALL
      SELECT p.doc_id, p.n,
             CASE WHEN k.used + p.len + 2 > {PARAMS.chunk_max_chars} THEN k.chunk_no + 1 ELSE k.chunk_no END,
             CASE WHEN k.used + p.len + 2 > {PARAMS.chunk_max_chars} THEN p.len ELSE k.used + p.len + 2 END
      FROM pack k JOIN paras p ON p.doc_id = k.doc_id AND p.n = k.n + 1""",
    "packed": """
      SELECT doc_id, chunk_no, string_agg(p, chr(10) || chr(10) ORDER BY n) AS content
      FROM pack JOIN paras USING (doc_id, n) GROUP BY ALL""",
    "chunks": """
      SELECT row_number() OVER (ORDER BY doc_id, chunk_no) AS id, doc_id, chunk_no,
             title AS doc_title, category, source_url, content
      FROM packed JOIN articles USING (doc_id)""",
    "inputs": """
      SELECT id, doc_title || CASE WHEN coalesce(category, '') <> '' THEN ' — ' || category ELSE '' END
             || chr(10) || chr(10) || content AS input FROM chunks""",
    **hashed_vectors("inputs", "id", "input"),
    # --- lexeme index
    "title_words": f"""
      SELECT id, generate_subscripts(l, 1) AS pos, unnest(l) AS w
      FROM (SELECT id, {words("coalesce(doc_title, '')")} AS l FROM chunks)""",
    "title_end": f"SELECT id, max(pos) AS shift FROM title_words WHERE w NOT IN ({STOPS}) GROUP BY id",
    "body_words": f"""
      SELECT id, generate_subscripts(l, 1) AS pos, unnest(l) AS w
      FROM (SELECT id, {words("content")} AS l FROM chunks)""",
    "post": f"""
      SELECT id, {stem("w")} AS term, pos, 'A' AS weight FROM title_words WHERE w NOT IN ({STOPS})
      UNION ALL
      SELECT id, {stem("w")}, pos + coalesce(shift, 0), 'B'
      FROM body_words LEFT JOIN title_end USING (id) WHERE w NOT IN ({STOPS})""",
    # --- queries
    "asked": r"""
      SELECT item_id AS query_id, regexp_replace(text, '[.,\n]+ *', ' or ', 'g') AS text FROM benchmark""",
    **hashed_vectors("asked", "query_id", "text"),
    "pieces": f"""
      SELECT *, count(*) FILTER (WHERE lower(piece) = 'or') OVER (PARTITION BY query_id ORDER BY i) AS grp FROM (
        SELECT query_id, unnest({PIECES}) AS piece, generate_subscripts({PIECES}, 1) AS i FROM asked)""",
    "terms": f"""
      SELECT query_id, grp, i, off, starts_with(piece, '-') AS negated, {stem("w")} AS term FROM (
        SELECT query_id, grp, i, piece, unnest(l) AS w, generate_subscripts(l, 1) AS off FROM (
          SELECT *, {words("piece")} AS l FROM pieces WHERE lower(piece) <> 'or'))
      WHERE w NOT IN ({STOPS})""",
    "wanted": "SELECT DISTINCT query_id, grp, term FROM terms WHERE NOT negated",
    "needs": "SELECT query_id, grp, count(*) AS n FROM wanted GROUP BY ALL",
    "has_all": """
      SELECT query_id, grp, id, n FROM wanted JOIN (SELECT DISTINCT id, term FROM post) USING (term)
      JOIN needs USING (query_id, grp) GROUP BY ALL HAVING count(*) = n""",
    "matched": "SELECT * FROM has_all",
    "entries": """
      SELECT query_id, grp, id, n, term, pos, CASE weight WHEN 'A' THEN 1.0 ELSE 0.4 END::DOUBLE AS w
      FROM matched JOIN wanted USING (query_id, grp) JOIN post USING (id, term)""",
    "latest": """
      SELECT e.query_id, e.grp, e.id, e.n, e.pos, t.term,
             max(CASE WHEN e.term = t.term THEN e.pos END) OVER (
               PARTITION BY e.query_id, e.grp, e.id, t.term ORDER BY e.pos) AS last_pos
      FROM entries e JOIN wanted t ON t.query_id = e.query_id AND t.grp = e.grp""",
    "ends": """
      SELECT query_id, grp, id, pos AS q, min(last_pos) AS p FROM latest
      GROUP BY query_id, grp, id, pos HAVING count(last_pos) = max(n)""",
    "covers": "SELECT query_id, grp, id, p, min(q) AS q FROM ends GROUP BY ALL",
    "parts": """
      SELECT c.query_id, c.id, (count(*) / sum(1 / e.w)) / (1 + (c.q - c.p) - (count(*) - 1)) AS part
      FROM covers c JOIN entries e ON e.query_id = c.query_id AND e.grp = c.grp AND e.id = c.id
           AND e.pos BETWEEN c.p AND c.q GROUP BY c.query_id, c.grp, c.id, c.p, c.q""",
    "ranks": "SELECT query_id, id, round(sum(part), 9) AS score FROM parts GROUP BY ALL",
    "sparse": f"""
      SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rnk
      FROM ranks QUALIFY rnk <= {PARAMS.candidate_k}""",
    # --- dense and fused
    "distances": f"""
      SELECT query_id, id, {cosine("q.v", "c.v")} AS distance FROM asked_vec q, inputs_vec c""",
    "dense": f"""
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance NULLS LAST, id) AS rnk
      FROM distances QUALIFY rnk <= {PARAMS.candidate_k}""",
    "fused": f"""
      SELECT query_id, id, coalesce(1.0::DOUBLE / ({PARAMS.rrf_k} + d.rnk), 0) +
             coalesce(1.0::DOUBLE / ({PARAMS.rrf_k} + s.rnk), 0) AS score
      FROM dense d FULL JOIN sparse s USING (query_id, id)""",
    "ranked": f"""
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rnk
      FROM fused JOIN distances USING (query_id, id) QUALIFY rnk <= {PARAMS.candidate_k}""",
    "hybrid": f"""
      SELECT query_id, id, score, distance, row_number() OVER (PARTITION BY query_id ORDER BY rnk) AS rnk
      FROM (SELECT * FROM ranked WHERE rnk <= {PARAMS.min_keep} OR distance <= {PARAMS.max_distance})
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rnk) <= {PARAMS.top_k}""",
    "dense_kept": f"""
      SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY rnk) AS rnk
      FROM (SELECT * FROM dense WHERE rnk <= {PARAMS.min_keep} OR distance <= {PARAMS.max_distance})
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rnk) <= {PARAMS.top_k}""",
}


def sql(final: str, **own: str) -> str:
    """``WITH RECURSIVE`` every part the statement needs, in dependency order."""
    parts = {**PARTS, **own}
    order: list[str] = []

    def visit(text: str, me: str | None = None) -> None:
        for name in re.findall(r"\b[a-z_]+\b", re.sub(r"'[^']*'", "''", text)):
            if name in parts and name != me and name not in order:
                visit(parts[name], name)
                order.append(name)

    visit(final)
    # a recursive part cannot be declared materialized
    recursive = lambda n: re.search(rf"\b{n}\b", parts[n])
    ctes = [f"{n} AS {'' if recursive(n) else 'MATERIALIZED '}({parts[n]})" for n in order]
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + final
