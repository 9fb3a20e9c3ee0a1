"""Conversation, rendering, citation and escalation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom.functions.text import citation_numbers
from ragloom.operators.answers import (
    DEFAULT_PRIORITY, DEFAULT_REASON, ANSWER_TEMPLATE, NO_CONTEXT, WEAK_NOTE, WEAK_REASON, citations_valid, escalation,
    escalation_record, prompt_table, render_contexts, render_sources, source_lists, title_texts,
)
from ragloom.operators.conversation import (
    search_queries, search_queries_per_turn, sub_queries, transcripts, validate_conversations,
)
from ragloom.operators.fusion import weak_match
from ragloom.plans.retrieve import retrieve
from workload.registry import query
from workload.sqlparts import SPACES, sql
from workload.tables import EMBEDDER, PARAMS, knowledge_base, messages, table, web_queries

L = F.col

PARTS = {
    "messages": """
      SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'model' ELSE role END AS role, text FROM conversations""",
}
LIMIT = 1500  # the longest fixture histories must trip it


@query(sql(f"""
  SELECT conv_id, reason IS NULL AS valid, reason FROM (
    SELECT conv_id, CASE
      WHEN NOT bool_and(role IN ('user', 'model')) THEN 'malformed turn'
      WHEN max_by(role, turn) <> 'user' THEN 'no open question'
      WHEN sum(length(text)) > {LIMIT} THEN 'over {LIMIT} characters' END AS reason
    FROM messages GROUP BY conv_id)""", **PARTS))
def conv_validate(spark, sf_dir):
    return validate_conversations(messages(spark, sf_dir), params=PARAMS.but(max_input_chars=LIMIT))


@query(sql(f"""
  SELECT conv_id, coalesce(rewritten, base) AS query, rewritten FROM (
    SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS base FROM (
      SELECT * FROM messages WHERE role = 'user'
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) GROUP BY conv_id)
  LEFT JOIN (
    SELECT conv_id, CASE WHEN n > 1 AND length(r) BETWEEN 3 AND 300 THEN r END AS rewritten FROM (
      SELECT conv_id, count(*) AS n, regexp_replace(trim('"' || min_by(text, turn) FILTER (WHERE role = 'model') || '''', {SPACES}),
             '^["'']|["'']$', '', 'g') AS r FROM messages GROUP BY conv_id)) USING (conv_id)""", **PARTS))
def search_query(spark, sf_dir):
    """Recent user texts, unless the first reply, quoted, is short enough to serve as a rewrite."""
    rows = messages(spark, sf_dir)
    first_reply = rows.filter("role = 'model'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("r"))
    rewrites = first_reply.select("conv_id", F.concat(F.lit('"'), "r", F.lit("'")).alias("rewrite"))
    return search_queries(rows, rewrites)


@query(sql("""
  SELECT conv_id, turn, concat_ws(' ', lag(text, 2) OVER w, lag(text) OVER w, text) AS query
  FROM messages WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""", **PARTS))
def search_query_turns(spark, sf_dir):
    return search_queries_per_turn(messages(spark, sf_dir))


@query(sql(f"""
  SELECT doc_id AS query_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, text FROM (
    SELECT doc_id, i, trim(regexp_replace(line, '^[-*0-9.) \\t]+', ''), {SPACES}) AS text FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
  WHERE length(text) BETWEEN 3 AND 160
  QUALIFY count(*) OVER (PARTITION BY doc_id) >= 2 AND n <= 5"""))
def sub_query_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(L("doc_id").alias("query_id"), "text")
    return sub_queries(lines).select("query_id", L("n").cast("bigint").alias("n"), "text")


@query(sql("""
  SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Guide: ' END || text, chr(10) ORDER BY turn) AS transcript
  FROM (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6)
  GROUP BY conv_id""", **PARTS))
def transcript(spark, sf_dir):
    return transcripts(messages(spark, sf_dir), "Guide")


# --- rendering --------------------------------------------------------------

def _found(spark, sf_dir):
    queries = web_queries(spark, sf_dir)
    return queries, retrieve(queries, knowledge_base(spark, sf_dir), EMBEDDER, PARAMS)


RENDER_PARTS = {
    "contexts": f"""
      SELECT query_id, coalesce(string_agg('[' || rnk || '] ' || doc_title || chr(10) || content,
             chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rnk), '{NO_CONTEXT}') AS context
      FROM asked LEFT JOIN (SELECT * FROM hybrid JOIN chunks USING (id)) USING (query_id) GROUP BY query_id""",
    "weaks": f"""
      SELECT query_id, coalesce(bool_and(distance > {PARAMS.max_distance}), false) AS weak
      FROM asked LEFT JOIN hybrid USING (query_id) GROUP BY query_id""",
}


@query(sql("SELECT query_id, context FROM contexts", **RENDER_PARTS))
def context_render(spark, sf_dir):
    return render_contexts(*_found(spark, sf_dir))


@query(sql("""
  SELECT query_id, rnk AS n, doc_title AS title, category, source_url AS url FROM hybrid JOIN chunks USING (id)"""))
def source_list(spark, sf_dir):
    return source_lists(_found(spark, sf_dir)[1]).select("query_id", F.inline("sources"))


@query(sql(f"""
  SELECT query_id, concat_ws(chr(10) || chr(10), '{ANSWER_TEMPLATE}', CASE WHEN weak THEN '{WEAK_NOTE}' END,
         '=== CONTEXT ===', context, '=== END CONTEXT ===') AS prompt
  FROM contexts JOIN weaks USING (query_id)""", **RENDER_PARTS))
def prompts(spark, sf_dir):
    queries, found = _found(spark, sf_dir)
    return prompt_table(queries, found, weak_match(queries, found, PARAMS.max_distance))


@query(sql("""
  SELECT doc_title AS title, string_agg(content, chr(10) ORDER BY id) AS body FROM chunks
  WHERE doc_title IN (SELECT doc_title FROM hybrid JOIN chunks USING (id)) GROUP BY doc_title"""))
def title_lookup(spark, sf_dir):
    found = _found(spark, sf_dir)[1]
    return title_texts(knowledge_base(spark, sf_dir).chunks, found.select(L("doc_title").alias("title")))


@query(sql("""
  SELECT query_id AS turn_id, coalesce(string_agg('[' || rnk || '] ' || title || chr(10) || body,
         chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rnk), '') AS rendered
  FROM (SELECT DISTINCT query_id FROM hybrid) LEFT JOIN (
    SELECT query_id, rnk, doc_title AS title FROM hybrid JOIN chunks USING (id)) USING (query_id)
  LEFT JOIN bodies USING (title) GROUP BY query_id""",
    bodies="SELECT doc_title AS title, string_agg(content, chr(10) ORDER BY id) AS body FROM chunks GROUP BY ALL"))
def judge_sources(spark, sf_dir):
    """Full texts behind the sources of every answer, numbered."""
    answers = source_lists(_found(spark, sf_dir)[1]).withColumnRenamed("query_id", "turn_id")
    return render_sources(answers, knowledge_base(spark, sf_dir).chunks)


# --- answers: assistant turns with citation markers appended ------------------

ANSWER_PARTS = {
    "answers": """
      SELECT conv_id * 100 + turn AS turn_id, text || CASE WHEN length(text) < 300 THEN ''
        WHEN length(text) < 500 THEN ' [' || turn || '] [12345678901234567890]'
        ELSE ' [1] see [' || (conv_id + 1) || ']' END AS answer,
        length(text) < 700 AS weak, text LIKE '%ent%' AS escalated, CASE WHEN text LIKE '%sch%' THEN 'broken' END AS error
      FROM conversations WHERE role = 'assistant'""",
}


def answers(spark, sf_dir):
    n = F.length("text")
    marker = (
        F.when(n < 300, "").when(n < 500, F.format_string(" [%d] [12345678901234567890]", "turn"))
        .otherwise(F.format_string(" [1] see [%d]", L("conv_id") + 1))
    )
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(
        (L("conv_id") * 100 + L("turn")).alias("turn_id"), F.concat("text", marker).alias("answer"),
        (n < 700).alias("weak"), L("text").contains("ent").alias("escalated"),
        F.when(L("text").contains("sch"), "broken").alias("error"),
    )


@query(sql("""
  SELECT turn_id, i - 1 AS place, TRY_CAST(d AS BIGINT) AS n FROM (
    SELECT turn_id, unnest(l) AS d, generate_subscripts(l, 1) AS i FROM (
      SELECT turn_id, regexp_extract_all(answer, '\\[([0-9]+)\\]', 1) AS l FROM answers))""", **ANSWER_PARTS))
def citations(spark, sf_dir):
    found = answers(spark, sf_dir).select("turn_id", F.posexplode(citation_numbers(L("answer"))).alias("place", "n"))
    return found.select("turn_id", L("place").cast("bigint").alias("place"), "n")


@query(sql("""
  SELECT turn_id, bool_and(d IS NULL OR coalesce(TRY_CAST(d AS BIGINT) BETWEEN 1 AND 5, false)) AS valid FROM answers
  LEFT JOIN (SELECT turn_id, unnest(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1)) AS d FROM answers) USING (turn_id)
  GROUP BY turn_id""", **ANSWER_PARTS))
def citation_valid(spark, sf_dir):
    return answers(spark, sf_dir).select("turn_id", citations_valid(L("answer"), F.lit(5)).alias("valid"))


@query(sql(f"""
  SELECT turn_id, need, CASE WHEN need THEN '{WEAK_REASON}' END AS reason,
         CASE WHEN need THEN left(answer, 200) END AS summary, CASE WHEN need THEN '{DEFAULT_PRIORITY}' END AS priority
  FROM (SELECT *, weak AND NOT escalated AND error IS NULL
          AND (NOT regexp_matches(answer, '\\[[0-9]+\\]') OR length(answer) < 600) AS need FROM answers)""", **ANSWER_PARTS))
def escalation_net(spark, sf_dir):
    made = escalation(L("weak"), L("escalated"), L("error"), L("answer"), L("answer"))
    return answers(spark, sf_dir).select("turn_id", made.alias("e")).select(
        "turn_id", L("e").isNotNull().alias("need"), "e.reason", "e.summary", "e.priority"
    )


@query(sql(f"""
  SELECT event_id, CASE WHEN event_type = 'click' THEN user_id::VARCHAR ELSE '{DEFAULT_REASON}' END AS reason,
         CASE WHEN event_type IN ('click', 'view', 'error') THEN '' ELSE event_type END AS summary,
         CASE WHEN event_type IN ('click', 'view', 'error') THEN '{DEFAULT_PRIORITY}' ELSE 'high' END AS priority
  FROM events"""))
def escalation_defaults(spark, sf_dir):
    """Escalation arguments with a field missing, none at all, or no JSON."""
    kind = L("event_type")
    args = (
        F.when(kind == "click", F.format_string('{"reason": "%d"}', "user_id"))
        .when(kind == "view", L("props")).when(kind == "error", "no arguments")
        .otherwise(F.format_string('{"summary": "%s", "priority": "high"}', kind))
    )
    return table(spark, sf_dir, "events").select("event_id", escalation_record(args).alias("e")).select("event_id", "e.*")
