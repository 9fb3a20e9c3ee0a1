"""Retrieval and answer scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ragloom.functions.text import words
from ragloom.operators.dense import dense_topk
from ragloom.plans.evaluate import (
    RULE, acceptance, acceptance_gate, acceptance_passes, compare_modes, coverage, coverage_gate, dashboard, failure_gate, first_hit_ranks,
    hard_failures, known_runs, misses, out_of_scope_correct, read_verdicts, recall_mrr, refusal_pattern, rejection_rate,
    rejections, word_runs, worst,
)
from ragloom.plans.retrieve import multi_requirement_retrieve, retrieve, retrieve_ways
from ragloom.session import broadcast_within, settled, written
from ragloom.operators.turns import fold_turns
from workload.registry import query
from workload.retrieval import FIT, REQUIREMENT_PARTS, _PAIRS, _vectors, requirement_lists
from workload.sqlparts import sql
from workload.sqlparts import words as sql_words
from workload.streams import turn_events
from workload.tables import EMBEDDER, PARAMS, articles, knowledge_base, table, web_queries

L = F.col
six = lambda *names: [F.round(L(n), 6).alias(n) for n in names]


# --- ground truth: documents that hold every five-word run of a passage --------

RUN = 5
RUN_BYTES = 200  # of a run that is sent


def truth(spark, sf_dir):
    """``query_id, expect`` (titles), null for passages found nowhere; written once.

    The runs of the passages are sent to the texts while their size allows, so
    that only texts' runs that some passage has are made and shuffled.
    """
    asked, n = settled(word_runs(
        table(spark, sf_dir, "benchmark").select(L("item_id").alias("query_id"), words(L("text")).alias("w")), RUN))
    wanted = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    held, known = articles(spark, sf_dir), None
    if n * RUN_BYTES <= PARAMS.broadcast_bytes:
        known = known_runs(asked, RUN)
    else:  # all runs cost more than a shuffle of the texts, and the fixture is one file
        held = held.repartition("title")
    held = word_runs(held.select("title", words(L("body")).alias("w")), RUN, known=known)
    found = held.join(broadcast_within(asked, n, RUN_BYTES, PARAMS.broadcast_bytes), "s").groupBy("query_id", "title").agg(F.count(F.lit(1)).alias("c"))
    full = found.join(wanted, "query_id").filter("c = n").groupBy("query_id").agg(
        F.sort_array(F.collect_list("title")).alias("expect"))
    return written(wanted.select("query_id").join(full, "query_id", "left"), "truth")


def labelled(spark, sf_dir, known=None):
    """The passages that are found somewhere, by their ``known`` truth."""
    known = truth(spark, sf_dir) if known is None else known
    return known.filter("expect IS NOT NULL").select(
        "query_id", F.when(F.size("expect") > 1, "copied").otherwise("single").alias("cls"), "expect")


_RUNS = f"""list_distinct(list_transform(range(1, greatest(len(w) - {RUN - 1}, 1) + 1),
             lambda i: array_to_string(w[i:i + {RUN - 1}], ' ')))"""
TRUTH = {
    "asked_sent": f"SELECT query_id, unnest({_RUNS}) AS s FROM (SELECT item_id AS query_id, {sql_words('text')} AS w FROM benchmark)",
    "held_sent": f"SELECT title, unnest({_RUNS}) AS s FROM (SELECT title, {sql_words('body')} AS w FROM articles)",
    "truth": """
      SELECT query_id, list(title ORDER BY title) AS expect FROM (
        SELECT query_id, title, count(*) AS c FROM asked_sent JOIN held_sent USING (s) GROUP BY ALL)
      JOIN (SELECT query_id, count(*) AS n FROM asked_sent GROUP BY ALL) USING (query_id) WHERE c = n GROUP BY query_id""",
    "labelled": "SELECT query_id, expect, CASE WHEN len(expect) > 1 THEN 'copied' ELSE 'single' END AS cls FROM truth",
    "negatives": "SELECT query_id FROM asked WHERE query_id NOT IN (SELECT query_id FROM truth)",
    "hybrid_titles": "SELECT query_id, rnk, distance, doc_title FROM hybrid JOIN chunks USING (id)",
    "dense_titles": "SELECT query_id, rnk, distance, doc_title FROM dense_kept JOIN chunks USING (id)",
    **{f"{mode}_ranks": f"""
      SELECT query_id, cls, coalesce(min(rnk), 0) AS rank FROM labelled LEFT JOIN (
        SELECT query_id, rnk FROM {mode}_titles JOIN labelled USING (query_id)
        WHERE len(list_filter(expect, lambda e: contains(lower(doc_title), lower(e)))) > 0) USING (query_id)
      GROUP BY ALL""" for mode in ("hybrid", "dense")},
    **{f"{mode}_scores": f"""
      SELECT coalesce(cls, 'overall') AS cls, count(*) AS n, count(*) FILTER (WHERE rank > 0) AS hits,
             avg((rank > 0)::INT) AS recall, avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END) AS mrr
      FROM {mode}_ranks GROUP BY ROLLUP (cls)""" for mode in ("hybrid", "dense")},
}


def _run(spark, sf_dir, hybrid=True):
    return retrieve(web_queries(spark, sf_dir), knowledge_base(spark, sf_dir), EMBEDDER, PARAMS, hybrid=hybrid)


@query(sql("SELECT query_id, cls, rank FROM hybrid_ranks", **TRUTH))
def eval_first_hit(spark, sf_dir):
    return first_hit_ranks(labelled(spark, sf_dir), _run(spark, sf_dir))


@query(sql("SELECT cls, n, hits, round(recall, 6) AS recall, round(mrr, 6) AS mrr FROM hybrid_scores", **TRUTH))
def eval_recall_mrr(spark, sf_dir):
    scores = recall_mrr(first_hit_ranks(labelled(spark, sf_dir), _run(spark, sf_dir)))
    return scores.select("cls", "n", "hits", *six("recall", "mrr"))


@query(sql("""
  SELECT query_id, cls, array_to_string(expect, '|') AS expect, coalesce(got, '') AS got
  FROM (SELECT * FROM dense_ranks JOIN labelled USING (query_id, cls) WHERE rank = 0) LEFT JOIN (
    SELECT query_id, string_agg(doc_title, '|' ORDER BY rnk) AS got FROM dense_titles WHERE rnk <= 3 GROUP BY 1) USING (query_id)""",
    **TRUTH))
def eval_misses(spark, sf_dir):
    known, found = labelled(spark, sf_dir), _run(spark, sf_dir, hybrid=False)
    lost = misses(first_hit_ranks(known, found), known, found)
    return lost.select("query_id", "cls", F.array_join("expect", "|").alias("expect"), F.array_join("got", "|").alias("got"))


@query(sql("""
  SELECT cls, d.n, round(d.recall, 6) AS recall_dense, round(d.mrr, 6) AS mrr_dense, round(h.recall, 6) AS recall_hybrid,
         round(h.mrr, 6) AS mrr_hybrid, round(h.recall - d.recall, 6) AS recall_delta, round(h.mrr - d.mrr, 6) AS mrr_delta,
         h.recall + 1e-9 >= d.recall AS ok
  FROM dense_scores d JOIN hybrid_scores h USING (cls)""", **TRUTH))
def eval_mode_delta(spark, sf_dir):
    known = labelled(spark, sf_dir)
    found = retrieve_ways(web_queries(spark, sf_dir), knowledge_base(spark, sf_dir), EMBEDDER, PARAMS)
    sides = [first_hit_ranks(known, side) for side in found]
    return compare_modes(*sides).select(
        "cls", "n", *six("recall_dense", "mrr_dense", "recall_hybrid", "mrr_hybrid", "recall_delta", "mrr_delta"), "ok")


_REJECT = f"""
  SELECT query_id, leaks IS NULL AS rejected, coalesce(leaks, '') AS leaks FROM negatives LEFT JOIN (
    SELECT query_id, string_agg(doc_title || ' (' || printf('%.3f', distance) || ')', '|' ORDER BY rnk) AS leaks
    FROM hybrid_titles WHERE distance <= {PARAMS.max_distance} GROUP BY 1) USING (query_id)"""


def _rejected(spark, sf_dir, hybrid=True):
    negatives = truth(spark, sf_dir).filter("expect IS NULL").select("query_id")
    return rejections(negatives, _run(spark, sf_dir, hybrid), PARAMS.max_distance)


@query(sql(_REJECT.replace("hybrid_titles", "dense_titles"), **TRUTH))
def eval_rejection_dense(spark, sf_dir):
    found = _rejected(spark, sf_dir, hybrid=False)
    return found.select("query_id", "rejected", F.array_join("leaks", "|").alias("leaks"))


@query(sql(_REJECT, **TRUTH))
def eval_rejection(spark, sf_dir):
    return _rejected(spark, sf_dir).select("query_id", "rejected", F.array_join("leaks", "|").alias("leaks"))


@query(sql(f"""
  SELECT count(*) AS n, count(*) FILTER (WHERE rejected) AS rejected, round(avg(rejected::INT), 6) AS rate
  FROM ({_REJECT})""", **TRUTH))
def eval_rejection_rate(spark, sf_dir):
    return rejection_rate(_rejected(spark, sf_dir)).select("n", "rejected", *six("rate"))


_COVER = {
    **{k: v for k, v in TRUTH.items() if k in ("asked_sent", "held_sent", "truth")},
    **REQUIREMENT_PARTS,
    "decomposed": "SELECT DISTINCT group_id, doc_title FROM interleaved JOIN chunks USING (id)",
    "single": f"""
      SELECT DISTINCT query_id // 10 AS group_id, doc_title FROM hybrid JOIN chunks USING (id)
      WHERE query_id % 10 = 0 AND rnk <= {FIT}""",
    **{f"{side}_cover": f"""
      SELECT group_id, avg(hit::INT) AS covered, coalesce(string_agg(e, '|' ORDER BY i) FILTER (WHERE NOT hit), '') AS missed FROM (
        SELECT query_id AS group_id, e, i, coalesce(bool_or(contains(lower(doc_title), lower(e))), false) AS hit
        FROM (SELECT query_id, unnest(expect) AS e, generate_subscripts(expect, 1) AS i FROM truth)
        LEFT JOIN {side} ON group_id = query_id GROUP BY query_id, e, i) GROUP BY group_id"""
       for side in ("single", "decomposed")},
}


def _coverages(spark, sf_dir):
    expected = labelled(spark, sf_dir).select(L("query_id").alias("group_id"), "expect")
    texts, subs = requirement_lists(spark, sf_dir)
    kb = knowledge_base(spark, sf_dir)
    many = multi_requirement_retrieve(texts, subs, kb, EMBEDDER, PARAMS)
    whole = retrieve(texts.select(L("group_id").alias("query_id"), F.substring("text", 1, PARAMS.fit_embed_chars).alias("text")),
                     kb, EMBEDDER, PARAMS, PARAMS.fit_top_k)
    return coverage(expected, whole.withColumnRenamed("query_id", "group_id")), coverage(expected, many)


@query(sql("SELECT group_id, round(covered, 6) AS covered, missed FROM decomposed_cover", **_COVER))
def eval_coverage(spark, sf_dir):
    return _coverages(spark, sf_dir)[1].select("group_id", *six("covered"), F.array_join("missed", "|").alias("missed"))


@query(sql("""
  SELECT round(s, 6) AS single, round(d, 6) AS decomposed, d + 1e-9 >= s AS ok
  FROM (SELECT avg(covered) AS s FROM single_cover), (SELECT avg(covered) AS d FROM decomposed_cover)""", **_COVER))
def eval_coverage_gate(spark, sf_dir):
    return coverage_gate(*_coverages(spark, sf_dir)).select(*six("single", "decomposed"), "ok")


@query(sql("""
  SELECT coalesce(cls, 'overall') AS cls, count(*) AS n, count(*) FILTER (WHERE rank > 0) AS hits,
         round(avg((rank > 0)::INT), 6) AS recall, round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr
  FROM (SELECT vec_id, 'label ' || label || '.' AS cls, coalesce(min(rnk) FILTER (WHERE other = label), 0) AS rank FROM vecs LEFT JOIN (
          SELECT query_id, b.label AS other, row_number() OVER (PARTITION BY query_id ORDER BY rnk) AS rnk
          FROM near JOIN vecs b ON b.vec_id = id WHERE id <> query_id) ON query_id = vec_id AND rnk <= 5 GROUP BY vec_id, label)
  GROUP BY ROLLUP (cls)""", **_PAIRS))
def knn_label_recall(spark, sf_dir):
    """Does a vector's neighbourhood hold its own label? Scored per label."""
    queries, chunks = _vectors(spark, sf_dir)
    title = F.format_string("label %d.", "label")
    near = dense_topk(queries, chunks, PARAMS.candidate_k, PARAMS).filter("id != query_id")
    again = Window.partitionBy("query_id").orderBy("rnk")
    found = near.withColumn("rnk", F.row_number().over(again)).filter("rnk <= 5").join(
        chunks.select("id", title.alias("doc_title")), "id")
    known = chunks.select(L("id").alias("query_id"), title.alias("cls"), F.array(title).alias("expect"))
    return recall_mrr(first_hit_ranks(known, found)).select("cls", "n", "hits", *six("recall", "mrr"))


# --- answers: documents as answers, their lines as judged claims ----------------

ANSWERS = {
    "claims": """
      SELECT doc_id, trim(p) AS claim, i, contains(p, 'the') AS supported FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS p,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents JOIN labels USING (doc_id))
      WHERE p <> ''""",
    "judged": """
      SELECT d.doc_id, CASE WHEN lang = 'es' THEN 'oos' ELSE 'answerable' END AS kind, toxic = 1 AS escalated,
             text || CASE WHEN lang = 'en' THEN ' [1] [' || d.doc_id || ']' ELSE '' END AS answer,
             CASE WHEN text LIKE '%rrr%' THEN 'timeout' END AS run_error,
             g.ok / g.n::DOUBLE AS groundedness, coalesce(g.n, 0)::BIGINT AS claim_count,
             CASE WHEN quality IS NOT NULL THEN (quality + 1) / 2.0::DOUBLE END AS citation_precision,
             coalesce(quality = 1, false) AS substantive, coalesce(lost, '') AS lost
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN (
        SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE supported) AS ok,
               string_agg(claim, '|' ORDER BY i) FILTER (WHERE NOT supported) AS lost FROM claims GROUP BY doc_id) g ON g.doc_id = d.doc_id""",
}


def judged(spark, sf_dir):
    """Verdicts as JSON texts: unlabelled documents have no verdict at all."""
    lines = F.filter(F.split("text", "\n"), lambda p: p != "")
    claims = F.transform(lines, lambda p: F.struct(F.trim(p).alias("claim"), p.contains("the").alias("supported")))
    cites = F.array(F.struct(F.lit(1).alias("n"), F.lit(True).alias("supported")),
                    F.struct(F.lit(2).alias("n"), (L("quality") == 1).alias("supported")))
    verdict = F.when(L("quality").isNotNull(), F.to_json(F.struct(
        claims.alias("claims"), cites.alias("citations"), (L("quality") == 1).alias("substantive"))))
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    mark = F.when(L("lang") == "en", F.format_string(" [1] [%d]", "doc_id")).otherwise("")
    rows = docs.select(
        "doc_id", F.when(L("lang") == "es", "oos").otherwise("answerable").alias("kind"), (L("toxic") == 1).alias("escalated"),
        F.concat("text", mark).alias("answer"), F.when(L("text").contains("rrr"), "timeout").alias("run_error"),
        F.lit(500).alias("source_count"), verdict.alias("verdict"))
    return read_verdicts(rows)


@query(sql("""
  SELECT doc_id, round(groundedness, 6) AS groundedness, claim_count, round(citation_precision, 6) AS citation_precision,
         substantive, lost AS unsupported FROM judged""", **ANSWERS))
def groundedness(spark, sf_dir):
    return judged(spark, sf_dir).select(
        "doc_id", *six("groundedness"), L("claim_count").cast("bigint").alias("claim_count"), *six("citation_precision"),
        "substantive", F.array_join("unsupported_claims", "|").alias("unsupported"))


_REFUSAL = refusal_pattern().replace("'", "''")
_CORRECT = f"(coalesce(escalated, false) OR (regexp_matches(answer, '{_REFUSAL}') AND NOT regexp_matches(answer, '\\[[0-9]+\\]')))"


@query(sql(f"""
  SELECT count(*) FILTER (WHERE kind = 'answerable') AS answerable,
         round(avg(groundedness) FILTER (WHERE kind = 'answerable'), 6) AS mean_groundedness,
         round(avg(citation_precision) FILTER (WHERE kind = 'answerable'), 6) AS mean_citation_precision,
         round(avg(substantive::INT) FILTER (WHERE kind = 'answerable'), 6) AS substantive_rate,
         count(*) FILTER (WHERE kind = 'answerable' AND escalated) AS false_escalations,
         count(*) FILTER (WHERE kind = 'oos') AS out_of_scope,
         count(*) FILTER (WHERE kind = 'oos' AND {_CORRECT}) AS out_of_scope_correct
  FROM judged WHERE run_error IS NULL""", **ANSWERS))
def answer_dashboard(spark, sf_dir):
    d = dashboard(judged(spark, sf_dir))
    rates = ["mean_groundedness", "mean_citation_precision", "substantive_rate"]
    return d.select(*[c for c in d.columns if c not in rates], *six(*rates))


@query(f"""
  SELECT turn_id, {_CORRECT} AS correct FROM (
    SELECT conv_id * 100 + turn AS turn_id, false AS escalated,
           text || CASE WHEN length(text) % 3 = 0 THEN ' I CANNOT help' WHEN length(text) % 3 = 1 THEN ' outside [2]' ELSE '' END AS answer
    FROM conversations WHERE role = 'assistant')""")
def oos_correct(spark, sf_dir):
    n = F.length("text") % 3
    answer = F.concat("text", F.when(n == 0, " I CANNOT help").when(n == 1, " outside [2]").otherwise(""))
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return rows.select((L("conv_id") * 100 + L("turn")).alias("turn_id"),
                       out_of_scope_correct(F.lit(False), answer).alias("correct"))


_FAILED = f"""
  SELECT doc_id, concat_ws('; ', CASE WHEN run_error IS NOT NULL THEN 'did not run' END,
    CASE WHEN run_error IS NULL AND kind = 'answerable' AND escalated THEN 'escalated though answerable' END,
    CASE WHEN run_error IS NULL AND kind = 'answerable' AND bad THEN 'citation of no source' END,
    CASE WHEN run_error IS NULL AND kind = 'oos' AND NOT {_CORRECT} THEN 'out of scope, neither escalated nor refused' END) AS reasons
  FROM (SELECT *, len(list_filter(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1),
          lambda d: coalesce(TRY_CAST(d AS BIGINT) NOT BETWEEN 1 AND 500, true))) > 0 AS bad FROM judged)"""


@query(sql(_FAILED, **ANSWERS))
def hard_gate_reasons(spark, sf_dir):
    return hard_failures(judged(spark, sf_dir)).select("doc_id", F.array_join("reasons", "; ").alias("reasons"))


@query(sql(f"""
  SELECT count(*) FILTER (WHERE reasons <> '') AS failures, count(*) FILTER (WHERE reasons <> '') = 0 AS ok
  FROM ({_FAILED})""", **ANSWERS))
def hard_gate(spark, sf_dir):
    return failure_gate(hard_failures(judged(spark, sf_dir)))


@query(sql("""
  SELECT doc_id, round(groundedness, 6) AS groundedness FROM judged
  WHERE groundedness IS NOT NULL ORDER BY judged.groundedness, doc_id LIMIT 3""", **ANSWERS))
def worst_answers(spark, sf_dir):
    return worst(judged(spark, sf_dir).select("doc_id", "groundedness"), "doc_id").select("doc_id", *six("groundedness"))


# Declared checks, one scenario per number of the turn inside its conversation.
CHECKS = [
    ("1", 200, None, None, None, True, "none", None),
    ("2", 40, "on|ent", r"^\d+/2$", None, None, None, None),
    ("3", None, "the|un|qu", r"/3$", False, None, "none", None),
    ("4", None, None, None, None, None, "or_refusal", None),
    ("5", None, None, None, None, None, None, "brok"),
    ("never", 1, None, None, None, None, None, None),  # no conversation has such a turn
]


def _accepted(spark, sf_dir):
    turns = fold_turns(turn_events(spark, sf_dir), keep="first")
    named = turns.withColumn("id", (L("turn_id") % 100).cast("string"))
    return acceptance(named, spark.createDataFrame(CHECKS, RULE))


_CHECKED = f"""
  SELECT turn::VARCHAR AS id, conv_id * 100 + turn AS turn_id, CASE turn
      WHEN 1 THEN length(answer) > 200 AND NOT escalated
      WHEN 2 THEN length(answer) > 40 AND regexp_matches(answer, '(?i)on|ent')
      WHEN 3 THEN regexp_matches(answer, '(?i)the|un|qu') AND NOT escalated
      WHEN 4 THEN {_CORRECT}
      ELSE answer LIKE '%sch%' END AS ok
  FROM (SELECT *, text AS answer, text LIKE '%ent%' AS escalated FROM conversations)
  WHERE role = 'assistant' AND turn BETWEEN 1 AND 5
  UNION ALL SELECT id, NULL, false FROM (VALUES ('1'), ('2'), ('3'), ('4'), ('5'), ('never')) rules(id)
  WHERE id NOT IN (SELECT turn::VARCHAR FROM conversations WHERE role = 'assistant')"""


@query(_CHECKED)
def acceptance_checks(spark, sf_dir):
    return _accepted(spark, sf_dir).select("id", "turn_id", "ok")


@query(f"""
  SELECT count(*) AS scenarios, count(*) FILTER (WHERE failures > 0) AS failed, count(*) FILTER (WHERE failures > 0) = 0 AS ok
  FROM (SELECT id, count(*) FILTER (WHERE NOT ok) AS failures FROM ({_CHECKED}) GROUP BY id)""")
def acceptance_overall(spark, sf_dir):
    return acceptance_passes(_accepted(spark, sf_dir))


@query(f"SELECT id, count(turn_id) AS turns, count(*) FILTER (WHERE NOT ok) AS failures FROM ({_CHECKED}) GROUP BY id")
def acceptance_report(spark, sf_dir):
    return acceptance_gate(_accepted(spark, sf_dir))
