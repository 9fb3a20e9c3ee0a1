"""Rate limit, event fold, frames, turn log, archive and table queries; batch and stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom.operators.answers import SOURCE
from ragloom.operators.ratelimit import client_key, rate_limit
from ragloom.operators.turns import fold_turns, parse_frames, parse_pieces, turn_log
from ragloom.plans.retrieve import retrieve
from ragloom.session import scratch_path
from ragloom.sources.archive import archive_turns
from ragloom.sources.tables import full_reload, promote
from ragloom.streaming.ratelimit import rate_limit_stream
from ragloom.streaming.sinks import archive_stream, drain
from ragloom.streaming.turns import fold_turns_stream, split_late
from workload.registry import query
from workload.sqlparts import sql
from workload.tables import EMBEDDER, PARAMS, knowledge_base, messages, table, web_queries

L = F.col


def _as_stream(df):
    """The rows of a table, arriving as a stream of files."""
    path = scratch_path(df.sparkSession, "arriving")
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


# Fixture requests are sparse: a day and two requests make the limit trip.
DAY, MAX = 86_400, 2

_LIMIT_PARTS = {
    "windows": """
      SELECT user_id, min(ts) AS opened FROM events GROUP BY user_id
      UNION ALL
      SELECT w.user_id, min(e.ts) FROM windows w JOIN events e
        ON e.user_id = w.user_id AND e.ts > w.opened + INTERVAL 1 DAY GROUP BY w.user_id, w.opened""",
    "placed": """
      SELECT e.event_id, e.user_id, e.ts, w.opened FROM events e ASOF JOIN windows w
        ON e.user_id = w.user_id AND e.ts >= w.opened""",
}
_LIMIT = f"""WITH RECURSIVE windows AS ({_LIMIT_PARTS["windows"]}), placed AS ({_LIMIT_PARTS["placed"]})
  SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, opened ORDER BY ts, event_id) > {MAX} AS limited
  FROM placed"""


@query(_LIMIT)
def rate_limited(spark, sf_dir):
    """Windows anchored at a key's first hit, the keys' times cut into slices."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    limited = rate_limit(events, DAY, MAX, "user_id", "ts", "event_id", slice_seconds=5 * DAY)
    return limited.select("event_id", "user_id", "limited")


@query(f"""
  WITH RECURSIVE events AS (
    SELECT event_id, coalesce(CASE WHEN user_id % 3 > 0 THEN user_id END::VARCHAR, 'unknown') AS user_id, ts
    FROM main.events WHERE event_id % 7 > 0),
  windows AS ({_LIMIT_PARTS["windows"]}), placed AS ({_LIMIT_PARTS["placed"]})
  SELECT event_id, row_number() OVER (PARTITION BY user_id, opened ORDER BY ts, event_id) > {MAX} AS limited FROM placed
  UNION ALL SELECT event_id, NULL FROM main.events WHERE event_id % 7 = 0""")
def rate_limited_nulls(spark, sf_dir):
    """Some requests without a key, some without a time."""
    events = table(spark, sf_dir, "events").select(
        "event_id", F.when(L("user_id") % 3 > 0, L("user_id")).alias("user_id"), F.when(L("event_id") % 7 > 0, L("ts")).alias("ts"))
    return rate_limit(events, DAY, MAX, "user_id", "ts", "event_id").select("event_id", "limited")


def _arriving(df, place, n):
    """The rows of a table as a stream of ``n`` files in order of ``place``, one a micro-batch."""
    path = scratch_path(df.sparkSession, "arriving")
    # one task writes a file, but not what comes before it
    for i in range(n):
        df.filter(place == i).repartition(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(_LIMIT)
def rate_limited_stream(spark, sf_dir):
    """The same rule on a stream that arrives in order, in three files."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    source = _arriving(events, F.floor((F.day("ts") - 1) / 11), 3)
    limited = rate_limit_stream(source, DAY, MAX, "user_id", "ts", "event_id")
    return drain(limited, "limits", idle_batches=False).select("event_id", "user_id", "limited")


@query(_LIMIT)
def rate_limited_backlog(spark, sf_dir):
    """The stream stops after its first file, finds a backlog of four when it goes on, and forgets keys in between."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    path, out = (scratch_path(spark, label) for label in ("arriving", "limits"))
    for files in (range(1), range(1, 5)):
        for i in files:
            events.filter(F.floor((F.day("ts") - 1) / 7) == i).repartition(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
        limited = rate_limit_stream(source, DAY, MAX, "user_id", "ts", "event_id", lateness_seconds=0)
        found = drain(limited, path=out)
    return found.select("event_id", "user_id", "limited")


# Files of events from anywhere in the month, some without a key, some without a time.
_UNORDERED = f"""WITH RECURSIVE arrived AS (
    SELECT event_id, coalesce(CASE WHEN user_id % 5 > 0 THEN user_id END::VARCHAR, 'unknown') AS user_id, event_id % 4 AS file, ts AS sent,
           CASE WHEN event_id % 7 > 0 THEN ts END AS own FROM main.events),
  numbered AS (
    SELECT event_id, user_id, own, max(own) OVER (PARTITION BY user_id ORDER BY file, own, event_id ROWS UNBOUNDED PRECEDING) AS ts,
           row_number() OVER (PARTITION BY user_id ORDER BY file, own, event_id) AS nth
    FROM arrived WHERE own IS NOT NULL),
  events AS (SELECT event_id, user_id, ts, own, nth FROM numbered),
  windows AS ({_LIMIT_PARTS["windows"]}),
  placed AS (SELECT e.*, w.opened FROM events e ASOF JOIN windows w ON e.user_id = w.user_id AND e.ts >= w.opened)
  SELECT event_id, row_number() OVER (PARTITION BY user_id, opened ORDER BY nth) > {MAX} AS limited, own < ts AS late FROM placed
  UNION ALL SELECT event_id, NULL, false FROM arrived WHERE own IS NULL"""


@query(_UNORDERED)
def rate_limited_unordered(spark, sf_dir):
    """A stream of files out of order: every request comes out, late ones at the time their key's clock shows."""
    events = table(spark, sf_dir, "events").select(
        "event_id", F.when(L("user_id") % 5 > 0, L("user_id")).alias("user_id"), F.when(L("event_id") % 7 > 0, L("ts")).alias("ts"))
    source = _arriving(events, L("event_id") % 4, 4)
    limited = rate_limit_stream(source, DAY, MAX, "user_id", "ts", "event_id", lateness_seconds=60 * DAY)
    return drain(limited, "limits", idle_batches=False).select("event_id", "limited", "late")


@query("""
  SELECT event_id, CASE event_type WHEN 'click' THEN user_id::VARCHAR WHEN 'error' THEN 'unknown'
         WHEN 'view' THEN '' ELSE event_type END AS key FROM events""")
def client_keys(spark, sf_dir):
    kind = L("event_type")
    header = (
        F.when(kind == "click", F.format_string(" %d , 10.0.0.1", "user_id"))
        .when(kind == "view", ", 10.0.0.1").when(kind != "error", kind)
    )
    return table(spark, sf_dir, "events").select("event_id", client_key(header).alias("key"))


# --- assistant turns as event streams -----------------------------------------

def turn_events(spark, sf_dir):
    """Events of every assistant turn: sources (twice), a delta per word, escalation, done or error."""
    turns = messages(spark, sf_dir).filter("role = 'model'")
    refs = lambda n: F.array(F.struct(F.lit(n).cast("bigint").alias("n"), F.concat_ws("/", "conv_id", "turn").alias("title"),
                                      F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("url")))
    none = F.lit(None).cast("string")

    def event(kind, text=none, sources=None, message=none):
        sources = F.lit(None).cast(f"array<{SOURCE}>") if sources is None else sources
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), sources.alias("sources"), none.alias("reason"),
                        none.alias("summary"), none.alias("priority"), message.alias("message"))

    nothing = F.array().cast(
        f"array<struct<type:string,text:string,sources:array<{SOURCE}>,reason:string,summary:string,"
        "priority:string,message:string>>")
    words = F.transform(F.split("text", "(?<= )"), lambda w: event("delta", w))
    escalated = F.when(L("text").contains("ent"), F.array(event("escalation"))).otherwise(nothing)
    last = F.when(L("text").contains("sch"), F.array(event("error", message=F.lit("broken")))).otherwise(F.array(event("done")))
    events = F.concat(F.array(event("sources", sources=refs(1)), event("sources", sources=refs(2))), words, escalated, last)
    return turns.select((L("conv_id") * 100 + L("turn")).alias("turn_id"), F.posexplode(events).alias("seq", "_e")).select(
        "turn_id", "seq", "_e.*")


def _folded(place: int) -> str:
    return f"""
      SELECT conv_id * 100 + turn AS turn_id, text AS answer, {place}::BIGINT AS n, conv_id || '/' || turn AS title,
             text LIKE '%ent%' AS escalated, CASE WHEN text LIKE '%sch%' THEN 'broken' END AS error
      FROM conversations WHERE role = 'assistant'"""


def _shown(folded):
    return folded.select("turn_id", "answer", L("sources")[0]["n"].alias("n"), L("sources")[0]["title"].alias("title"),
                         "escalated", "error")


@query(_folded(2))
def turn_fold(spark, sf_dir):
    return _shown(fold_turns(turn_events(spark, sf_dir)))


@query(_folded(1))
def turn_fold_first(spark, sf_dir):
    return _shown(fold_turns(turn_events(spark, sf_dir), keep="first"))


ROWS_A_FILE = 1 << 20


@query(_folded(2))
def turn_fold_stream(spark, sf_dir):
    """Events in files out of order; a turn's error and its done arrive apart, and a last file moves the clock on."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    events = turn_events(spark, sf_dir).withColumn("ts", start)
    done = events.filter("type = 'error'").withColumn("type", F.lit("done")).withColumn("seq", L("seq") + 1)
    empty = events.filter("type = 'sources'").withColumns({"type": F.lit("delta"), "sources": F.lit(None).cast(f"array<{SOURCE}>")})
    events = events.unionByName(done).unionByName(empty)
    path = scratch_path(spark, "arriving")
    # a micro-batch is one file, or several even ones where a file would be large
    files = max(1, min(spark.sparkContext.defaultParallelism, events.count() // (3 * ROWS_A_FILE)))
    for i in range(3):
        events.filter(F.pmod("seq", F.lit(3)) == 2 - i).repartition(files).write.mode("append").parquet(path)
    later = events.limit(1).withColumns({"turn_id": F.lit(-1).cast("bigint"), "ts": start + F.expr("INTERVAL 1 DAY")})
    later.repartition(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)
    folded = drain(fold_turns_stream(source), "turns").filter("turn_id >= 0")
    return _shown(folded.withColumn("sources", F.from_json("sources_json", f"array<{SOURCE}>")))


_EVENTS = """
  SELECT conv_id * 100 + turn AS turn_id, i - 1 AS seq, 'delta' AS type, w AS text FROM (
    SELECT conv_id, turn, unnest(l) AS w, generate_subscripts(l, 1) + 2 AS i FROM (
      SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x, i:
        CASE WHEN i < len(string_split(text, ' ')) THEN x || ' ' ELSE x END) AS l FROM conversations WHERE role = 'assistant'))
  UNION ALL SELECT conv_id * 100 + turn, k, 'sources', NULL FROM conversations, range(2) r(k) WHERE role = 'assistant'
  UNION ALL SELECT conv_id * 100 + turn, len(string_split(text, ' ')) + 2, 'escalation', NULL FROM conversations
    WHERE role = 'assistant' AND text LIKE '%ent%'
  UNION ALL SELECT conv_id * 100 + turn, len(string_split(text, ' ')) + 2 + (text LIKE '%ent%')::INT,
    CASE WHEN text LIKE '%sch%' THEN 'error' ELSE 'done' END, NULL FROM conversations WHERE role = 'assistant'"""


@query(f"SELECT * FROM ({_EVENTS}) WHERE turn_id // 100 % 3 = 0")
def late_events(spark, sf_dir):
    """The turns of a third of the conversations arrive when their time is long over."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    events = turn_events(spark, sf_dir).withColumn("ts", start)
    late = F.floor(L("turn_id") / 100) % 3 == 0
    later = events.limit(1).withColumns({"turn_id": F.lit(-1).cast("bigint"), "ts": start + F.expr("INTERVAL 1 DAY")})
    path = scratch_path(spark, "arriving")
    for part in (events.filter(~late), later, events.filter(late).withColumn("ts", start + F.expr("INTERVAL 2 HOURS"))):
        part.repartition(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return split_late(drain(fold_turns_stream(source), "turns"))[1].select("turn_id", "seq", "type", "text")


def captured(spark, sf_dir):
    """Each turn's events as one captured stream, with noise and an unfinished last frame."""
    event = F.struct("type", "text", "sources", "message")
    frames = turn_events(spark, sf_dir).select(
        "turn_id", "seq", F.concat(F.lit("id: 1\ndata: "), F.to_json(event), F.lit("\n\n")).alias("frame"))
    joined = frames.groupBy("turn_id").agg(F.sort_array(F.collect_list(F.struct("seq", "frame"))).alias("_f"))
    text = F.array_join(F.transform("_f", lambda x: x["frame"]), "event: ping\n\ndata: {broken\n\n")
    return joined.select("turn_id", F.concat(text, F.lit('data: {"type": "done"}')).alias("raw"))


@query(_EVENTS)
def frame_parse(spark, sf_dir):
    parsed = parse_frames(captured(spark, sf_dir))
    return parsed.select("turn_id", L("seq").cast("bigint").alias("seq"), "type", "text")


@query(_EVENTS)
def frame_pieces(spark, sf_dir):
    """The captured streams cut after every 37 bytes, wherever that is."""
    raw = captured(spark, sf_dir).select("turn_id", L("raw").cast("binary").alias("raw"))
    cuts = F.sequence(F.lit(0), F.floor(F.octet_length("raw") / 37).cast("int"))
    pieces = raw.select("turn_id", "raw", F.posexplode(cuts).alias("n", "_k")).select(
        "turn_id", "n", F.substring("raw", L("_k") * 37 + 1, F.lit(37)).alias("piece"))
    return parse_pieces(pieces).select("turn_id", L("seq").cast("bigint").alias("seq"), "type", "text")


_LOG = r"""
  SELECT query_id, round(nearest, 6) AS nearest, '{"kind":"turn","endpoint":"chat","query":' || to_json(text) ||
         CASE WHEN sources IS NULL THEN ',"sources":[]' ELSE ',"sources":[' || sources || ']' END || ',"hybrid":true,"escalated":false,"nearestDistance":#' AS line
  FROM asked LEFT JOIN (
    SELECT query_id, min_by(distance, rnk) AS nearest,
           string_agg('{"title":' || to_json(doc_title) || ',"distance":#}', ',' ORDER BY rnk) AS sources
    FROM hybrid JOIN chunks USING (id) GROUP BY query_id) USING (query_id)"""


@query(sql(_LOG))
def turn_logs(spark, sf_dir):
    """Log line per query; numbers in the line are masked, as engines write them differently."""
    queries = web_queries(spark, sf_dir)
    found = retrieve(queries, knowledge_base(spark, sf_dir), EMBEDDER, PARAMS)
    trace = found.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rnk", L("doc_title").alias("title"), "distance"))).alias("_s"))
    turns = queries.join(trace, "query_id", "left").select(
        "query_id", F.lit("chat").alias("endpoint"), L("text").alias("query"), F.lit(True).alias("hybrid"),
        F.lit(False).alias("escalated"), F.lit(None).cast("string").alias("error"),
        F.coalesce(F.transform("_s", lambda s: F.struct(s["title"].alias("title"), s["distance"].alias("distance"))),
                   F.array().cast("array<struct<title:string,distance:double>>")).alias("sources"),
    )
    masked = F.regexp_replace(F.regexp_replace("line", r'("distance":)[0-9.E\-]+', "$1#"), r'("nearestDistance":)[0-9.E\-]+\}', "$1#")
    return turn_log(turns).select("query_id", F.round("nearestDistance", 6).alias("nearest"), masked.alias("line"))


# --- sinks --------------------------------------------------------------------

_ARCHIVED = """
  SELECT string_agg(text, ' ' ORDER BY turn) AS question, max_by(text, turn) AS answer, conv_id % 2 = 0 AS escalated
  FROM conversations GROUP BY conv_id"""


def _finished(spark, sf_dir):
    rows = messages(spark, sf_dir).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("_t"), F.max_by("text", "turn").alias("answer"))
    return rows.select(F.array_join(F.transform("_t", lambda t: t["text"]), " ").alias("question"), "answer",
                       F.when(L("conv_id") % 2 == 0, True).alias("escalated"))


@query(_ARCHIVED)
def archive_append(spark, sf_dir):
    path = scratch_path(spark, "archive")
    if not archive_turns(_finished(spark, sf_dir), path):
        raise RuntimeError("archive failed")
    return spark.read.parquet(path).select("question", "answer", "escalated")


@query(_ARCHIVED)
def archive_streamed(spark, sf_dir):
    source = _as_stream(_finished(spark, sf_dir))
    path = scratch_path(spark, "archive")
    archive_stream(source, f"{path}/rows", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("question", "answer", "escalated")


@query(sql("SELECT id, doc_title, content FROM chunks"))
def reload_table(spark, sf_dir):
    """Loaded twice; the second load replaces the first."""
    chunks = knowledge_base(spark, sf_dir).chunks
    full_reload(chunks.unionByName(chunks), "chunks_reloaded")
    return full_reload(chunks, "chunks_reloaded").select("id", "doc_title", "content")


@query(sql("SELECT id, upper(doc_title) AS doc_title FROM chunks"))
def shadow_promote(spark, sf_dir):
    """A shadow table built beside the live one takes its name."""
    chunks = knowledge_base(spark, sf_dir).chunks
    full_reload(chunks, "chunks_live")
    full_reload(chunks.withColumn("doc_title", F.upper("doc_title")), "chunks_shadow")
    return promote(spark, "chunks_shadow", "chunks_live").select("id", "doc_title")
