import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from ragloom.operators.ratelimit import client_key, rate_limit
from ragloom.operators.turns import EVENT, fit_log_query, fold_turns, parse_frames, parse_pieces, turn_log
from ragloom.session import scratch_path
from ragloom.sources.archive import archive_batch, archive_turns
from ragloom.sources.tables import checked_name, full_reload, promote
from ragloom.streaming.frames import parse_pieces_stream
from ragloom.streaming.ratelimit import rate_limit_stream
from ragloom.streaming.sinks import drain
from ragloom.streaming.turns import fold_turns_stream, split_late

START = dt.datetime(2024, 1, 1)


def limited_by_loop(rows, window, most):
    hits, out = {}, {}
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        count, reset = hits.get(key, (0, None))
        if reset is None or t > reset:
            hits[key], out[i] = (1, t + window), False
        else:
            hits[key], out[i] = (count + 1, reset), count + 1 > most
    return out


def requests(seed, n=1500, horizon=4000):
    rnd = random.Random(seed)
    keys = ["hot"] * 4 + ["a", "b", "c", ""]
    rows = [(i, rnd.choice(keys), rnd.randint(0, horizon)) for i in range(n)]
    return rows + [(n + i, "edge", t) for i, t in enumerate((0, 60, 60, 61, 121, 122, 500))]


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, k, START + dt.timedelta(seconds=t)) for i, k, t in rows], "id bigint, key string, ts timestamp_ntz").repartition(5)


@pytest.mark.parametrize("slice_seconds", [None, 7, 60, 61, 300, 100_000])
def test_batch_limit_equals_a_loop(spark, slice_seconds):
    rows = requests(1)
    got = {r["id"]: r["limited"] for r in rate_limit(frame(spark, rows), 60, 5, slice_seconds=slice_seconds).collect()}
    assert got == limited_by_loop(rows, 60, 5)


def test_batch_limit_over_small_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        rows = requests(2, horizon=40_000)
        got = {r["id"]: r["limited"] for r in rate_limit(frame(spark, rows), 60, 2, slice_seconds=500).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == limited_by_loop(rows, 60, 2)


def test_stream_in_batches_equals_batch(spark, tmp_path):
    rows = sorted(requests(3), key=lambda r: (r[2], r[0]))
    for n, part in enumerate((rows[:500], rows[500:900], rows[900:])):
        last_t = part[-1][2]
        assert n == 2 or last_t <= rows[(500, 900)[n]][2]
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = frame(spark, rows[:1]).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = rate_limit_stream(source, 60, 5)
    got = {r["id"]: r["limited"] for r in drain(stream, idle_batches=False).collect()}
    assert got == limited_by_loop(rows, 60, 5)


def test_stream_with_a_pause_and_a_backlog_equals_batch(spark, tmp_path):
    # "early" trips its limit, is silent while others go on for long, and comes back inside its window
    rows = [(i, "early", t) for i, t in enumerate((0, 1, 2, 3))] + [(10 + i, "busy", 4 + i) for i in range(40)]
    rows += [(100, "early", 45), (101, "early", 58), (102, "early", 61), (103, "early", 200), (104, "busy", 5000), (105, "early", 5001)]
    parts, path = [rows[:4], rows[4:30], rows[30:45], rows[45:47], rows[47:]], str(tmp_path / "in")
    stream = lambda: rate_limit_stream(
        spark.readStream.schema(frame(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(path), 60, 3, lateness_seconds=0)
    for stop in (1, 2, 5):  # each run goes on where the last one ended; the last one finds three files
        for part in parts[{1: 0, 2: 1, 5: 2}[stop]:stop]:
            frame(spark, part).coalesce(1).write.mode("append").parquet(path)
        got = drain(stream(), path=str(tmp_path / "run"))
    assert {r["id"]: r["limited"] for r in got.collect()} == limited_by_loop(rows, 60, 3)
    assert got.count() == len(rows)


def test_a_request_behind_the_watermark_is_decided_at_it(spark, tmp_path):
    batches = [[(1, "a", 0), (2, "b", 1000)], [(3, "a", 5), (4, "a", 6), (5, "c", 1001)], [(6, "a", 950), (7, "a", 1002)]]
    for b in batches:
        frame(spark, b).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frame(spark, batches[0]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["id"]: (r["limited"], r["late"]) for r in drain(rate_limit_stream(source, 60, 2, lateness_seconds=100)).collect()}
    # the window of 3 and 4 opens at 900, where the clock stands, and holds 6; 7 is beyond its end
    assert got == {1: (False, False), 2: (False, False), 3: (False, True), 4: (False, True), 5: (False, False), 6: (True, False), 7: (False, False)}


def test_limit_keeps_requests_without_key_or_time(spark, tmp_path):
    rows = [(1, None, START), (2, "unknown", START), (3, "a", None), (4, None, START), (5, "a", START)]
    df = spark.createDataFrame(rows, "id bigint, key string, ts timestamp_ntz")
    want = {1: False, 2: True, 3: None, 4: True, 5: False}
    assert {r["id"]: r["limited"] for r in rate_limit(df, 60, 1).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rate_limit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 60, 1)
    assert {r["id"]: r["limited"] for r in drain(stream, idle_batches=False).collect()} == want


def test_slices_follow_the_densest_key(spark, monkeypatch):
    from ragloom.operators import ratelimit

    monkeypatch.setattr(ratelimit, "SLICE_TICKS", 40)
    rows = requests(4)
    got = {r["id"]: r["limited"] for r in rate_limit(frame(spark, rows), 60, 5).collect()}
    assert got == limited_by_loop(rows, 60, 5)


@pytest.mark.parametrize("header, want", [(" 1.2.3.4 , 5.6.7.8", "1.2.3.4"), (None, "unknown"), ("", ""), (",x", "")])
def test_client_key(one, header, want):
    assert one(client_key(F.col("h")), h=header) == want


# --- turns --------------------------------------------------------------------

def events(spark):
    src = lambda t: [(1, t, None, None)]
    rows = [
        (1, 3, "delta", "b", None, None), (1, 1, "delta", "a", None, None), (1, 0, "sources", None, src("x"), None),
        (1, 4, "sources", None, src("y"), None), (1, 5, "escalation", None, None, None), (1, 6, "error", None, None, "e1"),
        (1, 7, "error", None, None, "e2"), (2, 0, "done", None, None, None),
    ]
    return spark.createDataFrame(
        rows, "turn_id int, seq int, type string, text string, sources array<struct<n:bigint,title:string,category:string,url:string>>, message string")


@pytest.mark.parametrize("keep, title, error", [("last", "y", "e2"), ("first", "x", "e1")])
def test_fold(spark, keep, title, error):
    got = {r["turn_id"]: r for r in fold_turns(events(spark), keep).collect()}
    assert (got[1]["answer"], got[1]["sources"][0]["title"], got[1]["escalated"], got[1]["error"]) == ("ab", title, True, error)
    assert (got[2]["answer"], got[2]["sources"], got[2]["escalated"], got[2]["error"]) == ("", [], False, None)


def test_stream_fold_gives_one_row_a_turn(spark, tmp_path):
    schema = "turn_id int, seq int, type string, text string, sources array<struct<n:bigint,title:string,category:string,url:string>>, message string, ts timestamp"
    at = lambda s: START + dt.timedelta(seconds=s)
    batches = [
        [(1, 1, "delta", "b", None, None, at(0)), (2, 0, "delta", "lost", None, None, at(1)), (5, 1, "error", None, None, "boom", at(1))],
        [(1, 0, "delta", "a", None, None, at(2)), (1, 2, "done", None, None, None, at(3)), (1, 3, "delta", None, None, None, at(3))],
        [(5, 0, "delta", "x", None, None, at(4)), (5, 2, "done", None, None, None, at(5))],
        [(3, 0, "done", None, None, None, at(99_000))],
    ]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r["turn_id"], r["answer"], r["error"]) for r in drain(fold_turns_stream(source, idle_seconds=60)).collect())
    assert got == [(1, "ab", None), (2, "lost", None), (5, "x", "boom")]


def test_late_events_reappear(spark, tmp_path):
    schema = "turn_id int, seq int, type string, text string, sources array<struct<n:bigint,title:string,category:string,url:string>>, message string, ts timestamp"
    at = lambda s: START + dt.timedelta(seconds=s)
    batches = [
        [(1, 0, "delta", "a", None, None, at(0)), (2, 0, "delta", "x", None, None, at(7300))],
        [(9, 0, "delta", "z", None, None, at(10))],  # two hours behind; its turn would be out
        [(1, 1, "delta", "too late", None, None, at(1)), (2, 1, "delta", "y", None, None, at(1)), (4, 0, "done", None, None, None, None)],
        [(3, 0, "done", None, None, None, at(99_000))],
        [(5, 0, "done", None, None, None, at(199_000))],
    ]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    turns, late = split_late(drain(fold_turns_stream(source, idle_seconds=60)))
    assert sorted((r["turn_id"], r["answer"]) for r in turns.collect()) == [(1, "a"), (2, "xy"), (3, ""), (4, "")]
    assert sorted((r["turn_id"], r["seq"], r["text"], r["ts"]) for r in late.collect()) == [(1, 1, "too late", at(1)), (9, 0, "z", at(10))]


def test_frames(spark):
    raw = (
        'data: {"type":"delta","text":"a\\n"}\n\n: ping\n\ndata: {bad\n\nid: 7\ndata:{"type":"delta","text":"b"}\ndata: {"type":"x"}\n\n'
        'data: {"type":"done"}'
    )
    df = spark.createDataFrame([(1, raw), (2, ""), (3, 'data: {"type":"done"}\n\n')], "turn_id int, raw string")
    got = [(r["turn_id"], r["seq"], r["type"], r["text"]) for r in parse_frames(df).orderBy("turn_id", "seq").collect()]
    assert got == [(1, 0, "delta", "a\n"), (1, 1, "delta", "b"), (3, 0, "done", None)]
    assert "sources" in EVENT


def cut_anywhere(seed):
    rnd, streams, pieces = random.Random(seed), {}, []
    for turn in range(6):
        frames = [rnd.choice(['data: {"type":"delta","text":"é漢\\n%d"}' % i, ": ping", "data: {bad", 'id: 7\ndata:{"type":"done"}', ""]) for i in range(20)]
        streams[turn] = "\n\n".join(frames) + rnd.choice(["", "\n", "\n\n"])
        raw = streams[turn].encode()
        cuts = sorted({0, len(raw), *(rnd.randrange(len(raw)) for _ in range(30))})
        parts = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        parts[3:3] = [None, b""]
        pieces += [(turn, n, part, START + dt.timedelta(seconds=n)) for n, part in enumerate(parts)]
    rnd.shuffle(pieces)
    return streams, pieces


def test_frames_cut_anywhere(spark, tmp_path):
    streams, pieces = cut_anywhere(4)
    whole = parse_frames(spark.createDataFrame(list(streams.items()), "turn_id int, raw string"))
    want = sorted(map(tuple, whole.select("turn_id", "seq", "type", "text").collect()), key=str)
    df = spark.createDataFrame(pieces, "turn_id int, n int, piece binary, ts timestamp")
    assert sorted(map(tuple, parse_pieces(df).select("turn_id", "seq", "type", "text").collect()), key=str) == want
    for i in range(3):
        spark.createDataFrame(pieces[i::3], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}
    for r in sorted(drain(parse_pieces_stream(source)).collect(), key=lambda r: (r["turn_id"], r["seq"])):
        got.setdefault(r["turn_id"], []).append((r["type"], r["text"]))
    assert sorted(((t, i, *e) for t, es in got.items() for i, e in enumerate(es)), key=str) == want


def test_turn_log(spark):
    df = spark.createDataFrame(
        [("chat", "q", [("A", 0.25), ("B", 0.1)], 12, None, False), ("chat", "q", [], None, "boom", True)],
        "endpoint string, query string, sources array<struct<title:string,distance:double>>, totalMs int, error string, escalated boolean")
    one, two = (json.loads(r["line"]) for r in turn_log(df).collect())
    assert one == {"kind": "turn", "endpoint": "chat", "query": "q", "sources": [{"title": "A", "distance": 0.25}, {"title": "B", "distance": 0.1}],
                   "totalMs": 12, "escalated": False, "nearestDistance": 0.25}
    assert two["nearestDistance"] is None and two["error"] == "boom" and "totalMs" not in two
    assert spark.range(1).select(fit_log_query(F.lit("x" * 200))).head()[0] == "(fit) " + "x" * 120


# --- sinks --------------------------------------------------------------------

def test_archive(spark, tmp_path):
    turns = spark.createDataFrame([("q", "a", None), ("r", None, True)], "question string, answer string, escalated boolean")
    path = str(tmp_path / "archive")
    assert not archive_turns(turns, path, enabled=False)
    assert archive_turns(turns, path) and archive_turns(turns, path)
    got = spark.read.parquet(path)
    assert got.count() == 4 and got.filter("created_at IS NULL OR escalated IS NULL").count() == 0
    (tmp_path / "file").write_text("in the way")
    assert not archive_turns(turns, str(tmp_path / "file"))  # logged, not raised


def test_replayed_batch_replaces_itself(spark, tmp_path):
    turns = spark.createDataFrame([("q", "a", False)], "question string, answer string, escalated boolean")
    path = str(tmp_path / "archive")
    write = archive_batch(path)
    for batch in (0, 1, 1):
        write(turns, batch)
    assert archive_turns(turns, path)  # the same layout
    got = spark.read.parquet(path)
    assert got.count() == got.select("id").distinct().count() == 3
    (tmp_path / "file").write_text("in the way")
    with pytest.raises(Exception):  # the batch fails and comes again
        archive_batch(str(tmp_path / "file"))(turns, 0)


@pytest.mark.parametrize("name", ["Kb", "1kb", "kb-x", "kb;drop", "", "kb\n"])
def test_table_names(name):
    with pytest.raises(ValueError):
        checked_name(name)


def test_reload_and_promote(spark):
    where = scratch_path(spark, "tables")
    first, second = spark.range(3), spark.range(5)
    assert full_reload(first, "t_live", where).count() == 3
    assert full_reload(second, "t_live", where).count() == 5
    broken = second.select(F.raise_error(F.lit("no")).cast("bigint").alias("id"))
    with pytest.raises(Exception):
        full_reload(broken, "t_live", where)
    assert spark.table("t_live").count() == 5
    full_reload(first, "t_shadow", where)
    assert promote(spark, "t_shadow", "t_live").count() == 3
    stored = [r["tableName"] for r in spark.sql("SHOW TABLES LIKE 't_*__*'").collect()]
    assert len(stored) == 1  # what both names stand for
    full_reload(second, "t_shadow", where)
    assert spark.table("t_live").count() == 3


def test_large_micro_batches_are_several_files(spark, tmp_path, monkeypatch):
    """Three micro-batches and the last, whatever the number of files; the same turns as in one."""
    import workload.streams as streams

    rnd = random.Random(7)
    rows = [(c, t, rnd.choice(["user", "assistant"]), " ".join(rnd.choice(["ent", "sch", "a\u00e9", "b\"\n"]) for _ in range(rnd.randint(1, 20))))
            for c in range(12) for t in range(1, 5)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    want = sorted(map(str, streams.turn_fold(spark, str(tmp_path)).collect()))
    seen = []
    drain = streams.drain
    monkeypatch.setattr(streams, "scratch_path", lambda spark, label: f"{tmp_path}/{label}-{streams.ROWS_A_FILE}")
    monkeypatch.setattr(streams, "drain", lambda s, label: seen.append(s) or drain(s, path=f"{tmp_path}/out-{streams.ROWS_A_FILE}"))
    for most in (1 << 20, 20):
        monkeypatch.setattr(streams, "ROWS_A_FILE", most)
        assert sorted(map(str, streams.turn_fold_stream(spark, str(tmp_path)).collect())) == want
        assert len([f for f in (tmp_path / f"out-{most}" / "state" / "sources" / "0").iterdir() if f.name.isdigit()]) == 4
    files = [len(list((tmp_path / f"arriving-{most}").glob("*.parquet"))) for most in (1 << 20, 20)]
    assert files[0] == 4 < files[1]


def test_late_events_keep_every_field(spark, tmp_path):
    """Held as text, an event comes out as it came: to the microsecond, nulls and quotes included."""
    at = dt.datetime(2024, 1, 1, 0, 0, 5, 123457)
    src = "array<struct<n:bigint,title:string,category:string,url:string>>"
    kind = f"turn_id long, seq long, type string, text string, sources {src}, message string, ts timestamp"
    spark.createDataFrame([(1, 0, "delta", "x", None, None, at + dt.timedelta(days=9))], kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = [(2, 3, "delta", 'q"\\\n{é', None, None, at), (2, None, None, None, [(1, "T", None, "u")], "m", at), (3, 0, "done", "", None, "", at)]
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    _, late = split_late(drain(fold_turns_stream(source)))
    got = sorted(map(tuple, late.select("turn_id", "seq", "type", "text", "sources_json", "message", "ts").collect()), key=str)
    assert got == sorted([(2, 3, "delta", 'q"\\\n{é', None, None, at), (2, None, None, None, '[{"n":1,"title":"T","url":"u"}]', "m", at), (3, 0, "done", "", None, "", at)], key=str)
