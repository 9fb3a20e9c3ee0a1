"""Turn fold on a stream of events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ragloom.session import ship
from ragloom.streaming.clock import CLOCK, with_clock


LATE = "struct<seq:bigint,type:string,text:string,sources_json:string,message:string,ts:timestamp>"
#: An event while it is held, as JSON: a column and a state of one text cost a call least.
HELD = "seq bigint, type string, text string, sources_json string, message string, at bigint"


def fold_turns_stream(events: DataFrame, ts: str = "ts", idle_seconds: int = 600, lateness: str = "1 hour", keep: str = "last") -> DataFrame:
    """``(turn_id, answer, sources_json, escalated, error, late)``: a row per turn, and a row per late event.

    A turn may send ``error`` and then ``done``, and its events may arrive in any
    order: they are held, by ``seq``, until the watermark shows ``idle_seconds`` of
    event time without one more. Then the turn comes out as the batch fold has
    it, and its state goes. The watermark stays ``lateness`` behind the newest event.

    No event is dropped. One whose turn is not held, and that is so old that its
    turn would have come out already, is late: it comes out by itself in ``late``,
    which is null in the rows of turns (``split_late``).
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be first or last")
    ship(events.sparkSession)
    rows = with_clock(events.withColumn("_at", F.col(ts).cast("timestamp")), F.col("_at"), lateness).select(
        "turn_id", F.to_json(F.struct("seq", "type", "text", F.to_json("sources").alias("sources_json"), "message", F.unix_micros("_at").alias("at"))).alias("event"), CLOCK)

    def fold(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, newest = state.get if state.exists else ("", 0)
        passed = max(0, state.getCurrentWatermarkMs())
        if not state.hasTimedOut:
            found = [e for pdf in chunks for e in pdf["event"].tolist()]  # one turn's events of one micro-batch
            more = ",".join(found)
            # whole milliseconds
            moments = [None if at is None else at // 1000 for at in (e.get("at") for e in json.loads(f"[{more}]"))]
            # an open turn takes every event; a new one is opened by an event that is not late
            if state.exists or any(at is None or at + idle_seconds * 1000 > passed for at in moments):
                newest = max(newest, *(at or 0 for at in moments))
                state.update((f"{held},{more}" if held else more, newest))
                state.setTimeoutTimestamp(max(newest + idle_seconds * 1000, passed + 1))
            else:
                yield pd.DataFrame({"turn_id": [k[0]] * len(found), "answer": None, "sources_json": None, "escalated": None, "error": None, "late": found})
            return
        state.remove()
        events_ = sorted(json.loads(f"[{held}]"), key=lambda e: ("seq" not in e, e.get("seq", 0)))

        def chosen(kind: str, field: str):
            found = [e[field] for e in events_ if e.get("type") == kind and field in e]
            return found[0 if keep == "first" else -1] if found else None

        yield pd.DataFrame({
            "turn_id": [k[0]], "answer": ["".join(e["text"] for e in events_ if e.get("type") == "delta" and "text" in e)],
            "sources_json": [chosen("sources", "sources_json")], "escalated": [any(e.get("type") == "escalation" for e in events_)],
            "error": [chosen("error", "message")], "late": [None],
        })

    types = dict(events.dtypes)
    made = rows.groupBy("turn_id").applyInPandasWithState(
        fold,
        f"turn_id {types['turn_id']}, answer string, sources_json string, escalated boolean, error string, late string",
        "events string, newest bigint",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    e = F.from_json("late", HELD)
    late = F.struct(*[e[c].alias(c) for c in ("seq", "type", "text", "sources_json", "message")], F.timestamp_micros(e["at"]).alias("ts"))
    return made.withColumn("late", F.when(F.col("late").isNotNull(), late).cast(LATE))


def split_late(folded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, late events) of ``fold_turns_stream``, once written."""
    return folded.filter("late IS NULL").drop("late"), folded.filter("late IS NOT NULL").select("turn_id", "late.*")
