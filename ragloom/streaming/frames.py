"""Events of captured streams that arrive in pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ragloom.operators.turns import cut_frames, frame_events
from ragloom.session import ship
from ragloom.streaming.clock import CLOCK, with_clock


def parse_pieces_stream(pieces: DataFrame, ts: str = "ts", order: str = "n", piece: str = "piece", idle_seconds: int = 3600) -> DataFrame:
    """``(turn_id, seq, <event fields>)`` as pieces arrive; ``seq`` numbers all frames of a stream.

    Pieces are numbered from 0 and may arrive in any order: one that comes before
    its turn is held. What a stream keeps is the rest of its last frame and the
    pieces held; both go after ``idle_seconds`` of event time without a piece. A
    piece that comes again is skipped.
    """
    ship(pieces.sparkSession)
    at = F.col(ts).cast("timestamp")
    rows = with_clock(pieces, at, f"{idle_seconds} seconds").select(
        "turn_id", F.col(order).cast("long").alias("n"), F.col(piece).cast("binary").alias("piece"), F.unix_millis(at).alias("at"), CLOCK)

    def cut(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        carry, following, seq, newest, numbers, held = state.get if state.exists else (b"", 0, 0, 0, [], [])
        waiting = dict(zip(numbers, map(bytes, held), strict=True))
        for pdf in chunks:
            newest = max([newest, *(int(t) for t in pdf["at"].dropna())])
            for n, part in zip(pdf["n"], pdf["piece"], strict=True):
                if n >= following:
                    waiting[int(n)] = b"" if part is None else bytes(part)
        frames: list[bytes] = []
        carry = bytes(carry)
        while following in waiting:
            done, carry = cut_frames(carry, waiting.pop(following))
            frames += done
            following += 1
        state.update((carry, following, seq + len(frames), newest, list(waiting), list(waiting.values())))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs(), 0) + 1)
        yield pd.DataFrame({"turn_id": [k[0]] * len(frames), "seq": range(seq, seq + len(frames)), "frame": frames})

    kept = "carry binary, following bigint, seq bigint, newest bigint, numbers array<bigint>, held array<binary>"
    kind = dict(pieces.dtypes)["turn_id"]
    made = rows.groupBy("turn_id").applyInPandasWithState(
        cut, f"turn_id {kind}, seq bigint, frame binary", kept, "append", GroupStateTimeout.EventTimeTimeout)
    return frame_events(made)
