"""Request limit on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ragloom.functions.clock import micros
from ragloom.operators.ratelimit import NEVER, limit_key, open_windows
from ragloom.session import ship
from ragloom.streaming.clock import with_clock


def rate_limit_stream(
    requests: DataFrame,
    window_seconds: int,
    max_requests: int,
    key: str = "key",
    ts: str = "ts",
    order: str = "id",
    lateness_seconds: int | None = None,
) -> DataFrame:
    """``(key, id, ts, limited, late)`` as requests arrive; every request comes out.

    Requests are decided in order of arrival, those of a micro-batch by time and
    id. The clock of a key never runs back: a request older than one before it
    is ``late`` and is decided at the time the clock shows. Nor does it stay more
    than ``lateness_seconds``, ten windows unless given, behind the newest
    request of earlier micro-batches. So replay in order equals the batch
    result, whatever pauses it makes and however its batches are cut. Requests
    without a key are counted together; those without a time come out with
    ``limited`` null and change nothing.

    The state of a key is its clock, the end of its open window and the count
    inside it. It goes when event time has passed that end for good: from then on
    a request opens a window, with the state or without it.
    """
    ship(requests.sparkSession)
    window = window_seconds * 1_000_000
    lateness = 10 * window_seconds if lateness_seconds is None else lateness_seconds
    types = {c: t for c, t in requests.dtypes}
    rows = requests.select(limit_key(F.col(key)).alias("group"), F.col(key).alias("key"), F.col(order).alias("id"), micros(requests, ts).alias("_t"))
    rows = with_clock(rows, F.timestamp_micros("_t"), f"{lateness} seconds")

    def fold(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        clock, reset, count = state.get if state.exists else (NEVER, NEVER, 0)
        passed = state.getCurrentWatermarkMs()
        clock = max(clock, passed * 1000) if passed > 0 else clock  # none before the first batch
        pdfs = list(chunks)  # one key's rows of one micro-batch
        pdf = pdfs[0] if len(pdfs) == 1 else pd.concat(pdfs)
        if pdf["_t"].dtype.kind != "i":  # whole numbers only where none is missing
            unknown = pdf["_t"].isna()
            if unknown.any():
                lost = pdf[unknown]
                yield lost[["key", "id", "_t"]].assign(limited=None, late=False)
                pdf = pdf[~unknown]
        if len(pdf):
            own, ids = pdf["_t"].to_numpy().astype(np.int64), pdf["id"].to_numpy()
            # a call a key and micro-batch: what pandas does for one is most of its time
            order = np.lexsort((ids, own)) if ids.dtype.kind in "iu" else pdf.reset_index(drop=True).sort_values(["_t", "id"]).index.to_numpy()
            own = own[order]
            t = np.maximum.accumulate(np.r_[clock, own])[1:]
            place, opens = open_windows(t, window, reset)
            starts = np.r_[0, opens]
            nth = np.arange(len(t)) - starts[place + 1] + 1 + np.where(place < 0, count, 0)
            if len(opens):
                reset = int(t[opens[-1]]) + window
            clock, count = int(t[-1]), int(nth[-1])
            yield pd.DataFrame({"key": pdf["key"].to_numpy()[order], "id": ids[order], "_t": own, "limited": nth > max_requests, "late": own < t})
        if reset > NEVER:
            state.update((clock, reset, count))
            # a whole millisecond behind the end, and ahead of the watermark as Spark wants it
            state.setTimeoutTimestamp(max(reset // 1000, passed) + 1)

    out = f"key {types[key]}, id {types[order]}, _t bigint, limited boolean, late boolean"
    folded = rows.groupBy("group").applyInPandasWithState(
        fold, out, "clock bigint, reset bigint, count bigint", "append", GroupStateTimeout.EventTimeTimeout
    )
    return folded.select(F.col("key").alias(key), F.col("id").alias(order), F.timestamp_micros("_t").alias(ts), "limited", "late")
