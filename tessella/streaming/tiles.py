"""Streams of load events: per-tile state, and windowed counts of late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "state string, retries int, bytes long, since timestamp"
OUTPUT = "tile_id long, ts timestamp, state string, retries int, bytes long"


def advance(state: tuple, kind: str, size: int, at, limit: int) -> tuple:
    """The state after one event: (state, retries, bytes, since). A retry beyond the limit has failed; a success forgets retries."""
    name, retries, _, since = state
    if kind in ("loaded", "empty"):
        new, retries = kind, 0
    elif kind == "failed" or retries + 1 > limit:
        new, retries = "failed", min(retries + (kind == "retry"), limit + 1)
    else:
        new, retries = "retry", retries + 1
    return new, retries, size if new == "loaded" else 0, since if new == name else at


def tile_states(events: DataFrame, limit: int = 3, ttl: str | None = None) -> DataFrame:
    """The state of each tile after every micro-batch that changes it.

    ``events``: tile_id, ts, event_id, kind, size; events of one batch apply in order of ts and
    event_id. With ``ttl``, a tile without events for that long of event time is unloaded; the stream
    needs a watermark for it.
    """
    millis = None if ttl is None else int(pd.Timedelta(ttl).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"tile_id": [key[0]], "ts": [pd.NaT], "state": ["unloaded"], "retries": [0], "bytes": [0]})
            return
        now = state.get if state.exists else ("unloaded", 0, 0, None)
        frame = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        for at, kind, size in zip(frame["ts"], frame["kind"], frame["size"]):
            now = advance(now, kind, int(size), at.to_pydatetime(), limit)
        state.update(now)
        last = frame["ts"].iloc[-1]
        if millis is not None:
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + millis)
        yield pd.DataFrame({"tile_id": [key[0]], "ts": [last], "state": [now[0]], "retries": [now[1]], "bytes": [now[2]]})

    timeout = GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.EventTimeTimeout
    return events.groupBy("tile_id").applyInPandasWithState(run, OUTPUT, STATE, "update", timeout)


def load_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and loaded bytes by window and kind; events later than ``late`` behind the newest are dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("n"), F.sum(F.when(F.col("kind") == "loaded", F.col("size")).otherwise(0)).alias("bytes"))
    return grouped.select(F.col("window.start").alias("start"), "kind", "n", "bytes")


def first_of_each(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events without repeats of one id within the watermark: at-least-once delivery made exact."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
