"""Tile state from ordered load events, in batch: the same rules that the streaming form applies event by event.

States: unloaded, loading, loaded, empty, failed, retry. A retry waits ``min(2^min(n, 6), 64)`` frames, and
after ``limit`` retries a tile has failed for good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def backoff(retries: Column) -> Column:
    """Frames to wait after so many retries."""
    return F.least(F.pow(F.lit(2.0), F.least(retries, F.lit(6))), F.lit(64.0)).cast("int")


STATE = "struct<state:string,retries:int,bytes:bigint,since:bigint>"


def step(s: Column, kind: Column, size: Column, at: Column, limit: int) -> Column:
    """The state after an event: a success forgets the retries; a failure, or one retry too many, stands until a success."""
    retry = s["retries"] + 1
    state = F.when(kind == "loaded", "loaded").when(kind == "empty", "empty").when(kind == "failed", "failed").when(retry > limit, "failed").otherwise("retry")
    retries = F.when(kind == "retry", F.least(retry, F.lit(limit + 1))).when(kind == "failed", s["retries"]).otherwise(0)
    held = F.when(kind == "loaded", size).otherwise(0).cast("bigint")
    since = F.when(state == s["state"], s["since"]).otherwise(at)
    return F.struct(state.alias("state"), retries.cast("int").alias("retries"), held.alias("bytes"), since.alias("since")).cast(STATE)


def fold_events(events: DataFrame, key: str, order: list[str], kind: Column, size: Column, limit: int = 3) -> DataFrame:
    """(key, state, retries, bytes, since): the state of each tile after all its events. A tile's events meet in one row, in order."""
    sorted_ = F.array_sort(F.collect_list(F.struct(*order, kind.alias("kind"), size.alias("size"))))
    start = F.struct(F.lit("unloaded").alias("state"), F.lit(0).alias("retries"), F.lit(0).cast("bigint").alias("bytes"), F.lit(0).cast("bigint").alias("since")).cast(STATE)
    last = F.aggregate("events", start, lambda s, e: step(s, e["kind"], e["size"].cast("bigint"), e[order[-1]].cast("bigint"), limit))
    return events.groupBy(key).agg(sorted_.alias("events")).select(key, last.alias("s")).select(key, "s.*")


def stale(now: DataFrame, before: DataFrame, state: DataFrame) -> DataFrame:
    """Tiles held in ``state`` that neither this frame nor the one before asks for."""
    return state.join(now, "tile_id", "left_anti").join(before, "tile_id", "left_anti")


def expired(state: DataFrame, now: Column) -> DataFrame:
    """Loaded tiles whose age exceeds their greatest; a null greatest age never ends."""
    return state.where((F.col("state") == "loaded") & F.col("max_age").isNotNull() & (now - F.col("loaded_at") > F.col("max_age")))


def pressure(usages: Column, budget: int, nominal: float = 16.0, ratio: float = 1.02) -> Column:
    """The threshold after frames of memory use: up by the ratio over the budget, down within it, never below the nominal one."""
    return F.aggregate(usages, F.lit(nominal), lambda t, u: F.when(u > budget, t * ratio).otherwise(F.greatest(F.lit(nominal), t / ratio)))
