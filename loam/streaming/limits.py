"""Streaming forms of the limiter and the cache: one keyed state, arrival order, the same decisions as in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def limit_stream(events: DataFrame, key: str, limit: int, window_s: float) -> DataFrame:
    """(event_id, allowed) of a stream: anchored windows, as operators.replay.rate_limit. State: end of window, count."""
    span = int(window_s * 1_000_000)

    def run(_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reset, count = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        out = []
        for t in rows["t"]:
            if reset < 0 or t > reset:
                reset, count = int(t) + span, 1
                out.append(limit >= 1)
            elif count >= limit:
                out.append(False)
            else:
                count += 1
                out.append(True)
        state.update((reset, count))
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "allowed": out})

    held = events.where("ts is not null").select(F.col(key).cast("string").alias("k"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return held.groupBy("k").applyInPandasWithState(run, "event_id bigint, allowed boolean", "reset bigint, count bigint", "append", GroupStateTimeout.NoTimeout)


def cache_stream(events: DataFrame, key: str, ttl_s: float) -> DataFrame:
    """(event_id, hit) of a stream: a key is held from its write until ttl."""
    span = int(ttl_s * 1_000_000)

    def run(_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        written = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        out = []
        for t in rows["t"]:
            hit = written is not None and t - written <= span
            if not hit:
                written = int(t)
            out.append(hit)
        state.update((written,))
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "hit": out})

    held = events.where("ts is not null").select(F.col(key).cast("string").alias("k"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return held.groupBy("k").applyInPandasWithState(run, "event_id bigint, hit boolean", "written bigint", "append", GroupStateTimeout.NoTimeout)
