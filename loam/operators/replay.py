"""Order-dependent state over past events, replayed in batch: limiters, caches with expiry, least-recently-used.

A key's events are folded in order by iterating over sorted partitions, so memory holds one key's state, not its
events; a key with any number of events is a stream of sorted rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Requests of a window and its seconds.
LIMIT, WINDOW_S = 10, 60


def _sorted(events: DataFrame, key: str) -> DataFrame:
    return events.repartition(F.col(key)).sortWithinPartitions(key, "ts", "event_id")


def rate_limit(events: DataFrame, key: str, limit: int = LIMIT, window_s: float = WINDOW_S) -> DataFrame:
    """(event_id, allowed): a window opens with the first event after the last one has ended; limit events pass."""
    span = int(window_s * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, reset, count = object(), 0, 0
        for b in batches:
            out = []
            for k, t in zip(b["k"], b["t"]):
                if k != now:
                    now, reset, count = k, None, 0
                if reset is None or t > reset:
                    reset, count = t + span, 1
                    out.append(limit >= 1)
                elif count >= limit:
                    out.append(False)
                else:
                    count += 1
                    out.append(True)
            yield pd.DataFrame({"event_id": b["event_id"], "allowed": out})

    held = _sorted(events.where("ts is not null"), key).select(F.col(key).cast("string").alias("k"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return held.mapInPandas(run, "event_id bigint, allowed boolean")


def cache_replay(events: DataFrame, key: str, ttl_s: float | None = None) -> DataFrame:
    """(event_id, hit): a key is held from its write until ttl; hits do not renew it."""
    span = None if ttl_s is None else int(ttl_s * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, written = object(), None
        for b in batches:
            out = []
            for k, t in zip(b["k"], b["t"]):
                if k != now:
                    now, written = k, None
                hit = written is not None and (span is None or t - written <= span)
                if not hit:
                    written = t
                out.append(hit)
            yield pd.DataFrame({"event_id": b["event_id"], "hit": out})

    held = _sorted(events.where("ts is not null"), key).select(F.col(key).cast("string").alias("k"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return held.mapInPandas(run, "event_id bigint, hit boolean")


def lru_replay(events: DataFrame, space: str, key: str, size: int, ttl_s: float | None = None) -> DataFrame:
    """(event_id, hit): each space holds the size keys used last, each until ttl_s after its write (a hit does not renew
    that). A space is worked through in order by one task: what it holds depends on all events before."""
    span = None if ttl_s is None else int(ttl_s * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = object(), OrderedDict()
        for b in batches:
            out = []
            for s, k, t in zip(b["s"], b["k"], b["t"]):
                if s != now:
                    now, held = s, OrderedDict()
                hit = k in held and (span is None or t - held[k] <= span)
                if not hit:
                    held[k] = t
                held.move_to_end(k)
                if len(held) > size:
                    held.popitem(last=False)
                out.append(hit)
            yield pd.DataFrame({"event_id": b["event_id"], "hit": out})

    ordered = events.where("ts is not null").repartition(F.col(space)).sortWithinPartitions(space, "ts", "event_id")
    return ordered.select(F.col(space).cast("string").alias("s"), F.col(key).cast("string").alias("k"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).mapInPandas(run, "event_id bigint, hit boolean")


def hit_counts(replayed: DataFrame) -> DataFrame:
    """(hits, misses) of a replayed cache (event_id, hit)."""
    return replayed.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
