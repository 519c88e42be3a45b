"""Streaming operators: windows, deduplication, ingest, counting triggers, change feeds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def zoned(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums per event-time window and type; rows later than ``late`` may be left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def distinct_events(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def every_nth(events: DataFrame, n: int) -> DataFrame:
    """(user_id, fired): how often a user's counter has reached another ``n``; the counter is the state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        after = before + sum(len(b) for b in batches)
        state.update((after,))
        yield pd.DataFrame({"user_id": [key[0]], "fired": [after // n - before // n]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, fired long", "seen long", "append", GroupStateTimeout.NoTimeout)


def absorbed(turns: DataFrame, late: str = "3650 days") -> DataFrame:
    """Rows that an ingest keeps of arriving turns: long enough, with the text as it is stored, and none that says what
    another has said already (case, marks and blanks aside), as far as the watermark reaches back."""
    c = F.trim("content")
    role = F.lower(F.trim("role"))
    said = F.regexp_replace(F.lower("content"), r"[^\p{L}\p{N}]+", " ")
    kept = turns.where(F.char_length(c) >= 20).select("turn_id", F.when(role == "user", "user-msg").otherwise("asst-msg").alias("label"), F.concat(F.when(role == "user", "Q: ").otherwise("A: "), F.substring("content", 1, 500)).alias("content"), F.md5(F.trim(said)).alias("said"), F.coalesce(F.col("created_at").cast("timestamp"), F.timestamp_seconds(F.lit(1704067200))).alias("at"))
    return kept.withWatermark("at", late).dropDuplicatesWithinWatermark(["label", "said"]).drop("at")


def changes(rows: DataFrame, tab: str, kind, at: str) -> DataFrame:
    """An event per arriving row: tab, row_id, kind, at.  Offsets of the source are the high-water mark."""
    return rows.select(F.lit(tab).alias("tab"), F.col("id").alias("row_id"), kind.alias("kind"), F.col(at).cast("timestamp").alias("at"))


def idle_runs(events: DataFrame, idle: str, late: str = "1 day") -> DataFrame:
    """(user_id, run_at): when a user has been idle for ``idle`` after a burst of events, which is when a cycle may run."""
    w = F.session_window("ts", idle)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.end").alias("run_at"), "n")


def last_seen(events: DataFrame, ttl_ms: int, late: str = "1 day") -> DataFrame:
    """(event_type, last_at, expired): a state per type that expires when event time has passed its last event by ``ttl_ms``.

    A type gives a row when its state is written (expired is false) and one when it times out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"event_type": [key[0]], "last_at": [pd.Timestamp(last, unit="us", tz="UTC")], "expired": [True]})
            return
        last = state.get[0] if state.exists else 0
        for b in batches:
            last = max(last, int(b["ts"].max().as_unit("ns").value // 1000))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_type": [key[0]], "last_at": [pd.Timestamp(last, unit="us", tz="UTC")], "expired": [False]})

    return events.withWatermark("ts", late).groupBy("event_type").applyInPandasWithState(step, "event_type string, last_at timestamp, expired boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)
