"""Streaming forms: windows with watermarks, and custom state per clip.

The batch and streaming forms share their step functions and expressions.
Late rows beyond the watermark are dropped; state of a clip expires when no
row came for ``idle`` of event time or processing time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinelake.functions.kernels import kickoff_step
from kinelake.session import ship


def tumbling_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per tumbling window of event time (column ts)."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("w.start").alias("start_s"), "n", (F.col("n") % 2 == 1).alias("odd"))


def sliding_counts(events: DataFrame, window: str = "6 hours", slide: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Rows and approximate users per sliding window (exact distinct counts need the batch form)."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).select(F.unix_seconds("w.start").alias("start_s"), "n", "mean_value")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions per user."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


def deficit_stream(frames: DataFrame, expected: int = 3, keep: int = 13, idle_ms: int = 60_000) -> DataFrame:
    """Trailing median of the last ``keep`` counts per clip; input clip, frame, n in frame order per clip."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = list(state.get[0]) if state.exists else []
        out = []
        for b in batches:
            for f, n in b.sort_values("frame")[["frame", "n"]].itertuples(index=False):
                last = (last + [int(n)])[-keep:]
                s = sorted(last)
                med = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
                out.append((key[0], int(f), med, med < expected))
        state.update((last,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["clip", "frame", "med", "deficit"])

    ship(frames.sparkSession)
    return frames.groupBy("clip").applyInPandasWithState(step, "clip string, frame int, med double, deficit boolean", "last array<int>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def kickoff_stream(snapshots: DataFrame, fps: float = 25.0, idle_ms: int = 60_000) -> DataFrame:
    """Kickoffs per clip out of readiness snapshots (clip, g, ready, side) in order of g per clip."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = state.get if state.exists else (None, None, 0.0, -1e9)
        out = []
        for b in batches:
            for g, ready, side in b.sort_values("g")[["g", "ready", "side"]].itertuples(index=False):
                s, fired = kickoff_step(tuple(s), g * 5 / fps, float(ready), float(side))
                if fired:
                    out.append((key[0], int(g) * 5))
        state.update(tuple(s))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["clip", "frame"])

    ship(snapshots.sparkSession)
    return snapshots.groupBy("clip").applyInPandasWithState(step, "clip string, frame int", "since double, armed double, side double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def keep_changed_stream(hashes: DataFrame, least: int = 10, idle_ms: int = 3_600_000) -> DataFrame:
    """Sequential dedup per venue: a hash (venue, id, h) stays if it differs enough from the last kept one."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for b in batches:
            for i, h in b.sort_values("id")[["id", "h"]].itertuples(index=False):
                if last is None or (int(h) ^ int(last)).bit_count() > least:
                    out.append((key[0], int(i)))
                    last = int(h)
        state.update((last,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["venue", "id"])

    ship(hashes.sparkSession)
    return hashes.groupBy("venue").applyInPandasWithState(step, "venue string, id int", "h bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)
