"""Event rollup and tracking of sessions, as batches and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Of a user's sessions that are still open, by their begins: begin, end (both in microseconds) and number of events; and the events that may be sent again.
STATE = "begin array<long>, end array<long>, n array<long>, sent array<long>, at array<long>"


def rollup(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, users, total) of a batch."""
    return events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "users", "total")


def streaming_rollup(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same of a stream, with approximate numbers of users (streams have no exact distinct counts); windows close once the watermark passes."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "users", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n): session windows by user; works on batches and streams."""
    frame = events.withColumn("ts", F.col("ts").cast("timestamp"))
    frame = frame.withWatermark("ts", late) if events.isStreaming else frame
    return frame.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def _named(sessions: DataFrame) -> DataFrame:
    """With session_id, the same for the same user and begin however the session was found."""
    begin = F.unix_micros("session_start")
    return sessions.select(F.substring(F.sha2(F.concat_ws(":", "user_id", begin), 256), 1, 32).alias("session_id"), "user_id", "session_start", "session_end", "n")


def track(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """(session_id, user_id, session_start, session_end, n) of a batch of events (event_id, user_id, ts, ...): runs of a user's events that lie no more than
    the gap apart. An event that was sent again counts once; those without id, user or time don't count."""
    ts = F.col("ts").cast("timestamp").alias("ts")
    once = events.where("event_id is not null and user_id is not null and ts is not null").groupBy("user_id", "event_id").agg(F.min(ts).alias("ts"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    apart = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))
    runs = once.withColumn("first", F.when(apart <= gap_seconds * 1_000_000, 0).otherwise(1)).withColumn("run", F.sum("first").over(order))
    return _named(runs.groupBy("user_id", "run").agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count(F.lit(1)).alias("n")))


def track_stream(events: DataFrame, gap_seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """The same of a stream, a row for each session once the watermark is past its end by more than the gap.

    Events may come in any order and be sent again within the time that `late` allows; later ones don't count. For each user the state holds the sessions still open
    and the ids of events since the watermark, no events; timers close what no event extends.
    """
    gap = gap_seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin, end, n, sent, at = (list(x) for x in state.get) if state.exists else ([], [], [], [], [])
        known = set(sent)
        for pdf in [] if state.hasTimedOut else batches:
            times = pdf["ts"].to_numpy("datetime64[us]").astype(np.int64)
            for i, t in zip(pdf["event_id"], times, strict=True):
                if i in known:
                    continue
                known.add(int(i))
                sent.append(int(i))
                at.append(int(t))
                near = [k for k in range(len(begin)) if begin[k] - gap <= t <= end[k] + gap]
                whole = (min([t, *(begin[k] for k in near)]), max([t, *(end[k] for k in near)]), 1 + sum(n[k] for k in near))
                rest = [(begin[k], end[k], n[k]) for k in range(len(begin)) if k not in near]
                begin, end, n = (list(map(int, x)) for x in zip(*sorted([*rest, whole]), strict=True))
        mark = state.getCurrentWatermarkMs() * 1000
        done = [k for k in range(len(end)) if end[k] + gap < mark]
        stay = [k for k in range(len(end)) if end[k] + gap >= mark]
        recent = [k for k in range(len(at)) if at[k] >= mark]
        if done:
            stamp = lambda x: pd.to_datetime([x[k] for k in done], unit="us")
            yield pd.DataFrame({"user_id": key[0], "session_start": stamp(begin), "session_end": stamp(end), "n": [n[k] for k in done]})
        if stay:
            state.update(([begin[k] for k in stay], [end[k] for k in stay], [n[k] for k in stay], [sent[k] for k in recent], [at[k] for k in recent]))
            state.setTimeoutTimestamp(max(min(end[k] for k in stay) + gap, mark) // 1000 + 1)
        else:
            state.remove()

    marked = events.where("event_id is not null and user_id is not null").select(F.col("event_id").cast("long"), F.col("user_id").cast("long"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    schema = "user_id long, session_start timestamp, session_end timestamp, n long"
    return _named(marked.groupBy("user_id").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout))
