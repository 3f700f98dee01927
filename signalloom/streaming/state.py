"""Streaming forms of stream state and search intents. All state is bounded by a watermark; later events are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

def dynamic_state_stream(events: DataFrame, *, watermark: str = "2 minutes", window: str = "600 seconds", slide: str = "30 seconds", stale_us: int = 90_000_000) -> DataFrame:
    """Viewers, growth, likes and gifts per stream at the end of every sliding window: users first, then streams."""
    t, us = F.col("event_type"), F.col("ts_us")
    presence = t.isin("LIVE_JOINED", "LIVE_WATCHED")
    end = F.unix_micros(F.col("window.end"))
    half = (F.unix_micros(F.col("window.end")) + F.unix_micros(F.col("window.start"))) / 2
    e = events.withWatermark("timestamp", watermark).withColumn("window", F.window("timestamp", window, slide))
    hit = lambda c: F.max((c).cast("int"))
    users = e.groupBy("window", "content_id", "user_id").agg(
        F.max(F.when(presence | (t == "LIVE_LEFT"), F.struct("ts_us", "event_id", presence.alias("on")))).alias("_p"),
        hit((t == "LIVE_JOINED") & (us >= half)).alias("_late"), hit((t == "LIVE_JOINED") & (us < half)).alias("_early"),
        F.sum((F.coalesce("liked", F.lit(False)) | (t == "LIVE_LIKED")).cast("long")).alias("_likes"), F.sum((t == "LIVE_GIFT_SENT").cast("long")).alias("_gifts"))
    seen = F.coalesce(F.col("_p.on") & (F.col("_p.ts_us") >= end - stale_us), F.lit(False))
    s = users.groupBy("window", "content_id").agg(
        F.sum(seen.cast("long")).alias("current_viewer_count"), F.sum("_late").alias("_late"), F.sum("_early").alias("_early"),
        F.sum("_likes").alias("recent_likes"), F.sum("_gifts").alias("recent_gifts"))
    growth = (F.col("_late") - F.col("_early")) / F.greatest(F.lit(1), F.col("_early"))
    return s.select(F.col("window.end").alias("at"), "content_id", "current_viewer_count", F.greatest(F.lit(-1.0), F.least(F.lit(10.0), growth)).alias("viewer_growth_rate"),
                    "recent_likes", "recent_gifts")


def intent_stream(intents: DataFrame, *, watermark: str = "1 minute", ttl_ms: int = 30 * 60_000) -> DataFrame:
    """Changes of each user's active search intent: a newer one replaces it, the time limit removes it."""
    schema = "user_id string, intent string, recorded_ms long, active boolean"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            intent, at = state.get
            state.remove()
            yield pd.DataFrame([(key[0], intent, at, False)], columns=["user_id", "intent", "recorded_ms", "active"])
            return
        rows = pd.concat(list(batches)).sort_values("recorded_ms", kind="stable")
        intent, at = rows.iloc[-1][["intent", "recorded_ms"]]
        if state.exists and state.get[1] > at:
            return
        state.update((intent, int(at)))
        state.setTimeoutTimestamp(max(int(at) + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], intent, int(at), True)], columns=["user_id", "intent", "recorded_ms", "active"])

    timed = intents.withWatermark("timestamp", watermark).select("user_id", "intent", (F.unix_millis("timestamp")).alias("recorded_ms"), "timestamp")
    return timed.groupBy("user_id").applyInPandasWithState(step, schema, "intent string, recorded_ms long", "update", GroupStateTimeout.EventTimeTimeout)
