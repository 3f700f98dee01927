"""LIVE sessions of a stream. Events wait in a buffer per user until the watermark passes them, so they leave in order of
(time, event id) however micro-batches are cut; late events are dropped. Whenever a timer fires, one pass over the events
that have left derives the sessions of each of the user's streams, as the batch form does: all sessions of a stream but the
last are complete, and the last one is complete when the watermark is the idle time beyond its last event. Only events of
incomplete sessions, and those that still wait, stay in the state.

A user's streams share one state, and its events travel in pickled blocks, because a call to the state store and a row of it
cost far more than an event. The pass is plain Python: most users have few events at a time, for which building data frames
would cost more than all else.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.live import RECONNECT_GRACE_US, _COUNTS, live_signals

# Spark also reads the processor in a worker of the driver, which gets no files of the session: the module travels with it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SESSION_SCHEMA = (
    "user_id string, content_id string, creator_id string, category string, joined_us long, ended_us long, joined boolean, impression boolean, "
    "watch_us long, reconnect_count long, like_count long, share_count long, comment_count long, gift_count long, creator_follow_count long, "
    "not_interested_count long, exclusion_reason string")
_EVENT = ["content_id", "event_id", "creator_id", "category", "event_type", "ts_us", "watch_us", *_COUNTS]
_SESSION = [c.split()[0] for c in SESSION_SCHEMA.split(", ")]
#: Events of a block.
BLOCK = 10_000
#: Places of an event's columns.
STREAM, ID, CREATOR, CATEGORY, KIND, AT, WATCH, COUNTS = range(8)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Session:
    """Running state of one session. A segment goes from one opening join to the next; its stay ends at the matched leave."""

    def __init__(self, first: tuple):
        self.events: list[tuple] = []
        self.creator, self.category, self.joined_us = first[CREATOR], first[CATEGORY], first[AT]
        self.joined = self.impression = self.unmatched = False
        self.last_mark = None
        self.reconnects = self.total = self.over = 0
        self.counts = [0] * (len(first) - COUNTS)
        self.segment(None)

    def segment(self, opened_us: int | None) -> None:
        self.opened_us, self.pending, self.gap, self.stay = opened_us, 0, None, 0

    def end_segment(self) -> None:
        self.total += self.stay
        if self.gap is not None:
            self.over = max(self.over, self.gap - self.total)

    def row(self, user: str, stream: str) -> tuple:
        self.end_segment()
        reason = "UNMATCHED_LEFT" if self.unmatched else "OPEN_ENDED" if self.last_mark == "LIVE_JOINED" else None
        return (user, stream, self.creator, self.category, self.joined_us, self.events[-1][AT], self.joined, self.impression, self.total + self.over, self.reconnects,
                *self.counts, reason)


def sessions_of(events: list[tuple], grace_us: int) -> list[_Session]:
    """Sessions of one (user, stream), in order, the last one perhaps incomplete."""
    found: list[_Session] = []
    seen, is_open, closed_us = set(), False, None
    for e in sorted(events, key=lambda e: (e[AT], e[ID] is None, e[ID] or "")):
        if e[ID] in seen:
            continue
        seen.add(e[ID])
        kind, at, watch = e[KIND], e[AT], e[WATCH]
        opens = kind == "LIVE_JOINED" and not is_open
        late = closed_us is not None and at - closed_us > grace_us
        if not found or (opens and late):
            found.append(_Session(e))
        s = found[-1]
        s.events.append(e)
        if opens:
            if len(s.events) > 1:
                s.end_segment()
            s.segment(at)
            s.reconnects += closed_us is not None and not late
        if kind == "LIVE_WATCHED" and watch is not None:
            s.joined = True
            if is_open:
                s.pending = max(s.pending, watch)
            else:
                s.gap = watch if s.gap is None else max(s.gap, watch)
        elif kind == "LIVE_JOINED":
            s.joined, s.last_mark, is_open = True, kind, True
        elif kind == "LIVE_LEFT":
            s.last_mark = kind
            if is_open:
                s.stay = watch if watch is not None else max(s.pending, at - s.opened_us)
                closed_us = at
            else:
                s.unmatched = True
            is_open = False
        s.impression |= kind == "LIVE_IMPRESSION"
        for i, n in enumerate(e[COUNTS:]):
            s.counts[i] += n
    return found


def _blocks(events: list[tuple]) -> list[tuple]:
    return [(pickle.dumps(events[i : i + BLOCK]),) for i in range(0, len(events), BLOCK)]


class LiveSessions(StatefulProcessor):
    def __init__(self, grace_us: int, idle_ms: int):
        self.grace_us, self.idle_ms = grace_us, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "block binary")
        # The watermark that the user's events were last taken by, -1 before; there is one as long as a timer is set.
        self.passed = handle.getValueState("passed", "ms long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.passed.get()
        passed = -1 if held is None else held[0]
        came = [e for e in (tuple(r)[-len(_EVENT):] for r in rows) if e[AT] is not None and e[AT] // 1000 > passed]
        if came:
            self.events.appendList(_blocks(came))
            if held is None:
                self.passed.update((-1,))
                self.handle.registerTimer(max(min(e[AT] for e in came) // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        kept, due, gone, out = [], [], {}, []
        for e in (e for (block,) in self.events.get() for e in pickle.loads(block)):
            if e[AT] // 1000 <= now:
                gone.setdefault(e[STREAM], []).append(e)
            else:
                kept.append(e)
                due.append(e[AT] // 1000)
        for stream, events in gone.items():
            found = sessions_of(events, self.grace_us)
            last = found[-1].events
            if last[-1][AT] // 1000 + self.idle_ms > now:
                found.pop()
                kept += last
                due.append(last[-1][AT] // 1000 + self.idle_ms)
            out += [Row(*_SESSION)(*s.row(key[0], stream)) for s in found]
        if kept:
            self.events.put(_blocks(kept))
            self.passed.update((now,))
            self.handle.registerTimer(max(min(due), now) + 1)
        else:
            self.events.clear()
            self.passed.clear()
        return iter(out)


def live_session_stream(events: DataFrame, *, watermark: str = "10 minutes", grace_us: int = RECONNECT_GRACE_US, idle_ms: int = 6 * 3_600_000) -> DataFrame:
    """Finished sessions of a stream of LIVE events (``timestamp`` is event time). Timers need the RocksDB state store,
    which is set on the session for the queries that start after this call."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    watch_us = F.round(F.col("watch_time_seconds") * 1_000_000).cast("long").alias("watch_us")
    signals = [c.cast("long").alias(n) for n, c in live_signals().items()]
    # The last columns are those of _EVENT, in its order.
    slim = events.withWatermark("timestamp", watermark).select("user_id", "timestamp", "content_id", "event_id", "creator_id", "category", "event_type", "ts_us", watch_us, *signals)
    return slim.groupBy("user_id").transformWithState(LiveSessions(grace_us, idle_ms), SESSION_SCHEMA, "Append", "EventTime")
