"""Streaming flows over all rows, each run to its end (``availableNow``) in several micro-batches and read back."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import functions as F

from ..session import shared_folder
from ..operators import live
from ..sources import adapter
from ..streaming import ingestion, sessions
from . import live as live_queries, quality
from .base_sql import affinity, with_ctes

#: Micro-batches of a flow, and files of each.
PARTS, FILES = 3, 8


def _root(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/streams-{uuid.uuid4().hex}"


def _fed(spark, rows, order, path: str):
    """A stream of ``rows`` in as many micro-batches as ``PARTS``, cut by rank of ``order``."""
    bounds = rows.select(F.percentile_approx(order, [i / PARTS for i in range(1, PARTS)], 10_000)).first()[0] or []
    part = F.lit(0)
    for b in bounds:
        part = part + (F.col(order) > b).cast("int")
    for i in range(PARTS):  # one after the other: files are taken in order of time
        rows.where(part == i).coalesce(FILES).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", FILES).parquet(path)


def _to_table(stream, root: str, name: str):
    q = stream.writeStream.format("parquet").option("path", f"{root}/{name}").option("checkpointLocation", f"{root}/{name}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(f"{root}/{name}")


@lru_cache(maxsize=4)
def _ingested(spark, d) -> str:
    root = _root(spark)
    stream = _fed(spark, quality.messages(spark, d), "offset", f"{root}/in")
    batch = ingestion.behaviour_batch(root, adapter.contents(spark, d), F.timestamp_micros(F.lit(quality.AS_OF)))
    ingestion.start(stream, batch, f"{root}/checkpoint", available_now=True).awaitTermination()
    return root


def behaviour_stream(spark, d):
    """All messages through the ingestion stream: what is stored in the end."""
    rows = ingestion.read_interactions(spark, _ingested(spark, d))
    return rows.select("event_id", "user_id", "content_id", "category", "event_type", "watch_percentage", "liked", "shared", "content_pending")


def behaviour_stream_popularity(spark, d):
    """Popularity from running sums, as the last batch that touched a content left it."""
    return ingestion.latest_popularity(spark, _ingested(spark, d))


def registration_stream(spark, d):
    """All registrations through the stream: the newest context of each user."""
    root = _root(spark)
    stream = _fed(spark, quality.registration_messages(spark, d), "offset", f"{root}/in")
    ingestion.start(stream, ingestion.registration_batch(root), f"{root}/checkpoint", available_now=True).awaitTermination()
    u = ingestion.latest_contexts(spark, root)
    return u.select("user_id", F.col("age").cast("long").alias("age"), "region", F.array_join("interests", ",").alias("interests"))


def pending_resolution_stream(spark, d):
    """All raw interactions as pending events, joined with a stream of contents that come with the stream's own clock."""
    root = _root(spark)
    events = adapter.raw_interactions(spark, d).select("event_id", "user_id", "content_id", "event_type", "ts_us", F.timestamp_micros("ts_us").alias("timestamp"), F.lit(True).alias("content_pending"))
    first = events.agg(F.min("ts_us")).first()[0]
    contents = adapter.contents(spark, d).select("content_id", "content_type", (F.lit(first) + F.col("popularity_score") * 86_400_000_000).cast("long").alias("ts_us"))
    contents = contents.withColumn("timestamp", F.timestamp_micros("ts_us"))
    done = ingestion.resolved_stream(_fed(spark, events, "ts_us", f"{root}/events"), _fed(spark, contents, "ts_us", f"{root}/contents"), wait="3650 days", delay="3650 days")
    return _to_table(done, root, "resolved")


def live_session_stream(spark, d):
    """The LIVE log through the session stream; two last ticks move the watermark beyond every session."""
    root = _root(spark)
    log = adapter.live_log(spark, d)
    log = log.withColumn("timestamp", F.timestamp_micros("ts_us"))
    stream = _fed(spark, log, "ts_us", f"{root}/in")
    last = log.agg(F.max("ts_us")).first()[0]
    for i in (1, 2):
        tick = log.limit(1).withColumns({"user_id": F.lit("-tick"), "event_id": F.lit(f"tick{i}").cast(log.schema["event_id"].dataType), "ts_us": F.lit(last + i * 10**14)})
        tick.withColumn("timestamp", F.timestamp_micros("ts_us")).write.parquet(f"{root}/in/tick{i}")
    found = sessions.live_session_stream(stream, grace_us=live_queries.GRACE, idle_ms=10**10)
    s = _to_table(found, root, "sessions").where("user_id <> '-tick'")
    return s.select("user_id", "content_id", "creator_id", "category", "joined_us", "ended_us", "joined", "impression", F.round(F.col("watch_us") / 1e6, 6).alias("total_watch_seconds"),
                    "reconnect_count", *live._COUNTS, "exclusion_reason")


QUERIES = {
    "behaviour_stream": behaviour_stream, "behaviour_stream_popularity": behaviour_stream_popularity, "registration_stream": registration_stream,
    "pending_resolution_stream": pending_resolution_stream, "live_session_stream": live_session_stream,
}

ORACLE = {
    "behaviour_stream": quality.ORACLE["store_events"],
    "behaviour_stream_popularity": with_ctes(f"""
        SELECT content_id, {affinity("sum(3 * (et = 'CONTENT_LIKED')::INT + 5 * (et = 'CONTENT_SHARED')::INT + 4 * (t = 'view' AND coalesce(round(v / 30 * 100, 4), 0) >= 90)::INT - 4 * (et = 'VIDEO_SKIPPED')::INT)")} AS popularity
        FROM acc JOIN contents c USING (content_id) WHERE c.content_type = 'VIDEO' GROUP BY 1 HAVING bool_or(NOT content_pending)""", "CONTENTS", extra=quality._MSG),
    "registration_stream": "WITH " + quality._REG + " SELECT user_id, age, region, interests FROM regs WHERE reject_reason IS NULL",
    "pending_resolution_stream": with_ctes("""SELECT r.event_id, r.user_id, r.content_id, c.content_type FROM raw_interactions r JOIN contents c ON c.content_id = r.content_id
        WHERE (event_type LIKE 'LIVE%') = (c.content_type = 'LIVE')""", "RAW"),
    "live_session_stream": live_queries._session_sql("SELECT * EXCLUDE (positive, wus, session_no, target) FROM labelled"),
}
