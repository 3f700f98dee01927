"""Scan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens
from ..sources import adapter, scans
from .base_sql import with_ctes

_COLS = ["event_id", "user_id", "content_id", "category", "event_type", "watch_percentage", "ts_us"]
_SQL = ", ".join(_COLS)


def scan_interactions(spark, d):
    return scans.resolved(adapter.raw_interactions(spark, d)).select(*_COLS)


def recent_n_per_user(spark, d):
    return scans.recent_per_user(adapter.interactions(spark, d), 20).select(*_COLS)


def recent_n_global(spark, d):
    return scans.recent_global(adapter.interactions(spark, d)).select(*_COLS)


def asof_warmup(spark, d):
    rows = adapter.interactions(spark, d)
    return scans.warmup_before(rows, scans.recent_global(rows, 200)).select(*_COLS)


def content_engagement_scan(spark, d):
    return scans.content_engagement(adapter.raw_interactions(spark, d)).select(*_COLS)


def active_catalog(spark, d):
    seen = adapter.interactions(spark, d).where(F.col("watch_percentage") >= 90).select("content_id").distinct()
    return scans.active_catalog(
        adapter.contents(spark, d), "VIDEO", where=F.col("popularity_score") >= 0.5, exclude=seen, limit=500
    ).select("content_id", "creator_id", "category", "created_us", "popularity_score")


def decode_token_list(spark, d):
    c = adapter.table(spark, d, "documents")
    raw = (
        F.when(F.col("doc_id") % 4 == 0, F.lit(None).cast("string"))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("not json "), "source"))
        .when(F.col("doc_id") % 4 == 2, F.to_json(F.array("source", "lang")))
        .otherwise(F.to_json(F.array("lang")))
    )
    arr = tokens.decode_token_list(raw)
    return c.select("doc_id", F.size(arr).cast("long").alias("n"), F.array_join(arr, ",").alias("joined"))


QUERIES = {
    "scan_interactions": scan_interactions, "recent_n_per_user": recent_n_per_user, "recent_n_global": recent_n_global,
    "asof_warmup": asof_warmup, "content_engagement_scan": content_engagement_scan, "active_catalog": active_catalog,
    "decode_token_list": decode_token_list,
}
ORACLE = {
    "scan_interactions": with_ctes(f"SELECT {_SQL} FROM interactions", "INTERACTIONS"),
    "recent_n_per_user": with_ctes(
        f"SELECT {_SQL} FROM interactions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_us DESC, id DESC) <= 20",
        "INTERACTIONS"),
    "recent_n_global": with_ctes(f"SELECT {_SQL} FROM interactions ORDER BY ts_us DESC, id DESC LIMIT 1000", "INTERACTIONS"),
    "asof_warmup": with_ctes(
        f"""SELECT {_SQL} FROM interactions
        WHERE user_id IN (SELECT user_id FROM win)
          AND (ts_us < (SELECT min(ts_us) FROM win)
               OR (ts_us = (SELECT min(ts_us) FROM win)
                   AND id < (SELECT min(id) FROM win WHERE ts_us = (SELECT min(ts_us) FROM win))))
        ORDER BY ts_us DESC, id DESC LIMIT 2000""",
        "INTERACTIONS", extra="win AS (SELECT * FROM interactions ORDER BY ts_us DESC, id DESC LIMIT 200)"),
    "content_engagement_scan": with_ctes(
        f"SELECT {_SQL} FROM raw_interactions WHERE NOT content_pending AND NOT is_training_context_only", "RAW"),
    "active_catalog": with_ctes(
        """SELECT content_id, creator_id, category, created_us, popularity_score FROM contents
        WHERE is_active AND content_type = 'VIDEO' AND popularity_score >= 0.5
          AND content_id NOT IN (SELECT content_id FROM interactions WHERE watch_percentage >= 90)
        ORDER BY created_us DESC, content_id LIMIT 500""", "INTERACTIONS"),
    "decode_token_list": """SELECT doc_id,
        CAST(CASE doc_id % 4 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS n,
        CASE doc_id % 4 WHEN 2 THEN source || ',' || lang WHEN 3 THEN lang ELSE '' END AS joined FROM documents""",
}
