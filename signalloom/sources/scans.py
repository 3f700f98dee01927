"""Reads over interactions and the catalog. ``ts_us`` is event time in microseconds, ``id`` the row number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.running import top_n

RECENT_PER_USER = 500
DRIFT_ROWS = 1000
WARMUP_ROWS = 2000


def resolved(df: DataFrame) -> DataFrame:
    """Rows whose content is known; every evidence read starts here."""
    return df.where(~F.col("content_pending"))


def recent_per_user(df: DataFrame, n: int = RECENT_PER_USER) -> DataFrame:
    return top_n(df, ["user_id"], [F.desc("ts_us"), F.desc("id")], n)


def recent_global(df: DataFrame, n: int = DRIFT_ROWS) -> DataFrame:
    """Newest rows over all users; planned as a per-partition top-n and one small merge."""
    return df.orderBy(F.desc("ts_us"), F.desc("id")).limit(n)


def warmup_before(df: DataFrame, window: DataFrame, n: int = WARMUP_ROWS) -> DataFrame:
    """Newest rows of the window's users strictly before its first (ts, id)."""
    first = window.agg(F.min(F.struct("ts_us", "id"))).scalar()
    users = window.select("user_id").distinct()
    return recent_global(df.where(F.struct("ts_us", "id") < first).join(users, "user_id", "left_semi"), n)


def content_engagement(df: DataFrame) -> DataFrame:
    """Rows that count towards a content's popularity."""
    return resolved(df).where(~F.col("is_training_context_only"))


def active_catalog(
    contents: DataFrame, content_type: str, *, where: Column | None = None, exclude: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Active contents of one type, newest first, minus the excluded ids."""
    out = contents.where(F.col("is_active") & (F.col("content_type") == content_type))
    if where is not None:
        out = out.where(where)
    if exclude is not None:
        out = out.join(exclude.select("content_id"), "content_id", "left_anti")
    return out if limit is None else out.orderBy(F.desc("created_us"), "content_id").limit(limit)
