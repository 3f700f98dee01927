"""How fast the session features follow a user's change of category."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .features import HEAVY_ROWS, SESSION_EVENTS, prepare, session_features, session_window
from .running import Family, load, prior_state


def adaptation_trace(rows: DataFrame, contents: DataFrame, switches: DataFrame, *, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Per (user_id, previous_category, new_category, from_us): both categories' session affinity after each new-category event."""
    users = switches.select("user_id").distinct()
    mine = rows.join(users, "user_id", "left_semi")
    heavy, tasks = load(mine, ["user_id"], "ts_us", heavy_rows)
    slim = mine.drop("content_type", "id", "content_duration_seconds", "watch_time_seconds", "content_pending")
    seen = session_window(prepare(slim, contents, heavy, heavy_rows, tasks).drop("_tokens"), heavy, heavy_rows, tasks=tasks)
    own = F.array(F.struct("ts_us", "event_id", "category", "session_delta", "session_label", "watch_percentage", "w10"))
    seen = seen.withColumn("_session", F.concat("_session", own))
    seen = seen.withColumn("_session", F.slice("_session", F.greatest(F.size("_session") - (SESSION_EVENTS - 1), F.lit(1)), SESSION_EVENTS))
    j = seen.join(switches, "user_id").where((F.col("category") == F.col("new_category")) & (F.col("ts_us") >= F.col("from_us")))
    both = session_features(session_features(j, "previous_category", "prev_"), "new_category", "new_")
    n = prior_state(both, ["user_id"], "ts_us", [Family(ordered=True, sums={"_before": F.lit(1)})], heavy=heavy, heavy_rows=heavy_rows, tasks=tasks)
    return n.select("user_id", "previous_category", "new_category", (F.col("_before") + 1).alias("event_number"),
                    F.col("prev_session_category_affinity").alias("previous_affinity"), F.col("new_session_category_affinity").alias("new_affinity"),
                    F.col("new_session_intent_confidence").alias("new_confidence"),
                    (F.col("new_session_category_affinity") > F.col("prev_session_category_affinity")).alias("new_outranks_previous"))


def adaptation_latency(trace: DataFrame) -> DataFrame:
    """First event number at which the new category leads; NULL if it never does."""
    return trace.groupBy("user_id", "previous_category", "new_category").agg(
        F.min(F.when(F.col("new_outranks_previous"), F.col("event_number"))).alias("crossover_at"), F.count(F.lit(1)).alias("events"))
