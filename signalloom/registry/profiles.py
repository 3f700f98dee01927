"""Profile, popularity and dataset-summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signals
from ..operators import profiles
from ..sources import adapter, scans
from .base_sql import affinity, with_ctes

NOW = adapter.SCORING_US
_DELTA = "base_delta - 8 * (event_type = 'CONTENT_NOT_INTERESTED')::INT"


def category_profiles(spark, d):
    return profiles.category_profiles(adapter.interactions(spark, d), NOW)


def behaviour_profile(spark, d):
    return profiles.creator_profiles(adapter.interactions(spark, d))


def content_popularity(spark, d):
    return profiles.content_popularity(adapter.interactions(spark, d), adapter.contents(spark, d))


def creator_category_counts(spark, d):
    return profiles.creator_category_counts(adapter.contents(spark, d)).select("creator_id", "category", "n")


def live_category_from_creator_history(spark, d):
    return profiles.live_category_from_history(profiles.creator_category_counts(adapter.contents(spark, d)))


def video_bootstrap_affinities(spark, d):
    """Category and creator affinities over the newest 500 rows of each user, LIVE rows then dropped."""
    recent = scans.recent_per_user(adapter.interactions(spark, d)).where(F.col("content_type") != "LIVE")
    cat = profiles.keyed_affinity(recent, ["user_id", "category"], "affinity").select(
        "user_id", F.lit("category").alias("kind"), F.col("category").alias("key"), "affinity")
    cre = profiles.keyed_affinity(recent, ["user_id", "creator_id"], "affinity").select(
        "user_id", F.lit("creator").alias("kind"), F.col("creator_id").alias("key"), "affinity")
    return cat.unionByName(cre)


def _annotated(spark, d):
    return signals.annotate(adapter.interactions(spark, d))


def dataset_diagnostics(spark, d):
    return profiles.dataset_diagnostics(_annotated(spark, d).where(
        F.col("target").isNotNull() & ~F.col("is_training_context_only")))


def video_dataset_summary(spark, d):
    return profiles.dataset_summary(_annotated(spark, d).where(F.col("content_type") != "LIVE"))


def scenario_counts(spark, d):
    named = adapter.table(spark, d, "customer").select(
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("coldstart-user-"), "c_custkey"))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("creator-pref-user-"), "c_custkey"))
        .otherwise(F.col("c_name")).alias("user_id"))
    return named.groupBy(profiles.scenario_of(F.col("user_id")).alias("scenario")).agg(F.count(F.lit(1)).alias("n"))


def category_distribution(spark, d):
    return profiles.category_distribution(adapter.interactions(spark, d))


def class_distribution(spark, d):
    return profiles.class_distribution(_annotated(spark, d))


def dataset_provenance(spark, d):
    rows = adapter.interactions(spark, d)
    marked = rows.withColumn("event_id", F.when(F.col("liked"), F.concat(F.lit("syn-"), "event_id")).otherwise(F.col("event_id")))
    return profiles.provenance(marked)


def stratified_downsample(spark, d):
    rows = _annotated(spark, d)
    return profiles.stratified_downsample(rows, 100).select("event_id", F.col("target").cast("long").alias("target"))


QUERIES = {
    "category_profiles": category_profiles, "behaviour_profile": behaviour_profile, "content_popularity": content_popularity,
    "creator_category_counts": creator_category_counts,
    "live_category_from_creator_history": live_category_from_creator_history,
    "video_bootstrap_affinities": video_bootstrap_affinities, "dataset_diagnostics": dataset_diagnostics,
    "video_dataset_summary": video_dataset_summary, "scenario_counts": scenario_counts,
    "category_distribution": category_distribution, "class_distribution": class_distribution,
    "dataset_provenance": dataset_provenance, "stratified_downsample": stratified_downsample,
}

_N = "CAST(count(*) FILTER (WHERE {0}) AS BIGINT) AS {1}"
_HISTORY = """newest AS (SELECT *, row_number() OVER (PARTITION BY creator_id ORDER BY created_us DESC, content_id) AS pos
    FROM contents WHERE content_type = 'VIDEO'),
counts AS (SELECT creator_id, category, count(*) AS n, min(pos) AS first_pos FROM newest WHERE pos <= 50 GROUP BY 1, 2)"""

ORACLE = {
    "category_profiles": with_ctes(f"""
        SELECT user_id, category, count(*) AS interaction_count,
          {_N.format("event_type = 'VIDEO_IMPRESSION'", "impression_count")},
          count(watch_percentage) AS watch_count, {_N.format("completed", "completion_count")},
          {_N.format("event_type = 'VIDEO_SKIPPED'", "skip_count")}, {_N.format("fast_skipped", "fast_skip_count")},
          {_N.format("sig_liked", "like_count")}, {_N.format("sig_shared", "share_count")},
          {_N.format("sig_favorited", "favorite_count")}, {_N.format("sig_commented", "comment_count")},
          {_N.format("sig_followed", "creator_follow_count")}, {_N.format("event_type = 'VIDEO_REWATCHED'", "rewatch_count")},
          {_N.format("event_type = 'CONTENT_NOT_INTERESTED'", "not_interested_count")},
          {_N.format(f"ts_us >= {NOW - profiles.WEEK_US}", "recent_interaction_count")},
          max(ts_us) AS last_interaction_us, round(coalesce(avg(watch_percentage), 0), 6) AS average_watch_percentage,
          {affinity(f"sum({_DELTA})")} AS affinity_score
        FROM sig GROUP BY user_id, category""", "SIG"),
    "behaviour_profile": with_ctes(f"""
        SELECT user_id, creator_id, count(*) AS interaction_count,
          {affinity("sum(4 * completed::INT + 6 * sig_followed::INT)")} AS score, max(ts_us) AS last_interaction_us
        FROM sig GROUP BY user_id, creator_id""", "SIG"),
    "content_popularity": with_ctes(f"""
        SELECT c.content_id, coalesce(p, 0.5::DOUBLE) AS popularity FROM contents c LEFT JOIN
          (SELECT content_id, {affinity(f"sum({_DELTA})")} AS p FROM sig WHERE NOT is_training_context_only
           GROUP BY content_id) USING (content_id)""", "SIG"),
    "creator_category_counts": with_ctes("SELECT creator_id, category, n FROM counts", "CONTENTS", extra=_HISTORY),
    "live_category_from_creator_history": with_ctes("""
        SELECT creator_id, CASE WHEN sum(n) < 3 THEN 'UNKNOWN' ELSE arg_max(category, n * 1000 - first_pos) END AS category,
          CASE WHEN sum(n) < 3 THEN 0.0::DOUBLE ELSE round(max(n) / sum(n), 6) END AS confidence
        FROM counts GROUP BY creator_id""", "CONTENTS", extra=_HISTORY),
    "video_bootstrap_affinities": with_ctes(f"""
        SELECT user_id, 'category' AS kind, category AS key, {affinity(f"sum({_DELTA})")} AS affinity FROM recent GROUP BY 1, 3
        UNION ALL
        SELECT user_id, 'creator', creator_id, {affinity(f"sum({_DELTA})")} FROM recent GROUP BY 1, 3""", "SIG", extra="""
        recent AS (SELECT * FROM (SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY user_id
          ORDER BY ts_us DESC, id DESC) <= 500) WHERE content_type <> 'LIVE')"""),
    "dataset_diagnostics": with_ctes(f"""
        SELECT count(*) AS labelled_rows, {_N.format("target = 1", "positive_rows")}, {_N.format("target = 0", "negative_rows")},
          round(count(*) FILTER (WHERE target = 1) / count(*), 6) AS positive_ratio,
          round(count(*) FILTER (WHERE target = 0) / count(*), 6) AS negative_ratio,
          {_N.format("rejected", "explicit_rejections")}, {_N.format("target = 0 AND NOT rejected", "implicit_negatives")},
          {_N.format("target = 1 AND watch_percentage >= 90", "high_watch_positives")},
          {_N.format("target = 1 AND sig_liked", "liked_positives")},
          {_N.format("target = 1 AND sig_followed", "followed_positives")},
          count(DISTINCT user_id) AS unique_users, count(DISTINCT content_id) AS unique_contents,
          count(DISTINCT creator_id) AS unique_creators, count(DISTINCT category) AS unique_categories,
          {_N.format("newest - ts_us <= 1800000000", "session_scale")},
          {_N.format("newest - ts_us > 1800000000 AND newest - ts_us <= 2592000000000", "recent_scale")},
          {_N.format("newest - ts_us > 2592000000000", "long_term_scale")}
        FROM (SELECT *, max(ts_us) OVER () AS newest FROM sig WHERE target IS NOT NULL AND NOT is_training_context_only)""", "SIG"),
    "video_dataset_summary": with_ctes(f"""
        SELECT count(*) AS total_interactions, count(target) AS labelled_samples, count(*) - count(target) AS neutral_rows,
          {_N.format("target = 1", "positive_samples")}, {_N.format("target = 0", "negative_samples")},
          round(count(*) FILTER (WHERE target = 1) / count(target), 4) AS positive_ratio,
          round(count(*) FILTER (WHERE target = 0) / count(target), 4) AS negative_ratio,
          count(DISTINCT user_id) AS unique_users, count(DISTINCT content_id) AS unique_contents,
          count(DISTINCT creator_id) AS unique_creators, min(ts_us) AS earliest_us, max(ts_us) AS latest_us
        FROM sig WHERE content_type <> 'LIVE'""", "SIG"),
    "scenario_counts": """SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'coldStart' WHEN 'MACHINERY' THEN 'creatorPreference'
        ELSE 'bulkOrOther' END AS scenario, count(*) AS n FROM customer GROUP BY 1""",
    "category_distribution": with_ctes(
        "SELECT category, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM interactions GROUP BY category", "INTERACTIONS"),
    "class_distribution": with_ctes(f"""SELECT {_N.format("target = 1", "positive")}, {_N.format("target = 0", "negative")},
        count(DISTINCT target) >= 2 AS both_classes FROM sig""", "SIG"),
    "dataset_provenance": with_ctes(f"""SELECT {_N.format("liked", "synthetic_rows")}, count(*) AS total_rows,
        count(*) FILTER (WHERE liked) = count(*) AS synthetic FROM interactions""", "INTERACTIONS"),
    "stratified_downsample": with_ctes("""
        SELECT event_id, CAST(target AS BIGINT) AS target FROM sig WHERE target IS NULL UNION ALL
        SELECT event_id, CAST(target AS BIGINT) FROM (SELECT *, row_number() OVER (PARTITION BY target
          ORDER BY sha256(event_id), event_id) AS rn FROM sig WHERE target IS NOT NULL) WHERE rn <= 100""", "SIG"),
}
