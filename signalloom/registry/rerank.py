"""Scoring and re-ranking queries. Candidates for the column formulas are all (order, line item) rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, rerank
from ..sources import adapter
from .base_sql import with_ctes

NOW = adapter.DECISION_US


def _scored(spark, d):
    """Every line item as a scored candidate of the user "order", with features from its columns."""
    li = adapter.table(spark, d, "lineitem")
    p = adapter.contents(spark, d).select(F.col("content_id").alias("cid"), "title", "hashtags", "topics", "entities", "subgenres", F.col("category").alias("cat"), "creator_id")
    k, q = F.col("l_partkey"), F.col("l_quantity")
    j = li.join(p, F.col("cid") == k.cast("string"))
    return j.select(
        F.col("l_orderkey").cast("string").alias("user_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("long")).alias("content_id"), "creator_id", F.col("cat").alias("category"),
        "title", "hashtags", "topics", "entities", "subgenres",
        ((F.col("l_extendedprice") % 1000) / 1000).alias("model_score"),
        (q % 4 == 0).cast("int").alias("already_seen"), (q % 9 == 0).cast("int").alias("creator_followed"),
        (q % 10).alias("_m"), ((q % 10) / 10).alias("session_intent_confidence"), (F.lit(0.5) + (k % 5) / 10).alias("session_category_affinity"),
        (k % 2).cast("int").alias("has_session_activity"), (k % 3).cast("long").alias("semantic_positive_match_count"),
        (F.lit(0.5) + (k % 50) / 100).alias("strongest_semantic_affinity"), ((k % 100) / 100).alias("category_affinity"),
        (k % 90).cast("double").alias("recent_category_watch_percentage"), ((k * 37 % 100) / 100).alias("content_popularity_score"),
        (k % 2).cast("int").alias("has_category_history"), (q * 8).cast("double").alias("content_age_hours"),
        F.when(k % 4 == 0, F.array(F.lit("RING"), F.lit("GEAR"), F.lit("ZZZ"))).alias("intent_topics"), F.when(k % 4 == 0, F.lit("PROMO")).alias("intent_category"),
        F.when(k % 4 == 0, 0.8).alias("intent_confidence"), F.when(k % 5 == 0, "SOCIAL").when(k % 5 == 1, "COLLABORATIVE").otherwise("LOCAL").alias("candidate_source"),
        ((k % 10) / 10).alias("interest_similarity"), F.when(k % 2 == 0, 0.9).otherwise(0.5).alias("relationship_strength"), F.lit(0.8).alias("source_user_engagement"),
        (F.col("l_orderkey") % 3 == 0).alias("cold_start"), F.lit("en").alias("user_language"), F.when(k % 2 == 0, "en").otherwise("fr").alias("language"),
        F.array(F.lit("SMALL"), F.lit("BOLT"), F.lit("BRAND")).alias("interests"), F.when(k % 3 == 0, 0.7).alias("cohort_score"),
        F.when(F.col("l_orderkey") % 3 == 0, "COLD_START").when(F.col("l_orderkey") % 3 == 1, "HYBRID").otherwise("PERSONALISED_ML").alias("strategy"),
    ).drop("_m")


_REL = ["rel_search", "rel_social", "rel_session", "rel_context", "rel_interest", "rel_cohort", "rel_freshness"]


def relevance_signals(spark, d):
    a = rerank.adjust_scores(_scored(spark, d))
    return a.select("content_id", *[F.round(c, 6).alias(c) for c in _REL], F.round("multiplier", 9).alias("multiplier"), "reason")


def adjusted_scores(spark, d):
    a = rerank.adjust_scores(_scored(spark, d))
    return a.select("user_id", "content_id", F.col("pre_rank").cast("long").alias("pre_rank"), F.round("adjusted_score", 9).alias("adjusted_score"))


def greedy_diversity_select(spark, d):
    return rerank.rerank(_scored(spark, d), 4).select("user_id", "content_id", "rank", "score", "reason")


def rerank_before_after(spark, d):
    """Uniques, seen rate and concentrations of the top three before and after re-ranking, mean over orders of two rows or more."""
    s = _scored(spark, d).withColumn("y", (F.col("category_affinity") > 0.5).cast("int"))
    # Re-ranking knows each row's place before it, so both orders come from one pass over an order's rows.
    placed = rerank.rerank(s, 3, carry=["already_seen", "y"], all_rows=True).withColumn("group_id", F.col("user_id"))
    both = F.array(F.struct(F.lit("before").alias("stage"), F.col("pre_rank").alias("rank")), F.struct(F.lit("after").alias("stage"), F.col("rank").alias("rank")))
    profile = metrics.top_k_profile(placed.withColumn("_both", both).drop("rank").select("*", F.inline("_both")).drop("_both"), 3, ["stage"]).where("n >= 2")
    cols = ["seen_rate", "precision", "unique_category", "category_concentration", "unique_creator_id", "creator_id_concentration"]
    means = lambda stage: F.struct(*[F.round(F.avg(F.when(F.col("stage") == stage, F.col(c))), 6).alias(c) for c in cols], F.lit(stage).alias("stage"))
    return profile.agg(F.array(means("before"), means("after")).alias("_rows")).select(F.inline("_rows"))


def _live(spark, d):
    li = adapter.table(spark, d, "lineitem")
    k, q = F.col("l_partkey"), F.col("l_quantity")
    return li.select(
        F.col("l_orderkey").cast("string").alias("user_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("long")).alias("content_id"),
        (F.col("l_suppkey") % 3).cast("string").alias("creator_id"), F.col("l_linestatus").alias("category"), ((F.col("l_extendedprice") % 1000) / 1000).alias("model_score"),
        (q % 4 == 0).alias("already_joined"), (k % 7).cast("long").alias("recent_likes"), (k % 3).cast("long").alias("recent_gifts"), (q % 11 == 0).alias("not_interested"),
        (q % 9 == 0).alias("creator_followed"), ((k % 100) / 100).alias("live_category_affinity"), ((k % 40) / 100).alias("viewer_growth_rate"), (k % 2 == 0).alias("region_match"))


def live_adjusted_score(spark, d):
    return _live(spark, d).select("content_id", F.round(rerank.live_adjusted_score(), 6).alias("score"), rerank.live_explanation().alias("reason"))


def live_rerank(spark, d):
    return rerank.live_rerank(_live(spark, d), 4)


def search_intent_ttl(spark, d):
    """Clicks as recorded search intents, read at the decision moment with a one-day life."""
    e = adapter.table(spark, d, "events").where(F.col("event_type") == "click")
    intents = e.select(F.col("user_id").cast("string").alias("user_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("recorded_us"),
                       F.get_json_object("props", "$.k").alias("query"), F.lit(0.8).alias("confidence")).where(F.col("recorded_us") <= NOW)
    return rerank.active_intents(intents, NOW, 86_400_000_000).select("user_id", "query", F.round("confidence", 6).alias("confidence"))


QUERIES = {
    "relevance_signals": relevance_signals, "adjusted_scores": adjusted_scores, "greedy_diversity_select": greedy_diversity_select,
    "rerank_before_after": rerank_before_after, "live_adjusted_score": live_adjusted_score, "live_rerank": live_rerank, "search_intent_ttl": search_intent_ttl,
}

_SCORED = """
cand AS (SELECT CAST(l_orderkey AS VARCHAR) AS user_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice) AS BIGINT)) AS content_id,
    c.creator_id, c.category, c.title, c.topic, c.entity, (l_extendedprice % 1000) / 1000 AS ms, l_partkey AS k, l_quantity AS q, l_orderkey % 3 AS o3,
    list_distinct(list_concat(string_split(upper(c.title), ' '), [c.topic, c.entity])) AS toks
  FROM lineitem JOIN contents c ON c.content_id = CAST(l_partkey AS VARCHAR)),
parts AS (SELECT *, list_distinct(flatten(list_transform(toks, lambda t: string_split(t, '_')))) AS prt FROM cand),
rel AS (SELECT *,
    CASE WHEN k % 4 = 0 THEN 0.8 * greatest(least(1, list_sum(list_transform(['RING', 'GEAR', 'ZZZ'], lambda t: CASE WHEN list_contains(toks, t) THEN 1.0 WHEN list_contains(prt, t) THEN 0.6 ELSE 0 END)) / 3),
        CASE WHEN category = 'PROMO' THEN 0.5 ELSE 0 END) ELSE 0 END AS rel_search,
    CASE WHEN k % 5 <= 1 AND q % 4 <> 0 THEN least(1, ((k % 10) / 10 + CASE WHEN k % 2 = 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END + 0.8) / 3) ELSE 0 END AS rel_social,
    CASE WHEN k % 2 = 1 AND (q % 10) / 10 >= 0.5 AND (0.5 + (k % 5) / 10) - 0.5 >= 0.15 THEN (q % 10) / 10 * least(1, ((0.5 + (k % 5) / 10) - 0.5) / 0.4) ELSE 0 END AS rel_session,
    CASE WHEN o3 = 0 THEN CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.0 END ELSE 0 END AS rel_context,
    CASE WHEN o3 = 0 THEN CASE WHEN category IN ('SMALL', 'BOLT', 'BRAND') THEN 1.0 WHEN len(list_intersect(toks, ['SMALL', 'BOLT', 'BRAND'])) > 0 THEN 0.8
        WHEN len(list_intersect(prt, ['SMALL', 'BOLT', 'BRAND'])) > 0 THEN 0.5 ELSE 0 END ELSE 0 END AS rel_interest,
    CASE WHEN k % 3 = 0 THEN 0.7 * CASE o3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.4 ELSE 0 END ELSE 0 END AS rel_cohort,
    CASE WHEN q * 8 <= 24 THEN 1 WHEN q * 8 >= 240 THEN 0 ELSE 1 - (q * 8 - 24) / 216 END AS rel_freshness,
    (k % 3 > 0 AND 0.5 + (k % 50) / 100 >= 0.75) AS strong,
    (k % 2 = 1 AND (q % 10) / 10 >= 0.5 AND (0.5 + (k % 5) / 10) - 0.5 >= 0.15) AS insess FROM parts),
mul AS (SELECT *, CASE WHEN strong THEN 1.2 ELSE 1.0 END * (1 + 0.35 * rel_search) * (1 + 0.25 * rel_social) * (1 + 0.3 * rel_session) * (1 + 0.08 * rel_context)
    * (1 + 0.3 * rel_interest) * (1 + 0.2 * rel_cohort) * (1 + 0.05 * rel_freshness) AS multiplier,
  CASE WHEN q % 9 = 0 THEN 'FOLLOWED_CREATOR' WHEN rel_search >= 0.5 THEN 'SEARCH_INTENT_MATCH' WHEN rel_interest >= 0.5 THEN 'ONBOARDING_INTEREST'
    WHEN rel_cohort >= 0.5 THEN 'REGIONAL_INTEREST' WHEN rel_social >= 0.6 THEN 'SOCIAL_RELEVANCE' WHEN insess THEN 'SESSION_INTEREST'
    WHEN strong THEN 'SEMANTIC_INTEREST_MATCH' WHEN (k % 100) / 100 >= 0.7 THEN 'HIGH_CATEGORY_AFFINITY' WHEN k % 90 >= 65 THEN 'RECENT_CATEGORY_ACTIVITY'
    WHEN (k * 37 % 100) / 100 >= 0.8 THEN 'POPULAR_CONTENT' WHEN k % 2 = 1 AND (k % 100) / 100 > 0.5 THEN 'PREVIOUS_CATEGORY_INTEREST' ELSE 'EXPLORATION' END AS reason,
  row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, content_id) AS pre_rank FROM rel),
adj AS (SELECT *, least(greatest(ms, 1e-9), 1 - 1e-9) AS cp,
    row_number() OVER (PARTITION BY user_id, category ORDER BY pre_rank) + row_number() OVER (PARTITION BY user_id, creator_id ORDER BY pre_rank) - 2 AS dup FROM mul)"""
_LIVE = """live_c AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice) AS BIGINT)) AS content_id, (l_extendedprice % 1000) / 1000 AS ms,
    l_partkey AS k, l_quantity AS q FROM lineitem)"""
_PASS = """
scored AS (SELECT CAST(l_orderkey AS VARCHAR) AS user_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice) AS BIGINT)) AS content_id,
    CAST(l_suppkey % 3 AS VARCHAR) AS creator_id, l_linestatus AS category, (l_extendedprice % 1000) / 1000 AS ms, l_partkey AS k, l_quantity AS q FROM lineitem),
adjusted AS (SELECT *, ms * CASE WHEN q % 4 = 0 THEN 0.82 ELSE 1 END * CASE WHEN k % 7 + 3 * (k % 3) > 0 THEN 1 + least(0.15, ln(1 + k % 7 + 3 * (k % 3)) * 0.05) ELSE 1 END
    * CASE WHEN q % 11 = 0 THEN 0.5 ELSE 1 END AS a FROM scored),
listed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a DESC, content_id) AS n FROM adjusted),
pass AS (
  SELECT user_id, 0::BIGINT AS n, []::BIGINT[] AS picks, []::VARCHAR[] AS cats, []::VARCHAR[] AS makers FROM (SELECT DISTINCT user_id FROM listed)
  UNION ALL
  SELECT p.user_id, l.n, CASE WHEN ok THEN list_append(picks, l.n) ELSE picks END, CASE WHEN ok THEN list_append(cats, l.category) ELSE cats END,
    CASE WHEN ok THEN list_append(makers, l.creator_id) ELSE makers END
  FROM pass p JOIN listed l ON l.user_id = p.user_id AND l.n = p.n + 1, LATERAL (SELECT len(picks) < 4 AND len(list_filter(makers, lambda m: m = l.creator_id)) < 2
    AND NOT coalesce(len(cats) >= 2 AND cats[-1] = l.category AND cats[-2] = l.category, false) AS ok) t),
done AS (SELECT user_id, arg_max(picks, n) AS picks FROM pass GROUP BY 1),
open_ AS (SELECT l.*, list_contains(picks, l.n) AS picked, len(picks) AS have FROM listed l JOIN done USING (user_id)),
chosen AS (SELECT *, row_number() OVER (PARTITION BY user_id, picked ORDER BY n) AS o FROM open_ QUALIFY picked OR o <= 4 - have)"""
_RR = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in _REL)
ORACLE = {
    "relevance_signals": with_ctes(f"SELECT content_id, {_RR}, round(multiplier, 9) AS multiplier, reason FROM mul", "CONTENTS", extra=_SCORED),
    "adjusted_scores": with_ctes("""
        SELECT user_id, content_id, pre_rank, round(CASE WHEN multiplier = 1 THEN ms ELSE 1 / (1 + exp(-(ln(cp / (1 - cp)) + ln(multiplier)))) END
          * CASE WHEN q % 4 = 0 THEN 0.85 ELSE 1 END * pow(0.96, dup), 9) AS adjusted_score FROM adj""", "CONTENTS", extra=_SCORED),
    "live_adjusted_score": "WITH " + _LIVE + """
        SELECT content_id, round(ms * CASE WHEN q % 4 = 0 THEN 0.82 ELSE 1 END * CASE WHEN k % 7 + 3 * (k % 3) > 0 THEN 1 + least(0.15, ln(1 + k % 7 + 3 * (k % 3)) * 0.05) ELSE 1 END
            * CASE WHEN q % 11 = 0 THEN 0.5 ELSE 1 END, 6) AS score,
          CASE WHEN q % 9 = 0 THEN 'FOLLOWED_CREATOR' WHEN (k % 100) / 100 >= 0.7 THEN 'PREFERRED_LIVE_CATEGORY' WHEN (k % 40) / 100 > 0.15 THEN 'TRENDING_LIVE'
            WHEN k % 2 = 0 THEN 'REGION_MATCH' ELSE 'EXPLORATION' END AS reason FROM live_c""",
    "live_rerank": "WITH RECURSIVE " + _PASS + """
        SELECT user_id, content_id, category, round(a, 6) AS score, CASE WHEN q % 9 = 0 THEN 'FOLLOWED_CREATOR' WHEN (k % 100) / 100 >= 0.7 THEN 'PREFERRED_LIVE_CATEGORY'
            WHEN (k % 40) / 100 > 0.15 THEN 'TRENDING_LIVE' WHEN k % 2 = 0 THEN 'REGION_MATCH' ELSE 'EXPLORATION' END AS reason,
          CAST(row_number() OVER (PARTITION BY user_id ORDER BY n) AS INTEGER) AS rank FROM chosen""",
    "search_intent_ttl": f"""SELECT CAST(user_id AS VARCHAR) AS user_id, json_extract_string(arg_max(props, ts), '$.k') AS query,
        round(0.8 * (1 - ({NOW} - max(epoch_us(ts))) / 8.64e10), 6) AS confidence FROM events WHERE event_type = 'click' AND epoch_us(ts) <= {NOW}
        GROUP BY 1 HAVING {NOW} - max(epoch_us(ts)) < 86400000000""",
}
