"""Cohort queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts
from ..sources import adapter
from .base_sql import with_ctes


def _prefs(spark, d):
    return cohorts.cohort_preferences(adapter.interactions(spark, d), adapter.demographics(spark, d))


def cohort_preferences(spark, d):
    return _prefs(spark, d)


def resolve_cohort(spark, d):
    return cohorts.resolve_cohorts(_prefs(spark, d), adapter.demographics(spark, d))


def shrink_toward_global(spark, d):
    return cohorts.cohort_profile(_prefs(spark, d), adapter.demographics(spark, d)).withColumn("score", F.round("score", 9))


QUERIES = {"cohort_preferences": cohort_preferences, "resolve_cohort": resolve_cohort, "shrink_toward_global": shrink_toward_global}

_COHORT = """
tagged AS (SELECT * FROM demographics WHERE region IS NOT NULL OR age_bucket IS NOT NULL),
lab AS (SELECT s.*, region, age_bucket, sum(controlled::INT) OVER (PARTITION BY s.user_id, content_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS occ
  FROM sig s JOIN tagged t USING (user_id) WHERE target IS NOT NULL AND NOT is_training_context_only AND content_type <> 'LIVE'),
labw AS (SELECT *, CASE WHEN NOT controlled THEN 10 ELSE CASE occ WHEN 1 THEN 10 WHEN 2 THEN 10 WHEN 3 THEN 6 WHEN 4 THEN 3 WHEN 5 THEN 1 ELSE 0 END END AS w FROM lab),
prefs AS (SELECT CAST(1 AS BIGINT) AS version,
    CASE grouping_id(region, age_bucket) WHEN 0 THEN 'REGION_AGE' WHEN 1 THEN 'REGION' WHEN 2 THEN 'AGE' ELSE 'GLOBAL' END AS cohort_type,
    region, age_bucket, category, coalesce(sum(w * target) / nullif(sum(w), 0), 0.5) AS preference_score, count(DISTINCT user_id) AS sample_users,
    count(*) AS sample_interactions, CAST(sum(target) AS BIGINT) AS positive_count, CAST(sum(1 - target) AS BIGINT) AS negative_count
  FROM labw GROUP BY GROUPING SETS ((category), (category, region), (category, age_bucket), (category, region, age_bucket))
  HAVING (grouping(region) = 1 OR region IS NOT NULL) AND (grouping(age_bucket) = 1 OR age_bucket IS NOT NULL)),
usable AS (SELECT cohort_type, region, age_bucket, max(sample_users) AS users, CAST(sum(sample_interactions) AS BIGINT) AS rows FROM prefs GROUP BY 1, 2, 3
  HAVING max(sample_users) >= 30 AND sum(sample_interactions) >= 200),
pairs AS (SELECT DISTINCT region, age_bucket FROM tagged),
chosen AS (SELECT p.region, p.age_bucket, u.cohort_type, u.region AS c_region, u.age_bucket AS c_age, users, rows FROM pairs p JOIN usable u ON
    (u.cohort_type = 'REGION_AGE' AND u.region = p.region AND u.age_bucket = p.age_bucket) OR (u.cohort_type = 'REGION' AND u.region = p.region)
    OR (u.cohort_type = 'AGE' AND u.age_bucket = p.age_bucket) OR u.cohort_type = 'GLOBAL'
  QUALIFY row_number() OVER (PARTITION BY p.region, p.age_bucket
    ORDER BY CASE u.cohort_type WHEN 'REGION_AGE' THEN 0 WHEN 'REGION' THEN 1 WHEN 'AGE' THEN 2 ELSE 3 END) = 1)"""
ORACLE = {
    "cohort_preferences": with_ctes("SELECT * FROM prefs", "SIG", "DEMOGRAPHICS", extra=_COHORT),
    "resolve_cohort": with_ctes("SELECT * FROM chosen", "SIG", "DEMOGRAPHICS", extra=_COHORT),
    "shrink_toward_global": with_ctes("""
        SELECT c.region, c.age_bucket, c.cohort_type AS source, p.category,
          round(CASE WHEN c.cohort_type = 'GLOBAL' THEN p.preference_score ELSE p.sample_interactions / (p.sample_interactions + 200.0::DOUBLE) * p.preference_score
            + (1 - p.sample_interactions / (p.sample_interactions + 200.0::DOUBLE)) * coalesce(g.preference_score, 0.5) END, 9) AS score
        FROM chosen c JOIN prefs p ON p.cohort_type = c.cohort_type AND p.region IS NOT DISTINCT FROM c.c_region AND p.age_bucket IS NOT DISTINCT FROM c.c_age
          LEFT JOIN prefs g ON g.cohort_type = 'GLOBAL' AND g.category = p.category""", "SIG", "DEMOGRAPHICS", extra=_COHORT),
}
