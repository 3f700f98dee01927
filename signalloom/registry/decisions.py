"""Decision-log queries: every (user, content) pair ranked at 2024-01-16, outcomes from later events."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from ..operators import decisions, features
from ..session import shared_folder
from ..sources import adapter
from .base_sql import affinity, with_ctes
from .pointintime import HISTORY, TOKEN_STATE

NOW = adapter.DECISION_US


def _log(spark, d):
    rows = adapter.interactions(spark, d)
    pop = adapter.contents(spark, d).select("content_id", "popularity_score")
    pairs = rows.select("user_id", "content_id", "category").distinct().join(pop, "content_id")
    w = Window.partitionBy("user_id").orderBy(F.desc("popularity_score"), "content_id")
    return pairs.select(F.concat(F.lit("req-"), "user_id").alias("request_id"), F.lit(NOW).cast("long").alias("ranking_us"), "user_id", "content_id", "category",
                        F.row_number().over(w).alias("final_rank"), F.col("popularity_score").alias("final_score"))


def _resolved(spark, d):
    return decisions.resolve_outcomes(_log(spark, d), adapter.interactions(spark, d))


def resolve_outcomes(spark, d):
    return _resolved(spark, d).select("request_id", "content_id", "exposure_state", "observation_state", "observed_us", F.col("relevance").cast("long").alias("relevance"))


def _broken(spark, d):
    """The resolved log with faults: repeated rows, shifted times, lost relevance."""
    log = _resolved(spark, d)
    n = F.col("user_id").cast("long") % 10
    twice = log.where((n == 1) & (F.col("final_rank") == 1))
    return log.withColumns({
        "ranking_us": F.when((n == 2) & (F.col("final_rank") == 1), F.col("ranking_us") + 1).otherwise(F.col("ranking_us")),
        "relevance": F.when((n == 3) & (F.col("final_rank") == 1), F.lit(9)).otherwise(F.col("relevance")),
        "observation_state": F.when((n == 4) & (F.col("final_rank") == 1), "RESOLVED").otherwise(F.col("observation_state")),
    }).unionByName(twice)


def validate_decision(spark, d):
    return decisions.violations(_broken(spark, d))


def validate_group(spark, d):
    return decisions.validate_groups(_resolved(spark, d)).select("request_id", "candidates", "resolved", "relevances", "reason", "trainable")


def build_ranking_dataset(spark, d):
    return decisions.ranking_dataset(_resolved(spark, d)).select("request_id", "content_id", F.col("relevance").cast("long").alias("relevance"), "sample_weight")


def ranking_exclusions(spark, d):
    early = _log(spark, d).where("final_rank <= 2")
    return decisions.exclusion_report(decisions.resolve_outcomes(early, adapter.interactions(spark, d)))


def readiness_report(spark, d):
    return decisions.readiness(_resolved(spark, d))


def detect_foreign_rows(spark, d):
    e = adapter.interactions(spark, d)
    marked = e.withColumn("event_id", F.when(F.col("liked"), F.concat(F.lit("syn-cmp-a-"), "event_id")).when(F.col("commented"), F.concat(F.lit("syn-cmp-b-"), "event_id")).otherwise(F.col("event_id")))
    return decisions.foreign_rows(marked, "a")


def _snapshot(spark, d):
    rows, contents = adapter.interactions(spark, d), adapter.contents(spark, d)
    pairs = rows.select("user_id", "content_id", "creator_id", "category").distinct()
    f = features.score_time_features(rows, pairs, contents, NOW)
    w = Window.partitionBy("user_id").orderBy(F.desc("category_affinity"), "content_id")
    final = f.select("user_id", "content_id", F.col("category_affinity").alias("model_score"), F.col("category_affinity").alias("score"),
                     F.row_number().over(w).alias("rank"), F.row_number().over(w).alias("pre_rank"))
    return decisions.snapshot(final, f, model_version="v1", ranking_us=NOW, request=F.col("user_id"))


def _read_back(s):
    back = decisions.read_payload(F.col("features"))
    return s.select("request_id", "content_id", F.col("final_rank").cast("long").alias("final_rank"), "problem", back["category_affinity"].alias("category_affinity"),
                    back["category"].alias("category"))


def snapshot_decisions(spark, d):
    """Snapshot rows of every pair, scored by category affinity, with the full stored feature vector."""
    return _read_back(_snapshot(spark, d))


def decision_log_round_trip(spark, d):
    """The snapshot written to the decision log and read back from the partition of its day."""
    path = f"{shared_folder(spark).rstrip('/')}/decisions-{uuid.uuid4().hex}"
    decisions.write_log(_snapshot(spark, d), path)
    return _read_back(spark.read.parquet(path).where(F.col("day") == F.to_date(F.timestamp_micros(F.lit(NOW)))))


def ranking_training_input_checks(spark, d):
    log = _resolved(spark, d)
    return decisions.check_training_input(log, ["final_score"], volume_confirmed=True).groupBy("relevance").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "relevance", F.col("relevance").cast("long"))


QUERIES = {
    "resolve_outcomes": resolve_outcomes, "validate_decision": validate_decision, "validate_group": validate_group, "build_ranking_dataset": build_ranking_dataset,
    "ranking_exclusions": ranking_exclusions, "readiness_report": readiness_report, "detect_foreign_rows": detect_foreign_rows,
    "snapshot_decisions": snapshot_decisions, "decision_log_round_trip": decision_log_round_trip, "ranking_training_input_checks": ranking_training_input_checks,
}

_LOG = f"""
log AS (SELECT 'req-' || user_id AS request_id, user_id, content_id, popularity_score, row_number() OVER (PARTITION BY user_id ORDER BY popularity_score DESC, content_id) AS final_rank
  FROM (SELECT DISTINCT user_id, content_id FROM sig) JOIN contents USING (content_id)),
outc AS (SELECT user_id, content_id, max(ts_us) AS observed_us, bool_or(rejected) AS rej, bool_or(completed) AS comp, bool_or(sig_liked) AS lk,
    bool_or(sig_shared OR sig_favorited OR sig_followed) AS strong, max(watch_percentage) AS wp FROM sig WHERE ts_us >= {NOW} GROUP BY 1, 2),
res AS (SELECT l.*, observed_us, CASE WHEN observed_us IS NULL THEN 'SERVED' ELSE 'IMPRESSED' END AS exposure_state,
    CASE WHEN observed_us IS NULL THEN 'NOT_OBSERVED' ELSE 'RESOLVED' END AS observation_state,
    CAST(CASE WHEN observed_us IS NULL THEN NULL WHEN rej THEN 0 WHEN wp < 20 AND NOT (strong OR lk) THEN 0 WHEN strong THEN 4 WHEN lk OR comp THEN 3 WHEN wp >= 70 THEN 2 ELSE 1 END AS BIGINT) AS relevance
  FROM log l LEFT JOIN outc USING (user_id, content_id)),
grp AS (SELECT request_id, count(*) AS candidates, count(relevance) AS resolved, count(DISTINCT relevance) AS relevances,
    CASE WHEN count(*) < 2 THEN 'TOO_FEW_CANDIDATES' WHEN count(relevance) = 0 THEN 'ZERO_RESOLVED' WHEN count(relevance) = 1 THEN 'ONE_RESOLVED'
      WHEN count(DISTINCT relevance) < 2 THEN 'IDENTICAL_RELEVANCE' END AS reason FROM res GROUP BY 1)"""
ORACLE = {
    "resolve_outcomes": with_ctes("SELECT request_id, content_id, exposure_state, observation_state, observed_us, relevance FROM res", "SIG", extra=_LOG),
    "validate_decision": with_ctes("""
        SELECT DISTINCT request_id, CASE CAST(user_id AS INT) % 10 WHEN 1 THEN 'DUPLICATE_CONTENT' WHEN 2 THEN 'MIXED_RANKING_TIME'
            WHEN 3 THEN CASE WHEN exposure_state = 'IMPRESSED' THEN 'RELEVANCE_OUT_OF_RANGE' ELSE 'UNEXPOSED_WITH_OUTCOME' END ELSE 'UNEXPOSED_BUT_OBSERVED' END AS violation
        FROM res WHERE final_rank = 1 AND (CAST(user_id AS INT) % 10 IN (1, 3) OR (CAST(user_id AS INT) % 10 = 2 AND user_id IN (SELECT user_id FROM res WHERE final_rank = 2))
            OR (CAST(user_id AS INT) % 10 = 4 AND exposure_state = 'SERVED'))""", "SIG", extra=_LOG),
    "validate_group": with_ctes("SELECT *, reason IS NULL AS trainable FROM grp", "SIG", extra=_LOG),
    "build_ranking_dataset": with_ctes("""SELECT request_id, content_id, relevance, CASE WHEN relevance >= 3 THEN 1.5::DOUBLE WHEN relevance = 2 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS sample_weight
        FROM res WHERE relevance IS NOT NULL AND request_id IN (SELECT request_id FROM grp WHERE reason IS NULL)""", "SIG", extra=_LOG),
    "ranking_exclusions": with_ctes("""
        SELECT reason, count(*) AS groups FROM (SELECT CASE WHEN count(*) < 2 THEN 'TOO_FEW_CANDIDATES' WHEN count(relevance) = 0 THEN 'ZERO_RESOLVED'
          WHEN count(relevance) = 1 THEN 'ONE_RESOLVED' WHEN count(DISTINCT relevance) < 2 THEN 'IDENTICAL_RELEVANCE' END AS reason
          FROM res WHERE final_rank <= 2 GROUP BY request_id) WHERE reason IS NOT NULL GROUP BY 1""", "SIG", extra=_LOG),
    "readiness_report": with_ctes("""
        SELECT count(*) AS candidates, CAST(0 AS BIGINT) AS ranked, count(*) FILTER (WHERE exposure_state = 'SERVED') AS served,
          count(*) FILTER (WHERE exposure_state = 'IMPRESSED') AS impressed, count(relevance) AS resolved, CAST(0 AS BIGINT) AS not_yet_resolved, CAST(0 AS BIGINT) AS censored,
          (SELECT count(*) FROM grp) AS decisions, (SELECT count(*) FROM grp WHERE reason IS NULL) AS trainable_groups, (SELECT count(*) FROM grp WHERE reason IS NULL) > 0 AS buildable
        FROM res""", "SIG", extra=_LOG),
    "detect_foreign_rows": with_ctes("""SELECT count(*) FILTER (WHERE liked) AS own, count(*) FILTER (WHERE commented AND NOT liked) AS "foreign",
        count(*) FILTER (WHERE NOT liked AND NOT commented) AS unmarked FROM interactions""", "INTERACTIONS"),
    "snapshot_decisions": with_ctes(f"""
        SELECT 'internal-correlation-only:' || user_id AS request_id, content_id, row_number() OVER (PARTITION BY user_id ORDER BY a DESC, content_id) AS final_rank,
          CAST(NULL AS VARCHAR) AS problem, a AS category_affinity, category
        FROM (SELECT p.*, coalesce(a, 0.5::DOUBLE) AS a FROM (SELECT DISTINCT user_id, content_id, category FROM weighted) p LEFT JOIN
          (SELECT user_id, category, {affinity("sum(cd) / 10.0")} AS a FROM delta WHERE ts_us < {NOW} GROUP BY 1, 2) USING (user_id, category))""", "WEIGHTED", "TOKENS", extra=TOKEN_STATE + "," + HISTORY),
    "ranking_training_input_checks": with_ctes("""SELECT relevance, count(*) AS rows FROM res WHERE relevance IS NOT NULL
        AND request_id IN (SELECT request_id FROM grp WHERE reason IS NULL) GROUP BY 1""", "SIG", extra=_LOG),
}
ORACLE["decision_log_round_trip"] = ORACLE["snapshot_decisions"]
