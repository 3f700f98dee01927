"""LIVE queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import live, profiles
from ..sources import adapter, scans
from .base_sql import affinity, with_ctes

GRACE = 12 * 3_600_000_000
WINDOW = 6 * 3_600_000_000
STALE = 3 * 3_600_000_000
NOW = adapter.DECISION_US


def _sessions(spark, d):
    return live.live_sessions(adapter.live_log(spark, d), grace_us=GRACE)


def live_sessions(spark, d):
    s = _sessions(spark, d)
    return s.select(
        "user_id", "content_id", "session_no", "creator_id", "category", "joined_us", "ended_us", "joined", "impression",
        F.round(F.col("watch_us") / 1e6, 6).alias("total_watch_seconds"), "reconnect_count", *live._COUNTS, "exclusion_reason",
        live.session_target().cast("long").alias("target"))


def live_session_signals(spark, d):
    return adapter.live_log(spark, d).select("event_id", *[c.alias(n) for n, c in live.live_signals().items()])


_HISTORY = [
    "previous_live_interaction_count_user", "previous_live_watch_time_user", "average_live_watch_time",
    "previous_live_category_interaction_count", "previous_live_category_watch_time", "average_live_watch_time_in_category",
    "category_join_rate", "category_positive_engagement_count", "previous_creator_live_interaction_count",
    "previous_creator_live_watch_time", "average_creator_live_watch_time", "creator_positive_engagement_count",
    "creator_followed", "recent_live_interaction_count", "recent_live_watch_time", "recent_category_live_activity",
]


def live_history_snapshot(spark, d):
    return live.session_history(_sessions(spark, d)).select("user_id", "content_id", "session_no", *_HISTORY)


def live_feature_snapshot(spark, d):
    """History features with VIDEO affinities standing in where there is no LIVE history."""
    rows = scans.recent_per_user(adapter.interactions(spark, d)).where(F.col("content_type") != "LIVE")
    boot = profiles.keyed_affinity(rows, ["user_id", "category"], "affinity").select(
        "user_id", F.lit("category").alias("kind"), F.col("category").alias("key"), "affinity").unionByName(
        profiles.keyed_affinity(rows, ["user_id", "creator_id"], "affinity").select(
            "user_id", F.lit("creator").alias("kind"), F.col("creator_id").alias("key"), "affinity"))
    s = live.session_snapshot(live.session_history(_sessions(spark, d)), boot)
    return s.select("user_id", "content_id", "session_no", F.round("live_category_affinity", 6).alias("live_category_affinity"),
                    F.round("creator_affinity", 6).alias("creator_affinity"), "average_live_watch_time_for_category")


def live_dataset(spark, d):
    ds = live.live_dataset(adapter.live_log(spark, d), grace_us=GRACE)
    return ds.select(
        "user_id", "content_id", "ts_us", "candidate_group", "category", F.col("target").cast("long").alias("target"),
        F.round("live_category_affinity", 6).alias("live_category_affinity"), F.round("creator_affinity", 6).alias("creator_affinity"),
        F.col("creator_followed").cast("long").alias("creator_followed"), "previous_live_interaction_count",
        "previous_live_watch_time", "average_live_watch_time_for_category", "recent_live_category_activity",
        F.col("hour_of_day").cast("long").alias("hour_of_day"))


def live_dataset_summary(spark, d):
    s = _sessions(spark, d).withColumn("target", live.session_target())
    return profiles.dataset_summary(s.withColumn("ts_us", F.col("ended_us"))).select(
        "total_interactions", "labelled_samples", "neutral_rows", "positive_samples", "negative_samples", "positive_ratio",
        "negative_ratio", "earliest_us", "latest_us")


def live_dynamic_state(spark, d):
    s = live.dynamic_state(adapter.live_log(spark, d), NOW, stale_us=STALE, window_us=WINDOW)
    return s.select("content_id", "current_viewer_count", F.round("viewer_growth_rate", 6).alias("viewer_growth_rate"),
                    "recent_likes", "recent_gifts")


def live_age_minutes(spark, d):
    c = adapter.contents(spark, d).where(F.col("content_type") == "LIVE")
    return c.select("content_id", F.round(scalars.live_age_minutes(F.col("created_us"), F.lit(NOW)), 6).alias("live_age_minutes"))


def user_live_signals(spark, d):
    """Followed creators, rejected streams, recent positive creators and categories of every user."""
    rows = adapter.interactions(spark, d)
    marked = rows.withColumn("creator_followed", F.col("event_type") == "CREATOR_FOLLOWED")
    parts = [
        live.followed_creators(marked).select("user_id", F.lit("followed_creator").alias("kind"), F.col("creator_id").alias("key"), "position"),
        live.not_interested_streams(rows).select("user_id", F.lit("not_interested").alias("kind"), F.col("content_id").alias("key"), "position"),
        live.recent_positive(rows, "creator_id").select("user_id", F.lit("positive_creator").alias("kind"), F.col("creator_id").alias("key"), "position"),
        live.recent_positive(rows, "category").select("user_id", F.lit("positive_category").alias("kind"), F.col("category").alias("key"), "position"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("position", F.col("position").cast("long"))


def top_live_categories(spark, d):
    s = _sessions(spark, d)
    top = live.top_live_categories(s, 3).select("user_id", F.lit("top_category").alias("kind"), F.col("category").alias("key"))
    return top.unionByName(live.followed_live_creators(s).select("user_id", F.lit("followed").alias("kind"), F.col("creator_id").alias("key")))


def preferred_live_categories(spark, d):
    demo = adapter.table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"), F.array(F.lower("c_mktsegment")).alias("interests"))
    users = adapter.interactions(spark, d).select("user_id").distinct()
    p = live.preferred_categories(
        demo.join(users, "user_id", "left_semi"), live.top_live_categories(_sessions(spark, d), 2),
        live.recent_positive(adapter.interactions(spark, d), "category"), 5)
    return p.select("user_id", F.array_join("categories", ",").alias("categories"))


def live_evidence_count(spark, d):
    """LIVE sessions rebuilt from the LIVE rows among each user's newest 100; else VIDEO rows."""
    recent = scans.recent_per_user(adapter.interactions(spark, d), 100)
    sessions = live.live_sessions(recent.where(F.col("content_type") == "LIVE"))
    return live.evidence_counts(recent, sessions)


QUERIES = {
    "live_session_signals": live_session_signals, "live_sessions": live_sessions, "live_history_snapshot": live_history_snapshot,
    "live_feature_snapshot": live_feature_snapshot, "live_dataset": live_dataset, "live_dataset_summary": live_dataset_summary,
    "live_dynamic_state": live_dynamic_state, "live_age_minutes": live_age_minutes, "user_live_signals": user_live_signals,
    "top_live_categories": top_live_categories, "preferred_live_categories": preferred_live_categories,
    "live_evidence_count": live_evidence_count,
}


def fold_sql(source: str, grace: int, prefix: str = "") -> str:
    """Sessions by a recursive fold, one event of every (user, stream) per step."""
    p = prefix
    return f"""
    {p}ev AS (SELECT *, row_number() OVER (PARTITION BY user_id, content_id ORDER BY ts_us, event_id) AS n FROM {source}),
    {p}fold AS (
      SELECT DISTINCT user_id, content_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS sess, CAST(NULL AS BIGINT) AS open_us,
        0.0::DOUBLE AS pending, CAST(NULL AS BIGINT) AS closed_us, 0.0::DOUBLE AS total, FALSE AS joined, FALSE AS unmatched,
        CAST(0 AS BIGINT) AS reconnects FROM {p}ev
      UNION ALL
      SELECT s.user_id, s.content_id, s.n, s.sess + fresh::INT,
        CASE WHEN et = 'LIVE_JOINED' THEN coalesce(open_us, ts_us) WHEN et = 'LIVE_LEFT' THEN NULL ELSE open_us END,
        CASE WHEN et = 'LIVE_LEFT' THEN 0 WHEN et = 'LIVE_WATCHED' AND w IS NOT NULL AND open_us IS NOT NULL THEN greatest(pending, w)
             ELSE pending END,
        CASE WHEN fresh THEN NULL WHEN et = 'LIVE_LEFT' AND open_us IS NOT NULL THEN ts_us ELSE closed_us END,
        CASE WHEN fresh THEN 0
             WHEN et = 'LIVE_LEFT' AND open_us IS NOT NULL THEN total + coalesce(w, greatest(pending, (ts_us - open_us) / 1e6))
             WHEN et = 'LIVE_WATCHED' AND w IS NOT NULL AND open_us IS NULL THEN greatest(total, w) ELSE total END,
        et = 'LIVE_JOINED' OR (et = 'LIVE_WATCHED' AND w IS NOT NULL) OR joined,
        CASE WHEN fresh THEN FALSE WHEN et = 'LIVE_LEFT' AND open_us IS NULL THEN TRUE ELSE unmatched END,
        CASE WHEN fresh THEN 0 WHEN et = 'LIVE_JOINED' AND open_us IS NULL AND closed_us IS NOT NULL THEN reconnects + 1
             ELSE reconnects END
      FROM (SELECT f.* EXCLUDE (n), e.n, e.event_type AS et, e.watch_time_seconds AS w, e.ts_us,
              coalesce(e.event_type = 'LIVE_JOINED' AND f.open_us IS NULL AND e.ts_us - f.closed_us > {grace}, FALSE) AS fresh
            FROM {p}fold f JOIN {p}ev e ON e.user_id = f.user_id AND e.content_id = f.content_id AND e.n = f.n + 1) s),
    {p}sess AS (
      SELECT f.user_id, f.content_id, f.sess AS session_no, first(e.creator_id ORDER BY e.n) AS creator_id,
        first(e.category ORDER BY e.n) AS category, min(e.ts_us) AS joined_us, max(e.ts_us) AS ended_us,
        last(f.joined ORDER BY e.n) AS joined, bool_or(e.event_type = 'LIVE_IMPRESSION') AS impression,
        round(last(f.total ORDER BY e.n), 6) AS total_watch_seconds, last(f.reconnects ORDER BY e.n) AS reconnect_count,
        count(*) FILTER (WHERE liked OR event_type = 'LIVE_LIKED') AS like_count,
        count(*) FILTER (WHERE shared OR event_type = 'LIVE_SHARED') AS share_count,
        count(*) FILTER (WHERE commented OR event_type = 'LIVE_COMMENTED') AS comment_count,
        count(*) FILTER (WHERE event_type = 'LIVE_GIFT_SENT') AS gift_count,
        count(*) FILTER (WHERE creator_followed OR event_type = 'LIVE_CREATOR_FOLLOWED') AS creator_follow_count,
        count(*) FILTER (WHERE event_type = 'LIVE_NOT_INTERESTED') AS not_interested_count,
        CASE WHEN last(f.unmatched ORDER BY e.n) THEN 'UNMATCHED_LEFT'
             WHEN arg_max(f.open_us IS NOT NULL, e.n) THEN 'OPEN_ENDED' END AS exclusion_reason
      FROM {p}fold f JOIN {p}ev e ON e.user_id = f.user_id AND e.content_id = f.content_id AND e.n = f.n
      GROUP BY 1, 2, 3)"""


def _session_sql(body: str, extra: str = "", *ctes: str) -> str:
    sql = with_ctes(body, "LIVE_LOG", *ctes, extra=fold_sql("live_log", GRACE) + "," + _LABELLED + extra)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_LABELLED = """
labelled AS (SELECT *, (like_count + share_count + comment_count + gift_count + creator_follow_count > 0) AS positive, CAST(round(total_watch_seconds * 1e6) AS BIGINT) AS wus,
    CAST(CASE WHEN not_interested_count > 0 THEN 0
         WHEN like_count + share_count + comment_count + gift_count + creator_follow_count > 0 THEN 1
         WHEN exclusion_reason IS NOT NULL THEN NULL WHEN joined AND total_watch_seconds >= 60 THEN 1
         WHEN (impression AND NOT joined) OR (joined AND total_watch_seconds < 10) THEN 0 END AS BIGINT) AS target FROM sess)"""

_HIST = f""",
hist AS (SELECT *,
    count(*) OVER u AS u_n, coalesce(sum(wus) OVER u, 0) AS u_w,
    count(*) OVER c AS c_n, coalesce(sum(wus) OVER c, 0) AS c_w,
    coalesce(sum(joined::INT) OVER c, 0) AS c_j, coalesce(sum(positive::INT) OVER c, 0) AS c_p,
    count(*) OVER k AS k_n, coalesce(sum(wus) OVER k, 0) AS k_w, coalesce(sum(positive::INT) OVER k, 0) AS k_p,
    coalesce(bool_or(creator_follow_count > 0) OVER k, FALSE) AS k_f,
    count(*) OVER ur AS r_n, coalesce(sum(wus) OVER ur, 0) AS r_w, count(*) OVER cr AS cr_n
  FROM labelled WINDOW u AS (PARTITION BY user_id ORDER BY ended_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    c AS (PARTITION BY user_id, category ORDER BY ended_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    k AS (PARTITION BY user_id, creator_id ORDER BY ended_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    ur AS (PARTITION BY user_id ORDER BY ended_us RANGE BETWEEN {live.WEEK_US} PRECEDING AND 1 PRECEDING),
    cr AS (PARTITION BY user_id, category ORDER BY ended_us RANGE BETWEEN {live.WEEK_US} PRECEDING AND 1 PRECEDING))"""

_DELTA = "base_delta - 8 * (event_type = 'CONTENT_NOT_INTERESTED')::INT"
_BOOT = f""",
recent AS (SELECT * FROM (SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY user_id
  ORDER BY ts_us DESC, id DESC) <= 500) WHERE content_type <> 'LIVE'),
bc AS (SELECT user_id, category, {affinity(f"sum({_DELTA})")} AS a FROM recent GROUP BY 1, 2),
bk AS (SELECT user_id, creator_id, {affinity(f"sum({_DELTA})")} AS a FROM recent GROUP BY 1, 2)"""


def _newest(where: str, key: str, kind: str, limit: int, source: str = "interactions") -> str:
    return f"""SELECT user_id, '{kind}' AS kind, key, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS position
      FROM (SELECT user_id, {key} AS key, max(ts_us) AS last
            FROM (SELECT * FROM {source} WHERE {where} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_us DESC, id DESC) <= 500)
            GROUP BY 1, 2) QUALIFY position <= {limit}"""


_RECENT_SIG = "(SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_us DESC, id DESC) <= 500)"
_R = "round({0}, 6) AS {0}"
ORACLE = {
    "live_session_signals": with_ctes("""
        SELECT event_id, liked OR event_type = 'LIVE_LIKED' AS like_count, shared OR event_type = 'LIVE_SHARED' AS share_count,
          commented OR event_type = 'LIVE_COMMENTED' AS comment_count, event_type = 'LIVE_GIFT_SENT' AS gift_count,
          creator_followed OR event_type = 'LIVE_CREATOR_FOLLOWED' AS creator_follow_count,
          event_type = 'LIVE_NOT_INTERESTED' AS not_interested_count FROM live_log""", "LIVE_LOG"),
    "live_sessions": _session_sql("SELECT * EXCLUDE (positive, wus) FROM labelled"),
    "live_history_snapshot": _session_sql("""
        SELECT user_id, content_id, session_no, u_n AS previous_live_interaction_count_user,
          CAST(u_w AS DOUBLE) / 1e6 AS previous_live_watch_time_user, CAST(u_w AS DOUBLE) / nullif(u_n, 0) / 1e6 AS average_live_watch_time,
          c_n AS previous_live_category_interaction_count, CAST(c_w AS DOUBLE) / 1e6 AS previous_live_category_watch_time,
          CAST(c_w AS DOUBLE) / nullif(c_n, 0) / 1e6 AS average_live_watch_time_in_category, round(c_j / nullif(c_n, 0), 6) AS category_join_rate,
          CAST(c_p AS BIGINT) AS category_positive_engagement_count, k_n AS previous_creator_live_interaction_count,
          CAST(k_w AS DOUBLE) / 1e6 AS previous_creator_live_watch_time, CAST(k_w AS DOUBLE) / nullif(k_n, 0) / 1e6 AS average_creator_live_watch_time,
          CAST(k_p AS BIGINT) AS creator_positive_engagement_count, k_f AS creator_followed, r_n AS recent_live_interaction_count,
          CAST(r_w AS DOUBLE) / 1e6 AS recent_live_watch_time, cr_n AS recent_category_live_activity FROM hist""", _HIST),
    "live_feature_snapshot": _session_sql("""
        SELECT h.user_id, content_id, session_no,
          CASE WHEN c_n = 0 AND bc.a IS NOT NULL THEN bc.a ELSE round(least(1.0::DOUBLE, 0.5 + c_n * 0.04), 6) END AS live_category_affinity,
          CASE WHEN k_n = 0 AND bk.a IS NOT NULL THEN bk.a ELSE round(least(1.0::DOUBLE, 0.5 + k_n * 0.05), 6) END AS creator_affinity,
          CAST(c_w AS DOUBLE) / greatest(1, c_n) / 1e6 AS average_live_watch_time_for_category
        FROM hist h LEFT JOIN bc ON bc.user_id = h.user_id AND bc.category = h.category
          LEFT JOIN bk ON bk.user_id = h.user_id AND bk.creator_id = h.creator_id""", _HIST + _BOOT, "SIG"),
    "live_dataset": _session_sql("""
        SELECT user_id, content_id, ended_us AS ts_us,
          user_id || ':' || strftime(make_timestamp(ended_us), '%Y-%m-%d') AS candidate_group, upper(category) AS category, target,
          round(least(1.0::DOUBLE, 0.5 + c_n * 0.04), 6) AS live_category_affinity,
          round(least(1.0::DOUBLE, 0.5 + k_n * 0.05), 6) AS creator_affinity, CAST(k_f::INT AS BIGINT) AS creator_followed,
          k_n AS previous_live_interaction_count, CAST(k_w AS DOUBLE) / 1e6 AS previous_live_watch_time,
          CAST(c_w AS DOUBLE) / greatest(1, c_n) / 1e6 AS average_live_watch_time_for_category, cr_n AS recent_live_category_activity,
          CAST(extract('hour' FROM make_timestamp(ended_us)) AS BIGINT) AS hour_of_day
        FROM hist WHERE target IS NOT NULL""", _HIST),
    "live_dataset_summary": _session_sql("""
        SELECT count(*) AS total_interactions, count(target) AS labelled_samples, count(*) - count(target) AS neutral_rows,
          count(*) FILTER (WHERE target = 1) AS positive_samples, count(*) FILTER (WHERE target = 0) AS negative_samples,
          round(count(*) FILTER (WHERE target = 1) / count(target), 4) AS positive_ratio,
          round(count(*) FILTER (WHERE target = 0) / count(target), 4) AS negative_ratio,
          min(ended_us) AS earliest_us, max(ended_us) AS latest_us FROM labelled"""),
    "live_dynamic_state": with_ctes(f"""
        SELECT n.content_id, coalesce(v, 0) AS current_viewer_count,
          round(greatest(-1.0::DOUBLE, least(10.0::DOUBLE, (late - early) / greatest(1, early))), 6) AS viewer_growth_rate,
          likes AS recent_likes, gifts AS recent_gifts
        FROM (SELECT content_id,
            count(DISTINCT CASE WHEN event_type = 'LIVE_JOINED' AND ts_us >= {NOW - WINDOW // 2} THEN user_id END) AS late,
            count(DISTINCT CASE WHEN event_type = 'LIVE_JOINED' AND ts_us >= {NOW - WINDOW} AND ts_us < {NOW - WINDOW // 2} THEN user_id END) AS early,
            count(*) FILTER (WHERE event_type = 'LIVE_LIKED' AND ts_us >= {NOW - WINDOW}) AS likes,
            count(*) FILTER (WHERE event_type = 'LIVE_GIFT_SENT' AND ts_us >= {NOW - WINDOW}) AS gifts FROM near GROUP BY 1) n
        LEFT JOIN (SELECT content_id, count(*) AS v FROM (SELECT content_id, user_id, arg_max(event_type, ts_us) AS et, max(ts_us) AS last_us
            FROM near WHERE event_type IN ('LIVE_JOINED','LIVE_WATCHED','LIVE_LEFT') GROUP BY 1, 2)
          WHERE et <> 'LIVE_LEFT' AND last_us >= {NOW - STALE} GROUP BY 1) USING (content_id)""", "LIVE_LOG",
        extra=f"near AS (SELECT * FROM live_log WHERE ts_us BETWEEN {NOW - WINDOW} AND {NOW})"),
    "live_age_minutes": with_ctes(f"""SELECT content_id,
        round(greatest(0.0::DOUBLE, least(1440.0::DOUBLE, ({NOW} - created_us) / 6e7)), 6) AS live_age_minutes
        FROM contents WHERE content_type = 'LIVE'""", "CONTENTS"),
    "user_live_signals": with_ctes(" UNION ALL ".join(f"SELECT * FROM ({q})" for q in (
        _newest("event_type = 'CREATOR_FOLLOWED'", "creator_id", "followed_creator", 10),
        _newest("event_type = 'LIVE_NOT_INTERESTED'", "content_id", "not_interested", 50),
        _newest("content_type <> 'LIVE' AND target = 1", "creator_id", "positive_creator", 10, _RECENT_SIG),
        _newest("content_type <> 'LIVE' AND target = 1", "category", "positive_category", 10, _RECENT_SIG))), "SIG"),
    "top_live_categories": _session_sql("""
        SELECT user_id, 'top_category' AS kind, category AS key FROM (SELECT user_id, category, count(*) AS n FROM sess GROUP BY 1, 2)
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) <= 3
        UNION ALL SELECT DISTINCT user_id, 'followed', creator_id FROM sess WHERE creator_follow_count > 0"""),
    "preferred_live_categories": _session_sql(f"""
        SELECT user_id, string_agg(tok, ',' ORDER BY p) AS categories FROM
          (SELECT user_id, tok, min(p) AS p FROM allc GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY min(p)) <= 5)
        GROUP BY user_id""", f""",
        allc AS (
          SELECT CAST(c_custkey AS VARCHAR) AS user_id, upper(c_mktsegment) AS tok, 0 AS p FROM customer
            WHERE CAST(c_custkey AS VARCHAR) IN (SELECT user_id FROM interactions)
          UNION ALL SELECT user_id, category, 100 + row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) AS rn
            FROM (SELECT user_id, category, count(*) AS n FROM sess GROUP BY 1, 2) QUALIFY rn <= 102
          UNION ALL SELECT user_id, key, 200 + position FROM
            ({_newest("content_type <> 'LIVE' AND target = 1", "category", "c", 10, _RECENT_SIG)}))""", "SIG"),
    "live_evidence_count": with_ctes("""
        SELECT user_id, CASE WHEN l > 0 THEN l ELSE v END AS evidence,
          CASE WHEN evidence = 0 THEN 'COLD_START' WHEN evidence < 10 THEN 'HYBRID' ELSE 'PERSONALISED_ML' END AS strategy
        FROM (SELECT user_id, count(*) FILTER (WHERE content_type <> 'LIVE') AS v FROM recent GROUP BY 1)
        LEFT JOIN (SELECT user_id, count(*) AS l FROM sess GROUP BY 1) USING (user_id)""", "INTERACTIONS", extra="""
        recent AS (SELECT * FROM interactions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_us DESC, id DESC) <= 100),
        """ + fold_sql("(SELECT * FROM recent WHERE content_type = 'LIVE')", live.RECONNECT_GRACE_US)).replace("WITH ", "WITH RECURSIVE ", 1),
}
