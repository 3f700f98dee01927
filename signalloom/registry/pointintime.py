"""Point-in-time feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features
from ..operators.running import load
from ..sources import adapter
from .base_sql import affinity, with_ctes

_HISTORY = [
    "category_affinity", "recent_category_affinity", "average_category_watch_percentage", "recent_category_watch_percentage",
    "category_completion_rate", "recent_category_completion_rate", "category_positive_count", "category_negative_count",
    "category_interaction_count", "creator_interaction_count", "creator_completion_rate", "user_total_interaction_count",
    "content_popularity_score", "content_age_hours", "days_since_last_category_interaction",
    "category_explicit_rejection_count", "recent_explicit_rejection_strength",
]
_FLAGS = ["has_category_history", "has_creator_history", "creator_followed", "already_seen", "hour_of_day"]
_SESSION = [
    "session_category_affinity", "session_positive_interaction_count", "session_negative_interaction_count",
    "session_average_watch_percentage", "session_intent_confidence", "session_category_streak",
    "session_category_streak_valence", "session_category_streak_valence_matched", "session_category_streak_valence_unmatched",
]
_SESSION_FLAGS = ["has_session_activity", "last_interaction_category_match"]
_SEMANTIC = [
    "hashtag_affinity", "topic_affinity", "entity_affinity", "subgenre_affinity", "title_affinity",
    "strongest_semantic_affinity", "average_semantic_affinity", "candidate_negative_semantic_match",
]
_SEMANTIC_N = [
    "semantic_positive_match_count", "semantic_negative_match_count", "semantic_explicit_rejection_match_count",
    "has_semantic_history", "repeat_rejection",
]


def _pick(df, doubles, longs):
    return df.select(
        "event_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in doubles], *[F.col(c).cast("long").alias(c) for c in longs])


def _prepared(spark, d):
    """Prepared rows, and the heavy users and the number of tasks that later states take over."""
    rows = adapter.interactions(spark, d)
    heavy, tasks = load(rows, ["user_id"], "ts_us", features.HEAVY_ROWS)
    return features.prepare(rows, adapter.contents(spark, d), heavy, features.HEAVY_ROWS, tasks), heavy, tasks


def pit_semantic(spark, d):
    prepared, heavy, tasks = _prepared(spark, d)
    s = features.semantic_features(features.token_state(prepared, heavy, features.HEAVY_ROWS, tasks))
    return s.select("event_id", *_SEMANTIC, *[F.col(c).cast("long").alias(c) for c in _SEMANTIC_N])


def pit_history(spark, d):
    f = features.feature_rows(adapter.interactions(spark, d), adapter.contents(spark, d))
    return _pick(f, _HISTORY, _FLAGS)


def pit_session(spark, d):
    prepared, heavy, tasks = _prepared(spark, d)
    s = features.session_window(prepared.drop("_tokens"), heavy, features.HEAVY_ROWS, tasks=tasks)
    return _pick(features.session_features(s), _SESSION, _SESSION_FLAGS)


def training_dataset(spark, d):
    t = features.training_dataset(adapter.interactions(spark, d), adapter.contents(spark, d))
    doubles = [c for c in (_HISTORY + _SESSION + _SEMANTIC) if c in features.FEATURES]
    longs = [c for c in (_FLAGS + _SESSION_FLAGS + _SEMANTIC_N) if c in features.FEATURES]
    return t.select(
        "event_id", "category", F.col("target").cast("long").alias("target"), "user_id", "candidate_group", "ts_us", "event_type",
        *[F.col(c) if c in _SEMANTIC else F.round(F.col(c).cast("double"), 6).alias(c) for c in doubles],
        *[F.col(c).cast("long").alias(c) for c in longs])


def score_time_features(spark, d):
    """Every user x content pair the user touched, scored at one later moment."""
    rows = adapter.interactions(spark, d)
    pairs = rows.select("user_id", "content_id", "creator_id", "category").distinct()
    f = features.score_time_features(rows, pairs, adapter.contents(spark, d), adapter.SCORING_US)
    return f.select(
        "user_id", "content_id",
        "hashtag_affinity", "entity_affinity", "average_semantic_affinity", "category_affinity", "recent_category_affinity",
        "session_category_affinity",
        *[F.round(c, 6).alias(c) for c in ("creator_interaction_count", "user_total_interaction_count", "content_age_hours")],
        F.col("already_seen").cast("long").alias("already_seen"), F.col("creator_followed").cast("long").alias("creator_followed"))


QUERIES = {
    "pit_semantic": pit_semantic, "pit_history": pit_history, "pit_session": pit_session,
    "training_dataset": training_dataset, "score_time_features": score_time_features,
}

def _mean(cond: str = "TRUE") -> str:
    """Mean of six-digit values over an exact integer sum."""
    return (f"coalesce(CAST(sum(CAST(round(aff * 1e6) AS BIGINT)) FILTER (WHERE {cond}) AS DOUBLE)"
            f" / ((count(aff) FILTER (WHERE {cond})) * 1e6), 0.5)")


_STRICT = "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_ORDERED = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
TOKEN_STATE = f"""
tok AS (SELECT w.event_id, w.user_id, w.ts_us, w.rejected, t.field, t.pos, t.token, w.w10,
    CASE WHEN rejected THEN -50 ELSE base_delta * w10 END AS td,
    CASE WHEN target = 1 THEN w10 ELSE 0 END AS p, CASE WHEN target = 0 THEN w10 ELSE 0 END AS n
  FROM weighted w JOIN content_tokens t USING (content_id)),
tstate AS (SELECT *, sum(td) OVER s AS t_raw, coalesce(sum(p) OVER s, 0) AS t_pos, coalesce(sum(n) OVER s, 0) AS t_neg,
    coalesce(sum(w10) OVER s, 0) AS t_w, coalesce(sum(rejected::INT) OVER s, 0) AS t_rej,
    coalesce(sum(p) OVER o, 0) AS o_pos, coalesce(sum(n) OVER o, 0) AS o_neg, coalesce(sum(w10) OVER o, 0) AS o_w
  FROM tok WINDOW s AS (PARTITION BY user_id, field, token ORDER BY ts_us {_STRICT}),
                  o AS (PARTITION BY user_id, field, token ORDER BY ts_us, event_id {_ORDERED})),
thit AS (SELECT *, CASE WHEN t_w > 0 THEN {affinity("t_raw / 10.0")} END AS aff FROM tstate),
semantic AS (SELECT event_id,
    {", ".join(f"{_mean("field = '" + f + "'")} AS {f}_affinity" for f in ("hashtag", "topic", "entity", "subgenre", "title"))},
    count(*) FILTER (WHERE aff IS NOT NULL AND t_pos > t_neg) AS semantic_positive_match_count,
    count(*) FILTER (WHERE aff IS NOT NULL AND t_neg > t_pos) AS semantic_negative_match_count,
    CAST(max((aff IS NOT NULL)::INT) AS BIGINT) AS has_semantic_history,
    coalesce(first(aff ORDER BY abs(aff - 0.5) DESC, pos) FILTER (WHERE aff IS NOT NULL), 0.5) AS strongest_semantic_affinity,
    {_mean()} AS average_semantic_affinity,
    count(*) FILTER (WHERE aff IS NOT NULL AND t_rej > 0) AS semantic_explicit_rejection_match_count,
    coalesce(max(CASE WHEN t_rej > 0 THEN greatest(0.0::DOUBLE, (0.5 - aff) * 2) END), 0.0) AS candidate_negative_semantic_match,
    CAST(max((rejected AND o_w > 0 AND o_neg > o_pos)::INT) AS BIGINT) AS repeat_rejection
  FROM thit GROUP BY event_id)"""

HISTORY = f"""
delta AS (SELECT w.* EXCLUDE (creator_followed), c.popularity_score, c.created_us,
    CASE WHEN rejected THEN CASE WHEN coalesce(repeat_rejection, 0) = 1 THEN -50 ELSE -80 END ELSE base_delta * w10 END AS cd,
    CASE WHEN watch_percentage IS NOT NULL THEN w10 END AS ww, w10 * watch_percentage AS ws
  FROM weighted w LEFT JOIN semantic USING (event_id) JOIN contents c USING (content_id)),
hist0 AS (SELECT *,
    coalesce(sum(cd) OVER c, 0) AS c_raw, coalesce(sum(w10) OVER c, 0) AS c_w, coalesce(sum(ww) OVER c, 0) AS c_ww,
    coalesce(sum(ws) OVER c, 0) AS c_ws, coalesce(sum(w10 * completed::INT) OVER c, 0) AS c_done,
    coalesce(sum(CASE WHEN target = 1 THEN w10 END) OVER c, 0) AS c_pos,
    coalesce(sum(CASE WHEN target = 0 THEN w10 END) OVER c, 0) AS c_neg, coalesce(sum(rejected::INT) OVER c, 0) AS c_rej,
    max(ts_us) OVER c AS c_last, max(CASE WHEN rejected THEN ts_us END) OVER c AS c_last_rej,
    coalesce(sum(cd) OVER r, 0) AS r_raw, coalesce(sum(ww) OVER r, 0) AS r_ww, coalesce(sum(ws) OVER r, 0) AS r_ws,
    coalesce(sum(CASE WHEN ww IS NOT NULL THEN w10 * completed::INT END) OVER r, 0) AS r_done,
    coalesce(sum(w10) OVER k, 0) AS k_w, coalesce(sum(w10 * completed::INT) OVER k, 0) AS k_done,
    coalesce(sum(sig_followed::INT) OVER k, 0) AS k_follow, count(*) OVER s AS s_n, coalesce(sum(w10) OVER u, 0) AS u_w
  FROM delta WINDOW c AS (PARTITION BY user_id, category ORDER BY ts_us {_STRICT}),
    r AS (PARTITION BY user_id, category ORDER BY ts_us RANGE BETWEEN {features.RECENT_US} PRECEDING AND 1 PRECEDING),
    k AS (PARTITION BY user_id, creator_id ORDER BY ts_us {_STRICT}),
    s AS (PARTITION BY user_id, content_id ORDER BY ts_us {_STRICT}), u AS (PARTITION BY user_id ORDER BY ts_us {_STRICT})),
hist AS (SELECT *, {affinity("c_raw / 10.0")} AS category_affinity, {affinity("r_raw / 10.0")} AS recent_category_affinity,
    CAST((c_w > 0)::INT AS BIGINT) AS has_category_history,
    round(CASE WHEN c_ww > 0 THEN c_ws / c_ww ELSE 0 END, 6) AS average_category_watch_percentage,
    round(CASE WHEN r_ww > 0 THEN r_ws / r_ww ELSE 0 END, 6) AS recent_category_watch_percentage,
    round(CASE WHEN c_ww > 0 THEN CAST(c_done AS DOUBLE) / c_ww ELSE 0 END, 6) AS category_completion_rate,
    round(CASE WHEN r_ww > 0 THEN CAST(r_done AS DOUBLE) / r_ww ELSE 0 END, 6) AS recent_category_completion_rate,
    round(ln(1 + c_pos / 10.0), 6) AS category_positive_count, round(ln(1 + c_neg / 10.0), 6) AS category_negative_count,
    round(ln(1 + c_w / 10.0), 6) AS category_interaction_count,
    CAST((k_w > 0)::INT AS BIGINT) AS has_creator_history, round(ln(1 + k_w / 10.0), 6) AS creator_interaction_count,
    round(CASE WHEN k_w > 0 THEN CAST(k_done AS DOUBLE) / k_w ELSE 0 END, 6) AS creator_completion_rate,
    CAST((k_follow > 0)::INT AS BIGINT) AS creator_followed, CAST((s_n > 0)::INT AS BIGINT) AS already_seen,
    round(ln(1 + u_w / 10.0), 6) AS user_total_interaction_count, popularity_score AS content_popularity_score,
    round(least(8760.0::DOUBLE, greatest(0.0::DOUBLE, (ts_us - created_us) / 3.6e9)), 6) AS content_age_hours,
    CAST(extract('hour' FROM make_timestamp(ts_us)) AS BIGINT) AS hour_of_day,
    round(CASE WHEN c_last IS NULL THEN 0 ELSE least(365.0::DOUBLE, (ts_us - c_last) / 8.64e10) END, 6) AS days_since_last_category_interaction,
    round(ln(1 + c_rej), 6) AS category_explicit_rejection_count,
    round(coalesce(exp(-ln(2.0) / 30 * (ts_us - c_last_rej) / 8.64e10), 0), 6) AS recent_explicit_rejection_strength
  FROM hist0)"""

SESSION = f"""
near AS (SELECT a.event_id, a.category AS own, a.ts_us AS now_us, b.*,
    row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts_us DESC, b.e2 DESC) AS rn
  FROM (SELECT event_id, user_id, category, ts_us FROM weighted) a JOIN
    (SELECT event_id AS e2, user_id, category AS cat, ts_us, session_delta AS sd, session_label AS sl, watch_percentage AS wp,
            w10 / 10.0 AS w FROM weighted) b
    ON a.user_id = b.user_id AND b.ts_us < a.ts_us AND a.ts_us - b.ts_us <= {features.SESSION_US}
  QUALIFY rn <= 12),
near2 AS (SELECT *, exp(-ln(2.0) / 5 * (now_us - ts_us) / 6e7) * w AS eff, abs(sd) + (sl IS NOT NULL)::INT AS mag,
    CASE sl WHEN 1 THEN 1 WHEN 0 THEN -1 ELSE 0 END AS sgn,
    first(cat) OVER l AS last_cat, first(sl) OVER l AS last_sl
  FROM near WINDOW l AS (PARTITION BY event_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
near3 AS (SELECT *, coalesce(min(CASE WHEN cat <> last_cat THEN rn END) OVER (PARTITION BY event_id), 99) AS b1,
    coalesce(min(CASE WHEN cat <> last_cat OR sl IS DISTINCT FROM last_sl THEN rn END) OVER (PARTITION BY event_id), 99) AS b2
  FROM near2),
sess AS (SELECT event_id, {affinity("coalesce(sum(eff * sd) FILTER (WHERE cat = own), 0)")} AS aff,
    ln(1 + coalesce(sum(w) FILTER (WHERE cat = own AND sl = 1), 0)) AS pos,
    ln(1 + coalesce(sum(w) FILTER (WHERE cat = own AND sl = 0), 0)) AS neg,
    sum(eff * wp) / nullif(sum(eff) FILTER (WHERE wp IS NOT NULL), 0) AS avg_wp,
    sum(eff * mag) FILTER (WHERE cat = own) AS ev, sum(eff * mag * sgn) FILTER (WHERE cat = own) AS signed,
    sum(w) FILTER (WHERE rn < b1) AS streak,
    CASE any_value(last_sl) WHEN 1 THEN 1 WHEN 0 THEN -1 ELSE 0 END * sum(w) FILTER (WHERE rn < b2) AS valence,
    (any_value(last_cat) = any_value(own))::INT AS match
  FROM near3 GROUP BY event_id),
session AS (SELECT w.event_id, coalesce(aff, 0.5) AS session_category_affinity,
    round(coalesce(pos, 0), 6) AS session_positive_interaction_count,
    round(coalesce(neg, 0), 6) AS session_negative_interaction_count,
    round(coalesce(avg_wp, 0), 6) AS session_average_watch_percentage,
    round(coalesce(CASE WHEN ev > 0 THEN least(1.0::DOUBLE, ev / 4) * abs(signed) / ev END, 0), 6) AS session_intent_confidence,
    round(coalesce(CAST(streak AS DOUBLE), 0), 6) AS session_category_streak,
    round(coalesce(CAST(valence AS DOUBLE), 0), 6) AS session_category_streak_valence,
    round(coalesce(CASE WHEN match = 1 THEN CAST(valence AS DOUBLE) END, 0), 6) AS session_category_streak_valence_matched,
    round(coalesce(CASE WHEN match = 0 THEN CAST(valence AS DOUBLE) END, 0), 6) AS session_category_streak_valence_unmatched,
    CAST((s.event_id IS NOT NULL)::INT AS BIGINT) AS has_session_activity,
    CAST(coalesce(match, 0) AS BIGINT) AS last_interaction_category_match
  FROM weighted w LEFT JOIN sess s USING (event_id))"""

_F = features.FEATURES
ORACLE = {
    "pit_semantic": with_ctes(
        f"SELECT event_id, {', '.join(_SEMANTIC)}, {', '.join(_SEMANTIC_N)} FROM semantic", "WEIGHTED", "TOKENS", extra=TOKEN_STATE),
    "pit_history": with_ctes(
        f"SELECT event_id, {', '.join(_HISTORY + _FLAGS)} FROM hist", "WEIGHTED", "TOKENS", extra=TOKEN_STATE + "," + HISTORY),
    "pit_session": with_ctes(
        f"SELECT event_id, {', '.join(_SESSION + _SESSION_FLAGS)} FROM session", "WEIGHTED", extra=SESSION),
    "training_dataset": with_ctes(f"""
        SELECT event_id, category, CAST(target AS BIGINT) AS target, user_id,
          user_id || ':' || strftime(make_timestamp(ts_us), '%Y-%m-%d') AS candidate_group, ts_us, event_type,
          {', '.join(c for c in _HISTORY + _FLAGS + _SESSION + _SESSION_FLAGS if c in _F)},
          {', '.join(c for c in _SEMANTIC if c in _F)}, {', '.join(c for c in _SEMANTIC_N if c in _F)}
        FROM hist JOIN session USING (event_id) JOIN semantic USING (event_id)
        WHERE target IS NOT NULL AND NOT is_training_context_only""", "WEIGHTED", "TOKENS",
        extra=TOKEN_STATE + "," + HISTORY + "," + SESSION),
    "score_time_features": with_ctes(f"""
        SELECT p.user_id, p.content_id,
          {affinity("c_raw / 10.0")} AS category_affinity, {affinity("r_raw / 10.0")} AS recent_category_affinity,
          hashtag_affinity, entity_affinity,
          round(ln(1 + k_w / 10.0), 6) AS creator_interaction_count, round(ln(1 + u_w / 10.0), 6) AS user_total_interaction_count,
          round(least(8760.0::DOUBLE, greatest(0.0::DOUBLE, ({adapter.SCORING_US} - c.created_us) / 3.6e9)), 6) AS content_age_hours,
          average_semantic_affinity,
          0.5::DOUBLE + 0 * coalesce(sess_n, 0) AS session_category_affinity,
          CAST(1 AS BIGINT) AS already_seen, CAST((k_follow > 0)::INT AS BIGINT) AS creator_followed
        FROM pairs p JOIN contents c USING (content_id) JOIN cat USING (user_id, category)
          JOIN cre ON cre.user_id = p.user_id AND cre.creator_id = p.creator_id JOIN usr ON usr.user_id = p.user_id
          JOIN sem ON sem.user_id = p.user_id AND sem.content_id = p.content_id
          LEFT JOIN (SELECT user_id, count(*) AS sess_n FROM weighted WHERE ts_us >= {adapter.SCORING_US - features.SESSION_US}
                     GROUP BY 1) q ON q.user_id = p.user_id""", "WEIGHTED", "TOKENS", extra=TOKEN_STATE + "," + HISTORY + f""",
        pairs AS (SELECT DISTINCT user_id, content_id, creator_id FROM weighted),
        cat AS (SELECT user_id, category, sum(cd) AS c_raw,
                  coalesce(sum(cd) FILTER (WHERE ts_us >= {adapter.SCORING_US - features.RECENT_US}), 0) AS r_raw FROM delta GROUP BY 1, 2),
        cre AS (SELECT user_id, creator_id, sum(w10) AS k_w, sum(sig_followed::INT) AS k_follow FROM weighted GROUP BY 1, 2),
        usr AS (SELECT user_id, sum(w10) AS u_w FROM weighted GROUP BY 1),
        tk AS (SELECT user_id, field, token, {affinity("sum(td) / 10.0")} AS aff FROM tok GROUP BY 1, 2, 3 HAVING sum(w10) > 0),
        sem AS (SELECT p.user_id, p.content_id, {_mean("t.field = 'hashtag'")} AS hashtag_affinity,
                  {_mean("t.field = 'entity'")} AS entity_affinity,
                  {_mean()} AS average_semantic_affinity
                FROM pairs p JOIN content_tokens t USING (content_id) LEFT JOIN tk
                  ON tk.user_id = p.user_id AND tk.field = t.field AND tk.token = t.token GROUP BY 1, 2)"""),
}
