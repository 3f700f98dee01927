"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, live, metrics, retrieval
from ..operators.running import top_n
from ..functions import signals
from ..sources import adapter
from .base_sql import affinity, with_ctes
from .pointintime import HISTORY, TOKEN_STATE

NOW = adapter.DECISION_US
SESSION = 24 * 3_600_000_000
LIMIT = 12
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _past(spark, d):
    return adapter.interactions(spark, d).where(F.col("ts_us") < NOW)


def _recent(spark, d):
    return top_n(_past(spark, d), ["user_id"], [F.desc("ts_us"), F.desc("id")], 500)


def _interests(spark, d):
    return adapter.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.array(F.lit("PROMO"), F.lit("SMALL")).alias("interests"))


def session_preferred_categories(spark, d):
    return retrieval.session_categories(_past(spark, d), NOW, session_us=SESSION)


def preferred_categories(spark, d):
    return retrieval.preferred_categories(_recent(spark, d), _interests(spark, d))


def _bucket_inputs(spark, d):
    video = _recent(spark, d).where(F.col("content_type") != "LIVE")
    return dict(
        users=_past(spark, d).select("user_id").distinct(),
        catalog=adapter.contents(spark, d).where(F.col("is_active") & (F.col("content_type") == "VIDEO")),
        seen=video.where(signals.hard_seen()).select("user_id", "content_id").distinct(),
        followed=video.where(signals.signal("sig_followed")).select("user_id", "creator_id").distinct(),
        session=session_preferred_categories(spark, d), preferred=retrieval.preferred_categories(_recent(spark, d)), now_us=NOW, limit=LIMIT)


def video_candidate_buckets(spark, d):
    return retrieval.video_buckets(**_bucket_inputs(spark, d)).withColumn("place", F.col("place").cast("long")).withColumn("bucket", F.col("bucket").cast("long"))


def bucket_quota_fill(spark, d):
    """Whole VIDEO retrieval: buckets, quota fill and the candidate projection."""
    c = retrieval.video_candidates(adapter.interactions(spark, d), adapter.contents(spark, d), NOW, limit=LIMIT, session_us=SESSION)
    return c.select("user_id", "content_id", "source", "position", "content_age_hours", "creator_followed", "already_seen")


def _state(spark, d):
    """Dynamic state per LIVE content over six-hour windows of the interactions at the decision moment."""
    rows = adapter.interactions(spark, d).where(F.col("content_type") == "LIVE")
    return live.dynamic_state(rows, NOW, stale_us=SESSION, window_us=4 * SESSION)


def _live_inputs(spark, d):
    past = _past(spark, d)
    marked = past.withColumn("creator_followed", F.col("event_type") == "CREATOR_FOLLOWED")
    return dict(
        users=past.select("user_id").distinct(), contents=adapter.contents(spark, d), followed=live.followed_creators(marked, 2),
        recent_creators=live.recent_positive(past, "creator_id", 3), preferred=live.recent_positive(past, "category", 1), state=_state(spark, d))


def live_candidate_buckets(spark, d):
    return retrieval.live_candidates(**_live_inputs(spark, d), limit=80).select("user_id", "content_id", "source")


def live_candidate_projection(spark, d):
    i = _live_inputs(spark, d)
    chosen = retrieval.live_candidates(**i, limit=20)
    hist = live.live_sessions(_past(spark, d).where(F.col("content_type") == "LIVE")).groupBy("user_id", "creator_id").agg(
        F.count(F.lit(1)).alias("previous_live_interactions"), F.round(F.sum("watch_us") / 1e6, 6).alias("previous_live_watch_time"))
    p = retrieval.live_projection(chosen, i["contents"], hist, i["followed"], i["state"], NOW)
    return p.select("user_id", "content_id", "source", F.round("live_age_minutes", 6).alias("live_age_minutes"), "creator_followed", "current_viewer_count",
                    F.coalesce("previous_live_interactions", F.lit(0)).alias("previous_live_interactions"))


def live_pool_buckets(spark, d):
    """Caller pools: every user's orders play streams."""
    o = adapter.table(spark, d, "orders")
    key = F.col("o_orderkey")
    pool = o.select(
        F.col("o_custkey").cast("string").alias("user_id"), key.alias("seq"), key.cast("string").alias("stream_id"), F.col("o_orderpriority").alias("category"),
        F.when(F.col("o_orderstatus") == "P", "ENDED").otherwise("ACTIVE").alias("status"), (key % 4).alias("previous_live_interactions"),
        (key % 5 == 0).alias("creator_followed"), ((key % 30) / 100).alias("viewer_growth_rate"), (key * 13 % 700).alias("current_viewer_count"),
        (key % 3 == 0).alias("region_match"), (key % 60).cast("double").alias("live_age_minutes"))
    return retrieval.live_pool_buckets(pool, 12)


def candidate_filter_dedupe(spark, d):
    o = adapter.table(spark, d, "lineitem")
    c = o.select(
        (F.col("l_orderkey") % 500).cast("string").alias("user_id"), (F.col("l_partkey") % 50).cast("string").alias("content_id"),
        F.when(F.col("l_suppkey") % 10 == 0, "  ").otherwise(F.col("l_suppkey").cast("string")).alias("creator_id"), F.col("l_linestatus").alias("category"),
        (F.col("l_tax") > 0.07).alias("already_seen"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("position"))
    seen = adapter.interactions(spark, d).select("user_id", "content_id").distinct()
    return retrieval.clean_candidates(c, seen).select("user_id", "content_id", "position").distinct()


def _exploded(df, key):
    return df.select(key, F.posexplode("vector").alias("slot", "value")).select(key, F.col("slot").cast("long").alias("slot"), F.round(F.col("value").cast("double"), 9).alias("value"))


def content_vector(spark, d):
    return _exploded(retrieval.content_vectors(adapter.contents(spark, d), CATEGORIES), "content_id")


def user_vector(spark, d):
    state = features.final_state(adapter.interactions(spark, d), adapter.contents(spark, d))
    return _exploded(retrieval.user_vectors(state, CATEGORIES), "user_id")


def _embedded(spark, d, name):
    e = adapter.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias(name), F.col("embedding").cast("array<double>").alias("vector"), "label")


def retrieve_top_k(spark, d):
    q, i = _embedded(spark, d, "query_id").drop("label"), _embedded(spark, d, "item_id").drop("label")
    own = q.select("query_id", F.col("query_id").alias("item_id"))
    return retrieval.retrieve_top_k(q, i, 10, seen=own).select("query_id", "item_id", F.round("score", 6).alias("score"))


def _report_inputs(spark, d):
    q, i = _embedded(spark, d, "query_id"), _embedded(spark, d, "item_id")
    ranked = retrieval.retrieve_top_k(q.drop("label"), i.drop("label"), 20, seen=q.select("query_id", F.col("query_id").alias("item_id")))
    from pyspark.sql import Window

    nxt = F.lead("query_id").over(Window.partitionBy("label").orderBy("query_id"))
    positives = q.select("query_id", nxt.alias("item_id")).where("item_id is not null")
    return ranked, positives, i.agg(F.count(F.lit(1)).alias("catalog_size"))


def retrieval_report(spark, d):
    r = metrics.retrieval_report(*_report_inputs(spark, d))
    return r.select("queries", *[F.round(c, 6).alias(c) for c in ("recall_at_1", "recall_at_5", "recall_at_10", "mrr", "ndcg_at_10", "coverage")])


def most_retrieved_items(spark, d):
    return metrics.most_retrieved(_report_inputs(spark, d)[0], 10)


def two_tower_training_pairs(spark, d):
    """Each labelled event's user vector, of strictly earlier events, slot by slot, and the length of its content vector."""
    p = retrieval.training_pairs(adapter.interactions(spark, d), adapter.contents(spark, d), CATEGORIES)
    return p.select("event_id", F.col("target").cast("long").alias("target"), F.size("content_vector").cast("long").alias("content_dim"), F.posexplode("user_vector").alias("slot", "value")).select(
        "event_id", "target", "content_dim", F.col("slot").cast("long").alias("slot"), F.round("value", 6).alias("value"))


QUERIES = {
    "session_preferred_categories": session_preferred_categories, "preferred_categories": preferred_categories,
    "video_candidate_buckets": video_candidate_buckets, "bucket_quota_fill": bucket_quota_fill, "live_candidate_buckets": live_candidate_buckets,
    "live_candidate_projection": live_candidate_projection, "live_pool_buckets": live_pool_buckets, "candidate_filter_dedupe": candidate_filter_dedupe,
    "content_vector": content_vector, "user_vector": user_vector, "retrieve_top_k": retrieve_top_k, "retrieval_report": retrieval_report,
    "most_retrieved_items": most_retrieved_items, "two_tower_training_pairs": two_tower_training_pairs,
}

_DELTA = "base_delta - 8 * (event_type = 'CONTENT_NOT_INTERESTED')::INT"
_USER = f"""
past AS (SELECT * FROM sig WHERE ts_us < {NOW}),
recent AS (SELECT * FROM past QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_us DESC, id DESC) <= 500),
vid AS (SELECT * FROM recent WHERE content_type <> 'LIVE'),
sess AS (SELECT user_id, category FROM (SELECT user_id, category, count(*) AS n, min(ts_us) AS f FROM
    (SELECT * FROM (SELECT * FROM past QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_us DESC, id DESC) <= 48)
     WHERE content_type <> 'LIVE' AND {NOW} - ts_us <= {SESSION} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_us DESC, id DESC) <= 12)
    WHERE target = 1 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) <= 2),
pref AS (SELECT user_id, category FROM (SELECT user_id, category, {affinity(f"sum({_DELTA})")} AS a, min(ts_us) AS f FROM vid GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY a DESC, f) <= 2),
catalog AS (SELECT * FROM contents WHERE is_active AND content_type = 'VIDEO'),
users AS (SELECT DISTINCT user_id FROM past),
fol AS (SELECT DISTINCT user_id, creator_id FROM vid WHERE sig_followed),
seen AS (SELECT DISTINCT user_id, content_id FROM vid WHERE NOT rejected),
bk AS (
  SELECT user_id, 0 AS bucket, c.* FROM fol JOIN catalog c USING (creator_id)
  UNION ALL SELECT user_id, 1, c.* FROM sess JOIN catalog c USING (category) UNION ALL SELECT user_id, 2, c.* FROM pref JOIN catalog c USING (category)
  UNION ALL SELECT user_id, 3, c.* FROM users, catalog c WHERE popularity_score >= 0.7
  UNION ALL SELECT user_id, 4, c.* FROM users, catalog c WHERE {NOW} - created_us <= {retrieval.NEW_US}
  UNION ALL SELECT u.user_id, 5, c.* FROM users u, catalog c WHERE NOT EXISTS (SELECT 1 FROM sess s WHERE s.user_id = u.user_id AND s.category = c.category)
    AND NOT EXISTS (SELECT 1 FROM pref p WHERE p.user_id = u.user_id AND p.category = c.category))"""
_LIVE = f"""
past AS (SELECT * FROM sig WHERE ts_us < {NOW}),
users AS (SELECT DISTINCT user_id FROM past),
act AS (SELECT *, row_number() OVER (ORDER BY created_us DESC, content_id) AS pos FROM contents WHERE is_active AND content_type = 'LIVE'),
fol AS (SELECT user_id, creator_id FROM (SELECT user_id, creator_id, max(ts_us) AS l FROM
    (SELECT * FROM past WHERE event_type = 'CREATOR_FOLLOWED' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_us DESC, id DESC) <= 500) GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY l DESC) <= 2),
posi AS (SELECT * FROM (SELECT * FROM past QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_us DESC, id DESC) <= 500) WHERE content_type <> 'LIVE' AND target = 1),
rc AS (SELECT user_id, creator_id FROM (SELECT user_id, creator_id, max(ts_us) AS l FROM posi GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY l DESC) <= 3) x
  WHERE NOT EXISTS (SELECT 1 FROM fol WHERE fol.user_id = x.user_id AND fol.creator_id = x.creator_id)),
pc AS (SELECT user_id, category FROM (SELECT user_id, category, max(ts_us) AS l FROM posi GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY l DESC) <= 1),
b3 AS (SELECT user_id, content_id, min(b) AS b, any_value(pos) AS pos FROM (SELECT user_id, content_id, 0 AS b, pos FROM fol JOIN act USING (creator_id)
    UNION ALL SELECT user_id, content_id, 1, pos FROM rc JOIN act USING (creator_id) UNION ALL SELECT user_id, content_id, 2, pos FROM pc JOIN act USING (category)) GROUP BY 1, 2),
sel AS (SELECT * FROM b3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY b, pos) <= 80),
room AS (SELECT u.user_id, 80 - count(s.content_id) AS room FROM users u LEFT JOIN sel s USING (user_id) GROUP BY 1),
pool AS (SELECT r.user_id, room, a.* FROM room r, act a WHERE room > 0 AND NOT EXISTS (SELECT 1 FROM sel s WHERE s.user_id = r.user_id AND s.content_id = a.content_id)
  QUALIFY row_number() OVER (PARTITION BY r.user_id ORDER BY pos) <= least(200, greatest(room, 50))),
near AS (SELECT * FROM sig WHERE content_type = 'LIVE' AND ts_us BETWEEN {NOW - 4 * SESSION} AND {NOW}),
st AS (SELECT content_id, greatest(-1, least(10, (late - early) / greatest(1, early))) AS g FROM (SELECT content_id,
    count(DISTINCT CASE WHEN event_type = 'LIVE_JOINED' AND ts_us >= {NOW - 2 * SESSION} THEN user_id END) AS late,
    count(DISTINCT CASE WHEN event_type = 'LIVE_JOINED' AND ts_us < {NOW - 2 * SESSION} THEN user_id END) AS early FROM near GROUP BY 1)),
tr AS (SELECT user_id, content_id, 3 AS b, row_number() OVER (PARTITION BY user_id ORDER BY g DESC, pos) AS pos FROM pool JOIN st USING (content_id) WHERE g > 0.15
  QUALIFY pos <= any_value(room) OVER (PARTITION BY user_id)),
sofar AS (SELECT user_id, content_id, b, pos FROM sel UNION ALL SELECT user_id, content_id, b, pos FROM tr),
ex AS (SELECT r.user_id, a.content_id, 4 AS b, pos FROM room r, act a WHERE NOT EXISTS (SELECT 1 FROM sofar s WHERE s.user_id = r.user_id AND s.content_id = a.content_id))"""
_HASH = """CAST(('0x' || substr(sha256({t}), 1, 8))::BIGINT % {d} AS BIGINT)"""
_SIGN = "CASE WHEN ('0x' || substr(sha256({t}), 9, 2))::INT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"


def _h(t: str, dim: int) -> str:
    return _HASH.format(t=t, d=dim)


_VALUES = " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS cat" for i, c in enumerate(CATEGORIES))
_SEM = """SELECT {k}, sum({w}) AS v, {h} AS slot FROM {src} GROUP BY 1, 3"""



def _in_turn(turns: list[tuple[int, str, int]], rest: list[tuple[int, str]], limit: int) -> str:
    """CTEs over ``lst`` (user_id, bucket, place, content_id): each turn (bucket, source, quota) takes its first items that
    no turn before took, then ``rest`` fills up. The last CTE is ``filled`` (user_id, content_id, source, position)."""
    parts, names = [], []
    for n, (bucket, source, quota) in enumerate([*turns, *[(b, s, limit) for b, s in rest]]):
        before = " UNION ALL ".join(f"SELECT user_id, content_id FROM turn{m}" for m in range(n))
        new = f"AND NOT EXISTS (SELECT 1 FROM ({before}) t WHERE t.user_id = l.user_id AND t.content_id = l.content_id)" if n else ""
        parts.append(f"""turn{n} AS (SELECT user_id, content_id, '{source}' AS source, {n} AS turn, row_number() OVER (PARTITION BY user_id ORDER BY place) AS o
            FROM lst l WHERE bucket = {bucket} {new} QUALIFY o <= {quota})""")
        names.append(f"SELECT * FROM turn{n}")
    return ", ".join(parts) + f""", filled AS (SELECT user_id, content_id, source, CAST(row_number() OVER (PARTITION BY user_id ORDER BY turn, o) AS INTEGER) AS position
        FROM ({" UNION ALL ".join(names)}) QUALIFY position <= {limit})"""


_QUOTA = max(1, LIMIT // len(retrieval.SOURCES))
_FILL = [(n, s, _QUOTA if n < 5 else max(1, int(_QUOTA * retrieval.EXPLORATION_FRACTION))) for n, s in enumerate(retrieval.SOURCES)]
_POOL = f"""pool AS (SELECT CAST(o_custkey AS VARCHAR) AS user_id, o_orderkey AS seq, CAST(o_orderkey AS VARCHAR) AS content_id, o_orderpriority AS category,
    o_orderkey % 4 AS prev, o_orderkey * 13 % 700 AS viewers, (o_orderkey % 30) / 100 AS growth FROM orders WHERE o_orderstatus <> 'P'),
  liked AS (SELECT DISTINCT user_id, category FROM (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY prev DESC, seq) <= 2) WHERE prev > 0),
  flags AS (SELECT p.*, [seq % 5 = 0, l.category IS NOT NULL, growth >= 0.15 OR viewers >= 500, seq % 3 = 0, seq % 60 <= 20, true] AS inside
    FROM pool p LEFT JOIN liked l ON l.user_id = p.user_id AND l.category = p.category),
  lst AS (SELECT user_id, b AS bucket, row_number() OVER (PARTITION BY user_id, b ORDER BY viewers DESC, seq) AS place, content_id FROM flags, range(6) r(b) WHERE inside[b + 1]
    UNION ALL SELECT user_id, 6, seq, content_id FROM pool),
  """ + _in_turn([(n, s, max(1, 12 // 6)) for n, s in enumerate(retrieval.LIVE_POOL_SOURCES)], [(6, "EXPLORATION")], 12)
_PLACES = f"""lst AS (SELECT user_id, bucket, content_id, row_number() OVER (PARTITION BY user_id, bucket
    ORDER BY CASE WHEN bucket = 4 THEN created_us ELSE popularity_score END DESC, content_id) AS place
  FROM bk b WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = b.user_id AND s.content_id = b.content_id) QUALIFY place <= {LIMIT}), """ + _in_turn(
    _FILL, [(n, s) for n, s in enumerate(retrieval.SOURCES[:-1])], LIMIT)
ORACLE = {
    "session_preferred_categories": with_ctes("SELECT * FROM sess", "SIG", extra=_USER),
    "preferred_categories": with_ctes("""SELECT * FROM pref UNION ALL SELECT CAST(c_custkey AS VARCHAR), cat FROM customer, (VALUES ('PROMO'), ('SMALL')) t(cat)
        WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT user_id FROM vid)""", "SIG", extra=_USER),
    "video_candidate_buckets": with_ctes(f"""
        SELECT user_id, CAST(bucket AS BIGINT) AS bucket, content_id, row_number() OVER (PARTITION BY user_id, bucket
            ORDER BY CASE WHEN bucket = 4 THEN created_us ELSE popularity_score END DESC, content_id) AS place
        FROM bk b WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = b.user_id AND s.content_id = b.content_id) QUALIFY place <= {LIMIT}""", "SIG", extra=_USER),
    "bucket_quota_fill": with_ctes(f"""
        SELECT f.user_id, f.content_id, source, position, round(least(8760.0::DOUBLE, greatest(0.0::DOUBLE, ({NOW} - c.created_us) / 3.6e9)), 2) AS content_age_hours,
          EXISTS (SELECT 1 FROM fol x WHERE x.user_id = f.user_id AND x.creator_id = c.creator_id) AS creator_followed, false AS already_seen
        FROM filled f JOIN contents c USING (content_id)""", "SIG", extra=_USER + ", " + _PLACES),
    "live_pool_buckets": f"WITH {_POOL} SELECT user_id, content_id AS stream_id, source, position FROM filled",
    "live_candidate_buckets": with_ctes("""
        SELECT user_id, content_id, ['FOLLOWED_CREATOR', 'RECENT_CREATOR_INTERACTION', 'PREFERRED_CATEGORY', 'TRENDING_LIVE', 'EXPLORATION'][b + 1] AS source
        FROM (SELECT * FROM sofar UNION ALL SELECT * FROM ex) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY b, pos) <= 80""", "SIG", extra=_LIVE),
    "candidate_filter_dedupe": with_ctes("""
        SELECT user_id, content_id, min(position) AS position FROM
          (SELECT CAST(l_orderkey % 500 AS VARCHAR) AS user_id, CAST(l_partkey % 50 AS VARCHAR) AS content_id, l_orderkey * 100 + l_linenumber AS position
           FROM lineitem WHERE l_suppkey % 10 <> 0 AND NOT l_tax > 0.07) c
        WHERE NOT EXISTS (SELECT 1 FROM interactions i WHERE i.user_id = c.user_id AND i.content_id = c.content_id) GROUP BY 1, 2""", "INTERACTIONS"),
    "content_vector": with_ctes(f"""
        SELECT content_id, CAST(i AS BIGINT) AS slot, CASE WHEN category = cat THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END AS value FROM contents, ({_VALUES})
        UNION ALL SELECT content_id, 6, popularity_score FROM contents
        UNION ALL SELECT content_id, 7 + s, CASE WHEN s = {_h('creator_id', 8)} THEN 0.6 * {_SIGN.format(t='creator_id')} ELSE 0.0::DOUBLE END FROM contents, range(8) r(s)
        UNION ALL SELECT c.content_id, 15 + s, round(0.6 * coalesce(v, 0), 9) FROM contents c CROSS JOIN range(32) r(s) LEFT JOIN
          (SELECT content_id, {_h('token', 32)} AS slot, sum({_SIGN.format(t='token')}) AS v FROM (SELECT DISTINCT content_id, token FROM content_tokens) GROUP BY 1, 2) x
          ON x.content_id = c.content_id AND x.slot = s""", "TOKENS"),
    "user_vector": with_ctes(f"""
        SELECT user_id, slot, round(value, 9) AS value FROM (
          SELECT u.user_id, CAST(i AS BIGINT) AS slot, 1.5 * coalesce(a, 0.5) AS value FROM us u CROSS JOIN ({_VALUES}) v LEFT JOIN cat c ON c.user_id = u.user_id AND c.category = v.cat
          UNION ALL SELECT u.user_id, 6 + i, 1.5 * coalesce(r, 0.5) FROM us u CROSS JOIN ({_VALUES}) v LEFT JOIN cat c ON c.user_id = u.user_id AND c.category = v.cat
          UNION ALL SELECT u.user_id, 12 + i, coalesce((c.w > 0)::INT, 0) FROM us u CROSS JOIN ({_VALUES}) v LEFT JOIN cat c ON c.user_id = u.user_id AND c.category = v.cat
          UNION ALL SELECT user_id, 18, least(1, ln(1 + w / 10.0) / 5) FROM us UNION ALL SELECT user_id, 19, p / 10.0 / greatest(1, (p + n) / 10.0) FROM us
          UNION ALL SELECT user_id, 20, n / 10.0 / greatest(1, (p + n) / 10.0) FROM us UNION ALL SELECT user_id, 21, least(1, ln(1 + k) / 3) FROM us
          UNION ALL SELECT u.user_id, 22 + s, 0.6 * coalesce(v, 0) FROM us u CROSS JOIN range(32) g(s) LEFT JOIN
            (SELECT user_id, {_h('token', 32)} AS slot, sum({_SIGN.format(t='token')} * (aff - 0.5)) AS v FROM tk GROUP BY 1, 2) x ON x.user_id = u.user_id AND x.slot = s)""",
        "WEIGHTED", "TOKENS", extra=TOKEN_STATE + "," + HISTORY + f""",
        dl AS (SELECT *, max(ts_us) OVER (PARTITION BY user_id) AS last_us FROM delta),
        cat AS (SELECT user_id, category, {affinity("sum(cd) / 10.0")} AS a, sum(w10) AS w,
                  {affinity(f"coalesce(sum(cd) FILTER (WHERE last_us - ts_us <= {features.RECENT_US}), 0) / 10.0")} AS r FROM dl GROUP BY 1, 2),
        us AS (SELECT user_id, sum(w10) AS w, coalesce(sum(w10) FILTER (WHERE target = 1), 0) AS p, coalesce(sum(w10) FILTER (WHERE target = 0), 0) AS n, any_value(k) AS k
          FROM weighted JOIN (SELECT user_id, count(*) AS k FROM (SELECT user_id, creator_id FROM weighted GROUP BY 1, 2 HAVING sum(w10) > 0) GROUP BY 1) USING (user_id) GROUP BY 1),
        tk AS (SELECT user_id, field, token, {affinity("sum(td) / 10.0")} AS aff FROM tok GROUP BY 1, 2, 3 HAVING sum(w10) > 0)"""),
    "retrieve_top_k": """SELECT query_id, item_id, round(score, 6) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id,
          round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 10""",
}
_RET = """WITH r AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM
    (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score
     FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) QUALIFY rank <= 20),
p AS (SELECT vec_id AS query_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS item_id FROM embeddings QUALIFY item_id IS NOT NULL)"""
ORACLE["retrieval_report"] = _RET + """
    SELECT count(*) AS queries, round(avg(coalesce((rank <= 1)::INT, 0)), 6) AS recall_at_1, round(avg(coalesce((rank <= 5)::INT, 0)), 6) AS recall_at_5,
      round(avg(coalesce((rank <= 10)::INT, 0)), 6) AS recall_at_10, round(avg(coalesce(1 / rank, 0)), 6) AS mrr,
      round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_at_10,
      round((SELECT count(DISTINCT item_id) FROM r WHERE rank <= 10) / (SELECT count(*) FROM embeddings), 6) AS coverage
    FROM p LEFT JOIN r USING (query_id, item_id)"""
ORACLE["most_retrieved_items"] = _RET + """
    SELECT item_id, count(*) AS times FROM r WHERE rank <= 10 GROUP BY 1 ORDER BY times DESC, item_id LIMIT 10"""
ORACLE["two_tower_training_pairs"] = with_ctes(f"""
    SELECT event_id, CAST(target AS BIGINT) AS target, CAST(47 AS BIGINT) AS content_dim, CAST(slot AS BIGINT) AS slot, round(value, 6) AS value FROM (
      SELECT e.event_id, e.target, i AS slot, 1.5 * coalesce(a, 0.5) AS value FROM e CROSS JOIN ({_VALUES}) v LEFT JOIN cat c ON c.event_id = e.event_id AND c.category = v.cat
      UNION ALL SELECT e.event_id, e.target, 6 + i, 1.5 * coalesce(r, 0.5) FROM e CROSS JOIN ({_VALUES}) v LEFT JOIN cat c ON c.event_id = e.event_id AND c.category = v.cat
      UNION ALL SELECT e.event_id, e.target, 12 + i, coalesce((c.w > 0)::INT, 0) FROM e CROSS JOIN ({_VALUES}) v LEFT JOIN cat c ON c.event_id = e.event_id AND c.category = v.cat
      UNION ALL SELECT event_id, target, 18, least(1, ln(1 + w / 10.0) / 5) FROM us UNION ALL SELECT event_id, target, 19, p / 10.0 / greatest(1, (p + n) / 10.0) FROM us
      UNION ALL SELECT event_id, target, 20, n / 10.0 / greatest(1, (p + n) / 10.0) FROM us UNION ALL SELECT event_id, target, 21, least(1, ln(1 + k) / 3) FROM us
      UNION ALL SELECT e.event_id, e.target, 22 + s, 0.6 * coalesce(v, 0) FROM e CROSS JOIN range(32) g(s) LEFT JOIN
        (SELECT event_id, {_h('token', 32)} AS slot, sum({_SIGN.format(t='token')} * (aff - 0.5)) AS v FROM tk GROUP BY 1, 2) x ON x.event_id = e.event_id AND x.slot = s)""",
    "WEIGHTED", "TOKENS", extra=TOKEN_STATE + "," + HISTORY + f""",
    e AS (SELECT event_id, user_id, ts_us, target FROM weighted WHERE target IS NOT NULL),
    cat AS (SELECT e.event_id, d.category, {affinity("sum(cd) / 10.0")} AS a, sum(w10) AS w,
              {affinity(f"coalesce(sum(cd) FILTER (WHERE e.ts_us - d.ts_us <= {features.RECENT_US}), 0) / 10.0")} AS r
            FROM e JOIN delta d ON d.user_id = e.user_id AND d.ts_us < e.ts_us GROUP BY 1, 2),
    pc AS (SELECT e.event_id, d.creator_id, sum(w10) AS w, coalesce(sum(w10) FILTER (WHERE d.target = 1), 0) AS p, coalesce(sum(w10) FILTER (WHERE d.target = 0), 0) AS n
           FROM e JOIN weighted d ON d.user_id = e.user_id AND d.ts_us < e.ts_us GROUP BY 1, 2),
    us AS (SELECT e.event_id, any_value(e.target) AS target, coalesce(sum(w), 0) AS w, coalesce(sum(p), 0) AS p, coalesce(sum(n), 0) AS n, count(*) FILTER (WHERE w > 0) AS k
           FROM e LEFT JOIN pc ON pc.event_id = e.event_id GROUP BY 1),
    tk AS (SELECT e.event_id, t.field, t.token, {affinity("sum(td) / 10.0")} AS aff FROM e JOIN tok t ON t.user_id = e.user_id AND t.ts_us < e.ts_us GROUP BY 1, 2, 3 HAVING sum(w10) > 0)""")
