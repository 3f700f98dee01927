"""Social and collaborative queries. Follow edges and pools derive from all orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import social
from ..sources import adapter
from .base_sql import with_ctes


def _edges(spark, d):
    o = adapter.table(spark, d, "orders")
    return o.where(F.col("o_orderstatus") == "P").select(
        (F.col("o_custkey") % 150).cast("string").alias("user_id"), (F.col("o_orderkey") % 150).cast("string").alias("target_id")).distinct()


def _pool(spark, d):
    o = adapter.table(spark, d, "orders")
    p = o.select((F.col("o_custkey") % 150).cast("string").alias("user_id"), ((F.col("o_orderkey") * 7) % 150).cast("string").alias("other_id"))
    return p.where("user_id <> other_id").distinct()


def relationship_strength(spark, d):
    return social.relations(_edges(spark, d))


def interest_cosine(spark, d):
    v = social.interest_vectors(adapter.interactions(spark, d))
    return social.pair_cosine(_pool(spark, d), v).withColumn("similarity", F.round("similarity", 9))


def _social(spark, d):
    rows = adapter.interactions(spark, d)
    return social.social_candidates(_edges(spark, d), rows, adapter.contents(spark, d), social.interest_vectors(rows))


def _collab(spark, d):
    rows = adapter.interactions(spark, d)
    return social.collaborative_candidates(_pool(spark, d), _edges(spark, d), rows, adapter.contents(spark, d), social.interest_vectors(rows))


_COLS = ["user_id", "content_id", "source", "source_user_id", "strength", "engagement", "mutual"]


def social_candidates(spark, d):
    return _social(spark, d).select(*_COLS, F.round("similarity", 9).alias("similarity"))


def collaborative_candidates(spark, d):
    return _collab(spark, d).select(*_COLS, F.round("similarity", 9).alias("similarity"))


def generate_candidates(spark, d):
    g = social.generate(_social(spark, d), _collab(spark, d), 30)
    return g.select(*_COLS, F.round("similarity", 9).alias("similarity"))


def social_payload(spark, d):
    p = social.to_payload(social.generate(_social(spark, d), _collab(spark, d)), adapter.contents(spark, d))
    return p.select("user_id", "contentId", "creatorId", "candidateSource", "contentAgeHours", F.to_json("socialContext").alias("socialContext"))


QUERIES = {
    "relationship_strength": relationship_strength, "interest_cosine": interest_cosine, "social_candidates": social_candidates,
    "collaborative_candidates": collaborative_candidates, "generate_candidates": generate_candidates, "social_payload": social_payload,
}

_STRENGTH = """CASE event_type WHEN 'CONTENT_SHARED' THEN 1.0::DOUBLE WHEN 'VIDEO_COMPLETED' THEN 0.85::DOUBLE WHEN 'CONTENT_LIKED' THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END"""
_SOCIAL = f"""
edges AS (SELECT DISTINCT CAST(o_custkey % 150 AS VARCHAR) AS u, CAST(o_orderkey % 150 AS VARCHAR) AS t FROM orders WHERE o_orderstatus = 'P'),
rel AS (SELECT user_id, other_id, bool_or(f) AS follows_target, bool_or(NOT f) AS followed_by_target,
    CASE WHEN bool_or(f) AND bool_or(NOT f) THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS strength, bool_or(f) AND bool_or(NOT f) AS mutual
  FROM (SELECT u AS user_id, t AS other_id, TRUE AS f FROM edges UNION ALL SELECT t, u, FALSE FROM edges) WHERE user_id <> other_id GROUP BY 1, 2),
pool AS (SELECT DISTINCT CAST(o_custkey % 150 AS VARCHAR) AS user_id, CAST((o_orderkey * 7) % 150 AS VARCHAR) AS other_id FROM orders
  WHERE o_custkey % 150 <> (o_orderkey * 7) % 150),
vec AS (SELECT user_id, category AS key, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS w FROM interactions GROUP BY 1, 2),
nrm AS (SELECT user_id, sqrt(sum(w * w)) AS nrm FROM vec GROUP BY 1),
cosine AS (SELECT p.user_id, p.other_id, coalesce(least(1, sum(a.w * b.w) / any_value(x.nrm) / any_value(y.nrm)), 0) AS similarity
  FROM (SELECT user_id, other_id FROM pool UNION SELECT user_id, other_id FROM rel) p LEFT JOIN nrm x ON x.user_id = p.user_id LEFT JOIN nrm y ON y.user_id = p.other_id
  LEFT JOIN vec a ON a.user_id = p.user_id LEFT JOIN vec b ON b.user_id = p.other_id AND b.key = a.key GROUP BY 1, 2),
ev AS (SELECT user_id AS other_id, content_id, {_STRENGTH} AS engagement, e FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_us DESC, id DESC) AS e FROM interactions)
  WHERE e <= 20 AND event_type NOT IN ('VIDEO_SKIPPED', 'CONTENT_NOT_INTERESTED')
    AND (event_type IN ('VIDEO_COMPLETED', 'CONTENT_LIKED', 'CONTENT_SHARED') OR coalesce(watch_percentage, 0) >= 80)),
seen AS (SELECT DISTINCT user_id, content_id FROM interactions WHERE event_type NOT IN ('CONTENT_NOT_INTERESTED', 'LIVE_NOT_INTERESTED')),
srel AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strength DESC, other_id) AS p FROM rel),
spool AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY other_id) AS p FROM pool),
cand AS (SELECT r.user_id, content_id, 'SOCIAL' AS source, r.other_id AS source_user_id, similarity, strength, engagement, mutual, p * 1000 + e AS position
    FROM srel r JOIN ev USING (other_id) JOIN cosine USING (user_id, other_id) WHERE p <= 5
  UNION ALL SELECT r.user_id, content_id, 'COLLABORATIVE', r.other_id, similarity, 0.0::DOUBLE, engagement, FALSE, p * 1000 + e
    FROM spool r JOIN ev USING (other_id) JOIN cosine USING (user_id, other_id) WHERE p <= 5 AND similarity >= 0.5
      AND NOT EXISTS (SELECT 1 FROM rel WHERE rel.user_id = r.user_id AND rel.other_id = r.other_id)),
open_cand AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = c.user_id AND s.content_id = c.content_id)),
merged AS (SELECT * FROM (SELECT *, min(position) OVER (PARTITION BY user_id, content_id, source) AS fp,
      row_number() OVER (PARTITION BY user_id, content_id, source ORDER BY strength + similarity DESC, position) AS rn FROM open_cand) WHERE rn = 1),
lim AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY user_id, source ORDER BY fp) <= 20),
gen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, content_id ORDER BY source DESC) AS r2 FROM lim) WHERE r2 = 1
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY strength + similarity + engagement DESC, source DESC, fp) <= 30)"""
_S = "user_id, content_id, source, source_user_id, strength, engagement, mutual, round(similarity, 9) AS similarity"
ORACLE = {
    "relationship_strength": with_ctes("SELECT * FROM rel", "INTERACTIONS", extra=_SOCIAL),
    "interest_cosine": with_ctes("SELECT user_id, other_id, round(similarity, 9) AS similarity FROM pool JOIN cosine USING (user_id, other_id)", "INTERACTIONS", extra=_SOCIAL),
    "social_candidates": with_ctes(f"SELECT {_S} FROM lim WHERE source = 'SOCIAL'", "INTERACTIONS", extra=_SOCIAL),
    "collaborative_candidates": with_ctes(f"SELECT {_S} FROM lim WHERE source = 'COLLABORATIVE'", "INTERACTIONS", extra=_SOCIAL),
    "generate_candidates": with_ctes(f"SELECT {_S} FROM gen", "INTERACTIONS", extra=_SOCIAL),
}
