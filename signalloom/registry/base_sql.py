"""Shared CTEs of the oracle queries: the adapter of ``sources.adapter`` in SQL."""

CONTENTS = """
contents AS (
  SELECT CAST(p_partkey AS VARCHAR) AS content_id, p_brand AS creator_id, upper(p_type) AS category,
         CASE WHEN p_partkey % 5 = 4 THEN 'LIVE' ELSE 'VIDEO' END AS content_type,
         p_size % 10 <> 0 AS is_active,
         CAST((p_partkey * 37) % 100 AS DOUBLE) / 100 AS popularity_score,
         CAST(p_size AS BIGINT) * 86400000000 + 1701388800000000 AS created_us,
         p_name AS title,
         upper(p_type) AS topic, replace(upper(p_brand), '#', '_') AS entity
  FROM part)"""

RAW = """
raw_interactions AS (
  SELECT CAST(e.event_id AS VARCHAR) AS event_id, CAST(e.user_id AS VARCHAR) AS user_id,
         c.content_id, c.creator_id, c.category, c.content_type,
         CASE WHEN c.content_type = 'VIDEO' THEN
                CASE e.event_type
                  WHEN 'view' THEN CASE WHEN e.value < 20 THEN 'VIDEO_SKIPPED' WHEN e.value >= 90 THEN 'VIDEO_COMPLETED'
                                        ELSE 'VIDEO_WATCHED' END
                  WHEN 'click' THEN 'CONTENT_LIKED' WHEN 'purchase' THEN 'CONTENT_SHARED'
                  WHEN 'signup' THEN 'CREATOR_FOLLOWED' ELSE 'CONTENT_NOT_INTERESTED' END
              ELSE CASE e.event_type WHEN 'view' THEN 'LIVE_WATCHED' WHEN 'click' THEN 'LIVE_JOINED'
                WHEN 'purchase' THEN 'LIVE_GIFT_SENT' WHEN 'signup' THEN 'LIVE_LEFT' ELSE 'LIVE_NOT_INTERESTED' END
         END AS event_type,
         CASE WHEN e.event_type = 'view' THEN e.value END AS watch_time_seconds,
         CASE WHEN e.event_type = 'view' AND c.content_type = 'VIDEO' THEN 100.0::DOUBLE END AS content_duration_seconds,
         CASE WHEN e.event_type = 'view' AND c.content_type = 'VIDEO'
              THEN round(LEAST(e.value, 100.0::DOUBLE), 4) END AS watch_percentage,
         (e.event_type = 'view' AND e.value >= 150) AS liked, FALSE AS shared, FALSE AS favorited,
         (e.event_type = 'view' AND e.value BETWEEN 100 AND 110) AS commented, FALSE AS creator_followed,
         epoch_us(e.ts) AS ts_us, e.event_id AS id,
         e.value BETWEEN 45 AND 50 AS is_training_context_only, e.value > 300 AS content_pending
  FROM events e JOIN contents c ON c.content_id = json_extract_string(e.props, '$.k'))"""

INTERACTIONS = """
interactions AS (SELECT * FROM raw_interactions WHERE NOT content_pending)"""

# Signals, label and the replay-control flag of every evidence row.
SIG = """
sig0 AS (
  SELECT *, (liked OR event_type = 'CONTENT_LIKED') AS sig_liked,
         (shared OR event_type = 'CONTENT_SHARED') AS sig_shared,
         (favorited OR event_type = 'CONTENT_FAVORITED') AS sig_favorited,
         (commented OR event_type = 'CONTENT_COMMENTED') AS sig_commented,
         (creator_followed OR event_type = 'CREATOR_FOLLOWED') AS sig_followed,
         (event_type = 'VIDEO_COMPLETED' OR coalesce(watch_percentage, 0) >= 90) AS completed,
         event_type IN ('CONTENT_NOT_INTERESTED', 'LIVE_NOT_INTERESTED') AS rejected,
         (event_type = 'VIDEO_SKIPPED' AND coalesce(watch_percentage, 0) < 20) AS fast_skipped
  FROM interactions),
sig AS (
  SELECT *,
         CASE WHEN rejected THEN 0
              WHEN coalesce(watch_percentage >= 70, FALSE) OR event_type = 'VIDEO_COMPLETED'
                   OR sig_liked OR sig_shared OR sig_favorited OR sig_followed THEN 1
              WHEN watch_percentage < 20 THEN 0 END AS target,
         CASE WHEN rejected THEN 0
              WHEN coalesce(watch_percentage >= 70, FALSE) OR sig_liked OR sig_shared THEN 1
              WHEN watch_percentage < 20 THEN 0 END AS session_label,
         CASE WHEN rejected THEN -6
              ELSE 4*completed::INT + 3*sig_liked::INT + 5*sig_shared::INT - 4*coalesce(watch_percentage < 20, FALSE)::INT
         END AS session_delta,
         4*completed::INT + 3*sig_liked::INT + 5*sig_shared::INT + 5*sig_favorited::INT + 2*sig_commented::INT
           + 6*sig_followed::INT + 4*(event_type = 'VIDEO_REWATCHED')::INT - 4*fast_skipped::INT AS base_delta,
         (event_type IN ('VIDEO_IMPRESSION','VIDEO_STARTED','VIDEO_WATCHED','VIDEO_COMPLETED','VIDEO_REWATCHED','VIDEO_SKIPPED')
           AND NOT (sig_liked OR sig_shared OR sig_favorited OR sig_commented OR sig_followed)) AS controlled
  FROM sig0)"""

# Influence of every row in tenths: the n-th controlled row of one (user, content).
WEIGHTED = """
weighted AS (
  SELECT *, CASE WHEN NOT controlled THEN 10
                 ELSE CASE occurrence WHEN 1 THEN 10 WHEN 2 THEN 10 WHEN 3 THEN 6 WHEN 4 THEN 3 WHEN 5 THEN 1 ELSE 0 END
            END AS w10
  FROM (SELECT *, sum(controlled::INT) OVER (PARTITION BY user_id, content_id ORDER BY ts_us, event_id
                                             ROWS UNBOUNDED PRECEDING) AS occurrence FROM sig))"""

# Ordered tokens of every content: (content_id, field, pos, token).
TOKENS = """
content_tokens AS (
  SELECT content_id, 'hashtag' AS field, CAST(min(i) AS INT) AS pos, tok AS token
  FROM (SELECT content_id, unnest(string_split(upper(title), ' ')) AS tok,
               generate_subscripts(string_split(upper(title), ' '), 1) - 1 AS i FROM contents) GROUP BY content_id, tok
  UNION ALL SELECT content_id, 'topic', 1000, topic FROM contents
  UNION ALL SELECT content_id, 'entity', 2000, entity FROM contents
  UNION ALL
  SELECT content_id, 'title', CAST(3999 + row_number() OVER (PARTITION BY content_id ORDER BY min(i)) AS INT), tok
  FROM (SELECT content_id, unnest(string_split(upper(title), ' ')) AS tok,
               generate_subscripts(string_split(upper(title), ' '), 1) - 1 AS i FROM contents)
  WHERE tok NOT IN ('AND','THE','OF','A','AN','TO','IN','ON','WITH','FOR','AT','BY','IS','IT','AS','OR','FROM','VS',
                    'BEST','ROAD','FINAL','NEW','TOP','LIVE','HIGHLIGHTS','MOMENTS','GREATEST')
  GROUP BY content_id, tok)"""

DEMOGRAPHICS = """
demographics AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id, CASE WHEN length(r_name) <= 8 THEN upper(trim(r_name)) END AS region,
         CAST(10 + (c_custkey * 7) % 65 AS INT) AS age,
         CASE WHEN age < 13 THEN NULL WHEN age <= 17 THEN '13-17' WHEN age <= 24 THEN '18-24' WHEN age <= 34 THEN '25-34'
              WHEN age <= 44 THEN '35-44' WHEN age <= 54 THEN '45-54' WHEN age <= 64 THEN '55-64' ELSE '65+' END AS age_bucket
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

SCORED = """
scored AS (
  SELECT l_orderkey AS group_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
         CAST(l_returnflag = 'R' AS INT) AS y, round(l_discount * 10, 6) AS p, round(l_tax * 10, 6) AS p_alt,
         epoch_us(l_shipdate) AS ts_us, CAST(l_partkey AS VARCHAR) AS content_id, CAST(l_suppkey AS VARCHAR) AS creator_id,
         l_linestatus AS category, l_extendedprice AS price, l_quantity AS quantity
  FROM lineitem)"""

LIVE_LOG = """
live_log AS (
  SELECT CAST(e.event_id AS VARCHAR) AS event_id, CAST(e.user_id AS VARCHAR) AS user_id, 'stream-' || c.category AS content_id,
    c.creator_id, c.category,
    CASE e.event_type WHEN 'view' THEN CASE WHEN e.value >= 60 THEN 'LIVE_LIKED' ELSE 'LIVE_WATCHED' END
      WHEN 'click' THEN 'LIVE_JOINED' WHEN 'signup' THEN 'LIVE_LEFT'
      WHEN 'purchase' THEN CASE WHEN e.value >= 100 THEN 'LIVE_GIFT_SENT' ELSE 'LIVE_IMPRESSION' END
      ELSE CASE WHEN e.value >= 100 THEN 'LIVE_NOT_INTERESTED' ELSE 'LIVE_IMPRESSION' END END AS event_type,
    CASE WHEN e.event_type = 'view' OR (e.event_type = 'signup' AND e.value < 20) THEN e.value END AS watch_time_seconds,
    FALSE AS liked, FALSE AS shared, (e.event_type = 'purchase' AND e.value BETWEEN 50 AND 60) AS commented,
    (e.event_type = 'click' AND e.value >= 150) AS creator_followed, epoch_us(e.ts) AS ts_us, e.event_id AS id
  FROM events e JOIN contents c ON c.content_id = json_extract_string(e.props, '$.k'))"""

_NEEDS = {
    "CONTENTS": (), "RAW": ("CONTENTS",), "INTERACTIONS": ("RAW",), "SIG": ("INTERACTIONS",), "WEIGHTED": ("SIG",),
    "TOKENS": ("CONTENTS",), "DEMOGRAPHICS": (), "SCORED": (), "LIVE_LOG": ("CONTENTS",),
}


def affinity(raw: str) -> str:
    return f"round(1 / (1 + exp(-({raw}) / 10.0)), 6)"


def with_ctes(body: str, *names: str, extra: str = "") -> str:
    """``body`` behind the named shared CTEs (with what they need) and ``extra`` ones."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS[name]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [globals()[n].strip() for n in ordered] + ([extra.strip()] if extra else [])
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
