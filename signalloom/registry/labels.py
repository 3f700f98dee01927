"""Row-level signals, labels, weights and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, signals, tokens
from ..operators import profiles
from ..sources import adapter
from .base_sql import affinity, with_ctes


def interaction_signals(spark, d):
    a = signals.annotate(adapter.interactions(spark, d))
    return a.select("event_id", "sig_liked", "sig_shared", "sig_favorited", "sig_commented", "sig_followed", "completed")


def labels_and_deltas(spark, d):
    a = signals.annotate(adapter.interactions(spark, d))
    i = lambda c: c.cast("long")
    return a.select(
        "event_id", i(F.col("target")).alias("target"), i(signals.session_label()).alias("session_label"),
        i(signals.session_delta()).alias("session_delta"), i(F.col("base_delta")).alias("base_delta"),
        signals.hard_seen().alias("hard_seen"), F.col("controlled"),
    )


def grades_and_weights(spark, d):
    rows = adapter.interactions(spark, d)
    return rows.select(
        "event_id", signals.relevance_grade().cast("long").alias("grade"),
        signals.ranking_row_weight().alias("row_weight"), signals.strong_engagement().alias("strong"),
        signals.engagement_strength().alias("strength"),
    )


def replay_weight(spark, d):
    w = profiles.with_replay_weight(adapter.interactions(spark, d))
    return w.select("event_id", F.round(F.col("w10") / 10, 1).alias("replay_weight"))


def effective_interaction_count(spark, d):
    return profiles.effective_interactions(profiles.with_replay_weight(adapter.interactions(spark, d)))


def _labelled_metadata(spark, d):
    a = signals.annotate(adapter.interactions(spark, d)).where(
        F.col("target").isNotNull() & ~F.col("is_training_context_only"))
    return a.withColumns({
        "event_watch_percentage": F.col("watch_percentage"), "event_liked": F.col("sig_liked"),
        "event_shared": F.col("sig_shared"), "event_favorited": F.col("sig_favorited"),
        "event_creator_followed": F.col("sig_followed"),
        "controlled": signals.replay_controlled(with_comment=False),
    })


def training_weights(spark, d):
    """Sample weight times the replay weight numbered over labelled rows only."""
    w = profiles.with_replay_weight(_labelled_metadata(spark, d))
    return w.select(
        "event_id", signals.sample_weight().alias("sample_weight"),
        F.round(F.col("w10") / 10, 1).alias("replay_weight"),
        F.round(signals.sample_weight() * F.col("w10") / 10, 6).alias("fit_weight"),
    )


def per_group_weights(spark, d):
    rows = adapter.interactions(spark, d)
    q = F.concat_ws(":", "user_id", F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd"))
    return rows.select(q.alias("query_id"), signals.ranking_row_weight().alias("w")).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("group_size"), F.round(F.avg("w"), 6).alias("mean_weight"))


def live_target(spark, d):
    r = adapter.interactions(spark, d).where(F.col("content_type") == "LIVE").select(
        "event_id", F.col("event_type").isin("LIVE_JOINED", "LIVE_WATCHED").alias("joined"),
        (F.col("event_type") == "LIVE_LEFT").alias("impression"), "watch_time_seconds", "liked", "shared", "commented",
        (F.col("event_type") == "LIVE_GIFT_SENT").alias("gift_sent"), "creator_followed")
    return r.select("event_id", signals.live_target().cast("long").alias("target"))


def scalar_functions(spark, d):
    c = adapter.table(spark, d, "customer")
    key, bal = F.col("c_custkey"), F.col("c_acctbal")
    born = F.date_add(F.to_date(F.lit("1900-01-01")), (key * 37 % 50000).cast("int"))
    as_of = F.timestamp_micros(F.lit(adapter.SCORING_US))
    age = scalars.age_from_birthday(born, as_of)
    return c.select(
        "c_custkey", scalars.affinity(bal / 100).alias("affinity"),
        scalars.watch_percentage(bal, F.nullif(key % 7, F.lit(0)).cast("double")).alias("watch_pct"),
        age.cast("long").alias("age"), scalars.age_bucket(age).alias("bucket"),
        scalars.normalize_region("c_mktsegment").alias("region"), scalars.safe_region("c_mktsegment").alias("safe_region"),
        scalars.strategy(key % 15).alias("strategy"),
        scalars.sanitize(F.when(key % 3 == 0, F.lit(float("nan"))).when(key % 3 == 1, bal)).alias("clean"),
        F.round(scalars.half_life_decay(bal / 100, 5.0), 6).alias("session_decay"),
        F.round(scalars.half_life_decay(bal / 100, 30.0), 6).alias("rejection_decay"),
    )


def hash_unit_interval(spark, d):
    r = adapter.interactions(spark, d).select("user_id", "content_id").distinct()
    return r.select("user_id", "content_id", F.round(scalars.unit_hash(F.col("user_id"), F.col("content_id")), 9).alias("u"))


def normalize_tokens(spark, d):
    """Tokens of whole URLs and sources of all pages."""
    p = adapter.table(spark, d, "pages")
    arr = tokens.normalize_tokens(F.array(F.concat(F.lit(" #"), "url"), F.col("url"), F.lit("##Tag one!"), F.lit("tag-ONE")))
    return p.select("page_id", F.size(arr).cast("long").alias("n"), F.array_join(arr, "|").alias("tokens"))


def title_tokens(spark, d):
    """Title tokens of every whole document text."""
    t = adapter.table(spark, d, "documents")
    return t.select(
        "doc_id", F.array_join(tokens.title_tokens(F.col("text")), " ").alias("tokens"),
        tokens.title_error(F.col("text")).alias("error"),
        F.length(tokens.normalize_title(F.col("text"))).cast("long").alias("n"))


def token_fields(spark, d):
    c = adapter.contents(spark, d)
    return c.select("content_id", F.inline(tokens.token_fields()))


def legacy_category_projection(spark, d):
    """All contents: five fixed mapping rows of one taxonomy version joined in."""
    mapping = spark.createDataFrame(
        [("v2", "ECONOMY", "TECH"), ("v2", "PROMO", "FASHION"), ("v2", "SMALL", "FOOD"), ("v1", "LARGE", "SPORT"),
         ("v2", "MEDIUM", "MUSIC")], "taxonomy_version string, category string, mapped string")
    c = adapter.contents(spark, d).withColumn("taxonomy_version", F.when(F.col("is_active"), "v2"))
    j = c.join(F.broadcast(mapping), ["taxonomy_version", "category"], "left")
    return j.select("content_id", scalars.legacy_category(F.col("category"), F.col("mapped")).alias("legacy_category"))


QUERIES = {
    "interaction_signals": interaction_signals, "labels_and_deltas": labels_and_deltas,
    "grades_and_weights": grades_and_weights, "replay_weight": replay_weight,
    "effective_interaction_count": effective_interaction_count, "training_weights": training_weights,
    "per_group_weights": per_group_weights, "live_target": live_target, "scalar_functions": scalar_functions,
    "hash_unit_interval": hash_unit_interval, "normalize_tokens": normalize_tokens, "title_tokens": title_tokens,
    "token_fields": token_fields, "legacy_category_projection": legacy_category_projection,
}

_STOP = ("'AND','THE','OF','A','AN','TO','IN','ON','WITH','FOR','AT','BY','IS','IT','AS','OR','FROM','VS','BEST','ROAD',"
         "'FINAL','NEW','TOP','LIVE','HIGHLIGHTS','MOMENTS','GREATEST'")
_NORM = "upper(regexp_replace(regexp_replace(regexp_replace(trim({0}), '^#+', ''), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))"
_ROW_WEIGHT = """CASE WHEN rejected THEN 2.0::DOUBLE WHEN coalesce(watch_percentage, 0) < 20 AND NOT liked THEN 1.0::DOUBLE
   ELSE greatest(1.0::DOUBLE, CASE WHEN coalesce(watch_percentage, 0) >= 90 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END,
                 CASE WHEN liked THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END) END"""
_STRONG = """CASE WHEN event_type IN ('VIDEO_SKIPPED', 'CONTENT_NOT_INTERESTED') THEN FALSE
   WHEN event_type IN ('VIDEO_COMPLETED','VIDEO_REWATCHED','CONTENT_LIKED','CONTENT_SHARED','CONTENT_FAVORITED') THEN TRUE
   ELSE coalesce(watch_percentage, 0) >= 80 END"""

ORACLE = {
    "interaction_signals": with_ctes(
        "SELECT event_id, sig_liked, sig_shared, sig_favorited, sig_commented, sig_followed, completed FROM sig", "SIG"),
    "labels_and_deltas": with_ctes(
        """SELECT event_id, CAST(target AS BIGINT) AS target, CAST(session_label AS BIGINT) AS session_label,
        CAST(session_delta AS BIGINT) AS session_delta, CAST(base_delta AS BIGINT) AS base_delta, NOT rejected AS hard_seen,
        controlled FROM sig""", "SIG"),
    "grades_and_weights": with_ctes(
        f"""SELECT event_id,
        CAST(CASE WHEN rejected THEN 0 WHEN coalesce(watch_percentage, 0) < 20 AND NOT liked THEN 0
             WHEN liked OR coalesce(watch_percentage, 0) >= 90 THEN 3 WHEN coalesce(watch_percentage, 0) >= 70 THEN 2
             ELSE 1 END AS BIGINT) AS grade,
        {_ROW_WEIGHT} AS row_weight, {_STRONG} AS strong,
        CASE WHEN NOT ({_STRONG}) THEN 0.0::DOUBLE WHEN event_type = 'CONTENT_SHARED' THEN 1.0::DOUBLE
             WHEN event_type IN ('VIDEO_COMPLETED', 'VIDEO_REWATCHED') THEN 0.85::DOUBLE
             WHEN event_type = 'CONTENT_LIKED' THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS strength FROM sig""", "SIG"),
    "replay_weight": with_ctes("SELECT event_id, w10 / 10.0::DOUBLE AS replay_weight FROM weighted", "WEIGHTED"),
    "effective_interaction_count": with_ctes(
        "SELECT user_id, sum(w10) / 10.0::DOUBLE AS effective_interactions FROM weighted GROUP BY user_id", "WEIGHTED"),
    "training_weights": with_ctes(
        """SELECT event_id, sample_weight, w10 / 10.0::DOUBLE AS replay_weight,
             round(sample_weight * w10 / 10.0::DOUBLE, 6) AS fit_weight
        FROM (SELECT *, CASE WHEN NOT ctl THEN 10 ELSE CASE occ WHEN 1 THEN 10 WHEN 2 THEN 10 WHEN 3 THEN 6 WHEN 4 THEN 3
                     WHEN 5 THEN 1 ELSE 0 END END AS w10 FROM numbered)""", "SIG", extra="""
        labelled AS (SELECT *, (event_type IN ('VIDEO_IMPRESSION','VIDEO_STARTED','VIDEO_WATCHED','VIDEO_COMPLETED',
             'VIDEO_REWATCHED','VIDEO_SKIPPED') AND NOT (sig_liked OR sig_shared OR sig_favorited OR sig_followed)) AS ctl,
             CASE WHEN target = 0 THEN CASE WHEN rejected THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END
                  ELSE greatest(CASE WHEN completed THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END,
                       CASE WHEN sig_liked THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END,
                       CASE WHEN sig_shared OR sig_favorited THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END,
                       CASE WHEN sig_followed THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END) END AS sample_weight
             FROM sig WHERE target IS NOT NULL AND NOT is_training_context_only),
        numbered AS (SELECT *, sum(ctl::INT) OVER (PARTITION BY user_id, content_id ORDER BY ts_us, event_id
             ROWS UNBOUNDED PRECEDING) AS occ FROM labelled)"""),
    "per_group_weights": with_ctes(
        f"""SELECT user_id || ':' || strftime(make_timestamp(ts_us), '%Y-%m-%d') AS query_id, count(*) AS group_size,
        round(avg({_ROW_WEIGHT}), 6) AS mean_weight FROM sig GROUP BY 1""", "SIG"),
    "live_target": with_ctes(
        """SELECT event_id, CAST(CASE
          WHEN (event_type IN ('LIVE_JOINED','LIVE_WATCHED') AND coalesce(watch_time_seconds, 0) >= 60)
               OR liked OR shared OR commented OR event_type = 'LIVE_GIFT_SENT' OR creator_followed THEN 1
          WHEN event_type = 'LIVE_LEFT' OR (event_type IN ('LIVE_JOINED','LIVE_WATCHED') AND coalesce(watch_time_seconds, 0) < 10) THEN 0
        END AS BIGINT) AS target FROM interactions WHERE content_type = 'LIVE'""", "INTERACTIONS"),
    "scalar_functions": f"""
        WITH x AS (SELECT *, DATE '1900-01-01' + CAST(c_custkey * 37 % 50000 AS INT) AS born FROM customer),
        y AS (SELECT *, CASE WHEN born <= DATE '2024-02-01' AND date_sub('year', born, DATE '2024-02-01') BETWEEN 0 AND 120
                   THEN date_sub('year', born, DATE '2024-02-01') END AS age FROM x)
        SELECT c_custkey, {affinity('c_acctbal / 100')} AS affinity,
          CASE WHEN c_custkey % 7 <> 0 THEN round(c_acctbal / (c_custkey % 7) * 100, 4) END AS watch_pct,
          CAST(age AS BIGINT) AS age,
          CASE WHEN age < 13 THEN NULL WHEN age <= 17 THEN '13-17' WHEN age <= 24 THEN '18-24' WHEN age <= 34 THEN '25-34'
               WHEN age <= 44 THEN '35-44' WHEN age <= 54 THEN '45-54' WHEN age <= 64 THEN '55-64' WHEN age >= 65 THEN '65+' END AS bucket,
          upper(trim(c_mktsegment)) AS region,
          CASE WHEN length(trim(c_mktsegment)) <= 8 THEN upper(trim(c_mktsegment)) END AS safe_region,
          CASE WHEN c_custkey % 15 = 0 THEN 'COLD_START' WHEN c_custkey % 15 < 10 THEN 'HYBRID' ELSE 'PERSONALISED_ML' END AS strategy,
          CASE WHEN c_custkey % 3 = 1 THEN c_acctbal ELSE 0.0::DOUBLE END AS clean,
          round(exp(-ln(2.0) / 5 * greatest(c_acctbal / 100, 0)), 6) AS session_decay,
          round(exp(-ln(2.0) / 30 * greatest(c_acctbal / 100, 0)), 6) AS rejection_decay FROM y""",
    "hash_unit_interval": with_ctes(
        """SELECT DISTINCT user_id, content_id,
        round(CAST(('0x' || substr(sha256(user_id || '|' || content_id), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0::DOUBLE, 9) AS u
        FROM interactions""", "INTERACTIONS"),
    "normalize_tokens": f"""
        WITH x AS (SELECT page_id, [{_NORM.format("' #' || url")}, {_NORM.format("url")}, 'TAG_ONE'] AS a FROM pages)
        SELECT page_id, CAST(2 AS BIGINT) AS n, a[1] || '|' || a[3] AS tokens FROM x""",
    "title_tokens": f"""
        WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9]+')) AS word,
                     generate_subscripts(regexp_split_to_array(text, '[^A-Za-z0-9]+'), 1) AS i FROM documents),
        u AS (SELECT doc_id, substr(upper(word), 1, 40) AS tok, min(i) AS i FROM w
              WHERE word <> '' AND upper(word) NOT IN ({_STOP}) GROUP BY 1, 2),
        k AS (SELECT doc_id, string_agg(tok, ' ' ORDER BY i) AS tokens FROM
              (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM u) WHERE rn <= 8 GROUP BY doc_id)
        SELECT d.doc_id, coalesce(tokens, '') AS tokens,
          CASE WHEN length(trim(text, E' \\t\\n\\r\\f\\v')) > 200 THEN 'TITLE_TOO_LONG' END AS error,
          nullif(length(trim(text, E' \\t\\n\\r\\f\\v')), 0) AS n
        FROM documents d LEFT JOIN k USING (doc_id)""",
    "token_fields": with_ctes("SELECT content_id, field, CAST(pos AS INT) AS pos, token FROM content_tokens", "TOKENS"),
    "legacy_category_projection": with_ctes(
        """SELECT content_id, CASE WHEN is_active THEN CASE category WHEN 'ECONOMY' THEN 'TECH' WHEN 'PROMO' THEN 'FASHION'
          WHEN 'SMALL' THEN 'FOOD' WHEN 'MEDIUM' THEN 'MUSIC' ELSE 'UNKNOWN' END ELSE 'UNKNOWN' END AS legacy_category
        FROM contents""", "CONTENTS"),
}
