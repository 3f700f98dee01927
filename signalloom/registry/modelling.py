"""Training, scoring and end-to-end queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adaptation, features, live, profiles, quality, training
from ..plans import recommend as plan
from ..session import cut_lineage
from ..sources import adapter
from .base_sql import with_ctes
from .quality import _records
from .retrieval import CATEGORIES

NOW = adapter.DECISION_US
WEIGHTS = {"category_affinity": 2.0, "recent_category_affinity": 1.0, "creator_completion_rate": 0.8, "average_semantic_affinity": 1.5, "content_popularity_score": 1.2,
           "already_seen": -0.3, "session_category_affinity": 0.7}
LIVE_WEIGHTS = {"live_category_affinity": 1.5, "creator_affinity": 1.0, "viewer_growth_rate": 0.2}
GROUPS = {"category": ["category_affinity", "recent_category_affinity"], "semantic": ["average_semantic_affinity", "strongest_semantic_affinity"], "content": ["content_popularity_score", "content_age_hours"]}


def _dataset(spark, d):
    return features.training_dataset(adapter.interactions(spark, d).where(F.col("content_type") != "LIVE"), adapter.contents(spark, d))


def train_and_select(spark, d):
    """Test metrics of the selected, calibrated model next to the baselines."""
    r = training.train_and_select(_dataset(spark, d), trees=20, rounds=20)
    cols = ["accuracy", "f1", "roc_auc", "average_precision", "ndcg_at_10", "precision_at_5", "mrr"]
    own = r.test_metrics.select(F.lit(r.winner.name).alias("model"), *[F.round(c, 6).alias(c) for c in cols])
    return own.unionByName(r.baselines.select(F.col("baseline").alias("model"), *[F.round(c, 6).alias(c) for c in cols]))


def train_candidates(spark, d):
    """Scores of every fitted algorithm on its own training rows."""
    rows = cut_lineage(_dataset(spark, d))
    fitted = training.train_candidates(rows, features.NUMERIC, features.CATEGORICAL)
    out = None
    for name, s in fitted.items():
        one = s.score(rows).groupBy("target").agg(F.round(F.avg("model_score"), 6).alias("mean_score"), F.count(F.lit(1)).alias("rows")).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def train_live(spark, d):
    scorer, comparison = training.train_live(live.live_dataset(adapter.live_log(spark, d), grace_us=12 * 3_600_000_000), trees=20)
    return comparison.withColumn("selected", F.col("model") == scorer.name)


def permutation_importance(spark, d):
    rows = cut_lineage(_dataset(spark, d))
    s = training.train_candidates(rows, features.NUMERIC, features.CATEGORICAL, names=["LogisticRegression"])["LogisticRegression"]
    return training.permutation_importance(s, rows, features.FEATURES)


def feature_group_ablation(spark, d):
    """Each labelled row against the same row with its user's average features."""
    rows = cut_lineage(_dataset(spark, d))
    s = training.train_candidates(rows, features.NUMERIC, features.CATEGORICAL, names=["LogisticRegression"])["LogisticRegression"]
    means = rows.groupBy("user_id").agg(*[F.avg(c).alias(c) for c in features.NUMERIC])
    right = rows.select("event_id", "user_id", "category").join(means, "user_id")
    a = training.group_ablation(s, rows, right, GROUPS, "event_id")
    return a.groupBy("group").agg(F.round(F.avg("share"), 6).alias("mean_share"), F.count(F.lit(1)).alias("rows"))


def _text_frame(spark, d):
    r = _records(spark, d).where("primaryCategory is not null")
    return r.select(F.col("exampleId").alias("content_id"), quality.feature_text().alias("text"), F.col("primaryCategory").alias("category"))


def text_classifier(spark, d):
    """Categories of all documents by a classifier fitted on the labelled ones, with the source as creator prior."""
    model, _ = training.text_classifier(_text_frame(spark, d).select("text", "category"))
    docs = _records(spark, d)
    probs = training.class_probabilities(model, docs.select(F.col("doc_id").cast("string").alias("content_id"), quality.feature_text().alias("text")), "content_id")
    items = docs.select(F.col("doc_id").cast("string").alias("content_id"), F.element_at("topics", 1).alias("creator_id"))
    counts = docs.where("primaryCategory is not null").groupBy(F.element_at("topics", 1).alias("creator_id"), F.col("primaryCategory").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return training.combine_with_creator_prior(probs, items, counts)


def classify_with_creator_prior(spark, d):
    """Fixed-rule probabilities over all parts joined with their creators' real history."""
    p = adapter.table(spark, d, "part")
    probs = p.select(F.col("p_partkey").cast("string").alias("content_id"), F.explode(F.create_map(
        F.lit("ECONOMY"), (F.col("p_partkey") % 89) / 100, F.lit("PROMO"), (F.col("p_partkey") % 53) / 100, F.lit("OTHER"), F.lit(0.05))).alias("category", "p"))
    c = adapter.contents(spark, d)
    return training.combine_with_creator_prior(probs, c.select("content_id", "creator_id"), profiles.creator_category_counts(c)).withColumn("confidence", F.round("confidence", 9))


def ranker_score_normalize(spark, d):
    li = adapter.scored_rows(spark, d).select("row_id", "category", (F.col("price") / 100 - 300).alias("raw"))
    return training.normalize_ranker_scores(li, li.where(F.col("category") == "O")).select("row_id", F.round("normalized", 9).alias("normalized"))


def score_candidates(spark, d):
    """A fitted model's scores for every touched (user, content) pair at the decision moment."""
    rows, contents = adapter.interactions(spark, d), adapter.contents(spark, d)
    s = training.train_candidates(cut_lineage(_dataset(spark, d)), features.NUMERIC, features.CATEGORICAL, names=["LogisticRegression"])["LogisticRegression"]
    f = features.score_time_features(rows, rows.select("user_id", "content_id", "creator_id", "category").distinct(), contents, NOW)
    return s.score(f).select("user_id", "content_id", F.round("model_score", 6).alias("model_score"))


def recommend(spark, d):
    return plan.recommend(adapter.interactions(spark, d), adapter.contents(spark, d), NOW, plan.column_score(training.linear_score(WEIGHTS, -3.0)), limit=10, pool=30,
                          session_us=86_400_000_000)


def recommend_live(spark, d):
    return plan.recommend_live(adapter.interactions(spark, d), adapter.contents(spark, d), NOW, plan.column_score(training.linear_score(LIVE_WEIGHTS, -1.0)), limit=10, pool=40,
                               stale_us=86_400_000_000, window_us=4 * 86_400_000_000)


def retrieve_then_rank(spark, d):
    return plan.retrieve_then_rank(adapter.interactions(spark, d), adapter.contents(spark, d), CATEGORIES, NOW, plan.column_score(training.linear_score(WEIGHTS, -3.0)))


def adaptation_latency(spark, d):
    """Per user: from its most frequent category before the decision moment to the one after it."""
    rows = adapter.interactions(spark, d)

    def favourite(part, name):
        n = part.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("user_id").agg(F.max_by("category", F.struct("n", "category")).alias(name))

    sw = favourite(rows.where(F.col("ts_us") < NOW), "previous_category").join(favourite(rows.where(F.col("ts_us") >= NOW), "new_category"), "user_id")
    sw = sw.where("previous_category <> new_category").withColumn("from_us", F.lit(NOW).cast("long"))
    return adaptation.adaptation_latency(adaptation.adaptation_trace(rows, adapter.contents(spark, d), sw))


QUERIES = {
    "train_candidates": train_candidates, "train_and_select": train_and_select, "train_live": train_live, "permutation_importance": permutation_importance,
    "feature_group_ablation": feature_group_ablation, "text_classifier": text_classifier, "classify_with_creator_prior": classify_with_creator_prior,
    "ranker_score_normalize": ranker_score_normalize, "score_candidates": score_candidates, "recommend": recommend, "recommend_live": recommend_live,
    "retrieve_then_rank": retrieve_then_rank, "adaptation_latency": adaptation_latency,
}

ORACLE = {
    "ranker_score_normalize": with_ctes("""
        SELECT row_id, round(1 / (1 + exp(-greatest(-60, least(60, (price / 100 - 300) / (SELECT stddev_pop(price / 100 - 300) FROM scored WHERE category = 'O'))))), 9) AS normalized FROM scored""", "SCORED"),
    "classify_with_creator_prior": with_ctes("""
        SELECT content_id,
          CASE WHEN tp >= 0.7 THEN tcat WHEN bp >= 0.35 THEN bcat ELSE 'UNKNOWN' END AS category, round(CASE WHEN tp >= 0.7 THEN tp ELSE bp END, 9) AS confidence,
          CASE WHEN tp >= 0.7 THEN 'MODEL' WHEN bp >= 0.35 THEN 'MODEL_WITH_CREATOR_PRIOR' ELSE 'UNKNOWN' END AS source
        FROM (SELECT content_id, max(p) AS tp, first(category ORDER BY p DESC, category) AS tcat FROM probs GROUP BY 1) JOIN
          (SELECT content_id, max(b) AS bp, first(category ORDER BY b DESC, category) AS bcat FROM (SELECT coalesce(p.content_id, s.content_id) AS content_id, coalesce(p.category, s.category) AS category,
             0.7 * coalesce(p, 0) + 0.3 * coalesce(s, 0) AS b FROM probs p FULL JOIN prior s ON s.content_id = p.content_id AND s.category = p.category) GROUP BY 1) USING (content_id)""", "CONTENTS", extra="""
        probs AS (SELECT content_id, 'ECONOMY' AS category, (CAST(content_id AS INT) % 89) / 100 AS p FROM contents UNION ALL
          SELECT content_id, 'PROMO', (CAST(content_id AS INT) % 53) / 100 FROM contents UNION ALL SELECT content_id, 'OTHER', 0.05 FROM contents),
        newest AS (SELECT *, row_number() OVER (PARTITION BY creator_id ORDER BY created_us DESC, content_id) AS pos FROM contents WHERE content_type = 'VIDEO'),
        counts AS (SELECT creator_id, category, count(*) AS n, sum(count(*)) OVER (PARTITION BY creator_id) AS total FROM newest WHERE pos <= 50 GROUP BY 1, 2),
        prior AS (SELECT content_id, k.category, n / total AS s FROM contents c JOIN counts k ON k.creator_id = c.creator_id)"""),
}
