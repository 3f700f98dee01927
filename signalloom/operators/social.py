"""Candidates from followed and similar users. Pairs come from edges or a given pool, never from all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import signals
from .running import top_n

MAX_RELATED = 5
MAX_POOL = 5
MAX_EVENTS = 20
MAX_CANDIDATES = 20
MIN_SIMILARITY = 0.5


def relationship_strength(follows: Column, followed: Column) -> Column:
    return F.when(follows & followed, 0.9).when(follows | followed, 0.5).otherwise(0.0)


def relations(edges: DataFrame) -> DataFrame:
    """(user_id, other_id) pairs of a directed follow table with direction flags and strength."""
    both = edges.select("user_id", F.col("target_id").alias("other_id"), F.lit(1).alias("f"), F.lit(0).alias("b")).unionByName(
        edges.select(F.col("target_id").alias("user_id"), F.col("user_id").alias("other_id"), F.lit(0).alias("f"), F.lit(1).alias("b")))
    g = both.where("user_id <> other_id").groupBy("user_id", "other_id").agg(
        (F.max("f") == 1).alias("follows_target"), (F.max("b") == 1).alias("followed_by_target"))
    return g.withColumns({
        "strength": relationship_strength(F.col("follows_target"), F.col("followed_by_target")),
        "mutual": F.col("follows_target") & F.col("followed_by_target")})


def interest_vectors(rows: DataFrame) -> DataFrame:
    """Long-form interest vector: a user's share of interactions per category."""
    n = rows.groupBy("user_id", F.col("category").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("user_id").agg(F.sum("n").alias("t"))
    return n.join(total, "user_id").select("user_id", "key", (F.col("n") / F.col("t")).alias("weight"))


def pair_cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of the sparse vectors of each (user_id, other_id), in [0, 1], 0 without a norm."""
    norms = vectors.groupBy("user_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    v = vectors.select(F.col("user_id").alias("other_id"), "key", F.col("weight").alias("w2"))
    dots = (
        pairs.select("user_id", "other_id").join(vectors, "user_id").join(v, ["other_id", "key"])
        .groupBy("user_id", "other_id").agg(F.sum(F.col("weight") * F.col("w2")).alias("dot")))
    j = (
        pairs.join(dots, ["user_id", "other_id"], "left").join(norms.withColumnRenamed("norm", "n1"), "user_id", "left")
        .join(norms.select(F.col("user_id").alias("other_id"), F.col("norm").alias("n2")), "other_id", "left"))
    cos = F.col("dot") / (F.col("n1") * F.col("n2"))
    cos = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.coalesce(cos, F.lit(0.0))).otherwise(0.0)
    return j.withColumn("similarity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), cos))).drop("dot", "n1", "n2")


def _from_sources(pairs: DataFrame, rows: DataFrame, contents: DataFrame, source: str) -> DataFrame:
    """Strong, unseen events on known content of each pair's other user; ``position`` keeps the visit order."""
    events = top_n(rows, ["user_id"], [F.desc("ts_us"), F.desc("id")], MAX_EVENTS, rank="_e")
    strong = events.where(signals.strong_engagement()).select(
        F.col("user_id").alias("other_id"), "content_id", signals.engagement_strength().alias("engagement"), "_e")
    seen = rows.where(signals.hard_seen()).select("user_id", "content_id").distinct()
    known = contents.select("content_id")
    return (
        pairs.join(strong, "other_id").join(seen, ["user_id", "content_id"], "left_anti").join(known, "content_id", "left_semi")
        .select("user_id", "content_id", F.lit(source).alias("source"), F.col("other_id").alias("source_user_id"), "similarity",
                "strength", "engagement", "mutual", (F.col("_p") * 1000 + F.col("_e")).alias("position")))


def merge(candidates: DataFrame) -> DataFrame:
    """One candidate per (user, content): SOCIAL first, then the larger relation + similarity, then the earlier.

    The place in the list is that of the content's first appearance.
    """
    better = F.struct((F.col("source") == "SOCIAL").cast("int"), F.col("strength") + F.col("similarity"), -F.col("position"))
    kept = ["source", "source_user_id", "similarity", "strength", "engagement", "mutual"]
    m = candidates.groupBy("user_id", "content_id").agg(F.max_by(F.struct(*kept), better).alias("c"), F.min("position").alias("position"))
    return m.select("user_id", "content_id", "c.*", "position")


def social_candidates(edges: DataFrame, rows: DataFrame, contents: DataFrame, vectors: DataFrame) -> DataFrame:
    """Up to twenty candidates per user from its five strongest relations (ties by user id)."""
    rel = top_n(relations(edges), ["user_id"], [F.desc("strength"), F.asc("other_id")], MAX_RELATED, rank="_p")
    found = _from_sources(pair_cosine(rel, vectors), rows, contents, "SOCIAL")
    return top_n(merge(found), ["user_id"], [F.asc("position")], MAX_CANDIDATES)


def collaborative_candidates(pool: DataFrame, edges: DataFrame, rows: DataFrame, contents: DataFrame, vectors: DataFrame) -> DataFrame:
    """Up to twenty candidates per user from the first five of its pool, relations and dissimilar users skipped."""
    first = top_n(pool, ["user_id"], [F.asc("other_id")], MAX_POOL, rank="_p")
    strangers = first.join(relations(edges).select("user_id", "other_id"), ["user_id", "other_id"], "left_anti")
    similar = pair_cosine(strangers, vectors).where(F.col("similarity") >= MIN_SIMILARITY)
    found = _from_sources(similar.withColumns({"strength": F.lit(0.0), "mutual": F.lit(False)}), rows, contents, "COLLABORATIVE")
    return top_n(merge(found), ["user_id"], [F.asc("position")], MAX_CANDIDATES)


def generate(social: DataFrame, collaborative: DataFrame, limit: int = 50) -> DataFrame:
    """Both sources merged and ranked by relation + similarity + engagement."""
    both = social.unionByName(collaborative.withColumn("position", F.col("position") + 1_000_000))
    total = F.col("strength") + F.col("similarity") + F.col("engagement")
    return top_n(merge(both), ["user_id"], [F.desc(total), F.asc("position")], limit, rank="rank")


def to_payload(candidates: DataFrame, contents: DataFrame) -> DataFrame:
    """Outgoing candidate rows with the nested social context (4 dp) and a fixed age of five hours."""
    j = candidates.join(contents, "content_id")
    return j.select(
        "user_id", F.col("content_id").alias("contentId"), F.col("creator_id").alias("creatorId"), "category",
        F.col("popularity_score").alias("contentPopularityScore"), F.lit(5.0).alias("contentAgeHours"),
        F.lit(False).alias("creatorFollowed"), F.lit(False).alias("alreadySeen"), "title", "hashtags", "topics", "entities", "subgenres",
        F.col("source").alias("candidateSource"),
        F.struct(F.col("source_user_id").alias("sourceUserId"), F.round("similarity", 4).alias("interestSimilarity"),
                 F.round("strength", 4).alias("relationshipStrength"), F.round("engagement", 4).alias("sourceUserEngagement"),
                 F.col("mutual").alias("mutualFollow")).alias("socialContext"))
