"""Cohort preferences by region and age, fallback between levels, shrinkage towards the global level."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import signals
from .profiles import with_replay_weight

MIN_USERS = 30
MIN_INTERACTIONS = 200
SHRINKAGE_K = 200.0
LEVELS = ["REGION_AGE", "REGION", "AGE", "GLOBAL"]


def cohort_preferences(rows: DataFrame, demographics: DataFrame, previous: DataFrame | None = None, **kw) -> DataFrame:
    """Preference score per (cohort, category); replay is numbered over the labelled rows of tagged users only.

    A user has one demographic row, so after the per-user sums a cohort's users are its row count
    and the four grouping sets need no distinct aggregation.
    """
    tagged = demographics.where(F.col("region").isNotNull() | F.col("age_bucket").isNotNull())
    a = signals.annotate(rows).where(
        (F.col("content_type") != "LIVE") & ~F.col("is_training_context_only") & F.col("target").isNotNull())
    a = with_replay_weight(a.join(tagged.select("user_id"), "user_id", "left_semi"), **kw)
    pos = F.col("target") == 1
    users = a.groupBy("user_id", F.upper("category").alias("category")).agg(
        F.sum(pos.cast("long")).alias("pos"), F.sum((~pos).cast("long")).alias("neg"),
        F.sum(F.when(pos, F.col("w10")).otherwise(0)).alias("wpos"), F.sum("w10").alias("w"))
    cube = users.join(tagged.select("user_id", "region", "age_bucket"), "user_id")
    cat, reg, age = F.col("category"), F.col("region"), F.col("age_bucket")
    out = cube.groupingSets([[cat], [cat, reg], [cat, age], [cat, reg, age]], cat, reg, age).agg(
        F.grouping("region").alias("_gr"), F.grouping("age_bucket").alias("_ga"),
        F.sum("pos").alias("positive_count"), F.sum("neg").alias("negative_count"), F.count(F.lit(1)).alias("sample_users"),
        F.sum("wpos").alias("_wp"), F.sum("w").alias("_w"))
    out = out.where(((F.col("_gr") == 1) | reg.isNotNull()) & ((F.col("_ga") == 1) | age.isNotNull()))
    kind = (
        F.when((F.col("_gr") == 0) & (F.col("_ga") == 0), "REGION_AGE").when(F.col("_gr") == 0, "REGION")
        .when(F.col("_ga") == 0, "AGE").otherwise("GLOBAL"))
    version = F.lit(1) if previous is None else F.coalesce(previous.agg(F.max("version")).scalar(), F.lit(0)) + 1
    return out.select(
        version.cast("long").alias("version"), kind.alias("cohort_type"), "region", "age_bucket", "category",
        F.when(F.col("_w") > 0, F.col("_wp") / F.col("_w")).otherwise(0.5).alias("preference_score"), "sample_users",
        (F.col("positive_count") + F.col("negative_count")).alias("sample_interactions"), "positive_count", "negative_count")


def resolve_cohorts(preferences: DataFrame, people: DataFrame, *, min_users: int = MIN_USERS, min_rows: int = MIN_INTERACTIONS) -> DataFrame:
    """For each (region, age_bucket) met among ``people``: the narrowest cohort with enough evidence."""
    latest = preferences.where(F.col("version") == preferences.agg(F.max("version")).scalar())
    usable = latest.groupBy("cohort_type", "region", "age_bucket").agg(
        F.max("sample_users").alias("users"), F.sum("sample_interactions").alias("rows")
    ).where((F.col("users") >= min_users) & (F.col("rows") >= min_rows))
    pairs = people.select("region", "age_bucket").distinct().where(F.col("region").isNotNull() | F.col("age_bucket").isNotNull())
    none = F.lit(None).cast("string")
    wanted = pairs.select("region", "age_bucket", F.explode(F.array(*[
        F.struct(F.lit(i).alias("level"), F.lit(t).alias("cohort_type"), r.alias("c_region"), a.alias("c_age"))
        for i, (t, r, a) in enumerate((
            ("REGION_AGE", F.col("region"), F.col("age_bucket")), ("REGION", F.col("region"), none),
            ("AGE", none, F.col("age_bucket")), ("GLOBAL", none, none)))
    ])).alias("w")).select("region", "age_bucket", "w.*")
    real = (
        F.when(F.col("cohort_type") == "REGION_AGE", F.col("c_region").isNotNull() & F.col("c_age").isNotNull())
        .when(F.col("cohort_type") == "REGION", F.col("c_region").isNotNull())
        .when(F.col("cohort_type") == "AGE", F.col("c_age").isNotNull()).otherwise(True))
    u = usable.withColumnsRenamed({"region": "u_region", "age_bucket": "u_age", "cohort_type": "u_type"})
    hit = wanted.where(real).join(u, (F.col("u_type") == F.col("cohort_type")) & F.col("u_region").eqNullSafe(F.col("c_region"))
                                  & F.col("u_age").eqNullSafe(F.col("c_age")))
    return hit.groupBy("region", "age_bucket").agg(
        F.min(F.struct("level", "cohort_type", "c_region", "c_age", "users", "rows")).alias("m")
    ).select("region", "age_bucket", "m.cohort_type", "m.c_region", "m.c_age", "m.users", "m.rows")


def shrunk_preferences(preferences: DataFrame, k: float = SHRINKAGE_K) -> DataFrame:
    """Each cohort's score pulled towards the global score of its category by n / (n + k)."""
    latest = preferences.where(F.col("version") == preferences.agg(F.max("version")).scalar())
    world = latest.where(F.col("cohort_type") == "GLOBAL").select("category", F.col("preference_score").alias("_g"))
    n = F.col("sample_interactions")
    w = n / (n + k)
    mixed = w * F.col("preference_score") + (1 - w) * F.coalesce("_g", F.lit(0.5))
    return latest.join(world, "category", "left").withColumn(
        "score", F.when(F.col("cohort_type") == "GLOBAL", F.col("preference_score")).otherwise(mixed)).drop("_g")


def cohort_profile(preferences: DataFrame, people: DataFrame, **kw) -> DataFrame:
    """(region, age_bucket, category, score): the resolved cohort's shrunk scores."""
    chosen = resolve_cohorts(preferences, people, **kw)
    s = shrunk_preferences(preferences).select(
        F.col("cohort_type").alias("s_type"), F.col("region").alias("s_region"), F.col("age_bucket").alias("s_age"), "category", "score")
    on = (F.col("s_type") == F.col("cohort_type")) & F.col("s_region").eqNullSafe(F.col("c_region")) & F.col("s_age").eqNullSafe(F.col("c_age"))
    return chosen.join(s, on).select("region", "age_bucket", F.col("cohort_type").alias("source"), "category", "score")
