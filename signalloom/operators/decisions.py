"""Decision log: ranked snapshots, outcomes from later events, group validation, readiness, training checks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import signals
from .features import FEATURES, NUMERIC

SCHEMA_VERSION = "video-ranking-features-sha256:" + hashlib.sha256(json.dumps(FEATURES, separators=(",", ":")).encode()).hexdigest()


class RankingInputError(Exception):
    pass


def feature_payload(features: Sequence[str] = tuple(FEATURES)) -> Column:
    """Feature vector as JSON: schema version, names in order, values."""
    values = F.array(*[F.col(c).cast("string") for c in features])
    return F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.array(*[F.lit(c) for c in features]).alias("names"), values.alias("values")))


def read_payload(payload: Column, features: Sequence[str] = tuple(FEATURES)) -> Column:
    """The stored vector as a struct again; NULL where version, names or length disagree."""
    p = F.from_json(payload, "schemaVersion string, names array<string>, values array<string>")
    ok = (p["schemaVersion"] == SCHEMA_VERSION) & (p["names"] == F.array(*[F.lit(c) for c in features])) & (F.size(p["values"]) == len(features))
    parts = [F.get(p["values"], F.lit(i)).cast("string" if c == "category" else "double").alias(c) for i, c in enumerate(features)]
    return F.when(ok, F.struct(*parts))


def snapshot(final: DataFrame, features: DataFrame, *, model_version: str, ranking_us: int, request: Column, numeric: Sequence[str] = tuple(NUMERIC)) -> DataFrame:
    """One log row per (request, item): ranks, scores, feature vector and what is wrong with it, if anything."""
    names = ["category", *numeric]
    keys = ["user_id", "content_id"]
    j = final.drop(*[c for c in final.columns if c in names]).join(features.select(*keys, *names), keys)
    bad = F.lit(False)
    for c in numeric:
        v = F.col(c).cast("double")
        bad = bad | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    problem = F.when(F.coalesce(F.trim("category"), F.lit("")) == "", "BLANK_CATEGORY").when(bad, "FEATURE_NOT_FINITE").when(
        (F.col("rank") < 1) | (F.col("pre_rank") < 1), "RANK_NOT_POSITIVE")
    return j.select(
        F.concat(F.lit("internal-correlation-only:"), request).alias("request_id"), F.lit(ranking_us).cast("long").alias("ranking_us"),
        F.lit(model_version).alias("model_version"), *keys, "category", feature_payload(names).alias("features"),
        F.col("model_score").alias("raw_model_score"), F.col("model_score").alias("normalized_model_score"),
        F.col("pre_rank").alias("pre_rerank_rank"), F.col("score").alias("final_score"), F.col("rank").alias("final_rank"), problem.alias("problem"))


def write_log(df: DataFrame, path: str) -> None:
    """Append snapshots partitioned by decision day."""
    df.withColumn("day", F.to_date(F.timestamp_micros("ranking_us"))).write.mode("append").partitionBy("day").parquet(path)


_OUTCOMES = ["rejected", "completed", "sig_liked", "sig_shared", "sig_favorited", "sig_followed"]


def resolve_outcomes(log: DataFrame, events: DataFrame) -> DataFrame:
    """Every logged item with its exposure state and, from events at or after the decision, the relevance 0..4.

    What follows a decision is a suffix of the item's events, so its maxima are running maxima over falling time; log rows
    stand among the events. Days keep a hot (user, content) apart: a window runs over one day's rows, another over each
    pair's days, and a log row takes the greater of both. No row meets more than one other row in the join.
    """
    pair = ["user_id", "content_id"]
    facts = [*_OUTCOMES, "watch_percentage", "observed_us"]
    day = F.floor(F.col("_us") / 86_400_000_000)
    seen = signals.annotate(events).select(
        *pair, F.col("ts_us").alias("_us"), *[F.col(c).cast("int").alias(c) for c in _OUTCOMES], "watch_percentage", F.col("ts_us").alias("observed_us"), F.lit(None).alias("_row"))
    names = log.columns
    asked = log.select(*pair, F.col("ranking_us").alias("_us"), *[F.lit(None).alias(c) for c in facts], F.struct(*names).alias("_row"))
    wanted = log.select(*pair).distinct()
    rows = seen.join(wanted, pair, "left_semi").unionByName(asked).withColumn("_day", day)
    later = Window.partitionBy(*pair, "_day").orderBy(F.desc("_us")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same_day = rows.withColumns({c: F.max(c).over(later) for c in facts}).where("_row is not null")
    later_days = Window.partitionBy(*pair).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(*pair, "_day").agg(*[F.max(c).alias(c) for c in facts])
    days = days.select(*pair, "_day", *[F.max(c).over(later_days).alias(f"_{c}") for c in facts])
    found = same_day.join(days, [*pair, "_day"]).select("_row", *[F.greatest(c, f"_{c}").alias(f"_{c}") for c in facts])
    f = lambda c: F.col(f"_{c}") == 1
    strong = f("sig_shared") | f("sig_favorited") | f("sig_followed")
    grade = (
        F.when(f("rejected"), 0).when((F.col("_watch_percentage") < 20) & ~(strong | f("sig_liked")), 0).when(strong, 4)
        .when(f("sig_liked") | f("completed"), 3).when(F.col("_watch_percentage") >= 70, 2).otherwise(1))
    hit = F.col("_observed_us").isNotNull()
    return found.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in names], F.col("_observed_us").alias("observed_us"), F.when(hit, grade).alias("relevance"),
        F.when(hit, "IMPRESSED").otherwise("SERVED").alias("exposure_state"), F.when(hit, "RESOLVED").otherwise("NOT_OBSERVED").alias("observation_state"))


def violations(log: DataFrame) -> DataFrame:
    """(request_id, violation): duplicate contents, mixed ranking times and broken exposure/observation states."""
    g = log.groupBy("request_id").agg(F.countDistinct("ranking_us").alias("times"))
    dup = log.groupBy("request_id", "content_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("request_id", F.lit("DUPLICATE_CONTENT").alias("violation"))
    mixed = g.where("times > 1").select("request_id", F.lit("MIXED_RANKING_TIME").alias("violation"))
    exp, obs, rel = F.col("exposure_state"), F.col("observation_state"), F.col("relevance")
    hidden = exp.isin("RANKED", "SERVED")
    state = (
        F.when(hidden & (obs != "NOT_OBSERVED"), "UNEXPOSED_BUT_OBSERVED").when(hidden & (F.col("observed_us").isNotNull() | rel.isNotNull()), "UNEXPOSED_WITH_OUTCOME")
        .when((exp == "IMPRESSED") & (obs == "NOT_OBSERVED"), "IMPRESSED_NOT_OBSERVED").when((exp == "IMPRESSED") & F.col("observed_us").isNull(), "OBSERVED_AT_MISSING")
        .when(F.col("observed_us") < F.col("ranking_us"), "OBSERVED_BEFORE_RANKING").when(obs.isin("NOT_YET_RESOLVED", "CENSORED") & rel.isNotNull(), "UNRESOLVED_WITH_RELEVANCE")
        .when((obs == "RESOLVED") & rel.isNull(), "RESOLVED_WITHOUT_RELEVANCE").when((obs == "RESOLVED") & ~rel.between(0, 4), "RELEVANCE_OUT_OF_RANGE"))
    broken = log.select("request_id", state.alias("violation")).where("violation is not null")
    blank = log.where(F.coalesce(F.trim("request_id"), F.lit("")) == "").select("request_id", F.lit("BLANK_REQUEST").alias("violation"))
    return dup.unionByName(mixed).unionByName(broken).unionByName(blank).distinct()


def validate_groups(log: DataFrame) -> DataFrame:
    """Per decision: counts, trainable or the first reason why not."""
    resolved = F.col("observation_state") == "RESOLVED"
    # At most five relevances exist, so the distinct set is a short array.
    g = log.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.sum(resolved.cast("long")).alias("resolved"),
        F.size(F.collect_set(F.when(resolved, F.col("relevance")))).cast("long").alias("relevances"))
    reason = (
        F.when(F.col("candidates") < 2, "TOO_FEW_CANDIDATES").when(F.col("resolved") == 0, "ZERO_RESOLVED")
        .when(F.col("resolved") == 1, "ONE_RESOLVED").when(F.col("relevances") < 2, "IDENTICAL_RELEVANCE"))
    return g.withColumns({"reason": reason, "trainable": reason.isNull()})


def ranking_dataset(log: DataFrame) -> DataFrame:
    """Resolved rows of trainable decisions with their relevance weight."""
    good = validate_groups(log).where("trainable").select("request_id")
    return log.where(F.col("observation_state") == "RESOLVED").join(good, "request_id", "left_semi").withColumn("sample_weight", signals.resolved_weight())


def exclusion_report(log: DataFrame) -> DataFrame:
    return validate_groups(log).where("not trainable").groupBy("reason").agg(F.count(F.lit(1)).alias("groups"))


def readiness(log: DataFrame) -> DataFrame:
    """One row of counts per exposure and observation state."""
    n = lambda c, v: F.sum((F.col(c) == v).cast("long"))
    rows = log.agg(
        F.count(F.lit(1)).alias("candidates"), n("exposure_state", "RANKED").alias("ranked"), n("exposure_state", "SERVED").alias("served"),
        n("exposure_state", "IMPRESSED").alias("impressed"), n("observation_state", "RESOLVED").alias("resolved"),
        n("observation_state", "NOT_YET_RESOLVED").alias("not_yet_resolved"), n("observation_state", "CENSORED").alias("censored"))
    g = validate_groups(log)
    trainable = g.agg(F.sum(F.col("trainable").cast("long"))).scalar()
    return rows.withColumns({"decisions": g.agg(F.count(F.lit(1))).scalar(), "trainable_groups": trainable}).withColumn(
        "buildable", F.coalesce(F.col("trainable_groups") > 0, F.lit(False)))


def per_decision_counts(log: DataFrame) -> DataFrame:
    return validate_groups(log).select("request_id", "candidates", "resolved")


def check_training_input(log: DataFrame, features: Sequence[str], *, volume_confirmed: bool) -> DataFrame:
    """The training rows, or RankingInputError naming every broken precondition."""
    data = ranking_dataset(log)
    bad = F.lit(False)
    for c in features:
        v = F.col(c).cast("double")
        bad = bad | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    s = data.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(bad.cast("long")).alias("bad"), F.sum(F.col("relevance").isNull().cast("long")).alias("unlabelled"),
        F.count("sample_weight").alias("weighted")).withColumn("decisions", log.agg(F.countDistinct("request_id")).scalar()).first()
    rules = [
        (s["decisions"] == 0, "no decisions"), (s["rows"] == 0, "no trainable decisions"), (not volume_confirmed, "volume not confirmed"),
        ((s["bad"] or 0) > 0, "features not finite"), ((s["unlabelled"] or 0) > 0, "relevance missing"),
        (s["weighted"] not in (0, s["rows"]), "weights neither all present nor all absent")]
    broken = [text for hit, text in rules if hit]
    if broken:
        raise RankingInputError("; ".join(broken))
    return data


def foreign_rows(events: DataFrame, experiment: str, marker: str = "syn-cmp-") -> DataFrame:
    """Own and foreign rows among the marked ones, by event-id prefix."""
    marked = F.col("event_id").startswith(marker)
    own = F.col("event_id").startswith(f"{marker}{experiment}-")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return events.agg(n(marked & own).alias("own"), n(marked & ~own).alias("foreign"), n(~marked).alias("unmarked"))
