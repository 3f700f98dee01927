"""Ingestion: event validation, idempotent storage, users, contents, contexts. Each step maps tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars, signals, tokens
from ..operators import profiles
from ..operators.running import top_n

MAX_SKEW_SECONDS = 300
ZONED = r"(?i)(Z|[+-]\d{2}:?\d{2})$"


def parse_messages(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON behaviour messages to event columns; an unparsable message has ``malformed`` set."""
    from ..schemas import BEHAVIOUR_MESSAGE

    m = F.from_json(F.col(value).cast("string"), BEHAVIOUR_MESSAGE, {"mode": "PERMISSIVE"})
    j = raw.withColumn("_m", m)
    c = lambda n: F.col(f"_m.{n}")
    flag = lambda n: F.coalesce(c(n), F.lit(False))
    return j.select(
        *[x for x in raw.columns if x != value], c("eventId").alias("event_id"), c("userId").alias("user_id"), c("contentId").alias("content_id"),
        c("creatorId").alias("creator_id"), F.upper(tokens.strip(c("category"))).alias("category"), c("eventType").alias("event_type"),
        F.coalesce(c("liveWatchTimeSeconds"), c("watchTimeSeconds")).alias("watch_time_seconds"), c("contentDurationSeconds").alias("content_duration_seconds"),
        flag("liked").alias("liked"), flag("shared").alias("shared"), flag("favorited").alias("favorited"), flag("commented").alias("commented"),
        flag("creatorFollowed").alias("creator_followed"), c("timestamp").alias("ts_text"), F.try_to_timestamp(c("timestamp")).alias("timestamp"),
        (c("eventId").isNull() & c("userId").isNull() & c("eventType").isNull()).alias("malformed"))


def event_reject_reason(now: Column) -> Column:
    """First broken rule of a parsed event, or NULL."""
    bad_id = lambda n: F.coalesce(~F.length(n).between(1, 128), F.lit(True))
    live, watch, length = F.col("event_type").startswith("LIVE_"), F.col("watch_time_seconds"), F.col("content_duration_seconds")
    return (
        F.when(F.col("malformed"), "MALFORMED")
        .when(bad_id("event_id") | bad_id("user_id") | bad_id("content_id") | bad_id("creator_id"), "BAD_ID")
        .when(F.coalesce(F.col("category"), F.lit("")) == "", "EMPTY_CATEGORY").when(F.length("category") > 64, "CATEGORY_TOO_LONG")
        .when(~F.coalesce(F.col("event_type").isin(signals.EVENT_TYPES), F.lit(False)), "UNKNOWN_EVENT_TYPE")
        .when(F.col("timestamp").isNull(), "BAD_TIMESTAMP").when(~F.col("ts_text").rlike(ZONED), "TIMEZONE_MISSING")
        .when(F.unix_micros("timestamp") - F.unix_micros(now) > MAX_SKEW_SECONDS * 1_000_000, "FUTURE_TIMESTAMP")
        .when(watch < 0, "NEGATIVE_WATCH").when(length <= 0, "DURATION_NOT_POSITIVE")
        .when(~live & watch.isNotNull() & length.isNull(), "DURATION_MISSING").when(~live & (watch > length * 3), "WATCH_EXCEEDS_DURATION"))


def validate_against_catalog(events: DataFrame, contents: DataFrame) -> DataFrame:
    """Add ``content_pending`` and fill ``reject_reason`` from the content row (inactive, or LIVE-ness mismatch)."""
    dim = contents.select("content_id", F.col("is_active").alias("_active"), F.col("content_type").alias("content_type"))
    j = events.join(dim, "content_id", "left")
    known = F.col("content_type").isNotNull()
    mismatch = F.col("event_type").startswith("LIVE_") != (F.col("content_type") == "LIVE")
    why = F.when(known & ~F.col("_active"), "CONTENT_INACTIVE").when(known & mismatch, "CONTENT_TYPE_MISMATCH")
    return j.withColumns({"reject_reason": F.coalesce("reject_reason", why), "content_pending": ~known}).drop("_active")


def to_interactions(events: DataFrame) -> DataFrame:
    """Accepted events as stored rows: flags folded with event types, watch percentage computed."""
    return events.withColumns({
        "liked": signals.signal("sig_liked"), "shared": signals.signal("sig_shared"), "favorited": signals.signal("sig_favorited"),
        "commented": signals.signal("sig_commented"), "creator_followed": signals.signal("sig_followed"),
        "watch_percentage": scalars.watch_percentage("watch_time_seconds", "content_duration_seconds"),
        "is_training_context_only": F.lit(False)})


def new_events(events: DataFrame, stored: DataFrame | None, order: str = "offset") -> DataFrame:
    """First message per event id that is not stored yet."""
    first = top_n(events, ["event_id"], [F.asc(order)], 1)
    return first if stored is None else first.join(stored.select("event_id"), "event_id", "left_anti")


def store_events(messages: DataFrame, contents: DataFrame, stored: DataFrame | None, now: Column, order: str = "offset") -> dict[str, DataFrame]:
    """Parsed messages to {accepted, rejected, duplicates, counts}; nothing is fatal."""
    judged = validate_against_catalog(messages.withColumn("reject_reason", event_reject_reason(now)), contents)
    valid = judged.where("reject_reason is null")
    fresh = new_events(valid, stored, order)
    duplicates = valid.join(fresh.select("event_id", order), ["event_id", order], "left_anti")
    status = F.when(F.col("reject_reason") == "MALFORMED", "malformed").when(
        F.col("reject_reason").isin("CONTENT_INACTIVE", "CONTENT_TYPE_MISMATCH"), "rejected").when(F.col("reject_reason").isNotNull(), "invalid").otherwise("valid")
    counts = judged.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return {"accepted": to_interactions(fresh).drop("reject_reason", "malformed", "ts_text"), "rejected": judged.where("reject_reason is not null"),
            "duplicates": duplicates, "counts": counts}


def missing_users(ids: DataFrame, users: DataFrame) -> DataFrame:
    return ids.select("user_id").distinct().join(users.select("user_id"), "user_id", "left_anti").withColumn("status", F.lit("ACTIVE"))


def touched_popularity(accepted: DataFrame, interactions: DataFrame, contents: DataFrame) -> DataFrame:
    """New popularity of the VIDEO contents a batch touched, from all their rows."""
    video = contents.where(F.col("content_type") == "VIDEO").select("content_id")
    touched = accepted.where(~F.col("content_pending")).select("content_id").distinct().join(video, "content_id", "left_semi")
    rows = interactions.join(touched, "content_id", "left_semi")
    return profiles.content_popularity(rows, touched)


# --- contents -------------------------------------------------------------------------------------

def content_reject_reason() -> Column:
    errors = [tokens.token_list_error(F.col(c)) for c in ("hashtags", "topics", "entities", "subgenres")]
    return (
        F.when(F.coalesce(F.length("content_id"), F.lit(0)) == 0, "BAD_ID").when(F.coalesce(F.length("creator_id"), F.lit(0)) == 0, "BAD_ID")
        .when(~F.col("content_type").isin("VIDEO", "LIVE"), "BAD_CONTENT_TYPE").when(tokens.title_error(F.col("title")).isNotNull(), "TITLE_TOO_LONG")
        .when(F.coalesce(*errors).isNotNull(), "BAD_TOKENS"))


def ingest_content(incoming: DataFrame, contents: DataFrame, inferred: DataFrame, history: DataFrame, order: str = "offset") -> DataFrame:
    """Validated content rows with ``reject_reason``; category explicit, inferred from text, or from the creator's history.

    ``inferred``: (content_id, category, confidence, source, taxonomy_version) of the text classifier;
    ``history``: (creator_id, category, confidence) of the creator's VIDEO contents, used for LIVE.
    """
    first = top_n(incoming, ["content_id"], [F.asc(order)], 1).select("content_id", F.col(order).alias("_first"))
    known = contents.select("content_id", F.lit(True).alias("_known"))
    j = incoming.join(first, "content_id", "left").join(known, "content_id", "left")
    j = j.join(inferred.select("content_id", F.col("category").alias("_ic"), F.col("confidence").alias("_if"), F.col("source").alias("_is"),
                               F.col("taxonomy_version").alias("_iv")), "content_id", "left")
    j = j.join(history.select("creator_id", F.col("category").alias("_hc"), F.col("confidence").alias("_hf")), "creator_id", "left")
    repeated = F.col("_known").isNotNull() | (F.col(order) > F.col("_first"))
    why = F.coalesce(content_reject_reason(), F.when(repeated, "DUPLICATE_CONTENT"))
    explicit, is_live = F.nullif(F.upper(tokens.strip(F.col("category"))), F.lit("")), F.col("content_type") == "LIVE"
    stated = explicit.isNotNull()
    return j.select(
        *[c for c in incoming.columns if c not in ("category", "title", "hashtags", "topics", "entities", "subgenres")],
        F.when(stated, explicit).when(is_live, F.coalesce("_hc", F.lit("UNKNOWN"))).otherwise(F.coalesce("_ic", F.lit("UNKNOWN"))).alias("category"),
        F.when(stated, "EXPLICIT").when(is_live, "CREATOR_HISTORY").otherwise(F.coalesce("_is", F.lit("UNKNOWN"))).alias("category_source"),
        F.when(~stated, F.when(is_live, F.coalesce("_hf", F.lit(0.0))).otherwise(F.coalesce("_if", F.lit(0.0)))).alias("category_confidence"),
        F.when(~stated & ~is_live, F.col("_iv")).alias("taxonomy_version"), F.lit(0.5).alias("popularity_score"),
        tokens.normalize_title(F.col("title")).alias("title"), *[tokens.normalize_tokens(F.col(c)).alias(c) for c in ("hashtags", "topics", "entities", "subgenres")],
        why.alias("reject_reason"))


def resolve_pending(pending: DataFrame, contents: DataFrame) -> DataFrame:
    """Interactions with ``content_pending`` cleared where a content of matching LIVE-ness has arrived."""
    dim = contents.select("content_id", (F.col("content_type") == "LIVE").alias("_live"))
    fits = F.col("event_type").startswith("LIVE_") == F.col("_live")
    return pending.join(dim, "content_id", "left").withColumn(
        "content_pending", F.col("content_pending") & ~F.coalesce(fits, F.lit(False))).drop("_live")


def update_content_status(contents: DataFrame, updates: DataFrame) -> DataFrame:
    """Contents with the latest (content_id, is_active, at_us) applied."""
    latest = updates.groupBy("content_id").agg(F.max_by("is_active", "at_us").alias("_a"))
    return contents.join(latest, "content_id", "left").withColumn("is_active", F.coalesce("_a", "is_active")).drop("_a")


# --- users ----------------------------------------------------------------------------------------

def parse_registrations(raw: DataFrame, value: str = "value") -> DataFrame:
    """``user.registered`` messages to rows with ``reject_reason``; a malformed birthday counts as unknown."""
    from ..schemas import USER_REGISTERED_MESSAGE

    m = raw.withColumn("_m", F.from_json(F.col(value).cast("string"), USER_REGISTERED_MESSAGE))
    d = lambda n: F.col(f"_m.data.{n}")
    at = F.try_to_timestamp(d("occurredAt"))
    blank = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    why = (
        F.when(F.col("_m.type").isNull(), "MALFORMED").when(F.col("_m.type") != "user.registered", "WRONG_TYPE").when(blank(F.col("_m.eventId")), "EVENT_ID_MISSING")
        .when(F.coalesce(F.col("_m.target.type"), F.lit("")) != "user", "WRONG_TARGET").when(blank(d("userId")), "USER_ID_MISSING")
        .when(~F.col("_m.target.id").eqNullSafe(d("userId")), "TARGET_MISMATCH").when(at.isNull(), "BAD_TIMESTAMP").when(~d("occurredAt").rlike(ZONED), "TIMEZONE_MISSING")
        .when(F.length(d("region")) > 256, "REGION_TOO_LONG").when(tokens.token_list_error(d("interests")).isNotNull(), "BAD_INTERESTS"))
    interests = tokens.normalize_tokens(d("interests"))
    born = F.when(d("birthday").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(d("birthday"), "yyyy-MM-dd"))
    return m.select(
        *[x for x in raw.columns if x != value], d("userId").alias("user_id"), F.unix_micros(at).alias("at_us"),
        scalars.age_from_birthday(born, at).alias("age"), scalars.safe_region(d("region")).alias("region"),
        F.when(F.size(interests) > 0, interests).alias("interests"), why.alias("reject_reason"))


def upsert_latest(current: DataFrame | None, incoming: DataFrame, columns: list[str], key: str = "user_id", at: str = "at_us") -> DataFrame:
    """Per key, each column's newest non-NULL incoming value, else the stored one."""
    picks = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in columns]
    new = incoming.groupBy(key).agg(*picks)
    if current is None:
        return new
    old = current.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    return old.join(new, key, "full_outer").select(key, *[F.coalesce(c, f"_o_{c}").alias(c) for c in columns])


def upsert_onboarding(current: DataFrame | None, registrations: DataFrame) -> DataFrame:
    return upsert_latest(current, registrations.where("reject_reason is null"), ["age", "region", "interests"])


def upsert_demographics(current: DataFrame | None, seen: DataFrame) -> DataFrame:
    """(user_id, region, age_bucket, at_us) sightings merged into the demographic table; all-NULL sightings are no-ops."""
    return upsert_latest(current, seen.where("region is not null or age_bucket is not null"), ["region", "age_bucket"])


def parse_candidates(raw: DataFrame, value: str = "value") -> DataFrame:
    """External candidate lists: ``list_missing`` marks bodies without a list; bad items drop out one by one."""
    from ..schemas import CANDIDATE

    body = raw.withColumn("_items", F.from_json(F.get_json_object(value, "$.candidates"), f"array<{CANDIDATE.simpleString()}>"))
    rows = body.select(*[c for c in raw.columns if c != value], F.col("_items").isNull().alias("list_missing"), F.posexplode_outer("_items").alias("position", "_c"))
    ok = (F.length("_c.contentId") > 0) & (F.length("_c.creatorId") > 0) & (F.length("_c.category") > 0) & F.col("_c.contentPopularityScore").between(0, 1) & (F.col("_c.contentAgeHours") >= 0)
    return rows.where(F.col("list_missing") | F.coalesce(ok, F.lit(False))).select("*", "_c.*").drop("_c")
