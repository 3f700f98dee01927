"""Explicit schemas of every table and message; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


STR, DBL, BOOL, LONG, INT, TS = (
    T.StringType(), T.DoubleType(), T.BooleanType(), T.LongType(), T.IntegerType(), T.TimestampType(),
)
STRS = T.ArrayType(STR)

INTERACTION = _s(
    ("event_id", STR), ("user_id", STR), ("content_id", STR), ("creator_id", STR), ("category", STR),
    ("event_type", STR), ("watch_time_seconds", DBL), ("content_duration_seconds", DBL),
    ("watch_percentage", DBL), ("liked", BOOL), ("shared", BOOL), ("favorited", BOOL),
    ("commented", BOOL), ("creator_followed", BOOL), ("timestamp", TS),
    ("is_training_context_only", BOOL), ("content_pending", BOOL),
)

CONTENT = _s(
    ("content_id", STR), ("creator_id", STR), ("category", STR), ("content_type", STR),
    ("duration_seconds", DBL), ("popularity_score", DBL), ("is_active", BOOL), ("created_at", TS),
    ("updated_at", TS), ("title", STR), ("hashtags", STRS), ("topics", STRS), ("entities", STRS),
    ("subgenres", STRS), ("category_confidence", DBL), ("category_source", STR),
    ("primary_category", STR), ("subcategory", STR), ("taxonomy_version", STR),
)

# One behaviour message on the wire (camelCase JSON).
BEHAVIOUR_MESSAGE = _s(
    ("eventId", STR), ("userId", STR), ("contentId", STR), ("creatorId", STR), ("category", STR),
    ("eventType", STR), ("watchTimeSeconds", DBL), ("liveWatchTimeSeconds", DBL),
    ("contentDurationSeconds", DBL), ("liked", BOOL), ("shared", BOOL), ("favorited", BOOL),
    ("commented", BOOL), ("creatorFollowed", BOOL), ("timestamp", STR),
)

USER_REGISTERED_MESSAGE = _s(
    ("type", STR), ("eventId", STR), ("target", _s(("type", STR), ("id", STR))),
    ("data", _s(("userId", STR), ("birthday", STR), ("region", STR), ("interests", STRS), ("occurredAt", STR))),
)

DATASET_RECORD = _s(
    ("exampleId", STR), ("contentId", STR), ("creatorId", STR), ("contentType", STR), ("title", STR),
    ("hashtags", STRS), ("language", STR), ("contentCreatedAt", STR), ("primaryCategory", STR),
    ("subcategory", STR), ("topics", STRS), ("taxonomyVersion", STR), ("labelSource", STR),
    ("labelConfidence", DBL), ("reviewStatus", STR), ("reviewerId", STR), ("reviewedAt", STR),
    ("notes", STR), ("datasetSplit", STR), ("sourceMetadata", T.MapType(STR, STR)),
)

RECENT_WATCH = _s(
    ("timestamp", TS), ("watch_percentage", DBL), ("completed", BOOL), ("liked", BOOL),
    ("shared", BOOL), ("not_interested", BOOL),
)
CATEGORY_PROFILE = _s(
    ("category", STR), ("interaction_count", LONG), ("positive_count", LONG), ("negative_count", LONG),
    ("completed_count", LONG), ("watch_count", LONG), ("watch_percentage_sum", DBL),
    ("raw_affinity_score", DBL), ("recent_raw_affinity_score", DBL), ("last_interaction_at", TS),
    ("explicit_negative_count", LONG), ("last_explicit_negative_at", TS),
    ("recent_watch_events", T.ArrayType(RECENT_WATCH)),
)
CREATOR_PROFILE = _s(("creator_id", STR), ("interaction_count", LONG), ("completed_count", LONG))
SEMANTIC_AFFINITY = _s(
    ("field", STR), ("token", STR), ("interaction_count", LONG), ("positive_count", LONG),
    ("negative_count", LONG), ("raw_affinity_score", DBL), ("explicit_negative_count", LONG),
)
PROFILE_SNAPSHOT = _s(
    ("user_id", STR), ("version", INT), ("total_interaction_count", LONG),
    ("followed_creator_ids", STRS), ("seen_content_ids", STRS),
    ("categories", T.ArrayType(CATEGORY_PROFILE)), ("creators", T.ArrayType(CREATOR_PROFILE)),
    ("semantic_affinities", T.ArrayType(SEMANTIC_AFFINITY)),
)

CANDIDATE = _s(
    ("contentId", STR), ("creatorId", STR), ("category", STR), ("contentPopularityScore", DBL),
    ("contentAgeHours", DBL), ("creatorFollowed", BOOL), ("alreadySeen", BOOL), ("title", STR),
    ("hashtags", STRS), ("topics", STRS), ("entities", STRS), ("subgenres", STRS),
)
