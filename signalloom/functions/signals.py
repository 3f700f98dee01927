"""Engagement signals, labels and weights of one interaction row, as column expressions.

Every function takes column names of the interactions table and returns a Column, so
Catalyst folds the whole family into one generated stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Event types and thresholds.
REJECTION_TYPES = ["CONTENT_NOT_INTERESTED", "LIVE_NOT_INTERESTED"]
PASSIVE_TYPES = [
    "VIDEO_IMPRESSION", "VIDEO_STARTED", "VIDEO_WATCHED", "VIDEO_COMPLETED", "VIDEO_REWATCHED", "VIDEO_SKIPPED",
]
EVENT_TYPES = PASSIVE_TYPES + [
    "CONTENT_LIKED", "CONTENT_SHARED", "CONTENT_FAVORITED", "CONTENT_COMMENTED", "CREATOR_FOLLOWED",
    "CONTENT_NOT_INTERESTED", "LIVE_IMPRESSION", "LIVE_JOINED", "LIVE_LEFT", "LIVE_WATCHED", "LIVE_LIKED",
    "LIVE_SHARED", "LIVE_COMMENTED", "LIVE_GIFT_SENT", "LIVE_CREATOR_FOLLOWED", "LIVE_NOT_INTERESTED",
]
COMPLETION_PCT = 90
POSITIVE_PCT = 70
FAST_SKIP_PCT = 20
STRONG_PCT = 80
# Influence of the n-th passive replay of one content by one user; 0 from the sixth on.
REPLAY_CURVE = [1.0, 1.0, 0.6, 0.3, 0.1]
EXPLICIT_REJECTION_PENALTY = 8
REPEAT_REJECTION_PENALTY = 5
TOKEN_REJECTION_PENALTY = 5
SESSION_REJECTION_PENALTY = 6
STRONG_STRENGTH = {
    "CONTENT_SHARED": 1.0, "CONTENT_FAVORITED": 0.95, "VIDEO_COMPLETED": 0.85, "VIDEO_REWATCHED": 0.85,
    "CONTENT_LIKED": 0.8,
}
DISLIKE_TYPES = ["VIDEO_SKIPPED", "CONTENT_NOT_INTERESTED"]

_ALIASES = {
    "sig_liked": ("liked", "CONTENT_LIKED"),
    "sig_shared": ("shared", "CONTENT_SHARED"),
    "sig_favorited": ("favorited", "CONTENT_FAVORITED"),
    "sig_commented": ("commented", "CONTENT_COMMENTED"),
    "sig_followed": ("creator_followed", "CREATOR_FOLLOWED"),
}


def _is(event_type: str) -> Column:
    return F.col("event_type") == event_type


def signal(name: str) -> Column:
    flag, alias = _ALIASES[name]
    return F.coalesce(F.col(flag), F.lit(False)) | _is(alias)


def wp0() -> Column:
    return F.coalesce(F.col("watch_percentage"), F.lit(0.0))


def rejected() -> Column:
    return F.col("event_type").isin(REJECTION_TYPES)


def completed() -> Column:
    return _is("VIDEO_COMPLETED") | (wp0() >= COMPLETION_PCT)


def fast_skipped() -> Column:
    return _is("VIDEO_SKIPPED") & (wp0() < FAST_SKIP_PCT)


def _labelling_signal() -> Column:
    return signal("sig_liked") | signal("sig_shared") | signal("sig_favorited") | signal("sig_followed")


def target() -> Column:
    """1 positive, 0 negative, NULL neutral; an explicit rejection wins over everything."""
    wp = F.col("watch_percentage")
    return (
        F.when(rejected(), 0)
        .when((wp >= POSITIVE_PCT) | _is("VIDEO_COMPLETED") | _labelling_signal(), 1)
        .when(wp < FAST_SKIP_PCT, 0)
    )


def session_label() -> Column:
    wp = F.col("watch_percentage")
    return (
        F.when(rejected(), 0)
        .when((wp >= POSITIVE_PCT) | signal("sig_liked") | signal("sig_shared"), 1)
        .when(wp < FAST_SKIP_PCT, 0)
    )


def session_delta() -> Column:
    measured_skip = F.coalesce(F.col("watch_percentage") < FAST_SKIP_PCT, F.lit(False))
    return F.when(rejected(), -SESSION_REJECTION_PENALTY).otherwise(
        completed().cast("int") * 4 + signal("sig_liked").cast("int") * 3
        + signal("sig_shared").cast("int") * 5 - measured_skip.cast("int") * 4
    )


def base_delta() -> Column:
    """Weighted engagement before replay weighting and without the rejection override."""
    i = lambda c: c.cast("int")
    return (
        i(completed()) * 4 + i(signal("sig_liked")) * 3 + i(signal("sig_shared")) * 5
        + i(signal("sig_favorited")) * 5 + i(signal("sig_commented")) * 2 + i(signal("sig_followed")) * 6
        + i(_is("VIDEO_REWATCHED")) * 4 - i(fast_skipped()) * 4
    )


def profile_delta() -> Column:
    """The unweighted per-row term of category affinity and content popularity."""
    return base_delta() - _is("CONTENT_NOT_INTERESTED").cast("int") * 8


def hard_seen() -> Column:
    return ~rejected()


def replay_controlled(with_comment: bool = True) -> Column:
    """Passive row without any explicit flag; only such rows advance the replay count."""
    explicit = _labelling_signal() | (signal("sig_commented") if with_comment else F.lit(False))
    return F.col("event_type").isin(PASSIVE_TYPES) & ~explicit


def replay_weight_tenths(occurrence: Column, controlled: Column) -> Column:
    """Influence in tenths (an exact integer) of a row that is the n-th controlled one."""
    curve = F.lit(0)
    for n in range(len(REPLAY_CURVE), 0, -1):
        curve = F.when(occurrence == n, int(round(REPLAY_CURVE[n - 1] * 10))).otherwise(curve)
    return F.when(controlled, curve).otherwise(10).cast("long")


def sample_weight() -> Column:
    """Training weight of a labelled row (columns ``target`` and ``event_*`` metadata)."""
    done = _is("VIDEO_COMPLETED") | (F.coalesce(F.col("event_watch_percentage"), F.lit(0.0)) >= COMPLETION_PCT)
    bonus = lambda c, w: F.when(c, w).otherwise(1.0)
    return F.when(
        F.col("target") == 0, F.when(rejected(), 2.0).otherwise(1.0)
    ).otherwise(
        F.greatest(
            bonus(done, 1.05), bonus(F.col("event_liked"), 1.1),
            bonus(F.col("event_shared") | F.col("event_favorited"), 1.15),
            bonus(F.col("event_creator_followed"), 1.2),
        )
    )


def _no_flag() -> Column:
    f = [F.coalesce(F.col(c), F.lit(False)) for c in ("liked", "shared", "favorited", "creator_followed")]
    return ~(f[0] | f[1] | f[2] | f[3])


def relevance_grade() -> Column:
    """0..4 from the row's flags and (non-null) watch percentage."""
    wp, flag = wp0(), lambda c: F.coalesce(F.col(c), F.lit(False))
    return (
        F.when(rejected(), 0)
        .when((wp < FAST_SKIP_PCT) & _no_flag(), 0)
        .when(flag("shared") | flag("favorited") | flag("creator_followed"), 4)
        .when(flag("liked") | (wp >= COMPLETION_PCT), 3)
        .when(wp >= POSITIVE_PCT, 2)
        .otherwise(1)
    )


def ranking_row_weight() -> Column:
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    bonus = lambda c, w: F.when(c, w).otherwise(1.0)
    return (
        F.when(rejected(), 2.0)
        .when((wp0() < FAST_SKIP_PCT) & _no_flag(), 1.0)
        .otherwise(
            F.greatest(
                bonus(wp0() >= COMPLETION_PCT, 1.05), bonus(flag("liked"), 1.1),
                bonus(flag("shared") | flag("favorited"), 1.15), bonus(flag("creator_followed"), 1.2),
            )
        )
    )


def live_target() -> Column:
    """Label of one LIVE observation row (``joined, impression, watch_time_seconds`` and five action flags)."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    action = flag("liked") | flag("shared") | flag("commented") | flag("gift_sent") | flag("creator_followed")
    watch = F.coalesce(F.col("watch_time_seconds"), F.lit(0.0))
    return (
        F.when((flag("joined") & (watch >= 60)) | action, 1)
        .when((flag("impression") & ~flag("joined")) | (flag("joined") & (watch < 10)), 0)
    )


def strong_engagement() -> Column:
    return (
        F.when(F.col("event_type").isin(DISLIKE_TYPES), False)
        .when(F.col("event_type").isin(list(STRONG_STRENGTH)), True)
        .otherwise(wp0() >= STRONG_PCT)
    )


def engagement_strength() -> Column:
    out = F.when(~strong_engagement(), 0.0)
    for event_type, strength in STRONG_STRENGTH.items():
        out = out.when(_is(event_type), strength)
    return out.otherwise(0.7)


def resolved_weight() -> Column:
    """Weight of a resolved decision row by its relevance; NULL when unresolved."""
    return F.when(
        F.col("observation_state") == "RESOLVED",
        F.when(F.col("relevance") >= 3, 1.5).when(F.col("relevance") == 2, 1.25).otherwise(1.0),
    )


def annotate(df: DataFrame) -> DataFrame:
    """Add signal flags, label, completion and the replay-control flag."""
    cols = {name: signal(name) for name in _ALIASES}
    cols |= {
        "completed": completed(), "rejected": rejected(), "fast_skipped": fast_skipped(), "target": target(),
        "controlled": replay_controlled(), "base_delta": base_delta(),
    }
    return df.withColumns(cols)
