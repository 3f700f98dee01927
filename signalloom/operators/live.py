"""LIVE streams: sessions, history before each session, datasets, dynamic stream state, user signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars, signals, tokens
from ..session import cut_lineage
from .running import HEAVY_ROWS, Family, dealt_by, load, prior_state, top_n

RECONNECT_GRACE_US = 30 * 1_000_000
WEEK_US = 7 * 86_400_000_000
MEANINGFUL_STAY_US = 60 * 1_000_000
SHORT_STAY_US = 10 * 1_000_000
VIEWER_STALE_US = 90 * 1_000_000
DYNAMIC_WINDOW_US = 600 * 1_000_000
TRENDING_GROWTH = 0.15

# Fixed order: the LIVE model's input.
LIVE_CATEGORICAL = ["category", "region", "language"]
LIVE_NUMERIC = [
    "live_category_affinity", "creator_affinity", "creator_followed", "previous_live_interaction_count",
    "previous_live_watch_time", "average_live_watch_time_for_category", "recent_live_category_activity",
    "current_viewer_count", "viewer_growth_rate", "live_age_minutes", "region_match", "language_match", "hour_of_day",
    "already_joined",
]
LIVE_FEATURES = LIVE_CATEGORICAL + LIVE_NUMERIC
_COUNTS = ["like_count", "share_count", "comment_count", "gift_count", "creator_follow_count", "not_interested_count"]


def live_signals() -> dict[str, Column]:
    """Six LIVE signals of a row: flag or event type; gifts and rejections by type only."""
    is_ = lambda t: F.col("event_type") == t
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return {
        "like_count": flag("liked") | is_("LIVE_LIKED"), "share_count": flag("shared") | is_("LIVE_SHARED"),
        "comment_count": flag("commented") | is_("LIVE_COMMENTED"), "gift_count": is_("LIVE_GIFT_SENT"),
        "creator_follow_count": flag("creator_followed") | is_("LIVE_CREATOR_FOLLOWED"),
        "not_interested_count": is_("LIVE_NOT_INTERESTED"),
    }


def live_sessions(rows: DataFrame, *, grace_us: int = RECONNECT_GRACE_US, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """One row per reconstructed viewing session of a (user, stream).

    Whether a segment is open before a row depends only on the latest JOINED/LEFT before it, and a
    session ends only at a JOINED that comes later than the grace time after the latest matched
    LEFT. So sessions and segments are numbered by running windows; no row-by-row fold is needed
    and a hot user or stream splits like every other running state.
    """
    t = F.col("event_type")
    keep = ["event_id", "user_id", "content_id", "creator_id", "category", "event_type", "watch_time_seconds", "ts_us"]
    slim = rows.select(*keep, *[c.cast("long").alias(n) for n, c in live_signals().items()])
    heavy, tasks = load(slim, ["user_id"], "ts_us", heavy_rows)
    same_id = Window.partitionBy("user_id", "content_id", "event_id").orderBy("ts_us")
    # Without a hot user one exchange serves the copies and the states; with one, copies are found by their own key.
    dealt = dealt_by(slim, tasks, "user_id") if heavy is None else slim
    first = dealt.withColumn("_dup", F.row_number().over(same_id)).where("_dup = 1").drop("_dup")
    kw = {"heavy": heavy, "heavy_rows": heavy_rows, "co_partitioned": heavy is None, "tasks": tasks}

    def step(df: DataFrame, **fam) -> DataFrame:
        return prior_state(df, ["user_id"], "ts_us", [Family(keys=["content_id"], ordered=True, **fam)], **kw)

    joined, left = t == "LIVE_JOINED", t == "LIVE_LEFT"
    a = step(first, lasts={"_open": F.when(joined, 1).when(left, 0)})
    is_open = F.coalesce(F.col("_open") == 1, F.lit(False))
    a = a.withColumns({"_open": is_open, "_opens": joined & ~is_open, "_closes": left & is_open})
    b = step(a, sums={"_seg": F.col("_opens").cast("long")}, lasts={"_closed_us": F.when(F.col("_closes"), F.col("ts_us"))})
    late = F.coalesce(F.col("ts_us") - F.col("_closed_us") > grace_us, F.lit(False))
    b = b.withColumns({
        "_seg": F.col("_seg") + F.col("_opens").cast("long"),
        "_new": F.col("_opens") & late,
        "_reconnect": F.col("_opens") & F.col("_closed_us").isNotNull() & ~late,
    })
    c = step(b, sums={"_sess": F.col("_new").cast("long")})
    c = c.withColumn("_sess", F.col("_sess") + F.col("_new").cast("long"))

    watch_us = F.round(F.col("watch_time_seconds") * 1_000_000).cast("long")
    watched = (t == "LIVE_WATCHED") & F.col("watch_time_seconds").isNotNull()
    at = F.struct("ts_us", "event_id")
    either = joined | left
    segments = c.groupBy("user_id", "content_id", "_sess", "_seg").agg(
        F.min("ts_us").alias("ts_us"), F.max("ts_us").alias("_last_us"), F.min(at).alias("_first"),
        F.min_by("creator_id", at).alias("creator_id"), F.min_by("category", at).alias("category"),
        F.max((joined | watched).cast("int")).alias("joined"), F.max((t == "LIVE_IMPRESSION").cast("int")).alias("impression"),
        F.min(F.when(F.col("_opens"), F.col("ts_us"))).alias("_open_us"),
        F.max(F.when(watched & F.col("_open"), watch_us)).alias("_pending"),
        F.max(F.when(watched & ~F.col("_open"), watch_us)).alias("_gap"),
        F.min(F.when(F.col("_closes"), F.col("ts_us"))).alias("_close_us"),
        F.min(F.when(F.col("_closes"), watch_us)).alias("_explicit"),
        F.max((left & ~F.col("_open")).cast("int")).alias("_unmatched"),
        F.max(F.when(either, F.struct("ts_us", "event_id", joined.alias("j")))).alias("_last_jl"),
        F.sum(F.col("_reconnect").cast("long")).alias("reconnect_count"),
        *[F.sum(n).alias(n) for n in _COUNTS],
    )
    stay = F.coalesce(F.col("_explicit"), F.greatest(F.coalesce("_pending", F.lit(0)), F.col("_close_us") - F.col("_open_us")))
    segments = segments.withColumn("_stay", F.when(F.col("_close_us").isNotNull(), stay).otherwise(0))
    # total after a segment = max(total + stay, largest reading taken while no segment is open)
    fam = Family(keys=["content_id", "_sess"], ordered=True, sums={"_before": F.col("_stay")})
    seg = prior_state(segments, ["user_id"], "ts_us", [fam], tie_break=["_seg"], heavy=heavy, heavy_rows=heavy_rows,
                      co_partitioned=heavy is None, tasks=tasks)
    over = F.max(F.when(F.col("_gap").isNotNull(), F.col("_gap") - F.col("_before") - F.col("_stay")))
    s = seg.groupBy("user_id", "content_id", "_sess").agg(
        F.min_by("creator_id", "_first").alias("creator_id"), F.min_by("category", "_first").alias("category"),
        F.min("ts_us").alias("joined_us"), F.max("_last_us").alias("ended_us"), F.max("joined").alias("joined"),
        F.max("impression").alias("impression"),
        (F.sum("_stay") + F.greatest(F.coalesce(over, F.lit(0)), F.lit(0))).alias("watch_us"),
        F.sum("reconnect_count").alias("reconnect_count"), *[F.sum(n).alias(n) for n in _COUNTS],
        F.max("_unmatched").alias("_unmatched"), F.max("_last_jl").alias("_last_jl"),
    )
    return s.withColumns({
        "joined": F.col("joined") == 1, "impression": F.col("impression") == 1,
        "exclusion_reason": F.when(F.col("_unmatched") == 1, "UNMATCHED_LEFT").when(F.col("_last_jl.j"), "OPEN_ENDED"),
    }).withColumnRenamed("_sess", "session_no").drop("_unmatched", "_last_jl")


def positive_action() -> Column:
    return F.greatest(*[F.col(n) for n in _COUNTS[:5]]) > 0


def session_target() -> Column:
    stay = F.col("watch_us")
    return (
        F.when(F.col("not_interested_count") > 0, 0)
        .when(positive_action(), 1)
        .when(F.col("exclusion_reason").isNotNull(), None)
        .when(F.col("joined") & (stay >= MEANINGFUL_STAY_US), 1)
        .when((F.col("impression") & ~F.col("joined")) | (F.col("joined") & (stay < SHORT_STAY_US)), 0)
    )


def session_history(sessions: DataFrame, *, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Every session with what the user's sessions that ended strictly earlier add up to.

    Rows with ``contributes = false`` (probes) read the history without entering it.
    """
    s = sessions if "contributes" in sessions.columns else sessions.withColumn("contributes", F.lit(True))
    own = lambda c: F.when(F.col("contributes"), c)
    one, stay = own(F.lit(1)), own(F.col("watch_us"))
    s = s.withColumns({"at_us": F.col("ended_us"), "m_n": one, "m_w": stay, "_expiry": F.lit(False)})
    expiry = s.where("contributes").select(
        "user_id", "category", (F.col("ended_us") + WEEK_US).alias("at_us"), (-F.col("m_n")).alias("x_n"),
        (-F.col("m_w")).alias("x_w"), F.lit(True).alias("_expiry"), F.lit(False).alias("contributes"))
    stream = s.withColumns({"x_n": F.col("m_n"), "x_w": F.col("m_w")}).unionByName(expiry, allowMissingColumns=True)
    n, w, pos = F.col("m_n"), F.col("m_w"), own(positive_action().cast("long"))
    families = [
        Family(sums={"u_n": n, "u_w": w, "recent_n": F.col("x_n"), "recent_w": F.col("x_w")}),
        Family(keys=["category"], sums={
            "c_n": n, "c_w": w, "c_joined": own(F.col("joined").cast("long")), "c_pos": pos, "c_recent": F.col("x_n")}),
        Family(keys=["creator_id"], sums={
            "k_n": n, "k_w": w, "k_pos": pos, "k_follow": own((F.col("creator_follow_count") > 0).cast("long"))}),
    ]
    out = prior_state(stream, ["user_id"], "at_us", families, heavy_rows=heavy_rows).where(~F.col("_expiry"))
    sec = lambda c: F.col(c) / 1e6
    mean = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b) / 1e6)
    return out.withColumns({
        "previous_live_interaction_count_user": F.col("u_n"), "previous_live_watch_time_user": sec("u_w"),
        "average_live_watch_time": mean("u_w", "u_n"),
        "previous_live_category_interaction_count": F.col("c_n"), "previous_live_category_watch_time": sec("c_w"),
        "average_live_watch_time_in_category": mean("c_w", "c_n"),
        "category_join_rate": F.when(F.col("c_n") > 0, F.round(F.col("c_joined") / F.col("c_n"), 6)),
        "category_positive_engagement_count": F.col("c_pos"),
        "previous_creator_live_interaction_count": F.col("k_n"), "previous_creator_live_watch_time": sec("k_w"),
        "average_creator_live_watch_time": mean("k_w", "k_n"), "creator_positive_engagement_count": F.col("k_pos"),
        "creator_followed": F.col("k_follow") > 0, "recent_live_interaction_count": F.col("recent_n"),
        "recent_live_watch_time": sec("recent_w"), "recent_category_live_activity": F.col("c_recent"),
    })


def category_affinity_from(n: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 + n * 0.04)


def creator_affinity_from(n: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 + n * 0.05)


def session_snapshot(history: DataFrame, bootstrap: DataFrame | None = None) -> DataFrame:
    """LIVE affinities from the history; VIDEO bootstrap values stand in where the LIVE count is 0.

    ``bootstrap`` has (user_id, kind, key, affinity) rows, kind being category or creator.
    """
    out = history.withColumns({
        "live_category_affinity": category_affinity_from(F.col("previous_live_category_interaction_count")),
        "creator_affinity": creator_affinity_from(F.col("previous_creator_live_interaction_count")),
        "average_live_watch_time_for_category": F.col("c_w") / F.greatest(F.lit(1), F.col("c_n")) / 1e6,
        "recent_live_category_activity": F.col("recent_category_live_activity"),
        "previous_live_interaction_count": F.col("previous_creator_live_interaction_count"),
        "previous_live_watch_time": F.col("previous_creator_live_watch_time"),
    })
    if bootstrap is None:
        return out
    for kind, key, col, n in (("category", "category", "live_category_affinity", "c_n"), ("creator", "creator_id", "creator_affinity", "k_n")):
        b = bootstrap.where(F.col("kind") == kind).select("user_id", F.col("key").alias(key), F.col("affinity").alias("_boot"))
        out = out.join(b, ["user_id", key], "left")
        out = out.withColumn(col, F.when((F.col(n) == 0) & F.col("_boot").isNotNull(), F.col("_boot")).otherwise(F.col(col))).drop("_boot")
    return out


def live_dataset(rows: DataFrame, **kw) -> DataFrame:
    """Labelled sessions with the LIVE feature row; neutral sessions update history only."""
    grace = kw.pop("grace_us", RECONNECT_GRACE_US)
    sessions = cut_lineage(live_sessions(rows, grace_us=grace, **kw))
    s = session_snapshot(session_history(sessions.withColumn("target", session_target()), **kw)).where("target is not null")
    end = F.timestamp_micros("ended_us")
    zero = {c: F.lit(0) for c in ("current_viewer_count", "region_match", "language_match", "already_joined")}
    zero |= {c: F.lit(0.0) for c in ("viewer_growth_rate", "live_age_minutes")}
    s = s.withColumns({
        "category": F.upper(F.coalesce("category", F.lit("UNKNOWN"))), "region": F.lit("unknown"), "language": F.lit("unknown"),
        "creator_followed": F.col("creator_followed").cast("int"), "hour_of_day": F.hour(end),
        "candidate_group": F.concat_ws(":", "user_id", F.date_format(end, "yyyy-MM-dd")), **zero,
    })
    return s.select(*LIVE_FEATURES, "target", "user_id", "content_id", "creator_id", "candidate_group", F.col("ended_us").alias("ts_us"))


def live_feature_row(c: DataFrame, now_us: int) -> DataFrame:
    """The serving-time LIVE feature row of joined candidate and history columns."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(x)))
    return c.withColumns({
        "category": F.upper("category"), "region": F.lower("region"), "language": F.lower("language"),
        "live_category_affinity": unit("live_category_affinity"), "creator_affinity": unit("creator_affinity"),
        "creator_followed": F.col("creator_followed").cast("int"), "region_match": F.col("region_match").cast("int"),
        "language_match": F.col("language_match").cast("int"), "already_joined": F.col("already_joined").cast("int"),
        "hour_of_day": F.hour(F.timestamp_micros(F.lit(now_us))),
        **{n: scalars.sanitize(n) for n in ("previous_live_watch_time", "average_live_watch_time_for_category", "viewer_growth_rate", "live_age_minutes")},
    })


def dynamic_state(
    rows: DataFrame, now_us: int, *, stale_us: int = VIEWER_STALE_US, window_us: int = DYNAMIC_WINDOW_US
) -> DataFrame:
    """Viewers, growth, likes and gifts of every stream at ``now``; two aggregations, users first."""
    now, t, us = F.lit(now_us), F.col("event_type"), F.col("ts_us")
    near = rows.where(us.between(now_us - max(stale_us, window_us), now_us))
    inside, half = us >= now_us - window_us, us >= now_us - window_us // 2
    presence = t.isin("LIVE_JOINED", "LIVE_WATCHED")
    hit = lambda c: F.max((c & inside).cast("int"))
    users = near.groupBy("content_id", "user_id").agg(
        F.max(F.when(presence | (t == "LIVE_LEFT"), F.struct("ts_us", "id", presence.alias("on")))).alias("_p"),
        hit((t == "LIVE_JOINED") & half).alias("_late"), hit((t == "LIVE_JOINED") & ~half).alias("_early"),
        F.sum(((F.coalesce("liked", F.lit(False)) | (t == "LIVE_LIKED")) & inside).cast("long")).alias("_likes"),
        F.sum(((t == "LIVE_GIFT_SENT") & inside).cast("long")).alias("_gifts"),
    )
    seen = F.col("_p.on") & (F.col("_p.ts_us") >= now - stale_us)
    s = users.groupBy("content_id").agg(
        F.sum(F.coalesce(seen, F.lit(False)).cast("long")).alias("current_viewer_count"), F.sum("_late").alias("_late"),
        F.sum("_early").alias("_early"), F.sum("_likes").alias("recent_likes"), F.sum("_gifts").alias("recent_gifts"))
    growth = (F.col("_late") - F.col("_early")) / F.greatest(F.lit(1), F.col("_early"))
    return s.withColumn("viewer_growth_rate", F.greatest(F.lit(-1.0), F.least(F.lit(10.0), growth))).drop("_late", "_early")


def newest_distinct(rows: DataFrame, key: str, limit: int, *, history: int | None = None) -> DataFrame:
    """Per user the ``limit`` most recent distinct values of ``key`` among the newest ``history`` rows (None: all)."""
    recent = rows if history is None else top_n(rows, ["user_id"], [F.desc("ts_us"), F.desc("id")], history)
    latest = recent.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy("user_id", key).agg(F.max(F.struct("ts_us", "id")).alias("_last"))
    return top_n(latest, ["user_id"], [F.desc("_last")], limit, rank="position").drop("_last")


def followed_creators(rows: DataFrame, limit: int = 10) -> DataFrame:
    return newest_distinct(rows.where(F.coalesce("creator_followed", F.lit(False))), "creator_id", limit)


def not_interested_streams(rows: DataFrame, limit: int = 50) -> DataFrame:
    return newest_distinct(rows.where(F.col("event_type") == "LIVE_NOT_INTERESTED"), "content_id", limit)


def recent_positive(rows: DataFrame, key: str, limit: int = 10, *, history: int | None = None) -> DataFrame:
    """Distinct creators or categories of positive VIDEO rows within the newest rows of each user."""
    recent = rows if history is None else top_n(rows, ["user_id"], [F.desc("ts_us"), F.desc("id")], history)
    positive = recent.where((F.col("content_type") != "LIVE") & (signals.target() == 1))
    if key == "category":
        positive = positive.withColumn("category", F.upper("category"))
    return newest_distinct(positive, key, limit, history=history)


def top_live_categories(sessions: DataFrame, limit: int) -> DataFrame:
    n = sessions.where(F.coalesce("category", F.lit("")) != "").groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("sessions"))
    return top_n(n, ["user_id"], [F.desc("sessions"), F.asc("category")], limit, rank="position")


def followed_live_creators(sessions: DataFrame) -> DataFrame:
    return sessions.where((F.col("creator_follow_count") > 0) & (F.coalesce("creator_id", F.lit("")) != "")).select("user_id", "creator_id").distinct()


def ranked_list(df: DataFrame, value: str, name: str) -> DataFrame:
    """(user, value, position) rows, at most a fixed number per user, as one ordered array per user."""
    pairs = F.array_sort(F.collect_list(F.struct("position", value)))
    return df.groupBy("user_id").agg(F.transform(pairs, lambda s: s[value]).alias(name))


def preferred_categories(interests: DataFrame, live: DataFrame, video: DataFrame, limit: int = 10) -> DataFrame:
    """Interests, then LIVE history, then recent VIDEO categories: normalized, ordered distinct, cut."""
    empty = F.array().cast("array<string>")
    j = (
        interests.select("user_id", "interests")
        .join(ranked_list(live, "category", "_live"), "user_id", "full_outer")
        .join(ranked_list(video, "category", "_video"), "user_id", "full_outer")
    )
    chained = F.concat(*[F.coalesce(c, empty) for c in ("interests", "_live", "_video")])
    kept = F.filter(tokens.normalize_tokens(chained), lambda t: t != "")
    return j.select("user_id", F.slice(kept, 1, limit).alias("categories"))


def evidence_counts(recent_rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """LIVE sessions of the user, or VIDEO rows where there are none."""
    video = recent_rows.groupBy("user_id").agg(F.sum((F.col("content_type") != "LIVE").cast("long")).alias("_v"))
    live = sessions.groupBy("user_id").agg(F.count(F.lit(1)).alias("_l"))
    n = F.when(F.col("_l") > 0, F.col("_l")).otherwise(F.coalesce("_v", F.lit(0)))
    return video.join(live, "user_id", "full_outer").select("user_id", n.alias("evidence"), scalars.strategy(n).alias("strategy"))
