"""Strictly point-in-time features of every (user, item, time) row.

A row at time T sees only events with ``ts < T``. State lives in window frames, not in mutable
accumulators: replay numbering and token state first, then one exchange by user under which the
category, creator, content, user and session windows all run. A thirty-day trailing sum is a
running sum to which every event also sends its negative thirty days later, so it needs no
second frame and stays exact (all weights are integers in tenths, watch percentages in 1e-4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars, signals, tokens
from ..session import cut_lineage
from .profiles import with_replay_weight
from .running import HEAVY_ROWS, Family, add_slice, dealt_by, load, prior_state, slice_of

RECENT_US = 30 * 86_400_000_000
SESSION_US = 30 * 60_000_000
SESSION_EVENTS = 12
SESSION_HALF_LIFE_MIN = 5.0
REJECTION_HALF_LIFE_DAYS = 30.0
CONFIDENCE_SATURATION = 4.0
DAY_US = 86_400_000_000

CATEGORICAL = ["category"]
# Fixed order: the model's numeric input.
NUMERIC = [
    "category_affinity", "recent_category_affinity", "average_category_watch_percentage",
    "recent_category_watch_percentage", "category_completion_rate", "recent_category_completion_rate",
    "category_positive_count", "category_negative_count", "has_creator_history", "creator_interaction_count",
    "creator_completion_rate", "creator_followed", "hashtag_affinity", "topic_affinity", "entity_affinity",
    "subgenre_affinity", "title_affinity", "semantic_positive_match_count", "semantic_negative_match_count",
    "has_semantic_history", "strongest_semantic_affinity", "average_semantic_affinity",
    "user_total_interaction_count", "content_popularity_score", "content_age_hours", "already_seen", "hour_of_day",
    "session_category_affinity", "session_positive_interaction_count", "session_negative_interaction_count",
    "session_category_streak_valence_matched", "last_interaction_category_match", "session_intent_confidence",
]
FEATURES = CATEGORICAL + NUMERIC
DIAGNOSTICS = [
    "has_category_history", "category_interaction_count", "days_since_last_category_interaction",
    "has_session_activity", "session_average_watch_percentage", "session_category_streak",
    "session_category_streak_valence", "session_category_streak_valence_unmatched",
    "category_explicit_rejection_count", "recent_explicit_rejection_strength",
    "semantic_explicit_rejection_match_count", "candidate_negative_semantic_match",
    "category_positive_minus_negative", "semantic_positive_minus_negative",
]
_ROW = ["event_id", "user_id", "content_id", "creator_id", "category", "event_type", "ts_us", "emit", "contributes"]


def log1p_tenths(c: str) -> Column:
    return F.log1p(F.col(c) / 10)


def prepare(rows: DataFrame, contents: DataFrame, heavy: DataFrame | None, heavy_rows: int, tasks: int | None = None) -> DataFrame:
    """Signals, replay weight and content context of every row. Rows with ``contributes = false``
    (probes) leave no trace in anyone's state; rows with ``emit = false`` are dropped at the end."""
    base = rows.withColumns({
        "emit": F.col("emit") if "emit" in rows.columns else F.lit(True),
        "contributes": F.col("contributes") if "contributes" in rows.columns else F.lit(True),
        "category": F.upper("category"),
    })
    a = signals.annotate(base)
    a = a.withColumns({
        "controlled": F.col("controlled") & F.col("contributes"),
        "session_label": signals.session_label(), "session_delta": signals.session_delta(),
    })
    dim = contents.select(
        "content_id", "popularity_score", "created_us", tokens.token_fields().alias("_tokens"))
    joined = a.join(dim, "content_id", "left")
    return with_replay_weight(joined, heavy=heavy, heavy_rows=heavy_rows, tasks=tasks)


def token_state(prepared: DataFrame, heavy: DataFrame | None, heavy_rows: int, tasks: int | None = None) -> DataFrame:
    """Per (row, field, token): what the user's earlier rows with that token add up to."""
    w, on = F.col("w10"), F.col("contributes")
    exploded = prepared.select(
        "user_id", "event_id", "ts_us", "contributes", "rejected", "target", "base_delta", "w10",
        F.explode("_tokens").alias("_t"),
    ).select("*", "_t.field", "_t.pos", "_t.token").drop("_t")
    own = lambda c: F.when(on, c)
    delta = F.when(F.col("rejected"), F.lit(-10 * signals.TOKEN_REJECTION_PENALTY)).otherwise(F.col("base_delta") * w)
    pos, neg = F.when(F.col("target") == 1, w).otherwise(0), F.when(F.col("target") == 0, w).otherwise(0)
    earlier = Family(keys=["field", "token"], sums={
        "t_raw": own(delta), "t_pos": own(pos), "t_neg": own(neg), "t_w": own(w),
        "t_rej": own(F.col("rejected").cast("long")),
    })
    processed = Family(keys=["field", "token"], ordered=True, sums={"o_pos": own(pos), "o_neg": own(neg), "o_w": own(w)})
    return prior_state(exploded, ["user_id"], "ts_us", [earlier, processed], heavy=heavy, heavy_rows=heavy_rows, tasks=tasks)


def _mean(affinities: Column) -> Column:
    """Mean of six-digit affinities over an exact integer sum, so row order cannot change it."""
    millionths = F.sum(F.round(affinities * 1_000_000).cast("long")).cast("double")
    return F.coalesce(millionths / (F.count(affinities) * 1_000_000), F.lit(0.5))


def semantic_features(token_rows: DataFrame) -> DataFrame:
    """Token state folded back to one row per event, with the repeat-rejection flag."""
    aff = scalars.affinity(F.col("t_raw") / 10)
    t = token_rows.withColumn("aff", F.when(F.col("t_w") > 0, aff))
    hit = F.col("aff").isNotNull()
    n = lambda c: F.sum((hit & c).cast("long"))
    per_field = [_mean(F.when(F.col("field") == f, F.col("aff"))).alias(f"{f}_affinity") for f in tokens.FIELDS]
    strength = F.greatest(F.lit(0.0), (0.5 - F.col("aff")) * 2)
    return t.groupBy("user_id", "event_id").agg(
        *per_field,
        n(F.col("t_pos") > F.col("t_neg")).alias("semantic_positive_match_count"),
        n(F.col("t_neg") > F.col("t_pos")).alias("semantic_negative_match_count"),
        F.max(hit.cast("int")).alias("has_semantic_history"),
        F.coalesce(
            F.max_by("aff", F.when(hit, F.struct(F.abs(F.col("aff") - 0.5), -F.col("pos")))), F.lit(0.5)
        ).alias("strongest_semantic_affinity"),
        _mean(F.col("aff")).alias("average_semantic_affinity"),
        n(F.col("t_rej") > 0).alias("semantic_explicit_rejection_match_count"),
        F.coalesce(F.max(F.when(hit & (F.col("t_rej") > 0), strength)), F.lit(0.0)).alias("candidate_negative_semantic_match"),
        F.max((F.col("rejected") & (F.col("o_w") > 0) & (F.col("o_neg") > F.col("o_pos"))).cast("int")).alias("repeat_rejection"),
    )


SEMANTIC_DEFAULTS = {
    **{f"{f}_affinity": 0.5 for f in tokens.FIELDS}, "semantic_positive_match_count": 0,
    "semantic_negative_match_count": 0, "has_semantic_history": 0, "strongest_semantic_affinity": 0.5,
    "average_semantic_affinity": 0.5, "semantic_explicit_rejection_match_count": 0,
    "candidate_negative_semantic_match": 0.0, "repeat_rejection": 0,
}


def history_features(rows: DataFrame, heavy: DataFrame | None, heavy_rows: int, tasks: int | None = None) -> DataFrame:
    """Category, creator, content and user history of every row (columns of ``rows`` kept)."""
    w, on = F.col("w10"), F.col("contributes")
    watched = F.col("watch_percentage").isNotNull()
    delta = F.when(
        F.col("rejected"),
        F.when(F.col("repeat_rejection") == 1, -10 * signals.REPEAT_REJECTION_PENALTY)
        .otherwise(-10 * signals.EXPLICIT_REJECTION_PENALTY),
    ).otherwise(F.col("base_delta") * w)
    done, fixed_wp = F.col("completed").cast("long"), F.round(F.col("watch_percentage") * 10000).cast("long")
    own = lambda c: F.when(on, c)
    measured = rows.withColumns({
        "m_delta": own(delta), "m_w": own(w), "m_ww": own(F.when(watched, w)), "m_ws": own(F.when(watched, w * fixed_wp)),
        "m_done": own(w * done), "m_wdone": own(F.when(watched, w * done)),
    })
    # The same recent measures with the opposite sign, due just after they leave the trailing window.
    expiry = measured.where(on).select(
        "user_id", "category", (F.col("ts_us") + RECENT_US).alias("ts_us"), F.concat(F.lit("~"), "event_id").alias("event_id"),
        *[(-F.col(m)).alias(f"x_{m}") for m in ("m_delta", "m_ww", "m_ws", "m_wdone")], F.lit(True).alias("_expiry"),
    )
    recent = {f"x_{m}": F.col(m) for m in ("m_delta", "m_ww", "m_ws", "m_wdone")}
    stream = measured.withColumns(recent).withColumn("_expiry", F.lit(False)).unionByName(expiry, allowMissingColumns=True)
    c = F.col
    families = [
        Family(
            keys=["category"],
            sums={
                "c_raw": c("m_delta"), "c_w": c("m_w"), "c_ww": c("m_ww"), "c_ws": c("m_ws"), "c_done": c("m_done"),
                "c_pos": F.when(c("target") == 1, c("m_w")), "c_neg": F.when(c("target") == 0, c("m_w")),
                "c_rej": own(c("rejected").cast("long")),
                "r_raw": c("x_m_delta"), "r_ww": c("x_m_ww"), "r_ws": c("x_m_ws"), "r_done": c("x_m_wdone"),
            },
            maxs={"c_last": own(c("ts_us")), "c_last_rej": F.when(on & c("rejected"), c("ts_us"))},
        ),
        Family(keys=["creator_id"], sums={
            "k_w": c("m_w"), "k_done": c("m_done"), "k_follow": own(c("sig_followed").cast("long"))}),
        Family(keys=["content_id"], sums={"s_n": own(F.lit(1))}),
        Family(sums={"u_w": c("m_w")}),
    ]
    out = prior_state(stream, ["user_id"], "ts_us", families, heavy=heavy, heavy_rows=heavy_rows, tasks=tasks)
    ratio = scalars.ratio_or_zero
    now = F.col("ts_us")
    return out.where(~c("_expiry")).withColumns({
        "category_affinity": scalars.affinity(c("c_raw") / 10),
        "recent_category_affinity": scalars.affinity(c("r_raw") / 10),
        "has_category_history": (c("c_w") > 0).cast("int"),
        "average_category_watch_percentage": ratio(c("c_ws") / 10000, c("c_ww")),
        "recent_category_watch_percentage": ratio(c("r_ws") / 10000, c("r_ww")),
        "category_completion_rate": ratio(c("c_done"), c("c_ww")),
        "recent_category_completion_rate": ratio(c("r_done"), c("r_ww")),
        "category_positive_count": log1p_tenths("c_pos"),
        "category_negative_count": log1p_tenths("c_neg"),
        "category_interaction_count": log1p_tenths("c_w"),
        "days_since_last_category_interaction": F.when(
            c("c_last").isNotNull(), F.least(F.lit(365.0), (now - c("c_last")) / float(DAY_US))).otherwise(0.0),
        "has_creator_history": (c("k_w") > 0).cast("int"),
        "creator_interaction_count": log1p_tenths("k_w"),
        "creator_completion_rate": ratio(c("k_done"), c("k_w")),
        "creator_followed": (c("k_follow") > 0).cast("int"),
        "already_seen": (c("s_n") > 0).cast("int"),
        "user_total_interaction_count": log1p_tenths("u_w"),
        "category_explicit_rejection_count": F.log1p(c("c_rej")),
        "recent_explicit_rejection_strength": F.coalesce(
            scalars.half_life_decay((now - c("c_last_rej")) / float(DAY_US), REJECTION_HALF_LIFE_DAYS), F.lit(0.0)),
        "content_popularity_score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c("popularity_score"), F.lit(0.5)))),
        "content_age_hours": scalars.age_hours(F.coalesce(c("created_us"), now), now),
        "hour_of_day": F.hour(F.timestamp_micros(now)),
    })


def session_window(rows: DataFrame, heavy: DataFrame | None, heavy_rows: int, *, co_partitioned: bool = False, tasks: int | None = None) -> DataFrame:
    """Add ``_session``: the last twelve earlier events of the user within thirty minutes, oldest first.

    The frame spans at most the twelve latest distinct timestamps, of each at most its last twelve
    rows, so its size is fixed. A hot user's slices receive copies of the rows of the preceding
    thirty minutes as context.
    """
    work = add_slice(rows, ["user_id"], "ts_us", heavy)
    if heavy is None:
        part = ["user_id"]
        work = work.withColumn("_context", F.lit(False))
        work = work if co_partitioned else dealt_by(work, tasks, "user_id")
    else:
        part = ["user_id", "_b"]
        reach = slice_of(F.col("ts_us") + SESSION_US)
        last = F.when(F.col("contributes"), F.greatest(F.col("_b"), reach)).otherwise(F.col("_b"))
        work = work.withColumn("_to", F.explode(F.sequence(F.col("_b"), last)))
        work = work.withColumn("_context", F.col("_to") != F.col("_b")).withColumn("_b", F.col("_to")).drop("_to")
        work = dealt_by(work, tasks, *part)
    event = F.struct("ts_us", "event_id", "category", "session_delta", "session_label", "watch_percentage", "w10")
    tail = F.row_number().over(Window.partitionBy(*part, "ts_us", "contributes").orderBy(F.desc("event_id")))
    step = F.dense_rank().over(Window.partitionBy(*part).orderBy("ts_us"))
    kept = F.when(F.col("contributes") & (F.col("_tail") <= SESSION_EVENTS), event)
    # Steps count distinct timestamps of contributing rows only, so probes never push events out.
    frame = Window.partitionBy(*part).orderBy("_step").rangeBetween(-SESSION_EVENTS, -1)
    work = work.withColumn("_tail", tail).withColumn("_step", step)
    work = work.withColumn("_near", F.collect_list(kept).over(frame)).where(~F.col("_context"))
    now = F.col("ts_us")
    near = F.array_sort(F.filter("_near", lambda e: now - e["ts_us"] <= SESSION_US))
    last12 = F.slice(near, F.greatest(F.size(near) - (SESSION_EVENTS - 1), F.lit(1)), SESSION_EVENTS)
    return work.withColumn("_session", last12).drop("_near", "_tail", "_step", "_context", "_b", "_bounds")


def session_features(rows: DataFrame, category: str = "category", prefix: str = "") -> DataFrame:
    """Session features of ``_session`` for the row's own category (or another column)."""
    now, cat = F.col("ts_us"), F.col(category)
    zero = F.lit(0.0)

    def w(e: Column) -> Column:
        return e["w10"] / 10

    def eff(e: Column) -> Column:
        return scalars.half_life_decay((now - e["ts_us"]) / 6.0e7, SESSION_HALF_LIFE_MIN) * w(e)

    def total(arr, fn) -> Column:
        return F.aggregate(arr, zero, lambda acc, e: acc + fn(e))

    own = F.filter("_session", lambda e: e["category"] == cat)
    watched = F.filter("_session", lambda e: e["watch_percentage"].isNotNull())
    sign = lambda e: F.when(e["session_label"] == 1, 1).when(e["session_label"] == 0, -1).otherwise(0)
    magnitude = lambda e: F.abs(e["session_delta"]) + F.when(e["session_label"].isNotNull(), 1.0).otherwise(0.0)

    latest = F.try_element_at(F.col("_session"), F.lit(-1))
    run_start = F.struct(F.lit(True).alias("on"), zero.alias("w"))

    def run(same) -> Column:
        def step(acc: Column, e: Column) -> Column:
            on = acc["on"] & same(e)
            return F.struct(on.alias("on"), F.when(on, acc["w"] + w(e)).otherwise(acc["w"]).alias("w"))

        return F.aggregate(F.reverse("_session"), run_start, step, lambda acc: acc["w"])

    last_sign = F.when(latest["session_label"] == 1, 1).when(latest["session_label"] == 0, -1).otherwise(0)
    out = rows.withColumns({
        "_own": own, "_last_cat": latest["category"],
        f"{prefix}session_category_streak": run(lambda e: e["category"] == latest["category"]),
        f"{prefix}session_category_streak_valence": F.when(
            F.coalesce(last_sign, F.lit(0)) == 0, 0.0
        ).otherwise(last_sign * run(lambda e: (e["category"] == latest["category"]) & e["session_label"].eqNullSafe(latest["session_label"]))),
        "_ww": total(watched, eff), "_ws": total(watched, lambda e: eff(e) * e["watch_percentage"]),
    })
    out = out.withColumns({
        "_evidence": total(F.col("_own"), lambda e: eff(e) * magnitude(e)),
        "_signed": total(F.col("_own"), lambda e: eff(e) * magnitude(e) * sign(e)),
        f"{prefix}session_category_affinity": scalars.affinity(total(F.col("_own"), lambda e: eff(e) * e["session_delta"])),
        f"{prefix}session_positive_interaction_count": F.log1p(
            total(F.filter("_own", lambda e: e["session_label"] == 1), w)),
        f"{prefix}session_negative_interaction_count": F.log1p(
            total(F.filter("_own", lambda e: e["session_label"] == 0), w)),
        f"{prefix}has_session_activity": (F.size("_session") > 0).cast("int"),
        f"{prefix}session_average_watch_percentage": scalars.ratio_or_zero(F.col("_ws"), F.col("_ww")),
        f"{prefix}last_interaction_category_match": F.coalesce((F.col("_last_cat") == cat).cast("int"), F.lit(0)),
    })
    match, val = F.col(f"{prefix}last_interaction_category_match") == 1, F.col(f"{prefix}session_category_streak_valence")
    return out.withColumns({
        f"{prefix}session_intent_confidence": F.least(F.lit(1.0), F.col("_evidence") / CONFIDENCE_SATURATION)
        * scalars.ratio_or_zero(F.abs("_signed"), F.col("_evidence")),
        f"{prefix}session_category_streak_valence_matched": F.when(match, val).otherwise(0.0),
        f"{prefix}session_category_streak_valence_unmatched": F.when(match, 0.0).otherwise(val),
    }).drop("_own", "_last_cat", "_ww", "_ws", "_evidence", "_signed")


def feature_rows(rows: DataFrame, contents: DataFrame, *, heavy_rows: int = HEAVY_ROWS, cut: bool = True) -> DataFrame:
    """All features of every emitted row, with the row's identity, label and signals."""
    slim = rows.drop("content_type", "id", "content_duration_seconds", "watch_time_seconds", "content_pending")
    heavy, tasks = load(slim, ["user_id"], "ts_us", heavy_rows)
    prepared = prepare(slim, contents, heavy, heavy_rows, tasks)
    if cut:
        prepared = cut_lineage(prepared)
    semantic = semantic_features(token_state(prepared, heavy, heavy_rows, tasks))
    bare = prepared.drop("_tokens")
    # The other side of the join follows the greater number of tasks.
    bare = bare if tasks is None else bare.repartition(tasks, "user_id", "event_id")
    joined = bare.join(semantic, ["user_id", "event_id"], "left").fillna(SEMANTIC_DEFAULTS)
    hist = history_features(joined, heavy, heavy_rows, tasks)
    full = session_features(session_window(hist, heavy, heavy_rows, co_partitioned=heavy is None, tasks=tasks))
    return full.where("emit").withColumns({
        "category_positive_minus_negative": F.col("category_positive_count") - F.col("category_negative_count"),
        "semantic_positive_minus_negative": F.col("semantic_positive_match_count") - F.col("semantic_negative_match_count"),
    })


def training_dataset(rows: DataFrame, contents: DataFrame, **kw) -> DataFrame:
    """Labelled, non-context rows with features, metadata and the user-day candidate group."""
    keep = F.when(F.col("is_training_context_only"), False).otherwise(signals.target().isNotNull())
    f = feature_rows(rows.withColumn("emit", keep), contents, **kw)
    return f.select(
        "event_id", *FEATURES, *DIAGNOSTICS, "target", "user_id", "creator_id", "content_id",
        F.concat_ws(":", "user_id", F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd")).alias("candidate_group"),
        "ts_us", "event_type", F.col("watch_percentage").alias("event_watch_percentage"),
        F.col("sig_liked").alias("event_liked"), F.col("sig_shared").alias("event_shared"),
        F.col("sig_favorited").alias("event_favorited"), F.col("sig_followed").alias("event_creator_followed"),
        "rejected",
    )


def with_warmup(rows: DataFrame, warmup: DataFrame, contents: DataFrame, **kw) -> DataFrame:
    """Features of ``rows`` with ``warmup`` rows priming the state but not emitted."""
    both = rows.withColumn("emit", F.lit(True)).unionByName(warmup.withColumn("emit", F.lit(False)))
    return feature_rows(both, contents, **kw)


def score_time_features(history: DataFrame, candidates: DataFrame, contents: DataFrame, now_us: int, **kw) -> DataFrame:
    """Features of (user, content) candidates at one moment, from the users' histories.

    Candidates become probe rows that read the state and never write it; only histories of users
    with candidates are read.
    """
    probes = candidates.select(
        F.concat_ws(":", F.lit("probe"), "user_id", "content_id").alias("event_id"), "user_id", "content_id", "creator_id",
        "category", F.lit(now_us).cast("long").alias("ts_us"), F.lit("").alias("event_type"),
        F.lit(True).alias("emit"), F.lit(False).alias("contributes"),
    )
    users = candidates.select("user_id").distinct()
    past = history.where(F.col("ts_us") < now_us).join(users, "user_id", "left_semi")
    rows = past.withColumns({"emit": F.lit(False), "contributes": F.lit(True)}).unionByName(probes, allowMissingColumns=True)
    return feature_rows(rows, contents, **kw)


# --- state at the end of a history, and nested profile snapshots ----------------------------------

def final_state(rows: DataFrame, contents: DataFrame, *, heavy_rows: int = HEAVY_ROWS) -> dict[str, DataFrame]:
    """What a whole history adds up to per key (plain aggregations): category, creator and token tables.

    Recent sums are taken over the thirty days before the user's own last event.
    """
    heavy, tasks = load(rows, ["user_id"], "ts_us", heavy_rows)
    slim = rows.drop("content_type", "id", "content_duration_seconds", "watch_time_seconds", "content_pending")
    prepared = cut_lineage(prepare(slim, contents, heavy, heavy_rows, tasks))
    tstate = token_state(prepared, heavy, heavy_rows, tasks)
    repeat = tstate.groupBy("user_id", "event_id").agg(
        F.max((F.col("rejected") & (F.col("o_w") > 0) & (F.col("o_neg") > F.col("o_pos"))).cast("int")).alias("repeat_rejection"))
    w, c = F.col("w10"), F.col
    j = prepared.drop("_tokens").join(repeat, ["user_id", "event_id"], "left")
    last = prepared.groupBy("user_id").agg(F.max("ts_us").alias("_last"))
    penalty = F.when(F.coalesce("repeat_rejection", F.lit(0)) == 1, -10 * signals.REPEAT_REJECTION_PENALTY).otherwise(-10 * signals.EXPLICIT_REJECTION_PENALTY)
    j = j.withColumn("_d", F.when(c("rejected"), penalty).otherwise(c("base_delta") * w)).join(last, "user_id")
    category = j.groupBy("user_id", "category").agg(
        F.sum("_d").alias("raw10"), F.sum(F.when(c("_last") - c("ts_us") <= RECENT_US, c("_d")).otherwise(0)).alias("recent10"),
        F.sum("w10").alias("w10"), F.sum(F.when(c("target") == 1, w).otherwise(0)).alias("pos10"),
        F.sum(F.when(c("target") == 0, w).otherwise(0)).alias("neg10"), F.max("ts_us").alias("last_us"))
    creator = prepared.groupBy("user_id", "creator_id").agg(
        F.sum("w10").alias("w10"), F.sum(w * c("completed").cast("long")).alias("done10"), F.max(c("sig_followed").cast("int")).alias("followed"))
    token = prepared.select("user_id", "rejected", "base_delta", "target", "w10", F.explode("_tokens").alias("t")).groupBy(
        "user_id", c("t.field").alias("field"), c("t.token").alias("token")).agg(
        F.sum(F.when(c("rejected"), F.lit(-10 * signals.TOKEN_REJECTION_PENALTY)).otherwise(c("base_delta") * w)).alias("raw10"),
        F.sum("w10").alias("w10"), F.sum(F.when(c("target") == 1, w).otherwise(0)).alias("pos10"),
        F.sum(F.when(c("target") == 0, w).otherwise(0)).alias("neg10"), F.sum(c("rejected").cast("long")).alias("rejections"))
    return {"category": category, "creator": creator, "token": token}


def explode_snapshot(profiles: DataFrame) -> dict[str, DataFrame]:
    """Nested profile snapshots as per-category, per-creator, per-token and per-watch-event tables."""
    cats = profiles.select("user_id", F.inline("categories")).withColumn("category", F.upper("category"))
    return {
        "category": cats.drop("recent_watch_events"),
        "watch": cats.select("user_id", "category", F.inline("recent_watch_events")),
        "creator": profiles.select("user_id", F.inline("creators")),
        "token": profiles.select("user_id", F.inline("semantic_affinities")),
        "followed": profiles.select("user_id", F.explode("followed_creator_ids").alias("creator_id")).distinct(),
        "seen": profiles.select("user_id", F.explode("seen_content_ids").alias("content_id")).distinct(),
        "user": profiles.select("user_id", "total_interaction_count"),
    }


def snapshot_violations(profiles: DataFrame) -> DataFrame:
    """(user_id, violation) for counts that exceed their total and for repeated keys."""
    over = lambda arr, f: F.coalesce(F.exists(arr, f), F.lit(False))
    twice = lambda a: F.coalesce(F.size(F.array_distinct(a)) < F.size(a), F.lit(False))
    n = lambda s: s["interaction_count"]
    rules = {
        "CATEGORY_COUNT": over("categories", lambda s: (s["positive_count"] > n(s)) | (s["negative_count"] > n(s)) | (s["completed_count"] > n(s)) | (s["watch_count"] > n(s))),
        "CATEGORY_LABELS": over("categories", lambda s: s["positive_count"] + s["negative_count"] > n(s)),
        "CATEGORY_EXPLICIT": over("categories", lambda s: s["explicit_negative_count"] > s["negative_count"]),
        "CREATOR_COUNT": over("creators", lambda s: s["completed_count"] > n(s)),
        "TOKEN_COUNT": over("semantic_affinities", lambda s: (s["positive_count"] + s["negative_count"] > n(s)) | (s["explicit_negative_count"] > s["negative_count"])),
        "DUPLICATE_CATEGORY": twice(F.transform("categories", lambda s: F.upper(s["category"]))),
        "DUPLICATE_CREATOR": twice(F.transform("creators", lambda s: s["creator_id"])),
        "DUPLICATE_TOKEN": twice(F.transform("semantic_affinities", lambda s: F.struct(s["field"], s["token"]))),
        "DUPLICATE_FOLLOWED": twice(F.col("followed_creator_ids")), "DUPLICATE_SEEN": twice(F.col("seen_content_ids")),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return profiles.select("user_id", F.explode(found).alias("violation"))


def snapshot_features(profiles: DataFrame, candidates: DataFrame, contents: DataFrame, now_us: int) -> DataFrame:
    """Features of (user, content) candidates from nested profile snapshots, same columns as from events."""
    s, now = explode_snapshot(profiles), F.lit(now_us).cast("long")
    us = lambda c: F.unix_micros(c)
    base = candidates.select(
        "user_id", "content_id", "creator_id", F.upper("category").alias("category"), F.concat_ws(":", F.lit("probe"), "user_id", "content_id").alias("event_id"),
        now.alias("ts_us")).join(contents.select("content_id", "popularity_score", "created_us", tokens.token_fields().alias("_tokens")), "content_id", "left")
    t = s["token"]
    long = lambda c: F.coalesce(F.col(c), F.lit(0)) * 10
    tok = base.select("user_id", "event_id", F.explode("_tokens").alias("_t")).select("user_id", "event_id", "_t.*").join(t, ["user_id", "field", "token"], "left").select(
        "user_id", "event_id", "field", "pos", "token", (F.coalesce("raw_affinity_score", F.lit(0.0)) * 10).alias("t_raw"), long("positive_count").alias("t_pos"),
        long("negative_count").alias("t_neg"), long("interaction_count").alias("t_w"), F.coalesce("explicit_negative_count", F.lit(0)).alias("t_rej"),
        F.lit(False).alias("rejected"), F.lit(0).alias("o_w"), F.lit(0).alias("o_neg"), F.lit(0).alias("o_pos"))
    sem = semantic_features(tok)
    watch = s["watch"].withColumn("w_us", us(F.col("timestamp")))
    recent = watch.where((now - F.col("w_us") <= RECENT_US) & F.col("watch_percentage").isNotNull()).groupBy("user_id", "category").agg(
        F.avg("watch_percentage").alias("_rw"), F.avg(F.col("completed").cast("double")).alias("_rc"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    label = (F.when(flag("not_interested"), 0).when((F.col("watch_percentage") >= 70) | flag("liked") | flag("shared"), 1).when(F.col("watch_percentage") < 20, 0))
    skip = F.coalesce(F.col("watch_percentage") < 20, F.lit(False)).cast("int")
    delta = F.when(flag("not_interested"), -signals.SESSION_REJECTION_PENALTY).otherwise(
        flag("completed").cast("int") * 4 + flag("liked").cast("int") * 3 + flag("shared").cast("int") * 5 - skip * 4)
    event = F.struct(F.col("w_us").alias("ts_us"), "category", F.col("category").alias("event_id"), delta.alias("session_delta"),
                     label.alias("session_label"), "watch_percentage", F.lit(10).cast("long").alias("w10"))
    near = watch.where((now - F.col("w_us") <= SESSION_US) & (F.col("w_us") <= now)).withColumn("_e", event)
    last = near.withColumn("_rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("_e")))).where(F.col("_rn") <= SESSION_EVENTS)
    sessions = last.groupBy("user_id").agg(F.array_sort(F.collect_list("_e")).alias("_session"))
    yes = F.lit(1).alias("_y")
    j = (
        base.drop("_tokens").join(sem, ["user_id", "event_id"], "left").fillna(SEMANTIC_DEFAULTS)
        .join(s["category"].withColumnsRenamed({"interaction_count": "_cn"}), ["user_id", "category"], "left").join(recent, ["user_id", "category"], "left")
        .join(s["creator"].select("user_id", "creator_id", F.col("interaction_count").alias("_kn"), F.col("completed_count").alias("_kd")), ["user_id", "creator_id"], "left")
        .join(s["followed"].select("*", F.lit(1).alias("_f")), ["user_id", "creator_id"], "left").join(s["seen"].select("*", yes), ["user_id", "content_id"], "left")
        .join(s["user"], "user_id", "left").join(sessions, "user_id", "left"))
    num, zero, c = (lambda x: F.coalesce(F.col(x), F.lit(0))), F.lit(0.0), F.col
    types = dict(sessions.dtypes)["_session"]
    f = j.withColumns({
        "_session": F.coalesce("_session", F.array().cast(types)),
        "category_affinity": scalars.affinity(F.coalesce("raw_affinity_score", zero)),
        "recent_category_affinity": scalars.affinity(F.coalesce("recent_raw_affinity_score", zero)),
        "has_category_history": (num("_cn") > 0).cast("int"),
        "average_category_watch_percentage": F.coalesce(scalars.ratio_or_zero(c("watch_percentage_sum"), num("watch_count")), zero),
        "category_completion_rate": F.coalesce(scalars.ratio_or_zero(c("completed_count"), num("watch_count")), zero),
        "recent_category_watch_percentage": F.coalesce("_rw", zero), "recent_category_completion_rate": F.coalesce("_rc", zero),
        "category_positive_count": F.log1p(num("positive_count").cast("double")), "category_negative_count": F.log1p(num("negative_count").cast("double")),
        "category_interaction_count": F.log1p(num("_cn").cast("double")),
        "days_since_last_category_interaction": F.when(
            c("last_interaction_at").isNotNull(), F.least(F.lit(365.0), F.greatest(zero, (c("ts_us") - us(c("last_interaction_at"))) / float(DAY_US)))).otherwise(0.0),
        "has_creator_history": (num("_kn") > 0).cast("int"), "creator_interaction_count": F.log1p(num("_kn").cast("double")),
        "creator_completion_rate": F.coalesce(scalars.ratio_or_zero(c("_kd"), num("_kn")), zero), "creator_followed": num("_f"), "already_seen": num("_y"),
        "user_total_interaction_count": F.log1p(num("total_interaction_count").cast("double")),
        "category_explicit_rejection_count": F.log1p(num("explicit_negative_count").cast("double")),
        "recent_explicit_rejection_strength": F.coalesce(
            scalars.half_life_decay((c("ts_us") - us(c("last_explicit_negative_at"))) / float(DAY_US), REJECTION_HALF_LIFE_DAYS), zero),
        "content_popularity_score": F.greatest(zero, F.least(F.lit(1.0), F.coalesce("popularity_score", F.lit(0.5)))),
        "content_age_hours": scalars.age_hours(F.coalesce("created_us", "ts_us"), c("ts_us")), "hour_of_day": F.hour(F.timestamp_micros("ts_us")),
    })
    return session_features(f).select("user_id", "content_id", "creator_id", *FEATURES, "has_category_history", "category_interaction_count",
                                      "days_since_last_category_interaction", "has_session_activity")
