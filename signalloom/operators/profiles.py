"""Aggregated profiles: category, creator, popularity, creator history, dataset summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars, signals
from .running import Family, prior_state, top_n

WEEK_US = 7 * 86_400_000_000
CREATOR_HISTORY_ROWS = 50
CREATOR_HISTORY_MIN = 3


def _n(cond: Column) -> Column:
    return F.sum(F.coalesce(cond, F.lit(False)).cast("long"))


def category_profiles(rows: DataFrame, now_us: int) -> DataFrame:
    """Fourteen counters, mean watch percentage and affinity per (user, category)."""
    a = signals.annotate(rows)
    is_ = lambda t: F.col("event_type") == t
    out = a.groupBy("user_id", "category").agg(
        F.count(F.lit(1)).alias("interaction_count"),
        _n(is_("VIDEO_IMPRESSION")).alias("impression_count"),
        _n(F.col("watch_percentage").isNotNull()).alias("watch_count"),
        _n(F.col("completed")).alias("completion_count"),
        _n(is_("VIDEO_SKIPPED")).alias("skip_count"),
        _n(F.col("fast_skipped")).alias("fast_skip_count"),
        _n(F.col("sig_liked")).alias("like_count"),
        _n(F.col("sig_shared")).alias("share_count"),
        _n(F.col("sig_favorited")).alias("favorite_count"),
        _n(F.col("sig_commented")).alias("comment_count"),
        _n(F.col("sig_followed")).alias("creator_follow_count"),
        _n(is_("VIDEO_REWATCHED")).alias("rewatch_count"),
        _n(is_("CONTENT_NOT_INTERESTED")).alias("not_interested_count"),
        _n(F.col("ts_us") >= now_us - WEEK_US).alias("recent_interaction_count"),
        F.max("ts_us").alias("last_interaction_us"),
        F.round(F.coalesce(F.avg("watch_percentage"), F.lit(0.0)), 6).alias("average_watch_percentage"),
        F.sum(signals.profile_delta()).alias("_raw"),
    )
    return out.withColumn("affinity_score", scalars.affinity("_raw")).drop("_raw")


def keyed_affinity(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Affinity of the summed engagement weights per key (user x creator, content, ...)."""
    return rows.groupBy(*keys).agg(scalars.affinity(F.sum(signals.profile_delta())).alias(name))


def creator_profiles(rows: DataFrame) -> DataFrame:
    """Creator affinity per user, best creators first, with the user's last interaction."""
    a = signals.annotate(rows)
    per = a.groupBy("user_id", "creator_id").agg(
        F.count(F.lit(1)).alias("interaction_count"),
        scalars.affinity(F.sum(F.col("completed").cast("int") * 4 + F.col("sig_followed").cast("int") * 6)).alias("score"),
        F.max("ts_us").alias("last_interaction_us"),
    )
    return per


def content_popularity(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """Engagement-derived popularity of every content; 0.5 where there is no evidence."""
    counted = rows.where(~F.col("is_training_context_only"))
    scores = keyed_affinity(counted, ["content_id"], "popularity")
    return contents.select("content_id").join(scores, "content_id", "left").withColumn(
        "popularity", F.coalesce("popularity", F.lit(0.5))
    )


def creator_category_counts(contents: DataFrame) -> DataFrame:
    """Category counts over each creator's newest fifty VIDEO contents, with the first-seen position."""
    newest = top_n(
        contents.where(F.col("content_type") == "VIDEO"), ["creator_id"],
        [F.desc("created_us"), F.asc("content_id")], CREATOR_HISTORY_ROWS, rank="_pos",
    )
    return newest.groupBy("creator_id", "category").agg(
        F.count(F.lit(1)).alias("n"), F.min("_pos").cast("long").alias("first_pos")
    )


def live_category_from_history(counts: DataFrame) -> DataFrame:
    """Modal category of a creator and its share; UNKNOWN below three rows. Ties: first seen."""
    g = counts.groupBy("creator_id").agg(
        F.sum("n").alias("total"),
        F.max_by("category", F.struct(F.col("n"), -F.col("first_pos"))).alias("top"),
        F.max("n").alias("top_n"),
    )
    enough = F.col("total") >= CREATOR_HISTORY_MIN
    return g.select(
        "creator_id",
        F.when(enough, F.col("top")).otherwise("UNKNOWN").alias("category"),
        F.when(enough, F.round(F.col("top_n") / F.col("total"), 6)).otherwise(0.0).alias("confidence"),
    )


def with_replay_weight(rows: DataFrame, **kw) -> DataFrame:
    """Add ``w10``: each row's replay influence in tenths, numbered per (user, content)."""
    a = rows if "controlled" in rows.columns else signals.annotate(rows)
    fam = Family(keys=["content_id"], ordered=True, sums={"_passive_before": F.col("controlled").cast("long")})
    out = prior_state(a, ["user_id"], "ts_us", [fam], **kw)
    return out.withColumn(
        "w10", signals.replay_weight_tenths(F.col("_passive_before") + 1, F.col("controlled"))
    ).drop("_passive_before")


def effective_interactions(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("user_id").agg(F.round(F.sum("w10") / 10, 6).alias("effective_interactions"))


def dataset_summary(rows: DataFrame) -> DataFrame:
    """One row of totals, labels, uniques and the time range of a labelled interaction set."""
    t = F.col("target")
    labelled = F.count("target")
    share = lambda v: F.round(F.sum((t == v).cast("long")) / F.nullif(labelled, F.lit(0)), 4)
    return rows.agg(
        F.count(F.lit(1)).alias("total_interactions"), labelled.alias("labelled_samples"),
        (F.count(F.lit(1)) - labelled).alias("neutral_rows"),
        F.sum((t == 1).cast("long")).alias("positive_samples"), F.sum((t == 0).cast("long")).alias("negative_samples"),
        share(1).alias("positive_ratio"), share(0).alias("negative_ratio"),
        F.countDistinct("user_id").alias("unique_users"), F.countDistinct("content_id").alias("unique_contents"),
        F.countDistinct("creator_id").alias("unique_creators"),
        F.min("ts_us").alias("earliest_us"), F.max("ts_us").alias("latest_us"),
    )


# User-id prefixes of the scenario cohorts.
SCENARIO_PREFIXES = [
    ("coldstart-user-", "coldStart"), ("session-switch-user-", "sessionSwitch"), ("recent-shift-user-", "recentShift"),
    ("semantic-pref-user-", "semanticPreference"), ("creator-pref-user-", "creatorPreference"),
    ("fastskip-streak-user-", "fastSkipStreak"),
]


def scenario_of(user: Column, prefixes: Sequence[tuple[str, str]] = tuple(SCENARIO_PREFIXES)) -> Column:
    out = F.lit("bulkOrOther")
    for prefix, name in reversed(prefixes):
        out = F.when(user.startswith(prefix), name).otherwise(out)
    return out


def dataset_diagnostics(labelled: DataFrame) -> DataFrame:
    """Label balance, negative/positive breakdown, uniques and age buckets against the newest row."""
    t, us = F.col("target"), F.col("ts_us")
    rows = labelled.withColumn("_max", labelled.agg(F.max("ts_us")).scalar())
    age = F.col("_max") - us
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    session, month = 30 * 60_000_000, 30 * 86_400_000_000
    total = F.count(F.lit(1))
    return rows.agg(
        total.alias("labelled_rows"), n(t == 1).alias("positive_rows"), n(t == 0).alias("negative_rows"),
        F.round(n(t == 1) / total, 6).alias("positive_ratio"), F.round(n(t == 0) / total, 6).alias("negative_ratio"),
        n(F.col("rejected")).alias("explicit_rejections"), n((t == 0) & ~F.col("rejected")).alias("implicit_negatives"),
        n((t == 1) & (F.col("watch_percentage") >= 90)).alias("high_watch_positives"),
        n((t == 1) & F.col("sig_liked")).alias("liked_positives"),
        n((t == 1) & F.col("sig_followed")).alias("followed_positives"),
        F.countDistinct("user_id").alias("unique_users"), F.countDistinct("content_id").alias("unique_contents"),
        F.countDistinct("creator_id").alias("unique_creators"), F.countDistinct("category").alias("unique_categories"),
        n(age <= session).alias("session_scale"), n((age > session) & (age <= month)).alias("recent_scale"),
        n(age > month).alias("long_term_scale"),
    )


def category_distribution(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("category", F.round(F.col("n") / counts.agg(F.sum("n")).scalar(), 4).alias("share"))


def class_distribution(rows: DataFrame, label: str = "target") -> DataFrame:
    y = F.col(label)
    return rows.agg(
        F.sum((y == 1).cast("long")).alias("positive"), F.sum((y == 0).cast("long")).alias("negative"),
        (F.countDistinct(y) >= 2).alias("both_classes"),
    )


def provenance(rows: DataFrame, prefix: str = "syn-") -> DataFrame:
    """Synthetic and other rows behind a training set, told apart by the event-id prefix."""
    synthetic = F.sum(F.col("event_id").startswith(prefix).cast("long"))
    total = F.count(F.lit(1))
    return rows.agg(
        synthetic.alias("synthetic_rows"), total.alias("total_rows"),
        ((total > 0) & (synthetic == total)).alias("synthetic"),
    )


#: Hex digits of a hash that a level of the selection looks at (4,096 bins), and the size of a bin that is ranked outright.
_DIGITS, _SMALL = 3, 4_096


def first_by_hash(rows: DataFrame, n: int, label: str, labels: Sequence, key: str) -> DataFrame:
    """The ``n`` rows of each label with the least sha256 of ``key`` (ties by ``key``), found without ranking them.

    The place of the n-th hash is narrowed by histograms of its next digits, a few thousand numbers a level; hashes below
    it are taken by a filter, and only the last bin, a small one, is ranked.
    """
    hashed = rows.withColumn("_h", F.sha2(F.col(key).cast("string"), 256))
    bound = {v: ("", n) for v in labels}  # label: (prefix of the n-th hash, how many of that prefix are wanted)
    waiting = list(labels)
    while waiting:
        depth = len(bound[waiting[0]][0])
        inside = F.lit(False)
        for v in waiting:
            inside = inside | ((F.col(label) == v) & F.col("_h").startswith(bound[v][0]))
        bins = hashed.where(inside).groupBy(label, F.substring("_h", 1, depth + _DIGITS).alias("_p")).agg(F.count(F.lit(1)).alias("_c")).collect()
        still = []
        for v in waiting:
            prefix, left = bound[v]
            for p, c in sorted((r["_p"], r["_c"]) for r in bins if r[label] == v):
                if left <= c:
                    bound[v] = (p, left)
                    if left < c and c > _SMALL and depth + _DIGITS < 64:
                        still.append(v)
                    break
                left -= c
            else:
                bound[v] = ("g", 0)  # beyond every hash: all rows of the label
        waiting = still
    below, edge = F.lit(False), F.lit(False)
    for v, (p, _) in bound.items():
        below = below | ((F.col(label) == v) & (F.col("_h") < p))
        edge = edge | ((F.col(label) == v) & F.col("_h").startswith(p))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h", key))
    wanted = F.lit(0)
    for v, (_, left) in bound.items():
        wanted = F.when(F.col(label) == v, left).otherwise(wanted)
    last = hashed.where(edge).withColumn("_r", rank).where(F.col("_r") <= wanted).drop("_r")
    return hashed.where(below).unionByName(last).drop("_h")


def stratified_downsample(rows: DataFrame, per_class: int, label: str = "target") -> DataFrame:
    """All neutral rows plus exactly ``per_class`` rows of each class, chosen by the id's hash.

    A short class is an error, checked when the job runs.
    """
    labelled = rows.where(F.col(label).isNotNull())
    picked = first_by_hash(labelled, per_class, label, (0, 1), "event_id")
    sizes = labelled.agg(*[F.sum((F.col(label) == v).cast("long")).alias(f"_c{v}") for v in (0, 1)])
    short = (F.coalesce(F.col("_c0"), F.lit(0)) < per_class) | (F.coalesce(F.col("_c1"), F.lit(0)) < per_class)
    failed = F.raise_error(F.lit("class smaller than the requested sample"))
    enough = sizes.select(F.when(short, failed).otherwise(F.lit(True)).cast("boolean")).scalar()
    return rows.where(F.col(label).isNull()).unionByName(picked.where(enough))
