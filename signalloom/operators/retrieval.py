"""Candidate retrieval for all users at once: bucketed VIDEO and LIVE candidates, vectors, dense top-k."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars, signals, tokens
from ..session import cut_lineage
from . import features, live
from .lists import bound, first_unseen, global_list, listed, ranked_lists, taken_in_turn
from .running import HEAVY_ROWS, Family, detect, load, prior_state, top_n

SOURCES = ["FOLLOWED_CREATOR", "SESSION_INTEREST", "PREFERRED_CATEGORY", "TRENDING", "NEW_CONTENT", "EXPLORATION"]
LIVE_POOL_SOURCES = ["FOLLOWED_CREATOR", "PREFERRED_LIVE_CATEGORY", "TRENDING_LIVE", "REGION_MATCH", "NEW_LIVE", "EXPLORATION"]
LIVE_SOURCES = ["FOLLOWED_CREATOR", "RECENT_CREATOR_INTERACTION", "PREFERRED_CATEGORY", "TRENDING_LIVE", "EXPLORATION"]
TRENDING_POPULARITY = 0.7
NEW_US = 72 * 3_600_000_000
SESSION_US = 30 * 60_000_000
SESSION_EVENTS = 12
EXPLORATION_FRACTION = 0.5
TRENDING_POOL = 200
#: Newest rows of a user that serving features read, unless the caller sets another bound (None: all rows).
HISTORY = 500


def newest(rows: DataFrame, history: int | None) -> DataFrame:
    """The newest ``history`` rows of each user, whatever their type; all rows for None."""
    return rows if history is None else top_n(rows, ["user_id"], [F.desc("ts_us"), F.desc("id")], history)


def session_categories(recent: DataFrame, now_us: int, *, session_us: int = SESSION_US, top: int = 2) -> DataFrame:
    """Top categories by positives among each user's last twelve VIDEO rows of the session (newest 48 rows read)."""
    newest = top_n(recent, ["user_id"], [F.desc("ts_us"), F.desc("id")], SESSION_EVENTS * 4)
    inside = newest.where((F.col("content_type") != "LIVE") & (now_us - F.col("ts_us") <= session_us))
    last = top_n(inside, ["user_id"], [F.desc("ts_us"), F.desc("id")], SESSION_EVENTS).where(signals.target() == 1)
    n = last.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts_us", "id")).alias("_first"))
    return top_n(n, ["user_id"], [F.desc("n"), F.asc("_first")], top).select("user_id", "category")


def preferred_categories(recent: DataFrame, interests: DataFrame | None = None, *, top: int = 2) -> DataFrame:
    """Top categories by affinity; onboarding interests (user_id, interests) only for users without behaviour."""
    video = recent.where(F.col("content_type") != "LIVE")
    aff = video.groupBy("user_id", "category").agg(
        scalars.affinity(F.sum(signals.profile_delta())).alias("affinity"), F.min(F.struct("ts_us", "id")).alias("_first"))
    best = top_n(aff, ["user_id"], [F.desc("affinity"), F.asc("_first")], top).select("user_id", "category")
    if interests is None:
        return best
    known = video.select("user_id").distinct()
    fallback = interests.join(known, "user_id", "left_anti").select("user_id", F.explode("interests").alias("category"))
    return best.unionByName(fallback.distinct())


def video_buckets(
    users: DataFrame, catalog: DataFrame, seen: DataFrame, followed: DataFrame, session: DataFrame, preferred: DataFrame,
    now_us: int, *, limit: int,
) -> DataFrame:
    """(user_id, bucket, place, content_id): the first ``limit`` unseen contents of every bucket of every user.

    ``limit`` rows per bucket are enough for the quota fill, because an item is skipped there only
    when it was already taken, and at most ``limit`` items are taken. Each bucket reads shared
    ranked lists (per creator, per category, or one list), so work is users x limit, not users x catalog.
    """
    users, seen, followed, session, preferred = (cut_lineage(x) for x in (users, seen, followed, session, preferred))
    heavy = detect(seen, ["user_id"])
    by_pop = [F.desc("popularity_score"), F.asc("content_id")]
    creators = ranked_lists(catalog, "creator_id", by_pop)
    categories = ranked_lists(catalog, "category", by_pop)
    pop = lambda df: global_list(df, -F.col("popularity_score") * 1e12)
    trending = pop(catalog.where(F.col("popularity_score") >= TRENDING_POPULARITY))
    fresh = global_list(catalog.where(now_us - F.col("created_us") <= NEW_US), -F.col("created_us"))
    everyone = users.select("user_id", F.lit("*").alias("key"))
    as_key = lambda df, c: df.select("user_id", F.col(c).alias("key")).distinct()

    # Categories are a fixed taxonomy (a short list); what a user explores is the list minus its own.
    taxonomy = catalog.agg(F.array_sort(F.collect_set("category"))).scalar()
    own = session.unionByName(preferred).groupBy("user_id").agg(F.collect_set("category").alias("_own"))
    explore = users.join(own, "user_id", "left").withColumn("_all", taxonomy).select(
        "user_id", F.explode(F.array_except("_all", F.coalesce("_own", F.array().cast("array<string>")))).alias("key"))

    parts = [
        (0, creators, as_key(followed, "creator_id")), (1, categories, as_key(session, "category")),
        (2, categories, as_key(preferred, "category")), (3, trending, everyone), (4, fresh, everyone), (5, categories, explore),
    ]
    out = None
    for rank, lists, members in parts:
        got = first_unseen(lists, members, seen, limit, heavy=heavy).select("user_id", F.lit(rank).alias("bucket"), "content_id")
        out = got if out is None else out.unionByName(got)
    ranked = out.join(catalog.select("content_id", "popularity_score", "created_us"), "content_id")
    value = F.when(F.col("bucket") == 4, F.col("created_us").cast("double")).otherwise(F.col("popularity_score"))
    return top_n(ranked, ["user_id", "bucket"], [value.desc(), F.asc("content_id")], limit, rank="place").select(
        "user_id", "bucket", "place", "content_id")


def quota_fill(buckets: DataFrame, limit: int) -> DataFrame:
    """Quota per bucket first, then up to ``limit`` in bucket order; exploration stays at its quota."""
    base = max(1, limit // len(SOURCES))
    names = [f"b{n}" for n in range(len(SOURCES))]
    wide = listed(buckets, ["user_id"], {name: (F.col("bucket") == n, [F.col("place")]) for n, name in enumerate(names)})
    quotas = [base] * (len(SOURCES) - 1) + [max(1, int(base * EXPLORATION_FRACTION))]
    return taken_in_turn(wide, ["user_id"], list(zip(names, SOURCES, quotas)), list(zip(names, SOURCES))[:-1], limit)


def video_candidates(rows: DataFrame, contents: DataFrame, now_us: int, *, limit: int = 200, exclude_seen: bool = True,
                     interests: DataFrame | None = None, session_us: int = SESSION_US, history: int | None = HISTORY,
                     recent: DataFrame | None = None) -> DataFrame:
    """The whole VIDEO retrieval for every user of ``rows`` (and of ``interests``).

    Interests are read from the newest ``history`` rows of any type (``recent`` where the caller has them already); what a
    user has seen and whom they follow, from all rows, so old items don't come back.
    """
    past = rows.where(F.col("ts_us") < now_us)
    recent = newest(past, history) if recent is None else recent
    video = past.where(F.col("content_type") != "LIVE")
    users = past.select("user_id").distinct()
    if interests is not None:
        users = users.unionByName(interests.select("user_id")).distinct()
    seen = video.where(signals.hard_seen()).select("user_id", "content_id").distinct()
    followed = video.where(signals.signal("sig_followed")).select("user_id", "creator_id").distinct()
    catalog = contents.where(F.col("is_active") & (F.col("content_type") == "VIDEO"))
    buckets = video_buckets(
        users, catalog, seen if exclude_seen else seen.limit(0), followed, session_categories(recent, now_us, session_us=session_us),
        preferred_categories(recent, interests), now_us, limit=limit)
    chosen = quota_fill(buckets, limit)
    return video_projection(chosen, contents, followed, seen, now_us)


def video_projection(chosen: DataFrame, contents: DataFrame, followed: DataFrame, seen: DataFrame, now_us: int) -> DataFrame:
    """Candidate rows with catalog fields, age in hours (2 dp) and the followed / seen flags."""
    j = chosen.join(contents, "content_id")
    j = j.join(followed.select("user_id", "creator_id").distinct().withColumn("_f", F.lit(True)), ["user_id", "creator_id"], "left")
    j = j.join(seen.select("user_id", "content_id").distinct().withColumn("_s", F.lit(True)), ["user_id", "content_id"], "left")
    return j.withColumns({
        "content_age_hours": F.round(scalars.age_hours(F.col("created_us"), F.lit(now_us)), 2),
        "creator_followed": F.coalesce("_f", F.lit(False)), "already_seen": F.coalesce("_s", F.lit(False)),
    }).drop("_f", "_s")


def live_candidates(
    users: DataFrame, contents: DataFrame, followed: DataFrame, recent_creators: DataFrame, preferred: DataFrame,
    state: DataFrame, *, limit: int,
) -> DataFrame:
    """(user_id, content_id, source, position): followed, recent creators, preferred categories, trending, newest.

    ``state`` is the dynamic state per stream. Every bucket takes newest streams first and up to the
    remaining room; the trending pool is the newest unselected streams, 200 at most.
    """
    users, followed, state = (cut_lineage(x) for x in (users.select("user_id"), followed.select("user_id", "creator_id"), state))
    active = contents.where(F.col("is_active") & (F.col("content_type") == "LIVE")).where(
        (F.coalesce("creator_id", F.lit("")) != "") & (F.coalesce("category", F.lit("")) != ""))
    newest = [F.desc("created_us"), F.asc("content_id")]
    creators = ranked_lists(active, "creator_id", newest, limit)
    categories = ranked_lists(active, "category", newest, limit)
    strangers = recent_creators.select("user_id", "creator_id").join(followed.select("user_id", "creator_id"), ["user_id", "creator_id"], "left_anti")
    parts = [(0, creators, followed, "creator_id"), (1, creators, strangers, "creator_id"), (2, categories, preferred, "category")]
    first = None
    for rank, lists, members, key in parts:
        got = members.select("user_id", F.col(key).alias("key")).distinct().join(lists, "key").select("user_id", "content_id", F.lit(rank).alias("bucket"))
        first = got if first is None else first.unionByName(got)
    best = first.groupBy("user_id", "content_id").agg(F.min("bucket").alias("bucket")).join(active.select("content_id", "created_us"), "content_id")
    selected = cut_lineage(top_n(best, ["user_id"], [F.asc("bucket"), *newest], limit, rank="_o").select(
        "user_id", "content_id", "bucket", F.col("_o").cast("double").alias("_o")))

    taken = selected.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    room = users.select("user_id").join(taken, "user_id", "left").select("user_id", (F.lit(limit) - F.coalesce("_n", F.lit(0))).alias("_room"))
    everyone = room.where("_room > 0")
    stream = cut_lineage(global_list(active, -F.col("created_us")))
    members = everyone.select("user_id", F.lit("*").alias("key"))
    pool = first_unseen(stream, members, selected, TRENDING_POOL, heavy=None).join(everyone, "user_id")
    size = F.least(F.lit(TRENDING_POOL), F.greatest(F.col("_room"), F.lit(TRENDING_POOL // 4)))
    pool = top_n(pool, ["user_id"], [F.asc("pos")], TRENDING_POOL, rank="_k").where(F.col("_k") <= size)
    growing = pool.join(state.select("content_id", "viewer_growth_rate").where(F.col("viewer_growth_rate") > live.TRENDING_GROWTH), "content_id")
    trending = top_n(growing, ["user_id"], [F.desc("viewer_growth_rate"), F.asc("pos")], limit, rank="_o").where(F.col("_o") <= F.col("_room")).select(
        "user_id", "content_id", F.lit(3).alias("bucket"), F.col("_o").cast("double").alias("_o"))
    # Selections are at most `limit` rows per user, so no user needs slicing here.
    so_far = cut_lineage(selected.unionByName(trending))
    rest = first_unseen(stream, members, so_far, limit, heavy=None).select("user_id", "content_id", F.lit(4).alias("bucket"), F.col("pos").cast("double").alias("_o"))
    out = top_n(so_far.unionByName(rest), ["user_id"], [F.asc("bucket"), F.asc("_o")], limit, rank="position")
    names = F.array(*[F.lit(s) for s in LIVE_SOURCES])
    return out.select("user_id", "content_id", F.element_at(names, F.col("bucket") + 1).alias("source"), "position")


def live_projection(chosen: DataFrame, contents: DataFrame, history: DataFrame, followed: DataFrame, state: DataFrame, now_us: int) -> DataFrame:
    """LIVE candidate rows: dynamic state, age in minutes, previous creator sessions, unknown region and language."""
    j = chosen.join(contents, "content_id").join(state, "content_id", "left").join(history, ["user_id", "creator_id"], "left")
    j = j.join(followed.select("user_id", "creator_id").distinct().withColumn("_f", F.lit(True)), ["user_id", "creator_id"], "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("current_viewer_count", "recent_likes", "recent_gifts")}
    return j.withColumns({
        **zero, "viewer_growth_rate": F.coalesce("viewer_growth_rate", F.lit(0.0)),
        "live_age_minutes": scalars.live_age_minutes(F.col("created_us"), F.lit(now_us)),
        "creator_followed": F.coalesce("_f", F.lit(False)), "region": F.lit("unknown"), "language": F.lit("unknown"),
        "region_match": F.lit(False), "language_match": F.lit(False), "already_joined": F.lit(False), "status": F.lit("ACTIVE"),
    }).drop("_f")


def live_pool_buckets(pool: DataFrame, limit: int) -> DataFrame:
    """Quota fill over a caller's pool: (user_id, seq, stream_id, category, status, ...) rows in input order."""
    active = pool.where(F.col("status") == "ACTIVE")
    top = top_n(active, ["user_id"], [F.desc("previous_live_interactions"), F.asc("seq")], 2).where("previous_live_interactions > 0")
    wanted = top.groupBy("user_id").agg(F.collect_set("category").alias("_pref"))
    j = active.join(wanted, "user_id", "left")
    pref = F.coalesce(F.array_contains("_pref", F.col("category")), F.lit(False))
    flags = F.array(
        F.col("creator_followed"), pref, (F.col("viewer_growth_rate") >= 0.15) | (F.col("current_viewer_count") >= 500),
        F.col("region_match"), F.col("live_age_minutes") <= 20, F.lit(True))
    # Only the first `limit` of each bucket by viewers, and of the input order, can be chosen.
    busiest = [F.desc("current_viewer_count"), F.asc("seq")]
    flagged = j.select("user_id", "seq", F.col("stream_id").alias("content_id"), "current_viewer_count", F.posexplode(flags).alias("bucket", "_in")).where("_in").drop("_in")
    deep = top_n(flagged, ["user_id", "bucket"], busiest, limit)
    early = top_n(j.select("user_id", "seq", F.col("stream_id").alias("content_id"), "current_viewer_count", F.lit(-1).alias("bucket")), ["user_id"], [F.asc("seq")], limit)
    names = [f"b{n}" for n in range(len(LIVE_POOL_SOURCES))]
    lists = {name: (F.col("bucket") == n, [-F.col("current_viewer_count"), F.col("seq")]) for n, name in enumerate(names)}
    wide = listed(deep.unionByName(early), ["user_id"], lists | {"early": (F.col("bucket") == -1, [F.col("seq")])})
    quota = max(1, limit // len(LIVE_POOL_SOURCES))
    turns = [(name, source, quota) for name, source in zip(names, LIVE_POOL_SOURCES)]
    return taken_in_turn(wide, ["user_id"], turns, [("early", "EXPLORATION")], limit).withColumnRenamed("content_id", "stream_id")


def clean_candidates(candidates: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Drop blank ids, creators and categories, seen contents and repeats (first position wins)."""
    full = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    out = candidates.where(full("content_id") & full("creator_id") & full("category"))
    if seen is not None:
        out = out.where(~F.coalesce("already_seen", F.lit(False))).join(seen.select("user_id", "content_id"), ["user_id", "content_id"], "left_anti")
    firsts = out.groupBy("user_id", "content_id").agg(F.min("position").alias("position"))
    return out.join(firsts, ["user_id", "content_id", "position"], "left_semi")


# --- hashed vectors and dense retrieval ---------------------------------------------------------

SEMANTIC_DIM, CREATOR_DIM = 32, 8
#: Rows of a group of queries or items in dense retrieval, scores that a task holds at once, and queries it asks with at once.
GROUP_ROWS, SCORES, ASKED = 16_384, 1 << 22, 4_096
CATEGORY_WEIGHT, HASH_WEIGHT = 1.5, 0.6


def hash_slot(token: Column, dim: int) -> Column:
    """First four bytes of sha256 modulo ``dim``."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % dim).cast("int")


def hash_sign(token: Column) -> Column:
    return F.when(F.conv(F.substring(F.sha2(token, 256), 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)


def hashed_vector(weighted: DataFrame, keys: Sequence[str], dim: int, name: str) -> DataFrame:
    """(keys, token, weight) rows to one dense array per key; empty tokens are skipped."""
    t = F.col("token")
    sums = weighted.where(t != "").groupBy(*keys, hash_slot(t, dim).alias("_slot")).agg(F.sum(hash_sign(t) * F.col("weight")).alias("_v"))
    filled = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_slot", "_v"))).alias("_m"))
    return filled.select(*keys, _dense("_m", dim).alias(name))


def _dense(entries: str, dim: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(entries, i), F.lit(0.0)))


def content_vectors(contents: DataFrame, categories: Sequence[str]) -> DataFrame:
    """One-hot category x 1.5, popularity, hashed creator and hashed tokens x 0.6, per content."""
    flat = contents.select("content_id", F.explode(tokens.all_tokens()).alias("token")).withColumn("weight", F.lit(1.0))
    sem = hashed_vector(flat, ["content_id"], SEMANTIC_DIM, "_sem")
    creator = F.col("creator_id")
    cre = F.transform(F.sequence(F.lit(0), F.lit(CREATOR_DIM - 1)), lambda i: F.when(i == hash_slot(creator, CREATOR_DIM), hash_sign(creator) * HASH_WEIGHT).otherwise(0.0))
    onehot = F.array(*[F.when(F.upper("category") == c, CATEGORY_WEIGHT).otherwise(0.0) for c in categories])
    zeros = F.array(*[F.lit(0.0)] * SEMANTIC_DIM)
    return contents.join(sem, "content_id", "left").select("content_id", F.concat(
        onehot, F.array(F.coalesce("popularity_score", F.lit(0.5))), cre, F.transform(F.coalesce("_sem", zeros), lambda x: x * HASH_WEIGHT)).alias("vector"))


def user_vectors(state: dict[str, DataFrame], categories: Sequence[str]) -> DataFrame:
    """Category block, four capped statistics and the hashed semantic block of each user (``features.final_state``)."""
    creators = state["creator"].where("w10 > 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("creators"))
    history = state["category"].join(creators, "user_id", "left").fillna({"creators": 0})
    token_weights = state["token"].where("w10 > 0").select("user_id", "token", (scalars.affinity(F.col("raw10") / 10) - 0.5).alias("weight"))
    cell = F.struct(scalars.affinity(F.col("raw10") / 10).alias("a"), scalars.affinity(F.col("recent10") / 10).alias("r"),
                    (F.col("w10") > 0).cast("double").alias("h"))
    per = history.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("category"), cell))).alias("_m"), F.sum("w10").alias("_w"),
        F.sum("pos10").alias("_p"), F.sum("neg10").alias("_n"), F.max("creators").alias("_k"))
    at = lambda c, f, d: F.coalesce(F.try_element_at("_m", F.lit(c))[f], F.lit(d))
    blocks = [F.array(*[at(c, "a", 0.5) * CATEGORY_WEIGHT for c in categories]), F.array(*[at(c, "r", 0.5) * CATEGORY_WEIGHT for c in categories]),
              F.array(*[at(c, "h", 0.0) for c in categories])]
    labelled = F.greatest(F.lit(1.0), (F.col("_p") + F.col("_n")) / 10)
    stats = F.array(F.least(F.lit(1.0), F.log1p(F.col("_w") / 10) / 5.0), F.col("_p") / 10 / labelled, F.col("_n") / 10 / labelled,
                    F.least(F.lit(1.0), F.log1p(F.col("_k").cast("double")) / 3.0))
    sem = hashed_vector(token_weights, ["user_id"], SEMANTIC_DIM, "_sem")
    zeros = F.array(*[F.lit(0.0)] * SEMANTIC_DIM)
    return per.join(sem, "user_id", "left").select("user_id", F.concat(
        *blocks, stats, F.transform(F.coalesce("_sem", zeros), lambda x: x * HASH_WEIGHT)).alias("vector"))


def unit(v: Column) -> Column:
    """``v`` at length 1; the vector and its length are computed once, not for each of its numbers."""
    norm = lambda u: F.sqrt(F.aggregate(u, F.lit(0.0), lambda a, x: a + x * x))
    return bound(v, lambda u: bound(norm(u), lambda n: F.transform(u, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def _block_count(items: int) -> int:
    """Blocks of a catalog: about as many as items in one, at least eight and at most 4,096."""
    return min(4_096, max(8, math.isqrt(max(items, 1))))


def _nearest(pivots):
    """Adds to batches of (id, vector) the block of the nearest pivot."""
    def run(batches):
        for pdf in batches:
            if len(pdf):
                v, own = np.stack(pdf["vector"].to_numpy()).astype("float64"), (pivots.value ** 2).sum(1)[None, :]
                block = [(own - 2 * v[n : n + 1_024] @ pivots.value.T).argmin(1) for n in range(0, len(v), 1_024)]
                yield pdf.assign(block=np.concatenate(block).astype("int32"))

    return run


def _bounds(v, cells):
    """The highest score that each vector can have in each cell, from its centre and radius."""
    _, centres, radii, _ = cells
    bound = v @ centres.T + np.sqrt((v ** 2).sum(1))[:, None] * radii[None, :]
    return bound + 1e-6 + 1e-9 * np.abs(bound)  # room for rounding only ever keeps a cell


def _at_home(cells):
    """Adds to batches of queries the cell with the highest bound."""
    def run(batches):
        for pdf in batches:
            if len(pdf) and len(cells.value[0]):
                v = np.stack(pdf["vector"].to_numpy()).astype("float64")
                home = np.concatenate([_bounds(v[n : n + 1_024], cells.value).argmax(1) for n in range(0, len(v), 1_024)])
                yield pdf.assign(cell=cells.value[0][home])

    return run


def _sent(cells):
    """Rows (query, group of cells) of all groups with a cell other than the query's own whose bound reaches its floor."""
    def run(batches):
        names, _, _, groups = cells.value
        for pdf in batches:
            for start in range(0, len(pdf), 1_024):
                part = pdf.iloc[start : start + 1_024]
                reach = part["floor"].to_numpy(dtype="float64", na_value=-np.inf)
                row, at = np.nonzero(_bounds(np.stack(part["vector"].to_numpy()).astype("float64"), cells.value) >= reach[:, None])
                other = names[at] != part["cell"].to_numpy()[row]
                pairs = np.unique(np.stack([row[other], groups[at[other]]], 1), axis=0)
                yield part.iloc[pairs[:, 0]].assign(group=pairs[:, 1].astype("int32"))

    return run


def _best_in_block(queries, items):
    """Rows of ``queries``, rows of ``items`` and scores of the pairs that reach the query's floor and are among its first
    ``depth`` in this block: of scores equal to the last of them, as many as may be needed, lesser item rows first. So what
    is held grows with the depth, not with the block."""
    found = []
    left, right = np.ascontiguousarray(queries["vector"]), np.ascontiguousarray(items["vector"]).T
    step = max(1, SCORES // max(1, len(items)))
    for start in range(0, len(queries), step):
        scores, bar = np.round(left[start : start + step] @ right, 9), queries["floor"][start : start + step]
        most = int(queries["depth"][start : start + step].max())
        if most < len(items):
            bar = np.maximum(bar, np.partition(scores, len(items) - most, axis=1)[:, len(items) - most])
        tied = scores == bar[:, None]
        row, at = np.nonzero((scores > bar[:, None]) | (tied & (np.cumsum(tied, axis=1, dtype="int32") <= most)))
        found.append((start + row, at, scores[row, at]))
    return [np.concatenate(x) for x in zip(*found)]


def _leaders(found, depth):
    """Of (query row, item row, score) those among the best ``depth`` of their query; ties go to the lesser item row."""
    row, at, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((at, -score, row))
    row, at, score = row[order], at[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    good = place < depth[row]
    return row[good], at[good], score[good]


def _search(queries, items, cells, best):
    """The best ``_depth`` items per query, cell by cell; what is found raises the floor that later cells must reach.

    ``cells``: centres and radii, by which queries leave cells out (their own one too); None: all items are one cell.
    """
    if not len(queries) or not len(items):
        # Typed as the inputs are: a plain empty column holds doubles, which Arrow turns into chunks instead of text.
        return pd.DataFrame({"query_id": queries["query_id"].iloc[:0], "item_id": items["item_id"].iloc[:0], "score": np.zeros(0)}, index=range(0))
    items = items.sort_values("item_id", kind="stable")
    vectors = lambda df: np.stack(df["vector"].to_numpy()).astype("float64")
    q = np.zeros(len(queries), [("vector", "f8", (len(queries["vector"].iloc[0]),)), ("floor", "f8"), ("depth", "i8")])
    q["vector"], q["floor"] = vectors(queries), queries["floor"].to_numpy(dtype="float64", na_value=-np.inf)
    i = np.zeros(len(items), [("vector", "f8", (len(items["vector"].iloc[0]),))])
    i["vector"], depth = vectors(items), queries["_depth"].to_numpy(dtype="int64")
    q["depth"] = depth
    if cells is None:
        parts = [(np.arange(len(i)), np.full(len(q), np.inf))]
    else:
        own, home = items["cell"].to_numpy(), queries["cell"].to_numpy()
        held, inside = np.unique(own, return_inverse=True)
        at = np.searchsorted(cells[0], held)
        bound = _bounds(q["vector"], (None, cells[1][at], cells[2][at], None))
        by_cell, ends = np.argsort(inside, kind="stable"), np.r_[0, np.cumsum(np.bincount(inside))]
        parts = [(by_cell[ends[n] : ends[n + 1]], np.where(home == c, -np.inf, bound[:, n])) for n, c in enumerate(held)]
    kept, pending, waiting = (np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)), [], 0
    for places, reach in parts:
        asked = np.flatnonzero((reach >= q["floor"]) & (reach > -np.inf))
        for start in range(0, len(asked), ASKED):
            some = asked[start : start + ASKED]
            row, at, score = best(q[some], i[places])
            pending.append((some[row], places[at], score))
            waiting += len(row)
            if waiting > max(SCORES // 4, len(kept[0])):
                kept = _raised(q, [kept, *pending], depth)
                pending, waiting = [], 0
    row, at, score = _leaders([kept, *pending], depth)
    return pd.DataFrame({
        "query_id": pd.Series(queries["query_id"].to_numpy()[row], dtype=queries["query_id"].dtype),
        "item_id": pd.Series(items["item_id"].to_numpy()[at], dtype=items["item_id"].dtype), "score": score})


def _raised(q, found, depth):
    """The leaders of what was found so far; queries with enough of them get the last one's score as their floor."""
    row, at, score = kept = _leaders(found, depth)
    many = np.bincount(row, minlength=len(q))
    full = np.flatnonzero((many >= depth) & (many > 0))
    q["floor"][full] = np.maximum(q["floor"][full], score[np.cumsum(many)[full] - 1])
    return kept


def _packed(sizes, most: int):
    """A number for each of ``sizes`` in a row, so that those of one number make up about ``most``."""
    before = np.cumsum(sizes) - sizes
    return np.unique(before // most, return_inverse=True)[1].astype("int32")


def retrieve_top_k(queries: DataFrame, items: DataFrame, k: int = 30, *, seen: DataFrame | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Exact dot-product top-k of (query_id, vector) against (item_id, vector), minus seen pairs.

    Items are cut into cells by the nearest of some pivots, so that near items share a cell; a small table has each
    cell's centre and radius. No item of a cell scores above q . centre + |q| radius. A query first goes to the cell
    with the highest bound and takes the k-th score found there; then to those other cells only whose bound reaches it.
    For that, queries and cells travel in groups of about ``group_rows`` rows each, and a pair of groups is one matrix
    product after the other: tasks hold two groups, whatever the tables' size, and a row travels as often as there are
    groups on the other side, not once for each cell. Where no bound keeps a cell out, that is all pairs. Items a query has
    seen are requested on top of k, so exclusion stays exact.
    """
    spark = queries.sparkSession
    q_type, i_type = dict(queries.dtypes)["query_id"], dict(items.dtypes)["item_id"]
    q_vector, i_vector = dict(queries.dtypes)["vector"], dict(items.dtypes)["vector"]
    count = _block_count(items.count())
    chosen = items.orderBy(F.xxhash64("item_id"), "item_id").limit(count).select("vector").collect()  # bounded by ``count``
    if not chosen:
        return queries.select("query_id", F.lit(None).cast(i_type).alias("item_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank")).limit(0)
    pivots = spark.sparkContext.broadcast(np.array([r["vector"] for r in chosen], "float64"))
    placed = cut_lineage(items.select("item_id", "vector").mapInPandas(_nearest(pivots), f"item_id {i_type}, vector {i_vector}, block int"))

    def reach(batches):
        for pdf in batches:
            if len(pdf):
                away = np.sqrt(((np.stack(pdf["vector"].to_numpy()).astype("float64") - pivots.value[pdf["block"]]) ** 2).sum(1))
                yield pd.DataFrame({"block": pdf["block"], "away": away, "n": 1}).groupby("block", as_index=False).agg({"away": "max", "n": "sum"})

    balls = placed.mapInPandas(reach, "block int, away double, n long").groupBy("block").agg(F.max("away").alias("radius"), F.sum("n").alias("n")).orderBy("block").collect()  # at most ``count``
    # A block of more rows than a group becomes several cells of one centre.
    parts = np.array([-(-r["n"] // group_rows) for r in balls])
    block = np.repeat([r["block"] for r in balls], parts)
    groups = _packed(np.repeat([r["n"] / p for r, p in zip(balls, parts)], parts), group_rows)
    cells = spark.sparkContext.broadcast((np.arange(len(block), dtype="int32"), pivots.value[block], np.repeat([r["radius"] for r in balls], parts), groups))
    first, many = np.zeros(len(chosen), "int64"), np.ones(len(chosen), "int64")
    first[[r["block"] for r in balls]], many[[r["block"] for r in balls]] = np.cumsum(parts) - parts, parts

    def into_cells(batches):
        for pdf in batches:
            cell = first[pdf["block"]] + pdf.pop("part").to_numpy() % many[pdf.pop("block")]
            yield pdf.assign(cell=cell.astype("int32"), group=cells.value[3][cell])

    celled = placed.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(1 << 31))).mapInPandas(into_cells, f"item_id {i_type}, vector {i_vector}, cell int, group int")

    spare = queries.select("query_id")
    if seen is not None:
        known = seen.join(items.select("item_id"), "item_id", "left_semi")
        spare = spare.join(known.groupBy("query_id").agg(F.countDistinct("item_id").alias("_s")), "query_id", "left")
    depth = F.lit(k) + F.coalesce(F.col("_s"), F.lit(0)) if seen is not None else F.lit(k)
    asked = queries.select("query_id", "vector").join(spare.withColumn("_depth", depth.cast("int")).select("query_id", "_depth"), "query_id")
    schema = f"query_id {q_type}, vector {q_vector}, _depth int, floor double, cell int"
    homes = cut_lineage(asked.withColumn("floor", F.lit(None).cast("double")).mapInPandas(_at_home(cells), schema))

    out = f"query_id {q_type}, item_id {i_type}, score double"
    at_home = homes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / group_rows).cast("int").alias("turns"))  # at most as many rows as cells
    turn = F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn")
    own = homes.join(F.broadcast(at_home), "cell").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int")).drop("turns")
    inside = celled.join(F.broadcast(at_home), "cell").select("item_id", "vector", "cell", turn)
    near = cut_lineage(own.groupBy("cell", "turn").cogroup(inside.groupBy("cell", "turn")).applyInPandas(lambda q, i: _search(q, i, None, _best_in_block), out))

    floors = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("_c"), F.min("score").alias("floor"))
    rest = homes.drop("floor").join(floors, "query_id", "left")
    rest = rest.select("query_id", "vector", "_depth", F.when(F.col("_c") >= F.col("_depth"), F.col("floor")).alias("floor"), "cell")
    crowds = max(1, -(-homes.count() // group_rows))
    sent = rest.mapInPandas(_sent(cells), schema + ", group int").withColumn("crowd", F.pmod(F.xxhash64("query_id"), F.lit(crowds)).cast("int"))
    shelves = celled.withColumn("crowd", F.explode(F.sequence(F.lit(0), F.lit(crowds - 1))))
    far = sent.groupBy("group", "crowd").cogroup(shelves.groupBy("group", "crowd")).applyInPandas(lambda q, i: _search(q, i, cells.value, _best_in_block), out)
    best = near.unionByName(far)
    if seen is not None:
        best = best.join(seen.select("query_id", "item_id").distinct(), ["query_id", "item_id"], "left_anti")
    return top_n(best, ["query_id"], [F.desc("score"), F.asc("item_id")], k, rank="rank")


def vectors_before(rows: DataFrame, contents: DataFrame, categories: Sequence[str], *, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Every labelled event with ``user_vector``: the user's vector of strictly earlier events.

    A vector is made of sums, so it is state on the user's own time line, like any other: counts and deltas per category
    (recent ones leave thirty days later), creators when they first count, and for each hashed slot the steps by which
    token affinities move. Steps are whole millionths, so the order of events of one time cannot change a vector.
    """
    heavy, tasks = load(rows, ["user_id"], "ts_us", heavy_rows)
    prepared = cut_lineage(features.prepare(rows.drop("content_type", "id", "content_duration_seconds", "watch_time_seconds", "content_pending"), contents, heavy, heavy_rows, tasks))
    state = {"heavy": heavy, "heavy_rows": heavy_rows, "tasks": tasks}
    repeats = (F.col("rejected") & (F.col("o_w") > 0) & (F.col("o_neg") > F.col("o_pos"))).cast("int")
    repeat = features.token_state(prepared, **state).groupBy("user_id", "event_id").agg(F.max(repeats).alias("_again"))
    penalty = F.when(F.coalesce("_again", F.lit(0)) == 1, -10 * signals.REPEAT_REJECTION_PENALTY).otherwise(-10 * signals.EXPLICIT_REJECTION_PENALTY)
    w = F.col("w10")
    moved = prepared.drop("_tokens").join(repeat, ["user_id", "event_id"], "left").withColumn("_d", F.when(F.col("rejected"), penalty).otherwise(F.col("base_delta") * w))

    of = lambda i, c: F.when(F.col("category") == categories[i], c)
    n = range(len(categories))
    own = {f"d{i}": of(i, F.col("_d")) for i in n} | {f"r{i}": of(i, F.col("_d")) for i in n} | {f"w{i}": of(i, w) for i in n}
    own |= {"w": w, "p": F.when(F.col("target") == 1, w), "n": F.when(F.col("target") == 0, w)}
    line = moved.select("user_id", "event_id", "content_id", "ts_us", "target", *[c.alias(k) for k, c in own.items()])
    gone = moved.select("user_id", (F.col("ts_us") + features.RECENT_US).alias("ts_us"), *[of(i, -F.col("_d")).alias(f"r{i}") for i in n])
    creators = prepared.where("w10 > 0").groupBy("user_id", "creator_id").agg(F.min("ts_us").alias("ts_us")).select("user_id", "ts_us", F.lit(1).alias("k"))

    delta = F.when(F.col("rejected"), F.lit(-10 * signals.TOKEN_REJECTION_PENALTY)).otherwise(F.col("base_delta") * w)
    said = prepared.select("user_id", "ts_us", delta.alias("_d"), "w10", F.explode("_tokens").alias("t")).where("t.token <> ''")
    said = said.groupBy("user_id", "ts_us", F.col("t.field").alias("field"), F.col("t.token").alias("token")).agg(F.sum("_d").alias("_d"), F.sum("w10").alias("w10"))
    before = prior_state(said, ["user_id"], "ts_us", [Family(keys=["field", "token"], sums={"_raw": F.col("_d"), "_w": w})], tie_break=["field", "token"], **state)
    millionths = lambda raw, many: F.when(many > 0, F.round(scalars.affinity(raw / 10) * 1_000_000).cast("long") - 500_000).otherwise(0)
    step = (millionths(F.col("_raw") + F.col("_d"), F.col("_w") + w) - millionths(F.col("_raw"), F.col("_w"))) * hash_sign(F.col("token")).cast("long")
    slot = hash_slot(F.col("token"), SEMANTIC_DIM)
    steps = before.select("user_id", "ts_us", slot.alias("_s"), step.alias("_x")).groupBy("user_id", "ts_us").agg(
        *[F.sum(F.when(F.col("_s") == i, F.col("_x"))).alias(f"s{i}") for i in range(SEMANTIC_DIM)])

    names = [*own, "k", *[f"s{i}" for i in range(SEMANTIC_DIM)]]
    timeline = line.unionByName(gone, allowMissingColumns=True).unionByName(creators, allowMissingColumns=True).unionByName(steps, allowMissingColumns=True)
    past = prior_state(timeline, ["user_id"], "ts_us", [Family(sums={f"_{c}": F.col(c) for c in names})], **state)
    c = lambda name: F.col(f"_{name}")
    labelled = F.greatest(F.lit(1.0), (c("p") + c("n")) / 10)
    vector = F.array(
        *[scalars.affinity(c(f"d{i}") / 10) * CATEGORY_WEIGHT for i in n], *[scalars.affinity(c(f"r{i}") / 10) * CATEGORY_WEIGHT for i in n],
        *[(c(f"w{i}") > 0).cast("double") for i in n], F.least(F.lit(1.0), F.log1p(c("w") / 10) / 5.0), c("p") / 10 / labelled, c("n") / 10 / labelled,
        F.least(F.lit(1.0), F.log1p(c("k").cast("double")) / 3.0), *[c(f"s{i}") / 1_000_000 * HASH_WEIGHT for i in range(SEMANTIC_DIM)])
    return past.where(F.col("event_id").isNotNull() & F.col("target").isNotNull()).select("event_id", "user_id", "content_id", "target", vector.alias("user_vector"))


def training_pairs(rows: DataFrame, contents: DataFrame, categories: Sequence[str], *, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(user vector strictly before the event, content vector, label) per labelled event."""
    vectors = content_vectors(contents, categories).withColumnRenamed("vector", "content_vector")
    return vectors_before(rows, contents, categories, heavy_rows=heavy_rows).join(vectors, "content_id").select("event_id", "user_id", "content_id", "user_vector", "content_vector", "target")
