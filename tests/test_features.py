"""Point-in-time rules: brute force, leakage properties, hot-key splitting."""

import pytest
from pyspark.sql import functions as F

from signalloom.operators import features, running
from signalloom.operators.running import Family, prior_state
from tests.helpers import DAY, MIN, T0, TOKENS, brute_force, contents, frame, random_rows, row

COLS = ["category_affinity", "recent_category_affinity", "recent_category_watch_percentage", "category_positive_count", "creator_interaction_count",
        "user_total_interaction_count", "already_seen", "hashtag_affinity", "session_category_affinity", "session_category_streak", "session_category_streak_valence"]


def compute(spark, rows, **kw):
    f = features.feature_rows(frame(spark, rows), contents(spark, TOKENS, TOKENS), **kw).select("event_id", *COLS)
    return {r["event_id"]: r.asDict() for r in f.collect()}


def assert_same(got, want):
    assert set(got) == set(want)
    for e, w in want.items():
        for c in COLS:
            assert got[e][c] == pytest.approx(w[c], abs=2e-6), (e, c, got[e][c], w[c])


@pytest.mark.parametrize("heavy_rows", [10**9, 25])
def test_matches_plain_python(spark, heavy_rows):
    """Same values with and without splitting of heavy users."""
    rows = random_rows(160, seed=3, span=3 * DAY) + random_rows(40, seed=4, span=45 * DAY)
    rows = [r | {"event_id": f"e{i:04d}"} for i, r in enumerate(rows)]
    assert_same(compute(spark, rows, heavy_rows=heavy_rows), brute_force(rows))


def test_dense_session_across_slices(spark):
    """Thirty events per half hour of one user, cut into slices shorter than a session."""
    rows = [r | {"ts_us": T0 + i * MIN, "user_id": "u"} for i, r in enumerate(random_rows(120, seed=9))]
    assert_same(compute(spark, rows, heavy_rows=10), brute_force(rows))


def test_future_rows_change_nothing(spark):
    rows = random_rows(60, seed=5, span=5 * DAY)
    later = [row(f"z{i}", "u0", "c0", T0 + 9 * DAY + i, "CONTENT_NOT_INTERESTED", category="SPORT") for i in range(5)]
    full = compute(spark, rows + later)
    assert {k: v for k, v in full.items() if not k.startswith("z")} == compute(spark, rows)


def test_input_order_does_not_matter(spark):
    rows = random_rows(60, seed=6, span=DAY)
    assert compute(spark, rows) == compute(spark, rows[::-1])


def test_thirty_day_boundary(spark):
    rows = [row("a", ts=T0, event_type="CONTENT_LIKED", content="c0", category="SPORT"), row("b", ts=T0 + 30 * DAY, content="c0", category="SPORT", wp=50.0),
            row("c", ts=T0 + 30 * DAY + 1, content="c0", category="SPORT", wp=50.0)]
    got = compute(spark, rows)
    assert got["b"]["recent_category_affinity"] > 0.5
    assert got["c"]["recent_category_affinity"] == pytest.approx(0.5)
    assert got["c"]["category_affinity"] > 0.5


def test_context_rows_update_but_emit_nothing(spark):
    rows = [row("a", ts=T0, event_type="CONTENT_LIKED", content="c0", category="SPORT", is_training_context_only=True), row("b", ts=T0 + 1, content="c0", category="SPORT", wp=95.0)]
    d = features.training_dataset(frame(spark, rows), contents(spark, TOKENS, TOKENS)).collect()
    assert [r["event_id"] for r in d] == ["b"] and d[0]["category_affinity"] == pytest.approx(0.574443)


def test_warmup_and_probes(spark):
    past = [row(f"p{i}", ts=T0 + i, event_type="CONTENT_LIKED", content="c0", category="SPORT") for i in range(3)]
    now = [row("n", ts=T0 + 10, content="c0", category="SPORT", wp=80.0)]
    c = contents(spark, TOKENS, TOKENS)
    warm = features.with_warmup(frame(spark, now), frame(spark, past), c).collect()
    assert [r["event_id"] for r in warm] == ["n"] and warm[0]["category_affinity"] == pytest.approx(0.710950)
    cand = spark.createDataFrame([("u", "c0", "k-c0", "SPORT"), ("u", "c1", "k-c1", "SPORT")], "user_id string, content_id string, creator_id string, category string")
    probes = features.score_time_features(frame(spark, past), cand, c, T0 + 10).select("content_id", "category_affinity", "user_total_interaction_count", "session_category_streak").collect()
    assert {r["content_id"] for r in probes} == {"c0", "c1"}
    assert all(r["category_affinity"] == pytest.approx(0.710950) and r["session_category_streak"] == 3.0 for r in probes)


def test_replay_saturation(spark):
    rows = [row(i, ts=T0 + i, content="c0", category="SPORT", wp=50.0) for i in range(8)]
    from signalloom.operators.profiles import with_replay_weight

    w = with_replay_weight(frame(spark, rows)).orderBy("ts_us").select("w10").collect()
    assert [r["w10"] for r in w] == [10, 10, 6, 3, 1, 0, 0, 0]


@pytest.mark.parametrize("heavy_rows", [10**9, 7])
def test_prior_state_kinds(spark, heavy_rows):
    df = spark.range(60).select(F.lit("k").alias("k"), (F.col("id") % 3).alias("g"), F.col("id").alias("at"), F.col("id").alias("v"), F.col("id").cast("string").alias("event_id"))
    fam = Family(keys=["g"], ordered=True, sums={"s": F.col("v")}, maxs={"m": F.col("v")}, lasts={"l": F.when(F.col("v") % 2 == 0, F.col("v"))})
    for r in prior_state(df, ["k"], "at", [fam], heavy_rows=heavy_rows).collect():
        before = [v for v in range(r["v"]) if v % 3 == r["g"]]
        even = [v for v in before if v % 2 == 0]
        assert (r["s"], r["m"], r["l"]) == (sum(before), max(before, default=None), even[-1] if even else None)


def test_snapshot_equals_event_replay(spark):
    """A nested profile snapshot gives the features that the raw rows give."""
    from signalloom.schemas import PROFILE_SNAPSHOT

    rows = [row("a", ts=T0, event_type="CONTENT_LIKED", content="c0", category="SPORT"), row("b", ts=T0 + MIN, content="c2", category="MUSIC", wp=95.0, event_type="VIDEO_COMPLETED")]
    now, c = T0 + 5 * MIN, contents(spark, TOKENS, TOKENS)
    cand = spark.createDataFrame([("u", "c0", "k-c0", "SPORT"), ("u", "c3", "k-c3", "MUSIC")], "user_id string, content_id string, creator_id string, category string")
    import datetime as dt

    at = lambda us: dt.datetime.fromtimestamp(us / 1e6, dt.timezone.utc).replace(tzinfo=None)
    cat = lambda name, done, watch, total, raw, when, recent: (name, 1, 1, 0, done, watch, total, raw, raw, at(when), 0, None, recent)
    snap = [("u", 1, 2, [], ["c0", "c2"], [cat("SPORT", 0, 0, 0.0, 3.0, T0, []), cat("MUSIC", 1, 1, 95.0, 4.0, T0 + MIN, [(at(T0 + MIN), 95.0, True, False, False, False)])],
             [("k-c0", 1, 0), ("k-c2", 1, 1)],
             [("hashtag", "A", 2, 2, 0, 7.0, 0), ("hashtag", "B", 1, 1, 0, 3.0, 0), ("hashtag", "C", 1, 1, 0, 4.0, 0)])]
    s = {r["content_id"]: r for r in features.snapshot_features(spark.createDataFrame(snap, PROFILE_SNAPSHOT), cand, c, now).collect()}
    e = {r["content_id"]: r for r in features.score_time_features(frame(spark, rows), cand, c, now).collect()}
    for cid in ("c0", "c3"):
        for col in ("category_affinity", "recent_category_watch_percentage", "category_completion_rate", "hashtag_affinity", "already_seen", "creator_interaction_count",
                    "user_total_interaction_count", "content_age_hours", "strongest_semantic_affinity"):
            assert s[cid][col] == pytest.approx(e[cid][col], abs=1e-6), (cid, col)


def test_slices_hold_equal_counts_for_bursts(spark):
    """Ten outliers around a burst of one key, and a light key beside it."""
    rows = [("hot", 1_000_000 + i) for i in range(4_000)] + [("hot", i * 10**12) for i in range(10)] + [("light", i) for i in range(50)]
    df = spark.createDataFrame(rows, "user_id string, at long")
    heavy = running.heavy_keys(df, ["user_id"], "at", 400)
    sliced = running.add_slice(df, ["user_id"], "at", heavy)
    sizes = {(r["user_id"], r["_b"]): r["count"] for r in sliced.groupBy("user_id", "_b").count().collect()}
    assert max(sizes.values()) <= 800 and sizes[("light", 0)] == 50 and len(sizes) >= 10
    assert running.heavy_keys(df, ["user_id"], "at", 10_000) is None


def test_vectors_know_only_earlier_events(spark):
    """Cutting the history at an event leaves its vector, and those before it, as they were; hot users split alike."""
    from signalloom.operators import retrieval

    rows = random_rows(120, 9)
    c = contents(spark, TOKENS, TOKENS)
    cats = sorted({r["category"] for r in rows})
    pick = lambda rows, **kw: {r["event_id"]: [round(x, 9) for x in r["user_vector"]] for r in retrieval.vectors_before(frame(spark, rows), c, cats, **kw).collect()}
    whole = pick(rows)
    assert whole and len(next(iter(whole.values()))) == 3 * len(cats) + 4 + retrieval.SEMANTIC_DIM
    middle = sorted(r["ts_us"] for r in rows)[60]
    assert pick([r for r in rows if r["ts_us"] <= middle]) == {e: v for e, v in whole.items() if e in {r["event_id"] for r in rows if r["ts_us"] <= middle}}
    assert pick(rows, heavy_rows=15) == whole


def test_state_is_spread_by_rows(spark):
    """The windows of many rows go over as many tasks as their number asks for, whatever the session's own number is."""
    df = spark.range(1000).select((F.col("id") % 200).cast("string").alias("user_id"), F.col("id").alias("at"), F.col("id").cast("string").alias("event_id"))
    assert running.load(df, ["user_id"], "at", 10_000, task_rows=30) == (None, 34)
    assert running.load(df, ["user_id"], "at", 10_000, task_rows=1000) == (None, None)
    fam = running.Family(sums={"n": F.lit(1)})
    out = running.prior_state(df, ["user_id"], "at", [fam], heavy=None, tasks=34).withColumn("_task", F.spark_partition_id()).cache()
    assert out.select("_task").distinct().count() > 17
    assert out.agg(F.sum("n")).first()[0] == 200 * (0 + 1 + 2 + 3 + 4)
    out.unpersist()
