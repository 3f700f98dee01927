"""Bounded list picks against straightforward models, and exact retrieval with small blocks."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from signalloom.operators import lists, metrics, profiles, rerank, retrieval
from signalloom.registry import rerank as registry_rerank


def test_quota_fill_order(spark):
    rows = [("u", b, p, f"{'abcdef'[b]}{p}") for b in range(6) for p in range(1, 9)] + [("v", 3, 1, "x"), ("v", 4, 1, "x"), ("v", 4, 2, "y")]
    got = retrieval.quota_fill(spark.createDataFrame(rows, "user_id string, bucket int, place int, content_id string"), 12).orderBy("user_id", "position").collect()
    u = [r["content_id"] for r in got if r["user_id"] == "u"]
    assert u == ["a1", "a2", "b1", "b2", "c1", "c2", "d1", "d2", "e1", "e2", "f1", "a3"]
    assert [(r["content_id"], r["source"]) for r in got if r["user_id"] == "v"] == [("x", "TRENDING"), ("y", "NEW_CONTENT")]


def test_group_metrics_move_rows_once_and_do_not_depend_on_hot_groups(spark):
    rng = random.Random(5)
    rows = [(m, None if g == 9 else g, f"r{rng.randrange(40):02d}", rng.choice([0.1, 0.4, 0.4, 0.9]), rng.choice([0, 0, 0, 1, 2, None])) for m in "ab" for g in range(10) for _ in range(1 + g * 3)]
    rows += [("a", 7, "same", 0.4, 0), ("a", 7, "same", 0.4, 1), ("b", 20, "x", 0.5, 0), ("a", 21, "y", 0.5, None)]
    rows += [("a", 30, f"z{i:02d}", 1 - i / 50, int(i > 20)) for i in range(30)]
    df = spark.createDataFrame(rows, "model string, group_id long, row_id string, p double, y int")
    read = lambda out: {(r["model"], r["group_id"]): r.asDict() for r in out.collect()}
    once = metrics.group_metrics(df, ["model"], relevant=1, ks=[3, 5])
    got, want = read(once), read(metrics.group_metrics(df, ["model"], relevant=1, ks=[3, 5], heavy_rows=10))
    assert got["a", 30]["first_rank"] == 22 and len(got) == len(want) == 21
    for g, r in want.items():
        # Rows equal in score and id have no order, so only what does not depend on it is compared there.
        for c in ("n", "positives", "first_rank", "idcg3", "idcg5", *(["hits3", "hits5", "dcg3", "dcg5"] if g[1] != 7 else [])):
            assert got[g][c] == r[c] or abs(got[g][c] - r[c]) < 1e-12, (g, c, got[g], r)
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "WindowGroupLimit" not in plan


def test_top_k_profile_counts_values_of_each_group(spark):
    rng = random.Random(8)
    rows = [(s, None if g == 4 else g, n + 1, rng.choice(["x", "y", None]), rng.choice(["p", "q", "r"]), rng.randrange(2), rng.randrange(2)) for s in ("before", "after") for g in range(5) for n in range(g + 1)]
    df = spark.createDataFrame(rows, "stage string, group_id long, rank int, category string, creator_id string, already_seen int, y int")
    got = {(r["stage"], r["group_id"]): r for r in metrics.top_k_profile(df, 3, ["stage"]).collect()}
    assert len(got) == 8 and metrics.top_k_profile(df.where("stage = 'after'"), 3).count() == 4
    for (stage, g), r in got.items():
        top = [x for x in rows if x[0] == stage and x[1] == g and x[2] <= 3]
        assert r["n"] == len(top) and abs(r["seen_rate"] - sum(x[5] for x in top) / len(top)) < 1e-12 and abs(r["precision"] - sum(x[6] for x in top) / len(top)) < 1e-12
        for at, c in ((3, "category"), (4, "creator_id")):
            values = [x[at] for x in top]
            assert r[f"unique_{c}"] == len(set(values))
            assert abs(r[f"{c}_concentration"] - sum(values.count(v) ** 2 for v in set(values)) / len(top) ** 2) < 1e-12


def test_rerank_before_after_moves_rows_once(spark):
    """Both stages are those of the re-ranking itself and of a plain sort; rows move to their order once, without texts."""
    place = "/root/testdata/sf0.001"
    query = registry_rerank.rerank_before_after(spark, place)
    s = registry_rerank._scored(spark, place).withColumn("y", (F.col("category_affinity") > 0.5).cast("int")).cache()
    picked = {(r["user_id"], r["content_id"]): r["rank"] for r in rerank.rerank(s, 3).collect()}
    groups = {}
    for r in s.select("user_id", "content_id", "model_score", "already_seen", "y", "category", "creator_id").collect():
        groups.setdefault(r["user_id"], []).append(r)
    for got in query.collect():
        tops = []
        for rows in groups.values():
            if len(rows) > 1:
                rows = sorted(rows, key=lambda r: (-r["model_score"], r["content_id"]))
                tops.append(rows[:3] if got["stage"] == "before" else [r for r in rows if (r["user_id"], r["content_id"]) in picked])
        mean = lambda f: sum(map(f, tops)) / len(tops)
        assert abs(got["seen_rate"] - mean(lambda t: sum(r["already_seen"] for r in t) / len(t))) < 1e-6
        assert abs(got["precision"] - mean(lambda t: sum(r["y"] for r in t) / len(t))) < 1e-6
        assert abs(got["unique_category"] - mean(lambda t: len({r["category"] for r in t}))) < 1e-6
        assert abs(got["creator_id_concentration"] - mean(lambda t: sum(sum(r["creator_id"] == x["creator_id"] for x in t) for r in t) / len(t) ** 2)) < 1e-6
    plan = query._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(user_id") == 1


def test_dense_search_holds_the_best_of_a_block_only(spark):
    """Queries without a floor and many equal scores: memory goes by the depth, results are those of brute force."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(3)
    kinds, depth = rng.integers(-3, 4, (400, 8)).astype(float), rng.integers(5, 40, 1_024)
    items = pd.DataFrame({"item_id": [f"i{n:05d}" for n in range(8_192)], "vector": list(kinds[rng.integers(0, 400, 8_192)])})
    queries = pd.DataFrame({"query_id": np.arange(1_024), "vector": list(rng.integers(-3, 4, (1_024, 8)).astype(float)), "_depth": depth, "floor": [None] * 1_024})
    tracemalloc.start()
    got = retrieval._search(queries, items.sample(frac=1, random_state=1), None, retrieval._best_in_block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    scores = np.stack(queries["vector"]) @ np.stack(items["vector"]).T
    for q in (0, 1, 500, 1_023):
        best = np.lexsort((np.arange(8_192), -scores[q]))[: depth[q]]
        own = got[got["query_id"] == q]
        assert sorted(own["item_id"]) == sorted(items["item_id"].iloc[best])
    assert len(got) == depth.sum() and peak < 200e6


def test_first_unseen_is_exact(spark):
    rng = random.Random(2)
    cat = [(f"c{i:03d}", "k%d" % (i % 2), i) for i in range(80)]
    seen = [(f"u{u}", f"c{i:03d}") for u in range(4) for i in range(80) if rng.random() < (0.9 if u == 0 else 0.3)]
    c = spark.createDataFrame(cat, "content_id string, g string, o int")
    s = spark.createDataFrame(seen, "user_id string, content_id string")
    members = spark.createDataFrame([(f"u{u}", f"k{k}") for u in range(4) for k in range(2)], "user_id string, key string")
    got = {}
    for r in lists.first_unseen(lists.ranked_lists(c, "g", [F.col("o")]), members, s, 5, heavy_rows=6).collect():
        got.setdefault((r["user_id"], r["key"]), set()).add(r["content_id"])
    for u in range(4):
        for k in range(2):
            open_ = [x for x, g, _ in cat if g == f"k{k}" and (f"u{u}", x) not in set(seen)][:5]
            assert got.get((f"u{u}", f"k{k}"), set()) == set(open_)


def test_global_list_splits_ties(spark):
    df = spark.range(3000).select(F.format_string("c%05d", F.col("id")).alias("content_id"), F.when(F.col("id") % 10 > 0, 5).otherwise(F.col("id")).alias("o"))
    got = [(r["content_id"], r["pos"]) for r in lists.global_list(df, F.col("o")).orderBy("pos").collect()]
    want = sorted((5 if i % 10 else i, f"c{i:05d}") for i in range(3000))
    assert got == [(c, n + 1) for n, (_, c) in enumerate(want)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = lists.range_parts(df.withColumn("o", F.lit(1)), F.col("o")).groupBy("_part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(r["count"] for r in parts) < 3000 / len(parts) * 1.5


def test_live_pool(spark):
    rows = [("u", n, f"s{n}", f"c{n % 3}", "ACTIVE" if n != 4 else "ENDED", n % 2, n == 0, 0.2 if n == 7 else 0.0, 1000 - n, n == 3, 30.0) for n in range(10)]
    pool = spark.createDataFrame(rows, "user_id string, seq int, stream_id string, category string, status string, previous_live_interactions int, creator_followed boolean, "
                                       "viewer_growth_rate double, current_viewer_count int, region_match boolean, live_age_minutes double")
    got = [(r["stream_id"], r["source"]) for r in retrieval.live_pool_buckets(pool, 6).orderBy("position").collect()]
    # one per bucket: followed s0; preferred categories come from the two busiest (s1: c1, s3: c0); trending s2 (viewers >= 500); region s3; none new; exploration s5
    assert got == [("s0", "FOLLOWED_CREATOR"), ("s1", "PREFERRED_LIVE_CATEGORY"), ("s2", "TRENDING_LIVE"), ("s3", "REGION_MATCH"), ("s5", "EXPLORATION"), ("s6", "EXPLORATION")]


def _scored(spark, rows):
    cols = ["user_id", "content_id", "creator_id", "category", "model_score", "already_seen", "creator_followed", "category_affinity", "recent_category_watch_percentage", "content_popularity_score", "cold_start"]
    df = spark.createDataFrame([tuple(r) for r in rows], "user_id string, content_id string, creator_id string, category string, model_score double, cold_start boolean")
    df = df.withColumns({"already_seen": F.lit(0), "creator_followed": F.lit(0), "category_affinity": F.lit(0.5), "recent_category_watch_percentage": F.lit(0.0), "content_popularity_score": F.lit(0.1)})
    return df.select(*cols)


def test_greedy_caps_creator_and_runs(spark):
    rows = [("u", f"c{i}", "k0" if i < 4 else f"k{i}", "A" if i < 6 else "B", 0.9 - i / 100, False) for i in range(8)]
    got = rerank.rerank(_scored(spark, rows), 8).orderBy("rank").collect()
    cats, creators = [r["category"] for r in got], [r["creator_id"] for r in got]
    assert creators[0] == "k0" and len(got) == 8
    assert all(len(set(cats[i:i + 3])) > 1 for i in range(3))
    assert creators[:4].count("k0") <= 2


def test_every_candidate_of_a_large_request_is_scored(spark):
    rows = [("u", f"c{i:03d}", f"k{i}", "AB"[i % 2], 0.9 - i / 1000, False) for i in range(300)]
    adjusted = rerank.adjust_scores(_scored(spark, rows))
    assert adjusted.count() == 300
    assert rerank.adjust_scores(_scored(spark, rows), most=200).count() == 200


def test_cold_start_exploration_shows_new_categories(spark):
    rows = [("u", f"c{i}", f"k{i}", "A" if i < 12 else f"N{i}", 0.95 - i / 100, True) for i in range(16)]
    got = rerank.rerank(_scored(spark, rows), 10).orderBy("rank").collect()
    assert len({r["content_id"] for r in got}) == 10 and len({r["category"] for r in got}) > 1
    again = rerank.rerank(_scored(spark, rows[::-1]), 10).orderBy("rank").collect()
    assert [r["content_id"] for r in got] == [r["content_id"] for r in again]


def test_live_rerank_appends_skipped(spark):
    rows = [("u", f"s{i}", "k", "A", 0.9 - i / 10, False) for i in range(4)]
    df = spark.createDataFrame(rows, "user_id string, content_id string, creator_id string, category string, model_score double, cold_start boolean").withColumns({
        "creator_followed": F.lit(False), "live_category_affinity": F.lit(0.5), "viewer_growth_rate": F.lit(0.0), "region_match": F.lit(False)})
    for c, t in {"recent_likes": "long", "recent_gifts": "long", "already_joined": "boolean", "not_interested": "boolean"}.items():
        df = df.withColumn(c, F.lit(None).cast(t))
    got = rerank.live_rerank(df, 3).orderBy("rank").collect()
    assert [r["content_id"] for r in got] == ["s0", "s1", "s2"] and got[0]["score"] == 0.9


def test_top_k_blocks(spark):
    rng = np.random.default_rng(0)
    q, i = rng.normal(size=(30, 8)), rng.normal(size=(70, 8))
    qd = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(q)], "query_id long, vector array<double>")
    idf = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(i)], "item_id long, vector array<double>")
    seen = spark.createDataFrame([(a, b) for a in range(30) for b in range(70) if (a + b) % 3 == 0], "query_id long, item_id long")
    got = {}
    for r in retrieval.retrieve_top_k(qd, idf, 5, seen=seen).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    for a in range(30):
        s = sorted((-round(float(q[a] @ i[b]), 9), b) for b in range(70) if (a + b) % 3)
        assert got[a] == [b for _, b in s[:5]]


def test_top_k_of_text_ids_with_blocks_nobody_asks(spark):
    rng = np.random.default_rng(3)
    q, i = np.round(rng.normal(size=(3, 4)), 3), np.round(rng.normal(size=(90, 4)), 3)
    frame_ = lambda v, p: spark.createDataFrame([(f"{p}{n:02d}", [float(x) for x in r]) for n, r in enumerate(v)], f"{'query_id' if p == 'q' else 'item_id'} string, vector array<double>")
    got = {}
    for r in retrieval.retrieve_top_k(frame_(q, "q"), frame_(i, "i"), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    assert got == {f"q{a:02d}": [f"i{b:02d}" for _, b in sorted((-round(float(q[a] @ i[b]), 9), b) for b in range(90))[:4]] for a in range(3)}


def test_rows_travel_once_for_each_group(spark, monkeypatch):
    """Where bounds keep nothing out, a query goes to each group of items, not to each block; copies split over cells."""
    rng = np.random.default_rng(4)
    i = np.round(rng.normal(size=(240, 12)), 2)
    i[100:190] = i[0]
    frame_ = lambda name: spark.createDataFrame([(n, [float(x) for x in r]) for n, r in enumerate(i)], f"{name} long, vector array<double>")
    asked, plain = spark.sparkContext.accumulator(0), retrieval._search

    def counting(queries, items, cells, best):
        asked.add(len(queries))
        return plain(queries, items, cells, best)

    monkeypatch.setattr(retrieval, "_search", counting)
    got = {}
    for r in retrieval.retrieve_top_k(frame_("query_id"), frame_("item_id"), 6, group_rows=60).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    assert got == {a: [b for _, b in sorted((-round(float(i[a] @ i[b]), 9), b) for b in range(240))[:6]] for a in range(240)}
    assert asked.value <= 240 * 7  # home, and five or six groups; blocks are fifteen


def test_far_blocks_are_not_searched(spark):
    """Tight clusters in many directions: a query is shipped to few of the blocks, and ties at the last place stay exact."""
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(12, 6)) * 9
    i = np.round(np.concatenate([m + rng.normal(size=(25, 6)) * 0.2 for m in middle]), 2)
    i[7] = i[8] = i[9]
    frame_ = lambda v, name: spark.createDataFrame([(n, [float(x) for x in r]) for n, r in enumerate(v)], f"{name} long, vector array<double>")
    q = middle[rng.integers(0, 12, 40)] + rng.normal(size=(40, 6)) * 0.1
    counted = spark.sparkContext.accumulator(0)
    plain = retrieval._best_in_block

    def counting(asked, items):
        counted.add(len(asked) * len(items))
        return plain(asked, items)

    retrieval._best_in_block = counting
    try:
        rows = retrieval.retrieve_top_k(frame_(q, "query_id"), frame_(i, "item_id"), 4).orderBy("query_id", "rank").collect()
    finally:
        retrieval._best_in_block = plain
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append(r["item_id"])
    assert got == {a: [b for _, b in sorted((-round(float(q[a] @ i[b]), 9), b) for b in range(len(i)))[:4]] for a in range(40)}
    assert counted.value < 0.5 * len(q) * len(i)


def test_first_by_hash_equals_ranking(spark, monkeypatch):
    monkeypatch.setattr(profiles, "_SMALL", 3)
    monkeypatch.setattr(profiles, "_DIGITS", 1)
    rows = [(f"e{n % 190}", n % 3) for n in range(200)]
    df = spark.createDataFrame(rows, "event_id string, target int")
    sha = lambda e: hashlib.sha256(e.encode()).hexdigest()
    for n in (0, 1, 7, 40, 66, 500):
        got = profiles.first_by_hash(df, n, "target", (0, 1), "event_id")
        want = [x for v in (0, 1) for x in sorted((sha(e), e) for e, t in rows if t == v)[:n]]
        assert sorted((sha(r[0]), r[0]) for r in got.collect()) == sorted(want)
    plan = profiles.first_by_hash(df, 40, "target", (0, 1), "event_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith" in plan[plan.index("Window"):]  # only the last bin is ranked


def test_metric_edge_cases(spark):
    df = spark.createDataFrame([(1, "a", 1, 0.5), (1, "b", 1, 0.5), (2, "c", 1, 0.2)], "group_id long, row_id string, y int, p double")
    assert metrics.threshold_free(df).first().asDict() == {"roc_auc": 0.0, "average_precision": 0.0}
    assert metrics.select_threshold(df).first()["threshold"] == 0.5
    m = metrics.ranking_summary(metrics.group_metrics(df.withColumn("y", F.lit(0)))).first()
    assert m["recall_at_5"] == 0.0 and m["mrr"] == 0.0 and m["ndcg_at_5"] == 0.0
    rng = random.Random(1)
    rows = [(rng.randrange(3), f"r{n:03d}", rng.randrange(2), rng.randrange(5) / 5, rng.randrange(5) / 5) for n in range(60)]
    r = spark.createDataFrame(rows, "group_id long, row_id string, y int, p double, p_alt double")
    for x in [*metrics.pairwise_inversions(r).collect(), *metrics.pairwise_inversions(r, heavy_rows=6).collect()]:
        g = sorted((a for a in rows if a[0] == x["group_id"]), key=lambda a: a[1])
        assert x["inversions"] == sum((a[3] < b[3]) != (a[4] < b[4]) for n, a in enumerate(g) for b in g[n + 1:])
