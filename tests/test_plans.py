"""End-to-end plans on small tables, adaptation by hand, the decision log round trip."""

import math

import pytest
from pyspark.sql import functions as F

from signalloom.operators import adaptation, decisions, features, training
from signalloom.plans import recommend as plan
from signalloom.registry import modelling
from signalloom.sources import adapter
from tests.helpers import DAY, MIN, T0, contents, frame, random_rows, row


def test_adaptation_by_hand(spark):
    rows = [row(f"a{i}", ts=T0 + i * MIN, event_type="CONTENT_LIKED", content="c0", category="SPORT") for i in range(2)]
    rows += [row(f"b{i}", ts=T0 + (3 + i) * MIN, event_type="VIDEO_COMPLETED", wp=95.0, content=f"c{i + 1}", category="MUSIC") for i in range(3)]
    sw = spark.createDataFrame([("u", "SPORT", "MUSIC", T0 + 2 * MIN)], "user_id string, previous_category string, new_category string, from_us long")
    t = adaptation.adaptation_trace(frame(spark, rows), contents(spark, ["c0", "c1", "c2", "c3"]), sw)
    got = t.orderBy("event_number").collect()
    decay = lambda m: math.exp(-math.log(2) / 5 * m)
    for n, r in enumerate(got, 1):
        now = 2 + n
        old = 3 * (decay(now) + decay(now - 1))
        new = 4 * sum(decay(now - 3 - i) for i in range(n))
        assert r["previous_affinity"] == pytest.approx(1 / (1 + math.exp(-old / 10)), abs=1e-6)
        assert r["new_affinity"] == pytest.approx(1 / (1 + math.exp(-new / 10)), abs=1e-6)
        assert r["new_outranks_previous"] == (new > old)
    first = next(n for n, r in enumerate(got, 1) if r["new_outranks_previous"])
    assert adaptation.adaptation_latency(t).first()["crossover_at"] == first


def test_recommend_and_log(spark, tmp_path):
    rows = frame(spark, random_rows(80, seed=8, users=3, span=2 * DAY))
    c = contents(spark, [f"c{i}" for i in range(14)]).withColumn("category", F.when(F.col("content_id").isin("c0", "c1", "c4", "c5", "c6"), "SPORT").otherwise("MUSIC"))
    now = T0 + 3 * DAY
    out = plan.recommend(rows, c, now, plan.column_score(training.linear_score({"category_affinity": 2.0})), limit=5, pool=20).collect()
    seen = {(r["user_id"], r["content_id"]) for r in rows.where("event_type <> 'CONTENT_NOT_INTERESTED'").collect()}
    by = {}
    for r in out:
        assert (r["user_id"], r["content_id"]) not in seen
        by.setdefault(r["user_id"], []).append(r)
    assert set(by) == {"u0", "u1", "u2"}
    for recs in by.values():
        recs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in recs] == [1, 2, 3, 4, 5] and len({r["content_id"] for r in recs}) == 5
    final = spark.createDataFrame([(r["user_id"], r["content_id"], r["category"], r["score"], r["rank"], r["pre_rank"], r["model_score"]) for r in out],
                                  "user_id string, content_id string, category string, score double, rank int, pre_rank int, model_score double")
    from signalloom.operators import features

    cand = final.join(c.select("content_id", "creator_id"), "content_id").select("user_id", "content_id", "creator_id", "category")
    f = features.score_time_features(rows, cand, c, now)
    log = decisions.snapshot(final, f, model_version="v1", ranking_us=now, request=F.col("user_id"))
    decisions.write_log(log, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 15 and back.where("problem is not null").count() == 0
    vec = back.select(decisions.read_payload(F.col("features")).alias("v")).where("v is null").count()
    assert vec == 0
    later = frame(spark, [row("z1", by["u0"][0]["user_id"], by["u0"][0]["content_id"], now + 1, "CONTENT_SHARED"), row("z2", "u0", by["u0"][1]["content_id"], now, wp=10.0),
                          row("z3", "u0", by["u0"][2]["content_id"], now - 1, "CONTENT_SHARED")])
    res = {r["content_id"]: r for r in decisions.resolve_outcomes(back, later).where("user_id = 'u0'").collect()}
    grades = [res[r["content_id"]]["relevance"] for r in by["u0"]]
    assert grades == [4, 0, None, None, None]
    groups = {r["request_id"]: r["reason"] for r in decisions.validate_groups(decisions.resolve_outcomes(back, later)).collect()}
    assert groups["internal-correlation-only:u0"] is None and groups["internal-correlation-only:u1"] == "ZERO_RESOLVED"
    with pytest.raises(decisions.RankingInputError):
        decisions.check_training_input(decisions.resolve_outcomes(back, later), ["final_score"], volume_confirmed=False)


def test_permuted_values_travel_without_other_columns(spark):
    """Importance equals a plain model on shifted rows; only what the model reads is carried along."""
    class Sum:
        numeric, categorical = ["a", "b"], []

        def score(self, rows):
            assert "_repeat" not in rows.columns or "ballast" not in rows.columns
            return rows.withColumn("model_score", F.col("a") + F.col("b") / 10)

    data = [(f"u{n % 7}", f"c{n}", n, n * 37 % 11, n * 53 % 13, int(n * 37 % 11 > 4), "x" * 50) for n in range(60)]
    rows = spark.createDataFrame(data, "user_id string, content_id string, ts_us long, a long, b long, target int, ballast string")
    got = {r["feature"]: r for r in training.permutation_importance(Sum(), rows, ["a", "b"], repeats=3).collect()}
    order = rows.select("a", "b", "target").orderBy(F.xxhash64(F.lit(42), "user_id", "content_id", "ts_us")).collect()

    def auc(pairs):
        good, bad = [p for p, y in pairs if y], [p for p, y in pairs if not y]
        return sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)

    n = len(order)
    full = auc([(r["a"] + r["b"] / 10, r["target"]) for r in order])
    for f in ("a", "b"):
        other = [[order[(i + n * k // 4) % n] for i in range(n)] for k in (1, 2, 3)]
        lost = [full - auc([((o if f == "a" else r)["a"] + (o if f == "b" else r)["b"] / 10, r["target"]) for r, o in zip(order, shifted)]) for shifted in other]
        assert abs(got[f]["importance_mean"] - sum(lost) / 3) < 1e-9


def test_importance_of_a_linear_model_is_that_of_scored_rows(spark, monkeypatch):
    """All blocks, rims and ranges give what scoring each permuted row gives; categories and unknown features count too."""
    data = [(f"u{n % 17}", f"c{n}", n, "ABC"[n * 7 % 3], float(n * 37 % 11), float(n * 53 % 13) if n % 9 else None, float(n % 4), int((n * 37 % 11) + (n * 7 % 3) * 2 + n % 5 > 8)) for n in range(401)]
    rows = spark.createDataFrame(data, "user_id string, content_id string, ts_us long, kind string, a double, b double, other double, target int").repartition(3).cache()
    weighted = rows.withColumn("fit_weight", F.lit(1.0))
    centers = {"a": (5.0, 4.0), "b": (6.0, 7.0)}
    model = training.Pipeline(stages=[*training.stages(["a", "b"], ["kind"]), training.algorithms(401, 1, 1)["LogisticRegression"]]).fit(training.prepare(weighted, ["a", "b"], ["kind"], centers))
    s = training.Scorer("LogisticRegression", model, ["a", "b"], ["kind"], centers)

    class Rows:
        numeric, categorical, score = s.numeric, s.categorical, s.score

    monkeypatch.setattr(training, "BLOCK_ROWS", 60)
    monkeypatch.setattr(training, "RANKED_ROWS", 90)
    read = lambda scorer: {r["feature"]: (r["importance_mean"], r["importance_std"]) for r in training.permutation_importance(scorer, rows, ["kind", "a", "b", "other"]).collect()}
    got, want = read(s), read(Rows())
    assert set(got) == {"kind", "a", "b", "other"} and got["other"] == (0.0, 0.0) and got["a"][0] > 0.01
    assert all(abs(x - y) < 1e-9 for f in want for x, y in zip(got[f], want[f]))
    s.calibration = (2.0, -0.3)
    assert all(abs(x - y) < 1e-9 for f in want for x, y in zip(read(s)[f], want[f]))
    with_none = training.permutation_importance(s, rows.where("ts_us < 3"), ["a"]).collect()
    assert len(with_none) == 1 and training.permutation_importance(s, rows.where("ts_us < 0"), ["a"]).collect() == []


def test_importance_covers_all_features(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(training, "train_candidates", lambda *a, **kw: {"LogisticRegression": None})
    monkeypatch.setattr(training, "permutation_importance", lambda scorer, rows, names, **kw: asked.extend(names))
    modelling.permutation_importance(spark, "/root/testdata/sf0.001")
    assert sorted(asked) == sorted(features.FEATURES)


def test_candidates_are_fitted_in_full(spark, monkeypatch):
    """The registered query asks for the reference's 120 trees and 200 boosting rounds, and the algorithms have them."""
    asked = []
    monkeypatch.setattr(training, "fit_weights", lambda rows, **kw: rows)
    monkeypatch.setattr(training, "algorithms", lambda n, trees, rounds, algorithms=training.algorithms: asked.append(algorithms(n, trees, rounds)) or {})
    columns = {c: F.lit("a") if c in features.CATEGORICAL else F.lit(1.0) for c in features.FEATURES}
    monkeypatch.setattr(modelling, "_dataset", lambda spark, d: spark.range(5).select(*[v.alias(c) for c, v in columns.items()]))
    assert modelling.train_candidates(spark, "") is None
    assert asked[0]["RandomForest"].getNumTrees() == 120 and asked[0]["GradientBoosting"].getMaxIter() == 200


def test_a_catalog_is_not_broadcast_by_the_size_of_its_file(spark, tmp_path):
    parts = spark.range(300_000).select(F.col("id").alias("p_partkey"), F.lit("large ring").alias("p_name"), F.lit("Brand#7").alias("p_brand"), F.lit("LARGE").alias("p_type"),
                                        F.lit(1).cast("int").alias("p_size"), F.lit(900.0).alias("p_retailprice"))
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    catalog = adapter.contents(spark, str(tmp_path))
    estimated = int(str(catalog._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert estimated > 10 << 20  # rows take more than the 10 MB up to which a side is broadcast; the file takes less
