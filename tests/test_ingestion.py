"""Streaming ingestion: counts, idempotence on replay, pending contents, registrations."""

import json
import shutil

from pyspark.sql import functions as F

from signalloom.operators import profiles
from signalloom.sources import ingest, jsonl
from signalloom.streaming import ingestion

CONTENT = "content_id string, creator_id string, category string, content_type string, is_active boolean"
def now():
    return F.to_timestamp(F.lit("2024-02-01T00:00:00Z"))


def message(i, content="c1", kind="VIDEO_WATCHED", at="2024-01-01T00:00:00Z", **kw):
    return json.dumps({"eventId": f"e{i}", "userId": "u1", "contentId": content, "creatorId": "k1", "category": "sport", "eventType": kind, "timestamp": at} | kw)


def test_behaviour_stream(spark, tmp_path):
    contents = spark.createDataFrame([("c1", "k1", "SPORT", "VIDEO", True), ("c2", "k1", "SPORT", "VIDEO", False), ("l1", "k1", "SPORT", "LIVE", True)], CONTENT)
    src, root = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()

    def put(name, values, start):
        (src / name).write_text("\n".join(json.dumps({"offset": start + n, "value": v}) for n, v in enumerate(values)))

    put("a.json", [message(1, watchTimeSeconds=95, contentDurationSeconds=100), message(1), "{bad", message(2, "c2"), message(3, "l1"), message(4, watchTimeSeconds=5),
                   message(5, "later"), message(6, kind="CONTENT_LIKED"), message(7, at="2024-01-01T00:00:00"), message(8, at="2030-01-01T00:00:00Z")], 0)
    run = lambda: ingestion.start(ingestion.json_source(spark, str(src)), ingestion.behaviour_batch(root, contents, now()), str(tmp_path / "ck"), available_now=True).awaitTermination(240)
    run()
    counts = {r["status"]: r["n"] for r in spark.read.parquet(f"{root}/counts").collect()}
    assert counts == {"valid": 4, "malformed": 1, "rejected": 2, "invalid": 3, "duplicate": 1}
    stored = {r["event_id"]: r for r in ingestion.read_interactions(spark, root).collect()}
    assert set(stored) == {"e1", "e5", "e6"} and stored["e1"]["watch_percentage"] == 95.0 and stored["e6"]["liked"] and stored["e5"]["content_pending"]
    assert [r["user_id"] for r in spark.read.parquet(f"{root}/users").collect()] == ["u1"]
    assert ingestion.latest_popularity(spark, root).collect()[0]["popularity"] == 0.668188
    # A second run brings a repeat and a new event; the same epoch replayed writes the same rows.
    put("b.json", [message(6, kind="CONTENT_LIKED"), message(9, kind="CONTENT_SHARED")], 100)
    run()
    assert ingestion.read_interactions(spark, root).count() == 4
    batch = spark.createDataFrame([(100, message(6, kind="CONTENT_LIKED")), (101, message(9, kind="CONTENT_SHARED"))], "offset long, value string")
    ingestion.behaviour_batch(root, contents, now())(batch, 1)
    assert ingestion.read_interactions(spark, root).count() == 4
    assert ingestion.latest_popularity(spark, root).collect()[0]["popularity"] == 0.768525
    ingestion.fold_sums(spark, root, 1)
    put("c.json", [message(10, kind="CONTENT_SHARED")], 200)
    run()
    raw = spark.read.parquet(f"{root}/sums").groupBy("content_id").agg(F.sum("raw")).collect()
    assert dict(raw)["c1"] == 4 + 3 + 5 + 5 and spark.read.parquet(f"{root}/sums_folded").where("content_id = 'c1'").first()["raw"] == 12
    all_rows = profiles.content_popularity(ingestion.read_interactions(spark, root), spark.createDataFrame([("c1",)], "content_id string"))
    assert ingestion.latest_popularity(spark, root).collect()[0]["popularity"] == all_rows.first()["popularity"]
    ingestion.content_batch(root)(spark.createDataFrame([("later", "k1", "SPORT", "VIDEO", True)], CONTENT), 0)
    assert not {r["event_id"]: r for r in ingestion.read_interactions(spark, root).collect()}["e5"]["content_pending"]


def test_batches_read_no_stored_interactions(spark, tmp_path):
    """With the stored rows gone, later batches still find duplicates, users, popularity and pending rows."""
    contents = spark.createDataFrame([("c1", "k1", "SPORT", "VIDEO", True)], CONTENT)
    root, run = str(tmp_path), ingestion.behaviour_batch(str(tmp_path), contents, now())
    batch = lambda *v: spark.createDataFrame(list(enumerate(v)), "offset long, value string")
    run(batch(message(1, kind="CONTENT_LIKED"), message(2, "later")), 0)
    shutil.rmtree(f"{root}/interactions")
    run(batch(message(1, kind="CONTENT_LIKED"), message(3, kind="CONTENT_LIKED")), 1)
    assert [r["event_id"] for r in ingestion.read_interactions(spark, root).collect()] == ["e3"]
    assert spark.read.parquet(f"{root}/users").count() == 1
    sums = spark.createDataFrame([("c1",)], "content_id string")
    assert ingestion.popularity_of(spark, root, sums, 1).first()["popularity"] > ingestion.popularity_of(spark, root, sums, 0).first()["popularity"]
    shutil.rmtree(f"{root}/interactions")
    ingestion.content_batch(root)(spark.createDataFrame([("later", "k1", "SPORT", "VIDEO", True)], CONTENT), 0)
    assert [r["event_id"] for r in spark.read.parquet(f"{root}/resolved").collect()] == ["e2"]
    run(batch(message(4)), 1)  # a replay that accepts other rows replaces the whole epoch
    assert [r["event_id"] for r in ingestion.read_interactions(spark, root).collect()] == ["e4"]


def test_mismatched_content_stays_pending(spark):
    p = spark.createDataFrame([("e1", "x", "VIDEO_WATCHED", True), ("e2", "y", "LIVE_JOINED", True)], "event_id string, content_id string, event_type string, content_pending boolean")
    c = spark.createDataFrame([("x", "LIVE"), ("y", "LIVE")], "content_id string, content_type string")
    assert {r["event_id"]: r["content_pending"] for r in ingest.resolve_pending(p, c).collect()} == {"e1": True, "e2": False}


def test_registrations_overwrite_only_known_fields(spark, tmp_path):
    root = str(tmp_path)
    reg = lambda uid, **kw: json.dumps({"type": "user.registered", "eventId": "e", "target": {"type": "user", "id": uid}, "data": {"userId": uid, "occurredAt": "2024-02-29T00:00:00Z"} | kw})
    batch = lambda *v: spark.createDataFrame(list(enumerate(v)), "offset long, value string")
    ingestion.registration_batch(root)(batch(reg("u", birthday="2000-03-01", region=" eu ", interests=["#Foot ball"]), reg("v", birthday="nonsense"), "{"), 0)
    ingestion.registration_batch(root)(batch(reg("u", region="much too long")), 1)
    got = {r["user_id"]: (r["age"], r["region"], r["interests"]) for r in ingestion.latest_contexts(spark, root).collect()}
    assert got == {"u": (23, "EU", ["FOOT_BALL"]), "v": (None, None, None)}


def test_jsonl_round_trip(spark, tmp_path):
    lines = ['{"exampleId": "a", "title": "Crème  brûlée", "labelSource": "SYNTHETIC"}', "", '{"exampleId": "b", "labelSource": "SYNTHETIC"}', "{oops", '{"exampleId": "c", "title": "x", "labelSource": "SYNTHETIC", "zzz": 1}']
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    good, bad = jsonl.load_records(jsonl.read_jsonl(spark, str(tmp_path / "in.jsonl")))
    assert [r["exampleId"] for r in good.collect()] == ["a"]
    assert sorted(r["message"] for r in bad.collect()) == ["BAD_JSON", "NO_TEXT_SIGNAL", "UNKNOWN_FIELD"]
    jsonl.write_jsonl(good, str(tmp_path / "out"))
    again, none = jsonl.load_records(jsonl.read_jsonl(spark, str(tmp_path / "out")))
    assert again.count() == 1 and none.count() == 0
