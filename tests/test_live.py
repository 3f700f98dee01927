"""LIVE sessions by hand, against a plain fold, and in batch against streaming."""

import random
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from signalloom.operators import live
from signalloom.streaming import sessions as session_stream, state

SEC = 1_000_000
SCHEMA = ("event_id string, user_id string, content_id string, creator_id string, category string, event_type string, watch_time_seconds double, liked boolean, "
          "shared boolean, commented boolean, creator_followed boolean, ts_us long, id long")
T0 = 1_704_067_200_000_000
COMPARE = ["user_id", "content_id", "joined_us", "ended_us", "joined", "impression", "watch_us", "reconnect_count", "like_count", "gift_count", "not_interested_count", "exclusion_reason"]


def ev(i, t, kind, watch=None, user="u", stream="s", **kw):
    base = dict(event_id=f"e{i:05d}", user_id=user, content_id=stream, creator_id="k", category="C", event_type=kind, watch_time_seconds=watch, liked=False, shared=False,
                commented=False, creator_followed=False, ts_us=T0 + t * SEC, id=i)
    return tuple((base | kw).values())


def sessions(spark, events, **kw):
    df = spark.createDataFrame(events, SCHEMA)
    return [r.asDict() for r in live.live_sessions(df, **kw).orderBy("user_id", "content_id", "joined_us").collect()]


def test_reconnect_within_grace_continues(spark):
    s = sessions(spark, [ev(1, 0, "LIVE_JOINED"), ev(2, 40, "LIVE_LEFT"), ev(3, 70, "LIVE_JOINED"), ev(4, 100, "LIVE_LEFT")])
    assert [(x["watch_us"], x["reconnect_count"], x["exclusion_reason"]) for x in s] == [(70 * SEC, 1, None)]


def test_later_join_starts_new_session(spark):
    s = sessions(spark, [ev(1, 0, "LIVE_JOINED"), ev(2, 40, "LIVE_LEFT"), ev(3, 71, "LIVE_JOINED")])
    assert [(x["watch_us"], x["exclusion_reason"]) for x in s] == [(40 * SEC, None), (0, "OPEN_ENDED")]


def test_left_without_join(spark):
    s = sessions(spark, [ev(1, 0, "LIVE_IMPRESSION"), ev(2, 9, "LIVE_LEFT", 30.0), ev(3, 200, "LIVE_JOINED")])
    assert [(x["watch_us"], x["exclusion_reason"], x["impression"]) for x in s] == [(0, "UNMATCHED_LEFT", True)]


def test_explicit_and_pending_watch_time(spark):
    s = sessions(spark, [ev(1, 0, "LIVE_WATCHED", 5.0), ev(2, 10, "LIVE_JOINED"), ev(3, 12, "LIVE_WATCHED", 90.0), ev(4, 20, "LIVE_LEFT"), ev(5, 25, "LIVE_WATCHED", 300.0),
                         ev(6, 30, "LIVE_JOINED"), ev(7, 40, "LIVE_LEFT", 7.0), ev(7, 40, "LIVE_LEFT", 7.0)])
    assert [x["watch_us"] for x in s] == [307 * SEC]


def by_hand(events, grace=30 * SEC):
    """Sessions from the rules: cut each viewer's events into stays and gaps, then add the stays up."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    by = {}
    for e in events:
        r = dict(zip(names, e))
        by.setdefault((r["user_id"], r["content_id"]), {})[r["event_id"]] = r
    out = []
    for key, rows in by.items():
        ordered = sorted(rows.values(), key=lambda x: (x["ts_us"], x["event_id"]))
        inside = [next((p["event_type"] == "LIVE_JOINED" for p in reversed(ordered[:i]) if p["event_type"] in ("LIVE_JOINED", "LIVE_LEFT")), False) for i in range(len(ordered))]
        starts = [i for i, r in enumerate(ordered) if r["event_type"] == "LIVE_JOINED" and not inside[i]]
        ends = [i for i, r in enumerate(ordered) if r["event_type"] == "LIVE_LEFT" and inside[i]]
        last_end = lambda i: max((e for e in ends if e < i), default=None)
        fresh = [i for i in starts if last_end(i) is not None and ordered[i]["ts_us"] - ordered[last_end(i)]["ts_us"] > grace]
        for lo, hi in zip([0, *fresh], [*fresh, len(ordered)]):
            own = range(lo, hi)
            micros = lambda i: None if ordered[i]["watch_time_seconds"] is None else round(ordered[i]["watch_time_seconds"] * SEC)
            total, reading = 0, {i: micros(i) for i in own if ordered[i]["event_type"] == "LIVE_WATCHED" and micros(i) is not None}
            for i in own:
                if i in reading and not inside[i]:
                    total = max(total, reading[i])
                if i in ends:
                    begin = max(s for s in starts if s < i)
                    during = [reading[k] for k in range(begin, i) if k in reading and inside[k]]
                    total += micros(i) if micros(i) is not None else max([ordered[i]["ts_us"] - ordered[begin]["ts_us"], *during])
            marks = [i for i in own if ordered[i]["event_type"] in ("LIVE_JOINED", "LIVE_LEFT")]
            stray = any(ordered[i]["event_type"] == "LIVE_LEFT" and not inside[i] for i in own)
            n = lambda kind, flag=None: sum(ordered[i]["event_type"] == kind or bool(flag and ordered[i][flag]) for i in own)
            out.append({
                "user_id": key[0], "content_id": key[1], "joined_us": ordered[lo]["ts_us"], "ended_us": ordered[hi - 1]["ts_us"],
                "joined": bool(reading) or n("LIVE_JOINED") > 0, "impression": n("LIVE_IMPRESSION") > 0, "watch_us": total,
                "reconnect_count": sum(i in starts and last_end(i) is not None and i not in fresh for i in own), "like_count": n("LIVE_LIKED", "liked"), "gift_count": n("LIVE_GIFT_SENT"),
                "not_interested_count": n("LIVE_NOT_INTERESTED"),
                "exclusion_reason": "UNMATCHED_LEFT" if stray else "OPEN_ENDED" if marks and ordered[marks[-1]]["event_type"] == "LIVE_JOINED" else None})
    return out


def random_events(n, seed, span=4000):
    rng = random.Random(seed)
    kinds = ["LIVE_JOINED", "LIVE_LEFT", "LIVE_WATCHED", "LIVE_IMPRESSION", "LIVE_LIKED", "LIVE_GIFT_SENT", "LIVE_NOT_INTERESTED"]
    return [ev(i, rng.randrange(span), (k := rng.choice(kinds[:3] * 2 + kinds)), round(rng.uniform(0, 200), 1) if k in ("LIVE_WATCHED", "LIVE_LEFT") and rng.random() < 0.5 else None,
               f"u{rng.randrange(3)}", f"s{rng.randrange(2)}") for i in range(n)]


@pytest.mark.parametrize("heavy_rows", [10**9, 15])
def test_windows_equal_the_rules(spark, heavy_rows):
    events = random_events(300, 7)
    pick = lambda rows: sorted(tuple(str(r[c]) for c in COMPARE) for r in rows)
    assert pick(sessions(spark, events, heavy_rows=heavy_rows)) == pick(by_hand(events))


@pytest.mark.parametrize("seed", [11, 12])
def test_shuffled_micro_batches_equal_the_rules(spark, tmp_path, seed):
    """Events come out of order, in micro-batches within the watermark's reach; later ticks move it beyond the last session."""
    events, rng = sorted(random_events(120, seed), key=lambda e: e[11]), random.Random(seed)
    parts = [events[a : a + 30] + rng.sample(events[a : a + 30], 5) for a in range(0, 120, 30)]  # some events twice
    ticks = [[ev(90_000 + n, t, "LIVE_IMPRESSION", user="tick", stream=f"t{n}")] for n, t in enumerate((500_000, 600_000))]
    for n, rows in enumerate([*map(lambda p: rng.sample(p, len(p)), parts), *ticks]):
        df = spark.createDataFrame(rows, SCHEMA).withColumn("timestamp", F.timestamp_micros("ts_us"))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = session_stream.live_session_stream(src, watermark="3000 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = [r.asDict() for r in spark.read.parquet(str(tmp_path / "out")).where("user_id <> 'tick'").collect()]
    pick = lambda rows: sorted(tuple(str(r[c]) for c in COMPARE) for r in rows)
    assert pick(got) == pick(by_hand(events))


@pytest.mark.parametrize("seed", [21, 22, 23])
def test_one_pass_equals_the_rules(seed):
    """Sessions of a user's streams from one pass over unordered events, some of them twice."""
    events = random_events(200, seed)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    by = {}
    for e in random.Random(seed).sample(events + events[:40], 240):
        r = dict(zip(names, e))
        watch = None if r["watch_time_seconds"] is None else round(r["watch_time_seconds"] * SEC)
        counts = [int(r["event_type"] == k) for k in ("LIVE_LIKED", "LIVE_SHARED", "LIVE_COMMENTED", "LIVE_GIFT_SENT", "LIVE_CREATOR_FOLLOWED", "LIVE_NOT_INTERESTED")]
        by.setdefault((r["user_id"], r["content_id"]), []).append((r["content_id"], r["event_id"], r["creator_id"], r["category"], r["event_type"], r["ts_us"], watch, *counts))
    got = [dict(zip(session_stream._SESSION, s.row(*key))) for key, rows in by.items() for s in session_stream.sessions_of(rows, 30 * SEC)]
    pick = lambda rows: sorted(tuple(str(r[c]) for c in COMPARE) for r in rows)
    assert pick(got) == pick(by_hand(events))


def test_processor_travels_without_the_package(tmp_path):
    """Spark reads the processor in a worker of the driver that knows no package of the session."""
    file = tmp_path / "processor"
    file.write_bytes(cloudpickle.dumps(session_stream.LiveSessions(1, 2)))
    code = f"import pickle; print(pickle.load(open({str(file)!r}, 'rb')).idle_ms)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "", "PYTHONPATH": ""}, capture_output=True, text=True).stdout.strip() == "2"


def test_history_sees_only_ended_sessions(spark):
    s = spark.createDataFrame([("u", "s1", "C", "k", 10, 60 * SEC, True, 0), ("u", "s2", "C", "k", 10, 30 * SEC, True, 1), ("u", "s3", "C", "k", 11, 5 * SEC, False, 0)],
                              "user_id string, content_id string, category string, creator_id string, ended_us long, watch_us long, joined boolean, like_count int")
    for c in live._COUNTS[1:]:
        s = s.withColumn(c, F.lit(0))
    h = {r["content_id"]: r for r in live.session_history(s).collect()}
    assert (h["s1"]["u_n"], h["s2"]["u_n"], h["s3"]["u_n"]) == (0, 0, 2)
    assert h["s3"]["previous_live_watch_time_user"] == 90.0 and h["s3"]["category_join_rate"] == 1.0


def test_dynamic_state_stream_equals_batch(spark, tmp_path):
    events = random_events(200, 13, span=1500)
    df = spark.createDataFrame(events, SCHEMA).withColumn("timestamp", F.timestamp_micros("ts_us"))
    df.coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    tick = spark.createDataFrame([ev(90_000, 9000, "LIVE_IMPRESSION", user="tick", stream="t")], SCHEMA).withColumn("timestamp", F.timestamp_micros("ts_us"))
    tick.coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = state.dynamic_state_stream(src, slide="300 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    end = T0 + 1200 * SEC
    got = {r["content_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).where(F.unix_micros("at") == end).collect()}
    want = {r["content_id"]: r for r in live.dynamic_state(spark.createDataFrame(events, SCHEMA).where(F.col("ts_us") < end), end).collect()}
    assert set(got) == set(want) and got
    for k, w in want.items():
        for c in ("current_viewer_count", "viewer_growth_rate", "recent_likes", "recent_gifts"):
            assert got[k][c] == w[c], (k, c)


def test_intent_stream_replaces_and_expires(spark, tmp_path):
    rows = [("u", "a", 0), ("u", "b", 60), ("v", "c", 30)]
    mk = lambda rs: spark.createDataFrame([(u, i, T0 + t * SEC) for u, i, t in rs], "user_id string, intent string, us long").select("user_id", "intent", F.timestamp_micros("us").alias("timestamp"))
    df = mk(rows)
    df.coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    for n, t in enumerate((9000, 9100)):
        mk([("tick", "x", t)]).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = []
    q = state.intent_stream(src).writeStream.outputMode("update").foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.collect())).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    seen = [(u, i, a) for u, i, _, a in got if u != "tick"]
    assert sorted(seen) == [("u", "b", False), ("u", "b", True), ("v", "c", False), ("v", "c", True)]
