"""Small hand-made tables and a plain-Python model of the point-in-time rules."""

import math
import random

from pyspark.sql import types as T

MIN = 60_000_000
DAY = 86_400_000_000
T0 = 1_704_067_200_000_000

ROW = T.StructType([T.StructField(n, t) for n, t in [
    ("event_id", T.StringType()), ("user_id", T.StringType()), ("content_id", T.StringType()), ("creator_id", T.StringType()), ("category", T.StringType()),
    ("content_type", T.StringType()), ("event_type", T.StringType()), ("watch_time_seconds", T.DoubleType()), ("content_duration_seconds", T.DoubleType()),
    ("watch_percentage", T.DoubleType()), ("liked", T.BooleanType()), ("shared", T.BooleanType()), ("favorited", T.BooleanType()), ("commented", T.BooleanType()),
    ("creator_followed", T.BooleanType()), ("ts_us", T.LongType()), ("id", T.LongType()), ("is_training_context_only", T.BooleanType()), ("content_pending", T.BooleanType())]])


def row(event_id, user="u", content="c1", ts=T0, event_type="VIDEO_WATCHED", wp=None, category=None, creator=None, **kw):
    base = dict(event_id=str(event_id), user_id=user, content_id=content, creator_id=creator or f"k-{content}", category=category or f"cat-{content}".upper(), content_type="VIDEO",
                event_type=event_type, watch_time_seconds=None, content_duration_seconds=None, watch_percentage=wp, liked=False, shared=False, favorited=False,
                commented=False, creator_followed=False, ts_us=ts, id=0, is_training_context_only=False, content_pending=False)
    return base | kw


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in ROW.fields) for r in rows], ROW)


CONTENT = ("content_id string, creator_id string, category string, content_type string, popularity_score double, is_active boolean, created_us long, title string, "
           "hashtags array<string>, topics array<string>, entities array<string>, subgenres array<string>")


def contents(spark, ids, tokens=None):
    tokens = tokens or {}
    return spark.createDataFrame(
        [(c, f"k-{c}", f"cat-{c}".upper(), "VIDEO", 0.5, True, T0 - DAY, None, tokens.get(c, []), [], [], []) for c in ids], CONTENT)


KINDS = ["VIDEO_WATCHED", "VIDEO_SKIPPED", "VIDEO_COMPLETED", "VIDEO_REWATCHED", "CONTENT_LIKED", "CONTENT_SHARED", "CREATOR_FOLLOWED", "CONTENT_NOT_INTERESTED", "CONTENT_COMMENTED"]
TOKENS = {"c0": ["A", "B"], "c1": ["B"], "c2": ["C", "A"], "c3": []}
CATS = {"c0": "SPORT", "c1": "SPORT", "c2": "MUSIC", "c3": "MUSIC"}


def random_rows(n, seed=1, users=2, span=40 * DAY, ties=True):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        c = rng.choice(list(TOKENS))
        ts = T0 + (rng.randrange(span // (5 * MIN)) * 5 * MIN if ties else rng.randrange(span))
        kind = rng.choice(KINDS)
        wp = round(rng.uniform(0, 100), 4) if kind.startswith("VIDEO") and rng.random() < 0.8 else None
        out.append(row(f"e{i:04d}", f"u{rng.randrange(users)}", c, ts, kind, wp, CATS[c], liked=rng.random() < 0.05))
    return out


def affinity(x):
    return round(1 / (1 + math.exp(-x / 10)), 6)


def label(r, session=False):
    if "NOT_INTERESTED" in r["event_type"]:
        return 0
    liked, shared = r["liked"] or r["event_type"] == "CONTENT_LIKED", r["event_type"] == "CONTENT_SHARED"
    wp = r["watch_percentage"]
    extra = False if session else r["event_type"] in ("VIDEO_COMPLETED", "CREATOR_FOLLOWED")
    if (wp is not None and wp >= 70) or liked or shared or extra:
        return 1
    return 0 if wp is not None and wp < 20 else None


def brute_force(rows):
    """Features of every row by one plain pass over time-sorted batches of equal timestamps."""
    curve = [1.0, 1.0, 0.6, 0.3, 0.1]
    past, seen_n, tok, out = [], {}, {}, {}
    for ts in sorted({r["ts_us"] for r in rows}):
        batch = [r for r in rows if r["ts_us"] == ts]
        for r in batch:
            mine = [p for p in past if p["user_id"] == r["user_id"]]
            cat = [p for p in mine if p["category"] == r["category"]]
            rec = [p for p in cat if ts - p["ts_us"] <= 30 * DAY]
            ww = sum(p["w"] for p in rec if p["watch_percentage"] is not None)
            affs = []
            for t in TOKENS[r["content_id"]]:
                s = tok.get((r["user_id"], t))
                if s and s["w"] > 1e-9:
                    affs.append(affinity(s["raw"]))
            near = [p for p in mine if ts - p["ts_us"] <= 30 * MIN][-12:]
            eff = lambda p: math.exp(-math.log(2) / 5 * (ts - p["ts_us"]) / MIN) * p["w"]
            streak = val = 0.0
            if near:
                last = near[-1]
                for p in reversed(near):
                    if p["category"] != last["category"]:
                        break
                    streak += p["w"]
                sign = {1: 1, 0: -1, None: 0}[last["sl"]]
                for p in reversed(near):
                    if sign == 0 or p["category"] != last["category"] or p["sl"] != last["sl"]:
                        break
                    val += sign * p["w"]
            out[r["event_id"]] = {
                "category_affinity": affinity(sum(p["delta"] for p in cat)), "recent_category_affinity": affinity(sum(p["delta"] for p in rec)),
                "recent_category_watch_percentage": sum(p["w"] * p["watch_percentage"] for p in rec if p["watch_percentage"] is not None) / ww if ww else 0.0,
                "category_positive_count": math.log1p(sum(p["w"] for p in cat if p["label"] == 1)),
                "creator_interaction_count": math.log1p(sum(p["w"] for p in mine if p["creator_id"] == r["creator_id"])),
                "user_total_interaction_count": math.log1p(sum(p["w"] for p in mine)), "already_seen": int(any(p["content_id"] == r["content_id"] for p in mine)),
                "hashtag_affinity": sum(affs) / len(affs) if affs else 0.5,
                "session_category_affinity": affinity(sum(eff(p) * p["sd"] for p in near if p["category"] == r["category"])),
                "session_category_streak": streak, "session_category_streak_valence": val,
            }
        for r in sorted(batch, key=lambda x: (x["user_id"], x["event_id"])):
            p, kind, wp = dict(r), r["event_type"], r["watch_percentage"]
            liked = r["liked"] or kind == "CONTENT_LIKED"
            passive = kind.startswith("VIDEO") and not liked
            p["w"] = 1.0
            if passive:
                k = (r["user_id"], r["content_id"])
                seen_n[k] = seen_n.get(k, 0) + 1
                p["w"] = curve[seen_n[k] - 1] if seen_n[k] <= 5 else 0.0
            done = kind == "VIDEO_COMPLETED" or (wp or 0) >= 90
            reject = kind == "CONTENT_NOT_INTERESTED"
            base = 4 * done + 3 * liked + 5 * (kind == "CONTENT_SHARED") + 2 * (kind == "CONTENT_COMMENTED") + 6 * (kind == "CREATOR_FOLLOWED") + 4 * (kind == "VIDEO_REWATCHED") - 4 * (
                kind == "VIDEO_SKIPPED" and (wp or 0) < 20)
            states = [tok.setdefault((r["user_id"], t), {"raw": 0.0, "pos": 0.0, "neg": 0.0, "w": 0.0}) for t in TOKENS[r["content_id"]]]
            repeat = any(s["w"] > 1e-9 and s["neg"] > s["pos"] + 1e-9 for s in states)
            p["delta"] = -(5 if repeat else 8) if reject else base * p["w"]
            p["label"], p["sl"] = label(r), label(r, True)
            p["sd"] = -6 if reject else 4 * done + 3 * liked + 5 * (kind == "CONTENT_SHARED") - 4 * (wp is not None and wp < 20)
            for s in states:
                s["raw"] += -5 if reject else base * p["w"]
                s["pos"] += p["w"] * (p["label"] == 1)
                s["neg"] += p["w"] * (p["label"] == 0)
                s["w"] += p["w"]
            past.append(p)
    return out
