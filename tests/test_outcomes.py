"""Outcomes of logged decisions against the plain rule, and their plan."""

import random
import re


from signalloom.operators import decisions
from tests.helpers import DAY, T0, frame, row


def test_suffix_maxima_equal_the_rule(spark):
    rng = random.Random(4)
    kinds = ["VIDEO_WATCHED", "CONTENT_LIKED", "CONTENT_SHARED", "VIDEO_SKIPPED", "VIDEO_COMPLETED", "CONTENT_NOT_INTERESTED"]
    events = [row(f"e{i}", ts=T0 + rng.randrange(6) * DAY // 2 + rng.randrange(3), event_type=rng.choice(kinds), wp=float(rng.randrange(100)), content=f"c{rng.randrange(4)}") for i in range(60)]
    log = [(f"r{i}", T0 + rng.randrange(7) * DAY // 2 + rng.randrange(3), "u", f"c{rng.randrange(6)}") for i in range(40)]
    log += log[:3]
    df = frame(spark, events)
    got = decisions.resolve_outcomes(spark.createDataFrame(log, "request_id string, ranking_us long, user_id string, content_id string"), df)
    marked = decisions.signals.annotate(df).collect()

    def rule(ranking, content):
        mine = [e for e in marked if e["content_id"] == content and e["ts_us"] >= ranking]
        if not mine:
            return None, None
        any_ = lambda c: any(e[c] for e in mine)
        wp = max((e["watch_percentage"] for e in mine if e["watch_percentage"] is not None), default=None)
        strong = any_("sig_shared") or any_("sig_favorited") or any_("sig_followed")
        if any_("rejected") or (wp is not None and wp < 20 and not strong and not any_("sig_liked")):
            grade = 0
        else:
            grade = 4 if strong else 3 if any_("sig_liked") or any_("completed") else 2 if wp is not None and wp >= 70 else 1
        return grade, max(e["ts_us"] for e in mine)

    want = sorted((r, t, c, *map(str, rule(t, c))) for r, t, _, c in log)
    assert sorted((r["request_id"], r["ranking_us"], r["content_id"], str(r["relevance"]), str(r["observed_us"])) for r in got.collect()) == want


def test_no_row_meets_many(spark):
    """Events and log meet in windows; the only joins are a semi-join and one by (user, content, day), unique on a side."""
    df = frame(spark, [row("e1", ts=T0, event_type="CONTENT_LIKED", content="c0")])
    log = spark.createDataFrame([("r", T0, "u", "c0")], "request_id string, ranking_us long, user_id string, content_id string")
    plan = decisions.resolve_outcomes(log, df)._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join (\w+), (.*)", plan)
    assert {kind for kind, _ in joins} == {"Inner", "LeftSemi"} and sum(kind == "Inner" for kind, _ in joins) == 1
    assert "_day" in next(on for kind, on in joins if kind == "Inner")
