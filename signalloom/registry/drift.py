"""Drift queries: events before against after 2024-01-16."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, live
from ..plans import drift_job
from ..sources import adapter
from .base_sql import with_ctes

NUM, CAT = ["value", "hour"], ["event_type", "user_id"]


def _rows(spark, d, late: bool):
    e = adapter.table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    side = us >= adapter.DECISION_US if late else us < adapter.DECISION_US
    # A missing-value share and an infinite value on purpose.
    value = F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("value") > 400, F.lit(float("inf"))).otherwise(F.col("value"))
    return e.where(side).select(value.alias("value"), F.hour(F.timestamp_micros(us)).cast("double").alias("hour"),
                                F.when(F.col("value") > 1.0, F.col("event_type")).alias("event_type"), F.col("user_id").cast("string").alias("user_id"))


def numeric_baseline(spark, d):
    b = drift.numeric_baseline(_rows(spark, d, False), NUM)
    j = lambda c: F.array_join(F.transform(c, lambda x: F.format_number(x, 4)), "|").alias(c)
    return b.select("feature", "count", "missing", "min", "max", "mean", "std", j("quantiles"), j("edges"), j("proportions"))


def categorical_baseline(spark, d):
    b = drift.categorical_baseline(_rows(spark, d, False), CAT)
    return b.select("feature", "count", "missing", F.array_join("labels", "|").alias("labels"), "other",
                    F.round(F.aggregate("proportions", F.lit(0.0), lambda a, x: a + x), 6).alias("listed_share"))


def numeric_drift(spark, d):
    b = drift.build_baseline(_rows(spark, d, False), NUM, CAT)
    return drift.numeric_drift(b, _rows(spark, d, True), NUM).drop("kind", "severity")


def categorical_drift(spark, d):
    b = drift.build_baseline(_rows(spark, d, False), NUM, CAT)
    return drift.categorical_drift(b, _rows(spark, d, True), CAT).drop("kind", "severity")


def evaluate_drift(spark, d):
    b = drift.build_baseline(_rows(spark, d, False), NUM, CAT)
    return drift.evaluate_drift(b, _rows(spark, d, True), NUM, CAT).select("kind", "feature", "status", "observed_count")


def baseline_validation(spark, d):
    """Violations of a good baseline (none) and of one with broken parts."""
    b = drift.build_baseline(_rows(spark, d, False), NUM, CAT)
    broken = b.withColumns({
        "mean": F.when(F.col("feature") == "value", F.col("max") + 1).otherwise(F.col("mean")),
        "edges": F.when(F.col("feature") == "hour", F.reverse("edges")).otherwise(F.col("edges")),
        "other": F.when(F.col("feature") == "user_id", F.lit(0.0)).otherwise(F.col("other")),
        "labels": F.when(F.col("feature") == "event_type", F.concat("labels", "labels")).otherwise(F.col("labels")),
    })
    return drift.baseline_violations(b).unionByName(drift.baseline_violations(broken))


def drift_from_recent(spark, d):
    """Features of the newest rows, primed by warm-up rows, against the baseline of the training rows before them."""
    rows, contents = adapter.interactions(spark, d), adapter.contents(spark, d)
    base = drift_job.training_baseline(rows.where(F.col("ts_us") < adapter.DECISION_US), contents)
    return drift_job.drift_from_recent(rows, contents, base).select("kind", "feature", "status", "observed_count", "psi")


def drift_from_observations(spark, d):
    """LIVE feature rows after the decision moment against a baseline of those before it."""
    rows = live.live_dataset(adapter.live_log(spark, d))
    early, late = rows.where(F.col("ts_us") < adapter.DECISION_US), rows.where(F.col("ts_us") >= adapter.DECISION_US)
    base = drift.build_baseline(early, live.LIVE_NUMERIC, live.LIVE_CATEGORICAL)
    out = drift_job.drift_of(late, base, live.LIVE_NUMERIC, live.LIVE_CATEGORICAL)
    return out.select("kind", "feature", "status", "observed_count", "psi")


QUERIES = {
    "numeric_baseline": numeric_baseline, "categorical_baseline": categorical_baseline, "numeric_drift": numeric_drift,
    "categorical_drift": categorical_drift, "evaluate_drift": evaluate_drift, "baseline_validation": baseline_validation,
    "drift_from_recent": drift_from_recent, "drift_from_observations": drift_from_observations,
}

_BASE = f"""
src AS (SELECT epoch_us(ts) >= {adapter.DECISION_US} AS late, CASE WHEN event_type <> 'error' AND value <= 400 THEN value END AS value,
    CAST(extract('hour' FROM ts) AS DOUBLE) AS hour, CASE WHEN value > 1.0 THEN event_type END AS event_type, CAST(user_id AS VARCHAR) AS user_id FROM events),
num AS (SELECT late, 'value' AS feature, value AS v FROM src UNION ALL SELECT late, 'hour', hour FROM src),
cat AS (SELECT late, 'event_type' AS feature, event_type AS v FROM src UNION ALL SELECT late, 'user_id', user_id FROM src),
nb AS (SELECT feature, count(*) AS n, count(*) - count(v) AS miss, min(v) AS mn, max(v) AS mx, avg(v) AS mean, stddev_pop(v) AS sd,
    quantile_cont(v, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM num WHERE NOT late GROUP BY 1),
nbin AS (SELECT feature, i, count(v) FILTER (WHERE NOT late AND b = i) AS p, count(v) FILTER (WHERE late AND b6 = i) AS o
  FROM (SELECT num.*, len(list_filter(e, lambda x: x < v)) AS b, len(list_filter(e, lambda x: round(x, 6) < v)) AS b6 FROM num JOIN nb USING (feature)), range(10) t(i) GROUP BY 1, 2),
ntot AS (SELECT feature, sum(p) AS tp, sum(o) AS tob FROM nbin GROUP BY 1),
npsi AS (SELECT feature, sum((greatest(o / tob, 1e-4) - greatest(round(p / tp, 6), 1e-4)) * ln(greatest(o / tob, 1e-4) / greatest(round(p / tp, 6), 1e-4))) AS psi
  FROM nbin JOIN ntot USING (feature) GROUP BY 1),
ndrift AS (SELECT feature, psi, oc, abs(om / oc - miss / n) AS mrd, orr FROM npsi JOIN nb USING (feature) JOIN
  (SELECT feature, count(*) AS oc, count(*) - count(num.v) AS om, count(*) FILTER (WHERE num.v < round(mn, 6) OR num.v > round(mx, 6)) / count(num.v) AS orr
   FROM num JOIN nb USING (feature) WHERE late GROUP BY 1) USING (feature)),
cb AS (SELECT feature, v, count(*) AS c, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, v) AS rk,
    sum(count(*)) OVER (PARTITION BY feature) AS present FROM cat WHERE NOT late AND v IS NOT NULL GROUP BY 1, 2),
cstat AS (SELECT feature, count(*) AS n, count(*) - count(v) AS miss FROM cat WHERE NOT late GROUP BY 1),
cbase AS (SELECT feature, string_agg(v, '|' ORDER BY rk) AS labels, round(1 - sum(c) / any_value(present), 6) AS other, round(sum(round(c / present, 6)), 6) AS listed
  FROM cb WHERE rk <= 20 GROUP BY 1),
cobs AS (SELECT feature, coalesce(rk, 99) AS rk, count(*) AS c FROM (SELECT * FROM cat WHERE late AND v IS NOT NULL) x
  LEFT JOIN (SELECT feature, v, rk FROM cb WHERE rk <= 20) y USING (feature, v) GROUP BY 1, 2),
call AS (SELECT feature, rk, p, coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY feature) AS q FROM
  (SELECT feature, rk, round(c / present, 6) AS p FROM cb WHERE rk <= 20 UNION ALL SELECT feature, 99, other FROM cbase) LEFT JOIN cobs USING (feature, rk)),
cn AS (SELECT *, pp / sum(pp) OVER (PARTITION BY feature) AS a, qq / sum(qq) OVER (PARTITION BY feature) AS b
  FROM (SELECT *, greatest(p, 1e-4) AS pp, greatest(q, 1e-4) AS qq FROM call)),
cdrift AS (SELECT feature, psi, js, oc, abs(om / oc - miss / n) AS mrd, ord FROM
  (SELECT feature, sum((qq - pp) * ln(qq / pp)) AS psi, sum(a * ln(a / ((a + b) / 2)) + b * ln(b / ((a + b) / 2))) / 2 / ln(2.0) AS js,
     abs(max(CASE WHEN rk = 99 THEN q END) - max(CASE WHEN rk = 99 THEN p END)) AS ord FROM cn GROUP BY 1)
  JOIN cstat USING (feature) JOIN (SELECT feature, count(*) AS oc, count(*) - count(v) AS om FROM cat WHERE late GROUP BY 1) USING (feature))"""
_S = "CASE WHEN {0} >= {2} THEN 2 WHEN {0} >= {1} THEN 1 ELSE 0 END"
_N = "['OK','WARNING','CRITICAL'][1 + greatest(" + ", ".join([_S.format("psi", 0.1, 0.25), _S.format("mrd", 0.1, 0.25), _S.format("orr", 0.05, 0.2)]) + ")]"
_C = "['OK','WARNING','CRITICAL'][1 + greatest(" + ", ".join([_S.format("psi", 0.1, 0.25), _S.format("mrd", 0.1, 0.25), _S.format("ord", 0.05, 0.2)]) + ")]"
_J = "array_to_string(list_transform({0}, lambda x: format('{{:.4f}}', x)), '|') AS {1}"
ORACLE = {
    "numeric_baseline": "WITH " + _BASE + f"""
        SELECT feature, n AS count, miss AS missing, round(mn, 6) AS min, round(mx, 6) AS max, round(mean, 6) AS mean, round(sd, 6) AS std,
          {_J.format("q", "quantiles")}, {_J.format("e", "edges")}, {_J.format("p", "proportions")}
        FROM nb JOIN (SELECT feature, list(p / tp ORDER BY i) AS p FROM nbin JOIN ntot USING (feature) GROUP BY 1) USING (feature)""",
    "categorical_baseline": "WITH " + _BASE + """
        SELECT feature, n AS count, miss AS missing, labels, other, listed AS listed_share FROM cbase JOIN cstat USING (feature)""",
    "numeric_drift": "WITH " + _BASE + f"""
        SELECT feature, {_N} AS status, round(psi, 6) AS psi, oc AS observed_count, round(mrd, 6) AS missing_rate_delta, round(orr, 6) AS out_of_range_rate FROM ndrift""",
    "categorical_drift": "WITH " + _BASE + f"""
        SELECT feature, {_C} AS status, round(psi, 6) AS psi, round(js, 6) AS js_divergence, oc AS observed_count, round(mrd, 6) AS missing_rate_delta,
          round(ord, 6) AS other_rate_delta FROM cdrift""",
    "evaluate_drift": "WITH " + _BASE + f""", al AS (SELECT 'numeric' AS kind, feature, {_N} AS status, oc FROM ndrift UNION ALL SELECT 'categorical', feature, {_C}, oc FROM cdrift)
        SELECT kind, feature, status, oc AS observed_count FROM al UNION ALL
        SELECT 'overall', '__overall__', first(status ORDER BY CASE status WHEN 'OK' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END DESC), max(oc) FROM al""",
    "baseline_validation": """SELECT * FROM (VALUES ('numeric', 'value', 'MEAN_OUT_OF_RANGE'), ('numeric', 'hour', 'EDGES_DECREASE'),
        ('categorical', 'event_type', 'DUPLICATE_LABELS'), ('categorical', 'user_id', 'SHARES_DO_NOT_SUM')) t(kind, feature, violation)
        WHERE (SELECT count(*) FROM events) > 0""",
}
