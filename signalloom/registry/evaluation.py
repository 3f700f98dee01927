"""Metric queries over all line items as a score/label frame (see ``adapter.scored_rows``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..sources import adapter
from .base_sql import with_ctes

R = lambda *cols: [F.round(c, 6).alias(c) for c in cols]


def _rows(spark, d):
    return adapter.scored_rows(spark, d)


def _graded(spark, d):
    """Grades 0..4 instead of the binary label, and the price as the score."""
    return _rows(spark, d).withColumns({"y": (F.col("quantity") % 5).cast("int"), "p": F.col("p_alt")})


def classification_metrics(spark, d):
    return metrics.classification(_rows(spark, d), 0.5).select(
        "tp", "fp", "tn", "fn", *R("accuracy", "precision", "recall", "f1", "brier", "log_loss"))


def roc_auc_and_ap(spark, d):
    return metrics.threshold_free(_rows(spark, d)).select(*R("roc_auc", "average_precision"))


def calibration_bins(spark, d):
    return metrics.calibration_bins(_rows(spark, d)).select(F.col("bin").cast("long").alias("bin"), "count", *R("mean_predicted", "mean_actual"))


def rank_group_diagnostics(spark, d):
    return metrics.group_diagnostics(_rows(spark, d))


_RANK = ["precision_at_5", "recall_at_5", "hit_rate_at_5", "ndcg_at_5", "precision_at_10", "recall_at_10", "hit_rate_at_10", "ndcg_at_10", "mrr"]


def ranking_metrics(spark, d):
    return metrics.ranking_summary(metrics.group_metrics(_rows(spark, d))).select(*R(*_RANK))


def graded_ranking_metrics(spark, d):
    return metrics.ranking_summary(metrics.group_metrics(_graded(spark, d), relevant=2), graded=True).select(*R(*_RANK))


def diversity_diagnostics(spark, d):
    return metrics.diversity(_rows(spark, d), 3)


def threshold_selection(spark, d):
    rows = _rows(spark, d)
    f1 = metrics.select_threshold(rows, ["category"]).select("category", F.col("threshold").alias("best_f1"))
    rec = metrics.select_threshold(rows, ["category"], min_precision=0.335).select("category", F.col("threshold").alias("best_recall"))
    return f1.join(rec, "category")


def baseline_scores(spark, d):
    """Constant prior, price share and quantity share as scores of the same rows, each with its own threshold."""
    rows = _rows(spark, d)
    prior = rows.agg(F.avg("y")).scalar()
    long = rows.select(
        "group_id", "row_id", "y", F.explode(F.create_map(
            F.lit("prior"), prior, F.lit("discount"), F.col("p"), F.lit("quantity"), F.col("quantity") / 50)).alias("baseline", "p"))
    t = metrics.select_threshold(long, ["baseline"])
    return metrics.evaluate(long, t, ["baseline"]).select("baseline", *R("accuracy", "f1", "roc_auc", "average_precision", "ndcg_at_5", "mrr"))


def viewer_rank(spark, d):
    return metrics.percentile_rank(_rows(spark, d), "quantity", "viewer_rank").select("row_id", "quantity", F.round("viewer_rank", 9).alias("viewer_rank"))


def activity_cohorts(spark, d):
    n = adapter.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))
    return metrics.activity_cohorts(n).select("user_id", "n", "cohort")


def pairwise_inversions(spark, d):
    return metrics.pairwise_inversions(_unique_rows(spark, d))


def _constraints(rows):
    ends = rows.groupBy("group_id").agg(F.min("row_id").alias("higher"), F.max("row_id").alias("lower")).where("higher <> lower")
    return ends.select("group_id", F.concat_ws(">", "higher", "lower").alias("name"), "higher", "lower", F.lit(0.1).alias("min_margin"))


def _unique_rows(spark, d):
    """One row per (order, row id): repeated line items averaged."""
    return _rows(spark, d).groupBy("group_id", "row_id").agg(F.max("p").alias("p"), F.max("p_alt").alias("p_alt"), F.max("category").alias("category"))


def pairwise_constraints(spark, d):
    rows = _unique_rows(spark, d)
    c = _constraints(rows)
    before, after = metrics.constraint_results(rows, c, "p"), metrics.constraint_results(rows, c, "p_alt")
    return before.select("group_id", "name", "margin", "passed").join(metrics.rerank_effect(before, after), ["group_id", "name"])


def score_resolution(spark, d):
    return metrics.score_resolution(_rows(spark, d))


def _runs(spark, d):
    rows = _unique_rows(spark, d)
    return rows.select("group_id", "row_id", "category", F.explode(F.create_map(F.lit("a"), F.col("p"), F.lit("b"), F.col("p_alt"))).alias("run", "p"))


def candidate_score_matrix(spark, d):
    return metrics.score_matrix(_runs(spark, d), ["a", "b"])


def top_category_shares(spark, d):
    return metrics.top_category_shares(_runs(spark, d), 3)


def candidate_vs_baseline(spark, d):
    return metrics.candidate_vs_baseline(_graded(spark, d).withColumn("p2", F.col("quantity") / 50), "p2", "p")


def result_parity(spark, d):
    rows = _unique_rows(spark, d)
    from pyspark.sql import Window

    def ranked(score: str):
        w = Window.partitionBy("group_id").orderBy(F.desc(score), "row_id")
        return rows.select("group_id", "row_id", "category", F.lit("X").alias("reason"), F.col(score).alias("score"), F.row_number().over(w).cast("long").alias("rank"))

    return metrics.result_parity(ranked("p"), ranked("p_alt"))


def model_selection(spark, d):
    """Each supplier-nation group of rows plays one model; the best scored one is selected."""
    rows = _rows(spark, d).withColumn("model", F.col("category"))
    m = metrics.evaluate(rows, None, ["model"]).withColumns({"eligible": F.col("model") != "F", "duration_seconds": F.lit(1.0)})
    return metrics.select_winner(m).select("model", "selection_score", *R("roc_auc", "ndcg_at_10"))


def quality_scores(spark, d):
    rows = _rows(spark, d)
    m = metrics.evaluate(rows, None, ["category"]).withColumns({
        "hard_ndcg": F.col("ndcg_at_5"), "adversarial_ndcg": F.col("ndcg_at_10"), "critical_pass_rate": F.col("hit_rate_at_5"), "medium_ndcg": F.col("mrr")})
    return m.select("category", metrics.quality_score().alias("quality"), metrics.quality_score(True).alias("ranker_quality"))


def bootstrap_ci(spark, d):
    return metrics.bootstrap_intervals(_rows(spark, d))


_F3 = ["price", "quantity", "p"]


def _probe(spark, d):
    return _rows(spark, d).groupBy().agg(*[F.max_by(c, F.struct("price", "row_id")).alias(c) for c in _F3])


def feature_percentiles(spark, d):
    return metrics.feature_percentiles(_rows(spark, d), _rows(spark, d).agg(*[F.round(F.avg(c), 2).alias(c) for c in _F3]), _F3)


def similar_row_fraction(spark, d):
    return metrics.similar_fraction(_rows(spark, d), _rows(spark, d).agg(*[F.round(F.avg(c), 2).alias(c) for c in _F3]), ["quantity", "p"], 0.5)


def nearest_neighbour_distance(spark, d):
    rows = adapter.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_custkey") % 97).cast("double").alias("y"))
    probe = rows.agg(F.round(F.avg("x"), 2).alias("x"), F.round(F.avg("y"), 2).alias("y"))
    return metrics.nearest_neighbour(rows, probe, ["x", "y"], key="k")


def feature_delta_summary(spark, d):
    r = _rows(spark, d)
    means = lambda s: r.where(F.col("category") == s).agg(*[F.avg(c).alias(c) for c in _F3])
    return metrics.feature_delta(means("O"), means("F"), _F3)


QUERIES = {
    "classification_metrics": classification_metrics, "roc_auc_and_ap": roc_auc_and_ap, "calibration_bins": calibration_bins,
    "rank_group_diagnostics": rank_group_diagnostics, "ranking_metrics": ranking_metrics, "graded_ranking_metrics": graded_ranking_metrics,
    "diversity_diagnostics": diversity_diagnostics, "threshold_selection": threshold_selection, "baseline_scores": baseline_scores,
    "viewer_rank": viewer_rank, "activity_cohorts": activity_cohorts, "pairwise_inversions": pairwise_inversions,
    "pairwise_constraints": pairwise_constraints, "score_resolution": score_resolution, "candidate_score_matrix": candidate_score_matrix,
    "top_category_shares": top_category_shares, "candidate_vs_baseline": candidate_vs_baseline, "result_parity": result_parity,
    "model_selection": model_selection, "quality_scores": quality_scores, "bootstrap_ci": bootstrap_ci,
    "feature_percentiles": feature_percentiles, "similar_row_fraction": similar_row_fraction,
    "nearest_neighbour_distance": nearest_neighbour_distance, "feature_delta_summary": feature_delta_summary,
}


def _class_cols(t: str = "0.5") -> str:
    return f"""count(*) FILTER (WHERE p >= {t} AND y = 1) AS tp, count(*) FILTER (WHERE p >= {t} AND y = 0) AS fp,
      count(*) FILTER (WHERE p < {t} AND y = 0) AS tn, count(*) FILTER (WHERE p < {t} AND y = 1) AS fn,
      avg((p - y) * (p - y)) AS brier,
      avg(-CASE WHEN y = 1 THEN ln(greatest(1e-15, least(1 - 1e-15, p))) ELSE ln(1 - greatest(1e-15, least(1 - 1e-15, p))) END) AS log_loss"""


_DERIVED = """(tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
  coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"""


def curve(source: str, key: str) -> str:
    """Cumulative counts over distinct scores per key, and AUC / AP from them."""
    return f"""
    cells AS (SELECT {key}, p, count(*) AS n, sum(y) AS pos FROM {source} GROUP BY 1, 2),
    cum AS (SELECT *, sum(n) OVER w AS cum_n, sum(pos) OVER w AS cum_pos, sum(n) OVER (PARTITION BY {key}) AS tn,
              sum(pos) OVER (PARTITION BY {key}) AS tp FROM cells WINDOW w AS (PARTITION BY {key} ORDER BY p DESC)),
    auc AS (SELECT {key}, CASE WHEN any_value(tp) > 0 AND any_value(tn) > any_value(tp)
              THEN sum((n - pos) * (cum_pos - pos + pos / 2)) / any_value(tp) / (any_value(tn) - any_value(tp)) ELSE 0 END AS roc_auc,
              CASE WHEN any_value(tp) > 0 AND any_value(tn) > any_value(tp) THEN sum(pos / tp * cum_pos / cum_n) ELSE 0 END AS average_precision
            FROM cum GROUP BY 1)"""


def ranking(source: str, key: str, relevant: str = "y >= 1", graded: bool = False) -> str:
    other = "0" if graded else "NULL"
    size = "" if graded else "WHERE n >= 2"
    per, out = [], []
    for k in (5, 10):
        per.append(f"""count(*) FILTER (WHERE r <= {k} AND rel) AS h{k}, coalesce(sum(y / log2(r + 1)) FILTER (WHERE r <= {k}), 0) AS d{k},
          coalesce(sum(y / log2(i + 1)) FILTER (WHERE i <= {k}), 0) AS i{k}""")
        out.append(f"""coalesce(avg(h{k} / least({k}, n)), 0) AS precision_at_{k},
          coalesce(avg(CASE WHEN pos > 0 THEN h{k} / pos ELSE {other} END), 0) AS recall_at_{k},
          coalesce(avg(CASE WHEN pos > 0 THEN (h{k} > 0)::INT ELSE {other} END), 0) AS hit_rate_at_{k},
          coalesce(avg(CASE WHEN i{k} > 0 THEN d{k} / i{k} ELSE {other} END), 0) AS ndcg_at_{k}""")
    return f"""
    ranked AS (SELECT *, ({relevant}) AS rel, row_number() OVER (PARTITION BY {key}, group_id ORDER BY p DESC, row_id) AS r,
                 row_number() OVER (PARTITION BY {key}, group_id ORDER BY y DESC, row_id) AS i FROM {source}),
    pergroup AS (SELECT {key}, group_id, count(*) AS n, count(*) FILTER (WHERE rel) AS pos, min(r) FILTER (WHERE rel) AS fr,
                   {', '.join(per)} FROM ranked GROUP BY 1, 2),
    summary AS (SELECT {key}, {', '.join(out)}, coalesce(avg(CASE WHEN pos > 0 THEN 1 / fr ELSE {other} END), 0) AS mrr
                FROM pergroup {size} GROUP BY 1)"""


_GRADED = "graded AS (SELECT * EXCLUDE (y, p), CAST(quantity % 5 AS INT) AS y, p_alt AS p, 1 AS one FROM scored)"
_ONE = "one_scored AS (SELECT *, 1 AS one FROM scored)"
_RR = lambda cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)
_UNIQUE = """uniq AS (SELECT group_id, row_id, max(p) AS p, max(p_alt) AS p_alt, max(category) AS category FROM scored GROUP BY 1, 2),
runs AS (SELECT group_id, row_id, category, 'a' AS run, p FROM uniq UNION ALL SELECT group_id, row_id, category, 'b', p_alt FROM uniq)"""
_CONS = """cons AS (SELECT group_id, min(row_id) AS hi, max(row_id) AS lo FROM uniq GROUP BY 1 HAVING min(row_id) <> max(row_id)),
res AS (SELECT c.group_id, hi || '>' || lo AS name, a.p - b.p AS m1, a.p_alt - b.p_alt AS m2 FROM cons c
  JOIN uniq a ON a.group_id = c.group_id AND a.row_id = hi JOIN uniq b ON b.group_id = c.group_id AND b.row_id = lo)"""
_LONG = """long AS (SELECT group_id, row_id, y, 'prior' AS baseline, (SELECT avg(y) FROM scored) AS p FROM scored
  UNION ALL SELECT group_id, row_id, y, 'discount', p FROM scored UNION ALL SELECT group_id, row_id, y, 'quantity', quantity / 50 FROM scored)"""
_MEANS = "m AS (SELECT round(avg(price), 2) AS price, round(avg(quantity), 2) AS quantity, round(avg(p), 2) AS p FROM scored)"

ORACLE = {
    "classification_metrics": with_ctes(f"""SELECT tp, fp, tn, fn, {_RR(["accuracy", "precision", "recall", "f1", "brier", "log_loss"])}
        FROM (SELECT *, {_DERIVED} FROM (SELECT {_class_cols()} FROM scored))""", "SCORED"),
    "roc_auc_and_ap": with_ctes("SELECT round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM auc", "SCORED",
                                extra=_ONE + "," + curve("one_scored", "one")),
    "calibration_bins": with_ctes("""SELECT b AS bin, count(p) AS count, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS mean_actual
        FROM range(10) t(b) LEFT JOIN scored ON (SELECT count(*) FROM range(1, 10) e(i) WHERE p > 0.1::DOUBLE * i) = b GROUP BY b""", "SCORED"),
    "rank_group_diagnostics": with_ctes("""SELECT count(*) AS total_groups, count(*) FILTER (WHERE n >= 2) AS evaluated_groups,
          count(*) FILTER (WHERE n < 2) AS skipped_too_small, count(*) FILTER (WHERE n >= 2 AND pos = 0) AS without_positives,
          round(avg(n) FILTER (WHERE n >= 2), 4) AS mean_size, min(n) FILTER (WHERE n >= 2) AS min_size, max(n) FILTER (WHERE n >= 2) AS max_size,
          CAST(quantile_cont(n, 0.5) FILTER (WHERE n >= 2) AS DOUBLE) AS p50_size, CAST(quantile_cont(n, 0.9) FILTER (WHERE n >= 2) AS DOUBLE) AS p90_size
        FROM (SELECT group_id, count(*) AS n, sum(y) AS pos FROM scored GROUP BY 1)""", "SCORED"),
    "ranking_metrics": with_ctes(f"SELECT {_RR(_RANK)} FROM summary", "SCORED", extra=_ONE + "," + ranking("one_scored", "one")),
    "graded_ranking_metrics": with_ctes(f"SELECT {_RR(_RANK)} FROM summary", "SCORED", extra=_GRADED + "," + ranking("graded", "one", "y >= 2", True)),
    "diversity_diagnostics": with_ctes("""
        SELECT group_id, round(max(c) / sum(c), 6) AS top_category_share, count(*) AS unique_categories, any_value(u) AS unique_creators
        FROM (SELECT group_id, category, count(*) AS c FROM top GROUP BY 1, 2)
          JOIN (SELECT group_id, count(DISTINCT creator_id) AS u FROM top GROUP BY 1) USING (group_id) GROUP BY 1""", "SCORED",
        extra="top AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY p DESC, row_id) <= 3)"),
    "threshold_selection": with_ctes("""
        SELECT category, coalesce(first(p ORDER BY 2 * cum_pos / (cum_n + tp) DESC, p), 0.5) AS best_f1,
          coalesce(first(p ORDER BY cum_pos / tp DESC, p) FILTER (WHERE cum_pos / cum_n >= 0.335), 0.5) AS best_recall
        FROM cum GROUP BY category""", "SCORED", extra=curve("scored", "category")),
    "baseline_scores": with_ctes(f"""SELECT baseline, {_RR(["accuracy", "f1", "roc_auc", "average_precision", "ndcg_at_5", "mrr"])}
        FROM (SELECT *, {_DERIVED} FROM (SELECT baseline, {_class_cols("t")} FROM long JOIN thr USING (baseline) GROUP BY 1))
          JOIN auc USING (baseline) JOIN summary USING (baseline)""", "SCORED",
        extra=_LONG + "," + curve("long", "baseline") + """,
        thr AS (SELECT baseline, first(p ORDER BY 2 * cum_pos / (cum_n + tp) DESC, p) AS t FROM cum GROUP BY 1),""" + ranking("long", "baseline")),
    "viewer_rank": with_ctes("""SELECT row_id, quantity, round((rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2)
        / count(*) OVER (), 9) AS viewer_rank FROM scored""", "SCORED"),
    "activity_cohorts": """WITH n AS (SELECT o_custkey AS user_id, count(*) AS n FROM orders GROUP BY 1),
        s AS (SELECT list(n ORDER BY n) AS l FROM n)
        SELECT user_id, n, CASE WHEN n <= l[len(l) // 3 + 1] THEN 'sparse' WHEN n <= l[2 * len(l) // 3 + 1] THEN 'medium' ELSE 'high' END AS cohort FROM n, s""",
    "pairwise_inversions": with_ctes("""
        SELECT group_id, inversions, n * (n - 1) // 2 AS pairs, CASE WHEN n > 1 THEN round(inversions / (n * (n - 1) // 2), 6) ELSE 0.0::DOUBLE END AS rate
        FROM (SELECT a.group_id, count(b.row_id) FILTER (WHERE (a.p < b.p) <> (a.p_alt < b.p_alt)) AS inversions
              FROM uniq a LEFT JOIN uniq b ON a.group_id = b.group_id AND a.row_id < b.row_id GROUP BY 1)
          JOIN (SELECT group_id, count(*) AS n FROM uniq GROUP BY 1) USING (group_id)""", "SCORED", extra=_UNIQUE),
    "pairwise_constraints": with_ctes("""SELECT group_id, name, round(m1, 6) AS margin, m1 > 0.1 AS passed,
        CASE WHEN NOT (m1 > 0.1) AND m2 > 0.1 THEN 'improved' WHEN m1 > 0.1 AND NOT (m2 > 0.1) THEN 'degraded' ELSE 'neutral' END AS effect FROM res""",
        "SCORED", extra=_UNIQUE + "," + _CONS),
    "score_resolution": with_ctes("""
        SELECT group_id, count(*) AS count, round(min(p), 6) AS min, round(max(p), 6) AS max, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS std,
          count(DISTINCT round(p, 6)) AS unique_scores, count(*) FILTER (WHERE p - prev < 1e-4) AS within_1e4, count(*) FILTER (WHERE p - prev < 1e-3) AS within_1e3
        FROM (SELECT *, lag(p) OVER (PARTITION BY group_id ORDER BY p) AS prev FROM scored) GROUP BY 1""", "SCORED"),
    "candidate_score_matrix": with_ctes("""
        SELECT group_id, row_id, max(p) FILTER (WHERE run = 'a') AS a_score, max(rk) FILTER (WHERE run = 'a') AS a_rank,
          max(p) FILTER (WHERE run = 'b') AS b_score, max(rk) FILTER (WHERE run = 'b') AS b_rank, round(max(p) - min(p), 6) AS spread
        FROM (SELECT *, row_number() OVER (PARTITION BY group_id, run ORDER BY p DESC, row_id) AS rk FROM runs) GROUP BY 1, 2""", "SCORED", extra=_UNIQUE),
    "top_category_shares": with_ctes("""SELECT run, category, round(count(*) / sum(count(*)) OVER (PARTITION BY run), 6) AS share FROM
        (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY group_id, run ORDER BY p DESC, row_id) <= 3) GROUP BY 1, 2""", "SCORED", extra=_UNIQUE),
    "candidate_vs_baseline": with_ctes("""
        SELECT round(cn, 6) AS candidate_ndcg, round(cp, 6) AS candidate_precision, round(bn, 6) AS baseline_ndcg, round(bp, 6) AS baseline_precision,
          round(cn - bn, 6) AS ndcg_delta, round(cp - bp, 6) AS precision_delta, CASE WHEN cn >= bn AND cp >= bp THEN 'PASS' ELSE 'FAIL' END AS status
        FROM (SELECT avg(CASE WHEN i > 0 THEN dc / i END) AS cn, avg(CASE WHEN i > 0 THEN db / i END) AS bn, avg(pc / least(5, n)) AS cp, avg(pb / least(5, n)) AS bp
          FROM (SELECT group_id, count(*) AS n, sum(y / log2(rc + 1)) FILTER (WHERE rc <= 10) AS dc, sum(y / log2(rb + 1)) FILTER (WHERE rb <= 10) AS db,
                  sum(y / log2(ri + 1)) FILTER (WHERE ri <= 10) AS i, count(*) FILTER (WHERE rc <= 5 AND y > 0) AS pc, count(*) FILTER (WHERE rb <= 5 AND y > 0) AS pb
                FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY quantity / 50 DESC, row_id) AS rc,
                        row_number() OVER (PARTITION BY group_id ORDER BY p DESC, row_id) AS rb, row_number() OVER (PARTITION BY group_id ORDER BY y DESC) AS ri
                      FROM graded) GROUP BY 1) WHERE n >= 2)""", "SCORED", extra=_GRADED),
    "result_parity": with_ctes("""
        SELECT * FROM (SELECT group_id, rank, a.row_id IS NULL OR b.row_id IS NULL AS length_differs, a.row_id IS DISTINCT FROM b.row_id AS content_differs,
            a.category IS DISTINCT FROM b.category AS category_differs, FALSE AS reason_differs, NOT coalesce(abs(a.p - b.p) <= 1e-9, FALSE) AS score_differs
          FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY p DESC, row_id) AS rank FROM uniq) a FULL JOIN
            (SELECT group_id, row_id, category, p_alt AS p, row_number() OVER (PARTITION BY group_id ORDER BY p_alt DESC, row_id) AS rank FROM uniq) b
            USING (group_id, rank)) WHERE content_differs OR category_differs OR score_differs""", "SCORED", extra=_UNIQUE),
    "model_selection": with_ctes("""
        SELECT category AS model, round(0.35 * ndcg_at_10 + 0.25 * precision_at_10 + 0.25 * average_precision + 0.15 * recall_at_10, 6) AS selection_score,
          round(roc_auc, 6) AS roc_auc, round(ndcg_at_10, 6) AS ndcg_at_10
        FROM auc JOIN summary USING (category) ORDER BY category <> 'F' DESC, selection_score DESC LIMIT 1""", "SCORED",
        extra=curve("scored", "category") + "," + ranking("scored", "category")),
    "quality_scores": with_ctes("""
        SELECT category, round(0.3 * ndcg_at_5 + 0.2 * ndcg_at_10 + 0.2 * hit_rate_at_5 + 0.15 * mrr + 0.1 * average_precision
            + 0.025 * precision_at_10 + 0.025 * recall_at_10, 6) AS quality,
          round(0.352941 * ndcg_at_5 + 0.235294 * ndcg_at_10 + 0.235294 * hit_rate_at_5 + 0.176471 * mrr, 6) AS ranker_quality
        FROM auc JOIN summary USING (category)""", "SCORED", extra=curve("scored", "category") + "," + ranking("scored", "category")),
    "feature_percentiles": with_ctes(" UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg((s.{c} <= m.{c})::INT) * 100, 2) AS percentile FROM scored s, m" for c in _F3), "SCORED", extra=_MEANS),
    "similar_row_fraction": with_ctes("""SELECT round(avg((abs(s.quantity - m.quantity) <= 0.5 AND abs(s.p - m.p) <= 0.5)::INT), 6) AS fraction
        FROM scored s, m""", "SCORED", extra=_MEANS),
    "nearest_neighbour_distance": """
        WITH r AS (SELECT o_orderkey AS k, o_totalprice / 1000 AS x, CAST(o_custkey % 97 AS DOUBLE) AS y FROM orders),
        m AS (SELECT round(avg(x), 2) AS mx, round(avg(y), 2) AS my FROM r), sd AS (SELECT stddev_pop(x) AS dx, stddev_pop(y) AS dy FROM r)
        SELECT round(min(d), 4) AS nearest, round(quantile_cont(d, 0.5), 4) AS median, count(*) AS sampled_rows
        FROM (SELECT sqrt(pow((x - mx) / dx, 2) + pow((y - my) / dy, 2)) AS d FROM r, m, sd)""",
    "feature_delta_summary": with_ctes(f"""SELECT feature, round(l, 6) AS left_value, round(r, 6) AS right_value, round(abs(l - r), 6) AS difference FROM (
        {" UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) FILTER (WHERE category = 'O') AS l, avg({c}) FILTER (WHERE category = 'F') AS r FROM scored" for c in _F3)})
        WHERE abs(l - r) >= 0.01""", "SCORED"),
}
