"""Classification and ranking metrics of scored rows, exact and without any one-task sort.

Threshold-free metrics first reduce rows to distinct scores; ranking metrics at k keep k rows per
group where a group may be hot; a hot group therefore never lands whole in one task. ``keys`` evaluates several models at once.
Columns: ``y`` label, ``p`` score in [0, 1], ``group_id``, ``row_id`` (last tie-break).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .running import HEAVY_ROWS, Family, crowded, dealt_by, detect, one_row, prior_state, top_n

KS = (5, 10)
EPS = 1e-15
SCALE = float(2**53)


def _with_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn("_all", F.lit(0)), ["_all"])


def score_counts(df: DataFrame, keys: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Distinct scores, highest first, with inclusive running counts of rows and positives."""
    w = F.lit(1) if weight is None else weight
    work, base = _with_keys(df, keys)
    cells = work.groupBy(*base, "p").agg(F.sum(w).cast("long").alias("n"), F.sum(F.when(F.col("y") == 1, w).otherwise(0)).cast("long").alias("pos"))
    cells = cells.withColumns({"_at": (F.col("p") * -SCALE).cast("long"), "_np": -F.col("p")})
    fam = Family(ordered=True, sums={"above_n": F.col("n"), "above_pos": F.col("pos")})
    return prior_state(cells, base, "_at", [fam], tie_break=["_np"]).withColumns(
        {"cum_n": F.col("above_n") + F.col("n"), "cum_pos": F.col("above_pos") + F.col("pos")})


def _totals(cells: DataFrame, base: Sequence[str]) -> DataFrame:
    return cells.groupBy(*base).agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos"))


def threshold_free(df: DataFrame, keys: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """ROC AUC (ties averaged, 0 with one class) and average precision."""
    cells = score_counts(df, keys, weight)
    base = list(keys) or ["_all"]
    j = cells.join(_totals(cells, base), base)
    neg = F.col("n") - F.col("pos")
    concordant = F.sum(neg.cast("double") * (F.col("above_pos") + F.col("pos") / 2))
    both = (F.first("_pos") > 0) & (F.first("_n") > F.first("_pos"))
    out = j.groupBy(*base).agg(
        F.when(both, concordant / (F.first("_pos").cast("double") * (F.first("_n") - F.first("_pos")))).otherwise(0.0).alias("roc_auc"),
        F.when(both, F.sum(F.col("pos") / F.col("_pos") * F.col("cum_pos") / F.col("cum_n"))).otherwise(0.0).alias("average_precision"),
    )
    return out if keys else out.drop("_all")


def select_threshold(df: DataFrame, keys: Sequence[str] = (), *, min_precision: float | None = None) -> DataFrame:
    """Best F1 (or recall at a minimum precision) over distinct scores; lowest score wins ties; 0.5 by default."""
    cells = score_counts(df, keys)
    base = list(keys) or ["_all"]
    j = cells.join(_totals(cells, base), base)
    if min_precision is None:
        value = 2 * F.col("cum_pos") / (F.col("cum_n") + F.col("_pos"))
    else:
        value = F.when(F.col("cum_pos") / F.col("cum_n") >= min_precision, F.col("cum_pos") / F.col("_pos"))
    two = (F.col("_pos") > 0) & (F.col("_n") > F.col("_pos"))
    best = F.max_by("p", F.when(two & value.isNotNull(), F.struct(value, -F.col("p"))))
    out = j.groupBy(*base).agg(F.coalesce(best, F.lit(0.5)).alias("threshold"))
    return out if keys else out.drop("_all")


def classification(df: DataFrame, threshold: float | Column = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and the metrics derived from them, Brier score and log loss: one pass."""
    y, p = F.col("y"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p")))
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    hit = F.col("p") >= t
    clipped = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    n = lambda c: F.sum(c.cast("long"))
    out = df.groupBy(*keys).agg(
        n(hit & (y == 1)).alias("tp"), n(hit & (y == 0)).alias("fp"), n(~hit & (y == 0)).alias("tn"), n(~hit & (y == 1)).alias("fn"),
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-F.when(y == 1, F.log(clipped)).otherwise(F.log(1 - clipped))).alias("log_loss"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return out.withColumns({
        "accuracy": div(tp + tn, tp + fp + fn + tn), "precision": div(tp, tp + fp), "recall": div(tp, tp + fn),
        "f1": div(2 * tp, 2 * tp + fp + fn),
    })


def calibration_bins(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """Right-closed equal-width bins: count, mean predicted, mean actual; empty bins listed."""
    step = 1.0 / n_bins
    index = F.lit(0)
    for i in range(1, n_bins):
        index = index + (F.col("p") > step * i).cast("int")
    got = df.groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("p").alias("mean_predicted"), F.avg("y").alias("mean_actual"))
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return bins.join(got, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))


#: Rows of all groups that one task of ``group_metrics`` gets, about.
GROUPED_ROWS = 1_000_000


def group_metrics(df: DataFrame, keys: Sequence[str] = (), *, relevant: float = 1, ks: Sequence[int] = KS, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Per group: size, positives, hits and (ideal) gain at each k, rank of the first relevant row.

    Rows move once, to the task of their group, unless a group may be hot: then k rows per group and partial sums do.
    """
    g = [*keys, "group_id"]
    kmax = max(ks)
    rel = (F.col("y") >= relevant).cast("int")
    gain = lambda r: F.col("y") * (math.log(2) / F.log(F.col(r) + 1.0))
    at = lambda r, k, c: F.sum(F.when(F.col(r) <= k, c))
    top_cols = [*[at("_r", k, rel).alias(f"hits{k}") for k in ks], *[at("_r", k, gain("_r")).alias(f"dcg{k}") for k in ks]]
    best_cols = [at("_i", k, gain("_i")).alias(f"idcg{k}") for k in ks]
    sizes = [F.count(F.lit(1)).alias("n"), F.sum(rel).alias("positives")]
    hot, rows = crowded(df, g, heavy_rows)
    if not hot:
        known = df.select(*g, "p", "y", "row_id").where(F.expr(" and ".join(f"`{c}` is not null" for c in g)))
        tasks = None if rows <= GROUPED_ROWS else max(-(-rows // GROUPED_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        by_score, by_label = Window.partitionBy(*g).orderBy(F.desc("p"), F.asc("row_id")), Window.partitionBy(*g).orderBy(F.desc("y"))
        # Rows equal in score and id are counted together.
        ranked = dealt_by(known, tasks, *g).withColumns({"_r": F.row_number().over(by_score), "_upto": F.count(F.lit(1)).over(by_score)})
        ranked = ranked.withColumn("_i", F.row_number().over(by_label))
        return ranked.groupBy(*g).agg(*sizes, *top_cols, *best_cols, F.min(F.when(rel == 1, F.col("_upto"))).alias("first_rank"))
    ranked = top_n(df, g, [F.desc("p"), F.asc("row_id")], kmax, rank="_r")
    top = ranked.groupBy(*g).agg(*top_cols)
    best = top_n(df, g, [F.desc("y"), F.asc("row_id")], kmax, rank="_i").groupBy(*g).agg(*best_cols)
    totals = df.groupBy(*g).agg(*sizes, F.min(F.when(rel == 1, F.struct((-F.col("p")).alias("np"), "row_id"))).alias("_first"))
    firsts = totals.where(F.col("_first").isNotNull()).select(*g, "_first")
    ahead = df.join(firsts, g).where(F.struct((-F.col("p")).alias("np"), "row_id") <= F.col("_first"))
    rank = ahead.groupBy(*g).agg(F.count(F.lit(1)).alias("first_rank"))
    return totals.drop("_first").join(top, g).join(best, g).join(rank, g, "left")


def ranking_summary(groups: DataFrame, keys: Sequence[str] = (), *, graded: bool = False, ks: Sequence[int] = KS) -> DataFrame:
    """Means over groups of two or more rows.

    Binary rules: recall, hit rate and MRR only over groups with a positive, NDCG only where the
    ideal gain is not 0. ``graded`` rules count such groups as 0 instead.
    """
    g = groups.where("n >= 2") if not graded else groups
    has = F.col("positives") > 0
    other = F.lit(0.0) if graded else F.lit(None).cast("double")
    cols = []
    for k in ks:
        cols.append(F.avg(F.col(f"hits{k}") / F.least(F.lit(k), F.col("n"))).alias(f"precision_at_{k}"))
        cols.append(F.avg(F.when(has, F.col(f"hits{k}") / F.col("positives")).otherwise(other)).alias(f"recall_at_{k}"))
        cols.append(F.avg(F.when(has, (F.col(f"hits{k}") > 0).cast("double")).otherwise(other)).alias(f"hit_rate_at_{k}"))
        cols.append(F.avg(F.when(F.col(f"idcg{k}") > 0, F.col(f"dcg{k}") / F.col(f"idcg{k}")).otherwise(other)).alias(f"ndcg_at_{k}"))
    cols.append(F.avg(F.when(has, 1 / F.col("first_rank")).otherwise(other)).alias("mrr"))
    out = g.groupBy(*keys).agg(*cols)
    return out.fillna(0.0)


def group_diagnostics(df: DataFrame) -> DataFrame:
    sizes = df.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    big = F.col("n") >= 2
    kept = F.when(big, F.col("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("total_groups"), F.sum(big.cast("long")).alias("evaluated_groups"),
        F.sum((~big).cast("long")).alias("skipped_too_small"), F.sum((big & (F.col("pos") == 0)).cast("long")).alias("without_positives"),
        F.round(F.avg(kept), 4).alias("mean_size"), F.min(kept).alias("min_size"), F.max(kept).alias("max_size"),
        F.percentile(kept, 0.5).alias("p50_size"), F.percentile(kept, 0.9).alias("p90_size"))


def diversity(df: DataFrame, k: int = 10) -> DataFrame:
    """Top-k per group: share of the most frequent category, distinct categories and creators."""
    top = top_n(df, ["group_id"], [F.desc("p"), F.asc("row_id")], k)
    per = top.groupBy("group_id", "category").agg(F.count(F.lit(1)).alias("c"))
    share = per.groupBy("group_id").agg(
        F.round(F.max("c") / F.sum("c"), 6).alias("top_category_share"), F.count(F.lit(1)).alias("unique_categories"))
    return share.join(top.groupBy("group_id").agg(F.countDistinct("creator_id").alias("unique_creators")), "group_id")


def top_k_profile(ranked: DataFrame, k: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Per group over rows ranked (column ``rank``) up to k: uniques, seen rate, concentrations, precision."""
    g = [*keys, "group_id"]
    top = ranked.where((F.col("rank") <= k) & F.expr(" and ".join(f"`{c}` is not null" for c in g)))
    # A group has k rows here, so its values are counted inside an array.
    listed = lambda c: F.collect_list(F.struct(c)).alias(f"_{c}")
    base = top.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("already_seen").cast("double")).alias("seen_rate"), F.avg("y").alias("precision"), listed("category"), listed("creator_id"))
    for col in ("category", "creator_id"):
        v = F.col(f"_{col}")
        squares = F.aggregate(v, F.lit(0).cast("long"), lambda acc, x: acc + F.size(F.filter(v, lambda y: y.eqNullSafe(x))))
        base = base.withColumns({f"unique_{col}": F.size(F.array_distinct(v)).cast("long"), f"{col}_concentration": squares / F.pow(F.col("n"), F.lit(2))})
    return base.drop("_category", "_creator_id")


def bootstrap_intervals(df: DataFrame, threshold: float = 0.5, *, replicates: int = 200, seed: int = 42) -> DataFrame:
    """2.5/97.5 percentiles of five metrics over Poisson-bootstrap replicates.

    Resampling happens per distinct (score, label) cell: the sum of n Poisson(1) row weights is one
    Poisson(n) draw, so equal rows are drawn together and only cells are multiplied by the replicates.
    """
    cells = df.groupBy("p", "y").agg(F.count(F.lit(1)).alias("n"))

    def draw(batches):
        import numpy as np

        for pdf in batches:
            if not len(pdf):
                continue
            parts = []
            for p, y, n in zip(pdf["p"], pdf["y"], pdf["n"]):
                bits = np.array([p], dtype="float64").view("uint64")[0]
                rng = np.random.default_rng([seed, int(bits >> np.uint64(32)), int(bits & np.uint64(0xFFFFFFFF)), int(y)])
                parts.append(pd.DataFrame({"replicate": range(replicates), "p": p, "y": int(y), "w": rng.poisson(n, replicates).astype("int64")}))
            yield pd.concat(parts)

    drawn = cells.mapInPandas(draw, "replicate int, p double, y int, w long").where("w > 0")
    hit, y, w = F.col("p") >= threshold, F.col("y"), F.col("w")
    s = lambda c: F.sum(F.when(c, w).otherwise(0))
    m = drawn.groupBy("replicate").agg(s(hit & (y == 1)).alias("tp"), s(hit & (y == 0)).alias("fp"), s(~hit & (y == 1)).alias("fn"), F.sum(w).alias("n"))
    tp, fp, fn, n = (F.col(c) for c in ("tp", "fp", "fn", "n"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    m = m.withColumns({"accuracy": (n - fp - fn) / n, "precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "f1": div(2 * tp, 2 * tp + fp + fn)})
    m = m.join(threshold_free(drawn, ["replicate"], w).select("replicate", "roc_auc"), "replicate")
    long = m.select(F.expr("stack(5, 'accuracy', accuracy, 'precision', precision, 'recall', recall, 'f1', f1, 'roc_auc', roc_auc) as (metric, v)"))
    return long.groupBy("metric").agg(F.round(F.percentile("v", 0.025), 6).alias("low"), F.round(F.percentile("v", 0.975), 6).alias("high"))


def evaluate(df: DataFrame, thresholds: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """All metrics of each model in ``keys`` in one row; ``thresholds`` has (keys, threshold)."""
    keys = list(keys) or ["_all"]
    scored = df.withColumn("_all", F.lit(0)) if keys == ["_all"] else df
    if thresholds is not None and keys == ["_all"]:
        thresholds = thresholds.withColumn("_all", F.lit(0))
    cut = scored.withColumn("threshold", F.lit(0.5)) if thresholds is None else scored.join(thresholds, keys)
    out = classification(cut, F.col("threshold"), keys)
    for part in (threshold_free(scored, keys), ranking_summary(group_metrics(scored, keys), keys)):
        out = out.join(part, keys)
    return out.drop("_all")


def percentile_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Share of rows at or below, ties averaged, over the whole column."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c")).where(F.col(value).isNotNull())
    at = F.greatest(F.lit(-9e18), F.least(F.lit(9e18), F.col(value).cast("double") * 1e6)).cast("long")
    counts = counts.withColumns({"_one": F.lit(0), "_at": at})
    ranked = prior_state(counts, ["_one"], "_at", [Family(ordered=True, sums={"_before": F.col("_c")})], tie_break=[value])
    total = counts.agg(F.sum("_c")).scalar()
    pct = ranked.select(value, ((F.col("_before") + (F.col("_c") + 1) / 2) / total).alias(name))
    return df.join(pct, value, "left")


def index_values(df: DataFrame, value: str, fractions: Sequence[tuple[int, int]]) -> DataFrame:
    """Values at sorted positions ``n * a // b`` for each (a, b), as one row ``v0, v1, ...``."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c")).withColumns({"_one": F.lit(0), "_at": F.col(value).cast("long")})
    ranked = prior_state(counts, ["_one"], "_at", [Family(ordered=True, sums={"_before": F.col("_c")})], tie_break=[value])
    j = ranked.withColumn("_total", counts.agg(F.sum("_c")).scalar())
    pick = lambda a, b: F.max(F.when(
        (F.col("_before") <= F.floor(F.col("_total") * a / b)) & (F.floor(F.col("_total") * a / b) < F.col("_before") + F.col("_c")), F.col(value)))
    return j.agg(*[pick(a, b).alias(f"v{i}") for i, (a, b) in enumerate(fractions)])


def activity_cohorts(counts: DataFrame, n: str = "n") -> DataFrame:
    """sparse / medium / high by the thirds of the sorted activity counts."""
    j = counts.withColumn("_cut", one_row(index_values(counts, n, [(1, 3), (2, 3)])))
    level = F.when(F.col(n) <= F.col("_cut.v0"), "sparse").when(F.col(n) <= F.col("_cut.v1"), "medium").otherwise("high")
    return j.withColumn("cohort", level).drop("_cut")


def pairwise_inversions(df: DataFrame, *, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Per group the pairs that ``p`` and ``p_alt`` order differently, without forming pairs.

    Both scorings become ranks; walking in the order of the first, each bit of the second rank
    counts, for every 0, the 1s seen before with the same higher bits. That is n log n rows and a
    running sum, so a group of any size splits. Of tied rows the later row_id ranks first.
    """
    work = df.withColumns({"_a": (F.col("p") * SCALE).cast("long"), "_b2": (F.col("p_alt") * SCALE).cast("long")})
    work = work.select("group_id", "row_id", "_a", "_b2")
    heavy = detect(work, ["group_id"], heavy_rows)
    kw = {"heavy": heavy, "heavy_rows": heavy_rows}
    a = prior_state(work, ["group_id"], "_a", [Family(ordered=True, sums={"_ra": F.lit(1)})], tie_break=[F.desc("row_id")], **kw)
    b = prior_state(a, ["group_id"], "_b2", [Family(ordered=True, sums={"_rb": F.lit(1)})], tie_break=[F.desc("row_id")], co_partitioned=heavy is None, **kw)
    sizes = df.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    levels = F.ceil(F.log2(F.greatest(F.lit(2), F.col("size")))).cast("int")
    bits = b.join(sizes, "group_id").withColumn("_level", F.explode(F.sequence(F.lit(0), levels - 1)))
    shifted = F.expr("shiftright(_rb, _level)")
    bits = bits.select("group_id", F.col("_ra").alias("_at"), "_level", (shifted % 2).alias("_bit"), F.floor(shifted / 2).alias("_head"))
    run = prior_state(bits, ["group_id", "_level"], "_at", [Family(keys=["_head"], sums={"_ones": F.col("_bit")})], tie_break=["_head"], **kw)
    inv = run.where("_bit = 0").groupBy("group_id").agg(F.sum("_ones").alias("inversions"))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    return sizes.join(inv, "group_id", "left").select(
        "group_id", F.coalesce("inversions", F.lit(0)).cast("long").alias("inversions"), pairs.cast("long").alias("pairs"),
        F.when(pairs > 0, F.round(F.coalesce("inversions", F.lit(0)) / pairs, 6)).otherwise(0.0).alias("rate"))


def constraint_results(scores: DataFrame, constraints: DataFrame, score: str) -> DataFrame:
    """(group, name, higher, lower, min_margin) against the scores; passed iff the margin is larger."""
    s = scores.select("group_id", "row_id", F.col(score).alias("_s"))
    j = constraints.join(s.withColumnsRenamed({"row_id": "higher", "_s": "left_score"}), ["group_id", "higher"])
    j = j.join(s.withColumnsRenamed({"row_id": "lower", "_s": "right_score"}), ["group_id", "lower"])
    margin = F.col("left_score") - F.col("right_score")
    return j.withColumns({"margin": F.round(margin, 6), "passed": margin > F.greatest(F.lit(0.0), F.col("min_margin"))})


def rerank_effect(before: DataFrame, after: DataFrame) -> DataFrame:
    j = before.select("group_id", "name", F.col("passed").alias("b")).join(
        after.select("group_id", "name", F.col("passed").alias("a")), ["group_id", "name"])
    return j.select("group_id", "name", F.when(~F.col("b") & F.col("a"), "improved").when(F.col("b") & ~F.col("a"), "degraded").otherwise("neutral").alias("effect"))


def score_resolution(df: DataFrame, score: str = "p") -> DataFrame:
    """Per group: range, spread, distinct scores at 6 dp and near-ties of neighbouring scores.

    Neighbours come from a running last value over the distinct scores; equal rows are counted in place.
    """
    cells = df.groupBy("group_id", score).agg(F.count(F.lit(1)).alias("_c")).withColumns(
        {"_at": (F.col(score) * SCALE).cast("long"), "_s": F.col(score)})
    prev = prior_state(cells, ["group_id"], "_at", [Family(ordered=True, lasts={"_prev": F.col("_s")})], tie_break=["_s"])
    gap = F.col(score) - F.col("_prev")
    close = lambda t: F.sum(F.col("_c") - 1 + (F.coalesce(gap, F.lit(1e9)) < t).cast("int"))
    near = prev.groupBy("group_id").agg(close(1e-4).alias("within_1e4"), close(1e-3).alias("within_1e3"),
                                        F.countDistinct(F.round(score, 6)).alias("unique_scores"))
    basic = df.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("count"), F.round(F.min(score), 6).alias("min"), F.round(F.max(score), 6).alias("max"),
        F.round(F.avg(score), 6).alias("mean"), F.round(F.stddev_pop(score), 6).alias("std"))
    return basic.join(near, "group_id")


def _probe(probe: DataFrame, features: Sequence[str]) -> Column:
    return one_row(probe.limit(1).select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]))


def feature_percentiles(reference: DataFrame, probe: DataFrame, features: Sequence[str]) -> DataFrame:
    """Share (percent) of reference rows at or below the single probe row, per feature: one pass."""
    j = reference.withColumn("_p", _probe(probe, features))
    row = j.agg(*[F.round(F.avg((F.col(c) <= F.col(f"_p.{c}")).cast("double")) * 100, 2).alias(c) for c in features])
    return row.select(F.explode(F.create_map(*[x for c in features for x in (F.lit(c), F.col(c))])).alias("feature", "percentile"))


def similar_fraction(reference: DataFrame, probe: DataFrame, features: Sequence[str], tolerance: float = 0.1) -> DataFrame:
    j = reference.withColumn("_p", _probe(probe, features))
    near = F.lit(True)
    for c in features:
        near = near & (F.abs(F.col(c) - F.col(f"_p.{c}")) <= tolerance)
    return j.agg(F.round(F.avg(near.cast("double")), 6).alias("fraction"))


def nearest_neighbour(reference: DataFrame, probe: DataFrame, features: Sequence[str], *, key: str, sample: int | None = None) -> DataFrame:
    """Min and median z-scored distance of the probe to all rows, or to a hash-chosen ``sample`` of that many rows."""
    rows = reference if sample is None else reference.orderBy(F.sha2(F.col(key).cast("string"), 256), key).limit(sample)
    spread = rows.agg(*[F.stddev_pop(c).alias(c) for c in features])
    j = rows.withColumns({"_d": one_row(spread), "_p": _probe(probe, features)})
    square = F.lit(0.0)
    for c in features:
        sd = F.when(F.col(f"_d.{c}") == 0, 1.0).otherwise(F.col(f"_d.{c}"))
        square = square + F.pow((F.col(c) - F.col(f"_p.{c}")) / sd, 2)
    from .drift import exact_quantiles

    d = cut_lineage(j.select(F.lit("d").alias("feature"), F.sqrt(square).alias("value")))
    middle = exact_quantiles(d, [0.5]).select(F.element_at("quantiles", 1))
    return d.agg(F.round(F.min("value"), 4).alias("nearest"), F.round(middle.scalar(), 4).alias("median"), F.count(F.lit(1)).alias("sampled_rows"))


def feature_delta(left: DataFrame, right: DataFrame, features: Sequence[str], least: float = 0.01) -> DataFrame:
    """Features of two single rows that differ by at least ``least``."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.limit(1).select(F.explode(F.create_map(*[x for c in features for x in (F.lit(c), F.coalesce(F.col(c).cast("double"), F.lit(0.0)))])).alias("feature", name))

    d = F.abs(F.col("left_value") - F.col("right_value"))
    return long(left, "left_value").join(long(right, "right_value"), "feature").where(d >= least).select(
        "feature", F.round("left_value", 6).alias("left_value"), F.round("right_value", 6).alias("right_value"), F.round(d, 6).alias("difference"))


def score_matrix(runs: DataFrame, names: Sequence[str]) -> DataFrame:
    """(group, row, run, p) to one row per candidate: rank and score per run and the score spread."""
    g = runs.withColumn("_score", F.col("p"))
    from pyspark.sql import Window

    ranked = g.withColumn("_rank", F.row_number().over(Window.partitionBy("group_id", "run").orderBy(F.desc("_score"), "row_id")))
    wide = ranked.groupBy("group_id", "row_id").pivot("run", list(names)).agg(F.first("_score").alias("score"), F.first("_rank").cast("long").alias("rank"))
    present = F.lit(0)
    for n in names:
        present = present + F.col(f"{n}_score").isNotNull().cast("int")
    spread = F.greatest(*[F.col(f"{n}_score") for n in names]) - F.least(*[F.col(f"{n}_score") for n in names])
    return wide.withColumn("spread", F.when(present >= 2, F.round(spread, 6)))


def top_category_shares(runs: DataFrame, k: int = 10) -> DataFrame:
    top = top_n(runs, ["group_id", "run"], [F.desc("p"), F.asc("row_id")], k)
    per = top.groupBy("run", "category").agg(F.count(F.lit(1)).alias("c"))
    total = top.groupBy("run").agg(F.count(F.lit(1)).alias("t"))
    return per.join(total, "run").select("run", "category", F.round(F.col("c") / F.col("t"), 6).alias("share"))


def candidate_vs_baseline(df: DataFrame, candidate: str, baseline: str) -> DataFrame:
    """Graded NDCG@10 and binary precision@5 of two score columns; PASS when neither falls."""
    def run(score: str, prefix: str) -> DataFrame:
        s = df.withColumn("p", F.col(score))
        graded = ranking_summary(group_metrics(s, ks=[10]), ks=[10]).select(F.col("ndcg_at_10").alias(f"{prefix}_ndcg"))
        binary = ranking_summary(group_metrics(s.withColumn("y", (F.col("y") > 0).cast("int")), ks=[5]), ks=[5])
        return graded.withColumn(f"{prefix}_precision", binary.select("precision_at_5").scalar())

    base = one_row(run(baseline, "baseline"))
    j = run(candidate, "candidate").withColumn("_b", base).select("*", "_b.*").drop("_b")
    ok = (F.col("candidate_ndcg") >= F.col("baseline_ndcg")) & (F.col("candidate_precision") >= F.col("baseline_precision"))
    return j.select(
        *[F.round(c, 6).alias(c) for c in ("candidate_ndcg", "candidate_precision", "baseline_ndcg", "baseline_precision")],
        F.round(F.col("candidate_ndcg") - F.col("baseline_ndcg"), 6).alias("ndcg_delta"),
        F.round(F.col("candidate_precision") - F.col("baseline_precision"), 6).alias("precision_delta"),
        F.when(ok, "PASS").otherwise("FAIL").alias("status"))


def result_parity(left: DataFrame, right: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Positions where two ranked results (group, rank, row_id, category, reason, score) differ."""
    cols = ["row_id", "category", "reason", "score"]
    l2 = left.select("group_id", "rank", *[F.col(c).alias(f"l_{c}") for c in cols])
    r2 = right.select("group_id", "rank", *[F.col(c).alias(f"r_{c}") for c in cols])
    j = l2.join(r2, ["group_id", "rank"], "full_outer")
    same = lambda c: F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    close = F.coalesce(F.abs(F.col("l_score") - F.col("r_score")) <= tolerance, F.lit(False))
    return j.select(
        "group_id", "rank", (F.col("l_row_id").isNull() | F.col("r_row_id").isNull()).alias("length_differs"),
        (~same("row_id")).alias("content_differs"), (~same("category")).alias("category_differs"),
        (~same("reason")).alias("reason_differs"), (~close).alias("score_differs"),
    ).where("length_differs or content_differs or category_differs or reason_differs or score_differs")


# Weights of model selection.
SELECTION_WEIGHTS = {"ndcg_at_10": 0.35, "precision_at_10": 0.25, "average_precision": 0.25, "recall_at_10": 0.15}


def selection_score() -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in SELECTION_WEIGHTS.items()), F.lit(0.0))


def select_winner(models: DataFrame) -> DataFrame:
    """One row per model in, the winner out: eligible first, then score, AP, log loss, duration, name."""
    return models.withColumn("selection_score", F.round(selection_score(), 6)).orderBy(
        F.desc("eligible"), F.desc("selection_score"), F.desc("average_precision"), F.asc_nulls_last("log_loss"),
        F.asc("duration_seconds"), F.asc("model")).limit(1)


# Weights of the quality score.
QUALITY_WEIGHTS = {
    "hard_ndcg": 0.3, "adversarial_ndcg": 0.2, "critical_pass_rate": 0.2, "medium_ndcg": 0.15, "average_precision": 0.1,
    "precision_at_10": 0.025, "recall_at_10": 0.025,
}


def quality_score(for_ranker: bool = False) -> Column:
    weights = dict(QUALITY_WEIGHTS)
    if for_ranker:
        kept = {k: weights[k] for k in ("hard_ndcg", "adversarial_ndcg", "critical_pass_rate", "medium_ndcg")}
        total = sum(kept.values())
        weights = {k: round(v / total, 6) for k, v in kept.items()}
    return F.round(sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0)), 6)


def retrieval_report(ranked: DataFrame, positives: DataFrame, catalog_size: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """(query, item, rank) lists against (query, item) positives, one relevant item per row."""
    j = positives.join(ranked, ["query_id", "item_id"], "left")
    r = F.col("rank")
    hits = [F.avg(F.coalesce((r <= k).cast("double"), F.lit(0.0))).alias(f"recall_at_{k}") for k in ks]
    quality = j.agg(
        F.count(F.lit(1)).alias("queries"), *hits, F.avg(F.coalesce(1 / r, F.lit(0.0))).alias("mrr"),
        F.avg(F.when(r <= 10, math.log(2) / F.log(r + 1.0)).otherwise(0.0)).alias("ndcg_at_10"))
    found = ranked.where(r <= max(ks)).agg(F.countDistinct("item_id")).scalar()
    return quality.withColumn("coverage", found / catalog_size.select("catalog_size").scalar())


def most_retrieved(ranked: DataFrame, top_k: int, n: int = 10) -> DataFrame:
    return ranked.where(F.col("rank") <= top_k).groupBy("item_id").agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), "item_id").limit(n)
