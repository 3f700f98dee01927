"""Feature baselines and drift. A baseline is a table with one row per feature.

Exact quantiles come from distinct values and running counts, so no reducer ever holds a whole
column. Bins, shares and top categories are short arrays in the feature's row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .running import Family, prior_state, top_n

QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9]
BINS = 10
MAX_CATEGORIES = 20
EPSILON = 1e-4
MIN_OBSERVATIONS = 30
# Fixed values: (warning, critical) per signal.
PSI_LIMITS = (0.1, 0.25)
MISSING_LIMITS = (0.1, 0.25)
OTHER_LIMITS = (0.05, 0.20)
RANGE_LIMITS = (0.05, 0.20)
STATUS = ["OK", "WARNING", "CRITICAL"]


class DriftSchemaMismatch(Exception):
    pass


def numeric_long(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value) rows; NULL, NaN and infinities become NULL values."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]
    x = df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
    bad = F.isnan("value") | (F.abs("value") == float("inf"))
    return x.withColumn("value", F.when(~bad, F.col("value")))


def categorical_long(df: DataFrame, features: Sequence[str]) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in features]
    return df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def exact_quantiles(long: DataFrame, levels: Sequence[float], **kw) -> DataFrame:
    """Linear-interpolated quantiles per feature as an array in the order of ``levels``."""
    counts = long.where("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_c"))
    at = F.greatest(F.lit(-9e18), F.least(F.lit(9e18), F.col("value") * 1e6)).cast("long")
    run = prior_state(counts.withColumn("_at", at), ["feature"], "_at", [Family(ordered=True, sums={"_before": F.col("_c")})],
                      tie_break=["value"], **kw)
    n = counts.groupBy("feature").agg(F.sum("_c").alias("_n"))
    j = run.join(n, "feature")

    def holds(position: Column) -> Column:
        return (F.col("_before") <= position) & (position < F.col("_before") + F.col("_c"))

    aggs, outs = [], []
    for i, q in enumerate(levels):
        pos = F.lit(q) * (F.col("_n") - 1)
        aggs += [
            F.max(F.when(holds(F.floor(pos)), F.col("value"))).alias(f"lo{i}"),
            F.max(F.when(holds(F.ceil(pos)), F.col("value"))).alias(f"hi{i}"), F.first(pos - F.floor(pos)).alias(f"t{i}"),
        ]
        outs.append(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"t{i}"))
    return j.groupBy("feature").agg(*aggs).select("feature", F.array(*outs).alias("quantiles"))


def bin_of(value: Column, edges: Column) -> Column:
    """Right-closed bin index: edges strictly below the value."""
    return F.size(F.filter(edges, lambda e: e < value))


def _shares(counted: DataFrame, n_bins: int) -> DataFrame:
    """(feature, bin, c) to the array of shares in bin order, empty bins as 0."""
    by_bin = F.map_from_entries(F.collect_list(F.struct("bin", "c")))
    total = F.sum("c")
    filled = counted.groupBy("feature").agg(by_bin.alias("_m"), total.alias("_t"))
    bins = F.sequence(F.lit(0), F.lit(n_bins - 1))
    return filled.select("feature", F.transform(bins, lambda b: F.coalesce(F.try_element_at("_m", b), F.lit(0)) / F.col("_t")).alias("proportions"))


def numeric_baseline(df: DataFrame, features: Sequence[str], *, bins: int = BINS, **kw) -> DataFrame:
    """Counts, moments, quantiles, bin edges and bin shares per numeric feature."""
    long = numeric_long(df, features)
    stats = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("count"), (F.count(F.lit(1)) - F.count("value")).alias("missing"),
        F.round(F.min("value"), 6).alias("min"), F.round(F.max("value"), 6).alias("max"),
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))
    inner = [i / bins for i in range(1, bins)]
    q = exact_quantiles(long, [*QUANTILES, *inner], **kw).select(
        "feature", F.slice("quantiles", 1, len(QUANTILES)).alias("quantiles"), F.slice("quantiles", len(QUANTILES) + 1, bins - 1).alias("edges"))
    counted = long.where("value is not null").join(F.broadcast(q.select("feature", "edges")), "feature").groupBy(
        "feature", bin_of(F.col("value"), F.col("edges")).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    r6 = lambda c: F.transform(c, lambda x: F.round(x, 6))
    return (
        stats.join(q, "feature", "left").join(_shares(counted, bins), "feature", "left")
        .select(F.lit("numeric").alias("kind"), "feature", "count", "missing", "min", "max", "mean", "std",
                r6("quantiles").alias("quantiles"), r6("edges").alias("edges"), r6("proportions").alias("proportions"))
    )


def categorical_baseline(df: DataFrame, features: Sequence[str], *, top: int = MAX_CATEGORIES) -> DataFrame:
    """Shares of the most frequent values per feature, the rest as ``other``. Ties go by value."""
    long = categorical_long(df, features)
    stats = long.groupBy("feature").agg(F.count(F.lit(1)).alias("count"), (F.count(F.lit(1)) - F.count("value")).alias("missing"))
    counts = long.where("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    best = top_n(counts, ["feature"], [F.desc("c"), F.asc("value")], top, rank="_r")
    listed = best.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("_r", "value", "c"))).alias("_l"), F.sum("c").alias("_listed"))
    present = F.col("count") - F.col("missing")
    return stats.join(listed, "feature", "left").select(
        F.lit("categorical").alias("kind"), "feature", "count", "missing",
        F.coalesce(F.transform("_l", lambda s: s["value"]), F.array().cast("array<string>")).alias("labels"),
        F.coalesce(F.transform("_l", lambda s: F.round(s["c"] / present, 6)), F.array().cast("array<double>")).alias("proportions"),
        F.when(present > 0, F.round((present - F.coalesce("_listed", F.lit(0))) / present, 6)).otherwise(0.0).alias("other"))


def build_baseline(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], **kw) -> DataFrame:
    return numeric_baseline(df, numeric, **kw).unionByName(categorical_baseline(df, categorical), allowMissingColumns=True)


def psi(p: Column, q: Column) -> Column:
    """Population stability index of two share arrays."""
    lift = lambda x: F.greatest(x, F.lit(EPSILON))
    terms = F.zip_with(p, q, lambda a, b: (lift(b) - lift(a)) * F.log(lift(b) / lift(a)))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits of two floored, renormalized share arrays."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    lift = lambda a: F.transform(a, lambda x: F.greatest(x, F.lit(EPSILON)))
    sp, sq = total(lift(p)), total(lift(q))
    half = F.zip_with(lift(p), lift(q), lambda a, b: _js_term(a / sp, b / sq))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total(half) / (2 * math.log(2))))


def _js_term(a: Column, b: Column) -> Column:
    m = (a + b) / 2
    return a * F.log(a / m) + b * F.log(b / m)


def _severity(value: Column, limits: tuple[float, float]) -> Column:
    return F.when(value >= limits[1], 2).when(value >= limits[0], 1).otherwise(0)


def _status(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATUS]), level + 1)


def numeric_drift(baseline: DataFrame, observed: DataFrame, features: Sequence[str]) -> DataFrame:
    b = baseline.where(F.col("kind") == "numeric").select(
        "feature", F.col("count").alias("_bc"), F.col("missing").alias("_bm"), F.col("min").alias("_lo"), F.col("max").alias("_hi"), "edges",
        F.col("proportions").alias("_p"))
    rows = numeric_long(observed, features).join(F.broadcast(b), "feature")
    v = F.col("value")
    cells = rows.groupBy("feature", F.when(v.isNotNull(), bin_of(v, F.col("edges"))).alias("bin")).agg(
        F.count(F.lit(1)).alias("c"), F.sum(((v < F.col("_lo")) | (v > F.col("_hi"))).cast("long")).alias("out"))
    o = cells.groupBy("feature").agg(
        F.sum("c").alias("observed_count"), F.sum(F.when(F.col("bin").isNull(), F.col("c")).otherwise(0)).alias("_om"),
        F.sum(F.when(F.col("bin").isNotNull(), F.col("out"))).alias("_out"),
        F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "c")))).alias("_m"))
    finite = F.col("observed_count") - F.col("_om")
    shares = F.transform(F.sequence(F.lit(0), F.size("_p") - 1),
                         lambda i: F.when(finite > 0, F.coalesce(F.try_element_at("_m", i), F.lit(0)) / finite).otherwise(0.0))
    j = o.join(b, "feature").withColumn("_q", shares)
    base_rate = F.when(F.col("_bc") > 0, F.col("_bm") / F.col("_bc")).otherwise(0.0)
    j = j.withColumns({
        "psi": psi(F.col("_p"), F.col("_q")), "missing_rate_delta": F.abs(F.col("_om") / F.col("observed_count") - base_rate),
        "out_of_range_rate": F.when(finite > 0, F.col("_out") / finite).otherwise(0.0),
    })
    level = F.greatest(_severity(F.col("psi"), PSI_LIMITS), _severity(F.col("missing_rate_delta"), MISSING_LIMITS),
                       _severity(F.col("out_of_range_rate"), RANGE_LIMITS))
    r = lambda c: F.round(c, 6).alias(c)
    return j.select(F.lit("numeric").alias("kind"), "feature", _status(level).alias("status"), r("psi"), "observed_count",
                    r("missing_rate_delta"), r("out_of_range_rate"), level.alias("severity"))


def categorical_drift(baseline: DataFrame, observed: DataFrame, features: Sequence[str]) -> DataFrame:
    b = baseline.where(F.col("kind") == "categorical").select(
        "feature", F.col("count").alias("_bc"), F.col("missing").alias("_bm"), "labels", F.col("proportions").alias("_p"), F.col("other").alias("_po"))
    rows = categorical_long(observed, features).join(F.broadcast(b.select("feature", "labels")), "feature")
    v = F.col("value")
    cells = rows.groupBy("feature", F.when(v.isNotNull(), F.array_position("labels", v)).alias("pos")).agg(F.count(F.lit(1)).alias("c"))
    o = cells.groupBy("feature").agg(
        F.sum("c").alias("observed_count"), F.sum(F.when(F.col("pos").isNull(), F.col("c")).otherwise(0)).alias("_om"),
        F.map_from_entries(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "c")))).alias("_m"))
    present = F.col("observed_count") - F.col("_om")
    share = lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)) / present
    known = F.when(F.size("labels") > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("labels"))), lambda i: share(i.cast("long")))).otherwise(
        F.array().cast("array<double>"))
    # A value outside the listed labels has position 0: the "other" share closes both arrays.
    j = o.join(b, "feature").withColumns({"_q": F.concat(known, F.array(share(F.lit(0).cast("long")))), "_pp": F.concat("_p", F.array("_po"))})
    empty = (present == 0) | ((F.size("labels") == 0) & (F.col("_po") == 0))
    base_rate = F.when(F.col("_bc") > 0, F.col("_bm") / F.col("_bc")).otherwise(0.0)
    j = j.withColumns({
        "psi": F.when(empty, 0.0).otherwise(psi(F.col("_pp"), F.col("_q"))),
        "js_divergence": F.when(empty, 0.0).otherwise(js_divergence(F.col("_pp"), F.col("_q"))),
        "missing_rate_delta": F.abs(F.col("_om") / F.col("observed_count") - base_rate),
        "other_rate_delta": F.abs(F.when(empty, 0.0).otherwise(share(F.lit(0).cast("long"))) - F.col("_po")),
    })
    level = F.greatest(_severity(F.col("psi"), PSI_LIMITS), _severity(F.col("missing_rate_delta"), MISSING_LIMITS),
                       _severity(F.col("other_rate_delta"), OTHER_LIMITS))
    r = lambda c: F.round(c, 6).alias(c)
    return j.select(F.lit("categorical").alias("kind"), "feature", _status(level).alias("status"), r("psi"), r("js_divergence"),
                    "observed_count", r("missing_rate_delta"), r("other_rate_delta"), level.alias("severity"))


def evaluate_drift(baseline: DataFrame, observed: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Per-feature drift plus an ``__overall__`` row with the worst status.

    Fewer than thirty observations give INSUFFICIENT_DATA only; a missing column is an error.
    """
    absent = [c for c in [*categorical, *numeric] if c not in observed.columns]
    if absent:
        raise DriftSchemaMismatch(f"observations lack feature columns {sorted(absent)}")
    features = numeric_drift(baseline, observed, numeric).unionByName(categorical_drift(baseline, observed, categorical), allowMissingColumns=True)
    overall = features.agg(F.max("severity").alias("severity"), F.max("observed_count").alias("observed_count")).select(
        F.lit("overall").alias("kind"), F.lit("__overall__").alias("feature"),
        F.when(F.coalesce("observed_count", F.lit(0)) < MIN_OBSERVATIONS, "INSUFFICIENT_DATA").otherwise(_status(F.col("severity"))).alias("status"),
        F.coalesce("observed_count", F.lit(0)).alias("observed_count"))
    enough = features.where(F.col("observed_count") >= MIN_OBSERVATIONS).drop("severity")
    return enough.unionByName(overall, allowMissingColumns=True)


def baseline_violations(baseline: DataFrame, sample_count: int | Column | None = None) -> DataFrame:
    """One row per broken structural rule of a baseline table."""
    tol, order, upper = 1e-4, 1e-9, 1.0 + 1e-6
    total = lambda a: F.aggregate(F.coalesce(a, F.array().cast("array<double>")), F.lit(0.0), lambda acc, x: acc + x)
    falls = lambda a: F.exists(F.zip_with(F.slice(a, 2, F.greatest(F.lit(0), F.size(a) - 1)), F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - 1)), lambda y, x: y < x - order), lambda b: b)
    numeric, filled = F.col("kind") == "numeric", F.col("count") > F.col("missing")
    p = F.col("proportions")
    rules = {
        "NEGATIVE_COUNT": (F.col("count") < 0) | (F.col("missing") < 0),
        "MISSING_EXCEEDS_COUNT": F.col("missing") > F.col("count"),
        "MIN_ABOVE_MAX": numeric & (F.col("min") > F.col("max")),
        "MEAN_OUT_OF_RANGE": numeric & ((F.col("mean") < F.col("min") - order) | (F.col("mean") > F.col("max") + order)),
        "NEGATIVE_STD": numeric & (F.col("std") < 0),
        "STATS_MISSING": numeric & filled & (F.col("min").isNull() | F.col("max").isNull() | F.col("mean").isNull() | F.col("std").isNull()),
        "STATS_PRESENT_WITHOUT_VALUES": numeric & ~filled & F.col("mean").isNotNull(),
        "QUANTILES_DECREASE": numeric & filled & falls(F.col("quantiles")),
        "QUANTILE_OUT_OF_RANGE": numeric & filled & F.exists("quantiles", lambda x: (x < F.col("min") - order) | (x > F.col("max") + order)),
        "EDGES_DECREASE": numeric & filled & falls(F.col("edges")),
        "LENGTH_MISMATCH": numeric & filled & (F.size(p) != F.size("edges") + 1),
        "SHARE_OUT_OF_RANGE": F.exists(p, lambda x: (x < 0) | (x > upper)) | (F.col("other") < 0) | (F.col("other") > upper),
        "SHARES_DO_NOT_SUM": filled & (F.abs(total(p) + F.coalesce("other", F.lit(0.0)) - 1) > tol),
        "TOO_MANY_LABELS": (F.col("kind") == "categorical") & (F.size("labels") > MAX_CATEGORIES),
        "DUPLICATE_LABELS": (F.col("kind") == "categorical") & (F.size(F.array_distinct("labels")) < F.size("labels")),
        "BLANK_LABEL": (F.col("kind") == "categorical") & F.exists("labels", lambda x: F.trim(x) == ""),
    }
    if sample_count is not None:
        rules["COUNT_DISAGREES"] = F.col("count") != sample_count
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    broken = baseline.select("kind", "feature", F.explode(found).alias("violation"))
    twice = baseline.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.first("kind").alias("kind")).where("n > 1").select(
        "kind", "feature", F.lit("DUPLICATE_FEATURE").alias("violation"))
    return broken.unionByName(twice)
