"""Chronological splits that never cut a group."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .profiles import class_distribution
from .running import HEAVY_ROWS, Family, detect, prior_state

# Split attempts, widest first; aliases name the split that stands in for a missing one.
LIFECYCLE = [
    ({"train": 0.40, "modelSelection": 0.15, "calibration": 0.15, "thresholdTuning": 0.10, "test": 0.20}, {}),
    ({"train": 0.50, "modelSelection": 0.15, "calibration": 0.15, "test": 0.20}, {"thresholdTuning": "calibration"}),
    ({"train": 0.60, "modelSelection": 0.20, "test": 0.20}, {"calibration": "modelSelection", "thresholdTuning": "modelSelection"}),
]
ROLES = ["train", "modelSelection", "calibration", "thresholdTuning", "test"]


class InsufficientSplitData(Exception):
    pass


def _global(df: DataFrame, at: str, fam: Family, tie_break: str, **kw) -> DataFrame:
    """A running state over the whole table; it is sliced along ``at`` once it is large."""
    return prior_state(df.withColumn("_one", F.lit(0)), ["_one"], at, [fam], tie_break=[tie_break], **kw).drop("_one")


def chronological_blocks(df: DataFrame, group: str = "candidate_group", ts: str = "ts_us", **kw) -> DataFrame:
    """Groups with their time range and the block of transitively overlapping ranges they belong to."""
    groups = df.groupBy(group).agg(F.min(ts).alias("min_us"), F.max(ts).alias("max_us"), F.count(F.lit(1)).alias("size"))
    groups = cut_lineage(groups)
    kw = {"heavy": detect(groups.withColumn("_one", F.lit(0)), ["_one"], kw.get("heavy_rows", HEAVY_ROWS)), **kw}
    a = _global(groups, "min_us", Family(ordered=True, maxs={"_before": F.col("max_us")}), group, **kw)
    a = a.withColumn("_starts", F.coalesce((F.col("min_us") > F.col("_before")).cast("long"), F.lit(0)))
    b = _global(a, "min_us", Family(ordered=True, sums={"block": F.col("_starts")}), group, **kw)
    return b.withColumn("block", F.col("block") + F.col("_starts")).drop("_before", "_starts")


def assign_splits(df: DataFrame, ratios: Mapping[str, float], group: str = "candidate_group", ts: str = "ts_us", **kw) -> DataFrame:
    """Groups with their split: a block goes where its midpoint falls among the cumulative row boundaries."""
    names, running = list(ratios), 0.0
    if abs(sum(ratios.values()) - 1.0) > 1e-6:
        raise ValueError("split ratios must sum to 1")
    groups = cut_lineage(chronological_blocks(df, group, ts, **kw))
    blocks = groups.groupBy("block").agg(F.sum("size").alias("rows"), F.min("min_us").alias("min_us"))
    placed = _global(blocks, "min_us", Family(ordered=True, sums={"_earlier": F.col("rows")}), "block", **kw)
    placed = placed.withColumn("_total", blocks.agg(F.sum("rows")).scalar())
    midpoint = F.col("_earlier") + F.col("rows") / 2
    index = F.lit(0)
    for name in names[:-1]:
        running += ratios[name]
        index = index + (midpoint > F.bround(F.col("_total") * running, 0)).cast("int")
    labels = F.array(*[F.lit(n) for n in names])
    placed = placed.select("block", F.element_at(labels, index + 1).alias("split"))
    return groups.join(placed, "block")


def chronological_split(df: DataFrame, ratios: Mapping[str, float], group: str = "candidate_group", ts: str = "ts_us", **kw) -> DataFrame:
    """Rows with a ``split`` column; an empty split is an error."""
    assigned = cut_lineage(assign_splits(df, ratios, group, ts, **kw).select(group, "split"))
    found = {r["split"] for r in assigned.select("split").distinct().collect()}
    missing = [n for n in ratios if n not in found]
    if missing:
        raise InsufficientSplitData(f"empty splits {missing} of {list(ratios)}")
    return df.join(assigned, group)


def split_lifecycle(df: DataFrame, label: str = "target", **kw) -> tuple[DataFrame, dict[str, str]]:
    """First attempt whose splits are all non-empty and hold both classes: rows with ``split``, role -> split."""
    failures = []
    for ratios, aliases in LIFECYCLE:
        try:
            rows = chronological_split(df, ratios, **kw)
        except InsufficientSplitData as exc:
            failures.append(str(exc))
            continue
        classes = rows.groupBy("split").agg(F.countDistinct(label).alias("k")).collect()
        single = sorted(r["split"] for r in classes if r["k"] < 2)
        if single:
            failures.append(f"splits {single} lack both classes")
            continue
        return rows, {role: aliases.get(role, role) for role in ROLES}
    raise InsufficientSplitData("; ".join(failures))


def query_group_split(df: DataFrame, query: str = "query_id", ts: str = "ts_us", **kw) -> DataFrame:
    """70 % / 15 % / rest of the queries by time, whole queries only."""
    queries = df.groupBy(query).agg(F.min(ts).alias("first_us"))
    numbered = _global(queries, "first_us", Family(ordered=True, sums={"_i": F.lit(1)}), query, **kw)
    numbered = numbered.withColumn("_n", queries.agg(F.count(F.lit(1))).scalar())
    train_end = F.floor(F.col("_n") * 0.70)
    scale_end = train_end + F.greatest(F.lit(1), F.floor(F.col("_n") * 0.15))
    placed = numbered.select(
        query, F.when(F.col("_i") < train_end, "train").when(F.col("_i") < scale_end, "scale").otherwise("test").alias("split"))
    return df.join(placed, query)


__all__ = ["InsufficientSplitData", "assign_splits", "chronological_blocks", "chronological_split", "class_distribution",
           "query_group_split", "split_lifecycle"]
