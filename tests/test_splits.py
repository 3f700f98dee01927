"""Chronological splits: whole groups, strict order, slicing, errors."""

import pytest
from pyspark.sql import functions as F

from signalloom.operators import splits


def data(spark, groups=40):
    return spark.range(groups * 5).select(F.concat(F.lit("g"), F.col("id") % groups).alias("candidate_group"), ((F.col("id") % groups) * 100 + F.col("id") / groups).cast("long").alias("ts_us"),
                                          (F.col("id") % 3 == 0).cast("int").alias("target"))


@pytest.mark.parametrize("heavy_rows", [10**9, 7])
def test_groups_stay_whole_and_ordered(spark, heavy_rows):
    s = splits.chronological_split(data(spark), {"train": 0.5, "test": 0.5}, heavy_rows=heavy_rows)
    got = s.groupBy("split").agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    by = {r["split"]: r for r in got}
    assert by["train"]["n"] == by["test"]["n"] == 100 and by["train"]["b"] < by["test"]["a"]
    assert s.select("candidate_group", "split").distinct().count() == 40


def test_overlapping_groups_share_a_block(spark):
    df = spark.createDataFrame([("a", 1), ("a", 10), ("b", 5), ("b", 20), ("c", 15), ("d", 21)], "candidate_group string, ts_us long")
    got = {r["candidate_group"]: r["block"] for r in splits.chronological_blocks(df).collect()}
    assert got["a"] == got["b"] == got["c"] and got["d"] == got["a"] + 1


def test_empty_split_is_an_error(spark):
    one = spark.createDataFrame([("a", 1), ("b", 1)], "candidate_group string, ts_us long")
    with pytest.raises(splits.InsufficientSplitData):
        splits.chronological_split(one, {"train": 0.5, "test": 0.5})


def test_lifecycle_falls_back(spark):
    rows = [(f"g{i}", i * 10 + j, (i + j) % 2) for i in range(6) for j in range(2)]
    df = spark.createDataFrame(rows, "candidate_group string, ts_us long, target int")
    out, roles = splits.split_lifecycle(df)
    assert set(roles) == set(splits.ROLES) and out.count() == 12
    assert roles["thresholdTuning"] == "calibration"
