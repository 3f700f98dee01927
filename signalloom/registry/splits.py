"""Split queries over the labelled interactions, grouped by user and day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signals
from ..operators import splits
from ..sources import adapter
from .base_sql import with_ctes

RATIOS = splits.LIFECYCLE[0][0]


def _labelled(spark, d):
    rows = signals.annotate(adapter.interactions(spark, d)).where("target is not null")
    day = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd")
    return rows.select("event_id", "target", "ts_us", F.concat_ws(":", "user_id", day).alias("candidate_group"))


def chronological_blocks(spark, d):
    return splits.chronological_blocks(_labelled(spark, d)).select("candidate_group", "min_us", "max_us", "size", "block")


def chronological_group_split(spark, d):
    rows = _labelled(spark, d)
    return splits.chronological_split(rows, RATIOS).select("event_id", "split")


def split_lifecycle(spark, d):
    rows, roles = splits.split_lifecycle(_labelled(spark, d))
    per = rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("target").cast("long").alias("positives"))
    named = F.create_map(*[x for role, s in roles.items() for x in (F.lit(role), F.lit(s))])
    return per.select(F.explode(named).alias("role", "_s"), "split", "rows", "positives").where("_s = split").drop("_s")


def query_group_split(spark, d):
    rows = adapter.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("query_id"),
                                                  F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts_us"))
    return splits.query_group_split(rows).select("row_id", "split")


QUERIES = {
    "chronological_blocks": chronological_blocks, "chronological_group_split": chronological_group_split,
    "split_lifecycle": split_lifecycle, "query_group_split": query_group_split,
}

_BLOCKS = """
lab AS (SELECT event_id, target, ts_us, user_id || ':' || strftime(make_timestamp(ts_us), '%Y-%m-%d') AS candidate_group FROM sig WHERE target IS NOT NULL),
grp AS (SELECT candidate_group, min(ts_us) AS min_us, max(ts_us) AS max_us, count(*) AS size FROM lab GROUP BY 1),
blk AS (SELECT * EXCLUDE (st), CAST(sum(st) OVER (ORDER BY min_us, candidate_group ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM
  (SELECT *, coalesce(min_us > max(max_us) OVER (ORDER BY min_us, candidate_group ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE)::INT AS st FROM grp)),
sz AS (SELECT block, sum(size) AS n, sum(sum(size)) OVER (ORDER BY block) - sum(size) AS before, (SELECT count(*) FROM lab) AS total FROM blk GROUP BY 1),
spl AS (SELECT block, ['train','modelSelection','calibration','thresholdTuning','test'][1
    + (before + n / 2 > round_even(total * 0.40::DOUBLE, 0))::INT + (before + n / 2 > round_even(total * 0.55::DOUBLE, 0))::INT
    + (before + n / 2 > round_even(total * 0.70::DOUBLE, 0))::INT + (before + n / 2 > round_even(total * 0.80::DOUBLE, 0))::INT] AS split FROM sz)"""
ORACLE = {
    "chronological_blocks": with_ctes("SELECT * FROM blk", "SIG", extra=_BLOCKS),
    "chronological_group_split": with_ctes(
        "SELECT event_id, split FROM lab JOIN blk USING (candidate_group) JOIN spl USING (block)", "SIG", extra=_BLOCKS),
    "split_lifecycle": with_ctes("""SELECT split AS role, split, count(*) AS rows, CAST(sum(target) AS BIGINT) AS positives
        FROM lab JOIN blk USING (candidate_group) JOIN spl USING (block) GROUP BY 1, 2""", "SIG", extra=_BLOCKS),
    "query_group_split": """WITH q AS (SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderdate), o_custkey) - 1 AS i, count(*) OVER () AS n
          FROM orders GROUP BY 1)
        SELECT o_orderkey AS row_id, CASE WHEN i < floor(n * 0.70::DOUBLE) THEN 'train'
          WHEN i < floor(n * 0.70::DOUBLE) + greatest(1, floor(n * 0.15::DOUBLE)) THEN 'scale' ELSE 'test' END AS split FROM orders JOIN q USING (o_custkey)""",
}
