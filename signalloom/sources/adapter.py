"""Driver tables as interactions and contents.

``part`` is the catalog and ``events`` the interaction log; the same two derivations, written in
SQL, open every oracle query (``registry.base_sql``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import tokens

DAY_US = 86_400_000_000
CATALOG_EPOCH_US = 1_701_388_800_000_000  # 2023-12-01 00:00:00 UTC
SCORING_US = 1_706_745_600_000_000  # 2024-02-01 00:00:00 UTC
DECISION_US = 1_705_363_200_000_000  # 2024-01-16 00:00:00 UTC


#: Bytes of rows in memory for a byte of a Parquet file, about. Joins whose sides are broadcast pass them through the driver.
FILE_TO_ROWS = 10.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Sides are planned as broadcasts by the size of files, which holds a catalog of millions of rows for small.
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(FILE_TO_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        key.cast("string").alias("content_id"),
        F.col("p_brand").alias("creator_id"),
        F.upper("p_type").alias("category"),
        F.when(key % 5 == 4, "LIVE").otherwise("VIDEO").alias("content_type"),
        (F.col("p_size") % 10 != 0).alias("is_active"),
        (((key * 37) % 100).cast("double") / 100).alias("popularity_score"),
        (F.col("p_size").cast("long") * DAY_US + CATALOG_EPOCH_US).alias("created_us"),
        F.col("p_name").alias("title"),
        tokens.normalize_tokens(F.split("p_name", " ")).alias("hashtags"),
        tokens.normalize_tokens(F.array("p_type")).alias("topics"),
        tokens.normalize_tokens(F.array("p_brand")).alias("entities"),
        F.array().cast("array<string>").alias("subgenres"),
    )


def raw_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an interaction row, pending ones included."""
    e = table(spark, sf_dir, "events")
    c = contents(spark, sf_dir).select("content_id", "creator_id", "category", "content_type")
    v, t = F.col("value"), F.col("e_type")
    video = (
        F.when(t == "view", F.when(v < 20, "VIDEO_SKIPPED").when(v >= 90, "VIDEO_COMPLETED").otherwise("VIDEO_WATCHED"))
        .when(t == "click", "CONTENT_LIKED").when(t == "purchase", "CONTENT_SHARED")
        .when(t == "signup", "CREATOR_FOLLOWED").otherwise("CONTENT_NOT_INTERESTED")
    )
    live = (
        F.when(t == "view", "LIVE_WATCHED").when(t == "click", "LIVE_JOINED").when(t == "purchase", "LIVE_GIFT_SENT")
        .when(t == "signup", "LIVE_LEFT").otherwise("LIVE_NOT_INTERESTED")
    )
    is_video, view = F.col("content_type") == "VIDEO", t == "view"
    e = e.select(
        "event_id", "user_id", F.col("event_type").alias("e_type"), "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.get_json_object("props", "$.k").alias("content_id"),
    )
    return e.join(c, "content_id").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("user_id"),
        "content_id", "creator_id", "category", "content_type",
        F.when(is_video, video).otherwise(live).alias("event_type"),
        F.when(view, v).alias("watch_time_seconds"),
        F.when(view & is_video, F.lit(100.0)).alias("content_duration_seconds"),
        F.when(view & is_video, F.round(F.least(v, F.lit(100.0)), 4)).alias("watch_percentage"),
        (view & (v >= 150)).alias("liked"),
        F.lit(False).alias("shared"),
        F.lit(False).alias("favorited"),
        (view & v.between(100, 110)).alias("commented"),
        F.lit(False).alias("creator_followed"),
        "ts_us",
        F.col("event_id").alias("id"),
        v.between(45, 50).alias("is_training_context_only"),
        (v > 300).alias("content_pending"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved evidence rows only."""
    return raw_interactions(spark, sf_dir).where(~F.col("content_pending"))


def video_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(spark, sf_dir).where(F.col("content_type") != "LIVE")


def live_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event read as LIVE activity: one stream per category, so sessions have several events."""
    e = table(spark, sf_dir, "events")
    c = contents(spark, sf_dir).select("content_id", "creator_id", "category")
    t, v = F.col("e_type"), F.col("value")
    e = e.select(
        "event_id", "user_id", F.col("event_type").alias("e_type"), "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.get_json_object("props", "$.k").alias("content_id"),
    )
    return e.join(c, "content_id").select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("stream-"), "category").alias("content_id"), "creator_id", "category",
        F.when(t == "view", F.when(v >= 60, "LIVE_LIKED").otherwise("LIVE_WATCHED"))
        .when(t == "click", "LIVE_JOINED").when(t == "signup", "LIVE_LEFT")
        .when(t == "purchase", F.when(v >= 100, "LIVE_GIFT_SENT").otherwise("LIVE_IMPRESSION"))
        .otherwise(F.when(v >= 100, "LIVE_NOT_INTERESTED").otherwise("LIVE_IMPRESSION")).alias("event_type"),
        F.when((t == "view") | ((t == "signup") & (v < 20)), v).alias("watch_time_seconds"),
        F.lit(False).alias("liked"), F.lit(False).alias("shared"), ((t == "purchase") & v.between(50, 60)).alias("commented"),
        ((t == "click") & (v >= 150)).alias("creator_followed"), "ts_us", F.col("event_id").alias("id"),
    )


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: region (names over eight characters become NULL) and age bucket."""
    from ..functions import scalars

    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    age = (F.lit(10) + (F.col("c_custkey") * 7) % 65).cast("int")
    return (
        c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").cast("string").alias("user_id"),
            scalars.safe_region("r_name").alias("region"),
            age.alias("age"),
            scalars.age_bucket(age).alias("age_bucket"),
        )
    )


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score/label frame over all line items: group = order, ties on purpose (11 distinct scores)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("group_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.round(F.col("l_discount") * 10, 6).alias("p"),
        F.round(F.col("l_tax") * 10, 6).alias("p_alt"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ts_us"),
        F.col("l_partkey").cast("string").alias("content_id"),
        F.col("l_suppkey").cast("string").alias("creator_id"),
        F.col("l_linestatus").alias("category"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
    )
