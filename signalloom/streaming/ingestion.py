"""Structured Streaming ingestion. A micro-batch writes folders of its own epoch, so a replayed batch replaces all of itself.

Layout under ``root``, each by epoch: ``interactions`` (by day), ``rejected``, ``counts``; ``ids``, ``users`` and
``pending`` (by hash bucket of event, user and content); ``sums`` (by bucket of content: what the batch adds to each
content's engagement), ``popularity``, ``resolved``; ``contexts`` (by bucket of user: new versions of changed users).

No batch reads the stored interactions: it looks its events up in their own buckets of ``ids``, its users in theirs of
``users``, and adds its own sums to earlier ones of the contents it touched. ``fold_sums`` folds old epochs into one.

The stream's checkpoint advances only after a batch is written: at-least-once delivery with idempotent writes.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars, signals
from ..sources import ingest

#: Hash buckets of the keyed tables.
BUCKETS = 256


def kafka_source(spark: SparkSession, servers: str, topic: str, *, max_offsets: int = 1_000_000) -> DataFrame:
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option(
        "maxOffsetsPerTrigger", max_offsets).load()
    # The partition goes into the offset, so it orders messages of all partitions.
    return raw.select((F.col("partition").cast("long") * (1 << 48) + F.col("offset")).alias("offset"), F.col("value").cast("string").alias("value"))


def json_source(spark: SparkSession, path: str) -> DataFrame:
    """Files of {offset, value} rows, for tests and backfills."""
    return spark.readStream.schema("offset long, value string").json(path)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where nothing was written yet. Any other failure (a clash of schemas, a store that
    can't be reached) is raised: it must not look like an empty store."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _write(df: DataFrame, path: str, epoch: int, *by: str) -> None:
    """Rows of one epoch, in a folder of its own that is replaced as a whole."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/epoch={epoch}")


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _keyed(df: DataFrame, path: str, epoch: int, key: str) -> None:
    """Rows of one epoch by bucket; a bucket's rows go through one task, so that it is one file."""
    _write(df.withColumn("bucket", _bucket(key)).repartition("bucket"), path, epoch, "bucket")


def _matching(spark: SparkSession, path: str, keys: DataFrame, key: str, before: int | None = None) -> DataFrame | None:
    """Stored rows in the buckets that ``keys`` fall into (at most ``BUCKETS`` numbers), of epochs other than ``before``."""
    table = _read(spark, path)
    if table is None:
        return None
    own = [r[0] for r in keys.select(_bucket(key)).distinct().collect()]
    rows = table.where(F.col("bucket").isin(own))
    return (rows if before is None else rows.where(F.col("epoch") < before)).drop("bucket")


def behaviour_batch(root: str, contents: DataFrame, now: Column | None = None):
    """foreachBatch function: validate, dedupe, store; malformed, invalid, rejected and duplicate rows are only counted."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        parsed = ingest.parse_messages(batch)
        # Event ids are unique over the whole store, whatever timestamp a resend carries.
        known = _matching(spark, f"{root}/ids", parsed.where("event_id is not null"), "event_id", epoch)
        out = ingest.store_events(parsed, contents, known, F.current_timestamp() if now is None else now)
        accepted = out["accepted"].withColumns({"day": F.to_date("timestamp"), "ts_us": F.unix_micros("timestamp"), "id": F.col("offset")}).persist()
        _write(accepted, f"{root}/interactions", epoch, "day")
        _write(out["rejected"].select("event_id", "reject_reason"), f"{root}/rejected", epoch)
        _write(out["counts"].unionByName(out["duplicates"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate").alias("status"), "n")), f"{root}/counts", epoch)
        users = _matching(spark, f"{root}/users", accepted, "user_id", epoch)
        users = spark.createDataFrame([], "user_id string") if users is None else users
        _keyed(ingest.missing_users(accepted, users), f"{root}/users", epoch, "user_id")
        _keyed(accepted.where("content_pending").select("event_id", "content_id", "event_type", "content_pending"), f"{root}/pending", epoch, "content_id")
        counted = accepted.where(~F.col("is_training_context_only"))
        _keyed(counted.groupBy("content_id").agg(F.sum(signals.profile_delta()).alias("raw")), f"{root}/sums", epoch, "content_id")
        touched = accepted.where(~F.col("content_pending")).select("content_id").distinct()
        video = touched.join(contents.where(F.col("content_type") == "VIDEO").select("content_id"), "content_id", "left_semi")
        _write(popularity_of(spark, root, video, epoch), f"{root}/popularity", epoch)
        # Written last: while a batch's ids are missing, it counts as not stored and is replayed whole.
        _keyed(accepted.select("event_id"), f"{root}/ids", epoch, "event_id")
        accepted.unpersist()
        batch.unpersist()

    return run


def _sums(spark: SparkSession, root: str, upto: int, wanted: DataFrame | None = None) -> DataFrame | None:
    """Sums per content of all epochs up to one: the newest folded ones, and the epochs since. With ``wanted``, of its
    buckets only."""
    def rows(path: str) -> DataFrame | None:
        return _read(spark, path) if wanted is None else _matching(spark, path, wanted, "content_id")

    since, folded = -1, rows(f"{root}/sums_folded")
    if folded is not None:
        newest = _read(spark, f"{root}/sums_folded").where(F.col("upto") <= upto).agg(F.max("upto")).first()[0]
        since = since if newest is None else newest
        folded = folded.where(F.col("upto") == since).select("content_id", "raw")
    fresh = rows(f"{root}/sums")
    fresh = None if fresh is None else fresh.where((F.col("epoch") > since) & (F.col("epoch") <= upto)).select("content_id", "raw")
    return fresh if folded is None else folded if fresh is None else folded.unionByName(fresh)


def fold_sums(spark: SparkSession, root: str, upto: int) -> None:
    """Fold the sums of all epochs up to a finished one into one version, so that batches read fewer files."""
    sums = _sums(spark, root, upto)
    if sums is not None:
        folded = sums.groupBy("content_id").agg(F.sum("raw").alias("raw")).withColumn("bucket", _bucket("content_id"))
        folded.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/sums_folded/upto={upto}")


def popularity_of(spark: SparkSession, root: str, wanted: DataFrame, upto: int) -> DataFrame:
    """Popularity of the wanted contents from the running sums of all epochs up to one."""
    sums = _sums(spark, root, upto, wanted)
    return sums.join(wanted, "content_id", "left_semi").groupBy("content_id").agg(scalars.affinity(F.sum("raw")).alias("popularity"))


def content_batch(root: str):
    """foreachBatch function on newly ingested contents: pending interactions of matching LIVE-ness become resolved. Only
    pending rows in the buckets of these contents are read."""

    def run(batch: DataFrame, epoch: int) -> None:
        waiting = _matching(batch.sparkSession, f"{root}/pending", batch, "content_id")
        if waiting is None:
            return
        waiting = waiting.drop("epoch").join(batch.select("content_id").distinct(), "content_id", "left_semi")
        done = ingest.resolve_pending(waiting, batch).where(~F.col("content_pending"))
        _write(done.select("event_id"), f"{root}/resolved", epoch)

    return run


def resolved_stream(pending: DataFrame, contents: DataFrame, *, wait: str = "7 days", delay: str = "10 minutes") -> DataFrame:
    """Pending events of one stream with the content of another that resolves them: same id, matching LIVE-ness, at most
    ``wait`` apart in event time (either first). Both sides have ``timestamp`` and may come ``delay`` late, so the state of
    either side is bounded."""
    e = pending.where("content_pending").withWatermark("timestamp", delay).select("event_id", "user_id", F.col("content_id").alias("_wanted"), "event_type", F.col("timestamp").alias("_at"))
    c = contents.withWatermark("timestamp", delay).select("content_id", "content_type", F.col("timestamp").alias("_made"))
    fits = F.col("event_type").startswith("LIVE_") == (F.col("content_type") == "LIVE")
    near = F.expr(f"_at >= _made - interval {wait} AND _at <= _made + interval {wait}")
    return e.join(c, (F.col("_wanted") == F.col("content_id")) & fits & near).select("event_id", "user_id", "content_id", "content_type")


def read_interactions(spark: SparkSession, root: str) -> DataFrame:
    """Stored rows with the pending flags that later contents cleared."""
    rows = spark.read.parquet(f"{root}/interactions").drop("epoch")
    resolved = _read(spark, f"{root}/resolved")
    if resolved is None:
        return rows
    hit = resolved.select("event_id").distinct().withColumn("_r", F.lit(True))
    return rows.join(hit, "event_id", "left").withColumn("content_pending", F.col("content_pending") & F.col("_r").isNull()).drop("_r")


def latest_popularity(spark: SparkSession, root: str) -> DataFrame:
    p = spark.read.parquet(f"{root}/popularity")
    return p.groupBy("content_id").agg(F.max_by("popularity", "epoch").alias("popularity"))


def registration_batch(root: str):
    """foreachBatch function: new versions of the onboarding contexts of the users that a batch changes."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        parsed = ingest.parse_registrations(batch)
        users = parsed.where("reject_reason is null").select("user_id").distinct()
        stored = _matching(spark, f"{root}/contexts", users, "user_id", epoch)
        before = None if stored is None else _newest(stored).join(users, "user_id", "left_semi")
        _keyed(ingest.upsert_onboarding(before, parsed), f"{root}/contexts", epoch, "user_id")
        _write(parsed.where("reject_reason is not null").select("user_id", "reject_reason"), f"{root}/rejected_users", epoch)

    return run


def _newest(rows: DataFrame) -> DataFrame:
    newest = Window.partitionBy("user_id").orderBy(F.desc("epoch"))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "epoch")


def latest_contexts(spark: SparkSession, root: str) -> DataFrame | None:
    all_ = _read(spark, f"{root}/contexts")
    return None if all_ is None else _newest(all_.drop("bucket"))


def start(stream: DataFrame, batch, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
