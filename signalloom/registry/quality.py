"""Ingestion and text-dataset queries over all events, customers and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..operators import features, profiles, quality
from ..schemas import PROFILE_SNAPSHOT
from ..session import shared_folder
from ..sources import adapter, ingest, jsonl
from .base_sql import affinity, with_ctes
from .pointintime import HISTORY, TOKEN_STATE, _mean

AS_OF = adapter.SCORING_US


# --- behaviour messages ---------------------------------------------------------------------------

def messages(spark, d):
    """Every event as a JSON message, with faults by event type and value; strong clicks are sent twice."""
    e = adapter.table(spark, d, "events")
    t, v, k = F.col("event_type"), F.col("value"), F.get_json_object("props", "$.k")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    live = k.cast("int") % 5 == 4
    kind = (
        F.when((t == "signup") & (v < 5), "BOGUS")
        .when(live, F.when(t == "view", "LIVE_WATCHED").when(t == "click", "LIVE_JOINED").otherwise("LIVE_LIKED"))
        .otherwise(F.when(t == "view", "VIDEO_WATCHED").when(t == "click", "CONTENT_LIKED").when(t == "purchase", "CONTENT_SHARED").when(t == "signup", "LIVE_LEFT").otherwise("VIDEO_SKIPPED")))
    body = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("eventId"), F.col("user_id").cast("string").alias("userId"),
        F.when(v > 200, F.concat(F.lit("x"), k)).otherwise(k).alias("contentId"), F.lit("c1").alias("creatorId"), F.lit(" promo ").alias("category"), kind.alias("eventType"),
        F.when(t == "view", v).alias("watchTimeSeconds"), F.when(t == "view", F.lit(30.0)).alias("contentDurationSeconds"),
        F.when((t == "purchase") & (v < 5), stamp).otherwise(F.concat(stamp, F.lit("Z"))).alias("timestamp")))
    m = e.select(F.col("event_id").alias("offset"), F.when((t == "error") & (v < 10), F.concat(F.lit("{oops "), "event_id")).otherwise(body).alias("value"), t.alias("_t"), v.alias("_v"))
    again = m.where((F.col("_t") == "click") & (F.col("_v") > 100)).withColumn("offset", F.col("offset") + 100_000_000)
    return m.unionByName(again).select("offset", "value")


def _stored(spark, d):
    return ingest.store_events(ingest.parse_messages(messages(spark, d)), adapter.contents(spark, d), None, F.timestamp_micros(F.lit(AS_OF)))


def validate_event(spark, d):
    p = ingest.parse_messages(messages(spark, d)).withColumn("reject_reason", ingest.event_reject_reason(F.timestamp_micros(F.lit(AS_OF))))
    return ingest.validate_against_catalog(p, adapter.contents(spark, d)).groupBy("reject_reason", "content_pending").agg(F.count(F.lit(1)).alias("n"))


def store_events(spark, d):
    return _stored(spark, d)["accepted"].select("event_id", "user_id", "content_id", "category", "event_type", "watch_percentage", "liked", "shared", "content_pending")


def ingest_counts(spark, d):
    s = _stored(spark, d)
    return s["counts"].unionByName(s["duplicates"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate").alias("status"), "n"))


def touched_popularity(spark, d):
    """Popularity of the contents touched by the last batch, from the batch and all earlier rows."""
    acc = _stored(spark, d)["accepted"].where(~F.col("content_pending"))
    batch = acc.where(F.col("offset") >= acc.agg(F.max("offset")).scalar() * 0.98)
    return ingest.touched_popularity(batch, acc, adapter.contents(spark, d))


def ensure_users(spark, d):
    users = adapter.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("user_id")).where(F.col("c_acctbal") > 0)
    ids = adapter.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("user_id"))
    return ingest.missing_users(ids, users)


def validate_user_registered(spark, d):
    return _registrations(spark, d).select("offset", "user_id", F.col("age").cast("long").alias("age"), "region", F.array_join("interests", ",").alias("interests"), "reject_reason")


def registration_messages(spark, d):
    """Every customer as a JSON registration, with faults by key."""
    c = adapter.table(spark, d, "customer")
    k = F.col("c_custkey")
    born = F.date_format(F.date_add(F.to_date(F.lit("1940-01-01")), (k * 37 % 30000).cast("int")), "yyyy-MM-dd")
    body = F.to_json(F.struct(
        F.when(k % 11 == 0, "user.deleted").otherwise("user.registered").alias("type"), F.concat(F.lit("e"), k).alias("eventId"),
        F.struct(F.lit("user").alias("type"), F.when(k % 13 == 0, F.lit("other")).otherwise(k.cast("string")).alias("id")).alias("target"),
        F.struct(k.cast("string").alias("userId"), F.when(k % 5 == 0, F.lit("not a date")).otherwise(born).alias("birthday"), F.col("c_mktsegment").alias("region"),
                 F.array(F.lower("c_mktsegment"), F.when(k % 17 == 0, F.lit("  ")).otherwise(F.lit("#news"))).alias("interests"),
                 F.when(k % 7 == 0, F.lit("2024-02-01T00:00:00")).otherwise(F.lit("2024-02-01T00:00:00Z")).alias("occurredAt")).alias("data")))
    return c.select(k.alias("offset"), body.alias("value"))


def _registrations(spark, d):
    return ingest.parse_registrations(registration_messages(spark, d))


def upsert_onboarding(spark, d):
    """Stored contexts of all customers, overwritten by what the registrations bring."""
    stored = adapter.demographics(spark, d).select("user_id", F.col("age"), "region", F.array(F.lit("OLD")).alias("interests"))
    u = ingest.upsert_onboarding(stored, _registrations(spark, d))
    return u.select("user_id", F.col("age").cast("long").alias("age"), "region", F.array_join("interests", ",").alias("interests"))


def upsert_demographics(spark, d):
    """Orders as sightings: the newest non-NULL region and age bucket per customer win."""
    o = adapter.table(spark, d, "orders")
    seen = o.select(F.col("o_custkey").cast("string").alias("user_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("region"),
                    F.when(F.col("o_orderstatus") == "O", F.col("o_orderstatus")).alias("age_bucket"), F.col("o_orderkey").alias("at_us"))
    stored = adapter.demographics(spark, d).select("user_id", "region", "age_bucket")
    return ingest.upsert_demographics(stored, seen)


def resolve_pending(spark, d):
    """Raw interactions against a catalog in which some LIVE contents turned out to be VIDEO."""
    late = adapter.contents(spark, d).withColumn("content_type", F.when(F.col("popularity_score") < 0.3, "VIDEO").otherwise(F.col("content_type")))
    r = ingest.resolve_pending(adapter.raw_interactions(spark, d).drop("content_type"), late)
    return r.groupBy("content_id").agg(F.sum(F.col("content_pending").cast("long")).alias("pending"), F.count(F.lit(1)).alias("n"))


def update_content_status(spark, d):
    li = adapter.table(spark, d, "lineitem")
    ups = li.select(F.col("l_partkey").cast("string").alias("content_id"), (F.col("l_linestatus") == "O").alias("is_active"),
                    (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_suppkey") % 100).alias("at_us"))
    once = ups.groupBy("content_id", "at_us").agg(F.max("is_active").alias("is_active"))
    return ingest.update_content_status(adapter.contents(spark, d), once).select("content_id", "is_active")


def ingest_content(spark, d):
    """All parts as incoming contents of known suppliers' catalog: explicit, inferred and history categories."""
    c = adapter.contents(spark, d)
    incoming = adapter.table(spark, d, "part").select(
        F.col("p_partkey").alias("offset"), F.when(F.col("p_partkey") % 20 == 0, F.lit("0")).otherwise(F.concat(F.lit("n"), F.col("p_partkey"))).alias("content_id"),
        F.col("p_brand").alias("creator_id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("category"),
        F.when(F.col("p_partkey") % 5 == 4, "LIVE").otherwise("VIDEO").alias("content_type"), F.col("p_name").alias("title"), F.split("p_name", " ").alias("hashtags"),
        F.array("p_type").alias("topics"), F.array("p_brand").alias("entities"), F.array().cast("array<string>").alias("subgenres"))
    inferred = incoming.where(F.col("offset") % 2 == 0).select("content_id", F.lit("TECH").alias("category"), F.lit(0.8).alias("confidence"), F.lit("MODEL").alias("source"),
                                                              F.lit(quality.TAXONOMY_VERSION).alias("taxonomy_version")).dropDuplicates(["content_id"])
    history = profiles.live_category_from_history(profiles.creator_category_counts(c))
    return ingest.ingest_content(incoming, c, inferred, history).select(
        "offset", "content_id", "category", "category_source", "taxonomy_version", "popularity_score", "title", F.array_join("hashtags", ",").alias("hashtags"), "reject_reason")


def parse_candidates(spark, d):
    """One candidate list per order; some bodies lack the list, some items are bad."""
    li = adapter.table(spark, d, "lineitem")
    item = F.struct(F.col("l_partkey").cast("string").alias("contentId"), F.when(F.col("l_suppkey") % 10 == 0, "").otherwise(F.col("l_suppkey").cast("string")).alias("creatorId"),
                    F.col("l_linestatus").alias("category"), (F.col("l_discount") * 10.5).alias("contentPopularityScore"), F.col("l_quantity").alias("contentAgeHours"))
    body = li.groupBy(F.col("l_orderkey").alias("request")).agg(F.to_json(F.struct(F.collect_list(item).alias("candidates"))).alias("value"))
    body = body.withColumn("value", F.when(F.col("request") % 50 == 0, F.lit('{"other": 1}')).otherwise(F.col("value")))
    p = ingest.parse_candidates(body)
    return p.groupBy("request").agg(F.max("list_missing").alias("list_missing"), F.count("contentId").alias("kept"))


# --- labelled text records ------------------------------------------------------------------------

def _records(spark, d):
    doc, lab = adapter.table(spark, d, "documents"), adapter.table(spark, d, "labels")
    k, q = F.col("doc_id"), F.col("quality")
    return doc.join(lab, "doc_id", "left").select(
        F.concat(F.lit("ex-"), F.when(F.col("toxic") == 1, k - k % 10).otherwise(k)).alias("exampleId"), F.lit(None).cast("string").alias("contentId"),
        F.lit(None).cast("string").alias("creatorId"), F.lit("VIDEO").alias("contentType"), F.col("text").alias("title"), F.array(F.concat(F.lit("#"), "source"), F.col("lang")).alias("hashtags"),
        F.when(k % 6 == 0, F.lit("english!")).otherwise(F.col("lang")).alias("language"), F.lit(None).cast("string").alias("contentCreatedAt"),
        F.when(q == 1, "TECH").when(q == 0, "NEWS").alias("primaryCategory"), F.lit(None).cast("string").alias("subcategory"), F.array("source").alias("topics"),
        F.when(q.isNotNull() & (k % 7 != 0), quality.TAXONOMY_VERSION).alias("taxonomyVersion"),
        F.element_at(F.array(*[F.lit(s) for s in quality.LABEL_SOURCES]), (k % 4 + 1).cast("int")).alias("labelSource"), F.when(k % 8 == 3, 0.7).alias("labelConfidence"),
        F.when(k % 3 == 0, "REVIEWED").otherwise("UNREVIEWED").alias("reviewStatus"), F.when(k % 9 != 0, "r1").alias("reviewerId"), F.when(k % 3 == 0, "2024-01-01").alias("reviewedAt"),
        F.lit(None).cast("string").alias("notes"), F.lit(None).cast("string").alias("datasetSplit"), F.lit(None).cast("map<string,string>").alias("sourceMetadata"), k.alias("doc_id"))


def validate_dataset_record(spark, d):
    r = _records(spark, d)
    return r.select("doc_id", F.array_join(quality.record_errors(), ",").alias("errors"))


def language_tag(spark, d):
    r = _records(spark, d)
    return r.select("doc_id", text.language_tag(F.col("language")).alias("tag"), text.language_error(F.col("language")).alias("error"))


def dataset_text_norm(spark, d):
    t = adapter.table(spark, d, "documents")
    n = text.normalize_text(F.col("text"))
    return t.select("doc_id", F.length(n).cast("long").alias("n"), F.sha2(n, 256).alias("digest"))


def content_fingerprint(spark, d):
    return quality.with_fingerprint(_records(spark, d)).select("doc_id", "fingerprint")


def duplicate_and_conflict_check(spark, d):
    return quality.dataset_issues(quality.with_fingerprint(_records(spark, d)))


def duplicate_members(spark, d):
    return quality.dataset_issue_members(quality.with_fingerprint(_records(spark, d)))


def dataset_manifest(spark, d):
    return quality.manifest(quality.with_fingerprint(_records(spark, d)))


def dataset_eligibility(spark, d):
    return _records(spark, d).select("doc_id", F.coalesce(quality.training_eligible(), F.lit(False)).alias("training"), quality.gold_eligible().alias("gold"))


def training_frame_from_sources(spark, d):
    boot = adapter.table(spark, d, "benchmark").select(F.col("text"), F.lit("NEWS").alias("category"))
    return quality.frame_provenance(quality.training_frame(_records(spark, d), boot))


def read_jsonl_with_errors(spark, d):
    """Every document as a JSON line, some cut short or with an unknown key: counts per error."""
    r = _records(spark, d)
    line = F.to_json(F.struct(*[c for c in r.columns if c != "doc_id"]))
    k = F.col("doc_id")
    lines = r.withColumn("_l", line).select(
        F.when(k % 15 == 0, F.concat(F.lit("{"), "_l")).when(k % 15 == 1, F.concat(F.lit('{"bogus": 1, '), F.expr("substring(_l, 2)")))
        .otherwise(F.col("_l")).alias("value"))
    good, bad = jsonl.load_records(jsonl.parse_lines(lines, "value"))
    return bad.groupBy("message").agg(F.count(F.lit(1)).alias("n")).unionByName(good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("OK").alias("message"), "n"))


def jsonl_round_trip(spark, d):
    """Every faultless record written as JSON lines and read back, with the fingerprint of what was read."""
    path = f"{shared_folder(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    records = _records(spark, d)
    jsonl.write_jsonl(records.where(F.size(quality.record_errors()) == 0), path)
    good, _ = jsonl.load_records(jsonl.read_jsonl(spark, path))
    return good.select(F.col("exampleId").alias("exampleId"), "fingerprint")


# --- nested profile snapshots ---------------------------------------------------------------------

def profile_snapshots(spark, d):
    """Nested snapshots of all users built from their category, creator and token state."""
    state = features.final_state(adapter.interactions(spark, d), adapter.contents(spark, d))
    ten = lambda c: F.floor(F.col(c) / 10).cast("long")
    lng = F.lit(0).cast("long")
    watch = F.array().cast("array<struct<timestamp:timestamp,watch_percentage:double,completed:boolean,liked:boolean,shared:boolean,not_interested:boolean>>")
    cat = state["category"].groupBy("user_id").agg(F.collect_list(F.struct(
        "category", ten("w10").alias("interaction_count"), ten("pos10").alias("positive_count"), ten("neg10").alias("negative_count"), lng.alias("completed_count"),
        lng.alias("watch_count"), F.lit(0.0).alias("watch_percentage_sum"), (F.col("raw10") / 10).alias("raw_affinity_score"), (F.col("recent10") / 10).alias("recent_raw_affinity_score"),
        F.timestamp_micros("last_us").alias("last_interaction_at"), lng.alias("explicit_negative_count"), F.lit(None).cast("timestamp").alias("last_explicit_negative_at"),
        watch.alias("recent_watch_events"))).alias("categories"), F.sum(ten("w10")).alias("total_interaction_count"))
    cre = state["creator"].groupBy("user_id").agg(
        F.collect_list(F.struct("creator_id", ten("w10").alias("interaction_count"), ten("done10").alias("completed_count"))).alias("creators"),
        F.collect_list(F.when(F.col("followed") == 1, F.col("creator_id"))).alias("followed_creator_ids"))
    tok = state["token"].groupBy("user_id").agg(F.collect_list(F.struct(
        "field", "token", ten("w10").alias("interaction_count"), ten("pos10").alias("positive_count"), ten("neg10").alias("negative_count"),
        (F.col("raw10") / 10).alias("raw_affinity_score"), F.col("rejections").alias("explicit_negative_count"))).alias("semantic_affinities"))
    seen = adapter.interactions(spark, d).groupBy("user_id").agg(F.collect_set("content_id").alias("seen_content_ids"))
    p = cat.join(cre, "user_id").join(tok, "user_id").join(seen, "user_id").withColumn("version", F.lit(1))
    return p.select(*[f.name for f in PROFILE_SNAPSHOT.fields])


def explode_profile_snapshot(spark, d):
    """Features of every touched pair from the nested snapshots."""
    rows = adapter.interactions(spark, d)
    pairs = rows.select("user_id", "content_id", "creator_id", "category").distinct()
    f = features.snapshot_features(profile_snapshots(spark, d), pairs, adapter.contents(spark, d), AS_OF)
    return f.select("user_id", "content_id", "category_affinity", "hashtag_affinity", "entity_affinity", "average_semantic_affinity",
                    F.col("already_seen").cast("long").alias("already_seen"), F.col("creator_followed").cast("long").alias("creator_followed"))


#: What each class of users (by id) breaks; class 0 breaks nothing.
SNAPSHOT_FAULTS = ["", "DUPLICATE_CATEGORY", "DUPLICATE_SEEN", "DUPLICATE_CREATOR", "DUPLICATE_TOKEN", "DUPLICATE_FOLLOWED", "CATEGORY_COUNT", "CATEGORY_LABELS", "CATEGORY_EXPLICIT",
                   "CREATOR_COUNT", "TOKEN_COUNT"]


def validate_profile_snapshot(spark, d):
    """All users' snapshots, each class of users with a fault of its own, one for every rule."""
    p = profile_snapshots(spark, d)
    p = p.withColumn("semantic_affinities", F.transform("semantic_affinities", lambda t: t.withField("explicit_negative_count", F.lit(0).cast("long"))))
    fault = lambda name: F.col("user_id").cast("long") % len(SNAPSHOT_FAULTS) == SNAPSHOT_FAULTS.index(name)
    twice = lambda c: F.concat(c, F.slice(c, 1, 1))
    one = F.lit(1).cast("long")

    def first(column: str, **fields):
        """The column with the named fields of its first entry set."""
        def change(x):
            for name, value in fields.items():
                x = x.withField(name, value(x) if callable(value) else value)
            return x

        return F.transform(column, lambda x, i: F.when(i == 0, change(x)).otherwise(x))

    five = F.lit(5).cast("long")
    cats = F.when(fault("DUPLICATE_CATEGORY"), twice("categories")).when(fault("CATEGORY_COUNT"), first("categories", watch_count=lambda x: x["interaction_count"] + one))
    cats = cats.when(fault("CATEGORY_LABELS"), first("categories", interaction_count=five, positive_count=five, negative_count=one))
    cats = cats.when(fault("CATEGORY_EXPLICIT"), first("categories", explicit_negative_count=lambda x: x["negative_count"] + one))
    creators = F.when(fault("DUPLICATE_CREATOR"), twice("creators")).when(fault("CREATOR_COUNT"), first("creators", completed_count=lambda x: x["interaction_count"] + one))
    said = F.when(fault("DUPLICATE_TOKEN"), twice("semantic_affinities")).when(fault("TOKEN_COUNT"), first("semantic_affinities", explicit_negative_count=lambda x: x["negative_count"] + one))
    broken = p.withColumns({
        "categories": cats.otherwise(F.col("categories")), "creators": creators.otherwise(F.col("creators")), "semantic_affinities": said.otherwise(F.col("semantic_affinities")),
        "seen_content_ids": F.when(fault("DUPLICATE_SEEN"), twice("seen_content_ids")).otherwise(F.col("seen_content_ids")),
        "followed_creator_ids": F.when(fault("DUPLICATE_FOLLOWED"), F.concat("followed_creator_ids", F.array(F.lit("again"), F.lit("again")))).otherwise(F.array_distinct("followed_creator_ids"))})
    return features.snapshot_violations(broken)


QUERIES = {
    "validate_event": validate_event, "store_events": store_events, "ingest_counts": ingest_counts, "touched_popularity": touched_popularity, "ensure_users": ensure_users,
    "validate_user_registered": validate_user_registered, "upsert_onboarding": upsert_onboarding, "upsert_demographics": upsert_demographics,
    "resolve_pending": resolve_pending, "update_content_status": update_content_status, "ingest_content": ingest_content, "parse_candidates": parse_candidates,
    "validate_dataset_record": validate_dataset_record, "language_tag": language_tag, "dataset_text_norm": dataset_text_norm, "content_fingerprint": content_fingerprint,
    "duplicate_and_conflict_check": duplicate_and_conflict_check, "duplicate_members": duplicate_members, "dataset_manifest": dataset_manifest,
    "dataset_eligibility": dataset_eligibility, "training_frame_from_sources": training_frame_from_sources, "read_jsonl_with_errors": read_jsonl_with_errors, "jsonl_round_trip": jsonl_round_trip,
    "explode_profile_snapshot": explode_profile_snapshot, "validate_profile_snapshot": validate_profile_snapshot,
}

_MSG = """
msg0 AS (SELECT event_id, user_id, value AS v, event_type AS t, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id AS off FROM events
  UNION ALL SELECT event_id, user_id, value, event_type, CAST(json_extract_string(props, '$.k') AS INT), event_id + 100000000 FROM events WHERE event_type = 'click' AND value > 100),
msg AS (SELECT *, CASE WHEN v > 200 THEN 'x' || k ELSE CAST(k AS VARCHAR) END AS content_id,
    CASE WHEN t = 'signup' AND v < 5 THEN 'BOGUS' WHEN k % 5 = 4 THEN CASE t WHEN 'view' THEN 'LIVE_WATCHED' WHEN 'click' THEN 'LIVE_JOINED' ELSE 'LIVE_LIKED' END
      ELSE CASE t WHEN 'view' THEN 'VIDEO_WATCHED' WHEN 'click' THEN 'CONTENT_LIKED' WHEN 'purchase' THEN 'CONTENT_SHARED' WHEN 'signup' THEN 'LIVE_LEFT' ELSE 'VIDEO_SKIPPED' END END AS et FROM msg0),
judged AS (SELECT m.*, CASE WHEN t = 'error' AND v < 10 THEN TRUE ELSE c.content_id IS NULL END AS content_pending,
    CASE WHEN t = 'error' AND v < 10 THEN 'MALFORMED' WHEN et = 'BOGUS' THEN 'UNKNOWN_EVENT_TYPE' WHEN t = 'purchase' AND v < 5 THEN 'TIMEZONE_MISSING'
      WHEN t = 'view' AND et = 'VIDEO_WATCHED' AND v > 90 THEN 'WATCH_EXCEEDS_DURATION' WHEN NOT c.is_active THEN 'CONTENT_INACTIVE'
      WHEN (et LIKE 'LIVE%') <> (c.content_type = 'LIVE') THEN 'CONTENT_TYPE_MISMATCH' END AS reject_reason FROM msg m LEFT JOIN contents c ON c.content_id = m.content_id),
acc AS (SELECT * FROM judged WHERE reject_reason IS NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY off) = 1)"""
_REG = """
reg AS (SELECT c_custkey AS off, CAST(c_custkey AS VARCHAR) AS user_id, DATE '1940-01-01' + CAST(c_custkey * 37 % 30000 AS INT) AS born, upper(c_mktsegment) AS seg, c_custkey AS k FROM customer),
regs AS (SELECT off, user_id, CASE WHEN k % 5 <> 0 AND born <= DATE '2024-02-01' THEN date_sub('year', born, DATE '2024-02-01') END AS age, CASE WHEN length(seg) <= 8 THEN seg END AS region,
    CASE WHEN k % 17 = 0 THEN seg || ',' ELSE seg || ',NEWS' END AS interests,
    CASE WHEN k % 11 = 0 THEN 'WRONG_TYPE' WHEN k % 13 = 0 THEN 'TARGET_MISMATCH' WHEN k % 7 = 0 THEN 'TIMEZONE_MISSING' WHEN k % 17 = 0 THEN 'BAD_INTERESTS' END AS reject_reason FROM reg)"""
_REC = """
rec AS (SELECT d.doc_id, 'ex-' || CASE WHEN toxic = 1 THEN doc_id - doc_id % 10 ELSE doc_id END AS eid, text, source, lang, CASE WHEN doc_id % 6 = 0 THEN 'english!' ELSE lang END AS language,
    CASE quality WHEN 1 THEN 'TECH' WHEN 0 THEN 'NEWS' END AS cat, CASE WHEN quality IS NOT NULL AND doc_id % 7 <> 0 THEN 'v1-bootstrap' END AS tax,
    ['HUMAN_REVIEWED', 'SYNTHETIC', 'PSEUDO_LABELED', 'WEAK_SUPERVISION'][doc_id % 4 + 1] AS src, doc_id % 8 = 3 AS conf, doc_id % 3 = 0 AS reviewed,
    regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^ | $', '', 'g') AS flat
  FROM documents d LEFT JOIN labels USING (doc_id)),
fp AS (SELECT *, 'sha256:' || sha256('title:' || replace(lower(strip_accents(flat)), 'ß', 'ss') || '|hashtags:' || array_to_string(list_sort(['#' || source, lang]), ',')) AS f FROM rec)"""
_ERR = """array_to_string(list_filter([CASE WHEN length(text) > 200 THEN 'TITLE_TOO_LONG' END, CASE WHEN language = 'english!' THEN 'BAD_LANGUAGE' END,
  CASE WHEN cat IS NOT NULL AND tax IS NULL THEN 'TAXONOMY_MISSING' END, CASE WHEN reviewed AND doc_id % 9 = 0 THEN 'REVIEW_EVIDENCE_MISSING' END,
  CASE WHEN src = 'HUMAN_REVIEWED' AND reviewed AND cat IS NULL THEN 'REVIEWED_WITHOUT_CATEGORY' END], lambda x: x IS NOT NULL), ',')"""
ORACLE = {
    "validate_event": with_ctes("SELECT reject_reason, content_pending, count(*) AS n FROM judged GROUP BY 1, 2", "CONTENTS", extra=_MSG),
    "store_events": with_ctes("""SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, content_id, 'PROMO' AS category, et AS event_type,
        CASE WHEN t = 'view' THEN round(v / 30 * 100, 4) END AS watch_percentage, et = 'CONTENT_LIKED' AS liked, et = 'CONTENT_SHARED' AS shared, content_pending FROM acc""", "CONTENTS", extra=_MSG),
    "ingest_counts": with_ctes("""
        SELECT CASE WHEN reject_reason = 'MALFORMED' THEN 'malformed' WHEN reject_reason IN ('CONTENT_INACTIVE', 'CONTENT_TYPE_MISMATCH') THEN 'rejected'
          WHEN reject_reason IS NOT NULL THEN 'invalid' ELSE 'valid' END AS status, count(*) AS n FROM judged GROUP BY 1
        UNION ALL SELECT 'duplicate', (SELECT count(*) FROM judged WHERE reject_reason IS NULL) - (SELECT count(*) FROM acc)""", "CONTENTS", extra=_MSG),
    "touched_popularity": with_ctes(f"""
        SELECT content_id, {affinity("sum(3 * (et = 'CONTENT_LIKED')::INT + 5 * (et = 'CONTENT_SHARED')::INT + 4 * (t = 'view' AND coalesce(round(v / 30 * 100, 4), 0) >= 90)::INT - 4 * (et = 'VIDEO_SKIPPED')::INT)")} AS popularity
        FROM acc JOIN contents c USING (content_id) WHERE c.content_type = 'VIDEO' AND content_id IN
          (SELECT content_id FROM acc WHERE NOT content_pending AND off >= (SELECT max(off) FROM acc WHERE NOT content_pending) * 0.98) GROUP BY 1""", "CONTENTS", extra=_MSG),
    "duplicate_members": "WITH " + _REC + """
        SELECT f AS fingerprint, eid AS "exampleId", CASE WHEN k > 1 THEN 'CONFLICTING_LABELS' ELSE 'DUPLICATE_CONTENT' END AS kind FROM fp JOIN
          (SELECT f, count(DISTINCT (coalesce(cat, ''), coalesce(tax, ''))) AS k FROM fp GROUP BY 1 HAVING count(*) > 1) USING (f)""",
    "explode_profile_snapshot": with_ctes(f"""
        SELECT p.user_id, p.content_id, {affinity("c_raw / 10.0")} AS category_affinity, {_mean("t.field = 'hashtag'")} AS hashtag_affinity,
          {_mean("t.field = 'entity'")} AS entity_affinity, {_mean()} AS average_semantic_affinity, CAST(1 AS BIGINT) AS already_seen,
          CAST(any_value(k_follow > 0)::INT AS BIGINT) AS creator_followed
        FROM (SELECT DISTINCT user_id, content_id, creator_id, category FROM weighted) p JOIN content_tokens t USING (content_id)
          JOIN (SELECT user_id, category, sum(cd) AS c_raw FROM delta GROUP BY 1, 2) USING (user_id, category)
          JOIN (SELECT user_id, creator_id, sum(sig_followed::INT) AS k_follow FROM weighted GROUP BY 1, 2) k ON k.user_id = p.user_id AND k.creator_id = p.creator_id
          LEFT JOIN (SELECT user_id, field, token, {affinity("sum(td) / 10.0")} AS aff FROM tok GROUP BY 1, 2, 3) tk ON tk.user_id = p.user_id AND tk.field = t.field AND tk.token = t.token
        GROUP BY p.user_id, p.content_id, c_raw""", "WEIGHTED", "TOKENS", extra=TOKEN_STATE + "," + HISTORY),
    "ensure_users": """SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS user_id, 'ACTIVE' AS status FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
    "validate_user_registered": "WITH " + _REG + " SELECT off AS offset, user_id, age, region, CASE WHEN interests = '' THEN NULL ELSE interests END AS interests, reject_reason FROM regs",
    "upsert_onboarding": with_ctes("""SELECT user_id, CAST(coalesce(r.age, d.age) AS BIGINT) AS age, coalesce(r.region, d.region) AS region, coalesce(r.interests, 'OLD') AS interests
        FROM demographics d LEFT JOIN (SELECT * FROM regs WHERE reject_reason IS NULL) r USING (user_id)""", "DEMOGRAPHICS", extra=_REG),
    "upsert_demographics": with_ctes("""
        SELECT coalesce(d.user_id, s.user_id) AS user_id, coalesce(s.region, d.region) AS region, coalesce(s.age_bucket, d.age_bucket) AS age_bucket FROM demographics d FULL JOIN
          (SELECT CAST(o_custkey AS VARCHAR) AS user_id, arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS region,
             max('O') FILTER (WHERE o_orderstatus = 'O') AS age_bucket FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1) s ON s.user_id = d.user_id""", "DEMOGRAPHICS"),
    "resolve_pending": with_ctes("""
        SELECT r.content_id, count(*) FILTER (WHERE content_pending AND NOT ((event_type LIKE 'LIVE%') = (CASE WHEN c.popularity_score < 0.3 THEN 'VIDEO' ELSE c.content_type END = 'LIVE'))) AS pending, count(*) AS n
        FROM raw_interactions r JOIN contents c ON c.content_id = r.content_id GROUP BY 1""", "RAW"),
    "update_content_status": with_ctes("""
        SELECT c.content_id, coalesce(a, c.is_active) AS is_active FROM contents c LEFT JOIN (SELECT CAST(l_partkey AS VARCHAR) AS content_id, arg_max(act, at_us) AS a FROM
          (SELECT l_partkey, l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS at_us, bool_or(l_linestatus = 'O') AS act FROM lineitem GROUP BY 1, 2) GROUP BY 1) USING (content_id)""", "CONTENTS"),
    "ingest_content": with_ctes("""
        SELECT p_partkey AS "offset", CASE WHEN p_partkey % 20 = 0 THEN '0' ELSE 'n' || p_partkey END AS content_id,
          CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) WHEN p_partkey % 5 = 4 THEN h.category WHEN p_partkey % 2 = 0 THEN 'TECH' ELSE 'UNKNOWN' END AS category,
          CASE WHEN p_partkey % 3 = 0 THEN 'EXPLICIT' WHEN p_partkey % 5 = 4 THEN 'CREATOR_HISTORY' WHEN p_partkey % 2 = 0 THEN 'MODEL' ELSE 'UNKNOWN' END AS category_source,
          CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 <> 4 AND p_partkey % 2 = 0 THEN 'v1-bootstrap' END AS taxonomy_version, 0.5::DOUBLE AS popularity_score, p_name AS title,
          array_to_string(list_distinct_ordered, ',') AS hashtags, CASE WHEN p_partkey % 20 = 0 THEN 'DUPLICATE_CONTENT' END AS reject_reason
        FROM (SELECT *, CASE WHEN split_part(upper(p_name), ' ', 1) = split_part(upper(p_name), ' ', 2) THEN [split_part(upper(p_name), ' ', 1)] ELSE string_split(upper(p_name), ' ') END AS list_distinct_ordered FROM part) p
          JOIN h ON h.creator_id = p.p_brand""", "CONTENTS", extra="""
        newest AS (SELECT *, row_number() OVER (PARTITION BY creator_id ORDER BY created_us DESC, content_id) AS pos FROM contents WHERE content_type = 'VIDEO'),
        counts AS (SELECT creator_id, category, count(*) AS n, min(pos) AS fp FROM newest WHERE pos <= 50 GROUP BY 1, 2),
        h AS (SELECT creator_id, CASE WHEN sum(n) < 3 THEN 'UNKNOWN' ELSE arg_max(category, n * 1000 - fp) END AS category FROM counts GROUP BY 1)"""),
    "parse_candidates": """SELECT l_orderkey AS request, l_orderkey % 50 = 0 AS list_missing,
        CASE WHEN l_orderkey % 50 = 0 THEN 0 ELSE count(*) FILTER (WHERE l_suppkey % 10 <> 0 AND l_discount * 10.5 <= 1) END AS kept FROM lineitem GROUP BY 1
        HAVING l_orderkey % 50 = 0 OR count(*) FILTER (WHERE l_suppkey % 10 <> 0 AND l_discount * 10.5 <= 1) > 0""",
    "validate_dataset_record": "WITH " + _REC + f" SELECT doc_id, {_ERR} AS errors FROM rec",
    "language_tag": "WITH " + _REC + " SELECT doc_id, CASE WHEN language <> 'english!' THEN language END AS tag, CASE WHEN language = 'english!' THEN 'BAD_LANGUAGE' END AS error FROM rec",
    "dataset_text_norm": "WITH " + _REC + " SELECT doc_id, length(nfc_normalize(flat)) AS n, sha256(nfc_normalize(flat)) AS digest FROM rec",
    "content_fingerprint": "WITH " + _REC + " SELECT doc_id, f AS fingerprint FROM fp",
    "duplicate_and_conflict_check": "WITH " + _REC + """
        SELECT 'ERROR' AS severity, 'DUPLICATE_EXAMPLE_ID' AS kind, eid AS key, count(*) AS n FROM fp GROUP BY eid HAVING count(*) > 1 UNION ALL
        SELECT CASE WHEN count(DISTINCT (coalesce(cat, ''), coalesce(tax, ''))) > 1 THEN 'ERROR' ELSE 'WARNING' END,
          CASE WHEN count(DISTINCT (coalesce(cat, ''), coalesce(tax, ''))) > 1 THEN 'CONFLICTING_LABELS' ELSE 'DUPLICATE_CONTENT' END, f, count(*) FROM fp GROUP BY f HAVING count(*) > 1""",
    "dataset_manifest": "WITH " + _REC + """
        SELECT 'source' AS section, src AS key, count(*) AS n FROM fp GROUP BY 2 UNION ALL
        SELECT 'language', CASE WHEN language <> 'english!' THEN language ELSE 'unspecified' END, count(*) FROM fp GROUP BY 2 UNION ALL
        SELECT 'review', CASE WHEN reviewed THEN 'REVIEWED' ELSE 'UNREVIEWED' END, count(*) FROM fp GROUP BY 2 UNION ALL
        SELECT 'duplicates', 'fingerprints', count(*) FROM (SELECT f FROM fp GROUP BY 1 HAVING count(*) > 1) UNION ALL
        SELECT 'taxonomy', 'v1-bootstrap', count(*) FROM fp""",
    "dataset_eligibility": "WITH " + _REC + """ SELECT doc_id, CASE src WHEN 'HUMAN_REVIEWED' THEN reviewed WHEN 'WEAK_SUPERVISION' THEN conf ELSE TRUE END AS training,
        src = 'HUMAN_REVIEWED' AND reviewed AS gold FROM rec""",
    "training_frame_from_sources": "WITH " + _REC + """ SELECT src AS origin, count(*) AS rows, count(DISTINCT cat) AS categories FROM rec
        WHERE tax IS NOT NULL AND CASE src WHEN 'HUMAN_REVIEWED' THEN reviewed WHEN 'WEAK_SUPERVISION' THEN conf ELSE TRUE END GROUP BY 1
        UNION ALL SELECT 'BOOTSTRAP', count(*), 1 FROM benchmark""",
    "read_jsonl_with_errors": "WITH " + _REC + f""" SELECT CASE doc_id % 15 WHEN 0 THEN 'BAD_JSON' WHEN 1 THEN 'UNKNOWN_FIELD' ELSE CASE WHEN {_ERR} = '' THEN 'OK' ELSE {_ERR} END END AS message, count(*) AS n
        FROM rec GROUP BY 1""",
    "validate_profile_snapshot": with_ctes(f"""SELECT DISTINCT user_id, {SNAPSHOT_FAULTS!r}[1 + CAST(user_id AS INT) % {len(SNAPSHOT_FAULTS)}] AS violation
        FROM interactions WHERE CAST(user_id AS INT) % {len(SNAPSHOT_FAULTS)} > 0""", "INTERACTIONS"),
    "jsonl_round_trip": "WITH " + _REC + f""" SELECT eid AS "exampleId", f AS fingerprint FROM fp WHERE {_ERR} = ''""",
}
