"""Labelled text datasets: record rules, duplicates and conflicts, manifest, eligibility, training frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars, text, tokens

# Enumerations of a record.
LABEL_SOURCES = ["HUMAN_REVIEWED", "SYNTHETIC", "PSEUDO_LABELED", "WEAK_SUPERVISION"]
REVIEW_STATES = ["UNREVIEWED", "REVIEWED", "NEEDS_REVIEW", "DISPUTED"]
TAXONOMY_VERSION = "v1-bootstrap"


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _tag_error(c: str) -> Column:
    """Raw tag lists are bounded before any token normalization."""
    return (
        F.when(F.size(c) > tokens.MAX_TOKENS, "TOO_MANY_TAGS").when(F.exists(c, lambda t: tokens.strip(t) == ""), "BLANK_TAG")
        .when(F.exists(c, lambda t: F.length(tokens.strip(t)) > tokens.MAX_TOKEN_LENGTH), "TAG_TOO_LONG"))


def record_errors() -> Column:
    """All broken rules of a record as an array."""
    status = F.coalesce("reviewStatus", F.lit("UNREVIEWED"))
    labelled = ~(_blank("primaryCategory") & _blank("subcategory"))
    rules = [
        F.when(~F.coalesce(F.length("exampleId").between(1, 128), F.lit(False)), "BAD_EXAMPLE_ID"),
        F.when(~F.coalesce(F.col("labelSource").isin(LABEL_SOURCES), F.lit(False)), "BAD_LABEL_SOURCE"),
        F.when(~status.isin(REVIEW_STATES), "BAD_REVIEW_STATUS"), F.when(~F.col("labelConfidence").between(0, 1), "BAD_CONFIDENCE"),
        F.when(F.length("title") > tokens.MAX_TITLE_LENGTH, "TITLE_TOO_LONG"), text.language_error(F.col("language")),
        F.when(_blank("title") & (F.coalesce(F.size("hashtags"), F.lit(0)) <= 0), "NO_TEXT_SIGNAL"),
        F.when(labelled & _blank("taxonomyVersion"), "TAXONOMY_MISSING"),
        F.when((status == "REVIEWED") & (_blank("reviewerId") | _blank("reviewedAt")), "REVIEW_EVIDENCE_MISSING"),
        F.when((F.col("labelSource") == "HUMAN_REVIEWED") & (status == "REVIEWED") & _blank("primaryCategory"), "REVIEWED_WITHOUT_CATEGORY"),
        _tag_error("hashtags"), _tag_error("topics"),
    ]
    return F.filter(F.array(*rules), lambda e: e.isNotNull())


def with_fingerprint(records: DataFrame) -> DataFrame:
    return records.withColumn("_tags", text.fold_tags("hashtags")).withColumn("fingerprint", text.fingerprint(F.col("title"), F.col("_tags"))).drop("_tags")


def dataset_issues(records: DataFrame) -> DataFrame:
    """(severity, kind, key, n): repeated example ids; repeated fingerprints with equal or conflicting labels.

    A fingerprint's records are counted, never gathered; ``dataset_issue_members`` lists them row by row.
    """
    ids = records.groupBy(F.col("exampleId").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("ERROR").alias("severity"), F.lit("DUPLICATE_EXAMPLE_ID").alias("kind"), "key", "n")
    label = F.struct(F.coalesce("primaryCategory", F.lit("\u0000")), F.coalesce("subcategory", F.lit("\u0000")), F.coalesce("taxonomyVersion", F.lit("\u0000")))
    fp = records.groupBy(F.col("fingerprint").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("_k")).where("n > 1")
    conflict = F.col("_k") > 1
    return ids.unionByName(fp.select(
        F.when(conflict, "ERROR").otherwise("WARNING").alias("severity"), F.when(conflict, "CONFLICTING_LABELS").otherwise("DUPLICATE_CONTENT").alias("kind"), "key", "n"))


def dataset_issue_members(records: DataFrame) -> DataFrame:
    """(fingerprint, exampleId, kind) of every record that shares its fingerprint."""
    shared = dataset_issues(records).where(F.col("kind") != "DUPLICATE_EXAMPLE_ID").select(F.col("key").alias("fingerprint"), "kind")
    return records.join(shared, "fingerprint").select("fingerprint", "exampleId", "kind")


def training_eligible() -> Column:
    source = F.col("labelSource")
    return (
        F.when(source == "HUMAN_REVIEWED", F.col("reviewStatus") == "REVIEWED").when(source.isin("SYNTHETIC", "PSEUDO_LABELED"), True)
        .when(source == "WEAK_SUPERVISION", F.col("labelConfidence").isNotNull()).otherwise(False))


def gold_eligible() -> Column:
    return F.coalesce((F.col("labelSource") == "HUMAN_REVIEWED") & (F.col("reviewStatus") == "REVIEWED"), F.lit(False))


def manifest(records: DataFrame) -> DataFrame:
    """(section, key, n): composition by source, language and review status, totals, repeated fingerprints, taxonomy."""
    def by(section: str, c: Column) -> DataFrame:
        return records.groupBy(c.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "key", "n")

    repeated = records.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("c")).agg(F.sum((F.col("c") > 1).cast("long")).alias("n")).select(
        F.lit("duplicates").alias("section"), F.lit("fingerprints").alias("key"), "n")
    versions = F.countDistinct("taxonomyVersion")
    tax = records.agg(F.when(versions == 0, None).when(versions == 1, F.max("taxonomyVersion")).otherwise("MIXED").alias("key"), F.count(F.lit(1)).alias("n")).select(
        F.lit("taxonomy").alias("section"), "key", "n")
    parts = [by("source", F.col("labelSource")), by("language", F.coalesce(text.language_tag(F.col("language")), F.lit("unspecified"))),
             by("review", F.coalesce("reviewStatus", F.lit("UNREVIEWED"))), repeated, tax]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_text() -> Column:
    """Title tokens followed by normalized hashtags."""
    return F.concat_ws(" ", F.array_join(tokens.title_tokens(F.col("title")), " "), F.array_join(tokens.normalize_tokens(F.col("hashtags")), " "))


def training_frame(records: DataFrame, bootstrap: DataFrame | None, categories: list[str] | None = None) -> DataFrame:
    """Eligible, taxonomy-compatible records plus bootstrap rows: (text, category, origin)."""
    known = categories or scalars.KNOWN_CATEGORIES
    cat = F.upper(F.trim("primaryCategory"))
    fits = training_eligible() & (F.col("taxonomyVersion") == TAXONOMY_VERSION) & cat.isin(known)
    real = records.where(F.coalesce(fits, F.lit(False))).select(feature_text().alias("text"), cat.alias("category"), F.col("labelSource").alias("origin"))
    return real if bootstrap is None else real.unionByName(bootstrap.select("text", "category", F.lit("BOOTSTRAP").alias("origin")))


def frame_provenance(frame: DataFrame) -> DataFrame:
    return frame.groupBy("origin").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("category").alias("categories"))
