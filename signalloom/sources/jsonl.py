"""JSON-lines datasets: one record per line, bad lines collected next to the good rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators import quality
from ..schemas import DATASET_RECORD


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = DATASET_RECORD) -> DataFrame:
    """Rows with ``_line`` (raw text) and ``_corrupt`` (set where the line is no such record); blank lines skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return parse_lines(lines, "value", schema)


def parse_lines(lines: DataFrame, value: str, schema: T.StructType = DATASET_RECORD) -> DataFrame:
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType(), True)])
    parsed = F.from_json(value, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # Unknown keys are an error, as is a line that is no JSON object.
    keys = F.json_object_keys(value)
    extra = F.size(F.array_except(keys, F.array(*[F.lit(n) for n in schema.fieldNames()]))) > 0
    return lines.withColumn("_p", parsed).select(
        *[c for c in lines.columns if c != value], F.col(value).alias("_line"), "_p.*", F.coalesce(extra, F.lit(False)).alias("_extra"))


def load_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good records with fingerprints, errors as (_line, message))."""
    judged = rows.withColumn("_errors", quality.record_errors())
    problem = F.when(F.col("_corrupt").isNotNull(), "BAD_JSON").when(F.col("_extra"), "UNKNOWN_FIELD").when(F.size("_errors") > 0, F.array_join("_errors", ","))
    judged = judged.withColumn("_problem", problem)
    good = quality.with_fingerprint(judged.where("_problem is null").drop("_errors", "_problem", "_extra", "_corrupt", "_line"))
    return good, judged.where("_problem is not null").select("_line", F.col("_problem").alias("message"))


def write_jsonl(records: DataFrame, path: str) -> None:
    """Records under their wire names, NULL fields left out."""
    names = [n for n in DATASET_RECORD.fieldNames() if n in records.columns]
    records.select(*names).write.mode("overwrite").json(path)
