"""Helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signalloom.session import cut_lineage

#: Separators of words: space and the control characters tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: Stands for a null id inside keys; restored to null in results.
NO_ID = -(1 << 63)


#: Write a frame to the shared checkpoint folder, so that later steps read it and none repeats its work.
cut = cut_lineage


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session; operators size their groups by it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
