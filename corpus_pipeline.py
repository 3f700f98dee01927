"""A training corpus from ``documents``: quality, exact dedup, near dedup, mixing, tokens.

``run`` writes each stage's rows as Parquet in the shared folder of ``spark.checkpoint.dir`` and reads them back as the
next stage's documents, so a lost executor costs at most the stage at work. Stage folders stay there: the last stage is
read after ``run`` returns.

All stages take rows as they are: null texts count as empty, null ids come last, texts of any length are read whole, other
columns pass through whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from signalloom.llm import bpe, exact, jaccard, mixing, quality
from signalloom.llm.common import documents
from signalloom.session import shared_folder

#: Score from which a document stays.
KEEP_FROM = 0.3
#: Rows that a task hands to Python at once. Texts may be long, so there are few; it changes memory only, never results.
BATCH_ROWS = 2_000
#: Near copies: five words an n-gram, similarity 0.8 or more.
NEAR = jaccard.Similarity(n=5, num=8, den=10)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, doesn't reject. Rows that repeat stay or go
    together."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))  # holds for the later stages too
    model = quality.train(docs, documents(spark, sf_dir, "labels"))
    return docs.where(model.score(docs["text"]) >= KEEP_FROM)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of equal texts; of rows that repeat id and text, and of a
    group of null ids, one row."""
    return exact.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of near copies; texts without words stay each."""
    return jaccard.one_of_each(docs, NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say, so that domains meet their target weights. Rows with a null id stay once."""
    labels = mixing.quality_domains(documents(spark, sf_dir, "labels"))
    return mixing.drawn(docs, mixing.mixed(docs, labels))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document; documents that the mix repeats have a row each."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.token_digests(docs, bpe.Vocabulary.of(spark, path, public_tokenizers.PATTERN))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: Fitted models and rates can't be stated in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    place = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{number}")
        docs = spark.read.parquet(f"{place}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
