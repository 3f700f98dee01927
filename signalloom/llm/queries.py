"""Registered queries of the training-data operators, and their oracle SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from signalloom.llm import bpe, chat, divergence, exact, jaccard, mixing, mixlm, quality, runs, secretscan, sharding, substring, topk
from signalloom.llm.common import SPACES, documents, text_of


def vocabulary(spark: SparkSession) -> bpe.Vocabulary:
    return bpe.Vocabulary.of(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(documents(spark, sf_dir), vocabulary(spark))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.without_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir), mixing.quality_domains(documents(spark, sf_dir, "labels")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.scored(docs, quality.train(docs, documents(spark, sf_dir, "labels")))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir), jaccard.Similarity(n=3, num=9, den=10))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(documents(spark, sf_dir))
    return found.select("doc_id", "nth", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").alias("n_chars"), "score", "is_secret")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir))


def op8_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir), shards=8)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    columns = ["conv_id", "turn", "role", "text"]
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(documents(spark, sf_dir, "conversations").select(*columns).unionByName(more))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    rows = rows.select("vec_id", topk.integer_vector(F.col("embedding")).alias("embedding"))
    return topk.top_k(rows, F.col("vec_id") % 20 == 0, k=20)


def op11_context_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    found = mixlm.scored(docs, mixlm.train(docs.where(part != 2), part == 3))
    return found.select("doc_id", (part == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(documents(spark, sf_dir), least=10, ranks=10)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in every tenth document (by checksum of its id) the words from one on repeat with a period."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    chosen = F.col("doc_id").isNotNull() & (h % 10 == 0)
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(chosen, F.filter(F.split(text_of("text"), SPACES), lambda w: w != "")).alias("words"))
    n = F.size("words")
    placed = split.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    planted = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", source(i))), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_planted_runs(documents(spark, sf_dir)))

    def better(best, run):
        one, two = run["length"] * best["period"], best["length"] * run["period"]
        return F.when(best.isNull() | (one > two), run).otherwise(best)  # ties: the earlier one, as runs are in order

    best = F.reduce("runs", F.get("runs", F.lit(0)), better)
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {f.__name__: f for f in (
    op1_byte_bpe, op2_substring_dedup, op3_soft_membership_mixing, op4_quality_classifier, op5_ngram_jaccard, op6_secret_scan, op7_exact_dedup, op8_virtual_slot_sharding, op9_chat_formatting, op10_exact_top_k,
    op11_context_mixing_lm, op12_source_divergence, op13_periodic_runs)}

ORACLE = {
    "op7_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY t)""",
    "op9_chat_formatting": r"""
        WITH rows AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length('<turn:></turn>' || chr(10)) + length(role) + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g')))::BIGINT AS formatted_chars
        FROM rows GROUP BY conv_id""",
    "op10_exact_top_k": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 20""",
    "op12_source_divergence": r"""
        WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r FROM documents),
        w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
        of_lang AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        g AS (
            SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(total), 0) AS lang_total, coalesce(sum(n), 0)::HUGEINT AS total
            FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN of_lang USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) AS p,
                   1 + (1000000000::HUGEINT * (k.n + 2)) // (g.lang_total + 2 * g.v) AS q
            FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
        pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(s.value), 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (SELECT x.lang, x.source AS sx, y.source AS sy, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
                       FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND sx = a.source AND sy = b.source
            GROUP BY ALL),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
