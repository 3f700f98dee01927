"""Which 64-bit keys occur more than once, and a bounded filter for them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from signalloom.llm.common import cut

#: Bits of a filter whose keys were not counted (4 MB), and the most bits of one sized by its keys (32 MB).
FILTER_BITS, MOST_BITS = 25, 28


def recurring(keys: DataFrame, key: str = "key", n: str | None = None) -> DataFrame:
    """``key`` and ``n`` of keys counted at least twice; partial counts come before the shuffle."""
    count = F.sum(n) if n else F.count(F.lit(1))
    return keys.groupBy(key).agg(count.alias("n")).where("n > 1")


def bits_for(keys: int, most: int = MOST_BITS) -> int:
    """Size of a filter (a power of two) with some ten bits a key, at most 2 ** ``most``."""
    return min(max(16, (10 * keys).bit_length()), most)


def key_filter(keys: DataFrame, key: str = "key", bits: int = FILTER_BITS):
    """A broadcast Bloom filter of ``keys`` with two probes. Its size is fixed: with more keys it lets more others pass,
    which later exact steps drop, and it never holds one of ``keys`` back."""
    mask = (1 << bits) - 1
    probes = F.array(F.col(key).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(key, 64 - bits))
    words = keys.select(F.explode(probes).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    table = words.toArrow()  # at most 2 ** (bits - 6) rows
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(out)


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Mask of ``keys`` (uint64) that the filter lets pass."""
    width = int(len(bits)).bit_length() - 1 + 6
    yes = np.ones(len(keys), bool)
    for at in (keys & np.uint64((1 << width) - 1), keys >> np.uint64(64 - width)):
        yes &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    return yes


def passes(filter_, key: Column) -> Column:
    """Whether the broadcast filter lets a long column's value pass."""

    def one(values: pa.Array) -> pa.Array:
        return pa.array(may_hold(filter_.value, values.to_numpy(zero_copy_only=False).view(np.uint64)))

    return F.arrow_udf(one, "boolean")(key)

def without_rows(docs: DataFrame, gone: DataFrame, again: DataFrame, id_col: str, digest_: Column) -> DataFrame:
    """``docs`` without rows that ``gone`` (_id, _t) names by id and digest, and one row of those that ``again`` names."""
    # Null ids are ids too: a group keeps a plain join from missing them, so no row is marked twice.
    marked = gone.withColumn("_gone", F.lit(True)).unionByName(again.withColumn("_gone", F.lit(False)))
    marked = cut(marked.groupBy("_id", "_t").agg(F.max("_gone").alias("_gone")))
    held = key_filter(marked.select(F.xxhash64("_id", "_t").alias("key")), bits=bits_for(marked.count(), MOST_BITS))
    may = passes(held, F.xxhash64(F.col(id_col).cast("long"), digest_))
    doubtful = docs.where(may)
    names = doubtful.select(*[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_i"), digest_.alias("_d")])
    met = names.join(marked, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_d") == F.col("_t")), "left")
    once = met.where("_gone is null").select("_row").unionByName(met.where(~F.col("_gone")).groupBy("_i", "_d").agg(F.first("_row").alias("_row")).select("_row"))
    return docs.where(~may).unionByName(once.select("_row.*"))
