"""Exact deduplication with counting quotient filters.

Each map task builds counting quotient filters of the 64-bit fingerprints of its rows, one for each block of fingerprints
that share their first bits; they are lossless. Filters of all tasks merge block by block, by sorted remainders. Fingerprints that count above one go back to the tasks as a filter
sized by their number, so only texts that it lets pass are routed on, and their bytes decide: groups are formed by the
normalised text itself.

A hot text costs one remainder per map task in the filters, one row per map task in the grouping (partial
aggregation), and its rows carry only ids and digests in the last join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from signalloom.llm.common import SPACES, cut, partitions, text_of
from signalloom.llm.recurring import bits_for, key_filter, passes, without_rows


class CountingQuotientFilter:
    """A quotient filter of distinct whole numbers below 2 ** ``width``, with counts; it loses nothing.

    The leading bits of a number (its quotient) name a slot, the rest (the remainder) is stored near it: numbers of one
    quotient form a run of rising remainders, which begins at their slot or, where that is taken, right after the run
    before. Three bits a slot tell whether its quotient occurs, whether a run ends there, and whether it holds digits of
    the counter of the remainder before; a number that occurs once needs no counter. Runs are in order, so two filters
    merge by sorted remainders.
    """

    def __init__(self, width: int, numbers: np.ndarray, counts: np.ndarray):
        """``numbers`` rise."""
        self.width, self.n = width, len(numbers)
        self.slots_log = min(width, max(1, (2 * self.n).bit_length()))
        self.rest = width - self.slots_log
        #: Bits of a slot; a counter takes as many slots as its digits need.
        self.slot_bits = max(8, self.rest)
        quotient = (numbers >> np.uint64(self.rest)).astype(np.int64)
        digits = np.zeros(self.n, np.int64)
        left = counts.astype(np.uint64) - np.uint64(1)
        while left.any():
            digits += left > 0
            left = left >> np.uint64(self.slot_bits) if self.slot_bits < 64 else np.zeros_like(left)
        before = np.cumsum(1 + digits) - (1 + digits)
        at = before + np.maximum.accumulate(quotient - before) if self.n else before  # a run gives way to the one before
        size = max(1 << self.slots_log, int(at[-1] + 1 + digits[-1]) if self.n else 0)
        self.occupied, self.run_end, self.counter = (np.zeros(size, bool) for _ in range(3))
        self.slots = np.zeros(size, np.uint64)
        self.used = np.zeros(size, bool)
        self.occupied[quotient] = True
        last = np.r_[quotient[1:] != quotient[:-1], True] if self.n else np.zeros(0, bool)
        self.run_end[(at + digits)[last]] = True
        self.slots[at] = numbers & np.uint64((1 << self.rest) - 1)
        self.used[at] = True
        left, digit = counts.astype(np.uint64) - np.uint64(1), 1
        while (some := digits >= digit).any():
            place = (at + digit)[some]
            self.slots[place] = left[some] & np.uint64((1 << self.slot_bits) - 1)
            self.counter[place] = self.used[place] = True
            left = left >> np.uint64(self.slot_bits) if self.slot_bits < 64 else np.zeros_like(left)
            digit += 1

    @classmethod
    def of(cls, width: int, numbers: np.ndarray) -> CountingQuotientFilter:
        return cls(width, *np.unique(numbers, return_counts=True))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in order, and their counts."""
        place = np.flatnonzero(self.used)
        counter, end = self.counter[place], self.run_end[place]
        run = np.cumsum(end) - end
        first = np.flatnonzero(~counter)
        quotient = np.flatnonzero(self.occupied)[run[first]].astype(np.uint64)
        numbers = (quotient << np.uint64(self.rest)) | self.slots[place[first]]
        counts, digit = np.ones(len(first), np.uint64), 1
        many = np.diff(np.r_[first, len(place)]) - 1
        while (some := many >= digit).any():
            counts[some] += self.slots[place[first[some] + digit]] << np.uint64(self.slot_bits * (digit - 1))
            digit += 1
        return numbers, counts.astype(np.int64)

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Sum of two filters; nothing is lost, so any order of merges gives the same filter."""
        (a, m), (b, n) = self.items(), other.items()
        both, counts = np.concatenate([a, b]), np.concatenate([m, n])
        order = np.argsort(both, kind="stable")  # two sorted runs: merged in linear time
        both, counts = both[order], counts[order]
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
        return CountingQuotientFilter(self.width, both[first], np.add.reduceat(counts, first) if len(first) else counts)

    def to_bytes(self) -> bytes:
        """Metadata as bits, slots in as many bytes as they need."""
        wide = -(-self.slot_bits // 8)
        head = np.array([self.width, self.n, len(self.slots)], "<i8").tobytes()
        bits = [np.packbits(x).tobytes() for x in (self.occupied, self.run_end, self.counter, self.used)]
        return head + b"".join(bits) + np.ascontiguousarray(self.slots[self.used].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        width, n, size = np.frombuffer(raw[:24], "<i8").tolist()
        out = cls.__new__(cls)
        out.width, out.n, out.slots_log = width, n, min(width, max(1, (2 * n).bit_length()))
        out.rest = width - out.slots_log
        out.slot_bits, step = max(8, out.rest), -(-size // 8)
        bits = [np.unpackbits(np.frombuffer(raw[24 + i * step : 24 + (i + 1) * step], np.uint8), count=size).astype(bool) for i in range(4)]
        out.occupied, out.run_end, out.counter, out.used = bits
        wide = -(-out.slot_bits // 8)
        packed = np.frombuffer(raw[24 + 4 * step :], np.uint8).reshape(-1, wide)
        slots = np.zeros((len(packed), 8), np.uint8)
        slots[:, :wide] = packed
        out.slots = np.zeros(size, np.uint64)
        out.slots[out.used] = slots.view("<u8").ravel()
        return out


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def repeated_fingerprints(fingerprints: DataFrame, bits: int) -> DataFrame:
    """``fp`` (long) and ``n``: fingerprints that occur more than once, by merged filters of all partitions.

    The first ``bits`` bits name a block, which has a filter of its own in each task and is merged by one task.
    """
    width = 64 - bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        for batch in batches:
            waiting.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, waiting)) > 1 << 22:  # hand over full filters and begin others
                yield from emit(np.concatenate(waiting))
                waiting = []
        if waiting:
            yield from emit(np.concatenate(waiting))

    def emit(fingerprints: np.ndarray) -> Iterator[pa.RecordBatch]:
        block = (fingerprints >> np.uint64(width)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        names, begin = np.unique(block[order], return_index=True)
        parts = np.split(fingerprints[order] & np.uint64((1 << width) - 1), begin[1:])
        filters = [CountingQuotientFilter.of(width, p).to_bytes() for p in parts] if len(names) else []
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(filters, pa.binary())], names=["block", "filter"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        parts = [CountingQuotientFilter.from_bytes(f.as_py()) for f in table["filter"]]
        while len(parts) > 1:
            parts = [parts[i].merge(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        numbers, counts = parts[0].items()
        many = counts > 1
        return pa.table({"fp": (numbers[many] | np.uint64(key[0].as_py() << width)).view(np.int64), "n": counts[many]})

    filters = fingerprints.mapInArrow(build, "block long, filter binary")
    return filters.groupBy("block").applyInArrow(merge, "fp long, n long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after each run of spaces and controls tab to carriage return became one space;
    null counts as empty. The smallest id of a group stays; null ids come last, and a group of null ids alone has a
    null ``keep_id``. Rows that repeat both id and text are one record: they are marked alike. No rows in, no rows
    out; other columns are not read. ``bits`` name a block, 4 blocks a shuffle partition by default.
    """
    bits = bits or max(4, (4 * partitions(docs.sparkSession) - 1).bit_length())
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_of(text_col)).alias("t"))
    rows = rows.withColumn("fp", F.xxhash64("t"))
    again = cut(repeated_fingerprints(rows.select("fp"), bits).select("fp"))
    held = key_filter(again, "fp", bits_for(again.count()))
    groups = (
        rows.where(passes(held, F.col("fp"))).groupBy("fp", "t").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select(F.sha2("t", 256).alias("digest"), "keep", "n"))
    light = rows.select("id", F.sha2("t", 256).alias("digest"))
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return light.join(groups, "digest", "left").select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each text, that of the least id; of a text that only null ids hold, one row. All columns stay.

    Rows that may go are chosen by a filter, so no others are shuffled.
    """
    rows = cut(exact_duplicates(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("_id"), F.col("text_sha256").alias("_t"), "kept", "group_size").where("group_size > 1"))
    gone = rows.where(~F.col("kept")).select("_id", "_t").distinct()
    again = rows.where("kept").groupBy("_id", "_t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return without_rows(docs, gone, again, id_col, F.sha2(normalised(text_of(text_col)), 256))
