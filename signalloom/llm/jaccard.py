"""N-gram Jaccard join by vertical partitioning.

A document is the set of its word n-grams; n-grams have one global order, that of their 64-bit hashes. The order is cut
into fragments.

* Candidates: two sets of at most U n-grams each that reach the threshold differ in at most D n-grams. With more than D
  fragments, the two agree exactly in at least one. Sets are put into size classes so that similar sets meet in one, and
  each (class, fragment, content) becomes a key; only sets that share a key can be similar. A few spare fragments make
  sure that the shared one isn't empty; a set with more empty fragments than spare ones also gives keys for those.
* Counting: for a candidate pair, each fragment counts its own overlap, and the sums per pair decide.

Most keys occur once. Tasks send their keys shortened, sorted and packed as differences, some three bytes each; those that
occur again go into a filter sized by their number, and only keys that it lets pass travel as rows. Sets have 128-bit names.

Before counting, pairs are sifted by 256 parity bits a set: an n-gram flips one bit, so the bits in which two sets differ
are at most the n-grams in which they do. The sieve sits in the join itself and never drops a similar pair. What passes it
is sifted again by parity bits in proportion to the sets (some four to eight an n-gram), because 256 say little about large
sets; only pairs that pass both have their n-grams shuffled. Rows of keys that meet in the second round carry some of these
(one or two an n-gram), so large sets that share a passage aren't listed for each of its keys.

Equal sets are one node. Inside a key, all sets are compared first with the one that shares the largest part of its keys;
only sets that are then still in other components than most meet the rest, so large groups of near copies don't form all
pairs. Every pair of sets that share a key is either compared or already connected, so components are those of all links.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from signalloom.llm.common import cut, text_of
from signalloom.llm.components import components
from signalloom.llm.recurring import MOST_BITS, bits_for, key_filter, may_hold, without_rows
from signalloom.llm.wordhash import blocks, mixed, ngrams, raw_bytes, words_of

#: Fragments of the order in which overlaps are counted.
FRAGMENTS = 8
#: Columns of a set's parity bits, 64 in each.
PARITY = ["p0", "p1", "p2", "p3"]
#: Parity bits of the second sieve: at least and at most so many a set.
LEAST_WIDE, MOST_WIDE = 1 << 8, 1 << 17
#: Bits of a shortened key behind those of its bucket, and keys a task holds before it sends them.
SHORT, HELD = 32, 1 << 20


@dataclass(frozen=True)
class Similarity:
    """``n`` words an n-gram; sets link when overlap / union >= num / den."""

    n: int = 5
    num: int = 8
    den: int = 10

    @lru_cache  # noqa: B019  (small, frozen)
    def sizes(self) -> np.ndarray:
        """Largest set of each size class."""
        out = [1]
        while out[-1] < 1 << 40:
            out.append(max(out[-1] + 1, out[-1] * self.den // self.num))
        return np.array(out)

    @lru_cache  # noqa: B019
    def fragments(self, size_class: int) -> tuple[int, int]:
        """Number of fragments of a class, and how many of them are spare."""
        sizes = self.sizes()
        most = int((self.den - self.num) * 2 * int(sizes[size_class]) // (self.den + self.num))
        if not most:
            return 0, 0  # only equal sets, which are one node already
        spare = 1 + int(3 * (most + 1) * math.exp(-int(sizes[max(0, size_class - 2)]) / (most + 1)))
        return most + 1 + spare, spare


def sets_of(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text, A-Z in lower case; a text of fewer words is one n-gram."""
    data, offsets = raw_bytes(column)
    for a, b in blocks(offsets):
        words = words_of(data, offsets[a : b + 1], lower=True)
        grams, at = ngrams(words, n)
        cuts = np.searchsorted(at, words.first)
        few = {k: ngrams(words, k) for k in range(1, n)} if (words.counts < n).any() else {}
        for i in range(b - a):
            k = int(words.counts[i])
            if 0 < k < n:
                g, where = few[k]
                yield g[np.searchsorted(where, words.first[i])][None]
            else:
                yield np.unique(grams[cuts[i] : cuts[i + 1]])


def digest(grams: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    halves = [mixed(grams ^ np.uint64(salt)).sum(dtype=np.uint64) + np.uint64(len(grams)) for salt in (0x5851F42D4C957F2D, 0xA0761D6478BD642F)]
    return mixed(np.array(halves)).tobytes()


def parity(grams: np.ndarray) -> list[int]:
    """256 bits; each n-gram flips the one that its lowest bits name."""
    odd = np.bincount((grams & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def wide_parity(grams: np.ndarray) -> np.ndarray:
    """A power of two of bits, four or more an n-gram; each n-gram flips the one that its lowest bits name."""
    bits = min(max(LEAST_WIDE, 1 << (4 * len(grams) - 1).bit_length()), MOST_WIDE)
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def narrow_parity(wide: np.ndarray, n: int) -> np.ndarray | None:
    """``wide`` folded to one or two bits an n-gram; None where that's no more than ``parity`` has."""
    bits = 1 << (n - 1).bit_length()
    while len(wide) * 64 > max(LEAST_WIDE, bits):
        wide = wide[: len(wide) // 2] ^ wide[len(wide) // 2 :]
    return wide if len(wide) * 64 > LEAST_WIDE else None


def keys_of(grams: np.ndarray, like: Similarity) -> np.ndarray:
    """Keys of a set in its own size class and the next."""
    own = int(np.searchsorted(like.sizes(), len(grams)))
    content = mixed(grams)
    out = []
    for c in (own, own + 1):
        parts, spare = like.fragments(c)
        if not parts:
            continue
        part = ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        name = mixed(part[first] + np.uint64(c << 32))
        out.append(mixed(np.add.reduceat(content, first) ^ name))
        if parts - len(first) > spare:
            rest = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[first])
            out.append(mixed(mixed(rest + np.uint64(c << 32)) + np.uint64(1)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col)).alias("t"), F.col(text_col).alias("text"))


def _per_batch(make, types: dict[str, pa.DataType], n: int):
    """A mapInArrow function over columns that end with the text: ``make(others, sets)`` gives rows for those of a batch."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1_000):
                part = batch.slice(a, 1_000)
                others = zip(*(part.column(i).to_pylist() for i in range(part.num_columns - 1)), strict=True)
                rows = make(others, sets_of(part.column(part.num_columns - 1), n))
                columns = zip(*rows, strict=True) if rows else [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))

    return over


def named_sets(docs: DataFrame, like: Similarity, id_col: str, text_col: str) -> DataFrame:
    """``id, t, node, n`` of every row: a digest of its text, the set's name and size."""
    run = _per_batch(lambda ids, sets: [(*i, digest(s), len(s)) for i, s in zip(ids, sets, strict=True)], {"id": pa.int64(), "t": pa.int64(), "node": pa.binary(), "n": pa.int64()}, like.n)
    return _text(docs, id_col, text_col).mapInArrow(run, "id long, t long, node binary, n long")


def _short(keys: np.ndarray, bucket_bits: int) -> np.ndarray:
    return keys >> np.uint64(64 - bucket_bits - SHORT)


def recurring_filter(docs: DataFrame, like: Similarity, bucket_bits: int):
    """A broadcast filter that lets every key pass that several rows of ``docs`` have; it is asked by ``_held``."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            for s in sets_of(batch.column(0), like.n):
                if len(s):
                    held.append(_short(keys_of(s, like), bucket_bits))
                    waiting += len(held[-1])
                if waiting > HELD:
                    yield from packed(np.concatenate(held))
                    held, waiting = [], 0
        if held:
            yield from packed(np.concatenate(held))

    def packed(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys.sort()
        bucket = keys >> np.uint64(SHORT)
        cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(keys)] if len(keys) else [0]
        rest = keys.astype(np.uint32)
        steps = rest.copy()
        steps[1:] -= rest[:-1]
        steps[cuts[:-1]] = rest[cuts[:-1]]
        for a in range(0, len(cuts) - 1, 1024):
            own = [steps[x:y] for x, y in zip(cuts[a:-1][:1024], cuts[a + 1 :][:1024], strict=True)]
            names = bucket[cuts[a:-1][:1024]].astype(np.int64)
            planes = [zlib.compress(np.ascontiguousarray(s.view(np.uint8).reshape(-1, 4).T).tobytes(), 1) for s in own]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(planes, pa.binary())], names=["bucket", "packed"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for bucket, packed_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and parts:
                    yield several(now, parts)
                    parts = []
                now = bucket
                steps = np.frombuffer(zlib.decompress(packed_), np.uint8).reshape(4, -1).T
                parts.append(np.cumsum(np.ascontiguousarray(steps).view(np.uint32).ravel(), dtype=np.uint32))
        if parts:
            yield several(now, parts)

    def several(bucket: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(parts))
        same = keys[1:] == keys[:-1]
        keys = np.unique(keys[1:][same]).astype(np.uint64) | np.uint64(bucket << SHORT)
        return pa.RecordBatch.from_arrays([pa.array(mixed(keys).view(np.int64))], names=["key"])

    sent = docs.select("text").mapInArrow(send, "bucket long, packed binary")
    keys = cut(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(again, "key long"))
    return key_filter(keys, bits=bits_for(keys.count(), MOST_BITS))


def keyed_sets(texts: DataFrame, like: Similarity, held, bucket_bits: int) -> DataFrame:
    """``id, node, n, p0..p3, narrow, wide, keys, part`` of rows with keys that ``held`` lets pass; ``part``: how many of 1,000 keys."""

    def rows(ids, sets: Iterator[np.ndarray]) -> list[tuple]:
        out = []
        for (i,), s in zip(ids, sets, strict=True):
            if len(s) and len(keys := keys_of(s, like)):
                good = keys[may_hold(held.value, mixed(_short(keys, bucket_bits)))]
                if len(good):
                    wide = wide_parity(s)
                    out.append((i, digest(s), len(s), *parity(s), narrow_parity(wide, len(s)), wide, good.view(np.int64), 1000 * len(good) // len(keys)))
        return out

    types = {"id": pa.int64(), "node": pa.binary(), "n": pa.int64(), **dict.fromkeys(PARITY, pa.int64()), "narrow": pa.list_(pa.int64()), "wide": pa.list_(pa.int64()), "keys": pa.list_(pa.int64()), "part": pa.int32()}
    run = _per_batch(rows, types, like.n)
    return texts.select("id", "text").mapInArrow(run, f"id long, node binary, n long, {', '.join(p + ' long' for p in PARITY)}, narrow array<long>, wide array<long>, keys array<long>, part int")


def fragment_overlaps(texts: DataFrame, pairs: DataFrame, nodes: DataFrame, like: Similarity) -> DataFrame:
    """Pairs (x, y; nx, ny) that link, as (a, b): overlaps are counted per fragment, then summed per pair.

    Texts of the pairs' sets are chosen by a filter of their ids, so only their n-grams are shuffled.
    """

    def rows(_, sets: Iterator[np.ndarray]) -> list[tuple]:
        out = []
        for s in sets:
            ends = np.searchsorted(s >> np.uint64(32), [(f << 32) // FRAGMENTS for f in range(FRAGMENTS + 1)])
            out.append((digest(s), [s[ends[f] : ends[f + 1]].view(np.int64) for f in range(FRAGMENTS)]))
        return out

    run = _per_batch(rows, {"node": pa.binary(), "fragments": pa.list_(pa.list_(pa.int64()))}, like.n)

    def fragments(side: str) -> DataFrame:
        wanted = cut(nodes.join(pairs.select(F.col(side).alias("node")).distinct(), "node").select(F.xxhash64("rep").alias("key")))
        held = key_filter(wanted, bits=bits_for(wanted.count(), MOST_BITS))

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # in the same worker as the sets: a second one a task takes memory
            for batch in batches:
                good = may_hold(held.value, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                yield from run(iter([batch.filter(pa.array(good))]))

        found = texts.select(F.xxhash64("id").alias("key"), "text").mapInArrow(chosen, "node binary, fragments array<array<long>>")
        # Rows that repeat an id may hold other sets, which no pair asks for, or the same set.
        return found.groupBy("node").agg(F.first("fragments").alias(f"{side}_fragments")).withColumnRenamed("node", side)

    met = pairs.join(fragments("x"), "x").join(fragments("y"), "y")
    overlaps = F.zip_with("x_fragments", "y_fragments", lambda a, b: F.size(F.array_intersect(a, b)).cast("long"))
    sums = met.select("x", "y", "nx", "ny", F.reduce(overlaps, F.lit(0).cast("long"), lambda total, n: total + n).alias("both"))
    linked = sums.where(F.col("both") * like.den >= (F.col("nx") + F.col("ny") - F.col("both")) * like.num)
    return linked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _alike(like: Similarity, one: str = "x", two: str = "y") -> Column:
    """Whether sizes and parity bits of two sides (their columns named x_ and y_) allow a link. Never false for a link."""
    n1, n2 = F.col(f"{one}_n"), F.col(f"{two}_n")
    flips = sum((F.bit_count(F.col(f"{one}_{p}").bitwiseXOR(F.col(f"{two}_{p}"))) for p in PARITY), F.lit(0))
    return (F.least(n1, n2) * like.den >= F.greatest(n1, n2) * like.num) & (flips * (like.den + like.num) <= (n1 + n2) * (like.den - like.num))


def _near(one: str, two: str, both: Column, like: Similarity) -> Column:
    """Whether parity bits in columns ``one`` and ``two`` allow sets of ``both`` n-grams to link. Never false for a link."""
    xor = lambda a, b: a.bitwiseXOR(b)

    def folded(one: str, two: str) -> Column:  # bits of the wider set, taken by one bit of their place less
        half = F.size(two)
        return F.when(F.size(one) > half, F.zip_with(F.slice(one, F.lit(1), half), F.slice(one, half + 1, half), xor)).otherwise(F.col(one))

    # Sets without such bits, or whose widths still differ, give a null, and stay.
    flips = F.aggregate(F.zip_with(folded(one, two), folded(two, one), xor), F.lit(0), lambda n, w: n + F.bit_count(w))
    return F.coalesce(flips * (like.den + like.num) <= both * (like.den - like.num), F.lit(True))


def _sifted(pairs: DataFrame, wides: DataFrame, like: Similarity) -> DataFrame:
    """Pairs (x, y, nx, ny) whose wide parity bits allow a link. Never without a link."""
    met = pairs.join(wides.select(F.col("node").alias("x"), F.col("wide").alias("wx")), "x").join(wides.select(F.col("node").alias("y"), F.col("wide").alias("wy")), "y")
    return met.where(_near("wx", "wy", F.col("nx") + F.col("ny"), like)).select("x", "y", "nx", "ny")


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c) if c == "key" else F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def linked_sets(texts: DataFrame, nodes: DataFrame, like: Similarity) -> DataFrame:
    """``node, root`` over the links of different sets. ``nodes``: node, n, rep (the id that stands for it)."""
    rows = texts.count()
    bucket_bits = min(max(10, (rows >> 10).bit_length() + 6), 24)  # buckets hold some 100,000 keys each
    held = recurring_filter(texts, like, bucket_bits)
    found = keyed_sets(texts, like, held, bucket_bits).join(nodes.select("node", "rep"), "node").where(F.col("id").eqNullSafe(F.col("rep")))
    found = cut(found.drop("id", "rep").dropDuplicates(["node"]))
    facts, wides = found.select("node", "n", *PARITY), found.select("node", "wide")
    # Rows of keys carry names only; sizes and parity bits join them where pairs are judged.
    members = found.select("node", "part", F.explode("keys").alias("key"))
    leaders = members.groupBy("key").agg(F.max(F.struct("part", "node"))["node"].alias("y"), F.count(F.lit(1)).alias("share")).where("share > 1").drop("share")
    meets = members.join(leaders, "key").where("node <> y").select(F.col("node").alias("x"), "y").distinct()
    sides = lambda m: m.join(_prefixed(facts, "x"), F.col("x") == F.col("x_node")).join(_prefixed(facts, "y"), F.col("y") == F.col("y_node"))
    pairs = lambda m: m.select("x", "y", F.col("x_n").alias("nx"), F.col("y_n").alias("ny"))
    stars = cut(pairs(sides(meets).where(_alike(like))))
    links = cut(fragment_overlaps(texts, cut(_sifted(stars, wides, like)), nodes, like))
    roots = components(links)
    # What is still apart from most of its key meets all others of the key but the one that all were compared with.
    placed = found.select("node", "part", "keys").join(roots, "node", "left").select("node", "part", F.coalesce("root", "node").alias("root"), F.explode("keys").alias("key"))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("two"), F.max(F.struct("part", "node"))["node"].alias("leader"), F.count(F.lit(1)).alias("share"))
    placed = cut(placed.drop("part").join(open_keys.where("one <> two and share > 2").select("key", "leader"), "key").where("node <> leader").drop("leader"))
    groups = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    most = groups.groupBy("key").agg(F.max(F.struct("m", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots")
    open_rows = placed.join(most, "key").join(found.select("node", "n", *PARITY, "narrow"), "node")
    apart = _prefixed(open_rows.where(F.col("root") != F.col("main")), "x")
    others = _prefixed(open_rows, "y").withColumnRenamed("key", "y_key")
    different = (F.col("x_root") != F.col("y_root")) & ((F.col("y_root") == F.col("y_main")) | (F.col("x_node") < F.col("y_node")))
    near = _near("x_narrow", "y_narrow", F.col("x_n") + F.col("y_n"), like)  # 256 bits let all large sets pass
    still = apart.join(others, (F.col("key") == F.col("y_key")) & different & _alike(like) & near)
    still = still.select(F.col("x_node").alias("x"), F.col("y_node").alias("y"), F.col("x_n").alias("nx"), F.col("y_n").alias("ny")).distinct()
    done = stars.select("x", "y").unionByName(stars.select(F.col("y").alias("x"), F.col("x").alias("y")))
    rest = cut(_sifted(still.join(done, ["x", "y"], "left_anti"), wides, like))
    return components(links.unionByName(fragment_overlaps(texts, rest, nodes, like))) if rest.limit(1).count() else roots


def _placed_rows(docs: DataFrame, like: Similarity, id_col: str, text_col: str) -> DataFrame:
    """``id, t, n, place, component`` of every row: the set's component by name, and the least id in it."""
    named = cut(named_sets(docs, like, id_col, text_col))
    nodes = cut(named.where("n > 0").groupBy("node", "n").agg(F.min("id").alias("rep")))
    roots = linked_sets(_text(docs, id_col, text_col), nodes, like)
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component"))
    of_node = placed.join(least, "root").select("node", F.col("root").alias("place"), "component")
    empty, rest = named.where("n = 0").withColumn("component", F.col("id")).withColumn("place", F.lit(None).cast("binary")), named.where("n > 0").join(of_node, "node", "left")
    return rest.select("id", "t", "n", "place", "component").unionByName(empty.select("id", "t", "n", "place", "component"))


def jaccard_components(docs: DataFrame, like: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` (the least id reachable by links).

    Words are runs of bytes other than space and tab to carriage return, A-Z lower-cased. Null and empty texts have no
    n-gram, link with nothing and are their own component. Rows that repeat an id stay rows; a null id is the last in
    order. No rows in, no rows out; other columns are not read. Sets are compared by 64-bit hashes of their n-grams.
    """
    return _placed_rows(docs, like, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, like: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the least id (null ids last, then the least digest of the text).

    Rows that repeat id and text are one record, of which one row stays; texts without words are each their own. All
    columns stay, whatever their names. Rows that may go are chosen by a filter, so no others are shuffled.
    """
    rows = cut(_placed_rows(docs, like, id_col, text_col))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "t")
    first = rows.where("place is not null").groupBy("place").agg(F.min(order).alias("first"))
    gone = rows.join(first, "place").where(~order.eqNullSafe(F.col("first"))).select(F.col("id").alias("_id"), F.col("t").alias("_t")).distinct()
    again = rows.groupBy(F.col("id").alias("_id"), F.col("t").alias("_t")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return without_rows(docs, gone, again, id_col, F.xxhash64(text_of(text_col)))

