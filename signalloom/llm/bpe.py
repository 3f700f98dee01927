"""Byte-level BPE: encoding by overlapping chunks, decoding by concatenated bytes.

A text longer than one chunk is cut into chunks that overlap. Chunks are pre-tokenised in parallel, each from its own
start. The pattern looks only ahead, so where the boundaries of two neighbours meet in the overlap they agree from
there on: neighbours are stitched at their first common boundary, and the pieces between stitches are encoded, again in
parallel. A text with neighbours that never meet (one run of a class longer than the overlap) is encoded as one piece.
A text of one chunk is one piece and needs no shuffle.
"""

from __future__ import annotations

import base64
import contextlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from signalloom.llm.common import text_of

#: Characters of a chunk beside the overlap, of the overlap, and those at a cut end whose boundaries aren't trusted.
STEP, OVERLAP, MARGIN = 32_768, 1_024, 16
#: Distinct pre-tokens that a task remembers.
REMEMBERED = 200_000
_READY: dict[tuple, object] = {}


@dataclass(frozen=True)
class Vocabulary:
    """Pattern and ranks (base64 token and rank per line), read once on the driver and broadcast: a few hundred KB."""

    pattern: str
    newer: str  # characters that need the exact pattern
    exact: str
    ranks: object  # broadcast bytes

    @classmethod
    def of(cls, spark: SparkSession, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(pattern, *_newer_letters(pattern), spark.sparkContext.broadcast(f.read()))


def _ranges(points: set[int]) -> str:
    out, run = [], []
    for p in [*sorted(points), -2]:
        if run and p != run[-1] + 1:
            out.append(rf"\U{run[0]:08x}-\U{run[-1]:08x}")
            run = []
        run.append(p)
    return "".join(out)


@lru_cache
def _newer_letters(pattern: str) -> tuple[str, str]:
    """Characters whose class differs between the library and ``regex`` (they follow different Unicode versions), and
    the pattern with the library's classes. The library is asked: a pattern of one class keeps only its characters."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    odd: set[int] = set()
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        only = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs = set(map(ord, only.decode(only.encode_ordinary(every))))
        ours = set(map(ord, regex.findall(name, every)))
        odd |= theirs ^ ours
        whole = f"[[{name}{_ranges(theirs - ours)}]{f'--[{_ranges(ours - theirs)}]' if ours - theirs else ''}]"
        pattern = pattern.replace(name, whole)
        if name == r"\s":
            pattern = pattern.replace(r"\S", f"[^{whole}]")
    return (f"[{_ranges(odd)}]" if odd else ""), pattern


class Encoder(dict):
    """Pre-token -> its ids as little-endian int32 bytes, filled on demand."""

    def __init__(self, pattern: str, newer: str, exact: str, lines: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.usual = regex.compile(pattern)
        self.newer, self.exact = (re.compile(newer) if newer else None), regex.compile(exact, regex.V1)
        self.high = not (newer and self.newer.search("".join(map(chr, range(256)))))
        self.merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        self.lengths, self.starts = np.zeros(size, np.int64), np.zeros(size, np.int64)
        table, at = [], 0
        for token, rank in ranks.items():
            self.lengths[rank], self.starts[rank] = len(token), at
            table.append(token)
            at += len(token)
        self.table = np.frombuffer(b"".join(table), np.uint8)

    def __missing__(self, pretoken: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.array(self.merges._encode_single_piece(pretoken), "<i4").tobytes()
        if len(pretoken) < 64:
            self[pretoken] = ids
        return ids

    def split(self, text: str) -> regex.Pattern:
        """The pattern for this text: plain, unless a character is classed otherwise by the library."""
        if self.newer is None or text.isascii():
            return self.usual
        if self.high:  # none of them is in Latin-1, which is quick to tell
            with contextlib.suppress(UnicodeEncodeError):
                text.encode("latin-1")
                return self.usual
        return self.exact if self.newer.search(text) else self.usual

    def encode(self, piece: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(piece).findall(piece)))

    def boundaries(self, text: str) -> np.ndarray:
        return np.fromiter((m.start() for m in self.split(text).finditer(text)), np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        out = []
        for a in range(0, len(ids), 1 << 18):
            part = ids[a : a + (1 << 18)]
            n = self.lengths[part]
            ends = np.cumsum(n)
            out.append(self.table[np.repeat(self.starts[part] - ends + n, n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


def _encoder(v: Vocabulary) -> Encoder:
    lines = v.ranks.value
    key = (v.pattern, len(lines), hash(lines))
    if key not in _READY:
        _READY[key] = Encoder(v.pattern, v.newer, v.exact, lines)
    return _READY[key]


def _encode(v: Vocabulary):
    @F.arrow_udf("array<int>")
    def run(pieces: pa.Array) -> pa.Array:
        encoder = _encoder(v)
        ids = [encoder.encode(p.as_py() or "") for p in pieces]
        ends = np.cumsum([0, *map(len, ids)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))

    return run


def decoded(v: Vocabulary, ids: Column) -> Column:
    """Bytes of an array of ids: those of each id, one after the other. Null is empty."""

    @F.arrow_udf("binary")
    def run(lists: pa.Array) -> pa.Array:
        encoder = _encoder(v)
        return pa.array([encoder.decode(x.values.to_numpy() if x.is_valid else np.zeros(0, np.int64)) for x in lists], pa.binary())

    return run(ids)


def _bounds(v: Vocabulary):
    """Trusted boundaries, as offsets in the text, in the overlap with the chunk before and the one after."""

    @F.arrow_udf("struct<left:array<long>,right:array<long>>")
    def run(k: pa.Array, last: pa.Array, text: pa.Array) -> pa.Array:
        encoder, out = _encoder(v), []
        for i, final, chunk in zip(k.to_pylist(), last.to_pylist(), text, strict=True):
            chunk = chunk.as_py()
            at = encoder.boundaries(chunk)
            at = at[at <= (len(chunk) if final else len(chunk) - MARGIN)]
            out.append({"left": at[at < OVERLAP] + i * STEP, "right": at[at >= STEP] + i * STEP})
        return pa.array(out, pa.struct([("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))]))

    return run


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, (ident, digest, text) in enumerate(zip(*batch.columns, strict=True)):
            text = text.as_py()
            n = -(-(len(text) - OVERLAP) // STEP)
            for a in range(0, n, 64):
                ks = range(a, min(a + 64, n))
                yield pa.RecordBatch.from_arrays([
                    pa.array([ident.as_py()] * len(ks), pa.int64()), pa.array([digest.as_py()] * len(ks)), pa.array(ks, pa.int32()),
                    pa.array([k == n - 1 for k in ks]), pa.array([text[k * STEP : k * STEP + STEP + OVERLAP] for k in ks])],
                    names=["id", "digest", "k", "last", "chunk"])


def encoded(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` (long), ``ids`` (array<int>) per row of ``docs``. Null texts are empty and have no ids; null or
    repeated ids and repeated rows stay rows of their own; no rows in, no rows out; other columns are not read."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    one_chunk = F.length("text") <= STEP + OVERLAP
    encode = _encode(v)
    short = texts.where(one_chunk).select("id", encode("text").alias("ids"))

    # A text is named by its id and digest: texts that share an id stay apart.
    key = ["id", "digest"]
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["digest"] == b["digest"]) & (a["k"] == b["k"])
    long = texts.where(~one_chunk).select("id", F.sha2("text", 256).alias("digest"), "text")
    chunks = long.mapInArrow(_chunked, "id long, digest string, k int, last boolean, chunk string").repartition("digest", "k")
    bounds = chunks.select(*key, "k", "last", _bounds(v)("k", "last", "chunk").alias("b")).select(*key, "k", "last", "b.left", "b.right").dropDuplicates([*key, "k"])
    w = Window.partitionBy(*key).orderBy("k")
    begin = F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("left", F.lag("right").over(w))))
    cuts = bounds.select(*key, "k", "last", begin.alias("begin"))
    cuts = cuts.select(*key, "k", "last", "begin", F.lead("begin").over(w).alias("end"), F.max(F.col("begin").isNull()).over(Window.partitionBy(*key)).alias("whole"))
    cuts = cuts.alias("c")
    met = chunks.alias("t").join(cuts, same(_side("t"), _side("c"))).select("t.id", "t.digest", "t.k", "t.last", "t.chunk", "c.begin", "c.end", "c.whole")
    own = F.col("begin") - F.col("k") * STEP
    piece = F.when(F.col("last"), F.expr(f"substring(chunk, cast(begin - k * {STEP} + 1 as int))")).otherwise(
        F.substring(F.col("chunk"), (own + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int")))
    pieces = met.where("not whole").select(*key, "k", encode(piece).alias("ids"))
    rest = met.where("whole").select(*key, "k", F.when(F.col("last"), F.col("chunk")).otherwise(F.substring("chunk", 1, STEP)).alias("part"))
    wholes = rest.groupBy(*key).agg(_in_order("part").alias("parts")).select(*key, "parts.n", encode(F.array_join("parts.values", "")).alias("ids"))
    stitched = pieces.groupBy(*key).agg(_in_order("ids").alias("parts")).select(*key, "parts.n", F.flatten("parts.values").alias("ids"))
    many = stitched.unionByName(wholes).select("id", "ids", F.explode(F.sequence(F.lit(1), F.col("n")))).select("id", "ids")
    return short.unionByName(many).withColumnRenamed("id", id_col)


def _side(alias: str) -> dict[str, Column]:
    return {c: F.col(f"{alias}.{c}") for c in ("id", "digest", "k")}


def _in_order(value: str) -> Column:
    """Values by ``k``, once each, and how often the first occurs: rows that repeat id and text share their pieces."""
    listed = F.array_sort(F.collect_list(F.struct("k", value)))
    once = F.transform(F.filter(listed, lambda x, i: (i == 0) | (x["k"] != F.get(listed, i - 1)["k"])), lambda x: x[value])
    return F.struct(F.count(F.when(F.col("k") == 0, 1)).cast("int").alias("n"), once.alias("values"))


def token_digests(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas), ``decoded_sha256``."""
    tokens = encoded(docs, v, id_col, text_col)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return tokens.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
                         F.sha2(decoded(v, F.col("ids")), 256).alias("decoded_sha256"))
