"""Removal of passages that occur earlier in the corpus, by repeated-phrase automata.

A window is 20 consecutive words. Equal windows contain the same seed (the 6-word phrase with the least hash among the
15 inside), so windows are handled by seed:

1. Seeds of all documents are counted (partial counts first); those that recur go into a filter of fixed size.
2. Documents send the words around each recurring seed, about 26 for the windows that chose it, to the seed's shard.
3. A shard confirms which windows recur, word by word, compiles them (those that always follow one another as one phrase)
   into Aho-Corasick automata over letters that stand for words, and streams its passages through it to locate every occurrence. All but the first are repeats.
4. A document's repeats are joined back to its text.

A seed that very many documents hold would fill a shard. Windows of such hot seeds travel one by one as 128-bit digests
instead; their first occurrences are pre-aggregated before the shuffle, and the join can be split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from signalloom.llm.common import NO_ID, cut, partitions, text_of
from signalloom.llm.recurring import key_filter, may_hold, recurring
from signalloom.llm.wordhash import Words, blocks, ngrams, raw_bytes, words_of

WINDOW, SEED = 20, 6
#: Occurrences from which a seed is hot, and the most seeds that may be hot (their list is broadcast): the bound on
#: occurrences rises where more seeds would be.
HOT, MOST_HOT = 20_000, 10_000
#: Groups of seeds per shuffle partition; each is one automaton.
SHARDS = 8
_AT = np.uint64((1 << 28) - 1)


@dataclass
class Seeds:
    """Seeds of a block of texts: hash, number of the text, and the first and last window (as words of the block) that chose it."""

    key: np.ndarray
    text: np.ndarray
    first: np.ndarray
    last: np.ndarray


def seeds_of(words: Words) -> Seeds:
    """Seeds of all windows; windows never reach from one text into the next."""
    span = WINDOW - SEED + 1
    phrases, begins = ngrams(words, SEED)
    text = np.searchsorted(words.first, begins, side="right") - 1
    inside = text[: max(0, len(text) - span + 1)] == text[span - 1 :]
    if not inside.any():
        return Seeds(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    least, width = (phrases & ~_AT) | np.arange(len(phrases), dtype=np.uint64), 1  # the leftmost of equals is the least
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    window = np.flatnonzero(inside)
    at = (least[window] & _AT).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return Seeds(phrases[at[first]], text[window[first]], begins[window[first]], begins[window[last]])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, a digest that tells texts of a repeated id apart (below 0 for a null id, which comes first), text."""
    digest = F.shiftrightunsigned(F.xxhash64(text_of(text_col)), 1)
    known = F.col(id_col).isNotNull()
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.when(known, digest).otherwise(digest + F.lit(NO_ID)).alias("t"), text_of(text_col).alias("text"))


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, Words, Seeds]]:
    """Blocks of texts: the row of the first one, the words and the seeds."""
    data, offsets = raw_bytes(batch.column("text"))
    for a, b in blocks(offsets):
        words = words_of(data, offsets[a : b + 1])
        yield a, words, seeds_of(words)


def _seed_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [s.key for _, _, s in _documents(batch)]
        key, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for a in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(key[a : a + (1 << 16)].view(np.int64)), pa.array(n[a : a + (1 << 16)])], names=["key", "n"])


def _passages(held, hot: np.ndarray):
    """Rows (shard key, doc, t, start, passage) around recurring seeds that aren't hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, t = batch.column("doc").to_numpy(), batch.column("t").to_numpy()
            for row, words, seeds in _documents(batch):
                good = may_hold(held.value, seeds.key) & ~np.isin(seeds.key, hot)
                key, text, first, last = (x[good] for x in (seeds.key, seeds.text, seeds.first, seeds.last))
                raw = words.data.tobytes()
                starts, ends = words.start[first], words.end[last + WINDOW - 1]
                # Passages overlap, so a long text's may be several times its bytes.
                part = np.cumsum(ends - starts) // (8 << 20)
                for some in np.split(np.arange(len(key)), np.flatnonzero(part[1:] != part[:-1]) + 1) if len(key) else ():
                    passage = [raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
                    columns = [key[some].view(np.int64), doc[row + text[some]], t[row + text[some]], first[some] - words.first[text[some]]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(passage, pa.binary())], names=["key", "doc", "t", "start", "passage"])

    return run


def _hot_windows(hot: np.ndarray):
    """Rows (w1, w2, doc, t, start): windows of hot seeds, by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, t = batch.column("doc").to_numpy(), batch.column("t").to_numpy()
            for row, words, seeds in _documents(batch):
                mine = np.isin(seeds.key, hot)
                if not mine.any():
                    continue
                many = seeds.last[mine] - seeds.first[mine] + 1
                text = np.repeat(seeds.text[mine], many)
                start = np.concatenate([np.arange(a, b + 1) for a, b in zip(seeds.first[mine], seeds.last[mine], strict=True)])
                digests = []
                for hashes in (words.hash, words.hash2):
                    window, begins = ngrams(words, WINDOW, hashes)
                    digests.append(window[np.searchsorted(begins, start)].view(np.int64))
                columns = [*digests, doc[row + text], t[row + text], start - words.first[text]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["w1", "w2", "doc", "t", "start"])

    return run


#: Distinct words after which a shard goes on with another automaton (there are 1,114,112 letters).
LETTERS = 1_000_000


class _Letters(dict):
    """A letter of its own for each word, so that passages become strings and windows substrings."""

    def __missing__(self, word: bytes) -> str:
        n = len(self) + 1
        self[word] = letter = chr(n if n < 0xD800 else n + 0x800)  # no surrogates
        return letter


def _confirmed(where: dict[str, list[tuple[int, int, int]]]) -> dict[str, tuple[int, int, int]]:
    """Phrases of recurring windows among a seed's passages, with the first place of each. ``where``: places of each passage.

    Windows that always follow one another are one phrase: one recurs wherever the other does, and the first place of the
    next is one word further.
    """
    first: dict[str, tuple[int, int, int]] = {}
    again: set[str] = set()
    before: dict[str, str] = {}  # the letter that always stands before a window, or none
    after: dict[str, str] = {}
    for text, places in where.items():
        doc, t, start = places[0]
        for i in range(len(text) - WINDOW + 1):
            window, here = text[i : i + WINDOW], (doc, t, start + i)
            left, right = text[i - 1] if i else "", text[i + WINDOW : i + WINDOW + 1]
            known = first.setdefault(window, here)
            if known is here:
                before[window], after[window] = left, right
                if len(places) > 1:
                    again.add(window)
                continue
            again.add(window)
            if here < known:
                first[window] = here
            if before[window] != left:
                before[window] = ""
            if after[window] != right:
                after[window] = ""
    out = {}
    for text in where:
        begin = 0
        for i in range(len(text) - WINDOW + 1):
            window = text[i : i + WINDOW]
            if after[window] and before[text[i + 1 : i + 1 + WINDOW]]:
                continue
            if window in again:
                out[text[begin : i + WINDOW]] = first[text[begin : begin + WINDOW]]
            begin = i + 1
    return out


def _streamed(automaton, passages: list[tuple[str, list[tuple[int, int, int]]]], out: list[tuple[int, int, int, int]]) -> None:
    """Locate every occurrence of the automaton's phrases in the passages, and keep those with an earlier one."""
    automaton.make_automaton()
    for text, places in passages:
        hits = [(end - size + 1, size, earliest) for end, (size, earliest) in automaton.iter(text)]
        for doc, t, start in places if hits else ():
            stop = -1
            for i, size, earliest in hits:
                if (doc, t, start + i) > earliest:
                    if start + i <= stop:
                        out[-1] = (*out[-1][:3], start + i + size)
                    else:
                        out.append((doc, t, start + i, start + i + size))
                    stop = out[-1][3]


def _located(table: pa.Table) -> pa.Table:
    """Repeats among the passages of a shard, as ranges of words (doc, t, start, stop)."""
    import ahocorasick

    by_seed: dict[int, dict[bytes, list[tuple[int, int, int]]]] = {}
    for key, doc, t, start, passage in zip(*(table[c].to_pylist() for c in ("key", "doc", "t", "start", "passage")), strict=True):
        by_seed.setdefault(key, {}).setdefault(passage, []).append((doc, t, start))
    out: list[tuple[int, int, int, int]] = []
    letters, automaton, passages = _Letters(), ahocorasick.Automaton(), []
    while by_seed:  # equal windows have equal seeds, so each seed is confirmed by itself
        _, raw = by_seed.popitem()
        if len(raw) == 1 and len(next(iter(raw.values()))) == 1:
            continue  # the filter let a seed pass that occurs once
        where: dict[str, list[tuple[int, int, int]]] = {}
        for passage, places in raw.items():
            where.setdefault("".join(map(letters.__getitem__, passage.split())), []).extend(places)
        for places in where.values():
            places.sort()
        again = _confirmed(where)
        for phrase, earliest in again.items():
            automaton.add_word(phrase, (len(phrase), earliest))
        passages += where.items() if again else []
        if passages and (len(letters) > LETTERS or not by_seed):
            _streamed(automaton, passages, out)
            automaton, passages = ahocorasick.Automaton(), []
        if len(letters) > LETTERS:
            letters = _Letters()
    if passages:
        _streamed(automaton, passages, out)
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(("doc", "t", "start", "stop"), columns, strict=True)})


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_from: int = HOT) -> DataFrame:
    """``doc, t, start, stop``: ranges of words (may touch or overlap) covered by windows that also start earlier.

    Documents are in order of id; ids that repeat with different texts are different documents in order of ``t``, a
    digest of the text; null ids come first.
    """
    texts = _texts(docs, id_col, text_col)
    again = cut(recurring(texts.mapInArrow(_seed_keys, "key long, n long"), n="n"))
    held = key_filter(again)
    total = again.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bound = max(hot_from, total // MOST_HOT)
    hot = np.array([r["key"] for r in again.where(F.col("n") > bound).select("key").collect()], np.int64).view(np.uint64)  # at most MOST_HOT
    shards = SHARDS * partitions(docs.sparkSession)
    passages = texts.mapInArrow(_passages(held, hot), "key long, doc long, t long, start long, passage binary")
    found = passages.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInArrow(_located, "doc long, t long, start long, stop long")
    if not len(hot):
        return found
    windows = cut(texts.mapInArrow(_hot_windows(hot), "w1 long, w2 long, doc long, t long, start long"))  # read twice, made once
    place = F.struct("doc", "t", "start")
    first = windows.groupBy("w1", "w2").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeats = windows.join(first, ["w1", "w2"]).where(place > F.col("earliest"))
    return found.unionByName(repeats.select("doc", "t", "start", (F.col("start") + WINDOW).alias("stop")))


def _without(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    kept, n_words, n_removed = [], [], []
    data, offsets = raw_bytes(texts)
    gone = ranges.flatten()
    begins, ends = gone.field("start").to_numpy(zero_copy_only=False).tolist(), gone.field("stop").to_numpy(zero_copy_only=False).tolist()
    ats = np.cumsum([0, *(n or 0 for n in pc.list_value_length(ranges).to_pylist())]).tolist()
    for i in range(len(texts)):
        words = data[offsets[i] : offsets[i + 1]].tobytes().split()
        stays, at = words, 0
        if ats[i] < ats[i + 1]:
            stays = []
            for start, stop in sorted(zip(begins[ats[i] : ats[i + 1]], ends[ats[i] : ats[i + 1]], strict=True)):
                stays += words[at:start]
                at = max(at, stop)
            stays += words[at:]
        kept.append(b" ".join(stays).decode())
        n_words.append(len(words))
        n_removed.append(len(words) - len(stays))
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["kept", "n_words", "n_removed"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_from: int = HOT) -> DataFrame:
    """id, ``kept`` (the words that stay, joined by single spaces), ``n_words``, ``n_removed`` per row of ``docs``.

    Words are runs of bytes other than space and tab to carriage return, unchanged. Null and empty texts have no words.
    Rows that repeat both id and text are the same place in the corpus and are treated alike. No rows in, no rows out;
    other columns are not read.
    """
    ranges = repeated_ranges(docs, id_col, text_col, hot_from).groupBy("doc", "t").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    joined = _texts(docs, id_col, text_col).join(ranges, ["doc", "t"], "left")
    without = F.arrow_udf(_without, "struct<kept:string,n_words:long,n_removed:long>")
    out = joined.select("doc", "t", without("text", "ranges").alias("x"))
    return out.select(F.when(F.col("t") >= 0, F.col("doc")).alias(id_col), "x.kept", "x.n_words", "x.n_removed")
