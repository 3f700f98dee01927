"""Runs of words: stretches that repeat with a small period, found by recompression.

The words of a block of texts become one sequence with a symbol of its own at every end of a text. Recompression shortens
it level by level: block compression replaces a symbol that stands k times in a row by one new symbol, pair compression
replaces pairs whose left symbol is in one half of the alphabet and whose right symbol in the other. Equal symbols of a
level stand for equal words, so the levels are a run-length grammar in which the longest common extension of two places is
found by climbing while symbols agree and descending where they differ, some steps a level.

A run of period q and length L has L - q places in a row whose word equals the word q further on. Such a stretch covers a
multiple of the least L - q, so only those places are candidates (a harmonic grid: about n / 2q for each q). The grammar
extends each candidate whose two words agree to both sides, exactly; stretches found with a multiple of their period are
the same stretches, of which the least period stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from signalloom.llm.wordhash import blocks, mixed, raw_bytes, words_of

#: Words up to which a text's grid is a prefix of one kept table; longer texts list theirs period by period.
TABLE = 1 << 17


class Grammar:
    """Levels of a recompressed sequence, end to end in flat arrays; entries point to entries.

    The first and the last symbol of ``text`` must occur once.
    """

    def __init__(self, text: np.ndarray):
        self._symbols, self._up, self._head, self._base, self._times, self._below = [text], [], [np.full(len(text), -1)], [text], [np.ones(len(text), np.int64)], [0]
        self._fresh, self._size = int(text.max(initial=0)) + 1, len(text)
        quiet = turn = 0
        while len(text) > 1:
            turn += 1
            begin = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            if len(begin) < len(text):
                text = self._add_blocks(text, begin)
            left = mixed(text.astype(np.uint64) + np.uint64(turn << 40)) & np.uint64(1) != 0
            one, other = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
            at = np.flatnonzero(one if np.count_nonzero(one) >= np.count_nonzero(other) else other)
            if not len(at):
                continue  # the next turn divides the alphabet otherwise
            _, name = np.unique(text[at] * self._fresh + text[at + 1], return_inverse=True)
            quiet = quiet + 1 if int(name.max()) + 1 == len(at) else 0
            text = self._add_pairs(text, at, name)
            if quiet > 1 and len(np.unique(text)) == len(text):
                break  # nothing occurs twice any more
        self._up.append(np.full(len(text), -1))
        flat = lambda parts: np.concatenate(parts).astype(np.int32)
        self.symbol, self.up, self.head, self.base, self.times = map(flat, (self._symbols, self._up, self._head, self._base, self._times))
        self.tail = np.r_[self.head[1:] - 1, 0].astype(np.int32)  # last child; set right at the ends of levels below
        ends = np.cumsum([len(s) for s in self._symbols]) - 1
        for level in range(1, len(ends)):
            self.tail[ends[level]] = ends[level - 1]
        whole = self.up >= 0
        self.is_first, self.is_last = whole.copy(), whole.copy()
        self.is_first[whole] = self.head[self.up[whole]] == np.flatnonzero(whole)
        self.is_last[whole] = self.tail[self.up[whole]] == np.flatnonzero(whole)
        self.leaves = len(self._symbols[0])
        del self._symbols, self._up, self._head, self._base, self._times

    def _add(self, text: np.ndarray, begin: np.ndarray, base: np.ndarray, times: np.ndarray, owner: np.ndarray) -> np.ndarray:
        below = self._below[-1]
        self._below.append(self._size)
        self._up.append(owner + self._size)
        self._head.append(begin + below)
        self._symbols.append(text)
        self._base.append(base)
        self._times.append(times)
        self._size += len(text)
        return text

    def _add_blocks(self, text: np.ndarray, begin: np.ndarray) -> np.ndarray:
        times = np.diff(np.r_[begin, len(text)])
        base, many = text[begin], times > 1
        new = base.copy()
        _, name = np.unique(base[many] * (len(text) + 1) + times[many], return_inverse=True)
        new[many] = self._fresh + name
        self._fresh += int(name.max()) + 1
        return self._add(new, begin, base, times, np.repeat(np.arange(len(begin)), times))

    def _add_pairs(self, text: np.ndarray, at: np.ndarray, name: np.ndarray) -> np.ndarray:
        starts = np.ones(len(text), bool)
        starts[at + 1] = False
        begin = np.flatnonzero(starts)
        new, owner = text[begin], np.cumsum(starts) - 1
        new[owner[at]] = self._fresh + name
        self._fresh += int(name.max()) + 1
        return self._add(new, begin, np.full(len(begin), -1), np.ones(len(begin), np.int64), owner)

    def _extended(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """Places, from ``x`` on in the direction of ``step``, at which the sequences at x and y (x < y) first differ."""
        edge, inner, outer = (self.is_first, self.head, self.tail) if step > 0 else (self.is_last, self.tail, self.head)
        x, y, out, open_ = x.copy(), y.copy(), np.empty(len(x), np.int64), np.arange(len(x))
        while len(open_):
            climb = edge[x] & edge[y]
            climb &= self.symbol[self.up[x]] == self.symbol[self.up[y]]
            same = ~climb & (self.symbol[x] == self.symbol[y])
            down = ~climb & ~same
            done = down & (x < self.leaves)
            x[climb], y[climb] = self.up[x[climb]], self.up[y[climb]]
            a, b = self.up[x[same]], self.up[y[same]]
            left = np.minimum(step * (outer[a] - x[same]), step * (outer[b] - y[same])) + 1  # to the end of the nearer block
            far = np.where((a >= 0) & (self.base[a] >= 0), left, 1)
            x[same] += step * far
            y[same] += step * far
            down &= ~done
            a, b = x[down], y[down]
            skip = np.where((self.base[a] == self.base[b]) & (self.base[a] >= 0), np.minimum(self.times[a], self.times[b]), 0)
            x[down], y[down] = inner[a] + step * skip, inner[b] + step * skip
            out[open_[done]] = x[done]
            stay = ~done
            x, y, open_ = x[stay], y[stay], open_[stay]
        return out

    def extension(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many symbols agree before, and from, places x and y."""
        return x - 1 - self._extended(x - 1, y - 1, -1), self._extended(x, y, 1) - x


def _least_length(period, least: int, times: int):
    return np.maximum(least, times * period)


@lru_cache(maxsize=4)
def _grid(words: int, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (words needed, place, period) of texts of up to ``words`` words, by words needed."""
    place, period = [], []
    for q in range(1, words // times + 1):
        at = np.arange(0, words - q, _least_length(q, least, times) - q)
        place.append(at)
        period.append(np.full(len(at), q))
    place, period = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (place, period))
    need = np.maximum(place + period + 1, _least_length(period, least, times))
    order = np.argsort(need, kind="stable")
    return need[order], place[order].astype(np.int32), period[order].astype(np.int32)


def _candidates(word: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of the grid at which the word equals the one a period further on."""
    n = len(word)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n <= TABLE:
        need, place, period = _grid(max(1 << 12, 1 << (n - 1).bit_length()), least, times)
        k = int(np.searchsorted(need, n, side="right"))
        place, period = place[:k], period[:k]
        hit = np.flatnonzero(word[place] == word[place + period])
        return place[hit].astype(np.int64), period[hit].astype(np.int64)
    places, periods = [], []
    for q in range(1, n // times + 1):
        at = np.arange(0, n - q, int(_least_length(q, least, times)) - q)
        at = at[word[at] == word[at + q]]
        places.append(at)
        periods.append(np.full(len(at), q))
    return np.concatenate(places), np.concatenate(periods)


def runs_of(texts: list[np.ndarray], least: int, times: int) -> list[np.ndarray]:
    """Rows (start, length, period) of each text's runs, by start, then period. A text is an array of word numbers."""
    found = [_candidates(t, least, times) for t in texts]
    counts = [len(p) for p, _ in found]
    if not sum(counts):
        return [np.zeros((0, 3), np.int64)] * len(texts)
    used = [i for i, c in enumerate(counts) if c]  # other texts need no grammar
    top, parts, begin = max(int(texts[i].max()) for i in used) + 1, [np.array([0])], {}
    at = 1
    for k, i in enumerate(used):
        parts += [texts[i] + 1, np.array([top + 1 + k])]
        begin[i] = at
        at += len(texts[i]) + 1
    grammar = Grammar(np.concatenate(parts))
    owner = np.repeat(used, [counts[i] for i in used])
    place, period = (np.concatenate([found[i][j] for i in used]) for j in (0, 1))
    x = place + np.array([begin[i] for i in used]).repeat([counts[i] for i in used])
    before, after = grammar.extension(x, x + period)
    start, length = place - before, before + after + period
    good = np.flatnonzero(length >= _least_length(period, least, times))
    owner, start, length, period = owner[good], start[good], length[good], period[good]
    order = np.lexsort((period, length, start, owner))
    owner, start, length, period = owner[order], start[order], length[order], period[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    rows = np.stack([start, length, period], 1)[fresh]
    owner = owner[fresh]
    order = np.lexsort((rows[:, 2], rows[:, 0], owner))
    cuts = np.searchsorted(owner[order], np.arange(len(texts) + 1))
    return [rows[order][a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    stays = np.ones(len(words), bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return b" ".join(words if stays.all() else [w for w, s in zip(words, stays, strict=True) if s])


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    Words are runs of bytes other than space and tab to carriage return, numbered from 0. A run is a stretch of words with
    smallest period q, at least ``max(least, times * q)`` words long (``times`` is at least 2), that no neighbouring word
    extends. ``collapsed`` is the text's words without those that any run holds after its first q words, joined by one
    space. Null and empty texts have no words and no runs; ids may be null, repeat or tie, rows stay rows; a text of any
    length is one value, handled whole by one task in memory proportional to it. No rows in, no rows out; other columns are
    not read.
    """
    if times < 2:
        raise ValueError("a run repeats at least twice")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_bytes(batch.column(1))
            for a, b in blocks(offsets):
                words = words_of(data, offsets[a : b + 1])
                texts = [words.ids[words.first[i] : words.first[i + 1]] for i in range(b - a)]
                runs = runs_of(texts, least, times)
                kept = [_collapsed(data[offsets[a + i] : offsets[a + i + 1]].tobytes().split(), r) for i, r in enumerate(runs)]
                flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
                structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in runs])], pa.int32()), structs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words.counts), lists, pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(over, "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)
