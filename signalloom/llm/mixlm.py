"""Language model by online logistic context mixing.

A text is its words and one end. Frequent words (a dictionary of bounded size) and the end are coded by a binary code of
their own, all other words by an escape and a code of their bytes, so a text becomes a row of bits. Each bit is predicted
by several contexts: the place in the code alone, with the word before, with the two before; in spelled
words the letters so far, the last two and the last three. A context is hashed to a slot that counts the bits seen there.

* Counts of all training documents add up page by page and are sent to the tasks; their number of slots is a parameter.
* Mixing: the contexts' predictions, stretched to the log-odds scale, are added with weights and squashed to a probability.
  A gate (how often two of the contexts were seen, and whether a word is spelled) selects the set of weights. Sets are first
  learned on a fold of the training documents with the counts of the others, then go on learning in each text, online.
* Refinement: what share of the bits was one where the mix said so, in that fold and then in the text so far, is averaged
  with the mix.

Weights and refinement change every ``STEP`` words with what is already coded, so every probability depends on earlier
words only, and texts are scored apart, many bits at a time.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from signalloom.llm.common import cut, text_of
from signalloom.llm.wordhash import Words, _keys, blocks, mixed, raw_bytes, words_of

#: Words in the dictionary (the others are spelled), slots of a context (2 ** 20), contexts, gates (for own codes and spelled words each).
DICTIONARY, SLOT_BITS, CONTEXTS, GATES = 262_142, 20, 3, 16
#: Words between two changes of the weights; rate of learning; words a place in the refinement is worth at first.
STEP, RATE, PRIOR = 256, 0.02, 64.0
#: Places of the refinement on the log-odds scale, and of a page of slots.
PLACES, PAGE = 24, 1 << 14
_TERMINATOR = 256
_FAR = 60_000
#: Bytes of text whose words are looked up in the dictionary at once.
LOOKED_UP = 2 << 20


def prefix_code(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (as numbers) and lengths of a Huffman code; the rarest symbols count as a millionth of all."""
    least = max(1, int(weights.sum()) >> 20)
    heap = [(max(int(w), least), i, None) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    fresh = len(heap)
    while len(heap) > 1:
        one, two = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (one[0] + two[0], fresh, (one, two)))
        fresh += 1
    length = np.zeros(len(weights), np.int64)
    waiting = [(heap[0], 0)]
    while waiting:
        (_, i, parts), depth = waiting.pop()
        if parts is None:
            length[i] = max(1, depth)
        else:
            waiting += [(parts[0], depth + 1), (parts[1], depth + 1)]
    code, at, out = 0, 0, np.zeros(len(weights), np.int64)
    for i in np.lexsort((np.arange(len(weights)), length)):  # canonical: in order of length, then symbol
        code <<= int(length[i]) - at
        at = int(length[i])
        out[i] = code
        code += 1
    return out, length


@dataclass
class Coder:
    """Numbers and codes of dictionary words, the escape (after them) and the end (last); codes of bytes."""

    words: pa.Array
    counts: np.ndarray
    code: np.ndarray
    length: np.ndarray
    byte_code: np.ndarray
    byte_length: np.ndarray

    @classmethod
    def of(cls, words: list[bytes], counts: list[int], others: int, ends: int) -> Coder:
        """``others``: occurrences of words outside the dictionary; ``ends``: texts."""
        in_words = np.ones(257, np.int64)
        for w, c in zip(words, counts, strict=True):
            np.add.at(in_words, np.frombuffer(w, np.uint8).astype(np.int64), c)
            in_words[_TERMINATOR] += c
        code, length = prefix_code(np.array([*counts, others + 1, ends + 1], np.int64))
        return cls(pa.array(words, pa.large_binary()), np.array([*counts, 0, ends], np.int64), code, length, *prefix_code(in_words))


@dataclass
class Bits:
    """Bits of some texts in order of step: the word each belongs to, the words' texts, places and steps, bits, slots."""

    word: np.ndarray
    text: np.ndarray
    place: np.ndarray
    step: np.ndarray
    bit: np.ndarray
    slots: list[np.ndarray]


def _mix32(x: np.ndarray) -> np.ndarray:
    return (mixed(x) >> np.uint64(32)).astype(np.uint32)


def _coded(code: np.ndarray, length: np.ndarray, contexts: list[np.ndarray], slot_bits: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Item, bit and slots of each bit of the items' codes."""
    item = np.repeat(np.arange(len(code), dtype=np.int32), length)
    # bits of the code from this one on
    left = np.repeat((np.cumsum(length, dtype=np.int32)).astype(np.int32), length)
    left -= np.arange(len(item), dtype=np.int32)
    part = (code | (np.int32(1) << length))[item]  # a leading 1 tells depths apart
    node = (part >> left).view(np.uint32) * np.uint32(0x9E3779B1)
    left -= np.int32(1)
    bit = ((part >> left) & np.int32(1)).astype(np.uint8)
    slots = []
    for c in contexts:
        slot = c[item]
        slot += node
        slot *= np.uint32(0x85EBCA6B)
        slot >>= np.uint32(32 - slot_bits)
        slots.append(slot)
    return item, bit, slots


def bits_of(words: Words, numbers: np.ndarray, coder: Coder, slot_bits: int) -> tuple[Bits, Bits]:
    """Bits of words' own codes, and of spelled words. ``numbers``: dictionary number of each distinct word of the block,
    or the escape's."""
    n_texts = len(words.first) - 1
    counts = words.counts
    end = np.cumsum(counts + 1) - 1  # where each text's end stands among words and ends
    total = int(counts.sum()) + n_texts
    is_end = np.zeros(total, bool)
    is_end[end] = True
    at_word = np.flatnonzero(~is_end)
    symbol, name = np.full(total, len(coder.code) - 1), np.zeros(total, np.uint64)
    symbol[at_word], name[at_word] = numbers[words.ids], words.hash
    text = np.repeat(np.arange(n_texts, dtype=np.int32), counts + 1)
    place = (np.arange(total) - np.repeat(end - counts, counts + 1)).astype(np.int32)
    before = np.r_[np.uint64(0), name[:-1]]
    before[place == 0] = 1
    two = np.r_[np.zeros(2, np.uint64), name[:-2]][:total]
    two[place < 2] = 2
    step = (place // max(STEP, -(-(int(counts.max(initial=0)) + 1) // _FAR))).astype(np.uint16)
    order = np.argsort(step, kind="stable")
    contexts = [np.full(total, 7, np.uint32), _mix32(before + np.uint64(3)), _mix32(before * np.uint64(0xD6E8FEB86659FD93) + two)]
    code = lambda codes, which: codes[which].astype(np.int32)
    coded = _coded(code(coder.code, symbol[order]), code(coder.length, symbol[order]), [c[order] for c in contexts], slot_bits)
    own = Bits(coded[0], text[order], place[order], step[order], *coded[1:])

    far = order[symbol[order] == len(coder.code) - 2]
    which = (np.cumsum(~is_end) - 1)[far]
    start, size = words.start[which], words.end[which] - words.start[which] + 1
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(far), dtype=np.int32), size)
    inside = np.arange(len(owner)) - np.repeat(begin, size)
    last = np.cumsum(size) - 1
    letter = words.data[np.minimum(np.repeat(start, size) + inside, max(0, len(words.data) - 1))].astype(np.int64) if len(owner) else np.zeros(0, np.int64)
    letter[last] = _TERMINATOR
    terms = letter.astype(np.uint64) * _keys(int(size.max(initial=1)))[0][inside]
    sums = np.cumsum(terms, dtype=np.uint64) - terms
    so_far = sums - np.repeat(sums[begin], size)
    last_ones, ago = np.zeros(len(owner), np.uint64), []
    for k in (1, 2, 3):
        previous = np.r_[np.zeros(min(k, len(letter)), np.int64), letter[:-k]][: len(letter)]
        last_ones = last_ones * np.uint64(512) + np.where(inside >= k, previous + 1, 0).astype(np.uint64)
        if k > 1:
            ago.append(_mix32(last_ones + np.uint64(k << 40)))
    item, bit, slots = _coded(code(coder.byte_code, letter), code(coder.byte_length, letter), [_mix32(so_far + np.uint64(11)), *ago], slot_bits)
    return own, Bits(owner[item], text[far], place[far], step[far], bit, slots)


@dataclass
class Mix:
    """By slot: stretched prediction (in 256ths) and, in the last two bits, how often it was seen (0 to 3); weights and
    refinement at first, for words' own codes and for spelled words."""

    table: np.ndarray
    weights: np.ndarray
    hits: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, weights: np.ndarray | None = None, hits: np.ndarray | None = None) -> Mix:
        """``counts``: zeros and ones of each context's slots."""
        table = np.empty(counts.shape[:2], np.int16)
        for k, c in enumerate(counts):
            stretch = np.clip(np.log((c[:, 1] + np.float32(0.4)) / (c[:, 0] + np.float32(0.4))), -15, 15)
            table[k] = (np.rint(stretch * 256).astype(np.int16) << 2) | np.searchsorted([1, 3, 16], c.sum(1), side="right").astype(np.int16)
        return cls(table, np.full((2, GATES, CONTEXTS), 0.4) if weights is None else weights, np.zeros((2, PLACES, 2)) if hits is None else hits)


#: Contexts whose sightings are the gate, in own codes and in spelled words.
_GATED = ((1, 2), (0, 2))


def mix_bits(bits: Bits, mix: Mix, spelled: int, texts: int, apart: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Natural log probability of each text, and the last weights and refinement. Texts learn apart, or all together."""
    lanes = texts if apart else 1
    held = [t[s] for t, s in zip(mix.table, bits.slots, strict=True)]
    gate = ((held[_GATED[spelled][0]] & 3) * 4 + (held[_GATED[spelled][1]] & 3)).astype(np.int64)
    x = np.empty((CONTEXTS, len(gate)), np.float32)
    for k, h in enumerate(held):
        np.multiply(h >> 2, np.float32(1 / 256), out=x[k])
    weights = np.tile(mix.weights[spelled].T.astype(np.float32), (1, lanes))
    seen = mix.hits[spelled].sum(1)
    share = np.where(seen > 0, (mix.hits[spelled][:, 1] + 0.5) / (seen + 1), -1).astype(np.float32)
    ones, all_ = np.zeros(lanes * PLACES, np.float32), np.zeros(lanes * PLACES, np.float32)
    out = np.zeros(texts)
    last = np.zeros(texts, np.int64)
    np.maximum.at(last, bits.text, bits.step)
    lane_of = np.empty(texts, np.int32)
    lane_of[np.argsort(-last, kind="stable")] = np.arange(texts)  # texts that go on have the first lanes
    at_word = np.searchsorted(bits.step, np.arange(int(bits.step.max(initial=0)) + 2))
    cuts = np.searchsorted(bits.word, at_word)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        text, own, one = bits.text[bits.word[a:b]], x[:, a:b], bits.bit[a:b].astype(np.float32)
        g, h = gate[a:b], np.zeros(b - a, np.int64)
        going = 1
        if apart:
            lane = lane_of[text].astype(np.int64)
            going = int(lane.max()) + 1
            g = g + lane * GATES
            h += lane * PLACES
        dot = weights[0][g] * own[0]
        for k in range(1, CONTEXTS):
            dot += weights[k][g] * own[k]
        np.clip(dot, -12, 12, out=dot)
        p = 1 / (1 + np.exp(-dot))
        place = np.clip((dot + 8) * np.float32(PLACES / 16), 0, PLACES - 1).astype(np.int64)
        h += place
        prior = share[place]
        refined = (ones[h] + np.float32(PRIOR) * np.where(prior < 0, p, prior)) / (all_[h] + np.float32(PRIOR))
        final = np.clip((p + refined) * np.float32(0.5), np.float32(1e-5), np.float32(1 - 1e-5))
        out += np.bincount(text, np.log(np.abs(one - 1 + final)), minlength=texts)
        away = one - p
        size = going * GATES
        many = np.bincount(g, minlength=size)
        scale = RATE / np.sqrt(np.maximum(many, 1))
        for k in range(CONTEXTS):
            weights[k, :size] += scale * np.bincount(g, away * own[k], minlength=size)
        size = going * PLACES
        came = np.bincount(2 * h + bits.bit[a:b], minlength=2 * size).reshape(-1, 2)
        ones[:size] += came[:, 1]
        all_[:size] += came.sum(1)
    return out, weights.T.astype(np.float64), np.stack([all_ - ones, ones], 1).astype(np.float64)


def _blocks(batch: pa.RecordBatch, coder: Coder, size: int) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    """Range of rows, words, and dictionary numbers of the distinct words."""
    data, offsets = raw_bytes(batch.column("text"))
    escape = len(coder.code) - 2
    for a, b in blocks(offsets, LOOKED_UP):
        whole = words_of(data, offsets[a : b + 1], lower=True)
        number = pc.fill_null(pc.index_in(whole.distinct, value_set=coder.words), escape).to_numpy(zero_copy_only=False).astype(np.int64)
        for c, d in blocks(offsets[a : b + 1] - offsets[a], size):
            yield a + c, a + d, whole.part(c, d), number


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of texts and how often each occurs."""
    for batch in batches:
        data, offsets = raw_bytes(batch.column("text"))
        for a, b in blocks(offsets, 8 << 20):
            words = words_of(data, offsets[a : b + 1], lower=True)
            n = np.bincount(words.ids, minlength=len(words.distinct))
            column = words.distinct.cast(pa.binary()).cast(pa.string())
            for s in range(0, len(n), 1 << 16):
                yield pa.RecordBatch.from_arrays([column[s : s + (1 << 16)], pa.array(n[s : s + (1 << 16)].astype(np.int64))], names=["word", "n"])


def _pages(coder, slot_bits: int):
    """Counts of this task's training texts, page by page: (page, fold, zeros and ones, packed)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((CONTEXTS, 4 << slot_bits), np.int32)
        waiting: list[list[np.ndarray]] = [[] for _ in range(CONTEXTS)]

        def add() -> None:
            for k, keys in enumerate(waiting):
                if keys:
                    counts[k] += np.bincount(np.concatenate(keys), minlength=4 << slot_bits).astype(np.int32)
                keys.clear()

        for batch in batches:
            fold = batch.column("fold").to_numpy(zero_copy_only=False).astype(np.uint32)
            for a, _, words, numbers in _blocks(batch, coder.value, 1 << 19):
                for bits in bits_of(words, numbers, coder.value, slot_bits):
                    side = (fold[a + bits.text] << np.uint32(slot_bits + 1))[bits.word] | bits.bit
                    for keys, slots in zip(waiting, bits.slots, strict=True):
                        keys.append(side | (slots << np.uint32(1)))
                if sum(map(len, waiting[0])) > 6 << slot_bits:
                    add()
        add()
        counts = counts.reshape(CONTEXTS, 2, 1 << slot_bits, 2).swapaxes(0, 1)
        for side in (0, 1):
            paged = counts[side].reshape(-1, PAGE, 2)
            used = np.flatnonzero(paged.any((1, 2)))
            for s in range(0, len(used), 64):
                part = used[s : s + 64]
                packed = [_packed(paged[i]) for i in part]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.full(len(part), side, np.int32)), pa.array(packed, pa.binary())], names=["page", "side", "packed"])

    return over


def _packed(counts: np.ndarray) -> bytes:
    """Counts with small ones as single bytes (255 stands for a larger one, listed behind)."""
    flat = counts.ravel()
    return zlib.compress(np.minimum(flat, 255).astype(np.uint8).tobytes() + flat[flat >= 255].astype("<i8").tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    raw = zlib.decompress(packed)
    flat = np.frombuffer(raw[: 2 * PAGE], np.uint8).astype(np.int64)
    flat[flat == 255] = np.frombuffer(raw[2 * PAGE :], "<i8")
    return flat


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the pages of a shuffle partition, as they stream by; a partition has a bounded number of pages."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for page, side, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (page, side) in sums:
                sums[page, side] += _unpacked(packed)
            else:
                sums[page, side] = _unpacked(packed)
    if sums:
        rows = [(p, s, _packed(c)) for (p, s), c in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["page", "side", "packed"])


def _learned(coder, first, slot_bits: int):
    """Rows (at, value, weight): last weights and refinement of this task's texts, by place in a flat array."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = first.value
        weights, hits, seen = mix.weights.copy(), np.zeros((2, PLACES, 2)), 0
        for batch in batches:
            for a, b, words, numbers in _blocks(batch, coder.value, 1 << 19):
                for spelled, bits in enumerate(bits_of(words, numbers, coder.value, slot_bits)):
                    _, weights[spelled], more = mix_bits(bits, Mix(mix.table, weights, mix.hits), spelled, b - a, apart=False)
                    hits[spelled] += more
                    seen += len(bits.bit)
        if seen:
            flat = np.r_[weights.ravel() * seen, hits.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat), pa.array(np.full(len(flat), float(seen)))], names=["at", "value", "weight"])

    return over


@dataclass
class Model:
    """A fitted model: broadcast coder and mix, counts of words, and their sums."""

    coder: object
    mix: object
    words: DataFrame
    tokens: int
    distinct: int
    slot_bits: int


def train(docs: DataFrame, fold: Column, text_col: str = "text", dictionary: int = DICTIONARY, slot_bits: int = SLOT_BITS) -> Model:
    """Fit on all rows of ``docs``. Weights learn on the rows where ``fold`` holds, with the counts of the others; the
    counts that stay are those of all rows. The dictionary takes the most frequent
    words, at most ``dictionary``."""
    spark = docs.sparkSession
    rows = docs.select(text_of(text_col).alias("text"), F.coalesce(fold, F.lit(False)).alias("fold"))
    words = cut(rows.select("text").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    texts = rows.count()
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # The words of at least a count, the least (of eight to an octave) of which no more than ``dictionary`` words have.
    octave = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("long")
    steps = sorted(((r["o"], r["k"]) for r in words.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)  # 512 at most
    within = [o for i, (o, _) in enumerate(steps) if sum(k for _, k in steps[: i + 1]) <= dictionary]
    top = words.where(octave >= within[-1]).orderBy(F.desc("n"), "word").collect() if within else []  # at most ``dictionary`` rows
    own = Coder.of([r["word"].encode() for r in top], [r["n"] for r in top], total - sum(r["n"] for r in top), texts)
    coder = spark.sparkContext.broadcast(own)
    pages = rows.mapInArrow(_pages(coder, slot_bits), "page int, side int, packed binary").repartition("page").mapInArrow(_folded, "page int, side int, packed binary")
    counts = np.zeros((2, (CONTEXTS << slot_bits) // PAGE, 2 * PAGE), np.int32)
    for r in pages.toLocalIterator():  # as many pages as the model has, whatever the input
        counts[r["side"], r["page"]] = np.minimum(_unpacked(r["packed"]), 2**31 - 1)
    counts = counts.reshape(2, CONTEXTS, 1 << slot_bits, 2)
    first = spark.sparkContext.broadcast(Mix.of(counts[0]))
    flat = rows.where("fold").mapInArrow(_learned(coder, first, slot_bits), "at int, value double, weight double")
    flat = {r["at"]: (r["value"], r["weight"]) for r in flat.groupBy("at").agg(F.sum("value").alias("value"), F.sum("weight").alias("weight")).collect()}
    weights = hits = None
    if flat:
        k = 2 * GATES * CONTEXTS
        weights = np.array([flat[i][0] / flat[i][1] for i in range(k)]).reshape(2, GATES, CONTEXTS)
        hits = np.array([flat[k + i][0] for i in range(4 * PLACES)]).reshape(2, PLACES, 2)
    mix = spark.sparkContext.broadcast(Mix.of(counts[0] + counts[1], weights, hits))
    return Model(coder, mix, words, total + texts, distinct + (texts > 0), slot_bits)


def _scored(model: Model):
    coder, mix, slot_bits = model.coder, model.mix, model.slot_bits

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words, numbers in _blocks(batch, coder.value, 1 << 19):
                c = coder.value
                natural = sum(mix_bits(bits, mix.value, spelled, b - a)[0] for spelled, bits in enumerate(bits_of(words, numbers, c, slot_bits)))
                text = np.repeat(np.arange(b - a), words.counts)
                known = numbers[words.ids] < len(c.code) - 2
                logs = np.log10(c.counts[numbers[words.ids]] + 1.0)
                own = np.bincount(text, np.where(known, logs, 0), minlength=b - a) + np.log10(c.counts[-1] + 1.0)
                n_known = np.bincount(text, known, minlength=b - a).astype(np.int64) + int(c.counts[-1] > 0)
                key, n = np.unique(text[~known] * len(words.distinct) + words.ids[~known], return_counts=True)
                others = np.bincount(key // max(1, len(words.distinct)), n, minlength=b - a).astype(np.int64)
                size = np.bincount(text, words.end - words.start + 1, minlength=b - a).astype(np.int64) + 1
                rare = pa.StructArray.from_arrays([words.distinct.take(pa.array(key % max(1, len(words.distinct)))).cast(pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))], ["word", "n"])
                ends = np.searchsorted(key, np.arange(b - a + 1) * max(1, len(words.distinct)))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc").slice(a, b - a), batch.column("t").slice(a, b - a), pa.array(words.counts.astype(np.int64) + 1), pa.array(n_known), pa.array(own), pa.array(others),
                    pa.array(natural / np.log(10)), pa.array(size), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare)],
                    names=["doc", "t", "n_tokens", "n_known", "own", "others", "score", "size", "rare"])

    return over


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_tokens`` (words and the end), ``n_known``, ``train_tokens``, ``base_score`` (log10
    probability by add-one word counts), ``score`` (log10 probability by the model) and ``bits_per_byte``.

    Words are runs of bytes other than space and tab to carriage return, A-Z lower-cased. Null and empty texts are an end
    alone. Ids may be null or repeat: rows stay rows, and rows that repeat id and text score alike. Texts of any length
    are scored whole. No rows in, no rows out; a model of no rows gives each bit even odds. Other columns are not read.
    Words outside the dictionary look up their counts in a join; each is rarer than any dictionary word, so none is hot.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_of(text_col)).alias("t"), text_of(text_col).alias("text"))
    each = cut(rows.mapInArrow(_scored(model), "doc long, t long, n_tokens long, n_known long, own double, others long, score double, size long, rare array<struct<word:string,n:long>>"))
    asked = each.select("doc", "t", F.explode("rare").alias("x")).select("doc", "t", "x.word", F.col("x.n").alias("k"))
    met = asked.join(model.words, "word", "left")
    known = F.col("n").isNotNull()
    sums = met.groupBy("doc", "t").agg(
        F.sum("k").alias("k"), F.sum(F.when(known, F.col("k")).otherwise(0)).alias("known"), F.sum(F.when(known, F.col("k") * F.log10(F.col("n") + 1.0)).otherwise(0.0)).alias("logs"))
    joined = each.drop("rare").join(sums.withColumnRenamed("doc", "d2").withColumnRenamed("t", "t2"), F.col("doc").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2")), "left")
    copies = F.coalesce(F.col("k") / F.col("others"), F.lit(1.0))  # rows that repeat id and text have asked together
    base = F.col("own") + F.coalesce(F.col("logs"), F.lit(0.0)) / copies - F.col("n_tokens") * F.log10(F.lit(float(model.tokens + model.distinct + 1)))
    return joined.select(
        F.col("doc").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce((F.col("known") / copies).cast("long"), F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score", (-F.col("score") / F.log10(F.lit(2.0)) / F.col("size")).alias("bits_per_byte"))
