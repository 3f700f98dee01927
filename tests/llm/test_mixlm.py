import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalloom.llm import mixlm, queries
from signalloom.llm.common import documents
from signalloom.llm.wordhash import raw_bytes, words_of
from tests.llm import helpers

TEXTS = ["the cat sat on the mat", "", "The DOG sat", "zebra zebra \x0b übergang the", "a" * 300 + " mat", " the  the\tthe "]
NUMBERS = {b"the": 0, b"sat": 1, b"mat": 2, b"on": 3}
CODER = mixlm.Coder.of(list(NUMBERS), [9, 4, 3, 1], 5, 6)


def bits_of(texts):
    data, offsets = raw_bytes(pa.array(texts, pa.string()))
    words = words_of(data, offsets, lower=True)
    numbers = np.array([NUMBERS.get(w, len(CODER.code) - 2) for w in words.distinct.to_pylist()], np.int64)
    return mixlm.bits_of(words, numbers, CODER, 16)


def by_word(bits, i):
    """Bits and slots of each word of text ``i``: place to a list of (bit, slots)."""
    out = {}
    for k in np.flatnonzero(bits.text[bits.word] == i):
        out.setdefault(int(bits.place[bits.word[k]]), []).append((int(bits.bit[k]), [int(s[k]) for s in bits.slots]))
    return out


def test_codes_are_complete_and_prefix_free():
    for weights in ([1, 1], [5, 1, 1, 1], [10**9, 1, 2, 3, 10**6], list(range(1, 400))):
        code, length = mixlm.prefix_code(np.array(weights))
        assert sum(2.0**-n for n in length) == 1
        words = [format(c, f"0{n}b") for c, n in zip(code, length, strict=True)]
        assert not any(a != b and b.startswith(a) for a in words for b in words)


def test_bits_spell_the_text():
    own, spelled = bits_of(TEXTS)
    read = {format(c, f"0{n}b"): i for i, (c, n) in enumerate(zip(CODER.code, CODER.length, strict=True))}
    letters = {format(c, f"0{n}b"): i for i, (c, n) in enumerate(zip(CODER.byte_code, CODER.byte_length, strict=True))}
    names = [*NUMBERS, None, b""]
    for i, text in enumerate(TEXTS):
        words, far, out = by_word(own, i), by_word(spelled, i), []
        for place in sorted(words):
            word = names[read["".join(str(b) for b, _ in words[place])]]
            if word is None:
                code, held = "", []
                for b, _ in far[place]:
                    code += str(b)
                    if code in letters:
                        held.append(letters[code])
                        code = ""
                assert code == "" and held[-1] == 256
                word = bytes(held[:-1])
            out.append(word)
        assert out == [w.encode() for w in helpers.WORD.findall(text.translate(helpers.LOWER))] + [b""]


def test_contexts_know_earlier_words_only():
    for one, two in zip(bits_of(["the cat sat on"]), bits_of(["the cat sat mat zebra"]), strict=True):
        a, b = by_word(one, 0), by_word(two, 0)
        assert all(a.get(k) == b.get(k) for k in range(3))


@pytest.mark.parametrize("apart", [True, False])
def test_mixing_against_single_steps(apart):
    texts = [" ".join(t.split() * (100 if len(t) < 99 else 3)) for t in TEXTS]
    rng = np.random.default_rng(1)
    mix = mixlm.Mix.of(rng.integers(0, 4, (mixlm.CONTEXTS, 1 << 16, 2)), rng.random((2, mixlm.GATES, mixlm.CONTEXTS)), rng.integers(0, 3, (2, mixlm.PLACES, 2)).astype(float))
    lanes = [[i] for i in range(len(texts))] if apart else [list(range(len(texts)))]
    for spelled, bits in enumerate(bits_of(texts)):
        got = mixlm.mix_bits(bits, mix, spelled, len(texts), apart)[0]
        log = Counter()
        for lane in lanes:
            weights, hits = mix.weights[spelled].copy(), np.zeros((mixlm.PLACES, 2))
            mine = [k for k in range(len(bits.bit)) if bits.text[bits.word[k]] in lane]
            for step in sorted({int(bits.step[bits.word[k]]) for k in mine}):
                grads, more = {}, []
                for k in mine:
                    if bits.step[bits.word[k]] != step:
                        continue
                    held = [int(mix.table[c][bits.slots[c][k]]) for c in range(mixlm.CONTEXTS)]
                    x, bit = [(v >> 2) / 256 for v in held], int(bits.bit[k])
                    g = (held[0] & 3) * 4 + (held[2] & 3) if spelled else (held[1] & 3) * 4 + (held[2] & 3)
                    dot = max(-12, min(12, sum(w * v for w, v in zip(weights[g], x, strict=True))))
                    p = 1 / (1 + math.exp(-dot))
                    at = int(max(0, min(mixlm.PLACES - 1, (dot + 8) * mixlm.PLACES / 16)))
                    known = mix.hits[spelled, at].sum()
                    prior = (mix.hits[spelled, at, 1] + 0.5) / (known + 1) if known else p
                    final = (p + (hits[at, 1] + mixlm.PRIOR * prior) / (hits[at].sum() + mixlm.PRIOR)) / 2
                    final = min(max(final, 1e-5), 1 - 1e-5)
                    log[int(bits.text[bits.word[k]])] += math.log(final if bit else 1 - final)
                    grads.setdefault(g, []).append([(bit - p) * v for v in x])
                    more.append((at, bit))
                for g, each in grads.items():
                    weights[g] += mixlm.RATE / math.sqrt(len(each)) * np.sum(each, 0)
                for at, bit in more:
                    hits[at, bit] += 1
        for i in range(len(texts)):
            assert got[i] == pytest.approx(log[i], rel=2e-3, abs=2e-3)


def expected_base(rows):
    part = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7
    tokens = lambda t: [*helpers.WORD.findall((t or "").translate(helpers.LOWER)), None]
    counts = Counter(w for d, t in rows if part(d) != 2 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [(d, part(d) == 2, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for d, t in rows]


def same(got, want):
    order = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3], round(r[5], 6))
    for g, w in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert tuple(g[:5]) == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op11_context_mixing_lm(spark, sf).collect()
    same(got, expected_base([(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()]))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held) > -8  # log10; a word by bytes alone takes 15


def test_odd_rows_and_a_small_dictionary(spark):
    rows = [(1, None), (2, ""), (None, "some words here"), (3, "Same text twice, same"), (3, "Same text twice, same"), (3, "other text"), (4, "x" * 9000), (5, "\x85 ü € the the")] + [(i, f"the word number {i} of many") for i in range(6, 40)]
    docs = helpers.documents(spark, rows)
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    model = mixlm.train(docs.where(part != 2), part == 3, dictionary=5, slot_bits=14)
    got = mixlm.scored(docs, model).select("doc_id", (part == 2).alias("h"), "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    same(got, expected_base(rows))
    twice = [r["score"] for r in got if r["doc_id"] == 3 and r["n_tokens"] == 5]
    assert len(twice) == 2 and twice[0] == pytest.approx(twice[1])


def test_no_rows(spark):
    none = helpers.documents(spark, [])
    model = mixlm.train(none, F.lit(False), slot_bits=14)
    assert mixlm.scored(none, model).collect() == []
    [r] = mixlm.scored(helpers.documents(spark, [(1, "a b")]), model).collect()
    assert r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] < 0
