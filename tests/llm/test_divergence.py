import re
from collections import Counter, defaultdict

import numpy as np

from signalloom.llm import divergence, queries
from tests.llm import helpers

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def expected(rows, least, ranks):
    """rows: (text, lang, source)."""
    held, counts = defaultdict(Counter), defaultdict(Counter)
    groups = {(lang or "", source or "") for _, lang, source in rows}
    for text, lang, source in rows:
        found = TERM.findall((text or "").translate(helpers.LOWER))
        held[lang or ""].update(set(found))
        counts[lang or "", source or ""].update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]
        own = {g[1]: {t: counts[g][t] for t in kept} for g in groups if g[0] == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        shares, q = {s: p(c) for s, c in own.items()}, p(whole)
        for s in own:
            pairs = [(o, sum(f(shares[s][t], shares[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, f(shares[s][t], q[t])) for t in kept if own[s][t] and shares[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ordered)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i % 3 or None, t, la, s, "x", 1, 2) for i, (t, la, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n long, docs long")


def test_odd_rows_against_the_definition(spark):
    words = ["a", "A", "über", "ÜBER", "naïve", "straße", "x" * 40, "x" * 40 + "y", "日本語", "ab", "abc", "abcd", "abcde", "É", "e\x00f", "b" * 9000]
    rng = np.random.default_rng(7)
    rows = [(" ".join(rng.choice(words, rng.integers(0, 12))) + rng.choice([" 1", "-", "_a@", ""]), la, s) for la, s in [("en", "s1"), ("en", "s2"), ("en", None), (None, "s1"), ("de", "z"), ("de", "Z")] for _ in range(14)]
    rows += [(None, "en", "only null"), ("", "fr", "s1"), ("12 34", "fr", "s2"), ("rare words", "it", "s1"), (None, None, None)] + [("again again", "en", "s1")] * 6
    for least in (1, 3, 10):
        got = sorted(tuple(r) for r in divergence.divergences(frame(spark, rows), least=least, ranks=4).collect())
        assert got == expected(rows, least, 4)


def test_full_filters_only_delay(spark, monkeypatch):
    rows = [(f"word{'abcdefgh'[i % 8]}{'xyz'[i % 3]} common", "en", f"s{i % 3}") for i in range(40)]
    monkeypatch.setattr(divergence, "bits_for", lambda n, most: 6)
    assert sorted(tuple(r) for r in divergence.divergences(frame(spark, rows), least=4).collect()) == expected(rows, 4, 10)


def test_large_counts_are_exact(spark):
    counts = np.array([[0, 3, 10**12, 7 * 10**12]])
    got = divergence._shares(counts, np.array([9 * 10**12] * 4))[0].tolist()
    assert got == [1 + 10**9 * (int(c) + 2) // (9 * 10**12) for c in counts[0]]
    rows = spark.createDataFrame([(int(c), 9 * 10**12 - 10, 5) for c in counts[0]], "n long, total long, terms long")
    assert [r[0] for r in rows.select(divergence.share(rows.n, rows.total, rows.terms)).collect()] == got


def test_no_rows(spark):
    assert divergence.divergences(frame(spark, [])).collect() == []
    assert "op12_source_divergence" in queries.ORACLE


def test_few_levels_read_every_text(spark, monkeypatch):
    read = []
    whole = divergence._prefixes
    monkeypatch.setattr(divergence, "_prefixes", lambda length, before, held: read.append(length) or whole(length, before, held))
    word = "abcdefghij" * 3  # 30 bytes
    rows = [(i, f"{word} {word[:9]} {word[:5]}", "en", "web") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {(r["term"], r["n"]) for r in divergence.kept_counts(docs).collect()} == {(word, 12), (word[:9], 12), (word[:5], 12)}
    assert len(read) <= 2
