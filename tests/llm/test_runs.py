import random

import numpy as np
import pytest

from signalloom.llm import queries, runs
from signalloom.llm.common import documents
from tests.llm import helpers


def some_words(rng):
    n = rng.choice([0, 1, 2, 23, 24, 25, rng.randint(30, 400)])
    letters = rng.choice([1, 2, 3, 60])
    words = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.6:
        period, a = rng.randint(1, max(1, n // 3)), rng.randrange(n)
        words = [words[min(a + (i - a) % period, n - 1)] if i >= a else w for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("least, times", [(24, 3), (4, 2), (6, 3), (1, 2)])
def test_runs_are_those_of_the_definition(least, times):
    rng = random.Random(least)
    for _ in range(60):
        texts = [some_words(rng) for _ in range(rng.randint(1, 6))]
        found = runs.runs_of([np.array(t, np.int64) for t in texts], least, times)
        assert [[tuple(map(int, r)) for r in f] for f in found] == [helpers.word_runs(t, least, times) for t in texts]


def test_grid_of_long_texts_lists_the_same_candidates(monkeypatch):
    rng = random.Random(5)
    texts = [np.array(some_words(rng) * 3, np.int64) for _ in range(20)]
    kept = runs.runs_of(texts, 24, 3)
    monkeypatch.setattr(runs, "TABLE", 8)
    for a, b in zip(kept, runs.runs_of(texts, 24, 3), strict=True):
        assert (a == b).all()


def test_grammar_extends_to_both_sides():
    rng = np.random.default_rng(3)
    for letters in (1, 2, 30):
        text = np.r_[0, rng.integers(1, letters + 1, 500), letters + 1]
        grammar = runs.Grammar(text)
        x, y = rng.integers(1, 400, 200), rng.integers(401, 501, 200)
        before, after = grammar.extension(x, y)
        for i in range(200):
            k = 0
            while text[x[i] + k] == text[y[i] + k]:
                k += 1
            b = 0
            while text[x[i] - 1 - b] == text[y[i] - 1 - b]:
                b += 1
            assert (before[i], after[i]) == (b, k)


def test_query_on_odd_rows(spark, tmp_path):
    line = "same line again and again "
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, line * 9), (5, line * 9), (5, line * 9), (6, "x " * 24), (7, "x " * 23), (-8, "ü€ ö " * 40 + "\x85  end"), (9, "a b " * 70_000)]
    rows += [(i, " ".join(f"w{(i * j) % 17}" for j in range(i))) for i in range(10, 70)]
    rows[-1] = (rows[-1][0], " ".join(f"v{j}" for j in range(200)))
    helpers.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    small = [r for r in got if r[0] != 9]
    assert small == sorted((helpers.periodic_row(*r) for r in rows if r[0] != 9), key=repr)
    assert len(got) == len(rows)
    one = next(r for r in got if r[0] == 9)
    assert one[1] >= 1


def test_no_rows_and_whole_results(spark):
    found = runs.periodic_runs(helpers.documents(spark, []))
    assert found.collect() == [] and found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    [r] = runs.periodic_runs(helpers.documents(spark, [(1, "p " + "a b c " * 9 + "q")])).collect()
    assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (29, [(1, 27, 3)], "p a b c q")


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted((tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect()), key=repr)
    assert got == sorted((helpers.periodic_row(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()), key=repr)
