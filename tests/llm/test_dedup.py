import random

import numpy as np
import pytest

from signalloom.llm import exact, jaccard, substring
from signalloom.llm.components import components
from tests.llm import helpers

LINE = " ".join(f"w{i}" for i in range(60))
ODD = [
    (None, "x y"), (None, "x y"), (-1, None), (-2, ""), (-3, "   \n"), (-5, "X Y"), (-6, LINE), (-6, LINE), (-4, "q " + LINE + " z"),
    (-9, "  u\x1cv " + LINE.replace(" ", "\n", 30) + " z"), (-7, " ".join(f"v{i}" for i in range(41))), (-8, " ".join(f"v{i}" for i in range(40))),
    (-8, " ".join(f"v{i}" for i in range(42))), (90, "a " * 500), (91, "a " * 30 + LINE[:150]), (92, "é" * 70_000), (93, "That it."), (94, "ÀB c"), (95, "àb c"),
]


def corpus(n=150, seed=3, start=0):
    """Random texts with copies, near copies (a hot group of a third) and shared passages. From 0, some ids repeat."""
    r = random.Random(seed)
    fresh = lambda k: [f"t{r.randrange(400)}" for _ in range(k)]
    base, passage, rows = fresh(120), fresh(30), list(ODD)
    for i in range(n):
        kind = i % 6
        if kind < 2:
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"e{r.randrange(9)}"
        elif kind == 2:
            w = fresh(r.randrange(60)) + passage + fresh(r.randrange(60))
        elif kind == 3 and rows:
            w = (rows[r.randrange(len(rows))][1] or "").split(" ")
        else:
            w = fresh(r.choice([1, 3, 9, 12, 40, 200]))
        rows.append((start + i, " ".join(w)))
    return rows


def test_exact_groups(spark):
    rows = corpus()
    got = exact.exact_duplicates(helpers.documents(spark, rows)).toPandas()
    found = sorted((str(helpers.whole(a)), str(helpers.whole(b)), int(c), bool(d)) for a, b, c, d in got[["doc_id", "keep_id", "group_size", "kept"]].itertuples(index=False))
    assert found == sorted((str(a), str(b), c, d) for a, b, c, d in helpers.exact_groups(rows))


def test_exact_drop_keeps_columns(spark):
    rows = corpus()
    docs = helpers.documents(spark, rows)
    left = exact.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(str(r[0]) for r in left.select("doc_id").collect()) == sorted(str(k) for k in helpers.exact_keepers(rows))


@pytest.mark.parametrize("width", [9, 20, 58, 63])
def test_quotient_filters_merge_without_loss(width):
    r = np.random.default_rng(width)
    parts = [r.integers(0, 1 << min(width, 9), 400).astype(np.uint64) << np.uint64(max(0, width - 9)) for _ in range(4)]
    parts += [r.integers(0, 1 << width, 300).astype(np.uint64), np.zeros(0, np.uint64), np.repeat(np.uint64(5), 70_000), np.full(3, (1 << width) - 1, np.uint64)]
    merged = exact.CountingQuotientFilter.of(width, parts[0])
    for p in parts[1:]:
        merged = exact.CountingQuotientFilter.from_bytes(exact.CountingQuotientFilter.of(width, p).to_bytes()).merge(merged)
    numbers, counts = np.unique(np.concatenate(parts), return_counts=True)
    got = merged.items()
    assert (got[0] == numbers).all() and (got[1] == counts).all()
    assert merged.occupied.sum() == merged.run_end.sum()  # one run for each quotient
    assert len(merged.to_bytes()) < 40 + 4 * len(merged.slots) + 8 * merged.used.sum()


@pytest.mark.parametrize("like", [(3, 9, 10), (5, 8, 10), (1, 1, 2)])
def test_jaccard_components(spark, like):
    rows = corpus()
    got = jaccard.jaccard_components(helpers.documents(spark, rows), jaccard.Similarity(*like)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, helpers.jaccard_components(rows, *like)))


def test_near_copies_leave_one(spark):
    rows = [r for r in corpus(start=1_000) if r[0] != -8]
    docs = helpers.documents(spark, rows)
    left = jaccard.one_of_each(docs, jaccard.Similarity(5, 8, 10))
    assert left.columns == docs.columns
    found = list(zip(rows, helpers.jaccard_components(rows, 5, 8, 10), strict=True))
    want = [str(c) for c in {c for _, (_, n, c) in found if n}] + [str(d) for d, _ in {(d, t) for (d, t), (_, n, _) in found if not n}]
    assert sorted(str(r[0]) for r in left.select("doc_id").collect()) == sorted(want)


def test_words_and_ids_that_weak_names_confuse(spark):
    one = two = "a"
    other = {"a": "b", "b": "a"}
    for _ in range(10):  # Thue-Morse words: equal under every polynomial hash modulo 2^64
        one = one + "".join(other[c] for c in one)
    two = "".join(other[c] for c in one)
    ends = (-(1 << 63), (1 << 63) - 1)
    rows = [(1, one), (2, two), (ends[0], LINE), (ends[1], LINE + " more"), (ends[1], "alone"), (None, "far from all")]
    got = {(r[0], r[1]): r[2] for r in jaccard.jaccard_components(helpers.documents(spark, rows), jaccard.Similarity(3, 9, 10)).collect()}
    assert got == {(1, 1): 1, (2, 1): 2, (ends[0], 58): ends[0], (ends[1], 59): ends[0], (ends[1], 1): ends[1], (None, 1): None}
    before = "s1 " + " ".join(f"s{i}" for i in range(18))
    rows = [(ends[0], f"{before} {one}"), (ends[1], f"{before} {two}"), (None, f"{before} {two}")]
    for row in substring.without_repeats(helpers.documents(spark, rows)).collect():
        assert row["n_removed"] == (20 if row["doc_id"] == ends[1] else 0)


@pytest.mark.parametrize("hot_from", [20_000, 20])
def test_repeats_are_removed(spark, hot_from):
    rows = [r for r in corpus(start=1_000) if r[0] != -8]
    got = substring.without_repeats(helpers.documents(spark, rows), hot_from=hot_from).toPandas()
    found = sorted((str(helpers.whole(a)), int(n), int(m), k) for a, k, n, m in got[["doc_id", "kept", "n_words", "n_removed"]].itertuples(index=False))
    assert found == sorted((str(a), n, m, k) for a, n, m, k in helpers.without_repeats(rows))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)} | {201: 200}


def test_empty_tables(spark):
    docs = helpers.documents(spark, [])
    assert exact.exact_duplicates(docs).count() == 0
    assert jaccard.jaccard_components(docs).count() == 0
    assert substring.without_repeats(docs).count() == 0


def test_texts_of_pairs_need_one_worker_a_task(spark):
    """Texts are chosen where their sets are made; a second Python worker in each task held an executor's memory."""
    like = jaccard.Similarity(2, 5, 10)
    texts = jaccard._text(helpers.documents(spark, [(1, "a b c d e"), (2, "a b c d f"), (3, "g h i")]), "doc_id", "text")
    nodes = jaccard.named_sets(helpers.documents(spark, [(1, "a b c d e"), (2, "a b c d f"), (3, "g h i")]), like, "doc_id", "text").selectExpr("node", "n", "id rep")
    x, y = (nodes.where(f"rep = {i}").selectExpr(f"node {s}", f"n n{s}") for i, s in ((1, "x"), (2, "y")))
    links = jaccard.fragment_overlaps(texts, x.crossJoin(y), nodes, like)
    assert "ArrowEvalPython" not in links._jdf.queryExecution().executedPlan().toString()
    assert links.count() == 1


def test_large_sets_that_share_a_passage_are_told_apart_before_their_ngrams_travel(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(800))
    rows = [(d, f"{passage} " + " ".join(f"w{d}x{i}" for i in range(800))) for d in range(12)]
    rows += [(20 + d, " ".join(f"p{i}" for i in range(1_600 - 40 * d))) for d in range(6)]  # widths of bits differ at 1,024 n-grams
    rows += [(30 + d, " ".join(f"q{i}" for i in range(1_010 + 5 * d))) for d in range(6)]
    compared = []
    whole = jaccard.fragment_overlaps
    monkeypatch.setattr(jaccard, "fragment_overlaps", lambda texts, pairs, *more: compared.append(pairs.where("nx = ny and nx = 1596").count()) or whole(texts, pairs, *more))
    got = jaccard.jaccard_components(helpers.documents(spark, rows), jaccard.Similarity(5, 8, 10)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(helpers.jaccard_components(rows, 5, 8, 10))
    assert sum(compared) == 0


def test_windows_that_follow_one_another_are_one_phrase():
    letters = "".join(chr(200 + i) for i in range(40))
    assert substring._confirmed({letters[:33]: [(1, 0, 5), (2, 0, 0)]}) == {letters[:33]: (1, 0, 5)}
    # The second passage leaves the first after 24 words: its windows are told apart from the first one's later windows.
    got = substring._confirmed({letters[:30]: [(4, 0, 2), (5, 0, 0)], letters[:24] + "xyz": [(3, 0, 7)]})
    assert got == {letters[:24]: (3, 0, 7), letters[5:30]: (4, 0, 7)}
    # A window that follows itself stands for itself.
    assert substring._confirmed({"a" * 25: [(1, 0, 0)]}) == {"a" * 20: (1, 0, 0)}


def test_large_sets_that_share_a_passage_are_not_listed_for_its_keys(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(800))
    rows = [(d, f"{passage} " + " ".join(f"w{d}x{i}" for i in range(800))) for d in range(12)]
    rows += [(20 + d, " ".join(f"q{i}" for i in range(1_010 + 5 * d))) for d in range(6)]  # widths of bits differ at 1,024 n-grams
    listed, whole = [], jaccard._sifted

    def seen(pairs, wides, like):
        listed.append(pairs.count())
        return whole(pairs, wides, like)

    monkeypatch.setattr(jaccard, "_sifted", seen)
    got = jaccard.jaccard_components(helpers.documents(spark, rows), jaccard.Similarity(3, 9, 10)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, helpers.jaccard_components(rows, 3, 9, 10)))
    assert len(listed) == 2 and listed[1] == 0  # the first are pairs with the one set that all others of a key meet
    one = np.unique(np.random.default_rng(1).integers(0, 2**64, 3_000, dtype=np.uint64))
    bits = jaccard.narrow_parity(jaccard.wide_parity(one), len(one)).view(np.uint64)
    assert len(bits) == 64 and int(np.bitwise_count(bits).sum()) == int((np.bincount((one & np.uint64(4095)).astype(int), minlength=4096) & 1).sum())
