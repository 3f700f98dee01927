import hashlib
import random

import corpus_pipeline
from signalloom.llm import mixing, quality
from tests.llm import helpers
from tests.llm.test_text import labelled


def corpus(spark):
    rows, labels, _ = labelled(spark)
    r = random.Random(9)
    base = [f"t{r.randrange(300)}" for _ in range(150)]
    rows += [(1_000 + i, " ".join(base[:i] + ["edit"] + base[i + 1 :])) for i in range(0, 90, 30)]
    rows += [(2_000 + i, rows[10 + i][1]) for i in range(20)] + [(3_000, "  ".join(rows[20][1].split()))]
    return rows, helpers.documents(spark, rows), labels


def ids(df):
    return sorted(str(r[0]) for r in df.select("doc_id").collect())


def test_stages_against_brute_force(spark, tmp_path):
    rows, docs, labels = corpus(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    place, text = str(tmp_path), dict(rows)
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]

    kept = corpus_pipeline.keep_quality(spark, docs, place)
    scored = quality.scored(docs, quality.train(docs, labels))
    assert ids(kept) == ids(scored.where("predicted = 1")) and kept.columns == docs.columns
    assert sum(d is not None and 0 <= d < 400 and d % 5 == 0 for d, _ in pairs(kept)) < 8
    assert sum(d is not None and 0 <= d < 400 and d % 5 != 0 for d, _ in pairs(kept)) > 312

    once = corpus_pipeline.drop_copies(spark, kept, place)
    assert ids(once) == sorted(str(d) for d in helpers.exact_keepers(pairs(kept))) and once.columns == docs.columns

    apart = corpus_pipeline.drop_near_copies(spark, once, place)
    found = list(zip(pairs(once), helpers.jaccard_components(pairs(once), 5, 8, 10), strict=True))
    want = [str(c) for c in {c for _, (_, n, c) in found if n}] + [str(d) for d, _ in {(d, t) for (d, t), (_, n, _) in found if not n}]
    assert ids(apart) == sorted(want)
    assert apart.columns == docs.columns

    mixed = corpus_pipeline.mix(spark, apart, place)
    rates = mixing.mixed(apart, mixing.quality_domains(labels))
    assert ids(mixed) == ids(mixing.drawn(apart, rates)) and mixed.columns == docs.columns

    tokens = corpus_pipeline.tokenize(spark, mixed, place).collect()
    encoder = helpers.reference_tokens()
    want = sorted((str(d), hashlib.sha256(",".join(map(str, encoder.encode_ordinary(t or ""))).encode()).hexdigest()) for d, t in pairs(mixed))
    assert sorted((str(r["doc_id"]), r["ids_sha256"]) for r in tokens) == want
    assert all(r["decoded_sha256"] == hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest() for r in tokens if r["doc_id"] is not None)


def test_run_gives_the_last_stage_of_all(spark, tmp_path):
    _, docs, labels = corpus(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got, now = corpus_pipeline.run(spark, str(tmp_path)), docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, now.collect()))


def test_empty_tables_give_an_empty_table(spark, tmp_path):
    helpers.documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
