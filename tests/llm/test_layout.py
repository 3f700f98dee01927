import hashlib
import random
import zlib

from pyspark.sql import functions as F

from signalloom.llm import chat, sharding, topk
from tests.llm import helpers


def rows_with_a_hot_id(n=600, seed=4):
    r = random.Random(seed)
    rows = [(None, None), (None, "a"), (-1, ""), (-2, "é" * 3_000)]
    return rows + [(7 if i % 3 == 0 else i, "x" * r.randrange(1, 400)) for i in range(n)]


def test_shards_are_near_equal_and_slots_gapless(spark):
    rows = rows_with_a_hot_id()
    got = sharding.sharded(helpers.documents(spark, rows), shards=4).collect()
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    loads = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    assert max(loads) - min(loads) <= 0.02 * sum(loads)
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.sharded(helpers.documents(spark, [])).count() == 0


def test_rebalancing_edits_the_map(spark, tmp_path):
    rows = spark.range(5_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("y"), (F.col("id") % 50).cast("int")).alias("text"))
    sized = rows.select(sharding.slot_of(slots=256).alias("virtual_slot"), (F.octet_length("text") + 1).cast("long").alias("size"))
    sizes = sharding.slot_bytes(sized).cache()
    first = sharding.first_map(sizes, 4)
    path = str(tmp_path / "map")
    sharding.store_map(first, path)
    sharding.store_map(sharding.rebalanced(sharding.read_map(spark, path), sizes, 5), path)
    sharding.store_map(sharding.rebalanced(sharding.read_map(spark, path), sizes, 3), path)
    bytes_of = {r[0]: r[1] for r in sizes.collect()}
    maps = {v: {r["virtual_slot"]: r["shard"] for r in sharding.read_map(spark, path, v).collect()} for v in (1, 2, 3)}
    total = sum(bytes_of.values())
    for v, n in ((1, 4), (2, 5), (3, 3)):
        assert maps[v].keys() == bytes_of.keys() and set(maps[v].values()) == set(range(n))
        loads = [sum(bytes_of[x] for x, s in maps[v].items() if s == k) for k in range(n)]
        assert max(loads) - min(loads) <= 0.05 * total / n
    moved = sum(bytes_of[x] for x in bytes_of if maps[1][x] != maps[2][x])
    assert moved <= 1.2 * total / 5
    assert all(maps[2][x] == maps[3][x] for x in bytes_of if maps[2][x] < 3)


def test_events_fold_into_final_messages(spark):
    log = [
        (1, 0, 0, "open", "user", "hi "), (1, 0, 1, "delta", None, "there"), (1, 0, 1, "delta", None, "there"), (1, 1, 2, "open", "assistant", None),
        (1, 1, 4, "delta", None, "draft"), (1, 1, 5, "regenerate", None, "ignored"), (1, 1, 7, "delta", None, "B"), (1, 1, 6, "delta", None, "A"),
        (1, 2, 8, "open", "user", "typo"), (1, 2, 9, "edit", None, "fixed"), (1, 3, 10, "open", "assistant", "gone"), (1, 3, 11, "delete", None, None),
        (None, 0, 0, "open", None, "x"), (1, 4, 12, "unknown", "user", "?"),
    ]
    events = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")
    got = sorted((str(r["conv_id"]), r["message"], r["role"], r["text"]) for r in chat.final_messages(events).collect())
    assert got == [("1", 0, "user", "hi there"), ("1", 1, "assistant", "AB"), ("1", 2, "user", "fixed"), ("None", 0, "", "x")]


def test_formatting_reads_back(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "system", None), (1, 1, "assistant", "<turn:user>\\b\\l>"), (1, 1, "assistant", "<turn:user>\\b\\l>"),
            (2, 5, "user", "é\U0001f600"), (2, 3, "assistant", ""), (None, 0, "assistant", "x" * 50_000), (3, 0, None, "a")]
    talks = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, seq int")
    got = {r["conv_id"]: r for r in chat.digests(talks).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] or "", r[3] or ""))]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
    assert chat.digests(talks.limit(0)).count() == 0


def test_top_k_equals_brute_force(spark):
    r = random.Random(6)
    rows = [(i, [r.randrange(-20, 21) for _ in range(6)]) for i in range(300)] + [(300 + i, [9, 9, 9, 9, 9, 9]) for i in range(150)]
    rows += [(1000, [1, 2]), (1020, [3, 4]), (1040, [3, 4]), (1060, [])]
    table = spark.createDataFrame([(*x, 1, 2) for x in rows] + [(None, [1] * 6, 0, 0), (5000, None, 0, 0)], "vec_id long, embedding array<long>, id int, q int")
    for shard_rows, block_rows in ((10_000, 10_000), (60, 9)):
        got = topk.top_k(table, F.col("vec_id") % 20 == 0, 7, shard_rows=shard_rows, block_rows=block_rows).collect()
        assert sorted(map(tuple, got)) == helpers.top_k(rows, 7, lambda q: q % 20 == 0)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [0.5, -0.5]), (1, [float("nan"), 1.0]), (2, None), (3, [1.0, None]), (4, [float("inf"), 1.0]), (20, [0.3, -0.01])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = table.where(topk.usable(F.col("embedding"))).select("vec_id", topk.integer_vector(F.col("embedding")).alias("v")).collect()
    assert [(r[0], r[1]) for r in got] == [(0, [32, -32]), (20, [19, -1])]


def test_top_k_beyond_doubles(spark):
    big = 1 << 40
    rows = [(i, [big + i, -i]) for i in range(0, 60, 3)]
    table = spark.createDataFrame([(i, [v // (1 << 12) for v in x]) for i, x in rows], "vec_id long, embedding array<long>")
    want = helpers.top_k([(i, [v // (1 << 12) for v in x]) for i, x in rows], 5, lambda q: q % 20 == 0)
    assert sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 20 == 0, 5).collect())) == want
