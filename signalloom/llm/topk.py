"""Exact top-k inner product search with ball trees.

Candidates are dealt to shards by a hash of their id and queries to blocks; a task holds one shard and one block. It
builds a ball tree over its shard and walks it best node first: a node is left out when its largest possible inner
product (query . centre + |query| * radius) is below the query's k-th score so far. Each block first searches one home
shard; the k-th scores found there are shared with all other shards, whose walks start from them. Ties go to the
smaller id, so nodes are left out only strictly below the k-th score.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from signalloom.llm.common import cut

SHARD_ROWS, BLOCK_ROWS, LEAF = 16_384, 8_192, 256
#: Inner products below this are exact in doubles.
EXACT = float(1 << 52)


def integer_vector(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & whole, F.lit(False))


class BallTree:
    """Nodes over a permutation of the rows: [start, stop), centre, radius, children."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order, self.nodes, centres = np.arange(len(points)), [], []
        waiting = [(0, len(points), -1)]
        while waiting:
            start, stop, parent = waiting.pop()
            rows = points[self.order[start:stop]]
            centre = rows.mean(0)
            away = ((rows - centre) ** 2).sum(1)
            me = len(self.nodes)
            self.nodes.append([start, stop, float(np.sqrt(away.max())), -1, -1])
            centres.append(centre)
            if parent >= 0:
                self.nodes[parent][3 if self.nodes[parent][3] < 0 else 4] = me
            if stop - start > leaf and away.max() > 0:
                a = rows[away.argmax()]
                b = rows[((rows - a) ** 2).sum(1).argmax()]
                side = np.argsort(rows @ (b - a), kind="stable")  # halves along the two points furthest apart
                self.order[start:stop] = self.order[start:stop][side]
                middle = (start + stop) // 2
                waiting += [(middle, stop, me), (start, middle, me)]
        self.centres = np.array(centres)
        self.radii = np.array([n[2] for n in self.nodes])
        self.points = points[self.order]


def search(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query (scores, ids) of its best k rows among those scoring at least ``floor``, other than its own id."""
    if queries.shape[1] == 0:
        own = [ids[ids != q] for q in query_ids]
        return [(np.zeros(min(k, len(x)), np.int64), np.sort(x)[:k]) for x in own]
    tree = BallTree(points)
    ids = ids[tree.order]
    norms = np.sqrt((queries ** 2).sum(1))
    bounds = queries @ tree.centres.T + norms[:, None] * tree.radii
    bounds += 1e-6 + 1e-9 * np.abs(bounds)  # room for rounding; only ever keeps a node
    whole = float(np.abs(points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * points.shape[1] < EXACT
    exact_points = None if whole else tree.points.astype(object)
    out = []
    for i, query in enumerate(queries):
        kth, held, found = floor[i], 0, []
        best_s, best_i = np.empty(0, np.int64), np.empty(0, np.int64)
        heap = [(-bounds[i, 0], 0)]
        while heap and -heap[0][0] >= kth:
            _, n = heapq.heappop(heap)
            start, stop, _, left, right = tree.nodes[n]
            if left >= 0:
                for child in (left, right):
                    if bounds[i, child] >= kth:
                        heapq.heappush(heap, (-bounds[i, child], child))
                continue
            if whole:
                score = (tree.points[start:stop] @ query).astype(np.int64)
            else:
                score = np.array([max(min(int(s), 2**63 - 1), -(2**63)) for s in exact_points[start:stop] @ query.astype(object)], np.int64)
            good = np.flatnonzero((score >= kth) & (ids[start:stop] != query_ids[i]))
            found.append((score[good], ids[start:stop][good]))
            held += len(good)
            if held >= k:  # fold what was found into the best k
                s, d = (np.concatenate([b, *x]) for b, x in zip((best_s, best_i), zip(*found, strict=True), strict=True))
                top = np.lexsort((d, -s))[:k]
                best_s, best_i, found, held = s[top], d[top], [], 0
                if len(top) == k:
                    kth = max(kth, best_s[-1])
        if found:
            s, d = (np.concatenate([b, *x]) for b, x in zip((best_s, best_i), zip(*found, strict=True), strict=True))
            top = np.lexsort((d, -s))[:k]
            best_s, best_i = s[top], d[top]
        out.append((best_s, best_i))
    return out


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1 if rows and len(flat) else 0).astype(np.float64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
          shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of every query with all other rows.

    ``vector_col`` holds whole numbers (``integer_vector``); only vectors of the query's own length are compared. Rows
    with a null id or vector take no part. A query's own id is no candidate. Rows that repeat an id are candidates
    each, for other ids; as queries they count once (the least vector). Ties go to the smaller id; k may exceed the
    rows there are. No rows in, no rows out; other columns are not read.

    Shards and blocks are sized in rows, so their number follows the input and no task holds more than one of each.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q"))
    n, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // block_rows))
    dim, key = F.size("v").alias("dim"), F.xxhash64("id")
    candidates = rows.select(dim, F.pmod(key, F.lit(shards)).cast("int").alias("shard"), "id", "v")
    queries = (rows.where("q").groupBy("id").agg(F.min("v").alias("asked"))
               .select(F.size("asked").alias("dim"), F.pmod(F.hash("id"), F.lit(blocks)).cast("int").alias("block"), F.col("id").alias("query_id"), "asked"))

    def scored(at_home: bool, floors: DataFrame | None) -> DataFrame:
        wanted = F.explode(F.array(F.col("home")) if at_home else F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home")))
        meets = lambda: (spark.range(blocks).select(F.col("id").cast("int").alias("block")).withColumn("home", F.col("block") % shards)
                         .select("block", wanted.alias("shard")))  # pairs of numbers, not of rows
        left = candidates.join(meets(), "shard")
        right = queries.join(meets(), "block")
        right = right.withColumn("floor", F.lit(None).cast("long")) if floors is None else right.join(floors, "query_id", "left")

        def one(key: tuple, own: pa.Table, asks: pa.Table) -> pa.Table:
            if not own.num_rows or not asks.num_rows:
                return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
            floor = asks["floor"].to_numpy(zero_copy_only=False).astype(np.float64)
            floor[np.isnan(floor)] = -np.inf
            ask_ids = asks["query_id"].to_numpy()
            found = search(own["id"].to_numpy(), _matrix(own["v"], own.num_rows), ask_ids, _matrix(asks["asked"], asks.num_rows), k, floor)
            return pa.table({
                "query_id": np.repeat(ask_ids, [len(s) for s, _ in found]), "vec_id": np.concatenate([i for _, i in found]).astype(np.int64),
                "score": np.concatenate([s for s, _ in found]).astype(np.int64)})

        on = ("dim", "shard", "block")
        return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(one, "query_id long, vec_id long, score long")

    home = cut(scored(True, None))
    kth = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    found = home if shards == 1 else home.unionByName(scored(False, kth.select("query_id", "floor")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
