"""Quality classifier: support vectors over naive Bayes features.

Features are indicators of byte n-grams, hashed to a fixed width. Each indicator is scaled by its class log-count
ratio, and a linear hinge-loss model is fitted to the scaled indicators by dual coordinate descent. The margin becomes
a probability by a logistic curve fitted to rows that the model has not seen.

The model is fitted on at most ``sample`` labelled rows, those with the smallest hash of the id. Scoring is one pass
over all texts with weights of a fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from signalloom.llm.wordhash import raw_bytes

WIDTH_BITS, NGRAM, SAMPLE, FOLDS = 16, 3, 12_000, 5


def features(data: np.ndarray) -> np.ndarray:
    """Sorted distinct hashed n-grams of one text's bytes; texts shorter than an n-gram are padded."""
    if len(data) < NGRAM:
        if not len(data):
            return np.zeros(0, np.int64)
        data = np.concatenate([data, np.zeros(NGRAM - len(data), np.uint8)])
    seen = np.zeros(1 << WIDTH_BITS, bool)
    for a in range(0, len(data) - NGRAM + 1, 1 << 20):
        part = data[a : a + (1 << 20) + NGRAM - 1].astype(np.uint32)
        gram = np.zeros(len(part) - NGRAM + 1, np.uint32)
        for j in range(NGRAM):
            gram = (gram << np.uint32(8)) ^ (gram >> np.uint32(24)) ^ part[j : len(gram) + j]
        seen[(gram * np.uint32(2654435761)) >> np.uint32(32 - WIDTH_BITS)] = True
    return np.flatnonzero(seen)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log of the smoothed share of each feature among class 1 over its share among class 0."""
    counts = np.ones((2, 1 << WIDTH_BITS))
    for row, label in zip(rows, labels, strict=True):
        counts[int(label), row] += 1
    shares = counts / counts.sum(1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = 20, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of the L2-regularised hinge loss; ``y`` is +1 or -1, ``cost`` the bound of each dual."""
    w, alpha = np.zeros((1 << WIDTH_BITS) + 1), np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + w[-1]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * y[i] * values[i]
                w[-1] += step * y[i]
                largest = max(largest, abs(step) * square[i])
        if largest < 1e-3:
            break
    return w


def logistic_curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through smoothed labels, by Newton steps."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margin * margin).sum() + 1e-6, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, float(np.log((n1 + 1) / (n0 + 1))))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 0.1) -> np.ndarray:
    """Weight per feature, then bias: score = 1 / (1 + exp(-(sum of weights + bias))). With one class or no rows: the
    smoothed share of class 1 for every text."""
    prior = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    out = np.zeros((1 << WIDTH_BITS) + 1)
    out[-1] = prior
    if len(set(labels.tolist())) < 2:
        return out
    kept_back = np.arange(len(rows)) % FOLDS == 0
    if len(set(labels[kept_back].tolist())) < 2:
        kept_back = np.zeros(len(rows), bool)
    use = np.flatnonzero(~kept_back)
    ratio = log_count_ratios([rows[i] for i in use], labels[use])
    scale = lambda row: ratio[row] / np.sqrt(max(1, len(row)))  # noqa: E731  texts of all lengths weigh alike
    y = np.where(labels == 1, 1.0, -1.0)
    share = np.array([(labels[use] == c).mean() for c in (0, 1)])
    w = dual_coordinate_descent([rows[i] for i in use], [scale(rows[i]) for i in use], y[use], cost / (2 * np.maximum(share, 1e-9))[labels[use].astype(int)])
    ask = np.flatnonzero(kept_back) if kept_back.any() else use
    margin = np.array([w[rows[i]] @ scale(rows[i]) + w[-1] for i in ask])
    a, b = logistic_curve(margin, labels[ask].astype(float))
    out[:-1] = a * w[:-1] * ratio
    out[-1] = a * w[-1] + b
    return out


@dataclass(frozen=True)
class Model:
    weights: object  # broadcast array of fixed size

    def score(self, text: Column) -> Column:
        """Probability of class 1; null texts count as empty."""
        weights = self.weights

        @F.arrow_udf("double")
        def run(texts: pa.Array) -> pa.Array:
            w = weights.value
            data, offsets = raw_bytes(texts)
            out = np.empty(len(texts))
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                row = features(data[a:b])
                out[i] = w[row].sum() / np.sqrt(max(1, len(row))) + w[-1]
            return pa.array(1 / (1 + np.exp(-np.clip(out, -500, 500))))

        return run(text)


def held_out(id_column: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 5, is 0 (null ids too)."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold. Labels that are null are left out; an id with
    several labels counts by their mean (0.5 and above: 1).

    Rows of ``docs`` that repeat an id are examples each; null and empty texts are examples of padding alone, long texts
    count whole. The sample takes labels in order of a hash of their id, ties by id. Without usable labels, or with labels
    of one class, the model gives every text the smoothed share of class 1. Other columns are not read.
    """
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label")))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # bounded, so it may be broadcast

    @F.arrow_udf("array<int>")
    def indicators(texts: pa.Array) -> pa.Array:
        data, offsets = raw_bytes(texts)
        return pa.array([features(data[a:b]).astype(np.int32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.list_(pa.int32()))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "label", indicators("text").alias("row"))

    def fitted(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("label", "ascending")])
        found = [x.values.to_numpy().astype(np.int64) for x in table["row"]]
        return pa.table({"weights": [fit(found, table["label"].to_numpy()).tobytes()]})

    got = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(fitted, "weights binary").collect()
    weights = np.frombuffer(got[0]["weights"]) if got else fit([], np.zeros(0, np.int64))
    return Model(docs.sparkSession.sparkContext.broadcast(weights))


def scored(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``held_out``, ``score``, ``predicted`` per row of ``docs``; only the text is an input of the score.

    Null texts score as empty ones, texts of any length whole; equal texts score alike, so repeated rows tie. Null ids are
    held out. No rows in, no rows out; other columns are not read.
    """
    return docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), model.score(F.col(text_col)).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
