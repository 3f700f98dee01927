"""Mixing to target weights over soft domains.

A naive Bayes classifier, trained on the labelled table, gives every document a posterior over domains: each document
belongs to all domains in part. Document rates r >= 0 are then fitted by projected gradient so that the expected
tokens of each domain, sum of tokens * posterior * rate, meet their targets, starting from and staying close to 1.

Everything is DataFrame code. The classifier is a pair of arrays of fixed width, the gradient needs one number per
domain, and a rate is a function of the document's posterior and of the residuals so far, so an iteration is one
aggregation without a shuffle of documents.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from signalloom.llm.common import SPACES, cut, text_of

WIDTH, SAMPLE, SURE = 1 << 15, 12_000, 5.0


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(WIDTH)).cast("int")


def word_evidence(docs: DataFrame, labels: DataFrame, domains: Sequence[str], id_col: str, text_col: str, sample: int) -> tuple[list[Column], list[float], list[bool]]:
    """A constant array per domain but the first, the log odds that each word bucket adds to those of the rest, and the
    log odds of a text without any, and which domains there is evidence of: ``WIDTH`` numbers a domain, whatever the input. ``labels``: id, domain. At most ``sample`` labelled ids that ``docs`` has are used (smallest hash of the id), and class sizes count their rows. Buckets whose
    count is not ``SURE`` standard deviations above chance add 0."""
    known = labels.where(F.col("id").isNotNull() & F.col("domain").isin(*domains)).groupBy("id").agg(F.min("domain").alias("domain"))
    known = known.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    chosen = cut(known.orderBy(F.xxhash64("id"), "id").limit(sample))  # bounded, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id")
    seen = rows.select("domain", F.explode(F.array_distinct(F.transform(words(F.col("text")), bucket))).alias("b"))
    count = lambda d: F.count(F.when(F.col("domain") == d, 1)).cast("double").alias(d)
    table = cut(seen.groupBy("b").agg(*[count(d) for d in domains]))
    of_domain = dict(rows.groupBy("domain").count().collect())
    documents = sum(of_domain.values())
    priors = [math.log((of_domain.get(d, 0) + 1) / (documents + len(domains))) for d in domains]
    values, absent = [], []
    for d in domains[1:]:
        inside, outside = of_domain.get(d, 0), documents - of_domain.get(d, 0)
        seen_in, n = F.col(d), sum((F.col(x) for x in domains), F.lit(0.0))
        chance = n * (inside / max(1, documents))
        here, there = (seen_in + 0.5) / (inside + 1), (n - seen_in + 0.5) / (outside + 1)
        sure = seen_in - chance > SURE * F.sqrt(chance + 1)
        without = F.when(sure, F.log((1 - here) / (1 - there))).otherwise(0.0)
        values.append((F.when(sure, F.log(here / there)).otherwise(0.0) - without).alias(f"v_{d}"))
        absent.append(F.coalesce(F.sum(without), F.lit(0.0)).alias(d))
    every = docs.sparkSession.range(WIDTH).select(F.col("id").cast("int").alias("b")).join(table.select("b", *values), "b", "left")
    listed = lambda d: F.array_sort(F.collect_list(F.struct("b", F.coalesce(f"v_{d}", F.lit(0.0)).alias("v"))))
    text = lambda d: F.array_join(F.transform(listed(d), lambda x: F.round(x["v"], 4).cast("string")), ",").alias(d)
    found = every.agg(*[text(d) for d in domains[1:]]).first()
    start = table.agg(*absent).first()
    evident = [of_domain.get(domains[0], 0) > 0] + [of_domain.get(d, 0) > 0 and any(map(float, v.split(","))) for d, v in zip(domains[1:], found, strict=True)]
    return [F.split(F.lit(v), ",").cast("array<double>") for v in found], priors[:1] + [a + b for a, b in zip(priors[1:], start, strict=True)], evident


def posteriors(docs: DataFrame, arrays: Sequence[Column], priors: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``tokens`` (words) and ``p`` (a share per domain, in order; sums to 1) of each row of ``docs``."""
    fields = [f"s{i}" for i in range(len(arrays))]
    step = lambda acc, b: F.struct(*[(acc[f] + F.get(a, b)).alias(f) for f, a in zip(fields, arrays, strict=True)])
    said = words(text_of(text_col))
    sums = docs.select(F.col(id_col), F.size(said).alias("n"), F.aggregate(
        F.array_distinct(F.transform(said, bucket)), F.struct(*[F.lit(0.0).alias(f) for f in fields]), step).alias("s"))
    logits = [F.lit(priors[0])] + [F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(f"s.{f}") + priors[i + 1])) for i, f in enumerate(fields)]
    total = sum((F.exp(x) for x in logits), F.lit(0.0))
    return sums.select(id_col, F.col("n").cast("long").alias("tokens"), F.array(*[F.exp(x) / total for x in logits]).alias("p"))


def _stepped(p: Sequence[Column], pushes: Sequence[Sequence[float]]) -> Column:
    """A document's rate after projected gradient steps from 1."""
    if not pushes:
        return F.lit(1.0)
    taken = F.split(F.lit(",".join(repr(float(x)) for v in pushes for x in v)), ",").cast("array<double>")
    push = lambda k: sum((x * F.get(taken, k * len(p) + i) for i, x in enumerate(p)), F.lit(0.0))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(pushes) - 1)), F.lit(1.0), lambda rate, k: F.greatest(F.lit(0.0), rate - push(k)))


def fitted_rates(members: DataFrame, targets: Sequence[float], budget: float | None = None, tolerance: float = 1e-4, evident: Sequence[bool] | None = None) -> DataFrame:
    """``members`` (tokens, p) plus ``rate``.

    ``targets`` are nonnegative weights of the domains. Domains that are not ``evident`` have no goal: documents hold them in
    equal parts, so rates can't move their share. ``budget`` is the number of tokens wanted, by default as many as keep the
    first domain whole; documents of scarcer ones are then repeated. Least squares on domain totals relative to their goals.
    Empty input, no token or no evident domain at all: rates of 1.

    A step that doesn't lower the loss is shortened, in the end to a length that lowers it; so the last rates are the
    best. The fit ends, after however many steps, when targets are met or the projected gradient is small.
    """
    at = [i for i, t in enumerate(targets) if evident is None or evident[i]]
    weight = sum(targets[i] for i in at)
    targets = [targets[i] / weight for i in at] if weight else []
    d = range(len(targets))
    p = [F.get("p", F.lit(i)) for i in at[: len(targets)]]
    sums = members.agg(F.coalesce(F.sum("tokens"), F.lit(0)), *[F.coalesce(F.sum(F.col("tokens") * x), F.lit(0.0)) for x in p]).first()
    total, owned = float(sums[0]), [float(x) for x in sums[1:]]
    if not total or not targets:
        return members.withColumn("rate", F.lit(1.0))
    wanted = budget if budget is not None else next((o / t for o, t in zip(owned, targets, strict=True) if t > 0 and o > 0), total)
    goal = np.array([max(t * wanted, 1e-9 * total) for t in targets])

    def after(pushes: Sequence[Sequence[float]]) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, residuals, and overlaps of the domains among documents that can still move."""
        moved = F.when(F.col("rate") > 0, F.col("tokens")).otherwise(0)
        now = members.withColumn("rate", _stepped(p, pushes)).agg(*[F.sum(F.col("tokens") * x * F.col("rate")) for x in p], *[F.sum(moved * p[i] * p[j]) for i in d for j in d]).first()
        off = np.array(now[: len(p)], float) - goal
        return math.sqrt((off * off / goal).sum() / goal.sum()), off, np.array(now[len(p) :], float).reshape(len(p), -1)

    pushes: list[list[float]] = []
    loss, off, metric = after(pushes)
    # A plain gradient step of 1 / steepest lowers the loss, whichever documents are held at 0.
    steepest = max(float(np.linalg.eigvalsh(metric / np.sqrt(np.outer(goal, goal))).max()), 1e-300)
    own, plain = 1.0, 1.0  # lengths of the steps in the metric of the overlaps, given up once none helps, and of plain ones
    while loss >= tolerance:
        found, push = None, off
        full = np.linalg.solve(metric + 1e-6 * max(np.trace(metric), 1.0) * np.eye(len(p)), off)
        while own and (found is None or found[0] >= loss * (1 - 2e-2)):
            own = own / 4 if found else own
            own = own if own >= 1 / 64 else 0.0
            push = full * own
            found = after([*pushes, push.tolist()])
        if own:
            own = min(1.0, 2 * own)
        else:
            push = off / goal / steepest * plain
            found = after([*pushes, push.tolist()])
            while found[0] >= loss and plain > 1:
                plain = max(1.0, plain / 4)
                push = off / goal / steepest * plain
                found = after([*pushes, push.tolist()])
            plain *= 2
            if found[0] >= loss * (1 - 1e-6):  # what a plain step gains bounds the projected gradient
                break
        pushes.append(push.tolist())
        loss, off, metric = found
    return members.withColumn("rate", _stepped(p, pushes))


def quality_domains(labels: DataFrame) -> DataFrame:
    """id and domain of a table of quality and toxicity marks: toxic first, then junk, else clean; rows without either
    mark are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), "clean")
    return labels.select(F.col("doc_id").alias("id"), domain.alias("domain"))


#: Default weights of the domains of ``quality_domains``.
TARGETS: Mapping[str, float] = {"clean": 0.95, "toxic": 0.03, "junk": 0.02}


def mixed(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text",
          sample: int = SAMPLE, budget: float | None = None) -> DataFrame:
    """id, ``tokens``, ``p_<domain>`` and ``rate`` per row of ``docs``; ``labels``: id, domain.

    By default the first domain of ``targets`` stays whole and scarcer ones are repeated (see ``fitted_rates``). Null texts
    have no tokens; texts of any length count whole. Null or repeated ids and repeated rows stay rows of their own; rows with
    equal posteriors have equal rates. Without labelled rows all posteriors are equal. No rows in, no rows out. Other
    columns are not read.
    """
    names = list(targets)
    docs = docs.select(id_col, text_col)
    arrays, priors, evident = word_evidence(docs, labels, names, id_col, text_col, sample)
    members = cut(posteriors(docs, arrays, priors, id_col, text_col))
    found = fitted_rates(members, list(targets.values()), budget, evident=evident)
    return found.select(id_col, "tokens", *[F.get("p", F.lit(i)).alias(f"p_{n}") for i, n in enumerate(names)], "rate")


def drawn(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` as often as their rate says: its whole part, and once more where a hash of the id falls below
    the rest. All columns stay. Rows with a null id count once; repeated ids take their mean rate."""
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor("rate") + (part < F.col("rate") - F.floor("rate")).cast("int")
    wanted = rates.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.avg("rate").alias("rate")).select(F.col(id_col).alias("_id"), times.cast("int").alias("_n"))
    joined = docs.join(wanted, docs[id_col] == wanted["_id"], "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    return joined.where("_n > 0").withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("_n")))).select(*docs.columns)
