"""State before each row (running sums, maxima, last values), safe for a hot key.

A plain ``Window.partitionBy(user)`` puts every row of one user into one task. Here a key that
holds many rows is split along the order axis into buckets of about as many rows each. Per bucket and key the totals are
pre-aggregated, running totals over the (few) buckets give a *carry* row that opens the next
bucket, and the windows then run per (key, bucket). All key families of one call share a single
exchange, because their windows start with the same base keys. The number of buckets of a hot
key is its row count over ``heavy_rows``; without hot keys the split costs one counting pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

HEAVY_ROWS = 2_000_000
#: Slices of a key at most.
QUANTILES = 256
#: Rows of the input that one task of a state's windows gets, about. Windows hold several sorted copies of wide rows.
TASK_ROWS = 100_000


@dataclass
class Family:
    """Measures kept per (base keys + ``keys``). Output columns carry the given names.

    ``ordered`` families process rows one by one in (at, tie-break) order; in the others rows with
    an equal ``at`` never see one another.
    """

    keys: Sequence[str] = ()
    ordered: bool = False
    sums: Mapping[str, Column] = field(default_factory=dict)
    maxs: Mapping[str, Column] = field(default_factory=dict)
    lasts: Mapping[str, Column] = field(default_factory=dict)


def load(df: DataFrame, base: Sequence[str], at: str, heavy_rows: int, task_rows: int = TASK_ROWS) -> tuple[DataFrame | None, int | None]:
    """The heavy keys, and over how many tasks windows of ``df`` are spread, from one counting pass.

    Tasks are as many as the rows ask for, so that a task's memory does not grow with the input: adaptive coalescing goes by
    compressed bytes, and sorted rows take some fifty times as many. None, the session's own number, where one task could
    hold all rows.

    Heavy keys are ``base, _bounds`` of keys with more than ``heavy_rows`` rows, or None where there are none. The bounds are quantiles of the key's own ``at``, so slices hold about as many rows each, however bursts or outliers
    spread them. Rows of one ``at`` stay together: in unordered families they must not see one another.
    """
    counts = df.groupBy(*base).agg(F.count(F.lit(1)).alias("_n"))
    rows, most = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    tasks = None if rows <= task_rows else max(-(-rows // task_rows), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if most <= heavy_rows:
        return None, tasks
    counts = counts.where(F.col("_n") > heavy_rows)
    fine = F.array(*[F.lit(i / QUANTILES) for i in range(1, QUANTILES)])
    hot = df.select(*base, at).join(counts.select(*base), list(base), "left_semi")
    marks = hot.groupBy(*base).agg(F.percentile_approx(at, fine, 20 * QUANTILES).alias("_marks")).join(counts, list(base))
    slices = F.least(F.lit(QUANTILES), F.ceil(F.col("_n") / heavy_rows)).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), slices - 1), lambda i: F.element_at("_marks", F.greatest(F.lit(1), F.least(F.lit(QUANTILES - 1), F.round(i * QUANTILES / slices)).cast("int"))))
    return cut_lineage(marks.select(*base, F.array_sort(F.array_distinct(cuts)).alias("_bounds"))), tasks


def heavy_keys(df: DataFrame, base: Sequence[str], at: str, heavy_rows: int) -> DataFrame | None:
    return load(df, base, at, heavy_rows)[0]


def dealt_by(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    return df.repartition(*keys) if tasks is None else df.repartition(tasks, *keys)


def detect(df: DataFrame, base: Sequence[str], heavy_rows: int = HEAVY_ROWS) -> str | None:
    """``"detect"`` if some key has more than ``heavy_rows`` rows, else None: the ``heavy`` argument for
    later states whose rows are a subset of ``df``."""
    n = df.groupBy(*base).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy_rows)
    return "detect" if n.limit(1).collect() else None


def crowded(df: DataFrame, base: Sequence[str], heavy_rows: int = HEAVY_ROWS) -> tuple[bool, int]:
    """Whether a key may have more than ``heavy_rows`` rows, and the number of rows.

    Rows are counted by hashes of their keys, of which there are few, so the pass ships next to nothing. Keys that share a
    hash are counted together, so a hot key is never missed.
    """
    cells = df.groupBy(F.pmod(F.xxhash64(*base), F.lit(1 << 16)).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    most, rows = cells.agg(F.coalesce(F.max("_n"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    return most > heavy_rows, rows


def slice_of(at: Column) -> Column:
    """Slice that ``at`` falls into by the ``_bounds`` of its row; 0 for light keys."""
    return F.coalesce(F.size(F.filter("_bounds", lambda b: b <= at)), F.lit(0)).cast("long")


def add_slice(df: DataFrame, base: Sequence[str], at: str, heavy: DataFrame | None) -> DataFrame:
    """Add ``_b``: 0 for light keys, else the row's slice of its key (and ``_bounds``, null for light keys)."""
    if heavy is None:
        return df.withColumn("_b", F.lit(0).cast("long"))
    # Each heavy key holds more than heavy_rows rows, so the list is short against the rows; its measured size decides
    # how it is joined.
    return df.join(heavy, list(base), "left").withColumn("_b", slice_of(F.col(at)))


def prior_state(
    df: DataFrame,
    base: Sequence[str],
    at: str,
    families: Sequence[Family],
    *,
    tie_break: Sequence[str | Column] = ("event_id",),
    heavy: DataFrame | None | str = "detect",
    heavy_rows: int = HEAVY_ROWS,
    co_partitioned: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Add, per family, the aggregates over earlier rows of the same keys. ``at`` must be a long.

    ``heavy`` is the result of ``heavy_keys`` where the caller already has it. ``co_partitioned``
    says the input is already hash-partitioned by ``base``, so a second exchange is left out. ``tasks``
    is what ``load`` gives with ``heavy``.
    """
    out_cols = df.columns
    if isinstance(heavy, str):
        heavy, tasks = load(df, base, at, heavy_rows)
    work = add_slice(df, base, at, heavy)
    measures: dict[str, Column] = {}
    for fam in families:
        for kind in (fam.sums, fam.maxs, fam.lasts):
            measures |= {f"{name}#": expr for name, expr in kind.items()}
    work = work.withColumns(measures)

    if heavy is None:
        part = list(base)
        stream = work if co_partitioned else dealt_by(work, tasks, *base)
    else:
        part = [*base, "_b"]
        stream = work.withColumn("_carry", F.lit(False))
        hot = work.where(F.col("_bounds").isNotNull())
        for fam in families:
            stream = stream.unionByName(_carry_rows(hot, base, at, fam, tie_break), allowMissingColumns=True)
        stream = dealt_by(stream, tasks, *part)

    for fam in families:
        w = Window.partitionBy(*part, *fam.keys)
        if fam.ordered:
            w = w.orderBy(at, *tie_break).rowsBetween(Window.unboundedPreceding, -1)
        else:
            w = w.orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
        over = {n: F.coalesce(F.sum(f"{n}#").over(w), F.lit(0)) for n in fam.sums}
        over |= {n: F.max(f"{n}#").over(w) for n in fam.maxs}
        over |= {n: F.last(f"{n}#", ignorenulls=True).over(w) for n in fam.lasts}
        stream = stream.withColumns(over)
    names = [n for fam in families for kind in (fam.sums, fam.maxs, fam.lasts) for n in kind]
    if heavy is not None:
        stream = stream.where(~F.col("_carry"))
    return stream.select(*[c for c in out_cols if c not in names], *names)


def _carry_rows(hot: DataFrame, base: Sequence[str], at: str, fam: Family, tie_break: Sequence[str | Column]) -> DataFrame:
    """One row per (key, slice) of the heavy keys that holds the state at the slice's start."""
    keys = [*base, *fam.keys]
    order = F.struct(at, *tie_break) if fam.lasts else None
    aggs = [F.sum(f"{n}#").alias(f"{n}#") for n in fam.sums]
    aggs += [F.max(f"{n}#").alias(f"{n}#") for n in fam.maxs]
    aggs += [F.max_by(f"{n}#", F.when(F.col(f"{n}#").isNotNull(), order)).alias(f"{n}#") for n in fam.lasts]
    totals = hot.groupBy(*keys, "_b").agg(F.min(at).alias("_first"), *aggs)
    slices = Window.partitionBy(*keys).orderBy("_b")
    w = slices.rowsBetween(Window.unboundedPreceding, -1)
    over = [F.sum(f"{n}#").over(w).alias(f"{n}#") for n in fam.sums]
    over += [F.max(f"{n}#").over(w).alias(f"{n}#") for n in fam.maxs]
    over += [F.last(f"{n}#", ignorenulls=True).over(w).alias(f"{n}#") for n in fam.lasts]
    return (
        totals.select(*keys, "_b", (F.col("_first") - 1).alias(at), *over, F.row_number().over(slices).alias("_nth"))
        .where("_nth > 1").drop("_nth").withColumn("_carry", F.lit(True))
    )


def one_row(df: DataFrame) -> Column:
    """The only row of an aggregate as a scalar-subquery struct."""
    return df.select(F.struct("*").alias("_row")).scalar()


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key. Spark plans a group limit before the exchange, so a hot key ships
    at most ``n`` rows per map task."""
    out = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")
