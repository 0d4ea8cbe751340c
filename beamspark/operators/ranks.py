"""Exact ranks, quantiles and neighbours for groups of any size.

A plain ordered window would sort a whole group in one task. Here equal values are first added up, a large
group is cut at approximate quantiles, and only the short per-bucket totals are scanned in order; each
bucket then ranks its own values. Groups are counted by a job of its own when the plan is made. Results are exact: the
cuts only decide where the work goes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256
BISECTIONS = 8  # that halve 256 to one
SLICE_ROWS = 200_000
LARGE_KEYS = 10_000


def _large(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """(keys, _n) of the keys to cut: more than ``SLICE_ROWS`` rows and over one in ``LARGE_KEYS`` of all, so ``LARGE_KEYS`` at most."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > SLICE_ROWS)
    # A key must have more than SLICE_ROWS of all rows: whatever falls below is no large key, however many rows there are.
    every = df.count() if not counts.isEmpty() else 0
    found = counts.where(F.col("_n") * LARGE_KEYS > every).collect() if every else []
    return df.sparkSession.createDataFrame(found, counts.schema) if found else None


def _slices(df: DataFrame, keys: list[str], at: str, name: str) -> DataFrame | None:
    """Number of the slice of its key that a row's ``at`` lies in; nothing where no key is large.

    Keys are counted first, and only large ones are cut: one slice for every ``SLICE_ROWS`` rows, ``BUCKETS`` at most,
    in order of ``at``. Large keys and their cuts go by broadcast, and rows stay where they are.
    """
    large = _large(df, keys)
    if large is None:
        return None
    cuts = [i / BUCKETS for i in range(1, BUCKETS)]
    edges = df.join(F.broadcast(large), keys).groupBy(*keys).agg(F.first("_n").alias("_n"), F.percentile_approx(at, cuts, 10 * BUCKETS).alias("_cuts"))
    edges = edges.withColumn("_slices", F.least(F.lit(BUCKETS), F.ceil(F.col("_n") / SLICE_ROWS)).cast("int")).drop("_n")

    def halve(lo, half):
        return F.when(F.get("_cuts", lo + half - 1) < F.col(at), lo + half).otherwise(lo)

    steps = F.array(*(F.lit(BUCKETS >> k) for k in range(1, BISECTIONS + 1)))
    place = F.floor(F.aggregate(steps, F.lit(0), halve) * F.col("_slices") / BUCKETS).cast("int")
    out = df.join(F.broadcast(edges), keys, "left").withColumn(name, F.coalesce(F.when(F.col("_slices").isNotNull(), place), F.lit(0)))
    return out.drop("_cuts", "_slices")


def bucketed(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Add ``bucket``: a slice of each key's ``at`` values, in order of ``at``, and within it a finer slice.

    Slices that still hold more than ``SLICE_ROWS`` rows are cut once more, so that up to ``BUCKETS`` squared of them
    share a key's work. Where no key is large there is one slice, and the plan has no cut in it.
    """
    keys = list(keys)
    out = _slices(df, keys, at, "bucket")
    if out is None:
        return df.withColumn("bucket", F.lit(0))
    finer = _slices(out, [*keys, "bucket"], at, "finer")
    if finer is None:
        return out.withColumn("bucket", F.col("bucket") * BUCKETS)
    return finer.withColumn("bucket", F.col("bucket") * BUCKETS + F.col("finer")).drop("finer")


def lagged(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Add the previous row's ``value`` in ``order``; only bucket ends cross buckets."""
    keys = list(keys)
    b = bucketed(df, keys, order)
    ends = b.groupBy(*keys, "bucket").agg(F.max(F.struct(order, value))[value].alias("end"))
    ends = ends.withColumn("carry", F.lag("end").over(Window.partitionBy(*keys).orderBy("bucket"))).drop("end")
    inside = F.lag(value).over(Window.partitionBy(*keys, "bucket").orderBy(order))
    return b.join(ends, [*keys, "bucket"]).withColumn(name, F.coalesce(inside, "carry")).drop("carry", "bucket")


def cumulative(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """Distinct (keys, value) with ``w`` and the running total ``cum`` up to and including the value."""
    keys = list(keys)
    w = F.count(F.lit(1)) if weight is None else F.sum(weight)
    d = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(w.alias("w"))
    d = bucketed(d, keys, value)
    totals = d.groupBy(*keys, "bucket").agg(F.sum("w").alias("bw"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("prev", F.coalesce(F.sum("bw").over(before), F.lit(0))).drop("bw")
    inner = Window.partitionBy(*keys, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(totals, [*keys, "bucket"]).withColumn("cum", F.col("prev") + F.sum("w").over(inner))
    return out.drop("prev", "bucket")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles as columns q05, q50 ... of each group."""
    c = cumulative(df, keys, value)
    n = c.groupBy(*keys).agg(F.max("cum").alias("n"))
    c = c.join(n, list(keys))
    aggs = []
    for q in qs:
        pos = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.floor(pos), F.ceil(pos)
        at = lambda k: F.min(F.when(F.col("cum") > k, F.col(value)))
        frac = F.max(pos - lo)
        aggs.append((at(lo) + (at(hi) - at(lo)) * frac).alias(f"q{round(q * 100):02d}"))
    return c.groupBy(*keys).agg(*aggs)


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Smallest value whose running weight reaches half of the total."""
    c = cumulative(df.where(F.col(weight) > 0), keys, value, F.col(weight))
    total = c.groupBy(*keys).agg(F.max("cum").alias("total"))
    return c.join(total, list(keys)).where(F.col("cum") >= 0.5 * F.col("total")).groupBy(*keys).agg(
        F.min(value).alias("weighted_median"))
