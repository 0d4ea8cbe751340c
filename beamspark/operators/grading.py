"""Grades, false-alarm rates, verdicts and decoy placement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of the two grades; the rider widens the first grade's spreads.
G1 = {"dt": 25.0, "dp": 1.2, "st": 10.0, "sp": 1.0, "occ": 0.50}
G2 = {"dt": 50.0, "dp": 2.0, "st": 50.0, "sp": 1.5, "occ": 0.45}
RIDER_FACTOR = 1.5
DECOY_RANGE = (60.0, 1160.0)
DECOY_CLEAR = 60.0
DECOY_SEPARATION = 100.0
DECOY_STEP = 75.0


EXACT_DIGITS = 6


def _units(value: str) -> Column:
    """A value of at most ``EXACT_DIGITS`` decimals as a whole number; more decimals are rounded, NaN is refused."""
    return F.round(F.col(value) * float(10**EXACT_DIGITS)).cast("bigint")


def exact_mean(value: str) -> Column:
    """Mean of numbers with few decimals from their exact sum, so that the order of rows does not show."""
    return F.sum(_units(value)).cast("double") / (F.count(value) * F.lit(float(10**EXACT_DIGITS)))


def exact_stddev_pop(value: str) -> Column:
    """Population standard deviation of numbers with few decimals from exact sums of values and squares."""
    n, x = F.count(value), _units(value)
    total = F.sum(x).cast("decimal(18,0)")
    squares = F.sum(x.cast("decimal(13,0)") * x.cast("decimal(13,0)")).cast("decimal(27,0)")
    spread = (n.cast("decimal(10,0)") * squares - total * total).cast("double")
    return F.sqrt(spread) / (n * F.lit(float(10**EXACT_DIGITS)))


def passes(limits: dict[str, float]) -> Column:
    """Location, tightness and occupancy checks of one statistics row."""
    return (
        (F.abs("dt") <= limits["dt"]) & (F.abs("dp") <= limits["dp"]) & (F.col("sigma_t") <= limits["st"])
        & (F.col("sigma_s") <= limits["sp"]) & (F.col("occupancy") >= limits["occ"])
    )


def grade(stats: DataFrame, keys: Sequence[str], peak_ok: Column) -> DataFrame:
    """Two grades per group from its type-1 row; the stricter also needs the type-3 row to agree."""
    rider = {**G1, "st": G1["st"] * RIDER_FACTOR, "sp": G1["sp"] * RIDER_FACTOR, "occ": 0.0}
    one, three = F.col("bootstrap_type") == "type1", F.col("bootstrap_type") == "type3"
    g = stats.groupBy(*keys).agg(
        F.bool_or(one).alias("has_type1"), F.bool_or(one & passes(G1)).alias("a"),
        F.bool_or(one & passes(G2)).alias("b"), F.bool_or(three & passes(rider)).alias("r"))
    g = g.where("has_type1").withColumns({
        "g1": F.col("a") & F.col("r") & peak_ok, "g2": F.col("b") & peak_ok})
    outcome = F.when(F.col("g1"), "DETECTED-G1").when(F.col("g2"), "DETECTED-G2").otherwise("NOT-DETECTED")
    return g.withColumn("outcome", outcome).drop("has_type1", "a", "b", "r")


def false_alarm_rates(graded: DataFrame, realisation: str, phase: str) -> DataFrame:
    """Fires and rates per phase, and per realisation with any phase firing."""
    sets = [[F.col(realisation), F.col(phase)], [F.col(realisation)]]
    per = graded.groupingSets(sets, realisation, phase).agg(
        F.bool_or("g1").alias("g1"), F.bool_or("g2").alias("g2"))
    out = per.groupBy(F.coalesce(F.col(phase), F.lit("any")).alias(phase)).agg(
        F.count("*").alias("n"), F.count_if("g1").alias("g1_fires"), F.count_if("g2").alias("g2_fires"))
    return out.withColumns({"far_g1": F.col("g1_fires") / F.col("n"), "far_g2": F.col("g2_fires") / F.col("n")})


def verdict(grade_name: Column, detected: Column, *rates: Column) -> Column:
    quiet = F.lit(True)
    for r in rates:
        quiet = quiet & F.coalesce(r < F.lit(1.0 / 3.0), F.lit(False))
    return (
        F.when(detected & quiet, F.when(grade_name == "G1", "RECOVERED-STRONG").otherwise("RECOVERED"))
        .when(detected, "METHOD-FRAGILE").when(quiet, "NOT-RECOVERED").otherwise("INCONCLUSIVE")
    )


def null_statistics(
    null: DataFrame, keys: Sequence[str], thresholds: dict[str, float], real: dict[str, float]
) -> DataFrame:
    """False-alarm rate, exceedance probability, maximum and missing count; a null never exceeds."""
    aggs = [F.count("*").alias("n_null")]
    for c, limit in thresholds.items():
        aggs += [(F.count_if(F.col(c) >= limit) / F.count("*")).alias(f"far_{c}"),
                 F.max(c).alias(f"{c}_max"), F.count_if(F.col(c).isNull()).alias(f"{c}_nan")]
    for c, value in real.items():
        aggs.append(((F.lit(1.0) + F.count_if(F.col(c) >= value)) / (F.count("*") + 1.0)).alias(f"p_{c}"))
    return null.groupBy(*keys).agg(*aggs)


def nearest_label(value: Column, features: dict[str, float]) -> Column:
    """Name of the closest feature; the first listed wins a tie."""
    pairs = F.array(*[
        F.struct(F.abs(value - F.lit(v)).alias("d"), F.lit(i).alias("i"), F.lit(k).alias("name"))
        for i, (k, v) in enumerate(features.items())])
    return F.array_min(pairs)["name"]


def robust_estimate(degenerate: Column, robust: Column, fitted: Column) -> Column:
    return F.when(degenerate, robust).otherwise(fitted)


def stability_status(dt: Column, ds: Column, max_dt: float = 20.0, max_ds: float = 1.5) -> Column:
    return F.when((F.abs(dt) > max_dt) | (F.abs(ds) > max_ds), "warning").otherwise("passed")


def sliding_bins(
    df: DataFrame, keys: Sequence[str], x: str, hit: str, *, first: float, step: float, bins: int, width: float
) -> DataFrame:
    """Mean of ``hit`` over overlapping half-open bins; each row names its own bins, so nothing is joined."""
    hi = F.floor((F.col(x) - first) / step).cast("int") + 1
    lo = F.ceil((F.col(x) - first - width) / step).cast("int") - 1
    seq = F.sequence(F.greatest(lo, F.lit(0)), F.greatest(F.least(hi, F.lit(bins - 1)), F.lit(0)))
    edge = lambda k: F.lit(first) + k.cast("double") * F.lit(step)
    mine = F.filter(seq, lambda k: (F.col(x) >= edge(k)) & (F.col(x) < edge(k) + width) & (k < bins))
    flat = df.select(*keys, hit, F.explode(mine).alias("k"))
    return flat.groupBy(*keys, "k").agg(F.avg(hit).alias("fraction")).withColumn("bin", edge(F.col("k")))


def decoy_walk(
    targets: DataFrame, key: str, center: str, *, shifts: Sequence[float], collisions: Sequence[float], max_k: int = 40
) -> DataFrame:
    """Decoy centres per target: walk away in fixed steps, reflect at the range ends, take the first clear spot.

    Each decoy depends on those already placed for the same target, so the walk is unrolled over the few
    shifts; targets are independent rows.
    """
    lo, hi = DECOY_RANGE

    df = targets.withColumn("placed", F.array().cast("array<double>"))
    out = []
    for i, shift in enumerate(shifts):
        sign = 1.0 if shift > 0 else -1.0
        df = df.withColumn("cand", F.transform(
            F.sequence(F.lit(0), F.lit(max_k)),
            lambda k: F.col(center) + F.lit(shift) + F.lit(DECOY_STEP * sign) * k))
        df = df.withColumn("cand", F.transform("cand", lambda c, k: F.struct(
            F.aggregate(F.sequence(F.lit(1), F.lit(8)), c, lambda a, _: F.when(a < lo, 2 * lo - a).when(
                a > hi, 2 * hi - a).otherwise(a)).alias("c"), k.alias("k"))))

        def clear(c):
            ok = (c["c"] >= lo) & (c["c"] <= hi) & (F.abs(c["c"] - F.col(center)) >= DECOY_CLEAR)
            for t in collisions:
                ok = ok & (F.abs(c["c"] - F.lit(t)) >= DECOY_CLEAR)
            return ok & ~F.exists("placed", lambda p: F.abs(p - c["c"]) < DECOY_SEPARATION)

        df = df.withColumn(f"hit{i}", F.try_element_at(F.filter("cand", clear), F.lit(1)))
        df = df.withColumn("placed", F.array_compact(F.concat("placed", F.array(F.col(f"hit{i}.c")))))
        out.append(F.struct(F.lit(i + 1).alias("decoy"), F.lit(float(shift)).alias("shift_s"),
                            F.col(f"hit{i}.c").alias("center_s"), F.col(f"hit{i}.k").alias("walk_steps")))
    return df.select(key, F.inline(F.array(*out)))
