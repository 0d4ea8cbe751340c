"""Resampled stacks: event subsets, distance strata, pick jitter, scrambled distances, leave-one-out.

A design says which realisations a trace takes part in. It travels with the trace as an array, so one
pass over the traces feeds every realisation: subset designs share one shift per slowness and become a
matrix product, and only jittered or re-distanced designs shift again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beamspark import dims
from beamspark.functions import kernels
from beamspark.operators import peaks, ranks, stack
from beamspark.operators.traces import map_arrays

# ---- designs ---------------------------------------------------------------------------------


def seeded_subsets(n_events: int, n_real: int, seed: int) -> list[list[int]]:
    """Two thirds of a registered event list per realisation, drawn from the stated seed."""
    rng = np.random.default_rng(seed)
    take = max(2, int(np.floor(2.0 / 3.0 * n_events)))
    return [sorted(rng.choice(np.arange(n_events), size=take, replace=False).tolist()) for _ in range(n_real)]


def seeded_strata(distances: Sequence[float], n_real: int, seed: int) -> list[list[int]]:
    """Half of each draw from the 29-32 degree cluster and the rest from outside it."""
    d = np.asarray(distances, dtype=float)
    inside = (d >= dims.CLUSTER_MIN_DEG) & (d <= dims.CLUSTER_MAX_DEG)
    a, b = np.flatnonzero(inside), np.flatnonzero(~inside)
    take = max(2, int(np.floor(2.0 / 3.0 * len(d))))
    na = max(1, take // 2)
    if not len(a) or not len(b) or na > len(a) or take - na > len(b):
        raise ValueError("blocked_distance_cluster_pathology")
    rng = np.random.default_rng(seed)
    return [
        sorted([*rng.choice(a, na, replace=False).tolist(), *rng.choice(b, take - na, replace=False).tolist()])
        for _ in range(n_real)
    ]


def seeded_jitter(n_events: int, n_real: int, seed: int, limit_s: float = 10.0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([rng.uniform(-limit_s, limit_s, size=n_events) for _ in range(n_real)])


def seeded_permutations(n_events: int, n_real: int, seed_base: int) -> list[list[int]]:
    """Realisation 0 is the identity; realisation r draws from seed ``seed_base + r``, again if the identity comes out."""
    if n_events < 2:
        raise ValueError("a permutation null needs two events or more")
    same = list(range(n_events))
    out = [same]
    for r in range(1, n_real + 1):
        rng = np.random.default_rng(seed_base + r)
        draws = (rng.permutation(n_events).tolist() for _ in iter(int, 1))
        out.append(next(p for p in draws if p != same))
    return out


def rotated_distances(traces: DataFrame, lane: str, n_real: int, step: int) -> DataFrame:
    """Traces with ``members`` and ``distances``: a permutation null of each lane's own distances.

    In realisation r the event of rank k (by id) takes the distance of the one of rank k + r * step, counted
    around the lane, so that every realisation hands out the lane's distances once each; r = 0 changes nothing.
    Ranks come from counts per slice of a lane, and what is joined is one narrow row per event and realisation.
    """
    ids = traces.select(lane, "event_id", "distance")
    rank = ranks.cumulative(ids, [lane], "event_id").select(lane, "event_id", (F.col("cum") - 1).alias("rank"))
    placed = ids.join(rank, [lane, "event_id"]).join(ids.groupBy(lane).agg(F.count("*").alias("n")), lane)
    reals = F.explode(F.sequence(F.lit(0), F.lit(n_real - 1))).alias("real")
    asked = placed.select(lane, "event_id", "rank", "n", reals).withColumn("rank", F.pmod(F.col("rank") + F.col("real") * step, F.col("n")))
    given = asked.join(placed.select(lane, "rank", "distance"), [lane, "rank"])
    per = given.groupBy(lane, "event_id").agg(F.array_sort(F.collect_list(F.struct("real", "distance"))).alias("d"))
    per = per.select(lane, "event_id", F.col("d.real").alias("members"), F.col("d.distance").alias("distances"))
    return traces.join(per, [lane, "event_id"])


def scrambled_distances(traces: DataFrame, lane: str, n_sets: int, score, by: str = "distances") -> DataFrame:
    """Traces with ``distances``: a permutation null of each lane's own distances, one value for every set; set 0 changes nothing.

    In set r the event of rank k (by id) takes the distance of the one of rank k by ``score(r)``, an integer below 2**20 (ties by
    id). Ranks come from counts per slice of a lane, so that no lane is sorted in one task, and what is joined is
    narrow: traces meet one row per event.
    """
    ids = traces.select(lane, "event_id", "distance")
    rank = ranks.cumulative(ids, [lane], "event_id").select(lane, "event_id", (F.col("cum") - 1).alias("rank"))
    placed = ids.join(rank, [lane, "event_id"])
    if n_sets > 1:
        drawn = placed.select(lane, "event_id", "rank", "distance", F.explode(F.sequence(F.lit(1), F.lit(n_sets - 1))).alias("set"))
        drawn = drawn.select(lane, "set", "distance", (score(F.col("set")).cast("long") * F.lit(1 << 40) + F.col("rank")).alias("drawn"))
        order = ranks.cumulative(drawn, [lane, "set"], "drawn").select(lane, "set", "drawn", (F.col("cum") - 1).alias("rank"))
        given = drawn.join(order, [lane, "set", "drawn"]).select(lane, "set", "rank", "distance").join(placed.select(lane, "rank", "event_id"), [lane, "rank"])
        every = given.select(lane, "event_id", "set", "distance").unionByName(ids.withColumn("set", F.lit(0)))
    else:
        every = ids.withColumn("set", F.lit(0))
    per = every.groupBy(lane, "event_id").agg(F.array_sort(F.collect_list(F.struct("set", "distance"))).alias("d"))
    return traces.join(per.select(lane, "event_id", F.col("d.distance").alias(by)), [lane, "event_id"])


def design_table(spark: SparkSession, subsets: Sequence[Sequence[int]]) -> DataFrame:
    """(event_index, members) rows of a drawn design; its size is the registered event list."""
    by_event: dict[int, list[int]] = {}
    for r, picked in enumerate(subsets):
        for i in picked:
            by_event.setdefault(int(i), []).append(r)
    return spark.createDataFrame(sorted(by_event.items()), "event_index int, members array<int>")


def fidelity(level: str, n_bootstrap: int) -> dict:
    """Registered fidelity level; the realisation count must be the one it declares."""
    if level not in dims.BOOTSTRAP_FIDELITY:
        raise ValueError(f"Unknown bootstrap fidelity level {level!r}")
    count, published = dims.BOOTSTRAP_FIDELITY[level]
    if count != n_bootstrap:
        raise ValueError(f"{level} declares {count} realisations, got {n_bootstrap}")
    return {"level": level, "n_bootstrap": count, "published_equivalent": published,
            "published_n_bootstrap": dims.PUBLISHED_BOOTSTRAP_N}


SCORE_BUCKETS = 512  # counts of a lane and realisation, whatever its size; a five-hundredth of its rows is put in order


def with_subset_members(
    traces: DataFrame, lane: str, n_real: int, score, span: int, stratum: Column | None = None
) -> DataFrame:
    """Traces with ``members``: the realisations whose exact two-thirds subset of the lane has the trace.

    ``score(realisation)`` is an integer in [0, span) that orders the traces of a lane, the id settles
    ties, and the smallest are taken. A lane of fewer than two traces is refused. With ``stratum`` (a boolean: inside the cluster) half comes from
    inside and the rest from outside, and a lane that cannot supply either part is refused.

    Only bucket counts are shuffled: a trace knows from its own scores which realisations surely take
    or leave it, and the few that fall in the bucket on the limit are put in order.
    """
    width = max(1, -(-span // SCORE_BUCKETS))
    t = traces.withColumn("part", F.lit(True) if stratum is None else stratum)
    reals = F.sequence(F.lit(0), F.lit(n_real - 1))
    bucket = lambda r: F.floor(score(r) / F.lit(width))
    fan = t.select(lane, "part", "event_id", F.explode(reals).alias("real"))
    counts = fan.groupBy(lane, "part", "real", bucket(F.col("real")).alias("bucket")).agg(F.count("*").alias("bn"))
    size = t.groupBy(lane).agg(F.count("*").alias("n"), F.count_if("part").alias("n_in"))
    take = F.greatest(F.lit(2), F.floor(F.col("n") * 2 / 3)).cast("bigint")
    few = F.when(F.col("n") < 2, F.raise_error(F.lit("blocked_low_event_count")).cast("bigint"))
    if stratum is None:
        size = size.select(lane, F.coalesce(few, take).alias("want_in"), F.lit(0).cast("bigint").alias("want_out"))
    else:
        n_in = F.greatest(F.lit(1), F.floor(take / 2)).cast("bigint")
        short = (n_in > F.col("n_in")) | (take - n_in > F.col("n") - F.col("n_in"))
        guard = F.when(F.col("n") < 2, few).when(short, F.raise_error(F.lit("blocked_distance_cluster_pathology")).cast("bigint"))
        size = size.select(lane, F.coalesce(guard, n_in).alias("want_in"), (take - n_in).alias("want_out"))
    run = Window.partitionBy(lane, "part", "real").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    edge = counts.join(size, lane).withColumn("cum", F.sum("bn").over(run)).withColumn(
        "want", F.when(F.col("part"), F.col("want_in")).otherwise(F.col("want_out")))
    edge = edge.where(F.col("cum") >= F.col("want")).groupBy(lane, "part", "real").agg(
        F.min(F.struct("bucket", (F.col("want") - F.col("cum") + F.col("bn")).alias("left"))).alias("e"))
    edges = edge.groupBy(lane, "part").agg(F.map_from_entries(F.collect_list(F.struct("real", "e"))).alias("edges"))
    edges = edges.withColumn("edges", F.transform(reals, lambda r: F.col("edges")[r]))  # by place: no trace searches a map
    j = t.join(edges, [lane, "part"], "left")
    limit = lambda r: F.get("edges", r)
    j = j.withColumns({
        "sure": F.filter(reals, lambda r: F.coalesce(bucket(r) < limit(r)["bucket"], F.lit(True))),
        "open": F.filter(reals, lambda r: F.coalesce(bucket(r) == limit(r)["bucket"], F.lit(False)))})
    rows = j.where(F.size("open") > 0).select(lane, "part", "event_id", "edges", F.explode("open").alias("real"))
    rows = rows.select(lane, "part", "event_id", "real", score(F.col("real")).alias("score"), limit(F.col("real"))["left"].alias("left"))
    rn = F.row_number().over(Window.partitionBy(lane, "part", "real").orderBy("score", "event_id"))
    late = rows.withColumn("rn", rn).where(F.col("rn") <= F.col("left")).groupBy(lane, "event_id").agg(
        F.collect_list("real").alias("late"))
    out = j.join(late, [lane, "event_id"], "left")
    members = F.array_sort(F.concat("sure", F.coalesce("late", F.array().cast("array<int>"))))
    return out.withColumn("members", members).where(F.size("members") > 0).drop("part", "edges", "sure", "open", "late")


# ---- occupancy -------------------------------------------------------------------------------


def occupancy(
    grid: DataFrame, lanes: Sequence[str], windows: dict[str, tuple[float, float]], thresholds: Sequence[int],
    n_real: int, *, pre_s: float, sr: float, start: int = 0,
) -> DataFrame:
    """Share of realisations in which a cell reaches a percentage of that realisation's window peak.

    Works on the array rows of the grid: the window peak is a maximum of row maxima, and a cell becomes
    a row only where it passes the lowest threshold.
    """
    parts = []
    for phase, (a, b) in windows.items():
        lo = max(0, int(np.ceil((a + pre_s) * sr - 1e-9)) - start)
        hi = int(np.floor((b + pre_s) * sr + 1e-9)) - start
        vals = F.slice("power", F.lit(lo + 1), F.lit(max(0, hi - lo + 1)))
        parts.append(F.struct(F.lit(phase).alias("phase"), F.lit(lo + start).alias("t_off"), vals.alias("p"),
                              F.array_max(vals).alias("top")))
    rows = grid.select(*lanes, "real", "si", F.explode(F.array(*parts)).alias("w")).select(
        *lanes, "real", "si", F.col("w.phase").alias("phase"), "w.t_off", "w.p", "w.top")
    peak = F.max("top").over(Window.partitionBy(*lanes, "real", "phase"))
    rows = rows.withColumn("peak", peak).where(F.col("peak").isNotNull())
    levels = F.array(*[F.lit(int(t)) for t in thresholds])
    rows = rows.withColumn("thr", F.explode(levels))
    level = F.col("thr") / F.lit(100.0) * F.lit(1.0 - 1e-12) * F.col("peak")  # equal but for rounding is enough
    hits = F.filter(F.transform("p", lambda v, i: F.when(v >= level, i + F.col("t_off"))), lambda v: v.isNotNull())
    flat = rows.select(*lanes, "phase", F.col("thr").alias("threshold_pct"), "si", F.explode(hits).alias("ti"))
    return flat.groupBy(*lanes, "phase", "threshold_pct", "si", "ti").agg(
        (F.count("*") / F.lit(float(n_real))).alias("frac"))


def realisation_peaks(
    grid: DataFrame, lanes: Sequence[str], windows: dict[str, tuple[float, float]], *, pre_s: float, sr: float,
    start: int = 0, min_support: int = 1,
) -> DataFrame:
    """Peak of every realisation and phase with the support at its cell."""
    out = None
    for phase, (a, b) in windows.items():
        p = peaks.global_peak_of_rows(grid, [*lanes, "real"], a, b, pre_s=pre_s, sr=sr, start=start, min_support=min_support)
        p = p.withColumn("phase", F.lit(phase))
        out = p if out is None else out.unionByName(p)
    return out


def projections(occ: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Occupancy summed onto the time and the slowness axis in one grouping-sets pass."""
    sets = [[*map(F.col, keys), F.col("ti")], [*map(F.col, keys), F.col("si")]]
    return occ.groupingSets(sets, *keys, "ti", "si").agg(F.sum("frac").alias("weight"))


def count_components(si: np.ndarray, ti: np.ndarray) -> int:
    """Number of 4-connected groups among grid cells: runs along time, joined where rows touch."""
    order = np.lexsort((ti, si))
    si, ti = si[order], ti[order]
    cut = np.flatnonzero((np.diff(si) != 0) | (np.diff(ti) != 1)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(si)])) - 1
    parent = list(range(len(first)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    rows: dict[int, list[int]] = {}
    for i, f in enumerate(first):
        rows.setdefault(int(si[f]), []).append(i)
    for s, here in rows.items():
        below, j = rows.get(s - 1, []), 0
        for i in here:
            while j < len(below) and ti[last[below[j]]] < ti[first[i]]:
                j += 1
            k = j
            while k < len(below) and ti[first[below[k]]] <= ti[last[i]]:
                parent[root(i)] = root(below[k])
                k += 1
    return len({root(i) for i in range(len(first))})


def component_counts(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of 4-connected groups of (si, ti) cells per map; a map is bounded by its two axes."""
    maps = mask.groupBy(*keys).agg(F.collect_list("si").alias("si"), F.collect_list("ti").alias("ti"))
    return map_arrays(maps, list(keys), ["si", "ti"], "components bigint", lambda si, ti: (count_components(si, ti),))


def argmax_cell(occ: DataFrame, keys: Sequence[str]) -> DataFrame:
    top = F.max(F.struct("frac", (-F.col("si")).alias("nsi"), (-F.col("ti")).alias("nti")))
    return occ.groupBy(*keys).agg(top.alias("m")).select(
        *keys, (-F.col("m.nsi")).alias("si"), (-F.col("m.nti")).alias("ti"), F.col("m.frac").alias("frac"))


def fit_reasons(axis_min, axis_max, spacing) -> Column:
    """Reasons that make a projection fit unusable, in fixed order; an empty array means it stands.

    Reads mean, sigma, residual_rms, projection_peak, occupancy_argmax, weighted_median,
    fit_converged and fallback_used.
    """
    span, cell = F.abs(axis_max - axis_min), F.abs(spacing)
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)
    mean, sigma, resid, peak, amax, wmed = (
        finite(F.col(c)) for c in
        ("mean", "sigma", "residual_rms", "projection_peak", "occupancy_argmax", "weighted_median"))
    tolerance = F.greatest(F.lit(dims.FIT_ESTIMATOR_CELLS) * cell, F.lit(dims.FIT_ESTIMATOR_SPAN_SHARE) * span)
    spread = F.greatest(mean, amax, wmed) - F.least(mean, amax, wmed)
    missing = mean.isNull() | amax.isNull() | wmed.isNull()
    return F.array_compact(F.array(
        F.when(~F.col("fit_converged"), "optimizer_not_converged"),
        F.when(F.col("fallback_used"), "optimizer_fallback_used"),
        F.when(peak.isNull() | (peak <= 0), "nonpositive_projection_peak")
        .when(resid.isNull(), "residual_rms_unavailable").when(resid / peak > dims.FIT_RESIDUAL_SHARE, "residual_rms_fraction"),
        F.when(sigma.isNull() | (sigma <= 0), "sigma_unavailable").when(span <= 0, "axis_span_unavailable")
        .when(sigma > dims.FIT_SIGMA_SPAN_SHARE * span, "sigma_exceeds_axis_span_fraction"),
        F.when(missing, "tri_estimator_unavailable").when(spread > tolerance, "tri_estimator_inconsistency"),
    ))


def pick_table(
    occ: DataFrame, lanes: Sequence[str], *, slowness: Sequence[float], n_times: int, pre_s: float, sr: float
) -> DataFrame:
    """One row per map: Gaussian fits of both projections, robust estimates and the quality gate."""
    keys = [*lanes, "phase", "threshold_pct"]
    nodes, t = np.asarray(slowness, dtype=float), np.arange(n_times) / sr - pre_s
    # A map is bounded by the two axes, so one row can hold it however many realisations fed it.
    maps = occ.groupBy(*keys).agg(F.collect_list(F.struct("si", "ti", "frac")).alias("m")).select(
        *keys, F.col("m.si").alias("si"), F.col("m.ti").alias("ti"), F.col("m.frac").alias("frac"))

    def weighted_median(x, w):
        return float(x[np.searchsorted(np.cumsum(w), 0.5 * w.sum())])

    def summarise(si, ti, frac):
        grid = np.zeros((len(nodes), n_times))
        grid[si, ti] = frac
        best = np.unravel_index(np.argmax(grid), grid.shape)
        high = np.nonzero(grid >= dims.OCCUPANCY_PLATEAU_SHARE * grid.max())
        common = (float(grid[best]), len(frac), count_components(*high))
        out = []
        for axis, x, at, step in (("time", t, best[1], 1.0 / sr), ("slowness", nodes, best[0], np.median(np.diff(nodes)))):
            y = grid.sum(axis=0 if axis == "time" else 1)
            mean, sigma, ok, rms = (v[0] for v in kernels.gaussian_fit(x, y))
            out.append((axis, mean, sigma, bool(ok), not ok, rms, int(np.count_nonzero(y)), float(y.max()), float(x[at]),
                        weighted_median(x, y), float(x[0]), float(x[-1]), float(step), *common))
        return out

    rows = map_arrays(
        maps, keys, ["si", "ti", "frac"],
        "axis string, mean double, sigma double, fit_converged boolean, fallback_used boolean, residual_rms double, "
        "projection_nonzero_bins int, projection_peak double, occupancy_argmax double, weighted_median double, "
        "axis_min double, axis_max double, step double, occupancy_argmax_value double, occupied_cell_count int, "
        "high_occupancy_component_count int", summarise)
    rows = rows.withColumn("reasons", fit_reasons(F.col("axis_min"), F.col("axis_max"), F.col("step")))
    one = lambda a, c: F.max(F.when(F.col("axis") == a, F.col(c)))
    fields = ("mean", "sigma", "fit_converged", "residual_rms", "projection_nonzero_bins", "weighted_median",
              "occupancy_argmax")
    out = rows.groupBy(*keys).agg(
        *[one(a, c).alias(f"{c}_{a}") for a in ("time", "slowness") for c in fields],
        *[F.max(c).alias(c) for c in
          ("occupancy_argmax_value", "occupied_cell_count", "high_occupancy_component_count")],
        one("time", "reasons").alias("rt"), one("slowness", "reasons").alias("rs"))
    why = F.concat_ws(
        ";", F.when(F.size("rt") > 0, F.concat(F.lit("time:"), F.concat_ws("|", "rt"))),
        F.when(F.size("rs") > 0, F.concat(F.lit("slowness:"), F.concat_ws("|", "rs"))))
    return out.withColumns({
        "fit_quality_reasons": why, "degenerate_fit": (F.size("rt") > 0) | (F.size("rs") > 0)}).drop("rt", "rs")


# ---- leave-one-out ---------------------------------------------------------------------------

GROUP_TRACES = 400


def leave_one_out(
    traces: DataFrame, lane: str, slowness: Sequence[float], *, ref: float, sr: float, pre_s: float,
    window: tuple[float, float], power_window_s: float, min_support: int = dims.MIN_STACK_SUPPORT,
    order: float = dims.NTH_ROOT, group_traces: int = GROUP_TRACES,
) -> DataFrame:
    """Peak of the nth-root stack with each event held out.

    The held-out stack is the lane's total less the event's own shifted trace, so the work grows with
    the number of events and not with its square. Traces meet the totals in groups of bounded size: a
    large lane is split over many groups, each with its own copy of the lane's grid.
    """
    nodes = np.asarray(list(slowness), dtype=np.float64)
    samples = max(1, int(round(power_window_s * sr)))
    # Only the samples that the window and half a power window beside it read are ever stacked.
    first, last = stack.window_range(*window, pre_s, sr, power_window_s)
    first = max(0, first)
    total = stack.partial_stacks(traces, [lane], slowness, ref=ref, sr=sr, method="nth_root", order=order, time_range=(first, last))
    total = stack.sum_partials(total, [lane, "si"])
    share = F.ceil(F.count("*") / F.lit(group_traces)).cast("int").alias("groups")
    size = traces.groupBy(lane).agg(share)
    left = traces.select(lane, "event_id", "distance", "x", "valid").join(size, lane)
    left = left.withColumn("grp", F.pmod(F.xxhash64("event_id"), F.col("groups")).cast("int")).drop("groups")
    right = total.join(size, lane).withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    lane_type = traces.schema[lane].dataType.simpleString()
    id_type = traces.schema["event_id"].dataType.simpleString()

    def held_out(key: tuple, events: pa.Table, totals: pa.Table) -> pa.Table:
        by_si = np.argsort(totals.column("si").to_numpy())
        sums, counts = totals.column("acc0").combine_chunks(), totals.column("cnt").combine_chunks()
        n = len(sums[0]) if len(by_si) else 0
        acc, cnt = stack._ragged(sums, n, np.float64)[by_si], stack._ragged(counts, n, np.int64)[by_si]
        t = (np.arange(n) + first) / sr - pre_s
        inside = (t >= window[0]) & (t <= window[1])
        found = []
        for dist, x, ok in zip(events.column("distance").to_pylist(), events.column("x"), events.column("valid")):
            parts = stack._channels(
                np.asarray(x.values)[None, :], np.asarray(ok.values.to_numpy(zero_copy_only=False), dtype=bool)[None, :],
                "nth_root", order)
            best = (None, -1, -1, 0)
            for si, s in enumerate(nodes):
                roll = np.rint(np.array([-s * (dist - ref) * sr])).astype(np.int64)
                own, one = stack._shift_add(parts, roll, np.ones((1, 1)), first, first + n)
                c = cnt[si] - np.rint(one[0]).astype(np.int64)
                m = (acc[si] - own[0]) / np.maximum(c, 1)
                power, has = stack.tapered_power(np.sign(m) * np.abs(m) ** order, c >= min_support, samples)
                live = has & inside
                if live.any():
                    i = int(np.argmax(np.where(live, power, -np.inf)))
                    if best[0] is None or power[i] > best[0]:
                        best = (float(power[i]), si, i + first, int(c[i]))
            found.append(best)
        cols = [events.column(lane), events.column("event_id")]
        for k, typ in enumerate((pa.float64(), pa.int32(), pa.int32(), pa.int32())):
            cols.append(pa.array([f[k] for f in found], type=typ))
        return pa.Table.from_arrays(cols, [lane, "event_id", "power", "slow_idx", "time_idx", "support_count"])

    ddl = f"`{lane}` {lane_type}, event_id {id_type}, power double, slow_idx int, time_idx int, support_count int"
    out = left.groupBy(lane, "grp").cogroup(right.groupBy(lane, "grp")).applyInArrow(held_out, ddl)
    s = F.get(F.array(*[F.lit(float(v)) for v in nodes]), F.col("slow_idx"))
    found = F.col("power").isNotNull()
    return out.select(
        lane, "event_id", F.when(found, F.col("time_idx") / F.lit(sr) - F.lit(pre_s)).alias("time_s"),
        F.when(found, s).alias("slowness_sdeg"), "power", "slow_idx", "time_idx", "support_count",
        F.when(found, "ok").otherwise("blocked_low_support").alias("status"))
