"""Peaks of the slowness-time grid: arg-max, boxes, ranks, neighbourhoods and the peak fact table.

Input is the long cell form (keys, si, s, ti, t, power, support) with null power where unsupported.
Ties go to the first cell in slowness order, then time order. Boxes are literal arrays that each cell
is tested against in place, so a point-in-box match is a generator and never a join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamspark import dims
from beamspark.dims import Box


def ordered_cell() -> Column:
    """Struct whose maximum is the row-major first cell of largest power."""
    return F.struct(
        F.col("power").alias("power"), (-F.col("si")).alias("nsi"), (-F.col("ti")).alias("nti"),
        F.col("s").alias("s"), F.col("t").alias("t"), F.col("support").alias("support"),
    )


def supported(min_support: int = dims.MIN_STACK_SUPPORT) -> Column:
    return F.col("power").isNotNull() & (F.col("support") >= min_support)


def in_box(t_min, t_max, s_min=None, s_max=None) -> Column:
    """Closed rectangle (or closed time window) membership."""
    hit = F.col("t").between(t_min, t_max)
    return hit if s_min is None else hit & F.col("s").between(s_min, s_max)


def global_peak(
    cells: DataFrame, keys: Sequence[str], t_min: float, t_max: float, min_support: int = dims.MIN_STACK_SUPPORT
) -> DataFrame:
    """Largest supported cell of a closed time window; a key with none keeps a row with its reason."""
    window = in_box(t_min, t_max)
    out = cells.groupBy(*keys).agg(
        F.count_if(window).alias("n_window"),
        F.max(F.when(window & supported(min_support), ordered_cell())).alias("p"),
    )
    return peak_columns(out, keys)


def global_peak_of_rows(
    grid: DataFrame, keys: Sequence[str], t_min: float, t_max: float, *, pre_s: float, sr: float, start: int = 0,
    min_support: int = dims.MIN_STACK_SUPPORT,
) -> DataFrame:
    """:func:`global_peak` straight from the array rows of a grid: each row offers its own best cell, so no
    cell becomes a row and only one candidate per slowness is shuffled."""
    time = lambda i: (i + start) / F.lit(float(sr)) - F.lit(float(pre_s))
    inside = lambda i: time(i).between(t_min, t_max)

    def offer(c: Column, i: Column) -> Column:
        cell = F.struct(c["power"].alias("power"), (-(i + start)).alias("nti"), time(i).alias("t"), c["support"].alias("support"))
        return F.when(inside(i) & c["power"].isNotNull() & (c["support"] >= min_support), cell)

    rows = grid.select(
        *keys, "si", "s", F.size(F.filter("support", lambda _, i: inside(i))).alias("n"),
        F.array_max(F.transform(F.arrays_zip("power", "support"), offer)).alias("c"))
    best = F.struct(F.col("c.power").alias("power"), (-F.col("si")).alias("nsi"), F.col("c.nti").alias("nti"),
                    F.col("s").alias("s"), F.col("c.t").alias("t"), F.col("c.support").alias("support"))
    out = rows.groupBy(*keys).agg(F.sum("n").alias("n_window"), F.max(F.when(F.col("c").isNotNull(), best)).alias("p"))
    return peak_columns(out, keys)


def peak_columns(df: DataFrame, keys: Sequence[str], counted: str = "n_window") -> DataFrame:
    """Unpack a peak struct into the result row: coordinates, indices, support, status and reason."""
    empty, low = F.col(counted) == 0, F.col("p").isNull()
    status = F.when(empty, "blocked_empty_window").when(low, "blocked_low_support").otherwise("ok")
    reason = (
        F.when(empty, "no_time_samples_in_window")
        .when(low, "no_finite_cells_meeting_minimum_support")
        .otherwise("")
    )
    return df.select(
        *keys, F.col("p.t").alias("time_s"), F.col("p.s").alias("slowness_sdeg"), F.col("p.power").alias("power"),
        F.coalesce(-F.col("p.nsi"), F.lit(-1)).alias("slow_idx"),
        F.coalesce(-F.col("p.nti"), F.lit(-1)).alias("time_idx"),
        F.coalesce(F.col("p.support"), F.lit(0)).alias("support_count"),
        status.alias("status"), reason.alias("excluded_reason"),
    )


def box_array(boxes: Sequence[Box]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(b.phase).alias("phase"), F.lit(b.label).alias("peak_label"),
            F.lit(float(b.t_min)).alias("t_min"), F.lit(float(b.t_max)).alias("t_max"),
            F.lit(float(b.s_min)).alias("s_min"), F.lit(float(b.s_max)).alias("s_max"),
        )
        for b in boxes
    ])


def box_peaks(
    cells: DataFrame, keys: Sequence[str], boxes: Sequence[Box], min_support: int = dims.MIN_STACK_SUPPORT
) -> DataFrame:
    """Peak and cell counts of every box in one pass; a box without cells still gives a row."""
    per_box = []
    for b in boxes:
        hit = in_box(b.t_min, b.t_max, b.s_min, b.s_max)
        per_box.append(F.struct(
            F.count_if(hit).alias("total"),
            F.count_if(hit & supported(min_support)).alias("valid"),
            F.max(F.when(hit & supported(min_support), ordered_cell())).alias("p"),
        ))
    agg = cells.groupBy(*keys).agg(F.array(*per_box).alias("b"))
    rows = agg.select(*keys, F.explode(F.arrays_zip(box_array(boxes).alias("box"), F.col("b"))).alias("z"))
    rows = rows.select(
        *keys, F.col("z.box.phase").alias("phase"), F.col("z.box.peak_label").alias("peak_label"),
        F.col("z.b.total").alias("box_total_cell_count"), F.col("z.b.valid").alias("box_valid_cell_count"),
        F.col("z.b.p").alias("p"),
    )
    extra = [*keys, "phase", "peak_label", "box_total_cell_count", "box_valid_cell_count"]
    return peak_columns(rows, extra, counted="box_total_cell_count")


def second_peak(
    cells: DataFrame, keys: Sequence[str], t_min: float, t_max: float, *,
    dt: float = dims.EXCLUSION_TIME_S, ds: float = dims.EXCLUSION_SLOWNESS,
    min_support: int = dims.MIN_STACK_SUPPORT,
) -> DataFrame:
    """Largest cell outside the exclusion box around the first peak; blocked when there is no first."""
    first = global_peak(cells, keys, t_min, t_max, min_support).select(
        *keys, F.col("time_s").alias("t1"), F.col("slowness_sdeg").alias("s1"), F.col("status").alias("st1")
    )
    near = (F.abs(F.col("t") - F.col("t1")) <= dt) & (F.abs(F.col("s") - F.col("s1")) <= ds)
    window = in_box(t_min, t_max)
    ok = window & supported(min_support) & ~near
    out = cells.join(first, list(keys)).groupBy(*keys).agg(
        F.count_if(window).alias("n_window"), F.first("st1").alias("st1"),
        F.max(F.when(ok, ordered_cell())).alias("p"),
    )
    blocked = F.col("st1") != "ok"
    rows = peak_columns(out.withColumn("n_window", F.when(blocked, 1).otherwise(F.col("n_window"))), [*keys, "st1"])
    return rows.select(
        *keys, "time_s", "slowness_sdeg", "power", "slow_idx", "time_idx", "support_count",
        F.when(F.col("st1") != "ok", "blocked_prerequisite_peak").otherwise(F.col("status")).alias("status"),
        F.when(F.col("st1") != "ok", "first_peak_unavailable").otherwise(F.col("excluded_reason")).alias(
            "excluded_reason"),
    )


def rank_and_quantile(
    cells: DataFrame, peaks: DataFrame, keys: Sequence[str], windows: dict[str, tuple[float, float]],
    min_support: int = dims.MIN_STACK_SUPPORT,
) -> DataFrame:
    """Background quantile over all finite cells and rank among supported cells of the phase window.

    ``peaks`` has a few rows per key, so each cell meets its key's peaks once and only counts leave.
    """
    p = peaks.select(*keys, "phase", "peak_label", F.col("power").alias("peak_power"))
    limits = F.create_map(*[
        v for ph, (a, b) in windows.items()
        for v in (F.lit(ph), F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")))
    ])
    slim = cells.where("power IS NOT NULL").select(*keys, "t", "power", "support")
    win = limits[F.col("phase")]
    ranked = F.col("t").between(win["lo"], win["hi"]) & (F.col("support") >= min_support)
    counts = slim.join(p.where("peak_power IS NOT NULL"), list(keys)).groupBy(*keys, "phase", "peak_label").agg(
        F.avg((F.col("power") <= F.col("peak_power")).cast("double")).alias("background_quantile"),
        F.count_if(ranked).alias("n_ranked"),
        F.count_if(ranked & (F.col("power") > F.col("peak_power"))).alias("n_above"),
    )
    out = peaks.join(counts, [*keys, "phase", "peak_label"], "left")
    rank = F.when(F.coalesce(F.col("n_ranked"), F.lit(0)) > 0, F.col("n_above") + 1).otherwise(F.lit(0))
    return out.withColumn("target_box_rank", rank).drop("n_ranked", "n_above")


def box_occupancy(
    cells: DataFrame, peaks: DataFrame, keys: Sequence[str], boxes: Sequence[Box],
    min_support: int = dims.MIN_STACK_SUPPORT, share: float = dims.OCCUPANCY_IN_BAND,
) -> DataFrame:
    """Share of a box's supported cells that reach ``share`` of its peak, and its supported fraction."""
    hits = cells.where(supported(min_support)).select(
        *keys, "power",
        F.explode(F.filter(box_array(boxes), lambda b: F.col("t").between(b["t_min"], b["t_max"])
                           & F.col("s").between(b["s_min"], b["s_max"]))).alias("b"),
    ).select(*keys, "power", F.col("b.phase").alias("phase"), F.col("b.peak_label").alias("peak_label"))
    ref = peaks.select(*keys, "phase", "peak_label", F.col("power").alias("ref"))
    band = hits.join(ref, [*keys, "phase", "peak_label"]).groupBy(*keys, "phase", "peak_label").agg(
        F.count_if((F.col("ref") > 0) & (F.col("power") >= F.lit(share) * F.col("ref"))).alias("n_band")
    )
    out = peaks.join(band, [*keys, "phase", "peak_label"], "left")
    total, valid = F.col("box_total_cell_count"), F.col("box_valid_cell_count")
    return out.select(
        *peaks.columns,
        F.when(total > 0, valid / total).otherwise(F.lit(0.0)).alias("box_supported_cell_fraction"),
        F.when(valid > 0, F.coalesce(F.col("n_band"), F.lit(0)) / valid).otherwise(F.lit(0.0)).alias(
            "box_occupancy_in_band"),
    )


def local_maxima(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flag cells at least as large as their 3x3 neighbourhood: a slowness pass, then a time pass."""
    over_s = Window.partitionBy(*keys, "ti").orderBy("si").rangeBetween(-1, 1)
    over_t = Window.partitionBy(*keys, "si").orderBy("ti").rangeBetween(-1, 1)
    banded = cells.withColumn("m1", F.max("power").over(over_s))
    wide = banded.withColumn("m2", F.max("m1").over(over_t)).drop("m1")
    return wide.withColumn(
        "is_local_max", F.coalesce(F.col("power") >= F.col("m2"), F.lit(False))
    ).drop("m2")


def sub_window_product(cells: DataFrame, keys: Sequence[str], windows: dict[str, tuple[float, float]]) -> DataFrame:
    """Cells of each phase window divided by that window's own largest power."""
    picks = F.filter(
        F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi"))
                  for p, (a, b) in windows.items()]),
        lambda w: F.col("t").between(w["lo"], w["hi"]),
    )
    sub = cells.select(*keys, "si", "ti", "power", F.explode(picks).alias("w")).select(
        *keys, F.col("w.phase").alias("phase"), "si", "ti", "power")
    top = sub.groupBy(*keys, "phase").agg(F.max("power").alias("top"))
    out = sub.join(top, [*keys, "phase"])
    return out.withColumn("rel_power", F.when(F.col("top") > 0, F.col("power") / F.col("top"))).drop("top")


def peak_facts(
    peaks: DataFrame, published: dict[str, tuple[float, float]], *,
    tolerances: dict[str, tuple[float, float]], median_error: Column, max_error: Column,
) -> DataFrame:
    """Distances to the published target, tolerances and their uncertainty-widened form.

    ``published`` and ``tolerances`` are keyed by ``phase/label``; labels that share a target repeat it.
    """
    key = F.concat_ws("/", "phase", "peak_label")

    def pick(table: dict[str, tuple[float, float]], i: int) -> Column:
        return F.create_map(*[v for k, p in table.items() for v in (F.lit(k), F.lit(float(p[i])))])[key]

    df = peaks.withColumns({
        "paper_time_s": pick(published, 0), "paper_slowness_sdeg": pick(published, 1),
        "tolerance_t": pick(tolerances, 0), "tolerance_s": pick(tolerances, 1),
        "median_distance_error_deg": median_error, "max_distance_error_deg": max_error,
    })
    df = df.withColumns({
        "dt_vs_paper_s": F.col("time_s") - F.col("paper_time_s"),
        "ds_vs_paper_sdeg": F.col("slowness_sdeg") - F.col("paper_slowness_sdeg"),
        "distance_uncertainty_moveout_s": F.abs("paper_slowness_sdeg") * F.col("median_distance_error_deg"),
    })
    ok = F.col("status") == "ok"
    folded = F.col("tolerance_t") + F.col("distance_uncertainty_moveout_s")
    near_s = F.abs("ds_vs_paper_sdeg") <= F.col("tolerance_s")

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    return df.withColumns({
        "grid_coordinate_miss_norm": F.sqrt(
            F.pow(F.col("dt_vs_paper_s") / F.col("tolerance_t"), 2.0)
            + F.pow(F.col("ds_vs_paper_sdeg") / F.col("tolerance_s"), 2.0)),
        "within_published_tolerance": flag(ok & (F.abs("dt_vs_paper_s") <= F.col("tolerance_t")) & near_s),
        "uncertainty_folded_time_tolerance_s": folded,
        "within_uncertainty_folded_tolerance": flag(ok & (F.abs("dt_vs_paper_s") <= folded) & near_s),
    }).drop("tolerance_t", "tolerance_s")


def normalization_lane(mode: Column, variant: Column) -> Column:
    return (
        F.when((mode == "paperfaith") & (variant == "A"), "headline_targeted_window_eq1")
        .when(variant == "C", "ablation_full_window")
        .when(variant == "B", "targeted_pkkp_window")
        .otherwise("unspecified")
    )


def box_family(
    cells: DataFrame, keys: Sequence[str], *, t_centers: Sequence[float], s_centers: Sequence[float],
    half_t: float, half_s: float, min_support: int = dims.MIN_STACK_SUPPORT,
) -> DataFrame:
    """Largest supported power and supported-cell count of every box of one size on a regular lattice.

    Separable: cells first fold into the time boxes that hold them (per slowness), and those partial
    maxima fold into the slowness boxes, so no cell is ever paired with the whole family.
    """
    t0, dt = float(t_centers[0]), float(t_centers[1] - t_centers[0])
    s0, ds = float(s_centers[0]), float(s_centers[1] - s_centers[0])

    def covering(v: Column, origin: float, step: float, half: float, count: int) -> Column:
        lo = F.greatest(F.lit(0), F.floor((v - half - origin) / step - 1).cast("int"))
        hi = F.least(F.lit(count - 1), F.ceil((v + half - origin) / step + 1).cast("int"))
        seq = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        # The sequence is one wider on both sides; the closed comparison itself decides membership.
        center = lambda i: F.lit(origin) + i.cast("double") * F.lit(step)
        return F.filter(seq, lambda i: (v >= center(i) - half) & (v <= center(i) + half))

    live = cells.where(supported(min_support)).select(
        *keys, "si", "s", "power", F.explode(covering(F.col("t"), t0, dt, half_t, len(t_centers))).alias("ic"))
    by_t = live.groupBy(*keys, "si", "s", "ic").agg(F.max("power").alias("power"), F.count("*").alias("n"))
    both = by_t.select(
        *keys, "ic", "power", "n", F.explode(covering(F.col("s"), s0, ds, half_s, len(s_centers))).alias("kc"))
    return both.groupBy(*keys, "ic", "kc").agg(
        F.max("power").alias("box_max_power"), F.sum("n").alias("n_supported_cells")
    ).withColumns({
        "t_center": F.lit(t0) + F.col("ic").cast("double") * F.lit(dt),
        "s_center": F.lit(s0) + F.col("kc").cast("double") * F.lit(ds),
    })


def range_maxima(values: np.ndarray, counted: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum (-inf where none) and number of the counted values in each closed index range, from one sparse table.

    Level j of the table holds maxima of runs of 2**j values; two runs that may overlap cover a range of any length.
    """
    n = len(values)
    table, runs = [np.where(counted, values, -np.inf)], 1
    while 2 * runs <= n:
        last = table[-1]
        table.append(np.maximum(last[:-runs], last[runs:]))
        runs *= 2
    lo, hi = np.clip(lo, 0, n), np.clip(hi, -1, n - 1)
    size = np.maximum(hi - lo + 1, 0)
    level = np.frexp(np.maximum(size, 1))[1] - 1
    best = np.full(len(lo), -np.inf)
    for j in np.unique(level[size > 0]):
        at = (level == j) & (size > 0)
        best[at] = np.maximum(table[j][lo[at]], table[j][hi[at] + 1 - (1 << j)])
    total = np.concatenate(([0], np.cumsum(counted)))
    return best, np.where(size > 0, total[np.maximum(hi + 1, 0)] - total[lo], 0)


def box_sweep(
    grid: DataFrame, keys: Sequence[str], *, t_centers: Sequence[float], s_centers: Sequence[float], half_t: float, half_s: float,
    pre_s: float, sr: float, min_support: int = dims.MIN_STACK_SUPPORT,
) -> DataFrame:
    """Every box of a family on the array rows of a grid: (keys, ic, kc, t_center, s_center, box_max_power, n_supported_cells).

    A two-dimensional range maximum in two steps: each slowness row answers all time ranges from one sparse table, and rows
    fold into the slowness boxes they lie in. What is shuffled is one array of time boxes per slowness row and box,
    whatever the number of samples. A box without supported cells gives a row with null power.
    """
    tc, sc = np.asarray(t_centers, dtype=float), [float(s) for s in s_centers]
    types = {f.name: f.dataType.simpleString() for f in grid.schema.fields}
    ddl = ", ".join(f"`{k}` {types[k]}" for k in keys)
    covering = F.array(*[F.struct(F.lit(k).alias("kc"), F.lit(s - half_s).alias("a"), F.lit(s + half_s).alias("b")) for k, s in enumerate(sc)])
    inside = F.filter(covering, lambda c: (F.col("s") >= c["a"]) & (F.col("s") <= c["b"]))

    def by_time(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            power, support = batch.column("power"), batch.column("support")
            offs, best, count = np.asarray(power.offsets), [], []
            values = np.asarray(power.values.to_numpy(zero_copy_only=False), dtype=float)
            enough = np.asarray(support.values)[support.offsets[0].as_py():] >= min_support
            for a, b in zip(offs[:-1], offs[1:]):
                t = np.arange(b - a) / sr - pre_s
                lo, hi = np.searchsorted(t, tc - half_t, "left"), np.searchsorted(t, tc + half_t, "right") - 1
                m, n = range_maxima(values[a:b], ~np.isnan(values[a:b]) & enough[a - offs[0]:b - offs[0]], lo, hi)
                best.append(m)
                count.append(n)
            shape = (len(best), len(tc))
            arrays = [np.reshape(best, shape), np.reshape(count, shape).astype(np.int64)]
            cols = [batch.column(k) for k in (*keys, "inside")] + [_arrays(v) for v in arrays]
            yield pa.RecordBatch.from_arrays(cols, [*keys, "inside", "m", "n"])

    rows = grid.select(*keys, F.transform(inside, lambda c: c["kc"]).alias("inside"), "power", "support")
    rows = rows.mapInArrow(by_time, f"{ddl}, inside array<int>, m array<double>, n array<bigint>")
    rows = rows.select(*keys, F.explode("inside").alias("kc"), "m", "n")
    none = grid.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(len(sc) - 1))).alias("kc"))
    rows = rows.unionByName(none.select("*", F.lit(None).cast("array<double>").alias("m"), F.lit(None).cast("array<bigint>").alias("n")))

    def fold(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, count, fields = np.full(len(tc), -np.inf), np.zeros(len(tc), dtype=np.int64), None
        for batch in batches:
            fields = batch.schema
            for m, n in zip(batch.column("m"), batch.column("n")):
                if m.is_valid:
                    np.maximum(best, np.asarray(m.values), out=best)
                    count += np.asarray(n.values)
        cols = [pa.array([k.as_py()], fields.field(c).type) for k, c in zip(key, (*keys, "kc"))]
        yield pa.RecordBatch.from_arrays([*cols, _arrays(best[None, :]), _arrays(count[None, :])], [*keys, "kc", "m", "n"])

    out = rows.groupBy(*keys, "kc").applyInArrow(fold, f"{ddl}, kc int, m array<double>, n array<bigint>")
    out = out.select(*keys, "kc", F.posexplode(F.arrays_zip("m", "n")).alias("ic", "c"))
    return out.select(
        *keys, "ic", "kc", F.get(F.array(*[F.lit(float(t)) for t in tc]), F.col("ic")).alias("t_center"),
        F.get(F.array(*[F.lit(s) for s in sc]), F.col("kc")).alias("s_center"),
        F.when(F.col("c.n") > 0, F.col("c.m")).alias("box_max_power"), F.col("c.n").alias("n_supported_cells"))


def _arrays(rows: np.ndarray) -> pa.ListArray:
    offsets = pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).reshape(-1)))


def overlaps(t: Column, s: Column, half_t: float, half_s: float, box: Box) -> Column:
    """Closed rectangle overlap of a centred box with a fixed one."""
    return (
        (t - half_t <= box.t_max) & (t + half_t >= box.t_min) & (s - half_s <= box.s_max) & (s + half_s >= box.s_min)
    )
