"""Row-local trace steps. A trace is one row, so none of these shuffles.

Column builders stay in the JVM; the ``map_*`` steps hand Arrow batches to NumPy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from beamspark import dims
from beamspark.functions import kernels


def _rows(col: pa.Array) -> list[np.ndarray]:
    offs = np.asarray(col.offsets)
    vals = col.values.to_numpy(zero_copy_only=False)
    return [vals[a:b] for a, b in zip(offs[:-1], offs[1:])]


PIECE_BYTES = 1 << 20  # of input rows that are worked on and sent back together


def _pieces(batches: Iterator[pa.RecordBatch], size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes: what a step makes of a batch may be many times as large."""
    for rb in batches:
        rows = max(1, rb.num_rows * size // max(1, rb.nbytes))
        for i in range(0, rb.num_rows, rows):
            yield rb.slice(i, rows)


def map_arrays(
    df: DataFrame, keep: Sequence[str], inputs: Sequence[str], outputs: str, fn: Callable, *, tasks: int | None = None,
    batch: bool = False,
) -> DataFrame:
    """Apply ``fn(*arrays) -> tuple`` to each row; ``outputs`` is the DDL of the added columns.

    ``fn`` may return a list of tuples to give several rows per trace. With ``batch`` it gets the lists of
    many rows at once and returns one tuple per row. ``tasks`` deals the rows over that many tasks by the first kept
    column, for a few rows that are heavy to work on.
    """
    spark = df.sparkSession
    if tasks is not None:
        df = df.repartition(tasks, keep[0])
    kept = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    ddl = ", ".join([*kept, outputs])
    out = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    added = out.names[len(keep) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in _pieces(batches):
            cols = [
                _rows(rb.column(c)) if pa.types.is_list(rb.column(c).type)
                else rb.column(c).to_numpy(zero_copy_only=False)
                for c in inputs
            ]
            index, made = [], []
            results = fn(*cols) if batch else map(fn, *cols)
            for i, got in enumerate(results):
                got = got if isinstance(got, list) else [got]
                index += [i] * len(got)
                made += got
            picked = rb.select(list(keep)).take(pa.array(index, pa.int64()))
            arrays = list(picked.columns)
            for k, name in enumerate(added):
                arrays.append(pa.array([m[k] for m in made], type=out.field(name).type, from_pandas=True))
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(run, ddl)


def map_alike(
    df: DataFrame, keep: Sequence[str], inputs: Sequence[str], outputs: str, fn: Callable, *, alike: Sequence[str] = (),
    size: int = PIECE_BYTES,
) -> DataFrame:
    """``map_arrays`` for steps that take many rows at once: ``fn`` is called for rows whose lists have the same lengths
    and whose ``alike`` columns are equal, with lists as matrices (row, item) and other inputs as vectors.

    It returns the added columns as arrays (row, copy), or (row, copy, item) for lists: so many rows come of each row.
    """
    ddl = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), outputs])
    out = to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)
    added = out.names[len(keep) :]

    def taken(col: pa.Array, rows: np.ndarray) -> np.ndarray:
        if not pa.types.is_list(col.type):
            return col.to_numpy(zero_copy_only=False)[rows]
        offs = np.asarray(col.offsets)
        vals = col.values.slice(offs[0], offs[-1] - offs[0]).to_numpy(zero_copy_only=False)
        at = offs[:-1][rows] - offs[0]
        return vals[at[:, None] + np.arange(offs[rows[0] + 1] - offs[rows[0]])]

    def column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        if values.ndim == 2:
            return pa.array(values.ravel(), type=kind, from_pandas=True)
        offs = pa.array(np.arange(values.shape[0] * values.shape[1] + 1, dtype=np.int32) * np.int32(values.shape[2]))
        return pa.ListArray.from_arrays(offs, pa.array(values.ravel(), type=kind.value_type), type=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in _pieces(batches, size):
            cols = [rb.column(c) for c in inputs]
            sizes = [np.diff(np.asarray(c.offsets)) for c in cols if pa.types.is_list(c.type)]
            own = [rb.column(c).to_numpy(zero_copy_only=False) for c in alike]
            kinds, group = {}, np.stack([*sizes, *own], axis=1).tolist()
            for i, kind in enumerate(map(tuple, group)):
                kinds.setdefault(kind, []).append(i)
            for rows in map(np.array, kinds.values()):
                made = [np.ascontiguousarray(v) for v in fn(*(taken(c, rows) for c in cols))]
                picked = rb.select(list(keep)).take(pa.array(np.repeat(rows, made[0].shape[1])))
                yield pa.RecordBatch.from_arrays(
                    [*picked.columns, *(column(v, out.field(name).type) for v, name in zip(made, added))], names=out.names)

    return df.select(*dict.fromkeys([*keep, *inputs, *alike])).mapInArrow(run, ddl)


def masked_stats(x: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """count, mean and population deviation of the samples ``keep(value, index)`` selects."""
    picked = F.transform(x, lambda v, i: F.when(keep(v, i), v))

    def step(a: Column, v: Column) -> Column:
        n = a["n"] + 1
        d = v - a["mean"]
        mean = a["mean"] + d / n
        new = F.struct(n.alias("n"), mean.alias("mean"), (a["m2"] + d * (v - mean)).alias("m2"))
        return F.when(v.isNull(), a).otherwise(new)

    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(picked, start, step, lambda a: F.struct(
        a["n"].alias("n"), F.when(a["n"] > 0, a["mean"]).alias("mean"),
        F.when(a["n"] > 0, F.sqrt(a["m2"] / a["n"])).alias("std")))


def zscore(df: DataFrame, sr: float, pre_s: float, t_min: float, t_max: float) -> DataFrame:
    """Standardise each trace on the valid samples of a closed window; invalid samples become zero.

    ``norm_status`` refuses an empty window or one without variance.
    """
    t = lambda i: i.cast("double") / F.lit(sr) - F.lit(pre_s)
    stats = masked_stats(F.col("x"), lambda v, i: t(i).between(t_min, t_max) & F.get(F.col("valid"), i))
    out = df.withColumn("st", stats)
    status = F.when(F.col("st.n") == 0, "blocked_no_valid_samples").when(
        F.col("st.std") <= 0, "blocked_zero_variance").otherwise("ok")
    z = F.zip_with("x", "valid", lambda v, ok: F.when(
        ok, (v - F.col("st.mean")) / F.when(F.col("st.std") > 0, F.col("st.std"))).otherwise(F.lit(0.0)))
    return out.withColumns({"norm_status": status, "z": z})


def cut_zero_padded(start: Column, length: int, x: str = "x", valid: str = "valid") -> Column:
    """Samples [start, start + length) as (x, valid) arrays; what the trace lacks is zero and invalid."""
    i = lambda k: start + k
    inside = lambda k: (i(k) >= 0) & (i(k) < F.size(x))
    seq = F.sequence(F.lit(0), F.lit(length - 1))
    return F.struct(
        F.transform(seq, lambda k: F.when(inside(k), F.get(F.col(x), i(k))).otherwise(F.lit(0.0))).alias("x"),
        F.transform(seq, lambda k: F.when(inside(k), F.get(F.col(valid), i(k))).otherwise(F.lit(False))).alias("valid"),
    )


def rotation_matrix(azimuths=dims.SENSOR_AZIMUTH_DEG, dip: float = dims.SENSOR_DIP_DEG) -> np.ndarray:
    """Rows give vertical, north and east as combinations of the three oblique channels."""
    az, d = np.radians(azimuths), np.radians(dip)
    forward = np.stack([np.full(3, -np.sin(d)), np.cos(d) * np.cos(az), np.cos(d) * np.sin(az)], axis=1)
    return np.linalg.inv(forward)


def rotate(u: Column, v: Column, w: Column) -> dict[str, Column]:
    """Z, N and E arrays from oblique U, V, W arrays."""
    m = rotation_matrix()
    trio = F.arrays_zip(u.alias("u"), v.alias("v"), w.alias("w"))

    def row(r: int) -> Column:
        a, b, c = (F.lit(float(k)) for k in m[r])
        return F.transform(trio, lambda s: s["u"] * a + s["v"] * b + s["w"] * c)

    return {name: row(r) for r, name in enumerate("zne")}


def block_rms(x: Column, samples: int) -> Column:
    """Root mean square of each whole block; a partial last block is dropped."""
    n = F.floor(F.size(x) / F.lit(samples)).cast("int")
    blocks = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    sq = lambda k: F.aggregate(
        F.slice(x, k * samples + 1, F.lit(samples)), F.lit(0.0), lambda a, v: a + v * v)
    return F.transform(blocks, lambda k: F.sqrt(sq(k) / F.lit(samples)))


def array_median(a: Column) -> Column:
    """Middle of a sorted array, the mean of two middles when even."""
    s, n = F.array_sort(a), F.size(a)
    lo, hi = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(s, lo) + F.get(s, hi)) / 2.0)


def array_percentile(a: Column, q: float) -> Column:
    """Linear-interpolated quantile of an array."""
    s = F.array_sort(a)
    pos = (F.size(a) - 1) * F.lit(q)
    lo = F.floor(pos).cast("int")
    frac = pos - lo
    v0 = F.get(s, lo)
    v1 = F.coalesce(F.get(s, lo + 1), v0)
    return v0 + (v1 - v0) * frac


def glitch_flags(df: DataFrame, keys: Sequence[str], sr: float, ratio: float = dims.GLITCH_RATIO) -> DataFrame:
    """Blocks of one second whose RMS exceeds ``ratio`` times the trace's median block RMS."""
    samples = max(1, round(sr))
    rms = df.select(*keys, block_rms(F.col("x"), samples).alias("rms")).withColumn("med", array_median(F.col("rms")))
    rows = rms.where("med > 0").select(*keys, "med", F.posexplode("rms").alias("b", "r"))
    return rows.where(F.col("r") / F.col("med") > ratio).select(
        *keys, (F.col("b") * samples / F.lit(sr)).alias("start_s"),
        ((F.col("b") + 1) * samples / F.lit(sr)).alias("end_s"), (F.col("r") / F.col("med")).alias("rms_ratio"))


def qc_verdict(df: DataFrame, max_missing=0.10, flat=0.98, clip=0.05, min_p2p=100.0) -> DataFrame:
    """Mechanical screening of raw traces: coverage, flat line and clipping, first failure wins."""
    live = F.filter(F.zip_with("x", "valid", lambda v, ok: F.when(ok, v)), lambda v: v.isNotNull())
    d = df.withColumn("live", live)
    n = F.size("live")
    pairs = F.zip_with(F.slice("live", F.lit(2), F.greatest(n - 1, F.lit(0))),
                       F.slice("live", F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, b: a == b)
    count = lambda arr, p: F.size(F.filter(arr, p))
    # Bounds become columns first: inside a lambda they would be worked out again for every sample.
    d = d.withColumns({"lo": F.array_min("live"), "hi": F.array_max("live")})
    lo, hi = F.col("lo"), F.col("hi")
    d = d.withColumns({
        "missing_frac": 1.0 - n / F.size("x"),
        "flatline_frac": F.when(n > 1, count(pairs, lambda p: p) / (n - 1)),
        "p2p": hi - lo,
        "clip_frac": (count("live", lambda v: v == lo) + count("live", lambda v: v == hi)) / F.when(n > 0, n),
    })
    reason = (
        F.when((n < 2) | (F.col("p2p") == 0), "flatline_or_empty")
        .when(F.col("missing_frac") > max_missing, "coverage")
        .when(F.col("flatline_frac") >= flat, "flatline")
        .when((F.col("clip_frac") > clip) & (F.col("p2p") >= min_p2p), "clipping")
        .otherwise("")
    )
    d = d.withColumn("reason", reason)
    return d.withColumn("qc", F.when(F.col("reason") == "", "ok").otherwise("excluded")).drop("live", "lo", "hi")


def sample_rate(t: Column, nominal: float, snap: float = 1e-3) -> dict[str, Column]:
    """Median step, p99.9 - p0.1 spread, monotone flag and the rate snapped to ``nominal`` when close."""
    n = F.size(t)
    steps = F.zip_with(F.slice(t, F.lit(2), n - 1), F.slice(t, F.lit(1), n - 1), lambda b, a: b - a)
    med = array_median(steps)
    rate = F.lit(1.0) / med
    close = F.abs(rate - F.lit(nominal)) <= F.lit(snap * nominal)
    return {
        "median_step": med,
        "step_spread": array_percentile(steps, 0.999) - array_percentile(steps, 0.001),
        "strictly_increasing": F.forall(steps, lambda d: d > 0),
        "rate_hz": F.when(close, F.lit(nominal)).otherwise(rate),
    }


def normalise_products(
    df: DataFrame, keys: Sequence[str], *, sr: float, pre_s: float, t_min: float, t_max: float,
    smooth_s: float = 5.0, edge_s: float = dims.ENVELOPE_EDGE_EXCLUSION_S,
) -> DataFrame:
    """Standardised waveform, smoothed envelope and the envelope's eroded mask for every trace."""
    z = zscore(df, sr, pre_s, t_min, t_max).where("norm_status = 'ok'")
    smooth_n, margin = max(1, round(smooth_s * sr)), max(0, round(edge_s * sr))

    def envelope(wave, mask):
        env = kernels.boxcar_mean(kernels.run_envelope(wave, mask), mask, smooth_n)
        inner = kernels.erode(mask, margin)
        return np.where(inner, env, 0.0), inner

    return map_arrays(
        z, [*keys, "z", "valid"], ["z", "valid"], "envelope array<double>, envelope_valid array<boolean>", envelope)


def circular_mean(deg: Column, distinct_zero: float = 0.0) -> Column:
    """Mean direction in degrees [0, 360); null when both sums are zero. An aggregate."""
    s, c = F.avg(F.sin(F.radians(deg))), F.avg(F.cos(F.radians(deg)))
    angle = F.degrees(F.atan2(s, c))
    return F.when((F.abs(s) > distinct_zero) | (F.abs(c) > distinct_zero), F.pmod(angle + 360.0, F.lit(360.0)))


def great_circle_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return F.degrees(F.lit(2.0) * F.asin(F.sqrt(F.least(a, F.lit(1.0)))))


WINDOW_FIELDS = ("dop", "azimuth", "inclination", "vertical", "horizontal")
MEAN_FIELDS = {"dop": "dop", "azimuth": "azimuth_deg", "inclination": "inclination_deg", "vrm": "vrm", "hrm": "hrm"}


def band_signals(df: DataFrame, keys: Sequence[str], components: Sequence[str], sr: float, freqs: Sequence[float]) -> DataFrame:
    """One row per record and frequency: (keys, band, freq, re, im, level), the three complex band signals end to end and the modulus of the first."""
    freqs = [float(f) for f in freqs]

    def shifted(*zne):
        rows = len(zne[0])
        bands = kernels.frequency_shifts(np.stack(zne, axis=1), sr, freqs)
        level, bands = np.abs(bands[:, 0]), bands.transpose(0, 2, 1, 3).reshape(rows, len(freqs), -1)
        each = lambda v: np.broadcast_to(v, (rows, len(freqs)))
        return each(np.arange(len(freqs))), each(freqs), bands.real, bands.imag, level

    # A record makes rows of many times its size: so few of them at a time.
    return map_alike(df, keys, components, "band int, freq double, re array<double>, im array<double>, level array<double>", shifted, size=PIECE_BYTES // 16)


def window_polarizations(bands: DataFrame, keys: Sequence[str], sr: float, along: Sequence[str] = ()) -> DataFrame:
    """One row per record and band with an entry per window: (keys, band, along, n, win, start, live, dop, azimuth, inclination, vertical, horizontal).

    ``along`` names further columns of the bands that stay with their row.
    """

    def windows(re, im, freq):
        signal = np.empty(re.shape, dtype=complex)
        signal.real, signal.imag = re, im
        signal = signal.reshape(len(re), 3, -1)
        n = signal.shape[2]
        win, starts = kernels.band_windows(n, sr, freq[0])
        w = kernels.window_polarization(signal, win, starts)
        one = lambda v: np.full((len(re), 1), v)
        start = np.broadcast_to(starts, (len(re), 1, len(starts)))
        return one(n), one(win), start, *(w[k][:, None, :] for k in ("live", *WINDOW_FIELDS))

    fields = "n int, win int, start array<int>, live array<boolean>, " + ", ".join(f"{k} array<double>" for k in WINDOW_FIELDS)
    return map_alike(bands, [*keys, "band", *along], ["re", "im", "freq"], fields, windows, alike=["freq"], size=4 * PIECE_BYTES)


def covered_means(windows: DataFrame, keys: Sequence[str], *, alone: bool = False, along: Sequence[str] = ()) -> DataFrame:
    """(keys, band, ti, dop, azimuth_deg, inclination_deg, vrm, hrm): means over the windows that cover each sample.

    Directions are means of unit vectors; azimuth and inclination are null where no window moves. With ``alone`` no two
    rows of ``windows`` may share keys and band: the means are then taken where the row lies, without a shuffle, and
    ``along`` names arrays of one value a sample that become columns beside them.
    """
    if alone:
        return _means_in_place(windows, keys, along)
    per_window = F.explode(F.arrays_zip("start", "live", *WINDOW_FIELDS)).alias("w")
    rows = windows.select(*keys, "band", "win", per_window).select(*keys, "band", "win", "w.*")
    rows = rows.select(*keys, "band", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("win") - 1)).alias("ti"), "live", *WINDOW_FIELDS)
    live = lambda c: F.avg(F.when(F.col("live"), c))
    means = rows.groupBy(*keys, "band", "ti").agg(
        F.avg("dop").alias("dop"), live(F.sin("azimuth")).alias("_sin"), live(F.cos("azimuth")).alias("_cos"), live(F.col("inclination")).alias("inclination_deg"),
        F.avg(F.col("dop") * F.col("vertical")).alias("vrm"), F.avg(F.col("dop") * F.col("horizontal")).alias("hrm"))
    azimuth = F.pmod(F.degrees(F.atan2("_sin", "_cos")) + 360.0, F.lit(360.0))
    return means.withColumn("azimuth_deg", azimuth).drop("_sin", "_cos")


def _means_in_place(windows: DataFrame, keys: Sequence[str], along: Sequence[str]) -> DataFrame:
    def means(n, win, start, live, *rest):
        fields, beside = dict(zip(WINDOW_FIELDS, rest)), rest[len(WINDOW_FIELDS) :]
        out = np.empty((len(MEAN_FIELDS), len(n), n[0]))
        same = (start == start[0]).all()  # as they are wherever one step made them
        each, which = (start[:1], np.zeros(len(n), dtype=int)) if same else np.unique(start, axis=0, return_inverse=True)
        for k, starts in enumerate(each):
            rows = slice(None) if same else np.flatnonzero(which.ravel() == k)
            got = kernels.covered_polarization(int(n[0]), int(win[0]), starts, live[rows], **{f: v[rows] for f, v in fields.items()})
            out[:, rows] = [got[f] for f in MEAN_FIELDS]
        return np.broadcast_to(np.arange(n[0]), out.shape[1:]), *out, *beside

    added = ", ".join(f"`{c}` {windows.schema[c].dataType.elementType.simpleString()}" for c in along)
    fields = "ti int, " + ", ".join(f"{c} double" for c in MEAN_FIELDS.values()) + (f", {added}" if added else "")
    inputs = ["n", "win", "start", "live", *WINDOW_FIELDS, *along]
    return map_alike(windows, [*keys, "band"], inputs, fields, means, alike=["n", "win"])
