"""Slowness-time stacking of trace rows.

A trace is one row (lane columns, ``distance``, ``x array<double>``, ``valid array<boolean>``).
Each task shifts and adds the traces it holds, one slowness at a time, and sends one partial row per
(lane, realisation, slowness) to the shuffle. What is shuffled is therefore grids, not samples, and a
lane that holds most of the traces is summed by every task that reads it before a merge task sees it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamspark import dims

CHANNELS = {"linear": 1, "nth_root": 1, "pws": 3}
BUFFER_BYTES = 96 << 20
REALS_PER_GROUP = 64
SHORT_WINDOW = 16
UNEQUAL = "unequal_lengths: the traces of a lane must have one length"


def roll_samples(slowness: Column, distance: Column, ref: float, sr: float) -> Column:
    """Half-even rounded shift in samples for one trace at one slowness."""
    return F.rint(-slowness * (distance - F.lit(ref)) * F.lit(float(sr))).cast("int")


def shift_zero_fill(x: Column, roll: Column) -> Column:
    """Shift an array by ``roll`` samples; vacated positions become zero and nothing wraps."""
    n = F.size(x)
    pad = F.least(F.abs(roll), n)
    zeros = F.array_repeat(F.lit(0.0), pad)
    right = F.concat(zeros, F.slice(x, F.lit(1), n - pad))
    left = F.concat(F.slice(x, pad + 1, n - pad), zeros)
    return F.when(roll >= 0, right).otherwise(left)


def _ragged(col: pa.ListArray, width: int, dtype) -> np.ndarray:
    """List column to a zero-padded matrix."""
    offsets = np.asarray(col.offsets)
    flat = np.asarray(col.values.to_numpy(zero_copy_only=False)).astype(dtype, copy=False)
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == width).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, width)
    out = np.zeros((len(lengths), width), dtype=dtype)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        out[i, : b - a] = flat[a:b]
    return out


def _analytic_phase(x: np.ndarray) -> np.ndarray:
    """Instantaneous phase of each row through the one-sided spectrum."""
    n = x.shape[1]
    gain = np.zeros(n)
    gain[0] = 1.0
    gain[1 : (n + 1) // 2] = 2.0
    if n % 2 == 0:
        gain[n // 2] = 1.0
    return np.angle(np.fft.ifft(np.fft.fft(x, axis=1) * gain, axis=1))


def _lerp_shift(x: np.ndarray, valid: np.ndarray, samples: np.ndarray):
    """Move rows by a real number of samples; the mask needs both neighbours valid."""
    n = x.shape[1]
    pos = np.arange(n)[None, :] - samples[:, None]
    left = np.floor(pos)
    frac = pos - left
    i0 = np.clip(left.astype(np.int64), 0, n - 1)
    i1 = np.clip(i0 + 1, 0, n - 1)
    inside = (pos >= 0) & (pos <= n - 1)
    x0, x1 = np.take_along_axis(x, i0, 1), np.take_along_axis(x, i1, 1)
    v0, v1 = np.take_along_axis(valid, i0, 1), np.take_along_axis(valid, i1, 1)
    ok = inside & v0 & (v1 | (frac == 0.0))
    return np.where(inside, x0 + (x1 - x0) * frac, 0.0), ok


def rooted(x: np.ndarray, order: float) -> np.ndarray:
    """Signed root; the fourth by two square roots."""
    if order == 4:
        return np.copysign(np.sqrt(np.sqrt(np.abs(x))), x)
    return np.sign(x) * np.abs(x) ** (1.0 / order)


def raised(x: np.ndarray, order: float) -> np.ndarray:
    """Signed power, the inverse of ``rooted``."""
    if order == 4:
        return x * x * x * np.abs(x)
    return np.sign(x) * np.abs(x) ** order


def _channels(x: np.ndarray, valid: np.ndarray, method: str, order: float) -> list[np.ndarray]:
    """Per-sample quantities whose masked sums make the stack; the last one counts support."""
    masked = np.where(valid, x, 0.0)
    if method == "linear":
        parts = [masked]
    elif method == "nth_root":
        parts = [rooted(masked, order)]
    else:
        phase = _analytic_phase(masked)
        parts = [masked, np.where(valid, np.cos(phase), 0.0), np.where(valid, np.sin(phase), 0.0)]
    return parts + [valid.astype(np.float64)]


def _shift_add(parts: list[np.ndarray], rolls: np.ndarray, weights: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
    """Weighted sums of shifted rows on [lo, hi): one matrix product per distinct roll."""
    n = parts[0].shape[1]
    out = [np.zeros((weights.shape[0], hi - lo)) for _ in parts]
    if weights.shape[0] == 1:
        # One realisation: rows are added where they fall.
        for roll, w, i in zip(rolls.tolist(), weights[0].tolist(), range(len(rolls))):
            a, b = max(lo, roll, 0), min(hi, n + roll, n)
            if a < b:
                for acc, part in zip(out, parts):
                    row = part[i, a - roll : b - roll]
                    acc[0, a - lo : b - lo] += row if w == 1.0 else w * row
        return out
    order = np.argsort(rolls, kind="stable")
    cuts = np.flatnonzero(np.diff(rolls[order])) + 1
    groups = np.split(order, cuts)
    if len(groups) * 4 > len(rolls):
        # Few rows share a roll: gather the shifted rows once and use a single product.
        moved = [np.zeros((len(rolls), hi - lo)) for _ in parts]
        for i, roll in enumerate(rolls):
            a, b = max(lo, roll, 0), min(hi, n + roll, n)
            if a < b:
                for m, part in zip(moved, parts):
                    m[i, a - lo : b - lo] = part[i, a - roll : b - roll]
        return [weights @ m for m in moved]
    for idx in groups:
        roll = int(rolls[idx[0]])
        a, b = max(lo, roll, 0), min(hi, n + roll, n)
        if a >= b:
            continue
        w = weights[:, idx]
        for acc, part in zip(out, parts):
            acc[:, a - lo : b - lo] += w @ part[idx, a - roll : b - roll]
    return out


def _list_array(rows: np.ndarray, typ: pa.DataType) -> pa.ListArray:
    count, width = rows.shape
    offsets = pa.array(np.arange(0, (count + 1) * width, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).reshape(-1), type=typ))


def partial_stacks(
    traces: DataFrame,
    lanes: Sequence[str],
    slowness: Sequence[float],
    *,
    ref: float = dims.REF_DISTANCE_DEG,
    sr: float,
    method: str = "linear",
    order: float = dims.NTH_ROOT,
    time_range: tuple[int, int] | None = None,
    buffer_bytes: int = BUFFER_BYTES,
    blocks: int = 1,
) -> DataFrame:
    """Map side: shifted sums of the traces each task holds.

    ``blocks`` deals the slowness axis over that many tasks, each with a copy of the traces: for a few
    heavy traces that would leave cores idle. Traces of a lane must have one length, and masks the length
    of their trace; anything else is refused, here or where the partial rows meet.

    Optional trace columns: ``members array<int>`` names the realisations a trace takes part in
    (absent: realisation 0); ``jitter_s array<double>`` and ``distances array<double>`` give, in the
    order of ``members``, a time shift or a replaced distance for that realisation.
    ``time_range`` keeps only output samples [lo, hi), so a window query never builds the rest.
    """
    has = {c: c in traces.columns for c in ("members", "jitter_s", "distances")}
    cols = [*lanes, "distance", "x", "valid", *[c for c, there in has.items() if there]]
    source = traces.select(*cols)
    nodes = np.asarray(list(slowness), dtype=np.float64)
    blocks = min(blocks, len(nodes))
    if blocks > 1:
        fan = source.withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        source = fan.repartitionByRange(blocks, "blk")
    width = CHANNELS[method]
    lane_types = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in lanes]
    acc_cols = [f"acc{k}" for k in range(width)]
    schema = ", ".join(
        [*lane_types, "real int", "si int", *[f"{c} array<double>" for c in acc_cols], "cnt array<int>", "n int", "src int"]
    )

    def emit(key: tuple, lane_fields, real: np.ndarray, si: int, sums: list[np.ndarray], n: int) -> pa.RecordBatch:
        rows = len(real)
        arrays = [pa.array([k] * rows, type=f.type) for k, f in zip(key, lane_fields)]
        arrays += [pa.array(real.astype(np.int32)), pa.array(np.full(rows, si, dtype=np.int32))]
        arrays += [_list_array(s, pa.float64()) for s in sums[:-1]]
        arrays.append(_list_array(np.rint(sums[-1]).astype(np.int32), pa.int32()))
        arrays.append(pa.array(np.full(rows, n, dtype=np.int32)))
        arrays.append(pa.array(np.full(rows, TaskContext.get().partitionId(), dtype=np.int32)))
        return pa.RecordBatch.from_arrays(arrays, [*lanes, "real", "si", *acc_cols, "cnt", "n", "src"])

    group_cols = [*lanes, "blk"] if blocks > 1 else list(lanes)

    def stack_lane(key, lane_fields, tbl: pa.Table) -> Iterator[pa.RecordBatch]:
        mine = range(len(nodes))
        if blocks > 1:
            *key, blk = key
            mine = range(int(blk), len(nodes), blocks)
        xs = tbl.column("x").combine_chunks()
        lengths = np.diff(np.asarray(xs.offsets))
        masks = np.diff(np.asarray(tbl.column("valid").combine_chunks().offsets))
        if (lengths != masks).any():
            raise ValueError("mask_shape_mismatch: a mask must be as long as its trace")
        if len(np.unique(lengths)) > 1:
            raise ValueError(UNEQUAL)
        n = int(lengths[0]) if len(lengths) else 0
        if n == 0:
            return
        x = _ragged(xs, n, np.float64)
        valid = _ragged(tbl.column("valid").combine_chunks(), n, bool)
        dist = tbl.column("distance").to_numpy()
        lo, hi = time_range or (0, n)
        lo, hi = max(0, lo), min(n, hi)
        if hi <= lo:
            return
        if has["members"]:
            members = tbl.column("members").combine_chunks()
            offs = np.asarray(members.offsets)
            owner = np.repeat(np.arange(len(x)), np.diff(offs))
            real_of = np.asarray(members.values)[offs[0] : offs[-1]]
        else:
            owner, real_of = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        reals = np.unique(real_of)
        if has["jitter_s"] or has["distances"]:

            def flat(name):
                col = tbl.column(name).combine_chunks()
                o = np.asarray(col.offsets)
                return np.asarray(col.values)[o[0] : o[-1]]

            jit = flat("jitter_s") if has["jitter_s"] else None
            other = flat("distances") if has["distances"] else None
            for r in reals:
                pick = np.flatnonzero(real_of == r)
                xr, vr = x[owner[pick]], valid[owner[pick]]
                if jit is not None:
                    xr, vr = _lerp_shift(xr, vr, jit[pick] * sr)
                parts = _channels(xr, vr, method, order)
                dr = other[pick] if other is not None else dist[owner[pick]]
                for si in mine:
                    rolls = np.rint(-nodes[si] * (dr - ref) * sr).astype(np.int64)
                    sums = _shift_add(parts, rolls, np.ones((1, len(pick))), lo, hi)
                    yield emit(key, lane_fields, np.array([r]), si, sums, n)
            return
        weights = np.zeros((len(reals), len(x)))
        np.add.at(weights, (np.searchsorted(reals, real_of), owner), 1.0)
        parts = _channels(x, valid, method, order)
        for si in mine:
            rolls = np.rint(-nodes[si] * (dist - ref) * sr).astype(np.int64)
            yield emit(key, lane_fields, reals, si, _shift_add(parts, rolls, weights, lo, hi), n)

    def by_lane(tbl: pa.Table) -> Iterator[pa.RecordBatch]:
        fields = [tbl.schema.field(c) for c in lanes]
        if not group_cols:
            yield from stack_lane((), fields, tbl)
            return
        codes = tbl.select(group_cols).to_pandas().groupby(group_cols, dropna=False, sort=False).indices
        for key, idx in codes.items():
            key = key if isinstance(key, tuple) else (key,)
            plain = tuple(k.item() if hasattr(k, "item") else k for k in key)
            yield from stack_lane(plain, fields, tbl.take(pa.array(np.sort(idx))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= buffer_bytes:
                yield from by_lane(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from by_lane(pa.Table.from_batches(held))

    return source.mapInArrow(run, schema)


def gathered(traces: DataFrame, lanes: Sequence[str], per_task: int = 400) -> DataFrame:
    """Bring traces of a lane together, ``per_task`` at a time, for data with very many lanes.

    Tasks that hold only a trace or two of each lane would shuffle more grid than they saved; one
    shuffle of the traces avoids that. A large lane is spread over as many groups as it needs.
    """
    size = traces.groupBy(*lanes).agg(F.ceil(F.count("*") / F.lit(per_task)).cast("int").alias("groups"))
    salted = traces.join(size, list(lanes)).withColumn("grp", F.pmod(F.xxhash64("distance", "x"), F.col("groups")))
    return salted.repartition(*lanes, "grp").drop("groups", "grp")


def add_exactly(held: list | None, new: np.ndarray) -> list:
    """Add an array to a running [sum, lost low bits]; the result does not depend on the order in which partial rows arrive.

    A grid that is evaluated twice then has the same bits both times, and cells that are equal on paper stay equal.
    """
    if held is None:
        return [new.copy(), np.zeros_like(new)]
    total, low = held
    if new.dtype.kind != "f":
        total += new
        return held
    both = total + new
    kept = both - total
    low += (total - (both - kept)) + (new - kept)
    held[0] = both
    return held


def one_length(batch: pa.RecordBatch, length: int | None) -> int:
    """Trace length of partial rows; those of one lane that differ are refused."""
    found = np.unique(batch.column("n").to_numpy())
    if len(found) > 1 or length not in (None, int(found[0])):
        raise ValueError(UNEQUAL)
    return int(found[0])


def sum_partials(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Element-wise sums of the ``acc*`` and ``cnt`` arrays of each key, one streaming pass per group."""
    types = {f.name: f.dataType.simpleString() for f in partials.schema.fields}
    sums = [c for c in partials.columns if c.startswith("acc") or c == "cnt"]

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        schema = length = None
        for b in batches:
            schema = b.schema
            length = one_length(b, length)
            for name in sums:
                col = b.column(name)
                offs, vals = np.asarray(col.offsets), np.asarray(col.values)
                for lo, hi in zip(offs[:-1], offs[1:]):
                    held[name] = add_exactly(held.get(name), vals[lo:hi])
        cols = [pa.array([k.as_py()], type=schema.field(n).type) for k, n in zip(key, keys)]
        cols += [_list_array(sum(held[c])[None, :], pa.int32() if c == "cnt" else pa.float64()) for c in sums]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([length], pa.int32())], [*keys, *sums, "n"])

    ddl = ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"{c} {types[c]}" for c in sums), "n int"])
    return partials.select(*keys, *sums, "n").groupBy(*keys).applyInArrow(add, ddl)


def merge_grids(
    partials: DataFrame,
    lanes: Sequence[str],
    slowness: Sequence[float],
    *,
    method: str = "linear",
    order: float = dims.NTH_ROOT,
    pw_order: float = 1.0,
    min_support: int = dims.MIN_STACK_SUPPORT,
    power_samples: int | None = None,
    fan_in: int | None = None,
) -> DataFrame:
    """Reduce side: add the partial rows of each (lane, realisation, slowness) as they stream in.

    One lane over very many map tasks brings a row from each of them to one key: ``fan_in`` first adds up
    the rows of that many neighbouring tasks, so that no merge task reads more than their number of groups.

    Gives one row per slowness with ``beam`` and ``support`` arrays, and ``power`` when
    ``power_samples`` asks for the tapered moving power. Unsupported cells are null.
    """
    if min_support < 1:
        raise ValueError("min_support must be at least 1")
    nodes = [float(s) for s in slowness]
    width = CHANNELS[method]
    # Neighbouring realisations share a group: fewer, larger calls, still bounded by the time axis.
    keys = [*lanes, "si", "rblock"]
    if fan_in is not None:
        near = partials.withColumn("src", F.floor(F.col("src") / F.lit(fan_in)).cast("int"))
        partials = sum_partials(near, [*lanes, "real", "si", "src"])
    part = partials.withColumn("rblock", F.floor(F.col("real") / F.lit(REALS_PER_GROUP)).cast("int"))
    types = {f.name: f.dataType.simpleString() for f in part.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in (*lanes, "real", "si")])
    schema += ", s double, beam array<double>, support array<int>"
    if power_samples is not None:
        schema += ", power array<double>"

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        fields, length = None, None
        for batch in batches:
            fields = batch.schema
            length = one_length(batch, length)
            reals = batch.column("real").to_pylist()
            for c in range(width + 1):
                col = batch.column(f"acc{c}" if c < width else "cnt")
                offs, vals = np.asarray(col.offsets), np.asarray(col.values)
                for r, a, b in zip(reals, offs[:-1], offs[1:]):
                    held = sums.setdefault(r, [None] * (width + 1))
                    held[c] = add_exactly(held[c], vals[a:b])
        rows = {"beam": [], "support": [], "power": []}
        for r in sorted(sums):
            *acc, count = (total + low for total, low in sums[r])
            ok = count >= min_support
            safe = np.maximum(count, 1)
            mean = acc[0] / safe
            if method == "nth_root":
                mean = raised(mean, order)
            elif method == "pws":
                mean = mean * (np.hypot(acc[1], acc[2]) / safe) ** pw_order
            rows["beam"].append(pa.array(mean, mask=~ok))
            rows["support"].append(pa.array(count.astype(np.int32)))
            if power_samples is not None:
                power, has = tapered_power(mean, ok, power_samples)
                rows["power"].append(pa.array(power, mask=~has))

        def lists(arrays: list[pa.Array]) -> pa.ListArray:
            offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(arrays))

        n, si = len(sums), key[len(lanes)].as_py()
        cols = [pa.array([k.as_py()] * n, type=fields.field(c).type) for k, c in zip(key, lanes)]
        cols += [pa.array(sorted(sums), pa.int32()), pa.array([si] * n, pa.int32()), pa.array([nodes[si]] * n)]
        names = [*lanes, "real", "si", "s"]
        for name, arrays in rows.items():
            if arrays:
                cols.append(lists(arrays))
                names.append(name)
        yield pa.RecordBatch.from_arrays(cols, names)

    return part.groupBy(*keys).applyInArrow(merge, schema)


def taper(samples: int) -> np.ndarray:
    """Hann weights; a window too short to have any weight becomes a boxcar."""
    h = np.hanning(samples)
    return h if h.any() else np.ones(samples)


def window_sums(y: np.ndarray, width: int) -> np.ndarray:
    """Sums of all windows of ``width`` values along the last axis: a suffix of one block plus a prefix of the next.

    Running sums start anew in every block, so that a large value is never subtracted again from small ones behind it.
    """
    n = y.shape[-1]
    blocks = -(-n // width)
    padded = np.zeros((*y.shape[:-1], blocks * width))
    padded[..., :n] = y
    cut = padded.reshape(*y.shape[:-1], blocks, width)
    prefix = np.cumsum(cut, axis=-1).reshape(padded.shape)
    suffix = np.cumsum(cut[..., ::-1], axis=-1)[..., ::-1].copy()
    suffix[..., 0] = 0.0  # a window that begins with a block ends with it
    count = n - width + 1
    return suffix.reshape(padded.shape)[..., :count] + prefix[..., width - 1:width - 1 + count]


@lru_cache(maxsize=8)
def _wave(n: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    turn = 2.0 * np.pi / period * (np.arange(n) % period)
    return np.cos(turn), np.sin(turn)


@lru_cache(maxsize=8)
def _whole_weight(n: int, samples: int) -> np.ndarray:
    """Weight of every window where all cells count."""
    return tapered_sums(np.ones(n), samples)


def tapered_sums(y: np.ndarray, samples: int) -> np.ndarray:
    """Hann-weighted sums of the windows centred on every value, as a same-length convolution, in linear time.

    The weight is a constant less a cosine, hence three running sums: of 1, cos and sin. Short windows are added weight by
    weight instead, so that equal windows have equal bits wherever they lie.
    """
    padded = np.zeros((*y.shape[:-1], y.shape[-1] + samples - 1))
    padded[..., samples // 2:samples // 2 + y.shape[-1]] = y
    if samples < 3:
        return window_sums(padded, samples)
    if samples <= SHORT_WINDOW:
        out = np.zeros(y.shape)
        for k, h in enumerate(taper(samples)):
            if h:
                out += h * padded[..., k:k + y.shape[-1]]
        return out
    cos, sin = _wave(padded.shape[-1], samples - 1)
    starts = slice(0, y.shape[-1])
    wave = cos[starts] * window_sums(padded * cos, samples) + sin[starts] * window_sums(padded * sin, samples)
    return np.maximum(0.5 * (window_sums(padded, samples) - wave), 0.0)


def tapered_power(beam: np.ndarray, ok: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean of squared beam over supported cells along the last axis, centred as a same-length convolution."""
    if not beam.shape[-1]:
        return beam, ok
    width = max(1, min(beam.shape[-1], samples))
    top = tapered_sums(np.where(ok, beam, 0.0) ** 2, width)
    bottom = _whole_weight(beam.shape[-1], width) if ok.all() else tapered_sums(ok.astype(np.float64), width)
    has = ok & (bottom > 0.0)
    return np.divide(top, bottom, out=np.zeros(beam.shape), where=has), has


def vespagram(
    traces: DataFrame,
    lanes: Sequence[str],
    slowness: Sequence[float],
    *,
    ref: float = dims.REF_DISTANCE_DEG,
    sr: float,
    method: str = "nth_root",
    order: float = dims.NTH_ROOT,
    pw_order: float | None = None,
    min_support: int = dims.MIN_STACK_SUPPORT,
    power_window_s: float | None = dims.POWER_WINDOW_S,
    time_range: tuple[int, int] | None = None,
    buffer_bytes: int = BUFFER_BYTES,
    blocks: int = 1,
    fan_in: int | None = None,
) -> DataFrame:
    """Stack and smooth: one row per (lane, realisation, slowness) with arrays over time.

    ``time_range`` trims the stack to the samples a caller reads; callers that need power inside a
    window widen it by half a power window (see :func:`window_range`).
    """
    if method not in CHANNELS:
        raise ValueError(f"Unknown stack method: {method}")
    if method == "pws" and pw_order is None and order != dims.NTH_ROOT:
        raise ValueError("phase-weighted stacking takes pw_order; the root order does not apply to it")
    part = partial_stacks(
        traces, lanes, slowness, ref=ref, sr=sr, method=method, order=order,
        time_range=time_range, buffer_bytes=buffer_bytes, blocks=blocks,
    )
    samples = None if power_window_s is None else max(1, int(round(power_window_s * sr)))
    return merge_grids(
        part, lanes, slowness, method=method, order=order, pw_order=1.0 if pw_order is None else pw_order,
        min_support=min_support, power_samples=samples, fan_in=fan_in,
    )


def window_range(t_min: float, t_max: float, pre_s: float, sr: float, power_window_s: float) -> tuple[int, int]:
    """Sample range that a closed time window needs once the power window is added on both sides."""
    half = int(np.ceil(power_window_s * sr / 2.0)) + 1
    return int(np.floor((t_min + pre_s) * sr)) - half, int(np.ceil((t_max + pre_s) * sr)) + half + 1


def cells(grid: DataFrame, keys: Sequence[str], *, pre_s: float, sr: float, start: int = 0) -> DataFrame:
    """Array rows to long cells: (keys, real, si, s, ti, t, beam, support[, power])."""
    arrays = ["beam", "support"] + (["power"] if "power" in grid.columns else [])
    flat = grid.select(*keys, "real", "si", "s", F.posexplode(F.arrays_zip(*arrays)).alias("ti", "c"))
    ti = F.col("ti") + F.lit(start)
    return flat.select(
        *keys, "real", "si", "s", ti.alias("ti"), (ti / F.lit(float(sr)) - F.lit(float(pre_s))).alias("t"),
        *[F.col(f"c.{a}").alias(a) for a in arrays],
    )


def long_form_stack(
    traces: DataFrame, lanes: Sequence[str], slowness: Sequence[float], *, ref: float, sr: float,
    method: str = "linear", order: float = dims.NTH_ROOT, min_support: int = dims.MIN_STACK_SUPPORT,
) -> DataFrame:
    """The same linear or nth-root stack with built-in expressions only; the tests hold the two together."""
    axis = F.array(*[F.struct(F.lit(i).alias("si"), F.lit(float(s)).alias("s")) for i, s in enumerate(slowness)])
    fan = traces.select(*lanes, "distance", "x", "valid", F.explode(axis).alias("a"))
    fan = fan.withColumn("roll", roll_samples(F.col("a.s"), F.col("distance"), ref, sr))
    fan = fan.withColumn("n", F.size("x"))
    flat = fan.select(
        *lanes, "a.si", "a.s", "roll", "n", F.posexplode(F.arrays_zip("x", "valid")).alias("i", "c")
    ).where(F.col("c.valid"))
    ti = F.col("i") + F.col("roll")
    val = F.col("c.x")
    if method == "nth_root":
        val = F.signum(val) * F.pow(F.abs(val), F.lit(1.0 / order))
    flat = flat.select(*lanes, "si", "s", ti.alias("ti"), val.alias("v"), "n").where((ti >= 0) & (ti < F.col("n")))
    out = flat.groupBy(*lanes, "si", "s", "ti").agg(F.sum("v").alias("acc"), F.count("*").alias("support"))
    mean = F.col("acc") / F.col("support")
    if method == "nth_root":
        mean = F.signum(mean) * F.pow(F.abs(mean), F.lit(float(order)))
    return out.withColumn("beam", F.when(F.col("support") >= min_support, mean)).drop("acc")
