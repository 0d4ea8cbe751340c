"""Bootstraps and nulls of stacked grids: from designs to occupancy and peaks in one pass over the traces.

A realisation is a number: ``set * per_set + member``. A *set* is one assignment of distances to events (the true one, or a
scramble); a *member* is one choice of events, or one draw of jitter, inside it. A task holds a block of realisations of
one lane, all slownesses of them, and adds the lane's traces to it as they stream past: subset designs are one matrix
product per slowness, whatever the number of realisations, and a scramble is a shift of its own, not a copy of the traces.
The block is then smoothed, its peaks are found and its cells marked where it lies, so that neither samples nor grids are
shuffled, only sparse counts.

What grows: traces are shuffled once per block (``block_bytes`` bounds a block, so that few realisations of a long axis or
thousands of a short one make one). A lane with more than ``per_group`` traces and over a thousandth of all of them (a thousand lanes at
most, known by broadcast) is split: each group of ``per_group`` traces gives one partial block, and partial blocks are
added up in two levels, in parts of about ``part_bytes`` (some realisations of a block) that are groups of their own. Bytes shuffled per trace depend on ``per_group`` and the axes, not on the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamspark import dims
from beamspark.operators import stack

BLOCK_BYTES = 96 << 20
PER_GROUP = 400
HEAVY_SHARE = 1_000
FAN_IN = 32
CELL_BYTES = 12  # a sum and a count
PART_BYTES = 4 << 20  # of a block that is added up from partial blocks at once
HELD_CELLS = 1 << 18  # interpolated samples that are added together, so that they stay in the processor's cache
SLACK = 1e-12  # a cell that equals the threshold but for rounding reaches it
FOUND = "`set` int, phase string, threshold_pct int, si array<int>, ti array<int>, n array<int>, real array<int>, power array<double>, support array<int>"


@dataclass(frozen=True)
class Design:
    """What every task knows: the axes, the windows and how realisations are numbered."""

    slowness: tuple[float, ...]
    windows: tuple[tuple[str, float, float], ...]
    thresholds: tuple[int, ...]
    n_sets: int
    per_set: int
    sr: float
    pre_s: float
    ref: float = dims.REF_DISTANCE_DEG
    order: float = dims.NTH_ROOT
    min_support: int = dims.MIN_STACK_SUPPORT
    power_window_s: float = dims.POWER_WINDOW_S
    block_bytes: int = BLOCK_BYTES
    part_bytes: int = PART_BYTES

    @property
    def n_real(self) -> int:
        return self.n_sets * self.per_set

    @property
    def samples(self) -> tuple[int, int]:
        """Output samples that the windows and the power window beside them read; past the end of a trace they stay empty."""
        ends = [stack.window_range(a, b, self.pre_s, self.sr, self.power_window_s) for _, a, b in self.windows]
        return max(0, min(a for a, _ in ends)), max(1, *(b for _, b in ends))

    @property
    def per_block(self) -> int:
        lo, hi = self.samples
        return max(1, min(self.n_real, self.block_bytes // (len(self.slowness) * (hi - lo) * CELL_BYTES)))

    @property
    def per_part(self) -> int:
        lo, hi = self.samples
        return max(1, self.part_bytes // (len(self.slowness) * (hi - lo) * CELL_BYTES))

    @property
    def blocks(self) -> int:
        return -(-self.n_real // self.per_block)


def design(slowness: Sequence[float], windows: dict[str, tuple[float, float]], thresholds: Sequence[int], *, per_set: int, n_sets: int = 1, **more) -> Design:
    if per_set < 1 or n_sets < 1:
        raise ValueError("a design needs at least one realisation")
    return Design(tuple(map(float, slowness)), tuple((k, *map(float, v)) for k, v in windows.items()), tuple(thresholds), n_sets, per_set, **more)


def _lerped(x: np.ndarray, valid: np.ndarray, samples: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples [a, b) of one trace, a row for each of several moves by a real number of samples; a mask needs both neighbours valid."""
    if not np.isfinite(samples).all():
        raise ValueError("jitter must be finite")
    n = len(x)
    low = np.floor(-samples)
    frac = (-samples - low)[:, None]
    low = np.clip(low, -b - 1, n - a).astype(np.int64)  # beyond these nothing of the trace is left
    start, stop = a + low.min(), b + low.max() + 1
    first, last = max(0, start), min(n, stop)
    near, has = np.zeros(stop - start), np.zeros(stop - start, dtype=bool)
    if first < last:
        near[first - start:last - start], has[first - start:last - start] = x[first:last], valid[first:last]
    near = np.lib.stride_tricks.sliding_window_view(near, b - a + 1)[a + low - start]
    has = np.lib.stride_tricks.sliding_window_view(has, b - a + 1)[a + low - start]
    # Inside means a position in [0, n - 1]; the last sample has no right neighbour and needs none.
    return near[:, :-1] + (near[:, 1:] - near[:, :-1]) * frac, has[:, :-1] & (has[:, 1:] | (frac == 0.0))


def _places(reals: np.ndarray, here: np.ndarray) -> list[tuple]:
    """Where rows go: pairs of an index of realisations and one of rows, in which no realisation stands twice."""
    rows = np.flatnonzero(here)
    to = reals[rows]
    if not len(rows):
        return []
    step = np.diff(to)
    if (step <= 0).any():
        return [(int(t), int(r)) for t, r in zip(to, rows, strict=True)]
    if (step == 1).all() and rows[-1] - rows[0] == len(rows) - 1:
        return [(slice(int(to[0]), int(to[-1]) + 1), slice(int(rows[0]), int(rows[-1]) + 1))]
    return [(to, rows)]


class Block:
    """Sums and counts of some realisations of one lane: arrays over slowness, realisation and time."""

    def __init__(self, plan: Design, number: int, part: int | None = None):
        self.plan = plan
        self.first = number * plan.per_block
        self.last = min(plan.n_real, self.first + plan.per_block)
        if part is not None:
            self.first += part * plan.per_part
            self.last = min(self.last, self.first + plan.per_part)
        self.lo, self.hi = plan.samples
        shape = (len(plan.slowness), self.last - self.first, self.hi - self.lo)
        self.total, self.count = np.zeros(shape), np.zeros(shape, dtype=np.int32)
        self.length: int | None = None

    def rolls(self, distances: np.ndarray) -> np.ndarray:
        p = self.plan
        return np.rint(-np.asarray(p.slowness)[:, None] * (distances[None, :] - p.ref) * p.sr).astype(np.int64)

    def take(self, batch: pa.RecordBatch) -> None:
        """Add the traces of a batch."""
        p, names = self.plan, set(batch.schema.names)
        xs, masks = batch.column("x"), batch.column("valid")
        lengths = np.diff(np.asarray(xs.offsets))
        if (lengths != np.diff(np.asarray(masks.offsets))).any():
            raise ValueError("mask_shape_mismatch: a mask must be as long as its trace")
        if len(np.unique(lengths)) > 1 or self.length not in (None, int(lengths[0])):
            raise ValueError(stack.UNEQUAL)
        n = self.length = int(lengths[0])
        if n == 0:
            return
        x, valid = stack._ragged(xs, n, np.float64), stack._ragged(masks, n, bool)
        near = batch.column("distance").to_numpy()
        sets = _by_row(batch.column("distances"), p.n_sets) if "distances" in names else None
        owner, member, jitter = self._members(batch, names, len(x))
        if jitter is not None:
            self._jittered(x, valid, owner, member, jitter, near, sets)
            return
        if p.per_set == 1 and "members" not in names:
            self._alone(x, valid, near, sets)
            return
        parts = None
        for k in range(self.first // p.per_set, (self.last - 1) // p.per_set + 1):
            a, b = max(self.first, k * p.per_set), min(self.last, (k + 1) * p.per_set)
            mine = (member >= a - k * p.per_set) & (member < b - k * p.per_set)
            rows, at = owner[mine], member[mine] + k * p.per_set - self.first
            rolls = self.rolls(near if sets is None else sets[:, k])
            weights = np.zeros((b - a, len(x)))
            np.add.at(weights, (at - (a - self.first), rows), 1.0)
            if parts is None:
                masked = np.where(valid, x, 0.0)
                parts = (stack.rooted(masked, p.order), valid.astype(np.float64))
            self._weighted(parts, rolls, weights, slice(a - self.first, b - self.first))

    def _members(self, batch: pa.RecordBatch, names: set, n: int):
        """Row, member and jitter of every pair of a trace and a member that takes it; all members where none are named."""
        if "members" not in names:
            owner, member = np.repeat(np.arange(n), self.plan.per_set), np.tile(np.arange(self.plan.per_set), n)
        else:
            col = batch.column("members")
            offs = np.asarray(col.offsets)
            owner, member = np.repeat(np.arange(n), np.diff(offs)), np.asarray(col.values)[offs[0]:offs[-1]]
        if "jitter_s" not in names:
            return owner, member, None
        col = batch.column("jitter_s")
        offs = np.asarray(col.offsets)
        return owner, member, np.asarray(col.values)[offs[0]:offs[-1]]

    def _bounds(self, roll: int, n: int) -> tuple[int, int]:
        return max(self.lo, roll, 0), min(self.hi, n + roll, n)

    def _weighted(self, parts, rolls, weights, reals: slice) -> None:
        width, n = self.hi - self.lo, parts[0].shape[1]
        moved = [np.empty((weights.shape[1], width)) for _ in parts]
        for si in range(len(rolls)):
            for m in moved:
                m.fill(0.0)
            for i, roll in enumerate(rolls[si]):
                a, b = self._bounds(roll, n)
                if a < b:
                    for m, part in zip(moved, parts, strict=True):
                        m[i, a - self.lo:b - self.lo] = part[i, a - roll:b - roll]
            self.total[si, reals] += weights @ moved[0]
            self.count[si, reals] += np.rint(weights @ moved[1]).astype(np.int32)

    def _alone(self, x, valid, near, sets) -> None:
        """Sets of one realisation each: all shifts of a trace are windows of it, gathered at once for every set and slowness."""
        p, n, width = self.plan, x.shape[1], self.hi - self.lo
        rolls = np.stack([self.rolls(near if sets is None else sets[:, k]) for k in range(self.first, self.last)], axis=1)  # slowness, set, trace
        least, most = rolls.min(axis=(0, 1)), rolls.max(axis=(0, 1))
        root = stack.rooted(np.where(valid, x, 0.0), p.order)
        for row in range(len(x)):
            start, stop = self.lo - most[row], self.hi - least[row]
            first, last = max(0, start), min(n, stop)
            if first >= last:
                continue
            at = most[row] - rolls[:, :, row]
            # Samples that fall outside the trace's own axis after a shift are never kept: windows end at its length.
            for into, part in ((self.total, root), (self.count, valid.astype(np.int32))):
                padded = np.zeros(stop - start, dtype=part.dtype)
                padded[first - start:last - start] = part[row, first:last]
                shifted = np.lib.stride_tricks.sliding_window_view(padded, width)[at]
                inside = max(0, min(self.hi, n) - self.lo)
                into[:, :, :inside] += shifted[:, :, :inside]

    def _jittered(self, x, valid, owner, member, jitter, near, sets) -> None:
        """Each trace is interpolated once for all its members, and the rows are added to all sets of the block that have them."""
        p, n = self.plan, x.shape[1]
        ks = np.arange(self.first // p.per_set, (self.last - 1) // p.per_set + 1)
        rolls = np.stack([self.rolls(near if sets is None else sets[:, k]) for k in ks])  # set, slowness, trace
        least, most = rolls.min(axis=(0, 1)), rolls.max(axis=(0, 1))
        bounds = np.searchsorted(owner, np.arange(len(x) + 1))
        held, cells = [], 0
        for row in range(len(x)):
            at, shift = member[bounds[row]:bounds[row + 1]], jitter[bounds[row]:bounds[row + 1]]
            reals = ks[:, None] * p.per_set + at - self.first
            here = (reals >= 0) & (reals < self.last - self.first)
            used = here.any(axis=0)
            # Only the samples that some slowness moves into the kept range are interpolated.
            first, last = max(0, self.lo - most[row]), min(n, self.hi - least[row])
            if first >= last or not used.any():
                continue
            moved, ok = _lerped(x[row], valid[row], shift[used] * p.sr, first, last)
            # Places within a set's own realisations of the block.
            pairs = [_places(r - max(0, k * p.per_set - self.first), h) for k, r, h in zip(ks, reals[:, used], here[:, used], strict=True)]
            root = np.where(ok, stack.rooted(moved, p.order), 0.0)
            held.append((row, first, last, pairs, np.ascontiguousarray(root.T), np.ascontiguousarray(ok.T.astype(np.int32))))
            cells += moved.size
            if cells > HELD_CELLS:
                self._add_moved(held, rolls, n)
                held, cells = [], 0
        self._add_moved(held, rolls, n)

    def _add_moved(self, held: list[tuple], rolls: np.ndarray, n: int) -> None:
        """Add interpolated traces, in their order, to each set and slowness in turn: one slice moves all members at once."""
        first_set = self.first // self.plan.per_set
        for i, by_slowness in enumerate(rolls):
            for si, shifts in enumerate(by_slowness.tolist()):
                # Time first and realisations last, as the rows lie: a move in time is then one run of memory.
                mine = slice(max(0, (first_set + i) * self.plan.per_set - self.first), (first_set + i + 1) * self.plan.per_set - self.first)
                total, count = (np.ascontiguousarray(of[si, mine].T) for of in (self.total, self.count))
                for row, first, last, pairs, root, ok in held:
                    roll = shifts[row]
                    a, b = self._bounds(roll, n)
                    a, b = max(a, first + roll), min(b, last + roll)
                    if a < b:
                        into, take = slice(a - self.lo, b - self.lo), slice(a - roll - first, b - roll - first)
                        for to, of in pairs[i]:
                            total[into, to] += root[take, of]
                            count[into, to] += ok[take, of]
                self.total[si, mine], self.count[si, mine] = total.T, count.T

    def power(self) -> np.ndarray:
        """Smoothed power of every cell, -1 where it has none; takes the place of the sums."""
        p = self.plan
        n = self.length or 0
        inside = max(0, min(self.hi, n) - self.lo)
        samples = max(1, int(round(p.power_window_s * p.sr)))
        for si in range(len(self.total)):
            count = self.count[si, :, :inside]
            mean = self.total[si, :, :inside] / np.maximum(count, 1)
            beam = stack.raised(mean, p.order)
            power, has = stack.tapered_power(beam, count >= p.min_support, samples)
            self.total[si] = -1.0
            self.total[si, :, :inside] = np.where(has, power, -1.0)
        return self.total

    def found(self, occupancy: bool, peaks: bool) -> Iterator[tuple]:
        """Rows of ``FOUND``: marked cells of every window and threshold, and the peaks of every window."""
        p, power = self.plan, self.power()
        for phase, t_min, t_max in p.windows:
            i0 = max(0, int(np.ceil((t_min + p.pre_s) * p.sr - 1e-9)) - self.lo)
            i1 = min(self.hi - self.lo, int(np.floor((t_max + p.pre_s) * p.sr + 1e-9)) + 1 - self.lo)
            if i0 >= i1:
                continue
            for k in range(self.first // p.per_set, (self.last - 1) // p.per_set + 1):
                a, b = max(self.first, k * p.per_set), min(self.last, (k + 1) * p.per_set)
                cells = power[:, a - self.first:b - self.first, i0:i1]
                top = cells.max(axis=(0, 2))
                live = np.flatnonzero(top >= 0)
                for thr in p.thresholds if occupancy and len(live) else ():
                    level = np.where(top >= 0, thr / 100.0 * (1.0 - SLACK) * top, np.inf)
                    marked = (cells >= level[None, :, None]).sum(axis=1, dtype=np.int32)
                    si, ti = np.nonzero(marked)
                    yield (k, phase, thr, si, ti + i0 + self.lo, marked[si, ti], None, None, None)
                if peaks and len(live):
                    flat = cells.transpose(1, 0, 2).reshape(cells.shape[1], -1)[live]
                    best = flat.argmax(axis=1)  # the first: least slowness, then least time
                    si, ti = np.divmod(best, i1 - i0)
                    at = self.count[si, live + a - self.first, ti + i0]
                    yield (k, phase, None, si, ti + i0 + self.lo, None, live + a - k * p.per_set, top[live], at)


def _by_row(col: pa.ListArray, width: int) -> np.ndarray:
    out = stack._ragged(col, width, np.float64)
    if (np.diff(np.asarray(col.offsets)) != width).any():
        raise ValueError("distances must give one value per set")
    return out


def _found_batch(rows: list[tuple], head: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    kinds = [("si", pa.int32()), ("ti", pa.int32()), ("n", pa.int32()), ("real", pa.int32()), ("power", pa.float64()), ("support", pa.int32())]
    cols = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())]
    cols += [pa.array([None if r[3 + i] is None else np.asarray(r[3 + i]).tolist() for r in rows], pa.list_(t)) for i, (_, t) in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(
        [*[pa.array([h.as_py()] * len(rows), h.type) for h in head], *cols], [*names, "set", "phase", "threshold_pct", *[k for k, _ in kinds]])


def _heavy(traces: DataFrame, lanes: Sequence[str], per_group: int) -> DataFrame | None:
    """(lanes, groups) of the lanes to split: more than a group's traces and over a thousandth of all, so a thousand at most."""
    counts = traces.groupBy(*lanes).agg(F.count("*").alias("traces"))
    total = counts.agg(F.sum("traces")).first()[0] or 0
    rows = counts.where((F.col("traces") > per_group) & (F.col("traces") * HEAVY_SHARE > total)).select(
        *lanes, F.ceil(F.col("traces") / per_group).cast("int").alias("groups"))
    found = rows.collect()
    return traces.sparkSession.createDataFrame(found, rows.schema) if found else None


def _same(lanes: Sequence[str], other: str):
    cond = F.lit(True)
    for c in lanes:
        cond = cond & F.col(f"t.{c}").eqNullSafe(F.col(f"{other}.{c}"))
    return cond


def resampled(
    traces: DataFrame, lanes: Sequence[str], plan: Design, *, occupancy: bool = True, peaks: bool = False, per_group: int = PER_GROUP,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Rows (lanes, ``FOUND``) of the nth-root power grids of every realisation.

    A trace is one row: lanes, distance, x, valid, and if given ``members array<int>`` (the members of a set that take
    it; all by default), ``jitter_s array<double>`` in the order of the members, ``distances array<double>`` (one for
    every set; its own by default). Traces of a lane must have one length. Lanes are counted in jobs of their own: ``sizes``, a
    row with the lanes of every trace, spares them the work that made the traces.
    """
    more = [c for c in ("members", "jitter_s", "distances") if c in traces.columns]
    source = traces.select(*lanes, "distance", "x", "valid", *more)
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    lane_ddl = ", ".join(f"`{c}` {types[c]}" for c in lanes)
    numbers = F.explode(F.sequence(F.lit(0), F.lit(plan.blocks - 1))).alias("block")

    def whole(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(plan, key[-1].as_py())
        for batch in batches:
            if batch.num_rows:
                block.take(batch)
        rows = list(block.found(occupancy, peaks))
        if rows:
            yield _found_batch(rows, list(key[:-1]), list(lanes))

    heavy = _heavy(source if sizes is None else sizes, lanes, per_group)
    if heavy is None:
        return source.select("*", numbers).groupBy(*lanes, "block").applyInArrow(whole, f"{lane_ddl}, {FOUND}")

    def partial(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(plan, key[-1].as_py())
        for batch in batches:
            if batch.num_rows:
                block.take(batch)
        for part, at in enumerate(range(0, block.last - block.first, plan.per_part)):
            yield from _sums(block, slice(at, at + plan.per_part), key[:-2], key[-2].as_py() // FAN_IN, key[-1].as_py(), part)

    def _sums(block: Block, reals: slice, head: tuple, src: int, number: int, part: int) -> Iterator[pa.RecordBatch]:
        for si in range(len(plan.slowness)):
            cols = [pa.array([h.as_py()], h.type) for h in head]
            cols += [pa.array([v], pa.int32()) for v in (src, number, part, si, block.length)]
            cols += [stack._list_array(block.total[si, reals].reshape(1, -1), pa.float64()), stack._list_array(block.count[si, reals].reshape(1, -1), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, [*lanes, "src", "block", "part", "si", "length", "total", "count"])

    def added(number: int, part: int, batches: Iterator[pa.RecordBatch]) -> Block:
        block = Block(plan, number, part)
        for batch in batches:
            if batch.num_rows:
                block.length = stack.one_length(batch.select(["length"]).rename_columns(["n"]), block.length)
                for i, si in enumerate(batch.column("si").to_pylist()):
                    for name, into in (("total", block.total), ("count", block.count)):
                        col = batch.column(name)
                        a, b = col.offsets[i].as_py(), col.offsets[i + 1].as_py()
                        into[si] += np.asarray(col.values)[a:b].reshape(into[si].shape)
        return block

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, number, part = (k.as_py() for k in key[-3:])
        yield from _sums(added(number, part, batches), slice(None), key[:-3], src, number, part)

    def finished(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(added(key[-2].as_py(), key[-1].as_py(), batches).found(occupancy, peaks))
        if rows:
            yield _found_batch(rows, list(key[:-2]), list(lanes))

    small = F.broadcast(heavy).alias("h")
    light = source.alias("t").join(small, _same(lanes, "h"), "left_anti")
    split = source.alias("t").join(small, _same(lanes, "h")).select("t.*", F.pmod(F.xxhash64("t.distance", "t.x"), F.col("groups")).cast("int").alias("grp"))
    sums = f"{lane_ddl}, src int, block int, part int, si int, length int, total array<double>, count array<int>"
    parts = split.select("*", numbers).groupBy(*lanes, "grp", "block").applyInArrow(partial, sums)
    parts = parts.groupBy(*lanes, "src", "block", "part").applyInArrow(merged, sums)
    far = parts.groupBy(*lanes, "block", "part").applyInArrow(finished, f"{lane_ddl}, {FOUND}")
    near = light.select("*", numbers).groupBy(*lanes, "block").applyInArrow(whole, f"{lane_ddl}, {FOUND}")
    return near.unionByName(far)


def occupancy(found: DataFrame, lanes: Sequence[str], plan: Design) -> DataFrame:
    """(lanes, set, phase, threshold_pct, si, ti, frac): share of a set's realisations in which a cell is marked."""
    keys = [*lanes, "set", "phase", "threshold_pct"]
    rows = found.where("threshold_pct is not null").select(*keys, F.explode(F.arrays_zip("si", "ti", "n")).alias("c"))
    return rows.groupBy(*keys, F.col("c.si").alias("si"), F.col("c.ti").alias("ti")).agg((F.sum("c.n") / F.lit(float(plan.per_set))).alias("frac"))


def realisation_peaks(found: DataFrame, lanes: Sequence[str], plan: Design) -> DataFrame:
    """(lanes, set, real, phase, time_s, slowness_sdeg, power, slow_idx, time_idx, support_count): the peak of every realisation and window."""
    nodes = F.array(*[F.lit(s) for s in plan.slowness])
    rows = found.where("threshold_pct is null").select(*lanes, "set", "phase", F.explode(F.arrays_zip("real", "si", "ti", "power", "support")).alias("c"))
    return rows.select(*lanes, "set", F.col("c.real").alias("real"), "phase", (F.col("c.ti") / F.lit(plan.sr) - F.lit(plan.pre_s)).alias("time_s"),
                       F.get(nodes, F.col("c.si")).alias("slowness_sdeg"), F.col("c.power").alias("power"), F.col("c.si").alias("slow_idx"),
                       F.col("c.ti").alias("time_idx"), F.col("c.support").alias("support_count"))
