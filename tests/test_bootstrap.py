"""One-pass bootstraps against separate stacks, whatever the blocks, groups and task counts."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from beamspark.dims import SlownessAxis
from beamspark.operators import bootstrap, peaks, resample, stack
from test_stack import frame, random_rows, reference_stack

AXIS = SlownessAxis(-2.0, 0.0, 5).values
WINDOWS = {"P": (5.0, 15.0), "Q": (12.0, 22.0)}
LEVELS = (50, 85)


def plan(**more):
    args = {"per_set": 4, "sr": 2.0, "pre_s": 0.0, "power_window_s": 3.0} | more
    return bootstrap.design(AXIS, WINDOWS, LEVELS, **args)


def grid_of(rows):
    """Power and support of one stack, by NumPy alone."""
    power, support = [], []
    for s in AXIS:
        beam, count = reference_stack(rows, s, 2.0, "nth_root")
        ok = ~np.isnan(beam)
        h = stack.taper(6)
        top, weight = np.convolve(np.where(ok, beam, 0.0) ** 2, h, "same"), np.convolve(ok.astype(float), h, "same")
        power.append(np.where(ok & (weight > 0), top / np.where(weight > 0, weight, 1.0), np.nan))
        support.append(count)
    return np.array(power), np.array(support)


def expected(grids):
    """Marked cells and peaks of realisations given as (power, support)."""
    marks, tops = {}, {}
    for r, (power, support) in enumerate(grids):
        for phase, (a, b) in WINDOWS.items():
            t = np.arange(power.shape[1]) / 2.0
            cells = np.where((t >= a) & (t <= b), power, np.nan)
            if np.isnan(cells).all():
                continue
            top = np.nanmax(cells)
            si, ti = np.argwhere(cells == top)[0]
            tops[r, phase] = (int(si), int(ti), int(support[si, ti]))
            for thr in LEVELS:
                for i, j in np.argwhere(cells >= thr / 100 * top * (1 - 1e-12)):
                    marks[phase, thr, int(i), int(j)] = marks.get((phase, thr, int(i), int(j)), 0) + 1
    return marks, tops


def compared(found, design, want, lanes=("lane",)):
    marks, tops = want
    got = {(r.phase, r.threshold_pct, r.si, r.ti): r.frac for r in bootstrap.occupancy(found, list(lanes), design).where("set = 0").collect()}
    assert got == pytest.approx({k: v / design.per_set for k, v in marks.items()})
    seen = {(r.real, r.phase): (r.slow_idx, r.time_idx, r.support_count) for r in bootstrap.realisation_peaks(found, list(lanes), design).where("set = 0").collect()}
    assert seen == tops


SUBSETS = [[0, 1, 2, 5], [3, 4, 6, 7, 8], [0, 2, 4, 6, 8], [1, 3, 5, 7]]


def subset_frame(spark, rows):
    t = frame(spark, rows).withColumnRenamed("event_id", "event_index")
    return t.join(resample.design_table(spark, SUBSETS), "event_index")


@pytest.mark.parametrize("block_bytes,per_group", [(1 << 20, 400), (1, 400), (1 << 20, 2), (1, 2)])
def test_subsets_equal_separate_stacks(spark, block_bytes, per_group):
    rows = random_rows(9)
    design = plan(block_bytes=block_bytes)
    assert design.blocks == (4 if block_bytes == 1 else 1)
    found = bootstrap.resampled(subset_frame(spark, rows).repartition(5), ["lane"], design, peaks=True, per_group=per_group)
    compared(found, design, expected([grid_of([rows[i] for i in pick]) for pick in SUBSETS]))


def test_two_levels_of_merging(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "FAN_IN", 2)
    rows = random_rows(9)
    found = bootstrap.resampled(subset_frame(spark, rows), ["lane"], plan(), peaks=True, per_group=1)
    compared(found, plan(), expected([grid_of([rows[i] for i in pick]) for pick in SUBSETS]))


def test_jitter_equals_interpolated_traces(spark):
    rows = random_rows(5)
    shifts = [[0.0, 0.3, -1.25, 2.0], [0.5, 0.0, 0.1, -0.7], [0.0] * 4, [-3.0, 1.0, 0.25, 0.25], [10.0, -10.0, 40.0, -40.0]]
    t = frame(spark, rows)
    js = spark.createDataFrame(list(enumerate(shifts)), "event_id int, jitter_s array<double>")
    grids = []
    for r in range(4):
        moved = []
        for (d, x, m), s in zip(rows, shifts, strict=True):
            y, ok = stack._lerp_shift(np.asarray(x)[None, :], np.asarray(m, bool)[None, :], np.array([s[r] * 2.0]))
            moved.append((d, y[0], ok[0]))
        grids.append(grid_of(moved))
    for block_bytes, per_group in ((1 << 20, 400), (1, 2)):
        design = plan(block_bytes=block_bytes)
        compared(bootstrap.resampled(t.join(js, "event_id"), ["lane"], design, peaks=True, per_group=per_group), design, expected(grids))


def test_sets_have_their_own_distances(spark):
    """A scramble is a shift in the same pass: sets times members, in blocks that run over sets."""
    rows = random_rows(9)
    turned = [[rows[(i + k) % 9][0] for k in range(3)] for i in range(9)]
    d = spark.createDataFrame(list(enumerate(turned)), "event_index int, distances array<double>")
    t = subset_frame(spark, rows).join(d, "event_index")
    for block_bytes in (1 << 20, 5 * 60 * 12 * 5):
        design = plan(n_sets=3, block_bytes=block_bytes)
        found = bootstrap.resampled(t, ["lane"], design, peaks=True)
        for k in range(3):
            want = expected([grid_of([(turned[i][k], *rows[i][1:]) for i in pick]) for pick in SUBSETS])
            shown = found.where(F.col("set") == k).withColumn("set", F.lit(0))
            compared(shown, design, want)


def test_jitter_in_every_set(spark):
    """The nested null: each set's distances with each member's jitter, against separate stacks."""
    rows = random_rows(5)
    rng = np.random.default_rng(6)
    shifts = rng.uniform(-4, 4, (5, 4)).round(2).tolist()
    turned = [[rows[(i + k) % 5][0] for k in range(3)] for i in range(5)]
    js = spark.createDataFrame([(i, shifts[i], turned[i]) for i in range(5)], "event_id int, jitter_s array<double>, distances array<double>")
    t = frame(spark, rows).join(js, "event_id")
    for block_bytes in (1 << 20, 5 * 60 * 12 * 5, 1):
        design = plan(n_sets=3, block_bytes=block_bytes)
        found = bootstrap.resampled(t, ["lane"], design, peaks=True)
        for k in range(3):
            grids = []
            for r in range(4):
                moved = []
                for i, (_, x, m) in enumerate(rows):
                    y, ok = stack._lerp_shift(np.asarray(x)[None, :], np.asarray(m, bool)[None, :], np.array([shifts[i][r] * 2.0]))
                    moved.append((turned[i][k], y[0], ok[0]))
                grids.append(grid_of(moved))
            compared(found.where(F.col("set") == k).withColumn("set", F.lit(0)), design, expected(grids))


def test_shuffled_bytes_do_not_grow_with_tasks(spark):
    """Partial blocks depend on groups of traces: the same number of rows from 2 tasks and from 40."""
    rows = random_rows(24)
    counts = []
    for tasks in (2, 40):
        t = frame(spark, rows).withColumn("members", F.sequence(F.lit(0), F.lit(3))).repartition(tasks)
        found = bootstrap.resampled(t, ["lane"], plan(), per_group=6)
        found.collect()
        counts.append(found._jdf.queryExecution().toString().count("FlatMapGroupsInArrow"))
        assert found.count() > 0
    assert counts[0] == counts[1]


def test_odd_tables(spark):
    design = plan()
    t = frame(spark, random_rows(4))
    assert bootstrap.resampled(t.limit(0), ["lane"], design).count() == 0
    uneven = frame(spark, [(29.0, np.ones(50), np.ones(50)), (29.0, np.ones(49), np.ones(49))])
    with pytest.raises(Exception, match="unequal_lengths"):
        bootstrap.resampled(uneven, ["lane"], design).collect()
    # Windows past the end of short traces give nothing; a null lane is a lane.
    short = frame(spark, [(29.0, np.ones(5), np.ones(5))] * 3)
    assert bootstrap.resampled(short, ["lane"], design).count() == 0
    none = t.withColumn("lane", F.lit(None).cast("int"))
    assert bootstrap.occupancy(bootstrap.resampled(none, ["lane"], design, per_group=1), ["lane"], design).where("lane is null").count() > 0
    with pytest.raises(ValueError, match="at least one"):
        plan(per_set=0)


def test_power_window_is_the_convolution():
    rng = np.random.default_rng(2)
    for n, k in itertools.product((1, 2, 5, 17, 300), (1, 2, 3, 4, 8, 40, 99, 400)):
        beam, ok = rng.normal(size=(3, n)) ** 7, rng.random((3, n)) > 0.3
        power, has = stack.tapered_power(beam, ok, k)
        h = stack.taper(max(1, min(n, k)))
        for r in range(3):
            top, weight = np.convolve(np.where(ok[r], beam[r], 0.0) ** 2, h, "same"), np.convolve(ok[r].astype(float), h, "same")
            want = np.divide(top, weight, out=np.zeros(n), where=ok[r] & (weight > 0))
            assert (has[r] == (ok[r] & (weight > 0))).all()
            np.testing.assert_allclose(power[r], want, rtol=0, atol=1e-12 * max(1e-300, np.abs(want).max()))


def test_power_window_keeps_small_values_behind_large_ones():
    beam = np.concatenate([np.full(50, 1e8), np.full(200, 1e-6)])
    power, _ = stack.tapered_power(beam, np.ones(250, bool), 20)
    np.testing.assert_allclose(power[80:], 1e-12, rtol=1e-9)


def test_range_maxima():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 100):
        v, ok = rng.normal(size=n), rng.random(n) > 0.3
        lo, hi = rng.integers(0, n + 1, 200), rng.integers(-1, n + 2, 200)
        best, count = peaks.range_maxima(v, ok, lo, hi)
        for a, b, m, c in zip(lo, hi, best, count, strict=True):
            inside = v[a:min(b, n - 1) + 1][ok[a:min(b, n - 1) + 1]] if a <= min(b, n - 1) else np.zeros(0)
            assert c == len(inside) and m == (inside.max() if len(inside) else -np.inf)


def test_box_sweep_against_every_box(spark):
    rows = random_rows(6)
    g = stack.vespagram(frame(spark, rows), ["lane"], AXIS, sr=2.0, power_window_s=3.0)
    tc, sc = [-3.0 + 1.7 * i for i in range(20)], [-2.4 + 0.3 * k for k in range(9)]
    got = {(r.ic, r.kc): (r.box_max_power, r.n_supported_cells) for r in peaks.box_sweep(
        g, ["lane"], t_centers=tc, s_centers=sc, half_t=2.5, half_s=0.2, pre_s=0.0, sr=2.0).collect()}
    cells = [(r["s"], i / 2.0, p) for r in g.collect() for i, (p, n) in enumerate(zip(r["power"], r["support"], strict=True)) if p is not None and n >= 2]
    assert len(got) == len(tc) * len(sc)
    for (i, k), (m, n) in got.items():
        inside = [p for s, t, p in cells if tc[i] - 2.5 <= t <= tc[i] + 2.5 and sc[k] - 0.2 <= s <= sc[k] + 0.2]
        assert n == len(inside) and (m is None) == (not inside) and (m is None or m == max(inside))


def test_scrambled_distances_are_permutations(spark):
    t = spark.range(40).select((F.col("id") * 3 % 41).alias("event_id"), F.when(F.col("id") < 30, 0).otherwise(1).alias("lane"), (F.col("id") / 7).alias("distance"))
    score = lambda k: F.pmod(F.col("event_id") * 31 + k * 17, F.lit(13))
    rows = resample.scrambled_distances(t, "lane", 5, score).collect()
    for lane in (0, 1):
        mine = sorted((r for r in rows if r.lane == lane), key=lambda r: r.event_id)
        own = [r.distance for r in mine]
        assert [r.distances[0] for r in mine] == own
        for k in range(1, 5):
            order = sorted(mine, key=lambda r: ((r.event_id * 31 + k * 17) % 13, r.event_id))
            assert [r.distances[k] for r in mine] == [r.distance for r in order]
    assert resample.scrambled_distances(t, "lane", 1, score).where(F.size("distances") == 1).count() == 40


def test_lanes_are_counted_without_the_designs(spark):
    """``sizes`` stands in for the traces where lanes are counted, and single sets gather what products add."""
    t = frame(spark, random_rows()).withColumn("distances", F.array(*[F.col("distance") + 0.3 * k for k in range(5)]))
    alone, twice = plan(per_set=1, n_sets=5), plan(per_set=2, n_sets=5)
    lane = spark.createDataFrame([(0,)] * 17, "lane int")
    for per_group in (400, 5):
        found = {}
        for name, p in (("alone", alone), ("twice", twice)):
            rows = bootstrap.occupancy(bootstrap.resampled(t, ["lane"], p, per_group=per_group, sizes=lane), ["lane"], p).collect()
            found[name] = {(r["set"], r.phase, r.threshold_pct, r.si, r.ti): r.frac for r in rows}
        assert found["alone"] == found["twice"] and found["alone"]


def test_jitter_interpolates_a_trace_once(monkeypatch):
    """However many members and sets a trace has, it is moved by all its jitters in one step; a member that stands twice counts twice."""
    calls, lerped = [], bootstrap._lerped
    monkeypatch.setattr(bootstrap, "_lerped", lambda *a: calls.append(1) or lerped(*a))
    rng = np.random.default_rng(3)
    x, ok = rng.normal(size=(3, 60)), rng.random((3, 60)) > 0.1
    members, jitter = [[0, 1, 2, 3], [3, 1, 3], [0, 2]], [[0.0, 0.3, -1.25, 40.0], [0.5, -0.7, 0.5], [2.0, -300.0]]
    near = [[28.0, 30.0], [31.0, 28.0], [30.0, 31.0]]
    batch = pa.RecordBatch.from_pydict({
        "x": x.tolist(), "valid": ok.tolist(), "distance": [d[0] for d in near], "distances": near,
        "members": pa.array(members, pa.list_(pa.int32())), "jitter_s": jitter})
    design = plan(n_sets=2, min_support=1)
    block = bootstrap.Block(design, 0)
    block.take(batch)
    assert len(calls) == 3
    total, count = np.zeros(block.total.shape), np.zeros(block.count.shape, int)
    for i in range(3):
        for k in range(2):
            for m, shift in zip(members[i], jitter[i], strict=True):
                y, has = stack._lerp_shift(x[i][None, :], ok[i][None, :], np.array([shift * design.sr]))
                root = np.where(has[0], stack.rooted(y[0], design.order), 0.0)
                for si, roll in enumerate(block.rolls(np.array([near[i][k]]))[:, 0]):
                    for t in range(max(block.lo, roll), min(block.hi, 60, 60 + roll)):
                        total[si, k * design.per_set + m, t - block.lo] += root[t - roll]
                        count[si, k * design.per_set + m, t - block.lo] += has[0][t - roll]
    np.testing.assert_array_equal(block.count, count)
    np.testing.assert_allclose(block.total, total, atol=1e-12)
    broken = batch.set_column(5, "jitter_s", pa.array([[0.0, float("nan"), 0.0, 0.0], *jitter[1:]]))
    with pytest.raises(ValueError, match="finite"):
        bootstrap.Block(design, 0).take(broken)


def test_partial_blocks_are_added_in_parts(spark):
    """A block of a split lane is added up and searched in parts: no task takes all its realisations."""
    rows = random_rows(9)
    design = plan(part_bytes=1)
    assert design.blocks == 1 and design.per_part == 1
    found = bootstrap.resampled(subset_frame(spark, rows), ["lane"], design, peaks=True, per_group=1)
    # A row of peaks has the realisations of one part.
    assert found.where("threshold_pct is null and size(real) > 1").count() == 0
    compared(found, design, expected([grid_of([rows[i] for i in pick]) for pick in SUBSETS]))
