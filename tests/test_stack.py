import numpy as np
import pytest
from pyspark.sql import functions as F

from beamspark.dims import SlownessAxis
from beamspark.operators import peaks, stack

DDL = "event_id int, lane int, distance double, x array<double>, valid array<boolean>"


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, 0, float(d), [float(v) for v in x], [bool(v) for v in m]) for i, (d, x, m) in enumerate(rows)], DDL)


def reference_stack(rows, s, sr, method="linear", order=4.0, min_support=2):
    """Plain NumPy stack of one slowness."""
    n = len(rows[0][1])
    acc, cnt = np.zeros(n), np.zeros(n, int)
    for d, x, m in rows:
        roll = int(np.rint(-s * (d - 29.0) * sr))
        v = np.where(m, x, 0.0)
        v = np.sign(v) * np.abs(v) ** (1 / order) if method == "nth_root" else v
        for i in range(n):
            if m[i] and 0 <= i + roll < n:
                acc[i + roll] += v[i]
                cnt[i + roll] += 1
    mean = acc / np.maximum(cnt, 1)
    mean = np.sign(mean) * np.abs(mean) ** order if method == "nth_root" else mean
    return np.where(cnt >= min_support, mean, np.nan), cnt


def random_rows(n_traces=17, n=50, seed=1):
    rng = np.random.default_rng(seed)
    return [(27.0 + 0.37 * i, rng.normal(size=n), rng.random(n) > 0.2) for i in range(n_traces)]


def test_roll_index(spark):
    d = spark.createDataFrame([(29.0,), (29.5,), (30.0,), (31.0,)], "d double")
    got = [r[0] for r in d.select(stack.roll_samples(F.lit(-7.0), F.col("d"), 29.0, 20.0)).collect()]
    assert got == [0, 70, 140, 280]


def test_roll_rounds_half_to_even(spark):
    d = spark.createDataFrame([(29.5,), (30.5,), (31.5,)], "d double")
    got = [r[0] for r in d.select(stack.roll_samples(F.lit(-1.0), F.col("d"), 29.0, 1.0)).collect()]
    assert got == [0, 2, 2]


@pytest.mark.parametrize("roll,want", [
    (3, [0, 0, 0, 0, 1, 2, 3, 4, 5, 6]), (-3, [3, 4, 5, 6, 7, 8, 9, 0, 0, 0]), (10, [0] * 10), (-10, [0] * 10)])
def test_shift_never_wraps(spark, roll, want):
    d = spark.createDataFrame([([float(i) for i in range(10)],)], "x array<double>")
    assert d.select(stack.shift_zero_fill(F.col("x"), F.lit(roll))).first()[0] == [float(v) for v in want]


def test_delta_alignment(spark):
    rows = []
    for i in range(10):
        d = 29.0 + 0.5 * i
        x = np.zeros(3000)
        x[1200 - int(np.rint(7.0 * (d - 29.0) * 20))] = 1.0
        rows.append((d, x, np.ones(3000, bool)))
    g = stack.vespagram(frame(spark, rows), ["lane"], [-7.0], sr=20.0, method="linear", power_window_s=None).first()
    beam = np.array([np.nan if v is None else v for v in g["beam"]])
    assert np.nanargmax(beam) == 1200 and beam[1200] == 1.0


def test_support_divides_by_valid_contributors(spark):
    rows = [(29.0, [1.0, 1, 99, 99, 1], [1, 1, 0, 0, 1]), (29.0, [99.0, 3, 3, 3, 99], [0, 1, 1, 1, 0])]
    g = stack.vespagram(frame(spark, rows), ["lane"], [-1.0], sr=1.0, method="linear", min_support=1, power_window_s=None)
    assert g.first()["beam"] == [1.0, 2.0, 3.0, 3.0, 1.0]


def test_support_map_and_null_power(spark):
    t = [1, 1, 1, 1, 0, 0, 0, 0]
    rows = [(29.0, np.ones(8), np.ones(8)), (31.0, np.ones(8), t)]
    g = stack.vespagram(frame(spark, rows), ["lane"], [-1.0], sr=1.0, method="linear", power_window_s=1.0).first()
    assert g["support"] == [1, 1, 2, 2, 2, 2, 1, 1]
    assert g["power"][0] is None and g["power"][2] is not None


def test_min_support_must_be_positive(spark):
    with pytest.raises(ValueError):
        stack.vespagram(frame(spark, random_rows(2)), ["lane"], [-1.0], sr=1.0, min_support=0)


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        stack.vespagram(frame(spark, random_rows(2)), ["lane"], [-1.0], sr=1.0, method="median")


def test_phase_weights_favour_coherence(spark):
    t = np.arange(512)
    same = [(29.0, np.sin(0.2 * t), np.ones(512)) for _ in range(8)]
    apart = [(29.0, np.sin(0.2 * t + k * 2 * np.pi / 8), np.ones(512)) for k in range(8)]
    beams = []
    for rows in (same, apart):
        g = stack.vespagram(frame(spark, rows), ["lane"], [0.0], sr=1.0, method="pws", power_window_s=None)
        beams.append(np.array(g.first()["beam"]))
    assert np.allclose(beams[0], same[0][1], atol=1e-9)
    assert np.sqrt((beams[1] ** 2).mean()) < 0.1 * np.sqrt((beams[0] ** 2).mean())


@pytest.mark.parametrize("method", ["linear", "nth_root"])
@pytest.mark.parametrize("how", ["plain", "tiny_buffer", "dealt", "gathered"])
def test_grid_agrees_with_numpy(spark, method, how):
    rows, axis = random_rows(), SlownessAxis(-2.0, 0.0, 5)
    t = frame(spark, rows).repartition(4)
    args = {"buffer_bytes": 1} if how == "tiny_buffer" else {"blocks": 3} if how == "dealt" else {}
    if how == "gathered":
        t = stack.gathered(t, ["lane"], per_task=5)
    g = stack.vespagram(t, ["lane"], axis.values, sr=2.0, method=method, power_window_s=3.0, **args).collect()
    assert sorted(r["si"] for r in g) == list(range(5))
    for r in g:
        want, cnt = reference_stack(rows, r["s"], 2.0, method)
        got = np.array([np.nan if v is None else v for v in r["beam"]])
        assert r["support"] == cnt.tolist()
        np.testing.assert_allclose(got, want, atol=1e-12)


def test_builtin_form_agrees(spark):
    rows, axis = random_rows(), SlownessAxis(-2.0, 0.0, 5).values
    t = frame(spark, rows)
    a = stack.cells(stack.vespagram(t, ["lane"], axis, sr=2.0, power_window_s=None), ["lane"], pre_s=0.0, sr=2.0)
    b = stack.long_form_stack(t, ["lane"], axis, ref=29.0, sr=2.0, method="nth_root")
    j = a.where("support > 0").select("si", "ti", "beam").join(
        b.select("si", "ti", F.col("beam").alias("b2")), ["si", "ti"], "full")
    bad = j.where("(beam IS NULL) <> (b2 IS NULL) OR abs(beam - b2) > 1e-12")
    assert bad.count() == 0


def test_time_range_reads_the_same_power(spark):
    t, axis = frame(spark, random_rows(n=120)), [-1.0, -0.5]
    lo, hi = stack.window_range(20.0, 30.0, 0.0, 2.0, 5.0)
    full = {r["si"]: r["power"] for r in stack.vespagram(t, ["lane"], axis, sr=2.0, power_window_s=5.0).collect()}
    part = {r["si"]: r["power"] for r in
            stack.vespagram(t, ["lane"], axis, sr=2.0, power_window_s=5.0, time_range=(lo, hi)).collect()}
    for si in full:
        a = [np.nan if v is None else v for v in full[si][40:61]]
        b = [np.nan if v is None else v for v in part[si][40 - lo : 61 - lo]]
        np.testing.assert_allclose(a, b)


def test_determinism_over_partitioning(spark):
    rows, axis = random_rows(40), SlownessAxis(-2.0, 0.0, 4).values
    out = []
    for parts in (1, 7):
        g = stack.vespagram(frame(spark, rows).repartition(parts), ["lane"], axis, sr=2.0, power_window_s=3.0)
        c = stack.cells(g, ["lane"], pre_s=0.0, sr=2.0).select("si", "ti", F.round("power", 9).alias("p"))
        out.append(sorted((r["si"], r["ti"], r["p"] is None, r["p"] or 0.0) for r in c.collect()))
    assert out[0] == out[1]


def test_ties_go_to_first_slowness_then_time(spark):
    c = spark.createDataFrame(
        [(0, s, float(s), t, float(t), 1.0, 3) for s in range(3) for t in range(4)],
        "lane int, si int, s double, ti int, t double, power double, support int")
    p = peaks.global_peak(c, ["lane"], 1.0, 3.0).first()
    assert (p["slow_idx"], p["time_idx"]) == (0, 1)


def test_empty_window_and_low_support_keep_a_row(spark):
    c = spark.createDataFrame([(0, 0, 0.0, 0, 0.0, 1.0, 1)],
                              "lane int, si int, s double, ti int, t double, power double, support int")
    assert peaks.global_peak(c, ["lane"], 5.0, 6.0).first()["status"] == "blocked_empty_window"
    low = peaks.global_peak(c, ["lane"], 0.0, 1.0).first()
    assert low["status"] == "blocked_low_support" and low["time_idx"] == -1
    assert peaks.second_peak(c, ["lane"], 0.0, 1.0).first()["status"] == "blocked_prerequisite_peak"


def test_plateau_counts_as_local_maximum(spark):
    c = spark.createDataFrame([(0, s, float(s), t, float(t), 2.0 if t < 2 else 1.0, 3) for s in range(2) for t in range(4)],
                              "lane int, si int, s double, ti int, t double, power double, support int")
    flags = {(r["si"], r["ti"]): r["is_local_max"] for r in peaks.local_maxima(c, ["lane"]).collect()}
    assert flags[(0, 0)] and flags[(1, 1)] and not flags[(0, 2)] and flags[(0, 3)]


def test_peak_table_has_its_36_columns_and_five_rows_per_lane(spark):
    from beamspark.operators import detect
    from beamspark.sources.sinks import PEAK_COLUMNS

    lanes = ["mode", "input_type", "norm_variant", "polarization_operator", "stack_method", "power_window_s"]
    rows = [("paperfaith", "envelope", "A", "mk", "nth_root", "20.0", s, -10.0 + s * 0.5, t, 500.0 + 10.0 * t,
             1.0 / (1 + abs(s - 7) + abs(t - 11)), 5) for s in range(21) for t in range(110)]
    c = spark.createDataFrame(rows, ", ".join(f"{x} string" for x in lanes)
                              + ", si int, s double, ti int, t double, power double, support int")
    err = c.select(*lanes).distinct().withColumns({"median_distance_error_deg": F.lit(1.0), "max_distance_error_deg": F.lit(2.0)})
    got = detect.peak_table(c, lanes, err).toPandas().set_index("peak_label")
    assert list(got.reset_index().columns.drop("peak_label")) == [x for x in PEAK_COLUMNS if x != "peak_label"]
    assert sorted(got.index) == ["global", "paper_target", "peak_1", "peak_2", "published_target"]
    g = got.loc["global"]
    assert (g["time_s"], g["slowness_sdeg"], g["target_box_rank"]) == (610.0, -6.5, 1) and g["local_max_neighbor_check"]
    assert g["dt_vs_paper_s"] == 6.0 and not g["within_published_tolerance"] and g["within_uncertainty_folded_tolerance"]
    assert g["uncertainty_folded_time_tolerance_s"] == 8.5 and g["normalization_lane"] == "headline_targeted_window_eq1"
    assert got.loc["published_target"]["box_total_cell_count"] == 12
    assert got.loc["peak_1"]["time_s"] == 1200.0 and got.loc["peak_2"]["status"] == "ok"


def test_row_peaks_equal_cell_peaks(spark):
    g = stack.vespagram(frame(spark, random_rows(n=60)), ["lane"], SlownessAxis(-2.0, 0.0, 5).values, sr=2.0, power_window_s=3.0)
    c = stack.cells(g, ["lane"], pre_s=3.0, sr=2.0)
    for window in ((0.0, 20.0), (500.0, 600.0)):
        a = peaks.global_peak(c, ["lane"], *window).first()
        b = peaks.global_peak_of_rows(g, ["lane"], *window, pre_s=3.0, sr=2.0).first()
        assert a == b


@pytest.mark.parametrize("parts", [1, 3, 8])
@pytest.mark.parametrize("method", ["linear", "pws"])
def test_unequal_lengths_are_refused(spark, parts, method):
    rows = [(0, 30.0, [1.0] * n, [True] * n) for n in (16, 16, 24)]
    t = spark.createDataFrame(rows, "lane int, distance double, x array<double>, valid array<boolean>").repartition(parts)
    for span in (None, (0, 8)):
        with pytest.raises(Exception, match="unequal_lengths"):
            stack.vespagram(t, ["lane"], [-1.0, 0.0], sr=2.0, method=method, power_window_s=None, time_range=span).collect()
    short = spark.createDataFrame([(0, 30.0, [1.0] * 4, [True] * 3)], "lane int, distance double, x array<double>, valid array<boolean>")
    with pytest.raises(Exception, match="mask_shape_mismatch"):
        stack.vespagram(short, ["lane"], [0.0], sr=2.0, power_window_s=None).collect()


@pytest.mark.parametrize("method", ["linear", "nth_root", "pws"])
def test_two_level_merge_gives_the_same_stack(spark, method):
    rng = np.random.default_rng(5)
    rows = [(i % 2, float(28 + i % 5), rng.normal(size=12).tolist(), (rng.random(12) < 0.9).tolist()) for i in range(40)]
    t = spark.createDataFrame(rows, "lane int, distance double, x array<double>, valid array<boolean>").repartition(8)
    args = {"sr": 2.0, "method": method, "power_window_s": 2.0}
    one, two = (stack.vespagram(t, ["lane"], [-1.0, 0.0, 0.5], fan_in=f, **args).orderBy("lane", "si").collect() for f in (None, 3))
    assert len(one) == len(two) == 6
    for a, b in zip(one, two):
        assert a["support"] == b["support"]
        for c in ("beam", "power"):
            np.testing.assert_allclose([np.nan if v is None else v for v in a[c]], [np.nan if v is None else v for v in b[c]], rtol=1e-12, atol=1e-12)


def test_order_of_arrival_does_not_change_a_bit(spark):
    """Partial rows come from the shuffle in any order; a grid evaluated twice must still have the same bits."""
    rng = np.random.default_rng(5)
    parts = []
    for src in range(40):
        acc = (rng.normal(size=30) * 10.0 ** rng.integers(-6, 6, size=30)).tolist()
        parts.append((0, 0, 0, acc, [1] * 30, 30, src))
    ddl = "lane int, real int, si int, acc0 array<double>, cnt array<int>, n int, src int"
    seen = set()
    for order in range(6):
        shuffled = [parts[i] for i in np.random.default_rng(order).permutation(40)]
        p = spark.createDataFrame(shuffled, ddl).coalesce(1)
        for got in (stack.merge_grids(p, ["lane"], [0.0], method="nth_root").first().beam, stack.sum_partials(p, ["lane", "si"]).first().acc0):
            seen.add(np.asarray(got).tobytes())
    assert len(seen) == 2  # one of each step


def test_equal_short_windows_have_equal_power_anywhere():
    """A run of values gives the same bits at every place: ties then go to the first cell, as registered."""
    run = np.random.default_rng(2).normal(size=9) ** 4
    beam = np.zeros(64)
    for at in (7, 22, 41):
        beam[at:at + 9] = run
    power, _ = stack.tapered_power(beam, np.ones(64, bool), 5)
    for at in (22, 41):
        assert (power[at:at + 9] == power[7:16]).all()
