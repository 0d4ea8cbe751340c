import numpy as np
import pytest
from pyspark.sql import functions as F

from beamspark.operators import grading, resample, stack
from beamspark.dims import SlownessAxis
from test_stack import frame, random_rows

AXIS = SlownessAxis(-2.0, 0.0, 5).values


def test_seeded_designs_repeat_the_stated_generator():
    rng = np.random.default_rng(13)
    assert resample.seeded_subsets(7, 3, 13) == [sorted(rng.choice(np.arange(7), 4, replace=False).tolist()) for _ in range(3)]
    np.testing.assert_array_equal(resample.seeded_jitter(4, 2, 5)[0], np.random.default_rng(5).uniform(-10, 10, 4))
    perms = resample.seeded_permutations(3, 20, 7)
    assert perms[0] == [0, 1, 2] and [0, 1, 2] not in perms[1:] and len(perms) == 21
    # Stated values: each realisation has a generator of its own.
    for r in range(1, 21):
        rng = np.random.default_rng(7 + r)
        drawn = rng.permutation(3).tolist()
        assert perms[r] == (drawn if drawn != [0, 1, 2] else rng.permutation(3).tolist()) or drawn == [0, 1, 2]
    assert resample.seeded_permutations(5, 3, 7)[2] == np.random.default_rng(9).permutation(5).tolist()
    with pytest.raises(ValueError, match="two events"):
        resample.seeded_permutations(1, 3, 0)


def test_strata_pathology():
    with pytest.raises(ValueError, match="blocked_distance_cluster_pathology"):
        resample.seeded_strata([40.0, 41.0, 42.0], 2, 0)
    picks = resample.seeded_strata([29, 30, 31, 32, 40, 41, 42, 43, 44], 4, 1)
    assert all(sum(i < 4 for i in p) == 3 and len(p) == 6 for p in picks)


def test_fidelity_levels():
    assert resample.fidelity("methods_robustness_200", 200)["published_equivalent"] is False
    with pytest.raises(ValueError):
        resample.fidelity("published_uncertainty_10000", 200)
    with pytest.raises(ValueError):
        resample.fidelity("other", 200)


def test_subset_members_are_exact_and_skew_proof(spark):
    t = spark.range(3000).select(F.col("id").alias("event_id"), F.when(F.col("id") < 2500, 0).otherwise(F.col("id") % 5 + 1).alias("lane"))
    score = lambda r: F.pmod(F.xxhash64("event_id", r), F.lit(1 << 20)).cast("int")
    m = resample.with_subset_members(t, "lane", 4, score, 1 << 20)
    coarse = resample.with_subset_members(t, "lane", 4, lambda r: score(r) % 3, 3)
    assert coarse.select(F.sum(F.size("members"))).first()[0] == m.select(F.sum(F.size("members"))).first()[0]
    n = m.select("lane", F.explode("members").alias("r")).groupBy("lane", "r").count().collect()
    size = {r["lane"]: r["count"] for r in t.groupBy("lane").count().collect()}
    assert len(n) == 4 * len(size) and all(r["count"] == max(2, size[r["lane"]] * 2 // 3) for r in n)


def test_subset_strata_refuse_short_lanes(spark):
    t = spark.range(30).select(F.col("id").alias("event_id"), F.lit(0).alias("lane"), (F.col("id") < 2).alias("inside"))
    score = lambda r: F.pmod(F.xxhash64("event_id", r), F.lit(1000)).cast("int")
    with pytest.raises(Exception, match="blocked_distance_cluster_pathology"):
        resample.with_subset_members(t, "lane", 2, score, 1000, F.col("inside")).collect()


def test_members_give_the_same_grid_as_separate_stacks(spark):
    rows = random_rows(9)
    subsets = resample.seeded_subsets(9, 3, 4)
    t = frame(spark, rows).withColumnRenamed("event_id", "event_index")
    g = stack.vespagram(t.join(resample.design_table(spark, subsets), "event_index"), ["lane"], AXIS, sr=2.0, power_window_s=3.0)
    got = {(r["real"], r["si"]): r["power"] for r in g.collect()}
    for real, pick in enumerate(subsets):
        one = stack.vespagram(frame(spark, [rows[i] for i in pick]), ["lane"], AXIS, sr=2.0, power_window_s=3.0).collect()
        for r in one:
            a = np.array([np.nan if v is None else v for v in got[(real, r["si"])]])
            b = np.array([np.nan if v is None else v for v in r["power"]])
            np.testing.assert_allclose(a, b, atol=1e-12)


def test_zero_jitter_changes_nothing(spark):
    t = frame(spark, random_rows(6))
    plain = {r["si"]: r["beam"] for r in stack.vespagram(t, ["lane"], AXIS, sr=2.0, power_window_s=None).collect()}
    j = t.withColumns({"members": F.array(F.lit(0)), "jitter_s": F.array(F.lit(0.0))})
    for r in stack.vespagram(j, ["lane"], AXIS, sr=2.0, power_window_s=None, blocks=2).collect():
        a, b = ([np.nan if v is None else v for v in beam] for beam in (r["beam"], plain[r["si"]]))
        np.testing.assert_allclose(a, b, atol=1e-12)


def test_occupancy_bounds_and_repeat(spark):
    t = frame(spark, random_rows(7, n=60)).withColumn("members", F.sequence(F.lit(0), F.lit(10)))
    g = stack.vespagram(t, ["lane"], AXIS, sr=2.0, power_window_s=3.0)
    runs = [resample.occupancy(g, ["lane"], {"P": (5.0, 20.0)}, (50, 85), 11, pre_s=0.0, sr=2.0).orderBy(
        "threshold_pct", "si", "ti").collect() for _ in range(2)]
    assert runs[0] == runs[1]
    assert all(0 < r["frac"] <= 1 and 10 <= r["ti"] <= 40 for r in runs[0])
    assert {r["threshold_pct"] for r in runs[0] if r["frac"] == 1.0} == {50, 85}


def test_leave_one_out_equals_direct_stacks(spark):
    rows = random_rows(8, n=60)
    got = {r["event_id"]: r for r in resample.leave_one_out(
        frame(spark, rows), "lane", AXIS, ref=29.0, sr=2.0, pre_s=0.0, window=(5.0, 25.0), power_window_s=3.0,
        group_traces=3).collect()}
    assert len(got) == 8
    for held in range(8):
        t = frame(spark, [r for i, r in enumerate(rows) if i != held])
        best = (-1.0, None, None)
        for r in sorted(stack.vespagram(t, ["lane"], AXIS, sr=2.0, power_window_s=3.0).collect(), key=lambda r: r["si"]):
            for i, v in enumerate(r["power"]):
                if v is not None and 5.0 <= i / 2.0 <= 25.0 and v > best[0]:
                    best = (v, r["si"], i)
        assert (got[held]["slow_idx"], got[held]["time_idx"]) == best[1:]
        assert got[held]["power"] == pytest.approx(best[0])


def test_components():
    grid = np.array([[1, 1, 0, 0, 1], [0, 1, 0, 1, 1], [0, 0, 0, 0, 0], [1, 0, 1, 1, 1], [1, 1, 1, 0, 1]])
    assert resample.count_components(*np.nonzero(grid)) == 3
    assert resample.count_components(*np.nonzero(np.eye(4))) == 4


def test_pick_table_of_a_clean_map_is_not_degenerate(spark):
    t, s = np.arange(100), np.linspace(-10, 0, 21)
    occ = np.exp(-((t[None, :] - 40.0) ** 2) / 50 - ((s[:, None] + 5.0) ** 2) / 2)
    rows = [(0, "P", 85, i, j, float(occ[i, j])) for i in range(21) for j in range(100) if occ[i, j] > 1e-6]
    df = spark.createDataFrame(rows, "lane int, phase string, threshold_pct int, si int, ti int, frac double")
    r = resample.pick_table(df, ["lane"], slowness=s.tolist(), n_times=100, pre_s=0.0, sr=1.0).first()
    assert not r["degenerate_fit"] and r["fit_quality_reasons"] == ""
    assert r["mean_time"] == pytest.approx(40.0, abs=1e-3) and r["occupancy_argmax_slowness"] == -5.0
    single = df.where("si = 10 AND ti = 40")
    r = resample.pick_table(single, ["lane"], slowness=s.tolist(), n_times=100, pre_s=0.0, sr=1.0).first()
    assert r["high_occupancy_component_count"] == 1 and r["occupied_cell_count"] == 1


def test_decoys_keep_clear(spark):
    t = spark.createDataFrame([(1, 600.0), (2, 100.0)], "k int, dt double")
    d = grading.decoy_walk(t, "k", "dt", shifts=(-150.0, 150.0, 225.0), collisions=(450.0, 760.0)).collect()
    for k, dt in ((1, 600.0), (2, 100.0)):
        c = [r["center_s"] for r in d if r["k"] == k]
        assert len(c) == 3
        for v in c:
            assert 60 <= v <= 1160 and abs(v - dt) >= 60 and abs(v - 450) >= 60 and abs(v - 760) >= 60
        assert all(abs(a - b) >= 100 for i, a in enumerate(c) for b in c[:i])


def test_null_never_exceeds(spark):
    n = spark.createDataFrame([(0, 1.0), (0, None), (0, 3.0)], "g int, ridge double")
    r = grading.null_statistics(n, ["g"], {"ridge": 2.0}, {"ridge": 2.0}).first()
    assert r["far_ridge"] == pytest.approx(1 / 3) and r["p_ridge"] == pytest.approx(2 / 4) and r["ridge_nan"] == 1


def test_lanes_of_one_trace_are_refused(spark):
    t = spark.createDataFrame([(0, 1, 30.0), (0, 2, 31.0), (1, 3, 30.0)], "lane int, event_id long, distance double")
    score = lambda r: F.pmod(F.col("event_id") + r, F.lit(10)).cast("int")
    for stratum in (None, F.col("distance") < 30.5):
        with pytest.raises(Exception, match="blocked_low_event_count"):
            resample.with_subset_members(t, "lane", 2, score, 10, stratum).collect()
    assert len(resample.with_subset_members(t.where("lane = 0"), "lane", 2, score, 10).collect()) == 2


def test_rotated_distances_are_permutations(spark):
    t = spark.range(40).select((F.col("id") * 3 % 41).alias("event_id"), F.when(F.col("id") < 30, 0).otherwise(1).alias("lane"), (F.col("id") / 7).alias("distance"))
    rows = resample.rotated_distances(t, "lane", 4, 7).collect()
    for lane in (0, 1):
        mine = sorted((r for r in rows if r.lane == lane), key=lambda r: r.event_id)
        own = [r.distance for r in mine]
        assert all(r.members == [0, 1, 2, 3] for r in mine)
        for k in range(4):
            assert [r.distances[k] for r in mine] == [own[(i + 7 * k) % len(own)] for i in range(len(own))]
