import numpy as np
import pytest
from pyspark.sql import functions as F

from beamspark.functions import kernels as k
from beamspark.operators import traces as tr


def test_bandpass_gain_and_symmetry():
    x = np.zeros((1, 4096))
    x[0, 2048] = 1.0
    y = k.bandpass(x, 20.0, 0.2, 0.8)[0]
    np.testing.assert_allclose(y, y[::-1][np.r_[-1, 0:4095]], atol=1e-10)
    amp, f = np.abs(np.fft.rfft(y)), np.fft.rfftfreq(4096, 0.05)
    at = lambda hz: amp[np.argmin(np.abs(f - hz))]
    assert at(0.4) == pytest.approx(1.0, abs=1e-3)
    assert at(0.2) == pytest.approx(0.5, abs=0.02) and at(0.8) == pytest.approx(0.5, abs=0.02)
    assert at(0.05) < 1e-3 and at(2.0) < 1e-3


def test_bandpass_refuses_bad_band():
    with pytest.raises(ValueError):
        k.bandpass(np.zeros((1, 10)), 1.0, 0.2, 0.8)


@pytest.mark.parametrize("n", [2, 7, 64, 65])
def test_envelope_of_tone_is_flat(n):
    t = np.arange(n)
    x = np.cos(2 * np.pi * t * max(1, n // 8) / n)
    if n > 8:
        np.testing.assert_allclose(k.analytic_abs(x), 1.0, atol=1e-9)
    assert k.analytic_abs(x[:1])[0] == abs(x[0])


def test_runs_and_erosion():
    m = np.array([1, 1, 1, 1, 1, 0, 1, 1, 0, 1], bool)
    assert k.runs(m) == [(0, 5), (6, 8), (9, 10)]
    assert k.erode(m, 1).nonzero()[0].tolist() == [1, 2, 3]
    assert k.erode(m, 0).tolist() == m.tolist()
    assert not k.erode(m, 6).any()


def test_envelope_does_not_leak_between_runs():
    x = np.zeros(200)
    x[:100] = 50.0 * np.sin(np.arange(100))
    x[110:] = 0.01 * np.sin(np.arange(90))
    mask = np.ones(200, bool)
    mask[100:110] = False
    assert k.run_envelope(x, mask)[110:].max() < 0.1


def test_even_window_centre():
    x = np.zeros(12)
    x[5] = 1.0
    assert k.boxcar_mean(x, np.ones(12, bool), 4).nonzero()[0].tolist() == [4, 5, 6, 7]


def test_gap_fill_only_short_inner_gaps():
    x = np.arange(12.0)
    ok = np.ones(12, bool)
    ok[[0, 3, 4, 7, 8, 9]] = False
    assert k.fill_gaps(x, ok, 2).tolist() == [0, 1, 2, 3, 4, 5, 6, 0, 0, 0, 10, 11]


def test_window_starts_reach_the_end():
    assert k.window_starts(11, 4, 0.5)[1].tolist() == [0, 2, 4, 6, 7]
    assert k.window_starts(3, 10, 0.9) [0] == 3
    assert k.window_starts(0, 5, 0.9)[1].size == 0


def test_polarisation_filters():
    sr, t = 20.0, np.arange(400) / 20.0
    z = np.sin(2 * np.pi * 0.4 * t)
    noise = np.random.default_rng(7).normal(size=(3, 200))
    rec = np.vstack([z, np.zeros(400), np.zeros(400)])
    rec[:, 200:] = noise
    for out in (k.mk_filter(rec, sr)[0], k.dop_filter(rec, sr)):
        assert np.abs(out[250:]).mean() < 0.8 * np.abs(rec[0, 250:]).mean()
        assert np.abs(out[:150]).max() > 0.4
    tone = np.sin(2 * np.pi * 0.4 * np.arange(800) / sr)
    oblique = np.vstack([tone, tone, np.zeros(800)])
    mk, axis = k.mk_filter(oblique, sr)[0], k.dop_filter(oblique, sr)
    assert np.abs(mk).max() < np.abs(axis).max() and np.corrcoef(mk, tone)[0, 1] > 0.95


def test_degenerate_window_has_no_polarisation():
    axis, dop, _ = k.principal_axes(np.zeros((1, 3, 3)))
    assert axis[0].tolist() == [1.0, 0.0, 0.0] and dop[0] == 0.0


def test_fdpa_linear_motion():
    t = np.arange(1200) / 20.0
    s = np.sin(2 * np.pi * 0.4 * t)
    f = k.fdpa(np.vstack([0.0 * s, s, s]), 20.0, np.array([0.4]))
    mid = slice(400, 800)
    assert f["dop"][0, mid].min() > 0.99
    assert np.allclose(f["inclination"][0, mid], 0.0, atol=1e-6) and f["hrm"][0, mid].min() > 0.99
    dead = k.fdpa(np.zeros((3, 100)), 20.0, np.array([1.0]))
    assert np.isnan(dead["azimuth"]).all() and not dead["dop"].any()


def test_lanczos_keeps_samples_on_the_old_grid():
    x = np.random.default_rng(0).normal(size=80)
    np.testing.assert_allclose(k.lanczos(x, 2.0), x[::2], atol=1e-12)
    slow = np.sin(0.1 * np.arange(200))
    np.testing.assert_allclose(k.lanczos(slow, 0.5)[60:340:2], slow[30:170], atol=1e-12)


def test_gaussian_fit_recovers_and_falls_back():
    x = np.linspace(-50, 50, 201)
    y = 3.0 * np.exp(-((x - 7.0) ** 2) / (2 * 4.0**2)) + 0.5
    mean, sigma, ok, rms = k.gaussian_fit(x, np.vstack([y, np.zeros(201)]))
    assert ok[0] and mean[0] == pytest.approx(7.0, abs=1e-4) and sigma[0] == pytest.approx(4.0, abs=1e-4) and rms[0] < 1e-5
    assert not ok[1] and np.isnan(mean[1])
    sparse = np.array([0.0, 0.0, 1.0, 0.0])
    m, s, *_ = k.gaussian_fit(np.arange(4.0), sparse)
    assert m[0] == pytest.approx(2.0, abs=0.6) and s[0] > 0


def test_rotation_is_the_inverse_of_the_sensor_axes():
    m = tr.rotation_matrix()
    d = np.radians(-29.3)
    up = np.array([-np.sin(d)] * 3)
    np.testing.assert_allclose(m @ up, [1.0, 0.0, 0.0], atol=1e-12)


def _one(spark, x, valid=None):
    valid = [True] * len(x) if valid is None else valid
    return spark.createDataFrame([(1, [float(v) for v in x], valid)], "event_id int, x array<double>, valid array<boolean>")


def test_zscore_uses_population_deviation_and_refuses_flat(spark):
    r = tr.zscore(_one(spark, [1, 2, 3, 4]), 1.0, 0.0, 0.0, 3.0).first()
    np.testing.assert_allclose(r["z"], (np.arange(1, 5) - 2.5) / np.std([1, 2, 3, 4]))
    assert tr.zscore(_one(spark, [1] * 6), 1.0, 0.0, 0.0, 3.0).first()["norm_status"] == "blocked_zero_variance"
    assert tr.zscore(_one(spark, [1] * 6), 1.0, 0.0, 50.0, 60.0).first()["norm_status"] == "blocked_no_valid_samples"


def test_glitch_flags(spark):
    x = np.ones(100)
    x[40:45] = 100.0
    flags = tr.glitch_flags(_one(spark, x), ["event_id"], 5.0).collect()
    assert [(r["start_s"], r["end_s"]) for r in flags] == [(8.0, 9.0)]
    assert tr.glitch_flags(_one(spark, [1.0, 2.0]), ["event_id"], 5.0).count() == 0
    assert tr.glitch_flags(_one(spark, np.zeros(50)), ["event_id"], 5.0).count() == 0


def test_sample_rate_snaps(spark):
    t = spark.createDataFrame([([i * 0.05000001 for i in range(50)],), ([i * 0.07 for i in range(50)],)], "t array<double>")
    r = tr.sample_rate(F.col("t"), 20.0)
    got = [v[0] for v in t.select(r["rate_hz"]).collect()]
    assert got[0] == 20.0 and got[1] == pytest.approx(1 / 0.07)


def test_cut_pads_outside(spark):
    c = _one(spark, [1, 2, 3]).select(tr.cut_zero_padded(F.lit(-2), 6).alias("c")).first()["c"]
    assert c["x"] == [0, 0, 1, 2, 3, 0] and c["valid"] == [False, False, True, True, True, False]


def test_qc_reasons(spark):
    rng = np.random.default_rng(1)
    good, flat = rng.normal(size=100) * 1000, np.repeat([1.0, 5.0], 50)
    clipped = np.clip(rng.normal(size=100) * 1000, -600, 600)
    gap = [True] * 80 + [False] * 20
    got = [tr.qc_verdict(_one(spark, x, m)).first()["reason"] for x, m in
           ((good, None), (flat, None), (clipped, None), (good, gap), (np.ones(10), None))]
    assert got == ["", "flatline", "clipping", "coverage", "flatline_or_empty"]


def test_window_starts_against_a_plain_walk():
    for n in (1, 2, 5, 16, 17, 64):
        for win in (1, 3, 16, 40):
            for overlap in (0.0, 0.5, 0.9):
                got, starts = k.window_starts(n, win, overlap)
                hop, at, want = max(1, int(round(got * (1.0 - overlap)))), 0, []
                while at < n - got:
                    want.append(at)
                    at += hop
                assert got == min(win, n) and starts.tolist() == [*want, n - got]


def test_polarization_in_steps_equals_one_record_at_once(spark):
    from pyspark.sql import functions as F

    from beamspark.operators import traces as tr

    rng, freqs = np.random.default_rng(8), [0.3, 0.8]
    rows = [(i, *(rng.normal(size=80).tolist() for _ in range(3))) for i in range(3)] + [(3, *[[0.0] * 80] * 3)]
    df = spark.createDataFrame(rows, "event_id int, z array<double>, n array<double>, e array<double>").repartition(3)
    bands = tr.band_signals(df, ["event_id"], ["z", "n", "e"], 4.0, freqs)
    got = {(r.event_id, r.band, r.ti): r for r in tr.covered_means(tr.window_polarizations(bands, ["event_id"], 4.0), ["event_id"]).collect()}
    assert len(got) == 4 * 2 * 80
    for i, *zne in rows:
        want = k.fdpa(np.vstack(zne), 4.0, np.array(freqs))
        for b in range(2):
            for t in range(80):
                r = got[i, b, t]
                assert r.dop == pytest.approx(want["dop"][b, t]) and r.vrm == pytest.approx(want["vrm"][b, t]) and r.hrm == pytest.approx(want["hrm"][b, t])
                for mine, name in ((r.azimuth_deg, "azimuth"), (r.inclination_deg, "inclination")):
                    assert (mine is None) == np.isnan(want[name][b, t]) and (mine is None or mine == pytest.approx(want[name][b, t]))
    assert bands.select(F.size("re")).distinct().collect()[0][0] == 240


def test_pieces_of_batches():
    import pyarrow as pa

    from beamspark.operators import traces as tr

    rb = pa.RecordBatch.from_pydict({"x": [[float(i)] * 64 for i in range(5000)]})
    assert rb.nbytes > 2 * tr.PIECE_BYTES
    pieces = list(tr._pieces(iter([rb, rb.slice(0, 0), rb.slice(10, 1)])))
    assert max(p.nbytes for p in pieces) <= tr.PIECE_BYTES and [p.num_rows for p in pieces][-1] == 1
    assert pa.Table.from_batches(pieces).equals(pa.Table.from_batches([rb, rb.slice(10, 1)]))


def test_filter_bank_is_one_python_step(spark, sf_dir):
    from beamspark.plans.traces import filter_bank

    plan = filter_bank(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def _entries(cov):
    return cov[:, 0, 0].real, cov[:, 1, 1].real, cov[:, 2, 2].real, cov[:, 0, 1], cov[:, 0, 2], cov[:, 1, 2]


def test_leading_axes_against_lapack():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5000, 3, 6)) + 1j * rng.normal(size=(5000, 3, 6))
    x[:500, 1:] *= 1e-5  # nearly one direction
    x[500:600, :, 1:] = 0  # one direction and no other
    x[600:700] *= 1e-70
    x[700:800] *= 1e60
    x[800:900, 0] *= 1e-8  # hardly a first component
    cov = x @ x.conj().transpose(0, 2, 1)
    turn = np.linalg.qr(x[900:1000, :, :3])[0]  # two largest almost alike, then two smallest
    cov[900:950] = turn[:50] @ np.diag([2.0 + 1e-5, 2.0, 1.0]) @ turn[:50].conj().transpose(0, 2, 1)
    cov[950:1000] = turn[50:] @ np.diag([2.0, 1.0 + 1e-9, 1.0]) @ turn[50:].conj().transpose(0, 2, 1)
    vals, axes = k.leading_axes(*_entries(cov))
    low, vecs = np.linalg.eigh(cov)
    assert (np.abs(vals.T - np.clip(low[:, ::-1], 0, None)) <= 1e-13 * low[:, 2:]).all()
    want = vecs[:, :, -1] * np.exp(-1j * np.angle(vecs[:, :1, -1]))
    clear = (low[:, 2] - low[:, 1] > 1e-3 * low[:, 2]) & (np.abs(want[:, 0]) > 1e-4)
    assert clear.sum() > 4700 and np.abs(axes.T - want)[clear].max() < 1e-9
    # Anything the closed form cannot hold is LAPACK's own answer, bit for bit.
    odd = np.array([np.zeros((3, 3)), np.eye(3), np.diag([0.0, 2.0, 1.0]), np.full((3, 3), 1e-200)], dtype=complex)
    vals, axes = k.leading_axes(*_entries(odd))
    low, vecs = np.linalg.eigh(odd)
    assert (vals.T == np.clip(low[:, ::-1], 0, None)).all()
    assert (axes.T == vecs[:, :, -1] * np.exp(-1j * np.angle(vecs[:, :1, -1]))).all()
    with pytest.raises(np.linalg.LinAlgError):
        k.leading_axes(*_entries(np.full((1, 3, 3), np.nan + 0j)))


def test_means_in_place_equal_grouped_means(spark):
    """Records of two lengths, one without motion: means where the row lies are those of all windows brought together."""
    from beamspark.operators import traces as tr

    rng = np.random.default_rng(9)
    rows = [(i, *(rng.normal(size=48 + 16 * (i % 2)).tolist() for _ in range(3))) for i in range(5)] + [(9, *[[0.0] * 48] * 3)]
    df = spark.createDataFrame(rows, "event_id int, z array<double>, n array<double>, e array<double>").repartition(3)
    bands = tr.band_signals(df, ["event_id"], ["z", "n", "e"], 4.0, [0.3, 0.5, 0.8])
    bands = bands.withColumn("w", tr.F.slice("re", 1, (tr.F.size("re") / 3).cast("int")))
    windows = tr.window_polarizations(bands, ["event_id"], 4.0, along=["w"])
    key = lambda r: (r.event_id, r.band, r.ti)
    fast = tr.covered_means(windows, ["event_id"], alone=True, along=["w"])
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.rindex("MapInArrow")]
    got, want = ({key(r): r for r in f.collect()} for f in (fast, tr.covered_means(windows, ["event_id"])))
    assert got.keys() == want.keys() and len(got) == (4 * 48 + 2 * 64) * 3
    for at, r in want.items():
        for c in ("dop", "azimuth_deg", "inclination_deg", "vrm", "hrm"):
            assert (got[at][c] is None) == (r[c] is None) and (r[c] is None or got[at][c] == pytest.approx(r[c], abs=1e-9))
    level = {(r.event_id, r.band): r.w for r in bands.collect()}
    assert all(r.w == level[r.event_id, r.band][r.ti] for r in got.values())
