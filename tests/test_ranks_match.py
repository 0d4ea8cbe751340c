import numpy as np
import pandas as pd
import pytest
from beamspark.operators import grading, match, model, ranks


@pytest.fixture(params=[200_000, 20])
def slices(request, monkeypatch):
    """Once with every key whole and once with the large ones cut."""
    monkeypatch.setattr(ranks, "SLICE_ROWS", request.param)


def skewed(seed=3, n=1500):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        "k": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 30, n)), "v": rng.integers(0, 400, n).astype(float),
        "w": rng.integers(1, 5, n).astype(float), "id": np.arange(n)})


def test_quantiles(spark, slices):
    p = skewed()
    got = ranks.quantiles(spark.createDataFrame(p), ["k"], "v", [0.05, 0.5, 0.95]).toPandas().set_index("k").sort_index()
    want = p.groupby("k")["v"].quantile([0.05, 0.5, 0.95]).unstack()
    np.testing.assert_allclose(got[["q05", "q50", "q95"]].to_numpy(), want.to_numpy())


def test_weighted_median(spark, slices):
    p = skewed()
    got = ranks.weighted_median(spark.createDataFrame(p), ["k"], "v", "w").toPandas().set_index("k")["weighted_median"]
    for k, g in p.groupby("k"):
        g = g.sort_values("v")
        c = g["w"].cumsum().to_numpy()
        assert got[k] == g["v"].to_numpy()[np.searchsorted(c, 0.5 * c[-1])]


def test_lagged(spark, slices):
    p = skewed().drop_duplicates(["k", "v"]).reset_index(drop=True)
    got = ranks.lagged(spark.createDataFrame(p), ["k"], "v", "id", "before").toPandas().sort_values(["k", "v"])
    want = p.sort_values(["k", "v"]).groupby("k")["id"].shift()
    np.testing.assert_array_equal(got["before"].astype(float).to_numpy(), want.to_numpy())


def test_nearest(spark, slices):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"k": np.where(rng.random(400) < 0.6, 0, rng.integers(1, 9, 400)), "t": rng.integers(0, 5000, 400)})
    right = pd.DataFrame({"k": rng.integers(0, 8, 300), "t": rng.integers(0, 5000, 300), "id": np.arange(300)})
    got = match.nearest(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "t", "id").toPandas()
    assert len(got) == len(left.drop_duplicates())
    for r in got.itertuples():
        cand = right[right["k"] == r.k]
        if cand.empty:
            assert pd.isna(r.match_id)
            continue
        best = cand.assign(d=(cand["t"] - r.t).abs()).sort_values(["d", "t", "id"]).iloc[0]
        assert (r.delta, r.match_id) == (best["d"], best["id"])


def test_interval_counts(spark, slices):
    rng = np.random.default_rng(6)
    left = pd.DataFrame({"k": np.where(rng.random(300) < 0.6, 0, rng.integers(1, 5, 300)), "lo": rng.integers(0, 900, 300)})
    left["hi"] = left["lo"] + rng.integers(0, 80, 300)
    left["id"] = np.arange(300)
    right = pd.DataFrame({"k": rng.integers(0, 4, 500), "t": rng.integers(0, 1000, 500)})
    got = match.interval_counts(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "lo", "hi", "t", "id")
    got = got.toPandas().set_index("id")["n"]
    for r in left.itertuples():
        assert got[r.id] == ((right["k"] == r.k) & right["t"].between(r.lo, r.hi)).sum()


def test_exact_identifier_beats_nearer_event(spark):
    targets = spark.createDataFrame([(1, "S0001a", 1000), (2, "S0002a", 1000), (3, "S0003a", 90_000_000)],
                                    "target_id int, token string, at bigint")
    cat = spark.createDataFrame([("near", ["S0009a"], 1001), ("named", ["S0001a"], 70_000_000)],
                                "resource_id string, tokens array<string>, at bigint")
    got = {r["target_id"]: (r["resource_id"], r["status"]) for r in
           match.match_events(targets, cat, tolerance=10_000_000).collect()}
    assert got == {1: ("named", "exact_id"), 2: ("near", "nearest"), 3: (None, "no_event_within_tolerance")}


@pytest.mark.parametrize("swarm", [0, 300])
def test_near_strong_against_all_pairs(spark, swarm):
    rng = np.random.default_rng(swarm)
    n = 500
    rows = [(i, int(rng.integers(0, 20000)), float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(n)]
    rows += [(n + i, int(9000 + rng.integers(0, 700)), float(10 + rng.normal()), float(179.5 + rng.normal()) % 360 - 0.0) for i in range(swarm)]
    rows = [(i, t, a, (o + 180) % 360 - 180) for i, t, a, o in rows]
    e = spark.createDataFrame(rows, "event_id long, at long, lat double, lon double")
    strong = [r for r in rows if r[0] % 3 == 0]

    def apart(x, y):
        a, b, c, d = np.radians([x[2], x[3], y[2], y[3]])
        return np.degrees(np.arccos(np.clip(np.sin(a) * np.sin(c) + np.cos(a) * np.cos(c) * np.cos(b - d), -1, 1)))

    want = {x[0] for x in rows if any(y[0] != x[0] and x[1] - 900 <= y[1] <= x[1] + 700 and apart(x, y) <= 15 for y in strong)}
    got = match.near_strong(e, e.where("event_id % 3 = 0"), before=900, after=700, degrees=15.0)
    assert {r.event_id for r in got.collect()} == want


def test_rank_picks_count_within_ties(spark):
    """Models of one value follow their ids: the pick is the model of that rank, not the least id of the value."""
    rows = [(0, m, 1.0 if m < 3 else 2.0 if m < 10 else 3.0) for m in range(12)]
    got = model.rank_picks(spark.createDataFrame(rows, "family int, m int, v double"), ["family"], "v", "m", [0.0, 50.0, 75.0, 100.0])
    ranked = sorted((v, m) for _, m, v in rows)
    assert {r.percent: (r.v, r.m) for r in got.collect()} == {p: ranked[round(11 * p / 100)] for p in (0.0, 50.0, 75.0, 100.0)}


def test_statistics_on_a_limit_do_not_depend_on_row_order(spark):
    """A mean of 0.047 or a spread of 0.025 has the same bits in any order of the rows."""
    rng = np.random.default_rng(3)
    taxes = np.array([0.0] * 50 + [0.05] * 50)
    rates = np.array([0.04] * 30 + [0.05] * 70)
    seen = set()
    for _ in range(8):
        rows = list(zip(rng.permutation(rates).tolist(), rng.permutation(taxes).tolist()))
        df = spark.createDataFrame(rows, "rate double, tax double").coalesce(1)
        seen.add(tuple(df.agg(grading.exact_mean("rate"), grading.exact_stddev_pop("tax"), grading.exact_stddev_pop("rate")).first()))
    assert len(seen) == 1
    mean, spread, _ = seen.pop()
    assert mean == 0.047 and spread == 0.025
    assert spark.createDataFrame([(None,)], "v double").agg(grading.exact_mean("v"), grading.exact_stddev_pop("v")).first() == (None, None)
