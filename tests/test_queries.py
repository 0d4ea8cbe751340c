"""Every registered query against its SQL."""

import pandas as pd
import pytest

import __spark_entry__ as entry
from check import normal

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)
    if name not in ORACLES:
        assert len(got)
        return
    cur = duck.execute(ORACLES[name])
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description])
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(normal(got), normal(want))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_samples_of_all_bands_are_never_broadcast(spark, sf_dir):
    """One row per event, band and sample: a broadcast of them gathered the whole table in the driver."""
    plan = QUERIES["frequency_dependent_polarization"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_box_peaks_of_small_powers(spark, sf_dir, tmp_path):
    """Powers near 1e-12 still have one largest cell in a box: only neighbours are compared after rounding."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * REPLACE (list_transform(embedding, lambda v: v / 1000)::FLOAT[] AS embedding) FROM '{sf_dir}/embeddings.parquet'")
    con.execute(f"COPY embeddings TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    df = QUERIES["box_peak_local_max"](spark, str(tmp_path))
    got = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)
    cur = con.execute(ORACLES["box_peak_local_max"])
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description])
    pd.testing.assert_frame_equal(normal(got[list(want.columns)]), normal(want))


def test_generated_models_are_added_up_by_hash(spark, sf_dir):
    """Sorting every row of a file of models took memory in proportion to the file."""
    plan = QUERIES["generated_models"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_polarization_shuffles_records_once_and_no_samples(spark, sf_dir):
    """Every sample of every band was shuffled twice, 64 KB an event; time and disk grew with that."""
    df = QUERIES["frequency_dependent_polarization"](spark, sf_dir).groupBy("band").count()
    assert {r["count"] for r in df.collect()} == {500 * 64}
    last = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    after = last[: last.rindex("MapInArrow")]  # above the first Python step only the count of this test shuffles
    assert last.count("MapInArrow") == 3 and after.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in last


def test_polarization_of_events_of_several_records(spark, tmp_path):
    """Records of one event share its means and keep their own levels; records without an event have no rows."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from beamspark.functions import kernels

    rng = np.random.default_rng(4)
    ids = [1, 2, 3, 3, 3, 4, 4, 5, None, None]
    x = rng.normal(size=(len(ids), 64)).astype(np.float32)
    x[[1, 5]] = 0
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32())),
                             "label": pa.array([0] * len(ids), pa.int32())}), f"{tmp_path}/embeddings.parquet")
    got = QUERIES["frequency_dependent_polarization"](spark, str(tmp_path)).toPandas()
    assert got.groupby("event_id").size().to_dict() == {i: ids.count(i) * 13 * 64 for i in range(1, 6)}
    for event in range(1, 6):
        own = [np.vstack([v, v[::-1], np.roll(v, -16)]).astype(float) for i, v in zip(ids, x) if i == event]
        for k, freq in enumerate(np.geomspace(0.2, 0.8, 13)):
            bands = np.array([kernels.frequency_shift(z, 4.0, freq) for z in own])
            win, starts = kernels.band_windows(64, 4.0, freq)
            w = kernels.window_polarization(bands, win, starts)
            # All records' windows after one another cover a sample as often as they all do.
            want = kernels.covered_polarization(64, win, np.tile(starts, len(own)), **{f: v.ravel() for f, v in w.items()})
            rows = got[(got.event_id == event) & (got.band == k)].sort_values(["ti", "masked_vertical"])
            each = lambda v: np.repeat(v, len(own))
            np.testing.assert_allclose(rows["dop"], each(want["dop"]), atol=1e-6)
            np.testing.assert_allclose(rows["azimuth_deg"], each(want["azimuth"]), atol=1e-3)
            np.testing.assert_allclose(rows["inclination_deg"], each(want["inclination"]), atol=1e-4)
            np.testing.assert_allclose(rows["vrm_minus_hrm"], each(want["vrm"] - want["hrm"]), atol=1e-6)
            level = np.sort(np.abs(bands[:, 0]), axis=0).T.ravel()
            np.testing.assert_allclose(rows["masked_vertical"], np.where(each(want["dop"]) >= 0.6, level, 0.0), atol=1e-6)


def test_fast_rounding_is_rounding(spark):
    from beamspark.plans.registry import rnd, rnd_fast

    values = [0.0, -0.0, 0.5, 1e-7, -4e-7, 5e-7, -5e-7, 0.1234565, 0.1234575, 2.0000005, 359.9995, 359.99949999999, 1e300, -3.3e15, 1234567.1234565,
              float("nan"), float("inf"), float("-inf"), None, *(k / 2000 + 0.0005 for k in range(300)), *(k * 0.0123456789 for k in range(-300, 300))]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(2)
    for digits in (3, 4, 6):
        rows = df.select(rnd("v", digits).alias("a"), rnd_fast("v", digits).alias("b")).collect()
        assert [repr(r.a) for r in rows] == [repr(r.b) for r in rows]
