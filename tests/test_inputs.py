"""Stack inputs, frozen constants and the influence sink."""

import json

import pytest

from beamspark.operators import inputs
from beamspark.sources import sinks


@pytest.fixture
def parts(spark):
    events = spark.createDataFrame([("e1", "vespagram", 30.0, 1.0), ("e2", "vespagram", 31.0, 2.0), ("e3", "other", 40.0, 1.0)],
                                   "event_id string, set string, distance double, distance_err double")
    traces = spark.createDataFrame([("A", "e1", [1.0, 2.0], -1.0, 0.5), ("A", "e2", [3.0, 4.0], -1.0, 0.5)],
                                   "variant string, event_id string, x array<double>, start_s double, step_s double")
    masks = spark.createDataFrame([("A", "e1", [True, False]), ("A", "e2", [True, True])], "variant string, event_id string, valid array<boolean>")
    return events, traces, masks


def test_whole_inputs_load(parts):
    rows = inputs.stack_inputs(*parts, [{"variant": "A"}]).orderBy("event_id").collect()
    assert [(r.event_id, r.distance, r.x, r.valid) for r in rows] == [("e1", 30.0, [1.0, 2.0], [True, False]), ("e2", 31.0, [3.0, 4.0], [True, True])]


def test_what_is_missing_fails_and_is_named(spark, parts):
    events, traces, masks = parts
    with pytest.raises(Exception, match="missing_trace: B/e1|missing_trace: B/e2"):
        inputs.stack_inputs(events, traces, masks, [{"variant": "B"}]).collect()
    with pytest.raises(Exception, match="missing_mask: A/e2"):
        inputs.stack_inputs(events, traces, masks.where("event_id = 'e1'"), [{"variant": "A"}]).collect()
    late = traces.where("event_id = 'e1'").unionByName(spark.createDataFrame([("A", "e2", [3.0, 4.0], -0.9, 0.5)], traces.schema))
    with pytest.raises(Exception, match="time_axis_mismatch: A/e2"):
        inputs.stack_inputs(events, late, masks, [{"variant": "A"}]).collect()


def test_frozen_constants():
    inputs.assert_frozen(**inputs.FROZEN)
    inputs.assert_frozen(ref_distance_deg=29.0, slowness_min=-10.0, slowness_max=0.0, slowness_steps=100, stack_method="nth_root", nth_root_order=4,
                         power_window_s=20.0, min_support=2)
    with pytest.raises(ValueError, match="nth_root_order, other"):
        inputs.assert_frozen(nth_root_order=3, other=1)


def test_influence_sink(spark, tmp_path):
    grids = spark.createDataFrame([("A", None, 0, [1.0]), ("A", "e1", 0, [2.0])], "variant string, held string, si int, power array<double>")
    members = spark.createDataFrame([("A", None, "e1"), ("A", None, "e2"), ("A", "e1", "e2")], "variant string, held string, event_id string")
    summary = spark.createDataFrame([("A", None, 600.0), ("A", "e1", 610.0)], "variant string, held string, time_s double")
    sinks.write_leave_one_out(str(tmp_path / "loo"), grids=grids, members=members, influence=summary, lanes=["variant"], held="held")
    back = spark.read.parquet(str(tmp_path / "loo" / "grids"))
    assert back.where("product = 'hold_out_e1'").first()["power"] == [2.0]
    assert spark.read.parquet(str(tmp_path / "loo" / "members")).where("product = 'full_set'").count() == 2
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "loo" / "summary")).collect()]
    assert {x["product"]: x["time_s"] for x in lines} == {"full_set": 600.0, "hold_out_e1": 610.0}
