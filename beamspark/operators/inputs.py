"""Loading the inputs of a stack: event table, traces and masks meet here, and a run's constants are checked.

Everything is joins on (lane, event): an event that a lane asks for and lacks is a row with a status, and the strict
form fails the job on the first such row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamspark import dims

AXIS_TOLERANCE_S = 1e-9
EVENT_SET = "vespagram"

#: The constants a registered run may not change.
FROZEN = {
    "ref_distance_deg": dims.REF_DISTANCE_DEG, "slowness_min": dims.FULL_AXIS.lo, "slowness_max": dims.FULL_AXIS.hi,
    "slowness_steps": dims.FULL_AXIS.steps, "stack_method": "nth_root", "nth_root_order": dims.NTH_ROOT,
    "power_window_s": dims.POWER_WINDOW_S, "min_support": dims.MIN_STACK_SUPPORT,
}


def input_status(events: DataFrame, traces: DataFrame, masks: DataFrame, lanes: Sequence[Mapping[str, object]]) -> DataFrame:
    """One row per lane asked for and event of the stacking set, with trace, mask and a status.

    ``events``: (event_id, set, distance, distance_err); ``traces``: lane columns, event_id, x, start_s, step_s; ``masks``:
    lane columns, event_id, valid. Lanes are a short registered list. Status: missing_trace, missing_mask,
    mask_shape_mismatch, time_axis_mismatch (against the lane's earliest start, finest step and longest trace) or ok.
    """
    names = list(lanes[0])
    asked = F.explode(F.array(*(F.struct(*(F.lit(lane[n]).alias(n) for n in names)) for lane in lanes)))
    wanted = events.where(F.col("set") == EVENT_SET).select("event_id", "distance", "distance_err", asked.alias("lane_")).select(
        *(F.col(f"lane_.{n}").alias(n) for n in names), "event_id", "distance", "distance_err")
    keys = [*names, "event_id"]
    base = traces.groupBy(*names).agg(F.min("start_s").alias("start0"), F.min("step_s").alias("step0"), F.max(F.size("x")).alias("size0"))
    j = wanted.join(traces.select(*keys, "x", "start_s", "step_s"), keys, "left").join(masks.select(*keys, "valid"), keys, "left").join(base, names, "left")
    off = (F.abs(F.col("start_s") - F.col("start0")) > AXIS_TOLERANCE_S) | (F.abs(F.col("step_s") - F.col("step0")) > AXIS_TOLERANCE_S) | (
        F.size("x") != F.col("size0"))
    status = (F.when(F.col("x").isNull(), "missing_trace").when(F.col("valid").isNull(), "missing_mask")
              .when(F.size("valid") != F.size("x"), "mask_shape_mismatch").when(off, "time_axis_mismatch").otherwise("ok"))
    return j.withColumn("status", status).drop("start0", "step0", "size0")


def stack_inputs(events: DataFrame, traces: DataFrame, masks: DataFrame, lanes: Sequence[Mapping[str, object]]) -> DataFrame:
    """Traces with masks and distances, ready to be stacked; any input that is not ok fails the job and is named."""
    j = input_status(events, traces, masks, lanes)
    name = F.concat_ws("/", *(F.col(n).cast("string") for n in lanes[0]), F.col("event_id").cast("string"))
    bad = F.raise_error(F.concat(F.col("status"), F.lit(": "), name)).cast("double")
    return j.withColumn("distance", F.when(F.col("status") == "ok", F.col("distance")).otherwise(bad)).drop("status")


def departures(constants: Mapping[str, Column]) -> Column:
    """Names, sorted, of the given constants that differ from the registered ones; null counts as different."""
    return F.array_compact(F.array(*(F.when(~constants[n].eqNullSafe(F.lit(FROZEN[n])), n) for n in sorted(constants))))


def assert_frozen(**constants: object) -> None:
    """Refuse a run whose constants are not the registered ones, before anything is computed."""
    unknown = sorted(set(constants) - set(FROZEN))
    wrong = sorted(n for n, v in constants.items() if n in FROZEN and v != FROZEN[n])
    if unknown or wrong:
        raise ValueError(f"constants do not match the registered card: {', '.join([*wrong, *unknown])}")
