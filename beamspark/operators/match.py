"""Time matching without pairing groups: nearest, interval counts, contamination, picks.

Both sides are put on one axis and cut into buckets of equal depth. Each bucket is scanned in order by
itself; what it needs from its neighbours is one value per bucket, so no key or moment, however crowded,
is joined with itself or sent to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamspark.operators.ranks import bucketed
from beamspark.operators.traces import great_circle_deg


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, right_id: str) -> DataFrame:
    """Distinct (keys, left_at) with the closest right row: ``match_at``, ``match_id``, ``delta``.

    Times are whole numbers. The earlier of two equally close rows wins, and the smallest id of a moment.
    """
    keys = list(keys)
    r = right.groupBy(*keys, F.col(right_at).alias("at")).agg(F.min(right_id).alias("rid"))
    q = left.select(*keys, F.col(left_at).alias("at")).distinct().withColumn("asked", F.lit(True))
    pts = r.withColumn("asked", F.lit(False)).unionByName(q.withColumn("rid", F.lit(None).cast(
        r.schema["rid"].dataType)).select(*keys, "at", "rid", "asked"))
    pts = pts.groupBy(*keys, "at").agg(F.max("rid").alias("rid"), F.bool_or("asked").alias("asked"))
    pts = bucketed(pts, keys, "at").withColumn("r", F.when(F.col("rid").isNotNull(), F.struct("at", "rid")))
    ends = pts.groupBy(*keys, "bucket").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    by_bucket = Window.partitionBy(*keys).orderBy("bucket")
    from_end = Window.partitionBy(*keys).orderBy(F.desc("bucket"))
    ends = ends.select(
        *keys, "bucket",
        F.last("hi", True).over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.last("lo", True).over(from_end.rowsBetween(Window.unboundedPreceding, -1)).alias("after"))
    inside = Window.partitionBy(*keys, "bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # The way back is a second running scan: a frame that runs to the end is worked out anew for every row.
    back = Window.partitionBy(*keys, "bucket").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    j = pts.join(ends, [*keys, "bucket"])
    j = j.withColumns({
        "prev": F.coalesce(F.last("r", True).over(inside), "before"),
        "next": F.coalesce(F.last("r", True).over(back), "after"),
    }).where("asked")
    dp, dn = F.col("at") - F.col("prev.at"), F.col("next.at") - F.col("at")
    use_prev = F.coalesce(dp <= dn, F.col("prev").isNotNull())
    best = F.when(use_prev, F.col("prev")).otherwise(F.col("next"))
    return j.withColumn("best", best).select(
        *keys, F.col("at").alias(left_at), F.col("best.at").alias("match_at"), F.col("best.rid").alias("match_id"),
        F.abs(F.col("best.at") - F.col("at")).alias("delta"))


def interval_counts(left: DataFrame, right: DataFrame, keys: Sequence[str], lo: str, hi: str, at: str, row_id: str) -> DataFrame:
    """(row_id, n): number of right moments in each left row's closed [lo, hi], from running counts."""
    keys = list(keys)
    marks = left.select(*keys, row_id, F.inline(F.array(
        F.struct(F.col(lo).alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("w")),
        F.struct(F.col(hi).alias("at"), F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("w")))))
    pts = right.groupBy(*keys, F.col(at).alias("at")).agg(F.count("*").alias("w")).select(
        *keys, F.lit(None).cast(left.schema[row_id].dataType).alias(row_id), "at", F.lit(1).alias("kind"), "w")
    both = bucketed(marks.unionByName(pts), keys, "at")
    total = both.groupBy(*keys, "bucket").agg(F.sum("w").alias("bw"))
    prev = F.sum("bw").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    total = total.select(*keys, "bucket", F.coalesce(prev, F.lit(0)).alias("prev"))
    run = F.sum("w").over(
        Window.partitionBy(*keys, "bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    seen = both.join(total, [*keys, "bucket"]).withColumn("seen", F.col("prev") + run).where(F.col(row_id).isNotNull())
    return seen.groupBy(row_id).agg(
        F.sum(F.when(F.col("kind") == 2, F.col("seen")).otherwise(-F.col("seen"))).alias("n"))


def match_events(
    targets: DataFrame, catalogue: DataFrame, *, tolerance: int, target_at: str = "at", token: str = "token"
) -> DataFrame:
    """Closest catalogue event that names the target's identifier, else the closest within tolerance.

    ``targets``: (target_id, token, at). ``catalogue``: (resource_id, tokens, at), times in microseconds.
    """
    named = catalogue.select(F.explode("tokens").alias(token), "resource_id", "at")
    exact = nearest(targets, named, [token], target_at, "at", "resource_id").select(
        token, target_at, F.col("match_id").alias("exact_id"), F.col("delta").alias("exact_delta"))
    near = nearest(
        targets.withColumn("all", F.lit(1)), catalogue.withColumn("all", F.lit(1)), ["all"], target_at, "at",
        "resource_id").select(target_at, F.col("match_id").alias("near_id"), F.col("delta").alias("near_delta"))
    j = targets.join(exact, [token, target_at], "left").join(near, target_at, "left")
    hit, close = F.col("exact_id").isNotNull(), F.col("near_delta") <= tolerance
    return j.select(
        "target_id", F.when(hit, F.col("exact_id")).when(close, F.col("near_id")).alias("resource_id"),
        F.when(hit, F.col("exact_delta")).when(close, F.col("near_delta")).alias("delta"),
        hit.alias("event_id_match_used"),
        F.when(hit, "exact_id").when(close, "nearest").otherwise("no_event_within_tolerance").alias("status"))


def select_picks(picks: DataFrame, key: str) -> DataFrame:
    """Earliest preferred pick per event, else the earliest of any; one aggregation.

    ``picks``: (key, pick_id, at, preferred) of picks that passed the network, station and phase filter.
    """
    best = F.min(F.struct((~F.col("preferred")).alias("np"), F.col("at"), F.col("pick_id")))
    return picks.groupBy(key).agg(
        F.count("*").alias("candidate_p_pick_count"), F.count_if("preferred").alias("preferred_pick_count"),
        best.alias("b")).select(
        key, F.col("b.pick_id").alias("pick_id"), F.col("b.at").alias("pick_at"), "candidate_p_pick_count",
        "preferred_pick_count", (~F.col("b.np")).alias("pick_selected_from_preferred_origin_arrival"))


def near_strong(
    events: DataFrame, strong: DataFrame, *, before: int, after: int, degrees: float
) -> DataFrame:
    """Ids of events with another strong event close in time and in angle (a semi join: no pairs leave).

    Two events in one fine cell (half the angle wide, the shorter interval long) are close for certain, so a
    count of strong events per cell settles a swarm without pairs. The others are compared with the strong
    events filed under their slot, latitude band and longitude cell: each strong event is filed wherever it
    could disturb. Both sides have (event_id, at, lat, lon).
    """
    slot, short, half = before + after, min(before, after), degrees / 2
    t = lambda c: F.floor(c / slot)
    band = lambda c: F.floor((c + 90) / degrees)
    turn = int(360 // degrees)  # longitude cells around the globe, a little wider than the angle
    cell = lambda c: F.floor(F.pmod(c + 180, F.lit(360.0)) * turn / 360)
    fine = [F.floor(F.col("at") / max(short, 1)).alias("ft"), F.floor((F.col("lat") + 90) / half).alias("fa"), F.floor((F.col("lon") + 180) / half).alias("fo")]
    names = ["ft", "fa", "fo"]
    crowd = strong.select("event_id", *fine).groupBy(*names).agg(F.count("*").alias("crowd"), F.min("event_id").alias("one"))
    e = events.select("event_id", "at", "lat", "lon", *fine).join(crowd, names, "left")
    other = F.coalesce((F.col("crowd") > 1) | (F.col("one") != F.col("event_id")), F.lit(False)) & F.lit(short > 0)
    sure = e.where(other).select("event_id")
    e = e.where(~other).select("event_id", "at", "lat", "lon")
    # How far in longitude a strong event reaches: all around near a pole.
    reach = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(np.radians(degrees))) / F.cos(F.radians(F.col("slat"))))))
    reach = F.when(F.abs(F.col("slat")) + degrees >= 89.9, F.lit(180.0)).otherwise(reach + 0.01)
    s = strong.select(
        F.col("event_id").alias("sid"), F.col("at").alias("sat"), F.col("lat").alias("slat"), F.col("lon").alias("slon"),
        F.explode(F.sequence(t(F.col("at") - after), t(F.col("at") + before))).alias("slot"))
    s = s.withColumn("band", F.explode(F.sequence(band(F.col("slat")) - 1, band(F.col("slat")) + 1)))
    first = F.floor((F.col("slon") + 180 - reach) * turn / 360)
    last = F.least(F.floor((F.col("slon") + 180 + reach) * turn / 360), first + turn - 1)
    s = s.withColumn("cell", F.explode(F.transform(F.sequence(first, last), lambda c: F.pmod(c, F.lit(turn).cast("bigint")))))
    e = e.withColumns({"slot": t(F.col("at")), "band": band(F.col("lat")), "cell": cell(F.col("lon"))})
    close = (
        (F.col("sid") != F.col("event_id")) & (F.col("sat") >= F.col("at") - before)
        & (F.col("sat") <= F.col("at") + after)
        & (great_circle_deg(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")) <= degrees))
    on = (e["slot"] == s["slot"]) & (e["band"] == s["band"]) & (e["cell"] == s["cell"]) & close
    return e.join(s, on, "left_semi").select("event_id").union(sure)


def uncontaminated(
    events: DataFrame, *, wide: tuple[int, int], wide_mag: float, near: tuple[int, int], near_mag: float, degrees: float
) -> DataFrame:
    """Events that no other large event disturbs: any within the wide interval, close ones within the near."""
    # Shifted by the interval so that the window reaches ``before`` back and ``after`` ahead.
    ids = events.select("event_id", (F.col("at") - wide[0]).alias("lo"), (F.col("at") + wide[1]).alias("hi"),
                        F.lit(1).alias("all"))
    large = events.where(F.col("mag") >= wide_mag).select("at", F.lit(1).alias("all"))
    n = interval_counts(ids, large, ["all"], "lo", "hi", "at", "event_id")
    hits = events.join(n, "event_id").where(F.col("n") > (F.col("mag") >= wide_mag).cast("int")).select("event_id")
    local = near_strong(events, events.where(F.col("mag") >= near_mag), before=near[0], after=near[1], degrees=degrees)
    return events.join(hits, "event_id", "left_anti").join(local, "event_id", "left_anti")


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First ``n`` rows of an order; every task keeps only its own ``n``."""
    return df.orderBy(*order).limit(n)
