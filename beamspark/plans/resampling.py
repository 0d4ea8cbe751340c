"""Bootstrap, null-model, influence and grading queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from beamspark import dims
from beamspark.operators import bootstrap, grading, peaks, ranks, resample, stack
from beamspark.plans.grids import (
    AXIS, AXIS_SQL, BOXES, POWER_S, POWER_SQL, PRE, SAMPLES_SQL, SR, WINDOWS, grid, grid_cells, traces,
)
from beamspark.plans.registry import big, registered, rnd, table

N_REAL = 200
N_SCRAMBLES = 200
SPAN = 10007
THRESHOLDS = (50, 70, 85)
N_TIMES = 64
# Fifteen overlapping windows, as many as the published runs read.
FIFTEEN = {f"W{k:02d}": (2.0 + 3 * k, 12.0 + 3 * k) for k in range(15)}
FIFTEEN_SQL = ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in FIFTEEN.items())
PLAN = bootstrap.design(AXIS.values, WINDOWS, THRESHOLDS, per_set=N_REAL, sr=SR, pre_s=PRE, power_window_s=POWER_S)


def vesp_by(keys: str, samples: str, source: str = "smp") -> str:
    """SQL of the nth-root power grid of prepared samples, keyed by ``keys`` besides lane."""
    lead = ("lane, " + keys) if keys else "lane"
    return SAMPLES_SQL + ", " + AXIS_SQL + ", " + samples + f""", acc AS (
  SELECT {lead}, si, ti, count(*) AS support, sum(sign(x) * pow(abs(x), 0.25::DOUBLE)) / count(*) AS root
  FROM (SELECT {lead}, si, x, ti + round_even(-s * (distance - 29.0::DOUBLE), 0)::BIGINT AS ti FROM {source}, axis)
  WHERE ti BETWEEN 0 AND 63 GROUP BY {lead}, si, ti), beam AS (
  SELECT *, sign(root) * pow(abs(root), 4.0::DOUBLE) AS beam FROM acc WHERE support >= 2), hann AS (
  SELECT k, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * k / 4) AS h FROM range(5) r(k)), vesp AS (
  SELECT d.*, s, d.ti - 8.0::DOUBLE AS t, p AS power FROM (
    SELECT {', '.join('d.' + k.strip() for k in lead.split(','))}, d.si, d.ti, d.support,
           sum(h * n.beam * n.beam) / sum(h) AS p
    FROM beam d CROSS JOIN hann JOIN beam n ON {' AND '.join(f'n.{k.strip()} = d.{k.strip()}' for k in lead.split(','))}
      AND n.si = d.si AND n.ti = d.ti + 2 - hann.k
    GROUP BY {', '.join('d.' + k.strip() for k in lead.split(','))}, d.si, d.ti, d.support) d JOIN axis USING (si))"""


OCC_SQL = """, w(phase, lo, hi) AS (VALUES ('PKiKP', 2.0, 32.0), ('PKKP', 28.0, 52.0)), pk AS (
  SELECT lane, real, phase, max(power) AS peak FROM vesp JOIN w ON t BETWEEN lo AND hi GROUP BY ALL), occ AS (
  SELECT lane, phase, thr AS threshold_pct, si, ti, count(*) / 200.0::DOUBLE AS frac
  FROM vesp JOIN w ON t BETWEEN lo AND hi JOIN pk USING (lane, real, phase)
  CROSS JOIN (SELECT unnest([50, 70, 85]) AS thr) WHERE power >= thr / 100.0::DOUBLE * (1 - 1e-12::DOUBLE) * peak GROUP BY ALL)"""
OCC_OUT = """SELECT lane::BIGINT AS lane, phase, threshold_pct::BIGINT AS threshold_pct, si::BIGINT AS si, ti, frac FROM occ"""
SCORE_SQL = "((event_id * 7919 + (real + 1) * 104729) * 31) % 10007"
TYPE1_SQL = """reals AS (SELECT unnest(range(200)) AS real), design AS (
  SELECT event_id, real FROM (SELECT event_id, real, row_number() OVER (PARTITION BY lane, real ORDER BY """ + SCORE_SQL + """,
    event_id) AS rn, count(*) OVER (PARTITION BY lane, real) AS n FROM (SELECT DISTINCT event_id, lane FROM samples), reals)
  WHERE n >= 2 AND rn <= greatest(2, floor(2 * n / 3))), smp AS (SELECT s.*, real FROM samples s JOIN design USING (event_id) WHERE valid)"""
TYPE2_SQL = """reals AS (SELECT unnest(range(200)) AS real), ids AS (
  SELECT DISTINCT event_id, lane, 11.0::DOUBLE + 0.6::DOUBLE * distance BETWEEN 29.0 AND 32.0 AS inside FROM samples), design AS (
  SELECT event_id, real FROM (
    SELECT event_id, real, inside, greatest(2, floor(2 * count(*) OVER (PARTITION BY lane, real) / 3))::BIGINT AS take,
           row_number() OVER (PARTITION BY lane, real, inside ORDER BY """ + SCORE_SQL + """, event_id) AS rn
    FROM ids, reals) WHERE rn <= CASE WHEN inside THEN take // 2 ELSE take - take // 2 END),
smp AS (SELECT s.* REPLACE (11.0::DOUBLE + 0.6::DOUBLE * distance AS distance), real FROM samples s JOIN design USING (event_id) WHERE valid)"""
TYPE3_SQL = """smp AS (SELECT p.lane, p.distance, p.real, p.ti, a.x + (coalesce(b.x, a.x) - a.x) * f AS x FROM (
  SELECT *, floor(pos)::BIGINT AS i0, pos - floor(pos) AS f FROM (
    SELECT event_id, lane, distance, ti, real, ti - ((event_id * 31 + real * 17) % 41 - 20) * 0.25::DOUBLE AS pos
    FROM samples, range(200) r(real)) WHERE pos BETWEEN 0 AND 63) p
  JOIN samples a ON a.event_id = p.event_id AND a.ti = i0 LEFT JOIN samples b ON b.event_id = p.event_id AND b.ti = i0 + 1
  WHERE a.valid AND (f = 0 OR b.valid))"""
SCRAMBLED_SQL = """sets AS (SELECT unnest(range(201)) AS k), ids AS (
  SELECT event_id, lane, distance, row_number() OVER (PARTITION BY lane ORDER BY event_id) AS rank FROM (SELECT DISTINCT event_id, lane, distance FROM samples)),
drawn AS (
  SELECT lane, k, distance AS given, row_number() OVER (
    PARTITION BY lane, k ORDER BY CASE WHEN k > 0 THEN ((event_id * 6101 + k * 3571) * 29) % 9973 END, event_id) AS rank FROM ids, sets),
given AS (SELECT event_id, k, given FROM ids JOIN drawn USING (lane, rank))"""
SCRAMBLE_SQL = SCRAMBLED_SQL + """, smp AS (
  SELECT s.* REPLACE (given AS distance), k AS real FROM samples s JOIN given USING (event_id) WHERE valid)"""


def score(real):
    return F.pmod((F.col("event_id") * 7919 + (real + 1) * 104729) * 31, F.lit(SPAN))


def scramble_score(k):
    return F.pmod((F.col("event_id") * 6101 + k * 3571) * 29, F.lit(9973))


def enough(t):
    """Traces of the lanes that can be resampled at all: two events or more."""
    return t.join(t.groupBy("lane").count().where("count >= 2").select("lane"), "lane", "left_semi")


def drawn(t, design, column):
    """Traces with a drawn column: designs are made of ids and distances alone, and meet the traces once."""
    ids = design(t.select("lane", "event_id", "distance"))
    return t.join(ids.select("lane", "event_id", column), ["lane", "event_id"])


def type1_traces(spark, sf):
    return drawn(traces(spark, sf), lambda t: resample.with_subset_members(enough(t), "lane", N_REAL, score, SPAN), "members")


def type2_traces(spark, sf):
    # The test distances at six tenths of their spread: enough of them lie inside the registered cluster and outside.
    t = traces(spark, sf).withColumn("distance", F.lit(11.0) + F.lit(0.6) * F.col("distance"))
    inside = F.col("distance").between(dims.CLUSTER_MIN_DEG, dims.CLUSTER_MAX_DEG)
    return drawn(t, lambda t: resample.with_subset_members(t, "lane", N_REAL, score, SPAN, inside), "members")


def jitter():
    reals = F.sequence(F.lit(0), F.lit(N_REAL - 1))
    return F.transform(reals, lambda r: (F.pmod(F.col("event_id") * 31 + r * 17, F.lit(41)) - 20) * F.lit(0.25))


def type3_traces(spark, sf):
    return traces(spark, sf).withColumn("jitter_s", jitter())


def lanes_of(spark, sf):
    """The lane of every trace, to count by without drawing the designs."""
    return traces(spark, sf).select("lane")


def _occ(t, plan=PLAN, sizes=None):
    return bootstrap.occupancy(bootstrap.resampled(t, ["lane"], plan, sizes=sizes), ["lane"], plan).drop("set")


def _occ_out(occ):
    return occ.select(big("lane").alias("lane"), "phase", big("threshold_pct").alias("threshold_pct"),
                      big("si").alias("si"), big("ti").alias("ti"), "frac")


@registered("bootstrap_event_subset_occupancy", sql="WITH " + vesp_by("real", TYPE1_SQL) + OCC_SQL + OCC_OUT)
def bootstrap_event_subset_occupancy(spark, sf):
    return _occ_out(_occ(type1_traces(spark, sf), sizes=lanes_of(spark, sf)))


@registered("bootstrap_distance_stratified_occupancy", sql="WITH " + vesp_by("real", TYPE2_SQL) + OCC_SQL + OCC_OUT)
def bootstrap_distance_stratified_occupancy(spark, sf):
    return _occ_out(_occ(type2_traces(spark, sf), sizes=lanes_of(spark, sf)))


@registered("bootstrap_pick_jitter_occupancy", sql="WITH " + vesp_by("real", TYPE3_SQL) + OCC_SQL + OCC_OUT)
def bootstrap_pick_jitter_occupancy(spark, sf):
    return _occ_out(_occ(type3_traces(spark, sf), sizes=lanes_of(spark, sf)))


@registered("bootstrap_fifteen_windows", sql="WITH " + vesp_by("real", TYPE1_SQL) + OCC_SQL.replace(
    "('PKiKP', 2.0, 32.0), ('PKKP', 28.0, 52.0)", FIFTEEN_SQL) + OCC_OUT)
def bootstrap_fifteen_windows(spark, sf):
    """All windows of a run are read from one block of realisations."""
    plan = bootstrap.design(AXIS.values, FIFTEEN, THRESHOLDS, per_set=N_REAL, sr=SR, pre_s=PRE, power_window_s=POWER_S)
    return _occ_out(_occ(type1_traces(spark, sf), plan, sizes=lanes_of(spark, sf)))


REAL_PEAK_SQL = """, w(phase, lo, hi) AS (VALUES ('PKiKP', 2.0, 32.0), ('PKKP', 28.0, 52.0)), rk AS (
  SELECT lane, real, phase, t, s, power, support, row_number() OVER (PARTITION BY lane, real, phase
    ORDER BY power DESC, si, ti) AS rn FROM vesp JOIN w ON t BETWEEN lo AND hi)
SELECT lane::BIGINT AS lane, real::BIGINT AS realisation, phase, t AS time_s, round(s, 6) + 0.0 AS slowness_sdeg,
       round(power, 9) AS power, support::BIGINT AS support_count FROM rk WHERE rn = 1"""


def _real_peaks(t, plan=PLAN, real="real", sizes=None):
    found = bootstrap.resampled(t, ["lane"], plan, occupancy=False, peaks=True, sizes=sizes)
    p = bootstrap.realisation_peaks(found, ["lane"], plan)
    return p.select(big("lane").alias("lane"), big(real).alias("realisation"), "phase", "time_s",
                    rnd("slowness_sdeg").alias("slowness_sdeg"), rnd("power", 9).alias("power"),
                    big("support_count").alias("support_count"))


@registered("bootstrap_realisation_peaks", sql="WITH " + vesp_by("real", TYPE2_SQL) + REAL_PEAK_SQL)
def bootstrap_realisation_peaks(spark, sf):
    return _real_peaks(type2_traces(spark, sf), sizes=lanes_of(spark, sf))


@registered("scramble_null_peaks", sql="WITH " + vesp_by("real", SCRAMBLE_SQL) + REAL_PEAK_SQL)
def scramble_null_peaks(spark, sf):
    """The true distances (realisation 0) and two hundred permutations of them."""
    plan = bootstrap.design(AXIS.values, WINDOWS, (), per_set=1, n_sets=N_SCRAMBLES + 1, sr=SR, pre_s=PRE, power_window_s=POWER_S)
    return _real_peaks(resample.scrambled_distances(traces(spark, sf), "lane", N_SCRAMBLES + 1, scramble_score), plan, "set", lanes_of(spark, sf))


@registered("windowed_bootstrap_occupancy", sql="WITH " + vesp_by("real", TYPE1_SQL) + OCC_SQL.replace(
    "('PKiKP', 2.0, 32.0), ('PKKP', 28.0, 52.0)", "('PKiKP', 10.0, 18.0)") + OCC_OUT)
def windowed_bootstrap_occupancy(spark, sf):
    """Only the samples the window and its power smoothing read are ever stacked."""
    plan = bootstrap.design(AXIS.values, {"PKiKP": (10.0, 18.0)}, THRESHOLDS, per_set=N_REAL, sr=SR, pre_s=PRE, power_window_s=POWER_S)
    return _occ_out(_occ(type1_traces(spark, sf), plan, sizes=lanes_of(spark, sf)))


@registered("occupancy_projection", sql="WITH " + vesp_by("real", TYPE1_SQL) + OCC_SQL + """
SELECT lane::BIGINT AS lane, phase, threshold_pct::BIGINT AS threshold_pct, ti, si::BIGINT AS si,
       round(sum(frac), 6) AS weight
FROM occ GROUP BY GROUPING SETS ((lane, phase, threshold_pct, ti), (lane, phase, threshold_pct, si))""")
def occupancy_projection(spark, sf):
    p = resample.projections(_occ(type1_traces(spark, sf), sizes=lanes_of(spark, sf)), ["lane", "phase", "threshold_pct"])
    return p.select(big("lane").alias("lane"), "phase", big("threshold_pct").alias("threshold_pct"),
                    big("ti").alias("ti"), big("si").alias("si"), rnd("weight").alias("weight"))


@registered("occupancy_components", sql="WITH RECURSIVE " + vesp_by("real", TYPE1_SQL) + OCC_SQL + """, top AS (
  SELECT lane, phase, max(frac) AS m FROM occ WHERE threshold_pct = 85 GROUP BY 1, 2), c AS (
  SELECT lane, phase, si, ti, si * 100 + ti AS id FROM occ JOIN top USING (lane, phase)
  WHERE threshold_pct = 85 AND frac >= 0.8::DOUBLE * m), reach AS (
  SELECT lane, phase, si, ti, id AS root FROM c UNION
  SELECT c.lane, c.phase, c.si, c.ti, r.root FROM reach r JOIN c ON c.lane = r.lane AND c.phase = r.phase
    AND abs(c.si - r.si) + abs(c.ti - r.ti) = 1), lab AS (
  SELECT lane, phase, si, ti, min(root) AS root FROM reach GROUP BY 1, 2, 3, 4)
SELECT lane::BIGINT AS lane, phase, count(DISTINCT root)::BIGINT AS components, count(*)::BIGINT AS cells
FROM lab GROUP BY 1, 2""")
def occupancy_components(spark, sf):
    occ = _occ(type1_traces(spark, sf), sizes=lanes_of(spark, sf)).where("threshold_pct = 85")
    top = occ.groupBy("lane", "phase").agg(F.max("frac").alias("m"))
    high = occ.join(top, ["lane", "phase"]).where(F.col("frac") >= 0.8 * F.col("m"))
    n = high.groupBy("lane", "phase").agg(F.count("*").alias("cells"))
    return resample.component_counts(high, ["lane", "phase"]).join(n, ["lane", "phase"]).select(
        big("lane").alias("lane"), "phase", "components", "cells")


@registered("bootstrap_pick_table")
def bootstrap_pick_table(spark, sf):
    """Fits, robust estimates and quality gate of every occupancy map."""
    return resample.pick_table(_occ(type1_traces(spark, sf), sizes=lanes_of(spark, sf)), ["lane"], slowness=AXIS.values, n_times=N_TIMES,
                               pre_s=PRE, sr=SR)


@registered("weighted_median", sql="""WITH d AS (
  SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), c AS (
  SELECT l_returnflag, v, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS cum,
         sum(w) OVER (PARTITION BY l_returnflag) AS total FROM d)
SELECT l_returnflag, min(v) AS weighted_median FROM c WHERE cum >= 0.5 * total GROUP BY 1""")
def weighted_median(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    return ranks.weighted_median(li, ["l_returnflag"], "l_extendedprice", "l_quantity")


LOO_SQL = "WITH " + vesp_by("held", """ev AS (SELECT DISTINCT event_id AS held, lane FROM samples),
smp AS (SELECT s.*, held FROM samples s JOIN ev USING (lane) WHERE valid AND s.event_id <> held)""") + """, rk AS (
  SELECT lane, held, t, s, power, support, row_number() OVER (PARTITION BY lane, held ORDER BY power DESC, si, ti) AS rn
  FROM vesp WHERE t BETWEEN 2.0 AND 52.0), loo AS (SELECT * FROM rk WHERE rn = 1)"""


def _loo(spark, sf):
    return resample.leave_one_out(traces(spark, sf), "lane", AXIS.values, ref=29.0, sr=SR, pre_s=PRE,
                                  window=(2.0, 52.0), power_window_s=POWER_S)


def branch(t):
    return F.when(t < 26.0, "602-family").otherwise("662-family")


@registered("leave_one_out_influence", sql=LOO_SQL + """
SELECT lane::BIGINT AS lane, held AS held_out_event, t AS time_s, round(s, 6) + 0.0 AS slowness_sdeg,
       round(power, 8) + 0.0 AS power, support::BIGINT AS support_count,
       CASE WHEN t < 26 THEN '602-family' ELSE '662-family' END AS branch FROM loo""")
def leave_one_out_influence(spark, sf):
    p = _loo(spark, sf)
    return p.select(big("lane").alias("lane"), big("event_id").alias("held_out_event"), "time_s",
                    rnd("slowness_sdeg").alias("slowness_sdeg"), rnd("power", 8).alias("power"),
                    big("support_count").alias("support_count"), branch(F.col("time_s")).alias("branch"))


@registered("leave_one_out_verdict", sql=LOO_SQL + """, facc AS (
  SELECT lane, si, ti, count(*) AS support, sum(sign(x) * pow(abs(x), 0.25::DOUBLE)) / count(*) AS root
  FROM (SELECT lane, si, x, ti + round_even(-s * (distance - 29.0::DOUBLE), 0)::BIGINT AS ti FROM samples, axis WHERE valid)
  WHERE ti BETWEEN 0 AND 63 GROUP BY 1, 2, 3), fbeam AS (
  SELECT *, sign(root) * pow(abs(root), 4.0::DOUBLE) AS beam FROM facc WHERE support >= 2), fvesp AS (
  SELECT d.lane, d.si, any_value(s) AS s, d.ti, sum(h * n.beam * n.beam) / sum(h) AS power FROM fbeam d CROSS JOIN hann
  JOIN fbeam n ON n.lane = d.lane AND n.si = d.si AND n.ti = d.ti + 2 - hann.k JOIN axis a ON a.si = d.si
  GROUP BY d.lane, d.si, d.ti), fv AS (
  SELECT lane, ti - 8.0::DOUBLE AS ft, s AS fs FROM (SELECT *, row_number() OVER (PARTITION BY lane
    ORDER BY power DESC, si, ti) AS rn FROM fvesp WHERE ti - 8 BETWEEN 2 AND 52) WHERE rn = 1)
SELECT lane::BIGINT AS lane, count(*) AS n_hold_out_runs,
       count(*) FILTER ((t < 26) <> (ft < 26)) AS flip_count, bool_or((t < 26) <> (ft < 26)) AS m1_material,
       round(max(abs(t - ft)), 6) AS max_abs_dt, round(max(abs(s - fs)), 6) + 0.0 AS max_abs_ds
FROM loo JOIN fv USING (lane) GROUP BY lane""")
def leave_one_out_verdict(spark, sf):
    full = peaks.global_peak(grid_cells(spark, sf), ["lane"], 2.0, 52.0).select(
        "lane", F.col("time_s").alias("ft"), F.col("slowness_sdeg").alias("fs"))
    j = _loo(spark, sf).join(full, "lane")
    flip = branch(F.col("time_s")) != branch(F.col("ft"))
    return j.groupBy(big("lane").alias("lane")).agg(
        F.count("*").alias("n_hold_out_runs"), F.count_if(flip).alias("flip_count"),
        F.bool_or(flip).alias("m1_material"), rnd(F.max(F.abs(F.col("time_s") - F.col("ft")))).alias("max_abs_dt"),
        rnd(F.max(F.abs(F.col("slowness_sdeg") - F.col("fs")))).alias("max_abs_ds"))


@registered("injection_ladder", sql="WITH " + vesp_by("alpha", """rms AS (
  SELECT event_id, sqrt(avg(x * x)) AS rms FROM samples WHERE valid AND ti < 12 GROUP BY 1), smp AS (
  SELECT lane, distance, s.event_id, ti, alpha, x + CASE WHEN ti = round_even(22 - 1.1::DOUBLE * (distance - 29.0), 0)
    THEN alpha * rms ELSE 0 END AS x
  FROM samples s JOIN rms USING (event_id) CROSS JOIN (SELECT unnest([0.0, 1.0, 2.0, 4.0, 8.0])::DOUBLE AS alpha)
  WHERE valid)""") + """, rk AS (
  SELECT lane, alpha, t, s, power, row_number() OVER (PARTITION BY lane, alpha ORDER BY power DESC, si, ti) AS rn
  FROM vesp WHERE t BETWEEN 2.0 AND 32.0)
SELECT lane::BIGINT AS lane, alpha, t AS time_s, round(s, 6) + 0.0 AS slowness_sdeg, round(power, 9) + 0.0 AS power,
       abs(t - 14) <= 2 AND abs(s + 1.1::DOUBLE) <= 0.3 AS recovered FROM rk WHERE rn = 1""")
def injection_ladder(spark, sf):
    t = traces(spark, sf)
    pre = F.filter(F.transform("x", lambda v, i: F.when((i < 12) & F.get("valid", i), v)), lambda v: v.isNotNull())
    rms = F.sqrt(F.aggregate(pre, F.lit(0.0), lambda a, v: a + v * v) / F.size(pre))
    t = t.withColumn("rms", rms).withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in (0.0, 1.0, 2.0, 4.0, 8.0)])))
    at = F.rint(F.lit(22.0) - F.lit(1.1) * (F.col("distance") - 29.0)).cast("int")
    t = t.withColumn("at", at).withColumn("add", F.col("alpha") * F.col("rms"))
    t = t.withColumn("x", F.transform("x", lambda v, i: F.when(i == F.col("at"), v + F.col("add")).otherwise(v)))
    g = stack.vespagram(t, ["lane", "alpha"], AXIS.values, sr=SR, power_window_s=POWER_S)
    p = peaks.global_peak_of_rows(g, ["lane", "alpha"], *WINDOWS["PKiKP"], pre_s=PRE, sr=SR)
    near = (F.abs(F.col("time_s") - 14) <= 2) & (F.abs(F.col("slowness_sdeg") + 1.1) <= 0.3)
    return p.select(big("lane").alias("lane"), "alpha", "time_s", rnd("slowness_sdeg").alias("slowness_sdeg"),
                    rnd("power", 9).alias("power"), near.alias("recovered"))


def _second(sql: str) -> str:
    """Rename the tables of one occupancy SQL so that a second can stand beside it."""
    for name in ("reals", "ids", "design", "smp", "acc", "beam", "vesp", "occ", "pk"):
        sql = re.sub(rf"\b{name}\b(?! FROM acc)", name + "2", sql)
    return sql.replace("AS beam2 FROM", "AS beam FROM").replace("n.beam2", "n.beam").replace("d.beam2", "d.beam")


TYPE2_OCC_SQL = _second(vesp_by("real", TYPE2_SQL)[len(SAMPLES_SQL + ", " + AXIS_SQL):] + OCC_SQL).replace(
    "hann AS (\n", "hann2 AS (\n").replace(", w(phase", ", w2(phase")


@registered("bootstrap_concordance", sql="WITH " + vesp_by("real", TYPE1_SQL) + OCC_SQL + TYPE2_OCC_SQL + """, c1 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lane, phase, threshold_pct ORDER BY frac DESC, si, ti) AS rn
    FROM occ) WHERE rn = 1), c2 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lane, phase, threshold_pct ORDER BY frac DESC, si, ti) AS rn
    FROM occ2) WHERE rn = 1), c1r AS (
  SELECT lane, phase, threshold_pct, 63 - ti AS ti FROM (SELECT *, row_number() OVER (
    PARTITION BY lane, phase, threshold_pct ORDER BY frac DESC, si, 63 - ti) AS rn FROM occ) WHERE rn = 1)
SELECT lane::BIGINT AS lane, phase, threshold_pct::BIGINT AS threshold_pct, (c2.ti - c1.ti)::BIGINT AS dt_s,
       round((c2.si - c1.si) * 0.2, 6)::DOUBLE + 0.0 AS ds_sdeg,
       abs(c2.ti - c1.ti) <= 5 AND abs(c2.si - c1.si) * 0.2::DOUBLE <= 0.5 AS concordant,
       CASE WHEN abs(c2.ti - 8 - 14) <= abs(c2.ti - 8 - 28) AND abs(c2.ti - 8 - 14) <= abs(c2.ti - 8 - 40) THEN 'early'
            WHEN abs(c2.ti - 8 - 28) <= abs(c2.ti - 8 - 40) THEN 'middle' ELSE 'late' END AS nearest_feature,
       c1r.ti = c1.ti AS adverse_reproduced
FROM c1 JOIN c1r USING (lane, phase, threshold_pct) JOIN c2 USING (lane, phase, threshold_pct)""")
def bootstrap_concordance(spark, sf):
    keys = ["lane", "phase", "threshold_pct"]
    occ = _occ(type1_traces(spark, sf), sizes=lanes_of(spark, sf))
    a = resample.argmax_cell(occ, keys)
    # Adverse control: the map reversed in time, its best cell found anew.
    r = resample.argmax_cell(occ.withColumn("ti", F.lit(N_TIMES - 1) - F.col("ti")), keys).select(*keys, F.col("ti").alias("ti_r"))
    b = resample.argmax_cell(_occ(type2_traces(spark, sf), sizes=lanes_of(spark, sf)), keys).select(
        *keys, F.col("si").alias("si2"), F.col("ti").alias("ti2"))
    dt, ds = F.col("ti2") - F.col("ti"), (F.col("si2") - F.col("si")) * F.lit(0.2)
    t2 = F.col("ti2") - PRE
    return a.join(b, keys).join(r, keys).select(
        big("lane").alias("lane"), "phase", big("threshold_pct").alias("threshold_pct"), big(dt).alias("dt_s"),
        rnd(ds).alias("ds_sdeg"), ((F.abs(dt) <= 5) & (F.abs(ds) <= 0.5)).alias("concordant"),
        grading.nearest_label(t2, {"early": 14.0, "middle": 28.0, "late": 40.0}).alias("nearest_feature"),
        (F.col("ti_r") == F.col("ti")).alias("adverse_reproduced"))


@registered("power_ratio_statement", sql="WITH " + POWER_SQL + """, g AS (
  SELECT lane, max(power) AS gp FROM vesp WHERE t BETWEEN 2.0 AND 32.0 GROUP BY lane), p AS (
  SELECT lane, max(power) AS pp FROM vesp WHERE t BETWEEN 10 AND 18 AND s BETWEEN -1.5 AND -0.7 GROUP BY lane)
SELECT v.lane::BIGINT AS lane, round(any_value(gp / pp), 9) AS s3_ratio,
       (1 + count(*) FILTER (v.power > pp AND t BETWEEN 2.0 AND 32.0))::BIGINT AS s1_rank,
       round(avg(CASE WHEN v.power <= pp THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS s2_quantile,
       count(*)::BIGINT AS cells
FROM vesp v JOIN g USING (lane) JOIN p USING (lane) WHERE v.power IS NOT NULL GROUP BY v.lane""")
def power_ratio_statement(spark, sf):
    c = grid_cells(spark, sf).where("power IS NOT NULL")
    top = c.groupBy("lane").agg(
        F.max(F.when(peaks.in_box(*WINDOWS["PKiKP"]), F.col("power"))).alias("gp"),
        F.max(F.when(peaks.in_box(10.0, 18.0, -1.5, -0.7), F.col("power"))).alias("pp"))
    j = c.join(top, "lane")
    return j.groupBy(big("lane").alias("lane")).agg(
        rnd(F.any_value(F.col("gp") / F.col("pp")), 9).alias("s3_ratio"),
        (F.lit(1) + F.count_if((F.col("power") > F.col("pp")) & peaks.in_box(*WINDOWS["PKiKP"]))).alias("s1_rank"),
        rnd(F.avg((F.col("power") <= F.col("pp")).cast("double")), 9).alias("s2_quantile"),
        F.count("*").alias("cells"))


@registered("sub_window_share", sql="WITH " + vesp_by("real", TYPE1_SQL) + """, rk AS (
  SELECT lane, real, t, power, row_number() OVER (PARTITION BY lane, real ORDER BY power DESC, si, ti) AS rn
  FROM vesp WHERE t BETWEEN 2.0 AND 52.0)
SELECT lane::BIGINT AS lane, round(avg(CASE WHEN t >= 26 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS late_share,
       min(CASE WHEN t >= 26 THEN t END) AS late_min_t, max(CASE WHEN t < 26 THEN t END) AS early_max_t,
       median(t) AS median_t FROM rk WHERE rn = 1 GROUP BY lane""")
def sub_window_share(spark, sf):
    plan = bootstrap.design(AXIS.values, {"both": (2.0, 52.0)}, (), per_set=N_REAL, sr=SR, pre_s=PRE, power_window_s=POWER_S)
    p = bootstrap.realisation_peaks(bootstrap.resampled(type1_traces(spark, sf), ["lane"], plan, occupancy=False, peaks=True, sizes=lanes_of(spark, sf)), ["lane"], plan)
    late = F.col("time_s") >= 26
    return p.groupBy(big("lane").alias("lane")).agg(
        rnd(F.avg(late.cast("double")), 9).alias("late_share"), F.min(F.when(late, F.col("time_s"))).alias("late_min_t"),
        F.max(F.when(~late, F.col("time_s"))).alias("early_max_t"), F.median("time_s").alias("median_t"))


@registered("shift_table_wide", sql="WITH " + SAMPLES_SQL + ", " + AXIS_SQL + """
SELECT event_id, """ + ", ".join(
    f"max(CASE WHEN si = {i} THEN round_even(-s * (distance - 29.0::DOUBLE), 0)::BIGINT END) AS roll_s{i:03d}"
    for i in range(11)) + " FROM samples, axis WHERE ti = 0 GROUP BY event_id")
def shift_table_wide(spark, sf):
    rolls = [big(stack.roll_samples(F.lit(s), F.col("distance"), 29.0, SR)).alias(f"roll_s{i:03d}")
             for i, s in enumerate(AXIS.values)]
    return traces(spark, sf).select(big("event_id").alias("event_id"), *rolls)


NULL_SQL = """real AS (
  SELECT l_returnflag, l_suppkey AS realisation, max(l_extendedprice * l_discount) AS ridge,
         max(CASE WHEN l_linenumber >= 5 AND l_discount > 0.06 THEN l_extendedprice * l_discount END) AS target
  FROM lineitem GROUP BY 1, 2)"""


@registered("null_exceedance_statistics", sql="WITH " + NULL_SQL + """
SELECT l_returnflag, count(*) AS n_null,
       round(count(*) FILTER (ridge >= 9000)::DOUBLE / count(*), 9) AS far_ridge,
       round(count(*) FILTER (target >= 8000)::DOUBLE / count(*), 9) AS far_target,
       round((1.0 + count(*) FILTER (ridge >= 9900)) / (count(*) + 1.0), 9)::DOUBLE AS p_ridge,
       round(quantile_cont(ridge, 0.05::DOUBLE), 6) AS q05, round(quantile_cont(ridge, 0.5::DOUBLE), 6) AS q50,
       round(quantile_cont(ridge, 0.95::DOUBLE), 6) AS q95, round(max(ridge), 6) AS ridge_max,
       count(*) FILTER (target IS NULL) AS target_nan FROM real GROUP BY 1""")
def null_exceedance_statistics(spark, sf):
    v = F.col("l_extendedprice") * F.col("l_discount")
    r = table(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_suppkey").alias("realisation")).agg(
        F.max(v).alias("ridge"),
        F.max(F.when((F.col("l_linenumber") >= 5) & (F.col("l_discount") > 0.06), v)).alias("target"))
    q = ranks.quantiles(r, ["l_returnflag"], "ridge", [0.05, 0.5, 0.95])
    s = grading.null_statistics(r, ["l_returnflag"], {"ridge": 9000.0, "target": 8000.0}, {"ridge": 9900.0})
    return s.join(q, "l_returnflag").select(
        "l_returnflag", "n_null", rnd("far_ridge", 9).alias("far_ridge"), rnd("far_target", 9).alias("far_target"),
        rnd("p_ridge", 9).alias("p_ridge"), rnd("q05").alias("q05"), rnd("q50").alias("q50"), rnd("q95").alias("q95"),
        rnd("ridge_max").alias("ridge_max"), "target_nan")


STATS_SQL = """st AS (
  SELECT l_suppkey AS realisation, l_linestatus AS phase,
         CASE l_returnflag WHEN 'A' THEN 'type1' WHEN 'N' THEN 'type3' ELSE 'type2' END AS bootstrap_type,
         avg(l_quantity) - 25.5 AS dt, (avg(l_discount) - 0.05) * 100 AS dp, stddev_pop(l_quantity) / 1.5 AS st,
         stddev_pop(l_tax) * 40 AS sp, avg(CASE WHEN l_quantity > 24 THEN 1.0::DOUBLE ELSE 0 END) AS occ
  FROM lineitem GROUP BY 1, 2, 3)"""
GRADE_SQL = STATS_SQL + """, t AS (
  SELECT realisation, phase,
    bool_or(bootstrap_type = 'type1' AND abs(dt) <= 25 AND abs(dp) <= 1.2 AND st <= 10 AND sp <= 1.0 AND occ >= 0.5) AS g1a,
    bool_or(bootstrap_type = 'type1' AND abs(dt) <= 50 AND abs(dp) <= 2.0 AND st <= 50 AND sp <= 1.5 AND occ >= 0.45) AS g2a,
    bool_or(bootstrap_type = 'type3' AND abs(dt) <= 25 AND abs(dp) <= 1.2 AND st <= 15 AND sp <= 1.5) AS rider,
    bool_or(bootstrap_type = 'type1') AS has1, realisation % 7 <> 0 AS peak_ok
  FROM st GROUP BY 1, 2), gr AS (
  SELECT realisation, phase, g1a AND rider AND peak_ok AS g1, g2a AND peak_ok AS g2 FROM t WHERE has1)"""


def _stats(spark, sf):
    """Statistics of exact sums: a mean or spread that lies on a limit is on the same side in any order of the rows."""
    kind = F.when(F.col("l_returnflag") == "A", "type1").when(F.col("l_returnflag") == "N", "type3").otherwise("type2")
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("realisation"), F.col("l_linestatus").alias("phase"), kind.alias("bootstrap_type")
    ).agg((grading.exact_mean("l_quantity") - 25.5).alias("dt"), ((grading.exact_mean("l_discount") - 0.05) * 100).alias("dp"),
          (grading.exact_stddev_pop("l_quantity") / 1.5).alias("sigma_t"), (grading.exact_stddev_pop("l_tax") * 40).alias("sigma_s"),
          F.avg((F.col("l_quantity") > 24).cast("double")).alias("occupancy"))


def _graded(spark, sf):
    return grading.grade(_stats(spark, sf), ["realisation", "phase"], F.pmod("realisation", F.lit(7)) != 0)


@registered("detection_grades", sql="WITH " + GRADE_SQL + """
SELECT realisation, phase, g1, g2, CASE WHEN g1 THEN 'DETECTED-G1' WHEN g2 THEN 'DETECTED-G2' ELSE 'NOT-DETECTED' END
  AS outcome FROM gr""")
def detection_grades(spark, sf):
    return _graded(spark, sf).select("realisation", "phase", "g1", "g2", "outcome")


@registered("false_alarm_rollup", sql="WITH " + GRADE_SQL + """
SELECT coalesce(phase, 'any') AS phase, count(*) AS n, count(*) FILTER (g1) AS g1_fires, count(*) FILTER (g2) AS g2_fires,
       round(count(*) FILTER (g2)::DOUBLE / count(*), 9) AS far_g2
FROM (SELECT realisation, phase, bool_or(g1) AS g1, bool_or(g2) AS g2 FROM gr
      GROUP BY GROUPING SETS ((realisation, phase), (realisation))) GROUP BY 1""")
def false_alarm_rollup(spark, sf):
    return grading.false_alarm_rates(_graded(spark, sf), "realisation", "phase").select(
        "phase", "n", "g1_fires", "g2_fires", rnd("far_g2", 9).alias("far_g2"))


@registered("grade_verdicts", sql="WITH " + GRADE_SQL + """, f AS (
  SELECT phase, count(*) FILTER (g2)::DOUBLE / count(*) AS far2, count(*) FILTER (g1)::DOUBLE / count(*) AS far1,
         max(CASE WHEN realisation = 1 AND g1 THEN 1 ELSE 0 END) AS d1, max(CASE WHEN realisation = 1 AND g2 THEN 1 ELSE 0 END) AS d2
  FROM gr GROUP BY phase)
SELECT phase, grade, CASE WHEN d = 1 AND far < 1/3::DOUBLE THEN CASE grade WHEN 'G1' THEN 'RECOVERED-STRONG' ELSE 'RECOVERED' END
   WHEN d = 1 THEN 'METHOD-FRAGILE' WHEN far < 1/3::DOUBLE THEN 'NOT-RECOVERED' ELSE 'INCONCLUSIVE' END AS verdict
FROM (SELECT phase, 'G1' AS grade, d1 AS d, far1 AS far FROM f UNION ALL SELECT phase, 'G2', d2, far2 FROM f)""")
def grade_verdicts(spark, sf):
    g = _graded(spark, sf).groupBy("phase").agg(*[
        c for k in ("g1", "g2") for c in (
            (F.count_if(F.col(k)) / F.count("*")).alias(f"far_{k}"),
            F.bool_or(F.col(k) & (F.col("realisation") == 1)).alias(f"hit_{k}"))])
    rows = g.select("phase", F.explode(F.array(*[
        F.struct(F.lit(k.upper()).alias("grade"), F.col(f"hit_{k}").alias("hit"), F.col(f"far_{k}").alias("far"))
        for k in ("g1", "g2")])).alias("r"))
    return rows.select("phase", "r.grade", grading.verdict(F.col("r.grade"), F.col("r.hit"), F.col("r.far")).alias(
        "verdict"))


@registered("fit_quality_gate", sql="""WITH f AS (
  SELECT l_orderkey, l_linenumber, l_quantity AS mean, l_discount * 300 AS sigma, l_tax * 10 AS resid,
         l_quantity % 7 AS peak, l_quantity + l_tax * 50 AS amax, l_quantity - l_discount * 20 AS wmed,
         l_returnflag <> 'R' AS conv, l_linestatus = 'F' AND l_returnflag = 'R' AS fb FROM lineitem), r AS (
  SELECT *, list_filter([CASE WHEN NOT conv THEN 'optimizer_not_converged' END,
    CASE WHEN fb THEN 'optimizer_fallback_used' END,
    CASE WHEN peak <= 0 THEN 'nonpositive_projection_peak' WHEN resid / peak > 0.10 THEN 'residual_rms_fraction' END,
    CASE WHEN sigma <= 0 THEN 'sigma_unavailable' WHEN sigma > 0.25 * 63 THEN 'sigma_exceeds_axis_span_fraction' END,
    CASE WHEN greatest(mean, amax, wmed) - least(mean, amax, wmed) > greatest(3.0, 0.05::DOUBLE * 63)
         THEN 'tri_estimator_inconsistency' END], lambda x: x IS NOT NULL) AS reasons FROM f)
SELECT array_to_string(reasons, '|') AS reasons, len(reasons) > 0 AS degenerate_fit, count(*) AS n
FROM r GROUP BY 1, 2""")
def fit_quality_gate(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("mean"), (F.col("l_discount") * 300).alias("sigma"),
        (F.col("l_tax") * 10).alias("residual_rms"), (F.col("l_quantity") % 7).alias("projection_peak"),
        (F.col("l_quantity") + F.col("l_tax") * 50).alias("occupancy_argmax"),
        (F.col("l_quantity") - F.col("l_discount") * 20).alias("weighted_median"),
        (F.col("l_returnflag") != "R").alias("fit_converged"),
        ((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")).alias("fallback_used"))
    r = resample.fit_reasons(F.lit(0.0), F.lit(63.0), F.lit(1.0))
    return li.select(F.concat_ws("|", r).alias("reasons")).groupBy("reasons").agg(F.count("*").alias("n")).select(
        "reasons", (F.col("reasons") != "").alias("degenerate_fit"), "n")


@registered("bootstrap_verdicts", sql="WITH " + STATS_SQL + """
SELECT realisation, phase, bootstrap_type, CASE WHEN occ < 0.5 THEN 'argmax' ELSE 'gaussian' END AS estimator,
  CASE WHEN abs(CASE WHEN occ < 0.5 THEN dt * 30 ELSE dt * 10 END) > 20 OR abs(dp) > 0.3 THEN 'warning' ELSE 'passed' END
  AS status FROM st""")
def bootstrap_verdicts(spark, sf):
    degenerate = F.col("occupancy") < 0.5
    dt = grading.robust_estimate(degenerate, F.col("dt") * 30, F.col("dt") * 10)
    return _stats(spark, sf).select(
        "realisation", "phase", "bootstrap_type", F.when(degenerate, "argmax").otherwise("gaussian").alias("estimator"),
        grading.stability_status(dt, F.col("dp"), 20.0, 0.3).alias("status"))


@registered("sliding_bin_trigger", sql="""WITH c AS (
  SELECT l_returnflag, 25 + l_quantity / 6 AS d, CASE WHEN l_discount > 0.08 THEN 1.0::DOUBLE ELSE 0 END AS hit FROM lineitem)
SELECT l_returnflag, round(max(f), 9) AS max_bin_fraction, count(*) AS bins FROM (
  SELECT l_returnflag, b, avg(hit) AS f FROM c JOIN (SELECT 25 + k * 0.5::DOUBLE AS b FROM range(17) r(k)) ON d >= b AND d < b + 3
  GROUP BY 1, 2) GROUP BY 1""")
def sliding_bin_trigger(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_returnflag", (F.lit(25) + F.col("l_quantity") / 6).alias("d"),
        (F.col("l_discount") > 0.08).cast("double").alias("hit"))
    f = grading.sliding_bins(li, ["l_returnflag"], "d", "hit", first=25.0, step=0.5, bins=17, width=3.0)
    return f.groupBy("l_returnflag").agg(rnd(F.max("fraction"), 9).alias("max_bin_fraction"),
                                         F.count("*").alias("bins"))


@registered("reference_parameters", sql="""SELECT o_orderpriority, median(o_totalprice) AS med_price,
  round_even(median(o_totalprice) / 1000 * 2, 0) / 2 AS ref_distance,
  round_even(median(o_totalprice) FILTER (o_orderstatus = 'P') / 25, 0) * 25 AS ref_depth FROM orders GROUP BY 1""")
def reference_parameters(spark, sf):
    o = table(spark, sf, "orders")
    med = ranks.quantiles(o, ["o_orderpriority"], "o_totalprice", [0.5])
    dep = ranks.quantiles(o.where("o_orderstatus = 'P'"), ["o_orderpriority"], "o_totalprice", [0.5]).withColumnRenamed(
        "q50", "d50")
    return med.join(dep, "o_orderpriority", "left").select(
        "o_orderpriority", F.col("q50").alias("med_price"), (F.rint(F.col("q50") / 1000 * 2) / 2).alias("ref_distance"),
        (F.rint(F.col("d50") / 25) * 25).alias("ref_depth"))


@registered("event_set_variants", sql="WITH " + vesp_by("variant", """smp AS (
  SELECT s.*, variant FROM samples s, (SELECT unnest(['all', 'near', 'far']) AS variant)
  WHERE valid AND (variant = 'all' OR (variant = 'near' AND distance <= 32) OR (variant = 'far' AND distance > 32)))""") + """,
rk AS (SELECT lane, variant, t, s, power, support, row_number() OVER (PARTITION BY lane, variant ORDER BY power DESC, si, ti)
  AS rn FROM vesp WHERE t BETWEEN 2.0 AND 32.0)
SELECT lane::BIGINT AS lane, variant, t AS time_s, round(s, 6) + 0.0 AS slowness_sdeg, round(power, 9) AS power,
       support::BIGINT AS support_count FROM rk WHERE rn = 1""")
def event_set_variants(spark, sf):
    near = F.col("distance") <= 32
    names = F.array(F.lit("all"), F.when(near, "near").otherwise("far"))
    t = traces(spark, sf).withColumn("variant", F.explode(names))
    g = stack.vespagram(t, ["lane", "variant"], AXIS.values, sr=SR, power_window_s=POWER_S)
    p = peaks.global_peak_of_rows(g, ["lane", "variant"], 2.0, 32.0, pre_s=PRE, sr=SR)
    return p.select(big("lane").alias("lane"), "variant", "time_s", rnd("slowness_sdeg").alias("slowness_sdeg"),
                    rnd("power", 9).alias("power"), big("support_count").alias("support_count"))


@registered("decoy_windows", sql="""WITH RECURSIVE t AS (
  SELECT s_suppkey AS target, 300 + s_acctbal / 20 AS dt FROM supplier), sh AS (
  SELECT unnest([1, 2, 3, 4]) AS ord, unnest([-300.0, -150.0, 150.0, 300.0])::DOUBLE AS shift), walk AS (
  SELECT target, dt, 0 AS ord, []::DOUBLE[] AS placed, []::BIGINT[] AS steps FROM t UNION ALL
  SELECT w.target, w.dt, w.ord + 1, list_append(placed, c.c), list_append(steps, c.k)
  FROM walk w JOIN LATERAL (
    SELECT first(k ORDER BY k) AS k, first(c ORDER BY k) AS c FROM (
      SELECT k, CASE WHEN v < 60 THEN 120 - v WHEN v > 1160 THEN 2320 - v ELSE v END AS c FROM (
        SELECT k, CASE WHEN u < 60 THEN 120 - u WHEN u > 1160 THEN 2320 - u ELSE u END AS v FROM (
          SELECT k, CASE WHEN q < 60 THEN 120 - q WHEN q > 1160 THEN 2320 - q ELSE q END AS u FROM (
           SELECT k, CASE WHEN p < 60 THEN 120 - p WHEN p > 1160 THEN 2320 - p ELSE p END AS q FROM (
            SELECT k::BIGINT AS k, w.dt + sh.shift + 75.0::DOUBLE * sign(sh.shift) * k AS p
            FROM range(41) r(k), sh WHERE sh.ord = w.ord + 1)))))
    WHERE abs(c - 250) >= 60 AND abs(c - 700) >= 60 AND abs(c - w.dt) >= 60
      AND len(list_filter(w.placed, lambda z: abs(c - z) < 100)) = 0) c ON true
  WHERE w.ord < 4)
SELECT target, (i)::BIGINT AS decoy, round(placed[i], 6) AS center_s, steps[i] AS walk_steps
FROM walk, (SELECT unnest([1, 2, 3, 4]) AS i) WHERE ord = 4""")
def decoy_windows(spark, sf):
    t = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("target"), (F.lit(300) + F.col("s_acctbal") / 20).alias("dt"))
    d = grading.decoy_walk(t, "target", "dt", shifts=(-300.0, -150.0, 150.0, 300.0), collisions=(250.0, 700.0))
    return d.select("target", big("decoy").alias("decoy"), rnd("center_s").alias("center_s"),
                    big("walk_steps").alias("walk_steps"))
