"""Queries on stacked grids: traces are the embedding rows, lanes their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beamspark.dims import Box, SlownessAxis
from beamspark.operators import peaks, ranks, stack
from beamspark.plans.registry import big, registered, rnd, table

SR = 1.0
PRE = 8.0
AXIS = SlownessAxis(-2.0, 0.0, 11)
POWER_S = 5.0
WINDOWS = {"PKiKP": (2.0, 32.0), "PKKP": (28.0, 52.0)}
BOXES = [
    Box("PKiKP", "published_target", 10.0, 18.0, -1.5, -0.7),
    Box("PKKP", "paper_target", 36.0, 44.0, -1.7, -0.9),
    Box("PKKP", "off_grid", 900.0, 910.0, -1.7, -0.9),
]


def distance(vec_id: str = "vec_id") -> Column:
    return F.lit(27.5) + F.pmod(F.col(vec_id), F.lit(23)) * F.lit(0.5)


def valid_mask(vec_id: str = "vec_id", x: str = "embedding") -> Column:
    """A four-sample gap and a short tail cut, both placed by the id."""
    start = F.pmod(F.col(vec_id), F.lit(7)).cast("int")
    cut = F.lit(64) - F.pmod(F.col(vec_id), F.lit(5)).cast("int")
    return F.transform(F.col(x), lambda _, i: ~(i.between(start, start + 3)) & (i < cut))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("event_id"), F.col("label").alias("lane"), distance().alias("distance"),
        F.col("embedding").cast("array<double>").alias("x"), valid_mask().alias("valid"),
    )


def grid(spark: SparkSession, sf_dir: str, method: str = "nth_root", power: bool = True) -> DataFrame:
    return stack.vespagram(
        traces(spark, sf_dir), ["lane"], AXIS.values, sr=SR, method=method,
        power_window_s=POWER_S if power else None,
    )


def grid_cells(spark: SparkSession, sf_dir: str, method: str = "nth_root", power: bool = True) -> DataFrame:
    return stack.cells(grid(spark, sf_dir, method, power), ["lane"], pre_s=PRE, sr=SR)


# ---- shared SQL -------------------------------------------------------------------------------

SAMPLES_SQL = """samples AS (
  SELECT vec_id AS event_id, label AS lane, 27.5::DOUBLE + (vec_id % 23) * 0.5::DOUBLE AS distance,
         ti, x, NOT (ti BETWEEN vec_id % 7 AND vec_id % 7 + 3) AND ti < 64 - vec_id % 5 AS valid
  FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
               (generate_subscripts(embedding, 1) - 1)::BIGINT AS ti FROM embeddings))"""
AXIS_SQL = """axis AS (
  SELECT i AS si, CASE WHEN i = 10 THEN 0.0::DOUBLE
         ELSE -2.0::DOUBLE + i * (2.0::DOUBLE / 10.0::DOUBLE) END AS s FROM range(11) r(i))"""
STACK_SQL = SAMPLES_SQL + ", " + AXIS_SQL + """, shifted AS (
  SELECT lane, event_id, si, s, x,
         ti + round_even(-s * (distance - 29.0::DOUBLE) * 1.0::DOUBLE, 0)::BIGINT AS ti
  FROM samples, axis WHERE valid), acc AS (
  SELECT lane, si, any_value(s) AS s, ti, count(*) AS support, sum(x) / count(*) AS lin,
         sum(sign(x) * pow(abs(x), 0.25::DOUBLE)) / count(*) AS root
  FROM shifted WHERE ti BETWEEN 0 AND 63 GROUP BY lane, si, ti), dense AS (
  SELECT lane, si, s, ti, ti / 1.0::DOUBLE - 8.0::DOUBLE AS t, coalesce(support, 0) AS support,
         CASE WHEN support >= 2 THEN lin END AS lin,
         CASE WHEN support >= 2 THEN sign(root) * pow(abs(root), 4.0::DOUBLE) END AS beam
  FROM (SELECT DISTINCT lane FROM samples) CROSS JOIN axis CROSS JOIN (SELECT unnest(range(64)) AS ti)
  LEFT JOIN acc USING (lane, si, s, ti))"""
# A five-sample Hann window: its two ends weigh nothing.
POWER_SQL = STACK_SQL + """, hann AS (
  SELECT k, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * k / 4) AS h FROM range(5) r(k)), vesp AS (
  SELECT lane, si, s, ti, t, support, beam, CASE WHEN beam IS NOT NULL AND den > 0 THEN num / den END AS power
  FROM (SELECT d.lane, d.si, d.s, d.ti, d.t, d.support, d.beam, sum(h * n.beam * n.beam) AS num,
               sum(CASE WHEN n.beam IS NOT NULL THEN h END) AS den
        FROM dense d CROSS JOIN hann JOIN dense n ON n.lane = d.lane AND n.si = d.si AND n.ti = d.ti + 2 - hann.k
        GROUP BY d.lane, d.si, d.s, d.ti, d.t, d.support, d.beam))"""


@registered("shift_roll_index", sql="WITH " + SAMPLES_SQL + ", " + AXIS_SQL + """
SELECT event_id, si::BIGINT AS si, round_even(-s * (distance - 29.0::DOUBLE), 0)::BIGINT AS roll,
       round(sum(CASE WHEN ti + round_even(-s * (distance - 29.0::DOUBLE), 0) BETWEEN 0 AND 63 THEN x * (1 + ti
         + round_even(-s * (distance - 29.0::DOUBLE), 0)) ELSE 0 END), 6) + 0.0 AS moment
FROM samples, axis GROUP BY event_id, si, s, distance""")
def shift_roll_index(spark, sf):
    axis = F.array(*[F.struct(F.lit(i).alias("si"), F.lit(s).alias("s")) for i, s in enumerate(AXIS.values)])
    t = traces(spark, sf).select("event_id", "distance", "x", F.explode(axis).alias("a"))
    t = t.withColumn("roll", stack.roll_samples(F.col("a.s"), F.col("distance"), 29.0, SR))
    moved = F.transform(stack.shift_zero_fill(F.col("x"), F.col("roll")), lambda v, i: v * (i + 1))
    total = F.aggregate(moved, F.lit(0.0), lambda a, v: a + v)
    return t.select("event_id", big("a.si").alias("si"), big("roll").alias("roll"), rnd(total).alias("moment"))


def _cells_out(c: DataFrame, value: str) -> DataFrame:
    return c.select(
        big("lane").alias("lane"), big("si").alias("si"), big("ti").alias("ti"), rnd(value, 9).alias(value),
        big("support").alias("support"))


@registered("linear_stack", sql="WITH " + STACK_SQL + """
SELECT lane::BIGINT AS lane, si::BIGINT AS si, ti::BIGINT AS ti, round(lin, 9) + 0.0 AS beam,
       support::BIGINT AS support FROM dense""")
def linear_stack(spark, sf):
    return _cells_out(grid_cells(spark, sf, "linear", power=False), "beam")


@registered("nth_root_stack", sql="WITH " + STACK_SQL + """
SELECT lane::BIGINT AS lane, si::BIGINT AS si, ti::BIGINT AS ti, round(beam, 9) + 0.0 AS beam,
       support::BIGINT AS support FROM dense""")
def nth_root_stack(spark, sf):
    return _cells_out(grid_cells(spark, sf, power=False), "beam")


@registered("nth_root_stack_builtin", sql="WITH " + STACK_SQL + """
SELECT lane::BIGINT AS lane, si::BIGINT AS si, ti::BIGINT AS ti, round(beam, 9) + 0.0 AS beam,
       support::BIGINT AS support FROM dense WHERE support > 0""")
def nth_root_stack_builtin(spark, sf):
    return _cells_out(
        stack.long_form_stack(traces(spark, sf), ["lane"], AXIS.values, ref=29.0, sr=SR, method="nth_root"), "beam")


@registered("phase_weighted_stack", sql="WITH " + STACK_SQL + """, masked AS (
  SELECT event_id, lane, distance, ti, valid, CASE WHEN valid THEN x ELSE 0.0::DOUBLE END AS x FROM samples), quad AS (
  SELECT a.event_id, a.ti, sum(b.x * 2.0::DOUBLE / 64 / tan(pi() * ((a.ti - b.ti + 64) % 64) / 64)) AS q
  FROM masked a JOIN masked b ON a.event_id = b.event_id AND (a.ti - b.ti) % 2 <> 0 GROUP BY a.event_id, a.ti), ph AS (
  SELECT m.lane, m.distance, m.ti, m.x, atan2(q.q, m.x) AS phi
  FROM masked m JOIN quad q USING (event_id, ti) WHERE m.valid), moved AS (
  SELECT lane, si, ti + round_even(-s * (distance - 29.0::DOUBLE), 0)::BIGINT AS ti, x, phi FROM ph, axis)
SELECT lane::BIGINT AS lane, si::BIGINT AS si, ti::BIGINT AS ti,
       round(sum(x) / count(*) * sqrt(sum(cos(phi)) * sum(cos(phi)) + sum(sin(phi)) * sum(sin(phi))) / count(*), 9)
         + 0.0 AS beam, count(*)::BIGINT AS support
FROM moved WHERE ti BETWEEN 0 AND 63 GROUP BY lane, si, ti HAVING count(*) >= 2""")
def phase_weighted_stack(spark, sf):
    return _cells_out(grid_cells(spark, sf, "pws", power=False).where("beam IS NOT NULL"), "beam")


@registered("vespagram_hann_power", sql="WITH " + POWER_SQL + """
SELECT lane::BIGINT AS lane, si::BIGINT AS si, ti::BIGINT AS ti, round(power, 9) + 0.0 AS power,
       support::BIGINT AS support FROM vesp""")
def vespagram_hann_power(spark, sf):
    return _cells_out(grid_cells(spark, sf), "power")


@registered("support_map", sql="WITH " + STACK_SQL + """
SELECT lane::BIGINT AS lane, si::BIGINT AS si, count(*) FILTER (support >= 2)::BIGINT AS supported,
       count(*)::BIGINT AS total, max(support)::BIGINT AS max_support, min(support)::BIGINT AS min_support
FROM dense GROUP BY lane, si""")
def support_map(spark, sf):
    c = grid_cells(spark, sf, "linear", power=False)
    return c.groupBy(big("lane").alias("lane"), big("si").alias("si")).agg(
        F.count_if(F.expr("support >= 2")).alias("supported"), F.count("*").alias("total"),
        big(F.max("support")).alias("max_support"), big(F.min("support")).alias("min_support"))


PEAK_COLS_SQL = """round(t, 6) + 0.0 AS time_s, round(s, 6) + 0.0 AS slowness_sdeg, round(power, 9) + 0.0 AS power,
  coalesce(si, -1)::BIGINT AS slow_idx, coalesce(ti, -1)::BIGINT AS time_idx,
  coalesce(support, 0)::BIGINT AS support_count"""


def _peak_out(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys, rnd("time_s").alias("time_s"), rnd("slowness_sdeg").alias("slowness_sdeg"),
        rnd("power", 9).alias("power"), big("slow_idx").alias("slow_idx"), big("time_idx").alias("time_idx"),
        big("support_count").alias("support_count"), "status", "excluded_reason")


def _lane(df: DataFrame) -> DataFrame:
    return df.withColumn("lane", big("lane"))


@registered("global_peak", sql="WITH " + POWER_SQL + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lane ORDER BY power DESC, si, ti) AS rn FROM vesp
  WHERE power IS NOT NULL AND support >= 2 AND t BETWEEN 2.0 AND 32.0)
SELECT lane::BIGINT AS lane, """ + PEAK_COLS_SQL + """, 'ok' AS status, '' AS excluded_reason
FROM ranked WHERE rn = 1""")
def global_peak(spark, sf):
    p = peaks.global_peak_of_rows(grid(spark, sf), ["lane"], *WINDOWS["PKiKP"], pre_s=PRE, sr=SR)
    return _peak_out(_lane(p), "lane")


def _box_values_sql() -> str:
    rows = ", ".join(
        f"('{b.phase}', '{b.label}', {b.t_min}::DOUBLE, {b.t_max}::DOUBLE, {b.s_min}::DOUBLE, {b.s_max}::DOUBLE)"
        for b in BOXES)
    return f"boxes(phase, peak_label, t_min, t_max, s_min, s_max) AS (VALUES {rows})"


BOX_PEAK_SQL = POWER_SQL + ", " + _box_values_sql() + """, inside AS (
  SELECT b.phase, b.peak_label, v.*, v.power IS NOT NULL AND v.support >= 2 AS ok
  FROM vesp v JOIN boxes b ON v.t BETWEEN b.t_min AND b.t_max AND v.s BETWEEN b.s_min AND b.s_max), tot AS (
  SELECT lane, phase, peak_label, count(*) AS total, count(*) FILTER (ok) AS n_ok
  FROM inside GROUP BY ALL), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lane, phase, peak_label ORDER BY power DESC, si, ti) AS rn
                 FROM inside WHERE ok) WHERE rn = 1), bp AS (
  SELECT l.lane, b.phase, b.peak_label, p.t, p.s, p.power, p.si, p.ti, p.support,
         coalesce(q.total, 0) AS total, coalesce(q.n_ok, 0) AS n_ok,
         CASE WHEN coalesce(q.total, 0) = 0 THEN 'blocked_empty_window'
              WHEN p.power IS NULL THEN 'blocked_low_support' ELSE 'ok' END AS status,
         CASE WHEN coalesce(q.total, 0) = 0 THEN 'no_time_samples_in_window'
              WHEN p.power IS NULL THEN 'no_finite_cells_meeting_minimum_support' ELSE '' END AS excluded_reason
  FROM (SELECT DISTINCT lane FROM vesp) l CROSS JOIN boxes b
  LEFT JOIN tot q USING (lane, phase, peak_label) LEFT JOIN best p USING (lane, phase, peak_label))"""


@registered("box_peaks", sql="WITH " + BOX_PEAK_SQL + """
SELECT lane::BIGINT AS lane, phase, peak_label, total::BIGINT AS box_total_cell_count,
       n_ok::BIGINT AS box_valid_cell_count, """ + PEAK_COLS_SQL + ", status, excluded_reason FROM bp")
def box_peaks(spark, sf):
    p = _lane(peaks.box_peaks(grid_cells(spark, sf), ["lane"], BOXES))
    return _peak_out(p, "lane", "phase", "peak_label", "box_total_cell_count", "box_valid_cell_count")


@registered("second_peak_excluding_first", sql="WITH " + POWER_SQL + """, c AS (
  SELECT * FROM vesp WHERE power IS NOT NULL AND support >= 2 AND t BETWEEN 28.0 AND 52.0), p1 AS (
  SELECT lane, t AS t1, s AS s1 FROM (
    SELECT *, row_number() OVER (PARTITION BY lane ORDER BY power DESC, si, ti) AS rn FROM c) WHERE rn = 1), rest AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.lane ORDER BY power DESC, si, ti) AS rn FROM c JOIN p1 USING (lane)
  WHERE NOT (abs(t - t1) <= 6.0 AND abs(s - s1) <= 0.5))
SELECT lane::BIGINT AS lane, """ + PEAK_COLS_SQL + """, 'ok' AS status, '' AS excluded_reason
FROM rest WHERE rn = 1""")
def second_peak_excluding_first(spark, sf):
    p = peaks.second_peak(grid_cells(spark, sf), ["lane"], *WINDOWS["PKKP"], dt=6.0, ds=0.5)
    return _peak_out(_lane(p), "lane")


RANK_SQL = BOX_PEAK_SQL + """, q AS (
  SELECT b.lane, b.phase, b.peak_label, b.power,
         avg(CASE WHEN v.power <= b.power THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS background_quantile,
         1 + count(*) FILTER (v.power > b.power AND v.support >= 2 AND v.t BETWEEN
             CASE b.phase WHEN 'PKiKP' THEN 2.0 ELSE 28.0 END AND CASE b.phase WHEN 'PKiKP' THEN 32.0 ELSE 52.0 END)
           AS target_box_rank,
         count(*) FILTER (w.ok AND v.power >= 0.85::DOUBLE * b.power) AS n_band
  FROM bp b JOIN vesp v ON v.lane = b.lane AND v.power IS NOT NULL
  LEFT JOIN inside w ON w.lane = b.lane AND w.phase = b.phase AND w.peak_label = b.peak_label
                    AND w.si = v.si AND w.ti = v.ti
  WHERE b.power IS NOT NULL GROUP BY ALL)"""


@registered("peak_rank_quantile", sql="WITH " + RANK_SQL + """
SELECT bp.lane::BIGINT AS lane, bp.phase, bp.peak_label, round(bp.power, 9) + 0.0 AS power,
       round(q.background_quantile, 9) + 0.0 AS background_quantile,
       coalesce(q.target_box_rank, 0)::BIGINT AS target_box_rank,
       round(CASE WHEN total > 0 THEN n_ok::DOUBLE / total ELSE 0 END, 9) AS box_supported_cell_fraction,
       round(CASE WHEN n_ok > 0 THEN n_band::DOUBLE / n_ok ELSE 0 END, 9) AS box_occupancy_in_band
FROM bp LEFT JOIN q USING (lane, phase, peak_label)""")
def peak_rank_quantile(spark, sf):
    c = grid_cells(spark, sf)
    p = peaks.box_peaks(c, ["lane"], BOXES)
    r = peaks.rank_and_quantile(c, peaks.box_occupancy(c, p, ["lane"], BOXES), ["lane"], WINDOWS)
    return r.select(
        big("lane").alias("lane"), "phase", "peak_label", rnd("power", 9).alias("power"),
        rnd("background_quantile", 9).alias("background_quantile"), big("target_box_rank").alias("target_box_rank"),
        rnd("box_supported_cell_fraction", 9).alias("box_supported_cell_fraction"),
        rnd("box_occupancy_in_band", 9).alias("box_occupancy_in_band"))


@registered("local_maximum_3x3", sql="WITH " + POWER_SQL + """
SELECT a.lane::BIGINT AS lane, a.si::BIGINT AS si, a.ti::BIGINT AS ti, round(a.power, 9) + 0.0 AS power
FROM vesp a JOIN vesp b ON a.lane = b.lane AND b.si BETWEEN a.si - 1 AND a.si + 1 AND b.ti BETWEEN a.ti - 1 AND a.ti + 1
WHERE a.power IS NOT NULL GROUP BY a.lane, a.si, a.ti, a.power HAVING round(a.power, 12) >= max(round(b.power, 12))""")
def local_maximum_3x3(spark, sf):
    # Rounded first: neighbours that are equal on paper may differ in the last bit of a sum.
    c = grid_cells(spark, sf).withColumn("power", F.round("power", 12))
    c = peaks.local_maxima(c, ["lane"]).where("is_local_max")
    return c.select(big("lane").alias("lane"), big("si").alias("si"), big("ti").alias("ti"),
                    rnd("power", 9).alias("power"))


@registered("sub_window_normalised", sql="WITH " + POWER_SQL + """, w(phase, lo, hi) AS (
  VALUES ('PKiKP', 2.0, 32.0), ('PKKP', 28.0, 52.0)), sub AS (
  SELECT lane, phase, si, ti, power FROM vesp JOIN w ON t BETWEEN lo AND hi)
SELECT lane::BIGINT AS lane, phase, si::BIGINT AS si, ti::BIGINT AS ti,
       round(power / max(power) OVER (PARTITION BY lane, phase), 9) + 0.0 AS rel_power FROM sub""")
def sub_window_normalised(spark, sf):
    p = peaks.sub_window_product(grid_cells(spark, sf), ["lane"], WINDOWS)
    return p.select(big("lane").alias("lane"), "phase", big("si").alias("si"), big("ti").alias("ti"),
                    rnd("rel_power", 9).alias("rel_power"))


PUBLISHED = {"PKiKP/published_target": (14.0, -1.1), "PKKP/paper_target": (40.0, -1.3), "PKKP/off_grid": (905.0, -1.3)}
TOLERANCES = {"PKiKP/published_target": (2.0, 0.6), "PKKP/paper_target": (5.0, 0.4), "PKKP/off_grid": (30.0, 1.5)}


@registered("peak_fact_table", sql="WITH " + RANK_SQL + """, err AS (
  SELECT label AS lane, median((1.0::DOUBLE + vec_id % 5)) FILTER (vec_id % 11 <> 0) AS med,
         max((1.0::DOUBLE + vec_id % 5)) FILTER (vec_id % 11 <> 0) AS top FROM embeddings GROUP BY label),
tgt(phase, peak_label, pt, ps, tt, ts) AS (VALUES
  ('PKiKP', 'published_target', 14.0::DOUBLE, -1.1::DOUBLE, 2.0::DOUBLE, 0.6::DOUBLE),
  ('PKKP', 'paper_target', 40.0::DOUBLE, -1.3::DOUBLE, 5.0::DOUBLE, 0.4::DOUBLE),
  ('PKKP', 'off_grid', 905.0::DOUBLE, -1.3::DOUBLE, 30.0::DOUBLE, 1.5::DOUBLE)), lm AS (
  SELECT a.lane, a.si, a.ti, a.power >= max(b.power) AS is_max
  FROM vesp a JOIN vesp b ON a.lane = b.lane AND b.si BETWEEN a.si - 1 AND a.si + 1
   AND b.ti BETWEEN a.ti - 1 AND a.ti + 1 WHERE a.power IS NOT NULL GROUP BY a.lane, a.si, a.ti, a.power)
SELECT bp.lane::BIGINT AS lane, bp.phase, bp.peak_label, round(bp.t, 6) + 0.0 AS time_s,
  round(bp.s, 6) + 0.0 AS slowness_sdeg, round(bp.power, 9) + 0.0 AS power,
  coalesce(bp.support, 0)::BIGINT AS support_count, 2::BIGINT AS minimum_support, bp.status, bp.excluded_reason,
  pt AS paper_time_s, ps AS paper_slowness_sdeg, round(t - pt, 6) + 0.0 AS dt_vs_paper_s,
  round(s - ps, 6) + 0.0 AS ds_vs_paper_sdeg,
  coalesce(abs(t - pt) <= tt AND abs(s - ps) <= ts, false) AS within_published_tolerance,
  round(sqrt(pow((t - pt) / tt, 2) + pow((s - ps) / ts, 2)), 6) + 0.0 AS grid_coordinate_miss_norm,
  med AS median_distance_error_deg, top AS max_distance_error_deg,
  round(abs(ps) * med, 6) + 0.0 AS distance_uncertainty_moveout_s,
  round(tt + abs(ps) * med, 6) + 0.0 AS uncertainty_folded_time_tolerance_s,
  coalesce(abs(t - pt) <= tt + abs(ps) * med AND abs(s - ps) <= ts, false) AS within_uncertainty_folded_tolerance,
  coalesce(is_max, false) AS local_max_neighbor_check,
  round(q.background_quantile, 9) + 0.0 AS background_quantile,
  coalesce(q.target_box_rank, 0)::BIGINT AS target_box_rank,
  n_ok::BIGINT AS box_valid_cell_count, total::BIGINT AS box_total_cell_count,
  CASE WHEN bp.lane % 3 = 0 THEN 'headline_targeted_window_eq1' WHEN bp.lane % 3 = 1 THEN 'targeted_pkkp_window'
       ELSE 'ablation_full_window' END AS normalization_lane
FROM bp JOIN tgt USING (phase, peak_label) LEFT JOIN q USING (lane, phase, peak_label)
LEFT JOIN lm ON lm.lane = bp.lane AND lm.si = bp.si AND lm.ti = bp.ti LEFT JOIN err ON err.lane = bp.lane""")
def peak_fact_table(spark, sf):
    c = grid_cells(spark, sf)
    p = peaks.box_peaks(c, ["lane"], BOXES)
    p = peaks.rank_and_quantile(c, p, ["lane"], WINDOWS)
    flags = peaks.local_maxima(c, ["lane"]).where("is_local_max").select(
        "lane", F.col("si").alias("slow_idx"), F.col("ti").alias("time_idx"),
        F.lit(True).alias("local_max_neighbor_check"))
    p = p.join(flags, ["lane", "slow_idx", "time_idx"], "left").fillna({"local_max_neighbor_check": False})
    known = F.when(F.pmod("vec_id", F.lit(11)) != 0, F.lit(1.0) + F.pmod("vec_id", F.lit(5)))
    errors = table(spark, sf, "embeddings").select(F.col("label").alias("lane"), known.alias("e"))
    err = ranks.quantiles(errors, ["lane"], "e", [0.5]).withColumnRenamed("q50", "med").join(
        errors.groupBy("lane").agg(F.max("e").alias("top")), "lane")
    f = peaks.peak_facts(
        p.join(err, "lane", "left"), PUBLISHED, tolerances=TOLERANCES,
        median_error=F.col("med"), max_error=F.col("top"))
    variant = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.pmod("lane", F.lit(3)) + 1)
    cols = ["time_s", "slowness_sdeg", "dt_vs_paper_s", "ds_vs_paper_sdeg", "grid_coordinate_miss_norm",
            "distance_uncertainty_moveout_s", "uncertainty_folded_time_tolerance_s"]
    return f.select(
        big("lane").alias("lane"), "phase", "peak_label", *[rnd(k).alias(k) for k in cols],
        rnd("power", 9).alias("power"), big("support_count").alias("support_count"),
        F.lit(2).cast("bigint").alias("minimum_support"), "status", "excluded_reason", "paper_time_s",
        "paper_slowness_sdeg", "within_published_tolerance", "median_distance_error_deg", "max_distance_error_deg",
        "within_uncertainty_folded_tolerance", "local_max_neighbor_check",
        rnd("background_quantile", 9).alias("background_quantile"), big("target_box_rank").alias("target_box_rank"),
        "box_valid_cell_count", "box_total_cell_count",
        peaks.normalization_lane(F.lit("paperfaith"), variant).alias("normalization_lane"))


@registered("decoy_box_family", sql="WITH " + POWER_SQL + """, fam AS (
  SELECT 2.0::DOUBLE + i * 2.0::DOUBLE AS tc, -1.8::DOUBLE + k * 0.1::DOUBLE AS sc FROM range(25) a(i), range(17) b(k)),
box AS (
  SELECT v.lane, tc, sc, max(power) AS m, count(*) AS n FROM vesp v JOIN fam
    ON v.t BETWEEN tc - 4.0 AND tc + 4.0 AND v.s >= sc - 0.25::DOUBLE AND v.s <= sc + 0.25::DOUBLE
  WHERE power IS NOT NULL AND support >= 2 GROUP BY ALL), tgt AS (
  SELECT lane, max(power) AS target FROM vesp WHERE power IS NOT NULL AND support >= 2
    AND t BETWEEN 10.0 AND 18.0 AND s BETWEEN -1.5 AND -0.7 GROUP BY lane)
SELECT lane::BIGINT AS lane, count(*)::BIGINT AS n_boxes, count(*) FILTER (ov)::BIGINT AS n_overlap,
       count(*) FILTER (m >= target)::BIGINT AS ge_incl, count(*) FILTER (m >= target AND NOT ov)::BIGINT AS ge_excl,
       round(count(*) FILTER (m >= target)::DOUBLE / count(*), 9) AS fraction_incl,
       round(count(*) FILTER (m >= target AND NOT ov)::DOUBLE / count(*) FILTER (NOT ov), 9) AS fraction_excl,
       sum(n)::BIGINT AS cells_covered, round(max(m), 9) AS top_power
FROM (SELECT box.*, target, tc - 4 <= 18 AND tc + 4 >= 10 AND sc - 0.25::DOUBLE <= -0.7::DOUBLE
             AND sc + 0.25::DOUBLE >= -1.5::DOUBLE AS ov FROM box JOIN tgt USING (lane)) GROUP BY lane""")
def decoy_box_family(spark, sf):
    c = grid_cells(spark, sf)
    box = peaks.box_family(
        c, ["lane"], t_centers=[2.0 + 2.0 * i for i in range(25)],
        s_centers=[-1.8 + 0.1 * k for k in range(17)], half_t=4.0, half_s=0.25)
    target = c.where(peaks.supported() & peaks.in_box(10.0, 18.0, -1.5, -0.7)).groupBy("lane").agg(
        F.max("power").alias("target"))
    ov = peaks.overlaps(F.col("t_center"), F.col("s_center"), 4.0, 0.25, BOXES[0])
    ge = F.col("box_max_power") >= F.col("target")
    return box.join(target, "lane").withColumns({"ov": ov, "ge": ge}).groupBy(big("lane").alias("lane")).agg(
        F.count("*").alias("n_boxes"), F.count_if(F.expr("ov")).alias("n_overlap"), F.count_if(F.expr("ge")).alias("ge_incl"),
        F.count_if(F.expr("ge AND NOT ov")).alias("ge_excl"),
        rnd(F.count_if(F.expr("ge")) / F.count("*"), 9).alias("fraction_incl"),
        rnd(F.count_if(F.expr("ge AND NOT ov")) / F.count_if(F.expr("NOT ov")), 9).alias("fraction_excl"),
        F.sum("n_supported_cells").alias("cells_covered"), rnd(F.max("box_max_power"), 9).alias("top_power"))


# The two registered families, 371 x 89 and 371 x 81 boxes, laid over the axes of the test grid: (half widths, slowness centres, target).
FAMILY_T = [-4.0 + 0.15 * i for i in range(371)]
FAMILIES = {"PKiKP": (4.0, 0.12, [-1.88 + 0.02 * k for k in range(89)], BOXES[0]), "PKKP": (4.0, 0.2, [-1.8 + 0.02 * k for k in range(81)], BOXES[1])}


def _family_sql(name: str, half_t: float, half_s: float, first: float, count: int, box: Box) -> str:
    return f"""{name}_t AS (
  SELECT lane, s, i, max(power) AS m, count(*) AS n FROM ok JOIN range(371) r(i)
    ON t BETWEEN -4.0::DOUBLE + 0.15::DOUBLE * i - {half_t} AND -4.0::DOUBLE + 0.15::DOUBLE * i + {half_t} GROUP BY ALL), {name} AS (
  SELECT b.*, m, n, -4.0::DOUBLE + 0.15::DOUBLE * b.i AS tc FROM (
    SELECT l.lane, i, k, {first}::DOUBLE + 0.02::DOUBLE * k AS sc FROM (SELECT DISTINCT lane FROM vesp) l, range(371) a(i), range({count}) c(k)) b
  LEFT JOIN {name}_t f ON f.lane = b.lane AND f.i = b.i AND f.s >= sc - {half_s}::DOUBLE AND f.s <= sc + {half_s}::DOUBLE), {name}_b AS (
  SELECT lane, i, k, tc, sc, max(m) AS m, coalesce(sum(n), 0) AS n,
         tc - {half_t} <= {box.t_max} AND tc + {half_t} >= {box.t_min} AND sc - {half_s}::DOUBLE <= {box.s_max}::DOUBLE AND sc + {half_s}::DOUBLE >= {box.s_min}::DOUBLE AS ov
  FROM {name} GROUP BY ALL), {name}_k AS (
  SELECT lane, max(power) AS target FROM ok WHERE t BETWEEN {box.t_min} AND {box.t_max} AND s BETWEEN {box.s_min} AND {box.s_max} GROUP BY lane)"""


@registered("decoy_box_families", sql="WITH " + POWER_SQL + """, ok AS (SELECT * FROM vesp WHERE power IS NOT NULL AND support >= 2), ridge AS (
  SELECT lane, t AS rt, s AS rs, power AS rp FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY power DESC, si, ti) AS rn FROM ok) WHERE rn = 1), """
            + _family_sql("f1", 4.0, 0.12, -1.88, 89, BOXES[0]) + ", " + _family_sql("f2", 4.0, 0.2, -1.8, 81, BOXES[1]) + """, one AS (
  SELECT lane, count(*) AS boxes_1, count(*) FILTER (ov) AS overlap_1, count(*) FILTER (n = 0) AS empty_1, count(*) FILTER (near) AS ridge_boxes,
         round(count(*) FILTER (m >= target)::DOUBLE / count(*), 9) AS target_incl,
         round(count(*) FILTER (m >= target AND NOT ov)::DOUBLE / count(*) FILTER (NOT ov), 9) AS target_excl,
         round(count(*) FILTER (m >= rp)::DOUBLE / count(*), 9) AS ridge_incl,
         round(count(*) FILTER (m >= rp AND NOT near)::DOUBLE / count(*) FILTER (NOT near), 9) AS ridge_excl, sum(n)::BIGINT AS cells_1
  FROM (SELECT b.*, target, rp, abs(tc - rt) <= 4.0 AND abs(sc - rs) <= 0.12::DOUBLE AS near FROM f1_b b JOIN f1_k USING (lane) JOIN ridge USING (lane)) GROUP BY lane), two AS (
  SELECT lane, count(*) AS boxes_2, count(*) FILTER (ov) AS overlap_2, count(*) FILTER (n = 0) AS empty_2,
         round(count(*) FILTER (m >= target)::DOUBLE / count(*), 9) AS pkkp_incl,
         round(count(*) FILTER (m >= target AND NOT ov)::DOUBLE / count(*) FILTER (NOT ov), 9) AS pkkp_excl, sum(n)::BIGINT AS cells_2
  FROM f2_b JOIN f2_k USING (lane) GROUP BY lane)
SELECT * REPLACE (lane::BIGINT AS lane) FROM one JOIN two USING (lane)""")
def decoy_box_families(spark, sf):
    """The six fractions of both families: with and without the boxes that overlap the target, or hold the ridge."""
    g = grid(spark, sf)
    cells = stack.cells(g, ["lane"], pre_s=PRE, sr=SR).where(peaks.supported())
    best = lambda b: F.max(F.when(peaks.in_box(b.t_min, b.t_max, b.s_min, b.s_max), F.col("power")))
    marks = cells.groupBy("lane").agg(F.max(peaks.ordered_cell()).alias("r"), *[best(b).alias(f"target_{k}") for k, (*_, b) in FAMILIES.items()])
    out = None
    for no, (phase, (half_t, half_s, centers, box)) in enumerate(FAMILIES.items(), 1):
        fam = peaks.box_sweep(g, ["lane"], t_centers=FAMILY_T, s_centers=centers, half_t=half_t, half_s=half_s, pre_s=PRE, sr=SR).join(marks, "lane")
        m, target = F.col("box_max_power"), F.col(f"target_{phase}")
        fam = fam.where(target.isNotNull()).withColumns({
            "ov": peaks.overlaps(F.col("t_center"), F.col("s_center"), half_t, half_s, box), "ge": F.coalesce(m >= target, F.lit(False)),
            "gr": F.coalesce(m >= F.col("r.power"), F.lit(False)),
            "near": (F.abs(F.col("t_center") - F.col("r.t")) <= half_t) & (F.abs(F.col("s_center") - F.col("r.s")) <= half_s)})
        share = lambda hit, among: rnd(F.count_if(F.expr(f"{hit} AND {among}")) / F.count_if(F.expr(among)), 9)
        aggs = [F.count("*").alias(f"boxes_{no}"), F.count_if("ov").alias(f"overlap_{no}"), F.count_if(F.col("n_supported_cells") == 0).alias(f"empty_{no}"),
                F.sum("n_supported_cells").alias(f"cells_{no}")]
        name = "target" if no == 1 else "pkkp"
        aggs += [share("ge", "true").alias(f"{name}_incl"), share("ge", "NOT ov").alias(f"{name}_excl")]
        if no == 1:
            aggs += [F.count_if("near").alias("ridge_boxes"), share("gr", "true").alias("ridge_incl"), share("gr", "NOT near").alias("ridge_excl")]
        one = fam.groupBy(big("lane").alias("lane")).agg(*aggs)
        out = one if out is None else out.join(one, "lane")
    return out
