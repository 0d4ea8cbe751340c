"""Queries on single traces: every embedding row is one trace of 64 samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from beamspark import dims
from beamspark.functions import kernels
from beamspark.operators import traces as tr
from beamspark.plans.grids import SAMPLES_SQL, traces, valid_mask
from beamspark.plans.registry import big, registered, rnd, rnd_fast, table

SR = 20.0
FDPA_SR = 4.0  # sixteen seconds a record, so that the registered bands fit in
HEAVY_TASKS = 64  # tasks that the few heavy rows of a step are dealt over
COMPONENT_SQL = """base AS (
  SELECT vec_id AS event_id, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::BIGINT AS ti
  FROM embeddings), zne AS (
  SELECT a.event_id, a.ti, a.x AS z, b.x AS n, c.x AS e
  FROM base a JOIN base b ON b.event_id = a.event_id AND b.ti = 63 - a.ti
  JOIN base c ON c.event_id = a.event_id AND c.ti = (a.ti + 16) % 64)"""


def components(spark, sf):
    """Three components per event from one row: the trace, its reverse and its rotation by 16 samples."""
    x = F.col("x")
    return traces(spark, sf).select(
        "event_id", "lane", x.alias("z"), F.reverse(x).alias("n"),
        F.concat(F.slice(x, 17, 48), F.slice(x, 1, 16)).alias("e"), "valid")


def long_out(df, key, *values, digits=9):
    """(event, sample) rows from array columns."""
    flat = df.select(F.col(key).alias("event_id"), F.posexplode(F.arrays_zip(*values)).alias("ti", "c"))
    types = {v: df.schema[v].dataType.elementType.simpleString() for v in values}
    return flat.select(
        big("event_id").alias("event_id"), big("ti").alias("ti"),
        *[rnd(f"c.{v}", digits).alias(v) if types[v] == "double" else F.col(f"c.{v}").alias(v) for v in values])


@registered("zscore_window", sql="WITH " + SAMPLES_SQL + """, st AS (
  SELECT event_id, avg(x) AS mu, stddev_pop(x) AS sd FROM samples WHERE valid AND ti - 8 BETWEEN 4 AND 40 GROUP BY 1)
SELECT event_id, ti, round(CASE WHEN valid THEN (x - mu) / sd ELSE 0 END, 9) + 0.0 AS z
FROM samples JOIN st USING (event_id)""")
def zscore_window(spark, sf):
    return long_out(tr.zscore(traces(spark, sf), 1.0, 8.0, 4.0, 40.0), "event_id", "z")


@registered("smooth_valid_support", sql="WITH " + SAMPLES_SQL + """
SELECT a.event_id, a.ti, round(coalesce(sum(CASE WHEN b.valid THEN b.x END) / nullif(count(*) FILTER (b.valid), 0), 0), 9)
       + 0.0 AS smooth
FROM samples a JOIN samples b ON a.event_id = b.event_id AND b.ti BETWEEN a.ti - 3 AND a.ti + 2 GROUP BY 1, 2""")
def smooth_valid_support(spark, sf):
    s = tr.map_arrays(traces(spark, sf), ["event_id"], ["x", "valid"], "smooth array<double>",
                      lambda x, ok: (kernels.boxcar_mean(x, ok, 6),))
    return long_out(s, "event_id", "smooth")


@registered("valid_runs", sql="WITH " + SAMPLES_SQL + """, r AS (
  SELECT event_id, ti, ti - row_number() OVER (PARTITION BY event_id ORDER BY ti) AS g FROM samples WHERE valid)
SELECT event_id, min(ti) AS run_start, max(ti) + 1 AS run_end FROM r GROUP BY event_id, g""")
def valid_runs(spark, sf):
    r = tr.map_arrays(traces(spark, sf), ["event_id"], ["valid"], "run_start bigint, run_end bigint",
                      lambda ok: [(a, b) for a, b in kernels.runs(ok)])
    return r.select(big("event_id").alias("event_id"), "run_start", "run_end")


@registered("eroded_mask", sql="WITH " + SAMPLES_SQL + """, r AS (
  SELECT event_id, ti, ti - row_number() OVER (PARTITION BY event_id ORDER BY ti) AS g FROM samples WHERE valid), b AS (
  SELECT event_id, min(ti) AS lo, max(ti) + 1 AS hi FROM r GROUP BY event_id, g)
SELECT s.event_id, s.ti, bool_or(b.lo IS NOT NULL) AS inner_ok
FROM samples s LEFT JOIN b ON b.event_id = s.event_id AND s.ti >= b.lo + 3 AND s.ti < b.hi - 3 GROUP BY 1, 2""")
def eroded_mask(spark, sf):
    e = tr.map_arrays(traces(spark, sf), ["event_id"], ["valid"], "inner_ok array<boolean>",
                      lambda ok: (kernels.erode(ok, 3),))
    return long_out(e, "event_id", "inner_ok")


@registered("gap_fill_interpolated", sql="WITH " + SAMPLES_SQL + """, g AS (
  SELECT *, last_value(CASE WHEN valid THEN ti END IGNORE NULLS) OVER w AS t0,
         last_value(CASE WHEN valid THEN x END IGNORE NULLS) OVER w AS x0,
         first_value(CASE WHEN valid THEN ti END IGNORE NULLS) OVER v AS t1,
         first_value(CASE WHEN valid THEN x END IGNORE NULLS) OVER v AS x1
  FROM samples WINDOW w AS (PARTITION BY event_id ORDER BY ti ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      v AS (PARTITION BY event_id ORDER BY ti ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, ti, round(CASE WHEN valid THEN x WHEN t0 IS NULL OR t1 IS NULL OR t1 - t0 - 1 > 4 THEN 0
       ELSE x0 + (x1 - x0) * (ti - t0) / (t1 - t0) END, 9) + 0.0 AS filled FROM g""")
def gap_fill_interpolated(spark, sf):
    f = tr.map_arrays(traces(spark, sf), ["event_id"], ["x", "valid"], "filled array<double>",
                      lambda x, ok: (kernels.fill_gaps(x, ok, 4),))
    return long_out(f, "event_id", "filled")


@registered("cut_zero_padded", sql="WITH " + SAMPLES_SQL + """, o AS (
  SELECT DISTINCT event_id, round_even(event_id % 37 * 1.5::DOUBLE - 20.0::DOUBLE, 0)::BIGINT AS st FROM samples)
SELECT o.event_id, k.ti, round(coalesce(s.x, 0), 9) + 0.0 AS x, coalesce(s.valid, false) AS valid
FROM o CROSS JOIN (SELECT unnest(range(40)) AS ti) k
LEFT JOIN samples s ON s.event_id = o.event_id AND s.ti = k.ti + o.st""")
def cut_zero_padded(spark, sf):
    start = F.rint(F.pmod("event_id", F.lit(37)) * F.lit(1.5) - F.lit(20.0)).cast("int")
    t = traces(spark, sf).withColumn("st", start)
    c = t.select("event_id", tr.cut_zero_padded(F.col("st"), 40).alias("c")).select("event_id", "c.x", "c.valid")
    return long_out(c, "event_id", "x", "valid")


@registered("sample_rate_inference", sql="""WITH t AS (
  SELECT vec_id AS event_id, (generate_subscripts(embedding, 1) - 1) AS ti, unnest(embedding)::DOUBLE AS x
  FROM embeddings), d AS (
  SELECT event_id, y - lag(y) OVER (PARTITION BY event_id ORDER BY ti) AS d
  FROM (SELECT event_id, ti, ti * 0.05::DOUBLE + x * (CASE WHEN event_id % 2 = 0 THEN 0.0001::DOUBLE
        ELSE 0.2::DOUBLE END) AS y FROM t)), s AS (
  SELECT event_id, median(d) AS med, quantile_cont(d, 0.999::DOUBLE) - quantile_cont(d, 0.001::DOUBLE) AS spread,
         bool_and(d > 0) AS inc FROM d WHERE d IS NOT NULL GROUP BY event_id)
SELECT event_id, round(med, 9) + 0.0 AS median_step, round(spread, 9) + 0.0 AS step_spread,
       inc AS strictly_increasing,
       round(CASE WHEN abs(1 / med - 20.0) <= 0.02 THEN 20.0 ELSE 1 / med END, 6) + 0.0 AS rate_hz FROM s""")
def sample_rate_inference(spark, sf):
    scale = F.when(F.pmod("event_id", F.lit(2)) == 0, F.lit(0.0001)).otherwise(F.lit(0.2))
    t = traces(spark, sf).select(
        "event_id", F.transform("x", lambda v, i: i * F.lit(0.05) + v * scale).alias("axis"))
    r = tr.sample_rate(F.col("axis"), 20.0)
    return t.select(
        big("event_id").alias("event_id"), rnd(r["median_step"], 9).alias("median_step"),
        rnd(r["step_spread"], 9).alias("step_spread"), r["strictly_increasing"].alias("strictly_increasing"),
        rnd(r["rate_hz"]).alias("rate_hz"))


@registered("subsample_shift", sql="WITH " + SAMPLES_SQL + """, p AS (
  SELECT event_id, ti, ti - ((event_id * 31 % 41) - 20) * 0.25::DOUBLE AS pos FROM samples), q AS (
  SELECT *, floor(pos)::BIGINT AS i0, pos - floor(pos) AS f FROM p)
SELECT q.event_id, q.ti,
       round(CASE WHEN pos >= 0 AND pos <= 63 THEN a.x + (coalesce(b.x, a.x) - a.x) * f ELSE 0 END, 9) + 0.0 AS moved,
       pos >= 0 AND pos <= 63 AND a.valid AND (f = 0 OR b.valid) AS moved_ok
FROM q LEFT JOIN samples a ON a.event_id = q.event_id AND a.ti = i0
LEFT JOIN samples b ON b.event_id = q.event_id AND b.ti = i0 + 1""")
def subsample_shift(spark, sf):
    from beamspark.operators.stack import _lerp_shift

    shift = (F.pmod(F.col("event_id") * 31, F.lit(41)) - 20) * F.lit(0.25)
    m = tr.map_arrays(
        traces(spark, sf).withColumn("shift", shift), ["event_id"], ["x", "valid", "shift"],
        "moved array<double>, moved_ok array<boolean>",
        lambda x, ok, d: tuple(a[0] for a in _lerp_shift(x[None, :], ok[None, :], np.array([d]))))
    return long_out(m, "event_id", "moved", "moved_ok")


@registered("segment_envelope", sql="WITH " + SAMPLES_SQL + """, r AS (
  SELECT *, ti - row_number() OVER (PARTITION BY event_id ORDER BY ti) AS g FROM samples WHERE valid), n AS (
  SELECT event_id, g, count(*) AS n FROM r GROUP BY 1, 2), q AS (
  SELECT a.event_id, a.g, a.ti, sum(b.x * CASE WHEN a.ti = b.ti THEN 0
      WHEN n % 2 = 0 THEN (1 - cos(pi() * (a.ti - b.ti))) / tan(pi() * (a.ti - b.ti) / n) / n
      ELSE (1 / tan(pi() * (a.ti - b.ti) / n) - cos(pi() * (a.ti - b.ti)) / sin(pi() * (a.ti - b.ti) / n)) / n END) AS h
  FROM r a JOIN r b USING (event_id, g) JOIN n USING (event_id, g) GROUP BY 1, 2, 3)
SELECT s.event_id, s.ti, round(CASE WHEN q.h IS NULL THEN 0 ELSE sqrt(s.x * s.x + q.h * q.h) END, 8) + 0.0 AS envelope
FROM samples s LEFT JOIN q ON q.event_id = s.event_id AND q.ti = s.ti""")
def segment_envelope(spark, sf):
    e = tr.map_arrays(traces(spark, sf), ["event_id"], ["x", "valid"], "envelope array<double>",
                      lambda x, ok: (kernels.run_envelope(x, ok),))
    return long_out(e, "event_id", "envelope", digits=8)


@registered("normalised_envelope_products", sql="WITH " + SAMPLES_SQL + """, st AS (
  SELECT event_id, avg(x) AS mu, stddev_pop(x) AS sd FROM samples WHERE valid AND ti - 8 BETWEEN 4 AND 40 GROUP BY 1), zs AS (
  SELECT event_id, ti, valid, CASE WHEN valid THEN (x - mu) / sd ELSE 0 END AS z FROM samples JOIN st USING (event_id)), r AS (
  SELECT *, ti - row_number() OVER (PARTITION BY event_id ORDER BY ti) AS g FROM zs WHERE valid), n AS (
  SELECT event_id, g, count(*) AS n, min(ti) AS lo, max(ti) + 1 AS hi FROM r GROUP BY 1, 2), q AS (
  SELECT a.event_id, a.ti, any_value(a.ti >= lo + 3 AND a.ti < hi - 3) AS inner_ok, any_value(a.z) AS z,
    sum(b.z * CASE WHEN a.ti = b.ti THEN 0
      WHEN n % 2 = 0 THEN (1 - cos(pi() * (a.ti - b.ti))) / tan(pi() * (a.ti - b.ti) / n) / n
      ELSE (1 / tan(pi() * (a.ti - b.ti) / n) - cos(pi() * (a.ti - b.ti)) / sin(pi() * (a.ti - b.ti) / n)) / n END) AS h
  FROM r a JOIN r b USING (event_id, g) JOIN n USING (event_id, g) GROUP BY 1, 2), sm AS (
  SELECT a.event_id, a.ti, avg(sqrt(b.z * b.z + b.h * b.h)) AS env FROM q a JOIN q b ON a.event_id = b.event_id
    AND b.ti BETWEEN a.ti - 2 AND a.ti + 2 GROUP BY 1, 2)
SELECT zs.event_id, zs.ti, round(zs.z, 8) + 0.0 AS z, round(CASE WHEN q.inner_ok THEN env ELSE 0 END, 8) + 0.0 AS envelope,
  coalesce(q.inner_ok, false) AS envelope_valid
FROM zs LEFT JOIN q ON q.event_id = zs.event_id AND q.ti = zs.ti LEFT JOIN sm ON sm.event_id = zs.event_id AND sm.ti = zs.ti""")
def normalised_envelope_products(spark, sf):
    p = tr.normalise_products(traces(spark, sf), ["event_id"], sr=1.0, pre_s=8.0, t_min=4.0, t_max=40.0,
                              smooth_s=5.0, edge_s=3.0)
    return long_out(p, "event_id", "z", "envelope", "envelope_valid", digits=8)


WINDOW_SQL = """win AS (SELECT unnest(range(0, 49, 2)) AS st)"""


@registered("sliding_window_overlap_mean", sql="WITH " + SAMPLES_SQL + ", " + WINDOW_SQL + """, g AS (
  SELECT event_id, st, sqrt(avg(x * x)) AS gain FROM samples JOIN win ON ti >= st AND ti < st + 16 GROUP BY 1, 2)
SELECT s.event_id, s.ti, round(any_value(s.x) * avg(gain), 9) + 0.0 AS weighted, count(*) AS windows
FROM samples s JOIN g ON g.event_id = s.event_id AND s.ti >= st AND s.ti < st + 16 GROUP BY 1, 2""")
def sliding_window_overlap_mean(spark, sf):
    def step(x):
        win, starts = kernels.window_starts(len(x), 16, 0.9)
        seg = x[starts[:, None] + np.arange(win)[None, :]]
        gain = np.sqrt((seg**2).mean(axis=1))
        cover = np.bincount((starts[:, None] + np.arange(win)).ravel(), minlength=len(x))
        return x * kernels._cover(len(x), win, starts, gain), cover

    m = tr.map_arrays(traces(spark, sf), ["event_id"], ["x"], "weighted array<double>, windows array<bigint>", step)
    return long_out(m, "event_id", "weighted", "windows")


@registered("window_covariance_3c", sql="WITH " + COMPONENT_SQL + ", " + WINDOW_SQL + """
SELECT event_id, st AS window_start, round(covar_samp(z, z), 9) + 0.0 AS czz, round(covar_samp(n, n), 9) + 0.0 AS cnn,
       round(covar_samp(e, e), 9) + 0.0 AS cee, round(covar_samp(z, n), 9) + 0.0 AS czn,
       round(covar_samp(z, e), 9) + 0.0 AS cze, round(covar_samp(n, e), 9) + 0.0 AS cne
FROM zne JOIN win ON ti >= st AND ti < st + 16 GROUP BY 1, 2""")
def window_covariance_3c(spark, sf):
    def step(z, n, e):
        zne = np.vstack([z, n, e])
        win, starts = kernels.window_starts(len(z), 16, 0.9)
        seg = kernels._windows(zne, win, starts)
        c = seg @ seg.transpose(0, 2, 1) / (win - 1)
        return [(int(s), m[0, 0], m[1, 1], m[2, 2], m[0, 1], m[0, 2], m[1, 2]) for s, m in zip(starts, c)]

    names = ["czz", "cnn", "cee", "czn", "cze", "cne"]
    out = tr.map_arrays(components(spark, sf), ["event_id"], ["z", "n", "e"],
                        "window_start bigint, " + ", ".join(f"{c} double" for c in names), step)
    return out.select(big("event_id").alias("event_id"), "window_start", *[rnd(c, 9).alias(c) for c in names])


EIGEN_SQL = "WITH " + COMPONENT_SQL + ", " + WINDOW_SQL + """, c AS (
  SELECT event_id, st, avg(z) AS mz, avg(n) AS mn, avg(e) AS me,
         covar_samp(z, z) AS a, covar_samp(n, n) AS b, covar_samp(e, e) AS c,
         covar_samp(z, n) AS d, covar_samp(z, e) AS f, covar_samp(n, e) AS g
  FROM zne JOIN win ON ti >= st AND ti < st + 16 GROUP BY 1, 2), p AS (
  SELECT *, (a + b + c) / 3 AS q,
         sqrt((pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2) + pow(c - (a + b + c) / 3, 2)
               + 2 * (d * d + f * f + g * g)) / 6) AS p FROM c), l AS (
  SELECT *, acos(least(1, greatest(-1, ((a - q) * ((b - q) * (c - q) - g * g) - d * (d * (c - q) - g * f)
              + f * (d * g - (b - q) * f)) / (2 * p * p * p)))) / 3 AS phi FROM p), ev AS (
  SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM l), cr AS (
  SELECT *, 3 * q - l1 - l3 AS l2,
         d * g - f * (b - l1) AS x1, f * d - (a - l1) * g AS y1, (a - l1) * (b - l1) - d * d AS z1,
         d * (c - l1) - f * g AS x2, f * f - (a - l1) * (c - l1) AS y2, (a - l1) * g - d * f AS z2,
         (b - l1) * (c - l1) - g * g AS x3, g * f - d * (c - l1) AS y3, d * g - (b - l1) * f AS z3 FROM ev), nr AS (
  SELECT *, x1 * x1 + y1 * y1 + z1 * z1 AS n1, x2 * x2 + y2 * y2 + z2 * z2 AS n2, x3 * x3 + y3 * y3 + z3 * z3 AS n3
  FROM cr), ax AS (
  SELECT *, CASE WHEN n1 >= n2 AND n1 >= n3 THEN 1 WHEN n2 >= n3 THEN 2 ELSE 3 END AS w FROM nr), un AS (
  SELECT event_id, st, mz, mn, me, l1, l2, (l1 - l2) / (3 * q) AS dop,
         CASE w WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END / sqrt(greatest(n1, n2, n3)) AS vz,
         CASE w WHEN 1 THEN y1 WHEN 2 THEN y2 ELSE y3 END / sqrt(greatest(n1, n2, n3)) AS vn,
         CASE w WHEN 1 THEN z1 WHEN 2 THEN z2 ELSE z3 END / sqrt(greatest(n1, n2, n3)) AS ve FROM ax)"""


@registered("principal_axis_dop_filter", sql=EIGEN_SQL + """
SELECT event_id, ti, round(avg(dop * vz * (vz * (z - mz) + vn * (n - mn) + ve * (e - me))), 7) + 0.0 AS filtered
FROM zne JOIN un USING (event_id) WHERE ti >= st AND ti < st + 16 GROUP BY 1, 2""")
def principal_axis_dop_filter(spark, sf):
    f = tr.map_arrays(components(spark, sf), ["event_id"], ["z", "n", "e"], "filtered array<double>",
                      lambda z, n, e: (kernels.dop_filter(np.vstack([z, n, e]), SR, 16 / SR),))
    return long_out(f, "event_id", "filtered", digits=7)


@registered("montalbetti_kanasewich_filter", sql=EIGEN_SQL + """
SELECT event_id, ti, round(any_value(z) * avg((1 - l2 / l1) * vz * vz), 7) + 0.0 AS z,
       round(any_value(n) * avg((1 - l2 / l1) * vn * vn), 7) + 0.0 AS n,
       round(any_value(e) * avg((1 - l2 / l1) * ve * ve), 7) + 0.0 AS e
FROM zne JOIN un USING (event_id) WHERE ti >= st AND ti < st + 16 GROUP BY 1, 2""")
def montalbetti_kanasewich_filter(spark, sf):
    f = tr.map_arrays(
        components(spark, sf), ["event_id"], ["z", "n", "e"], "fz array<double>, fn array<double>, fe array<double>",
        lambda z, n, e: tuple(kernels.mk_filter(np.vstack([z, n, e]), SR, 16 / SR)))
    f = f.select("event_id", F.col("fz").alias("z"), F.col("fn").alias("n"), F.col("fe").alias("e"))
    return long_out(f, "event_id", "z", "n", "e", digits=7)


# Band-pass design in SQL from the corner frequencies: analog poles, bilinear transform, gain at the centre, then the
# impulse response of the four second-order sections, step by step. It shares nothing with the kernel's code.
DESIGN_SQL = """corner AS (
  SELECT band, 40.0::DOUBLE * tan(pi() * lo / 20) AS w1, 40.0::DOUBLE * tan(pi() * hi / 20) AS w2 FROM bands), half AS (
  SELECT band, w1, w2, sec, cos(pi() * (2 * sec + 3) / 8) * (w2 - w1) / 2 AS c, sin(pi() * (2 * sec + 3) / 8) * (w2 - w1) / 2 AS d
  FROM corner, range(1, 5) q(sec)), sq AS (
  SELECT *, c * c - d * d - w1 * w2 AS u, 2 * c * d AS v FROM half), rt AS (
  SELECT *, sqrt((sqrt(u * u + v * v) + u) / 2) AS ra, CASE WHEN v < 0 THEN -1 ELSE 1 END * sqrt((sqrt(u * u + v * v) - u) / 2) AS rb FROM sq), an AS (
  SELECT band, w1, w2, c + sg * ra AS x, d + sg * rb AS y FROM rt, (SELECT unnest([1, -1]) AS sg)), dg AS (
  SELECT band, w1, w2, ((40 + x) * (40 - x) - y * y) / ((40 - x) * (40 - x) + y * y) AS x,
         ((40 + x) * y + y * (40 - x)) / ((40 - x) * (40 - x) + y * y) AS y FROM an), gain AS (
  SELECT band, exp(sum(0.5::DOUBLE * ln(pow(cos(2 * atan(sqrt(w1 * w2) / 40)) - x, 2) + pow(sin(2 * atan(sqrt(w1 * w2) / 40)) - y, 2))))
         / pow(2 * sin(2 * atan(any_value(sqrt(w1 * w2)) / 40)), 4) AS g FROM dg GROUP BY band), sec AS (
  SELECT band, -2 * x AS a, x * x + y * y AS b, row_number() OVER (PARTITION BY band ORDER BY x) AS k FROM dg WHERE y > 0), par AS (
  SELECT band, max(a) FILTER (k = 1) AS a1, max(b) FILTER (k = 1) AS b1, max(a) FILTER (k = 2) AS a2, max(b) FILTER (k = 2) AS b2,
         max(a) FILTER (k = 3) AS a3, max(b) FILTER (k = 3) AS b3, max(a) FILTER (k = 4) AS a4, max(b) FILTER (k = 4) AS b4 FROM sec GROUP BY band), run AS (
  SELECT band, -1::BIGINT AS i, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS p1, 0.0::DOUBLE AS p2, 0.0::DOUBLE AS q1, 0.0::DOUBLE AS q2,
         0.0::DOUBLE AS r1, 0.0::DOUBLE AS r2, 0.0::DOUBLE AS s1, 0.0::DOUBLE AS s2 FROM par UNION ALL
  SELECT band, i, x0, x1, y1, p1, y2, q1, y3, r1, y3 - r2 - a4 * s1 - b4 * s2, s1 FROM (
    SELECT *, y2 - q2 - a3 * r1 - b3 * r2 AS y3 FROM (SELECT *, y1 - p2 - a2 * q1 - b2 * q2 AS y2 FROM (
      SELECT *, x0 - x2 - a1 * p1 - b1 * p2 AS y1 FROM (
        SELECT run.* EXCLUDE (i), i + 1 AS i, CASE WHEN i = -1 THEN g ELSE 0 END AS x0, par.* EXCLUDE (band) FROM run JOIN par USING (band) JOIN gain USING (band)
        WHERE i < 63)))) ), h AS (SELECT band, i AS k, s1 AS h FROM run WHERE i >= 0)"""

BANDPASS_SQL = "WITH RECURSIVE " + SAMPLES_SQL + ", bands(band, lo, hi) AS (VALUES (0, 0.2::DOUBLE, 0.8::DOUBLE)), " + DESIGN_SQL + """, f1 AS (
  SELECT s.event_id, s.ti + k AS ti, sum(s.x * h) AS y FROM samples s, h WHERE s.ti + k <= 63 GROUP BY 1, 2), f2 AS (
  SELECT event_id, ti - k AS ti, sum(y * h) AS y FROM f1, h WHERE ti - k >= 0 GROUP BY 1, 2)"""


@registered("bandpass_zero_phase", sql=BANDPASS_SQL + """
SELECT event_id, ti, round(y, 8) + 0.0 AS filtered FROM f2""")
def bandpass_zero_phase(spark, sf):
    f = tr.map_arrays(traces(spark, sf), ["event_id"], ["x"], "filtered array<double>",
                      lambda x: (kernels.bandpass(x[None, :], SR, 0.2, 0.8)[0],))
    return long_out(f, "event_id", "filtered", digits=8)


BANK_SQL = "WITH RECURSIVE " + COMPONENT_SQL.replace("zne AS", "raw AS") + """, bands AS (
  SELECT k AS band, pow(2.0::DOUBLE, k / 2.0::DOUBLE - 0.25::DOUBLE) AS lo, pow(2.0::DOUBLE, k / 2.0::DOUBLE + 0.25::DOUBLE) AS hi FROM range(-4, 7) b(k)), """ + DESIGN_SQL + """, f1 AS (
  SELECT event_id, band, ti + k AS ti, sum(z * h) AS z, sum(n * h) AS n, sum(e * h) AS e FROM raw, h WHERE ti + k <= 63 GROUP BY 1, 2, 3), zne AS (
  SELECT event_id * 16 + band + 4 AS event_id, ti - k AS ti, sum(z * h) AS z, sum(n * h) AS n, sum(e * h) AS e
  FROM f1 JOIN h USING (band) WHERE ti - k >= 0 GROUP BY 1, 2), """ + EIGEN_SQL.split(COMPONENT_SQL + ", ")[1] + """, vert AS (
  SELECT event_id, ti, any_value(z) * avg((1 - l2 / l1) * vz * vz) AS y FROM zne JOIN un USING (event_id) WHERE ti >= st AND ti < st + 16 GROUP BY 1, 2), hil AS (
  SELECT a.event_id, a.ti, sum(b.y / (32 * tan(pi() * (a.ti - b.ti) / 64))) AS q FROM vert a JOIN vert b ON b.event_id = a.event_id AND (a.ti - b.ti) % 2 <> 0
  GROUP BY 1, 2), env AS (SELECT event_id, ti, y, sqrt(y * y + q * q) AS e FROM vert JOIN hil USING (event_id, ti))
SELECT a.event_id // 16 AS event_id, a.event_id % 16 - 4 AS band, a.ti, round(any_value(a.y), 6) + 0.0 AS filtered, round(sum(b.e) / 5, 6) + 0.0 AS envelope
FROM env a JOIN env b ON b.event_id = a.event_id AND b.ti BETWEEN a.ti - 2 AND a.ti + 2 GROUP BY 1, 2, 3, a.event_id"""


@registered("filter_bank", sql=BANK_SQL)
def filter_bank(spark, sf):
    """The eleven half-octave bands around 0.25 to 8 Hz: band-pass, then polarisation weights, then smoothed envelope."""
    octave = 2.0**0.25

    def bands(z, n, e):
        zne, out = np.vstack([z, n, e]), []
        for k in range(-4, 7):
            centre = 2.0 ** (k / 2.0)
            y = kernels.mk_filter(np.vstack(kernels.bandpass(zne, SR, centre / octave, centre * octave)), SR, 16 / SR)[0]
            out.append((k, y, np.convolve(kernels.analytic_abs(y), np.full(5, 0.2), mode="same")))
        return out

    # One Python step, so that a core has one Python worker and not three.
    v = tr.map_arrays(components(spark, sf), ["event_id"], ["z", "n", "e"], "band bigint, filtered array<double>, envelope array<double>", bands,
                      tasks=HEAVY_TASKS)
    flat = v.select(big("event_id").alias("event_id"), "band", F.posexplode(F.arrays_zip("filtered", "envelope")).alias("ti", "c"))
    return flat.select("event_id", "band", big("ti").alias("ti"), *(rnd(f"c.{c}", 6).alias(c) for c in ("filtered", "envelope")))


FDPA_SQL = "WITH " + COMPONENT_SQL + """, fr AS (
  SELECT k, 0.2::DOUBLE * pow(4.0::DOUBLE, k / 12.0::DOUBLE) AS f FROM range(13) r(k)), par AS (
  SELECT k, f, round_even(f / 0.0625::DOUBLE, 0)::BIGINT AS shift, least(64, greatest(2, round_even(12.0::DOUBLE / f, 0)))::BIGINT AS win FROM fr), hop AS (
  SELECT *, greatest(1, round_even(win * (1.0::DOUBLE - 0.9::DOUBLE), 0))::BIGINT AS hop FROM par), wins AS (
  SELECT DISTINCT k, win, unnest(list_append(range(0, 65 - win, hop), 64 - win)) AS st FROM hop), wave AS (
  SELECT m, cos(2 * pi() * m / 64) AS c, sin(2 * pi() * m / 64) AS s FROM range(64) w(m)), ft AS (
  SELECT event_id, j, sum(z * c) AS zr, -sum(z * s) AS zi, sum(n * c) AS nr, -sum(n * s) AS ni, sum(e * c) AS er, -sum(e * s) AS ei
  FROM zne CROSS JOIN range(64) q(j) JOIN wave ON m = (j * ti) % 64 GROUP BY 1, 2), gf AS (
  SELECT event_id, k, (j - shift + 64) % 64 AS i, exp(-2 * pow(pi() * (CASE WHEN (j - shift + 64) % 64 < 32 THEN (j - shift + 64) % 64
    ELSE (j - shift + 64) % 64 - 64 END) * 0.0625::DOUBLE / f, 2)) / 64 AS g, zr, zi, nr, ni, er, ei FROM ft, par), sh AS (
  SELECT event_id, k, t, sum(g * (zr * c - zi * s)) AS zr, sum(g * (zr * s + zi * c)) AS zi, sum(g * (nr * c - ni * s)) AS nr,
         sum(g * (nr * s + ni * c)) AS ni, sum(g * (er * c - ei * s)) AS er, sum(g * (er * s + ei * c)) AS ei
  FROM gf CROSS JOIN range(64) q(t) JOIN wave ON m = (i * t) % 64 GROUP BY 1, 2, 3), cv AS (
  SELECT event_id, k, st, any_value(win) AS win, avg(zr * zr + zi * zi) AS a, avg(nr * nr + ni * ni) AS b, avg(er * er + ei * ei) AS c,
         avg(zr * nr + zi * ni) AS dr, avg(zi * nr - zr * ni) AS di, avg(zr * er + zi * ei) AS fr, avg(zi * er - zr * ei) AS fi,
         avg(nr * er + ni * ei) AS gr, avg(ni * er - nr * ei) AS gi
  FROM sh JOIN wins USING (k) WHERE t >= st AND t < st + win GROUP BY 1, 2, 3), ev AS (
  SELECT *, (a + b + c) / 3 AS q, sqrt((pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2) + pow(c - (a + b + c) / 3, 2)
    + 2 * (dr * dr + di * di + fr * fr + fi * fi + gr * gr + gi * gi)) / 6) AS p FROM cv), ph AS (
  SELECT *, acos(least(1, greatest(-1, ((a - q) * (b - q) * (c - q) + 2 * ((dr * gr - di * gi) * fr + (dr * gi + di * gr) * fi) - (a - q) * (gr * gr + gi * gi)
    - (b - q) * (fr * fr + fi * fi) - (c - q) * (dr * dr + di * di)) / (2 * p * p * p)))) / 3 AS phi FROM ev), la AS (
  SELECT *, q + 2 * p * cos(phi) AS l1, greatest(0, q + 2 * p * cos(phi + 2 * pi() / 3)) AS l3, greatest(0, 3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * pi() / 3))) AS l2
  FROM ph), m AS (SELECT *, a - l1 AS x, b - l1 AS y, c - l1 AS w FROM la), cr AS (
  SELECT *, dr * gr - di * gi - fr * y AS z1r, dr * gi + di * gr - fi * y AS z1i, fr * dr + fi * di - x * gr AS n1r, fi * dr - fr * di - x * gi AS n1i,
         x * y - dr * dr - di * di AS e1r, 0.0::DOUBLE AS e1i,
         dr * w - (fr * gr + fi * gi) AS z2r, di * w - (fi * gr - fr * gi) AS z2i, fr * fr + fi * fi - x * w AS n2r, 0.0::DOUBLE AS n2i,
         x * gr - (dr * fr + di * fi) AS e2r, -x * gi - (di * fr - dr * fi) AS e2i,
         y * w - gr * gr - gi * gi AS z3r, 0.0::DOUBLE AS z3i, gr * fr + gi * fi - dr * w AS n3r, gi * fr - gr * fi + di * w AS n3i,
         dr * gr - di * gi - y * fr AS e3r, -dr * gi - di * gr + y * fi AS e3i FROM m), nm AS (
  SELECT *, z1r * z1r + z1i * z1i + n1r * n1r + n1i * n1i + e1r * e1r AS s1, z2r * z2r + z2i * z2i + n2r * n2r + e2r * e2r + e2i * e2i AS s2,
         z3r * z3r + n3r * n3r + n3i * n3i + e3r * e3r + e3i * e3i AS s3 FROM cr), pk AS (
  SELECT event_id, k, st, win, (l1 - l2) / (l1 + l2 + l3) AS dop, greatest(s1, s2, s3) AS size, CASE WHEN s1 >= s2 AND s1 >= s3 THEN 1 WHEN s2 >= s3 THEN 2 ELSE 3 END AS c,
         z1r, z1i, n1r, n1i, e1r, e1i, z2r, z2i, n2r, n2i, e2r, e2i, z3r, z3i, n3r, n3i, e3r, e3i FROM nm), vc AS (
  SELECT event_id, k, st, win, dop, size, """ + ", ".join(
    f"CASE c WHEN 1 THEN {v}1{part} WHEN 2 THEN {v}2{part} ELSE {v}3{part} END AS {v}{part}" for v in "zne" for part in "ri") + """ FROM pk), ax AS (
  SELECT *, sqrt(zr * zr + zi * zi) AS zz, (nr * zr + ni * zi) / sqrt(zr * zr + zi * zi) AS nn, (er * zr + ei * zi) / sqrt(zr * zr + zi * zi) AS ee,
         (zr * zr + zi * zi) / size AS vert FROM vc), un AS (
  SELECT event_id, k, st, win, dop, vert, atan2(ee, nn) AS az, degrees(atan2(zz, sqrt(nn * nn + ee * ee))) AS inc FROM ax), cov AS (
  SELECT event_id, k, t, avg(dop) AS dop, degrees(atan2(avg(sin(az)), avg(cos(az)))) AS az, avg(inc) AS inc, avg(dop * vert) - avg(dop * (1 - vert)) AS d
  FROM un JOIN range(64) q(t) ON t >= st AND t < st + win GROUP BY 1, 2, 3)
SELECT event_id, k::BIGINT AS band, t::BIGINT AS ti, round(dop, 6) + 0.0 AS dop, round(az + CASE WHEN az < 0 THEN 360 ELSE 0 END, 3) % 360 + 0.0 AS azimuth_deg,
       round(inc, 4) + 0.0 AS inclination_deg, round(d, 6) + 0.0 AS vrm_minus_hrm,
       round(CASE WHEN dop >= 0.6 THEN sqrt(zr * zr + zi * zi) ELSE 0 END, 6) + 0.0 AS masked_vertical
FROM cov JOIN sh USING (event_id, k, t)"""


@registered("frequency_dependent_polarization", sql=FDPA_SQL)
def frequency_dependent_polarization(spark, sf):
    """The thirteen registered bands: band signals, windows of three cycles, means over the windows that cover a sample."""
    records = components(spark, sf).where(F.col("event_id").isNotNull()).repartition(HEAVY_TASKS, "event_id")
    records = records.withColumn("records", F.count("*").over(Window.partitionBy("event_id")))

    def bands(some):
        return tr.band_signals(some, ["event_id"], ["z", "n", "e"], FDPA_SR, np.geomspace(0.2, 0.8, 13))

    # An event of one record has its means where the record lies; only records that share an event are brought together
    # again. They are dealt anew, as there are few or none: an empty step would still start Python in every task.
    alone, shared = bands(records.where("records = 1")), bands(records.where("records > 1").repartition("event_id", "z"))
    p = tr.covered_means(tr.window_polarizations(alone, ["event_id"], FDPA_SR, along=["level"]), ["event_id"], alone=True, along=["level"])
    means = tr.covered_means(tr.window_polarizations(shared, ["event_id"], FDPA_SR), ["event_id"])
    level = shared.select("event_id", "band", F.posexplode("level").alias("ti", "level"))
    # Sizes behind a NumPy step are guesses: one row per sample is never broadcast on their word.
    p = p.unionByName(means.join(level.hint("merge"), ["event_id", "band", "ti"]))
    return p.select(
        big("event_id").alias("event_id"), big("band").alias("band"), big("ti").alias("ti"), rnd_fast("dop", 6).alias("dop"),
        (rnd_fast("azimuth_deg", 3) % 360 + F.lit(0.0)).alias("azimuth_deg"), rnd_fast("inclination_deg", 4).alias("inclination_deg"),
        rnd_fast(F.col("vrm") - F.col("hrm"), 6).alias("vrm_minus_hrm"), rnd_fast(F.when(F.col("dop") >= 0.6, F.col("level")).otherwise(0.0), 6).alias("masked_vertical"))


@registered("lanczos_resample", sql="WITH " + SAMPLES_SQL + """, pos AS (
  SELECT k, k * (4.0::DOUBLE / 3.0::DOUBLE) AS p FROM range(48) r(k))
SELECT event_id, k::BIGINT AS ti, round(sum(x * CASE WHEN abs(p - s.ti) < 1e-12 THEN 1
   ELSE sin(pi() * (p - s.ti)) / (pi() * (p - s.ti)) * sin(pi() * (p - s.ti) / 20) / (pi() * (p - s.ti) / 20) END), 8)
   + 0.0 AS resampled
FROM samples s, pos WHERE abs(p - s.ti) < 20 GROUP BY 1, 2""")
def lanczos_resample(spark, sf):
    f = tr.map_arrays(traces(spark, sf), ["event_id"], ["x"], "resampled array<double>",
                      lambda x: (kernels.lanczos(x, 4.0 / 3.0),))
    return long_out(f, "event_id", "resampled", digits=8)


@registered("gaussian_projection_fit")
def gaussian_projection_fit(spark, sf):
    """Gaussian plus offset fitted to each trace's squared amplitude over its axis."""
    def fit(xs):
        y = np.vstack(xs) ** 2
        found = kernels.gaussian_fit(np.arange(y.shape[1], dtype=float), y)
        return list(zip(*found, np.count_nonzero(y, axis=1)))

    return tr.map_arrays(traces(spark, sf), ["event_id"], ["x"],
                         "mean double, sigma double, converged boolean, residual_rms double, nonzero_bins int", fit,
                         tasks=HEAVY_TASKS, batch=True)


ROTATION_SQL = "sensor(az1, az2, az3, d) AS (VALUES (" + ", ".join(
    f"radians({v}::DOUBLE)" for v in (*dims.SENSOR_AZIMUTH_DEG, dims.SENSOR_DIP_DEG)) + """)), fw AS (
  SELECT -sin(d) AS s, cos(d) * cos(az1) AS b1, cos(d) * sin(az1) AS c1, cos(d) * cos(az2) AS b2, cos(d) * sin(az2) AS c2,
         cos(d) * cos(az3) AS b3, cos(d) * sin(az3) AS c3 FROM sensor), inv AS (
  SELECT *, s * (b2 * c3 - c2 * b3) - b1 * (s * c3 - c2 * s) + c1 * (s * b3 - b2 * s) AS det FROM fw)"""


@registered("rotate_oblique_to_zne", sql="WITH " + COMPONENT_SQL + ", " + ROTATION_SQL + """
SELECT event_id, ti, round((z * (b2 * c3 - c2 * b3) + n * (c1 * b3 - b1 * c3) + e * (b1 * c2 - c1 * b2)) / det, 9) + 0.0 AS z,
       round((z * (c2 * s - s * c3) + n * (s * c3 - c1 * s) + e * (c1 * s - s * c2)) / det, 9) + 0.0 AS n,
       round((z * (s * b3 - b2 * s) + n * (b1 * s - s * b3) + e * (s * b2 - b1 * s)) / det, 9) + 0.0 AS e
FROM zne CROSS JOIN inv""")
def rotate_oblique_to_zne(spark, sf):
    c = components(spark, sf)
    r = tr.rotate(F.col("z"), F.col("n"), F.col("e"))
    return long_out(c.select("event_id", *[v.alias(k) for k, v in r.items()]), "event_id", "z", "n", "e")


@registered("rms_glitch_flags", sql="WITH " + SAMPLES_SQL + """, b AS (
  SELECT event_id, ti // 4 AS b, sqrt(avg(x * x)) AS r FROM samples GROUP BY 1, 2), m AS (
  SELECT event_id, median(r) AS med FROM b GROUP BY 1)
SELECT event_id, b * 4 / 4.0::DOUBLE AS start_s, (b + 1) * 4 / 4.0::DOUBLE AS end_s, round(r / med, 9) AS rms_ratio
FROM b JOIN m USING (event_id) WHERE med > 0 AND r / med > 1.5""")
def rms_glitch_flags(spark, sf):
    g = tr.glitch_flags(traces(spark, sf), ["event_id"], 4.0, 1.5)
    return g.select(big("event_id").alias("event_id"), "start_s", "end_s", rnd("rms_ratio", 9).alias("rms_ratio"))


@registered("raw_trace_qc", sql="WITH " + SAMPLES_SQL.replace("unnest(embedding)::DOUBLE AS x",
    "round(unnest(embedding)::DOUBLE * CASE WHEN vec_id % 3 = 0 THEN 0.5 WHEN vec_id % 3 = 1 THEN 4 ELSE 900 END, 0) "
    "AS x") + """, v AS (
  SELECT *, x - lag(x) OVER (PARTITION BY event_id ORDER BY ti) AS d,
         min(x) OVER (PARTITION BY event_id) AS lo, max(x) OVER (PARTITION BY event_id) AS hi
  FROM samples WHERE valid), a AS (
  SELECT event_id, 1 - count(*) / 64.0::DOUBLE AS missing_frac, avg(CASE WHEN d = 0 THEN 1.0::DOUBLE WHEN d IS NOT NULL
         THEN 0.0::DOUBLE END) AS flatline_frac, any_value(hi - lo) AS p2p,
         avg(CASE WHEN x = lo THEN 1.0::DOUBLE ELSE 0 END) + avg(CASE WHEN x = hi THEN 1.0::DOUBLE ELSE 0 END) AS clip_frac
  FROM v GROUP BY event_id), r AS (
  SELECT *, CASE WHEN p2p = 0 THEN 'flatline_or_empty' WHEN missing_frac > 0.11 THEN 'coverage'
     WHEN flatline_frac >= 0.5 THEN 'flatline' WHEN clip_frac > 0.03 AND p2p >= 100 THEN 'clipping' ELSE '' END AS reason
  FROM a)
SELECT event_id, round(missing_frac, 6) AS missing_frac, round(flatline_frac, 6) AS flatline_frac, p2p,
       round(clip_frac, 6) AS clip_frac, reason, CASE WHEN reason = '' THEN 'ok' ELSE 'excluded' END AS qc FROM r""")
def raw_trace_qc(spark, sf):
    k = F.pmod("event_id", F.lit(3))
    scale = F.when(k == 0, 0.5).when(k == 1, 4.0).otherwise(900.0)
    t = traces(spark, sf).withColumn("x", F.transform("x", lambda v: F.round(v * scale, 0) + F.lit(0.0)))
    q = tr.qc_verdict(t, max_missing=0.11, flat=0.5, clip=0.03)
    return q.select(
        big("event_id").alias("event_id"), rnd("missing_frac").alias("missing_frac"),
        rnd("flatline_frac").alias("flatline_frac"), rnd("p2p").alias("p2p"), rnd("clip_frac").alias("clip_frac"),
        "reason", "qc")


@registered("mean_absolute_amplitude", sql="WITH " + SAMPLES_SQL + """, a AS (
  SELECT lane, ti, avg(abs(x)) AS m FROM samples WHERE valid GROUP BY 1, 2)
SELECT lane::BIGINT AS lane, ti, round(m, 9) AS mean_abs,
       round(quantile_cont(m, 0.95::DOUBLE) OVER (PARTITION BY lane), 9) AS p95 FROM a""")
def mean_absolute_amplitude(spark, sf):
    t = traces(spark, sf).select("lane", F.posexplode(F.arrays_zip("x", "valid")).alias("ti", "c")).where("c.valid")
    m = t.groupBy("lane", "ti").agg(F.avg(F.abs("c.x")).alias("m"))
    p = m.groupBy("lane").agg(F.percentile("m", F.lit(0.95)).alias("p95"))
    return m.join(p, "lane").select(
        big("lane").alias("lane"), big("ti").alias("ti"), rnd("m", 9).alias("mean_abs"), rnd("p95", 9).alias("p95"))


@registered("relative_l2_difference", sql="WITH " + COMPONENT_SQL + """
SELECT event_id, round(sqrt(sum((z - n) * (z - n))) / sqrt(sum(z * z)), 9) AS rel_l2,
       round(sqrt(avg((z - n) * (z - n))) / sqrt(avg((z - e) * (z - e))), 9) AS noise_ratio,
       CASE WHEN sqrt(avg((z - n) * (z - n))) / sqrt(avg((z - e) * (z - e))) < 0.9 THEN 'port_noise'
            WHEN sqrt(avg((z - n) * (z - n))) / sqrt(avg((z - e) * (z - e))) <= 1.1 THEN 'comparable'
            ELSE 'divergent' END AS noise_class FROM zne GROUP BY 1""")
def relative_l2_difference(spark, sf):
    c = components(spark, sf)
    ss = lambda col: F.aggregate(col, F.lit(0.0), lambda a, v: a + v * v)
    d = lambda p, q: F.zip_with(p, q, lambda a, b: a - b)
    r = c.select("event_id", ss(F.col("z")).alias("zz"), ss(d("z", "n")).alias("dn"), ss(d("z", "e")).alias("de"))
    ratio = F.sqrt(F.col("dn") / 64) / F.sqrt(F.col("de") / 64)
    return r.select(
        big("event_id").alias("event_id"), rnd(F.sqrt("dn") / F.sqrt("zz"), 9).alias("rel_l2"),
        rnd(ratio, 9).alias("noise_ratio"),
        F.when(ratio < 0.9, "port_noise").when(ratio <= 1.1, "comparable").otherwise("divergent").alias("noise_class"))


@registered("exact_stream_comparison", sql="WITH " + COMPONENT_SQL + """, a AS (SELECT event_id, ti, z AS v FROM zne),
b AS (SELECT event_id, ti, CASE WHEN event_id % 4 = 0 AND ti = 9 THEN v + 1 ELSE v END AS v FROM a
      WHERE NOT (event_id % 9 = 0 AND ti > 60))
SELECT coalesce(a.event_id, b.event_id) AS event_id, count(*) FILTER (a.v IS DISTINCT FROM b.v) AS mismatches,
       bool_and(a.v IS NOT DISTINCT FROM b.v) AS identical
FROM a FULL JOIN b ON a.event_id = b.event_id AND a.ti = b.ti GROUP BY 1""")
def exact_stream_comparison(spark, sf):
    a = traces(spark, sf).select("event_id", "x")
    other = F.transform("x", lambda v, i: F.when((F.pmod("event_id", F.lit(4)) == 0) & (i == 9), v + 1).otherwise(v))
    b = a.select("event_id", other.alias("y"))
    keep = F.when(F.pmod("event_id", F.lit(9)) == 0, F.lit(61)).otherwise(F.size("y"))
    b = b.select("event_id", F.slice("y", F.lit(1), keep).alias("y"))
    same = F.zip_with("x", "y", lambda p, q: p.eqNullSafe(q))
    j = a.join(b, "event_id", "full")
    return j.select(
        big("event_id").alias("event_id"), big(F.size(F.filter(same, lambda m: ~m))).alias("mismatches"),
        F.forall(same, lambda m: m).alias("identical"))


@registered("circular_mean_direction", sql="""SELECT user_id, event_type,
  CASE WHEN abs(avg(sin(radians(value)))) > 1e-12 OR abs(avg(cos(radians(value)))) > 1e-12 THEN
    round((degrees(atan2(avg(sin(radians(value))), avg(cos(radians(value))))) + 360) % 360, 6) END AS mean_deg,
  count(*) AS n FROM events GROUP BY 1, 2""")
def circular_mean_direction(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id", "event_type").agg(
        rnd(tr.circular_mean(F.col("value"), 1e-12)).alias("mean_deg"), F.count("*").alias("n"))


@registered("great_circle_distance", sql="""WITH p AS (
  SELECT event_id, (value * 7 + user_id) % 180 - 90 AS lat, (value * 13 + event_id) % 360 - 180 AS lon FROM events)
SELECT event_id, round(degrees(2 * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(4.5 - lat) / 2), 2) + cos(radians(lat))
  * cos(radians(4.5)) * pow(sin(radians(135.6 - lon) / 2), 2))))), 6) AS distance_deg FROM p""")
def great_circle_distance(spark, sf):
    lat = F.pmod(F.col("value") * 7 + F.col("user_id"), F.lit(180.0)) - 90
    lon = F.pmod(F.col("value") * 13 + F.col("event_id"), F.lit(360.0)) - 180
    return table(spark, sf, "events").select(
        "event_id", rnd(tr.great_circle_deg(lat, lon, F.lit(4.5), F.lit(135.6))).alias("distance_deg"))


@registered("channel_alignment_check", sql="""SELECT l_orderkey,
  count(*) AS channels, min(l_tax) = max(l_tax) AS same_rate, min(l_linestatus) = max(l_linestatus) AS same_length,
  date_diff('day', min(l_shipdate), max(l_shipdate))::BIGINT AS start_spread,
  CASE WHEN min(l_tax) <> max(l_tax) THEN 'mismatched_sampling_rate' WHEN min(l_linestatus) <> max(l_linestatus)
       THEN 'mismatched_length' WHEN date_diff('day', min(l_shipdate), max(l_shipdate)) >= 400 THEN 'misaligned_start'
       ELSE 'ok' END AS status FROM lineitem GROUP BY 1""")
def channel_alignment_check(spark, sf):
    spread = F.date_diff(F.max("l_shipdate"), F.min("l_shipdate"))
    rate = F.min("l_tax") == F.max("l_tax")
    length = F.min("l_linestatus") == F.max("l_linestatus")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("channels"), rate.alias("same_rate"), length.alias("same_length"),
        big(spread).alias("start_spread"),
        F.when(~rate, "mismatched_sampling_rate").when(~length, "mismatched_length")
        .when(spread >= 400, "misaligned_start").otherwise("ok").alias("status"))


@registered("axis_validation", sql="""WITH t AS (
  SELECT vec_id AS event_id, (generate_subscripts(embedding, 1) - 1) AS ti, unnest(embedding)::DOUBLE AS x
  FROM embeddings), a AS (
  SELECT event_id, x + ti * (CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END) AS v,
         v - lag(v) OVER (PARTITION BY event_id ORDER BY ti) AS d FROM t)
SELECT event_id, count(*) AS length, bool_and(isfinite(v)) AS finite, bool_and(d > 0) AS strictly_ascending
FROM a GROUP BY 1""")
def axis_validation(spark, sf):
    k = F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit(1.0)).otherwise(F.lit(0.1))
    t = traces(spark, sf).select("event_id", F.transform("x", lambda v, i: v + i * k).alias("a"))
    steps = F.zip_with(F.slice("a", F.lit(2), F.size("a") - 1), F.slice("a", F.lit(1), F.size("a") - 1),
                       lambda b, a: b > a)
    finite = F.forall("a", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return t.select(big("event_id").alias("event_id"), big(F.size("a")).alias("length"), finite.alias("finite"),
                    F.forall(steps, lambda s: s).alias("strictly_ascending"))


@registered("stack_input_validation", sql="""SELECT label::BIGINT AS lane, count(*) AS traces,
  count(DISTINCT len(embedding))::BIGINT AS lengths,
  CASE WHEN count(*) < 1 THEN 'no_traces' WHEN count(DISTINCT len(embedding)) > 1 THEN 'unequal_lengths'
       ELSE 'ok' END AS status FROM embeddings GROUP BY 1""")
def stack_input_validation(spark, sf):
    t = table(spark, sf, "embeddings").select("label", F.size("embedding").alias("n"),
                                              F.size(valid_mask()).alias("m"))
    lengths = F.when(F.min("n") == F.max("n"), F.lit(1)).otherwise(F.size(F.collect_set("n")))
    return t.groupBy(big("label").alias("lane")).agg(
        F.count("*").alias("traces"), big(lengths).alias("lengths"),
        F.when(F.max(F.abs(F.col("n") - F.col("m"))) > 0, "mask_shape_mismatch")
        .when(lengths > 1, "unequal_lengths").otherwise("ok").alias("status"))
