"""Layered-model queries: every supplier owns one model, its layers are the parts it ships."""

from __future__ import annotations

from pyspark.sql import functions as F

from beamspark.operators import model
from beamspark.plans.registry import big, registered, rnd, table

LAYER_SQL = """lay AS (SELECT l_suppkey AS m, l_partkey AS ord, 50 + (l_partkey % 97) * 20.0::DOUBLE AS depth,
  avg(l_quantity) / 10 + 4 AS vp, CASE WHEN l_partkey % 97 > 60 THEN 0 ELSE (avg(l_quantity) / 10 + 4) / sqrt(3) END AS vs,
  avg(l_tax) * 10 + 3 AS rho FROM lineitem GROUP BY 1, 2)"""


def layers(spark, sf):
    k = F.col("l_partkey") % 97
    li = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("m"), F.col("l_partkey").alias("ord")).agg(
        F.avg("l_quantity").alias("q"), F.avg("l_tax").alias("x"))
    k = F.col("ord") % 97
    vp = F.col("q") / 10 + 4
    return li.select("m", "ord", (F.lit(50) + k * F.lit(20.0)).alias("depth"), vp.alias("vp"),
                     F.when(k > 60, 0.0).otherwise(vp / F.sqrt(F.lit(3.0))).alias("vs"), (F.col("x") * 10 + 3).alias("rho"))


@registered("layered_model_sections", sql="WITH " + LAYER_SQL + """, s AS (
  SELECT m, ord, CASE WHEN ord >= 1800 THEN 'inner-core' WHEN ord >= 1000 THEN 'outer-core' ELSE 'mantle' END AS section,
         round(depth, 4) AS depth, round(vp, 4) AS vp, round(vs, 4) AS vs FROM lay)
SELECT m, section, count(*) AS rows_in_section, round(sum(depth), 4) AS depth_sum, round(max(vp), 4) AS max_vp FROM s GROUP BY 1, 2""")
def layered_model_sections(spark, sf):
    """Models written as sectioned text lines and parsed back."""
    lay = layers(spark, sf)
    row = lay.select("m", F.col("ord").cast("double").alias("pos"), model.format_rows(*[F.col(c) for c in ("depth", "vp", "vs", "rho")]).alias("value"))
    marks = lay.select("m").distinct().select("m", F.inline(F.array(
        F.struct(F.lit(999.5).alias("pos"), F.lit("outer-core").alias("value")),
        F.struct(F.lit(1799.5).alias("pos"), F.lit(" inner-core ").alias("value")))))
    s = model.sections(row.unionByName(marks), "m", "pos", "value")
    return s.groupBy("m", "section").agg(F.count("*").alias("rows_in_section"), rnd(F.sum("depth"), 4).alias("depth_sum"),
                                         rnd(F.max("vp"), 4).alias("max_vp"))


@registered("layered_model_text", sql="WITH " + LAYER_SQL + """
SELECT m, ord, printf('%.4f %.4f %.4f %.4f', depth, vp::DOUBLE, vs::DOUBLE, rho::DOUBLE) AS line FROM lay""")
def layered_model_text(spark, sf):
    return layers(spark, sf).select("m", "ord", model.format_rows(*[F.col(c) for c in ("depth", "vp", "vs", "rho")]).alias("line"))


@registered("cosh_profile", sql="""WITH p AS (SELECT p_partkey, 1500.0::DOUBLE AS d1, 2.5::DOUBLE + p_size / 100.0::DOUBLE AS v1, 2800.0::DOUBLE AS d2,
   CASE WHEN p_size % 10 = 0 THEN 2.5::DOUBLE + p_size / 100.0::DOUBLE ELSE 1.5::DOUBLE + p_retailprice / 2000.0::DOUBLE END AS v2 FROM part), k AS (
  SELECT *, CASE WHEN v1 <> v2 THEN (d2 - d1) / (cosh(v2) - cosh(v1)) END AS kk FROM p), n AS (
  SELECT p_partkey, i::BIGINT AS node, CASE WHEN v1 = v2 THEN d1 + (d2 - d1) * (i / 14.0::DOUBLE)
    ELSE kk * cosh(v1 + (v2 - v1) * (i / 14.0::DOUBLE)) + (d1 - kk * cosh(v1)) END AS depth, v1 + (v2 - v1) * (i / 14.0::DOUBLE) AS v FROM k, range(15) r(i))
SELECT p_partkey, node, round(depth, 5) + 0.0 AS depth, round(v, 6) AS v FROM n""")
def cosh_profile(spark, sf):
    v1 = F.lit(2.5) + F.col("p_size") / F.lit(100.0)
    v2 = F.when(F.col("p_size") % 10 == 0, v1).otherwise(F.lit(1.5) + F.col("p_retailprice") / F.lit(2000.0))
    n = model.cosh_profile(F.lit(1500.0), v1, F.lit(2800.0), v2, 15)
    p = table(spark, sf, "part").select("p_partkey", F.inline(n))
    return p.select("p_partkey", big("node").alias("node"), rnd("depth", 5).alias("depth"), rnd("v").alias("v"))


@registered("profile_interpolation", sql="""WITH t AS (SELECT event_id, value, [0.0, 10.0, 25.0, 60.0, 150.0]::DOUBLE[] AS xs, [8.0, 7.5, 6.25, 5.0, 4.0]::DOUBLE[] AS ys FROM events), i AS (
  SELECT *, greatest(1, least(4, len(list_filter(xs, lambda v: v <= value)))) AS i FROM t)
SELECT event_id, round(CASE WHEN value <= 0 THEN 8.0 WHEN value >= 150 THEN 4.0 ELSE ys[i] + (ys[i + 1] - ys[i]) * (value - xs[i]) / (xs[i + 1] - xs[i]) END, 6)::DOUBLE AS velocity FROM i""")
def profile_interpolation(spark, sf):
    arr = lambda v: F.array(*[F.lit(float(x)) for x in v])
    v = model.interpolate(F.col("value"), arr((0, 10, 25, 60, 150)), arr((8, 7.5, 6.25, 5, 4)))
    return table(spark, sf, "events").select("event_id", rnd(v).alias("velocity"))


@registered("model_profile_checks", sql="WITH " + LAYER_SQL + """, d AS (SELECT m, ord, depth, vp, vs, ord >= 1000 AND ord < 1800 AS oc,
   depth - lag(depth) OVER (PARTITION BY m ORDER BY ord) AS step FROM lay)
SELECT m, bool_and(coalesce(step >= 0, true)) AS depth_monotone, bool_and(NOT oc OR vs = 0) AS outer_core_fluid, bool_and(vs < vp) AS vs_below_vp
FROM d GROUP BY 1""")
def model_profile_checks(spark, sf):
    sec = F.when(F.col("ord") >= 1800, "inner-core").when(F.col("ord") >= 1000, "outer-core").otherwise("mantle")
    return model.profile_checks(layers(spark, sf).withColumn("section", sec), "m")


@registered("radius_scaled_models", sql="WITH " + LAYER_SQL + """, r AS (SELECT m, ord, 3389.5::DOUBLE - depth AS r, 1500.0::DOUBLE AS a, 1400.0::DOUBLE + m % 50 * 10 AS b FROM lay)
SELECT m, ord, round(3389.5::DOUBLE - CASE WHEN r <= a THEN r * b / a ELSE b + (r - a) * (3389.5::DOUBLE - b) / (3389.5::DOUBLE - a) END, 6) + 0.0 AS new_depth FROM r""")
def radius_scaled_models(spark, sf):
    new = F.lit(1400.0) + F.col("m") % 50 * 10
    s = model.rescale_radius(layers(spark, sf), "m", F.lit(1500.0), new, model.RADIUS_KM)
    return s.select("m", "ord", rnd("new_depth").alias("new_depth"))


@registered("percentile_model_picks", sql="WITH " + LAYER_SQL + """, s AS (SELECT m, m % 4 AS family, round(avg(vp), 6) AS mean_vp FROM lay WHERE depth BETWEEN 1550 AND 1800 GROUP BY m), r AS (
  SELECT *, row_number() OVER (PARTITION BY family ORDER BY mean_vp, m) - 1 AS rn, count(*) OVER (PARTITION BY family) AS n FROM s)
SELECT family, percent, m, mean_vp FROM r JOIN (SELECT unnest([2.5, 50.0, 97.5])::DOUBLE AS percent) ON rn = round_even((n - 1) * (percent / 100.0::DOUBLE), 0)""")
def percentile_model_picks(spark, sf):
    s = layers(spark, sf).where(F.col("depth").between(1550, 1800)).groupBy("m").agg(rnd(F.avg("vp")).alias("mean_vp"))
    s = s.withColumn("family", F.col("m") % 4)
    return model.rank_picks(s, ["family"], "mean_vp", "m", [2.5, 50.0, 97.5])


@registered("radius_misfit", sql="""WITH o AS (SELECT o_custkey, avg(o_totalprice) / 1000 AS obs, count(*) AS n FROM orders GROUP BY 1), g AS (
  SELECT o_custkey, 100.0::DOUBLE + i * 10 AS radius, (100.0::DOUBLE + i * 10) * 0.9::DOUBLE + i * i * 0.05::DOUBLE AS pred, obs, n FROM o, range(21) r(i)), f AS (
  SELECT o_custkey, radius, abs(obs - pred) * sqrt(n) AS misfit,
         (lead(pred) OVER w - lag(pred) OVER w) / (lead(radius) OVER w - lag(radius) OVER w) AS slope FROM g WINDOW w AS (PARTITION BY o_custkey ORDER BY radius))
SELECT o_custkey, arg_min(radius, (misfit, radius)) AS best_radius, round(min(misfit) * 1.0001234567::DOUBLE, 6) AS misfit,
  round(max(slope) FILTER (slope IS NOT NULL AND radius = b), 6) AS slope
FROM f JOIN (SELECT o_custkey, arg_min(radius, (misfit, radius)) AS b FROM f GROUP BY 1) USING (o_custkey) GROUP BY 1""")
def radius_misfit(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg((F.avg("o_totalprice") / 1000).alias("obs"), F.count("*").alias("n"))
    g = o.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(20))))
    g = g.withColumn("radius", F.lit(100.0) + F.col("i") * 10)
    g = g.withColumn("pred", F.col("radius") * 0.9 + F.col("i") * F.col("i") * F.lit(0.05))
    g = g.withColumn("misfit", F.abs(F.col("obs") - F.col("pred")) * F.sqrt("n"))
    b = model.best_radius(g, ["o_custkey"], "radius", "misfit")
    return b.select("o_custkey", "best_radius", rnd(F.col("misfit") * F.lit(1.0001234567)).alias("misfit"), rnd("slope").alias("slope"))


MODEL_TASKS = 64  # tasks that generated models are dealt over

# (depth, vp, vs, rho) rows of the base model that the generated cores replace.
BASE = {
    "mantle": [(0.0, 5.0, 2.9, 2.9), (50.0, 7.5, 4.2, 3.4), (1000.0, 9.0, 4.9, 3.7), (1700.0, 9.8, 5.3, 4.1)],
    "outer-core": [(1700.0, 4.9, 0.0, 5.9), (2700.0, 5.6, 0.0, 6.3)],
    "inner-core": [(2700.0, 7.0, 4.0, 6.5), (3389.5, 7.1, 4.1, 6.5)],
}
PARAM_SQL = """prm AS (SELECT p_partkey, 1600.0::DOUBLE + p_size * 6 AS r_oc, 4.0::DOUBLE + p_size / 50.0::DOUBLE AS vp_cmb,
  CASE WHEN p_partkey % 40 = 7 THEN -1.0::DOUBLE ELSE 4.2::DOUBLE + p_partkey % 30 / 20.0::DOUBLE END AS vp_icb,
  200.0::DOUBLE + p_partkey % 170 * 10 AS r_ic, p_size / 200.0::DOUBLE AS dvp FROM part), st AS (
  SELECT *, vp_icb * (1 + dvp) AS v_ic, vp_icb * (1 + dvp) + (vp_icb - vp_cmb) / (r_oc - r_ic) * r_ic AS v_end FROM prm), ok AS (
  SELECT *, CASE WHEN NOT (r_ic > 0 AND r_ic < r_oc) THEN 'radius_order' WHEN vp_icb <= 0 THEN 'nonpositive_velocity' WHEN vp_cmb <> vp_icb AND abs(cosh(vp_icb) - cosh(vp_cmb)) <= 1e-8 THEN 'coincident_velocities' WHEN v_end <= 0 THEN 'nonpositive_velocity' ELSE 'valid' END AS status FROM st)"""


def parameters(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k, (F.lit(1600.0) + F.col("p_size") * 6).alias("r_oc"), (F.lit(4.0) + F.col("p_size") / F.lit(50.0)).alias("vp_cmb"),
        F.when(k % 40 == 7, -1.0).otherwise(F.lit(4.2) + k % 30 / F.lit(20.0)).alias("vp_icb"),
        (F.lit(200.0) + k % 170 * 10).alias("r_ic"), (F.col("p_size") / F.lit(200.0)).alias("dvp_icb"))


@registered("generated_models", sql="WITH " + PARAM_SQL + """
SELECT p_partkey, status, CASE WHEN status <> 'valid' THEN 1 WHEN 3389.5::DOUBLE - r_oc > 1700 THEN 25 ELSE 24 END::BIGINT AS n_rows,
  CASE WHEN status = 'valid' THEN round(3389.5::DOUBLE - r_oc, 6) END AS cmb_depth,
  CASE WHEN status = 'valid' THEN round(v_ic, 6) END AS vp_icb_inner, CASE WHEN status = 'valid' THEN round(v_end / sqrt(3.0::DOUBLE), 6) END AS vs_centre,
  CASE WHEN status = 'valid' THEN round(9.0::DOUBLE + 0.8::DOUBLE * (least(3389.5::DOUBLE - r_oc, 1700.0) - 1000) / 700, 6) END AS vp_above_core FROM ok""")
def generated_models(spark, sf):
    # Dealt by model first: rows of one model are made and added up in one task, and none holds a whole file of them.
    g = model.generate(parameters(spark, sf).repartition(MODEL_TASKS, "p_partkey"), "p_partkey", BASE)
    at = lambda c, v: F.max(F.when(c, F.col(v)))
    outer, inner = F.col("section") == "outer-core", F.col("section") == "inner-core"
    return g.groupBy("p_partkey", "status").agg(
        F.count("*").alias("n_rows"), rnd(at(outer & (F.col("node") == 0), "depth")).alias("cmb_depth"),
        rnd(at(inner & (F.col("node") == 0), "vp")).alias("vp_icb_inner"),
        rnd(at(inner & (F.col("node") == 4), "vs")).alias("vs_centre"),
        # Plain numbers, which are added up by hashing: a largest struct would sort all rows.
        rnd(F.max_by("vp", F.when(F.col("section") == "mantle", F.col("node")))).alias("vp_above_core"))


@registered("model_validity", sql="""WITH p AS (SELECT p_partkey, 1600.0::DOUBLE + p_size * 10 AS r_oc, 300.0::DOUBLE + p_retailprice AS r_ic, 4.0::DOUBLE + p_size / 20.0 AS vp, 3.0::DOUBLE + p_partkey % 30 / 6.0 AS vs FROM part)
SELECT CASE WHEN r_ic <= 0 OR r_oc <= 0 THEN 'nonpositive_radius' WHEN r_ic >= r_oc THEN 'radius_order' WHEN vs >= vp THEN 'vs_exceeds_vp' ELSE 'valid' END AS status,
  count(*) AS n, round(max(vp / sqrt(3)), 6) AS max_solid_vs FROM p GROUP BY 1""")
def model_validity(spark, sf):
    p = table(spark, sf, "part").select(
        (F.lit(1600.0) + F.col("p_size") * 10).alias("oc"), (F.lit(300.0) + F.col("p_retailprice")).alias("ic"),
        (F.lit(4.0) + F.col("p_size") / F.lit(20.0)).alias("vp"), (F.lit(3.0) + F.col("p_partkey") % 30 / F.lit(6.0)).alias("vs"))
    st = (F.when((F.col("ic") <= 0) | (F.col("oc") <= 0), "nonpositive_radius").when(F.col("ic") >= F.col("oc"), "radius_order")
          .when(F.col("vs") >= F.col("vp"), "vs_exceeds_vp").otherwise("valid"))
    return p.groupBy(st.alias("status")).agg(F.count("*").alias("n"), rnd(F.max(F.col("vp") / F.sqrt(F.lit(3.0)))).alias("max_solid_vs"))
