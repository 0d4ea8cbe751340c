"""Layered models: sections, profiles, lookup, ranking and radius fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamspark.operators import ranks

# Planet radius in km and inner-core density.
RADIUS_KM = 3389.5
INNER_CORE_DENSITY = 6.5


def sections(lines: DataFrame, model: str, ord_: str, value: str) -> DataFrame:
    """Rows of sectioned text with the section in force: a mark line opens its section.

    A model has a handful of marks, so they are gathered and each row finds the last one before it.
    """
    mark = F.trim(value)
    is_mark = mark.isin("mantle", "outer-core", "inner-core")
    marks = lines.where(is_mark).groupBy(model).agg(
        F.array_sort(F.collect_list(F.struct(F.col(ord_).alias("at"), mark.alias("name")))).alias("marks"))
    df = lines.where(~is_mark & (F.trim(value) != "")).join(marks, model, "left")
    before = F.filter("marks", lambda m: m["at"] <= F.col(ord_))
    section = F.coalesce(F.try_element_at(before, F.lit(-1))["name"], F.lit("mantle"))
    parts = F.split(F.trim(value), r"\s+")
    num = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return df.select(
        model, ord_, section.alias("section"), num(0).alias("depth"), num(1).alias("vp"), num(2).alias("vs"),
        num(3).alias("rho"))


def format_rows(depth: Column, vp: Column, vs: Column, rho: Column) -> Column:
    return F.format_string("%.4f %.4f %.4f %.4f", depth, vp, vs, rho)


def coincident(v1: Column, v2: Column) -> Column:
    """Velocities that differ but too little to define a curve."""
    return (v1 != v2) & (F.abs(F.cosh(v2) - F.cosh(v1)) <= 1e-8)


def cosh_profile(d1: Column, v1: Column, d2: Column, v2: Column, nodes: int) -> Column:
    """Nodes of depth = K cosh(v) + b through two points, evenly spaced in velocity.

    Equal velocities have no curve: the depths are then evenly spaced at that velocity. Coincident ones
    that are not equal give null depths.
    """
    flat = v1 == v2
    k = (d2 - d1) / F.when(~flat & ~coincident(v1, v2), F.cosh(v2) - F.cosh(v1))
    b = d1 - k * F.cosh(v1)

    def node(i: Column) -> Column:
        share = i / F.lit(float(nodes - 1))
        v = v1 + (v2 - v1) * share
        depth = F.when(flat, d1 + (d2 - d1) * share).otherwise(k * F.cosh(v) + b)
        return F.struct(i.alias("node"), depth.alias("depth"), v.alias("v"))

    return F.transform(F.sequence(F.lit(0), F.lit(nodes - 1)), node)


def velocity_at_depth(depth: Column, d1: Column, v1: Column, d2: Column, v2: Column) -> Column:
    """Inverse of the curve; null outside its branch."""
    k = (d2 - d1) / F.when(v1 != v2, F.cosh(v2) - F.cosh(v1))
    arg = (depth - (d1 - k * F.cosh(v1))) / k
    return F.when(arg >= 1.0, F.acosh(arg))


def generate(params: DataFrame, key: str, base: dict[str, list[tuple[float, float, float, float]]]) -> DataFrame:
    """Layered models from five core parameters over one base model.

    ``params``: (key, r_oc, vp_cmb, vp_icb, r_ic, dvp_icb). ``base``: (depth, vp, vs, rho) rows per section.
    Gives (key, status, section, node, depth, vp, vs, rho); a refused model keeps one row with its reason.
    """
    if any(r[2] > r[1] for rows in base.values() for r in rows):
        raise ValueError("base model: shear speed above pressure speed")
    arr = lambda rows, c: F.array(*[F.lit(float(r[c])) for r in rows])
    mantle, above, below = base["mantle"], base["mantle"] + base["outer-core"], base["outer-core"] + base["inner-core"]
    full = F.lit(RADIUS_KM)
    bad = (
        F.when(~((F.col("r_ic") > 0) & (F.col("r_ic") < F.col("r_oc")) & (F.col("r_oc") < full)), "radius_order")
        .when((F.col("vp_cmb") <= 0) | (F.col("vp_icb") <= 0), "nonpositive_velocity")
        .when(coincident(F.col("vp_cmb"), F.col("vp_icb")), "coincident_velocities")
        .when(full - F.col("r_oc") <= mantle[0][0], "no_mantle_above_core"))
    df = params.withColumns({"d_oc": full - F.col("r_oc"), "d_ic": full - F.col("r_ic")})
    top_ic = F.col("vp_icb") * (1.0 + F.col("dvp_icb"))
    slope = (F.col("vp_icb") - F.col("vp_cmb")) / F.nullif(F.col("r_oc") - F.col("r_ic"), F.lit(0.0))
    df = df.withColumns({"v_ic": top_ic, "v_end": top_ic + slope * F.col("r_ic")})
    df = df.withColumn("status", F.coalesce(bad, F.when(F.col("v_end") <= 0, "nonpositive_velocity"), F.lit("valid")))
    rho = lambda rows, at: interpolate(at, arr(rows, 0), arr(rows, 3))
    df = df.withColumns({"rho_oc": rho(above, F.col("d_oc")), "rho_ic": rho(below, F.col("d_ic"))})

    def row(section: str, node: Column, depth: Column, vp: Column, vs: Column, density: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), node.cast("int").alias("node"), depth.alias("depth"),
                        vp.alias("vp"), vs.alias("vs"), density.alias("rho"))

    fixed = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("depth", "vp", "vs", "rho"), r)]) for r in mantle])
    kept = F.filter(fixed, lambda r: r["depth"] < F.col("d_oc"))
    upper = F.transform(kept, lambda r, i: row("mantle", i, r["depth"], r["vp"], r["vs"], r["rho"]))
    edge = F.array(row("mantle", F.size(kept), F.col("d_oc"), *[
        interpolate(F.col("d_oc"), arr(mantle, 0), arr(mantle, c)) for c in (1, 2, 3)]))
    outer = F.transform(
        cosh_profile(F.col("d_oc"), F.col("vp_cmb"), F.col("d_ic"), F.col("vp_icb"), 15),
        lambda n: row("outer-core", n["node"], n["depth"], n["v"], F.lit(0.0),
                      F.col("rho_oc") + (F.col("rho_ic") - F.col("rho_oc")) * n["node"] / F.lit(14.0)))
    inner = F.transform(
        cosh_profile(F.col("d_ic"), F.col("v_ic"), full, F.col("v_end"), 5),
        lambda n: row("inner-core", n["node"], n["depth"], n["v"], n["v"] / F.sqrt(F.lit(3.0)), F.lit(INNER_CORE_DENSITY)))
    rows = F.when(F.col("status") == "valid", F.concat(upper, edge, outer, inner))
    return df.select(key, "status", F.inline_outer(rows))


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Straight-line lookup in ascending arrays; outside, the end values hold."""
    n = F.size(xs)
    i = F.greatest(F.lit(1), F.least(n - 1, F.size(F.filter(xs, lambda v: v <= x))))
    x0, x1, y0, y1 = F.get(xs, i - 1), F.get(xs, i), F.get(ys, i - 1), F.get(ys, i)
    return (
        F.when(x <= F.get(xs, F.lit(0)), F.get(ys, F.lit(0))).when(x >= F.get(xs, n - 1), F.get(ys, n - 1))
        .otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0)))


def profile_checks(layers: DataFrame, model: str) -> DataFrame:
    """Per model: depth never decreases, no shear speed in the outer core, shear below pressure speed."""
    steps = ranks.lagged(layers, [model], "ord", "depth", "above")
    return steps.withColumn("step", F.col("depth") - F.col("above")).groupBy(model).agg(
        F.bool_and(F.coalesce(F.col("step") >= 0, F.lit(True))).alias("depth_monotone"),
        F.bool_and((F.col("section") != "outer-core") | (F.col("vs") == 0)).alias("outer_core_fluid"),
        F.bool_and(F.col("vs") < F.col("vp")).alias("vs_below_vp"))


def rescale_radius(layers: DataFrame, model: str, core_radius: Column, new_radius: Column, full: float) -> DataFrame:
    """Depths mapped so the core boundary moves from one radius to another; both parts stay linear."""
    r = F.lit(full) - F.col("depth")
    mapped = F.when(r <= core_radius, r * new_radius / core_radius).otherwise(
        new_radius + (r - core_radius) * (F.lit(full) - new_radius) / (F.lit(full) - core_radius))
    return layers.withColumn("new_depth", F.lit(full) - mapped)


def rank_picks(models: DataFrame, keys: Sequence[str], value: str, model: str, percents: Sequence[float]) -> DataFrame:
    """The models at given percent ranks of ``value``, models of one value in order of their id; ranks come from bucketed
    counts, not one sorted group."""
    c = ranks.cumulative(models, keys, value)
    n = c.groupBy(*keys).agg(F.max("cum").alias("n"))
    want = F.array(*[
        F.struct(F.lit(float(p)).alias("percent"), F.rint((F.col("n") - 1) * F.lit(p / 100.0)).cast("bigint").alias("pos"))
        for p in percents])
    hits = c.join(n, list(keys)).withColumn("w0", F.col("cum") - F.col("w")).withColumn(
        "p", F.explode(F.filter(want, lambda q: (q["pos"] >= F.col("w0")) & (q["pos"] < F.col("cum")))))
    hits = hits.select(*keys, value, F.col("p.percent").alias("percent"), (F.col("p.pos") - F.col("w0")).alias("skip"))
    # Of the models that share a picked value, the one as far behind the first as the rank is.
    tied = models.join(hits.select(*keys, value).distinct(), [*keys, value], "left_semi")
    order = ranks.cumulative(tied, [*keys, value], model)
    at = (F.col("skip") >= F.col("cum") - F.col("w")) & (F.col("skip") < F.col("cum"))
    return hits.join(order, [*keys, value]).where(at).select(*keys, "percent", model, value)


def best_radius(misfit: DataFrame, keys: Sequence[str], radius: str, value: str) -> DataFrame:
    """Radius of least misfit with its two neighbours' central slope; radii of one group are a short list."""
    w = Window.partitionBy(*keys).orderBy(radius)
    d = misfit.withColumn("slope", (F.lead("pred").over(w) - F.lag("pred").over(w))
                          / (F.lead(radius).over(w) - F.lag(radius).over(w)))
    best = F.min(F.struct(F.col(value).alias("m"), F.col(radius).alias("r"), F.col("slope").alias("slope")))
    return d.groupBy(*keys).agg(best.alias("b")).select(
        *keys, F.col("b.r").alias("best_radius"), F.col("b.m").alias("misfit"), F.col("b.slope").alias("slope"))
