"""Input contracts, controls and remaining statistics over grids and traces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from beamspark.functions import kernels
from beamspark.operators import audit, bootstrap, detect, grading, inputs, peaks, ranks, resample
from beamspark.operators import traces as tr
from beamspark.plans.grids import (
    AXIS, AXIS_SQL, BOX_PEAK_SQL, BOXES, POWER_S, POWER_SQL, PRE, SAMPLES_SQL, SR, WINDOWS, grid_cells, traces,
)
from beamspark.plans.registry import big, registered, rnd, table
from beamspark.plans.resampling import (
    GRADE_SQL, N_REAL, SCRAMBLED_SQL, THRESHOLDS, TYPE1_SQL, _stats, lanes_of, scramble_score,
    type1_traces, type3_traces,
)
from beamspark.plans.traces import COMPONENT_SQL, components, long_out


@registered("trace_coverage", sql="""WITH t AS (SELECT d.doc_id, e.vec_id IS NOT NULL AS present FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)
SELECT present, count(*) AS n, min(doc_id) AS first_id FROM t GROUP BY 1""")
def trace_coverage(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("present"))
    j = table(spark, sf, "documents").select("doc_id").join(e, "doc_id", "left").fillna({"present": False})
    return j.groupBy("present").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@registered("first_missing_traces", sql="""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY doc_id LIMIT 5""")
def first_missing_traces(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf, "documents").select("doc_id").join(e, "doc_id", "left_anti").orderBy("doc_id").limit(5)


@registered("time_axis_equality", sql="""WITH t AS (SELECT vec_id, label, (generate_subscripts(embedding, 1) - 1) AS ti FROM embeddings), a AS (
  SELECT label, ti, ti * 0.05::DOUBLE + CASE WHEN vec_id % 200 = 3 AND ti = 5 THEN 0.001::DOUBLE ELSE 0 END AS t FROM t), s AS (
  SELECT label, ti, max(t) - min(t) AS spread FROM a GROUP BY 1, 2)
SELECT label::BIGINT AS lane, round(max(spread), 9) AS max_spread, max(spread) <= 1e-9 AS equal_axes FROM s GROUP BY 1""")
def time_axis_equality(spark, sf):
    bump = lambda i: F.when((F.col("event_id") % 200 == 3) & (i == 5), 0.001).otherwise(0.0)
    t = traces(spark, sf).select("lane", F.posexplode(F.transform("x", lambda _, i: i * F.lit(0.05) + bump(i))).alias("ti", "t"))
    s = t.groupBy("lane", "ti").agg((F.max("t") - F.min("t")).alias("spread"))
    return s.groupBy(big("lane").alias("lane")).agg(rnd(F.max("spread"), 9).alias("max_spread"), (F.max("spread") <= 1e-9).alias("equal_axes"))


@registered("fixed_length_smoothing", sql="WITH " + SAMPLES_SQL + """
SELECT a.event_id, a.ti, round(sum(abs(b.x)) / 5, 9) AS smooth FROM samples a JOIN samples b ON a.event_id = b.event_id
  AND b.ti BETWEEN a.ti - 2 AND a.ti + 2 GROUP BY 1, 2""")
def fixed_length_smoothing(spark, sf):
    s = tr.map_arrays(traces(spark, sf), ["event_id"], ["x"], "smooth array<double>",
                      lambda x: (np.convolve(np.abs(x), np.full(5, 0.2), mode="same"),))
    return long_out(s, "event_id", "smooth")


@registered("grades_with_peak_flags", sql="WITH " + GRADE_SQL.replace("realisation % 7 <> 0 AS peak_ok", "coalesce(any_value(flag), false) AS peak_ok").replace(
    "FROM st GROUP BY 1, 2)", "FROM st LEFT JOIN (SELECT s_suppkey, true AS flag FROM supplier WHERE s_acctbal > 0) ON s_suppkey = realisation GROUP BY 1, 2)") + """
SELECT realisation, phase, g1, g2 FROM gr""")
def grades_with_peak_flags(spark, sf):
    """Local-maximum flags joined to the statistics; a group without a flag counts as not a maximum."""
    flags = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("realisation"), F.lit(True).alias("peak_ok"))
    g = grading.grade(_stats(spark, sf), ["realisation", "phase"], F.lit(True)).join(flags, "realisation", "left")
    ok = F.coalesce("peak_ok", F.lit(False))
    return g.select("realisation", "phase", (F.col("g1") & ok).alias("g1"), (F.col("g2") & ok).alias("g2"))


N1_SCRAMBLES = 25
# Sums over events are list products of the events' shifted roots with each realisation's members: 25 x 200 stacks a lane.
N1_SQL = "WITH " + SAMPLES_SQL + ", " + AXIS_SQL + ", " + SCRAMBLED_SQL.replace("range(201)", "range(1, 26)") + ", " + TYPE1_SQL[:TYPE1_SQL.index(", smp AS")] + """, w(phase, lo, hi) AS (VALUES ('PKiKP', 10, 40), ('PKKP', 36, 60)),
roots AS (
  SELECT event_id, lane, list(CASE WHEN valid THEN sign(x) * pow(abs(x), 0.25::DOUBLE) ELSE 0 END ORDER BY ti) AS r, list(valid::INT::DOUBLE ORDER BY ti) AS v
  FROM samples GROUP BY ALL),
moved AS (
  SELECT lane, k, si, t, list(CASE WHEN t - roll BETWEEN 0 AND 63 THEN r[t - roll + 1] ELSE 0 END ORDER BY event_id) AS r,
         list(CASE WHEN t - roll BETWEEN 0 AND 63 THEN v[t - roll + 1] ELSE 0 END ORDER BY event_id) AS v
  FROM (SELECT roots.*, k, si, round_even(-s * (given - 29.0::DOUBLE), 0)::BIGINT AS roll FROM roots JOIN given USING (event_id), axis), range(64) q(t) GROUP BY ALL),
rows_of AS (SELECT lane, k, si, list(r ORDER BY t) AS r, list(v ORDER BY t) AS v FROM moved GROUP BY ALL),
chosen AS (
  SELECT lane, real, list((d.event_id IS NOT NULL)::INT::DOUBLE ORDER BY e.event_id) AS m
  FROM (SELECT event_id, lane, real FROM roots, reals) e LEFT JOIN design d USING (event_id, real) GROUP BY ALL),
sums AS (
  SELECT lane, k, si, real, list_transform(r, lambda x: list_inner_product(x, m)) AS total, list_transform(v, lambda x: list_inner_product(x, m)) AS n
  FROM rows_of JOIN chosen USING (lane)),
squares AS (
  SELECT lane, k, si, real, list_transform(total, lambda x, i: CASE WHEN n[i] >= 2 THEN pow(x / n[i], 8) ELSE 0 END) AS b,
         list_transform(n, lambda x: CASE WHEN x >= 2 THEN 1.0::DOUBLE ELSE 0 END) AS ok FROM sums),
powers AS (
  SELECT lane, k, si, real, list_transform(b, lambda x, i: CASE WHEN ok[i] > 0 THEN
    (x + 0.5::DOUBLE * (CASE WHEN i > 1 THEN b[i - 1] ELSE 0 END + coalesce(b[i + 1], 0)))
    / (1 + 0.5::DOUBLE * (CASE WHEN i > 1 THEN ok[i - 1] ELSE 0 END + coalesce(ok[i + 1], 0))) END) AS p FROM squares),
cut AS (SELECT lane, k, si, real, phase, lo, p[lo + 1:hi + 1] AS p FROM powers, w),
tops AS (SELECT lane, k, real, phase, max(list_max(p)) AS peak FROM cut GROUP BY ALL)
SELECT lane::BIGINT AS lane, k::BIGINT AS k, phase, thr::BIGINT AS threshold_pct, si::BIGINT AS si, ti, count(*) / 200.0::DOUBLE AS frac FROM (
  SELECT lane, k, phase, thr, si, unnest(list_filter(list_transform(p, lambda x, i: CASE WHEN x >= thr / 100.0::DOUBLE * (1 - 1e-12::DOUBLE) * peak THEN lo + i - 1 END),
    lambda x: x IS NOT NULL)) AS ti FROM cut JOIN tops USING (lane, k, real, phase), (SELECT unnest([50, 70, 85]) AS thr)) GROUP BY ALL"""


def _n1(spark, sf, t):
    """Null machinery in full: every scramble has its own bootstrap, all of them in one pass over the traces."""
    plan = bootstrap.design(AXIS.values, WINDOWS, THRESHOLDS, per_set=N_REAL, n_sets=N1_SCRAMBLES + 1, sr=SR, pre_s=PRE, power_window_s=POWER_S)
    ids = resample.scrambled_distances(traces(spark, sf).select("lane", "event_id", "distance"), "lane", N1_SCRAMBLES + 1, scramble_score)
    t = t.join(ids.select("lane", "event_id", "distances"), ["lane", "event_id"])
    occ = bootstrap.occupancy(bootstrap.resampled(t, ["lane"], plan, sizes=lanes_of(spark, sf)), ["lane"], plan).where("set > 0")
    return occ.select(big("lane").alias("lane"), big("set").alias("k"), "phase", big("threshold_pct").alias("threshold_pct"),
                      big("si").alias("si"), big("ti").alias("ti"), "frac")


@registered("scrambled_bootstrap_occupancy", sql=N1_SQL)
def scrambled_bootstrap_occupancy(spark, sf):
    return _n1(spark, sf, type1_traces(spark, sf))


@registered("scrambled_jitter_occupancy")  # 1.8 billion shifted samples in SQL: tested on a small table
def scrambled_jitter_occupancy(spark, sf):
    return _n1(spark, sf, type3_traces(spark, sf))


@registered("decoy_controls", sql="WITH " + POWER_SQL + """, c AS (SELECT lane, t, s, power FROM vesp WHERE power IS NOT NULL AND support >= 2), r AS (
  SELECT lane, t AS rt, s AS rs, power AS rp FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY power DESC, si, ti) AS rn FROM vesp
    WHERE power IS NOT NULL AND support >= 2) WHERE rn = 1), a AS (
  SELECT lane, max(power) FILTER (t BETWEEN 10 AND 18 AND s BETWEEN -1.5 AND -0.7) AS p1,
         max(power) FILTER (t BETWEEN rt - 4 AND rt + 4 AND s >= rs - 0.25::DOUBLE AND s <= rs + 0.25::DOUBLE) AS p2,
         max(power) FILTER (t BETWEEN 34 AND 42 AND s BETWEEN -1.5 AND -0.7) AS a1, any_value(rp) AS rp FROM c JOIN r USING (lane) GROUP BY lane)
SELECT lane::BIGINT AS lane, p1 IS NOT NULL AS p1_positive, p2 = rp AS p2_positive, a1 IS NULL OR a1 < p1 AS a1_adverse FROM a""")
def decoy_controls(spark, sf):
    c = grid_cells(spark, sf).where(peaks.supported())
    r = c.groupBy("lane").agg(F.max(peaks.ordered_cell()).alias("r"))
    j = c.join(r, "lane")
    best = lambda cond: F.max(F.when(cond, F.col("power")))
    ridge = (F.abs(F.col("t") - F.col("r.t")) <= 4) & (F.col("s") >= F.col("r.s") - 0.25) & (F.col("s") <= F.col("r.s") + 0.25)
    g = j.groupBy(big("lane").alias("lane")).agg(
        best(peaks.in_box(10.0, 18.0, -1.5, -0.7)).alias("p1"), best(ridge).alias("p2"),
        best(peaks.in_box(34.0, 42.0, -1.5, -0.7)).alias("a1"), F.max("r.power").alias("rp"))
    return g.select("lane", F.col("p1").isNotNull().alias("p1_positive"), (F.col("p2") == F.col("rp")).alias("p2_positive"),
                    F.coalesce(F.col("a1") < F.col("p1"), F.lit(True)).alias("a1_adverse"))


@registered("box_peak_local_max", sql="WITH " + BOX_PEAK_SQL + """, lm AS (
  SELECT a.lane, a.si, a.ti, round(a.power, 12) >= max(round(b.power, 12)) AS is_max FROM vesp a JOIN vesp b ON a.lane = b.lane
   AND b.si BETWEEN a.si - 1 AND a.si + 1 AND b.ti BETWEEN a.ti - 1 AND a.ti + 1 WHERE a.power IS NOT NULL GROUP BY a.lane, a.si, a.ti, a.power)
SELECT bp.lane::BIGINT AS lane, bp.phase, bp.t AS time_s, round(bp.power, 9) AS power, lm.is_max AS is_local_max FROM bp
JOIN lm ON lm.lane = bp.lane AND lm.si = bp.si AND lm.ti = bp.ti""")
def box_peak_local_max(spark, sf):
    # Only the comparison of neighbours is rounded: stacks of many traces are small, and rounded powers would tie in a box.
    c = grid_cells(spark, sf)
    p = peaks.box_peaks(c, ["lane"], BOXES).where("status = 'ok'")
    m = peaks.local_maxima(c.withColumn("power", F.round("power", 12)), ["lane"]).select("lane", F.col("si").alias("slow_idx"), F.col("ti").alias("time_idx"), "is_local_max")
    return p.join(m, ["lane", "slow_idx", "time_idx"]).select(
        big("lane").alias("lane"), "phase", "time_s", rnd("power", 9).alias("power"), "is_local_max")


@registered("grid_structure_checks", sql="WITH " + POWER_SQL + """
SELECT lane::BIGINT AS lane, count(DISTINCT si)::BIGINT AS slownesses, count(DISTINCT ti)::BIGINT AS samples, count(*) = count(DISTINCT si) * count(DISTINCT ti) AS shape_ok,
  count(*) FILTER (power IS NOT NULL AND support < 2) AS unsupported_power, count(*) FILTER (power < 0) AS negative_power,
  CASE WHEN count(*) FILTER (power IS NOT NULL AND support < 2) > 0 THEN 'blocked_support_shape_mismatch' ELSE 'ok' END AS status FROM vesp GROUP BY 1""")
def grid_structure_checks(spark, sf):
    c = grid_cells(spark, sf)
    n_s, n_t = F.count_distinct("si"), F.count_distinct("ti")  # as many as the axes have
    ghost = F.count_if(F.col("power").isNotNull() & (F.col("support") < 2))
    return c.groupBy(big("lane").alias("lane")).agg(
        big(n_s).alias("slownesses"), big(n_t).alias("samples"), (F.count("*") == n_s * n_t).alias("shape_ok"),
        ghost.alias("unsupported_power"), F.count_if(F.col("power") < 0).alias("negative_power"),
        F.when(ghost > 0, "blocked_support_shape_mismatch").otherwise("ok").alias("status"))


@registered("pinned_number_assertions", sql="""WITH p AS (SELECT l_suppkey, round(avg(l_quantity), 6) AS observed, round(25.5 + (l_suppkey % 5 - 2) * 0.5, 6)::DOUBLE AS pinned FROM lineitem GROUP BY 1)
SELECT l_suppkey, observed, pinned, abs(observed - pinned) <= 0.5 AS reproduced, abs(observed - (pinned + 1)) <= 0.5 AS adverse_reproduced FROM p""")
def pinned_number_assertions(spark, sf):
    """Recorded numbers against recomputed ones, with a shifted twin that must not reproduce."""
    p = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(rnd(F.avg("l_quantity")).alias("observed"))
    p = p.withColumn("pinned", F.lit(25.5) + (F.col("l_suppkey") % 5 - 2) * F.lit(0.5))
    near = lambda v: F.abs(F.col("observed") - v) <= 0.5
    return p.select("l_suppkey", "observed", "pinned", near(F.col("pinned")).alias("reproduced"), near(F.col("pinned") + 1).alias("adverse_reproduced"))


@registered("fidelity_artifact_thresholds", sql="""WITH a AS (SELECT p_partkey, p_size % 6 <> 0 AS passed, CASE WHEN p_partkey % 15 = 0 THEN NULL ELSE p_size / 1000.0::DOUBLE END AS err FROM part)
SELECT CASE WHEN NOT passed OR err IS NULL OR err > 0.045 THEN 'blocked_model_generator_fidelity_failed' ELSE 'ok' END AS status, count(*) AS n FROM a GROUP BY 1""")
def fidelity_artifact_thresholds(spark, sf):
    err = F.when(F.col("p_partkey") % 15 != 0, F.col("p_size") / F.lit(1000.0))
    ok = (F.col("p_size") % 6 != 0) & F.coalesce(err <= 0.045, F.lit(False))
    st = F.when(ok, "ok").otherwise("blocked_model_generator_fidelity_failed")
    return audit.status_counts(table(spark, sf, "part").select(st.alias("status")), "status")


@registered("frozen_lane_guard", sql="""SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'A') AS variant_overrides, count(*) FILTER (l_linestatus <> 'O') AS mode_overrides,
  CASE WHEN count(*) FILTER (l_returnflag <> 'A' OR l_linestatus <> 'O') > 0 THEN 'refused' ELSE 'frozen' END AS status FROM lineitem GROUP BY 1""")
def frozen_lane_guard(spark, sf):
    frozen = {"l_returnflag": "A", "l_linestatus": "O"}
    off = {c: F.col(c) != v for c, v in frozen.items()}
    both = off["l_returnflag"] | off["l_linestatus"]
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(off["l_returnflag"]).alias("variant_overrides"), F.count_if(off["l_linestatus"]).alias("mode_overrides"),
        F.when(F.count_if(both) > 0, "refused").otherwise("frozen").alias("status"))


@registered("registered_input_check", sql="""SELECT label::BIGINT AS lane, count(*) AS events, min(vec_id) AS first_event, max(vec_id) AS last_event,
  count(*) = 23 AS registered_count, CASE WHEN count(*) = count(DISTINCT vec_id) THEN 'unique' ELSE 'repeated' END AS identity FROM embeddings GROUP BY 1""")
def registered_input_check(spark, sf):
    per = table(spark, sf, "embeddings").groupBy("label", "vec_id").agg(F.count("*").alias("n"))
    return per.groupBy(big("label").alias("lane")).agg(
        F.sum("n").alias("events"), F.min("vec_id").alias("first_event"), F.max("vec_id").alias("last_event"),
        (F.sum("n") == 23).alias("registered_count"), F.when(F.max("n") == 1, "unique").otherwise("repeated").alias("identity"))


@registered("registered_catalogue_row", sql="""SELECT source, count(*) FILTER (lang = 'en' AND n_chars > 3000) AS rows_found, CASE count(*) FILTER (lang = 'en' AND n_chars > 3000)
  WHEN 1 THEN 'ok' WHEN 0 THEN 'missing_registered_row' ELSE 'ambiguous_registered_row' END AS status, min(sha256(text)) FILTER (lang = 'en' AND n_chars > 3000) AS digest
FROM documents GROUP BY 1""")
def registered_catalogue_row(spark, sf):
    hit = (F.col("lang") == "en") & (F.col("n_chars") > 3000)
    d = table(spark, sf, "documents").select("source", hit.alias("hit"), F.when(hit, F.sha2("text", 256)).alias("h"))
    n = F.count_if("hit")
    return d.groupBy("source").agg(n.alias("rows_found"), F.when(n == 1, "ok").when(n == 0, "missing_registered_row").otherwise(
        "ambiguous_registered_row").alias("status"), F.min("h").alias("digest"))


@registered("sidecar_status", sql="""SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'refused_reserved_status' WHEN l_returnflag = 'R' THEN 'sidecar_attested_not_independently_verified'
  ELSE 'ucla_unverified' END AS status, count(*) AS n FROM lineitem GROUP BY 1""")
def sidecar_status(spark, sf):
    strict = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    st = F.when(strict, "refused_reserved_status").when(F.col("l_returnflag") == "R", "sidecar_attested_not_independently_verified").otherwise(
        "ucla_unverified")
    return audit.status_counts(table(spark, sf, "lineitem").select(st.alias("status")), "status")


@registered("dataset_listing_json", sql="""SELECT c_nationkey::BIGINT AS dataset, count(*) AS files, count(*) FILTER (c_acctbal > 0) AS restricted FROM customer GROUP BY 1""")
def dataset_listing_json(spark, sf):
    """Listings as JSON documents, one per customer file, unpacked with a fixed schema."""
    doc = F.to_json(F.struct(F.struct(F.col("c_nationkey").alias("id"), F.array(F.struct(
        F.col("c_name").alias("label"), (F.col("c_acctbal") > 0).alias("restricted"))).alias("files")).alias("data")))
    parsed = table(spark, sf, "customer").select(F.from_json(
        doc, "data struct<id:bigint,files:array<struct<label:string,restricted:boolean>>>").alias("j"))
    rows = parsed.select(F.col("j.data.id").alias("dataset"), F.explode("j.data.files").alias("f"))
    return rows.groupBy("dataset").agg(F.count("*").alias("files"), F.count_if("f.restricted").alias("restricted"))


@registered("events_by_distance", sql="""SELECT vec_id AS event_id, 27.5::DOUBLE + (vec_id % 23) * 0.5::DOUBLE AS distance, label::BIGINT AS lane FROM embeddings""")
def events_by_distance(spark, sf):
    t = traces(spark, sf).select(big("event_id").alias("event_id"), "distance", big("lane").alias("lane"))
    return t.orderBy("distance", "event_id")


@registered("endpoint_registry_keys", sql="""SELECT DISTINCT 'paperfaith/envelope/' || l_returnflag || '/nth_root/win' || (l_linenumber * 5) AS chain_id,
  CASE l_linestatus WHEN 'O' THEN 'PKiKP/published_target' ELSE 'PKKP/paper_target' END AS endpoint FROM lineitem""")
def endpoint_registry_keys(spark, sf):
    chain = F.concat(F.lit("paperfaith/envelope/"), "l_returnflag", F.lit("/nth_root/win"), (F.col("l_linenumber") * 5).cast("string"))
    end = F.when(F.col("l_linestatus") == "O", "PKiKP/published_target").otherwise("PKKP/paper_target")
    return table(spark, sf, "lineitem").select(chain.alias("chain_id"), end.alias("endpoint")).distinct()


FREQ = (1.0, 2.0)


@registered("cross_spectral_covariance", sql="WITH " + COMPONENT_SQL + """, g AS (
  SELECT f, d, sum(exp(-2 * pow(pi() * (CASE WHEN k < 32 THEN k ELSE k - 64 END) * (20.0::DOUBLE / 64) / f, 2)) * cos(2 * pi() * k * d / 64)) / 64 AS gre
  FROM (SELECT unnest([1.0, 2.0])::DOUBLE AS f), range(64) a(d), range(64) b(k) GROUP BY 1, 2), m AS (
  SELECT event_id, ti, f, z, n, e, cos(2 * pi() * round_even(f / (20.0::DOUBLE / 64), 0) * ti / 64) AS c,
         -sin(2 * pi() * round_even(f / (20.0::DOUBLE / 64), 0) * ti / 64) AS s FROM zne, (SELECT unnest([1.0, 2.0])::DOUBLE AS f)), y AS (
  SELECT m.event_id, m.f, t.ti, sum(gre * z * c) AS zr, sum(gre * z * s) AS zi, sum(gre * n * c) AS nr, sum(gre * n * s) AS ni,
         sum(gre * e * c) AS er, sum(gre * e * s) AS ei
  FROM m JOIN g ON g.f = m.f JOIN (SELECT unnest(range(64)) AS ti) t ON g.d = (t.ti - m.ti + 64) % 64 GROUP BY 1, 2, 3)
SELECT event_id, f AS frequency_hz, round(avg(zr * zr + zi * zi), 9) AS czz, round(avg(nr * nr + ni * ni), 9) AS cnn, round(avg(er * er + ei * ei), 9) AS cee,
  round(avg(zr * nr + zi * ni), 9) + 0.0 AS czn_re, round(avg(zi * nr - zr * ni), 9) + 0.0 AS czn_im,
  round(avg(zr * er + zi * ei), 9) + 0.0 AS cze_re, round(avg(zi * er - zr * ei), 9) + 0.0 AS cze_im FROM y GROUP BY 1, 2""")
def cross_spectral_covariance(spark, sf):
    """Complex covariance of the frequency-shifted components over each whole record."""
    def step(z, n, e):
        s = np.array([kernels.frequency_shift(np.vstack([z, n, e]), 20.0, f) for f in FREQ])
        c = s @ s.conj().transpose(0, 2, 1) / s.shape[2]
        return [(f, m[0, 0].real, m[1, 1].real, m[2, 2].real, m[0, 1].real, m[0, 1].imag, m[0, 2].real, m[0, 2].imag)
                for f, m in zip(FREQ, c)]

    names = ["czz", "cnn", "cee", "czn_re", "czn_im", "cze_re", "cze_im"]
    out = tr.map_arrays(components(spark, sf), ["event_id"], ["z", "n", "e"],
                        "frequency_hz double, " + ", ".join(f"{c} double" for c in names), step)
    return out.select(big("event_id").alias("event_id"), "frequency_hz", *[rnd(c, 9).alias(c) for c in names])


FIVE_SQL = BOX_PEAK_SQL + """, win(phase, lab, lo, hi) AS (VALUES ('PKiKP', 'global', 2.0, 32.0), ('PKKP', 'peak_1', 28.0, 52.0)), c AS (
  SELECT phase, lab, v.*, row_number() OVER (PARTITION BY lane, phase ORDER BY power DESC, si, ti) AS rn FROM vesp v JOIN win ON t BETWEEN lo AND hi
  WHERE power IS NOT NULL AND support >= 2), second AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.lane ORDER BY c.power DESC, c.si, c.ti) AS r2 FROM c JOIN c p ON p.lane = c.lane AND p.phase = c.phase AND p.rn = 1
  WHERE c.phase = 'PKKP' AND NOT (abs(c.t - p.t) <= 6 AND abs(c.s - p.s) <= 0.5)), allp AS (
  SELECT lane, phase, lab AS peak_label, t, s, power, si, ti, support FROM c WHERE rn = 1 UNION ALL
  SELECT lane, phase, 'peak_2', t, s, power, si, ti, support FROM second WHERE r2 = 1 UNION ALL
  SELECT lane, phase, peak_label, t, s, power, si, ti, support FROM bp WHERE peak_label <> 'off_grid'), q AS (
  SELECT a.lane, a.phase, a.peak_label, avg(CASE WHEN v.power <= a.power THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS quantile,
    1 + count(*) FILTER (v.power > a.power AND v.support >= 2 AND v.t BETWEEN CASE a.phase WHEN 'PKiKP' THEN 2.0 ELSE 28.0 END
      AND CASE a.phase WHEN 'PKiKP' THEN 32.0 ELSE 52.0 END) AS rank,
    max(v.power) FILTER (v.si BETWEEN a.si - 1 AND a.si + 1 AND v.ti BETWEEN a.ti - 1 AND a.ti + 1) <= a.power AS is_max
  FROM allp a JOIN vesp v ON v.lane = a.lane AND v.power IS NOT NULL GROUP BY a.lane, a.phase, a.peak_label, a.power)"""


@registered("five_registered_peaks", sql="WITH " + FIVE_SQL + """
SELECT lane::BIGINT AS lane, phase, peak_label, t AS time_s, round(s, 6) + 0.0 AS slowness_sdeg, round(power, 9) AS power,
  support::BIGINT AS support_count, round(quantile, 9) AS background_quantile, rank::BIGINT AS target_box_rank, is_max AS local_max
FROM allp JOIN q USING (lane, phase, peak_label)""")
def five_registered_peaks(spark, sf):
    p = detect.five_peaks(grid_cells(spark, sf), ["lane"], windows=WINDOWS, boxes=BOXES[:2], dt=6.0, ds=0.5)
    return p.select(
        big("lane").alias("lane"), "phase", "peak_label", "time_s", rnd("slowness_sdeg").alias("slowness_sdeg"),
        rnd("power", 9).alias("power"), big("support_count").alias("support_count"),
        rnd("background_quantile", 9).alias("background_quantile"), big("target_box_rank").alias("target_box_rank"),
        F.col("local_max_neighbor_check").alias("local_max"))


@registered("peak_table", sql="WITH " + FIVE_SQL + """, err AS (
  SELECT label AS lane, median(1.0::DOUBLE + vec_id % 5) FILTER (vec_id % 11 <> 0) AS med, max(1.0::DOUBLE + vec_id % 5) FILTER (vec_id % 11 <> 0) AS top
  FROM embeddings GROUP BY label), tgt(phase, peak_label, pt, ps, tt, ts, box) AS (VALUES
  ('PKiKP', 'global', 604.0::DOUBLE, -6.5::DOUBLE, 2.0::DOUBLE, 0.6::DOUBLE, ''), ('PKiKP', 'published_target', 604.0::DOUBLE, -6.5::DOUBLE, 2.0::DOUBLE, 0.6::DOUBLE, 'PKIKP_PUBLISHED'),
  ('PKKP', 'peak_1', 1290.0::DOUBLE, -8.0::DOUBLE, 30.0::DOUBLE, 1.5::DOUBLE, ''), ('PKKP', 'peak_2', 1341.0::DOUBLE, -7.0::DOUBLE, 30.0::DOUBLE, 1.5::DOUBLE, ''),
  ('PKKP', 'paper_target', 1341.0::DOUBLE, -7.0::DOUBLE, 5.0::DOUBLE, 0.4::DOUBLE, 'PKKP_PUBLISHED')), band AS (
  SELECT i.lane, i.phase, i.peak_label, count(*) FILTER (i.ok AND i.power >= 0.85::DOUBLE * bp.power) AS n_band
  FROM inside i JOIN bp USING (lane, phase, peak_label) GROUP BY ALL)
SELECT 'paperfaith' AS mode, CASE WHEN a.lane % 2 = 0 THEN 'envelope' ELSE 'raw' END AS input_type, CASE a.lane % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS norm_variant,
  'op' || a.lane AS polarization_operator, 'nth_root' AS stack_method, 5.0::DOUBLE AS power_window_s, a.phase, a.peak_label, round(a.t, 6) + 0.0 AS time_s,
  round(a.s, 6) + 0.0 AS slowness_sdeg, round(a.power, 9) + 0.0 AS power, a.support::BIGINT AS support_count, 2::BIGINT AS minimum_support, 'ok' AS status, '' AS excluded_reason,
  pt AS paper_time_s, ps AS paper_slowness_sdeg, round(a.t - pt, 6) + 0.0 AS dt_vs_paper_s, round(a.s - ps, 6) + 0.0 AS ds_vs_paper_sdeg,
  abs(a.t - pt) <= tt AND abs(a.s - ps) <= ts AS within_published_tolerance, round(sqrt(pow((a.t - pt) / tt, 2) + pow((a.s - ps) / ts, 2)), 6) + 0.0 AS grid_coordinate_miss_norm,
  med AS median_distance_error_deg, top AS max_distance_error_deg, round(abs(ps) * med, 6) + 0.0 AS distance_uncertainty_moveout_s,
  round(tt + abs(ps) * med, 6) + 0.0 AS uncertainty_folded_time_tolerance_s, abs(a.t - pt) <= tt + abs(ps) * med AND abs(a.s - ps) <= ts AS within_uncertainty_folded_tolerance,
  is_max AS local_max_neighbor_check, round(quantile, 9) + 0.0 AS box_peak_background_quantile, rank::BIGINT AS target_box_rank, box AS published_target_box,
  round(CASE WHEN box <> '' THEN n_band::DOUBLE / n_ok END, 9) + 0.0 AS box_occupancy_in_band, round(CASE WHEN box <> '' THEN n_ok::DOUBLE / total END, 9) + 0.0 AS box_supported_cell_fraction,
  coalesce(n_ok, 0)::BIGINT AS box_valid_cell_count, coalesce(total, 0)::BIGINT AS box_total_cell_count,
  CASE a.lane % 3 WHEN 0 THEN 'headline_targeted_window_eq1' WHEN 1 THEN 'targeted_pkkp_window' ELSE 'ablation_full_window' END AS normalization_lane,
  'not_required' AS current_provenance_status
FROM allp a JOIN q USING (lane, phase, peak_label) JOIN tgt USING (phase, peak_label) LEFT JOIN err ON err.lane = a.lane
LEFT JOIN bp ON bp.lane = a.lane AND bp.phase = a.phase AND bp.peak_label = a.peak_label LEFT JOIN band ON band.lane = a.lane AND band.phase = a.phase AND band.peak_label = a.peak_label
WHERE a.power IS NOT NULL""")
def peak_table(spark, sf):
    """The whole 36-column table of the five registered peaks, every lane column filled."""
    lane = F.col("lane")
    names = {
        "mode": F.lit("paperfaith"), "input_type": F.when(lane % 2 == 0, "envelope").otherwise("raw"),
        "norm_variant": F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.pmod(lane, F.lit(3)) + 1),
        "polarization_operator": F.concat(F.lit("op"), lane.cast("string")), "stack_method": F.lit("nth_root"), "power_window_s": F.lit(POWER_S)}
    known = F.when(F.pmod("vec_id", F.lit(11)) != 0, F.lit(1.0) + F.pmod("vec_id", F.lit(5)))
    errors = table(spark, sf, "embeddings").select(F.col("label").alias("lane"), known.alias("e")).withColumns(names)
    err = ranks.quantiles(errors, list(names), "e", [0.5]).withColumnRenamed("q50", "median_distance_error_deg").join(
        errors.groupBy(*names).agg(F.max("e").alias("max_distance_error_deg")), list(names))
    cells = grid_cells(spark, sf).withColumns(names)
    p = detect.peak_table(cells, list(names), err, windows=WINDOWS, boxes=BOXES[:2], dt=6.0, ds=0.5, min_support=2)
    digits = dict.fromkeys(("power", "box_peak_background_quantile", "box_occupancy_in_band", "box_supported_cell_fraction"), 9)
    whole = ("support_count", "minimum_support", "target_box_rank", "box_valid_cell_count", "box_total_cell_count")
    rounded = {f.name: rnd(f.name, digits.get(f.name, 6)) for f in p.schema.fields if f.dataType.simpleString() == "double"}
    return p.where("status = 'ok'").withColumns(rounded | {c: big(c) for c in whole})


@registered("stack_input_loader", sql="""WITH e AS (SELECT vec_id AS event_id, label, embedding AS x FROM embeddings), lanes(lane) AS (VALUES ('A'), ('B')), w AS (
  SELECT lane, event_id, label, x FROM e CROSS JOIN lanes WHERE event_id % 10 <> 0)
SELECT lane, event_id, CASE WHEN event_id % 17 = 0 AND lane = 'A' THEN 'missing_trace' WHEN event_id % 19 = 0 THEN 'missing_mask'
  WHEN event_id % 13 = 0 THEN 'mask_shape_mismatch' WHEN event_id % 23 = 0 THEN 'time_axis_mismatch' ELSE 'ok' END AS status,
  CASE WHEN NOT (event_id % 17 = 0 AND lane = 'A') THEN len(x)::BIGINT END AS samples FROM w""")
def stack_input_loader(spark, sf):
    """Event table, traces and masks of two lanes brought together; what is missing or off the axis has a status."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("event_id"), "embedding")
    k = F.col("event_id")
    events = e.select("event_id", F.when(k % 10 == 0, "other").otherwise("vespagram").alias("set"), F.lit(30.0).alias("distance"), F.lit(1.0).alias("distance_err"))
    lane = F.explode(F.array(F.lit("A"), F.lit("B"))).alias("lane")
    start = F.when(k % 23 == 0, -7.5).otherwise(-8.0).alias("start_s")
    found = e.select("event_id", lane, F.col("embedding").cast("array<double>").alias("x"), start, F.lit(1.0).alias("step_s"))
    found = found.where((k % 17 != 0) | (F.col("lane") == "B"))
    kept = F.when(k % 13 == 0, F.size("embedding") - 1).otherwise(F.size("embedding"))
    masks = e.where(k % 19 != 0).select("event_id", lane, F.transform(F.slice("embedding", F.lit(1), kept), lambda _: F.lit(True)).alias("valid"))
    j = inputs.input_status(events, found, masks, [{"lane": "A"}, {"lane": "B"}])
    return j.select("lane", big("event_id").alias("event_id"), "status", F.when(F.col("x").isNotNull(), big(F.size("x"))).alias("samples"))


@registered("frozen_constants_gate", sql="""SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_nationkey < 3 THEN 'nth_root_order' END, CASE WHEN s_acctbal < 0 THEN 'power_window_s' END,
  CASE WHEN s_suppkey % 7 = 0 THEN 'ref_distance_deg' END], lambda x: x IS NOT NULL), ',') AS departures FROM supplier""")
def frozen_constants_gate(spark, sf):
    """Recorded constants of each run against the registered card."""
    s = table(spark, sf, "supplier")
    d = inputs.departures({
        "ref_distance_deg": F.when(F.col("s_suppkey") % 7 == 0, 30.0).otherwise(29.0), "nth_root_order": F.when(F.col("s_nationkey") < 3, 3).otherwise(4),
        "power_window_s": F.when(F.col("s_acctbal") < 0, F.lit(None)).otherwise(20.0)})
    return s.select("s_suppkey", F.array_join(d, ",").alias("departures"))
