"""Catalogue matching, picks, screening and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from beamspark import dims
from beamspark.functions import text
from beamspark.operators import match
from beamspark.plans.registry import big, micros, registered, rnd, table

TOKEN_SQL = "'S' || lpad(({}) ::VARCHAR, 4, '0') || 'a'"


def token(number):
    return F.concat(F.lit("S"), F.lpad(number.cast("string"), 4, "0"), F.lit("a"))


@registered("event_scan_filter", sql="""SELECT event_id, user_id, round(value, 6) AS value,
  CASE WHEN value BETWEEN 29 AND 32 THEN 'cluster_29_32' ELSE 'outside_29_32' END AS distance_bin,
  CASE WHEN value < 32 THEN '602-family' ELSE '662-family' END AS branch
FROM events WHERE event_type = 'purchase' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""")
def event_scan_filter(spark, sf):
    e = table(spark, sf, "events").where(
        (F.col("event_type") == "purchase")
        & F.col("ts").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")))
    return e.select(
        "event_id", "user_id", rnd("value").alias("value"),
        F.when(F.col("value").between(29, 32), "cluster_29_32").otherwise("outside_29_32").alias("distance_bin"),
        F.when(F.col("value") < 32, "602-family").otherwise("662-family").alias("branch"))


MATCH_SQL = "WITH t AS (SELECT event_id AS target_id, epoch_us(ts) AS at, " + TOKEN_SQL.format(
    "(event_id * 3) % 5000") + " AS token FROM events WHERE event_type = 'purchase'), c AS (SELECT 'smi:' || event_id AS rid, epoch_us(ts) AS at, " \
    + TOKEN_SQL.format("event_id % 5000") + " AS token FROM events WHERE event_type <> 'purchase')"


@registered("catalogue_event_match", sql=MATCH_SQL + """, ex AS (
  SELECT target_id, rid, abs(c.at - t.at) AS delta, row_number() OVER (PARTITION BY target_id
    ORDER BY abs(c.at - t.at), c.at, rid) AS rn FROM t JOIN c USING (token)), ne AS (
  SELECT target_id, rid, abs(c.at - t.at) AS delta, row_number() OVER (PARTITION BY target_id
    ORDER BY abs(c.at - t.at), c.at, rid) AS rn FROM t JOIN c ON c.at BETWEEN t.at - 30000000 AND t.at + 30000000)
SELECT t.target_id, coalesce(ex.rid, ne.rid) AS resource_id, coalesce(ex.delta, ne.delta) AS delta,
       ex.rid IS NOT NULL AS event_id_match_used, CASE WHEN ex.rid IS NOT NULL THEN 'exact_id'
         WHEN ne.rid IS NOT NULL THEN 'nearest' ELSE 'no_event_within_tolerance' END AS status
FROM t LEFT JOIN ex ON ex.target_id = t.target_id AND ex.rn = 1 LEFT JOIN ne ON ne.target_id = t.target_id AND ne.rn = 1""")
def catalogue_event_match(spark, sf):
    e = table(spark, sf, "events").withColumn("at", micros("ts"))
    targets = e.where("event_type = 'purchase'").select(
        F.col("event_id").alias("target_id"), "at", token((F.col("event_id") * 3) % 5000).alias("token"))
    # The identifier stands in free text; a longer word that merely contains one must not match.
    words = F.concat(F.lit("quake "), token(F.col("event_id") % 5000), F.lit(" (was xS0001ab, S12345a)"))
    cat = e.where("event_type <> 'purchase'").select(
        F.concat(F.lit("smi:"), F.col("event_id")).alias("resource_id"), "at", text.event_tokens(words).alias("tokens"))
    return match.match_events(targets, cat, tolerance=int(dims.EVENT_MATCH_MAX_DELTA_S * 1_000_000))


@registered("nearest_feature_per_user", sql="""WITH l AS (
  SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'purchase'), r AS (
  SELECT event_id AS rid, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'view')
SELECT event_id, user_id, arg_min(rid, (abs(r.at - l.at), r.at, rid)) AS feature_id, min(abs(r.at - l.at)) AS delta_us
FROM l JOIN r USING (user_id) GROUP BY 1, 2""")
def nearest_feature_per_user(spark, sf):
    e = table(spark, sf, "events").withColumn("at", micros("ts"))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    right = e.where("event_type = 'view'").select(F.col("event_id").alias("rid"), "user_id", "at")
    near = match.nearest(left, right, ["user_id"], "at", "at", "rid")
    return left.join(near, ["user_id", "at"]).where("match_id IS NOT NULL").select(
        "event_id", "user_id", F.col("match_id").alias("feature_id"), F.col("delta").alias("delta_us"))


CONT_SQL = """e AS (SELECT event_id, epoch(ts)::BIGINT AS at, 4 + value / 100 AS mag,
  (event_id * 37) % 180 - 90.0::DOUBLE AS lat, (event_id * 101) % 360 - 180.0::DOUBLE AS lon FROM events)"""


def quakes(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.floor(micros("ts") / 1000000).alias("at"), (F.lit(4) + F.col("value") / 100).alias("mag"),
        ((F.col("event_id") * 37) % 180 - F.lit(90.0)).alias("lat"),
        ((F.col("event_id") * 101) % 360 - F.lit(180.0)).alias("lon"))


@registered("contamination_screen", sql="WITH " + CONT_SQL.replace("epoch(ts)::BIGINT", "epoch_us(ts) // 1000000") + """
SELECT e.event_id, e.at AS origin_s, round(e.mag, 6) AS mag FROM e WHERE NOT EXISTS (
  SELECT 1 FROM e o WHERE o.event_id <> e.event_id AND (
    (o.mag >= 6 AND o.at BETWEEN e.at - 2700 AND e.at + 1300) OR (o.mag >= 5 AND o.at BETWEEN e.at - 300 AND e.at + 1300
     AND degrees(2 * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(o.lat - e.lat) / 2), 2) + cos(radians(e.lat))
       * cos(radians(o.lat)) * pow(sin(radians(o.lon - e.lon) / 2), 2))))) <= 15)))""")
def contamination_screen(spark, sf):
    clean = match.uncontaminated(quakes(spark, sf), wide=(2700, 1300), wide_mag=6.0, near=(300, 1300), near_mag=5.0,
                                 degrees=15.0)
    return clean.select("event_id", F.col("at").alias("origin_s"), rnd("mag").alias("mag"))


@registered("interval_event_counts", sql="WITH " + CONT_SQL.replace("epoch(ts)::BIGINT", "epoch_us(ts) // 1000000") + """
SELECT e.event_id, count(o.event_id) AS n FROM e LEFT JOIN e o ON o.mag >= 5 AND o.at BETWEEN e.at - 2700 AND e.at + 1300
GROUP BY 1""")
def interval_event_counts(spark, sf):
    q = quakes(spark, sf).withColumn("all", F.lit(1))
    ids = q.select("event_id", (F.col("at") - 2700).alias("lo"), (F.col("at") + 1300).alias("hi"), "all")
    return match.interval_counts(ids, q.where("mag >= 5").select("at", "all"), ["all"], "lo", "hi", "at", "event_id")


@registered("largest_events", sql="""SELECT event_id, round(value, 6) AS magnitude, epoch_us(ts) AS at FROM events
ORDER BY value DESC, ts, event_id LIMIT 40""")
def largest_events(spark, sf):
    e = match.top_rows(table(spark, sf, "events"), 40, F.col("value").desc(), F.col("ts"), F.col("event_id"))
    return e.select("event_id", rnd("value").alias("magnitude"), micros("ts").alias("at"))


@registered("pick_selection", sql="""WITH p AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_returnflag = 'A' AND l_linestatus = 'O' AND o_orderstatus <> 'F' AS pref
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE lower(l_returnflag) IN ('a', 'n'))
SELECT l_orderkey, arg_min(l_linenumber::BIGINT * 1000000000 + l_partkey, (NOT pref, l_shipdate, l_linenumber::BIGINT * 1000000000 + l_partkey)) AS pick_id,
       count(*) AS candidate_p_pick_count, count(*) FILTER (pref) AS preferred_pick_count,
       bool_or(pref) AS pick_selected_from_preferred_origin_arrival FROM p GROUP BY 1""")
def pick_selection(spark, sf):
    li = table(spark, sf, "lineitem").where(F.upper("l_returnflag").isin("A", "N"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    p = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        "l_orderkey", (F.col("l_linenumber").cast("bigint") * 1000000000 + F.col("l_partkey")).alias("pick_id"),
        F.col("l_shipdate").alias("at"),
        ((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O") & (F.col("o_orderstatus") != "F")).alias(
            "preferred"))
    return match.select_picks(p, "l_orderkey").drop("pick_at")


@registered("preferred_origin", sql="""WITH o AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, l_linenumber = l_orderkey % 7 + 1 AS pref FROM lineitem)
SELECT l_orderkey, arg_min(l_suppkey, (NOT pref, l_linenumber, l_suppkey)) AS origin_id, bool_or(pref) AS is_preferred
FROM o GROUP BY 1""")
def preferred_origin(spark, sf):
    pref = F.col("l_linenumber") == F.col("l_orderkey") % 7 + 1
    best = F.min(F.struct((~pref).alias("np"), "l_linenumber", "l_suppkey"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(best.alias("b")).select(
        "l_orderkey", F.col("b.l_suppkey").alias("origin_id"), (~F.col("b.np")).alias("is_preferred"))


@registered("differential_arrival", sql="""SELECT l_orderkey, date_diff('day', min(l_shipdate) FILTER (l_returnflag = 'A'),
  min(l_shipdate) FILTER (l_returnflag = 'N'))::BIGINT AS diff_days FROM lineitem GROUP BY 1""")
def differential_arrival(spark, sf):
    first = lambda f: F.min(F.when(F.col("l_returnflag") == f, F.col("l_shipdate")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        big(F.date_diff(first("N"), first("A"))).alias("diff_days"))


@registered("representative_three", sql="""SELECT user_id, event_id, rn::BIGINT AS place FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'purchase', ts, event_id) AS rn
  FROM events) WHERE rn <= 3""")
def representative_three(spark, sf):
    from pyspark.sql import Window

    # The row limit reaches below the shuffle: every task forwards at most three rows per user.
    w = Window.partitionBy("user_id").orderBy(F.col("event_type") != "purchase", "ts", "event_id")
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    e = e.withColumn("place", F.row_number().over(w)).where("place <= 3")
    return e.select("user_id", "event_id", big("place").alias("place"))


@registered("event_token_regex", sql="""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'event ' || tk || ' seen'
    WHEN 1 THEN 'x' || tk || ',' || tk WHEN 2 THEN tk || '_b ' || tk || '9' ELSE tk || '  ' || tk END AS s
  FROM (SELECT event_id, """ + TOKEN_SQL.format("event_id % 10000") + """ AS tk FROM events))
SELECT event_id, len(regexp_extract_all(replace(replace(s, ' ', '  '), ',', ',,'),
  '(^|[^A-Za-z0-9_])([A-Z][0-9]{4}[a-z])($|[^A-Za-z0-9_])', 2))::BIGINT AS tokens FROM t""")
def event_token_regex(spark, sf):
    tk, k = token(F.col("event_id") % 10000), F.col("event_id") % 4
    s = (F.when(k == 0, F.concat(F.lit("event "), tk, F.lit(" seen"))).when(k == 1, F.concat(F.lit("x"), tk, F.lit(","), tk))
         .when(k == 2, F.concat(tk, F.lit("_b "), tk, F.lit("9"))).otherwise(F.concat(tk, F.lit("  "), tk)))
    return table(spark, sf, "events").select("event_id", big(F.size(text.event_tokens(s))).alias("tokens"))


@registered("href_extraction", sql="""SELECT page_id, i::BIGINT AS pos, list_extract(h, i) AS href,
  regexp_matches(list_extract(h, i), '\\.(xml|mseed)$') AS is_data
FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages), range(1, 1000) r(i) WHERE i <= len(h)""")
def href_extraction(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.posexplode(text.hrefs(F.col("html"))).alias("i", "href"))
    return p.select("page_id", big(F.col("i") + 1).alias("pos"), "href", F.col("href").rlike(r"\.(xml|mseed)$").alias("is_data"))


@registered("url_lane_parse", sql="""WITH p AS (
  SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN 'paperfaith/waveform/' || l_returnflag || '/nth_root_win'
      || l_quantity::INT || '.npz' WHEN 1 THEN 'alt/envelope/' || l_returnflag || '/linear_win' || l_quantity::INT || '_x.npz'
      WHEN 2 THEN 'broad/pws_' || l_quantity::INT || '.npz' WHEN 3 THEN 'solo.npz'
      ELSE 'm/i/' || l_returnflag || '/plain_method.npz' END AS path FROM lineitem), s AS (
  SELECT *, string_split(path, '/') AS parts, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem FROM p), q AS (
  SELECT *, regexp_extract(stem, '^(.+?)_win(\\d+)', 1) AS m, regexp_extract(stem, '^(.+?)_win(\\d+)', 2) AS w,
         try_cast(regexp_extract(stem, '^(.*)_([^_]+)$', 2) AS DOUBLE) AS tail FROM s)
SELECT CASE WHEN len(parts) >= 4 THEN parts[1] WHEN len(parts) >= 2 THEN parts[-2] ELSE 'unknown' END AS mode,
       CASE WHEN len(parts) >= 4 THEN parts[2] ELSE '' END AS input_type,
       CASE WHEN len(parts) >= 4 THEN parts[3] ELSE '' END AS norm_variant,
       CASE WHEN w <> '' THEN m WHEN tail IS NOT NULL THEN regexp_extract(stem, '^(.*)_([^_]+)$', 1) ELSE stem END AS stack_method,
       CASE WHEN w <> '' THEN w::DOUBLE ELSE tail END AS power_window_s, count(*) AS n FROM q GROUP BY 1, 2, 3, 4, 5""")
def url_lane_parse(spark, sf):
    k, rf, q = F.col("l_linenumber") % 5, F.col("l_returnflag"), F.col("l_quantity").cast("int")
    cat = lambda *a: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in a])
    path = (F.when(k == 0, cat("paperfaith/waveform/", rf, "/nth_root_win", q, ".npz"))
            .when(k == 1, cat("alt/envelope/", rf, "/linear_win", q, "_x.npz"))
            .when(k == 2, cat("broad/pws_", q, ".npz")).when(k == 3, F.lit("solo.npz"))
            .otherwise(cat("m/i/", rf, "/plain_method.npz")))
    p = table(spark, sf, "lineitem").select(path.alias("path"))
    lane = text.lane_path(F.col("path"))
    return p.select(*[c.alias(n) for n, c in lane.items()]).groupBy(*lane).agg(F.count("*").alias("n"))


@registered("json_nested_fallback", sql="""SELECT event_id, coalesce(json_extract_string(props, '$.meta.k'),
  json_extract_string(props, '$.k'), 'unknown') AS k, json_extract_string(props, '$.k')::INT % 3 = 0 AS flagged FROM events""")
def json_nested_fallback(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select(
        "event_id", F.coalesce(F.get_json_object("props", "$.meta.k"), k, F.lit("unknown")).alias("k"),
        (k.cast("int") % 3 == 0).alias("flagged"))


@registered("loose_value_predicates", sql="""WITH v AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '  '
  WHEN 2 THEN 'nan' WHEN 3 THEN ' ' || value || ' ' WHEN 4 THEN 'inf' ELSE 'abc' END AS s FROM events)
SELECT event_id, s IS NULL OR trim(s) = '' OR lower(trim(s)) = 'nan' AS is_empty,
       CASE WHEN isfinite(try_cast(trim(s) AS DOUBLE)) THEN round(try_cast(trim(s) AS DOUBLE), 6) END AS number FROM v""")
def loose_value_predicates(spark, sf):
    k = F.col("event_id") % 6
    s = (F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit("  ")).when(k == 2, F.lit("nan"))
         .when(k == 3, F.concat(F.lit(" "), F.col("value"), F.lit(" "))).when(k == 4, F.lit("inf")).otherwise(F.lit("abc")))
    e = table(spark, sf, "events").select("event_id", s.alias("s"))
    return e.select("event_id", text.is_empty(F.col("s")).alias("is_empty"), rnd(text.finite(F.trim("s"))).alias("number"))


@registered("realisation_spec_expansion", sql="""WITH s AS (SELECT c_custkey, c_custkey % 40 AS a FROM customer)
SELECT c_custkey, v::BIGINT AS realisation FROM (SELECT c_custkey, 0 AS v FROM s UNION
  SELECT c_custkey, a + k FROM s, range(4) r(k) UNION SELECT c_custkey, 7 FROM s)""")
def realisation_spec_expansion(spark, sf):
    a = F.col("c_custkey") % 40
    spec = F.concat(F.lit("identity, "), a, F.lit("-"), a + 3, F.lit(",7"))
    c = table(spark, sf, "customer").select("c_custkey", F.explode(text.expand_spec(spec)).alias("r"))
    return c.select("c_custkey", big("r").alias("realisation"))


@registered("composite_text_hash", sql="""SELECT doc_id, sha256('text' || chr(0) || sha256(text) || chr(10) || 'meta' || chr(0)
  || sha256(lang || '|' || source) || chr(10)) AS digest FROM documents""")
def composite_text_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.composite_hash(
        ("text", F.sha2("text", 256)), ("meta", F.sha2(F.concat_ws("|", "lang", "source"), 256))).alias("digest"))


@registered("data_row_counts", sql="""SELECT doc_id, count(*) FILTER (ltrim(l) <> '' AND NOT starts_with(ltrim(l), '#')
  AND NOT starts_with(ltrim(l), '-') AND NOT starts_with(ltrim(l), 'NUM')) AS data_rows, count(*) AS lines
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1""")
def data_row_counts(spark, sf):
    lines = F.split("text", "\n")
    return table(spark, sf, "documents").select(
        "doc_id", big(F.size(F.filter(lines, text.is_data_row))).alias("data_rows"), big(F.size(lines)).alias("lines"))


@registered("identity_table_scan", sql="""SELECT s_name AS locator, sha256(s_name) AS digest, s_nationkey::VARCHAR AS role,
  true AS valid_digest FROM supplier""")
def identity_table_scan(spark, sf):
    """Pipe-table lines written from the suppliers and read back as cells."""
    line = F.concat(F.lit("| `"), F.col("s_name"), F.lit("` | "), F.sha2("s_name", 256), F.lit(" | "),
                    F.col("s_nationkey"), F.lit(" |"))
    c = table(spark, sf, "supplier").select(text.table_cells(line).alias("c"))
    return c.select(F.col("c")[0].alias("locator"), F.col("c")[1].alias("digest"), F.col("c")[2].alias("role"),
                    text.is_sha256(F.col("c")[1]).alias("valid_digest"))


@registered("pin_line_scan", sql="""SELECT p_partkey, sha256(p_name) AS digest, 'part/' || p_partkey || '.bin' AS locator,
  p_partkey % 3 = 0 AS is_pin FROM part""")
def pin_line_scan(spark, sf):
    line = F.concat(F.when(F.col("p_partkey") % 3 == 0, "# pin ").otherwise(""), F.sha2("p_name", 256), F.lit("  part/"),
                    F.col("p_partkey"), F.lit(".bin"))
    p = table(spark, sf, "part").select("p_partkey", line.alias("l"))
    return p.select(
        "p_partkey", F.regexp_extract("l", r"([0-9a-f]{64})\s+(\S+)$", 1).alias("digest"),
        F.regexp_extract("l", r"([0-9a-f]{64})\s+(\S+)$", 2).alias("locator"), F.col("l").rlike("^# pin ").alias("is_pin"))


@registered("path_null_type", sql="""SELECT CASE l_linenumber % 3 WHEN 0 THEN 'n1' WHEN 1 THEN 'n2' ELSE 'real' END AS null_type,
  count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY 1""")
def path_null_type(spark, sf):
    k = F.col("l_linenumber") % 3
    path = F.concat(F.lit("runs/"), F.when(k == 0, "nulls/n1").when(k == 1, "nulls/n2").otherwise("real"),
                    F.lit("/stats_k"), F.col("l_suppkey"), F.lit(".csv"))
    null = F.coalesce(F.nullif(F.regexp_extract("p", r"/nulls/([^/]+)/", 1), F.lit("")), F.lit("real"))
    li = table(spark, sf, "lineitem").select(path.alias("p"), "l_quantity")
    return li.groupBy(null.alias("null_type")).agg(F.count("*").alias("n"), rnd(F.avg("l_quantity")).alias("mean_quantity"))


@registered("model_variant_names", sql="""SELECT p_partkey, list_filter(regexp_extract_all(lower(
   p_name || ' ETH_' || p_size || '.nd x_ipgp' || p_size || '.nd ' || p_brand || '.nd'), '[a-z0-9_#]+\\.nd'),
   lambda v: contains(v, 'eth') OR contains(v, 'ipgp')) AS variants FROM part""".replace("SELECT p_partkey,", "SELECT p_partkey, array_to_string(").replace(" AS variants", ", ',') AS variants"))
def model_variant_names(spark, sf):
    s = F.lower(F.concat_ws("", "p_name", F.lit(" ETH_"), "p_size", F.lit(".nd x_ipgp"), "p_size", F.lit(".nd "),
                            "p_brand", F.lit(".nd")))
    names = F.regexp_extract_all(s, F.lit(r"([a-z0-9_#]+\.nd)"), F.lit(1))
    keep = F.filter(names, lambda v: v.contains("eth") | v.contains("ipgp"))
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(",", keep).alias("variants"))


@registered("generated_cache_exclusion", sql="""WITH f AS (SELECT p_partkey, 'm/' || p_size || '_' || p_partkey // 4 AS stem,
   CASE p_partkey % 4 WHEN 0 THEN '.nd' WHEN 1 THEN '.npz' WHEN 2 THEN '.npz.lock' ELSE '.npz.invalid' END AS ext FROM part)
SELECT stem || ext AS path FROM f WHERE ext NOT IN ('.npz.lock', '.npz.invalid')
  AND NOT (ext = '.npz' AND stem IN (SELECT stem FROM f WHERE ext = '.nd'))""")
def generated_cache_exclusion(spark, sf):
    k = F.col("p_partkey") % 4
    ext = F.when(k == 0, ".nd").when(k == 1, ".npz").when(k == 2, ".npz.lock").otherwise(".npz.invalid")
    stem = F.concat(F.lit("m/"), F.col("p_size"), F.lit("_"), F.floor(F.col("p_partkey") / 4))
    f = table(spark, sf, "part").select(stem.alias("stem"), ext.alias("ext"))
    live = f.where(~F.col("ext").isin(".npz.lock", ".npz.invalid"))
    models = f.where("ext = '.nd'").select(F.col("stem").alias("nd_stem"))
    on = (F.col("stem") == F.col("nd_stem")) & (F.col("ext") == ".npz")
    return live.join(models, on, "left_anti").select(F.concat("stem", "ext").alias("path"))


@registered("target_window_status", sql="""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 30 - 100 AS dt,
  l_discount * 20 - 1.5 - l_tax * 100 AS dp FROM lineitem)
SELECT CASE WHEN dt < 50 OR dt > 1100 THEN 'excluded_time' WHEN dp < -10 OR dp > -0.5 THEN 'excluded_slowness' ELSE 'kept' END
  AS status, count(*) AS n FROM t GROUP BY 1""")
def target_window_status(spark, sf):
    dt = F.col("l_quantity") * 30 - 100
    dp = F.col("l_discount") * 20 - 1.5 - F.col("l_tax") * 100
    s = F.when(~dt.between(50, 1100), "excluded_time").when(~dp.between(-10.0, -0.5), "excluded_slowness").otherwise("kept")
    return table(spark, sf, "lineitem").groupBy(s.alias("status")).agg(F.count("*").alias("n"))


@registered("lane_selector_unique", sql="""SELECT l_orderkey, count(*) FILTER (l_linenumber = 1 AND l_returnflag = 'A') AS candidates,
  CASE count(*) FILTER (l_linenumber = 1 AND l_returnflag = 'A') WHEN 1 THEN 'ok' WHEN 0 THEN 'absent' ELSE 'ambiguous' END AS status
FROM lineitem GROUP BY 1""")
def lane_selector_unique(spark, sf):
    n = F.count_if((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "A"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        n.alias("candidates"), F.when(n == 1, "ok").when(n == 0, "absent").otherwise("ambiguous").alias("status"))


@registered("membership_melt", sql="""SELECT c_custkey, label FROM (
  SELECT c_custkey, unnest(['rich', 'building', 'low_key']) AS label,
         unnest([c_acctbal > 5000, c_mktsegment = 'BUILDING', c_custkey < 500]) AS member FROM customer) WHERE member""")
def membership_melt(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_acctbal") > 5000).alias("rich"), (F.col("c_mktsegment") == "BUILDING").alias("building"),
        (F.col("c_custkey") < 500).alias("low_key"))
    return c.unpivot("c_custkey", ["rich", "building", "low_key"], "label", "member").where("member").drop("member")


@registered("source_fallback_cascade", sql="""SELECT page_id, CASE WHEN starts_with(html, '<?xml') THEN 'xml'
    WHEN starts_with(html, '<!DOCTYPE html') THEN 'html' ELSE 'unknown' END AS sniffed,
  coalesce(CASE WHEN contains(url, '?') THEN NULL ELSE url END, regexp_extract(url, '^([^?]*)', 1)) AS chosen,
  CASE WHEN contains(url, '?') THEN 2 ELSE 1 END::BIGINT AS attempt FROM pages""")
def source_fallback_cascade(spark, sf):
    """First source that answers wins; the body's opening says what it is."""
    direct = F.when(~F.col("url").contains("?"), F.col("url"))
    bare = F.regexp_extract("url", r"^([^?]*)", 1)
    sniff = F.when(F.col("html").startswith("<?xml"), "xml").when(
        F.col("html").startswith("<!DOCTYPE html"), "html").otherwise("unknown")
    return table(spark, sf, "pages").select(
        "page_id", sniff.alias("sniffed"), F.coalesce(direct, bare).alias("chosen"),
        F.when(direct.isNull(), 2).otherwise(1).cast("bigint").alias("attempt"))


@registered("quakeml_catalogue_picks", sql="""SELECT event_id, 'smi:' || event_id AS resource_id,
  CASE WHEN event_id % 2 = 0 THEN 'p' ELSE 'S' END = 'p' AS has_p_pick, 1::BIGINT AS origins FROM events""")
def quakeml_catalogue_picks(spark, sf):
    """QuakeML documents, one per event, parsed with the XML reader's schema."""
    from beamspark.sources.readers import parse_quakeml

    xml = F.concat(
        F.lit('<event publicID="smi:'), F.col("event_id"), F.lit('"><description><text>quake</text></description>'
              '<preferredOriginID>o</preferredOriginID><origin publicID="o"><time><value>2024-01-01T00:00:00Z</value></time>'
              '<arrival><pickID>k</pickID><phase>P</phase></arrival></origin><pick publicID="k"><phaseHint>'),
        F.when(F.col("event_id") % 2 == 0, "p").otherwise("S"),
        F.lit('</phaseHint><time><value>2024-01-01T00:00:01Z</value></time><waveformID networkCode="XB" '
              'stationCode="ELYSE"/></pick></event>'))
    q = parse_quakeml(table(spark, sf, "events").select("event_id", xml.alias("xml")), "xml", ["event_id"])
    p = F.exists("picks", lambda k: (F.upper(k["phase_hint"]) == "P") & (k["waveform_id"]["network_code"] == "XB"))
    return q.select("event_id", "resource_id", p.alias("has_p_pick"), big(F.size("origins")).alias("origins"))
