"""Provenance, manifest, registry and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from beamspark import dims
from beamspark.functions import text
from beamspark.operators import audit, report
from beamspark.plans.registry import big, registered, rnd, table

PATH_SQL = "source || '/' || lang || '/' || doc_id % 700"


def _path_str():
    return F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id") % 700)


MANIFEST_SQL = "man AS (SELECT doc_id AS ord, " + PATH_SQL + """ AS path,
  CASE WHEN doc_id % 13 = 0 THEN '' ELSE sha256(text) END AS sha FROM documents), dig AS (
  SELECT path, arg_max(sha, ord) FILTER (sha <> '') AS pinned, count(*) AS entries FROM man GROUP BY 1), act AS (
  SELECT path, arg_max(h, doc_id) AS actual FROM (SELECT doc_id, """ + PATH_SQL + """ AS path,
     sha256(CASE WHEN doc_id % 17 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 19 <> 0) GROUP BY 1),
exp AS (SELECT DISTINCT CASE WHEN doc_id % 29 = 0 THEN '../' ELSE '' END || """ + PATH_SQL + """ AS path FROM documents), aud AS (
  SELECT path, coalesce(entries, 0) AS entries, CASE WHEN path LIKE '../%' THEN 'unsafe_path' WHEN pinned IS NULL THEN 'unpinned'
    WHEN actual IS NULL THEN 'missing_file' WHEN pinned <> actual THEN 'checksum_mismatch' ELSE 'ok' END AS status
  FROM exp LEFT JOIN dig USING (path) LEFT JOIN act USING (path))"""


def _audit(spark, sf):
    d = table(spark, sf, "documents")
    man = d.select(F.col("doc_id").alias("ord"), _path_str().alias("path"),
                   F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.sha2("text", 256)).alias("sha256"))
    body = F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    act = d.where(F.col("doc_id") % 19 != 0).groupBy(_path_str().alias("path")).agg(
        F.max(F.struct("doc_id", F.sha2(body, 256).alias("h")))["h"].alias("sha256"))
    prefix = F.when(F.col("doc_id") % 29 == 0, "../").otherwise("")
    exp = d.select(F.concat(prefix, _path_str()).alias("path")).distinct()
    return audit.audit_inputs(exp, man, act)


@registered("manifest_audit", sql="WITH " + MANIFEST_SQL + " SELECT path, entries, status FROM aud")
def manifest_audit(spark, sf):
    return _audit(spark, sf).select("path", F.coalesce("entries", F.lit(0)).cast("bigint").alias("entries"), "status")


@registered("manifest_status_counts", sql="WITH " + MANIFEST_SQL + """
SELECT coalesce(split_part(ltrim(path, './'), '/', 1), 'all') AS source, status, count(*) AS n FROM aud
GROUP BY ROLLUP (split_part(ltrim(path, './'), '/', 1), status)""")
def manifest_status_counts(spark, sf):
    a = _audit(spark, sf).select(F.split_part(F.regexp_replace("path", r"^[./]+", ""), F.lit("/"), F.lit(1)).alias("src"), "status")
    return a.rollup("src", "status").agg(F.count("*").alias("n")).select(
        F.coalesce("src", F.lit("all")).alias("source"), "status", "n")


@registered("first_violations", sql="WITH " + MANIFEST_SQL + """
SELECT path, status FROM aud WHERE status <> 'ok' ORDER BY path, status LIMIT 20""")
def first_violations(spark, sf):
    return audit.first_violations(_audit(spark, sf), 20)


@registered("dataset_stage_audit", sql="WITH " + MANIFEST_SQL + """, ds AS (
  SELECT source, count(DISTINCT path) FILTER (sha <> '') AS paths_with_checksum,
         bool_or(doc_id % 41 = 0) AS has_marker
  FROM (SELECT source, doc_id, """ + PATH_SQL + """ AS path, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'x' END AS sha FROM documents)
  GROUP BY 1)
SELECT source, paths_with_checksum, has_marker,
       CASE WHEN NOT has_marker THEN 'missing_marker' WHEN paths_with_checksum = 0 THEN 'no_checksums' ELSE 'ok' END AS status FROM ds""")
def dataset_stage_audit(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", _path_str().alias("path"))
    # One row per path first, so a large source never keeps a set of its paths in one task.
    per = d.groupBy("source", "path").agg(
        F.bool_or(F.col("doc_id") % 13 != 0).alias("pinned"), F.bool_or(F.col("doc_id") % 41 == 0).alias("mark"))
    g = per.groupBy("source").agg(F.count_if("pinned").alias("paths_with_checksum"), F.bool_or("mark").alias("has_marker"))
    return g.withColumn("status", F.when(~F.col("has_marker"), "missing_marker").when(
        F.col("paths_with_checksum") == 0, "no_checksums").otherwise("ok"))


@registered("path_hash_arrays", sql="""WITH z AS (
  SELECT o_orderkey, o_custkey, o_orderkey % 23 = 0 AS short, o_orderkey % 10 = 0 AS bad FROM orders), c AS (
  SELECT c_custkey FROM customer)
SELECT o_orderkey, CASE WHEN short THEN 0 ELSE 2 END::BIGINT AS checked_pairs,
  CASE WHEN short THEN 0 ELSE (CASE WHEN bad OR a.c_custkey IS NULL THEN 1 ELSE 0 END) + (CASE WHEN b.c_custkey IS NULL THEN 1 ELSE 0 END)
    END::BIGINT AS errors,
  CASE WHEN short THEN 'blocked_missing_current_provenance' WHEN bad OR a.c_custkey IS NULL OR b.c_custkey IS NULL
       THEN 'blocked_stale_provenance' ELSE 'current' END AS status
FROM z LEFT JOIN c a ON a.c_custkey = o_custkey LEFT JOIN c b ON b.c_custkey = o_custkey + 1""")
def path_hash_arrays(spark, sf):
    k = F.col("o_custkey")
    digest = lambda c: F.sha2(c.cast("string"), 256)
    first = F.when(F.col("o_orderkey") % 10 == 0, F.lit("stale")).otherwise(digest(k))
    hashes = F.when(F.col("o_orderkey") % 23 == 0, F.array(first)).otherwise(F.array(first, digest(k + 1)))
    o = table(spark, sf, "orders").select("o_orderkey", F.array(k.cast("string"), (k + 1).cast("string")).alias("paths"),
                                          hashes.alias("hashes"))
    known = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("path"),
                                                digest(F.col("c_custkey")).alias("sha256"))
    return audit.verify_path_hash_arrays(o, "o_orderkey", known)


@registered("identity_transplant", sql="""WITH i AS (
  SELECT c_custkey, 'loc' || c_custkey AS locator, sha256((CASE WHEN c_custkey % 11 = 0 THEN c_custkey + 1 WHEN c_custkey % 7 = 0
     THEN -1 ELSE c_custkey END)::VARCHAR) AS digest FROM customer), p AS (
  SELECT 'loc' || c_custkey AS locator, sha256(c_custkey::VARCHAR) AS digest FROM customer WHERE c_custkey % 5 <> 0)
SELECT c_custkey, CASE WHEN p.digest = i.digest THEN 'match' WHEN i.digest IN (SELECT digest FROM p) THEN 'transplanted_digest'
  WHEN p.digest IS NULL THEN 'missing_pin' ELSE 'digest_mismatch' END AS status FROM i LEFT JOIN p USING (locator)""")
def identity_transplant(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    claim = F.when(k % 11 == 0, k + 1).when(k % 7 == 0, F.lit(-1)).otherwise(k)
    ident = c.select(k, F.concat(F.lit("loc"), k).alias("locator"), F.sha2(claim.cast("string"), 256).alias("digest"))
    pins = c.where(k % 5 != 0).select(F.concat(F.lit("loc"), k).alias("locator"), F.sha2(k.cast("string"), 256).alias("digest"))
    return audit.transplanted(ident, pins).select("c_custkey", "status")


@registered("upstream_source_match", sql="""WITH p AS (
  SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) AS source, regexp_extract(url, 'https?://[^/]+(/[^?]*)', 1) AS path FROM pages), u AS (
  SELECT page_id AS rid, source, path FROM p WHERE page_id % 2 = 1 AND page_id % 4 <> 3), r AS (SELECT * FROM p WHERE page_id % 2 = 0), rp AS (
  SELECT path, min(rid) AS rid FROM u GROUP BY 1), us AS (
  SELECT r.source, min(u.rid) AS rid FROM (SELECT DISTINCT source FROM r) r JOIN u ON u.source <> '' AND contains(r.source, u.source) GROUP BY 1)
SELECT r.page_id, coalesce(rp.rid, us.rid) AS matched, CASE WHEN rp.rid IS NOT NULL THEN 'path' WHEN us.rid IS NOT NULL THEN 'source'
  ELSE 'none' END AS matched_by FROM r LEFT JOIN rp USING (path) LEFT JOIN us ON us.source = r.source""")
def upstream_source_match(spark, sf):
    """Registered rows against upstream rows: by whole path, else by an upstream source that the registered one contains."""
    url = F.col("url")
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract(url, r"https?://([^/]+)", 1).alias("source"),
                                         F.regexp_extract(url, r"https?://[^/]+(/[^?]*)", 1).alias("path"))
    upstream = p.where((F.col("page_id") % 2 == 1) & (F.col("page_id") % 4 != 3)).withColumnRenamed("page_id", "rid")
    registered_rows = p.where(F.col("page_id") % 2 == 0)
    return audit.upstream_matches(registered_rows, upstream).select("page_id", "matched", "matched_by")


RUNS_SQL = """a AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS v FROM lineitem WHERE l_suppkey % 10 <> 3 GROUP BY 1, 2), b AS (
  SELECT l_orderkey, l_linenumber, sum(CASE WHEN l_partkey % 50 = 0 THEN l_quantity + 1 ELSE l_quantity END) AS v
  FROM lineitem WHERE l_suppkey % 10 <> 4 GROUP BY 1, 2)"""


@registered("run_comparison", sql="WITH " + RUNS_SQL + """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, b.v - a.v AS delta, CASE WHEN b.v IS NULL THEN 'missing' WHEN a.v IS NULL THEN 'extra'
  WHEN abs(b.v - a.v) <= 0.001 THEN 'same' ELSE 'changed' END AS status
FROM a FULL JOIN b USING (l_orderkey, l_linenumber)""")
def run_comparison(spark, sf):
    li = table(spark, sf, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    old = li.where(F.col("l_suppkey") % 10 != 3).groupBy(*keys).agg(F.sum("l_quantity").alias("v"))
    moved = F.when(F.col("l_partkey") % 50 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    new = li.where(F.col("l_suppkey") % 10 != 4).groupBy(*keys).agg(F.sum(moved).alias("v"))
    return audit.compare_keyed(old, new, keys, "v", 0.001).withColumn("l_linenumber", big("l_linenumber"))


@registered("duplicate_keys", sql="""SELECT l_suppkey, l_linenumber::BIGINT AS l_linenumber, l_returnflag, l_linestatus, count(*) AS n
FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    d = audit.duplicate_keys(table(spark, sf, "lineitem"), ["l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"])
    return d.withColumn("l_linenumber", big("l_linenumber"))


@registered("set_relations", sql="""WITH s AS (SELECT c_custkey AS k, true AS a, false AS b, false AS c FROM customer UNION ALL
  SELECT o_custkey, false, true, false FROM orders UNION ALL
  SELECT o_custkey, false, false, true FROM orders WHERE o_orderpriority = '1-URGENT'), g AS (
  SELECT k, bool_or(a) AS a, bool_or(b) AS b, bool_or(c) AS c FROM s GROUP BY 1), r AS (
  SELECT 'customers' AS a, 'ordered' AS b, count(*) FILTER (a AND b) AS shared, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM g UNION ALL
  SELECT 'customers', 'urgent', count(*) FILTER (a AND c), count(*) FILTER (a AND NOT c), count(*) FILTER (c AND NOT a) FROM g UNION ALL
  SELECT 'ordered', 'urgent', count(*) FILTER (b AND c), count(*) FILTER (b AND NOT c), count(*) FILTER (c AND NOT b) FROM g)
SELECT *, only_a = 0 AND only_b = 0 AS equal, only_a = 0 AS a_subset_b FROM r""")
def set_relations(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority")
    return audit.set_comparison(
        {"customers": c, "ordered": o.select("k"), "urgent": o.where("o_orderpriority = '1-URGENT'").select("k")}, "k")


@registered("set_operations", sql="""SELECT 'union' AS op, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'error' UNION
    SELECT user_id FROM events WHERE value > 100) UNION ALL
  SELECT 'intersect', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE value > 100)
  UNION ALL SELECT 'except', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'error' EXCEPT SELECT user_id FROM events WHERE value > 100)""")
def set_operations(spark, sf):
    e = table(spark, sf, "events")
    a, b = e.where("event_type = 'error'").select("user_id"), e.where("value > 100").select("user_id")
    count = lambda d, op: d.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(a.union(b).distinct(), "union").unionByName(count(a.intersect(b), "intersect")).unionByName(
        count(a.subtract(b), "except"))


@registered("unknown_status_values", sql="""SELECT event_type AS status, count(*) AS n, event_type IN ('view', 'click', 'purchase') AS known
FROM events GROUP BY 1""")
def unknown_status_values(spark, sf):
    return audit.status_counts(table(spark, sf, "events").select(F.col("event_type").alias("status")), "status").withColumn(
        "known", F.col("status").isin("view", "click", "purchase"))


CHAIN_SQL = """l0 AS (SELECT doc_id, sha256(text) AS h FROM documents), l1 AS (
  SELECT doc_id, sha256(h || 'band') AS h, CASE WHEN doc_id % 11 = 0 THEN 'stale' ELSE h END AS u FROM l0), l2 AS (
  SELECT doc_id, sha256(h || 'align') AS h, CASE WHEN doc_id % 13 = 0 THEN 'stale' ELSE h END AS u FROM l1 WHERE doc_id % 17 <> 0), l3 AS (
  SELECT doc_id, sha256(h || 'norm') AS h, h AS u FROM l2)"""


@registered("provenance_hash_chain", sql="WITH " + CHAIN_SQL + """
SELECT doc_id, CASE WHEN l1.u <> l0.h THEN 1 WHEN l2.u IS NULL OR l2.u <> l1.h THEN 2 WHEN l3.u IS NULL OR l3.u <> l2.h THEN 3 END::BIGINT
  AS first_broken_level,
  CASE WHEN l1.u <> l0.h OR l2.u IS NULL OR l2.u <> l1.h OR l3.u IS NULL OR l3.u <> l2.h THEN 'blocked_stale_provenance'
  ELSE 'current' END AS status FROM l0 LEFT JOIN l1 USING (doc_id) LEFT JOIN l2 USING (doc_id) LEFT JOIN l3 USING (doc_id)""")
def provenance_hash_chain(spark, sf):
    k = F.col("doc_id")
    l0 = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))

    def step(prev, name, stale):
        up = F.when(stale, "stale").otherwise(F.col("sha256"))
        return prev.select("doc_id", F.sha2(F.concat("sha256", F.lit(name)), 256).alias("sha256"), up.alias("upstream_sha256"))

    l1 = step(l0, "band", k % 11 == 0)
    l2 = step(l1, "align", k % 13 == 0).where(k % 17 != 0)
    l3 = step(l2, "norm", F.lit(False))
    c = audit.hash_chain([l0, l1, l2, l3], "doc_id")
    return c.withColumn("first_broken_level", big("first_broken_level"))


@registered("canonical_parameters", sql="""SELECT l_returnflag, l_linestatus, count(*) AS n,
  count(*) FILTER (abs(l_tax - 0.05) > 1e-6) AS off_canonical, bool_and(abs(l_discount - round(l_discount, 2)) <= 1e-6) AS all_on_grid
FROM lineitem GROUP BY 1, 2""")
def canonical_parameters(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.count_if(F.abs(F.col("l_tax") - 0.05) > 1e-6).alias("off_canonical"),
        F.bool_and(F.abs(F.col("l_discount") - F.round("l_discount", 2)) <= 1e-6).alias("all_on_grid"))


@registered("lane_identity_status", sql="""WITH p AS (SELECT l_returnflag AS v, CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE l_returnflag END AS pv,
   l_quantity AS w, CASE WHEN l_suppkey % 14 = 0 THEN ' ' || (l_quantity + 1)::INT WHEN l_suppkey % 5 = 0 THEN ' ' || l_quantity::INT ELSE l_quantity::VARCHAR END AS pw
  FROM lineitem)
SELECT CASE WHEN trim(pv) = '' THEN 'blocked_missing_current_provenance' WHEN trim(pv) <> v THEN 'blocked_lane_identity_mismatch'
   WHEN try_cast(trim(pw) AS DOUBLE) <> w THEN 'blocked_lane_identity_mismatch' ELSE 'ok' END AS status, count(*) AS n FROM p GROUP BY 1""")
def lane_identity_status(spark, sf):
    q, s = F.col("l_quantity"), F.col("l_suppkey")
    pad = lambda c: F.concat(F.lit(" "), c.cast("int"))
    li = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("v"), F.when(s % 9 == 0, "").otherwise(F.col("l_returnflag")).alias("pv"),
        q.alias("w"), F.when(s % 14 == 0, pad(q + 1)).when(s % 5 == 0, pad(q)).otherwise(q.cast("string")).alias("pw"))
    st = audit.lane_identity(li, {"variant": ("pv", "v"), "power_window_s": ("pw", "w")}, True)
    return audit.status_counts(li.select(st.alias("status")), "status")


@registered("deglitch_state_machine", sql="""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' AND l_tax < 0.02 THEN 'blocked' ELSE 'succeeded' END AS tool,
  CASE WHEN l_linestatus = 'F' AND l_discount < 0.03 THEN '' WHEN l_discount < 0.05 THEN 'failed' ELSE 'succeeded' END AS rem,
  l_quantity > 20 AS att, l_partkey % 2 = 0 AS ev FROM lineitem)
SELECT CASE WHEN tool <> 'succeeded' THEN 'blocked_missing_seisglitch' WHEN rem = '' THEN 'succeeded_mps_only'
  WHEN rem <> 'succeeded' THEN 'ucla_unverified' WHEN att AND ev THEN 'mps_ucla_verified'
  WHEN att THEN 'sidecar_attested_not_independently_verified' ELSE 'ucla_unverified' END AS status, count(*) AS n FROM r GROUP BY 1""")
def deglitch_state_machine(spark, sf):
    tool = F.when((F.col("l_returnflag") == "N") & (F.col("l_tax") < 0.02), "blocked").otherwise("succeeded")
    rem = F.when((F.col("l_linestatus") == "F") & (F.col("l_discount") < 0.03), "").when(
        F.col("l_discount") < 0.05, "failed").otherwise("succeeded")
    st = audit.deglitch_status(tool, rem, F.col("l_quantity") > 20, F.col("l_partkey") % 2 == 0)
    return audit.status_counts(table(spark, sf, "lineitem").select(st.alias("status")), "status")


CHECKS_SQL = """chk AS (SELECT o_orderpriority, unnest(['amounts', 'customers', 'dates', 'statuses']) AS "check",
   unnest([count(*) FILTER (NOT o_totalprice > 2000), count(*) FILTER (o_custkey IS NULL),
           count(*) FILTER (NOT o_orderdate >= TIMESTAMP '1995-02-01'), count(*) FILTER (NOT o_orderstatus IN ('F', 'O', 'P'))]) AS failures
  FROM orders GROUP BY 1)"""


def _checks(spark, sf):
    return audit.checks(table(spark, sf, "orders"), ["o_orderpriority"], {
        "amounts": F.col("o_totalprice") > 2000, "customers": F.col("o_custkey").isNotNull(),
        "dates": F.col("o_orderdate") >= F.lit("1995-02-01").cast("timestamp_ntz"),
        "statuses": F.col("o_orderstatus").isin("F", "O", "P")})


@registered("validation_checks", sql="WITH " + CHECKS_SQL + """
SELECT o_orderpriority, "check", failures, CASE WHEN failures = 0 THEN 'passed' ELSE 'failed' END AS status FROM chk""")
def validation_checks(spark, sf):
    return _checks(spark, sf)


@registered("validation_verdict", sql="WITH " + CHECKS_SQL + """
SELECT o_orderpriority, count(*) FILTER (failures > 0) AS failed, min("check") FILTER (failures > 0) AS first_failed,
       bool_and(failures = 0) AS paper_ready FROM chk GROUP BY 1""")
def validation_verdict(spark, sf):
    return audit.overall(_checks(spark, sf), ["o_orderpriority"])


@registered("registry_validation", sql="""WITH r AS (SELECT l_suppkey, l_returnflag AS branch, l_linestatus AS lane, l_tax, l_discount,
   sha256(l_orderkey::VARCHAR) AS h, CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS claim FROM lineitem)
SELECT l_suppkey, CASE WHEN min(branch) = max(branch) THEN min(branch) ELSE 'mixed' END AS branch_label,
   CASE WHEN min(lane) = max(lane) THEN min(lane) ELSE 'mixed' END AS lane_label, max(claim)::BIGINT AS top_claim,
   count(*) FILTER (NOT regexp_matches(h, '^[0-9a-f]{64}$')) AS bad_hashes, count(*) FILTER (l_discount > 0.09 AND claim = 2) AS over_claims,
   count(*) AS n FROM r GROUP BY 1""")
def registry_validation(spark, sf):
    claim = F.when(F.col("l_linestatus") == "O", 1).otherwise(2)
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        audit.consistent_label(F.col("l_returnflag")).alias("branch_label"),
        audit.consistent_label(F.col("l_linestatus")).alias("lane_label"), big(F.max(claim)).alias("top_claim"),
        F.count_if(~text.is_sha256(F.sha2(F.col("l_orderkey").cast("string"), 256))).alias("bad_hashes"),
        F.count_if((F.col("l_discount") > 0.09) & (claim == 2)).alias("over_claims"), F.count("*").alias("n"))


@registered("catalogue_drift", sql="""WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS bal,
   CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer)
SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS old, seg AS new FROM customer JOIN n USING (c_custkey)
WHERE c_mktsegment IS DISTINCT FROM seg UNION ALL
SELECT c_custkey, 'rounded_balance', round(c_acctbal, 0)::BIGINT::VARCHAR, round(bal, 0)::BIGINT::VARCHAR FROM customer JOIN n USING (c_custkey)
WHERE round(c_acctbal, 0)::BIGINT <> round(bal, 0)::BIGINT""")
def catalogue_drift(spark, sf):
    c = table(spark, sf, "customer").withColumn("rounded_balance", big(F.round("c_acctbal", 0)))
    k = F.col("c_custkey")
    new = c.select(k, F.when(k % 12 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
                   big(F.round(F.when(k % 9 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")), 0)).alias("rounded_balance"))
    return audit.unpivot_diff(c.select(k, "c_mktsegment", "rounded_balance"), new, "c_custkey", ["c_mktsegment", "rounded_balance"])


@registered("registry_build", sql="""SELECT p_partkey, p_brand AS endpoint, coalesce(q.n, 0) AS peak_rows, q.top IS NOT NULL AS has_peak,
  round(q.top, 6) AS power, CASE WHEN q.top IS NULL THEN 'not_computed' ELSE 'computed' END AS result_status
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, max(l_extendedprice) AS top FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) q
ON q.l_partkey = p_partkey""")
def registry_build(spark, sf):
    q = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count("*").alias("n"), F.max("l_extendedprice").alias("top"))
    j = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("endpoint")).join(q, "p_partkey", "left")
    return j.select("p_partkey", "endpoint", F.coalesce("n", F.lit(0).cast("bigint")).alias("peak_rows"),
                    F.col("top").isNotNull().alias("has_peak"), rnd("top").alias("power"),
                    F.when(F.col("top").isNull(), "not_computed").otherwise("computed").alias("result_status"))


@registered("mask_coverage", sql="""SELECT CASE WHEN l.doc_id IS NULL THEN 'blocked_missing_valid_mask_events' ELSE 'ok' END AS status,
  count(*) AS n, min(d.doc_id) AS first_event FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY 1""")
def mask_coverage(spark, sf):
    masks = table(spark, sf, "labels").select("doc_id").distinct().withColumn("has", F.lit(True))
    j = table(spark, sf, "documents").select("doc_id").join(masks, "doc_id", "left")
    st = F.when(F.col("has").isNull(), "blocked_missing_valid_mask_events").otherwise("ok")
    return j.groupBy(st.alias("status")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_event"))


@registered("bootstrap_fidelity_payloads", sql="""WITH p AS (SELECT l_suppkey, l_returnflag, CASE WHEN l_suppkey % 3 = 0 THEN 'published_uncertainty_10000'
   WHEN l_suppkey % 3 = 1 THEN 'methods_robustness_200' ELSE 'other' END AS level, CASE WHEN l_suppkey % 2 = 0 THEN 200 ELSE 10000 END AS n,
   l_suppkey % 3 = 0 AS pub FROM lineitem)
SELECT l_suppkey, CASE WHEN max(level) = 'other' THEN 'unknown_level' WHEN max(n) <> CASE max(level) WHEN 'methods_robustness_200' THEN 200 ELSE 10000 END
   THEN 'count_mismatch' ELSE 'ok' END AS status, count(*) AS payloads FROM p GROUP BY 1""")
def bootstrap_fidelity_payloads(spark, sf):
    s = F.col("l_suppkey")
    level = F.when(s % 3 == 0, "published_uncertainty_10000").when(s % 3 == 1, "methods_robustness_200").otherwise("other")
    n = F.when(s % 2 == 0, 200).otherwise(10000)
    declared = F.create_map(*[x for k, (c, _) in dims.BOOTSTRAP_FIDELITY.items() for x in (F.lit(k), F.lit(c))])
    li = table(spark, sf, "lineitem").select("l_suppkey", level.alias("level"), n.alias("n"))
    g = li.groupBy("l_suppkey").agg(audit.consistent_label(F.col("level")).alias("level"), F.min("n").alias("lo"),
                                    F.max("n").alias("hi"), F.count("*").alias("payloads"))
    want = declared[F.col("level")]
    return g.select("l_suppkey", F.when(want.isNull(), "unknown_level").when(
        (F.col("lo") != want) | (F.col("hi") != want), "count_mismatch").otherwise("ok").alias("status"), "payloads")


@registered("first_failing_stage", sql="""WITH s AS (SELECT conv_id, turn, role, CASE WHEN len(text) % 7 = 0 THEN 'failed' WHEN len(text) % 11 = 0 THEN 'blocked'
   ELSE 'succeeded' END AS status FROM conversations)
SELECT conv_id, count(*) AS stages, min(turn) FILTER (status <> 'succeeded') AS failed_ord,
  arg_min(role, turn) FILTER (status <> 'succeeded') AS failed_stage,
  coalesce(arg_min(status, turn) FILTER (status <> 'succeeded'), 'succeeded') AS status FROM s GROUP BY 1""")
def first_failing_stage(spark, sf):
    n = F.length("text")
    st = F.when(n % 7 == 0, "failed").when(n % 11 == 0, "blocked").otherwise("succeeded")
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("stage"), st.alias("status"))
    return audit.first_failing_stage(c, "conv_id")


@registered("weakest_status", sql="""SELECT user_id, arg_min(event_type, CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2
  WHEN 'signup' THEN 3 ELSE 4 END) AS weakest, count(*) AS n FROM events GROUP BY 1""")
def weakest_status(spark, sf):
    ranks = {"error": 0, "view": 1, "click": 2, "signup": 3, "purchase": 4}
    return table(spark, sf, "events").groupBy("user_id").agg(
        text.weakest(F.col("event_type"), ranks).alias("weakest"), F.count("*").alias("n"))


@registered("stage_order_dedupe", sql="""SELECT conv_id, role, min(turn) AS first_turn, count(*) AS repeats FROM conversations GROUP BY 1, 2""")
def stage_order_dedupe(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id", "role").agg(
        F.min("turn").alias("first_turn"), F.count("*").alias("repeats"))


@registered("locked_pick_digest", sql="""WITH r AS (SELECT l_orderkey,
   sha256(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey) AS h FROM lineitem), c AS (
  SELECT l_orderkey, h AS a, sha256(h || ':' || count(*)) AS h FROM r GROUP BY l_orderkey, r.h), m6 AS (
  SELECT l_orderkey, substr(a, 1, 6) AS a, sha256(string_agg(h, '' ORDER BY a)) AS h FROM c GROUP BY 1, substr(a, 1, 6)), m3 AS (
  SELECT l_orderkey, substr(a, 1, 3) AS a, sha256(string_agg(h, '' ORDER BY a)) AS h FROM m6 GROUP BY 1, substr(a, 1, 3)), d AS (
  SELECT l_orderkey, sha256(string_agg(h, '' ORDER BY a)) AS digest FROM m3 GROUP BY 1)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, digest FROM lineitem JOIN d USING (l_orderkey)""")
def locked_pick_digest(spark, sf):
    """Digest of an event's sorted picks, written back onto each of its rows."""
    from beamspark.sources.sinks import locked_digest

    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    d = locked_digest(li, "l_orderkey", F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return li.join(d, "l_orderkey").select("l_orderkey", big("l_linenumber").alias("l_linenumber"), "l_partkey", "digest")


@registered("alignment_run_summary", sql="""SELECT o_orderpriority, count(*) AS events, count(*) FILTER (o_orderstatus = 'O') AS succeeded,
  count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderstatus = 'P') AS skipped,
  CASE WHEN count(*) FILTER (o_orderstatus <> 'O') > 0 THEN 'failed' ELSE 'succeeded' END AS batch_status FROM orders GROUP BY 1""")
def alignment_run_summary(spark, sf):
    has = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("events"), has("O").alias("succeeded"), has("F").alias("failed"), has("P").alias("skipped"),
        F.when(F.count_if(F.col("o_orderstatus") != "O") > 0, "failed").otherwise("succeeded").alias("batch_status"))


@registered("fragment_first_failure", sql="""SELECT event_id, CASE WHEN k % 5 = 0 THEN 'alignment:k' || k WHEN k % 3 = 0 THEN 'preprocessing:k' || k ELSE 'none' END AS first_failure
FROM (SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events)""")
def fragment_first_failure(spark, sf):
    """Fragments as JSON check lists; the first failing item of the list is the reason."""
    k = F.get_json_object("props", "$.k").cast("int")
    item = lambda name, bad: F.struct(F.lit(name).alias("name"), (~bad).alias("ok"), k.alias("k"))
    frag = F.to_json(F.array(item("alignment", k % 5 == 0), item("preprocessing", k % 3 == 0)))
    e = table(spark, sf, "events").select("event_id", frag.alias("fragment"))
    items = F.from_json("fragment", "array<struct<name:string,ok:boolean,k:int>>")
    bad = F.try_element_at(F.filter(items, lambda i: ~i["ok"]), F.lit(1))
    return e.select("event_id", F.coalesce(F.concat(bad["name"], F.lit(":k"), bad["k"]), F.lit("none")).alias("first_failure"))


@registered("document_inventory", sql="""SELECT source, lang, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, count(DISTINCT sha256(text)) AS distinct_digests
FROM documents GROUP BY 1, 2""")
def document_inventory(spark, sf):
    d = table(spark, sf, "documents").select("source", "lang", F.octet_length("text").alias("n"), F.sha2("text", 256).alias("h"))
    # Copies of one text fold before the shuffle by source, so many copies cost one row.
    per = d.groupBy("source", "lang", "h").agg(F.count("*").alias("files"), F.sum("n").alias("bytes"))
    return per.groupBy("source", "lang").agg(
        F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.count("*").alias("distinct_digests"))


@registered("adverse_byte_flip", sql="""WITH d AS (
  SELECT doc_id, text, doc_id % 3 = 0 AS flipped, doc_id % 7 = 0 AS repinned FROM documents), m AS (SELECT doc_id, sha256(text) AS pin FROM d)
SELECT d.doc_id, flipped, repinned,
  sha256(CASE WHEN flipped THEN (CASE WHEN text[1] = '7' THEN '8' ELSE '7' END) || text[2:] ELSE text END) = m.pin AS passes
FROM d JOIN m ON m.doc_id = CASE WHEN repinned AND d.doc_id + 1 IN (SELECT doc_id FROM m) THEN d.doc_id + 1 ELSE d.doc_id END""")
def adverse_byte_flip(spark, sf):
    """Negative controls: a third of the files has one changed character, a seventh the pin of its neighbour.

    Pins are recorded from the texts as they were; what is presented is hashed anew and held against the recorded pin. Only
    copies pass with a neighbour's pin, and nothing passes with a changed character.
    """
    d = table(spark, sf, "documents")
    pins = d.select("doc_id", F.sha2("text", 256).alias("pin"))
    flipped, repinned = F.col("doc_id") % 3 == 0, F.col("doc_id") % 7 == 0
    changed = F.concat(F.when(F.substring("text", 1, 1) == "7", "8").otherwise("7"), F.expr("substring(text, 2)"))
    shown = d.select("doc_id", flipped.alias("flipped"), repinned.alias("repinned"), F.sha2(F.when(flipped, changed).otherwise(F.col("text")), 256).alias("shown"))
    nearby = pins.select((F.col("doc_id") - 1).alias("doc_id"), F.col("pin").alias("next_pin"))
    j = shown.join(pins, "doc_id").join(nearby, "doc_id", "left")
    pin = F.when(F.col("repinned"), F.coalesce("next_pin", "pin")).otherwise(F.col("pin"))
    return j.select("doc_id", "flipped", "repinned", (F.col("shown") == pin).alias("passes"))


@registered("path_safety", sql="""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/abs/' || page_id WHEN 1 THEN 'a/../b' WHEN 2 THEN '' WHEN 3 THEN 'a..b/c'
   ELSE 'ok/' || page_id END AS path FROM pages)
SELECT page_id, trim(path) <> '' AND NOT starts_with(path, '/') AND NOT regexp_matches(path, '(^|/)\\.\\.(/|$)') AS safe FROM p""")
def path_safety(spark, sf):
    k = F.col("page_id") % 5
    path = (F.when(k == 0, F.concat(F.lit("/abs/"), "page_id")).when(k == 1, F.lit("a/../b")).when(k == 2, F.lit(""))
            .when(k == 3, F.lit("a..b/c")).otherwise(F.concat(F.lit("ok/"), "page_id")))
    return table(spark, sf, "pages").select("page_id", text.is_safe_relative(path).alias("safe"))


@registered("preflight_findings", sql="""WITH f AS (SELECT s_suppkey, unnest(['negative_balance', 'unknown_nation', 'short_name']) AS code,
   unnest(['error', 'error', 'warning']) AS severity, unnest([s_acctbal < 0, s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 3), len(s_name) < 18]) AS hit FROM supplier)
SELECT code, severity, count(*) AS findings FROM f WHERE hit GROUP BY 1, 2""")
def preflight_findings(spark, sf):
    n = table(spark, sf, "nation").where("n_regionkey <> 3").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(True).alias("ok"))
    s = table(spark, sf, "supplier").join(n, "s_nationkey", "left")
    rows = s.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("code"), F.lit(v).alias("severity"), p.alias("hit")) for c, v, p in (
            ("negative_balance", "error", F.col("s_acctbal") < 0), ("unknown_nation", "error", F.col("ok").isNull()),
            ("short_name", "warning", F.length("s_name") < 18))])))
    return rows.where("hit").groupBy("code", "severity").agg(F.count("*").alias("findings"))


@registered("run_record_consistency", sql="""SELECT CASE WHEN o_orderstatus = 'P' THEN 'status_not_ok' WHEN (o_totalprice < 150000) <> (o_orderpriority < '3') THEN 'branch_disagrees'
  ELSE 'ok' END AS verdict, count(*) AS n FROM orders GROUP BY 1""")
def run_record_consistency(spark, sf):
    v = F.when(F.col("o_orderstatus") == "P", "status_not_ok").when(
        (F.col("o_totalprice") < 150000) != (F.col("o_orderpriority") < "3"), "branch_disagrees").otherwise("ok")
    return audit.status_counts(table(spark, sf, "orders").select(v.alias("verdict")), "verdict")


@registered("endpoint_names", sql="""SELECT n_name, r_name AS endpoint, count(s_suppkey) AS suppliers FROM nation JOIN region ON r_regionkey = n_regionkey
LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def endpoint_names(spark, sf):
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("k"))
    n = table(spark, sf, "nation").join(table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return n.join(s, "n_nationkey", "left").select("n_name", F.col("r_name").alias("endpoint"),
                                                   F.coalesce("k", F.lit(0).cast("bigint")).alias("suppliers"))


REPORT_SQL = """frag AS (
  SELECT 'inventory' AS "check", count(*) AS items, count(*) FILTER (NOT coalesce(json_extract_string(props, '$.k') IS NOT NULL, false)) AS failures,
         min(CASE WHEN json_extract_string(props, '$.k') IS NULL THEN event_id::VARCHAR END) AS first_failing FROM events
  UNION ALL SELECT 'benchmark', count(*), count(*) FILTER (NOT coalesce(length(text) > 0, false)), min(CASE WHEN NOT coalesce(length(text) > 0, false) THEN item_id::VARCHAR END) FROM benchmark
  UNION ALL SELECT 'bootstrap_fidelity', count(*), count(*) FILTER (len(embedding) <> 64), min(CASE WHEN len(embedding) <> 64 THEN vec_id::VARCHAR END) FROM embeddings
  UNION ALL SELECT 'type2_distance_stratified', count(*), count(*) FILTER (NOT (inside >= 16 AND n - inside >= 16)), min(CASE WHEN NOT (inside >= 16 AND n - inside >= 16) THEN label::VARCHAR END)
    FROM (SELECT label, count(*) AS n, count(*) FILTER (27.5 + (vec_id % 23) * 0.5 BETWEEN 29 AND 32) AS inside FROM embeddings GROUP BY 1)
  UNION ALL SELECT 'type3_alignment_jitter', count(*), count(*) FILTER (NOT l_discount <= 0.10), min(CASE WHEN NOT l_discount <= 0.10 THEN l_orderkey::VARCHAR END) FROM lineitem
  UNION ALL SELECT 'deglitch', count(*), count(*) FILTER (NOT coalesce(n_chars = length(text), false)), min(CASE WHEN NOT coalesce(n_chars = length(text), false) THEN doc_id::VARCHAR END) FROM documents
  UNION ALL SELECT 'model', count(*), count(*) FILTER (NOT p_size BETWEEN 1 AND 50), min(CASE WHEN NOT p_size BETWEEN 1 AND 50 THEN p_partkey::VARCHAR END) FROM part
  UNION ALL SELECT 'preprocessing', count(*), count(*) FILTER (o_orderstatus = 'P'), min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey::VARCHAR END) FROM orders
  UNION ALL SELECT 'preprocessing', count(*), count(*) FILTER (NOT s_acctbal > 0), min(CASE WHEN NOT s_acctbal > 0 THEN s_suppkey::VARCHAR END) FROM supplier),
names AS (SELECT unnest(['inventory', 'benchmark', 'bootstrap_fidelity', 'type2_distance_stratified', 'type3_alignment_jitter', 'deglitch', 'branch_registry', 'model',
  'preprocessing', 'alignment']) AS "check"), report AS (
  SELECT "check", coalesce(sum(items), 0)::BIGINT AS items, coalesce(sum(failures), 0)::BIGINT AS failures, min(first_failing) AS first_failing
  FROM names LEFT JOIN frag USING ("check") GROUP BY 1), stated AS (
  SELECT *, CASE WHEN failures > 0 THEN 'failed' WHEN items > 0 THEN 'passed' WHEN "check" = 'branch_registry' THEN 'not_requested' ELSE 'missing' END AS status FROM report)"""


def _report(spark, sf):
    """Nine fragments over nine tables: two of one check, one optional check not asked for, and one that is missing."""
    col = F.col
    lanes = table(spark, sf, "embeddings").groupBy("label").agg(
        F.count("*").alias("n"), F.count_if((F.lit(27.5) + F.pmod("vec_id", F.lit(23)) * 0.5).between(29.0, 32.0)).alias("inside"))
    rows = [
        ("events", "inventory", F.get_json_object("props", "$.k").isNotNull(), "event_id"), ("benchmark", "benchmark", F.length("text") > 0, "item_id"),
        ("embeddings", "bootstrap_fidelity", F.size("embedding") == 64, "vec_id"), ("lineitem", "type3_alignment_jitter", col("l_discount") <= 0.10, "l_orderkey"),
        ("documents", "deglitch", col("n_chars") == F.length("text"), "doc_id"), ("part", "model", col("p_size").between(1, 50), "p_partkey"),
        ("orders", "preprocessing", col("o_orderstatus") != "P", "o_orderkey"), ("supplier", "preprocessing", col("s_acctbal") > 0, "s_suppkey")]
    parts = [report.fragment(table(spark, sf, t), check, ok, col(item)) for t, check, ok, item in rows]
    parts.append(report.fragment(lanes, "type2_distance_stratified", (col("inside") >= 16) & (col("n") - col("inside") >= 16), col("label")))
    return report.merged(parts)


@registered("validation_report", sql="WITH " + REPORT_SQL + """ SELECT * FROM stated""")
def validation_report(spark, sf):
    return _report(spark, sf)


@registered("validation_report_verdict", sql="WITH " + REPORT_SQL + """, bad AS (
  SELECT *, "check" || ': ' || CASE status WHEN 'missing' THEN 'missing check' ELSE failures || '/' || items || ' failed, first ' || coalesce(first_failing, 'unknown') END AS named
  FROM stated WHERE status IN ('failed', 'missing'))
SELECT (SELECT count(*) FROM stated) AS checks, count(*) AS failed, coalesce(string_agg(named, '; ' ORDER BY named), '') AS failures, count(*) = 0 AS paper_ready FROM bad""")
def validation_report_verdict(spark, sf):
    return report.verdict(_report(spark, sf))
