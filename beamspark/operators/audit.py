"""Provenance, manifest and consistency checks as joins and grouped predicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamspark.functions import text


def manifest_digests(manifest: DataFrame) -> DataFrame:
    """Digest per path: the last entry that carries one. ``manifest``: (ord, path, sha256)."""
    last = F.max(F.when(~text.is_empty(F.col("sha256")), F.struct("ord", "sha256")))
    return manifest.groupBy("path").agg(last.alias("m"), F.count("*").alias("entries")).select(
        "path", F.col("m.sha256").alias("pinned_sha256"), "entries")


def audit_inputs(expected: DataFrame, manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Class of every expected path: unsafe, unpinned, missing, drifted or ok."""
    j = expected.join(manifest_digests(manifest), "path", "left").join(
        actual.select("path", F.col("sha256").alias("actual_sha256")), "path", "left")
    status = (
        F.when(~text.is_safe_relative(F.col("path")), "unsafe_path")
        .when(F.col("pinned_sha256").isNull(), "unpinned")
        .when(F.col("actual_sha256").isNull(), "missing_file")
        .when(F.col("pinned_sha256") != F.col("actual_sha256"), "checksum_mismatch").otherwise("ok"))
    return j.withColumn("status", status)


def status_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def first_violations(audit: DataFrame, n: int = 20) -> DataFrame:
    return audit.where("status <> 'ok'").select("path", "status").orderBy("path", "status").limit(n)


def verify_path_hash_arrays(df: DataFrame, key: str, digests: DataFrame) -> DataFrame:
    """Check parallel path and hash arrays against known digests; arrays of unequal length are refused."""
    equal = F.size("paths") == F.size("hashes")
    flat = df.select(key, equal.alias("equal"), F.explode_outer(F.when(equal, F.arrays_zip("paths", "hashes"))).alias("z"))
    flat = flat.select(key, "equal", F.col("z.paths").alias("path"), F.col("z.hashes").alias("claimed"))
    j = flat.join(digests, "path", "left")
    bad = F.col("sha256").isNull() | (F.col("sha256") != F.col("claimed"))
    g = j.groupBy(key).agg(F.bool_and("equal").alias("equal"), F.count("path").alias("checked_pairs"),
                           F.count_if(bad & F.col("path").isNotNull()).alias("errors"))
    status = (F.when(~F.col("equal") | (F.col("checked_pairs") == 0), "blocked_missing_current_provenance")
              .when(F.col("errors") > 0, "blocked_stale_provenance").otherwise("current"))
    return g.withColumn("status", status).drop("equal")


def transplanted(identity: DataFrame, pins: DataFrame) -> DataFrame:
    """Identity rows against pins: match, missing, mismatch, or a digest pinned under another locator."""
    j = identity.join(pins.select("locator", F.col("digest").alias("pinned")), "locator", "left")
    known = pins.select("digest").distinct().withColumn("known", F.lit(True))
    j = j.join(known, "digest", "left")
    status = (
        F.when(F.col("pinned") == F.col("digest"), "match")
        .when(F.col("known"), "transplanted_digest")
        .when(F.col("pinned").isNull(), "missing_pin").otherwise("digest_mismatch"))
    return j.withColumn("status", status).drop("known")


def compare_keyed(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Full key comparison of two runs: missing, extra, same or changed, with the difference."""
    a = old.select(*keys, F.col(value).alias("old"), F.lit(1).alias("in_old"))
    b = new.select(*keys, F.col(value).alias("new"), F.lit(1).alias("in_new"))
    j = a.join(b, list(keys), "full")
    same = F.col("old").eqNullSafe(F.col("new")) | (F.abs(F.col("new") - F.col("old")) <= tolerance)
    status = (F.when(F.col("in_new").isNull(), "missing").when(F.col("in_old").isNull(), "extra")
              .when(same, "same").otherwise("changed"))
    return j.select(*keys, (F.col("new") - F.col("old")).alias("delta"), status.alias("status"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def set_comparison(sides: dict[str, DataFrame], key: str) -> DataFrame:
    """Per pair of named sets: sizes, one-sided members, equality and subset, in one grouped pass."""
    names = list(sides)
    tagged = reduce(DataFrame.unionByName, [d.select(key, F.lit(n).alias("side")) for n, d in sides.items()])
    has = tagged.groupBy(key).agg(*[F.bool_or(F.col("side") == n).alias(n) for n in names])
    one = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            one.append(F.struct(
                F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(F.col(a) & F.col(b)).alias("shared"),
                F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(F.col(b) & ~F.col(a)).alias("only_b")))
    out = has.agg(F.array(*one).alias("p")).select(F.inline("p"))
    return out.withColumns({
        "equal": (F.col("only_a") == 0) & (F.col("only_b") == 0), "a_subset_b": F.col("only_a") == 0})


def hash_chain(levels: Sequence[DataFrame], key: str) -> DataFrame:
    """Walk artefacts level by level: each must name the digest its upstream really has.

    ``levels``: (key, sha256, upstream_sha256), first level first. Gives the first broken level, if any.
    """
    out = levels[0].select(key, F.col("sha256").alias("h0"))
    for i, level in enumerate(levels[1:], 1):
        out = out.join(level.select(key, F.col("sha256").alias(f"h{i}"), F.col("upstream_sha256").alias(f"u{i}")),
                       key, "left")
    broken = F.lit(None).cast("int")
    for i in range(len(levels) - 1, 0, -1):
        bad = F.col(f"h{i}").isNull() | F.col(f"u{i}").isNull() | (F.col(f"u{i}") != F.col(f"h{i - 1}"))
        broken = F.when(bad, i).otherwise(broken)
    status = F.when(broken.isNull(), "current").otherwise("blocked_stale_provenance")
    return out.select(key, broken.alias("first_broken_level"), status.alias("status"))


def lane_identity(df: DataFrame, pairs: dict[str, tuple[str, str]], require_current: bool) -> Column:
    """Status of payload fields against path fields: empty, mismatched or ok; the first field listed wins."""
    status = F.lit("ok")
    for payload, path in reversed(list(pairs.values())):
        p = F.col(payload)
        differs = text.lane_value(p) != F.coalesce(text.lane_value(F.col(path)), F.lit(""))
        empty = F.when(F.lit(require_current), "blocked_missing_current_provenance").otherwise(status)
        status = F.when(text.is_empty(p), empty).when(differs, "blocked_lane_identity_mismatch").otherwise(status)
    return status


def consistent_label(c: Column) -> Column:
    """Aggregate: the one value a group agrees on, else ``mixed``; null when it has none."""
    lo, hi = F.min(c), F.max(c)
    return F.when(lo == hi, lo).when(lo.isNotNull(), F.lit("mixed"))


def checks(df: DataFrame, keys: Sequence[str], named: dict[str, Column]) -> DataFrame:
    """Long check table (keys, check, status, failures) of row predicates, one pass over the rows."""
    agg = df.groupBy(*keys).agg(F.array(*[
        F.struct(F.lit(n).alias("check"), F.count_if(~F.coalesce(p, F.lit(False))).alias("failures"))
        for n, p in named.items()]).alias("c"))
    out = agg.select(*keys, F.inline("c"))
    return out.withColumn("status", F.when(F.col("failures") == 0, "passed").otherwise("failed"))


def overall(check_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strict verdict: every check passed; the first failing check by name is reported."""
    bad = F.col("status") != "passed"
    return check_rows.groupBy(*keys).agg(
        F.count_if(bad).alias("failed"), F.min(F.when(bad, F.col("check"))).alias("first_failed"),
        F.bool_and(~bad).alias("paper_ready"))


def deglitch_status(tool: Column, remover: Column, attested: Column, evidence: Column) -> Column:
    """State of one record: which tools ran, whether the remover attested and whether that was verified."""
    return (
        F.when(tool != "succeeded", "blocked_missing_seisglitch")
        .when(remover == "", "succeeded_mps_only")
        .when(remover != "succeeded", "ucla_unverified")
        .when(attested & evidence, "mps_ucla_verified")
        .when(attested, "sidecar_attested_not_independently_verified")
        .otherwise("ucla_unverified"))


def first_failing_stage(stages: DataFrame, key: str) -> DataFrame:
    """Earliest stage in order that did not succeed. ``stages``: (key, ord, stage, status)."""
    bad = F.min(F.when(F.col("status") != "succeeded", F.struct("ord", "stage", "status")))
    return stages.groupBy(key).agg(F.count("*").alias("stages"), bad.alias("b")).select(
        key, "stages", F.col("b.ord").alias("failed_ord"), F.col("b.stage").alias("failed_stage"),
        F.coalesce("b.status", F.lit("succeeded")).alias("status"))


def unpivot_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Changed fields of rows present on both sides, as (key, field, old, new)."""
    j = old.join(new.select(F.col(key), *[F.col(f).alias(f"new_{f}") for f in fields]), key)
    rows = j.select(key, F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old"), F.col(f"new_{f}").cast("string").alias("new"))
        for f in fields])))
    return rows.where(~F.col("old").eqNullSafe(F.col("new")))


def upstream_matches(registered: DataFrame, upstream: DataFrame) -> DataFrame:
    """Registered rows (source, path, ...) with the first upstream row (rid, source, path) that answers them.

    The same path comes first, else an upstream source that is part of the registered source; the smallest
    ``rid`` wins. Parts are looked up by an equality join: each distinct registered source gives its substrings
    of the lengths that upstream sources have (one row of numbers, no longer than the longest source), so that rows grow with
    its length and not with the square.
    """
    whole = upstream.groupBy("path").agg(F.min("rid").alias("by_path"))
    first = upstream.where("source <> ''").groupBy(F.col("source").alias("part")).agg(F.min("rid").alias("by_source"))
    names = registered.where("source <> ''").select("source").distinct()
    lengths = first.agg(F.collect_set(F.length("part")).alias("lengths"))
    size = F.length("source")
    fitting = F.filter("lengths", lambda n: n <= size)
    cuts = F.flatten(F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring("source", i, n))))
    names = names.crossJoin(F.broadcast(lengths))  # one row
    near = names.select("source", F.explode(F.array_distinct(cuts)).alias("part")).join(first, "part").groupBy("source").agg(F.min("by_source").alias("by_source"))
    j = registered.join(whole, "path", "left").join(near, "source", "left")
    by = F.when(F.col("by_path").isNotNull(), "path").when(F.col("by_source").isNotNull(), "source").otherwise("none")
    return j.withColumns({"matched": F.coalesce("by_path", "by_source"), "matched_by": by}).drop("by_path", "by_source")
